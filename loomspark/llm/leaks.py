"""Problem 7: passages of test items in training documents.

The test items are a BM25 inverted index with block maxima. Every passage of every document is a query: windows of
twice the run looked for, one run apart, so that each run of words lies whole in some window; where no run of indexed
words lies in a window, its bound is nothing and it is skipped. The score a run of the
item must at least give its passage is that item's threshold, so that the search by block-max WAND loses none; what
it retrieves is verified word by word, and against the item's answer. One scan of the documents serves all shards of the
index that a task may hold at once.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")
#: Fixed parameters: BM25 as usual, words of a run, postings of a block, characters of one shard of the index, shards of a scan.
K1, B, RUN, BLOCK, SHARD_CHARS, SHARDS = 1.2, 0.75, 15, 16, 4_000_000, 4


#: Behind the last block of every list.
END = 1 << 60
_FIRST = itemgetter(0)


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, without regard to case."""
    return _WORD.findall(text.casefold()) if text else []


class Index:
    """Inverted index of test items; the weight of a term in an item is a share of that item's threshold."""

    def __init__(self, items: list[tuple[str, str | None, str | None]], run: int = RUN):
        self.run = run
        texts = [(i, words(q), answer) for i, q, answer in items]
        self.items = [(i, w, answer) for i, w, answer in texts if len(w) >= run]
        n = len(self.items)
        df = Counter(t for _, w, _ in self.items for t in set(w))
        average = sum(len(w) for _, w, _ in self.items) / max(1, n)
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        self.runs: list[set[str]] = []
        for no, (_, w, _) in enumerate(self.items):
            tf = Counter(w)
            norm = K1 * (1 - B + B * len(w) / average)
            weight = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + norm) for t, f in tf.items()}
            starts = range(len(w) - run + 1)
            least = min(sum(weight[t] for t in set(w[s : s + run])) for s in starts)
            self.runs.append({" ".join(w[s : s + run]) for s in starts})
            for t, x in weight.items():
                postings[t].append((no, x / least))
        self.top = {t: max(x for _, x in p) for t, p in postings.items()}
        #: of each term: its blocks of item numbers in order (with an end), their greatest weights and their weights
        self.lists: dict[str, tuple[list[int], list[float], list[np.ndarray]]] = {}
        for t, p in postings.items():
            held: dict[int, np.ndarray] = {}
            for no, x in p:
                held.setdefault(no // BLOCK, np.zeros(BLOCK))[no % BLOCK] = x
            self.lists[t] = ([*held, END], [float(v.max()) for v in held.values()], list(held.values()))
        self.codes = [{line.strip() for line in (a or "").splitlines() if len(line.strip()) >= 20} for _, _, a in self.items]

    def search(self, terms: set[str], least: float = 1 - 1e-9) -> list[int]:
        """All items that score at least their threshold, by block-max WAND over the terms' lists of blocks.

        Each list has a cursor. In the order of their blocks, the lists up to the first at which their greatest weights
        together reach the threshold name the pivot; lists behind it skip to it. There the blocks' own maxima must reach
        the threshold too before the block is scored, and the lists at it move on.
        """
        top = self.top
        known = [t for t in terms if t in top]
        if sum([top[t] for t in known]) < least:
            return []
        out: list[int] = []
        # [current block, greatest weight, blocks, maxima, weights, cursor]
        live = [[self.lists[t][0][0], top[t], *self.lists[t], 0] for t in known]
        while True:
            live.sort(key=_FIRST)
            bound, pivot = 0.0, END
            for x in live:
                bound += x[1]
                if bound >= least:
                    pivot = x[0]
                    break
            if pivot == END:
                return out
            if live[0][0] == pivot:
                here = [x for x in live if x[0] == pivot]
                if sum([x[3][x[5]] for x in here]) >= least:
                    score = sum([x[4][x[5]] for x in here])
                    out += [pivot * BLOCK + int(i) for i in np.flatnonzero(score >= least)]
                for x in here:
                    x[5] += 1
                    x[0] = x[2][x[5]]
            else:
                for x in live:
                    if x[0] >= pivot:
                        break
                    x[5] = bisect_left(x[2], pivot, x[5])
                    x[0] = x[2][x[5]]

    def _stretch(self, w: list[str], spans: list[tuple[int, int]], item: int) -> int:
        """Words of the longest stretch of the text all of whose runs are the item's."""
        have, run, best = self.runs[item], self.run, 0
        for first, end in spans:
            now = 0
            for s in range(first, end - run + 1):
                now = now + 1 if " ".join(w[s : s + run]) in have else 0
                best = max(best, now)
        return best + run - 1

    def leaks(self, text: str | None) -> list[tuple[int, int, float]]:
        """(item, words of its longest run in the text, share of its answer's lines that the text holds)."""
        w = words(text)
        run = self.run
        if len(w) < run:
            return []
        retrieved: set[int] = set()
        # A window without `run` indexed words in a row has an upper bound of nothing for any run: it is skipped whole.
        known = [t in self.top for t in w]
        spans, start = [], None
        for at, yes in enumerate([*known, False]):
            if yes and start is None:
                start = at
            elif not yes and start is not None:
                if at - start >= run:
                    spans.append((start, at))
                start = None
        for first, end in spans:
            for start in range(first, end - run + 1, run):
                window = w[start : min(start + 2 * run, end)]
                if items := self.search(set(window)):
                    said = {" ".join(window[s : s + run]) for s in range(len(window) - run + 1)}
                    retrieved.update(i for i in items if not said.isdisjoint(self.runs[i]))
        if not retrieved:
            return []
        longest = {i: self._stretch(w, spans, i) for i in retrieved}
        lines = {x.strip() for x in text.splitlines()}
        return [(i, n, len(self.codes[i] & lines) / len(self.codes[i]) if self.codes[i] else 0.0) for i, n in sorted(longest.items())]


def _shards(items: DataFrame) -> int:
    """Number of shards by hash of which none has more than SHARD_CHARS characters, but for an item longer by itself."""
    size = F.coalesce(F.length("q"), F.lit(0)) + F.coalesce(F.length("a"), F.lit(0))
    total, most = items.select(size.alias("n")).agg(F.sum("n"), F.max("n")).first()
    n = max(1, math.ceil((total or 0) / SHARD_CHARS))
    while n > 1:
        held = items.groupBy(F.expr(f"pmod(xxhash64(task_id), {n})")).agg(F.sum(size).alias("n")).agg(F.max("n")).first()[0]
        if held <= max(SHARD_CHARS, 2 * most):
            break
        n *= 2
    return n


def leaks(documents: DataFrame, tasks: DataFrame, solutions: DataFrame | None = None) -> DataFrame:
    """(doc_id, task_id, run_words, answer_share): documents that hold RUN consecutive words of a task's requirement.

    The items are indexed in shards of SHARD_CHARS characters; SHARDS of them are broadcast for one scan and meet every
    passage of every document, whole. Items or documents that are null or shorter than a run give no rows; rows that
    repeat a document or an item repeat no result; items with equal texts each come out. Other columns aren't read.
    """
    items = tasks.where("task_id IS NOT NULL").groupBy("task_id").agg(F.max("requirement").alias("q"))
    if solutions is None:
        items = items.withColumn("a", F.lit(None).cast("string"))
    else:
        items = items.join(solutions.groupBy("task_id").agg(F.max("code").alias("a")), "task_id", "left")
    spark = documents.sparkSession
    n = _shards(items)
    texts = documents.where("text IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    schema = "doc_id bigint, task_id string, run_words int, answer_share double"
    found = None
    for first in range(0, n, SHARDS):
        held = []
        for shard in range(first, min(n, first + SHARDS)):
            part = items.where(F.expr(f"pmod(xxhash64(task_id), {n}) = {shard}")).orderBy("task_id").select("task_id", "q", "a")
            held.append(spark.sparkContext.broadcast([tuple(r) for r in part.collect()]))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            indexes = [Index(x.value) for x in held]
            for batch in batches:
                rows = [(d, index.items[i][0], k, share) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for index in indexes for i, k, share in index.leaks(t)]
                columns = list(zip(*rows)) if rows else [[], [], [], []]
                kinds = (pa.int64(), pa.string(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "task_id", "run_words", "answer_share"])

        one = texts.mapInArrow(run, schema)
        found = one if found is None else found.unionByName(one)
    return found.groupBy("doc_id", "task_id").agg(F.max("run_words").alias("run_words"), F.max("answer_share").alias("answer_share"))
