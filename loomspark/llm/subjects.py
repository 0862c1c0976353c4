"""Problem 8: subject areas of each document.

A multi-pattern automaton finds curated, weighted subject terms; in each sentence, line or passage the leftmost longest
matches count. A passage gives a subject the weight of its best term times that term's rarity, shared among the subjects
that the passage names unless it holds two terms of this one; a document's score is the sum over its passages, normalised
by its length. A subject is assigned where the score reaches the subject's threshold, calibrated on raters' labels, and
an exact check finds passages enough.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from importlib import resources

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.session import cut

_BREAK = re.compile(r"[.!?]+(?:\s+|$|(?=[A-ZÀ-Þ一-鿿]))|[。！？\n\r]+|</?(?:p|div|li|br|h[1-6]|td|tr)\b[^>]*>")
_SPACE = re.compile(r"[\s_\-‐-―]+")
_HAN = re.compile(r"[㐀-鿿]")

#: A score is divided by 1 + SLOPE * log(1 + passages / average), so that long documents need a little more.
SLOPE = 0.1
#: Passages that a subject needs, those shared with other subjects counting for their share: one of its own and one shared
#: aren't enough, one of its own and two shared are.
PASSAGES = 1.75
#: Thresholds are fitted on all labelled documents; a subject's own labels are joined by PRIOR of all subjects, whatever their
#: number; DEFAULT is used where there are no labels.
PRIOR, DEFAULT = 300, 0.8
#: The areas and their terms are held in memory by every task.
MOST_AREAS = 10_000


def curated(path: str | None = None) -> list[tuple[str, str, float]]:
    """(subject, term, weight) of a tab-separated file, weight 1 where there is none; the subpackage's own list by default."""
    text = open(path, encoding="utf-8").read() if path else (resources.files("loomspark.llm") / "resources/subject_terms.tsv").read_text(encoding="utf-8")
    rows = [line.split("\t") for line in text.splitlines() if line and not line.startswith("#")]
    return [(r[0], r[1], float(r[2]) if len(r) > 2 else 1.0) for r in rows]


def plain(text: str) -> str:
    return _SPACE.sub(" ", text.casefold()).strip()


class Matcher:
    """Terms found in a passage, by their number; in scripts with spaces they begin and end at word borders, a plural s allowed."""

    def __init__(self, terms: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for no, t in enumerate(terms):
            self.automaton.add_word(t, (no, len(t), not _HAN.search(t)))
        self.empty = not terms
        if terms:
            self.automaton.make_automaton()

    def terms(self, passage: str) -> list[int]:
        if self.empty:
            return []
        text = plain(passage)
        found = []
        for end, (no, size, bordered) in self.automaton.iter(text):
            start = end - size + 1
            if bordered:
                if start and text[start - 1].isalnum():
                    continue
                after = text[end + 1 : end + 3]
                if after[:1].isalnum() and not (after[0] == "s" and not after[1:].isalnum()):
                    continue
            found.append((start, -end, no))
        found.sort()
        out, last = [], -1
        for start, end, no in found:
            if start > last:
                out.append(no)
                last = -end
        return out

    def passages(self, text: str | None) -> tuple[int, list[list[int]]]:
        """(number of passages, terms of each that holds any)."""
        parts = [part for part in _BREAK.split(text) if part and not part.isspace()] if text else []
        return len(parts), [hits for part in parts if (hits := self.terms(part))]


@lru_cache(maxsize=4)
def _matcher(terms: tuple[str, ...]) -> Matcher:
    return Matcher(list(terms))


#: A term with its weight for each subject.
Terms = tuple[tuple[str, tuple[tuple[str, float], ...]], ...]


def term_list(areas: DataFrame, path: str | None = None) -> Terms:
    """The curated terms and the examples of the subject areas (a fixed table of a dozen rows), for its subjects only.

    An example's weight is 1 unless the list has it; where a term stands twice the greater weight holds.
    """
    named = areas.where("subject IS NOT NULL").select("subject", "example_terms")
    if (n := named.count()) > MOST_AREAS:
        raise ValueError(f"{n} subject areas; the term list is broadcast and holds {MOST_AREAS} at most")
    rows = [(r[0], r[1] or []) for r in named.collect()]
    names = {s.casefold(): s for s, _ in rows}
    weights: dict[tuple[str, str], float] = {}
    for s, t, w in curated(path):
        if s.casefold() in names and plain(t):
            key = (plain(t), names[s.casefold()])
            weights[key] = max(w, weights.get(key, 0.0))
    for s, examples in rows:
        for t in examples:
            if t and plain(t):
                weights.setdefault((plain(t), names[s.casefold()]), 1.0)
    of: dict[str, list[tuple[str, float]]] = {}
    for (t, s), w in sorted(weights.items()):
        of.setdefault(t, []).append((s, w))
    return tuple((t, tuple(x)) for t, x in of.items())


def hits(documents: DataFrame, terms: Terms) -> DataFrame:
    """(doc_id, passages, hits): of each text the number of its passages and the numbers of their terms, -1 before each passage."""
    names = tuple(t for t, _ in terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(names)
        for batch in batches:
            counts, offsets, values = [], [0], []
            for text in batch.column(1).to_pylist():
                n, found = matcher.passages(text)
                counts.append(n)
                for part in found:
                    values.append(-1)
                    values += part
                offsets.append(len(values))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), lists], names=["doc_id", "passages", "hits"])

    source = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    return source.mapInArrow(run, "doc_id bigint, passages bigint, hits array<int>")


def scores(found: DataFrame, terms: Terms) -> DataFrame:
    """(doc_id, subject, score, evidence) from hits: the normalised sum of weights, and the passages that speak for it.

    A term's rarity is i / (1 + i), with i the log of 1 + documents / those with it; so it depends on shares alone, not on
    the table's size. What reaches the driver is a count for each term of the list.
    """
    stats = found.agg(F.count("*").alias("n"), F.avg("passages").alias("average")).first()
    n, average = stats["n"] or 1, stats["average"] or 1.0
    held = found.select(F.explode(F.array_distinct(F.filter("hits", lambda x: x >= 0))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    counts = {r["term"]: r["df"] for r in held.collect()}
    rare = [math.log(1 + n / max(1, counts.get(i, 1))) for i in range(len(terms))]
    rarity = [x / (1 + x) for x in rare]
    worth = [tuple((s, w * rarity[i]) for s, w in of) for i, (_, of) in enumerate(terms)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, passages, numbers in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if not numbers:
                    continue
                total: dict[str, float] = {}
                evidence: dict[str, float] = {}
                best: dict[str, float] = {}
                often: dict[str, int] = {}
                for no in [*numbers[1:], -1]:
                    if no >= 0:
                        for s, x in worth[no]:
                            best[s] = max(x, best.get(s, 0.0))
                            often[s] = often.get(s, 0) + 1
                        continue
                    for s, x in best.items():
                        share = 1.0 if often[s] > 1 else 1 / len(best)
                        total[s] = total.get(s, 0.0) + x * share
                        evidence[s] = evidence.get(s, 0.0) + share
                    best, often = {}, {}
                norm = 1 + SLOPE * math.log(1 + passages / average)
                out += [(doc, s, x / norm, evidence[s]) for s, x in total.items()]
            columns = list(zip(*out)) if out else [[]] * 4
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "subject", "score", "evidence"])

    return found.mapInArrow(run, "doc_id bigint, subject string, score double, evidence double")


def _within(best: float, labels: float) -> float:
    """One standard error under the best F1."""
    return best - math.sqrt(max(0.0, best * (1 - best)) / labels)


def lowest(points: list[tuple[float, float, float]], missed: float) -> float | None:
    """The least threshold whose F1 is within one standard error of the best, by (score, weight, weight if labelled).

    It lies midway between the last score that it lets in and the next one below. missed: weight of labels without a score.
    This is the rule for points that one process holds; thresholds() follows it over a table.
    """
    points = sorted(points, reverse=True)
    labels = missed + sum(y for _, _, y in points)
    if not points or labels <= 0:
        return None
    found = right = 0.0
    by: dict[float, float] = {}
    for score, w, y in points:
        found, right = found + w, right + y
        by[score] = 2 * right / (found + labels)
    best = max(by.values())
    least = _within(best, labels)
    chosen = min(score for score, f1 in by.items() if f1 >= least)
    return (chosen + max((x for x in by if x < chosen), default=0.0)) / 2


def _judged(scored: DataFrame, labels: DataFrame, subjects: list[str]) -> DataFrame:
    """(score, cells, part): of all labelled documents the number of pairs with a score, and of those labelled, by subject number.

    Labels without a score stand at score null. A part is one partition, holds a range of scores and goes downwards.
    """
    given = labels.where("doc_id IS NOT NULL AND subject IS NOT NULL").select(F.col("doc_id").cast("long"), F.lower(F.trim("subject")).alias("subject")).distinct()
    seen = scored.join(given.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.lower("subject").alias("subject"), "score", F.lit(0).alias("y"))
    pairs = seen.unionByName(given.select("doc_id", "subject", F.lit(None).cast("double").alias("score"), F.lit(1).alias("y")))
    pairs = pairs.groupBy("doc_id", "subject").agg(F.max("score").alias("score"), F.max("y").alias("y"))
    numbers = scored.sparkSession.createDataFrame([(s.lower(), i) for i, s in enumerate(subjects)], "subject string, number int")
    cells = pairs.join(F.broadcast(numbers), "subject").groupBy("score", "number").agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    return cells.repartitionByRange("score").groupBy("score").agg(F.collect_list(F.struct("number", "n", "y")).alias("cells")).sortWithinPartitions(F.desc("score")).withColumn("part", F.spark_partition_id())


def thresholds(scored: DataFrame, labels: DataFrame, subjects: list[str]) -> dict[str, float]:
    """For each subject its threshold by the labels of all labelled documents.

    All subjects' labels, weighted as PRIOR, join a subject's own, so that few labels move its threshold little. The
    threshold is the least whose F1 is within one standard error of the best, so that noise among labels drops no case.
    Labels are compared without regard to case; null and repeated ones count once or not at all.

    F1 needs the counts above each score. Every part begins with those of the parts above it; what reaches the driver is some
    numbers for each part and subject, whatever the number of labels.
    """
    judged = cut(_judged(scored, labels, subjects))
    sums = judged.select("part", "score", F.inline("cells")).groupBy("part", F.isnull("score").alias("missed"), "number").agg(F.sum("n").alias("n"), F.sum("y").alias("y"), F.max("score").alias("top")).toArrow()
    k = len(subjects)
    own = np.zeros(k)
    tops: dict[int, float] = {}
    held: dict[int, np.ndarray] = {}
    for part, missed, s, n, y, top in zip(*(c.to_pylist() for c in sums.columns)):
        own[s] += y
        if not missed:
            tops[part] = max(top, tops.get(part, top))
            held.setdefault(part, np.zeros((2, k)))[:, s] = n, y
    if not tops or not own.any():
        return dict.fromkeys(subjects, DEFAULT)
    order = sorted(tops, key=tops.__getitem__, reverse=True)
    share = PRIOR / max(PRIOR, own.sum())
    weight = share * own.sum() + own
    above, total = {}, np.zeros((2, k))
    for part in order:
        above[part], total = total, total + held[part]

    def curves(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, int, np.ndarray]]:
        """(part, scores, subject, F1 at each score), a batch at a time."""
        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            before = above[part].copy() if before is None else before
            score = batch.column("score").to_numpy()
            row = pc.list_parent_indices(batch.column("cells")).to_numpy()
            number, *counts = (x.to_numpy() for x in pc.list_flatten(batch.column("cells")).flatten())
            pooled = [np.bincount(row, x, len(score)).cumsum() + b.sum() for x, b in zip(counts, before)]
            for s in range(k):
                mine = number == s
                found, right = (share * p + np.bincount(row[mine], x[mine], len(score)).cumsum() + b[s] for p, x, b in zip(pooled, counts, before))
                yield part, score, s, 2 * right / (found + weight[s])
            for x, b in zip(counts, before):
                b += np.bincount(number, x, k)

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, float] = {}
        for _, _, s, f1 in curves(batches):
            best[s] = max(f1.max(), best.get(s, 0.0))
        yield pa.RecordBatch.from_pydict({"subject": pa.array(best, pa.int32()), "f1": pa.array(best.values(), pa.float64())})

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each subject the last score within bounds, and the one below it, null at the part's end."""
        low: dict[int, tuple[int, float, float | None]] = {}
        for part, score, s, f1 in curves(batches):
            if s in low and low[s][2] is None:
                low[s] = (part, low[s][1], score[0])
            if len(fit := np.flatnonzero(f1 >= least[s])):
                i = fit[-1]
                low[s] = (part, score[i], score[i + 1] if i + 1 < len(score) else None)
        parts, chosen, below = zip(*low.values()) if low else ([], [], [])
        yield pa.RecordBatch.from_pydict({"subject": pa.array(low, pa.int32()), "part": pa.array(parts, pa.int32()), "score": pa.array(chosen, pa.float64()), "below": pa.array(below, pa.float64())})

    points = judged.where("score IS NOT NULL")
    best = points.mapInArrow(highest, "subject int, f1 double").groupBy("subject").agg(F.max("f1")).collect()
    least = {s: _within(f1, weight[s]) for s, f1 in best}
    ends = points.mapInArrow(last, "subject int, part int, score double, below double").groupBy("subject").agg(F.min_by(F.struct("part", "score", "below"), "score").alias("x")).select("subject", "x.*").collect()
    following = dict(zip(order, [tops[p] for p in order[1:]] + [0.0]))
    return {subjects[s]: (score + (following[part] if below is None else below)) / 2 for s, part, score, below in ends}


def document_subjects(documents: DataFrame, areas: DataFrame, labels: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, subject): every subject whose score reaches its threshold and that two passages speak for.

    Null, empty and blank texts have no subject; rows with one doc_id are judged each by itself and give a subject once;
    an empty table or no areas give no rows. Texts are read whole. Other columns aren't read.
    """
    terms = term_list(areas, path)
    subjects = sorted({s for _, of in terms for s, _ in of})
    spark = documents.sparkSession
    if not subjects:
        return spark.createDataFrame([], "doc_id bigint, subject string")
    scored = cut(scores(cut(hits(documents, terms)), terms))
    limits = thresholds(scored, labels, subjects)
    limit = F.create_map(*[F.lit(x) for s in subjects for x in (s, limits[s])])
    return scored.where((F.col("evidence") > PASSAGES - 1e-6) & (F.col("score") >= limit[F.col("subject")])).select("doc_id", "subject").distinct()
