"""Problem 4: values that lost their end.

A backward character n-gram model holds, for the last characters of a text, how often a text goes on after them and
how often one ends there. The score of a value is the log of how much more often its final context ends a text than a
context does on average; values whose score falls short of the threshold of their language and column are cut.
Counts are exact: only the final contexts of the values are counted, over all texts. A Bloom filter of them tells which
places of a text may hold one; what passes is added up by the context itself, so that false ones fall out.

An exact check follows: an open fence or a header without its block decides for a cut, and where a record's response
quotes the same program in a closed fence, the program is compared with it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.prose import slug
from loomspark.session import cut

#: Lengths in bytes of the contexts.
ORDERS = (4, 8, 16)
#: The filter has 16 bits a context; those of more than 2^28 bits (32 MB) go out one after the other, each for its share of
#: the contexts. Segments of a filter are merged in MERGES parts before the last merge.
FILTER_BITS, LEAST_FILTER, MOST_FILTER, FILTER_SEGMENT, MERGES = 16, 16, 28, 1 << 17, 64
#: Bytes of text whose contexts are looked up at once.
COUNTED = 1 << 17
#: Stands before a text; no byte of UTF-8.
GAP = b"\xff" * max(ORDERS)
#: A context met less often gives way to a shorter one. A value doesn't count among the ends it is compared with;
#: an end that no other value shares counts ALONE.
SEEN, ALONE = 25, 0.02
#: What a mark adds to the threshold.
MARKED = 2.0
COLUMNS = ("llm_response", "repaired_code")
#: Kinds of text that are counted apart: responses with and without a fenced block, and code by its language.
GROUPS = ("fenced", "bare", "py", "json")
#: Thresholds of the score lie in this range, at the emptiest place; a place one away from the middle must have EMPTY of the
#: values less. All languages of a column join a language's own values as PRIOR, whatever its number of values.
LOW, HIGH, STEP, MIDDLE, EMPTY, PRIOR = -0.3, 2.1, 0.3, 0.9, 0.0005, 200

_MARK = re.compile(r"\s*(?:\[(?:\.{3}|…|cut|truncated|snip)\]|<(?:cut|truncated|snip)>|\((?:\.{3}|…|cut|truncated|snip)\)|\.{3}|…|�+)\s*\Z")
LONGEST_MARK = 16
_DIGITS = bytes.maketrans(b"123456789", b"000000000")
_HEX = re.compile(rb"[0a-f]{16,}")  # digests read alike, once their digits are zeros
_FENCE = re.compile(r"^[ \t>]*(`{3,}|~{3,})", re.M)
_FENCED = re.compile(r"^[ \t]*(`{3,}|~{3,})[^\n`]*\n(.*?)\n?^[ \t]*\1[`~]*[ \t]*\r?$", re.S | re.M)
_P = np.uint64(0x9E3779B97F4A7C15)


def unmarked(text: str) -> tuple[str, bool]:
    """The text without white space at its end and without marks that a cut left; whether there was one."""
    text = text.rstrip()
    marked = False
    while found := _MARK.search(text, max(0, len(text) - LONGEST_MARK)):
        text, marked = text[: found.start()].rstrip(), True
    return text, marked


def _bytes(text: str) -> bytes:
    return _HEX.sub(b"0" * 12, text.encode("utf-8", "replace").replace(b"\r\n", b"\n").translate(_DIGITS))


def _rolling(data: np.ndarray) -> dict[int, np.ndarray]:
    """For each position, hashes of the contexts that end there, by doubling."""
    h = data.astype(np.uint64) + np.uint64(1)
    power, width, out = _P, 1, {}
    with np.errstate(over="ignore"):
        while width < max(ORDERS):
            longer = h.copy()
            longer[width:] += h[:-width] * power
            h = longer
            width, power = width * 2, power * power
            if width in ORDERS:
                out[width] = h
    return out


def _mixed(h: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ seed) * np.uint64(0xD6E8FEB86659FD93)
        return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def _seed(group: int) -> np.uint64:
    return np.uint64((group + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)


def code_language(name: str | None) -> str:
    return "json" if name and name.strip().lower().endswith("json") else "py"


def _probes(mixed: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Three places in a filter of 2^bits; the hash's order is part of what was mixed."""
    yield mixed >> np.uint64(64 - bits)
    yield mixed & np.uint64((1 << bits) - 1)
    with np.errstate(over="ignore"):
        yield (mixed * _P) >> np.uint64(64 - bits)


def _order_seed(group: int, order: int) -> np.uint64:
    return np.uint64((int(_seed(group)) ^ order * 0xC2B2AE3D27D4EB4F) & (1 << 64) - 1)


def _distinct(contexts: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of bytes and how often each occurs."""
    words = np.ascontiguousarray(contexts).view(np.uint32 if contexts.shape[1] == 4 else np.uint64)
    order = np.argsort(words[:, 0], kind="stable") if words.shape[1] == 1 else np.lexsort(words.T)
    words = words[order]
    starts = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]).any(axis=1)]))
    sums = np.diff(np.append(starts, len(words))) if counts is None else np.add.reduceat(counts[order], starts)
    return np.ascontiguousarray(words[starts]).view(np.uint8), sums


def _holds(held: np.ndarray, place: np.ndarray) -> np.ndarray:
    return ((held[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1)).view(np.bool_)


def _runs(texts: list[bytes], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, which of them are places): the texts in arrays that stay in a processor's cache.

    A text begins behind a gap; a later piece of a long one behind the bytes before it, which aren't its places.
    """
    parts: list[bytes] = []
    lengths: list[int] = []

    def made() -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(parts), np.uint8), np.repeat(np.arange(len(lengths)) % 2 == 1, lengths)

    n = 0
    for t in texts:
        for at in range(0, len(t), size):
            before, piece = t[at - len(GAP) : at] if at else GAP, t[at : at + size]
            parts += (before, piece)
            lengths += (len(before), len(piece))
            n += len(piece)
            if n >= size:
                yield made()
                parts, lengths, n = [], [], 0
    if parts:
        yield made()


def occurrences(texts: list[bytes], group: int, held: np.ndarray, bits: int, size: int = COUNTED) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(contexts, how often each occurs) by order, of those that pass the filter."""
    found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for data, inside in _runs(texts, max(size, len(GAP))):
        for order, h in _rolling(data).items():
            at, mixed = None, _mixed(h, _order_seed(group, order))
            for place in _probes(mixed, bits):
                if at is None:
                    at = np.flatnonzero(_holds(held, place) & inside)
                else:
                    at = at[_holds(held, place[at])]
            if len(at):
                found.setdefault(order, []).append(_distinct(np.lib.stride_tricks.sliding_window_view(data, order)[at - (order - 1)]))
    for parts in found.values():
        yield parts[0] if len(parts) == 1 else _distinct(np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts]))


def _clean(code: str) -> str:
    return code.replace("\r\n", "\n").rstrip()


def open_fence(text: str) -> bool:
    """Whether a fenced block is left open at the end."""
    fence = None
    for found in _FENCE.finditer(text):
        sign = found.group(1)
        if fence is None:
            fence = sign
        elif sign[0] == fence[0] and len(sign) >= len(fence):
            fence = None
    return fence is not None


def open_header(code: str) -> bool:
    """Whether the last line is a block's header without its block."""
    last = code.rsplit("\n", 1)[-1].strip()
    return bool(re.fullmatch(r"(?:async\s+)?(?:def|class|if|elif|else|for|while|try|except|finally|with)\b.*:", last)) and last.count("(") == last.count(")")


def quoted(code: str, response: str | None) -> bool | None:
    """True where the response quotes the code in a closed fence and goes on there; False where it quotes it whole."""
    if not response or "`" not in response and "~" not in response:
        return None
    for found in _FENCED.finditer(response):
        block = _clean(found.group(2))
        if block == code:
            return False
        if len(block) > len(code) >= 40 and block.startswith(code):
            return True
    return None


def _batches(batch: pa.RecordBatch, size: int = 1000) -> Iterator[tuple[list, list, list, list]]:
    for at in range(0, batch.num_rows, size):
        part = batch.slice(at, size)
        yield tuple(part.column(i).to_pylist() for i in range(4))


def _values(names: list, responses: list, codes: list, columns: tuple[str, ...]) -> Iterator[tuple[int, str, str, bool, int]]:
    """(row, column, text without its mark, marked, group) of the values that aren't blank."""
    for i, (name, response, code) in enumerate(zip(names, responses, codes)):
        for column, value in (("llm_response", response), ("repaired_code", code)):
            if column in columns and value and not value.isspace():
                text, marked = unmarked(value)
                if not text:
                    continue  # only a mark: nothing that could have been cut
                kind = code_language(name) if column == "repaired_code" else "fenced" if "```" in text or "~~~" in text else "bare"
                yield i, column, text, marked, GROUPS.index(kind)


def _source(records: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Only the columns needed; the response also serves as evidence for the code."""
    code = F.col("repaired_code") if "repaired_code" in columns else F.lit(None).cast("string").alias("repaired_code")
    return records.where("repair_id IS NOT NULL").select(F.col("repair_id").cast("long"), "filename", "llm_response", code)


def _ends(records: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(repair_id, field, language, marked, verdict, kind: the group, tail: the longest final context, size in bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from loomspark.llm.prose import language

        for batch in batches:
            for ids, names, responses, codes in _batches(batch):
                found = list(_values(names, responses, codes, columns))
                texts = [_bytes(t) for _, _, t, _, _ in found]
                verdicts: list[int | None] = []
                kinds = [(language(f[2]) or "und") if f[1] == "llm_response" else GROUPS[f[4]] for f in found]
                for i, column, text, marked, group in found:
                    if column == "llm_response":
                        verdicts.append(1 if open_fence(text) else None)
                    else:
                        said = quoted(_clean(text), responses[i])
                        if said is None and GROUPS[group] == "py" and open_header(text):
                            said = True
                        verdicts.append(None if said is None else int(said))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[f[0]] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string()), pa.array(kinds, pa.string()), pa.array([f[3] for f in found], pa.bool_()), pa.array(verdicts, pa.int32()), pa.array([f[4] for f in found], pa.int32()), pa.array([(GAP + t[-len(GAP) :])[-len(GAP) :] for t in texts], pa.binary()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["repair_id", "field", "language", "marked", "verdict", "kind", "tail", "size"],
                )

    return _source(records, columns).mapInArrow(run, "repair_id bigint, field string, language string, marked boolean, verdict int, kind int, tail binary, size bigint")


def _filter(wanted: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """The filter of the contexts and the bits of its size; what reaches the driver is 32 MB at most."""
    import pandas as pd

    bits = min(max((FILTER_BITS * size).bit_length(), LEAST_FILTER), MOST_FILTER)
    length = (1 << bits) // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(length, np.uint8)
        for batch in batches:
            kinds, contexts = np.array(batch.column(0).to_pylist()), batch.column(1).to_pylist()
            orders = np.array([len(c) for c in contexts])
            for group in range(len(GROUPS)):
                for order in ORDERS:
                    chosen = np.flatnonzero((kinds == group) & (orders == order))
                    if len(chosen):
                        h = _rolling(np.frombuffer(b"".join(contexts[i] for i in chosen), np.uint8))[order][order - 1 :: order]
                        for place in _probes(_mixed(h, _order_seed(group, order)), bits):
                            np.bitwise_or.at(held, place >> np.uint64(3), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
        parts = [(s, held[s : s + FILTER_SEGMENT]) for s in range(0, length, FILTER_SEGMENT)]
        parts = [(s, zlib.compress(x.tobytes(), 1)) for s, x in parts if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in parts], pa.int32()), pa.array([c for _, c in parts], pa.binary())], names=["s", "c"])

    def merge(pdf):
        total = None
        for raw in pdf["c"]:
            x = np.frombuffer(zlib.decompress(raw), np.uint8)
            total = x if total is None else total | x
        return pd.DataFrame({"s": [pdf["s"].iloc[0]], "c": [zlib.compress(total.tobytes(), 1)]})

    held = np.zeros(length, np.uint8)
    pieces = wanted.select("kind", "context").mapInArrow(run, "s int, c binary").withColumn("part", F.spark_partition_id() % MERGES)
    merged = pieces.groupBy("s", "part").applyInPandas(merge, "s int, c binary")
    for s, c in merged.groupBy("s").applyInPandas(merge, "s int, c binary").collect():
        part = np.frombuffer(zlib.decompress(bytes(c)), np.uint8)
        held[s : s + len(part)] = part
    return held, bits


def context_counts(records: DataFrame, ends: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """(kind, context, here: ends with it, everywhere: places after it): exact, for the final contexts of all values."""
    each = ends.groupBy("kind", "tail").agg(F.count("*").alias("here"))
    bare, fenced = GROUPS.index("bare"), GROUPS.index("fenced")
    each = each.unionByName(each.where(F.col("kind") == bare).select(F.lit(fenced).alias("kind"), "tail", F.lit(0).cast("long").alias("here")))
    contexts = F.explode(F.array(*[F.expr(f"substring(tail, {1 - o + len(GAP)}, {o})") for o in ORDERS])).alias("context")
    wanted = cut(each.select("kind", "here", contexts).groupBy("kind", "context").agg(F.sum("here").alias("here")))
    size = wanted.count()
    shares = max(1, -(-size * FILTER_BITS // (1 << MOST_FILTER)))
    everywhere = None
    for share in range(shares):
        own = wanted if shares == 1 else wanted.where(F.expr(f"pmod(xxhash64(kind, context), {shares}) = {share}"))
        held = records.sparkSession.sparkContext.broadcast(_filter(own, -(-size // shares)))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, names, responses, codes in _batches(batch):
                    texts: dict[int, list[bytes]] = {}
                    for _, _, text, _, group in _values(names, responses, codes, columns):
                        texts.setdefault(group, []).append(_bytes(text))
                    for group, own in texts.items():
                        for found, counts in occurrences(own, group, *held.value):
                            n, order = found.shape
                            key = pa.FixedSizeBinaryArray.from_buffers(pa.binary(order), n, [None, pa.py_buffer(found.tobytes())]).cast(pa.binary())
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, group, np.int32)), key, pa.array(counts.astype(np.int64))], names=["kind", "context", "n"])

        counted = _source(records, columns).mapInArrow(run, "kind int, context binary, n bigint").groupBy("kind", "context").agg(F.sum("n").alias("n"))
        counted = own.join(counted, ["kind", "context"], "left").select("kind", "context", "here", F.coalesce("n", F.lit(0)).alias("everywhere"))
        everywhere = counted if everywhere is None else everywhere.unionByName(counted)
    return everywhere


def scored(records: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """(repair_id, field, language, score, marked, verdict): a row for each value that isn't blank.

    score is the log of (share of the final context among ends / its share among all places); low for texts cut off. A
    response without a block may also end the way that those with a block do. verdict is what the exact check says: 1
    cut, 0 whole, null nothing.
    """
    ends = cut(_ends(records, columns))
    counts = cut(context_counts(records, ends, columns))
    bare, fenced = GROUPS.index("bare"), GROUPS.index("fenced")
    tails = ends.select("kind", "tail").distinct()
    tails = tails.withColumn("as", F.explode(F.when(F.col("kind") == bare, F.array(F.lit(bare), F.lit(fenced))).otherwise(F.array("kind"))))
    for o in ORDERS:
        own = counts.select(F.col("kind").alias("as"), F.col("context").alias(f"c{o}"), F.col("here").alias(f"h{o}"), F.col("everywhere").alias(f"e{o}"))
        tails = tails.withColumn(f"c{o}", F.expr(f"substring(tail, {1 - o + len(GAP)}, {o})")).join(own, ["as", f"c{o}"])
    sizes = ends.groupBy(F.col("kind").alias("as")).agg(F.sum("size").alias("places"), F.count("*").alias("values"))
    lift = {o: (F.greatest(F.col(f"h{o}") - 1, F.lit(0)) + ALONE) / F.greatest(F.col(f"e{o}"), F.lit(1)) * F.col("places") / F.col("values") for o in ORDERS}
    chosen = lift[min(ORDERS)]
    for o in sorted(ORDERS)[1:]:
        chosen = F.when(F.col(f"e{o}") >= SEEN, lift[o]).otherwise(chosen)
    scores = tails.join(F.broadcast(sizes), "as").groupBy("kind", "tail").agg(F.max(F.log(chosen)).alias("score"))
    return ends.join(scores, ["kind", "tail"]).select("repair_id", "field", "language", "score", "marked", "verdict")


def thresholds(values: DataFrame) -> dict[tuple[str, str], float]:
    """For each language and column, the emptiest place of the scores between LOW and HIGH, near to MIDDLE.

    A place's density is that among the language's values and, weighing as PRIOR values, that among all of the column's;
    its neighbours count half.
    """
    place = F.when((F.col("score") >= LOW) & (F.col("score") < HIGH), F.floor((F.col("score") - LOW) / STEP).cast("int"))
    own: dict[tuple[str, str], dict[int | None, int]] = {}
    column: dict[str, dict[int | None, int]] = {}
    for language, field, k, n in values.groupBy("language", "field", place.alias("k")).count().collect():  # a few a language
        own.setdefault((language, field), {})[k] = n
        all_ = column.setdefault(field, {})
        all_[k] = all_.get(k, 0) + n
    at = [LOW + STEP * (i + 0.5) for i in range(round((HIGH - LOW) / STEP))]
    out = {}
    for key, have in own.items():
        all_, n = column[key[1]], sum(have.values())
        total = sum(all_.values())
        density = [(have.get(i, 0) + PRIOR * all_.get(i, 0) / total) / (n + PRIOR) for i in range(len(at))]
        near = [density[0], *density, density[-1]]
        smooth = [(a + 2 * b + c) / 4 for a, b, c in zip(near, near[1:], near[2:])]
        out[key] = at[min(range(len(at)), key=lambda i: (smooth[i] + EMPTY * abs(at[i] - MIDDLE), i))]
    return out


def cut_values(records: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """(repair_id, field, language): the values that lost their end.

    Null and blank values are no case; rows with one repair_id come out once for each field; an empty table gives no
    rows; long texts are read whole. A mark of the cut is taken off before the context is judged.
    """
    values = cut(scored(records, columns))
    limits = thresholds(values)
    if not limits:
        return values.select("repair_id", "field", "language")
    limit = F.create_map(*[F.lit(x) for k, v in sorted(limits.items()) for x in ("/".join(k), v)])
    low = F.col("score") < limit[F.concat_ws("/", "language", "field")] + F.when(F.col("marked"), MARKED).otherwise(0.0)
    said = F.col("verdict")
    return values.where(F.coalesce(said == 1, F.lit(False)) | (low & F.coalesce(said != 0, F.lit(True)))).select("repair_id", "field", "language").distinct()


def cut_rates(records: DataFrame, found: DataFrame) -> DataFrame:
    """Values that aren't blank, cut values and their share by source (model in one spelling) and field."""
    blank = {c: F.coalesce(F.length(F.regexp_replace(c, r"\s", "")), F.lit(0)) == 0 for c in COLUMNS}
    each = records.where("repair_id IS NOT NULL").select("repair_id", F.coalesce(slug(F.col("model")), F.lit("unknown")).alias("model"), *[(~b).alias(c) for c, b in blank.items()])
    each = each.groupBy("repair_id").agg(F.min("model").alias("model"), *[F.max(c).alias(c) for c in COLUMNS])
    long = each.select("repair_id", "model", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("has")) for c in COLUMNS])).alias("x")).where("x.has").select("repair_id", "model", "x.field")
    both = long.join(found.select("repair_id", "field", F.lit(1).alias("bad")), ["repair_id", "field"], "left")
    return both.groupBy("model", "field").agg(F.count("*").alias("values"), F.count("bad").alias("cut")).withColumn("rate", F.round(F.col("cut") / F.col("values"), 6))
