"""Problem 1: tokens of each record, in a state that is maintained: counts by content, facts of records and cells.

The count table has the tokens of each content by its 128-bit hash and the hash of the tokenizer's vocabulary. An update
hashes all texts in one pass and encodes those that a Bloom filter of the known hashes doesn't hold; what the filter holds
wrongly is encoded in a second pass by a filter of its own. So the filters only decide where a text is encoded, no text
leaves its task, and a content is encoded again only by workers that meet it at the same time. The cells change by signed
deltas: of records that came (+) and went (-), added up by slice and hash before the hashes meet the count table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.encode import BYTE_BPE_50K
from loomspark.llm.prose import language_name, slug
from loomspark.session import cut

FIELDS = ("prompt", "llm_response")
SLICE = ("model", "lang", "dll")
#: Bits of a filter: 16 a hash, 32 MB at most; a fuller filter leaves more to the second pass, the result is the same.
BITS_A_HASH, LEAST_BITS, MOST_BITS = 16, 13, 28
#: Contents whose tokens a worker keeps.
KEPT = 100_000


class State(NamedTuple):
    """counts (tokenizer, hash, tokens); facts (repair_id, slice, hash of each field); cells (slice, records, tokens of each field)."""

    counts: DataFrame
    facts: DataFrame
    cells: DataFrame


@lru_cache(maxsize=8)
def tokenizer_hash(vocabulary: str) -> str:
    """Hash of the vocabulary's bytes and of the pattern that parts the words: what the counts depend on."""
    from xxhash import xxh3_128

    from loomspark.llm.bpe import PATTERN

    with open(vocabulary, "rb") as f:
        return xxh3_128(f.read() + PATTERN.encode()).hexdigest()


def empty_state(spark: SparkSession, fields: Sequence[str] = FIELDS) -> State:
    names = ", ".join(f"{c} string" for c in SLICE)
    return State(
        spark.createDataFrame([], "tokenizer string, hash binary, tokens bigint"),
        spark.createDataFrame([], f"repair_id bigint, {names}, " + ", ".join(f"{f}_h binary" for f in fields)),
        spark.createDataFrame([], f"{names}, records bigint, " + ", ".join(f"{f}_tokens bigint" for f in fields)),
    )


def save(state: State, folder: str) -> str:
    """Writes the state as a new version below the folder and returns its path."""
    path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
    for name, df in zip(State._fields, state):
        df.write.parquet(f"{path}/{name}")
    return path


def load(spark: SparkSession, path: str) -> State:
    return State(*[spark.read.parquet(f"{path}/{name}") for name in State._fields])


class Filter:
    """Bloom filter of 128-bit hashes; the hash's own bits are its places."""

    def __init__(self, bits: int, held: np.ndarray | None = None):
        self.bits = bits
        self.held = np.zeros((1 << bits) // 8, np.uint8) if held is None else held

    def places(self, raw: bytes) -> tuple[int, int, int]:
        a, b, most = int.from_bytes(raw[:8], "little"), int.from_bytes(raw[8:], "little"), (1 << self.bits) - 1
        return a & most, b & most, (a >> 32 ^ b >> 32) & most

    def add(self, hashes: list[bytes]) -> None:
        if hashes:
            words = np.frombuffer(b"".join(hashes), np.uint64).reshape(-1, 2)
            most = np.uint64((1 << self.bits) - 1)
            for place in (words[:, 0] & most, words[:, 1] & most, (words[:, 0] >> np.uint64(32) ^ words[:, 1] >> np.uint64(32)) & most):
                np.bitwise_or.at(self.held, place >> np.uint64(3), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))

    def __contains__(self, raw: bytes) -> bool:
        return all(self.held[p >> 3] >> (p & 7) & 1 for p in self.places(raw))


def hash_filter(hashes: DataFrame) -> tuple[int, np.ndarray] | None:
    """(bits, filter) of a column of hashes, None of none; partitions' filters are merged segment by segment before the driver."""
    rows = hashes.count()
    if not rows:
        return None
    bits = min(max((rows * BITS_A_HASH).bit_length(), LEAST_BITS), MOST_BITS)
    segment = 1 << 17

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        own = Filter(bits)
        for batch in batches:
            own.add(batch.column(0).to_pylist())
        parts = [(s, own.held[s : s + segment]) for s in range(0, len(own.held), segment)]
        parts = [(s, zlib.compress(x.tobytes(), 1)) for s, x in parts if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], names=["s", "c"])

    def merge(pdf):
        import zlib

        import pandas as pd

        total = None
        for raw in pdf["c"]:
            x = np.frombuffer(zlib.decompress(raw), np.uint8)
            total = x if total is None else total | x
        return pd.DataFrame({"s": [pdf["s"].iloc[0]], "c": [zlib.compress(total.tobytes(), 1)]})

    import zlib

    whole = np.zeros((1 << bits) // 8, np.uint8)
    made = hashes.select("hash").mapInArrow(mark, "s int, c binary")
    made = made.withColumn("part", F.spark_partition_id() % 64).groupBy("s", "part").applyInPandas(merge, "s int, c binary")
    for s, c in made.groupBy("s").applyInPandas(merge, "s int, c binary").collect():
        part = np.frombuffer(zlib.decompress(bytes(c)), np.uint8)
        whole[s : s + len(part)] = part
    return bits, whole


def content_facts(records: DataFrame, fields: Sequence[str] = FIELDS, vocabulary: str = BYTE_BPE_50K, skip=None) -> DataFrame:
    """One row a record: names as written, language of the prompt, and of each field its content hash and tokens.

    skip is a broadcast filter of hashes: what it holds isn't encoded, its tokens are null. Null and empty texts have the
    hash null and no tokens.
    """
    columns = ", ".join(f"{f}_h binary, {f}_n bigint" for f in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        from loomspark.llm.bpe import transducer
        from loomspark.llm.prose import language

        count = transducer(vocabulary).count
        known = Filter(*skip.value) if skip is not None else ()
        kept: dict[bytes, int] = {}

        def tokens(raw: bytes, text: str) -> int | None:
            n = kept.get(raw)
            if n is None and raw not in known:
                if len(kept) >= KEPT:
                    kept.clear()
                n = kept[raw] = count(text)
            return n

        for batch in batches:
            texts = [batch.column(4 + i).to_pylist() for i in range(len(fields))]
            out = [batch.column(0), batch.column(1), pa.array([language(x) for x in texts[0]], pa.string()), batch.column(2), batch.column(3)]
            for column in texts:
                hashes = [xxh3_128_digest(x.encode("utf-8", "surrogatepass")) if x else None for x in column]
                out.append(pa.array(hashes, pa.binary()))
                out.append(pa.array([tokens(h, x) if h is not None else 0 for h, x in zip(hashes, column)], pa.int64()))
            yield pa.RecordBatch.from_arrays(out, schema=schema)

    schema = pa.schema([("repair_id", pa.int64()), *[(c, pa.string()) for c in ("model", "lang", "declared", "dll")], *[x for f in fields for x in ((f"{f}_h", pa.binary()), (f"{f}_n", pa.int64()))]])
    source = records.select(F.col("repair_id").cast("long"), *[F.col(c).cast("string") for c in ("model", "lang", "dll")], *[F.col(f).cast("string") for f in fields])
    return source.mapInArrow(run, f"repair_id bigint, model string, lang string, declared string, dll string, {columns}")


def missing_counts(records: DataFrame, wanted, fields: Sequence[str] = FIELDS, vocabulary: str = BYTE_BPE_50K) -> DataFrame:
    """(hash, tokens) of the contents that a broadcast filter holds: the second pass, of what the first one skipped wrongly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        from loomspark.llm.bpe import transducer

        count, only = transducer(vocabulary).count, Filter(*wanted.value)
        for batch in batches:
            made: dict[bytes, int] = {}
            for i in range(len(fields)):
                for x in batch.column(i).to_pylist():
                    if x and (raw := xxh3_128_digest(x.encode("utf-8", "surrogatepass"))) not in made and raw in only:
                        made[raw] = count(x)
            yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.binary()), pa.array(list(made.values()), pa.int64())], names=["hash", "tokens"])

    return records.select(*[F.col(f).cast("string") for f in fields]).mapInArrow(run, "hash binary, tokens bigint")


def _tidy(facts: DataFrame) -> DataFrame:
    """One row a record, with the names in one spelling; a language that the prompt doesn't show is the declared one."""
    rest = [c for c in facts.columns if c not in ("model", "lang", "declared", "dll")]
    return facts.select(
        *rest,
        F.coalesce(slug(F.col("model")), F.lit("unknown")).alias("model"),
        F.coalesce(F.col("lang"), language_name(F.col("declared")), F.lit("und")).alias("lang"),
        F.coalesce(slug(F.col("dll")), F.lit("unknown")).alias("dll"),
    )


def _distinct(facts: DataFrame) -> DataFrame:
    """One row for each repair_id; rows without one stay rows of their own."""
    rest = [c for c in facts.columns if c != "repair_id"]
    own = F.when(F.col("repair_id").isNull(), F.monotonically_increasing_id()).alias("row")
    return facts.select("*", own).groupBy("repair_id", "row").agg(F.min(F.struct(*rest)).alias("x")).select("repair_id", "x.*")


def signed(old: DataFrame, new: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """(slice, hash of each field, side): how many records more (or, below 0, fewer) have these; what stayed is left out."""
    key = [*SLICE, *[f"{f}_h" for f in fields]]
    count = lambda df, sign: df.groupBy(*key).agg((F.count("*") * sign).alias("side"))
    return count(old, -1).unionByName(count(new, 1)).groupBy(*key).agg(F.sum("side").alias("side")).where("side <> 0")


def delta_cells(changed: DataFrame, counts: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """Signed cells of what changed. A content meets the count table once for each slice, however many records hold it."""
    parts = [changed.groupBy(*SLICE).agg(F.sum("side").alias("records"), *[F.lit(0).cast("long").alias(f"{f}_tokens") for f in fields])]
    for f in fields:
        each = changed.where(F.col(f"{f}_h").isNotNull()).groupBy(*SLICE, F.col(f"{f}_h").alias("hash")).agg(F.sum("side").alias("side")).where("side <> 0")
        cells = each.join(counts, "hash").groupBy(*SLICE).agg(F.sum(F.col("side") * F.col("tokens")).alias("n"))
        parts.append(cells.select(*SLICE, F.lit(0).cast("long").alias("records"), *[(F.col("n") if g == f else F.lit(0)).cast("long").alias(f"{g}_tokens") for g in fields]))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy(*SLICE).agg(*[F.sum(c).alias(c) for c in ("records", *[f"{f}_tokens" for f in fields])])


def apply_delta(cells: DataFrame, *deltas: DataFrame) -> DataFrame:
    """Cells after signed deltas; a cell without records is gone."""
    values = [c for c in cells.columns if c not in SLICE]
    whole = cells
    for d in deltas:
        whole = whole.unionByName(d)
    return whole.groupBy(*SLICE).agg(*[F.sum(v).alias(v) for v in values]).where(F.col("records") != 0)


def update(records: DataFrame, state: State, fields: Sequence[str] = FIELDS, vocabulary: str = BYTE_BPE_50K) -> State:
    """The state of these records, from that of any others: records that aren't there any more count as removed.

    One record for each repair_id, and the rows without one as they are. Null and empty texts count 0. An empty table
    gives no facts and no cells; contents of removed records stay in the count table. Other columns aren't read.
    """
    spark = records.sparkSession
    name = tokenizer_hash(vocabulary)
    have = state.counts.where(F.col("tokenizer") == name).select("hash", "tokens")
    known = hash_filter(have)
    skip = None if known is None else spark.sparkContext.broadcast(known)
    made = cut(_distinct(_tidy(content_facts(records, fields, vocabulary, skip))))
    each = made.select(F.explode(F.array(*[F.struct(F.col(f"{f}_h").alias("hash"), F.col(f"{f}_n").alias("tokens")) for f in fields])).alias("x")).select("x.*").where("hash IS NOT NULL")
    met = cut(each.groupBy("hash").agg(F.max("tokens").alias("tokens")))
    if known is None:
        fresh = met
    else:
        left = cut(met.where("tokens IS NULL").select("hash").join(have, "hash", "left_anti"))
        fresh = met.where("tokens IS NOT NULL")
        if (again := hash_filter(left)) is not None:
            more = missing_counts(records, spark.sparkContext.broadcast(again), fields, vocabulary)
            fresh = fresh.unionByName(more.groupBy("hash").agg(F.max("tokens").alias("tokens")).join(left, "hash", "left_semi"))
        fresh = cut(fresh.join(have, "hash", "left_anti"))
    counts = state.counts.unionByName(fresh.select(F.lit(name).alias("tokenizer"), "hash", "tokens"))
    facts = made.select("repair_id", *SLICE, *[f"{f}_h" for f in fields])
    changed = delta_cells(signed(state.facts, facts, fields), have.unionByName(fresh), fields)
    return State(counts, facts, apply_delta(state.cells, changed))


def cube(cells: DataFrame) -> DataFrame:
    """Totals by every subset of model, lang and dll from the finest cells; '*' stands for all."""
    values = [c for c in cells.columns if c not in SLICE]
    out = cells.cube(*SLICE).agg(*[F.sum(v).alias(v) for v in values])
    tokens = [v for v in values if v.endswith("_tokens")]
    return out.select(*[F.coalesce(c, F.lit("*")).alias(c) for c in SLICE], *values, sum((F.col(t) for t in tokens[1:]), F.col(tokens[0])).alias("total_tokens"))
