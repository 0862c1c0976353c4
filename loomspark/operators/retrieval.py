"""Sparse and dense retrieval, fusion and ranking metrics."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.session import cut, stored

#: Queries of one block: a block of vectors of 64 numbers has 2 MB at most.
BLOCK = 4096
#: Text queries scored at once; their weights are a matrix of terms by queries.
QUERIES = 256
K1, B = 1.2, 0.75


def top(df: DataFrame, by: list[str], score: Column, tie: str, k: int) -> DataFrame:
    """Best k rows of each group in a total order, ranked from 1; the rank limit reaches below the shuffle."""
    w = W.partitionBy(*by).orderBy(score.desc(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dense_top(queries: DataFrame, vectors: DataFrame, k: int, key: str = "vec_id", value: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query_id, other, score, rank): exact cosine neighbours of each query among all other vectors.

    Queries go out in blocks of a bounded size; each partition keeps its own best k of each query, and only these are
    shuffled. Null vectors and vectors without length have no neighbours. Keys are numbers or strings, of one type.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    same = pa.string() if kind == "string" else pa.int64()
    kind = kind if kind == "string" else "bigint"
    found = None
    asked = stored(queries.where(F.col(value).isNotNull()).select(F.col(key).cast(kind).alias(key), value))
    blocks = max(1, math.ceil(asked.count() / block))
    for no in range(blocks):
        part = asked if blocks == 1 else asked.where(F.expr(f"pmod(xxhash64({key}), {blocks}) = {no}"))
        rows_ = [(r[0], list(r[1])) for r in part.select(key, value).limit(2 * block + 1).collect()]
        if len(rows_) > 2 * block:
            raise ValueError("ids of the queries aren't distinct: a block has more than twice its size")
        held = spark.sparkContext.broadcast(rows_)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            import numpy as np

            ids = np.array([i for i, _ in held.value])
            rows: list = []
            if len(ids):
                q = np.array([v for _, v in held.value], float)
                q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
            for batch in batches:
                if not len(ids) or not batch.num_rows:
                    continue
                batch = batch.filter(batch.column(1).is_valid())
                if not batch.num_rows:
                    continue
                other = np.array(batch.column(0).to_pylist())
                lists = batch.column(1)
                v = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(other), -1)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                s = np.round(q @ v.T, 6)
                s[ids[:, None] == other[None, :]] = -2
                keep = min(k, len(other))
                best = np.lexsort((np.broadcast_to(other, s.shape), -s), axis=1)[:, :keep]
                for i in range(len(ids)):
                    rows += [(ids[i].item(), other[j].item(), float(s[i, j])) for j in best[i] if s[i, j] > -2]
                if len(rows) > 4 * k * len(ids):
                    rows = _best(rows, k)
            columns = list(zip(*_best(rows, k))) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (same, same, pa.float64()))], names=["query_id", "other", "score"])

        one = vectors.select(F.col(key).cast(kind), value).mapInArrow(run, f"query_id {kind}, other {kind}, score double")
        found = one if found is None else found.unionByName(one)
    return top(found, ["query_id"], F.col("score"), "other", k)


def _best(rows: list, k: int) -> list:
    out, last, n = [], None, 0
    for row in sorted(rows, key=lambda r: (r[0], -r[2], r[1])):
        n = n + 1 if row[0] == last else 1
        last = row[0]
        if n <= k:
            out.append(row)
    return out


def terms(text: Column) -> Column:
    """Words of a text as plain letters and digits in lower case."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "), " "), lambda x: x != "")


def bm25_top(queries: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank) from queries (query_id, text) and documents (doc_id, text).

    Document frequencies of the queries' terms are counted with combining before the shuffle. Queries go out in shards
    of about QUERIES; each partition scores its documents by a shard's weights and keeps the best k of each query; only
    these are shuffled. Null and empty texts match nothing; equal scores go by doc_id.
    """
    spark = documents.sparkSession
    wanted = queries.where("query_id IS NOT NULL").select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).distinct()
    docs = stored(documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), terms(F.col("text")).alias("t")))  # words are made once
    stats = docs.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avgdl")).first()
    n, avgdl = stats["n"], stats["avgdl"] or 1.0
    df = docs.select(F.explode(F.array_distinct("t")).alias("term")).join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    weighed = cut(wanted.join(df, "term"))
    shards = max(1, math.ceil(queries.count() / QUERIES))
    while shards > 1:  # by hash, so that the largest may be above the average
        sizes = weighed.select("query_id").distinct().groupBy(F.expr(f"pmod(xxhash64(query_id), {shards})").alias("s")).count()
        if (sizes.agg(F.max("count")).first()[0] or 0) <= 2 * QUERIES:
            break
        shards *= 2
    found = None
    for shard in range(shards):
        by_query: dict[str, list] = {}
        for q, t, d in weighed.where(F.expr(f"pmod(xxhash64(query_id), {shards}) = {shard}")).select("query_id", "term", "df").collect():
            by_query.setdefault(q, []).append((t, math.log(1 + (n - d + 0.5) / (d + 0.5))))
        held = spark.sparkContext.broadcast(sorted(by_query.items()))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            import numpy as np

            number = {t: i for i, t in enumerate(sorted({t for _, ts in held.value for t, _ in ts}))}
            weights = np.zeros((len(number), len(held.value)))
            for j, (_, ts) in enumerate(held.value):
                for t, w in ts:
                    weights[number[t], j] = w
            best: list[list] = [[] for _ in held.value]
            for whole in batches:
                for start in range(0, whole.num_rows, 500):
                    batch = whole.slice(start, 500)
                    ids = batch.column(0).to_numpy(zero_copy_only=False)
                    scores = np.zeros((len(ids), len(held.value)))
                    for i, words in enumerate(batch.column(1).to_pylist()):
                        seen = [number[t] for t in words if t in number]
                        if seen:
                            rows, tf = np.unique(np.array(seen), return_counts=True)
                            scores[i] = (tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / avgdl))) @ weights[rows]
                    scores = np.round(scores, 6)
                    least = np.partition(scores, -k, axis=0)[-k] if len(ids) > k else np.zeros(scores.shape[1])
                    for j in range(scores.shape[1]):
                        floor = max(least[j], best[j][-1][0] if len(best[j]) == k else 0)
                        kept = np.flatnonzero((scores[:, j] >= floor) & (scores[:, j] > 0))
                        if len(kept):
                            best[j] = sorted(best[j] + [(float(scores[i, j]), int(ids[i])) for i in kept], key=lambda x: (-x[0], x[1]))[:k]
            rows = [(q, d, s) for (q, _), top_ in zip(held.value, best) for s, d in top_]
            columns = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.float64()))], names=["query_id", "doc_id", "score"])

        one = docs.mapInArrow(run, "query_id string, doc_id long, score double")
        found = one if found is None else found.unionByName(one)
    return top(found, ["query_id"], F.col("score"), "doc_id", k)


def bm25_from_index(queries: DataFrame, postings: DataFrame, stats: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank) from a stored index: postings (term, doc_id, tf, dl) and stats (n, avgdl).

    A join of the queries' terms with their postings, summed by query and document before the shuffle; the index is
    sorted by term, so that only row groups that may hold these terms are read. Equal scores go by doc_id.
    """
    wanted = queries.where("query_id IS NOT NULL").select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).distinct()
    df = postings.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    each = wanted.join(df, "term").join(postings, "term").crossJoin(F.broadcast(stats.limit(1)))  # the statistics are one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = each.groupBy("query_id", "doc_id").agg(F.round(F.sum(weight), 6).alias("score"))
    return top(scored, ["query_id"], F.col("score"), "doc_id", k)


def hashed_vectors(texts: DataFrame, postings: DataFrame, stats: DataFrame, key: str, size: int = 64) -> DataFrame:
    """(key, embedding): texts as dense vectors without a model: each term adds its count times its rarity in the index to
    one of `size` places, with a sign, both by the term's hash. Texts without an indexed term give no row."""
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    counts = texts.select(key, F.explode(terms(F.col("text"))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    each = counts.join(df, "term").crossJoin(F.broadcast(stats.limit(1).select("n")))
    digest = F.md5("term")
    place = F.conv(F.substring(digest, 1, 4), 16, 10).cast("int") % size
    sign = F.when(F.conv(F.substring(digest, 5, 1), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    cells = each.groupBy(key, place.alias("place")).agg(F.sum(sign * F.col("tf") * F.log(1 + F.col("n") / F.col("df"))).alias("v"))
    held = cells.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("place", "v"))).alias("m"))  # `size` entries at most
    return held.select(key, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("embedding"))


def fuse(a: DataFrame, b: DataFrame, by: list[str], k: int, tie: str, c: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two rankings with the columns `by`, tie and rank."""
    keys = [*by, tie]
    both = a.select(*keys, F.col("rank").alias("ra")).join(b.select(*keys, F.col("rank").alias("rb")), keys, "full_outer")
    score = F.round(F.coalesce(1.0 / (c + F.col("ra")), F.lit(0.0)) + F.coalesce(1.0 / (c + F.col("rb")), F.lit(0.0)), 8)
    return top(both.select(*keys, score.alias("score")), by, F.col("score"), tie, k)


def at_k(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(query_id, k, hits, precision, recall, hit) from (query_id, rank, relevant) and (query_id, gold: their number).

    A query without retrieved rows counts with 0; recall is 0 where nothing is relevant.
    """
    hits = ranked.where(F.col("rank") <= k).groupBy("query_id").agg(F.sum(F.col("relevant").cast("long")).alias("hits"))
    both = gold.join(hits, "query_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0).cast("long")))
    return both.select("query_id", F.lit(k).alias("k"), "hits", F.round(F.col("hits") / k, 6).alias("precision"), F.round(F.coalesce(F.try_divide("hits", "gold"), F.lit(0.0)), 6).alias("recall"), (F.col("hits") > 0).cast("int").alias("hit"))
