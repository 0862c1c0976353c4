"""As-of and range joins without a product of both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str, bucket: Column | None = None) -> DataFrame:
    """left with the right side's latest value at or before each row's time, NULL where there is none.

    Both sides are united and the value is carried forward in a window of each key. With a bucket of the time (an
    expression that grows with it), the windows are those of key and bucket, so that a hot key is many tasks' work; the
    value before a bucket comes from the last ones of the buckets before it.
    """
    a = left.select(*left.columns, F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_value"))
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in left.schema if f.name not in (*by, at)]
    b = right.select(*[F.col(c) for c in by], F.col(at), *empty, F.lit(0).alias("_side"), F.col(value).alias("_value"))
    both = a.unionByName(b)
    if bucket is None:
        w = W.partitionBy(*by).orderBy(at, "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
        return both.withColumn(f"asof_{value}", F.last("_value", ignorenulls=True).over(w)).where("_side = 1").drop("_side", "_value")
    both = both.withColumn("_bucket", bucket)
    # of equal times the last in the order of values, as in the window
    ends = both.groupBy(*by, "_bucket").agg(F.max(F.when(F.col("_value").isNotNull(), F.struct(F.col(at).alias("t"), F.col("_value").alias("v"))))["v"].alias("_end"))
    before = ends.withColumn("_before", F.last("_end", ignorenulls=True).over(W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))).drop("_end")
    w = W.partitionBy(*by, "_bucket").orderBy(at, "_side", F.col("_value").asc_nulls_first()).rowsBetween(W.unboundedPreceding, W.currentRow)
    within = both.withColumn("_last", F.last("_value", ignorenulls=True).over(w)).where("_side = 1")
    keys = [*by, "_bucket"]
    before = before.select(*[F.col(c).alias(f"_key_{c}") for c in keys], "_before")
    same = [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in keys]
    return within.join(before, same, "left").drop(*[f"_key_{c}" for c in keys]).withColumn(f"asof_{value}", F.coalesce("_last", "_before")).drop("_side", "_value", "_bucket", "_last", "_before")


def with_earlier(df: DataFrame, by: list[str], order: list[str], bucket: Column, values: list[str], rows: int) -> DataFrame:
    """df with _place, each row's place in its key's order, and _earlier, its `rows` rows before it, the nearest first.

    _earlier is an array of structs of the values; the order must be total. The windows are those of key and bucket (an
    expression that grows with the order), so that a hot key is many tasks' work: of each bucket only its count and its
    last rows go on to the key's later buckets.
    """
    df = df.withColumn("_bucket", bucket)
    keys = [*by, "_bucket"]
    held = F.struct(*values)
    within = W.partitionBy(*keys)
    lags = F.filter(F.array(*[F.lag(held, k).over(within.orderBy(*order)) for k in range(1, rows + 1)]), lambda x: x.isNotNull())
    here = df.withColumn("_own", lags).withColumn("_place", F.row_number().over(within.orderBy(*order)))
    last = F.row_number().over(within.orderBy(*[F.col(c).desc() for c in order]))
    tails = df.select(*keys, held.alias("v"), last.alias("r"), F.count("*").over(within).alias("n")).where(F.col("r") <= rows)
    ends = tails.groupBy(*keys).agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("r", "v"))), lambda x: x.v).alias("tail"))  # `rows` at most
    buckets = W.partitionBy(*by).orderBy("_bucket")
    before = F.slice(F.flatten(F.array(*[F.coalesce(F.lag("tail", k).over(buckets), F.array().cast(ends.schema["tail"].dataType)) for k in range(1, rows + 1)])), 1, rows)
    carried = ends.select(*[F.col(c).alias(f"_key_{c}") for c in keys], F.coalesce(F.sum("n").over(buckets.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_n"), before.alias("_tail"))
    both = here.join(carried, [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in keys])
    return both.select(*[c for c in df.columns if c != "_bucket"], (F.col("_place") + F.col("_n")).cast("long").alias("_place"), F.slice(F.concat("_own", "_tail"), 1, rows).alias("_earlier"))


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Points within [low, high) of the ranges: an equal join on cells of the given width, then the exact test."""
    cell = lambda c: F.floor(F.col(c) / width)
    cells: Column = F.sequence(cell(low), cell(high))
    r = ranges.withColumn("_cell", F.explode(cells))
    return points.withColumn("_cell", cell(point)).join(r, "_cell").where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("_cell")
