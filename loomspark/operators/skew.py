"""Joins and group values that hold when one key has a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hot_keys(counts: DataFrame, key: str, total: int, most: int = 1000) -> DataFrame:
    """Keys with more than total / most rows; there are fewer than `most` of them, whatever the data."""
    return counts.where(F.col("n") > F.lit(max(1, total // most)))


def with_group_values(df: DataFrame, key: str, values: dict[str, Column], total: int, most: int = 1000) -> DataFrame:
    """df with aggregates of each key's rows, without any group being gathered in one task.

    The aggregates are combined before the shuffle. They reach the rows of hot keys by a broadcast of at most `most`
    rows, and all other rows, whose groups have at most total / most rows each, by a join on the key. Null keys get
    null values; repeated rows stay.
    """
    groups = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), *[v.alias(k) for k, v in values.items()])
    hot = hot_keys(groups, key, total, most).drop("n")
    names = list(values)
    side = F.broadcast(hot.select(F.col(key).alias("_hot"), *[F.col(n).alias(f"_hot_{n}") for n in names]))
    marked = df.join(side, df[key] == F.col("_hot"), "left")
    heavy = marked.where("_hot IS NOT NULL").select(*df.columns, *[F.col(f"_hot_{n}").alias(n) for n in names])
    light = marked.where("_hot IS NULL").select(*df.columns).join(groups.drop("n"), key, "left").select(*df.columns, *names)
    return heavy.unionByName(light)
