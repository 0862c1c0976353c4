"""Typed access to the Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings repair_result verification "
    "token_log task solution gold_api api_doc subject_area subject_label"
).split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table; the schema comes from the Parquet footer, so columns and filters reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
