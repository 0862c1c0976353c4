"""Structured Streaming over a folder of event files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema, files: int = 1) -> DataFrame:
    """A stream over a folder of Parquet files, or over one file; ts becomes a timestamp, as watermarks need one."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    if spark.read.format("binaryFile").load(folder).select("path").where(F.col("path").endswith("/" + folder.rstrip("/").rpartition("/")[2])).limit(1).count():
        folder, _, name = folder.rstrip("/").rpartition("/")  # one file: its folder is watched for its name
        reader = reader.option("pathGlobFilter", name)
    return reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, late: str = "1 hour", length: str = "1 day") -> DataFrame:
    """Events and their value by type in tumbling windows; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def all_windowed_counts(events: DataFrame, length: str = "1 day") -> DataFrame:
    """Events and their value by type in tumbling windows; no watermark, so that no row is late, whatever its file.

    For complete mode: every run over a batch gives all windows up to then. The state has a row for each window and type.
    """
    return events.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def run_to_end(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Processes what is there and stops; the table holds the last batch's result, all windows of all rows."""

    def replace(result: DataFrame, batch: int) -> None:
        result.write.mode("overwrite").parquet(out)

    stream.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_to_table(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what is there and stops; the sink is exactly-once by its checkpoint."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
