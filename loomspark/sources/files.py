"""File sources and sinks: whole texts, YAML, JSON sidecars, CSV, logs, programs, reports and the sparse index."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.text import lines_of, natural_key

TASK_PATH = r"/([^/]+)/([^/]+)/([^/]+)/([^/]+)/([^/]+)$"
SIDECAR = (
    "final_code string, runtime_error_info struct<traceback: string>, root_cause struct<root_cause_type: string, "
    "crash_location: struct<crash_stage: string, line_no: int, crash_code: string>, "
    "forward_definition: struct<line_no: int, original_call: string>, init_definition: map<string, string>>, _corrupt_record string"
)


def whole_texts(spark: SparkSession, folder: str, suffix: str = ".py") -> DataFrame:
    """(path, text): every file below the folder with the suffix, as one row each."""
    return spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=f"*{suffix}").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def programs(spark: SparkSession, folder: str, suffix: str = ".py") -> DataFrame:
    """Whole texts with the keys that their path <model>/<step>/<dll>/<task>/<file> holds."""
    df = whole_texts(spark, folder, suffix)
    names = ("model", "step", "dll", "task_id", "filename")
    return df.select(*[F.regexp_extract("path", TASK_PATH, i + 1).alias(n) for i, n in enumerate(names)], F.when(F.col("text") != "", F.col("text")).alias("code"))


def in_order(df: DataFrame, path: str = "path") -> DataFrame:
    """Rows in the natural order of their paths, letter case regarded; a sort over all partitions."""
    return df.orderBy(natural_key(F.col(path), lower=False), path)


def write_programs(df: DataFrame, folder: str) -> None:
    """Programs (model, step, dll, task_id, filename, code) as text below their keys; missing code gives an empty file."""
    keys = ("model", "step", "dll", "task_id", "filename")
    df.select(*keys, F.coalesce("code", F.lit("")).alias("value")).write.mode("overwrite").partitionBy(*keys).text(folder)


def written_programs(spark: SparkSession, folder: str) -> DataFrame:
    """What write_programs wrote, each file's last line end aside; an empty file is missing code again."""
    df = spark.read.schema("value string, model string, step string, dll string, task_id string, filename string").text(folder, wholetext=True)
    code = F.regexp_replace("value", r"\n\z", "")
    return df.select("model", "step", "dll", "task_id", "filename", F.when(code != "", code).alias("code"))


def task_names(df: DataFrame, path: str = "path") -> DataFrame:
    """Distinct names of the folders that hold the files; empty folders aren't seen by a file scan."""
    return df.select(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("task_id")).distinct()


def yaml_rows(df: DataFrame, schema: str, text: str = "text", keys: dict[str, str] | None = None) -> DataFrame:
    """Rows of YAML documents by an explicit schema plus path and error; a broken document gives nulls and its error.

    keys maps a column to the document's key where they differ. Needs the yaml library on the executors.
    """
    from pyspark.sql import types as T

    kind = T.StructType.fromDDL(schema) if hasattr(T.StructType, "fromDDL") else df.sparkSession.createDataFrame([], schema).schema
    names = kind.fieldNames()
    keys = keys or {}

    def value(x):
        return None if x in ("", {}, []) else x

    def run(frames: Iterator):
        import pandas as pd
        import yaml

        for pdf in frames:
            out = []
            for path, t in zip(pdf["path"], pdf[text]):
                try:
                    doc, error = yaml.safe_load(t) if t is not None else {}, None
                    doc = doc if isinstance(doc, dict) else {}
                except yaml.YAMLError as e:
                    doc, error = {}, str(e).split("\n")[0]
                out.append([path, *[value(doc.get(keys.get(n, n))) for n in names], error])
            yield pd.DataFrame(out, columns=["path", *names, "error"], dtype=object)

    return df.select("path", text).mapInPandas(run, f"path string, {schema}, error string")


def sidecars(spark: SparkSession, folder: str, lines: bool = False) -> DataFrame:
    """Diagnosis sidecars, one a file or, with lines, one a line; what doesn't parse is kept in _corrupt_record."""
    return spark.read.schema(SIDECAR).json(folder, multiLine=not lines, recursiveFileLookup=True, pathGlobFilter="*.json")


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """Gold or predicted root causes from CSV with a header."""
    return spark.read.csv(path, header=True, schema="sample_id string, location string, root_cause_type string")


def formula_table(spark: SparkSession, path: str) -> DataFrame:
    """The table of shape formulas by family of APIs and axis, from CSV with a header."""
    return spark.read.csv(path, header=True, schema="family string, axis string, formula string")


#: Fixed pattern of the counter lines in logs: what was counted and the number.
COUNTER = r"(Input Prompt|LLM generated response) tokens\s*:\s*(\d+)"


def counters(df: DataFrame, line: str, *keep: str) -> DataFrame:
    """(keep, event, tokens) of the counter lines; other lines give none."""
    return df.where(F.rlike(line, F.lit(COUNTER))).select(*keep, F.regexp_extract(line, COUNTER, 1).alias("event"), F.expr(f"try_cast(regexp_extract({line}, r'{COUNTER}', 2) AS int)").alias("tokens"))


def token_logs(spark: SparkSession, folder: str) -> DataFrame:
    """(path, event, tokens) of the counter lines of log files."""
    return counters(spark.read.text(folder, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value"), "value", "path")


def write_yaml(df: DataFrame, folder: str, *by: str) -> None:
    """A YAML document a line, in the flow style that JSON is too, below folders of the given columns."""
    rest = [c for c in df.columns if c not in by]
    df.select(*by, F.concat(F.lit("--- "), F.to_json(F.struct(*rest), {"ignoreNullFields": "false"})).alias("value")).write.mode("overwrite").partitionBy(*by).text(folder)


def read_yaml(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """What write_yaml wrote, by an explicit schema; the columns of its folders are strings."""
    df = spark.read.text(folder)
    return df.select(*[c for c in df.columns if c != "value"], F.from_json(F.regexp_replace("value", "^--- ", ""), schema).alias("x")).select("*", "x.*").drop("value", "x")


def chat_logs(df: DataFrame) -> DataFrame:
    """(step, model, file, number, prompt, response): prompts and responses as lists of lines under the name of their log."""
    name = F.concat(F.lit("log_"), F.date_format("created_at", "yyyy_MM_dd_HH_mm"), F.lit("_"), F.col("repair_id").cast("string"), F.lit(".yaml"))
    return df.select("step", "model", name.alias("file"), F.col("repair_id").alias("number"), lines_of(F.col("prompt")).alias("prompt"), lines_of(F.col("llm_response")).alias("response"))


def lint_reports(spark: SparkSession, folder: str) -> DataFrame:
    """(path, type, symbol, line) of lint reports in JSON lines or lists; what doesn't parse has its text in _corrupt_record."""
    return spark.read.schema("path string, type string, symbol string, line int, _corrupt_record string").json(folder, recursiveFileLookup=True, pathGlobFilter="*.json")


def lint_categories(reports: DataFrame) -> DataFrame:
    """(type, issues, files): how often each category occurs and in how many files; unreadable rows count under 'unreadable'."""
    kind = F.when(F.col("_corrupt_record").isNotNull(), "unreadable").otherwise(F.coalesce("type", F.lit("unknown")))
    return reports.groupBy(kind.alias("type")).agg(F.count("*").alias("issues"), F.countDistinct("path").alias("files"))


def write_logs(df: DataFrame, folder: str) -> None:
    """Chat logs as YAML; partitions keep runs apart, so that names can't collide."""
    write_yaml(chat_logs(df), folder, "step", "model")


def write_json(df: DataFrame, folder: str) -> None:
    """Rows as JSON documents, nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(folder)


def write_report(df: DataFrame, folder: str, sheet: str) -> None:
    """A report as one sheet of a book: CSV below sheet=<name>; writing a sheet again replaces only it."""
    df.write.mode("overwrite").option("header", True).csv(f"{folder}/sheet={sheet}")


def write_partitioned(df: DataFrame, folder: str, *by: str) -> None:
    """Parquet by the given columns, rows of one value gathered first so that each has few files."""
    df.repartition(*[F.col(c) for c in by]).write.mode("overwrite").partitionBy(*by).parquet(folder)


def build_index(documents: DataFrame, folder: str) -> None:
    """Sparse index: postings (term, doc_id, tf, dl) in the order of terms, and the corpus statistics."""
    from loomspark.operators.retrieval import terms

    docs = documents.select("doc_id", terms(F.col("text")).alias("t"))
    postings = docs.select("doc_id", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf"))
    postings.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{folder}/postings")
    docs.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avgdl")).write.mode("overwrite").parquet(f"{folder}/stats")


def open_index(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(postings, stats); a filter on term reaches the files' row groups, as they are sorted by it."""
    return spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/stats")
