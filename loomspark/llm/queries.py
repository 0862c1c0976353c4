"""Queries of the operators over training text, with production parameters over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import cuts, duplicates, encode, leaks, pairs, subjects, syntax, tokens
from loomspark.session import checkpoint_dir
from loomspark.sources.tables import table


def p1_token_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of prompts and responses by model, prompt language and framework, with every subtotal: the first update of an empty state."""
    return tokens.cube(tokens.update(table(spark, folder, "repair_result"), tokens.empty_state(spark)).cells)


def _maintained(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of all records by way of three stored states: those up to a day, those from an earlier day on, then all."""
    records = table(spark, folder, "repair_result")
    at = lambda day: F.lit(day).cast("timestamp_ntz")
    store = f"{checkpoint_dir(spark)}/token-budget"
    state = tokens.empty_state(spark)
    for part in (records.where(F.col("created_at") < at("2025-07-01")), records.where(F.col("created_at") >= at("2025-04-01")), records):
        state = tokens.load(spark, tokens.save(tokens.update(part, state), store))
    return state.cells


def p1_token_delta(spark: SparkSession, folder: str) -> DataFrame:
    """The same cells as without a state, after records were added and removed, and removed ones came back."""
    return _maintained(spark, folder)


def p1_token_check(spark: SparkSession, folder: str) -> DataFrame:
    """Records by model and framework of the maintained cells, and how many of their cells differ from a full count."""
    full = tokens.update(table(spark, folder, "repair_result"), tokens.empty_state(spark)).cells
    values = [c for c in full.columns if c not in tokens.SLICE]
    one = lambda df, sign: df.select(*tokens.SLICE, *[(F.col(v) * sign).alias(v) for v in values], F.lit(sign).alias("side"))
    both = one(_maintained(spark, folder), 1).unionByName(one(full, -1)).groupBy(*tokens.SLICE).agg(*[F.sum(v).alias(v) for v in values], F.sum(F.when(F.col("side") > 0, F.col("records")).otherwise(0)).alias("kept"))
    differs = F.expr(" OR ".join(f"{v} <> 0" for v in values)).cast("int")
    return both.groupBy("model", "dll").agg(F.sum("kept").alias("records"), F.sum(differs).alias("different"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return duplicates.copy_pairs(table(spark, folder, "repair_result"))


def p2_programs(spark: SparkSession, folder: str) -> DataFrame:
    """Each program once, with the number of its copies."""
    return duplicates.collapsed(table(spark, folder, "repair_result"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return syntax.invalid_ids(table(spark, folder, "repair_result"))


def p3_rates(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "repair_result")
    return syntax.invalid_rates(records, syntax.invalid_ids(records))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return cuts.cut_values(table(spark, folder, "repair_result")).select("repair_id", "field")


def p4_rates(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "repair_result")
    return cuts.cut_rates(records, cuts.cut_values(records))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.defects(table(spark, folder, "repair_result"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode.encode_text(table(spark, folder, "documents"))


def p6_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each document's ids give back its text; null text counts as empty."""
    documents = table(spark, folder, "documents")
    back = encode.decode_ids(encode.encode_text(documents))
    both = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("a")).join(back.withColumnRenamed("text", "b"), "doc_id")
    return both.select("doc_id", (F.col("a") == F.col("b")).alias("same"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "task")).select("doc_id", "task_id")


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    """Each leaked task with its documents, longest run and how much of its solution any of them holds."""
    found = leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "task"), table(spark, folder, "solution"))
    return found.groupBy("task_id").agg(F.count("*").alias("documents"), F.max("run_words").alias("run_words"), F.round(F.max("answer_share"), 6).alias("answer_share"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.document_subjects(table(spark, folder, "documents"), table(spark, folder, "subject_area"), table(spark, folder, "subject_label"))


QUERIES = {f.__name__: f for f in (p1_token_budget, p1_token_delta, p1_token_check, p2_found, p2_programs, p3_found, p3_rates, p4_found, p4_rates, p5_found, p6_ids, p6_roundtrip, p7_found, p7_items, p8_found)}

_W = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"

_SLUG = "nullif(trim(regexp_replace(lower(string_split(trim({0}, ' '), '/')[-1]), '[^a-z0-9]+', '_', 'g'), '_'), '')"

#: SQL for those that SQL expresses on whole tables.
ORACLES: dict[str, str] = {
    "p1_token_check": f"SELECT model, dll, count(*) AS records, 0::BIGINT AS different FROM (SELECT DISTINCT repair_id, coalesce({_SLUG.format('model')}, 'unknown') AS model, coalesce({_SLUG.format('dll')}, 'unknown') AS dll FROM repair_result) GROUP BY ALL",
    "p7_items": f"""
WITH t AS (SELECT task_id, {_W.format('requirement')} AS w FROM task),
 tg AS (SELECT DISTINCT task_id, array_to_string(w[i:i + 14], ' ') AS g FROM (SELECT task_id, w, unnest(range(1, len(w) - 13)) AS i FROM t WHERE len(w) >= 15)),
 d AS (SELECT doc_id, {_W.format('text')} AS w FROM documents),
 dg AS (SELECT doc_id, i, array_to_string(w[i:i + 14], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 13)) AS i FROM d WHERE len(w) >= 15)),
 m AS (SELECT doc_id, task_id, i, i - row_number() OVER (PARTITION BY doc_id, task_id ORDER BY i) AS island FROM dg JOIN tg USING (g)),
 r AS (SELECT doc_id, task_id, max(n) + 14 AS run_words FROM (SELECT doc_id, task_id, island, count(*) AS n FROM m GROUP BY ALL) GROUP BY ALL),
 a AS (SELECT task_id, list_distinct(list_filter(list_transform(string_split_regex(max(code), '\\r\\n|[\\n\\r]'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) >= 20)) AS lines FROM solution GROUP BY task_id),
 x AS (SELECT r.*, coalesce(len(lines), 0) AS n, len(list_intersect(lines, list_transform(string_split_regex(text, '\\r\\n|[\\n\\r]'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')))) AS hits FROM r JOIN documents USING (doc_id) LEFT JOIN a USING (task_id))
SELECT task_id, count(*) AS documents, max(run_words)::INT AS run_words, round(max(CASE WHEN n = 0 THEN 0 ELSE hits / n END), 6) AS answer_share FROM x GROUP BY task_id""",
    "p6_roundtrip": "SELECT doc_id, true AS same FROM documents",
    "p7_found": f"""
WITH t AS (SELECT task_id, {_W.format('requirement')} AS w FROM task),
 tg AS (SELECT DISTINCT task_id, array_to_string(w[i:i + 14], ' ') AS g FROM (SELECT task_id, w, unnest(range(1, len(w) - 13)) AS i FROM t WHERE len(w) >= 15)),
 d AS (SELECT doc_id, {_W.format('text')} AS w FROM documents),
 dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 14], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 13)) AS i FROM d WHERE len(w) >= 15))
SELECT DISTINCT doc_id, task_id FROM dg JOIN tg USING (g)""",
}
