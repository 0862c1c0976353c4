"""Retrieval queries and their SQL."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.text import api_base
from loomspark.operators import retrieval as R
from loomspark.session import checkpoint_dir
from loomspark.sources.tables import table


def _ranked(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    ranked = R.dense_top(vectors.where("vec_id % 100 = 0"), vectors, 10)
    label = vectors.select("vec_id", "label")
    return ranked.join(label.withColumnRenamed("vec_id", "other").withColumnRenamed("label", "a"), "other").join(label.select(F.col("vec_id").alias("query_id"), F.col("label").alias("b")), "query_id").select("query_id", "rank", (F.col("a") == F.col("b")).alias("relevant"))


def _gold(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    sizes = vectors.groupBy("label").agg((F.count("*") - 1).alias("gold"))
    return vectors.where("vec_id % 100 = 0").join(sizes, "label").select(F.col("vec_id").alias("query_id"), "gold")


def retrieval_dense_prk(spark: SparkSession, folder: str) -> DataFrame:
    """Precision, recall and hit at 10 of each query vector; relevant are the vectors with its label."""
    return R.at_k(_ranked(spark, folder), _gold(spark, folder), 10)


def metrics_macro_at_k(spark: SparkSession, folder: str) -> DataFrame:
    from loomspark.session import cut

    ranked, gold = cut(_ranked(spark, folder)), _gold(spark, folder)
    one = None
    for k in (1, 5, 10):
        part = R.at_k(ranked, gold, k)
        one = part if one is None else one.unionByName(part)
    return one.groupBy("k").agg(F.count("*").alias("queries"), F.round(F.avg("precision"), 4).alias("precision"), F.round(F.avg("recall"), 4).alias("recall"), F.round(F.avg("hit"), 4).alias("hit"))


def retrieval_bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Ten best documents of each task's requirement."""
    tasks = table(spark, folder, "task").select(F.col("task_id").alias("query_id"), F.col("requirement").alias("text"))
    return R.bm25_top(tasks, table(spark, folder, "documents"), 10).select(F.col("query_id").alias("task_id"), "doc_id", F.col("rank").cast("int").alias("rank"))


def api_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, dll, api_name, text): API documents as one text each: name, signature, usage, parameters and shape formulas, empty parts kept."""
    parameters = F.array_join(F.transform("api_parameters", lambda p: F.concat(F.coalesce(p["name"], F.lit("")), F.lit(": "), F.coalesce(p["desc"], F.lit("")))), "; ")
    formulas = F.array_join(F.transform(F.array_sort(F.map_entries("api_shape.formulas")), lambda e: F.concat(e["key"], F.lit(" = "), F.coalesce(e["value"], F.lit("")))), "; ")
    docs = table(spark, folder, "api_doc").withColumn("parameters", parameters).withColumn("formulas", formulas)
    parts = [F.coalesce(c, F.lit("")) for c in ("api_name", "api_signature", "api_details", "parameters", "formulas")]
    return docs.select(F.concat_ws("/", "dll", "file_name").alias("doc_id"), "dll", "file_name", "api_name", F.concat_ws("\n", *parts).alias("text"))


#: Where the indexes of this session's folders lie: they are built once and read by every query.
_INDEXES: dict[tuple[str, str], str] = {}


def api_index(spark: SparkSession, folder: str) -> str:
    """Path of the sparse and dense index of a folder's API documents in the shared folder, built when first asked for."""
    from loomspark.sources.files import build_index, open_index

    key = (spark.sparkContext.applicationId, folder)
    if key in _INDEXES:
        try:
            spark.read.parquet(f"{_INDEXES[key]}/vectors")
        except AnalysisException:  # the shared folder was cleared
            del _INDEXES[key]
    if key not in _INDEXES:
        path = f"{checkpoint_dir(spark).rstrip('/')}/api-index-{uuid.uuid4().hex}"
        docs = api_documents(spark, folder)
        build_index(docs, path)
        R.hashed_vectors(docs, *open_index(spark, path), "doc_id").write.parquet(f"{path}/vectors")
        _INDEXES[key] = path
    return _INDEXES[key]


def retrieved_apis(spark: SparkSession, folder: str, k: int = 10, deep: int = 50) -> DataFrame:
    """(task_id, rank, score, doc_id, dll, api_name, text): the API documents of each task, by fusion of sparse and dense rankings from the stored index."""
    from loomspark.sources.files import open_index

    path = api_index(spark, folder)
    docs = api_documents(spark, folder)
    postings, stats = open_index(spark, path)
    queries = table(spark, folder, "task").groupBy(F.col("task_id").alias("query_id")).agg(F.max("requirement").alias("text"))
    sparse = R.bm25_from_index(queries, postings, stats, deep)
    asked = R.hashed_vectors(queries, postings, stats, "query_id").withColumnRenamed("query_id", "doc_id")
    dense = R.dense_top(asked, spark.read.parquet(f"{path}/vectors"), deep, key="doc_id").withColumnRenamed("other", "doc_id")
    fused = R.fuse(sparse, dense, ["query_id"], k, "doc_id")
    return fused.join(docs, "doc_id").select(F.col("query_id").alias("task_id"), F.col("rank").cast("int").alias("rank"), "score", "doc_id", "dll", "api_name", "text")


def retrieval_hybrid_rrf(spark: SparkSession, folder: str) -> DataFrame:
    """Ten API documents of each task by reciprocal rank fusion of BM25 and dense neighbours."""
    return retrieved_apis(spark, folder).select("task_id", "rank", "score", "doc_id", "api_name")


def gold_array_intersect(spark: SparkSession, folder: str) -> DataFrame:
    """Gold APIs of a task among its ten retrieved ones; a task without any retrieved counts with 0."""
    got = retrieved_apis(spark, folder).groupBy("task_id").agg(F.collect_set("api_name").alias("top"))  # 10 at most
    gold = table(spark, folder, "gold_api").groupBy("task_id").agg(F.max("gold_apis").alias("gold"))
    both = gold.join(got, "task_id", "left").withColumn("gold", F.array_distinct(F.coalesce("gold", F.array().cast("array<string>"))))
    hits = F.size(F.array_intersect("gold", F.coalesce("top", F.array().cast("array<string>"))))
    return both.select("task_id", F.size("gold").alias("gold"), hits.alias("hits"), F.round(hits / 10, 6).alias("precision"), F.round(F.coalesce(F.try_divide(hits, F.size("gold")), F.lit(0.0)), 6).alias("recall"), (hits > 0).cast("int").alias("hit"))


def alias_table(documents: DataFrame) -> DataFrame:
    """(alias, canonical): other spellings of API names: lower case, and the last part alone where only one API has it."""
    names = documents.where("api_name IS NOT NULL").select(api_base(F.col("api_name")).alias("canonical")).where("canonical IS NOT NULL").distinct()
    each = names.select(F.explode(F.array(F.lower("canonical"), F.lower(F.element_at(F.split("canonical", r"\."), -1)))).alias("alias"), "canonical")
    return each.groupBy("alias").agg(F.count("*").alias("n"), F.min("canonical").alias("canonical")).where("n = 1").drop("n")


def alias_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """APIs named in signatures and gold sets by their canonical name; names outside of the alias table keep theirs."""
    docs = table(spark, folder, "api_doc")
    named = docs.select(F.trim(F.substring_index("api_signature", "(", 1)).alias("written")).unionByName(docs.select(F.element_at(F.split(F.trim(F.substring_index("api_signature", "(", 1)), r"\."), -1).alias("written")))
    named = named.unionByName(table(spark, folder, "gold_api").select(F.explode("gold_apis").alias("written"))).where("written <> ''")
    both = named.join(alias_table(docs), F.lower(F.trim("written")) == F.col("alias"), "left")
    return both.groupBy("written", F.coalesce("canonical", "written").alias("name")).agg(F.count("*").alias("n"))


def candidate_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Gold API names of each task beside their documents; a name that no document has comes with NULL."""
    names = table(spark, folder, "gold_api").select("task_id", F.explode("gold_apis").alias("api_name")).distinct()
    docs = api_documents(spark, folder).where("api_name IS NOT NULL").groupBy("api_name").agg(F.count("*").alias("documents"), F.min("text").alias("api_doc"))
    return names.join(docs, "api_name", "left").select("task_id", "api_name", F.coalesce("documents", F.lit(0)).alias("documents"), "api_doc")


def api_catalog_semi(spark: SparkSession, folder: str) -> DataFrame:
    """Gold API names that the catalogue holds."""
    names = table(spark, folder, "gold_api").select("task_id", F.explode("gold_apis").alias("api")).select("task_id", api_base(F.col("api")).alias("api")).where("api IS NOT NULL").distinct()
    catalog = table(spark, folder, "api_doc").select(api_base(F.col("api_name")).alias("api")).where("api IS NOT NULL")
    return names.join(catalog, "api", "left_semi").select("task_id", "api")


def api_missing_anti(spark: SparkSession, folder: str) -> DataFrame:
    """Gold API names that the catalogue of any framework lacks, by how many tasks want them."""
    names = table(spark, folder, "gold_api").select("task_id", F.explode("gold_apis").alias("api"))
    return names.join(table(spark, folder, "api_doc").where("api_name IS NOT NULL"), F.col("api") == F.col("api_name"), "left_anti").groupBy("api").agg(F.countDistinct("task_id").alias("tasks"))


_DENSE = """
 q AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0),
 s AS (SELECT q.vec_id AS query_id, v.vec_id AS other, q.label = v.label AS relevant,
   row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, v.embedding::DOUBLE[]), 6) DESC, v.vec_id) AS rank
   FROM q JOIN embeddings v ON v.vec_id <> q.vec_id),
 g AS (SELECT q.vec_id AS query_id, (SELECT count(*) - 1 FROM embeddings x WHERE x.label = q.label) AS gold FROM q),
 m AS (SELECT g.query_id, k.k, count(*) FILTER (WHERE s.rank <= k.k AND s.relevant) AS hits, any_value(g.gold) AS gold
   FROM g CROSS JOIN (VALUES (1), (5), (10)) k(k) LEFT JOIN s ON s.query_id = g.query_id AND s.rank <= 10 GROUP BY ALL),
 p AS (SELECT query_id, k::INT AS k, hits::BIGINT AS hits, round(hits / k, 6) AS precision, round(CASE WHEN gold = 0 THEN 0 ELSE hits / gold END, 6) AS recall, (hits > 0)::INT AS hit FROM m)
"""
_TERMS = "list_filter(string_split(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"
API_DOCS = """docs AS (SELECT dll || '/' || file_name AS doc_id, dll, file_name, api_name, concat_ws(chr(10), coalesce(api_name, ''), coalesce(api_signature, ''), coalesce(api_details, ''),
 coalesce(array_to_string(list_transform(api_parameters, lambda p: coalesce(p.name, '') || ': ' || coalesce(p."desc", '')), '; '), ''),
 coalesce(array_to_string(list_transform(list_sort(map_entries(api_shape.formulas)), lambda e: e.key || ' = ' || coalesce(e.value, '')), '; '), '')) AS text FROM api_doc)"""
_PLACE = "('0x' || substr(md5(term), 1, 4))::INT % 64"
_SIGN = "CASE WHEN ('0x' || substr(md5(term), 5, 1))::INT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END"
HYBRID = f"""{API_DOCS},
 qs AS (SELECT task_id, max(requirement) AS text FROM task GROUP BY task_id),
 dw AS (SELECT doc_id, {_TERMS.format('text')} AS t FROM docs), st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM dw),
 dt AS (SELECT doc_id, term, any_value(dl) AS dl, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM dw) GROUP BY doc_id, term), df AS (SELECT term, count(*) AS df FROM dt GROUP BY term),
 qt AS (SELECT task_id, term, count(*) AS tf FROM (SELECT task_id, unnest({_TERMS.format('text')}) AS term FROM qs) GROUP BY ALL),
 sparse AS (SELECT task_id, doc_id, row_number() OVER (PARTITION BY task_id ORDER BY round(s, 6) DESC, doc_id) AS r FROM (
   SELECT task_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * dt.tf * 2.2 / (dt.tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS s FROM qt JOIN dt USING (term) JOIN df USING (term) CROSS JOIN st GROUP BY ALL) QUALIFY r <= 50),
 dv AS (SELECT doc_id, {_PLACE} AS k, sum({_SIGN} * tf * ln(1 + n / df)) AS v FROM dt JOIN df USING (term) CROSS JOIN st GROUP BY ALL), qv AS (SELECT task_id, {_PLACE} AS k, sum({_SIGN} * tf * ln(1 + n / df)) AS v FROM qt JOIN df USING (term) CROSS JOIN st GROUP BY ALL),
 dn AS (SELECT doc_id, sqrt(sum(v * v)) AS m FROM dv GROUP BY doc_id), qn AS (SELECT task_id, sqrt(sum(v * v)) AS m FROM qv GROUP BY task_id),
 dots AS (SELECT task_id, doc_id, sum(qv.v * dv.v) AS s FROM qv JOIN dv USING (k) GROUP BY ALL),
 dense AS (SELECT task_id, doc_id, row_number() OVER (PARTITION BY task_id ORDER BY round(coalesce(s, 0) / (qn.m * dn.m), 6) DESC, doc_id) AS r FROM qn CROSS JOIN dn LEFT JOIN dots USING (task_id, doc_id) QUALIFY r <= 50),
 fused AS (SELECT task_id, doc_id, round(coalesce(1.0::DOUBLE / (60 + sparse.r), 0) + coalesce(1.0::DOUBLE / (60 + dense.r), 0), 8) AS score FROM sparse FULL JOIN dense USING (task_id, doc_id)),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, doc_id)::INT AS rank FROM fused QUALIFY rank <= 10),
 hybrid AS (SELECT task_id, rank, score, doc_id, dll, api_name, text FROM ranked JOIN docs USING (doc_id))"""

SQL = {
    "retrieval_dense_prk": f"WITH {_DENSE} SELECT * FROM p WHERE k = 10",
    "metrics_macro_at_k": f"WITH {_DENSE} SELECT k, count(*) AS queries, round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall, round(avg(hit), 4) AS hit FROM p GROUP BY k",
    "retrieval_bm25_topk": f"""
WITH d AS (SELECT doc_id, {_TERMS.format('text')} AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
 tf AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d), c AS (SELECT doc_id, term, any_value(dl) AS dl, count(*) AS tf FROM tf GROUP BY doc_id, term),
 df AS (SELECT term, count(*) AS df FROM c GROUP BY term),
 q AS (SELECT task_id, unnest(list_distinct({_TERMS.format('requirement')})) AS term FROM task),
 s AS (SELECT q.task_id, c.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN c USING (term) JOIN df USING (term) CROSS JOIN st GROUP BY ALL),
 r AS (SELECT task_id, doc_id, row_number() OVER (PARTITION BY task_id ORDER BY round(score, 6) DESC, doc_id)::INT AS rank FROM s)
SELECT * FROM r WHERE rank <= 10""",
    "retrieval_hybrid_rrf": f"WITH {HYBRID} SELECT task_id, rank, score, doc_id, api_name FROM hybrid",
    "gold_array_intersect": f"""WITH {HYBRID},
 g AS (SELECT task_id, list_distinct(coalesce(max(gold_apis), []::VARCHAR[])) AS gold FROM gold_api GROUP BY task_id),
 h AS (SELECT g.task_id, len(any_value(gold))::INT AS gold, len(list_intersect(any_value(gold), coalesce(list(hybrid.api_name) FILTER (WHERE hybrid.api_name IS NOT NULL), []::VARCHAR[])))::INT AS hits FROM g LEFT JOIN hybrid USING (task_id) GROUP BY g.task_id)
SELECT task_id, gold, hits, round(hits / 10, 6) AS precision, round(CASE WHEN gold = 0 THEN 0 ELSE hits / gold END, 6) AS recall, (hits > 0)::INT AS hit FROM h""",
    "alias_resolution": """
WITH n AS (SELECT DISTINCT trim(split_part(trim(api_name), '(', 1)) AS canonical FROM api_doc WHERE api_name IS NOT NULL),
 c AS (SELECT canonical FROM n WHERE contains(canonical, '.')),
 a AS (SELECT alias, min(canonical) AS canonical FROM (SELECT lower(canonical) AS alias, canonical FROM c UNION ALL SELECT lower(string_split(canonical, '.')[-1]), canonical FROM c) GROUP BY alias HAVING count(*) = 1),
 w AS (SELECT trim(split_part(api_signature, '(', 1)) AS written FROM api_doc UNION ALL SELECT string_split(trim(split_part(api_signature, '(', 1)), '.')[-1] FROM api_doc UNION ALL SELECT unnest(gold_apis) FROM gold_api)
SELECT written, coalesce(canonical, written) AS name, count(*) AS n FROM w LEFT JOIN a ON lower(trim(written)) = alias WHERE written <> '' GROUP BY ALL""",
    "candidate_documents": f"""WITH {API_DOCS},
 n AS (SELECT DISTINCT task_id, unnest(gold_apis) AS api_name FROM gold_api), m AS (SELECT api_name, count(*) AS documents, min(text) AS api_doc FROM docs WHERE api_name IS NOT NULL GROUP BY api_name)
SELECT task_id, api_name, coalesce(documents, 0) AS documents, api_doc FROM n LEFT JOIN m USING (api_name)""",
    "api_catalog_semi": """
WITH n AS (SELECT DISTINCT task_id, trim(split_part(trim(api), '(', 1)) AS api FROM (SELECT task_id, unnest(gold_apis) AS api FROM gold_api)),
 c AS (SELECT DISTINCT trim(split_part(trim(api_name), '(', 1)) AS api FROM api_doc)
SELECT task_id, api FROM n WHERE contains(api, '.') AND api IN (SELECT api FROM c WHERE api IS NOT NULL)""",
    "api_missing_anti": "SELECT api, count(DISTINCT task_id) AS tasks FROM (SELECT task_id, unnest(gold_apis) AS api FROM gold_api) WHERE api NOT IN (SELECT api_name FROM api_doc WHERE api_name IS NOT NULL) GROUP BY api",
}
QUERIES = {f.__name__: f for f in (retrieval_dense_prk, metrics_macro_at_k, retrieval_bm25_topk, retrieval_hybrid_rrf, gold_array_intersect, alias_resolution, candidate_documents, api_catalog_semi, api_missing_anti)}
