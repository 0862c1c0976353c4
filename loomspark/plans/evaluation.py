"""Evaluation queries: pairing, rates, costs, samples, shapes, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.plans.code_text import _LINES, _SLUG
from loomspark.sources.files import counters
from loomspark.sources.tables import table


def _records(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Distinct records; only the columns asked for are read and moved."""
    return table(spark, folder, "repair_result").select("repair_id", *columns).distinct()


def _outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "verification").select("verification_id", "repair_id", "compile_status", "compile_error").distinct()


def _final(spark: SparkSession, folder: str) -> DataFrame:
    """(repair_id, ok): whether any of a repair's checks succeeded."""
    return _outcomes(spark, folder).groupBy("repair_id").agg(F.max((F.col("compile_status") == "success").cast("int")).alias("ok"))


def _file_key() -> Column:
    """A file name in one spelling: without folder and extension, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim("filename"), "^.*/", ""), r"\.[^.]*$", ""))


def pair_initial_final(spark: SparkSession, folder: str) -> DataFrame:
    """Diagnosed and repaired files of each model and framework by task and file name: matched, diagnosed only or repaired only."""
    key = ["model", "dll", "task_id", "file"]
    r = _records(spark, folder, "model", "dll", "task_id", "filename", "step").select(T.slug(F.col("model")).alias("model"), F.lower("dll").alias("dll"), "task_id", _file_key().alias("file"), "step")
    a = r.where("step = 'step_two'").groupBy(*key).agg(F.count("*").alias("a"))
    b = r.where("step = 'step_three'").groupBy(*key).agg(F.count("*").alias("b"))
    kind = F.when(F.col("a").isNull(), "final_only").when(F.col("b").isNull(), "initial_only").otherwise("matched")
    return a.join(b, key, "full_outer").groupBy(kind.alias("kind")).agg(F.count("*").alias("keys"), F.sum(F.coalesce("a", F.lit(0))).alias("initial"), F.sum(F.coalesce("b", F.lit(0))).alias("final"))


def repair_success_rate(spark: SparkSession, folder: str) -> DataFrame:
    """Among the tasks of a model whose draft failed, the share whose repaired program ran, by framework."""
    r = _records(spark, folder, "model", "dll", "task_id", "step").join(_final(spark, folder), "repair_id")
    by = r.groupBy(T.slug(F.col("model")).alias("model"), F.lower("dll").alias("dll"), "task_id").agg(F.max(F.when(F.col("step") == "step_three", F.col("ok"))).alias("final"), F.min(F.when(F.col("step") != "step_three", F.col("ok"))).alias("initial"))
    bad = F.count_if(F.col("initial") == 0)
    fixed = F.count_if((F.col("initial") == 0) & (F.col("final") == 1))
    return by.groupBy("dll").agg(bad.alias("failed"), fixed.alias("repaired"), F.round(F.coalesce(F.try_divide(fixed, bad), F.lit(0.0)), 6).alias("rate"))


def exec_rate_rollup(spark: SparkSession, folder: str) -> DataFrame:
    r = _records(spark, folder, "model", "dll", "task_id").join(_final(spark, folder), "repair_id").join(table(spark, folder, "task").select("task_id", "difficulty"), "task_id")
    rows = r.select(T.slug(F.col("model")).alias("model"), F.lower("dll").alias("dll"), "difficulty", "ok")
    return rows.rollup("model", "dll", "difficulty").agg(F.count("*").alias("programs"), F.sum("ok").alias("ran"), F.round(F.avg("ok"), 6).alias("rate"))


def issue_category_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds of errors by framework."""
    v = _outcomes(spark, folder).join(_records(spark, folder, "dll"), "repair_id")
    e = F.coalesce("compile_error", F.lit(""))
    kind = F.when(e.contains("mat1 and mat2"), "matmul").when(e.contains("expected"), "channels").when(e.contains("axis 1"), "axis").when(e.contains("timeout"), "timeout").otherwise("other")
    rows = v.where("compile_status <> 'success'").select(F.lower("dll").alias("dll"), kind.alias("kind"), "verification_id")
    return rows.groupBy("dll").pivot("kind", ["matmul", "channels", "axis", "timeout", "other"]).agg(F.count("verification_id")).na.fill(0)


def line_delta_class(spark: SparkSession, folder: str) -> DataFrame:
    """Code lines that repair added, removed or kept: a task's first draft against its last repair, by model and framework; keys of one side apart."""
    key = ["model", "dll", "task_id"]
    r = table(spark, folder, "repair_result").select("repair_id", T.slug(F.col("model")).alias("model"), F.lower("dll").alias("dll"), "task_id", "step", T.code_lines(F.col("repaired_code")).alias("lines")).where("lines IS NOT NULL")
    a = r.where("step = 'step_one'").groupBy(*key).agg(F.min(F.struct("repair_id", "lines"))["lines"].alias("a"))
    b = r.where("step = 'step_three'").groupBy(*key).agg(F.max(F.struct("repair_id", "lines"))["lines"].alias("b"))
    d = F.col("b") - F.col("a")
    kind = F.when(F.col("a").isNull(), "final_only").when(F.col("b").isNull(), "initial_only").when(d > 0, "added").when(d < 0, "removed").otherwise("preserved")
    return a.join(b, key, "full_outer").groupBy(kind.alias("kind")).agg(F.count("*").alias("programs"), F.sum(F.coalesce(d, F.lit(0))).alias("lines"))


def token_cost_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Logged tokens by model and event; repeated lines count once."""
    rows = counters(table(spark, folder, "token_log"), "line", "log_id", T.slug(F.col("model")).alias("model")).withColumn("tokens", F.col("tokens").cast("long")).distinct()
    return rows.groupBy("model", "event").agg(F.count("*").alias("lines"), F.sum("tokens").alias("total"), F.round(F.avg("tokens"), 4).alias("mean"), F.min("tokens").alias("least"), F.max("tokens").alias("most"), F.round(F.percentile("tokens", 0.5), 4).alias("median"), F.round(F.percentile("tokens", 0.9), 4).alias("p90"))


def location_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """Share of failed repairs whose crash line is the one that their prompt reported."""
    last = lambda c: F.try_element_at(T.frames(F.col(c)), F.lit(-1))["line"]
    gold = table(spark, folder, "repair_result").select("repair_id", "root_cause_type", last("prompt").alias("gold")).distinct()
    seen = _outcomes(spark, folder).select("repair_id", "verification_id", last("compile_error").alias("line")).where("line IS NOT NULL")
    both = gold.where("gold IS NOT NULL").join(seen, "repair_id", "left")
    hit = F.coalesce(F.col("line") == F.col("gold"), F.lit(False)).cast("int")
    return both.groupBy(F.coalesce(F.lower("root_cause_type"), F.lit("unknown")).alias("root_cause")).agg(F.count("*").alias("samples"), F.round(F.avg(hit), 6).alias("accuracy"))


def stratified_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Five records of each root cause and framework for annotation, by hash."""
    r = _records(spark, folder, "root_cause_type", "dll").select("repair_id", F.coalesce(F.lower("root_cause_type"), F.lit("unknown")).alias("stratum"), F.lower("dll").alias("dll"))
    w = W.partitionBy("stratum", "dll").orderBy(F.md5(F.col("repair_id").cast("string")), "repair_id")
    return r.withColumn("place", F.row_number().over(w)).where("place <= 5")


def missing_keys_anti(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks without a reference solution, and records without any check, by framework."""
    tasks = table(spark, folder, "task").join(table(spark, folder, "solution"), "task_id", "left_anti").select(F.lit("task").alias("kind"), F.col("difficulty").alias("part"))
    open_ = _records(spark, folder, "dll").join(table(spark, folder, "verification"), "repair_id", "left_anti").select(F.lit("unchecked").alias("kind"), F.lower("dll").alias("part"))
    return tasks.unionByName(open_).groupBy("kind", "part").agg(F.count("*").alias("keys"))


def prereq_semi(spark: SparkSession, folder: str) -> DataFrame:
    """Records to be repaired: those with a failed check and no successful one."""
    checks = table(spark, folder, "verification").groupBy("repair_id").agg(F.count_if(F.col("compile_status") != "success").alias("failed"), F.count_if(F.col("compile_status") == "success").alias("ran"))
    return _records(spark, folder, "task_id").join(checks.where("failed > 0 AND ran = 0").select("repair_id"), "repair_id", "left_semi")


def work_grid_cross(spark: SparkSession, folder: str) -> DataFrame:
    """Every task, framework and repeat; the two small dimensions are unfolded from each task's row."""
    return table(spark, folder, "task").select("task_id", F.explode(F.array(*map(F.lit, ("paddlepaddle", "pytorch", "tensorflow")))).alias("dll")).select("task_id", "dll", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("repeat"))


def repair_route_case(spark: SparkSession, folder: str) -> DataFrame:
    """Handler by root cause; unknown kinds are rejected."""
    kind = F.lower("root_cause_type")
    route = F.when(kind == "forward_local_crash", "local").when(kind == "merge_mismatch", "merge").when(kind == "direct_repair", "direct").when(kind == "unresolved_crash", "unresolved").otherwise("reject")
    return _records(spark, folder, "root_cause_type").groupBy(route.alias("route")).agg(F.count("*").alias("records"))


def conv_shape_eval(spark: SparkSession, folder: str) -> DataFrame:
    """Output sizes by the three formulas over the parts' sizes as kernels."""
    k, s, p = F.col("p_size"), (F.col("p_partkey") % 3 + 1), (F.col("p_partkey") % 4)
    part = table(spark, folder, "part")
    return part.select("p_partkey", *[T.conv_size(F.lit(64), k, s, p, m).alias(m) for m in ("valid", "same", "transposed")])


def param_solver_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Per kind of part, the kernel, stride and padding nearest to its least ones that give a size of 28 from 56."""
    base = table(spark, folder, "part").groupBy("p_type").agg(F.min("p_size").alias("k0"))
    g = base.select("p_type", "k0", F.explode(F.sequence(F.lit(1), F.lit(11))).alias("k")).select("*", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("s")).select("*", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("p"))
    fit = g.where(T.conv_size(F.lit(56), F.col("k"), F.col("s"), F.col("p")) == 28).withColumn("distance", F.abs(F.col("k") - F.col("k0")) + F.abs(F.col("s") - 1) + F.col("p"))
    w = W.partitionBy("p_type").orderBy("distance", "k", "s", "p")
    return fit.withColumn("place", F.row_number().over(w)).where("place = 1").select("p_type", "k", "s", "p", "distance")


#: Fixed table of shape formulas by family of APIs: a mark in the API's name, the axis, and the formula as text.
FORMULAS = (("conv", "Ho", "floor((H+2p-k)/s+1)"), ("conv", "Wo", "floor((W+2p-k)/s+1)"), ("pool", "Ho", "floor((H+2p-k)/s+1)"), ("pool", "Wo", "floor((W+2p-k)/s+1)"), ("same", "Ho", "floor((H-1)/s+1)"))


def formula_join(spark: SparkSession, folder: str) -> DataFrame:
    """APIs beside the formula table of their family, and whether their documents give the same formula; by family and axis.

    Documents' formulas count as the same where they are equal but for brackets left open at their end.
    """
    formulas = F.explode(F.array(*[F.struct(F.lit(a).alias("family"), F.lit(b).alias("axis"), F.lit(c).alias("formula")) for a, b, c in FORMULAS]))
    known = spark.range(1).select(formulas.alias("x")).select("x.*")
    api = table(spark, folder, "api_doc").select("dll", "file_name", F.regexp_extract(F.lower("api_name"), "(conv|pool)", 1).alias("family"), "api_shape.formulas").where("family <> ''")
    both = api.join(known, "family")
    own = F.try_element_at("formulas", F.col("axis"))
    given = F.regexp_replace(own, r"\)+$", "") == F.regexp_replace("formula", r"\)+$", "")
    return both.groupBy("family", "axis", "formula").agg(F.count("*").alias("apis"), F.count(own).alias("given"), F.count_if(F.coalesce(given, F.lit(False))).alias("same"))


def merge_shape_compare(spark: SparkSession, folder: str) -> DataFrame:
    """Mismatches where branches merge: the last annotated shape before a concatenation against the initial one, by framework and axis.

    A record's prompt notes shapes by line; the line that merges names the API and its axis. Branches fit where all other
    axes agree; expected is the shape of the first branch at the axis that differs.
    """
    lines = table(spark, folder, "repair_result").select("repair_id", F.lower("dll").alias("dll"), F.posexplode(F.split("prompt", "\n", -1)).alias("no", "line"))
    notes = r"#\s*(?:the initial shape of|output tensor shape)(.*)"
    shaped = lines.where(F.rlike("line", F.lit(notes))).select("repair_id", "no", T.shape_of(F.regexp_extract("line", notes, 1)).alias("shape")).where("shape IS NOT NULL")
    ends = shaped.groupBy("repair_id").agg(F.min(F.struct("no", "shape"))["shape"].alias("first"), F.max(F.struct("no", "shape"))["shape"].alias("last"), F.count("*").alias("shapes"))
    merge = r"(\w+(?:\.\w+)*)\(\[[^\]]*\],\s*(?:axis|dim)\s*=\s*(\d+)"
    merges = lines.where(F.rlike("line", F.lit(merge))).groupBy("repair_id", "dll").agg(F.min(F.struct("no", F.regexp_extract("line", merge, 1).alias("api"), F.regexp_extract("line", merge, 2).cast("int").alias("axis"))).alias("m"))
    both = merges.join(ends, "repair_id").select("repair_id", "dll", "m.api", "m.axis", "first", "last")
    apart = F.filter(F.transform(F.sequence(F.lit(0), F.least(F.size("first"), F.size("last")) - 1), lambda i: F.when((i != F.col("axis")) & (F.get("first", i) != F.get("last", i)), i)), lambda x: x.isNotNull())
    judged = both.withColumn("apart", apart)
    return judged.groupBy("dll", "api", "axis").agg(F.count("*").alias("merges"), F.count_if(F.size("first") != F.size("last")).alias("ranks"), F.count_if(F.size("apart") > 0).alias("mismatched"))


def variant_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """Success by step and sampling temperature as columns."""
    r = table(spark, folder, "repair_result").select("repair_id", "step", F.coalesce(F.try_element_at("repair_meta", F.lit("temperature")), F.lit("none")).alias("t")).distinct()
    return r.join(_final(spark, folder), "repair_id").groupBy("step").pivot("t", ["0.1", "0.8", "none"]).agg(F.count_if(F.col("ok") == 1)).select("step", F.coalesce("`0.1`", F.lit(0)).alias("low"), F.coalesce("`0.8`", F.lit(0)).alias("high"), F.coalesce("none", F.lit(0)).alias("unset"))


def replay(requests: DataFrame, log: DataFrame) -> DataFrame:
    """requests with the answer recorded for their prompt; NULL where there is none. No model is called.

    log has (prompt, answer, at); of several answers to one prompt the latest holds, and of these the greatest. Prompts
    meet by their hash; each is kept once before the join.
    """
    known = log.where("prompt IS NOT NULL AND answer IS NOT NULL").groupBy(F.md5("prompt").alias("h")).agg(F.max(F.struct("at", "answer"))["answer"].alias("answer"))
    return requests.withColumn("h", F.md5("prompt")).join(known, "h", "left").drop("h")


def replay_provider(spark: SparkSession, folder: str) -> DataFrame:
    """The recorded answer to each later prompt, by its hash: the log of a first half year replayed for all records."""
    r = table(spark, folder, "repair_result")
    log = r.where("created_at < '2025-07-01'").select("prompt", F.col("llm_response").alias("answer"), F.col("created_at").alias("at"))
    return replay(r.select("repair_id", "prompt").where("prompt IS NOT NULL"), log).select("repair_id", F.md5("answer").alias("answer")).distinct()


_R = "(SELECT DISTINCT repair_id, {0} FROM repair_result)"
_V = "(SELECT DISTINCT verification_id, repair_id, compile_status, compile_error FROM verification)"
_OK = f"(SELECT repair_id, max((compile_status = 'success')::INT) AS ok FROM {_V} GROUP BY repair_id)"
_LASTLINE = "regexp_extract_all({0}, 'File \"([^\"]+)\", line (\\d+)', 2)[-1]::INT"

SQL = {
    "pair_initial_final": f"""WITH r AS (SELECT {_SLUG.format('model')} AS model, lower(dll) AS dll, task_id, lower(regexp_replace(regexp_replace(trim(filename, ' '), '^.*/', ''), '\\.[^.]*$', '')) AS file, step FROM {_R.format('model, dll, task_id, filename, step')}),
 a AS (SELECT model, dll, task_id, file, count(*) AS a FROM r WHERE step = 'step_two' GROUP BY ALL), b AS (SELECT model, dll, task_id, file, count(*) AS b FROM r WHERE step = 'step_three' GROUP BY ALL)
SELECT CASE WHEN a IS NULL THEN 'final_only' WHEN b IS NULL THEN 'initial_only' ELSE 'matched' END AS kind, count(*) AS keys, sum(coalesce(a, 0))::BIGINT AS initial, sum(coalesce(b, 0))::BIGINT AS final FROM a FULL JOIN b USING (model, dll, task_id, file) GROUP BY 1""",
    "repair_success_rate": f"""WITH b AS (SELECT {_SLUG.format('model')} AS model, lower(dll) AS dll, task_id, max(CASE WHEN step = 'step_three' THEN ok END) AS final, min(CASE WHEN step <> 'step_three' THEN ok END) AS initial FROM {_R.format('model, dll, task_id, step')} JOIN {_OK} USING (repair_id) GROUP BY 1, 2, 3),
 c AS (SELECT dll, count(*) FILTER (WHERE initial = 0) AS failed, count(*) FILTER (WHERE initial = 0 AND final = 1) AS repaired FROM b GROUP BY dll)
SELECT dll, failed, repaired, round(CASE WHEN failed = 0 THEN 0 ELSE repaired / failed END, 6) AS rate FROM c""",
    "exec_rate_rollup": f"SELECT {_SLUG.format('model')} AS model, lower(dll) AS dll, difficulty, count(*) AS programs, sum(ok)::BIGINT AS ran, round(avg(ok), 6) AS rate FROM {_R.format('model, dll, task_id')} JOIN {_OK} USING (repair_id) JOIN task USING (task_id) GROUP BY ROLLUP (1, 2, 3)",
    "issue_category_pivot": f"""WITH e AS (SELECT lower(dll) AS dll, coalesce(compile_error, '') AS e FROM {_V} JOIN {_R.format('dll')} USING (repair_id) WHERE compile_status <> 'success'),
 k AS (SELECT dll, CASE WHEN contains(e, 'mat1 and mat2') THEN 'matmul' WHEN contains(e, 'expected') THEN 'channels' WHEN contains(e, 'axis 1') THEN 'axis' WHEN contains(e, 'timeout') THEN 'timeout' ELSE 'other' END AS kind FROM e)
SELECT dll, {', '.join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}" for k in ('matmul', 'channels', 'axis', 'timeout', 'other'))} FROM k GROUP BY dll""",
    "line_delta_class": f"""WITH r AS (SELECT * FROM (SELECT repair_id, {_SLUG.format('model')} AS model, lower(dll) AS dll, task_id, step, {_LINES.format('repaired_code')} AS lines FROM repair_result) WHERE lines IS NOT NULL),
 a AS (SELECT model, dll, task_id, arg_min(lines, repair_id) AS a FROM r WHERE step = 'step_one' GROUP BY ALL), b AS (SELECT model, dll, task_id, arg_max(lines, repair_id) AS b FROM r WHERE step = 'step_three' GROUP BY ALL)
SELECT CASE WHEN a IS NULL THEN 'final_only' WHEN b IS NULL THEN 'initial_only' WHEN b > a THEN 'added' WHEN b < a THEN 'removed' ELSE 'preserved' END AS kind, count(*) AS programs, sum(coalesce(b - a, 0))::BIGINT AS lines FROM a FULL JOIN b USING (model, dll, task_id) GROUP BY 1""",
    "token_cost_summary": f"""WITH l AS (SELECT DISTINCT log_id, {_SLUG.format('model')} AS model, regexp_extract(line, '(Input Prompt|LLM generated response) tokens\\s*:\\s*(\\d+)', 1) AS event, try_cast(regexp_extract(line, '(Input Prompt|LLM generated response) tokens\\s*:\\s*(\\d+)', 2) AS BIGINT) AS tokens FROM token_log)
SELECT model, event, count(*) AS lines, sum(tokens)::BIGINT AS total, round(avg(tokens), 4) AS mean, min(tokens) AS least, max(tokens) AS most, round(quantile_cont(tokens, 0.5), 4) AS median, round(quantile_cont(tokens, 0.9), 4) AS p90 FROM l WHERE event <> '' GROUP BY ALL""",
    "location_accuracy": f"""WITH g AS (SELECT DISTINCT repair_id, root_cause_type, {_LASTLINE.format('prompt')} AS gold FROM repair_result), s AS (SELECT repair_id, {_LASTLINE.format('compile_error')} AS line FROM {_V})
SELECT coalesce(lower(root_cause_type), 'unknown') AS root_cause, count(*) AS samples, round(avg(coalesce(line = gold, false)::INT), 6) AS accuracy FROM (SELECT * FROM g WHERE gold IS NOT NULL) LEFT JOIN (SELECT * FROM s WHERE line IS NOT NULL) USING (repair_id) GROUP BY 1""",
    "stratified_sample": f"SELECT repair_id, coalesce(lower(root_cause_type), 'unknown') AS stratum, lower(dll) AS dll, row_number() OVER (PARTITION BY coalesce(lower(root_cause_type), 'unknown'), lower(dll) ORDER BY md5(repair_id::VARCHAR), repair_id)::INT AS place FROM {_R.format('root_cause_type, dll')} QUALIFY place <= 5",
    "missing_keys_anti": f"SELECT kind, part, count(*) AS keys FROM (SELECT 'task' AS kind, difficulty AS part FROM task WHERE task_id NOT IN (SELECT task_id FROM solution) UNION ALL SELECT 'unchecked', lower(dll) FROM {_R.format('dll')} WHERE repair_id NOT IN (SELECT repair_id FROM verification)) GROUP BY ALL",
    "prereq_semi": f"SELECT repair_id, task_id FROM {_R.format('task_id')} WHERE repair_id IN (SELECT repair_id FROM verification WHERE compile_status <> 'success') AND repair_id NOT IN (SELECT repair_id FROM verification WHERE compile_status = 'success')",
    "work_grid_cross": "SELECT task_id, dll, repeat::INT AS repeat FROM task, (VALUES ('paddlepaddle'), ('pytorch'), ('tensorflow')) d(dll), range(1, 3) r(repeat)",
    "repair_route_case": f"SELECT CASE lower(root_cause_type) WHEN 'forward_local_crash' THEN 'local' WHEN 'merge_mismatch' THEN 'merge' WHEN 'direct_repair' THEN 'direct' WHEN 'unresolved_crash' THEN 'unresolved' ELSE 'reject' END AS route, count(*) AS records FROM {_R.format('root_cause_type')} GROUP BY 1",
    "conv_shape_eval": """WITH x AS (SELECT p_partkey, p_size AS k, p_partkey % 3 + 1 AS s, p_partkey % 4 AS p FROM part),
 y AS (SELECT p_partkey, floor((64 + 2 * p - k) / s) + 1 AS a, floor(63 / s) + 1 AS b, 63 * s - 2 * p + k AS c FROM x)
SELECT p_partkey, CASE WHEN a > 0 THEN a::BIGINT END AS valid, CASE WHEN b > 0 THEN b::BIGINT END AS same, CASE WHEN c > 0 THEN c::BIGINT END AS transposed FROM y""",
    "param_solver_grid": """WITH b AS (SELECT p_type, min(p_size) AS k0 FROM part GROUP BY p_type),
 g AS (SELECT *, abs(k - k0) + abs(s - 1) + p AS distance FROM b, range(1, 12) a(k), range(1, 5) c(s), range(0, 6) d(p) WHERE floor((56 + 2 * p - k) / s) + 1 = 28)
SELECT p_type, k::INT AS k, s::INT AS s, p::INT AS p, distance::INT AS distance FROM g QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY distance, k, s, p) = 1""",
    "formula_join": f"""WITH k AS (SELECT * FROM (VALUES {', '.join(str(x) for x in FORMULAS)}) t(family, axis, formula)),
 a AS (SELECT regexp_extract(lower(api_name), '(conv|pool)', 1) AS family, api_shape.formulas AS f FROM api_doc), b AS (SELECT k.*, CASE WHEN f IS NOT NULL THEN f[axis] END AS own FROM a JOIN k USING (family))
SELECT family, axis, formula, count(*) AS apis, count(own) AS given, count(*) FILTER (WHERE regexp_replace(own, '\\)+$', '') = regexp_replace(formula, '\\)+$', '')) AS same FROM b GROUP BY ALL""",
    "merge_shape_compare": """WITH l AS (SELECT repair_id, lower(dll) AS dll, unnest(string_split(prompt, chr(10))) AS line, unnest(range(len(string_split(prompt, chr(10))))) AS no FROM repair_result),
 s AS (SELECT repair_id, no, regexp_extract(regexp_extract(line, '#\\s*(?:the initial shape of|output tensor shape)(.*)', 1), '\\(([0-9 ,]+)\\)', 1) AS t FROM l WHERE regexp_matches(line, '#\\s*(?:the initial shape of|output tensor shape)(.*)')),
 a AS (SELECT repair_id, no, list_transform(list_filter(string_split(t, ','), lambda x: trim(x) <> ''), lambda x: trim(x)::INT) AS shape FROM s WHERE t <> ''),
 e AS (SELECT repair_id, arg_min(shape, no) AS f, arg_max(shape, no) AS z FROM a GROUP BY repair_id),
 m AS (SELECT repair_id, dll, arg_min(regexp_extract(line, p, 1), no) AS api, arg_min(regexp_extract(line, p, 2)::INT, no) AS axis FROM l, (SELECT '(\\w+(?:\\.\\w+)*)\\(\\[[^\\]]*\\],\\s*(?:axis|dim)\\s*=\\s*(\\d+)' AS p) WHERE regexp_matches(line, p) GROUP BY ALL)
SELECT dll, api, axis, count(*) AS merges, count(*) FILTER (WHERE len(f) <> len(z)) AS ranks, count(*) FILTER (WHERE len(list_filter(range(least(len(f), len(z))), lambda i: i <> axis AND f[i + 1] <> z[i + 1])) > 0) AS mismatched FROM m JOIN e USING (repair_id) GROUP BY ALL""",
    "variant_pivot": f"""WITH r AS (SELECT DISTINCT repair_id, step, coalesce(repair_meta['temperature'], 'none') AS t FROM repair_result)
SELECT step, count(*) FILTER (WHERE ok = 1 AND t = '0.1') AS low, count(*) FILTER (WHERE ok = 1 AND t = '0.8') AS high, count(*) FILTER (WHERE ok = 1 AND t = 'none') AS unset FROM r JOIN {_OK} USING (repair_id) GROUP BY step""",
    "replay_provider": """WITH k AS (SELECT md5(prompt) AS h, max({'at': created_at, 'answer': llm_response}).answer AS answer FROM repair_result WHERE created_at < '2025-07-01' AND prompt IS NOT NULL AND llm_response IS NOT NULL GROUP BY 1)
SELECT DISTINCT repair_id, md5(answer) AS answer FROM repair_result LEFT JOIN k ON md5(prompt) = h WHERE prompt IS NOT NULL""",
}
QUERIES = {
    f.__name__: f
    for f in (
        pair_initial_final, repair_success_rate, exec_rate_rollup, issue_category_pivot, line_delta_class, token_cost_summary, location_accuracy, stratified_sample, missing_keys_anti,
        prereq_semi, work_grid_cross, repair_route_case, conv_shape_eval, param_solver_grid, formula_join, merge_shape_compare, variant_pivot, replay_provider,
    )
}
