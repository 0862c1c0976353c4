"""Queries over code, responses and logs, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.functions import prompts as P
from loomspark.functions import text as T
from loomspark.operators import trees
from loomspark.plans.retrieval import API_DOCS, HYBRID, api_documents, retrieved_apis
from loomspark.session import checkpoint_dir, stored
from loomspark.sources import files
from loomspark.sources.files import counters
from loomspark.sources.tables import table


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "repair_result")


def code_fence_match(spark: SparkSession, folder: str) -> DataFrame:
    return _records(spark, folder).select("repair_id", T.fence_match(F.col("llm_response")).alias("code"))


def code_fence_regex(spark: SparkSession, folder: str) -> DataFrame:
    return _records(spark, folder).select("repair_id", T.fence_regex(F.col("llm_response")).alias("code"), T.fence_regex(F.col("llm_response"), "").alias("any_code"), T.fence_regex(F.col("llm_response"), "c++").alias("other_code"))


def code_line_count(spark: SparkSession, folder: str) -> DataFrame:
    return _records(spark, folder).select("repair_id", T.code_lines(F.col("repaired_code")).alias("code_lines"))


def valid_program_count(spark: SparkSession, folder: str) -> DataFrame:
    """Programs with and without code lines by step and framework; missing code has none."""
    lines = F.coalesce(T.code_lines(F.col("repaired_code")), F.lit(0))
    return _records(spark, folder).groupBy("step", F.lower("dll").alias("dll")).agg(F.count_if(lines > 0).alias("valid"), F.count_if(lines == 0).alias("empty"))


def strip_shape_comments(spark: SparkSession, folder: str) -> DataFrame:
    return _records(spark, folder).select("repair_id", T.strip_shape_comments(F.col("prompt")).alias("clean"))


def _lines(df: DataFrame, column: str) -> DataFrame:
    return df.select("repair_id", F.posexplode(F.split(column, "\n", -1)).alias("line_no", "line"))


def shape_annotation_extract(spark: SparkSession, folder: str) -> DataFrame:
    """Every shape annotation: line, kind, variable and shape; an unknown shape is NULL."""
    found = _lines(_records(spark, folder), "prompt").where(F.rlike("line", F.lit("#\\s*(the initial shape of|output tensor shape)")))
    kind = F.when(F.rlike("line", F.lit("the initial shape of")), "initial").when(F.rlike("line", F.lit("should be")), "expected").otherwise("observed")
    after = F.regexp_extract("line", r"(?:the initial shape of|output tensor shape)(.*)", 1)
    name = F.when(kind == "initial", F.regexp_extract("line", r"the initial shape of (\S+) is", 1)).otherwise(F.regexp_extract("line", r"^\s*([\w.]+)\s*=", 1))
    shape = F.array_join(T.shape_of(after), "x")
    return found.select("repair_id", "line_no", kind.alias("kind"), name.alias("name"), shape.alias("shape")).distinct()


def mask_detect(spark: SparkSession, folder: str) -> DataFrame:
    names = F.regexp_extract_all("prompt", F.lit(r"(\w+)\s*=\s*'mask'"), F.lit(1))
    return _records(spark, folder).select("repair_id", F.array_join(names, ",").alias("masked")).where("masked <> ''")


def slug_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Names as shell scripts spell them, where runs of other signs aren't drawn together, and lines by the usual rule."""
    return _records(spark, folder).groupBy(F.col("model").alias("written"), T.slug_by_sign(F.col("model")).alias("slug")).agg(F.count("*").alias("records"), F.sum(F.size(T.lines_of(F.coalesce("llm_response", F.lit(""))))).alias("lines"))


def slug_normalize(spark: SparkSession, folder: str) -> DataFrame:
    return _records(spark, folder).groupBy(F.col("model").alias("written"), T.slug(F.col("model")).alias("slug")).agg(F.count("*").alias("records"))


def natural_sort_rank(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks in natural order; a report over the fixed task table."""
    w, by_case = W.orderBy(T.natural_key(F.col("task_id")), "task_id"), W.orderBy(T.natural_key(F.initcap("task_id"), lower=False), "task_id")
    return table(spark, folder, "task").select("task_id", F.row_number().over(w).alias("place"), F.row_number().over(by_case).alias("by_case"))


def prompt_render(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts of each record from the same slots, by their hash: zero-shot, repair with and without shapes, unresolved crash."""
    records = _records(spark, folder)
    tasks = table(spark, folder, "task").select("task_id", "requirement")
    code, dll = F.coalesce("repaired_code", F.lit("")), F.lower("dll")
    base = P.zero_shot(F.col("requirement"), dll)
    return records.join(tasks, "task_id", "left").select(
        "repair_id",
        F.md5(base).alias("zero_shot"),
        F.md5(P.diagnosed(base, code, F.lower("root_cause_type"))).alias("repair"),
        F.md5(P.diagnosed(base, T.strip_shape_comments(code), F.lower("root_cause_type"))).alias("no_shapes"),
        F.md5(P.unresolved(code, F.regexp_extract("prompt", r"(Traceback \(most recent call last\):\n[^`]*)", 1))).alias("unresolved"),
    )


def prompt_steps(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of the prompts of each task's steps: names of APIs, then the program with the documents retrieved, and zero-shot."""
    docs = retrieved_apis(spark, folder).groupBy("task_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x.text).alias("docs"))  # 10 at most
    dll = F.lower(F.regexp_extract("requirement", "(PyTorch|TensorFlow|PaddlePaddle)", 1))
    tasks = table(spark, folder, "task").join(docs, "task_id", "left").withColumn("docs", F.coalesce("docs", F.array().cast("array<string>")))
    q = F.col("requirement")
    return tasks.select("task_id", P.candidates(q, dll).alias("first"), P.with_documents(q, dll, F.col("docs")).alias("second"), P.retrieval(q, dll, F.col("docs")).alias("retrieval"), P.zero_shot(q, dll).alias("zero_shot"))


def prompt_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts of each record by pipeline variant: baselines B1 to B4 and ablations A1 to A3, by their hash.

    B1 and B2 draft without and with the documents retrieved for the task; B3 and B4 debug the drafts that failed; A1
    leaves out the documents, A2 the root cause, A3 the shapes. Prompts are hashed where the record lies, beside the fixed
    tables of tasks; only the failed drafts of B3 and B4 meet their errors by a join.
    """
    docs = retrieved_apis(spark, folder).groupBy("task_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x.text).alias("docs"))
    tasks = stored(table(spark, folder, "task").select("task_id", "requirement").join(docs, "task_id", "left"))
    code, cause, dll = F.coalesce("repaired_code", F.lit("")), F.coalesce(F.lower("root_cause_type"), F.lit("unknown")), F.lower("dll")
    bare, q = P.zero_shot(F.col("requirement"), dll), P.retrieval(F.col("requirement"), dll, F.col("docs"))
    r = _records(spark, folder).join(tasks, "task_id", "left")

    def hashed(df: DataFrame, texts: dict) -> DataFrame:
        rows = F.array(*[F.struct(F.lit(k).alias("variant"), F.md5(v).alias("prompt")) for k, v in texts.items()])
        return df.select("repair_id", F.explode(rows).alias("x")).select("repair_id", "x.variant", "x.prompt")

    drafts = hashed(r, {"B1": bare, "B2": q, "A1": P.diagnosed(bare, code, cause), "A2": P.shapes_only(q, code), "A3": P.diagnosed(q, T.strip_shape_comments(code), cause)})
    failed = table(spark, folder, "verification").where("compile_status <> 'success'").groupBy("repair_id").agg(F.max(F.coalesce("compile_error", F.lit(""))).alias("error"))
    debugged = hashed(r.join(failed, "repair_id"), {"B3": P.self_debug(bare, code, F.col("error")), "B4": P.self_debug(q, code, F.col("error"))})
    return drafts.unionByName(debugged).distinct()


def root_cause_guard(spark: SparkSession, folder: str) -> DataFrame:
    """Records with a kind that no handler takes, with the error that names the kinds in order."""
    kinds = F.array_join(F.array_sort(F.array_distinct(F.array(*map(F.lit, ("Unresolved_Crash", "Forward_Local_Crash", "Direct_Repair", "Merge_Mismatch", "Direct_Repair"))))), ", ")
    known = F.col("root_cause_type").isin("Unresolved_Crash", "Forward_Local_Crash", "Direct_Repair", "Merge_Mismatch")
    rejected = _records(spark, folder).where(~F.coalesce(known, F.lit(False))).select("repair_id", "root_cause_type").distinct()
    return rejected.select("repair_id", F.concat(F.coalesce("root_cause_type", F.lit("NULL")), F.lit(" is none of "), kinds).alias("error"))


def code_statements(spark: SparkSession, folder: str) -> DataFrame:
    """Statements of the reference solutions by kind, through a table function."""
    spark.udtf.register("loomspark_statements", trees.Statements)
    table(spark, folder, "solution").createOrReplaceTempView("loomspark_solution")
    return spark.sql("SELECT task_id, s.line, s.depth, s.kind FROM loomspark_solution, LATERAL loomspark_statements(code) s")


def doc_concat(spark: SparkSession, folder: str) -> DataFrame:
    """API documents as one text of their parts, empty parts kept."""
    return api_documents(spark, folder).select("dll", "file_name", "api_name", F.col("text").alias("api_doc"))


def retrieved_docs_block(spark: SparkSession, folder: str) -> DataFrame:
    """Numbered list of the documents retrieved for each task of the gold sets; a fallback where there is none."""
    docs = retrieved_apis(spark, folder).groupBy("task_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x.text).alias("docs"))
    return table(spark, folder, "gold_api").select("task_id").distinct().join(docs, "task_id", "left").select("task_id", P.numbered(F.col("docs")).alias("block"))


def temperature_map(spark: SparkSession, folder: str) -> DataFrame:
    low = T.slug(F.col("model")).isin("okapi_7b_instruct", "quill_8b_it", "sorrel_4b_instruct")
    return _records(spark, folder).groupBy(F.when(low, 0.1).otherwise(0.8).alias("temperature")).agg(F.count("*").alias("records"))


def api_name_parts(spark: SparkSession, folder: str) -> DataFrame:
    base = T.api_base(F.col("api_signature"))
    parts = F.split(base, r"\.")
    return table(spark, folder, "api_doc").select("dll", "file_name", base.alias("api"), F.size(parts).alias("depth"), F.element_at(parts, -1).alias("leaf")).where("api IS NOT NULL")


def token_log_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Event and number of each counter line; other lines give none."""
    rows = counters(table(spark, folder, "token_log"), "line", "log_id")
    return rows.select("log_id", F.when(F.col("event") == "Input Prompt", "prompt").otherwise("response").alias("event"), "tokens").distinct()


def traceback_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Frames of each traceback, those in the user's program, and the last of these."""
    own = T.user_frames(F.col("compile_error"))
    last = F.try_element_at(own, F.lit(-1))
    return table(spark, folder, "verification").select("verification_id", F.size(T.frames(F.col("compile_error"))).alias("frames"), F.size(own).alias("own"), last["file"].alias("file"), last["line"].alias("line"), F.regexp_extract("compile_error", r"(\w+(?:Error|Argument)): [^\n]*\s*$", 1).alias("error")).where("frames > 0").distinct()


def verification_log_text(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes of a repair in path order, as key-value lines; a success stored as the text None has no error."""
    v = table(spark, folder, "verification").select("repair_id", "verification_id", "pyfile_path", "compile_status", F.when(F.col("compile_error") == "None", None).otherwise(F.col("compile_error")).alias("compile_error")).distinct()
    text = F.concat(F.lit("[status]: "), "compile_status", F.lit("\n[error]: "), F.coalesce("compile_error", F.lit("")))
    return v.groupBy("repair_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pyfile_path", "verification_id", text.alias("text")))), lambda x: x.text), "\n").alias("log"))


def log_file_name(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "token_log").select("log_id", F.concat(F.date_format("logged_at", "yyyy_MM_dd_HH_mm"), F.lit("_"), F.coalesce(F.col("repair_id").cast("long").cast("string"), F.lit("none"))).alias("name")).distinct()


def nested_default(spark: SparkSession, folder: str) -> DataFrame:
    get = lambda k, d: F.coalesce(F.try_element_at("repair_meta", F.lit(k)), F.lit(d))
    return _records(spark, folder).groupBy(get("temperature", "").alias("temperature"), get("attempt", "1").alias("attempt")).agg(F.count("*").alias("records"))


def module_name(spark: SparkSession, folder: str) -> DataFrame:
    """Dotted module names of the files below the marker; paths without it are dropped."""
    p = F.col("pyfile_path")
    module = F.replace(F.regexp_replace(F.substring(p, F.instr(p, "step_"), F.length(p)), r"(?i)\.(py|json)$", ""), F.lit("/"), F.lit("."))
    return table(spark, folder, "verification").where(F.instr(p, "step_") > 0).select("verification_id", module.alias("module")).distinct()


def forward_local_predicate(spark: SparkSession, folder: str) -> DataFrame:
    """Stage, line and code of each failed program's crash, and the root cause where it is a call made in the forward pass itself."""
    at, found = T.crash(F.col("compile_error")), T.forward_local(F.col("compile_error"))
    rows = table(spark, folder, "verification").where("compile_status <> 'success'")
    return rows.select("verification_id", at["crash_stage"].alias("crash_stage"), at["line_no"].alias("line_no"), at["crash_code"].alias("crash_code"), found["forward_definition"]["line_no"].alias("definition_line"), found["forward_definition"]["original_call"].alias("original_call"), found["root_cause_type"].alias("root_cause_type")).distinct()


def sources_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and content of each file format written to the shared folder and read back: programs, YAML, chat logs, JSON sidecars, CSV, logs, the index."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"
    records, checks = _records(spark, folder), table(spark, folder, "verification")
    out = []

    def add(name: str, df: DataFrame, size) -> None:
        out.append(df.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("size")).select(F.lit(name).alias("source"), "n", "size"))

    solutions = table(spark, folder, "solution").groupBy("task_id").agg(F.max("code").alias("code"))
    files.write_programs(solutions.select(F.lit("m").alias("model"), F.lit("step_one").alias("step"), F.lit("pytorch").alias("dll"), "task_id", F.lit("a.py").alias("filename"), "code"), f"{base}/programs")
    add("programs", files.in_order(files.written_programs(spark, f"{base}/programs"), "task_id"), F.length("code"))
    files.write_yaml(table(spark, folder, "task").select("difficulty", F.col("task_id"), F.col("requirement").alias("Requirement")), f"{base}/tasks", "difficulty")
    add("tasks", files.read_yaml(spark, f"{base}/tasks", "task_id string, Requirement string"), F.length("Requirement"))
    files.write_logs(records, f"{base}/chats")
    add("chats", files.read_yaml(spark, f"{base}/chats", "file string, number bigint, prompt array<string>, response array<string>"), F.coalesce(F.size("prompt"), F.lit(0)) + F.length("file"))
    files.write_json(checks.select(F.lit(None).cast("string").alias("final_code"), F.struct(F.col("compile_error").alias("traceback")).alias("runtime_error_info")), f"{base}/sidecars")
    add("sidecars", files.sidecars(spark, f"{base}/sidecars", lines=True), F.length("runtime_error_info.traceback"))
    files.write_report(checks.select("verification_id", F.concat_ws(":", "pyfile_path", T.crash(F.col("compile_error"))["line_no"].cast("string")), "compile_status"), f"{base}/book", "gold")
    add("annotations", files.annotations(spark, f"{base}/book/sheet=gold"), F.length("location"))
    table(spark, folder, "token_log").select("line").write.text(f"{base}/logs")
    add("logs", files.token_logs(spark, f"{base}/logs"), F.col("tokens"))
    files.build_index(api_documents(spark, folder), f"{base}/index")
    add("index", files.open_index(spark, f"{base}/index")[0], F.col("tf"))
    whole = out[0]
    for df in out[1:]:
        whole = whole.unionByName(df)
    return whole


def comment_clean(spark: SparkSession, folder: str) -> DataFrame:
    return _records(spark, folder).select("repair_id", trees.clean_comments_column(F.col("repaired_code"), F.col("dll")).alias("clean"))


def call_definition(spark: SparkSession, folder: str) -> DataFrame:
    """Definitions of the modules at whose call a repaired program crashed."""
    at = T.crash(F.col("compile_error"))
    crashes = table(spark, folder, "verification").where("compile_status <> 'success'").select("repair_id", at["line_no"].alias("crash_line"), at["crash_code"].alias("crash_code")).where("crash_code IS NOT NULL")
    return trees.crash_definitions(_records(spark, folder), crashes, "repair_id", "repaired_code")


def lint_parse_rate(spark: SparkSession, folder: str) -> DataFrame:
    """Repaired Python programs and those that parse, by framework."""
    records = _records(spark, folder).where(F.lower("filename").endswith(".py"))
    judged = records.withColumn("ok", trees.parses_column(F.col("repaired_code")))
    return judged.groupBy(F.lower("dll").alias("dll")).agg(F.count("repaired_code").alias("programs"), F.count_if("ok").alias("parsed"))


def mask_rewrite(spark: SparkSession, folder: str) -> DataFrame:
    """Masks the sizes of the layer that each record's error names."""
    records = _records(spark, folder).withColumn("attribute", F.regexp_extract("prompt", r"x = self\.(\w+)\(x\)\n\w*(?:Error|Argument)", 1)).withColumn("arguments", F.array(F.lit("in_channels"), F.lit("in_features"), F.lit("input_size")))
    return trees.masked(records, "repair_id", "repaired_code", "attribute", "arguments")


_F = "chr(96)||chr(96)||chr(96)"
_SQ, _DQ = "repeat(chr(39), 3)", "repeat('\"', 3)"
_CNT = "((length(x) - length(replace(x, {0}, ''))) = 6)"
_LINES = f"""CAST(substr(list_reduce(list_transform(string_split({{0}}, chr(10)), lambda l: regexp_replace(l, '^\\s+|\\s+$', '', 'g')),
 lambda a, x: CASE WHEN a[1] = '1' THEN (CASE WHEN contains(x, {_DQ}) OR contains(x, {_SQ}) THEN '0' ELSE '1' END) || substr(a, 2)
  WHEN starts_with(x, {_DQ}) OR starts_with(x, {_SQ}) THEN (CASE WHEN {_CNT.format(_DQ)} OR {_CNT.format(_SQ)} THEN '0' ELSE '1' END) || substr(a, 2)
  WHEN x = '' OR starts_with(x, '#') THEN a ELSE '0' || CAST(CAST(substr(a, 2) AS BIGINT) + 1 AS VARCHAR) END, '00'), 2) AS BIGINT)"""
_STRIP = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '(?m)[^\\S\\n]*#[^\\S\\n]*the initial shape of .*$', '', 'g'), '(?m)[^\\S\\n]*#[^\\S\\n]*output tensor shape.*$', '', 'g'), '(?m)[^\\S\\n]+$', '', 'g'), '\\A\\s+|\\s+\\z', '', 'g')"
_STRIPPED = f"CASE WHEN {_STRIP} = '' THEN '' ELSE {_STRIP} || chr(10) END"
_SLUG = "trim(regexp_replace(lower(string_split(trim({0}, ' '), '/')[-1]), '[^a-z0-9]+', '_', 'g'), '_')"

_NL = "chr(10)"


def _natural(text: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({text}, '([0-9]+|[^0-9]+)', 1), lambda p: CASE WHEN regexp_full_match(p, '[0-9]+') THEN lpad(p, 20, '0') ELSE p END), '')"


def _lines_of(text: str) -> str:
    parts = f"string_split_regex(coalesce({text}, ''), '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')"
    return f"(len({parts}) - (CASE WHEN {parts}[-1] = '' THEN 1 ELSE 0 END))"


def _fenced(tag: str) -> str:
    pattern = f"'(?s)```{tag}\\s*(.*?)```'"
    return f"CASE WHEN regexp_matches(llm_response, {pattern}) THEN regexp_replace(regexp_extract(llm_response, {pattern}, 1), '\\A\\s+|\\s+\\z', '', 'g') END"


def _zero(q: str, dll: str) -> str:
    return f"'Write a program with ' || coalesce({dll}, '') || ' for this task.' || {_NL} || {_NL} || 'Task:' || {_NL} || coalesce({q}, '') || {_NL} || {_NL} || 'Answer with one block of code.'"


def _numbered(docs: str) -> str:
    return f"CASE WHEN coalesce(len({docs}), 0) > 0 THEN array_to_string(list_transform({docs}, lambda x, i: '[Retrieved API ' || i || ']' || {_NL} || coalesce(x, '')), {_NL} || {_NL}) ELSE '(no API retrieved)' END"


def _retrieval(q: str, dll: str, docs: str) -> str:
    return f"'Write a program with ' || coalesce({dll}, '') || ' for this task.' || {_NL} || {_NL} || 'Task:' || {_NL} || coalesce({q}, '') || {_NL} || {_NL} || {_numbered(docs)} || {_NL} || {_NL} || 'Answer with one block of code.'"


_BLOCK = f"{_NL} || {_F} || 'python' || {_NL} || {{0}} || {_NL} || {_F} || {_NL}"


def _diagnosed(base: str, code: str, cause: str) -> str:
    return f"{base} || {_NL} || {_NL} || 'Program:' || {_BLOCK.format(code)} || {_NL} || 'Cause: ' || coalesce({cause}, '') || {_NL} || {_NL} || 'Repair it.'"


def _shapes(base: str, code: str) -> str:
    return f"{base} || {_NL} || {_NL} || 'Program:' || {_BLOCK.format(code)} || {_NL} || 'Repair it by the shapes that it notes.'"


def _debug(base: str, code: str, error: str) -> str:
    return f"{base} || {_NL} || {_NL} || 'This draft stops:' || {_BLOCK.format(code)} || {_NL} || 'with' || {_NL} || {error} || {_NL} || {_NL} || 'Repair it.'"


def _unresolved(code: str, error: str) -> str:
    return f"'Repair this program with few and local changes; keep the model''s structure.' || {_NL} || {_BLOCK.format(code)} || {_NL} || 'Error:' || {_NL} || {error} || {_NL} || {_NL} || 'Answer with the whole program in one block of code.'"


_DOCS = f"{HYBRID}, td AS (SELECT task_id, list(text ORDER BY rank) AS docs FROM hybrid GROUP BY task_id)"
_FRAME = "File \"([^\"]+)\", line (\\d+)"
_OWN = "list_filter(list_transform(range(1, len({0}) + 1), lambda i: [{0}[i], {1}[i]]), lambda f: NOT regexp_matches(f[1], '^<|site-packages/|dist-packages/|/lib/python\\d'))"
_AT = """SELECT *, list_filter(list_transform(range(1, len(files) + 1), lambda i: {'file': files[i], 'line': lines[i], 'func': funcs[i], 'code': codes[i]}), lambda f: NOT regexp_matches(f.file, '^<|site-packages/|dist-packages/|/lib/python\\d'))[-1] AS spot FROM (
 SELECT *, regexp_extract_all(compile_error, p, 1) AS files, regexp_extract_all(compile_error, p, 2) AS lines, regexp_extract_all(compile_error, p, 3) AS funcs, regexp_extract_all(compile_error, p, 4) AS codes
 FROM verification, (SELECT 'File "([^"]+)", line (\\d+), in ([^\\n]+)\\n[ \\t]*([^\\n]*)' AS p))"""
_STAGE = "CASE WHEN spot IS NULL THEN NULL WHEN spot.func IN ('forward', 'call') THEN 'forward' WHEN spot.func = '__init__' THEN 'init' ELSE 'other' END"

SQL = {
    "prompt_steps": f"""WITH {_DOCS}, x AS (SELECT task_id, requirement AS q, lower(regexp_extract(requirement, '(PyTorch|TensorFlow|PaddlePaddle)', 1)) AS dll, coalesce(docs, []) AS docs FROM task LEFT JOIN td USING (task_id))
SELECT task_id, 'Name the APIs of ' || dll || ' that a model for this task needs, and no others.' || {_NL} || {_NL} || 'Task:' || {_NL} || q || {_NL} || {_NL} || 'Answer with a list of dictionaries with the key api_name.' AS first,
 'Write a program with ' || dll || ' for this task. Use the documented APIs.' || {_NL} || {_NL} || 'Task:' || {_NL} || q || {_NL} || {_NL} || 'Documents:' || {_NL} || coalesce(array_to_string(docs, ''), '') || {_NL} || {_NL} || 'Name all arguments, and build the model once on a sample input.' AS second,
 {_retrieval('q', 'dll', 'docs')} AS retrieval, {_zero('q', 'dll')} AS zero_shot FROM x""",
    "prompt_variants": f"""WITH {_DOCS},
 f AS (SELECT repair_id, max(coalesce(compile_error, '')) AS error FROM verification WHERE compile_status <> 'success' GROUP BY repair_id),
 r AS (SELECT DISTINCT repair_id, task_id, lower(dll) AS dll, coalesce(repaired_code, '') AS code, coalesce(lower(root_cause_type), 'unknown') AS cause FROM repair_result),
 x AS (SELECT repair_id, {_zero('requirement', 'r.dll')} AS base, {_retrieval('requirement', 'r.dll', 'docs')} AS q, code, cause, error, {_STRIPPED.format('code')} AS bare
   FROM r LEFT JOIN task USING (task_id) LEFT JOIN td USING (task_id) LEFT JOIN f USING (repair_id))
SELECT repair_id, variant, md5(t) AS prompt FROM (
 SELECT repair_id, 'B1' AS variant, base AS t FROM x UNION ALL SELECT repair_id, 'B2', q FROM x
 UNION ALL SELECT repair_id, 'B3', {_debug('base', 'code', 'error')} FROM x WHERE error IS NOT NULL UNION ALL SELECT repair_id, 'B4', {_debug('q', 'code', 'error')} FROM x WHERE error IS NOT NULL
 UNION ALL SELECT repair_id, 'A1', {_diagnosed('base', 'code', 'cause')} FROM x UNION ALL SELECT repair_id, 'A2', {_shapes('q', 'code')} FROM x UNION ALL SELECT repair_id, 'A3', {_diagnosed('q', 'bare', 'cause')} FROM x)""",
    "root_cause_guard": "SELECT DISTINCT repair_id, coalesce(root_cause_type, 'NULL') || ' is none of Direct_Repair, Forward_Local_Crash, Merge_Mismatch, Unresolved_Crash' AS error FROM repair_result WHERE coalesce(root_cause_type, 'NULL') NOT IN ('Unresolved_Crash', 'Forward_Local_Crash', 'Direct_Repair', 'Merge_Mismatch')",
    "code_fence_match": f"""SELECT repair_id, CASE WHEN contains(llm_response, {_F}||'python') AND contains(r, {_F}) THEN regexp_replace(split_part(r, {_F}, 1), '\\A[ \\n\\t\\r]+|[ \\n\\t\\r]+\\z', '', 'g') END AS code
 FROM (SELECT repair_id, llm_response, replace(substr(llm_response, instr(llm_response, {_F}||'python')), {_F}||'python', '') AS r FROM repair_result)""",
    "code_fence_regex": f"""SELECT repair_id, {_fenced('python')} AS code, {_fenced('(?:\\w+)?')} AS any_code, {_fenced('c\\+\\+')} AS other_code FROM repair_result""",
    "code_line_count": f"SELECT repair_id, {_LINES.format('repaired_code')} AS code_lines FROM repair_result",
    "valid_program_count": f"SELECT step, lower(dll) AS dll, count(*) FILTER (WHERE n > 0) AS valid, count(*) FILTER (WHERE n = 0) AS empty FROM (SELECT step, dll, coalesce({_LINES.format('repaired_code')}, 0) AS n FROM repair_result) GROUP BY ALL",
    "strip_shape_comments": f"SELECT repair_id, {_STRIPPED.format('prompt')} AS clean FROM repair_result",
    "shape_annotation_extract": """
WITH l AS (SELECT repair_id, unnest(string_split(prompt, chr(10))) AS line, unnest(range(len(string_split(prompt, chr(10))))) AS line_no FROM repair_result),
 f AS (SELECT *, CASE WHEN regexp_matches(line, 'the initial shape of') THEN 'initial' WHEN regexp_matches(line, 'should be') THEN 'expected' ELSE 'observed' END AS kind,
   regexp_extract(regexp_extract(line, '(?:the initial shape of|output tensor shape)(.*)', 1), '\\(([0-9 ,]+)\\)', 1) AS s FROM l WHERE regexp_matches(line, '#\\s*(the initial shape of|output tensor shape)'))
SELECT DISTINCT repair_id, line_no::INT AS line_no, kind, CASE WHEN kind = 'initial' THEN regexp_extract(line, 'the initial shape of (\\S+) is', 1) ELSE regexp_extract(line, '^\\s*([\\w.]+)\\s*=', 1) END AS name,
 CASE WHEN s <> '' THEN array_to_string(list_transform(list_filter(string_split(s, ','), lambda x: trim(x) <> ''), lambda x: trim(x)::INT), 'x') END AS shape FROM f""",
    "mask_detect": "SELECT repair_id, masked FROM (SELECT repair_id, array_to_string(regexp_extract_all(prompt, '(\\w+)\\s*=\\s*''mask''', 1), ',') AS masked FROM repair_result) WHERE masked <> ''",
    "slug_normalize": f"SELECT model AS written, {_SLUG.format('model')} AS slug, count(*) AS records FROM repair_result GROUP BY ALL",
    "natural_sort_rank": f"SELECT task_id, row_number() OVER (ORDER BY {_natural('lower(task_id)')}, task_id)::INT AS place, row_number() OVER (ORDER BY {_natural('upper(task_id[1]) || lower(task_id[2:])')}, task_id)::INT AS by_case FROM task",
    "slug_variants": f"SELECT model AS written, regexp_replace(regexp_replace(lower(regexp_replace(model, '^.*/', '')), '[^a-z0-9]', '_', 'g'), '^_*|_*$', '', 'g') AS slug, count(*) AS records, sum({_lines_of('llm_response')})::BIGINT AS lines FROM repair_result GROUP BY 1, 2",
    "sources_round_trip": f"""SELECT 'programs' AS source, count(*) AS n, coalesce(sum(length(code)), 0)::BIGINT AS size FROM (SELECT task_id, max(code) AS code FROM solution GROUP BY task_id)
 UNION ALL SELECT 'tasks', count(*), sum(length(requirement))::BIGINT FROM task
 UNION ALL SELECT 'chats', count(*), sum(CASE WHEN prompt IS NULL THEN 0 ELSE {_lines_of('prompt')} END + length('log_' || strftime(created_at, '%Y_%m_%d_%H_%M') || '_' || repair_id || '.yaml'))::BIGINT FROM repair_result
 UNION ALL SELECT 'sidecars', count(*), sum(length(compile_error))::BIGINT FROM verification
 UNION ALL SELECT 'annotations', count(*), sum(length(concat_ws(':', pyfile_path, spot.line)))::BIGINT FROM ({_AT})
 UNION ALL SELECT 'logs', count(*), sum(try_cast(regexp_extract(line, '(Input Prompt|LLM generated response) tokens\\s*:\\s*(\\d+)', 2) AS INT))::BIGINT FROM token_log WHERE regexp_matches(line, '(Input Prompt|LLM generated response) tokens\\s*:\\s*(\\d+)')
 UNION ALL SELECT 'index', count(*), sum(tf)::BIGINT FROM (WITH {HYBRID} SELECT * FROM dt)""",
    "prompt_render": f"""WITH x AS (SELECT r.repair_id, {_zero('requirement', 'lower(dll)')} AS base, coalesce(repaired_code, '') AS code, lower(root_cause_type) AS cause, coalesce(regexp_extract(prompt, '(Traceback \\(most recent call last\\):\\n[^`]*)', 1), '') AS error FROM repair_result r LEFT JOIN task USING (task_id))
SELECT repair_id, md5(base) AS zero_shot, md5({_diagnosed('base', 'code', 'cause')}) AS repair, md5({_diagnosed('base', '(' + _STRIPPED.format('code') + ')', 'cause')}) AS no_shapes, md5({_unresolved('code', 'error')}) AS unresolved FROM x""",
    "doc_concat": f"WITH {API_DOCS} SELECT dll, file_name, api_name, text AS api_doc FROM docs",
    "retrieved_docs_block": f"WITH {_DOCS} SELECT task_id, {_numbered('docs')} AS block FROM (SELECT DISTINCT task_id FROM gold_api) LEFT JOIN td USING (task_id)",
    "temperature_map": f"SELECT CASE WHEN {_SLUG.format('model')} IN ('okapi_7b_instruct', 'quill_8b_it', 'sorrel_4b_instruct') THEN 0.1::DOUBLE ELSE 0.8::DOUBLE END AS temperature, count(*) AS records FROM repair_result GROUP BY 1",
    "api_name_parts": "WITH a AS (SELECT dll, file_name, trim(split_part(trim(api_signature), '(', 1)) AS api FROM api_doc) SELECT dll, file_name, api, len(string_split(api, '.'))::INT AS depth, string_split(api, '.')[-1] AS leaf FROM a WHERE contains(api, '.')",
    "token_log_parse": "SELECT DISTINCT log_id, CASE WHEN regexp_extract(line, '(Input Prompt|LLM generated response) tokens\\s*:\\s*(\\d+)', 1) = 'Input Prompt' THEN 'prompt' ELSE 'response' END AS event, regexp_extract(line, '(Input Prompt|LLM generated response) tokens\\s*:\\s*(\\d+)', 2)::INT AS tokens FROM token_log WHERE regexp_matches(line, '(Input Prompt|LLM generated response) tokens\\s*:\\s*(\\d+)')",
    "traceback_frames": f"""WITH f AS (SELECT verification_id, compile_error, regexp_extract_all(compile_error, '{_FRAME}', 1) AS a, regexp_extract_all(compile_error, '{_FRAME}', 2) AS b FROM verification),
 o AS (SELECT *, {_OWN.format('a', 'b')} AS own FROM f)
SELECT DISTINCT verification_id, len(a)::INT AS frames, len(own)::INT AS own, own[-1][1] AS file, own[-1][2]::INT AS line, regexp_extract(compile_error, '(\\w+(?:Error|Argument)): [^\\n]*\\s*$', 1) AS error FROM o WHERE len(a) > 0""",
    "verification_log_text": "WITH v AS (SELECT DISTINCT repair_id, verification_id, pyfile_path, compile_status, CASE WHEN compile_error = 'None' THEN NULL ELSE compile_error END AS e FROM verification) SELECT repair_id, string_agg('[status]: ' || compile_status || chr(10) || '[error]: ' || coalesce(e, ''), chr(10) ORDER BY pyfile_path, verification_id, '[status]: ' || compile_status || chr(10) || '[error]: ' || coalesce(e, '')) AS log FROM v GROUP BY repair_id",
    "log_file_name": "SELECT DISTINCT log_id, strftime(logged_at, '%Y_%m_%d_%H_%M') || '_' || coalesce(repair_id::BIGINT::VARCHAR, 'none') AS name FROM token_log",
    "nested_default": "SELECT coalesce(repair_meta['temperature'], '') AS temperature, coalesce(repair_meta['attempt'], '1') AS attempt, count(*) AS records FROM repair_result GROUP BY ALL",
    "module_name": "SELECT DISTINCT verification_id, replace(regexp_replace(substr(pyfile_path, instr(pyfile_path, 'step_')), '(?i)\\.(py|json)$', ''), '/', '.') AS module FROM verification WHERE contains(pyfile_path, 'step_')",
    "forward_local_predicate": f"""WITH a AS ({_AT}), l AS (SELECT *, {_STAGE} AS stage, spot.func IN ('forward', 'call') AND regexp_matches(spot.code, '\\w\\s*\\(') AND NOT regexp_matches(spot.code, '\\bself\\.\\w+(?:\\.\\w+|\\[[^\\]]*\\])*\\s*\\(') AS local FROM a WHERE compile_status <> 'success')
SELECT DISTINCT verification_id, stage AS crash_stage, spot.line::INT AS line_no, spot.code AS crash_code, CASE WHEN local THEN spot.line::INT END AS definition_line, CASE WHEN local THEN spot.code END AS original_call, CASE WHEN local THEN 'Forward_Local_Crash' END AS root_cause_type FROM l""",
}
QUERIES = {
    f.__name__: f
    for f in (
        code_fence_match, code_fence_regex, code_line_count, valid_program_count, strip_shape_comments, shape_annotation_extract, mask_detect, slug_normalize, slug_variants, natural_sort_rank, sources_round_trip,
        prompt_render, prompt_steps, prompt_variants, root_cause_guard, code_statements, doc_concat, retrieved_docs_block, temperature_map, api_name_parts, token_log_parse, traceback_frames, verification_log_text, log_file_name, nested_default,
        module_name, forward_local_predicate, comment_clean, call_definition, lint_parse_rate, mask_rewrite,
    )
}
