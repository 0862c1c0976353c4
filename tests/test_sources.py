"""Files, sinks, the index and the stream."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from loomspark.sources import files
from loomspark.streaming.events import event_stream, run_to_table, windowed_counts


def test_programs_and_names(spark, tmp_path):
    d = tmp_path / "m" / "step_one" / "pytorch" / "task_2"
    d.mkdir(parents=True)
    (d / "a.py").write_text("x = 1\ny = 2\n")
    (d / "empty.py").write_text("")
    (d / "b.txt").write_text("no")
    got = {r.filename: r for r in files.programs(spark, str(tmp_path)).collect()}
    assert got["a.py"].code == "x = 1\ny = 2\n" and got["a.py"].dll == "pytorch" and got["a.py"].task_id == "task_2"
    assert got.get("empty.py") is None or got["empty.py"].code is None
    assert [r.task_id for r in files.task_names(files.whole_texts(spark, str(tmp_path))).collect()] == ["task_2"]


def test_written_programs_and_logs(spark, tmp_path):
    df = spark.createDataFrame([("m", "s", "d", f"t{k}", "a.py", c) for k, c in ((10, "x = 1\ny = 2\n"), (2, None), (1, "z"))], "model string, step string, dll string, task_id string, filename string, code string")
    files.write_programs(df, str(tmp_path / "p"))
    back = files.written_programs(spark, str(tmp_path / "p"))
    assert {r.task_id: r.code for r in back.collect()} == {"t10": "x = 1\ny = 2\n", "t2": None, "t1": "z"}
    assert [r.task_id for r in files.in_order(back, "task_id").collect()] == ["t1", "t2", "t10"]
    logs = spark.createDataFrame([(7, "s", "m", "a\r\nb\n", None, "2025-01-02 03:04:05")], "repair_id long, step string, model string, prompt string, llm_response string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    files.write_logs(logs, str(tmp_path / "l"))
    got = files.read_yaml(spark, str(tmp_path / "l"), "file string, number bigint, prompt array<string>, response array<string>").first()
    assert (got.file, got.number, got.prompt, got.response, got.step) == ("log_2025_01_02_03_04_7.yaml", 7, ["a", "b"], None, "s")
    yaml = pytest.importorskip("yaml")
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "l")).collect())
    assert list(yaml.safe_load_all(text))[0]["prompt"] == ["a", "b"]
    (tmp_path / "f.csv").write_text("family,axis,formula\nconv,Ho,floor(x)\n")
    assert files.formula_table(spark, str(tmp_path / "f.csv")).first().formula == "floor(x)"


def test_yaml_three_kinds_of_missing(spark, tmp_path):
    docs = {"a": "name: x\nshape: ''\nlist: [1]\n", "b": "name: y\nshape: {}\n", "c": "name: z\nshape: null\n", "d": "name: [\n"}
    for k, t in docs.items():
        (tmp_path / f"{k}.yaml").write_text(t)
    df = files.yaml_rows(files.whole_texts(spark, str(tmp_path), ".yaml"), "name string, shape string, n array<int>", keys={"n": "list"})
    got = {r.name: r for r in df.collect()}
    assert got["x"].n == [1] and all(got[k].shape is None for k in "xyz") and got[None].error


def test_sidecars_csv_logs(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text(json.dumps({"final_code": "x", "root_cause": None}))
    (tmp_path / "j" / "b.json").write_text("{broken")
    rows = files.sidecars(spark, str(tmp_path / "j")).collect()
    assert len(rows) == 2 and sum(r._corrupt_record is not None for r in rows) == 1
    (tmp_path / "g.csv").write_text("sample_id,location,root_cause_type\n1,f:3,A\n")
    assert files.annotations(spark, str(tmp_path / "g.csv")).first().location == "f:3"
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "l.txt").write_text("[INFO] Input Prompt tokens : 12\nother\n")
    assert [(r.event, r.tokens) for r in files.token_logs(spark, str(tmp_path / "log")).collect()] == [("Input Prompt", 12)]


def test_lint_reports(spark, tmp_path):
    rows = [{"path": "a.py", "type": "error", "symbol": "no-member", "line": 3}, {"path": "b.py", "type": "error", "symbol": "x", "line": 1}, {"path": "a.py", "type": None, "symbol": "y"}]
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, rows)) + "\n{broken\n")
    got = {r.type: (r.issues, r["files"]) for r in files.lint_categories(files.lint_reports(spark, str(tmp_path)).cache()).collect()}
    assert got == {"error": (2, 2), "unknown": (1, 1), "unreadable": (1, 0)}


def test_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a"), (2, None), (3, "b")], "doc_id long, text string")
    files.build_index(docs, str(tmp_path / "ix"))
    postings, stats = files.open_index(spark, str(tmp_path / "ix"))
    assert {tuple(r) for r in postings.select("term", "doc_id", "tf").collect()} == {("a", 1, 2), ("b", 1, 1), ("b", 3, 1)}
    assert stats.first().n == 3


def test_report_and_partitions(spark, tmp_path):
    df = spark.createDataFrame([("s", "m", 1), ("s", "n", 2)], "step string, model string, v int")
    files.write_report(df, str(tmp_path / "book"), "one")
    files.write_report(df, str(tmp_path / "book"), "one")
    assert spark.read.csv(str(tmp_path / "book"), header=True).count() == 2
    files.write_partitioned(df, str(tmp_path / "p"), "step", "model")
    assert spark.read.parquet(str(tmp_path / "p")).where("model = 'm'").count() == 1


def test_stream_leaves_late_rows_out(spark, tmp_path):
    rows = [(1, "2024-01-01 10:00:00", "a", 1.0), (2, "2024-01-05 10:00:00", "a", 2.0), (3, "2024-01-09 10:00:00", "b", 3.0)]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "event_id int, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    run_to_table(windowed_counts(event_stream(spark, str(tmp_path / "in"), schema)), str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(str(r.start)[:10], r.n) for r in got} >= {("2024-01-01", 1)} and all(r.event_type == "a" for r in got)


@pytest.mark.parametrize("files", [1, 4])
def test_stream_windows_hold_all_rows(spark, tmp_path, files):
    """Later files hold older rows, rows without a time have no window, and the last window counts too."""
    from loomspark.plans.general import general_stream_windows

    rows = [(i, f"2024-01-{1 + (17 * i) % 30:02d} 0{i % 9}:30:00", "ab"[i % 2], float(i)) for i in range(200)] + [(200, "2024-01-31 23:59:59", "a", None), (201, None, "a", 1.0)]
    frame = spark.createDataFrame(rows, "event_id int, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for k in range(files):
        frame.where(F.col("event_id") % files == files - 1 - k).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    want = duckdb.sql(f"SELECT date_trunc('day', ts)::VARCHAR AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM '{tmp_path}/events.parquet/*.parquet' WHERE ts IS NOT NULL GROUP BY ALL").fetchall()
    got = general_stream_windows(spark, str(tmp_path)).collect()
    assert sorted((str(r.start)[:10], r.event_type, r.n) for r in got) == sorted((x[:10], y, n) for x, y, n, _ in want)
    assert {(str(r.start)[:10], r.event_type): r.total for r in got} == {(x[:10], y): t for x, y, _, t in want}
