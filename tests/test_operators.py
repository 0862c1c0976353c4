"""Operators against brute force on small fixtures."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.operators import retrieval as R
from loomspark.operators import trees
from loomspark.operators.ranges import asof_join, range_join
from loomspark.operators.skew import with_group_values


def test_dense_top(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)] + [(60, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for r in R.dense_top(df.where("vec_id < 7"), df, 4, block=3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.other))
    m = np.array([np.float32(v) for _, v in rows[:60]], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(m @ m.T, 6)
    for q in range(7):
        order = sorted((j for j in range(60) if j != q), key=lambda j: (-s[q, j], j))[:4]
        assert [o for _, o in sorted(got[q])] == order


def test_dense_top_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert R.dense_top(df, df, 3).count() == 0


def test_bm25_ties_nulls(spark):
    docs = spark.createDataFrame([(3, "red fox"), (1, "red fox"), (2, None), (4, ""), (5, "blue")], "doc_id long, text string")
    q = spark.createDataFrame([("a", "Fox!"), ("b", None), ("c", "absent")], "query_id string, text string")
    assert [(r.query_id, r.doc_id, r["rank"]) for r in R.bm25_top(q, docs, 5).orderBy("rank").collect()] == [("a", 1, 1), ("a", 3, 2)]


def test_at_k_empty_gold_and_monotone(spark):
    ranked = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("a", 3, True)], "query_id string, rank int, relevant boolean")
    gold = spark.createDataFrame([("a", 2), ("b", 0), ("c", 3)], "query_id string, gold long")
    by = {k: {r.query_id: r for r in R.at_k(ranked, gold, k).collect()} for k in (1, 2, 3, 9)}
    assert by[3]["a"].hits == 2 and by[3]["a"].recall == 1.0 and by[9]["a"].precision == round(2 / 9, 6)
    assert by[1]["b"].recall == 0.0 and by[1]["c"].hit == 0
    assert [by[k]["a"].recall for k in (1, 2, 3, 9)] == sorted(by[k]["a"].recall for k in (1, 2, 3, 9))


def test_fuse(spark):
    a = spark.createDataFrame([("g", 1, 1), ("g", 2, 2)], "g string, id int, rank int")
    b = spark.createDataFrame([("g", 2, 1), ("g", 3, 2)], "g string, id int, rank int")
    assert [r.id for r in R.fuse(a, b, ["g"], 3, "id").orderBy("rank").collect()] == [2, 1, 3]


def test_group_values_with_a_hot_key(spark):
    rows = [("hot" if i % 3 == 0 else f"k{i % 50}", i) for i in range(600)] + [(None, 7), (None, 8)]
    df = spark.createDataFrame(rows, "key string, v int")
    got = with_group_values(df, "key", {"least": F.min("v")}, 600, most=5)
    want = {}
    for k, v in rows:
        if k is not None:
            want[k] = min(v, want.get(k, v))
    out = got.collect()
    assert len(out) == len(rows) and all(r.least == want.get(r.key) for r in out)


def test_asof_and_range(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 2, 10), ("a", 5, 20), ("c", 1, 30)], "k string, t int, v int")
    assert {r.id: r.asof_v for r in asof_join(left, right, ["k"], "t", "v").collect()} == {1: 20, 2: None, 3: None}
    events = [(i, "hot" if i % 3 else "b", random.randrange(40), i % 2) for i in range(300)]
    l2 = spark.createDataFrame([e[:3] for e in events if e[3]], "id int, k string, t int").union(spark.createDataFrame([(900, None, 30)], "id int, k string, t int"))
    r2 = spark.createDataFrame(list({(e[1], e[2]): (e[1], e[2], e[0]) for e in events if not e[3]}.values()) + [(None, 3, 5)], "k string, t int, v int")
    one, many = ({r.id: r.asof_v for r in asof_join(l2, r2, ["k"], "t", "v", b).collect()} for b in (None, F.floor(F.col("t") / 5)))
    assert one == many and len(one) == 151 and one[900] == 5
    random.seed(2)
    pts = [(i, random.uniform(0, 50)) for i in range(80)]
    rng = [(i, lo, lo + random.uniform(0, 9)) for i, lo in enumerate(random.uniform(0, 50) for _ in range(25))]
    got = range_join(spark.createDataFrame(pts, "p int, x double"), spark.createDataFrame(rng, "r int, lo double, hi double"), "x", "lo", "hi", 2.0)
    assert {(r.p, r.r) for r in got.collect()} == {(p, r) for p, x in pts for r, lo, hi in rng if lo <= x < hi}


def test_with_earlier_rows_over_buckets(spark):
    from loomspark.operators.ranges import with_earlier

    rng = random.Random(4)
    rows = [(i, "hot" if i % 4 else rng.choice(["b", "c", None]), rng.randrange(30), rng.choice([None, i])) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, k string, t int, v int").repartition(4)
    for width in (1, 7, 100):
        got = {r.id: (r._place, [(x.id, x.v) for x in r._earlier]) for r in with_earlier(df, ["k"], ["t", "id"], F.floor(F.col("t") / width), ["id", "v"], 3).collect()}
        for k in ("hot", "b", "c", None):
            own = sorted(((t, i, v) for i, kk, t, v in rows if kk == k), key=lambda r: r[:2])
            for place, (_, i, _) in enumerate(own, 1):
                assert got[i] == (place, [(j, v) for _, j, v in own[max(0, place - 4) : place - 1][::-1]])
        assert len(got) == len(rows)


def test_clean_comments():
    code = "import torch  # a\nclass N:\n    def forward(self, x):\n        # whole\n        s = '# no'  # gone\n        return x\n    def f(self):\n        return 1  # kept"
    got = trees.clean_comments(code, "PyTorch")
    assert "# a" in got and "# whole" in got and "'# no'" in got and "gone" not in got and "# kept" in got
    deep = 'class N:\n    def call(self, x):\n        """Doc\n  # kept\n"""\n        y = (1,  # gone\n             2)\n        return y\n'
    assert trees.clean_comments(deep, "tensorflow") == deep.replace("  # gone", "")
    assert trees.clean_comments("def call(x):\n    return x  # c", "pytorch") == "def call(x):\n    return x  # c"
    asynchronous = "async def forward(x):\n    return x  # kept"
    assert trees.clean_comments(asynchronous, "pytorch") == asynchronous
    assert trees.clean_comments("def forward(:", "pytorch") is None and trees.clean_comments(None, "pytorch") is None and trees.clean_comments("x", "jax") is None


def test_definitions_and_masks(spark):
    code = "class N:\n    def __init__(self):\n        self.fc = nn.Linear(in_features=3, out_features=4)\n        self.x = 1\n"
    df = spark.createDataFrame([(1, code, "fc", ["in_features"]), (2, "def (", "fc", ["a"]), (3, None, None, None)], "id int, code string, a string, w array<string>")
    assert [tuple(r) for r in trees.definitions(df, "id", "code").collect()] == [(1, "fc", "nn.Linear", 3)]
    got = {r.id: r.code for r in trees.masked(df, "id", "code", "a", "w").collect()}
    assert "in_features='mask', out_features=4" in got[1] and got[2] is None and got[3] is None


def test_crash_definitions(spark):
    code = "class N:\n    def __init__(self):\n        self.fc = nn.Linear(3, 4)\n        self.b = nn.Sequential(nn.Conv2d(1, 2), nn.ReLU())\n        self.l = nn.ModuleList([nn.Linear(1, 1)])\n"
    programs = spark.createDataFrame([(1, code), (2, code), (3, "def ("), (4, None)], "id int, code string")
    crashes = spark.createDataFrame([(1, 9, "x = self.fc(x)"), (2, 9, "x = self.b(x)"), (2, 9, "x = self.b(x)"), (2, 8, "y = f(x)"), (3, 1, "self.fc(x)"), (9, 1, "self.fc(x)")], "id int, crash_line int, crash_code string")
    got = {(r.id, r.attribute, r.constructor, r.line, r.crash_line) for r in trees.crash_definitions(programs, crashes, "id", "code").collect()}
    assert got == {(1, "fc", "nn.Linear", 3, 9), (2, "b", "nn.Sequential", 4, 9), (2, "b.0", "nn.Conv2d", 4, 9), (2, "b.1", "nn.ReLU", 4, 9)}


def test_index_search_equals_scan(spark, tmp_path):
    from loomspark.sources.files import build_index, open_index

    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(rng.choices("a b c d e f g h".split(), k=rng.randint(0, 12)))) for i in range(80)] + [(99, None)], "doc_id long, text string").repartition(3)
    q = spark.createDataFrame([("x", "a c e"), ("y", "h h b"), ("z", "nothing"), ("n", None)], "query_id string, text string")
    build_index(docs, str(tmp_path / "i"))
    rows = lambda df: [tuple(r) for r in df.orderBy("query_id", "rank").select("query_id", "doc_id", "rank").collect()]
    assert rows(R.bm25_from_index(q, *open_index(spark, str(tmp_path / "i")), 7)) == rows(R.bm25_top(q, docs, 7))


def test_hashed_vectors(spark, tmp_path):
    from loomspark.sources.files import build_index, open_index

    docs = spark.createDataFrame([("p", "red fox runs"), ("q", "red fox runs fast"), ("r", "blue whale"), ("s", None)], "doc_id string, text string")
    build_index(docs, str(tmp_path / "i"))
    v = R.hashed_vectors(docs, *open_index(spark, str(tmp_path / "i")), "doc_id")
    assert {r.doc_id: len(r.embedding) for r in v.collect()} == {"p": 64, "q": 64, "r": 64}
    assert [r.other for r in R.dense_top(v.where("doc_id = 'p'"), v, 2, key="doc_id").orderBy("rank").collect()] == ["q", "r"]


def test_replay(spark):
    from loomspark.plans.evaluation import replay

    log = spark.createDataFrame([("p", "old", 1), ("p", "new", 2), ("q", None, 3), (None, "x", 4)], "prompt string, answer string, at int")
    asked = spark.createDataFrame([(1, "p"), (2, "q"), (3, None), (4, "unknown"), (5, "p")], "id int, prompt string")
    assert {r.id: r.answer for r in replay(asked, log).collect()} == {1: "new", 2: None, 3: None, 4: None, 5: "new"}


def test_aliases(spark):
    from loomspark.plans.retrieval import alias_table

    got = {r.alias: r.canonical for r in alias_table(spark.createDataFrame([("torch.nn.Linear",), ("tf.Conv",), ("paddle.Conv",), ("one",), (None,)], "api_name string")).collect()}
    assert got == {"torch.nn.linear": "torch.nn.Linear", "linear": "torch.nn.Linear", "tf.conv": "tf.Conv", "paddle.conv": "paddle.Conv"}


def test_shared_folder_is_asked_for_on_a_cluster():
    from loomspark.session import checkpoint_dir

    class Conf:
        def get(self, *a):
            return None

    class Context:
        master, applicationId = "spark://host:7077", "x"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        checkpoint_dir(Session())


def test_statements_table_function(spark):
    spark.udtf.register("statements_in_test", trees.Statements)
    df = spark.createDataFrame([(1, "import x\nif x:\n    y = 1\nelse:\n    pass\n"), (2, "def ("), (3, None)], "id int, code string")
    df.createOrReplaceTempView("programs_in_test")
    got = spark.sql("SELECT id, s.* FROM programs_in_test, LATERAL statements_in_test(code) s").collect()
    assert [tuple(r) for r in got] == [(1, 1, 0, "Import"), (1, 2, 0, "If"), (1, 3, 1, "Assign"), (1, 5, 1, "Pass")]
