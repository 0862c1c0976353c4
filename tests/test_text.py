"""Column functions on hand-written literals."""

import pytest
from pyspark.sql import functions as F

from loomspark.functions import text as T

FENCE = "`" * 3
D3, S3 = '"' * 3, "'" * 3


def values(spark, f, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t"))).collect()]


def test_fence_match(spark):
    got = values(spark, T.fence_match, "no fence", f"a\n{FENCE}python\nx = 1\n{FENCE}\nb", f"{FENCE}python\nx", f"{FENCE}json\n1\n{FENCE}", f"{FENCE}python{FENCE}python\nq\n{FENCE}", f"{FENCE}python\na\n{FENCE}\n{FENCE}python\nb\n{FENCE}", "", None)
    assert got == [None, "x = 1", None, None, "q", "a", None, None]


def test_fence_regex(spark):
    text = f"{FENCE}python{FENCE}python\nq\n{FENCE}"
    assert values(spark, T.fence_match, text) == ["q"]
    assert values(spark, T.fence_regex, text, None, "x", f"{FENCE}json\n1\n{FENCE}") == ["", None, None, None]
    bare = f"{FENCE}\n\n x = 1 \n{FENCE}"
    assert values(spark, lambda c: T.fence_regex(c, ""), f"{FENCE}json\n1\n{FENCE}", bare, f"{FENCE}python x{FENCE}") == ["1", "x = 1", "x"]
    assert values(spark, lambda c: T.fence_regex(c, "c++"), f"{FENCE}c++\nint x;\n{FENCE}", f"{FENCE}c\nint x;\n{FENCE}") == ["int x;", None]


def test_lines_of(spark):
    texts = ["", "a", "a\n", "a\r\nb\rc\n\n", "\n", "a\u2028b\x0cc", None]
    assert values(spark, T.lines_of, *texts) == [None if t is None else t.splitlines() for t in texts]


def test_crash_and_forward_local(spark):
    head = "Traceback (most recent call last):\n"
    frame = lambda f, n, where, code: f'  File "{f}", line {n}, in {where}\n    {code}\n'
    lib = frame("/usr/lib/python3.13/site-packages/torch/nn.py", 9, "forward", "return F.x(y)")
    texts = [head + frame("a.py", 3, "<module>", "y = m(x)") + frame("a.py", 7, "forward", c) + lib + "RuntimeError: no" for c in ("x = torch.cat([x, y], 1)", "x = self.fc(x)", "x = self.blocks[0](x)", "x + 1")]
    texts += [head + frame("a.py", 5, "__init__", "self.a = B(1)"), "no traceback", None]
    got = values(spark, T.crash, *texts)
    assert [None if g is None else (g.crash_stage, g.line_no) for g in got] == [("forward", 7)] * 4 + [("init", 5), None, None]
    found = values(spark, T.forward_local, *texts)
    assert found[0].root_cause_type == "Forward_Local_Crash" and found[0].forward_definition.original_call == "x = torch.cat([x, y], 1)" and found[0].init_definition == {} and found[1:] == [None] * 6
    assert [len(f) if f is not None else None for f in values(spark, T.user_frames, *texts)] == [2, 2, 2, 2, 1, 0, None]


def test_slug_by_sign(spark):
    assert values(spark, T.slug_by_sign, "org/Gem-3.4b--it", "_x_", None) == ["gem_3_4b__it", "x", None]


def test_prompts(spark):
    from loomspark.functions import prompts as P

    q, docs = F.lit("Do it"), F.array(F.lit("d1"), F.lit(None).cast("string"))
    row = spark.range(1).select(P.zero_shot(F.lit(None).cast("string"), F.lit("pytorch")), P.candidates(q, F.lit("x")), P.with_documents(q, F.lit("x"), docs), P.retrieval(q, F.lit("x"), docs), P.numbered(F.array().cast("array<string>")), P.unresolved(F.lit("x = 1"), F.lit("Error: y"))).first()
    assert "pytorch" in row[0] and "api_name" in row[1] and "Documents:\nd1" in row[2] and "[Retrieved API 1]\nd1\n\n[Retrieved API 2]\n" in row[3] and row[4] == "(no API retrieved)" and "x = 1" in row[5] and row[5].index("Error: y") > row[5].index("x = 1")


@pytest.mark.parametrize(
    "code, n",
    [
        ("", 0), ("\n  \n", 0), ("# a\n#b", 0), ("x = 1\n\n y", 2), (f"{D3}doc{D3}\nx", 1), (f"{D3}\na\nb\n{D3}\nx", 1), (f"{S3}\na {D3}\nx", 1),
        (f"x = {D3}\na\n{D3}\nb", 2), ("\tx\n\t# c\n", 1), (f"{D3}open\na", 0),
    ],
)
def test_code_lines(spark, code, n):
    assert values(spark, T.code_lines, code) == [n]


def test_code_lines_null_and_blank_lines_added(spark):
    assert values(spark, T.code_lines, None) == [None]
    a, b = values(spark, T.code_lines, "x\ny", "x\ny\n\n\n")
    assert a == b == 2


def test_strip_shape_comments(spark):
    text = "a = 1  # output tensor shape: (1, 2)\n# the initial shape of x is: (3,)\nb   \n"
    once = values(spark, T.strip_shape_comments, text)
    assert once == ["a = 1\n\nb\n"] and values(spark, T.strip_shape_comments, *once) == once
    assert values(spark, T.strip_shape_comments, "", None, "  \n") == ["", None, ""]


def test_slug(spark):
    assert values(spark, T.slug, "a/B-c..D_ ", "_x_", None, "") == ["b_c_d", "x", None, ""]


def test_natural_key(spark):
    names = ["t10", "T2", "t2a", "3b", "12", ""]
    keys = values(spark, T.natural_key, *names)
    assert sorted(names, key=lambda n: keys[names.index(n)]) == ["", "3b", "12", "T2", "t2a", "t10"]
    assert values(spark, lambda c: T.natural_key(c, False), "Ab") == ["Ab"]


def test_api_base(spark):
    assert values(spark, T.api_base, " a.b(c) ", "single", None, "x.y.z", "(a.b)") == ["a.b", None, None, "x.y.z", None]


def test_shape_and_frames(spark):
    assert values(spark, T.shape_of, " is: (1, 3, 32)", "(unknown)", "(5,)", "(2, x", None) == [[1, 3, 32], None, [5], None, None]
    got = values(spark, T.frames, 'File "a.py", line 3, in f\n  File "b.py", line 10', "", None)
    assert [[(x.file, x.line) for x in g] if g is not None else None for g in got] == [[("a.py", 3), ("b.py", 10)], [], None]


def test_conv_size(spark):
    df = spark.createDataFrame([(0, 32, 3, 1, 1), (1, 32, 3, 2, 0), (2, 2, 5, 1, 0)], "i int, h int, k int, s int, p int")
    got = df.orderBy("i").select(*[T.conv_size(F.col("h"), F.col("k"), F.col("s"), F.col("p"), m) for m in ("valid", "same", "transposed")])
    assert [tuple(r) for r in got.collect()] == [(32, 32, 32), (15, 16, 65), (None, 2, 6)]
