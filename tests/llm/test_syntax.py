"""The statement grammar against Python's and JSON's own parsers."""

import ast
import json
import random

import pytest

from loomspark.llm import syntax as S

BASE = """import torch
import torch.nn as nn

class Net(nn.Module):
    def __init__(self):
        super().__init__()
        self.fc = nn.Linear(
            in_features=3,
            out_features=4,
        )
        # note
        self.d = {"a": [1, 2], 'b': (3,)}

    @property
    def size(self):
        \"\"\"Doc with ( bracket.\"\"\"
        if self.x > 1 and \\
                self.y:
            return 1
        elif self.z: return 2
        else:
            return f"{self.x!r:>{3}} {'a'}"

try:
    net = Net()
except ValueError as e:
    print("bad", e)
else:
    pass
finally:
    pass
for i in range(3):
    while i:
        break
    else:
        continue
with open("x") as f, open("y") as g:
    del f
match net:
    case 1:
        pass
async def go():
    await x
x: int = 1; y = 2
"""


def truth(code):
    try:
        ast.parse(code)
        return True
    except (SyntaxError, ValueError):
        return False


def test_base_and_mutations(monkeypatch):
    assert truth(BASE) and S.valid(BASE, "py")
    rng = random.Random(5)
    lines = BASE.split("\n")
    odd = ["else:", "  x", "\tx", "try:", "finally:", ")", "(", '"""', "'''", "@d", "elif 1:", "<<<<<<< a", "=======", "x = = 1", "\\", "print 1", "return", "class A:", "﻿x", "x = 1,，2", "007", "é = 1", "lambda: 0", "if 1: pass", "x\\"]
    for _ in range(3000):
        part = lines[:]
        for _ in range(rng.randint(1, 2)):
            i = rng.randrange(len(part))
            act = rng.random()
            if act < 0.3:
                del part[i]
            elif act < 0.7:
                part.insert(i, " " * rng.choice((0, 4, 8)) + rng.choice(odd))
            else:
                part[i] = part[i][: rng.randrange(len(part[i]) + 1)]
        code = "\n".join(part)
        monkeypatch.setattr(S, "CHUNK", rng.choice((1, 30, 200, 1024)))
        assert S.valid(code, "py") == truth(code), code


def test_no_parse_of_a_file(monkeypatch):
    """Statements alone reach the parser: at most one of them and what completes it."""
    seen = []
    real = S.ast.parse
    monkeypatch.setattr(S.ast, "parse", lambda text: seen.append(text) or real(text))
    for cache in (S._item_kept, S._local):
        cache.cache_clear()
    assert S.valid(BASE, "py") and not S.valid(BASE + "x = (", "py") and not S.valid(BASE + "else:\n    pass\n", "py")
    assert seen and max(len(x) for x in seen) < 160 and not any(BASE in x for x in seen)


def test_strings_that_hold_quotes_of_their_kind():
    for code in ('x = f"{a["b"]}"\n', 'if x:\n    y = f"{\n  a["("]\n}"\nelse: z\n', 'x = f"{a[")"]}" + (\n', 'x = f"{a["b"}"\n', "x = 'a{' - 'c'\n", "x = 'a{' b 'c'\n"):
        assert S.valid(code, "py") == truth(code), code


def test_outlines_fold_associatively():
    rng = random.Random(8)
    pool = ["x\n", "if x:\n", "elif y:\n", "else:\n", "try:\n", "except E:\n", "finally:\n", "for x in y: z\n", "@d\n", "def f():\n", "match x:\n", "case 1:\n", "case [x]: y\n"]
    good = 0
    for _ in range(4000):
        lines, depth = [], 0
        for _ in range(rng.randint(1, 12)):
            line = rng.choice(pool)
            lines.append("  " * depth + line)
            depth = depth + 1 if line.endswith(":\n") and rng.random() < 0.95 else max(0, depth - rng.choice((0, 0, 1, 1, 2)))
        items = [S.item(x) for x in lines]
        i = rng.randrange(len(items) + 1)
        a, b, whole = S.fold(items[:i]), S.fold(items[i:]), S.fold(items)
        parts = None if a is None or b is None else S.fold([*a, *b])
        assert S.closed(parts) == S.closed(whole) == truth("".join(lines)), lines
        good += S.closed(whole)
    assert good > 100


def test_json_folds_associatively():
    rng = random.Random(9)
    for _ in range(3000):
        text = "".join(rng.choice("{}[]sv,:,,vsv") for _ in range(rng.randint(0, 14))) if rng.random() < 0.5 else "{s:[" + ",".join(rng.choice("svvv") for _ in range(60)) + "],s:v" + ",s:s" * rng.choice((0, 30)) + "}"
        i = rng.randrange(len(text) + 1)
        assert (S.json_fold(S.json_fold(text[:i]) + S.json_fold(text[i:])) in ("s", "v")) == (S.json_fold(text) in ("s", "v"))


def test_lone_carriage_returns():
    for code in ("def f():\n    x = 1\ry = 2\n    z = 3\n", "x = 1\ry = 2\n", "if x:\r\n    y\r\n", "if x:\r    y\r"):
        assert S.valid(code, "py") == truth(code)


def test_summaries_are_associative():
    rng = random.Random(3)
    pieces = ["x = (1,\n", "2)\n", '"""\n', "a # (\n", "'it\\'s'\n", "]\n", "{\n", "y = 'x\\\n", "z'\n", "'''\n", ")\n", "\n"]
    for _ in range(400):
        a, b, c = ("".join(rng.choice(pieces) for _ in range(rng.randint(1, 4))) for _ in range(3))
        ma, mb, mc = (S.state_map(S.lines_of(x)) for x in (a, b, c))
        left = S.combine_maps(S.combine_maps(ma, mb), mc)
        right = S.combine_maps(ma, S.combine_maps(mb, mc))
        whole = S.state_map(S.lines_of(a + b + c))
        for s in S.STATES:
            assert left[s][0] == right[s][0] == whole[s][0] and left[s][2] == right[s][2]
            if "!" not in left[s][1] + whole[s][1]:
                assert left[s] == right[s] == whole[s]


@pytest.mark.parametrize("text", ['{"a": 1}', "[1, 2", "NaN", '{"a": 01}', '"\t"', "[]", '{"a": 1,}', " 1 ", "[[[]]]", '{"a" 1}', "-", "tru", "1 2", "﻿1", '{"a": {"b": [true, null, -1.5e3]}}', "[1,]", "}", '"\\u12"'])
def test_json(text):
    def bad(name):
        raise ValueError(name)

    try:
        json.loads(text, parse_constant=bad)
        want = True
    except ValueError:
        want = False
    assert S.json_valid(text) == want


def test_json_deep_and_long_numbers():
    assert S.json_valid("[" * 100_000 + "]" * 100_000) and not S.json_valid("[" * 100_000 + "]" * 99_999)
    assert S.json_valid("1" * 10_000)


def test_rows_and_rates(spark, monkeypatch):
    big_ok = "x = (\n1,\n)\n" * 9000 + "def f():\n    return '''\n(\n'''\n"
    rows = [(1, "a.py", "x = 1", "m"), (2, "A.PY", "x = (", "m"), (2, "A.PY", "x = (", "m"), (3, "a.json", "{", "M"), (4, "a.json", "[1]", "m"), (5, "a.py", None, None), (6, "a.py", " \n", "m"), (7, None, "x = (", "m"), (8, "a.txt", "x = (", "m"), (9, "b.py", big_ok, "m"), (10, "b.py", big_ok + "x = )\n", "m"), (11, "b.json", "[" * 70_000, "m"), (None, "a.py", "x = (", "m")]
    df = spark.createDataFrame(rows, "repair_id long, filename string, repaired_code string, model string").withColumn("language", df_lit())
    got = {r.repair_id for r in S.invalid_ids(df.where("repair_id is not null")).collect()}
    assert got == {2, 3, 10, 11}
    assert got == {r.repair_id for r in S.invalid_ids(df).collect()}
    rates = {(r.model, r.language): (r.files, r.invalid) for r in S.invalid_rates(df.where("repair_id is not null"), S.invalid_ids(df.where("repair_id is not null"))).collect()}
    assert rates[("m", "py")] == (4, 2) and rates[("m", "json")] == (3, 2)
    assert S.invalid_ids(df.where("false")).count() == 0


@pytest.mark.parametrize("chunk, group", [(30, 2), (200, 64)])
def test_chunks_spread_over_partitions(spark, monkeypatch, chunk, group):
    """Every file as chunks in tasks of their own, reduced by a tree, against the parsers."""
    monkeypatch.setattr(S, "CHUNK", chunk)
    monkeypatch.setattr(S, "GROUP", group)
    monkeypatch.setattr(S, "HELD", 0)
    rng = random.Random(4)
    lines = BASE.split("\n")
    cases = [BASE, BASE * 6, "x = f\"{a['b']}\"\n" * 9 + 'y = f"{a["("]}"\n', "x = (\n" + "1,\n" * 90 + ")\n", "x = (\n" + "1,\n" * 90, "#\n" * 50, "'''\n" + "a\n" * 90 + "'''", "'''\n" + "a\n" * 90, "x\0", "if x:\n" + "    y\n" * 60 + "else:\n    z\n"]
    for _ in range(14):
        part = lines[:]
        part.insert(rng.randrange(len(part)), rng.choice(["else:", ")", "(", "'''", "x", "  x"]))
        cases.append("\n".join(part))
    rows = [(i, "a.py", c) for i, c in enumerate(cases)]
    texts = [json.dumps({"a": list(range(90)), "b": [{"c": "d"}] * 20}, indent=1), "[\n" * 40 + "]\n" * 40, "[\n" * 40 + "]\n" * 39, '{"a": 1,\n"b"\n: [2,\n3,,4]}', "1\n2\n", "\n" * 40 + "1"]
    rows += [(100 + i, "b.json", t) for i, t in enumerate(texts)]

    def fine(i, text):
        if i < 100:
            return truth(text)
        try:
            json.loads(text)
            return True
        except ValueError:
            return False

    df = spark.createDataFrame(rows, "repair_id long, filename string, repaired_code string").repartition(3)
    assert {r.repair_id for r in S.invalid_ids(df).collect()} == {i for i, _, t in rows if not fine(i, t)}


def df_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")
