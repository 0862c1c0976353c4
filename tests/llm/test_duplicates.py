"""Canonical forms, the filters and the groups against brute force."""

import random

import pytest

from loomspark.llm import duplicates as D

CODE = 'import torch\nimport json\n\nconf = dict(run="r1", rate=0.5)\nx = nn.Linear(in_features=8, out_features=16)\ny = f(x, a=g(p=1, q=2), b=3)\n'


def test_free_orders_and_formats():
    base = D.canonical(CODE, "py")
    same = [
        CODE.upper(),
        'import json\n\n\nimport torch\nconf = dict(rate=0.5, run=\'r1\')\nx = nn.Linear(\n    out_features = 16,\n    in_features = 8,\n)\ny = f(x, b=3, a=g(q=2, p=1))',
        CODE.replace(", ", "，").replace("(", "（").replace(")", "）"),
        CODE.replace("\n", "\r\n"),
        CODE.replace("\n", "\r"),
        CODE.replace("_", " "),
        "# ---\n" + CODE,
    ]
    for other in same:
        assert D.canonical(other, "py") == base, other
    different = [
        CODE.replace("in_features=8, out_features=16", "in_features=16, out_features=8"),
        CODE.replace("f(x, a", "f(a"),
        CODE.replace("rate=0.5", "rate=0.6"),
        "\n".join([*CODE.split("\n")[:3], *CODE.split("\n")[3:6][::-1]]),
        CODE.replace("f(x, a=g(p=1, q=2), b=3)", "f(x, a=g(p=1, b=3), q=2)"),
    ]
    for other in different:
        assert D.canonical(other, "py") != base, other
    assert D.canonical("def f(a=1, b=2): pass", "py") != D.canonical("def f(b=2, a=1): pass", "py")


def test_json_keys():
    a = D.canonical('{"a": 1, "b": {"c": [1, 2], "d": "x y"}}', "json")
    assert a == D.canonical('{\n "b": {"d": "x y", "c": [1, 2]},\n "a": 1\n}', "json")
    assert a != D.canonical('{"a": 1, "b": {"c": [2, 1], "d": "x y"}}', "json")
    assert a != D.canonical('{"b": 1, "a": {"c": [1, 2], "d": "x y"}}', "json")


def test_odd_texts():
    for text in (None, "", " \n", "---", "((((", "))))", "f(" * 5000, '"', "f(a=", "{", "=", ",", "import"):
        D.canonical(text, "py"), D.canonical(text, "json")
    assert D.canonical("-- ==", "py") == ""


def test_filter_misses_no_repeat(spark):
    rng = random.Random(1)
    values = [rng.getrandbits(63) for _ in range(3000)]
    rows = [(i, v - (1 << 62), v) for i, v in enumerate(values + values[:40] + [values[7]] * 30)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "repair_id long, h1 long, h2 long").repartition(7)
    for blocks in (1, 4):
        bits = {r.block: bytes(r.bits) for r in D.repeat_filter(df, blocks).collect()}

        def again(h1, h2):
            b = bits[h1 % blocks]
            return all(b[s >> 3] >> (s & 7) & 1 for s in ((h2 >> 15 * k) & D.BLOCK_BITS - 1 for k in range(D.PROBES)))

        assert all(again(v - (1 << 62), v) for v in values[:40])
        passed = sum(again(v - (1 << 62), v) for v in values[40:])
        assert passed < 300  # false positives only cost a shuffle


@pytest.mark.parametrize("wave", [8192, 2])
def test_waves_let_through_as_little(spark, monkeypatch, wave):
    """100,000 records against waves of one block or few: the same groups, and under two per cent of the rest let through."""
    monkeypatch.setattr(D, "WAVE", wave)
    n = 100_000 if wave > 2 else 20_000
    rows = spark.range(n).selectExpr("id AS repair_id", "'a.py' AS filename", f"concat('v', if(id < 400, id div 2, id), ' = 1') AS repaired_code").repartition(8)
    monkeypatch.setattr(D, "BITS_A_RECORD", 12)
    grouped, single = D.canonical_groups(rows)
    assert {(r.first_id, r.copies) for r in grouped.where("copies > 1").collect()} == {(i, 2) for i in range(0, 400, 2)}
    assert grouped.count() + single.count() == n and grouped.where("copies = 1").count() < 0.02 * n


def test_groups_with_a_hot_one(spark):
    rng = random.Random(2)
    rows = [(i, "a.py", "x = 1" if i % 3 == 0 else f"y = {rng.randrange(150)}", 5) for i in range(1, 600)]
    rows += [(3, "a.py", "X=1", 5), (700, "a.py", None, 1), (701, "a.py", "##", 1), (702, None, "x=1", 1), (None, "a.py", "x = 1", 1)]
    df = spark.createDataFrame(rows, "repair_id long, filename string, repaired_code string, first_id int").repartition(5)
    want, groups = set(), {}
    for i, _, code, _ in rows:
        if i is not None and code and D.canonical(code, "py"):
            groups.setdefault(D.canonical(code, "py"), set()).add(i)
    for ids in groups.values():
        want |= {(min(ids), i) for i in ids if i != min(ids)}
    got = [tuple(r) for r in D.copy_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {tuple(r) for r in D.collapsed(df).collect()} == {(min(x), len(x)) for x in groups.values()}
    assert D.copy_pairs(df.where("false")).count() == 0
