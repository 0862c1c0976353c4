"""Leaks against brute force; subjects on made documents."""

import random

from loomspark.llm import leaks as L
from loomspark.llm import subjects as S


def brute(docs, tasks, run=15):
    out = set()
    for d, text in docs:
        w = L.words(text)
        have = {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}
        for t, q in tasks:
            v = L.words(q)
            if any(tuple(v[i : i + run]) in have for i in range(len(v) - run + 1)):
                out.add((d, t))
    return out


def made(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["the", "of", "a"] * 6
    tasks = [(f"t{i}", " ".join(rng.choice(vocabulary) for _ in range(rng.randint(16, 60)))) for i in range(40)]
    tasks += [("same", tasks[0][1]), ("short", "w1 w2 w3"), ("null", None), ("exact", " ".join(f"x{i}" for i in range(15)))]
    docs = []
    for d in range(300):
        words = [rng.choice(vocabulary + ["out", "side"]) for _ in range(rng.randint(0, 120))]
        if d % 3 == 0:
            v = L.words(tasks[rng.randrange(40)][1])
            n = rng.choice((13, 14, 15, 16, 30))
            s = rng.randrange(max(1, len(v) - n))
            at = rng.randrange(len(words) + 1)
            words[at:at] = [x.upper() if rng.random() < 0.3 else x for x in v[s : s + n]]
        docs.append((d, rng.choice([" ", ", ", "_\n"]).join(words)))
    docs += [(900, None), (901, ""), (902, "x0-X1_x2 " + " ".join(f"x{i}" for i in range(3, 15))), (903, "pad " * 40_000 + tasks[2][1])]
    return docs, tasks


def test_leaks_in_every_sharding(spark, monkeypatch):
    docs, tasks = made()
    want = brute(docs, tasks)
    d = spark.createDataFrame([(*x, "clash") for x in docs] + [(*docs[0], "again")], "doc_id long, text string, task_id string").repartition(4)
    t = spark.createDataFrame([(*x, 1) for x in tasks] + [(*tasks[1], 2)], "task_id string, requirement string, doc_id int")
    assert len(want) > 40
    for chars, shards in ((10**6, 4), (700, 4), (700, 3)):
        monkeypatch.setattr(L, "SHARD_CHARS", chars)
        monkeypatch.setattr(L, "SHARDS", shards)
        got = [(r.doc_id, r.task_id) for r in L.leaks(d, t).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert L.leaks(d.where("false"), t).count() == 0 and L.leaks(d, t.where("false")).count() == 0


def test_search_equals_exhaustive_scores():
    _, tasks = made(5)
    index = L.Index([(i, q, None) for i, q in tasks])
    rng = random.Random(6)
    for _ in range(300):
        terms = {rng.choice(list(index.top)) for _ in range(rng.randint(1, 30))}
        want = []
        for no in range(len(index.items)):
            lists = [index.lists[t] for t in terms]
            score = sum(w[k.index(no // L.BLOCK)][no % L.BLOCK] for k, _, w in lists if no // L.BLOCK in k)
            if score >= 1 - 1e-9:
                want.append(no)
        assert index.search(terms) == want


def test_search_skips_blocks(monkeypatch):
    """Lists behind the pivot skip to it: a rare pair of words doesn't walk through a common word's blocks."""
    monkeypatch.setattr(L, "BLOCK", 2)
    items = [(f"t{i}", " ".join(["the", *[f"w{i}x{k}" for k in range(16)]]), None) for i in range(400)]
    index = L.Index(items)
    moves = []
    real = L.bisect_left
    monkeypatch.setattr(L, "bisect_left", lambda *a: moves.append(1) or real(*a))
    assert index.search(set(items[399][1].split())) == [399] and len(moves) <= 2


def test_answers(spark):
    q = " ".join(f"q{i}" for i in range(20))
    code = "value = first_function(1)\nother = second_function(2)"
    d = spark.createDataFrame([(1, q + "\n" + code.split("\n")[0])], "doc_id long, text string")
    got = L.leaks(d, spark.createDataFrame([("t", q)], "task_id string, requirement string"), spark.createDataFrame([("t", code)], "task_id string, code string")).first()
    assert got.run_words == 20 and got.answer_share == 0.5


AREAS = [("music", ["melody", "bass clef", "音阶"]), ("sport", ["pitch", "referee"]), ("law", None)]
CASES = {
    1: ("The melody is nice. We like bass-clefs here.", {"music"}),
    2: ("The melody is nice. Nothing more.", set()),
    3: ("melody_x = load(melody)\nprint(bass_clef)", {"music"}),
    4: ("From melody to pitch to verdict it goes. The melody again.", set()),
    5: ("音阶很好。我们喜欢音阶。", {"music"}),
    6: ("A pitch contour moves. The pitch contours end.", {"music"}),
    7: ("The REFEREE came. Melodies and melodyx don't count. referee!", {"sport"}),
    13: ("From pitch to melody, bass clef and verdict it goes. The melody again.", {"music"}),
    8: (None, set()), 9: ("", set()), 10: ("  \n", set()),
    11: ("plain. " * 20_000 + "melody. bass clef.", {"music"}),
    12: ("The verdict stands.The plaintiff left.", {"law"}),
}


def test_subjects(spark):
    areas = spark.createDataFrame(AREAS + [(None, ["x"])], "subject string, example_terms array<string>")
    docs = spark.createDataFrame([(i, t, "clash", 0.1) for i, (t, _) in CASES.items()] + [(1, CASES[1][0], "clash", 0.1), (None, "melody. melody.", "x", 0.0)], "doc_id long, text string, subject string, score double")
    labels = spark.createDataFrame([(1, "Music", "r"), (1, "music", "s"), (2, "sport", "r"), (None, "law", "r"), (3, None, "r"), (99, "law", "r")], "doc_id long, subject string, rater string")
    got = {}
    rows = S.document_subjects(docs, areas, labels).collect()
    for r in rows:
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert len(rows) == len(set(map(tuple, rows)))
    assert {i: got.get(i, set()) for i in CASES} == {i: s for i, (_, s) in CASES.items()}
    assert S.document_subjects(docs, areas, labels.where("false")).count() == len(rows)
    assert S.document_subjects(docs.where("false"), areas, labels).count() == 0 and S.document_subjects(docs, areas.where("false"), labels).count() == 0


def test_thresholds_are_lowest_within_noise():
    good = [(1.0 + i / 100, 1.0, 1.0) for i in range(100)]
    bad = [(0.1 + i / 1000, 1.0, 0.0) for i in range(100)]
    assert 0.15 < S.lowest(good + bad, 0.0) < 1.0 and S.lowest(good, 0.0) == S.lowest(good, 50.0) == 0.5
    assert S.lowest([], 3.0) is None and S.lowest(bad, 0.0) is None


def test_thresholds_are_fitted_on_all_labelled_documents(spark):
    """25,000 labelled documents in several ranges of scores and many batches, against the rule over all points at once."""
    rng = random.Random(8)
    scored, labels = [], []
    for i in range(25_000):
        for s, noise in (("Music", 0.3), ("law", 0.6)):
            score = round(rng.random() * 2, rng.choice((3, 6)))
            scored += [(i, s, score)] if rng.random() < 0.9 else []
            labels += [(i, s.upper())] * 2 if score + rng.gauss(0, noise) > 1.0 else []
        labels += [(i, " unknown ")]
    scored += [(i, "law", 0.5) for i in range(25_000, 30_000)]  # not labelled
    given, points, missed = {(i, s.strip().lower()) for i, s in labels}, {"music": [], "law": []}, dict.fromkeys(("music", "law"), 0)
    for i, s, score in scored[:-5_000]:
        points[s.lower()].append((score, float((i, s.lower()) in given)))
    for s in points:
        missed[s] = sum(x == s for _, x in given) - sum(y for _, y in points[s])
    share = S.PRIOR / sum(s in points for _, s in given)
    pooled = [(x, share, share * y) for rows in points.values() for x, y in rows]
    expected = {s: S.lowest(pooled + [(x, 1.0, y) for x, y in points[s.lower()]], share * sum(missed.values()) + missed[s.lower()]) for s in ("Music", "law")}
    small = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
    before = {c: spark.conf.get(c) for c in small}
    try:
        for c, v in small.items():
            spark.conf.set(c, v)
        got = S.thresholds(spark.createDataFrame(scored, "doc_id long, subject string, score double"), spark.createDataFrame(labels, "doc_id long, subject string"), ["Music", "law"])
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert got.keys() == expected.keys() and all(abs(got[s] - expected[s]) < 1e-9 for s in got), (got, expected)


def test_scores_weigh_rarity_and_length(spark):
    terms = (("common", (("a", 1.0),)), ("loose", (("b", 0.5),)), ("rare", (("a", 1.0),)))
    texts = ["common. common."] * 30 + ["rare. rare.", "rare. rare. " + "plain. " * 40, "loose. loose."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.subject): r for r in S.scores(S.hits(docs, terms), terms).collect()}
    assert got[30, "a"].score > got[0, "a"].score and got[30, "a"].score > got[31, "a"].score > 0
    assert got[32, "b"].score < got[30, "a"].score and all(r.evidence == 2 for r in got.values())


def test_entry_adds_these_queries():
    import __spark_entry__ as e

    names = e.queries()
    assert all(any(n.startswith(f"p{i}_") for n in names) for i in range(1, 9)) and set(e.oracle_sql()) <= set(names)
