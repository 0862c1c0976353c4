"""Cut values and defective pairs: held-out accuracy on made texts, and all defined cases."""

import math
import random

import pytest

from loomspark.llm import cuts, pairs

FENCE = "`" * 3
ENDS = ["The batch stays as it is.", "Nothing else was changed.", "I kept every name and comment.", "Hope this helps!", "- rest: unchanged"]


def program(rng):
    lines = ["import torch", "", "class Net:", "    def forward(self, x):"] + [f"        x = self.layer{rng.randrange(9)}(x)" for _ in range(rng.randint(3, 9))]
    return "\n".join([*lines, "        return x", "", rng.choice(["net = Net()", "print(net)", f"LIMITS = [{rng.randrange(99)}]"])])


def answer(rng, code):
    said = " ".join(rng.sample(ENDS[:3], 2) + [rng.choice(ENDS)])
    return f"Here is the program.\n\n{FENCE}python\n{code}\n{FENCE}\n\n{said}"


def corpus(n=900, seed=4):
    rng = random.Random(seed)
    rows, truth = [], set()
    for i in range(n):
        code = program(rng)
        response = answer(rng, code)
        name = "a.py"
        if i % 15 == 0:
            at = rng.randrange(40, len(response) - 8)
            while response[:at].rstrip().endswith((".", "!", "unchanged", FENCE)):
                at -= 1
            response = response[:at] + rng.choice(["", "", " <cut>", "…", "..."])
            truth.add((i, "llm_response"))
        if i % 17 == 0:
            code = code[: code.rindex("self.") + 7]
            truth.add((i, "repaired_code"))
        rows.append((i, name, response, code, "m/A" if i % 2 else "a", "de"))
    return rows, truth


def test_held_out_accuracy(spark):
    rows, truth = corpus()
    rows += [(5001, "a.py", None, " ", "m", "x"), (5002, None, "", None, None, None), (rows[0][0], *rows[0][1:])]
    df = spark.createDataFrame(rows, "repair_id long, filename string, llm_response string, repaired_code string, model string, language string").repartition(3)
    found = cuts.cut_values(df)
    got = [(r.repair_id, r.field) for r in found.collect()]
    assert len(got) == len(set(got))
    hit = len(set(got) & truth)
    assert hit / len(truth) > 0.93 and hit / len(got) > 0.93
    rates = {(r.model, r.field): r["values"] for r in cuts.cut_rates(df, found).collect()}
    assert rates[("a", "llm_response")] == 900
    assert cuts.cut_values(df.where("false")).count() == 0


def test_marks_fences_headers():
    assert cuts.unmarked("text cut […]  ".rstrip()) == ("text cut", True) and cuts.unmarked("done ") == ("done", False)
    assert cuts.unmarked("..." ) == ("", True)
    assert cuts.open_fence(f"a\n{FENCE}python\nx") and not cuts.open_fence(f"a\n{FENCE}\nx\n{FENCE}\nb")
    assert cuts.open_header("def f(a):") and not cuts.open_header("x = 1")
    code = "\n".join(f"x{i} = {i}" for i in range(9))
    text = f"A\n{FENCE}python\n{code}\n{FENCE}\n"
    assert cuts.quoted(code, text) is False and cuts.quoted(code[:-3], text) is True and cuts.quoted("other" * 10, text) is None and cuts.quoted(code, None) is None


def test_thresholds_move_little_with_few_values(spark):
    """One rule at every number of values: a language with few values takes nearly the column's place."""
    many = [("en", 0.8 + 0.001 * (i % 3), "llm_response") for i in range(300)] + [("en", s, "llm_response") for s in [-2.0] * 400 + [4.0] * 4000]
    limit = {n: cuts.thresholds(spark.createDataFrame(many + [("de", s, "llm_response") for s in ([4.0] * 9 + [-1.0]) * n], "language string, score double, field string")) for n in (1, 19, 21, 200)}
    assert len({x["en", "llm_response"] for x in limit.values()}) == 1 and len({x["de", "llm_response"] for n, x in limit.items() if n < 100}) == 1
    assert abs(limit[1]["en", "llm_response"] - 0.8) > cuts.STEP / 2
    assert cuts.thresholds(spark.createDataFrame([("en", 5.0, "x")], "language string, score double, field string")) == {("en", "x"): min((cuts.LOW + cuts.STEP * (i + 0.5) for i in range(8)), key=lambda v: abs(v - cuts.MIDDLE))}


@pytest.mark.parametrize("most", [28, 12])
def test_scores_are_of_exact_counts(spark, monkeypatch, most):
    """Counts of texts of very many contexts, by one filter and by several for a share each."""
    monkeypatch.setattr(cuts, "MOST_FILTER", most)
    monkeypatch.setattr(cuts, "LEAST_FILTER", min(most, 16))
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyzäöü()=,.: "
    texts = ["".join(rng.choices(letters, k=1500)).strip() + rng.choice([" done.", " and so on", "x", rng.choice(letters[:20]) + " whole text ends here."]) for _ in range(300)]
    texts += ["ab", "b", "c whole text ends here." * 40]
    data = [t.encode() for t in texts]
    padded = [b"\xff" * 16 + t for t in data]
    places = sum(map(len, data))
    everywhere, ends = {}, {}
    for t in padded:
        for order in (4, 8, 16):
            for i in range(17, len(t) + 1):
                everywhere[t[i - order : i]] = everywhere.get(t[i - order : i], 0) + 1
            ends[t[-order:]] = ends.get(t[-order:], 0) + 1
    want = []
    for t in padded:
        c = next(t[-o:] for o in (16, 8, 4) if o == 4 or everywhere[t[-o:]] >= cuts.SEEN)
        want.append(math.log((max(ends[c] - 1, 0) + cuts.ALONE) / everywhere[c] * places / len(texts)))
    df = spark.createDataFrame([(i, "a.py", None, t) for i, t in enumerate(texts)], "repair_id long, filename string, llm_response string, repaired_code string").repartition(3)
    got = {r.repair_id: r.score for r in cuts.scored(df).collect()}
    assert len(got) == len(want) and all(abs(got[i] - w) < 1e-9 for i, w in enumerate(want))


@pytest.mark.parametrize("size", [16, 40, 1 << 17])
def test_occurrences_of_long_texts_in_pieces(size):
    """Every context of every place, by a filter that holds all, however the texts are cut into runs."""
    import numpy as np

    rng = random.Random(6)
    texts = [bytes(rng.choices(b"abc", k=n)) for n in (0, 1, 15, 16, 17, 100, 333)]
    want = {}
    for t in texts:
        padded = cuts.GAP + t
        for order in cuts.ORDERS:
            for i in range(len(cuts.GAP) + 1, len(padded) + 1):
                want[padded[i - order : i]] = want.get(padded[i - order : i], 0) + 1
    got = {}
    for contexts, counts in cuts.occurrences(texts, 1, np.full(8, 255, np.uint8), 6, size):
        got.update({bytes(c): int(n) for c, n in zip(contexts, counts)})
    assert got == want


PROMPT = f"You repair programs. The program below stops with an error; change as little as possible.\n\n{FENCE}python\nx = conv(8, 16)\ny = x + 1\nprint(y)\n{FENCE}\n\nTraceback: line 3, wants 8 gets 16. Please explain in a few sentences."


def test_pair_checks():
    for text in (None, "", " \n", "None", "N/A", "...", "{}", "​", f"{FENCE}python\n\n{FENCE}", "(no answer)", "<empty>"):
        assert pairs.is_empty(text), text
    assert not pairs.is_empty("x") and not pairs.is_empty("word " * 60) and pairs.is_empty("- " * 200)
    assert pairs.is_copy(PROMPT, PROMPT.upper()) and pairs.is_copy(PROMPT, "You asked:\n\n" + PROMPT) and pairs.is_copy(PROMPT, "\n".join("> " + x for x in PROMPT.split("\n")))
    assert not pairs.is_copy(PROMPT, PROMPT + " The layer was wrong, so I set its width to eight and kept all of the rest.")
    assert not pairs.is_copy(PROMPT, "x = conv(8, 8)\ny = x + 1\nprint(y)")
    lines = [f"line {k} asks for quite another change of the layer with index {k * 7}" for k in range(5)]
    assert pairs.is_copy("\n".join(lines), "\n".join(lines[1:4])) and not pairs.is_copy("\n".join(lines), lines[1])
    assert pairs.is_copy("a b c d e f g h i j " * 50_000, "a b c d e f g h i j " * 50_000)
    de = f"Die Schicht passte nicht zu den Werten, die dort ankommen.\n{FENCE}python\nx = conv(8, 8)\n{FENCE}"
    assert pairs.wrong_language(PROMPT, de) and not pairs.wrong_language(PROMPT + " Please explain it in German.", de)
    assert not pairs.wrong_language(PROMPT + " Write it in good German, please.", de) and not pairs.wrong_language(PROMPT + " 请用德文回答。", de)
    assert pairs.wrong_language(PROMPT + " The German team wrote this program, and the log is German.", de)
    assert not pairs.wrong_language(PROMPT, f"{FENCE}python\nx = 1\n{FENCE}")


def words(rng, n=60):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(n))


def test_defects(spark):
    rng = random.Random(9)
    rows = []
    for i in range(400):
        code = program(rng)
        prompt = PROMPT.replace("16", str(20 + i)) + f" Case {i}. {words(rng)}" * 3
        rows.append((i, prompt, answer(rng, code), "a.py", code))
    refusal = "As things stand this request lies outside of what the team hands out, please ask somebody who knows the whole project well"
    for i in range(5):
        rows[i] = (i, rows[i][1], f"{refusal} {'today' if i % 2 else 'now'}.", "a.py", None)  # none of its words is listed anywhere
    rows[5] = (5, rows[5][1], "Thanks. I'd rather leave this one alone!", "a.py", None)
    rows[6] = (6, rows[6][1], None, "a.py", None)
    rows[7] = (7, rows[7][1], rows[7][1], "a.py", None)
    rows[8] = (8, None, None, "a.py", None)
    rows[9] = (9, rows[9][1], "Open the file and replace the 29 by 8 in line 3. Nothing else was changed.", "a.py", None)
    rows[10] = (10, rows[10][1], rows[10][2][: rows[10][2].index("self.") + 6], "a.py", None)
    rows[11] = (11, rows[11][1], "I'd rather leave this one alone. Sorry for that.", "a.py", None)
    for i in range(12, 18):  # one prompt and reworded copies of it: what recurs across these tells nothing
        rows[i] = (i, rows[12][1] + f" Reworded {i}.", "The width of that layer is simply too large there.", "a.py", None)
    rows.append(rows[6])
    df = spark.createDataFrame(rows, "repair_id long, prompt string, llm_response string, filename string, repaired_code string").repartition(3)
    got = {r.repair_id: r.defect for r in pairs.defects(df).collect()}
    want = {**{i: "refusal" for i in (0, 1, 2, 3, 4, 5, 11)}, 6: "empty", 7: "copy", 10: "truncated"}
    assert {k: v for k, v in got.items() if k < 18 and v != "truncated" or k == 10} == want and len(got) < 25
    assert pairs.defects(df.where("false")).count() == 0


def test_sketches_tell_unrelated_prompts():
    rng = random.Random(5)
    base = words(rng, 200)
    near, far = base.replace(base[200:230], "x y z"), words(rng, 200)
    differ = lambda a, b: sum(x != y for x, y in zip(pairs.sketch(a), pairs.sketch(b)))
    assert differ(base, near) < pairs.UNRELATED <= differ(base, far) and len(pairs.sketch("")) == pairs.SKETCH


def test_openings():
    assert pairs.openings(f"Danke! Zeile 12 in `a.b` geht nicht.\n{FENCE}python\nx = 1\n{FENCE}\nEnde.") == ["danke", "zeile in geht nicht"]
    assert pairs.openings("不能。抱歉。") == ["不 能", "抱 歉"] and pairs.openings("... 12") == [] and len(pairs.openings("w " * 9_000)[0].split()) == pairs.WORDS


def test_templates_follow_links(spark):
    base = [f"w{i}" for i in range(24)]
    texts = [" ".join([*base[: 24 - i], *[f"v{j}" for j in range(i)]]) for i in range(2)] + ["quite another opening of five words and more"]
    got = {r.opening: r.template for r in pairs.templates(spark.createDataFrame([(t,) for t in texts], "opening string")).collect()}
    assert got[texts[0]] == got[texts[1]] == min(texts[:2]) and got[texts[2]] == texts[2]


@pytest.mark.parametrize("heavy", [10_000, 5])
def test_templates_are_those_of_all_pairs(spark, monkeypatch, heavy):
    """Pairs of openings around one stock middle, each pair alike, and openings that share much but too little."""
    monkeypatch.setattr(pairs, "HEAVY", heavy)
    rng = random.Random(3)
    stock = [f"s{i}" for i in range(16)]
    texts = []
    for i in range(400):
        edge = [f"u{rng.randrange(10**6)}x{j}" for j in range(8)]
        texts += [" ".join([*edge[:4], *stock, *edge[4:]]), " ".join([*edge[:4], *stock, *edge[4:6], f"v{i}", "w"])]
    texts += [" ".join([*stock, *rng.choices("abc", k=8)]) for _ in range(100)] + ["short one", "short one now"]
    texts += [" ".join([f"h{j}" for j in range(i, i + 24)]) for i in range(12)]  # each alike with the next two only
    texts = sorted(set(texts))
    sets = [set(pairs.shingles(t.split())) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= pairs.ALIKE * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r.opening: r.template for r in pairs.templates(spark.createDataFrame([(t,) for t in texts], "opening string")).collect()}
    assert got == {t: texts[find(i)] for i, t in enumerate(texts)}
    assert len(set(got.values())) < len(texts) - 400
