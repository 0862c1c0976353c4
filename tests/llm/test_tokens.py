"""Counts, deltas and cubes against a full recount."""

import os

import pytest

from loomspark.llm import prose, tokens
from loomspark.llm.bpe import transducer
from loomspark.llm.encode import BYTE_BPE_50K

pytestmark = pytest.mark.skipif(not os.path.exists(BYTE_BPE_50K), reason="no vocabulary")
SCHEMA = "repair_id long, model string, lang string, dll string, prompt string, llm_response string, hash string"
EN, DE = "Find the layer that is wrong and explain it to me.", "Suche die Schicht, die nicht zu dem Modell passt, und gib das ganze Programm zurück."
ROWS = [
    (1, "org/A-b", "en", "PyTorch", EN, "x"), (2, "a_b", "EN", "pytorch", EN, None), (2, "a_b", "EN", "pytorch", EN, None), (3, "A_B ", None, "pytorch", DE, ""),
    (4, "c", "de", "tensorflow", EN, "yy zz"), (5, None, None, None, None, None), (6, "c", "zh_CN", "tensorflow", "x1 = 2", "x1"), (None, "c", "de", "tensorflow", DE, "q"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def brute(rows):
    count = transducer(BYTE_BPE_50K).count
    out = {}
    for r in {x for x in rows if x[0] is not None} | {x for x in rows if x[0] is None}:
        name = {"org/A-b": "a_b", "a_b": "a_b", "A_B ": "a_b", "c": "c", None: "unknown"}[r[1]]
        lang = prose.language(r[4]) or {"zh_CN": "zh", None: "und"}.get(r[2], (r[2] or "und").lower())
        key = (name, lang, (r[3] or "unknown").lower())
        a, b, c = out.get(key, (0, 0, 0))
        out[key] = (a + 1, b + count(r[4]), c + count(r[5]))
    return out


def cells(df):
    return {(r.model, r.lang, r.dll): (r.records, r.prompt_tokens, r.llm_response_tokens) for r in df.collect()}


def updated(spark, *tables):
    state = tokens.empty_state(spark)
    for rows in tables:
        state = tokens.update(frame(spark, rows), state)
    return state


def test_full_count(spark):
    state = updated(spark, ROWS)
    assert cells(state.cells) == brute(ROWS)
    texts = {t for r in ROWS for t in r[4:6] if t}
    assert state.counts.count() == len(texts) and {r.tokenizer for r in state.counts.collect()} == {tokens.tokenizer_hash(BYTE_BPE_50K)}
    total = [r for r in tokens.cube(state.cells).collect() if (r.model, r.lang, r.dll) == ("*", "*", "*")]
    assert total[0].records == 7 and total[0].total_tokens == sum(b + c for _, b, c in brute(ROWS).values())


def test_deltas_with_new_changed_removed_and_returned_records(spark, tmp_path):
    old_rows = ROWS[:5]
    new_rows = [ROWS[0], ROWS[1], (3, "A_B ", None, "pytorch", DE, "now there"), *ROWS[5:7]]  # 3 changed, 4 removed, 5 and 6 new
    state = updated(spark, old_rows)
    for rows in (new_rows, [], ROWS):
        state = tokens.load(spark, tokens.save(tokens.update(frame(spark, rows), state), str(tmp_path)))
        assert cells(state.cells) == brute(rows)
        assert len({bytes(r.hash) for r in state.counts.collect()}) == state.counts.count()


def test_new_texts_of_rows_without_id(spark):
    new_rows = [*ROWS, (None, "d", "en", "pytorch", "a text that stands nowhere else", "nor does this one"), (None, "d", "en", "pytorch", "a text that stands nowhere else", None)]
    assert cells(updated(spark, ROWS, new_rows).cells) == cells(updated(spark, new_rows).cells)


def test_filters_that_hold_everything_change_nothing(spark, monkeypatch):
    """A filter of too few bits skips unknown texts: the second pass encodes them."""
    monkeypatch.setattr(tokens, "LEAST_BITS", 3)
    monkeypatch.setattr(tokens, "MOST_BITS", 3)
    assert cells(updated(spark, ROWS[:3], ROWS).cells) == brute(ROWS)


def test_known_texts_are_not_encoded_again(spark):
    state = updated(spark, ROWS[:3])
    wrong = tokens.State(state.counts.selectExpr("tokenizer", "hash", "tokens + 1000 AS tokens"), tokens.empty_state(spark).facts, tokens.empty_state(spark).cells)
    again = tokens.update(frame(spark, ROWS[:3]), wrong)
    assert all(r.prompt_tokens >= 1000 for r in again.cells.collect())


def test_another_vocabulary_has_counts_of_its_own(spark, tmp_path):
    other = tmp_path / "byte_bpe_50k.tiktoken"  # the same name
    with open(BYTE_BPE_50K, "rb") as f:
        other.write_bytes(b"".join(f.readlines()[:256]))  # single bytes only
    state = tokens.update(frame(spark, ROWS), updated(spark, ROWS), vocabulary=str(other))
    assert state.counts.select("tokenizer").distinct().count() == 2
    fresh = tokens.update(frame(spark, ROWS), tokens.State(state.counts, *tokens.empty_state(spark)[1:]), vocabulary=str(other))
    assert sum(r.prompt_tokens for r in fresh.cells.collect()) == sum(len((r[4] or "").encode()) for r in [*{x for x in ROWS if x[0]}, ROWS[-1]])


def test_no_text_is_shuffled(spark):
    state = updated(spark, ROWS[:3])
    plan = tokens.update(frame(spark, ROWS), state).cells._jdf.queryExecution().executedPlan().toString()
    assert not any("Exchange" in line and ("prompt#" in line or "llm_response#" in line) for line in plan.split("\n"))


def test_empty(spark):
    state = updated(spark, [])
    assert all(df.count() == 0 for df in state)


def test_language():
    assert [prose.language(x) for x in (EN, DE, "请给出完整文件。", "Busca la capa que no es del tamaño correcto.", None, "", "x", "```python\nfor the of\n```")] == ["en", "de", "zh", "es", None, None, None, None]
