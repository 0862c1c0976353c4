"""The transducer against the public libraries and exact round trips."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspark.llm.bpe import Utf8Machine, decode, transducer
from loomspark.llm.encode import BYTE_BPE_50K, decode_ids, encode_text

pytestmark = pytest.mark.skipif(not os.path.exists(BYTE_BPE_50K), reason="no vocabulary")


def library():
    import tiktoken

    from loomspark.llm.bpe import PATTERN

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=transducer(BYTE_BPE_50K).ranks, special_tokens={})


CASES = ["", " ", "\n\n  x", "a\r\nb", "don't", "<|endoftext|>", "日本語 中文🙂é", "a" * 3000, "\x1c \x85　x", "  lead", "trail  ", "1234567 12a", "​﻿", "ﬀ́"]


def test_cases_against_library():
    ours, theirs = transducer(BYTE_BPE_50K), library()
    for text in CASES:
        assert ours.encode(text) == theirs.encode_ordinary(text), text
        assert ours.count(text) == len(ours.encode(text))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=60))
def test_any_text_against_library(text):
    ours = transducer(BYTE_BPE_50K)
    ids = ours.encode(text)
    assert ids == library().encode_ordinary(text)
    tokens = {i: t for t, i in ours.ranks.items()}
    assert "".join(decode(ids, tokens)) == text


def test_states_are_bounded():
    from loomspark.llm.bpe import Transducer

    small = Transducer(transducer(BYTE_BPE_50K).ranks, max_states=50, max_words=5)
    text = "several different words of a sentence, again and again: " * 3
    assert small.encode(text) == library().encode_ordinary(text)
    assert len(small.words) <= 5
    import random

    rng = random.Random(2)
    word = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(4000))  # one pre-token of many states
    assert small.encode(word) == library().encode_ordinary(word) and len(small.key) <= 52


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.lists(st.integers(0, 40), max_size=4))
def test_utf8_machine_in_any_pieces(data, cuts):
    machine, out, last = Utf8Machine(), "", 0
    for c in [*sorted(min(x, len(data)) for x in cuts), len(data)]:
        out += machine.feed(data[last:c])
        last = c
    assert out + machine.end() == data.decode("utf-8", "replace")


def test_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "hello world", "x"), (3, "hello world", "y"), (4, "z" * 200_000, "x")], "doc_id long, text string, ids string")
    got = encode_text(df).collect()
    by = {r.doc_id: r.ids for r in got}
    assert len(got) == 5 and by[1] == [] and by[2] == [] and by[3] == library().encode_ordinary("hello world")
    back = {r.doc_id: r.text for r in decode_ids(encode_text(df)).collect()}
    assert back[1] == "" and back[4] == "z" * 200_000
    assert encode_text(df.where("false")).count() == 0
