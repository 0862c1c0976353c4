"""Problem 6: encoding a corpus with a public tokenizer."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabularies; a parameter of every operator that needs one.
TOKENIZERS = os.environ.get("LOOMSPARK_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE_50K = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"


def encode_text(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = BYTE_BPE_50K, ids: str = "ids") -> DataFrame:
    """(key, ids array<int>): one row for each row of df, no special tokens; their strings are plain text.

    Null and empty text give the empty list, never null. Rows with equal keys or texts each give their own row, an
    empty table gives no rows, other columns are not read. A text of any length is read whole, in one pass.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from loomspark.llm.bpe import transducer

        encode = transducer(vocabulary).encode
        for batch in batches:
            keys = batch.column(0)
            offsets, values = [0], []
            for value in batch.column(1).to_pylist():
                values += encode(value)
                offsets.append(len(values))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([keys, lists], names=[key, ids])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, `{ids}` array<int>")


def decode_ids(df: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = BYTE_BPE_50K, text: str = "text") -> DataFrame:
    """(key, text): the text of a list of ids through the incremental UTF-8 machine; null ids give null."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from loomspark.llm.bpe import Utf8Machine, transducer

        tokens = {i: t for t, i in transducer(vocabulary).ranks.items()}

        def read(x: list[int]) -> str:
            machine = Utf8Machine()
            return "".join([machine.feed(b"".join([tokens[i] for i in x[at : at + 1024]])) for at in range(0, len(x), 1024)]) + machine.end()

        for batch in batches:
            texts = [None if x is None else read(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, text])

    return df.select(F.col(key), F.col(ids)).mapInArrow(run, f"`{key}` {kind}, `{text}` string")
