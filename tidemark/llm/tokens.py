"""Problem 8: token ids of the whole corpus."""

from __future__ import annotations

from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.bpe import replayer
from tidemark.llm.common import arrow_map
from tidemark.plans.registry import Registry, table
from tidemark.session import spread

query = Registry()

#: Where the public vocabularies lie; the file is read by the driver and reaches the executors as a broadcast.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def encode_texts(df: DataFrame, *, id_col: str = "doc_id", vocabulary: str = VOCABULARY, ids: bool = True) -> DataFrame:
    """``id_col`` and ``ids`` (array of int) of each row's ``text``, or with ``ids=False`` their number ``n_tokens``.

    Without special tokens: their strings in a text are ordinary text. Empty and null texts have an empty list.
    Every row comes out once, repeated ones too; a null id stays null; other columns are ignored; an empty table
    gives an empty result. White space, control characters and very long words are encoded like anything else.

    Scale: no shuffle. Each task replays the merges over the distinct words of its slice (the worker remembers
    up to ``bpe.REMEMBERED``), so a word is merged once and then looked up. The vocabulary, whose size is fixed by
    its file (under 1 MB), is broadcast.
    """
    raw = df.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        m, texts = replayer(raw.value), b.column(1).to_pylist()
        if ids:
            offsets, values = m.encode(texts)
            out = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
        else:
            out = pa.array(m.count(texts), pa.int64())
        return pa.RecordBatch.from_arrays([b.column(0), out], ["id", "out"])

    kind = dict(df.dtypes)[id_col]
    out = arrow_map(df.select(id_col, "text"), run, f"id {kind}, out {'array<int>' if ids else 'bigint'}")
    return out.toDF(id_col, "ids" if ids else "n_tokens")


def decode_ids(df: DataFrame, *, id_col: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """``id_col`` and the ``text`` that ``ids`` stand for, the inverse of ``encode_texts``; empty and null lists give an empty text."""
    raw = df.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        said = replayer(raw.value).bytes_of
        texts = [b"".join(map(said.__getitem__, ids or ())).decode("utf-8", "replace") for ids in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return arrow_map(df.select(id_col, "ids"), run, f"id {dict(df.dtypes)[id_col]}, text string").toDF(id_col, "text")


@query("p8_ids")
def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(spread(table(spark, sf_dir, "documents")))


@query("p8_text", "SELECT doc_id, coalesce(text, '') AS text FROM documents")
def p8_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of ``p8_ids``, decoded again."""
    return decode_ids(p8_ids(spark, sf_dir))
