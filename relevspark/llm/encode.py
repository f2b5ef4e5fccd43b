"""Encoding of a corpus with a public tokenizer (operator on DataFrames)."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relevspark.llm import bpe


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = bpe.DEFAULT_FOLDER) -> DataFrame:
    """One row ``(id, ids array<int>)`` per row of ``df``, without special tokens.

    Null and empty texts give the empty list; a null id stays null; repeated rows give repeated rows; other
    columns are not read.  A narrow map: no shuffle, each text is encoded whole where it is read.
    """
    path = os.path.join(folder, f"{tokenizer}.json")
    kind = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_text = bpe.encoder(path).encode
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                ids = [encode_text(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, kind)], names=["id", "ids"])

    key = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {key}, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def decode(ids: list[int], tokenizer: str = "byte_bpe_50k", folder: str = bpe.DEFAULT_FOLDER) -> str:
    """The text of a list of ids."""
    v = bpe.encoder(os.path.join(folder, f"{tokenizer}.json")).vocabulary
    back = {i: t for t, i in v.id_of.items()}
    return b"".join(back[i] for i in ids).decode("utf-8", "replace")
