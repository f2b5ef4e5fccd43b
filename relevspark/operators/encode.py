"""Encoding of texts to vectors with any model, cached by text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relevspark.functions import text as T

#: ``encode(texts, task)`` gives one vector a text; ``task`` is ``document`` or ``query``.
Encode = Callable[[list[str], str], np.ndarray]


def instruction(query_col: str, task: str | None):
    """Queries with an instruction before them, or as they are."""
    return T.instruct(query_col, task) if task else F.col(query_col)


def encode(df: DataFrame, id_col: str, text_col: str, encoder: Encode, task: str = "document", batch: int = 64) -> DataFrame:
    """``<id>, vec`` in batches; a null text is encoded as an empty one."""
    key = df.schema[id_col].dataType.simpleString()

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts = pdf["text"].fillna("").tolist()
            vecs = [v.astype(np.float32).tolist() for at in range(0, len(texts), batch) for v in np.asarray(encoder(texts[at : at + batch], task))]
            yield pd.DataFrame({"id": pdf["id"], "vec": vecs})

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(work, f"id {key}, vec array<float>").withColumnRenamed("id", id_col)


def encode_cached(df: DataFrame, id_col: str, text_col: str, encoder: Encode, path: str, task: str = "document", batch: int = 64) -> DataFrame:
    """The same with vectors kept at ``path`` under a hash of text and task; only texts that are not there are encoded, each once."""
    from relevspark.streaming.resume import append, read_or_none, todo

    spark = df.sparkSession
    hashed = df.select(id_col, F.sha2(F.concat(F.lit(f"{task}\n"), F.coalesce(text_col, F.lit(""))), 256).alias("h"), F.coalesce(text_col, F.lit("")).alias("text"))
    fresh = todo(hashed.select("h", "text").dropDuplicates(["h"]), read_or_none(spark, path), ["h"])
    append(encode(fresh, "h", "text", encoder, task, batch), path)
    kept = spark.read.schema("h string, vec array<float>").parquet(path).dropDuplicates(["h"])
    return hashed.join(kept, "h").select(id_col, "vec")


def token_vectors(df: DataFrame, id_col: str, text_col: str, encoder: Callable[[str], np.ndarray], most: int | None = None) -> DataFrame:
    """``<id>, tok, vec``, one row a token, for late interaction; ``most`` is the model's own limit of tokens."""
    key = df.schema[id_col].dataType.simpleString()

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(i, k, v.astype(np.float32).tolist()) for i, t in zip(pdf["id"], pdf["text"].fillna("")) for k, v in enumerate(np.asarray(encoder(t))[:most])]
            yield pd.DataFrame(rows, columns=["id", "tok", "vec"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(work, f"id {key}, tok int, vec array<float>").withColumnRenamed("id", id_col)
