"""Reading of conversation columns in Arrow batches, and the parties of a conversation."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

# How roles are spelled.
USER = {"user", "human", "prompter"}
ASSISTANT = {"assistant", "gpt", "model", "bot"}


def party(role: str | None) -> str | None:
    """``user``, ``assistant`` or None (neither), spelling aside."""
    r = (role or "").strip().lower()
    return "user" if r in USER else "assistant" if r in ASSISTANT else None


def parts(column: pa.Array) -> tuple[list[int], list[int], list, list]:
    """Starts and ends per row, then roles and contents of all messages of an ``array<struct<role, content>>`` column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_pylist()
    values = column.values
    roles, contents = (pc.struct_field(values, n).to_pylist() for n in ("role", "content"))
    nulls = column.is_null().to_pylist()
    starts = offsets[:-1]
    ends = [a if n else b for a, b, n in zip(starts, offsets[1:], nulls)]
    return starts, ends, roles, contents


def whole_text(conversation="conversation"):
    """All contents of a conversation in order as one text, null as empty, each from a new line."""
    return F.array_join(F.transform(F.col(conversation), lambda m: F.coalesce(m["content"], F.lit(""))), "\n")


def records(documents, conversations):
    """``(tbl, rec_id, text)`` of both tables; a null or empty conversation is an empty text."""
    d = documents.select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("rec_id"), F.col("text"))
    w = conversations.select(F.lit("wild_conversations").alias("tbl"), F.col("row_id").alias("rec_id"), F.coalesce(whole_text(), F.lit("")).alias("text"))
    return d.unionAll(w)
