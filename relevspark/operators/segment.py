"""Segmentation of transcripts and long texts into passages, with expressions only where they suffice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relevspark.functions import text as T

#: Titles by which a speaker who asks is known (prefixes, in lower case).
QUESTIONER_PREFIXES = ("senator", "chairman", "chairwoman", "chairperson", "the chairman", "the chairwoman", "the chair", "representative", "rep")


def is_questioner(speaker: str | Column) -> Column:
    low = F.lower(F.trim(T.col(speaker)))
    out = F.lit(False)
    for p in QUESTIONER_PREFIXES:
        out = out | F.startswith(low, F.lit(p))
    return F.coalesce(out, F.lit(False))


def exchanges(turns: DataFrame, doc: str = "doc_id", pos: str = "pos", speaker: str = "speaker") -> DataFrame:
    """``turns`` with ``exchange`` from 0: each questioner after the first opens a new one.

    In closed form the number is the count of questioners so far less one, and at least 0.
    """
    w = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.sum(is_questioner(speaker).cast("bigint")).over(w)
    return turns.withColumn("exchange", F.greatest(n - 1, F.lit(0).cast("bigint")))


def passage_type(n_turns: Column, n_words: Column) -> Column:
    """One long turn is an opening statement, one short turn procedural, anything else an exchange."""
    return F.when((n_turns == 1) & (n_words > 300), "opening_statement").when(n_turns == 1, "procedural").otherwise("qa_exchange")


def join_turns(exchanged: DataFrame, doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """``<doc>, exchange, n_turns, text``: turns of an exchange as ``speaker: text`` parted by blank lines."""
    turns = F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), F.concat(F.col("speaker"), F.lit(": "), F.col("text")).alias("t"))))
    return exchanged.groupBy(doc, "exchange").agg(turns.alias("_t")).select(doc, "exchange", F.size("_t").alias("n_turns"), F.array_join(F.transform("_t", lambda x: x["t"]), "\n\n").alias("text"))


def sentences(c: str | Column) -> Column:
    return F.filter(F.split(T.col(c), r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def pack_sentences(c: str | Column, most: int = 500) -> Column:
    """Sentences packed greedily into parts of at most ``most`` words; a longer sentence is a part of its own."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("cur"), F.lit(0).alias("n"))

    def step(acc, s):
        n = T.word_count(s)
        full = (acc["n"] > 0) & (acc["n"] + n > most)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(F.array_join(acc["cur"], " ")))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.array(s)).otherwise(F.concat(acc["cur"], F.array(s))).alias("cur"),
            F.when(full, n).otherwise(acc["n"] + n).alias("n"),
        )

    return F.aggregate(sentences(c), empty, step, lambda a: F.when(F.size(a["cur"]) > 0, F.concat(a["done"], F.array(F.array_join(a["cur"], " ")))).otherwise(a["done"]))


def split_passages(df: DataFrame, id_col: str, text_col: str, longer_than: int = 1000, most: int = 500) -> DataFrame:
    """``<id>, sub, text, word_count``: texts of more than ``longer_than`` words in parts, others whole (sub null); null texts give nothing."""
    parts = F.when(T.word_count(text_col) > longer_than, pack_sentences(text_col, most)).otherwise(F.array(F.col(text_col)))
    long = T.word_count(text_col) > longer_than
    out = df.where(F.col(text_col).isNotNull()).select(id_col, long.alias("_l"), F.posexplode(parts).alias("_p", "text"))
    return out.select(id_col, F.when(F.col("_l"), F.col("_p")).alias("sub"), "text", T.word_count("text").alias("word_count"))


def snippets(df: DataFrame, id_col: str, text_col: str, least: int = 200, most: int = 850, per_text: int = 2) -> DataFrame:
    """``<id>, nth, text``: paragraphs packed into pieces of ``least`` to ``most`` words, the first ``per_text`` of a text."""
    paragraphs = F.filter(F.split(T.col(text_col), r"\n\s*\n"), lambda p: F.trim(p) != "")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("cur"), F.lit(0).alias("n"))

    def step(acc, p):
        n = T.word_count(p)
        full = (acc["n"] > 0) & (acc["n"] + n > most)
        keep = full & acc["n"].between(least, most)
        return F.struct(F.when(keep, F.concat(acc["done"], F.array(F.array_join(acc["cur"], "\n\n")))).otherwise(acc["done"]).alias("done"), F.when(full, F.array(p)).otherwise(F.concat(acc["cur"], F.array(p))).alias("cur"), F.when(full, n).otherwise(acc["n"] + n).alias("n"))

    packed = F.aggregate(paragraphs, empty, step, lambda a: F.when((a["n"] >= least) & (a["n"] <= most), F.concat(a["done"], F.array(F.array_join(a["cur"], "\n\n")))).otherwise(a["done"]))
    return df.where(F.col(text_col).isNotNull()).select(id_col, F.posexplode(F.slice(packed, 1, per_text)).alias("nth", "text"))
