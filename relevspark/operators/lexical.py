"""BM25 as relational plans over tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relevspark.functions import text as T
from relevspark.operators.ranking import DIGITS


def tokens(df: DataFrame, id_col: str, text_col: str, out_id: str, tokenizer=T.tokenize_ascii) -> DataFrame:
    """``<out_id>, tokens`` of the rows with an id; a null text has no tokens."""
    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias(out_id), tokenizer(F.coalesce(F.col(text_col), F.lit(""))).alias("tokens"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: number of documents and mean length of ``did, tokens``."""
    return docs.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))


def document_frequency(docs: DataFrame) -> DataFrame:
    """``term, df`` over all documents, counted once a document before any shuffle."""
    return docs.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))


def _postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``did, dl, term, tf`` of the query terms alone; a document's terms are counted where it is read."""
    seen = docs.select("did", F.size("tokens").cast("double").alias("dl"), F.explode("tokens").alias("term"))
    return seen.join(terms, "term", "left_semi").groupBy("did", "dl", "term").agg(F.count(F.lit(1)).cast("double").alias("tf"))


def bm25(queries: DataFrame, docs: DataFrame, flavor: str = "lucene", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``qid, did, score`` of all documents that share a term with a query.

    ``queries`` are ``qid, tokens``, ``docs`` are ``did, tokens``; a term that a query repeats counts each time.  ``lucene``: idf = ln(1 + (n - df + .5) / (df + .5)), weight
    tf / (tf + k1 (1 - b + b dl / avgdl)).  ``okapi``: idf = ln(n - df + .5) - ln(df + .5), a negative one replaced by a quarter of the mean idf of all terms, weight times k1 + 1.
    """
    wanted = queries.select("qid", F.explode("tokens").alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).cast("double").alias("qtf"))
    terms = wanted.select("term").distinct()
    stats = corpus_stats(docs)
    postings = _postings(docs, terms)
    if flavor == "okapi":
        df = document_frequency(docs)  # of all terms, as the mean of their weights is needed
        idf = df.crossJoin(F.broadcast(stats.select("n"))).select("term", (F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("idf"))
        idf = idf.crossJoin(F.broadcast(idf.agg(F.avg("idf").alias("_mean")))).select("term", F.when(F.col("idf") < 0, 0.25 * F.col("_mean")).otherwise(F.col("idf")).alias("idf"))
    else:
        # of the queries' terms alone, from the same exchange as their hits
        df = postings.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))
        idf = df.crossJoin(F.broadcast(stats.select("n"))).select("term", F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weights = wanted.join(idf, "term").select("qid", "term", (F.col("qtf") * F.col("idf")).alias("w"))
    hits = postings.crossJoin(F.broadcast(stats.select("avgdl")))
    part = F.col("tf") * (k1 + 1 if flavor == "okapi" else 1.0) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = hits.join(weights, "term").groupBy("qid", "did").agg(F.sum(F.col("w") * part).alias("score"))
    return scored.select("qid", "did", F.round("score", DIGITS).alias("score"))


def build_index(docs: DataFrame, path: str, fingerprint: str) -> dict[str, DataFrame]:
    """The stored index of ``did, tokens`` under ``path``: postings in the order of terms (so that a scan for some terms skips most files), and one row of statistics.

    An index of the same fingerprint is read, not built again.
    """
    from relevspark.streaming.resume import stage

    spark = docs.sparkSession

    def postings() -> DataFrame:
        tf = docs.select("did", F.size("tokens").cast("double").alias("dl"), F.explode("tokens").alias("term")).groupBy("did", "dl", "term").agg(F.count(F.lit(1)).cast("double").alias("tf"))
        return tf.repartitionByRange("term", "did").sortWithinPartitions("term", "did")

    return {"postings": stage(spark, f"{path}/postings", postings, fingerprint), "stats": stage(spark, f"{path}/stats", lambda: corpus_stats(docs), fingerprint)}


def bm25_indexed(queries: DataFrame, index: dict[str, DataFrame], k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """The lucene flavor of ``bm25`` from a stored index; no text is read."""
    wanted = queries.select("qid", F.explode("tokens").alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).cast("double").alias("qtf"))
    postings = index["postings"].join(wanted.select("term").distinct(), "term", "left_semi")
    df = postings.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    stats = F.broadcast(index["stats"])
    weights = wanted.join(df, "term").crossJoin(stats.select("n")).select("qid", "term", (F.col("qtf") * F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("w"))
    part = F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = postings.crossJoin(stats.select("avgdl")).join(weights, "term").groupBy("qid", "did").agg(F.sum(F.col("w") * part).alias("score"))
    return scored.select("qid", "did", F.round("score", DIGITS).alias("score"))
