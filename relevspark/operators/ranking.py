"""Ranking of runs: one total order, top-k, exclusions, ranks from positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Digits to which scores are rounded before they are compared, so that a last bit cannot reorder rows.
DIGITS = 6


def order(score: str = "score", did: str = "did", tie: str = "asc") -> list[Column]:
    """Higher scores first; ties by id, ascending, or descending as strings (``tie='trec'``)."""
    s = F.col(score).desc_nulls_last()
    return [s, F.col(did).cast("string").desc()] if tie == "trec" else [s, F.col(did).asc()]


def rank(run: DataFrame, by: str = "qid", tie: str = "asc") -> DataFrame:
    """``run`` with ``rank`` from 1 within each query."""
    return run.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order(tie=tie))).cast("bigint"))


def top_k(run: DataFrame, k: int, by: str = "qid", tie: str = "asc") -> DataFrame:
    """The first ``k`` documents of each query with their ranks (Spark prunes each partition before the shuffle)."""
    return rank(run, by, tie).where(F.col("rank") <= k)


def exclude(run: DataFrame, pairs: DataFrame) -> DataFrame:
    """``run`` without the (qid, did) in ``pairs``; applied before ranking, so that no over-fetch is needed."""
    return run.join(pairs.select("qid", "did").distinct(), ["qid", "did"], "left_anti")


def position_scores(ranked: DataFrame, candidates: DataFrame) -> DataFrame:
    """``qid, did, score`` from positions: a ranked list gets the highest scores, all other candidates follow in their own order.

    ``ranked`` has qid, did, rank; ``candidates`` qid, did, pos.  Scores fall by one from the number of candidates.
    """
    both = candidates.join(ranked.select("qid", "did", F.col("rank").alias("_r")), ["qid", "did"], "full")
    w = Window.partitionBy("qid")
    placed = both.withColumn("_n", F.row_number().over(w.orderBy(F.col("_r").asc_nulls_last(), F.col("pos").asc_nulls_last(), F.col("did").asc())))
    return placed.select("qid", "did", (F.count(F.lit(1)).over(w) - F.col("_n") + 1).cast("bigint").alias("score"))


def batches(df: DataFrame, n: int, by: list[str], orders: list[Column]) -> DataFrame:
    """``df`` with ``batch``: consecutive rows of each group in portions of ``n``."""
    pos = F.row_number().over(Window.partitionBy(*by).orderBy(*orders))
    return df.withColumn("batch", F.floor((pos - 1) / n).cast("bigint"))


def shuffle_key(*parts: str | Column, seed: int = 42) -> Column:
    """A seeded order that depends on the row alone, not on partitions: an MD5 over its parts."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts)))


def stratified_sample(df: DataFrame, strata: list[str], id_col: str, size: int, seed: int = 42) -> DataFrame:
    """About ``size`` rows, each stratum in proportion and with at least one row, in an order by hash.

    This is a sampling operator; the share of a stratum is rounded half to even.
    """
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_total"))
    quota = F.greatest(F.lit(1), F.bround(F.col("_n") / F.col("_total") * size, 0).cast("bigint"))
    quotas = sizes.crossJoin(F.broadcast(total)).select(*(F.col(c).alias(f"_s{i}") for i, c in enumerate(strata)), quota.alias("_quota"))
    order = F.row_number().over(Window.partitionBy(*strata).orderBy(shuffle_key(id_col, seed=seed), F.col(id_col)))
    # no quota exceeds ``size``, so every partition keeps at most so many rows of a stratum before the shuffle
    first = df.withColumn("_r", order).where(F.col("_r") <= max(1, size))
    same = [F.col(c).eqNullSafe(F.col(f"_s{i}")) for i, c in enumerate(strata)]
    return first.join(quotas, same).where("_r <= _quota").select(*df.columns)
