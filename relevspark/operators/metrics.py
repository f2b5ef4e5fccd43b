"""Ranking metrics as one relational plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relevspark.operators.ranking import rank

CUTS = (10, 50, 100)


def judged_ranks(run: DataFrame, qrels: DataFrame, tie: str = "asc") -> DataFrame:
    """``qid, did, rank, grade`` of the judged documents in a run, ranked over the whole run."""
    return rank(run.select("qid", "did", "score"), tie=tie).join(qrels.select("qid", "did", "grade"), ["qid", "did"])


def per_query(run: DataFrame, qrels: DataFrame, cuts=CUTS, recalls=None, successes=(1, 5, 10), tie: str = "asc") -> DataFrame:
    """One row of metrics per query that is in both the run and the judgements.

    nDCG with linear gain over log2(rank + 1); a document is relevant from grade 1 on; reciprocal rank and average precision over the
    full run.  Null grades count as not judged.  Queries without a relevant document score 0.
    """
    recalls = cuts if recalls is None else recalls
    qrels = qrels.where("grade is not null").select("qid", "did", "grade")
    ideal_rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("grade").desc(), F.col("did").asc()))
    gain = lambda r: F.greatest("grade", F.lit(0)) / F.log2(r + 1)
    best = qrels.withColumn("_r", ideal_rank)
    ideal = best.groupBy("qid").agg(
        F.sum((F.col("grade") >= 1).cast("bigint")).alias("n_relevant"),
        F.count(F.lit(1)).alias("n_judged"),
        *(F.sum(F.when(F.col("_r") <= k, gain(F.col("_r")))).alias(f"_i{k}") for k in cuts),
    )
    hits = judged_ranks(run, qrels, tie)
    nth = F.sum((F.col("grade") >= 1).cast("bigint")).over(Window.partitionBy("qid").orderBy("rank"))
    hits = hits.withColumn("_nth", nth)
    rel = F.col("grade") >= 1
    got = hits.groupBy("qid").agg(
        F.min(F.when(rel, F.col("rank"))).alias("best_rank"),
        F.sum(F.when(rel, F.col("_nth") / F.col("rank"))).alias("_ap"),
        *(F.sum(F.when(F.col("rank") <= k, gain(F.col("rank")))).alias(f"_d{k}") for k in cuts),
        *(F.sum((rel & (F.col("rank") <= k)).cast("bigint")).alias(f"_h{k}") for k in recalls),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    joined = run.select("qid").distinct().join(ideal, "qid").join(got, "qid", "left")
    return joined.select(
        "qid", "n_relevant", "n_judged", "best_rank",
        zero(1.0 / F.col("best_rank")).alias("mrr"),
        zero(F.try_divide(F.col("_ap"), F.col("n_relevant"))).alias("map"),
        *(zero(F.try_divide(F.col(f"_d{k}"), F.col(f"_i{k}"))).alias(f"ndcg_{k}") for k in cuts),
        *(zero(F.try_divide(F.col(f"_h{k}").cast("double"), F.col("n_relevant"))).alias(f"recall_{k}") for k in recalls),
        *(F.when(F.col("best_rank") <= k, 1.0).otherwise(0.0).alias(f"success_{k}") for k in successes),
    )


def long_form(metrics: DataFrame) -> DataFrame:
    """``qid, metric, value``."""
    names = [c for c, t in metrics.dtypes if t == "double"]
    pairs = F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names))
    return metrics.select("qid", F.explode(pairs).alias("p")).select("qid", "p.metric", "p.value")


def means(long: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean, median and population deviation of each metric, over all queries or by group."""
    return long.groupBy(*(by or []), "metric").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.median("value").alias("median"), F.stddev_pop("value").alias("std"))


def best_rank_histogram(metrics: DataFrame, thresholds=(1, 5, 10, 50, 100)) -> DataFrame:
    """For each threshold, the number of queries whose first relevant document ranks at least as high."""
    t = F.array(*(F.lit(x) for x in thresholds))
    return metrics.select("best_rank", F.explode(t).alias("threshold")).groupBy("threshold").agg(F.sum(F.coalesce((F.col("best_rank") <= F.col("threshold")).cast("bigint"), F.lit(0))).alias("n_queries"))


def mrr_at_grade(run: DataFrame, qrels: DataFrame, grade: int = 2) -> DataFrame:
    """``qid, mrr``: reciprocal rank of the first document of at least ``grade``, for queries that have one judged."""
    gold = qrels.where(F.col("grade") >= grade)
    first = judged_ranks(run, gold).groupBy("qid").agg(F.min("rank").alias("_r"))
    asked = gold.select("qid").distinct().join(run.select("qid").distinct(), "qid", "left_semi")
    return asked.join(first, "qid", "left").select("qid", F.coalesce(1.0 / F.col("_r"), F.lit(0.0)).alias("mrr"))


def upper_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The element at half the length of the sorted values (the upper of two middle ones)."""
    w = Window.partitionBy(*by)
    placed = df.withColumn("_r", F.row_number().over(w.orderBy(value))).withColumn("_n", F.count(F.lit(1)).over(w))
    return placed.where("_r = floor(_n / 2) + 1").select(*by, F.col(value).alias("upper_median"))
