"""Fusion of runs into pools of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relevspark.operators.ranking import top_k


def stack(runs: dict[str, DataFrame], depth: dict[str, int] | int) -> DataFrame:
    """``system, prio, qid, did, score, rank`` of the top of each run; ``prio`` follows the order of ``runs``."""
    out = None
    for prio, (name, run) in enumerate(runs.items()):
        k = depth if isinstance(depth, int) else depth[name]
        part = top_k(run.select("qid", "did", "score"), k).select(F.lit(name).alias("system"), F.lit(prio).alias("prio"), "qid", "did", "score", "rank")
        out = part if out is None else out.unionByName(part)
    return out


def union_candidates(stacked: DataFrame) -> DataFrame:
    """``qid, did, pos, scores``: candidates in the order of their first occurrence, with a map of scores by system."""
    merged = stacked.groupBy("qid", "did").agg(F.min(F.struct("prio", "rank")).alias("_f"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("system", "score")))).alias("scores"))
    pos = F.row_number().over(Window.partitionBy("qid").orderBy("_f", "did")).cast("bigint")
    return merged.withColumn("pos", pos).select("qid", "did", "pos", "scores")


def first_scores(stacked: DataFrame) -> DataFrame:
    """``qid, did, score`` with the score of the first system that has the pair."""
    return stacked.groupBy("qid", "did").agg(F.min_by("score", F.struct("prio", "rank")).alias("score"))


def inject(candidates: DataFrame, qrels: DataFrame, gold_first_removed: bool = False) -> DataFrame:
    """``qid, did, pos, injected``: judged documents that are missing are appended in order of id.

    With ``gold_first_removed`` all judged documents leave the pool before, so each of them counts as injected.
    """
    gold = qrels.select("qid", "did").distinct()
    pool = candidates.select("qid", "did", "pos")
    if gold_first_removed:
        pool = pool.join(gold, ["qid", "did"], "left_anti")
    missing = gold.join(candidates.select("qid").distinct(), "qid", "left_semi").join(pool.select("qid", "did"), ["qid", "did"], "left_anti")
    both = pool.withColumn("injected", F.lit(False)).unionByName(missing.select("qid", "did", F.lit(1 << 40).cast("bigint").alias("pos"), F.lit(True).alias("injected")))
    return both.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("pos", "did")).cast("bigint"))


def pool(runs: DataFrame, k: int) -> DataFrame:
    """Distinct (qid, did) within the first ``k`` ranks of any run."""
    return runs.where(F.col("rank") <= k).select("qid", "did").distinct()


def unjudged(pooled: DataFrame, qrels: DataFrame) -> DataFrame:
    return pooled.join(qrels.select("qid", "did").distinct(), ["qid", "did"], "left_anti")
