"""Listwise tournaments over all queries at once.

A level deals each query's pool into batches, sorts every batch with a comparator, sends the best of each batch on and lays the rest
aside.  The final order is one sort: the last pool first, then the rests from the deepest level up, by place in the batch, then by batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relevspark.operators.ranking import shuffle_key
from relevspark.runtime import cut

#: A comparator gets rows with qid, depth, batch, did and more, and adds ``place`` from 1 within (qid, batch).
Comparator = Callable[[DataFrame], DataFrame]


def by_column(*orders) -> Comparator:
    """A comparator that sorts by columns (a window; nothing leaves the JVM)."""
    return lambda df: df.withColumn("place", F.row_number().over(Window.partitionBy("qid", "batch").orderBy(*orders)))


def by_function(sort: Callable[[str, list[str]], list[int]], schema: str) -> Comparator:
    """A comparator that asks ``sort(qid, dids)`` for numbers from 1; unknown and repeated numbers are dropped, missing ones follow.

    A batch is at most a few dozen rows, so each group fits a task.
    """

    def compare(df: DataFrame) -> DataFrame:
        def one(key, pdf):
            pdf = pdf.sort_values("deal").reset_index(drop=True)
            seen = []
            for n in sort(key[0], pdf["did"].tolist()):
                if 1 <= n <= len(pdf) and n not in seen:
                    seen.append(n)
            seen += [n for n in range(1, len(pdf) + 1) if n not in seen]
            pdf["place"] = [seen.index(i + 1) + 1 for i in range(len(pdf))]
            return pdf

        return df.groupBy("qid", "batch").applyInPandas(one, schema)

    return compare


def _level(pool: DataFrame, compare: Comparator, depth: int, size: int, shuffle: bool, seed: int) -> DataFrame:
    """``pool`` with depth, batch and place."""
    deal = shuffle_key("qid", "did", F.lit(depth), seed=seed) if shuffle else F.lit("")
    dealt = pool.withColumn("deal", F.row_number().over(Window.partitionBy("qid").orderBy(deal, "did")).cast("bigint"))
    dealt = dealt.withColumn("batch", F.floor((F.col("deal") - 1) / size).cast("bigint")).withColumn("depth", F.lit(depth))
    return compare(dealt)


def tournament(candidates: DataFrame, compare: Comparator, batch: int = 20, keep: int = 4, max_final: int | None = 20, shuffle: bool = True, seed: int = 42) -> DataFrame:
    """``qid, did, rank`` of all candidates ``qid, did, ...``.

    ``max_final`` None is the single-level form: one level unless a query's pool fits a batch, then one final sort of any size.  Null ids are dropped; repeated
    candidates count once (then one of the rows holds).
    """
    if not 0 < keep < batch:
        raise ValueError("keep must be less than batch, else the pools never shrink")
    columns = [c for c in candidates.columns if c not in ("deal", "batch", "depth", "place")]
    pool = candidates.select(*columns).where("qid is not null and did is not null").dropDuplicates(["qid", "did"])
    limit = batch if max_final is None else max_final
    size = Window.partitionBy("qid")
    done, depth = [], 0
    pool = cut(pool)
    while True:
        counted = pool.withColumn("_n", F.count(F.lit(1)).over(size))
        small = counted.where(F.col("_n") <= limit).drop("_n")
        big = counted.where(F.col("_n") > limit).drop("_n")
        last = max_final is None and depth > 0
        final = pool if last else small
        sorted_ = _level(final, compare, depth, 1 << 40, shuffle, seed)
        done.append(sorted_.select("qid", "did", F.lit(1).alias("is_final"), "depth", F.col("place").cast("bigint").alias("place"), F.lit(0).cast("bigint").alias("batch")))
        if last or not big.limit(1).count():
            break
        level = cut(_level(big, compare, depth, batch, shuffle, seed))
        tail = level.where(F.col("place") > keep)
        done.append(tail.select("qid", "did", F.lit(0).alias("is_final"), "depth", F.col("place").cast("bigint").alias("place"), "batch"))
        pool = level.where(F.col("place") <= keep).select(*columns)
        depth += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    w = Window.partitionBy("qid").orderBy(F.col("is_final").desc(), F.col("depth").desc(), "place", "batch", "did")
    return out.select("qid", "did", F.row_number().over(w).cast("bigint").alias("rank"))


def rerank_selected(ranked: DataFrame, compare: Comparator) -> DataFrame:
    """``qid, did, rank``: the ``selected`` documents of ``qid, did, rank, selected, ...`` in the order of one listwise comparison, then the others as they were."""
    first = compare(ranked.where("selected").withColumn("deal", F.col("rank")).withColumn("batch", F.lit(0).cast("bigint")).withColumn("depth", F.lit(0)))
    both = first.select("qid", "did", F.lit(0).alias("_s"), F.col("place").cast("bigint").alias("_p")).unionByName(ranked.where("not selected").select("qid", "did", F.lit(1).alias("_s"), F.col("rank").alias("_p")))
    return both.select("qid", "did", F.row_number().over(Window.partitionBy("qid").orderBy("_s", "_p", "did")).cast("bigint").alias("rank"))
