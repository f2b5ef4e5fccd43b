"""Multi-hop retrieval for all queries at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relevspark.operators.ranking import top_k
from relevspark.runtime import cut


def multi_hop(
    queries: DataFrame,
    search: Callable[[DataFrame, DataFrame | None], DataFrame],
    select: Callable[[DataFrame, int], DataFrame],
    next_query: Callable[[DataFrame, DataFrame, int], DataFrame],
    original_scores: Callable[[DataFrame], DataFrame],
    hops: int = 4,
    per_hop: int = 25,
    excluded: DataFrame | None = None,
) -> DataFrame:
    """``qid, did, rank, hop, selected``: pool A (selected documents) before pool B (the rest), each by the score of the original query.

    Each hop searches with the current query states (``search`` gets the pairs that are barred, and may leave them in), keeps the ``per_hop`` best documents not seen before, and lets ``select`` mark some;
    ``next_query`` makes the states of the next hop.  ``excluded`` pairs count as seen from the start.  The documents of each hop are
    written to the checkpoint folder, so no hop is computed twice.
    """
    state, seen = queries, None
    barred = excluded.select("qid", "did").distinct() if excluded is not None else None
    for hop in range(1, hops + 1):
        known = [pairs.select("qid", "did") for pairs in (barred, seen) if pairs is not None]
        known = known[0].unionByName(known[1]) if len(known) == 2 else known[0] if known else None
        run = search(state, known)
        if known is not None:
            run = run.join(known, ["qid", "did"], "left_anti")
        found = cut(select(top_k(run.select("qid", "did", "score"), per_hop), hop).select("qid", "did", "score", "selected", F.lit(hop).alias("hop")))
        seen = found if seen is None else seen.unionByName(found)
        if hop < hops:
            state = next_query(state, found, hop)
    scored = seen.join(original_scores(seen.select("qid", "did")).withColumnRenamed("score", "_o"), ["qid", "did"], "left")
    w = Window.partitionBy("qid").orderBy(F.col("selected").desc(), F.col("_o").desc_nulls_last(), "did")
    return scored.select("qid", "did", F.row_number().over(w).cast("bigint").alias("rank"), "hop", "selected")
