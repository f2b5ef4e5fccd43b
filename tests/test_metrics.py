"""Metrics against hand-worked values and a plain implementation."""

import math
import random

import pytest
from pyspark.sql import functions as F

from relevspark.operators import metrics as M
from relevspark.operators import ranking as R

QRELS = [("q1", "d1", 2), ("q1", "d2", 1), ("q1", "d3", 0), ("q2", "d4", 1), ("q2", "d5", 1), ("q3", "d9", 1)]
RUN = [("q1", "d2", 0.9), ("q1", "d7", 0.8), ("q1", "d1", 0.7), ("q1", "d3", 0.6), ("q2", "d8", 0.9), ("q2", "d4", 0.5), ("q2", "d5", 0.5)]


def frames(spark, run, qrels):
    return spark.createDataFrame(run, "qid string, did string, score double"), spark.createDataFrame(qrels, "qid string, did string, grade int")


def test_hand_worked(spark):
    run, qrels = frames(spark, RUN, QRELS)
    m = {r.qid: r for r in M.per_query(run, qrels, cuts=(2, 10)).collect()}
    assert set(m) == {"q1", "q2"}
    assert m["q1"].ndcg_10 == pytest.approx(0.760188, abs=1e-6) and m["q1"].recall_2 == 0.5 and m["q1"].mrr == 1 and m["q1"].map == pytest.approx(0.833333, abs=1e-6) and m["q1"].success_1 == 1 and m["q1"].best_rank == 1
    assert m["q2"].ndcg_10 == pytest.approx(0.693426, abs=1e-6) and m["q2"].recall_2 == 0.5 and m["q2"].mrr == 0.5 and m["q2"].map == pytest.approx(0.583333, abs=1e-6) and m["q2"].success_1 == 0 and m["q2"].success_5 == 1
    means = {r.metric: r.mean for r in M.means(M.long_form(M.per_query(run, qrels, cuts=(10,)))).collect()}
    assert means["ndcg_10"] == pytest.approx(0.726807, abs=1e-6) and means["mrr"] == 0.75 and means["map"] == pytest.approx(0.708333, abs=1e-6)
    two = {r.qid: r.mrr for r in M.mrr_at_grade(run, qrels, 2).collect()}
    assert two == {"q1": pytest.approx(1 / 3)}
    h = {r.threshold: r.n_queries for r in M.best_rank_histogram(M.per_query(run, qrels, cuts=(10,))).collect()}
    assert h == {1: 1, 5: 2, 10: 2, 50: 2, 100: 2}


def brute(run, qrels, k):
    out = {}
    for q in {r[0] for r in run} & {r[0] for r in qrels}:
        rel = {d: g for x, d, g in qrels if x == q}
        order = [d for _, d, _ in sorted((r for r in run if r[0] == q), key=lambda r: (-r[2], r[1]))]
        dcg = sum(rel.get(d, 0) / math.log2(i + 2) for i, d in enumerate(order[:k]))
        ideal = sum(g / math.log2(i + 2) for i, g in enumerate(sorted(rel.values(), reverse=True)[:k]))
        good = [i + 1 for i, d in enumerate(order) if rel.get(d, 0) >= 1]
        n = sum(g >= 1 for g in rel.values())
        out[q] = (dcg / ideal if ideal else 0.0, sum(i <= k for i in good) / n if n else 0.0, 1 / good[0] if good else 0.0, sum((j + 1) / i for j, i in enumerate(good)) / n if n else 0.0)
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    run = [(f"q{q}", f"d{d}", round(rng.random(), 1)) for q in range(15) for d in rng.sample(range(60), rng.randint(1, 40))]
    qrels = [(f"q{q}", f"d{d}", rng.randint(0, 2)) for q in range(3, 18) for d in rng.sample(range(60), rng.randint(1, 12))]
    got = {r.qid: (r.ndcg_10, r.recall_10, r.mrr, r.map) for r in M.per_query(*frames(spark, run, qrels), cuts=(10,)).collect()}
    want = brute(run, qrels, 10)
    assert set(got) == set(want)
    for q in want:
        assert got[q] == pytest.approx(want[q], abs=1e-9)
        assert all(0 <= x <= 1 for x in got[q])


def test_perfect_run_and_ties(spark):
    perfect = [(q, d, float(g)) for q, d, g in QRELS]
    m = M.per_query(*frames(spark, perfect, QRELS), cuts=(10,)).collect()
    assert all(r.ndcg_10 == 1 for r in m)
    run, qrels = frames(spark, RUN, QRELS)
    trec = {r.did: r.rank for r in R.rank(run, tie="trec").where("qid = 'q2'").collect()}
    assert trec == {"d8": 1, "d5": 2, "d4": 3}


def test_nulls_and_empty(spark):
    run, qrels = frames(spark, [("q1", "d1", None), ("q1", "d2", 0.5)], [("q1", "d1", 1), ("q1", "d2", None)])
    (m,) = M.per_query(run, qrels, cuts=(10,)).collect()
    assert m.best_rank == 2 and m.n_judged == 1
    assert M.per_query(run.limit(0), qrels, cuts=(10,)).count() == 0


def test_upper_median(spark):
    df = spark.createDataFrame([("a", x) for x in (4, 1, 3, 2)] + [("b", 7)], "k string, v int")
    assert {r.k: r.upper_median for r in M.upper_median(df, ["k"], "v").collect()} == {"a": 3, "b": 7}


def test_position_scores(spark):
    cand = spark.createDataFrame([("q", d, i) for i, d in enumerate("abdec")], "qid string, did string, pos int")
    ranked = spark.createDataFrame([("q", "d", 1), ("q", "a", 2)], "qid string, did string, rank int")
    assert {r.did: r.score for r in R.position_scores(ranked, cand).collect()} == {"d": 5, "a": 4, "b": 3, "e": 2, "c": 1}


def test_stratified_sample(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 900, "a").when(F.col("id") < 990, "b").otherwise("c").alias("s"))
    n = {r.s: r["count"] for r in R.stratified_sample(df, ["s"], "id", 100).groupBy("s").count().collect()}
    assert n == {"a": 90, "b": 9, "c": 1}
    once = {r.id for r in R.stratified_sample(df, ["s"], "id", 100).collect()}
    assert once == {r.id for r in R.stratified_sample(df.repartition(7), ["s"], "id", 100).collect()}
