"""Plans are those that large tables need."""

from pyspark.sql import functions as F

from relevspark.operators import dense as D
from relevspark.operators import judgements as J
from relevspark.operators import ranking as R
from relevspark.plans import collection_queries as C
from relevspark.plans.tables import Tables

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(C.time_filter(Tables(spark, FOLDER)))
    assert "PushedFilters" in p and "LessThan(ts" in p
    assert "props" not in p
    p = plan(C.frequent_authors(Tables(spark, FOLDER)))
    assert "ReadSchema: struct<source:string>" in p


def test_ranking_is_pruned_before_the_shuffle(spark):
    run = spark.range(1000).select((F.col("id") % 7).alias("qid"), F.col("id").alias("did"), F.rand(1).alias("score"))
    assert "WindowGroupLimit" in plan(R.top_k(run, 5))
    assert "WindowGroupLimit" in plan(J.dedup(run, ["qid"], [F.col("score").desc()]))
    assert "WindowGroupLimit" in plan(R.stratified_sample(run, ["qid"], "did", 50))


def test_no_cartesian_product(spark):
    t = Tables(spark, FOLDER)
    assert "CartesianProduct" not in plan(D.dense_topk(t.vector_queries(), t.vectors(), 10))


def test_aggregates_combine_before_the_shuffle(spark):
    p = plan(C.term_frequencies(Tables(spark, FOLDER)))
    assert p.count("HashAggregate") >= 2 and "ArrowEvalPython" not in p and "MapInArrow" not in p
