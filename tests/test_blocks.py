"""Dense search in blocks, batched model calls, reranking of a selection, block lists and moved keys on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from relevspark.operators import annotate as N
from relevspark.operators import dense as D
from relevspark.operators import judgements as J
from relevspark.operators.tournament import by_column, rerank_selected
from relevspark.plans import build as B
from relevspark.streaming.resume import migrate_keys


def vectors(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} string, vec array<float>, label string, score double")


def test_dense_ties_nulls_and_bars(spark):
    q = vectors(spark, [("q1", [1.0, 0.0], "a", 0.0), ("q2", [0.0, 2.0], None, 0.0)], "qid")
    d = vectors(spark, [("d3", [2.0, 0.0], "a", 1.0), ("d1", [1.0, 0.0], "b", 1.0), ("d2", [5.0, 0.0], "b", 1.0), ("d4", None, "c", 1.0), ("d5", [0.0, 1.0], None, 1.0)], "did")
    for block in (1, 256):
        got = [(r.qid, r.did, r.score, r["rank"]) for r in D.dense_topk(q, d, 3, block=block).orderBy("qid", "rank").collect()]
        assert got[:3] == [("q1", "d1", 1.0, 1), ("q1", "d2", 1.0, 2), ("q1", "d3", 1.0, 3)] and got[3] == ("q2", "d5", 1.0, 1)
    barred = spark.createDataFrame([("q1", "d1"), ("q1", "d1"), ("q9", "d2")], "qid string, did string")
    assert [r.did for r in D.dense_topk(q, d, 2, barred).where("qid = 'q1'").orderBy("rank").collect()] == ["d2", "d3"]
    assert [r.did for r in D.dense_topk(q, d, 2, unlike="label").where("qid = 'q1'").orderBy("rank").collect()] == ["d1", "d2"]
    assert "d5" not in {r.did for r in D.dense_topk(q, d, 9, unlike="label").where("qid = 'q2'").collect()}
    assert D.dense_topk(q, d.limit(0), 3).count() == 0 and D.dense_topk(q.limit(0), d, 3).count() == 0


def test_maxsim_topk_is_the_top_of_all(spark):
    t = spark.createDataFrame([(k // 3, k % 3, [float(k % 5), 1.0, float(k % 7)]) for k in range(60)], "did bigint, dtok bigint, vec array<float>")
    q = t.where("did < 4").select(F.col("did").alias("qid"), F.col("dtok").alias("qtok"), "vec")
    every = {(r.qid, r.did): r.score for r in D.maxsim(q, t).collect()}
    assert len(every) == 80
    for r in D.maxsim_topk(q, t, 5).collect():
        order = sorted((k for k in every if k[0] == r.qid), key=lambda k: (-every[k], k[1]))
        assert order[r["rank"] - 1] == (r.qid, r.did) and every[r.qid, r.did] == r.score


def test_batches_keep_their_own_keys(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"text {k}") for k in range(20)] + [(None, "x"), (99, None)], "k bigint, t string").coalesce(1)

    def client(prompt):
        lines = [x for x in prompt.split("\n")[1:]]
        if len(lines) > 1 and "text 3" in prompt.split("\n"):
            raise TimeoutError
        return json.dumps([{"n": int(x[1 : x.index("]")]), "said": x.split("] ", 1)[1], "id": "echo"} for x in reversed(lines) if "text 7" not in x or len(lines) == 1] + [{"n": 77, "said": "no such row"}])

    got = {r.k: (r.reply, r.status) for r in N.ask_batched(rows, "k", "t", client, 5, "go", 1, 0.0).collect()}
    assert len(got) == 22 and got[7] == (None, "missing") and json.loads(got[8][0]) == {"said": "text 8", "id": "echo"} and got[99][1] == "ok"
    for n in (5, 1):
        told = N.sweep(rows.where("k is not null"), "k", "t", client, str(tmp_path / "log"), "said string", n, "go", 1, 0.0)
    assert {r.k: r.parsed.said for r in told.collect()} == {k: f"text {k}" for k in range(20)} | {99: ""}
    assert N.ask_batched(rows.limit(0), "k", "t", client).count() == 0


def test_selected_first(spark):
    ranked = spark.createDataFrame([("q", k, k, k % 2 == 0, -k) for k in range(1, 7)], "qid string, did bigint, rank bigint, selected boolean, taste bigint")
    assert [r.did for r in rerank_selected(ranked, by_column("taste")).orderBy("rank").collect()] == [6, 4, 2, 1, 3, 5]


def test_block_list(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Ann  Lee", ["Bo"]), (2, "x", ["ann lee "]), (3, None, None), (4, "y", ["z", None])], "id int, author string, coauthors array<string>")
    names = spark.createDataFrame([("ANN LEE",)], "name string")
    assert sorted(r.id for r in J.blocked(docs, ["author", "coauthors"], names).collect()) == [3, 4]
    assert J.blocked(docs, ["author"], names.limit(0)).count() == 4
    monkeypatch.setattr(J, "MOST_NAMES", 0)
    with pytest.raises(ValueError):
        J.blocked(docs, ["author"], names)


def test_moved_keys(spark):
    log = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "key string, v int")
    names = spark.createDataFrame([("a", "x"), ("b", "c")], "old string, new string")
    assert sorted(map(tuple, migrate_keys(log, names, "key").collect())) == [("c", 3), ("x", 1)]


def test_guided_hops(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red apple"), (2, "apple pie harbor"), (3, "harbor boat"), (4, "boat sail"), (5, None)], "did bigint, text string")
    queries = spark.createDataFrame([("q", "apple"), ("n", None)], "qid string, query_text string")

    def client(prompt):
        if prompt.startswith("Select"):
            return '{"ids": [1], "notes": "harbor"}' if "apple pie" in prompt else "no list"
        return "harbor boat"

    got = B.guided_hops(queries, docs, client, str(tmp_path / "c"), hops=2, per_hop=3).where("qid = 'q'").orderBy("rank").collect()
    assert {(r.did, r.hop) for r in got} == {(1, 1), (2, 1), (3, 2), (4, 2)}
    assert {r.did for r in got if r.selected} == {1, 3, 4} and [r.selected for r in got] == [True, True, True, False]
