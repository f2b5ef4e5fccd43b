import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from relevspark.functions import vector as V
from relevspark.operators import dense as D
from relevspark.operators import fuse as U
from relevspark.operators import judgements as J
from relevspark.operators import lexical as L
from relevspark.operators import ranking as R
from relevspark.operators.hops import multi_hop
from relevspark.operators.tournament import by_column, by_function, tournament


def test_bm25_hand_worked(spark):
    docs = spark.createDataFrame([("d1", "the cat sat"), ("d2", "cat cat dog"), ("d3", "dog ran far away"), ("d4x", None)], "did string, text string").where("did <> 'd4x'")
    q = spark.createDataFrame([("q", ["cat", "dog", "cat"])], "qid string, tokens array<string>")
    d = docs.select("did", F.split("text", " ").alias("tokens"))
    okapi = {r.did: r.score for r in L.bm25(q, d, "okapi").collect()}
    assert okapi == {"d1": pytest.approx(0.114621, abs=1e-6), "d2": pytest.approx(0.218879, abs=1e-6), "d3": pytest.approx(0.050212, abs=1e-6)}
    lucene = {r.did: r.score for r in L.bm25(q, d, "lucene").collect()}
    assert lucene == {"d1": pytest.approx(0.393720, abs=1e-6), "d2": pytest.approx(0.751846, abs=1e-6), "d3": pytest.approx(0.172478, abs=1e-6)}
    assert L.bm25(q, d.limit(0)).count() == 0


def test_bm25_plan(spark):
    t = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    q = spark.read.parquet("/root/testdata/sf0.001/queries.parquet")
    run = R.top_k(L.bm25(L.tokens(q, "qid", "query_text", "qid"), L.tokens(t, "doc_id", "text", "did")), 10)
    plan = run._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan
    assert "lang" not in plan.split("Scan")[-1]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 8)).astype(np.float32)
    return v, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "did bigint, vec array<float>")


def test_dense_forms_agree(spark, vectors):
    v, docs = vectors
    q = docs.where("did % 7 = 0").select(F.col("did").alias("qid"), "vec")
    a = {(r.qid, r["rank"]): (r.did, r.score) for r in D.dense_topk(q, docs, 5).collect()}
    for block in (2, 256):
        assert {(r.qid, r["rank"]): (r.did, r.score) for r in D.dense_topk_blocks(q, docs, 5, block).collect()} == a
    n = v / np.linalg.norm(v, axis=1, keepdims=True)
    for qid in range(0, 60, 7):
        assert [a[qid, k + 1][0] for k in range(5)] == np.argsort(-(n @ n[qid]), kind="stable")[:5].tolist()
    excl = q.select("qid", F.col("qid").alias("did"))
    assert all(r.qid != r.did for r in D.dense_topk(q, docs, 5, excl).collect())
    assert D.dense_topk_blocks(q.limit(0), docs, 5).count() == 0


def test_zero_vector(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0])], "did int, vec array<float>")
    assert df.select(V.normalize("vec").alias("v")).first().v == [0.0, 0.0]


def test_maxsim(spark, vectors):
    v, docs = vectors
    toks = docs.select((F.col("did") / 3).cast("int").alias("did"), (F.col("did") % 3).alias("dtok"), "vec")
    q = toks.where("did < 2").select(F.col("did").alias("qid"), F.col("dtok").alias("qtok"), "vec")
    got = {(r.qid, r.did): r.score for r in D.maxsim(q, toks).collect()}
    n = v / np.linalg.norm(v, axis=1, keepdims=True)
    for (a, b), s in got.items():
        assert s == pytest.approx(sum(max(float(n[3 * a + i] @ n[3 * b + j]) for j in range(3)) for i in range(3)), abs=1e-5)


def runs(spark):
    mk = lambda ids: spark.createDataFrame([("q", d, float(10 - i)) for i, d in enumerate(ids)], "qid string, did string, score double")
    return {"one": mk("abc"), "two": mk("bd"), "three": mk("ea")}


def test_union_and_injection(spark):
    c = U.union_candidates(U.stack(runs(spark), {"one": 2, "two": 2, "three": 1}))
    assert [r.did for r in c.orderBy("pos").collect()] == list("abde")
    gold = spark.createDataFrame([("q", "c", 1), ("q", "b", 1)], "qid string, did string, grade int")
    got = U.inject(c, gold).orderBy("pos").collect()
    assert [r.did for r in got] == list("abdec") and [r.did for r in got if r.injected] == ["c"]
    got = U.inject(c, gold, gold_first_removed=True).orderBy("pos").collect()
    assert [r.did for r in got] == list("adebc") and [r.did for r in got if r.injected] == ["b", "c"]
    assert c.where("did = 'b'").first().scores == {"one": 9.0, "two": 10.0}
    assert U.first_scores(U.stack(runs(spark), 3)).where("did = 'a'").first().score == 10.0


def brute_tournament(ids, better, batch, keep, final):
    tails, depth = [], 0
    pool = list(ids)
    while len(pool) > final:
        groups = [sorted(pool[i : i + batch], key=better) for i in range(0, len(pool), batch)]
        tails.append([g[keep:] for g in groups])
        pool = [d for g in groups for d in g[:keep]]
        depth += 1
    out = sorted(pool, key=better)
    for level in reversed(tails):
        for k in range(max((len(g) for g in level), default=0)):
            out += [g[k] for g in level if k < len(g)]
    return out


def test_tournament_hand_worked(spark):
    c = spark.createDataFrame([("q", f"c{i:02d}", 7 * i % 11) for i in range(1, 11)], "qid string, did string, p int")
    got = [r.did for r in tournament(c, by_column("p"), batch=4, keep=2, max_final=4, shuffle=False).orderBy("rank").collect()]
    assert got == "c08 c05 c10 c09 c02 c04 c01 c07 c03 c06".split()


def test_tournament_properties(spark):
    rng = random.Random(1)
    rows = [(f"q{q}", f"d{d:03d}", rng.random()) for q in range(4) for d in range(rng.choice([3, 17, 60, 90]))]
    c = spark.createDataFrame(rows, "qid string, did string, p double")
    got = tournament(c, by_column("p"), batch=6, keep=2, max_final=5).collect()
    by = {}
    for r in got:
        by.setdefault(r.qid, []).append((r["rank"], r.did))
    for q in by:
        mine = {d: p for x, d, p in rows if x == q}
        assert sorted(d for _, d in by[q]) == sorted(mine) and sorted(k for k, _ in by[q]) == list(range(1, len(mine) + 1))
        assert min(by[q])[1] == min(mine, key=mine.get)
    plain = tournament(c, by_column("p"), batch=6, keep=2, max_final=5, shuffle=False).collect()
    for q in by:
        mine = {d: p for x, d, p in rows if x == q}
        assert [r.did for r in sorted((r for r in plain if r.qid == q), key=lambda r: r["rank"])] == brute_tournament(sorted(mine), mine.get, 6, 2, 5)
    with pytest.raises(ValueError):
        tournament(c, by_column("p"), batch=4, keep=4)
    assert tournament(c.limit(0), by_column("p")).count() == 0


def test_function_comparator(spark):
    c = spark.createDataFrame([("q", f"d{i}", i) for i in range(9)] + [("q", "d1", 1), (None, "x", 0)], "qid string, did string, p int")
    compare = by_function(lambda q, dids: [len(dids), 99, len(dids)], "qid string, did string, p int, deal bigint, batch bigint, depth int, place bigint")
    got = tournament(c, compare, batch=3, keep=1, max_final=None, shuffle=False).orderBy("rank").collect()
    assert sorted(r.did for r in got) == sorted(f"d{i}" for i in range(9)) and got[0].did == "d8"


def test_multi_hop(spark):
    docs = spark.createDataFrame([("q", f"d{i}", float(i)) for i in range(12)], "qid string, did string, score double")
    q = spark.createDataFrame([("q",)], "qid string")
    calls = []

    def next_query(state, found, hop):
        calls.append(hop)
        return state

    barred = spark.createDataFrame([("q", "d11")], "qid string, did string")
    got = multi_hop(q, lambda s, _: docs, lambda f, h: f.withColumn("selected", F.col("did").isin("d3", "d9")), next_query, lambda p: p.join(docs, ["qid", "did"]), hops=3, per_hop=3, excluded=barred).orderBy("rank").collect()
    assert [r.did for r in got] == ["d9", "d3", "d10", "d8", "d7", "d6", "d5", "d4", "d2"]
    assert calls == [1, 2] and {r.did: r.hop for r in got}["d2"] == 3


def test_judgements(spark):
    docs = spark.createDataFrame([("s1", "A", "p1"), ("s2", "A", "p1"), ("s3", "A", "p2")], "sid string, author string, post string")
    assert {(r.qid, r.did) for r in J.same_author(docs).collect()} == {("s1", "s3"), ("s2", "s3"), ("s3", "s1"), ("s3", "s2")}
    assert {(r.qid, r.did) for r in J.same_post(docs).collect()} == {("s1", "s1"), ("s1", "s2"), ("s2", "s1"), ("s2", "s2"), ("s3", "s3")}
    m = lambda *p: spark.createDataFrame(list(p), "raw string, canonical string")
    raw = spark.createDataFrame([("x",), ("w",), ("v",)], "label string")
    assert {r.label: r.canonical for r in J.collapse(raw, m(("x", "y"), ("w", "k")), m(("y", "z"))).collect()} == {"x": "z", "w": "k", "v": "v"}
    edges = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)] + [("z1", "z2")], "a string, b string")
    assert {r.label: r.root for r in J.merge_groups(edges).collect()} == {**{f"n{i:02d}": "n00" for i in range(21)}, "z1": "z1", "z2": "z1"}
    q = spark.createDataFrame([("q1", "a_1"), ("q2", "a_10")], "qid string, problem_key string")
    s = spark.createDataFrame([(0, "a_10", "ten"), (1, "a_1", "one")], "pos int, key string, solution string")
    assert {r.qid: r.solution for r in J.solution_of(q, s).collect()} == {"q1": "one", "q2": "ten"}
    assert {r.qid: r.solution for r in J.solution_of(q, s, contained=True).collect()} == {"q1": "ten", "q2": "ten"}
    gold = spark.createDataFrame([("q", "a", 0), ("q", "b", 1)], "qid string, did string, grade int")
    new = spark.createDataFrame([("q", "a", 2), ("q", "c", 2), ("q", "d", 0)], "qid string, did string, grade int")
    assert {(r.did, r.grade) for r in J.first_wins(gold, new).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {(r.did, r.grade) for r in J.max_merge(gold, new).collect()} == {("a", 2), ("b", 1), ("c", 2), ("d", 0)}
    assert not math.isnan(1.0)
