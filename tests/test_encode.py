import numpy as np
from pyspark.sql import functions as F

from relevspark.functions import parse as P
from relevspark.operators import encode as E
from relevspark.sources import readers
from relevspark.streaming import ingest as I


def test_encode(spark, tmp_path):
    log = str(tmp_path / "calls")

    def model(texts, task):
        with open(log, "a") as f:
            f.writelines(f"{task}:{t}\n" for t in texts)
        return np.array([[len(t), 1.0] for t in texts])

    df = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, None)], "id int, text string").coalesce(1)
    path = str(tmp_path / "v")
    want = {1: [2.0, 1.0], 2: [2.0, 1.0], 3: [0.0, 1.0]}
    for _ in range(2):
        assert {r.id: list(r.vec) for r in E.encode_cached(df, "id", "text", model, path).collect()} == want
    assert sorted(open(log).read().splitlines()) == ["document:", "document:ab"]
    assert {r.id: list(r.vec) for r in E.encode(df, "id", "text", model, "query").collect()} == want
    toks = E.token_vectors(df, "id", "text", lambda t: np.ones((len(t), 2)), most=1)
    assert sorted((r.id, r.tok) for r in toks.collect()) == [(1, 0), (2, 0)]


def test_authors(spark):
    rows = [("p", 0, None, "a"), ("p", 1, "Doe_Jane", "x"), ("p", 2, None, "b"), ("p", 3, "Roe_Rick", "y"), ("q", 0, None, "c")]
    df = spark.createDataFrame(rows, "page string, pos int, name string, href string")
    got = {(r.page, r.pos): r.author for r in P.carry_author(df).collect()}
    assert got == {("p", 0): None, ("p", 1): "Jane Doe", ("p", 2): "Jane Doe", ("p", 3): "Rick Roe", ("q", 0): None}
    by = spark.createDataFrame([("Title\nBy Jane Q. Doe\ntext",), ("nothing",)], "t string").select(P.byline("t").alias("b")).collect()
    assert [r.b for r in by] == ["Jane Q. Doe", None]


def test_sources_and_order(spark):
    a = spark.createDataFrame([("10", "x")], "id string, title string")
    b = spark.createDataFrame([("9", 3), ("z", 1)], "id string, karma int")
    u = readers.union_sources({"a": a, "b": b})
    assert [(r.id, r.source, r.karma) for r in readers.by_number(u, "id").collect()] == [("9", "b", 3), ("10", "a", None), ("z", "b", 1)]


def test_watermarked_counts(spark, tmp_path):
    src, out, log = (str(tmp_path / x) for x in ("s", "o", "l"))
    rows = [("2024-01-01 01:00:00", "a"), ("2024-01-01 02:00:00", "a"), ("2024-01-03 00:00:00", "b"), ("2024-01-09 00:00:00", "b")]
    spark.createDataFrame(rows, "ts string, k string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(src)
    counts = I.windowed_counts(I.stream_files(spark, src, "ts timestamp, k string"), "ts", "k")
    counts.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {(str(r.window_start)[:10], r.k): r.n for r in spark.read.parquet(out).collect()}
    assert got[("2024-01-01", "a")] == 2
