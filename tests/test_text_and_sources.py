import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from relevspark.functions import parse as P
from relevspark.functions import text as T
from relevspark.operators import annotate as N
from relevspark.operators import segment as S
from relevspark.plans import build as B
from relevspark.sources import paged, readers, sinks
from relevspark.streaming import ingest as I
from relevspark.streaming import resume


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f("x").alias("y")).first().y


def test_text_functions(spark):
    assert one(spark, "café  naïve a b1", T.tokenize_ascii) == ["caf", "na", "ve", "b1"]
    assert one(spark, "café  naïve a b1", T.tokenize_word) == ["café", "naïve", "b1"]
    assert one(spark, "a b \n c", T.word_count) == 3
    assert one(spark, "", T.word_count) == 0
    assert one(spark, "abcdef", lambda c: T.truncate(c, 3)) == "abc..."
    assert one(spark, "x << mid >> y", lambda c: T.unframe(c, "<<", ">>")) == "mid"
    assert one(spark, "plain", lambda c: T.unframe(c, "<<", ">>")) == "plain"
    assert one(spark, "```json\n[1]\n```", T.strip_fence) == "[1]"
    assert one(spark, "a\\b", T.double_backslashes) == "a\\\\b"
    assert str(one(spark, "/p-20240131/", T.day_of)) == "2024-01-31"
    assert one(spark, "/p", T.day_of) is None
    assert one(spark, "Mother nature", T.is_junk_theme) is True
    assert one(spark, "  Jane \n DOE ", T.normalize_name) == "jane doe"
    assert one(spark, [3, 9, 3, 1], lambda c: T.valid_permutation(c, F.lit(4)), "array<int>") == [3, 1, 2, 4]
    assert one(spark, [3, 9, 3, 1], lambda c: T.valid_permutation(c, F.lit(4), append=False), "array<int>") == [3, 1]
    el = "struct<id:int>"
    assert [r.id for r in one(spark, '{"a": 1, "items": [{"id": 4}, {"id": 5}]}', lambda c: T.json_list(c, el))] == [4, 5]
    assert [r.id for r in one(spark, '```\n[{"id": 4}]\n```', lambda c: T.json_list(c, el))] == [4]
    conv = [("user", " hi "), ("assistant", ""), ("ASSISTANT", "ok"), (None, None)]
    assert one(spark, conv, T.format_conversation, "array<struct<role string, content string>>") == "[User]: hi\n\n[Assistant]: ok"


def test_parsers(spark):
    html = "<html><head><title>T  x</title><meta name='author' content='Ann'><style>s{}</style></head><body><nav>menu</nav><article><h2>Head</h2><p>One &amp; two</p><!-- c --><a href='/d-20240102/'></a></article><a href='/x'>y</a></body></html>"
    assert "s{}" in P.text_nodes(html) and "One & two" in P.text_nodes(html) and "c -->" not in P.text_nodes(html)
    df = spark.createDataFrame([(html,), (None,)], "h string").select(P.parse_page("h").alias("p")).select("p.*")
    row = df.first()
    assert row.title == "T x" and row.text == "Head\nOne & two" and row.author == "Ann"
    links = df.limit(1).select(P.archive_links("links", base="https://e.example").alias("l")).first().l
    assert [(x.href, x.text) for x in links] == [("https://e.example/d-20240102/", "Head")]
    assert P.first_object('x {"a": {"b": 1}} {') == '{"a": {"b": 1}}' and P.first_object("none") is None
    assert [(t["speaker"], t["text"]) for t in P.turns_of("Mr. Smith. Hello there.\nMs. Jones. Bye.")] == [("Mr. Smith", "Hello there."), ("Ms. Jones", "Bye.")]
    assert P.turns_of("no label here")[0]["speaker"] == "UNKNOWN" and P.turns_of(None) == []


def test_segments(spark):
    rows = [("d", i, s, "x") for i, s in enumerate(["Mr. A", "Senator B", "Mr. A", "Senator C", "Mr. D"])]
    df = spark.createDataFrame(rows, "doc_id string, pos int, speaker string, text string")
    assert [r.exchange for r in S.exchanges(df).orderBy("pos").collect()] == [0, 0, 0, 1, 1]
    assert S.join_turns(S.exchanges(df)).orderBy("exchange").first().text == "Mr. A: x\n\nSenator B: x\n\nMr. A: x"
    sent = " ".join(" ".join(["w"] * (n - 1) + ["e."]) for n in (300, 150, 100, 700, 20))
    got = spark.createDataFrame([("a", sent), ("b", "short one."), ("c", None), ("e", "")], "id string, text string")
    parts = {(r.id, r["sub"]): r.word_count for r in S.split_passages(got, "id", "text").collect()}
    assert parts == {("a", 0): 450, ("a", 1): 100, ("a", 2): 700, ("a", 3): 20, ("b", None): 2, ("e", None): 0}
    text = "\n\n".join(" ".join([f"p{k}"] * 150) for k in range(12))
    s = S.snippets(spark.createDataFrame([("a", text)], "id string, text string"), "id", "text").collect()
    assert [len(r.text.split()) for r in s] == [750, 750]


def test_annotation_cache(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def client(prompt):
        with open(calls, "a") as f:
            f.write(prompt + "\n")
        if "boom" in prompt:
            raise ValueError
        return '{"n": %d}' % len(prompt)

    df = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, "boom"), (4, None)], "id int, prompt string").coalesce(1)
    out = {r.id: r for r in N.run_cached(df, "prompt", client, str(tmp_path / "c"), "n int", tries=1).collect()}
    assert out[1].parsed.n == out[2].parsed.n == 2 and out[3].status == "failed: ValueError" and out[4].status == "missing"
    assert open(calls).read().splitlines().count("aa") == 1
    N.run_cached(df, "prompt", client, str(tmp_path / "c"), "n int", tries=1)
    assert open(calls).read().splitlines() == ["aa", "boom", "boom"] or sorted(open(calls).read().splitlines()) == ["aa", "boom", "boom"]
    waits = []
    assert N.with_retry(lambda p: 1 / 0, tries=3, first=1, sleep=waits.append)("x") == (None, "failed: ZeroDivisionError") and waits == [1, 2]
    assert N.with_retry(lambda p: " ", tries=1)("x") == (" ", "empty")


def test_readers(spark, tmp_path):
    d = str(tmp_path)

    def put(name, text):
        with open(f"{d}/{name}", "w") as f:
            f.write(text)
        return f"{d}/{name}"

    a = put("a.jsonl", '# note\n{"_id": "1", "text": "x"}\n\n{"_id": "2"}\n')
    assert [(r._id, r.text) for r in readers.jsonl_commented(spark, a, "_id string, text string").orderBy("_id").collect()] == [("1", "x"), ("2", None)]
    b = put("b.jsonl", '{"_id": "1", "text": "x"}\nbroken\n')
    assert [r[readers.CORRUPT] for r in readers.jsonl(spark, b, "_id string, text string").collect()] == [None, "broken"]
    for k in range(3):
        with gzip.open(f"{d}/part{k}.jsonl.gz", "wt") as f:
            f.write("".join(json.dumps({"v": f"{k}-{i}"}) + "\n" for i in range(3)))
    assert [r.v for r in readers.numbered_jsonl(spark, f"{d}/part*.jsonl.gz", "v string").orderBy("_row_id").collect()] == [f"{k}-{i}" for k in range(3) for i in range(3)]
    c = put("c.csv", " sid , author \n 1 , Ann \n2,\n")
    assert [tuple(r) for r in readers.csv_track(spark, c, ["author"]).collect()] == [("1", "Ann")]
    put("7.txt", " seven ")
    put("x.txt", "no")
    t = readers.text_files(spark, f"{d}/*.txt", ids_only_digits=True)
    assert [tuple(r) for r in t.collect()] == [("7", "seven")]
    assert {(r.sid, r.text) for r in readers.with_texts(spark.createDataFrame([("7",), ("8",)], "sid string"), t, "sid").collect()} == {("7", "seven"), ("8", "")}
    q = put("q.tsv", "query-id\tcorpus-id\tscore\nq1\td1\t2\n# c\n\nq1\t0\td2\t1\n")
    assert {tuple(r) for r in readers.qrels(spark, q).collect()} == {("q1", "d1", 2), ("q1", "d2", 1)}
    e = put("e.json", '{"q1": ["a", "b", "a"]}')
    assert readers.exclusions(spark, e).count() == 2
    j = put("j.json", '{"meta": "x", "problems": [{"id": 1}, {"id": 2}]}')
    assert readers.json_document(spark, j, "struct<id:int>").count() == 2
    r = put("r.jsonl", '{"query_id": "q1", "ranked": [["d1", 0.5], ["d2", 0.25]]}\n{"qid": "q2", "ranked_list": ["d3", "d4"]}\n{"query_id": "q3", "hits": [{"tid": "d5", "score": 1.5}]}\n')
    got = {(x.qid, x.did): (x.score, x["rank"]) for x in readers.run_file(spark, r, "s").collect()}
    assert got == {("q1", "d1"): (0.5, 1), ("q1", "d2"): (0.25, 2), ("q2", "d3"): (2.0, 1), ("q2", "d4"): (1.0, 2), ("q3", "d5"): (1.5, 1)}


def test_sinks(spark, tmp_path):
    d = str(tmp_path)
    docs = spark.createDataFrame([(1, "t", "x")], "doc_id bigint, text string, lang string")
    sinks.json_lines(sinks.collection(docs, "doc_id", "text", ["lang"]), f"{d}/corpus")
    back = readers.jsonl(spark, f"{d}/corpus", "_id string, text string, metadata struct<lang:string>").first()
    assert (back._id, back.text, back.metadata.lang) == ("1", "t", "x")
    q = spark.createDataFrame([("q1", "d1", 2)], "qid string, did string, grade int")
    sinks.qrels_tsv(q, f"{d}/qrels")
    assert readers.qrels(spark, f"{d}/qrels").collect() == q.collect()
    sinks.monthly(spark.createDataFrame([("2024-01-05 00:00:00", 1)], "ts string, v int").withColumn("ts", F.col("ts").cast("timestamp")), "ts", f"{d}/m")
    assert os.path.isdir(f"{d}/m/month=2024-01")
    long = spark.createDataFrame([("q1", "mrr", 0.5), ("q2", "mrr", 1.0)], "qid string, metric string, value double")
    assert "mrr" in sinks.report(sinks.summary(long, "m", 3)) and sinks.summary(long, "m", 3).first().metrics == {"mrr": 0.75}
    run = spark.createDataFrame([("q1", "d1", 0.5, 1), ("q1", "d2", 0.25, 2)], "qid string, did string, score double, rank int")
    res = sinks.results(spark.createDataFrame([("q1", 0.123456)], "qid string, mrr double"), run).first()
    assert res.mrr == 0.1235 and [x.did for x in res.ranked] == ["d1", "d2"]


def test_resume(spark, tmp_path):
    path = str(tmp_path / "log")
    items = spark.range(5)
    seen = []

    def work(df):
        seen.append(sorted(r.id for r in df.collect()))
        return df.withColumn("status", F.when(F.col("id") == 3, "failed").otherwise("ok"))

    resume.process(items, path, ["id"], work)
    resume.process(items, path, ["id"], work)
    assert seen == [[0, 1, 2, 3, 4], [3]]
    built = []

    def make():
        built.append(1)
        return spark.range(2)

    for fp in ("a", "a", "b"):
        assert resume.stage(spark, str(tmp_path / "s"), make, fp).count() == 2
    assert len(built) == 2
    assert resume.cursor(None, "x") is None and resume.cursor(items, "id") == 0


def test_stream(spark, tmp_path):
    src, sink, log = (str(tmp_path / x) for x in ("src", "sink", "log"))
    spark.range(3).write.parquet(src)
    I.ingest(I.stream_files(spark, src, "id bigint"), sink, log, key=["id"])
    spark.range(3, 5).write.mode("append").parquet(src)
    I.ingest(I.stream_files(spark, src, "id bigint"), sink, log, key=["id"])
    assert sorted(r.id for r in spark.read.schema("id bigint").parquet(f"{sink}/batch=*").collect()) == [0, 1, 2, 3, 4]


def test_paged(spark):
    pages = {None: ([{"id": "a"}, {"id": "b"}], "1"), "1": ([{"id": "b"}], "2"), "2": ([], "3"), "3": ([], "4"), "4": ([{"id": "z"}], None)}
    assert [r["id"] for r in paged.crawl(lambda c: pages[c])] == ["a", "b", "b"]
    got = paged.listing(spark, {"s": lambda c: ([{"id": "a", "v": 1}, {"id": "a", "v": 2}], None)}, "id string, v int", "id").collect()
    assert [(r.id, r.v) for r in got] == [("a", 1)]

    def get(url):
        return {"u1": (200, "body", None), "u2": (404, "", None), "u2.txt": (200, "", None), "u3": (500, "", None), "u3.txt": (404, "", None)}[url]

    df = spark.createDataFrame([("u1",), ("u2",), ("u3",), (None,)], "url string")
    out = {r.url: (r.body, r.status) for r in paged.download(df, get, fallbacks=[lambda u: u + ".txt"]).collect()}
    assert out == {"u1": ("body", "ok"), "u2": ("", "empty"), "u3": (None, "failed: 404")}


def test_pipelines(spark, tmp_path):
    html = "<p>" + "Senator Smith. " + "word " * 60 + "</p><p>\nMr. Jones. " + "reply here. " * 700 + "</p>"
    p = B.passage_corpus(spark.createDataFrame([("H1", html.replace("</p><p>", "\n"))], "hearing_id string, html string")).orderBy("doc_id").collect()
    assert [r.doc_id for r in p] == ["H1_p0000_00", "H1_p0000_01", "H1_p0000_02"] and all(r.passage_type == "qa_exchange" for r in p)
    gold = spark.createDataFrame([("1", "A", "p1"), ("2", "A", "p2"), ("3", "B", "p3"), ("9", "A", "p4")], "sid string, author string, post string")
    texts = spark.createDataFrame([("1", "x"), ("2", "y"), ("3", "z"), ("4", "w"), ("5", "u")], "sid string, text string")
    c = B.authorship_collection(gold, spark.createDataFrame([("4",)], "sid string"), texts)
    assert {(r.sid, r.track) for r in c["corpus"].collect()} == {("1", "gold"), ("2", "gold"), ("3", "gold"), ("4", "distractor"), ("5", "untracked")}
    assert {(r.qid, r.did) for r in c["qrels"].collect()} == {("1", "2"), ("2", "1")} and c["queries"].count() == 2
    docs = spark.createDataFrame([(i, f"{'cat' if i % 2 else 'dog'} number {i}") for i in range(8)], "did int, text string")
    vec = docs.select("did", F.array(F.col("did").cast("float"), F.lit(1.0).cast("float")).alias("vec"))
    clients = {"label": lambda x: x.split()[1] + "!", "query": lambda x: x[7:] + "s?", "judge": lambda x: "2"}
    d = B.descriptive_collection(docs, clients, str(tmp_path / "c"), vectors=vec, coverage=2)
    assert {r.text for r in d["queries"].collect()} == {"cats?", "dogs?"}
    assert d["qrels"].where("grade = 1").count() == 8 and d["qrels"].where("grade = 2").count() == 4
    probs = spark.createDataFrame([("a", "t", "l1"), ("b", "t", "l1x"), ("c", "t", "l2"), ("d", "t", "l9")], "did string, text string, label string")
    maps = [spark.createDataFrame([("l1x", "l1")], "raw string, canonical string")]
    g = B.analogue_collection(probs, maps, spark.createDataFrame([("l1", "l2")], "a string, b string"))
    assert g["qrels"].count() == 6 and g["queries"].count() == 3
    run = spark.createDataFrame([("q", 1, 1.0), ("q", 2, 0.5)], "qid string, did int, score double")
    qrels = spark.createDataFrame([("q", 1, 1)], "qid string, did int, grade int")
    more = B.expand_judgements({"r": run}, qrels, docs, spark.createDataFrame([("q", "cats")], "qid string, query_text string"), lambda x: "2", str(tmp_path / "j"))
    assert {(r.did, r.grade) for r in more.collect()} == {(1, 1), (2, 2)}
    per, means = B.evaluate(run, qrels, spark.createDataFrame([("q", None)], "qid string, author string"))
    assert means.where("metric = 'mrr'").first().author == "unknown"
    rw = B.rewrite_and_retrieve(spark.createDataFrame([("q", "dog")], "qid string, query_text string"), lambda x: "cat", str(tmp_path / "r"), lambda t: t.select("qid", F.array(F.length("text").cast("float"), F.lit(1.0).cast("float")).alias("vec")), vec, 3)
    assert rw.count() == 3


@pytest.mark.parametrize("bad", ["x", None])
def test_bad_numbers(spark, bad):
    assert one(spark, bad, lambda c: T.json_list(c, "struct<id:int>")) is None
