"""Queries of whole pipelines, of model calls with deterministic clients, and of files written and read back, each with its SQL where SQL can say it."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from relevspark.functions import parse as P
from relevspark.functions import text as T
from relevspark.operators import annotate as N
from relevspark.operators import dense as D
from relevspark.operators import fuse as U
from relevspark.operators import judgements as J
from relevspark.operators import lexical as L
from relevspark.operators import metrics as M
from relevspark.operators import ranking as R
from relevspark.operators import segment as S
from relevspark.operators.tournament import by_column, by_function, rerank_selected, tournament
from relevspark.plans import build as B
from relevspark.plans import retrieval_queries as RQ
from relevspark.plans.retrieval_queries import QRELS, STACKED, bm25_ctes, ranked, tok
from relevspark.plans.tables import Tables
from relevspark.runtime import checkpoint_dir
from relevspark.sources import readers, sinks


def _place(t: Tables, name: str) -> str:
    """A new folder in the shared folder of the session."""
    return f"{checkpoint_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


# -- transcripts --------------------------------------------------------------------------------------------------------------
def _latest(t: Tables):
    return J.dedup(t("passages"), ["doc_id"], [F.col("landed_at").desc(), F.col("text").desc()])


def speaker_turns(t: Tables):
    """Turns of each passage by the label patterns of transcripts."""
    turns = _latest(t).where("text is not null").select("doc_id", F.explode(P.speaker_turns("text")).alias("t"))
    return turns.select("doc_id", "t.pos", "t.speaker", F.md5("t.text").alias("digest"))


def joined_exchanges(t: Tables):
    """The text of each exchange: its turns as ``speaker: text`` parted by blank lines."""
    p = _latest(t).where("hearing_id is not null and speaker is not null and text is not null")
    return S.join_turns(S.exchanges(p, "hearing_id", "doc_id", "speaker"), "hearing_id", "doc_id").select("hearing_id", "exchange", "n_turns", F.md5("text").alias("digest"))


def passage_corpus(t: Tables):
    """Passages as pages of their own: tags are stripped, turns found and grouped, long exchanges split."""
    pages = _latest(t).select(F.col("doc_id").alias("hearing_id"), F.concat(F.lit("<html><body><pre>"), F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</pre></body></html>")).alias("html"))
    c = B.passage_corpus(pages)
    return c.select("doc_id", "hearing_id", "passage_type", "word_count", F.md5("text").alias("digest"))


# -- filters and limits --------------------------------------------------------------------------------------------------------
def first_queries(t: Tables):
    """The first twenty queries by id (the limit of a trial run)."""
    return t("queries").select("qid", "query_text").orderBy("qid").limit(20)


def ordered_documents(t: Tables):
    """Documents in the order of the numbers that their ids are."""
    w = readers.by_number(t("documents").select(F.col("doc_id").cast("string").alias("id")), "id")
    return w.select("id", F.expr("try_cast(id as bigint)").alias("number"))


def group_order(t: Tables):
    """Themes by size, the largest first."""
    from pyspark.sql import Window

    g = t("queries").where("theme is not null").groupBy("theme").agg(F.count(F.lit(1)).alias("n"))
    return g.select("theme", "n", F.row_number().over(Window.orderBy(F.col("n").desc(), "theme")).cast("bigint").alias("place"))  # at most as many rows as there are themes of the fixed table


def blocked_names(t: Tables):
    """Documents of which neither source nor language is on a block list."""
    names = t.spark.createDataFrame([("Crawl_00",), (" ES ",), ("french",)], "name string")
    return J.blocked(t("documents").select("doc_id", "source", "lang"), ["source", "lang"], names)


def metadata_keywords(t: Tables):
    """Documents whose metadata, written as JSON, holds a keyword."""
    meta = F.to_json(F.struct("corpus_id", "title", "source", "lang"))
    return t("documents").select("doc_id", F.array_join(T.mentions_any(meta, ["crawl", "harbor", "french"]), ",").alias("keywords")).where("keywords <> ''")


def sampled_qrels(t: Tables):
    """Judgements of a sample of the queries."""
    sample = R.stratified_sample(t("queries").where("theme is not null"), ["theme"], "qid", 40)
    return t.qrels().join(sample.select("qid"), "qid", "left_semi").select("qid", "did", "grade")


def solutions_by_key(t: Tables):
    """A speaker for each hearing by its key, and the first by containment of the hearing's id in a longer key."""
    q = t("hearings").select(F.col("hearing_id").alias("qid"), F.col("hearing_id").alias("problem_key"))
    s = t("speakers").select(F.col("hearing_id").alias("key"), F.concat("hearing_id", F.lit("/"), F.col("speaker_id").cast("string")).alias("long"), F.col("full_name").alias("solution"), F.col("speaker_id").alias("pos"))
    equal = J.solution_of(q, s.where("solution is not null").groupBy("key").agg(F.min("solution").alias("solution")))
    held = J.solution_of(q, s.select(F.col("long").alias("key"), "solution", "pos"), contained=True)
    return equal.join(held.withColumnRenamed("solution", "first"), "qid")


def author_groups(t: Tables):
    """Documents of a source as those of an author, of a language as those of a post."""
    return J.author_groups(t("documents").select(F.col("doc_id").alias("sid"), F.col("source").alias("author"), F.col("lang").alias("post")))


# -- runs -----------------------------------------------------------------------------------------------------------------------
def bm25_indexed_top100(t: Tables):
    """The lucene ranking from an index that is stored once and read again."""
    path = _place(t, "index")
    L.build_index(t.doc_tokens(), path, "1")
    return R.top_k(L.bm25_indexed(t.query_tokens(), L.build_index(t.doc_tokens(), path, "1")), 100)


def metrics_deep(t: Tables):
    """Metrics with deep cuts."""
    m = M.per_query(R.top_k(RQ.run_of(t, "lucene"), 1000), t.qrels(), cuts=(10, 100, 1000), recalls=(300, 500, 1000), successes=(1, 20))
    return m.select("qid", *(F.round(c, 6).alias(c) for c in ("ndcg_10", "ndcg_100", "ndcg_1000", "recall_300", "recall_500", "recall_1000")), "success_20")


def excluded_then_united(t: Tables):
    """Candidates of two runs from which judged pairs were taken before the first were chosen."""
    runs = {n: R.exclude(RQ.run_of(t, n), t.qrels()) for n in ("okapi", "lucene")}
    return U.union_candidates(U.stack(runs, {"okapi": 5, "lucene": 10})).select("qid", "did", "pos")


def tournament_listwise(t: Tables):
    """The recursive tournament with a comparator that is asked for numbers, as a model would be."""
    import hashlib

    def sort(qid: str, dids: list[int]) -> list[int]:
        taste = [hashlib.md5(f"taste|{qid}|{d}".encode()).hexdigest() for d in dids]
        told = [n + 1 for n in sorted(range(len(dids)), key=lambda n: (taste[n], dids[n]))]
        return [0, *told[: len(told) // 2 + 1], 999, *told]

    schema = "qid string, did bigint, pos bigint, taste string, deal bigint, batch bigint, depth int, place bigint"
    return tournament(RQ._pool(t), by_function(sort, schema), batch=6, keep=2, max_final=5)


def hops_reranked(t: Tables):
    """Multi-hop results of which the selected documents are put in order by one comparison."""
    taste = F.md5(F.concat_ws("|", F.lit("taste"), F.col("qid").cast("string"), F.col("did").cast("string")))
    return rerank_selected(RQ.multihop_ranked(t).withColumn("taste", taste), by_column("taste", "did"))


def rewritten_ranked(t: Tables):
    """Queries that a client rewrites (two words are added; a null stays as it is), encoded by hashes, against all documents."""
    docs = D.hashed_vectors(t.doc_tokens(), "did", "tokens", 16)

    def encode(q):
        return D.hashed_vectors(L.tokens(q, "qid", "text", "qid"), "qid", "tokens", 16)

    return B.rewrite_and_retrieve(t("queries").select("qid", "query_text"), N.Deterministic(lambda p: p.removeprefix("Rewrite: ") + " budget treaty"), _place(t, "rewrite"), encode, docs, 10)


# -- model calls --------------------------------------------------------------------------------------------------------------------
def retried_answers(t: Tables):
    """Answers of a client that fails on the first call for each prompt."""

    class Flaky:
        def __init__(self):
            self.seen = set()

        def __call__(self, prompt):
            if prompt not in self.seen:
                self.seen.add(prompt)
                raise TimeoutError
            return prompt.upper()

    asked = N.run_cached(t("queries").select("qid", "query_text"), "query_text", Flaky(), _place(t, "answers"), first=0.0)
    return asked.select("qid", "reply", "status")


def _listed(rule):
    """A client that answers a numbered list, but leaves out every seventh row of its first reply for a prompt and the last of each."""

    class Listed:
        def __call__(self, prompt: str) -> str:
            rows = [x.split("] ", 1) for x in prompt.split("\n")[1:] if x.startswith("[")]
            kept = [r for r in rows if len(rows) < 2 or len(r[-1]) % 7]
            return json.dumps([{"n": int(r[0][1:]), **rule(r[1] if len(r) > 1 else "")} for r in reversed(kept)])

    return Listed()


def labels_batched(t: Tables):
    """A label for every query, fifteen queries a prompt; rows that a reply leaves out are asked for again, at last one by one."""
    q = t("queries").select("qid", T.blank_to_null(F.regexp_replace("query_text", r"\s+", " ")).alias("text"))
    client, path = _listed(lambda s: {"label": s.split(" ")[0].lower()}), _place(t, "labels")
    for n in (15, 4, 1):
        told = N.sweep(q, "qid", "text", client, path, "label string", n, "Label each text.", rounds=2, first=0.0)
    return told.select("qid", "parsed.label")


def failure_sweep(t: Tables):
    """Conversations with the kind of mistake that a client sees in them, null where it sees none."""
    w = t("wild_conversations").select("row_id", F.regexp_replace(F.substring(F.coalesce(T.format_conversation("conversation", 400), F.lit("")), 1, 400), r"\s+", " ").alias("text"))
    client = _listed(lambda s: {"mistake_type": "refusal" if "sorry" in s.lower() else None, "description": s[:20]})
    path = _place(t, "sweep")
    for n in (4, 1):
        told = N.sweep(w, "row_id", "text", client, path, "mistake_type string, description string", n, "Find mistakes.", rounds=1, first=0.0)
    return told.where("parsed.mistake_type is not null").select("row_id", "parsed.mistake_type")


def fingerprints(t: Tables):
    """A fingerprint of every query from one call each; a reply in a code fence is read all the same."""
    client = N.Deterministic(lambda p: "```json\n" + json.dumps({"move": p.split(" ")[0].lower(), "words": len(p.split())}) + "\n```")
    told = N.run_cached(t("queries").select("qid", "query_text"), "query_text", client, _place(t, "prints"), "move string, words int", tries=1)
    return told.select("qid", "parsed.move", "parsed.words")


def qrels_expanded(t: Tables):
    """Judgements with those of the unjudged pool added; the judge is a rule on the length of the prompt."""
    runs = {n: RQ.run_of(t, n) for n in ("okapi", "lucene")}
    docs = t("documents").select(F.col("doc_id").alias("did"), "text")
    return B.expand_judgements(runs, t.qrels(), docs, t("queries").select("qid", "query_text"), N.Deterministic(lambda p: str(len(p) % 3)), _place(t, "judge"), 5)


def descriptive_qrels(t: Tables):
    """Documents that a client labels by their length, labels of at least three documents as queries, and their members as judged."""
    docs = t("documents").select(F.col("doc_id").alias("did"), "text")
    clients = {"label": N.Deterministic(lambda p: f"Length {len(p) % 50}"), "query": N.Deterministic(lambda p: "about " + p)}
    made = B.descriptive_collection(docs, clients, _place(t, "descriptive"), 3)
    return made["qrels"].join(made["queries"].select("qid", "theme"), "qid").select("theme", "did", "grade")


# -- replies ---------------------------------------------------------------------------------------------------------------------------
def _replies(t: Tables):
    """Replies of a model, made of queries: an object of a list with wrong and repeated numbers, in a code fence."""
    q = t("queries").select("qid", F.length("query_text").alias("n"))
    body = F.concat(F.lit('{"order": ['), (F.col("n") % 7).cast("string"), F.lit(", 2, "), (F.col("n") % 4).cast("string"), F.lit(", 99, 2]}"))
    return q.select("qid", F.concat(F.lit("```json\n"), body, F.lit("\n```")).alias("reply"), F.concat(F.lit("I say "), body, F.lit(" and {more}")).alias("said"))


def unfenced_replies(t: Tables):
    return _replies(t).select("qid", T.strip_fence("reply").alias("bare"), T.double_backslashes(F.concat("qid", F.lit("\\frac"))).alias("doubled"))


def balanced_replies(t: Tables):
    return _replies(t).select("qid", P.balanced_object("said").alias("object"))


def permutations(t: Tables):
    """Numbers from 1 to 5 in the order of the reply, those missing at the end."""
    numbers = T.json_list("reply", "int")
    return _replies(t).select("qid", F.array_join(T.valid_permutation(numbers, F.lit(5)), ",").alias("filled"), F.array_join(T.valid_permutation(numbers, F.lit(5), append=False), ",").alias("bare"))


def dated_paths(t: Tables):
    path = F.concat(F.lit("/blog/x-"), F.date_format("landed_at", "yyyyMMdd"), F.lit("/"))
    return t("wild_conversations").select("row_id", T.day_of(path).cast("string").alias("day"))


# -- files written and read back -----------------------------------------------------------------------------------------------------
def jsonl_read_back(t: Tables):
    path = _place(t, "jsonl")
    sinks.json_lines(t("documents").select("doc_id", "title", "text", "n_chars"), path, gzip=True)
    return readers.jsonl(t.spark, path, "doc_id bigint, title string, text string, n_chars bigint").select("doc_id", "title", F.md5("text").alias("digest"), "n_chars")


def commented_read_back(t: Tables):
    path = _place(t, "commented")
    lines = t("queries").select(F.explode(F.array(F.lit("# a remark"), F.to_json(F.struct("qid", "theme")), F.lit("  "))).alias("value"))
    lines.write.text(path)
    return readers.jsonl_commented(t.spark, path, "qid string, theme string")


def numbered_read_back(t: Tables):
    path = _place(t, "numbered")
    sinks.json_lines(t("passages").select("doc_id", "word_count"), path, gzip=True)
    rows = readers.numbered_jsonl(t.spark, f"{path}/part-*", "doc_id string, word_count int")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_row_id").alias("n_ids"), F.min("_row_id").alias("least"), F.max("_row_id").alias("most"), F.sum("word_count").alias("n_words"))


def csv_read_back(t: Tables):
    path = _place(t, "csv")
    t("speakers").select(F.concat(F.lit(" "), F.col("speaker_id").cast("string")).alias(" speaker_id "), "full_name", "office").write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    return readers.csv_track(t.spark, path, ["speaker_id", "office"])


def qrels_read_back(t: Tables):
    path = _place(t, "qrels")
    sinks.qrels_tsv(t.qrels(), path)
    return readers.qrels(t.spark, path)


def run_read_back(t: Tables):
    """A run written as one object a query, and read back."""
    path = _place(t, "run")
    top = R.top_k(RQ.run_of(t, "lucene"), 10)
    pairs = F.transform(F.sort_array(F.collect_list(F.struct("rank", "did", "score"))), lambda x: F.concat(F.lit("["), F.lit('"'), x["did"].cast("string"), F.lit('", '), x["score"].cast("string"), F.lit("]")))
    lines = top.groupBy("qid").agg(pairs.alias("p")).select(F.concat(F.lit('{"query_id": "'), "qid", F.lit('", "ranked": ['), F.array_join("p", ", "), F.lit("]}")).alias("value"))
    lines.write.text(path)
    return readers.run_file(t.spark, path, "lucene")


def months_read_back(t: Tables):
    path = _place(t, "months")
    sinks.monthly(t("wild_conversations").select("row_id", "landed_at"), "landed_at", path)
    return t.spark.read.schema("row_id bigint, month string").json(path).groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("ids"))


def document_read_back(t: Tables):
    """Queries as one JSON document (a fixed table), its list under a key."""
    path = _place(t, "document")
    one = t("queries").agg(F.sort_array(F.collect_list(F.struct("qid", "theme"))).alias("items"))
    one.select(F.to_json(F.struct(F.lit("list").alias("kind"), "items")).alias("value")).coalesce(1).write.text(path)
    return readers.json_document(t.spark, path, "struct<qid: string, theme: string>")


def vectors_read_back(t: Tables):
    v = readers.embeddings(t.spark, f"{t.folder}/embeddings.parquet", "vec_id", "embedding")
    return v.select("did", F.size("vec").alias("n"), F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


def ranked_results(t: Tables):
    """Per-query results as written for a run: metrics rounded, and the ranked list."""
    run = R.top_k(RQ.run_of(t, "lucene"), 1000)
    r = sinks.results(M.per_query(run, t.qrels()), run, 10)
    return r.select("qid", "n_relevant", F.array_join(F.transform("ranked", lambda x: x["did"].cast("string")), ",").alias("ranked"))


# -- pages, remote sources, resumable work --------------------------------------------------------------------------------------------
def stripped_pages(t: Tables):
    """Text nodes of pages made of documents; the body of a script is one of them."""
    escaped = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    html = F.concat(F.lit("<!-- no --><div><p>"), escaped, F.lit("</p><script>var x;</script></div>"))
    return t("documents").select("doc_id", F.md5(P.strip_html(html)).alias("digest"))


def parsed_pages(t: Tables):
    """Title, author and byline of pages made of speakers."""
    html = F.concat(F.lit('<html><head><title> '), "full_name", F.lit('  page</title><meta name="author" content="'), "full_name", F.lit('"></head><body><nav>menu</nav><article><p>By '), "full_name", F.lit("</p></article></body></html>"))
    return t("speakers").where("full_name is not null").select("speaker_id", P.parse_page(html).alias("p")).select("speaker_id", "p.title", "p.author", F.size("p.links").alias("n_links"))


def carried_authors(t: Tables):
    """Links of an index page with the author of the last anchor before them."""
    links = t("speakers").where("full_name is not null").select(F.col("hearing_id").alias("page"), F.col("speaker_id").alias("pos"), F.when(F.col("office") == "member", F.concat(F.element_at(F.split("full_name", " "), -1), F.lit("_"), F.split("full_name", " ")[0])).otherwise(F.lit("")).alias("name"))
    return P.carry_author(links).select("page", "pos", "author")


def paged_listing(t: Tables):
    """Two listings with overlapping keys, read page by page; a cursor that repeats ends one of them."""
    from relevspark.sources.paged import listing

    def pages(first: int, last: int):
        def fetch(cursor):
            at = int(cursor or first)
            rows = [{"id": f"k{n}", "n": n} for n in range(at, min(at + 10, last))]
            return rows, str(at + 10) if at + 10 < last else cursor

        return fetch

    return listing(t.spark, {"a": pages(0, 55), "b": pages(40, 90)}, "id string, n bigint", "id")


def downloaded_pages(t: Tables):
    """Pages of hearings by a transport that asks for patience, fails for some addresses, and has others empty."""
    from relevspark.sources.paged import download

    class Get:
        def __init__(self):
            self.asked = set()

        def __call__(self, url: str):
            if url not in self.asked:
                self.asked.add(url)
                return 429, "", 0.0
            if url.endswith("1.htm"):
                return 404, "", None
            return 200, "" if url.endswith("2.htm") else url.upper(), None

    urls = t("hearings").select(F.concat("hearing_id", F.lit(".htm")).alias("url"))
    return download(urls, Get(), fallbacks=[lambda u: u.replace("1.htm", "1.txt")])


def resumed_log(t: Tables):
    """A log of processed documents: the first run fails for documents without a language, the second asks for these alone, the third for none."""
    from relevspark.streaming.resume import process

    path, d = _place(t, "log"), t("documents").select("doc_id", "lang")
    process(d, path, ["doc_id"], lambda x: x.select("doc_id", F.when(F.col("lang").isNull(), "failed").otherwise("ok").alias("status"), F.lit(1).alias("run")))
    process(d, path, ["doc_id"], lambda x: x.select("doc_id", F.lit("ok").alias("status"), F.lit(2).alias("run")))
    done = process(d, path, ["doc_id"], lambda x: x.select("doc_id", F.lit("ok").alias("status"), F.lit(3).alias("run")))
    return done.groupBy("run", "status").agg(F.count(F.lit(1)).alias("n"))


def stored_stage(t: Tables):
    """A stage that is built once under its fingerprint and read again; another fingerprint builds it anew."""
    from relevspark.streaming.resume import stage

    path = _place(t, "stage")
    build = lambda tag: lambda: t("queries").select("qid", F.lit(tag).alias("tag"))
    rows = [stage(t.spark, path, build(tag), fp) for tag, fp in (("first", "a"), ("second", "a"), ("third", "b"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def encoded_cached(t: Tables):
    """Vectors of queries by an encoder that is asked once for each text, from its store on the second call."""
    import numpy as np

    from relevspark.operators.encode import encode_cached

    path, q = _place(t, "vectors"), t("queries").select("qid", "query_text")
    encoder = lambda texts, task: np.array([[len(x), x.count("e")] for x in texts], np.float32)
    encode_cached(q, "qid", "query_text", encoder, path, "query")
    return encode_cached(q, "qid", "query_text", lambda texts, task: np.zeros((len(texts), 2), np.float32), path, "query").select("qid", F.array_join(F.transform("vec", lambda x: x.cast("int").cast("string")), ",").alias("vec"))


def guided_hops(t: Tables):
    """Two hops that a client guides: it selects even numbers and searches on with its notes."""

    def rule(prompt: str) -> str:
        if prompt.startswith("Select: "):
            numbers = [int(x[1 : x.index("]")]) for x in prompt.split("\n") if x.startswith("[") and "]" in x and x[1 : x.index("]")].isdigit()]
            return json.dumps({"ids": [n for n in numbers if n % 2 == 0], "notes": "harbor treaty"})
        return prompt.split(": ", 1)[1].replace("\n", " ")

    docs = t("documents").select(F.col("doc_id").alias("did"), "text")
    return B.guided_hops(t("queries").select("qid", "query_text"), docs, N.Deterministic(rule), _place(t, "hops"), hops=2, per_hop=4)


def migrated_log(t: Tables):
    """A log of speakers whose hearing stands for an old key; one of two rows is there under the new key already."""
    from relevspark.streaming.resume import migrate_keys

    log = t("hearings").select(F.col("hearing_id").alias("key"), F.lit(0).alias("v")).unionByName(t("speakers").where("speaker_id % 2 = 0").select(F.col("speaker_id").cast("string").alias("key"), F.lit(1).alias("v")))
    names = t("hearings").select(F.col("hearing_id").alias("old"), F.lit("n-").alias("_p")).select("old", F.concat("_p", "old").alias("new"))
    names = names.unionByName(t("speakers").where("speaker_id % 4 = 0").select(F.col("speaker_id").cast("string").alias("old"), (F.col("speaker_id") + 2).cast("string").alias("new")))
    return migrate_keys(log, names, "key")


def flag_rate(t: Tables):
    """The share of conversations of more than two turns."""
    from relevspark.operators.stats import rate

    return rate(t("wild_conversations"), F.col("turn") > 2).select(F.round("rate", 6).alias("rate"))


def run_summary(t: Tables):
    """The means of a run as its summary has them, one row a metric."""
    s = sinks.summary(M.long_form(RQ.metrics_per_query(t)), "bm25", 0)
    return s.select("model", "n_queries", F.explode("metrics").alias("metric", "value")).where("metric in ('map', 'mrr', 'ndcg_10')")


def exclusions_read_back(t: Tables):
    """Pairs to exclude written as one JSON object from queries to lists (the file's format), and read back."""
    path = _place(t, "exclusions")
    lists = t.qrels().where("grade = 2").groupBy("qid").agg(F.collect_list(F.col("did").cast("string")).alias("d"))
    one = lists.agg(F.map_from_entries(F.collect_list(F.struct("qid", "d"))).alias("m"))
    one.select(F.to_json("m").alias("value")).coalesce(1).write.text(path)
    return readers.exclusions(t.spark, path)


def pool_counts(t: Tables):
    """The first rank of a relevant document and the size of the pool of each judged query."""
    n = RQ.union_candidates(t).groupBy("qid").agg(F.count(F.lit(1)).alias("n_candidates"))
    return RQ._metrics(t).select("qid", "best_rank", "n_relevant").join(n, "qid")


QUERIES = {
    f.__name__: f
    for f in (
        speaker_turns, joined_exchanges, passage_corpus, first_queries, ordered_documents, group_order, blocked_names, metadata_keywords, sampled_qrels, solutions_by_key, author_groups,
        bm25_indexed_top100, metrics_deep, excluded_then_united, tournament_listwise, hops_reranked, rewritten_ranked,
        retried_answers, labels_batched, failure_sweep, fingerprints, qrels_expanded, descriptive_qrels, unfenced_replies, balanced_replies, permutations, dated_paths,
        jsonl_read_back, commented_read_back, numbered_read_back, csv_read_back, qrels_read_back, run_read_back, months_read_back, document_read_back, vectors_read_back, ranked_results,
        stripped_pages, parsed_pages, carried_authors, paged_listing, downloaded_pages, resumed_log, stored_stage, encoded_cached, guided_hops, migrated_log, flag_rate, run_summary, exclusions_read_back, pool_counts,
    )
}

# -- SQL -------------------------------------------------------------------------------------------------------------------------
_TITLED = r"(?m)^[ \t]*(Senator|Chairman|Chairwoman|Chairperson|Mr\.|Mrs\.|Ms\.|Dr\.|Representative|Rep\.|The CHAIRMAN|The CHAIRWOMAN|The CHAIR|General|Admiral|Secretary|Commissioner|Director|Ambassador|Governor|Mayor|Professor|Judge|Justice)[.\s]+([A-Z][A-Za-z\-'']+(?:\s+[A-Z][A-Za-z\-'']+)?)\s*[.:]\s*"
_FULL = r"(?m)^[ \t]*([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\s*:\s*(?:\(\d+:\d+\))?\s*"
_CAPITALS = r"(?m)^[ \t]*([A-Z]{2,}(?:\s+[A-Z]{2,})*)\s*[.]\s*"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(8201) || chr(8239) || chr(12288)"
_SPEAKERS = f"""with p as (select doc_id, text from (select *, row_number() over (partition by doc_id order by landed_at desc, text desc) as rn from passages) where rn = 1 and text is not null),
c as (select *, len(regexp_extract_all(text, '{_TITLED}')) as a, len(regexp_extract_all(text, '{_FULL}')) as b, len(regexp_extract_all(text, '{_CAPITALS}')) as c from p),
m as (select doc_id, text, a + b + c as hits, case when a >= b and a >= c then regexp_replace(text, '{_TITLED}', chr(1) || '\\1 \\2' || chr(2), 'g') when b >= c then regexp_replace(text, '{_FULL}', chr(1) || '\\1' || chr(2), 'g') else regexp_replace(text, '{_CAPITALS}', chr(1) || '\\1' || chr(2), 'g') end as marked from c),
s as (select doc_id, unnest(string_split(marked, chr(1))[2:]) as piece, generate_subscripts(string_split(marked, chr(1))[2:], 1) as i from m where hits > 0),
w as (select doc_id, i, trim(split_part(piece, chr(2), 1), '. ') as speaker, trim(split_part(piece, chr(2), 2), {_BLANKS}) as said from s
      union all select doc_id, 1, 'UNKNOWN', trim(text, {_BLANKS}) from m where hits = 0)
select doc_id, (row_number() over (partition by doc_id order by i) - 1)::int as pos, speaker, md5(said) as digest from w where said <> ''"""
_ASKS = " or ".join(f"starts_with(lower(trim(speaker)), '{p}')" for p in ("senator", "chairman", "chairwoman", "chairperson", "the chairman", "the chairwoman", "the chair", "representative", "rep"))


def _deep_sql() -> str:
    gain = lambda g, r: f"greatest({g}, 0) / log2({r} + 1)"
    cuts, recalls = (10, 100, 1000), (300, 500, 1000)
    return f"""with {bm25_ctes('lucene', 'lucene')}, {QRELS}, r as ({ranked('lucene', 1000)}),
best as (select *, row_number() over (partition by qid order by grade desc, did) as r from gold),
ideal as (select qid, sum((grade >= 1)::int) as n, {', '.join(f"sum(case when r <= {k} then {gain('grade', 'r')} end) as i{k}" for k in cuts)} from best group by qid),
got as (select r.qid, min(case when grade >= 1 then rank end) as first_, {', '.join(f"sum(case when rank <= {k} then {gain('grade', 'rank')} end) as d{k}" for k in cuts)}, {', '.join(f"sum((grade >= 1 and rank <= {k})::int) as h{k}" for k in recalls)} from r join gold g on r.qid = g.qid and r.did = g.did group by r.qid)
select qid, {', '.join(f"round(coalesce(d{k} / nullif(i{k}, 0), 0), 6) as ndcg_{k}" for k in cuts)}, {', '.join(f"round(coalesce(h{k}::double / nullif(n, 0), 0), 6) as recall_{k}" for k in recalls)}, case when first_ <= 20 then 1.0::double else 0.0::double end as success_20
from (select distinct qid from r) join ideal using (qid) left join got using (qid)"""


def _hashed(tokens: str, key: str, source: str) -> str:
    h = "list_reduce(list_transform(range(8), lambda i: (strpos('0123456789abcdef', substr(md5(term), i::int + 1, 1)) - 1)::bigint), lambda a, b: a * 16 + b)"
    return f"(select {key}, list(v order by c) as v from (select k.{key}, k.c, coalesce(x.v, 0)::double as v from (select distinct {key}, c from (select {key} from (select {key}, unnest({tokens}) as term from {source}) group by 1), (select unnest(range(16)) as c)) k left join (select {key}, h % 16 as c, sum(case when (h // 16) % 2 = 0 then 1 else -1 end) as v from (select {key}, {h} as h from (select {key}, unnest({tokens}) as term from {source})) group by all) x using ({key}, c)) group by {key})"


def _rewritten_sql() -> str:
    q = _hashed(tok("text"), "qid", "(select qid, query_text || ' budget treaty' as text from queries)")
    d = _hashed(tok("text"), "did", "(select doc_id as did, text from documents)")
    unit = "list_transform({0}, lambda x: x / greatest(sqrt(list_inner_product({0}, {0})), 1e-9))"
    return f"with q as (select qid, {unit.format('v')} as v from {q}), d as (select did, {unit.format('v')} as v from {d}), x as (select qid, did, round(list_inner_product(q.v, d.v), 6) as score from q, d) {ranked('x', 10)}"


_REPLY = "'{\"order\": [' || (length(query_text) % 7)::varchar || ', 2, ' || (length(query_text) % 4)::varchar || ', 99, 2]}'"
_ORDER = "list_filter([length(query_text) % 7, 2, length(query_text) % 4, 99, 2], lambda x: x between 1 and 5)"
SQL = {
    "speaker_turns": _SPEAKERS,
    "joined_exchanges": f"with p as (select *, greatest(sum(coalesce(({_ASKS}), false)::int) over (partition by hearing_id order by doc_id) - 1, 0)::bigint as exchange from (select * from (select *, row_number() over (partition by doc_id order by landed_at desc, text desc) as rn from passages) where rn = 1 and hearing_id is not null and speaker is not null and text is not null)) select hearing_id, exchange, count(*)::int as n_turns, md5(string_agg(speaker || ': ' || text, chr(10) || chr(10) order by doc_id)) as digest from p group by all",
    "first_queries": "select qid, query_text from queries order by qid limit 20",
    "ordered_documents": "select doc_id::varchar as id, doc_id as number from documents",
    "group_order": "select theme, n, row_number() over (order by n desc, theme) as place from (select theme, count(*) as n from queries where theme is not null group by theme)",
    "blocked_names": "select doc_id, source, lang from documents where lower(trim(coalesce(source, ''))) not in ('crawl_00', 'es', 'french') and lower(trim(coalesce(lang, ''))) not in ('crawl_00', 'es', 'french')",
    "metadata_keywords": "select doc_id, k as keywords from (select doc_id, array_to_string(list_filter(['crawl', 'harbor', 'french'], lambda k: contains(lower(concat_ws('|', corpus_id, title, source, lang)), k)), ',') as k from documents) where k <> ''",
    "sampled_qrels": f"with {QRELS}, d as (select qid, theme, count(*) over (partition by theme) as n, row_number() over (partition by theme order by md5(concat_ws('|', '42', qid)), qid) as r, count(*) over () as total from queries where theme is not null) select qid, did, grade from gold where qid in (select qid from d where r <= greatest(1, round_even(n / total * 40, 0)::bigint))",
    "solutions_by_key": "select h.hearing_id as qid, (select min(full_name) from speakers s where s.hearing_id = h.hearing_id) as solution, (select arg_min(full_name, speaker_id) from speakers s where contains(s.hearing_id || '/' || s.speaker_id::varchar, h.hearing_id)) as first from hearings h where h.hearing_id in (select hearing_id from speakers)",
    "author_groups": "select doc_id as sid, source as author, lang as post, case when lang is null then 0 else count(lang) over (partition by source) - count(*) over (partition by source, lang) end as n_relevant, case when lang is null then 0 else count(*) over (partition by source, lang) end as n_excluded from documents where source is not null",
    "bm25_indexed_top100": f"with {bm25_ctes('lucene')} {ranked('run', 100)}",
    "metrics_deep": _deep_sql(),
    "excluded_then_united": f"with {bm25_ctes('okapi', 'okapi')}, {bm25_ctes('lucene', 'lucene')}, {QRELS}, o as materialized (select * from okapi anti join gold using (qid, did)), l as materialized (select * from lucene anti join gold using (qid, did)), s as (select 0 as prio, qid, did, rank from ({ranked('o', 5)}) union all select 1, qid, did, rank from ({ranked('l', 10)})) select qid, did, row_number() over (partition by qid order by f, did) as pos from (select qid, did, min(prio * 1000 + rank) as f from s group by qid, did)",
    "tournament_listwise": RQ.SQL["tournament_recursive"],
    "hops_reranked": f"with m as ({RQ.SQL['multihop_ranked']}) select qid, did, row_number() over (partition by qid order by s, p, did) as rank from (select qid, did, case when selected then 0 else 1 end as s, case when selected then row_number() over (partition by qid, selected order by md5(concat_ws('|', 'taste', qid::varchar, did::varchar)), did) else rank end as p from m)",
    "rewritten_ranked": _rewritten_sql(),
    "retried_answers": "select qid, upper(query_text) as reply, 'ok' as status from queries",
    "labels_batched": "select qid, lower(split_part(trim(regexp_replace(query_text, '\\s+', ' ', 'g')), ' ', 1)) as label from queries",
    "fingerprints": "select qid, lower(split_part(query_text, ' ', 1)) as move, len(string_split_regex(trim(query_text), '\\s+'))::int as words from queries",
    "qrels_expanded": f"with {STACKED.replace('stacked as (', 'stacked as materialized (')}, {QRELS}, p as materialized (select distinct qid, did from stacked where rank <= 5), u as materialized (select * from p anti join gold using (qid, did)), j as (select u.qid, u.did, (length('Judge: ' || coalesce(query_text, '') || chr(10) || coalesce(text, '')) % 3)::int as grade from u join documents d on d.doc_id = u.did join queries q on q.qid = u.qid) select qid, did, grade from gold union all select qid, did, grade from j where grade > 0",
    "descriptive_qrels": "with d as (select doc_id as did, 'length ' || ((length('Label: ' || coalesce(text, '')) % 50)::varchar) as theme from documents) select theme, did, 1 as grade from d where theme in (select theme from d group by theme having count(*) >= 3)",
    "unfenced_replies": f"select qid, {_REPLY} as bare, qid || '\\\\frac' as doubled from queries",
    "balanced_replies": f"select qid, {_REPLY} as object from queries",
    "permutations": f"with r as (select qid, (select list(x order by i) from (select x, min(i) as i from (select unnest({_ORDER}) as x, generate_subscripts({_ORDER}, 1) as i) group by x)) as o from queries) select qid, array_to_string(list_concat(o, list_filter([1, 2, 3, 4, 5], lambda x: not list_contains(o, x))), ',') as filled, array_to_string(o, ',') as bare from r",
    "dated_paths": "select row_id, strftime(landed_at, '%Y-%m-%d') as day from wild_conversations",
    "jsonl_read_back": "select doc_id, title, md5(text) as digest, n_chars from documents",
    "commented_read_back": "select qid, theme from queries",
    "numbered_read_back": "select count(*) as n, count(*) as n_ids, 0::bigint as least, count(*) - 1 as most, sum(word_count)::bigint as n_words from passages",
    "csv_read_back": "select speaker_id::varchar as speaker_id, trim(full_name) as full_name, trim(office) as office from speakers where trim(office) <> ''",
    "qrels_read_back": f"with {QRELS} select qid, did::varchar as did, grade from gold",
    "run_read_back": f"with {bm25_ctes('lucene')}, x as ({ranked('run', 10)}) select 'lucene' as system, qid, did::varchar as did, score, rank from x",
    "months_read_back": "select strftime(landed_at, '%Y-%m') as month, count(*) as n, sum(row_id)::bigint as ids from wild_conversations group by 1",
    "document_read_back": "select qid, theme from queries",
    "vectors_read_back": "select vec_id as did, len(embedding)::int as n, round(list_sum(list_transform(embedding, lambda x: x::double)), 4) as total from embeddings",
    "ranked_results": f"with {bm25_ctes('lucene', 'lucene')}, {QRELS}, r as ({ranked('lucene', 1000)}) select qid, n_relevant, ranked from (select qid, sum((grade >= 1)::int)::bigint as n_relevant from gold group by qid) join (select qid, array_to_string(list(did::varchar order by rank), ',') as ranked from r where rank <= 10 group by qid) using (qid)",
    "failure_sweep": "with c as (select row_id, array_to_string(list_transform(list_filter(conversation, lambda m: trim(coalesce(m.content, '')) <> ''), lambda m: '[' || upper(left(trim(coalesce(m.role, 'unknown')), 1)) || lower(substr(trim(coalesce(m.role, 'unknown')), 2)) || ']: ' || trim(m.content)), chr(10) || chr(10)) as t from wild_conversations) select row_id, 'refusal' as mistake_type from c where contains(lower(left(case when length(t) > 400 then left(t, 400) else t end, 400)), 'sorry')",
    "stripped_pages": "select doc_id, md5(coalesce(text, '') || 'var x;') as digest from documents",
    "parsed_pages": "select speaker_id, trim(full_name) || ' page' as title, full_name as author, 0 as n_links from speakers where full_name is not null",
    "carried_authors": "select hearing_id as page, speaker_id as pos, last_value(case when office = 'member' and regexp_full_match(split_part(full_name, ' ', -1) || '_' || split_part(full_name, ' ', 1), '[^_]+_[^_]+') then split_part(full_name, ' ', 1) || ' ' || split_part(full_name, ' ', -1) end ignore nulls) over (partition by hearing_id order by speaker_id rows unbounded preceding) as author from speakers where full_name is not null",
    "paged_listing": "select case when n < 55 then 'a' else 'b' end as source, 'k' || n::varchar as id, n from (select unnest(range(90)) as n)",
    "downloaded_pages": "select url, case when ends_with(url, '1.htm') then upper(replace(url, '1.htm', '1.txt')) when ends_with(url, '2.htm') then '' else upper(url) end as body, case when ends_with(url, '2.htm') then 'empty' else 'ok' end as status from (select hearing_id || '.htm' as url from hearings)",
    "resumed_log": "select * from (select 1 as run, case when lang is null then 'failed' else 'ok' end as status, count(*) as n from documents group by all union all select 2, 'ok', count(*) from documents where lang is null having count(*) > 0)",
    "stored_stage": "select 'first' as tag, 2 * count(*) as n from queries union all select 'third', count(*) from queries",
    "encoded_cached": "select qid, length(coalesce(query_text, ''))::varchar || ',' || (length(coalesce(query_text, '')) - length(replace(coalesce(query_text, ''), 'e', '')))::varchar as vec from queries",
    "migrated_log": "with log as (select hearing_id as key, 0 as v from hearings union all select speaker_id::varchar, 1 from speakers where speaker_id % 2 = 0), names as (select hearing_id as old, 'n-' || hearing_id as new from hearings union all select speaker_id::varchar, (speaker_id + 2)::varchar from speakers where speaker_id % 4 = 0), kept as (select key, v from log where key not in (select old from names)) select * from kept union all select new, v from log join names on old = key where new not in (select key from kept)",
    "flag_rate": "select round(avg(case when turn > 2 then 1.0 else 0.0 end), 6) as rate from wild_conversations",
    "run_summary": f"with {RQ.METRICS}, {RQ.LONG} select 'bm25' as model, n_queries, metric, round(value, 4) as value from (select metric, count(*) as n_queries, avg(value) as value from long where metric in ('map', 'mrr', 'ndcg_10') group by metric)",
    "exclusions_read_back": f"with {QRELS} select qid, did::varchar as did from gold where grade = 2",
    "pool_counts": f"with {RQ.METRICS}, {STACKED.replace(bm25_ctes('lucene', 'lucene') + ',', '')} select qid, best_rank, n_relevant, n_candidates from m join (select qid, count(*) as n_candidates from candidates group by qid) using (qid)",
}
