"""End-to-end pipelines: building collections, expanding judgements, evaluating a retriever."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relevspark.functions import parse as P
from relevspark.functions import text as T
from relevspark.operators import annotate as N
from relevspark.operators import dense as D
from relevspark.operators import fuse as U
from relevspark.operators import judgements as J
from relevspark.operators import metrics as M
from relevspark.operators import ranking as R
from relevspark.operators import segment as S


def passage_corpus(hearings: DataFrame, html_col: str = "html", least_words: int = 50) -> DataFrame:
    """``doc_id, text, hearing_id, passage_type, word_count`` of hearings ``hearing_id, html``.

    Pages lose their tags, turns are found by their labels and grouped into exchanges, short exchanges are dropped (their numbers are
    not given again), long ones are split by sentences.
    """
    turns = hearings.select("hearing_id", F.explode(P.speaker_turns(P.strip_html(F.col(html_col)))).alias("t")).select(F.col("hearing_id").alias("doc_id"), "t.pos", "t.speaker", "t.text")
    exchanges = S.join_turns(S.exchanges(turns)).withColumn("_w", T.word_count("text")).where(F.col("_w") >= least_words)
    typed = exchanges.select(F.col("doc_id").alias("hearing_id"), F.concat(F.col("doc_id"), F.lit("_p"), F.lpad(F.col("exchange").cast("string"), 4, "0")).alias("pid"), S.passage_type(F.col("n_turns"), F.col("_w")).alias("passage_type"), "text")
    parts = S.split_passages(typed, "pid", "text")
    named = parts.join(typed.select("pid", "hearing_id", "passage_type"), "pid")
    sub = F.when(F.col("sub").isNotNull(), F.concat(F.lit("_"), F.lpad(F.col("sub").cast("string"), 2, "0"))).otherwise("")
    return named.select(F.concat("pid", sub).alias("doc_id"), "text", "hearing_id", "passage_type", "word_count")


def authorship_collection(gold: DataFrame, distractors: DataFrame, texts: DataFrame, least: int = 2) -> dict[str, DataFrame]:
    """Corpus, queries, judgements and exclusions of an authorship task.

    ``gold`` is ``sid, author, post``; ``texts`` is ``sid, text``.  Only gold snippets with a text count; authors need at least ``least`` of them.
    """
    tracks = J.reconcile(gold, distractors, texts, "sid")
    corpus = texts.join(tracks, "sid")
    present = gold.join(texts.select("sid"), "sid", "left_semi")
    kept = present.join(J.frequent(present, ["author"], least).select("author"), "author", "left_semi")
    qrels = J.same_author(kept)
    queries = kept.join(qrels.select(F.col("qid").alias("sid")).distinct(), "sid", "left_semi").join(texts, "sid").select(F.col("sid").alias("qid"), "text", "author")
    return {"corpus": corpus, "queries": queries, "qrels": qrels, "exclusions": J.same_post(kept)}


def descriptive_collection(docs: DataFrame, clients: dict[str, Callable[[str], str]], cache: str, least: int = 3, coverage: int = 50, vectors: DataFrame | None = None) -> dict[str, DataFrame]:
    """A collection whose queries describe groups of documents ``did, text``.

    Each document gets a label from ``clients['label']``, labels collapse to canonical ones, groups of at least ``least`` become queries by
    ``clients['query']``; members are judged 1, and, with ``vectors`` (did, vec; queries are encoded as the mean of their members), the nearest ``coverage``
    documents that are not members are judged by ``clients['judge']`` (a number).  Every answer is cached under ``cache`` and asked once.
    """
    told = N.run_cached(docs.withColumn("prompt", F.concat(F.lit("Label: "), F.coalesce("text", F.lit("")))), "prompt", clients["label"], f"{cache}/label", tries=1)
    labels = told.select("did", N.canonical_label(F.coalesce("reply", F.lit("uncategorized"))).alias("label")).where(~T.is_junk_theme("label"))
    big = J.frequent(labels, ["label"], least)
    members = labels.join(big.select("label"), "label", "left_semi")
    asked = N.run_cached(big.withColumn("prompt", F.concat(F.lit("Query: "), F.col("label"))), "prompt", clients["query"], f"{cache}/query", tries=1)
    queries = asked.select(F.concat(F.lit("q"), F.left(F.md5("label"), F.lit(8))).alias("qid"), F.coalesce("reply", "label").alias("text"), F.col("label").alias("theme"))
    own = members.join(queries.select("qid", F.col("theme").alias("label")), "label").select("qid", "did", F.lit(1).alias("grade"))
    qrels = own
    if vectors is not None:
        mean = own.join(vectors, "did").select("qid", F.posexplode("vec").alias("k", "x")).groupBy("qid", "k").agg(F.avg("x").alias("x")).groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda s: s["x"].cast("float")).alias("vec"))
        near = D.dense_topk(mean, vectors.select("did", "vec"), coverage, own)
        prompts = near.join(docs, "did").join(queries.select("qid", F.col("text").alias("_q")), "qid").withColumn("prompt", F.concat(F.lit("Judge: "), "_q", F.lit("\n"), F.coalesce("text", F.lit(""))))
        judged = N.run_cached(prompts, "prompt", clients["judge"], f"{cache}/judge", tries=1).select("qid", "did", F.expr("try_cast(reply as int)").alias("grade")).where("grade is not null")
        qrels = J.max_merge(own, judged)
    return {"corpus": docs, "queries": queries, "qrels": qrels, "labels": members}


def analogue_collection(problems: DataFrame, collapse_maps: list[DataFrame], merges: DataFrame, least: int = 2, sample: int = 500) -> dict[str, DataFrame]:
    """A collection of problems ``did, text, label`` that share a move: labels collapse, groups merge, members judge each other 2."""
    first = J.dedup(problems, ["did"], [F.col("text")])
    collapsed = J.collapse(first.select("did", "label"), *collapse_maps)
    roots = J.merge_groups(merges)
    grouped = collapsed.join(roots.withColumnRenamed("label", "canonical"), "canonical", "left").select("did", F.coalesce("root", "canonical").alias("label"))
    kept = grouped.join(J.frequent(grouped, ["label"], least).select("label"), "label", "left_semi")
    qrels = J.same_cluster(kept.select("label", F.col("did").alias("member_id")))
    queries = kept.join(first.select("did", "text"), "did").select(F.col("did").alias("qid"), "text", "label")
    return {"corpus": first, "queries": queries, "qrels": qrels, "sample": R.stratified_sample(queries, ["label"], "qid", sample)}


def expand_judgements(runs: dict[str, DataFrame], qrels: DataFrame, docs: DataFrame, queries: DataFrame, client: Callable[[str], str], cache: str, k: int = 10) -> DataFrame:
    """Judgements with those of the pool's unjudged pairs added: pool, take what is judged away, judge, keep positive ones."""
    fresh = U.unjudged(U.pool(U.stack(runs, k), k), qrels)
    prompts = fresh.join(docs, "did").join(queries, "qid").withColumn("prompt", F.concat(F.lit("Judge: "), F.coalesce("query_text", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))))
    judged = N.run_cached(prompts, "prompt", client, cache, tries=1).select("qid", "did", F.expr("try_cast(reply as int)").alias("grade")).where("grade is not null")
    return J.first_wins(qrels, judged)


def rewrite_and_retrieve(queries: DataFrame, client: Callable[[str], str], cache: str, encode: Callable[[DataFrame], DataFrame], corpus: DataFrame, k: int = 1000, excluded: DataFrame | None = None) -> DataFrame:
    """A run of rewritten queries ``qid, query_text``; a failed rewrite leaves the query as it is.  ``encode`` makes ``qid, vec`` of ``qid, text``."""
    told = N.run_cached(queries.withColumn("prompt", F.concat(F.lit("Rewrite: "), F.col("query_text"))), "prompt", client, cache, tries=1)
    text = told.select("qid", F.coalesce(F.when(F.col("status") == "ok", F.col("reply")), F.col("query_text")).alias("text"))
    return D.dense_topk(encode(text), corpus, k, excluded)


def evaluate(run: DataFrame, qrels: DataFrame, groups: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Metrics per query and their means, by group if ``groups`` (qid and group columns) are given."""
    per = M.per_query(run, qrels)
    long = M.long_form(per)
    if groups is None:
        return per, M.means(long)
    by = [c for c in groups.columns if c != "qid"]
    return per, M.means(long.join(groups, "qid", "left").fillna("unknown", by), by)


def guided_hops(queries: DataFrame, docs: DataFrame, client: Callable[[str], str], cache: str, hops: int = 3, per_hop: int = 5, most_chars: int = 400) -> DataFrame:
    """Multi-hop search that a model guides: ``qid, did, rank, hop, selected`` for ``queries`` (qid, query_text) over ``docs`` (did, text).

    After each hop the client sees the query and its new candidates, numbered, and answers ``{"ids": [...], "notes": "..."}``; a reply that cannot be read
    selects all.  From the query and the notes so far it then writes the next search; an empty or failed one leaves the search as it was.
    Texts in prompts are cut to ``most_chars`` characters, as the prompt's format asks.  All queries take a hop together; answers are cached under ``cache``.
    """
    from relevspark.operators import hops as H
    from relevspark.operators import lexical as L
    from relevspark.runtime import cut

    tokens = L.tokens(docs, "did", "text", "did")
    start = queries.select("qid", "query_text", F.coalesce("query_text", F.lit("")).alias("search"), F.lit("").alias("notes"))
    told: dict[int, DataFrame] = {}

    def search(state: DataFrame, _) -> DataFrame:
        return L.bm25(L.tokens(state, "qid", "search", "qid"), tokens)

    def select(found: DataFrame, hop: int) -> DataFrame:
        found = cut(found)
        shown = found.join(docs.select("did", F.left(F.coalesce("text", F.lit("")), F.lit(most_chars)).alias("_t")), "did")
        lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "_t"))), lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), x["_t"])), "\n")
        asked = shown.groupBy("qid").agg(lines.alias("_l")).join(queries.select("qid", "query_text"), "qid").withColumn("prompt", F.concat(F.lit("Select: "), F.coalesce("query_text", F.lit("")), F.lit("\n"), "_l"))
        said = N.run_cached(asked, "prompt", client, f"{cache}/select", "ids array<int>, notes string", tries=1)
        told[hop] = cut(said.select("qid", F.col("parsed.ids").alias("_ids"), F.coalesce("parsed.notes", F.lit("")).alias("_notes")))
        marked = found.join(told[hop], "qid", "left")
        return marked.withColumn("selected", F.coalesce(F.array_contains("_ids", F.col("rank").cast("int")), F.lit(True)))

    def next_query(state: DataFrame, found: DataFrame, hop: int) -> DataFrame:
        noted = state.join(told[hop].select("qid", "_notes"), "qid", "left").withColumn("notes", F.concat_ws("\n", F.nullif("notes", F.lit("")), F.nullif("_notes", F.lit(""))))
        asked = noted.withColumn("prompt", F.concat(F.lit(f"Search {hop + 1}: "), F.coalesce("query_text", F.lit("")), F.lit("\n"), "notes"))
        said = N.run_cached(asked, "prompt", client, f"{cache}/search", tries=1)
        return cut(said.select("qid", "query_text", F.coalesce(F.when(F.col("status") == "ok", F.col("reply")), F.col("search")).alias("search"), "notes"))

    def original(pairs: DataFrame) -> DataFrame:
        return L.bm25(L.tokens(start, "qid", "search", "qid"), tokens).join(pairs, ["qid", "did"], "left_semi")

    return H.multi_hop(start, search, select, next_query, original, hops=hops, per_hop=per_hop)
