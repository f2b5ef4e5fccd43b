"""Queries of building, segmenting, filtering and describing collections, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from relevspark.functions import text as T
from relevspark.operators import dense as D
from relevspark.operators import judgements as J
from relevspark.operators import ranking as R
from relevspark.operators import segment as S
from relevspark.operators import stats as A
from relevspark.plans.retrieval_queries import QRELS, tok
from relevspark.plans.tables import Tables
from relevspark.sources import readers, sinks

KEYWORDS = ["budget", "harbor", "pension", "treaty", "festival"]


# -- tables in the shapes of collections ----------------------------------------------------------------------------------------
def beir_corpus(t: Tables):
    c = sinks.collection(t("documents"), "doc_id", "text", ["source", "lang"], "title")
    return c.select("_id", "title", "text", F.col("metadata.source").alias("source"), F.col("metadata.lang").alias("lang"))


def beir_queries(t: Tables):
    c = sinks.collection(t("queries"), "qid", "query_text", ["theme"])
    return c.select("_id", "text", F.col("metadata.theme").alias("theme"))


def qrels_latest(t: Tables):
    return t.qrels()


def qrels_first(t: Tables):
    return J.dedup(t("qrels"), ["qid", "did"], [F.col("judged_at").asc(), F.col("grade").asc_nulls_last()]).select("qid", "did", "grade")


def grade_max_merge(t: Tables):
    """Late and early judgements as two sources."""
    q = t("qrels").where("grade is not null")
    return J.max_merge(q.where("judged_at < timestamp '2026-01-01'"), q.where("judged_at >= timestamp '2026-01-01'"))


def judged_queries(t: Tables):
    """Queries that have a judgement."""
    return t("queries").join(t.qrels().select("qid").distinct(), "qid", "left_semi").select("qid", "query_text")


def judged_in_corpus(t: Tables):
    return t.qrels().join(t("documents").select(F.col("doc_id").alias("did")), "did", "left_semi")


def _titled(t: Tables):
    """A corpus of titled documents alone."""
    return t("documents").where(T.blank_to_null("title").isNotNull()).select(F.col("doc_id").alias("did"))


def missing_documents(t: Tables):
    """Judged documents that a corpus of titled documents lacks, and the number of pairs on them."""
    return t.qrels().join(_titled(t), "did", "left_anti").groupBy("did").agg(F.count(F.lit(1)).alias("n"))


def unmatched_keys(t: Tables):
    """Keys that only one of vectors and documents has (the check before dense scoring)."""
    return readers.missing_keys(t("embeddings").select(F.col("vec_id").alias("id")), t("documents").select(F.col("doc_id").alias("id")), "id")


def surface_text(t: Tables):
    return t("documents").select("doc_id", T.truncate(T.surface("title", F.coalesce("text", F.lit(""))), 60).alias("surface"))


def id_formats(t: Tables):
    h = t("hearings")
    number = F.regexp_extract("hearing_id", r"(\d+)$", 1)
    return h.select("hearing_id", T.composite_id("congress", "committee", "hearing_title").alias("composite"), T.padded_id("q", number, 7).alias("padded"), T.slug("hearing_id").alias("slug"), F.regexp_extract("hearing_id", r"^CHRG-(\d+)", 1).cast("int").alias("congress_of"))


def hearings_in_range(t: Tables):
    return t("hearings").where(F.regexp_extract("hearing_id", r"^CHRG-(\d+)", 1).cast("int").between(112, 116)).select("hearing_id", "congress")


def framed_queries(t: Tables):
    framed = T.frame("query_text", "Find what shares the move of: <<", ">> and nothing else")
    return t("queries").select("qid", T.instruct(framed, "retrieve").alias("framed"), T.unframe(framed, "<<", ">>").alias("unframed"))


# -- text -----------------------------------------------------------------------------------------------------------------------
def tokenize_ascii(t: Tables):
    return t.doc_tokens().select("did", F.size("tokens").alias("n_tokens"), F.size(F.array_distinct("tokens")).alias("n_terms"), F.md5(F.array_join("tokens", " ")).alias("digest"))


def tokenize_word(t: Tables):
    return t.doc_tokens(T.tokenize_word).select("did", F.size("tokens").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("digest"))


def term_frequencies(t: Tables):
    return t.doc_tokens().select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def word_count_buckets(t: Tables):
    p = t("passages").select(T.word_count("text").alias("n"))
    return p.groupBy(T.word_bucket(F.col("n")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def conversation_format(t: Tables):
    return t("wild_conversations").select("row_id", T.format_conversation("conversation").alias("text"))


def conversation_truncated(t: Tables):
    return t("wild_conversations").select("row_id", T.format_conversation("conversation", 400).alias("text"))


def passage_split(t: Tables):
    return S.split_passages(t("documents"), "doc_id", "text").select("doc_id", "sub", "word_count", F.md5("text").alias("digest"))


def passage_split_counts(t: Tables):
    """Parts and words of each text: no word is lost by splitting."""
    return S.split_passages(t("documents"), "doc_id", "text").groupBy("doc_id").agg(F.sum("word_count").cast("bigint").alias("n_words"))


def text_snippets(t: Tables):
    return S.snippets(t("documents"), "doc_id", "text").select("doc_id", "nth", T.word_count("text").alias("n_words"))


def exchange_ids(t: Tables):
    """Passages of a hearing as its turns, grouped into exchanges."""
    p = J.dedup(t("passages"), ["doc_id"], [F.col("landed_at").desc(), F.col("text").desc()]).where("hearing_id is not null")
    return S.exchanges(p, "hearing_id", "doc_id", "speaker").select("doc_id", "hearing_id", "exchange")


def exchange_types(t: Tables):
    """Type and length of each exchange."""
    p = J.dedup(t("passages"), ["doc_id"], [F.col("landed_at").desc(), F.col("text").desc()]).where("hearing_id is not null")
    x = S.exchanges(p, "hearing_id", "doc_id", "speaker").groupBy("hearing_id", "exchange").agg(F.count(F.lit(1)).alias("n_turns"), F.sum(T.word_count("text")).cast("bigint").alias("n_words"))
    return x.select("*", S.passage_type(F.col("n_turns"), F.col("n_words")).alias("type"))


def long_enough(t: Tables):
    return t("documents").where((F.length(F.trim("text")) >= 100) & (T.word_count("text") >= 50)).select("doc_id")


def junk_themes(t: Tables):
    return t("queries").where(~T.is_junk_theme("theme")).select("qid", "theme")


def keyword_documents(t: Tables):
    return t("documents").select("doc_id", F.array_join(T.mentions_any("text", KEYWORDS), ",").alias("keywords")).where("keywords <> ''")


def blocked_sources(t: Tables):
    """Documents whose normalised source is not on a block list."""
    blocked = t.spark.createDataFrame([("crawl_00",), ("crawl_01",)], "source string")
    return t("documents").withColumn("_s", T.normalize_name("source")).join(blocked.withColumnRenamed("source", "_s"), "_s", "left_anti").select("doc_id", "source")


# -- judgements from clusters and authors -------------------------------------------------------------------------------------------
def _hearing_docs(t: Tables):
    return t("hearings").select(F.col("hearing_id").alias("sid"), F.col("committee").alias("author"), F.col("congress").alias("post"))


def authorship_qrels(t: Tables):
    return J.same_author(_hearing_docs(t))


def authorship_exclusions(t: Tables):
    return J.same_post(_hearing_docs(t))


def frequent_authors(t: Tables):
    return J.frequent(t("documents"), ["source"], 30)


def _themes(t: Tables):
    return t("queries").where("theme is not null").select(F.split("theme", " ")[1].alias("label"), F.col("qid").alias("member_id"))


def cocluster_qrels(t: Tables):
    return J.same_cluster(_themes(t))


def theme_groups(t: Tables):
    """The size of each group and its first three members, as prompts show them; only these are gathered."""
    nth = F.row_number().over(Window.partitionBy("label").orderBy("member_id"))
    first = _themes(t).withColumn("_n", nth).where(F.col("_n") <= 3).groupBy("label").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "member_id"))), lambda x: x["member_id"]), ",").alias("first_members"))
    return _themes(t).groupBy("label").agg(F.count(F.lit(1)).cast("int").alias("n")).join(first, "label").select("label", "n", "first_members")


def collapse_chain(t: Tables):
    """Raw theme, then its first word, then its first letter for the words of one pass."""
    themes = t("queries").where("theme is not null")
    raw = themes.select("qid", F.col("theme").alias("label"))
    one = themes.where("length(theme) % 3 <> 0").select(F.col("theme").alias("raw"), F.split("theme", " ")[0].alias("canonical")).distinct()
    two = themes.select(F.split("theme", " ")[0].alias("w")).where("length(w) % 2 = 0").select(F.col("w").alias("raw"), F.left("w", F.lit(1)).alias("canonical")).distinct()
    return J.collapse(raw, one, two)


def label_merges(t: Tables):
    """Themes that share a word belong to one group."""
    words = t("queries").where("theme is not null").select("theme", F.explode(F.split("theme", " ")).alias("w")).distinct()
    edges = words.groupBy("w").agg(F.min("theme").alias("a")).join(words, "w").where("a <> theme").select("a", F.col("theme").alias("b"))
    return J.merge_groups(edges)


def reconcile_tracks(t: Tables):
    gold = t.qrels().where("grade = 2").select("did")
    other = t.qrels().where("grade < 2").select("did")
    return J.reconcile(gold, other, t("documents").select(F.col("doc_id").alias("did")), "did")


def query_summaries(t: Tables):
    docs = t("documents").select(F.col("doc_id").alias("did"), F.coalesce("text", F.lit("")).alias("text"))
    s = sinks.query_summaries(t("queries").select("qid", "query_text"), t.qrels(), docs)
    return s.select("qid", "n_relevant", "n_score2", "n_score1", F.array_join(F.transform("relevant", lambda x: F.concat(x["grade"].cast("string"), F.lit(":"), x["did"].cast("string"))), ",").alias("top"))


# -- statistics ------------------------------------------------------------------------------------------------------------------------
def corpus_counts(t: Tables):
    return A.corpus_counts(t("passages"), KEYWORDS)


def text_profile(t: Tables):
    return A.text_profile(t("documents"), "text")


def judged_per_query(t: Tables):
    return A.relevant_counts(t.qrels())


def upper_median_relevant(t: Tables):
    from relevspark.operators.metrics import upper_median

    per = t.qrels().where("grade >= 1").groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    themed = per.join(t("queries").select("qid", T.lower_or(F.split("theme", " ")[0], "unknown").alias("theme")), "qid")
    return upper_median(themed, ["theme"], "n")


def coverage_ratio(t: Tables):
    """Share of documents with a title, with a language, and with a judgement."""
    d = t("documents").join(t.qrels().select(F.col("did").alias("doc_id"), F.lit(1).alias("_j")).distinct(), "doc_id", "left")
    one = lambda c, n: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6).alias(n)
    return d.agg(one(T.blank_to_null("title").isNotNull(), "titled"), one(F.col("lang").isNotNull(), "with_lang"), one(F.col("_j").isNotNull(), "judged"))


def month_counts(t: Tables):
    return t("wild_conversations").groupBy(F.date_format("landed_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def time_filter(t: Tables):
    e = t("events").where((F.col("ts") >= F.lit("2024-01-10").cast("timestamp")) & (F.col("ts") < F.lit("2024-01-20").cast("timestamp")) & (F.col("event_type") == "purchase"))
    return e.select("event_id", "ts", "user_id")


def english_conversations(t: Tables):
    w = t("wild_conversations").where((F.col("language") == "English") & (F.col("landed_at") >= F.lit("2025-03-01").cast("timestamp")) & (F.col("landed_at") < F.lit("2025-06-01").cast("timestamp")))
    return w.select("row_id", "conversation_hash")


def earliest_landed(t: Tables):
    """The cursor of a backward crawl: the earliest time of each committee."""
    return t("passages").groupBy("committee").agg(F.min("landed_at").alias("earliest"))


def dedup_latest(t: Tables):
    p = J.dedup(t("passages"), ["doc_id"], [F.col("landed_at").desc(), F.col("text").desc()])
    return p.select("doc_id", "landed_at", F.md5("text").alias("digest"))


def dedup_first(t: Tables):
    d = J.dedup(t("documents").where("text is not null"), ["text"], [F.col("doc_id").asc()])
    return d.select("doc_id")


def distinct_themes(t: Tables):
    return t("queries").where("theme is not null").select("theme").distinct()


def stratified_sample(t: Tables):
    return R.stratified_sample(t("documents").where("lang is not null"), ["lang", "source"], "doc_id", 500).select("doc_id", "lang", "source")


def query_batches(t: Tables):
    b = R.batches(t("queries"), 15, [], [F.col("qid")]).groupBy("batch")
    return b.agg(F.count(F.lit(1)).alias("n"), F.min("qid").alias("first_qid"))


def shuffled_queries(t: Tables):
    w = Window.orderBy(R.shuffle_key("qid"), "qid")  # 120 rows, a fixed table
    return t("queries").select("qid", F.row_number().over(w).cast("bigint").alias("place"))


def hashed_encoder(t: Tables):
    v = D.hashed_vectors(t.query_tokens(), "qid", "tokens", 16)
    return v.select("qid", F.array_join(F.transform("vec", lambda x: x.cast("int").cast("string")), ",").alias("vec"))


def stream_ingest_events(t: Tables):
    """Events by way of a file stream, counted by type."""
    from relevspark.runtime import checkpoint_dir
    from relevspark.streaming.ingest import ingest

    import uuid

    folder = f"{checkpoint_dir(t.spark)}/ingest-{uuid.uuid4().hex}"
    schema = t("events").schema
    stream = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    ingest(stream, f"{folder}/sink", f"{folder}/log", key=["event_id"])
    return t.spark.read.schema(schema).parquet(f"{folder}/sink/batch=*").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        beir_corpus, beir_queries, qrels_latest, qrels_first, grade_max_merge, judged_queries, judged_in_corpus, missing_documents, unmatched_keys, surface_text, id_formats, hearings_in_range, framed_queries,
        tokenize_ascii, tokenize_word, term_frequencies, word_count_buckets, conversation_format, conversation_truncated, passage_split, passage_split_counts, text_snippets, exchange_ids, exchange_types, long_enough, junk_themes, keyword_documents, blocked_sources,
        authorship_qrels, authorship_exclusions, frequent_authors, cocluster_qrels, theme_groups, collapse_chain, label_merges, reconcile_tracks, query_summaries,
        corpus_counts, text_profile, judged_per_query, upper_median_relevant, coverage_ratio, month_counts, time_filter, english_conversations, earliest_landed, dedup_latest, dedup_first, distinct_themes, stratified_sample, query_batches, shuffled_queries, hashed_encoder, stream_ingest_events,
    )
}

# white space of the two engines: Unicode spaces are named in the SQL
_WS = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{000B}]+"


def words_sql(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '{_WS}'), lambda w: w <> '')"


_LATEST = "(select * from (select *, row_number() over (partition by doc_id order by landed_at desc, text desc) as rn from passages) where rn = 1 and hearing_id is not null)"
_ASKS = " or ".join(f"starts_with(lower(trim(speaker)), '{p}')" for p in ("senator", "chairman", "chairwoman", "chairperson", "the chairman", "the chairwoman", "the chair", "representative", "rep"))
_EXCH = f"x as (select *, greatest(sum(coalesce(({_ASKS}), false)::int) over (partition by hearing_id order by doc_id) - 1, 0)::bigint as exchange from {_LATEST})"


def _conversation(most: int) -> str:
    text = "array_to_string(list_transform(list_filter(conversation, lambda m: trim(coalesce(m.content, '')) <> ''), lambda m: '[' || upper(left(trim(coalesce(m.role, 'unknown')), 1)) || lower(substr(trim(coalesce(m.role, 'unknown')), 2)) || ']: ' || trim(m.content)), chr(10) || chr(10))"
    return f"select row_id, case when length(t) > {most} then left(t, {most}) || chr(10) || '[... truncated ...]' else t end as text from (select row_id, {text} as t from wild_conversations)"


SQL = {
    "beir_corpus": "select doc_id::varchar as _id, coalesce(title, '') as title, coalesce(text, '') as text, source, lang from documents",
    "beir_queries": "select qid as _id, coalesce(query_text, '') as text, theme from queries",
    "qrels_latest": f"with {QRELS} select qid, did, grade from gold",
    "qrels_first": "select qid, did, grade from (select *, row_number() over (partition by qid, did order by judged_at, grade nulls last) as rn from qrels) where rn = 1",
    "grade_max_merge": "select qid, did, max(grade) as grade from qrels where grade is not null group by qid, did",
    "judged_queries": f"with {QRELS} select qid, query_text from queries where qid in (select qid from gold)",
    "judged_in_corpus": f"with {QRELS} select did, qid, grade from gold where did in (select doc_id from documents)",
    "missing_documents": f"with {QRELS} select did, count(*) as n from gold where did not in (select doc_id from documents where doc_id is not null and trim(title) <> '') group by did",
    "unmatched_keys": "select distinct vec_id as id, 'left_only' as side from embeddings where vec_id not in (select doc_id from documents) union all select distinct doc_id, 'right_only' from documents where doc_id not in (select vec_id from embeddings)",
    "surface_text": "select doc_id, case when length(s) > 60 then left(s, 60) || '...' else s end as surface from (select doc_id, coalesce(nullif(trim(title), ''), coalesce(text, '')) as s from documents)",
    "id_formats": "select hearing_id, coalesce(congress::varchar, '') || '___' || coalesce(committee, '') || '___' || coalesce(hearing_title, '') as composite, 'q' || lpad(regexp_extract(hearing_id, '(\\d+)$', 1), 7, '0') as padded, translate(hearing_id, '/-.', '___') as slug, regexp_extract(hearing_id, '^CHRG-(\\d+)', 1)::int as congress_of from hearings",
    "hearings_in_range": "select hearing_id, congress from hearings where regexp_extract(hearing_id, '^CHRG-(\\d+)', 1)::int between 112 and 116",
    "framed_queries": "select qid, 'Instruct: retrieve' || chr(10) || 'Query: Find what shares the move of: <<' || query_text || '>> and nothing else' as framed, trim(query_text) as unframed from queries",
    "tokenize_ascii": f"select did, len(t) as n_tokens, len(list_distinct(t)) as n_terms, md5(array_to_string(t, ' ')) as digest from (select doc_id as did, {tok('text')} as t from documents)",
    "tokenize_word": "select did, len(t) as n_tokens, md5(array_to_string(t, ' ')) as digest from (select doc_id as did, list_filter(regexp_extract_all(lower(replace(coalesce(text, ''), 'İ', 'i̇')), '[\\p{L}\\p{Nl}\\p{M}\\p{Nd}\\p{Pc}\\x{200C}\\x{200D}]{2,}'), lambda w: w not in (" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ")) as t from documents)",
    "term_frequencies": f"select term, count(*) as df from (select unnest(list_distinct({tok('text')})) as term from documents) group by term",
    "word_count_buckets": f"select case when n < 100 then '<100' when n < 200 then '100-200' when n < 500 then '200-500' else '500+' end as bucket, count(*) as n from (select len({words_sql('text')}) as n from passages) group by 1",
    "conversation_format": _conversation(10_000),
    "conversation_truncated": _conversation(400),
    "passage_split": f"""with recursive d as (select doc_id, text, len({words_sql('text')}) as n from documents where text is not null),
s as (select doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda w: trim(w) <> '') as s from d where n > 1000),
w as (select doc_id, s, list_transform(s, lambda x: len({words_sql('x')})) as c from s),
r as (select doc_id, 1 as i, 0 as sub, c[1] as n from w where len(s) > 0
      union all select r.doc_id, i + 1, case when r.n > 0 and r.n + c[i + 1] > 500 then sub + 1 else sub end, case when r.n > 0 and r.n + c[i + 1] > 500 then c[i + 1] else r.n + c[i + 1] end from r join w on w.doc_id = r.doc_id where i < len(s)),
p as (select r.doc_id, sub, string_agg(s[i], ' ' order by i) as text from r join w on w.doc_id = r.doc_id group by all union all select doc_id, null, text from d where n <= 1000)
select doc_id, sub, len({words_sql('text')}) as word_count, md5(text) as digest from p""",
    "text_snippets": f"""with recursive d as (select doc_id, list_filter(string_split_regex(text, '\\n\\s*\\n'), lambda w: trim(w) <> '') as s from documents where text is not null),
w as (select doc_id, list_transform(s, lambda x: len({words_sql('x')})) as c from d),
r as (select doc_id, 1 as i, 0 as g, c[1] as n from w where len(c) > 0
      union all select r.doc_id, i + 1, case when r.n > 0 and r.n + c[i + 1] > 850 then g + 1 else g end, case when r.n > 0 and r.n + c[i + 1] > 850 then c[i + 1] else r.n + c[i + 1] end from r join w on w.doc_id = r.doc_id where i < len(c)),
p as (select r.doc_id, g, sum(c[i])::int as n_words from r join w on w.doc_id = r.doc_id group by all having sum(c[i]) between 200 and 850)
select doc_id, nth, n_words from (select doc_id, n_words, row_number() over (partition by doc_id order by g) - 1 as nth from p) where nth < 2""",
    "passage_split_counts": f"select doc_id, sum(len({words_sql('text')}))::bigint as n_words from documents where text is not null group by doc_id",
    "exchange_ids": f"with {_EXCH} select doc_id, hearing_id, exchange from x",
    "exchange_types": f"with {_EXCH}, g as (select hearing_id, exchange, count(*) as n_turns, sum(len({words_sql('text')}))::bigint as n_words from x group by all) select *, case when n_turns = 1 and n_words > 300 then 'opening_statement' when n_turns = 1 then 'procedural' else 'qa_exchange' end as type from g",
    "long_enough": f"select doc_id from documents where length(trim(text)) >= 100 and len({words_sql('text')}) >= 50",
    "junk_themes": "select qid, theme from queries where not (" + " or ".join(f"contains(lower(coalesce(theme, '')), '{p}')" for p in ("insufficient information", "unable to determine", "unspecified", "uncategorized", "no clear", "not enough", "unclear", "general comment", "no implicit", "no stance", "neutral", "miscellaneous", "other", "unknown", "n/a")) + ")",
    "keyword_documents": "select doc_id, k as keywords from (select doc_id, array_to_string(list_filter([" + ", ".join(f"'{k}'" for k in KEYWORDS) + "], lambda k: contains(lower(coalesce(text, '')), k)), ',') as k from documents) where k <> ''",
    "blocked_sources": "select doc_id, source from documents where lower(trim(regexp_replace(source, '\\s+', ' ', 'g'))) not in ('crawl_00', 'crawl_01')",
    "authorship_qrels": "select a.hearing_id as qid, b.hearing_id as did, 1 as grade from hearings a join hearings b on a.committee = b.committee and a.congress <> b.congress and a.hearing_id <> b.hearing_id",
    "authorship_exclusions": "select a.hearing_id as qid, b.hearing_id as did from hearings a join hearings b on a.committee = b.committee and a.congress = b.congress",
    "frequent_authors": "select source, count(*) as n from documents group by source having count(*) >= 30",
    "cocluster_qrels": "with t as (select split_part(theme, ' ', 2) as label, qid from queries where theme is not null) select a.qid, b.qid as did, 2 as grade from t a join t b on a.label = b.label and a.qid <> b.qid",
    "theme_groups": "with t as (select split_part(theme, ' ', 2) as label, list(qid order by qid) as m from queries where theme is not null group by 1) select label, len(m) as n, array_to_string(m[1:3], ',') as first_members from t",
    "collapse_chain": "with a as (select qid, theme as label, case when length(theme) % 3 <> 0 then split_part(theme, ' ', 1) else theme end as c from queries where theme is not null), w as (select distinct split_part(theme, ' ', 1) as w from queries where theme is not null) select qid, label, case when c in (select w from w where length(w) % 2 = 0) then left(c, 1) else c end as canonical from a",
    "label_merges": "with recursive w as (select distinct theme, unnest(string_split(theme, ' ')) as w from queries where theme is not null), e as (select distinct x.theme as a, y.theme as b from w x join w y on x.w = y.w and x.theme <> y.theme), r as (select a as v, a as root from e union select e.b, r.root from r join e on e.a = r.v) select v as label, min(root) as root from r group by v",
    "reconcile_tracks": f"with {QRELS} select doc_id as did, case when doc_id in (select did from gold where grade = 2) then 'gold' when doc_id in (select did from gold where grade < 2) then 'distractor' else 'untracked' end as track from documents",
    "query_summaries": f"with {QRELS} select qid, count(*) as n_relevant, sum((grade = 2)::int)::bigint as n_score2, sum((grade = 1)::int)::bigint as n_score1, array_to_string(list(grade::varchar || ':' || did::varchar order by grade desc, did)[1:10], ',') as top from gold where qid in (select qid from queries) group by qid",
    "corpus_counts": A.corpus_counts_sql(KEYWORDS, words_sql('text')),
    "text_profile": "select count(*) as n, sum((coalesce(text, '') = '')::int)::bigint as n_empty, min(length(coalesce(text, ''))) as min_chars, median(length(coalesce(text, '')))::double as median_chars, round(avg(length(coalesce(text, ''))), 6) as mean_chars, max(length(coalesce(text, ''))) as max_chars from documents",
    "judged_per_query": f"with {QRELS}, c as (select qid, sum((grade >= 1)::int)::bigint as n from gold group by qid) select count(*) as n_queries, min(n) as least, median(n)::double as median, round(avg(n), 6) as mean, max(n) as most, round(least(1.0, 10 / avg(n)), 6) as recall_ceiling_10 from c",
    "upper_median_relevant": f"with {QRELS}, c as (select qid, count(*) as n from gold where grade >= 1 group by qid), t as (select lower(coalesce(split_part(theme, ' ', 1), 'unknown')) as theme, n from c join queries using (qid)) select theme, n as upper_median from (select *, row_number() over (partition by theme order by n) as r, count(*) over (partition by theme) as k from t) where r = k // 2 + 1",
    "coverage_ratio": f"with {QRELS} select round(avg((nullif(trim(title), '') is not null)::int), 6) as titled, round(avg((lang is not null)::int), 6) as with_lang, round(avg((doc_id in (select did from gold))::int), 6) as judged from documents",
    "month_counts": "select strftime(landed_at, '%Y-%m') as month, count(*) as n from wild_conversations group by 1",
    "time_filter": "select event_id, ts, user_id from events where ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-20' and event_type = 'purchase'",
    "english_conversations": "select row_id, conversation_hash from wild_conversations where language = 'English' and landed_at >= timestamp '2025-03-01' and landed_at < timestamp '2025-06-01'",
    "earliest_landed": "select committee, min(landed_at) as earliest from passages group by committee",
    "dedup_latest": "select doc_id, landed_at, md5(text) as digest from (select *, row_number() over (partition by doc_id order by landed_at desc, text desc) as rn from passages) where rn = 1",
    "dedup_first": "select min(doc_id) as doc_id from documents where text is not null group by text",
    "distinct_themes": "select distinct theme from queries where theme is not null",
    "stratified_sample": "with d as (select doc_id, lang, source, count(*) over (partition by lang, source) as n, row_number() over (partition by lang, source order by md5(concat_ws('|', '42', doc_id::varchar)), doc_id) as r, count(*) over () as total from documents where lang is not null) select doc_id, lang, source from d where r <= greatest(1, round_even(n / total * 500, 0)::bigint)",
    "query_batches": "select floor((r - 1) / 15)::bigint as batch, count(*) as n, min(qid) as first_qid from (select qid, row_number() over (order by qid) as r from queries) group by 1",
    "shuffled_queries": "select qid, row_number() over (order by md5(concat_ws('|', '42', qid)), qid) as place from queries",
    "hashed_encoder": f"with t as (select qid, unnest({tok('query_text')}) as term from queries), h as (select qid, list_reduce(list_transform(range(8), lambda i: (strpos('0123456789abcdef', substr(md5(term), i::int + 1, 1)) - 1)::bigint), lambda a, b: a * 16 + b) as h from t), c as (select qid, h % 16 as c, sum(case when (h // 16) % 2 = 0 then 1 else -1 end)::int as v from h group by all) select q.qid, string_agg(coalesce(c.v, 0)::varchar, ',' order by k.k) as vec from (select distinct qid from h) q cross join (select unnest(range(16)) as k) k left join c on c.qid = q.qid and c.c = k.k group by q.qid",
    "stream_ingest_events": "select event_type, count(*) as n from events group by event_type",
}
