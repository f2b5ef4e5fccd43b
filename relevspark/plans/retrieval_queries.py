"""Queries of retrieval, fusion, evaluation and reranking, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from relevspark.functions import text as T
from relevspark.functions import vector as V
from relevspark.operators import dense as D
from relevspark.operators import fuse as U
from relevspark.operators import hops as H
from relevspark.operators import judgements as J
from relevspark.operators import lexical as L
from relevspark.operators import metrics as M
from relevspark.operators import ranking as R
from relevspark.operators.tournament import by_column, tournament
from relevspark.plans.tables import Tables
from relevspark.runtime import cut


def run_of(t: Tables, flavor: str, tokenizer=T.tokenize_ascii):
    return L.bm25(t.query_tokens(tokenizer), t.doc_tokens(tokenizer), flavor)


# -- SQL pieces -------------------------------------------------------------------------------------------------------------
def tok(c: str) -> str:
    return f"regexp_extract_all(lower(replace(coalesce({c}, ''), 'İ', 'i̇')), '[a-z0-9]{{2,}}')"


def word_tok(c: str) -> str:
    stop = "'a','an','and','are','as','at','be','but','by','for','if','in','into','is','it','no','not','of','on','or','such','that','the','their','then','there','these','they','this','to','was','will','with'"
    words = f"regexp_extract_all(lower(replace(coalesce({c}, ''), 'İ', 'i̇')), '[\\p{{L}}\\p{{Nl}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}\\x{{200C}}\\x{{200D}}]{{2,}}')"
    return f"list_filter({words}, lambda w: w not in ({stop}))"


def bm25_ctes(flavor: str, name: str = "run", tok=tok) -> str:
    idf = "ln(1 + (n - df + 0.5) / (df + 0.5))"
    floor = ""
    if flavor == "okapi":
        idf = "ln(n - df + 0.5) - ln(df + 0.5)"
        floor = f"{name}_i as (select term, case when idf < 0 then 0.25 * (select avg(idf) from {name}_i0) else idf end as idf from {name}_i0),"
    p = name
    return f"""{p}_d as (select doc_id as did, {tok('text')} as tokens from documents where doc_id is not null),
{p}_w as (select qid, term, count(*)::double as qtf from (select qid, unnest({tok('query_text')}) as term from queries where qid is not null) group by all),
{p}_s as (select count(*)::double as n, avg(len(tokens)) as avgdl from {p}_d),
{p}_df as (select term, count(*)::double as df from (select unnest(list_distinct(tokens)) as term from {p}_d) group by all),
{p}_i{'0' if floor else ''} as (select term, {idf} as idf from {p}_df, {p}_s), {floor}
{p}_t as (select did, dl, term, count(*)::double as tf from (select did, len(tokens)::double as dl, unnest(tokens) as term from {p}_d) where term in (select term from {p}_w) group by all),
{name} as (select qid, did, round(sum(qtf * idf * (tf * {2.5 if flavor == 'okapi' else 1.0} / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))), 6) as score from {p}_t join {p}_w using (term) join {p}_i using (term), {p}_s group by qid, did)"""


def ranked(name: str, k: int | None = None) -> str:
    inner = f"select *, row_number() over (partition by qid order by score desc, did) as rank from {name}"
    return f"select * from ({inner}) where rank <= {k}" if k else inner


QRELS = "gold as (select qid, did, grade from (select *, row_number() over (partition by qid, did order by judged_at desc, grade desc nulls last) as rn from qrels) where rn = 1 and grade is not null)"
DOT = "list_inner_product(q.v, d.v)"
VEC = "select vec_id, label, list_transform(embedding, lambda x: x::double / greatest(sqrt(list_inner_product(embedding::double[], embedding::double[])), 1e-9)) as v from embeddings"
DENSE = f"vec as ({VEC}), dense as (select q.vec_id as qid, d.vec_id as did, q.label as ql, d.label as dl, round({DOT}, 6) as score from vec q, vec d where q.vec_id % 100 = 0)"


# -- runs ----------------------------------------------------------------------------------------------------------------------
def bm25_okapi_top100(t: Tables):
    return R.top_k(run_of(t, "okapi"), 100)


def bm25_lucene_top100(t: Tables):
    return R.top_k(run_of(t, "lucene"), 100)


def bm25_lucene_word_top100(t: Tables):
    """The lucene flavor over Unicode words without stop words."""
    return R.top_k(run_of(t, "lucene", T.tokenize_word), 100)


def bm25_excluded(t: Tables):
    return R.top_k(R.exclude(run_of(t, "lucene"), t.qrels()), 50)


def dense_top50(t: Tables):
    return D.dense_topk(t.vector_queries(), t.vectors(), 50)


def dense_top50_blocks(t: Tables):
    """The same with small blocks of queries."""
    return D.dense_topk(t.vector_queries(), t.vectors(), 50, block=7)


def dense_other_label(t: Tables):
    return D.dense_topk(t.vector_queries(), t.vectors(), 20, unlike="label")


def dense_coverage(t: Tables):
    """The nearest documents that are not judged yet: judged are those within the first ten."""
    run = D.dense_topk(t.vector_queries(), t.vectors(), 60)
    return run.where("rank > 10").withColumn("rank", F.col("rank") - 10)


def dense_excluded(t: Tables):
    """The nearest documents without the first three of each query, which travel with it as pairs to exclude."""
    near = D.dense_topk(t.vector_queries(), t.vectors(), 3)
    return D.dense_topk(t.vector_queries(), t.vectors(), 20, near.select("qid", "did"))


def maxsim_top20(t: Tables):
    """Each five vectors in a row are the tokens of one text."""
    toks = t.vectors().select(F.floor(F.col("did") / 5).alias("did"), (F.col("did") % 5).alias("dtok"), "vec")
    q = toks.where("did % 20 = 0").select(F.col("did").alias("qid"), F.col("dtok").alias("qtok"), "vec")
    return D.maxsim_topk(q, toks, 20)


def rescored_subset(t: Tables):
    """The BM25 pool's vectors again under another query: inner products of pairs within a label, for stated queries."""
    q, d = t.vector_queries(), t.vectors()
    pairs = q.select("qid", F.col("vec").alias("a"), "label").join(d.select("did", F.col("vec").alias("b"), "label"), "label")
    return pairs.select("qid", "did", F.round(V.cosine("a", "b"), 6).alias("score"))


# -- fusion -------------------------------------------------------------------------------------------------------------------
def _stacked(t: Tables):
    return U.stack({"okapi": run_of(t, "okapi"), "lucene": run_of(t, "lucene")}, {"okapi": 20, "lucene": 30})


STACKED = f"""{bm25_ctes('okapi', 'okapi')}, {bm25_ctes('lucene', 'lucene')},
stacked as (select 'okapi' as system, 0 as prio, qid, did, score, rank from ({ranked('okapi', 20)}) union all select 'lucene', 1, qid, did, score, rank from ({ranked('lucene', 30)})),
merged as (select qid, did, min(prio * 1000 + rank) as f, string_agg(system || '=' || printf('%.6f', score), ';' order by system) as scores, arg_min(score, prio * 1000 + rank) as first_score from stacked group by qid, did),
candidates as (select qid, did, row_number() over (partition by qid order by f, did) as pos, scores, first_score from merged)"""


def union_candidates(t: Tables):
    c = U.union_candidates(_stacked(t))
    pairs = F.transform(F.map_entries("scores"), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.6f", e["value"])))
    return c.select("qid", "did", "pos", F.array_join(pairs, ";").alias("scores"))


def first_scores(t: Tables):
    return U.first_scores(_stacked(t))


def gold_inject(t: Tables):
    return U.inject(U.union_candidates(_stacked(t)), t.qrels())


def gold_inject_math(t: Tables):
    return U.inject(U.union_candidates(_stacked(t)), t.qrels(), gold_first_removed=True)


def injected_counts(t: Tables):
    return gold_inject(t).groupBy("qid").agg(F.count(F.lit(1)).alias("n_candidates"), F.sum(F.col("injected").cast("bigint")).alias("n_injected"))


INJECTED = f"""missing as (select distinct qid, did from gold where qid in (select qid from candidates) and (qid, did) not in (select (qid, did) from candidates)),
injected as (select qid, did, row_number() over (partition by qid order by pos, did) as pos, injected from (select qid, did, pos, false as injected from candidates union all select qid, did, 1::bigint << 40, true from missing))"""
INJECTED_MATH = f"""kept as (select qid, did, pos from candidates where (qid, did) not in (select (qid, did) from gold)), add_ as (select distinct qid, did from gold where qid in (select qid from candidates)),
injected as (select qid, did, row_number() over (partition by qid order by pos, did) as pos, injected from (select qid, did, pos, false as injected from kept union all select qid, did, 1::bigint << 40, true from add_))"""


def rank_to_score(t: Tables):
    """A ranked list (the okapi top ten) over the pool of candidates."""
    c = U.union_candidates(_stacked(t)).select("qid", "did", "pos")
    return R.position_scores(R.top_k(run_of(t, "okapi"), 10), c)


def pool_topk(t: Tables):
    return U.pool(_stacked(t), 10)


def pool_unjudged(t: Tables):
    return U.unjudged(U.pool(_stacked(t), 10), t.qrels())


def _judged_pool(t: Tables):
    """A stand-in for a judge: grades by the okapi score."""
    run = run_of(t, "okapi").withColumn("grade", F.when(F.col("score") >= 30, 2).when(F.col("score") >= 15, 1).otherwise(0))
    return U.unjudged(U.pool(_stacked(t), 10), t.qrels()).join(run, ["qid", "did"]).select("qid", "did", "grade")


def qrels_pooled(t: Tables):
    return J.first_wins(t.qrels(), _judged_pool(t))


# -- evaluation -----------------------------------------------------------------------------------------------------------------
def _metrics(t: Tables):
    return M.per_query(R.top_k(run_of(t, "lucene"), 1000), t.qrels())


def metrics_per_query(t: Tables):
    m = _metrics(t)
    return m.select(*(F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in m.dtypes))


def _gain(g: str, r: str) -> str:
    return f"greatest({g}, 0) / log2({r} + 1)"


METRICS = f"""{bm25_ctes('lucene', 'lucene')}, {QRELS}, r as ({ranked('lucene', 1000)}),
best as (select *, row_number() over (partition by qid order by grade desc, did) as r from gold),
ideal as (select qid, sum((grade >= 1)::int)::bigint as n_relevant, count(*) as n_judged, {', '.join(f"sum(case when r <= {k} then {_gain('grade', 'r')} end) as i{k}" for k in M.CUTS)} from best group by qid),
hit as (select r.qid, r.did, rank, grade, sum((grade >= 1)::int) over (partition by r.qid order by rank) as nth from r join gold g on r.qid = g.qid and r.did = g.did),
got as (select qid, min(case when grade >= 1 then rank end) as best_rank, sum(case when grade >= 1 then nth / rank end) as ap, {', '.join(f"sum(case when rank <= {k} then {_gain('grade', 'rank')} end) as d{k}, sum((grade >= 1 and rank <= {k})::int) as h{k}" for k in M.CUTS)} from hit group by qid),
m as (select qid, n_relevant, n_judged, best_rank, round(coalesce(1.0::double / best_rank, 0), 6) as mrr, round(coalesce(ap / nullif(n_relevant, 0), 0), 6) as map,
{', '.join(f"round(coalesce(d{k} / nullif(i{k}, 0), 0), 6) as ndcg_{k}" for k in M.CUTS)}, {', '.join(f"round(coalesce(h{k}::double / nullif(n_relevant, 0), 0), 6) as recall_{k}" for k in M.CUTS)},
{', '.join(f"case when best_rank <= {k} then 1.0::double else 0.0::double end as success_{k}" for k in (1, 5, 10))} from (select distinct qid from r) join ideal using (qid) left join got using (qid))"""
NAMES = ["mrr", "map", *(f"ndcg_{k}" for k in M.CUTS), *(f"recall_{k}" for k in M.CUTS), *(f"success_{k}" for k in (1, 5, 10))]
LONG = "long as (" + " union all ".join(f"select qid, '{n}' as metric, {n} as value from m" for n in NAMES) + ")"


def _rounded(df):
    """Doubles at 5 digits; the small addend keeps halves, which come up in means of rounded values, from falling either way."""
    return df.select(*(F.round(F.col(c) + 1e-9, 5).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


def metrics_mean(t: Tables):
    return _rounded(M.means(M.long_form(metrics_per_query(t))))


def metrics_by_theme(t: Tables):
    theme = t("queries").select("qid", T.lower_or(F.split("theme", " ")[0], "unknown").alias("theme"))
    return _rounded(M.means(M.long_form(metrics_per_query(t)).join(theme, "qid"), ["theme"]))


STATS = "count(*) as n, round(avg(value) + 1e-9, 5) as mean, round(median(value) + 1e-9, 5) as median, round(stddev_pop(value) + 1e-9, 5) as std"


def best_rank_histogram(t: Tables):
    return M.best_rank_histogram(_metrics(t))


def mrr_grade2(t: Tables):
    m = M.mrr_at_grade(R.top_k(run_of(t, "lucene"), 1000), t.qrels())
    return m.select("qid", F.round("mrr", 6).alias("mrr"))


# -- reranking ------------------------------------------------------------------------------------------------------------------
def _pool(t: Tables):
    c = U.union_candidates(_stacked(t)).select("qid", "did", "pos")
    # the stand-in for a judge's taste: an order by hash
    return cut(c.withColumn("taste", F.md5(F.concat_ws("|", F.lit("taste"), "qid", F.col("did").cast("string")))))


def tournament_single(t: Tables):
    return tournament(_pool(t), by_column("taste", "did"), batch=8, keep=2, max_final=None)


def tournament_recursive(t: Tables):
    return tournament(_pool(t), by_column("taste", "did"), batch=6, keep=2, max_final=5)


def _md5(*parts: str) -> str:
    return "md5(concat_ws('|', " + ", ".join(parts) + "))"


def tournament_sql(batch: int, keep: int, final: int | None, levels: int = 6) -> str:
    """The levels written out one after another."""
    out = [STACKED, f"p0 as (select qid, did, {_md5(chr(39) + 'taste' + chr(39), 'qid', 'did::varchar')} as taste from candidates)"]
    parts = []
    limit = batch if final is None else final
    for d in range(levels):
        one = final is None and d > 0
        out.append(f"c{d} as (select *, count(*) over (partition by qid) as n from p{d})")
        small = "true" if one else f"n <= {limit}"
        out.append(f"f{d} as (select qid, did, 1 as is_final, {d} as depth, row_number() over (partition by qid order by taste, did) as place, 0 as batch from c{d} where {small})")
        parts.append(f"select * from f{d}")
        if one:
            break
        deal = _md5("'42'", "qid", "did::varchar", f"'{d}'")
        out.append(f"a{d} as (select qid, did, taste, floor((row_number() over (partition by qid order by {deal}, did) - 1) / {batch}) as batch from c{d} where not ({small}))")
        out.append(f"b{d} as (select *, row_number() over (partition by qid, batch order by taste, did) as place from a{d})")
        out.append(f"p{d + 1} as (select qid, did, taste from b{d} where place <= {keep})")
        parts.append(f"select qid, did, 0, {d}, place, batch from b{d} where place > {keep}")
    return f"with {', '.join(out)}, e as ({' union all '.join(parts)}) select qid, did, row_number() over (partition by qid order by is_final desc, depth desc, place, batch, did) as rank from e"


def multihop_ranked(t: Tables):
    """Three hops of five unseen vectors; the next query is the sum of the query and its best new vector."""
    docs, queries = t.vectors(), t.vector_queries().select("qid", "vec")

    def search(state, barred):
        # as many as a hop takes; documents seen before do not count
        return D.dense_topk(state, docs, 5, barred)

    def select(found, hop):
        return found.withColumn("selected", (F.col("rank") <= 2))

    def next_query(state, found, hop):
        best = R.top_k(found.select("qid", "did", "score"), 1).join(docs.select("did", F.col("vec").alias("_v")), "did")
        return cut(state.join(best.select("qid", "_v"), "qid").select("qid", F.zip_with("vec", "_v", lambda a, b: (a.cast("double") + b.cast("double"))).alias("vec")))

    def original(pairs):
        q = queries.select("qid", V.normalize("vec").alias("a"))
        return pairs.join(q, "qid").join(docs.select("did", V.normalize("vec").alias("b")), "did").select("qid", "did", F.round(V.dot("a", "b"), 6).alias("score"))

    return H.multi_hop(queries, search, select, next_query, original, hops=3, per_hop=5)


def multihop_sql(hops: int = 3, per: int = 5) -> str:
    norm = "list_transform({0}, lambda x: x / greatest(sqrt(list_inner_product({0}, {0})), 1e-9))"
    out = [f"vec as ({VEC})", "raw as (select vec_id, embedding::double[] as e from embeddings)", "s1 as (select vec_id as qid, e as v from raw where vec_id % 100 = 0)"]
    seen = []
    for h in range(1, hops + 1):
        barred = " and ".join(f"not exists (select 1 from h{j} x where x.qid = q.qid and x.did = d.vec_id)" for j in seen) or "true"
        out.append(f"r{h} as (select q.qid, d.vec_id as did, round(list_inner_product({norm.format('q.v')}, d.v), 6) as score from s{h} q, vec d where {barred})")
        out.append(f"h{h} as (select qid, did, score, rank <= 2 as selected, {h} as hop from (select *, row_number() over (partition by qid order by score desc, did) as rank from r{h}) where rank <= {per})")
        if h < hops:
            out.append(f"s{h + 1} as (select s.qid, list_transform(list_zip(s.v, w.e), lambda z: z[1] + z[2]) as v from s{h} s join (select qid, did from (select *, row_number() over (partition by qid order by score desc, did) as r from h{h}) where r = 1) b on b.qid = s.qid join raw w on w.vec_id = b.did)")
        seen.append(h)
    allh = " union all ".join(f"select * from h{h}" for h in seen)
    return f"with {', '.join(out)}, a as ({allh}), o as (select a.*, round(list_inner_product(q.v, d.v), 6) as os from a join vec q on q.vec_id = a.qid join vec d on d.vec_id = a.did) select qid, did, row_number() over (partition by qid order by selected desc, os desc, did) as rank, hop, selected from o"


QUERIES = {f.__name__: f for f in (bm25_okapi_top100, bm25_lucene_top100, bm25_lucene_word_top100, bm25_excluded, dense_top50, dense_top50_blocks, dense_other_label, dense_coverage, dense_excluded, maxsim_top20, rescored_subset, union_candidates, first_scores, gold_inject, gold_inject_math, injected_counts, rank_to_score, pool_topk, pool_unjudged, qrels_pooled, metrics_per_query, metrics_mean, metrics_by_theme, best_rank_histogram, mrr_grade2, tournament_single, tournament_recursive, multihop_ranked)}

_POOL = "pooled as (select distinct qid, did from stacked where rank <= 10)"
_UNJ = "unj as (select * from pooled where (qid, did) not in (select (qid, did) from gold))"
SQL = {
    "bm25_okapi_top100": f"with {bm25_ctes('okapi')} {ranked('run', 100)}",
    "bm25_lucene_top100": f"with {bm25_ctes('lucene')} {ranked('run', 100)}",
    "bm25_lucene_word_top100": f"with {bm25_ctes('lucene', tok=word_tok)} {ranked('run', 100)}",
    "bm25_excluded": f"with {bm25_ctes('lucene')}, {QRELS}, x as (select * from run where (qid, did) not in (select (qid, did) from gold)) {ranked('x', 50)}",
    "dense_top50": f"with {DENSE}, x as (select qid, did, score from dense) {ranked('x', 50)}",
    "dense_top50_blocks": f"with {DENSE}, x as (select qid, did, score from dense) {ranked('x', 50)}",
    "dense_other_label": f"with {DENSE}, x as (select qid, did, score from dense where ql <> dl) {ranked('x', 20)}",
    "dense_coverage": f"with {DENSE}, x as (select qid, did, score from (select *, row_number() over (partition by qid order by score desc, did) as r from dense) where r > 10) {ranked('x', 50)}",
    "dense_excluded": f"with {DENSE}, x as (select qid, did, score from (select *, row_number() over (partition by qid order by score desc, did) as r from dense) where r > 3) {ranked('x', 20)}",
    "maxsim_top20": f"with vec as ({VEC}), tk as (select vec_id // 5 as did, vec_id % 5 as tok, v from vec), p as (select q.did as qid, q.tok as qtok, d.did as did, max(round({DOT}, 6)) as s from tk q, tk d where q.did % 20 = 0 group by all), x as (select qid, did, round(sum(s), 6) as score from p group by all) {ranked('x', 20)}",
    "rescored_subset": f"with {DENSE} select qid, did, score from dense where ql = dl",
    "union_candidates": f"with {STACKED} select qid, did, pos, scores from candidates",
    "first_scores": f"with {STACKED} select qid, did, first_score as score from candidates",
    "gold_inject": f"with {STACKED}, {QRELS}, {INJECTED} select * from injected",
    "gold_inject_math": f"with {STACKED}, {QRELS}, {INJECTED_MATH} select * from injected",
    "injected_counts": f"with {STACKED}, {QRELS}, {INJECTED} select qid, count(*) as n_candidates, sum(injected::int)::bigint as n_injected from injected group by qid",
    "rank_to_score": f"with {STACKED}, r as ({ranked('okapi', 10)}) select qid, did, count(*) over (partition by qid) - row_number() over (partition by qid order by rank nulls last, pos nulls last, did) + 1 as score from candidates full join (select qid, did, rank from r) using (qid, did)",
    "pool_topk": f"with {STACKED}, {_POOL} select * from pooled",
    "pool_unjudged": f"with {STACKED}, {QRELS}, {_POOL}, {_UNJ} select * from unj",
    "qrels_pooled": f"with {STACKED.replace('stacked as (', 'stacked as materialized (').replace('okapi as (', 'okapi as materialized (')}, {QRELS}, {_POOL}, u as materialized (select qid, did from pooled except select qid, did from gold), j as (select qid, did, case when score >= 30 then 2 when score >= 15 then 1 else 0 end as grade from okapi semi join u using (qid, did)) select qid, did, grade from gold union all select qid, did, grade from j where grade > 0",
    "metrics_per_query": f"with {METRICS} select * from m",
    "metrics_mean": f"with {METRICS}, {LONG} select metric, {STATS} from long group by metric",
    "metrics_by_theme": f"with {METRICS}, {LONG} select theme, metric, {STATS} from long join (select qid, lower(coalesce(split_part(theme, ' ', 1), 'unknown')) as theme from queries) using (qid) group by theme, metric",
    "best_rank_histogram": f"with {METRICS} select threshold, sum(coalesce((best_rank <= threshold)::int, 0))::bigint as n_queries from m, (select unnest([1, 5, 10, 50, 100]) as threshold) group by threshold",
    "mrr_grade2": f"with {bm25_ctes('lucene', 'lucene')}, {QRELS}, r as ({ranked('lucene', 1000)}), g as (select * from gold where grade >= 2) select qid, round(coalesce(1.0::double / min(rank), 0), 6) as mrr from (select distinct g.qid from g where g.qid in (select qid from r)) left join (select r.qid, rank from r join g on r.qid = g.qid and r.did = g.did) using (qid) group by qid",
    "tournament_single": tournament_sql(8, 2, None),
    "tournament_recursive": tournament_sql(6, 2, 5),
    "multihop_ranked": multihop_sql(),
}
