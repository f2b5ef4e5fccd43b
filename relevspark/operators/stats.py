"""Descriptions of collections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relevspark.functions import text as T


def corpus_counts(passages: DataFrame, keywords: list[str]) -> DataFrame:
    """``kind, value, n``: passages by congress, type, length class and keyword (one passage may count under several), and distinct hearings, in one pass."""
    p = passages.select("congress", "hearing_id", T.normalize_name("passage_type").alias("type"), T.word_bucket(T.word_count("text")).alias("bucket"), T.mentions_any("text", keywords).alias("found"))
    pair = lambda kind, c: F.array(F.struct(F.lit(kind).alias("kind"), F.coalesce(c.cast("string"), F.lit("unknown")).alias("value")))
    marks = F.concat(pair("congress", F.col("congress")), pair("type", F.col("type")), pair("length", F.col("bucket")), F.transform("found", lambda k: F.struct(F.lit("keyword").alias("kind"), k.alias("value"))))
    counts = p.select(F.explode(marks).alias("m")).groupBy("m.kind", "m.value").agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(p.agg(F.lit("hearings").alias("kind"), F.lit("distinct").alias("value"), F.count_distinct("hearing_id").alias("n")))


def corpus_counts_sql(keywords: list[str], words: str) -> str:
    ks = ", ".join(f"'{k}'" for k in keywords)
    return f"""with p as (select congress, hearing_id, text, lower(trim(regexp_replace(passage_type, '\\s+', ' ', 'g'))) as type, len({words}) as w from passages)
select 'congress' as kind, coalesce(congress::varchar, 'unknown') as value, count(*) as n from p group by all
union all select 'type', coalesce(type, 'unknown'), count(*) from p group by all
union all select 'length', case when w < 100 then '<100' when w < 200 then '100-200' when w < 500 then '200-500' else '500+' end, count(*) from p group by all
union all select 'keyword', k, count(*) from p, (select unnest([{ks}]) as k) where contains(lower(coalesce(text, '')), k) group by all
union all select 'hearings', 'distinct', count(distinct hearing_id) from p"""


def text_profile(df: DataFrame, text_col: str) -> DataFrame:
    """Number of texts, empty ones, and their lengths in characters."""
    n = F.length(F.coalesce(F.col(text_col), F.lit("")))
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum((n == 0).cast("bigint")).alias("n_empty"), F.min(n).alias("min_chars"), F.median(n).alias("median_chars"), F.round(F.avg(n), 6).alias("mean_chars"), F.max(n).alias("max_chars"))


def relevant_counts(qrels: DataFrame) -> DataFrame:
    """Relevant documents per query, and the recall at 10 that they allow."""
    c = qrels.groupBy("qid").agg(F.sum((F.col("grade") >= 1).cast("bigint")).alias("n"))
    return c.agg(F.count(F.lit(1)).alias("n_queries"), F.min("n").alias("least"), F.median("n").alias("median"), F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("most"), F.round(F.least(F.lit(1.0), 10 / F.avg("n")), 6).alias("recall_ceiling_10"))


def rate(df: DataFrame, flag) -> DataFrame:
    """Share of rows for which ``flag`` holds (null counts as not)."""
    return df.agg(F.avg(F.when(flag, 1.0).otherwise(0.0)).alias("rate"))
