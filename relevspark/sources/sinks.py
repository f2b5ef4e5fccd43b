"""Writers of collections, runs, metrics and reports.  Spark commits each write as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, gzip: bool = False) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").option("compression", "gzip" if gzip else "none").text(path)


def collection(df: DataFrame, id_col: str, text_col: str, metadata: list[str] | None = None, title_col: str | None = None) -> DataFrame:
    """Rows ``_id, title, text, metadata`` of a corpus or a table of queries."""
    meta = F.struct(*metadata) if metadata else F.create_map().cast("map<string,string>")
    title = F.coalesce(F.col(title_col).cast("string"), F.lit("")) if title_col else F.lit("")
    return df.select(F.col(id_col).cast("string").alias("_id"), title.alias("title"), F.coalesce(text_col, F.lit("")).alias("text"), meta.alias("metadata"))


def qrels_tsv(qrels: DataFrame, path: str, header: str = "query-id") -> None:
    out = qrels.select(F.col("qid").alias(header), F.col("did").alias("corpus-id"), F.col("grade").alias("score"))
    out.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def monthly(df: DataFrame, time_col: str, path: str) -> None:
    """JSON lines, gzipped, one folder a month."""
    df.withColumn("month", F.date_format(time_col, "yyyy-MM")).write.mode("overwrite").partitionBy("month").option("compression", "gzip").json(path)


def query_summaries(queries: DataFrame, qrels: DataFrame, docs: DataFrame, most: int = 10, chars: int = 200) -> DataFrame:
    """One row a query: counts by grade and its best documents, the highest grade first, texts cut (a report)."""
    counts = qrels.groupBy("qid").agg(F.count(F.lit(1)).alias("n_relevant"), F.sum((F.col("grade") == 2).cast("bigint")).alias("n_score2"), F.sum((F.col("grade") == 1).cast("bigint")).alias("n_score1"))
    # the best are chosen before a text moves
    first = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("grade").desc(), "did"))
    best = qrels.select("qid", "did", "grade").withColumn("_n", first).where(F.col("_n") <= most).join(docs.select("did", F.left("text", F.lit(chars)).alias("text")), "did", "left")
    items = best.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("_n", "grade", "did", "text"))).alias("_i"))
    top = F.transform("_i", lambda x: F.struct(x["grade"].alias("grade"), x["did"].alias("did"), x["text"].alias("text")))
    return queries.join(counts, "qid").join(items, "qid").select(*queries.columns, "n_relevant", "n_score2", "n_score1", top.alias("relevant"))


def results(metrics: DataFrame, run: DataFrame, k: int = 100) -> DataFrame:
    """Per-query results: metrics rounded to 4 digits and the ranked list."""
    ranked = run.where(F.col("rank") <= k).groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "did", "score"))), lambda x: F.struct(x["did"].alias("did"), x["score"].alias("score"))).alias("ranked"))
    return metrics.select(*(F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in metrics.dtypes)).join(ranked, "qid", "left")


def summary(long: DataFrame, model: str, corpus_size: int) -> DataFrame:
    """One row: model, size, number of queries, and a map of mean metrics."""
    m = long.groupBy("metric").agg(F.round(F.avg("value"), 4).alias("v"), F.count(F.lit(1)).alias("n"))
    return m.agg(F.lit(model).alias("model"), F.lit(corpus_size).alias("corpus_size"), F.max("n").alias("n_queries"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "v")))).alias("metrics"))


def report(summary_row: DataFrame) -> str:
    """A plain-text report of a one-row summary."""
    r = summary_row.first()
    lines = [f"model    {r.model}", f"corpus   {r.corpus_size}", f"queries  {r.n_queries}", ""]
    return "\n".join(lines + [f"{k:<14} {v:.4f}" for k, v in sorted(r.metrics.items())])
