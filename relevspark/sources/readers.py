"""Readers of the file formats of retrieval collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORRUPT = "_corrupt"


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line (gzip too); blank lines are skipped, missing fields null, broken lines null with the line in ``_corrupt``."""
    return spark.read.schema(f"{schema}, {CORRUPT} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def jsonl_commented(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines without those that start with ``#``."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.startswith(F.ltrim("value"), F.lit("#")))
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def numbered_jsonl(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """JSON lines of many (gzip) files with ``_row_id``: the running number over files in order of name.

    Numbers within a file come from one pass over counts per file; only the small table of counts is summed on one task.
    """
    lines = spark.read.text(glob).select(F.col("_metadata.file_path").alias("_f"), F.monotonically_increasing_id().alias("_m"), "value").where(F.trim("value") != "")
    from pyspark.sql import Window

    nth = lines.withColumn("_n", F.row_number().over(Window.partitionBy("_f").orderBy("_m")))
    counts = lines.groupBy("_f").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.select("_f", F.coalesce(F.sum("_c").over(Window.orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    rows = nth.join(before, "_f").select((F.col("_o") + F.col("_n") - 1).alias("_row_id"), F.from_json("value", schema).alias("r"))
    return rows.select("_row_id", "r.*")


def csv_track(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A CSV with a header: names and values trimmed, rows without a required value dropped."""
    raw = spark.read.option("header", True).csv(path)
    df = raw.select(*(F.trim(F.col(f"`{c}`")).alias(c.strip().lstrip("﻿")) for c in raw.columns))
    for c in required:
        df = df.where(F.coalesce(F.col(c), F.lit("")) != "")
    return df


def text_files(spark: SparkSession, glob: str, ids_only_digits: bool = False) -> DataFrame:
    """``id, text`` of whole files, the id from the file's name; broken bytes become replacement signs."""
    files = spark.read.format("binaryFile").load(glob)
    df = files.select(F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1).alias("id"), F.trim(F.decode("content", "UTF-8")).alias("text"))
    return df.where(F.col("id").rlike(r"^\d+$")) if ids_only_digits else df


def with_texts(ids: DataFrame, texts: DataFrame, id_col: str) -> DataFrame:
    """``ids`` with ``text``; a missing file is an empty text."""
    return ids.join(texts.withColumnRenamed("id", id_col), id_col, "left").withColumn("text", F.coalesce("text", F.lit("")))


def json_document(spark: SparkSession, path: str, element: str) -> DataFrame:
    """The rows of one JSON document: a list, or the first list among an object's values."""
    whole = spark.read.option("wholetext", True).text(path)
    from relevspark.functions.text import json_list

    return whole.select(F.explode(json_list("value", element)).alias("r")).select("r.*")


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """``qid, did, grade`` of a tab-separated file with 3 columns or the 4 of TREC; headers, comments and blank lines are skipped."""
    parts = spark.read.text(path).where((F.trim("value") != "") & ~F.startswith("value", F.lit("#"))).select(F.split("value", "\t").alias("p")).where(F.size("p") >= 3)
    four = F.size("p") >= 4
    out = parts.select(F.trim(F.col("p")[0]).alias("qid"), F.trim(F.when(four, F.get("p", F.lit(2))).otherwise(F.get("p", F.lit(1)))).alias("did"), F.expr("try_cast(trim(case when size(p) >= 4 then p[3] else p[2] end) as int)").alias("grade"))
    return out.where("grade is not null")


def exclusions(spark: SparkSession, path: str) -> DataFrame:
    """``qid, did`` of a JSON object from queries to lists of documents."""
    whole = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return whole.select(F.explode("m").alias("qid", "_d")).select("qid", F.explode("_d").alias("did")).distinct()


def run_file(spark: SparkSession, path: str, system: str) -> DataFrame:
    """``system, qid, did, score, rank`` of a run with a JSON object a query, in any of its three shapes.

    Hits are pairs (``ranked: [[did, score], ...]``), ids (``ranked_list``) or objects (``ranked``, ``results``, ``hits`` with ``did``, ``tid``, ``corpus_id`` or ``_id``);
    without a score the reverse of the position stands for it.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.parse_json("value").alias("v"))
    get = lambda p, t: F.try_variant_get("v", p, t)
    qid = F.coalesce(get("$.query_id", "string"), get("$.qid", "string"), get("$._id", "string"))
    hits = F.coalesce(get("$.ranked", "array<variant>"), get("$.ranked_list", "array<variant>"), get("$.results", "array<variant>"), get("$.hits", "array<variant>"))
    each = lines.select(qid.alias("qid"), F.size(hits).alias("n"), F.posexplode(hits).alias("pos", "h"))
    inner = lambda p, t: F.try_variant_get("h", p, t)
    did = F.coalesce(inner("$[0]", "string"), inner("$.did", "string"), inner("$.tid", "string"), inner("$.corpus_id", "string"), inner("$._id", "string"), inner("$", "string"))
    score = F.coalesce(inner("$[1]", "double"), inner("$.score", "double"), (F.col("n") - F.col("pos")).cast("double"))
    return each.select(F.lit(system).alias("system"), "qid", did.alias("did"), score.alias("score"), (F.col("pos") + 1).cast("bigint").alias("rank"))


def embeddings(spark: SparkSession, path: str, id_col: str, vec_col: str, out: str = "did") -> DataFrame:
    """``<out>, vec``: vectors are bound to ids, never to positions."""
    return spark.read.parquet(path).select(F.col(id_col).alias(out), F.col(vec_col).cast("array<float>").alias("vec"))


def missing_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """``<key>, side`` of the keys that only one of two tables has."""
    left = a.select(key).distinct().join(b.select(key), key, "left_anti").withColumn("side", F.lit("left_only"))
    return left.unionByName(b.select(key).distinct().join(a.select(key), key, "left_anti").withColumn("side", F.lit("right_only")))


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """Rows of sources with different columns, with ``source``; columns that a source lacks are null."""
    out = None
    for name, df in sources.items():
        part = df.withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def by_number(df: DataFrame, id_col: str) -> DataFrame:
    """Rows in the order of the numbers that their ids are; ids that are no numbers follow in order of text."""
    return df.orderBy(F.expr(f"try_cast(`{id_col}` as bigint)").asc_nulls_last(), F.col(id_col).asc())
