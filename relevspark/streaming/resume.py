"""Work that can stop and go on: stages, append-only logs, anti-joins against what is done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None if there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def append(df: DataFrame, path: str) -> None:
    """Append rows; each append is committed as a whole."""
    df.write.mode("append").parquet(path)


def todo(items: DataFrame, done: DataFrame | None, keys: list[str], retry_failed: bool = True) -> DataFrame:
    """Items without a finished row; with ``retry_failed`` rows whose ``status`` is not ``ok`` count as undone."""
    if done is None:
        return items
    if retry_failed and "status" in done.columns:
        done = done.where("status = 'ok'")
    return items.join(done.select(*keys).distinct(), keys, "left_anti")


def stage(spark: SparkSession, path: str, build: Callable[[], DataFrame], fingerprint: str) -> DataFrame:
    """The stored result of a stage if it was built under ``fingerprint``, else build, store and read it.

    The fingerprint is part of the path, so an older result is never mistaken for the present one; the write is committed before the
    stage counts as done.
    """
    at = f"{path}/fp={fingerprint}"
    found = read_or_none(spark, at)
    if found is None:
        build().write.mode("overwrite").parquet(at)
        found = spark.read.parquet(at)
    return found


def cursor(landed: DataFrame | None, column: str):
    """The earliest value of a time column so far (where a backward crawl goes on), or None."""
    return None if landed is None else landed.agg(F.min(column)).first()[0]


def process(items: DataFrame, path: str, keys: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply ``work`` to the items that the log at ``path`` lacks, append its rows, and return the whole log."""
    spark = items.sparkSession
    append(work(todo(items, read_or_none(spark, path), keys)), path)
    return spark.read.parquet(path)


def migrate_keys(log: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """A log whose rows under old keys stand under their new ones: ``names`` is ``old, new``; keys it lacks stay, and a row that is there under the new key already holds."""
    renamed = log.join(names.select(F.col("old").alias(key), "new").dropDuplicates([key]), key, "left").withColumn("_moved", F.col("new").isNotNull()).withColumn(key, F.coalesce("new", key)).drop("new")
    kept = renamed.where(~F.col("_moved"))
    moved = renamed.where("_moved").join(kept.select(key).distinct(), key, "left_anti")
    return kept.unionByName(moved).select(*log.columns)
