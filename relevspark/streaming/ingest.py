"""Incremental ingest of landed files with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_files(spark: SparkSession, path: str, schema, fmt: str = "parquet", per_trigger: int = 1000) -> DataFrame:
    """A stream of the files under ``path``, new ones as they land."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(fmt).load(path)


def ingest(stream: DataFrame, sink: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None, key: list[str] | None = None) -> None:
    """Run a stream over all files that are there, once each, into the parquet table ``sink``.

    A restart goes on where the checkpoint stands.  A batch is written to its own folder, so a batch that is run again after a
    failure replaces itself; with ``key`` rows that a batch repeats are dropped.
    """

    def write(batch: DataFrame, number: int) -> None:
        out = transform(batch) if transform else batch
        if key:
            out = out.dropDuplicates(key)
        out.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(stream: DataFrame, time_col: str, group: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts per window and group of a stream, with a watermark for late rows."""
    counted = stream.withWatermark(time_col, late).groupBy(F.window(time_col, window).alias("w"), group).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), group, "n")
