"""Session helpers shared by every operator."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the session.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset (local tests) is a
    temporary folder made and set.
    """
    sc = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_KEY, None) or sc.getConf().get(CHECKPOINT_KEY)
    current = sc.getCheckpointDir()
    if current is None:
        if not named and not sc.master.startswith("local"):
            raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="relevspark-"))
    return sc.getCheckpointDir() or named


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and return it with its lineage cut."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
