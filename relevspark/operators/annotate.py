"""The contract of calls to a language model: prompt in, parsed rows out, cached by prompt, keyed by our own keys."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relevspark.functions import text as T


class Client(Protocol):
    """Anything that answers a prompt; it must be picklable."""

    def __call__(self, prompt: str) -> str: ...


class Deterministic:
    """A client made of a rule; used where no model is at hand."""

    def __init__(self, rule: Callable[[str], str]):
        self.rule = rule

    def __call__(self, prompt: str) -> str:
        return self.rule(prompt)


def with_retry(client: Client, tries: int = 4, first: float = 2.0, factor: float = 2.0, sleep=time.sleep) -> Callable[[str], tuple[str | None, str]]:
    """Calls ``client`` up to ``tries`` times with growing pauses; gives the reply and ``ok``, ``empty`` or ``failed: ...``."""

    def call(prompt: str) -> tuple[str | None, str]:
        wait, last = first, ""
        for k in range(tries):
            try:
                reply = client(prompt)
                return reply, "ok" if reply and reply.strip() else "empty"
            except Exception as e:  # noqa: BLE001
                last = f"failed: {type(e).__name__}"
                if k + 1 < tries:
                    sleep(wait)
                    wait *= factor
        return None, last

    return call


CACHE_SCHEMA = "h string, reply string, status string"


def pending(df: DataFrame, prompt_col: str, cache: DataFrame | None) -> DataFrame:
    """Distinct prompts ``h, prompt`` without a successful answer in ``cache``; failed ones are asked again, empty ones are not."""
    asked = df.where(F.col(prompt_col).isNotNull()).select(F.sha2(prompt_col, 256).alias("h"), F.col(prompt_col).alias("prompt")).dropDuplicates(["h"])
    return asked if cache is None else asked.join(cache.where("status in ('ok', 'empty')").select("h"), "h", "left_anti")


def ask(prompts: DataFrame, client: Client, tries: int = 4, first: float = 2.0) -> DataFrame:
    """``h, reply, status`` of ``h, prompt``; each partition calls the client in turn, so the partitions bound the concurrency."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = with_retry(client, tries, first)
        for pdf in frames:
            got = [call(p) for p in pdf["prompt"]]
            yield pd.DataFrame({"h": pdf["h"], "reply": [g[0] for g in got], "status": [g[1] for g in got]})

    return prompts.mapInPandas(work, CACHE_SCHEMA)


def annotate(df: DataFrame, prompt_col: str, cache: DataFrame, schema: str | None = None) -> DataFrame:
    """``df`` with ``reply``, ``status`` (``missing`` if never asked) and, with ``schema``, ``parsed`` from the reply's JSON.

    Rows are matched by the prompt's hash, never by an id that a reply repeats.
    """
    best = cache.groupBy("h").agg(F.max_by(F.struct("reply", "status"), F.when(F.col("status") == "ok", 2).when(F.col("status") == "empty", 1).otherwise(0)).alias("_a"))
    out = df.withColumn("h", F.sha2(prompt_col, 256)).join(best, "h", "left").select(*df.columns, F.col("_a.reply").alias("reply"), F.coalesce("_a.status", F.lit("missing")).alias("status"))
    return out if schema is None else out.withColumn("parsed", F.from_json(T.strip_fence("reply"), schema))


def run_cached(df: DataFrame, prompt_col: str, client: Client, cache_path: str, schema: str | None = None, tries: int = 4, first: float = 2.0) -> DataFrame:
    """Ask what the cache table at ``cache_path`` lacks, append it there, and annotate ``df`` from it."""
    from relevspark.streaming.resume import append, read_or_none

    spark = df.sparkSession
    append(ask(pending(df, prompt_col, read_or_none(spark, cache_path)), client, tries, first), cache_path)
    return annotate(df, prompt_col, spark.read.schema(CACHE_SCHEMA).parquet(cache_path), schema)


# -- rules that stand in for models -----------------------------------------------------------------------------------------
def describe(c: str):
    """The first sentence of a text."""
    return F.trim(F.split(F.trim(c), r"(?<=[.!?])\s+")[0])


def canonical_label(c: str):
    """A label without case, marks and double blanks."""
    return T.normalize_name(F.regexp_replace(c, r"[^\p{L}\p{N}\s]", " "))


def judge(score: str, high: float = 0.6, low: float = 0.3):
    """Grades 2, 1 or 0 by two thresholds of a similarity."""
    return F.when(F.col(score) >= high, 2).when(F.col(score) >= low, 1).otherwise(0)


def ask_batched(df: DataFrame, key: str, text: str, client: Client, n: int = 15, intro: str = "", tries: int = 4, first: float = 2.0) -> DataFrame:
    """``<key>, reply, status``: rows are put into prompts of ``n`` numbered texts, and a reply is a JSON list of objects with those numbers as ``n``.

    An answer belongs to the row whose number it names, never to an id that a reply repeats; rows that a reply leaves out are ``missing`` and rows of a
    failed call ``failed: ...``, so that ``todo`` asks for them again.  Which rows share a prompt changes no row's own key.
    """
    kind = df.schema[key].dataType.simpleString()

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = with_retry(client, tries, first)
        for pdf in frames:
            keys, texts = pdf["k"].tolist(), pdf["t"].fillna("").tolist()
            out = []
            for at in range(0, len(keys), n):
                part = texts[at : at + n]
                reply, status = call("\n".join([intro, *(f"[{i}] {t}" for i, t in enumerate(part, 1))]))
                said: dict[int, str] = {}
                try:
                    for x in json.loads(reply or "[]"):
                        said.setdefault(int(x["n"]), json.dumps({k: v for k, v in x.items() if k != "n"}, ensure_ascii=False))
                except (ValueError, KeyError, TypeError):
                    status = "failed: no list"
                for i in range(len(part)):
                    ok = i + 1 in said
                    out.append((keys[at + i], said.get(i + 1), "ok" if ok else status if status.startswith("failed") else "missing"))
            yield pd.DataFrame(out, columns=["k", "reply", "status"])

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(work, f"k {kind}, reply string, status string").withColumnRenamed("k", key)


def sweep(df: DataFrame, key: str, text: str, client: Client, path: str, schema: str, n: int = 15, intro: str = "", rounds: int = 3, first: float = 2.0) -> DataFrame:
    """``<key>, parsed`` of every row that got an answer within ``rounds`` rounds; each round asks what the log at ``path`` lacks."""
    from relevspark.streaming.resume import append, read_or_none, todo

    spark = df.sparkSession
    for _ in range(rounds):
        left = todo(df, read_or_none(spark, path), [key])
        if not left.limit(1).count():
            break
        append(ask_batched(left, key, text, client, n, intro, 1, first), path)
    said = spark.read.parquet(path).where("status = 'ok'").dropDuplicates([key])
    return said.select(key, F.from_json("reply", schema).alias("parsed"))
