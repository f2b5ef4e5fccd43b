"""Paged remote listings and bounded downloads as Spark sources; the transport is a function of the caller."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``fetch(cursor)`` gives rows and the next cursor, or None at the end.
Fetch = Callable[[str | None], tuple[list[dict], str | None]]


def crawl(fetch: Fetch, start: str | None = None, most_pages: int = 100_000, empty_stop: int = 2) -> Iterator[dict]:
    """All rows of a paged listing; it ends without a next cursor, when a cursor repeats, or after ``empty_stop`` empty pages in a row."""
    cursor, seen, empty = start, set(), 0
    for _ in range(most_pages):
        rows, nxt = fetch(cursor)
        yield from rows
        empty = 0 if rows else empty + 1
        if nxt is None or nxt in seen or empty >= empty_stop:
            return
        seen.add(nxt)
        cursor = nxt


def listing(spark: SparkSession, fetchers: dict[str, Fetch], schema: str, key: str) -> DataFrame:
    """Rows of several listings (one task each) with ``source``, the first of each key."""
    from relevspark.operators.judgements import dedup

    names = list(fetchers)
    field_names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name in pdf["source"]:
                rows = [{"source": name, "_at": i} | {f: r.get(f) for f in field_names} for i, r in enumerate(crawl(fetchers[name]))]
                if rows:
                    yield pd.DataFrame(rows)

    parts = spark.createDataFrame([(n,) for n in names], "source string").repartition(max(1, len(names)))
    got = parts.mapInPandas(work, f"source string, _at bigint, {schema}")
    return dedup(got, [key], [F.col("source"), F.col("_at")]).drop("_at")


def download(urls: DataFrame, get: Callable[[str], tuple[int, str, float | None]], url_col: str = "url", tries: int = 4, pause: float = 0.0, fallbacks: list[Callable[[str], str]] | None = None, sleep=time.sleep) -> DataFrame:
    """``<url>, body, status``: each partition loads its addresses in turn, so the number of partitions bounds the load on a host.

    ``get`` gives a status code, the body and the seconds to wait (for code 429).  After a failure the addresses that ``fallbacks`` make are tried; an
    empty body is kept and marked ``empty`` so that it is not asked for again.
    """
    fallbacks = fallbacks or []

    def one(url: str) -> tuple[str | None, str]:
        code = 0
        for u in (url, *(f(url) for f in fallbacks)):
            for k in range(tries):
                code, body, wait = get(u)
                if code == 429:
                    sleep(wait if wait is not None else 2.0**k)
                    continue
                if code == 200:
                    return body, "ok" if body.strip() else "empty"
                break
        return None, f"failed: {code}"

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            got = []
            for u in pdf[url_col]:
                got.append(one(u))
                if pause:
                    sleep(pause)
            yield pd.DataFrame({url_col: pdf[url_col], "body": [g[0] for g in got], "status": [g[1] for g in got]})

    return urls.select(url_col).where(F.col(url_col).isNotNull()).mapInPandas(work, f"{url_col} string, body string, status string")
