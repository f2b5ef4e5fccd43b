"""Filling of fixed-capacity containers by planning over the histogram of lengths.

Best fit decreasing is run over counts: all items of one length are placed together into runs of containers
with equal free space.  The plan is as large as the histogram (at most ``capacity`` lengths), not as the
collection.  Items then take the planned places by a join on their rank within their length.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relevspark.llm import bpe
from relevspark.runtime import cut

#: Least number of parts into which the items of one length are dealt, and documents a part, so that a frequent length is no single task however large the collection is.
SALT, PART = 64, 500_000
#: Rows of the table of containers; it is a setting, not data.
MOST_KINDS = 1000


@dataclass(frozen=True)
class Run:
    """Ranks ``rank .. rank + n - 1`` of ``length`` stand ``each`` in a container from ``first`` on."""

    length: int
    rank: int
    n: int
    each: int
    first: int
    start: int


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """Best fit decreasing over ``{length: count}``; returns the runs and the number of containers.

    Lengths of 0 need no space and stand in the fullest container (one is made if there is none).
    """
    if capacity <= 0:
        raise ValueError("capacity must be positive")
    if any(x < 0 or x > capacity for x in histogram):
        raise ValueError("lengths must lie between 0 and the capacity")
    free: dict[int, list[tuple[int, int]]] = {}
    gaps: list[int] = []
    used = 0
    runs: list[Run] = []

    def give(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in free:
                free[gap] = []
                bisect.insort(gaps, gap)
            free[gap].append((first, n))

    for length in sorted((x for x in histogram if x and histogram[x]), reverse=True):
        rank, left = 0, histogram[length]
        while left:
            k = bisect.bisect_left(gaps, length)
            if k < len(gaps):
                gap = gaps[k]
                first, n = free[gap].pop()
                if not free[gap]:
                    del free[gap], gaps[k]
            else:
                gap, first = capacity, used
                n = -(-left // (gap // length))
                used += n
            each = gap // length
            full = min(n, left // each)
            if full:
                runs.append(Run(length, rank, full * each, each, first, capacity - gap))
                rank, left = rank + full * each, left - full * each
                give(gap - each * length, first, full)
                first, n = first + full, n - full
            if left and n:
                runs.append(Run(length, rank, left, left, first, capacity - gap))
                give(gap - left * length, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            give(gap, first, n)
    if histogram.get(0):
        fullest = free[gaps[0]][0][0] if used and len(gaps) and sum(n for v in free.values() for _, n in v) == used else 0
        used = max(used, 1)
        runs.append(Run(0, 0, histogram[0], histogram[0], fullest, 0))
    return runs, used


def fill(docs: DataFrame, containers: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = bpe.DEFAULT_FOLDER) -> DataFrame:
    """One row ``(container_kind, container_id, <id>, part_no, start, tokens)`` per item and kind of container.

    An item is a text, or, if it alone exceeds the capacity, one of its parts: as many full parts as there are, then
    the rest.  ``start`` is the place of its first token in the text.  Null and empty texts are items of no tokens;
    null ids and repeated rows are items of their own; rows of ``containers`` with a null or non-positive capacity are
    errors.  Other columns are not read.
    """
    rows = containers.select("container_kind", "capacity", "tokenizer").limit(MOST_KINDS + 1).collect()
    if len(rows) > MOST_KINDS:
        raise ValueError("too many kinds of container")
    kinds = [(r.container_kind, r.capacity, r.tokenizer) for r in rows]
    if any(c is None or c <= 0 for _, c, _ in kinds):
        raise ValueError("capacity must be positive")
    key = docs.schema[id_col].dataType.simpleString()
    if not kinds:
        return docs.sparkSession.createDataFrame([], f"container_kind string, container_id bigint, {id_col} {key}, part_no int, start int, tokens int")
    names = sorted({t for _, _, t in kinds})

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [bpe.counter(n, folder) for n in names]
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array([f(t) for t in texts], pa.int32()) for f in counts)], names=["id", "h", *(f"n{k}" for k in range(len(names)))])

    sized = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("h")).mapInArrow(measure, f"id {key}, h bigint, " + ", ".join(f"n{k} int" for k in range(len(names))))
    sized = cut(sized)  # read twice below, encoded once
    salts = max(SALT, -(-sized.count() // PART))
    kind_of = F.array(*(F.struct(F.lit(j).alias("kind"), F.lit(c).alias("capacity"), F.col(f"n{names.index(t)}").alias("n")) for j, (_, c, t) in enumerate(kinds)))
    items = (
        sized.select("id", "h", F.explode(kind_of).alias("k"))
        .select("id", "h", "k.*")
        .withColumn("part_no", F.explode(F.expr("sequence(0, greatest(cast(ceil(n / capacity) as int), 1) - 1)")))
        # the salt spreads the items of one length, and the parts of one text, over many tasks
        .withColumn("salt", F.pmod(F.xxhash64("h", "part_no"), F.lit(salts)).cast("int"))
        .select("id", "salt", "kind", "part_no", (F.col("part_no") * F.col("capacity")).alias("start"), F.expr("least(n - part_no * capacity, capacity)").alias("tokens"))
    )
    cells = items.groupBy("kind", "tokens", "salt").agg(F.count(F.lit(1)).alias("n"))
    cells = cut(cells)  # at most kinds x (capacity + 1) x salts rows
    before = F.sum("n").over(Window.partitionBy("kind", "tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = cells.select("kind", "tokens", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    # at most capacity + 1 rows a kind, however large the collection is
    histogram = cells.groupBy("kind", "tokens").agg(F.sum("n").alias("n")).collect()
    plans = [plan({r.tokens: r.n for r in histogram if r.kind == j}, c)[0] for j, (_, c, _) in enumerate(kinds)]
    table = sorted((j, r.length, r.rank, r.each, r.first) for j, p in enumerate(plans) for r in p)
    place = np.array(table, dtype=np.int64).reshape(-1, 5)

    ranked = items.withColumn("rank", F.row_number().over(Window.partitionBy("kind", "tokens", "salt").orderBy("id", "part_no"))).join(offsets, ["kind", "tokens", "salt"])
    ranked = ranked.select("id", "kind", "part_no", "start", "tokens", (F.col("before") + F.col("rank") - 1).alias("rank"))
    labels = pa.array([k for k, _, _ in kinds], pa.string())

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the plan's rows are sorted by kind, length and rank
        above = 1 + max(c for _, c, _ in kinds)
        group = place[:, 0] * above + place[:, 1]
        for b in batches:
            kind, part, start, tokens, rank = (b.column(k).to_numpy(zero_copy_only=False) for k in range(1, 6))
            at = np.empty(len(kind), np.int64)
            want = kind.astype(np.int64) * above + tokens
            lo, hi = np.searchsorted(group, want, "left"), np.searchsorted(group, want, "right")
            for a, z in {(int(x), int(y)) for x, y in zip(lo, hi)}:
                m = lo == a
                at[m] = a + np.searchsorted(place[a:z, 2], rank[m], "right") - 1
            where = place[at, 4] + (rank - place[at, 2]) // place[at, 3]
            yield pa.RecordBatch.from_arrays([labels.take(pa.array(kind)), pa.array(where, pa.int64()), b.column(0), pa.array(part, pa.int32()), pa.array(start, pa.int32()), pa.array(tokens, pa.int32())], names=["container_kind", "container_id", "id", "part_no", "start", "tokens"])

    out = ranked.mapInArrow(take, f"container_kind string, container_id bigint, id {key}, part_no int, start int, tokens int")
    return out.withColumnRenamed("id", id_col)
