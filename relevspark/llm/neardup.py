"""Near-duplicate records by Golay-code fuzzy hashing, with an exact check of every candidate.

A record's words are cut into pieces where the hash of a word is the least of its neighbourhood, so an insertion or a move changes the pieces it touches
and no others.  Each piece has a fingerprint of ``SEGMENTS`` segments of 23 bits (signs of sums over its words); each segment is decoded to the nearest codeword of the
Golay code, and the segment with the least sure bit also to the codeword with that bit turned over, so a piece gives one or two keys of codeword indices and small edits within it
often leave one of them.  By the pigeonhole principle few edits leave most pieces whole: records that share the keys of two pieces are candidates, are compared by
a sketch of their runs of words, and what is left is compared by whole texts, exactly.

Exact copies (the same words in the same order) are one class before all this, so copies never fill a bucket.  A key that more than BUCKET records have
is hot: its records are keyed again by pairs of hot keys, which every candidate has that shares no other key; no candidate is lost by it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relevspark.llm import golay
from relevspark.runtime import cut

SEGMENTS = 3
#: Words on either side among which the hash of the first word of a piece is the least, and most pieces of a record that give keys (those with the least hashes).
REACH, PIECES = 3, 16
#: Runs of words, least number of words of a record, and least similarity (defaults; parameters of the operator).
RUN, LEAST_WORDS, SIMILARITY = 3, 50, 0.6
#: Keys with more records than this are hot; pairs of hot keys with more are compared in blocks of BLOCK records.
BUCKET = 64
BLOCK = 512
#: The share of pairs at the least similarity that the sketch may leave out.  Each of its marks is shared with the probability of the similarity, whatever the kind of edit.
MISS = 1e-3
#: Marks of a sketch: 7 bits each of the least of the record's runs under as many orders.
SKETCH = 28
#: Columns of marks, seven a column, each below a bit that is left free to count those that differ.
PRINT = [f"b{k}" for k in range(SKETCH // 7)]
#: Bits (as a power of two) of the filter that keeps the texts of other records than candidates from moving; it is at most 2**(FILTER - 6) rows whatever the data.
FILTER = 26
_WORD = re.compile(r"\w+")
_MASK = (1 << 64) - 1
#: Odd factors of the sketch's orders; the runs they order are mixed already.
_ODD = np.array([xxhash.xxh3_64_intdigest(f"segment {k}") | 1 for k in range(SKETCH)], np.uint64)


class _Words(dict):
    """64-bit hashes of words and the bits of their fingerprints."""

    def __missing__(self, word: str):
        if len(self) > 400_000:
            self.clear()
        v = self[word] = xxhash.xxh3_64_intdigest(word)
        return v


def _mix(a: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes."""
    a = a ^ (a >> np.uint64(33))
    a = a * np.uint64(0xFF51AFD7ED558CCD)
    a = a ^ (a >> np.uint64(33))
    a = a * np.uint64(0xC4CEB9FE1A85EC53)
    return a ^ (a >> np.uint64(33))


def _code(tbl: str):
    """A number for the name of a table."""
    return (F.crc32(F.coalesce(F.col(tbl), F.lit("")).cast("binary")) - F.lit(1 << 31)).cast("int")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _bits(hashes: np.ndarray) -> np.ndarray:
    """For each word hash the bits of its fingerprint as -1 and 1, shape (n, SEGMENTS * 23)."""
    n = SEGMENTS * golay.BITS
    lanes = -(-n // 64)
    with np.errstate(over="ignore"):
        blocks = np.stack([_mix(hashes + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & _MASK)) for k in range(lanes)], axis=1)
    return (np.unpackbits(blocks.view(np.uint8).reshape(len(hashes), -1), axis=1)[:, :n].astype(np.int8) << 1) - 1


def _starts(h: np.ndarray, at: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Places where a piece starts: the first word of each record and the words whose hash is the least within REACH words."""
    with np.errstate(over="ignore"):
        v = _mix(h + np.uint64(0xA0761D6478BD642F))
    least = np.ones(len(v), bool)
    for d in range(1, REACH + 1):
        apart = owner[d:] != owner[:-d]
        least[d:] &= apart | (v[d:] < v[:-d])
        least[:-d] &= apart | (v[:-d] <= v[d:])
    least[at[:-1]] = True
    return np.flatnonzero(least)


def _piece_codes(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each piece the indices of its SEGMENTS codewords, the segment of its least sure bit and the index of that segment with the bit turned over, in one number."""
    vocabulary, word = np.unique(h, return_inverse=True)
    sign = _bits(vocabulary)
    out = np.empty(len(starts), np.int64)
    stop = np.append(starts[1:], len(h))
    for a in range(0, len(starts), 8192):  # some pieces at a time, so that the gathered signs stay small
        b = min(len(starts), a + 8192)
        sums = np.add.reduceat(sign[word[starts[a] : stop[b - 1]]], starts[a:b] - starts[a], axis=0, dtype=np.int32)
        value = ((sums > 0).reshape(b - a, SEGMENTS, golay.BITS) @ (1 << np.arange(golay.BITS, dtype=np.int32))).astype(np.int32)
        unsure = np.abs(sums).argmin(1)
        segment = unsure // golay.BITS
        own = value[np.arange(b - a), segment]
        other = golay.decode(own ^ (1 << (unsure % golay.BITS)).astype(np.int32)).astype(np.int64)
        codes = golay.decode(value.ravel()).reshape(b - a, SEGMENTS).astype(np.int64)
        out[a:b] = (codes << (12 * np.arange(SEGMENTS))).sum(1) | (segment << 12 * SEGMENTS) | (other << 12 * SEGMENTS + 4)
    return out


def fingerprints(texts: list[str | None], run: int, least_words: int, known: _Words):
    """Of the texts that have enough words: index, text hash, number of distinct runs, codes of the chosen pieces (flat, with the number of pieces of each text) and marks of the sketch (n, columns of PRINT)."""
    index, starts, flat, digest = [], [0], [], []
    for k, t in enumerate(texts):
        w = words_of(t)
        if len(w) >= least_words and len(w) >= run:
            index.append(k)
            flat.extend(w)
            starts.append(len(flat))
            digest.append(xxhash.xxh3_128_digest(" ".join(w)))
    if not index:
        return index, digest, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(PRINT)), np.int64)
    h = np.fromiter(map(known.__getitem__, flat), np.uint64, len(flat))
    at = np.array(starts, np.int64)
    n = len(index)
    owner = np.repeat(np.arange(n), np.diff(at))
    with np.errstate(over="ignore"):
        runs = np.zeros(len(h) - run + 1, np.uint64)
        for j in range(run):
            runs = _mix(runs * np.uint64(3) + h[j : len(h) - run + 1 + j])
        # runs that reach into the next record are dropped
        inside = np.ones(len(runs), bool)
        for j in range(1, run):
            inside[at[1:-1] - j] = False
        r, o = _distinct(runs[inside], owner[: len(runs)][inside])
        distinct = np.bincount(o, minlength=n)
        first = np.concatenate([[0], np.cumsum(distinct)[:-1]])
        least = np.stack([np.minimum.reduceat((r ^ np.uint64(0xD6E8FEB86659FD93 * (s + 1) & _MASK)) * _ODD[s], first) for s in range(SKETCH)], axis=1)
        begin = _starts(h, at, owner)
        codes = _piece_codes(h, begin)
        order, o = _distinct(_mix((codes & ((1 << 12 * SEGMENTS) - 1)).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), owner[begin], places=True)
    pieces = np.bincount(o, minlength=n)
    rank = np.arange(len(o)) - np.repeat(np.concatenate([[0], np.cumsum(pieces)[:-1]]), pieces)
    marks = np.pad((_mix(least) & np.uint64(127)).astype(np.uint8).reshape(n, len(PRINT), 7), ((0, 0), (0, 0), (0, 1))).reshape(n, -1).view(np.int64)
    return index, digest, distinct, codes[order[rank < PIECES]], np.minimum(pieces, PIECES), marks


def _distinct(keys: np.ndarray, owner: np.ndarray, places: bool = False):
    """Keys (or their places) without repeats of one owner, in the order of owner and key, and their owners."""
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    fresh = np.ones(len(k), bool)
    fresh[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    return (order if places else k)[fresh], o[fresh]


def similarity(a: str | None, b: str | None, run: int = RUN) -> float:
    """The share of all distinct runs of words of either text that are in both."""
    x, y = words_of(a), words_of(b)
    s, t = (set(zip(*(w[k:] for k in range(run)))) for w in (x, y))
    both = len(s & t)
    return both / (len(s) + len(t) - both) if both else 0.0


def least_shared(similarity_: float, of: int = SKETCH) -> int:
    """The number of ``of`` marks that two records of this similarity share, but for MISS of them."""
    below = 0.0
    for m in range(of):
        below += math.comb(of, m) * similarity_**m * (1 - similarity_) ** (of - m)
        if below > MISS:
            return m
    return of


def fingerprint_table(records: DataFrame, run: int = RUN, least_words: int = LEAST_WORDS) -> DataFrame:
    """``tbl, rec_id, copy_key, n_runs, b0 ..., pieces`` of the records with enough words and an id."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                index, digest, n_runs, codes, sizes, marks = fingerprints(part.column(2).to_pylist(), run, least_words, known)
                if not index:
                    continue
                take = pa.array(index, pa.int32())
                pieces = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(codes))
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(digest, pa.binary()), pa.array(n_runs, pa.int32()), *(pa.array(marks[:, k]) for k in range(len(PRINT))), pieces], names=["tbl", "rec_id", "copy_key", "n_runs", *PRINT, "pieces"])

    return records.where("rec_id is not null").select("tbl", "rec_id", "text").mapInArrow(work, "tbl string, rec_id bigint, copy_key binary, n_runs int, " + "".join(f"{c} bigint, " for c in PRINT) + "pieces array<bigint>")


def _key_rows(reps: DataFrame) -> DataFrame:
    """``key, t, id, piece``, one row for each key of each piece of the representatives ``t, id, pieces``; the table is part of the key."""
    piece = reps.select("t", "id", F.posexplode("pieces").alias("piece", "p"))
    low = F.lit((1 << 12 * SEGMENTS) - 1)
    codes, segment, other = F.col("p").bitwiseAND(low), F.shiftrightunsigned("p", 12 * SEGMENTS).bitwiseAND(F.lit(15)).cast("int"), F.shiftrightunsigned("p", 12 * SEGMENTS + 4)
    # the codes with that of one segment replaced
    second = codes
    for k in range(SEGMENTS):
        second = F.when(segment == k, codes.bitwiseAND(F.lit(((1 << 12 * SEGMENTS) - 1) ^ (4095 << 12 * k))).bitwiseOR(F.shiftleft(other, 12 * k))).otherwise(second)
    both = F.when(second == codes, F.array(codes)).otherwise(F.array(codes, second))
    rows = piece.select("t", "id", F.col("piece").cast("tinyint").alias("piece"), F.explode(both).alias("c"))
    return rows.select(F.xxhash64("t", "c").alias("key"), "t", "id", "piece")


def _pairs_in_buckets(rows: DataFrame, keys: list[str], similarity_: float, more: tuple[str, ...] = ()) -> DataFrame:
    """Possible pairs of records that share a bucket of at most BUCKET rows ``keys, id, n, b0 ...``, with the columns ``more`` of both."""
    of = ("id", "n", *PRINT, *more)
    members = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*of))).alias("m")).where(F.size("m") > 1)
    a = members.select("t", "m", F.posexplode("m").alias("i", "a"))
    b = a.select("t", "a", F.explode(F.expr("slice(m, i + 2, size(m))")).alias("b"))
    b = b.select("t", *(F.col(f"{x}.{c}").alias(f"{c}_{x}") for x in "ab" for c in of))
    return _possible(b.where("id_a < id_b"), similarity_, more)


def _possible(pairs: DataFrame, similarity_: float, more: tuple[str, ...] = ()) -> DataFrame:
    """Pairs that share enough marks and of which the shorter is long enough to reach the similarity."""

    def differ(k: int):
        x = F.col(f"{PRINT[k]}_a").bitwiseXOR(F.col(f"{PRINT[k]}_b")) + F.lit(0x7F7F7F7F7F7F7F)
        return F.bit_count(x.bitwiseAND(F.lit(0x80808080808080)))

    every = sum((differ(k) for k in range(1, len(PRINT))), differ(0))
    pairs = pairs.where((F.least("n_a", "n_b") >= similarity_ * F.greatest("n_a", "n_b")) & (every <= SKETCH - least_shared(similarity_)))
    return pairs.select("t", "id_a", "id_b", *(f"{c}_{x}" for c in more for x in "ab"))


def _pairs_in_blocks(rows: DataFrame, keys: list[str], on: str = "id", more: tuple[str, ...] = ()) -> DataFrame:
    """Pairs ``id_a < id_b`` within groups of any size ``c``: one side is dealt into blocks, the other sent to each block."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("c") / BLOCK)).cast("int")
    left = rows.select(*keys, F.col(on).alias("id_a"), *(F.col(c).alias(f"{c}_a") for c in more), F.pmod(F.xxhash64(on), blocks).cast("int").alias("_block"))
    right = rows.select(*keys, F.col(on).alias("id_b"), *(F.col(c).alias(f"{c}_b") for c in more), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_block"))
    return left.join(right, [*keys, "_block"]).where("id_a < id_b")


def candidates(reps: DataFrame, similarity_: float = SIMILARITY) -> DataFrame:
    """Distinct pairs ``t, id_a, id_b`` of the representatives ``t, id, n, b0 ..., pieces`` that share the keys of two pieces (of one, if neither has two) and are possible by their sketches."""
    counted = _key_rows(reps).withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("c > 1")
    # most keys belong to one record; the others go back to their records, which get to know their hot keys
    hot = F.col("c") > BUCKET
    held = counted.groupBy("t", "id").agg(
        F.collect_list(F.when(~hot, F.struct("key", "piece"))).alias("keys"),
        F.collect_list(F.when(hot, F.struct("key", "piece"))).alias("hot"),
        F.coalesce(F.bit_or(F.when(hot, F.expr("shiftleft(1L, cast(key & 63 as int))"))), F.lit(0)).alias("mask"),
    )
    held = cut(held.join(reps.select("t", "id", "n", *PRINT, (F.size("pieces") == 1).alias("one")), ["t", "id"]))
    # records of a bucket must share a second piece: of another bucket, or perhaps a hot one
    single = held.select("t", "id", "n", *PRINT, "one", "mask", F.explode("keys").alias("k")).select("*", "k.key", "k.piece").drop("k")
    near = _pairs_in_buckets(single, ["t", "key"], similarity_, ("piece", "mask", "one"))
    alone = (F.col("mask_a").bitwiseAND(F.col("mask_b")) != 0) | (F.col("one_a") & F.col("one_b"))
    near = near.groupBy("t", "id_a", "id_b").agg(F.max(alone).alias("alone"), (F.min("piece_a") < F.max("piece_a")).alias("two")).where("alone or two").select("t", "id_a", "id_b")
    # pairs that share hot keys alone: under each two of them
    two = F.expr("flatten(transform(hot, (x, i) -> transform(filter(slice(hot, i + 2, size(hot)), y -> y.piece != x.piece), y -> xxhash64(least(x.key, y.key), greatest(x.key, y.key)))))")
    twos = F.when(F.col("one"), F.transform("hot", lambda x: x["key"])).otherwise(two)
    many = held.where("size(hot) > 0").select("t", "id", "n", *PRINT, F.explode(F.array_distinct(twos)).alias("key"))
    many = cut(many.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("t", "key"))).where("c > 1"))
    pairs = near.unionAll(_pairs_in_buckets(many.where(F.col("c") <= BUCKET), ["t", "key"], similarity_))
    pairs = pairs.unionAll(_possible(_pairs_in_blocks(many.where(F.col("c") > BUCKET), ["t", "key"], more=("n", *PRINT)), similarity_))
    return pairs.distinct()


def verify(pairs: DataFrame, records: DataFrame, run: int = RUN, similarity_: float = SIMILARITY) -> DataFrame:
    """``tbl, id_a, id_b, similarity`` of the pairs ``t, id_a, id_b`` whose similarity, from the whole texts, is at least ``similarity_``.

    Texts move once, to where the pairs of their record are, and the texts of second records from there to the first.  A filter of bits, of a size that does not
    depend on the data, keeps back most texts of records without a pair; those it lets through find none in the join.
    """
    pairs = cut(pairs)
    place = F.pmod(F.xxhash64("t", "id"), F.lit(1 << FILTER))
    bit = F.expr("shiftleft(1L, cast(_p & 63 as int))")
    ends = pairs.select("t", F.col("id_a").alias("id")).unionAll(pairs.select("t", F.col("id_b").alias("id")))
    bits = ends.select(place.alias("_p")).groupBy(F.shiftright("_p", 6).alias("_w")).agg(F.bit_or(bit).alias("_bits"))
    texts = records.where("rec_id is not null").select(_code("tbl").alias("t"), "tbl", F.col("rec_id").alias("id"), "text")
    texts = texts.withColumn("_p", place).withColumn("_w", F.shiftright("_p", 6)).join(F.broadcast(bits), "_w").where(F.col("_bits").bitwiseAND(bit) != 0)
    texts = texts.select("t", "id", "tbl", "text").repartition("t", "id")
    a = texts.select("t", F.col("id").alias("id_a"), "tbl", F.col("text").alias("text_a"))
    # both sides read the same columns, so that their exchange is one
    b = texts.select("t", F.col("id").alias("id_b"), F.col("tbl").alias("_tbl"), F.col("text").alias("text_b"))
    both = pairs.join(b, ["t", "id_b"]).join(a, ["t", "id_a"]).select("tbl", "id_a", "id_b", "text_a", "text_b", "_tbl")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            value = [similarity(s, t, run) for s, t in zip(x.column(3).to_pylist(), x.column(4).to_pylist())]
            keep = pa.array([k for k, v in enumerate(value) if v >= similarity_], pa.int32())
            yield pa.RecordBatch.from_arrays([*(x.column(i).take(keep) for i in range(3)), pa.array([v for v in value if v >= similarity_], pa.float64())], names=["tbl", "id_a", "id_b", "similarity"])

    return both.mapInArrow(work, "tbl string, id_a bigint, id_b bigint, similarity double")


def near_duplicates(records: DataFrame, run: int = RUN, least_words: int = LEAST_WORDS, similarity_: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Links between different texts and the classes of equal ones, of records ``tbl, rec_id, text``.

    Returns ``links`` (tbl, id_a, id_b, similarity; ids of class representatives, id_a < id_b) and ``classes`` (tbl, rec_id, class_id,
    n_copies: every record with enough words; class_id is the least id of its class).  Null and short texts, and rows with a null id, are in neither; ids are taken to be
    unique within a table, a repeated row is a copy of itself and gives no pair; other columns are not read.
    """
    prints = cut(fingerprint_table(records, run, least_words))
    first = F.min_by(F.struct("rec_id", "n_runs", *PRINT, "pieces"), "rec_id").alias("p")
    by_copy = prints.groupBy("tbl", "copy_key").agg(first)
    reps = cut(by_copy.select(_code("tbl").alias("t"), F.col("p.rec_id").alias("id"), F.col("p.n_runs").alias("n"), *(f"p.{c}" for c in PRINT), "p.pieces"))
    copies = prints.groupBy("tbl", "copy_key").agg(F.min("rec_id").alias("class_id"), F.count(F.lit(1)).alias("n_copies"))
    classes = cut(prints.select("tbl", "rec_id", "copy_key").join(copies, ["tbl", "copy_key"]).select("tbl", "rec_id", "class_id", "n_copies"))
    return cut(verify(candidates(reps, similarity_), records, run, similarity_)), classes


def all_pairs(links: DataFrame, classes: DataFrame) -> DataFrame:
    """Every pair ``tbl, id_a, id_b`` of near-duplicate records: links expanded to all copies, and the copies of each class."""
    several = classes.where("n_copies > 1").select("tbl", "class_id", "rec_id", F.col("n_copies").alias("c")).distinct()
    side = several.select("tbl", "class_id", "rec_id")
    wide = links.select("tbl", "id_a", "id_b").join(side.select("tbl", F.col("class_id").alias("id_a"), F.col("rec_id").alias("_a")), ["tbl", "id_a"], "left").join(side.select("tbl", F.col("class_id").alias("id_b"), F.col("rec_id").alias("_b")), ["tbl", "id_b"], "left")
    a, b = F.coalesce("_a", "id_a"), F.coalesce("_b", "id_b")
    between = wide.select("tbl", F.least(a, b).alias("id_a"), F.greatest(a, b).alias("id_b"))
    within = _pairs_in_blocks(several, ["tbl", "class_id"], "rec_id").select("tbl", "id_a", "id_b")
    return between.unionByName(within)


def groups(links: DataFrame, classes: DataFrame) -> DataFrame:
    """``tbl, rec_id, class_id, n_copies, group_id, n_links`` of every record: the groups are what links hold together.

    Labels fall to the least id along links, and along the labels' own labels, until none changes; each round is written
    to the shared checkpoint folder.
    """
    ends = links.select("tbl", F.col("id_a").alias("v"), F.col("id_b").alias("u")).unionAll(links.select("tbl", F.col("id_b"), F.col("id_a")))
    ends = cut(ends.distinct())
    labels = cut(ends.groupBy("tbl", "v").agg(F.min("u").alias("_m"), F.count(F.lit(1)).alias("n_links")).select("tbl", "v", F.least("v", "_m").alias("label"), "n_links"))
    while True:
        near = ends.join(labels.select("tbl", F.col("v").alias("u"), F.col("label").alias("l")), ["tbl", "u"]).groupBy("tbl", "v").agg(F.min("l").alias("l"))
        step = labels.join(near, ["tbl", "v"]).select("tbl", "v", "n_links", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        jump = step.select("tbl", F.col("v").alias("label"), F.col("label").alias("_next"))
        nxt = cut(step.join(jump, ["tbl", "label"], "left").select("tbl", "v", F.least("label", F.coalesce("_next", "label")).alias("label"), "n_links", "old"))
        changed = nxt.where("label != old").limit(1).count()
        labels = nxt.select("tbl", "v", "label", "n_links")
        if not changed:
            break
    named = labels.select("tbl", F.col("v").alias("class_id"), F.col("label").alias("_g"), "n_links")
    return classes.join(named, ["tbl", "class_id"], "left").select("tbl", "rec_id", "class_id", "n_copies", F.coalesce("_g", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
