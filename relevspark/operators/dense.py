"""Dense retrieval: exact nearest vectors and late interaction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relevspark.functions import vector as V
from relevspark.operators.ranking import DIGITS, top_k

#: Queries and documents whose vectors make one block (256 and 2,048 times 3,072 floats are 3 and 25 MB).
QUERY_BLOCK, DOC_BLOCK = 256, 2048


def scores(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """``qid, did, score`` of all pairs by expressions: ``queries`` are ``qid, vec``, ``corpus`` is ``did, vec``.

    For results that hold every pair of a stated set of queries; the nearest alone are found by ``dense_topk``.
    """
    q = queries.select("qid", V.normalize("vec").alias("_q"))
    d = corpus.select("did", V.normalize("vec").alias("_d"))
    return d.crossJoin(q).select("qid", "did", F.round(V.dot("_q", "_d"), DIGITS).alias("score"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix of vectors of length 1; null vectors are zeros."""
    rows = len(column)
    lengths = np.diff(column.offsets.to_numpy())
    width = int(lengths.max()) if rows else 0
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if column.null_count or (lengths != width).any():
        m = np.zeros((rows, width))
        for i, v in enumerate(column.to_pylist()):
            if v is not None:
                m[i, : len(v)] = v
    else:
        m = flat.reshape(rows, width)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)


def _products(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Rounded inner products of rows; a block of null vectors alone has no width and scores 0."""
    if q.shape[1] != d.shape[1]:
        if q.shape[1] and d.shape[1]:
            raise ValueError(f"vectors of {q.shape[1]} and {d.shape[1]} numbers")
        return np.zeros((len(q), len(d)))
    return np.round(q @ d.T, DIGITS)


def _blocks(df: DataFrame, ids: list[str], vec: str, block: int, names: list[str], more: list[str] = ()) -> DataFrame:
    """Rows of ``df`` packed where they are: one row has the ids (and ``more``) of up to ``block`` rows and their vectors as one binary matrix."""
    kinds = {c: df.schema[c].dataType.simpleString() for c in (*ids, *more)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, block):
                part = b.slice(at, block)
                held = pa.RecordBatch.from_arrays([part.column(i) for i in range(part.num_columns)], names=part.schema.names)
                columns = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), held.column(i)) for i in range(len(kinds))]
                vectors = held.column(len(kinds))
                vectors = pa.concat_arrays([vectors])  # a slice has offsets of its own
                yield pa.RecordBatch.from_arrays([*columns, pa.array([_matrix(vectors).tobytes()], pa.binary())], names=names)

    schema = ", ".join([*(f"`{n}` array<{k}>" for n, k in zip(names, kinds.values())), f"`{names[-1]}` binary"])
    return df.select(*kinds, vec).mapInArrow(work, schema)


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int, excluded: DataFrame | None = None, unlike: str | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """``qid, did, score, rank``: the ``k`` nearest documents of each query by cosine, without excluded pairs, and without documents of the query's own ``unlike``.

    A stated set of queries against all rows, in blocks: vectors are packed into matrices where they lie, each block of documents meets each
    block of queries once, and keeps its best ``k`` of every query; only these are ranked.  The pairs excluded of a query travel with it.  Null vectors score 0;
    ties go to the smaller id; a null ``unlike`` is like a null one; vectors of different widths are an error.
    """
    kind, did = queries.schema["qid"].dataType.simpleString(), corpus.schema["did"].dataType.simpleString()
    q = queries.select("qid", "vec", *([unlike] if unlike else []))
    if excluded is None:
        q = q.withColumn("_x", F.array().cast(f"array<{did}>"))
    else:
        q = q.join(excluded.groupBy("qid").agg(F.collect_set("did").alias("_x")), "qid", "left").withColumn("_x", F.coalesce("_x", F.array().cast(f"array<{did}>")))
    tag = [unlike] if unlike else []
    qb = _blocks(q, ["qid"], "vec", block, ["qids", "barred", *(["qtag"] if unlike else []), "qm"], ["_x", *tag])
    db = _blocks(corpus.select("did", "vec", *tag), ["did"], "vec", DOC_BLOCK, ["dids", *(["dtag"] if unlike else []), "dm"], tag)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                dids, qids = r["dids"], r["qids"]
                d, x = np.frombuffer(r["dm"]).reshape(len(dids), -1), np.frombuffer(r["qm"]).reshape(len(qids), -1)
                s = _products(x, d)
                ids = np.array(dids)
                if unlike:
                    s[np.array(r["qtag"], object)[:, None] == np.array(r["dtag"], object)[None, :]] = -np.inf
                for i, barred in enumerate(r["barred"]):
                    if barred:
                        s[i, np.isin(ids, np.array(barred))] = -np.inf
                best = [o[np.isfinite(row[o])] for row in s for o in (np.lexsort((ids, -row))[:k],)]
                at = np.concatenate(best).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([x_ for x_, n in zip(qids, best) for _ in n]).cast(b.schema.field("qids").type.value_type), pa.array(dids).take(pa.array(at)).cast(b.schema.field("dids").type.value_type), pa.array(np.concatenate([row[n] for row, n in zip(s, best)]))], names=["qid", "did", "score"])

    return top_k(db.crossJoin(qb).mapInArrow(work, f"qid {kind}, did {did}, score double"), k)


def dense_topk_blocks(queries: DataFrame, corpus: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """``dense_topk`` with blocks of ``block`` queries."""
    return dense_topk(queries, corpus, k, block=block)


def maxsim(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Late interaction scores ``qid, did, score`` of all documents for a stated set of queries."""
    return _maxsim(queries, corpus, None)


def maxsim_topk(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """The first ``k`` documents by late interaction, with ranks; blocks keep their best ``k`` before anything is shuffled."""
    return top_k(_maxsim(queries, corpus, k), k)


def _maxsim(queries: DataFrame, corpus: DataFrame, k: int | None) -> DataFrame:
    """Late interaction: ``qid, did, score`` by the sum over a query's vectors of the greatest inner product with a document's vectors.

    ``queries`` are ``qid, qtok, vec`` and ``corpus`` is ``did, dtok, vec``, one row a token; vectors are brought to length 1.  The tokens of a text
    are brought together, texts are packed into blocks, and blocks meet as in ``dense_topk``.
    """
    kind, did = queries.schema["qid"].dataType.simpleString(), corpus.schema["did"].dataType.simpleString()

    def packed(df: DataFrame, key: str, tok: str, block: int, names: list[str]) -> DataFrame:
        whole = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(tok, "vec"))).alias("_t")).select(key, F.size("_t").alias("_n"), F.transform("_t", lambda x: x["vec"]).alias("_v"))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, block):
                    ids, sizes, vecs = (b.slice(at, block).column(i) for i in range(3))
                    yield pa.RecordBatch.from_arrays([pa.array([ids.to_pylist()], pa.list_(ids.type)), pa.array([sizes.to_pylist()], pa.list_(pa.int32())), pa.array([_matrix(pa.concat_arrays([vecs.flatten()])).tobytes()], pa.binary())], names=names)

        return whole.mapInArrow(work, f"`{names[0]}` array<{df.schema[key].dataType.simpleString()}>, `{names[1]}` array<int>, `{names[2]}` binary")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                (d, dn), (q, qn) = ((np.frombuffer(r[m]).reshape(sum(r[n]), -1), np.array(r[n])) for m, n in (("dm", "dn"), ("qm", "qn")))
                s = _products(q, d)
                s = np.maximum.reduceat(s, np.cumsum(dn) - dn, axis=1)
                s = np.round(np.add.reduceat(s, np.cumsum(qn) - qn, axis=0), DIGITS)
                ids = np.array(r["dids"])
                best = [np.lexsort((ids, -row))[:k] for row in s]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, n in zip(r["qids"], best) for _ in n]).cast(b.schema.field("qids").type.value_type), pa.array(r["dids"]).take(pa.array(np.concatenate(best))).cast(b.schema.field("dids").type.value_type), pa.array(np.concatenate([row[n] for row, n in zip(s, best)]))], names=["qid", "did", "score"])

    both = packed(corpus, "did", "dtok", DOC_BLOCK // 8, ["dids", "dn", "dm"]).crossJoin(packed(queries, "qid", "qtok", QUERY_BLOCK // 8, ["qids", "qn", "qm"]))
    return both.mapInArrow(work, f"qid {kind}, did {did}, score double")


def hashed_vectors(df: DataFrame, id_col: str, tokens_col: str, size: int = 64) -> DataFrame:
    """A model-free encoder: signed counts of hashed tokens, ``<id>, vec`` of ``size`` numbers."""
    t = df.select(F.col(id_col), F.explode(tokens_col).alias("_t")).select(id_col, F.conv(F.substring(F.md5("_t"), 1, 8), 16, 10).cast("bigint").alias("_h"))
    cells = t.select(id_col, F.pmod("_h", F.lit(size)).alias("_c"), F.when(F.pmod(F.floor(F.col("_h") / size), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("_v")).groupBy(id_col, "_c").agg(F.sum("_v").alias("_v"))
    packed = cells.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("_c", "_v"))).alias("_m"))
    return packed.select(id_col, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.coalesce(F.col("_m")[k.cast("bigint")], F.lit(0.0)).cast("float")).alias("vec"))
