"""Building and merging of queries, relevance judgements and exclusions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most names of a block list; a longer one is an error, not cut.
MOST_NAMES = 100_000


def dedup(df: DataFrame, keys: list[str], orders: list[Column]) -> DataFrame:
    """One row of each key: the first in ``orders``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*orders))).where("_n = 1").drop("_n")


def frequent(df: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Keys with at least ``least`` rows, and their numbers."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def max_merge(*sources: DataFrame) -> DataFrame:
    """Judgements ``qid, did, grade`` of several sources; the highest grade holds."""
    out = sources[0].select("qid", "did", "grade")
    for s in sources[1:]:
        out = out.unionByName(s.select("qid", "did", "grade"))
    return out.groupBy("qid", "did").agg(F.max("grade").alias("grade"))


def first_wins(existing: DataFrame, new: DataFrame, positives_only: bool = True) -> DataFrame:
    """Existing judgements, and new ones (positive ones only) for pairs that have none."""
    more = new.where("grade > 0") if positives_only else new
    more = more.select("qid", "did", "grade").join(existing.select("qid", "did"), ["qid", "did"], "left_anti")
    return existing.select("qid", "did", "grade").unionByName(more.groupBy("qid", "did").agg(F.max("grade").alias("grade")))


def collapse(labels: DataFrame, *maps: DataFrame, label: str = "label") -> DataFrame:
    """``labels`` with ``canonical``: each map ``raw, canonical`` in turn; a label that a map lacks stays as it is.

    If a pass has no entry, the result of the passes before holds.
    """
    out = labels.withColumn("canonical", F.col(label))
    for m in maps:
        step = dedup(m.select(F.col("raw").alias("canonical"), F.col("canonical").alias("_next")), ["canonical"], [F.col("_next")])
        out = out.join(step, "canonical", "left").withColumn("canonical", F.coalesce("_next", "canonical")).drop("_next")
    return out.select(*labels.columns, "canonical")


def reconcile(gold: DataFrame, distractors: DataFrame, on_disk: DataFrame, key: str) -> DataFrame:
    """One row ``<key>, track`` of everything on disk: ``gold`` wins over ``distractor``; files in neither list are ``untracked``; listed ones without a file are dropped."""
    tracks = gold.select(key, F.lit("gold").alias("_g")).distinct().join(distractors.select(key, F.lit("distractor").alias("_d")).distinct(), key, "full")
    return on_disk.select(key).distinct().join(tracks, key, "left").select(key, F.coalesce("_g", "_d", F.lit("untracked")).alias("track"))


def same_author(docs: DataFrame, grade: int = 1) -> DataFrame:
    """Judgements ``qid, did, grade`` between documents ``sid, author, post`` of one author and different posts."""
    a = docs.select(F.col("sid").alias("qid"), "author", F.col("post").alias("_p"))
    b = docs.select(F.col("sid").alias("did"), "author", F.col("post").alias("_q"))
    return a.join(b, "author").where((F.col("_p") != F.col("_q")) & (F.col("qid") != F.col("did"))).select("qid", "did", F.lit(grade).alias("grade"))


def same_post(docs: DataFrame) -> DataFrame:
    """Exclusions ``qid, did``: documents of the same author and post, each itself included."""
    a = docs.select(F.col("sid").alias("qid"), "author", "post")
    return a.join(docs.select(F.col("sid").alias("did"), "author", "post"), ["author", "post"]).select("qid", "did")


def same_cluster(members: DataFrame, grade: int = 2) -> DataFrame:
    """Judgements between different members ``label, member_id`` of one cluster."""
    a = members.select("label", F.col("member_id").alias("qid"))
    return a.join(members.select("label", F.col("member_id").alias("did")), "label").where("qid != did").select("qid", "did", F.lit(grade).alias("grade"))


def merge_groups(edges: DataFrame) -> DataFrame:
    """``label, root``: labels joined by merge edges ``a, b`` share the least label of their group (connected components).

    Each round sends the least label along edges and jumps to the label's own label; rounds grow with the logarithm of a group's
    width, and each is written to the checkpoint folder.
    """
    from relevspark.runtime import cut

    both = cut(edges.select(F.col("a").alias("v"), F.col("b").alias("u")).unionAll(edges.select("b", "a")).distinct())
    roots = cut(both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("root")))
    while True:
        near = both.join(roots.select(F.col("v").alias("u"), "root"), "u").groupBy("v").agg(F.min("root").alias("m"))
        step = roots.join(near, "v").select("v", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        jump = step.select(F.col("v").alias("root"), F.col("root").alias("m"))
        step = cut(step.join(jump, "root", "left").select("v", "old", F.least("root", F.coalesce("m", "root")).alias("root")))
        roots = step.select("v", "root")
        if not step.where("old != root").limit(1).count():
            return roots.select(F.col("v").alias("label"), "root")


def solution_of(queries: DataFrame, solutions: DataFrame, contained: bool = False) -> DataFrame:
    """``qid, solution`` by the full composite id, or (``contained``) by the first solution, in order of position, whose key holds the query's id."""
    if not contained:
        return queries.select("qid", F.col("problem_key").alias("key")).join(solutions.select("key", "solution"), "key").select("qid", "solution")
    # every part of a key that is as long as some query's id, so that containment is an equality; there are at most as many lengths as a key has characters
    sizes = queries.where("problem_key <> ''").select(F.length("problem_key").alias("n")).distinct().agg(F.sort_array(F.collect_set("n")).alias("_sizes"))
    parts = F.flatten(F.transform(F.filter("_sizes", lambda n: n <= F.length("key")), lambda n: F.transform(F.sequence(F.lit(1), F.length("key") - n + 1), lambda i: F.substr("key", i, n))))
    held = solutions.where("key is not null").crossJoin(F.broadcast(sizes)).select("solution", "pos", F.explode(F.array_distinct(parts)).alias("problem_key"))
    hits = queries.select("qid", "problem_key").join(held, "problem_key")
    return hits.groupBy("qid").agg(F.min_by("solution", "pos").alias("solution"))


def author_groups(docs: DataFrame) -> DataFrame:
    """``sid, author, post, n_relevant, n_excluded``: membership instead of pairs, with the numbers of documents that ``same_author`` and ``same_post`` would pair each with.

    Groups are counted before they are joined, so a group of any size costs its rows, not their pairs.
    """
    rows = docs.where("author is not null")
    post = rows.groupBy("author", "post").agg(F.count(F.lit(1)).alias("n_excluded"))
    author = rows.where("post is not null").groupBy("author").agg(F.count(F.lit(1)).alias("_n"))
    counted = post.join(author, "author", "left")
    known = F.col("post").isNotNull()
    counts = counted.select(F.col("author").alias("_author"), F.col("post").alias("_post"), F.when(known, F.col("_n") - F.col("n_excluded")).otherwise(0).alias("n_relevant"), F.when(known, F.col("n_excluded")).otherwise(0).alias("n_excluded"))
    same = (F.col("author") == F.col("_author")) & F.col("post").eqNullSafe(F.col("_post"))
    return rows.join(counts, same).select("sid", "author", "post", "n_relevant", "n_excluded")


def blocked(df: DataFrame, columns: list[str], names: DataFrame) -> DataFrame:
    """Rows of ``df`` of which none of the ``columns`` (strings, or lists of them) holds one of the ``names`` (name; a list kept by hand, sent along as one row), case and blanks aside."""
    from relevspark.functions import text as T

    if names.limit(MOST_NAMES + 1).count() > MOST_NAMES:
        raise ValueError("the list of names is larger than what may be sent to every executor")
    lists = [F.col(c) if t.startswith("array") else F.array(c) for c, t in df.dtypes if c in columns]
    stop = names.agg(F.collect_set(T.normalize_name("name")).alias("_stop"))
    held = F.transform(F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in lists)), lambda x: F.coalesce(T.normalize_name(x), F.lit("")))
    return df.crossJoin(F.broadcast(stop)).where(~F.arrays_overlap(held, F.col("_stop"))).drop("_stop")
