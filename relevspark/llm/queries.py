"""Queries over the test tables, one per problem, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from relevspark.runtime import read_table as t


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from relevspark.llm.transcripts import speaker_turns

    return speaker_turns(t(spark, d, "passages"), t(spark, d, "speakers")).select("doc_id", "turn_no", "speaker_id")


def p1_turns(spark: SparkSession, d: str) -> DataFrame:
    """The turns with their cleaned text."""
    from relevspark.llm.transcripts import speaker_turns

    return speaker_turns(t(spark, d, "passages"), t(spark, d, "speakers"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from relevspark.llm.pairs import broken_pairs

    return broken_pairs(t(spark, d, "wild_conversations"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    from relevspark.llm.conversation import records

    return records(t(spark, d, "documents"), t(spark, d, "wild_conversations"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from relevspark.llm import toxic

    keys = ["tbl", "rec_id"]
    return toxic.flagged(toxic.score(_records(spark, d), keys), keys)


def p3_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores and offending offsets of every record."""
    from relevspark.llm import toxic

    return toxic.score(_records(spark, d), ["tbl", "rec_id"])


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates of flagged documents per source."""
    from relevspark.llm import toxic

    return toxic.rates(toxic.score(t(spark, d, "documents"), ["doc_id", "source"]))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from relevspark.llm import neardup

    return neardup.all_pairs(*neardup.near_duplicates(_records(spark, d)))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every record with its class of copies, its group and its number of links."""
    from relevspark.llm import neardup

    return neardup.groups(*neardup.near_duplicates(_records(spark, d)))


def _redacted(spark: SparkSession, d: str) -> DataFrame:
    from relevspark.llm.pii import redact

    return redact(_records(spark, d), t(spark, d, "name_parts"), ["tbl", "rec_id"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from relevspark.llm.pii import occurrences

    return occurrences(_redacted(spark, d), ["tbl", "rec_id"])


def p5_masked(spark: SparkSession, d: str) -> DataFrame:
    """Every record with placeholders, and the places of what was replaced."""
    return _redacted(spark, d)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    from relevspark.llm.encode import encode

    return encode(t(spark, d, "documents"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    from relevspark.llm.fill import fill

    return fill(t(spark, d, "documents"), t(spark, d, "containers"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    from relevspark.llm.stuffing import page_scores

    return page_scores(t(spark, d, "documents")).where("stuffed").select("doc_id")


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    """Words, links and tags, salad and mean information of every page."""
    from relevspark.llm.stuffing import page_scores

    return page_scores(t(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_turns": p1_turns,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_scores": p3_scores,
    "p3_rates": p3_rates,
    "p4_found": p4_found,
    "p4_groups": p4_groups,
    "p5_found": p5_found,
    "p5_masked": p5_masked,
    "p6_ids": p6_ids,
    "p7_fill": p7_fill,
    "p8_found": p8_found,
    "p8_scores": p8_scores,
}
#: All pairs by shared runs of words, by plain counting.
_PAIRS = r"""with r as (select 'documents' as tbl, doc_id as rec_id, coalesce(text, '') as text from documents where doc_id is not null
union all select 'wild_conversations', row_id, coalesce(array_to_string(list_transform(conversation, lambda m: coalesce(m.content, '')), chr(10)), '') from wild_conversations where row_id is not null),
w as (select tbl, rec_id, regexp_extract_all(lower(replace(text, 'İ', 'i̇')), '[\p{L}\p{N}_]+') as w from r),
k as (select tbl, rec_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as runs from w where len(w) >= 50),
e as materialized (select tbl, rec_id, unnest(list_transform(runs, lambda x: hash(x))) as run, len(runs) as n from k),
c as (select a.tbl, a.rec_id as id_a, b.rec_id as id_b, count(*) as shared, any_value(a.n) as na, any_value(b.n) as nb from e a join e b on a.tbl = b.tbl and a.run = b.run and a.rec_id < b.rec_id group by a.tbl, a.rec_id, b.rec_id)
select tbl, id_a, id_b from c where shared >= 0.6 * (na + nb - shared)"""
#: Classes of equal texts, links between their first members, and what links hold together.
_GROUPS = _PAIRS.replace("with r as", "with recursive r as").replace("\nselect tbl, id_a, id_b from c where", ",\np as materialized (select tbl, id_a, id_b from c where") + """),
s as (select tbl, rec_id, min(rec_id) over same as class_id, count(*) over same as n_copies from w where len(w) >= 50 window same as (partition by tbl, array_to_string(w, ' '))),
l as materialized (select p.* from p join s a on a.tbl = p.tbl and a.rec_id = p.id_a and a.class_id = a.rec_id join s b on b.tbl = p.tbl and b.rec_id = p.id_b and b.class_id = b.rec_id),
d as materialized (select tbl, id_a as v, id_b as u from l union all select tbl, id_b, id_a from l),
t as (select tbl, v, v as u from d union select t.tbl, t.v, d.u from t join d on d.tbl = t.tbl and d.v = t.u),
g as (select tbl, v, min(u) as root from t group by tbl, v),
n as (select tbl, v, count(*) as n_links from d group by tbl, v)
select s.tbl, s.rec_id, s.class_id, s.n_copies, coalesce(g.root, s.class_id) as group_id, coalesce(n.n_links, 0) as n_links from s left join g on g.tbl = s.tbl and g.v = s.class_id left join n on n.tbl = s.tbl and n.v = s.class_id"""
ORACLE_SQL: dict[str, str] = {"p4_found": _PAIRS, "p4_groups": _GROUPS}
