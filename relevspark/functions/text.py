"""Text functions as Column expressions; none of them leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English stop words of the word tokeniser.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with"]
#: Parts of a theme that make it useless, in any case.
JUNK_THEMES = ["insufficient information", "unable to determine", "unspecified", "uncategorized", "no clear", "not enough", "unclear", "general comment", "no implicit", "no stance", "neutral", "miscellaneous", "other", "unknown", "n/a"]


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokenize_ascii(c: str | Column) -> Column:
    """Lower-case runs of at least two ASCII letters or digits."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit("[a-z0-9]{2,}"), F.lit(0))


def tokenize_word(c: str | Column, stop_words: list[str] | None = None) -> Column:
    """Lower-case Unicode words of at least two characters without stop words."""
    tokens = F.regexp_extract_all(F.lower(col(c)), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    stop = F.array(*(F.lit(w) for w in (STOP_WORDS if stop_words is None else stop_words)))
    return F.filter(tokens, lambda t: ~F.array_contains(stop, t))


def words(c: str | Column) -> Column:
    """Runs of characters other than Unicode white space."""
    return F.filter(F.split(col(c), r"(?U)\s+"), lambda w: w != "")


def word_count(c: str | Column) -> Column:
    return F.size(words(c))


def word_bucket(n: Column) -> Column:
    """Length class of a passage of ``n`` words."""
    return F.when(n < 100, "<100").when(n < 200, "100-200").when(n < 500, "200-500").otherwise("500+")


def truncate(c: str | Column, n: int, mark: str = "...") -> Column:
    """The first ``n`` characters and ``mark`` if there are more."""
    return F.when(F.length(col(c)) > n, F.concat(F.left(col(c), F.lit(n)), F.lit(mark))).otherwise(col(c))


def blank_to_null(c: str | Column) -> Column:
    return F.nullif(F.trim(col(c)), F.lit(""))


def surface(preferred: str | Column, fallback: str | Column) -> Column:
    """The preferred text unless it is null or blank."""
    return F.coalesce(blank_to_null(preferred), col(fallback))


def normalize_name(c: str | Column) -> Column:
    """Lower case with single blanks."""
    return F.lower(F.trim(F.regexp_replace(col(c), r"\s+", " ")))


def composite_id(*parts: str | Column, sep: str = "___") -> Column:
    """Parts joined by ``sep``; a null part is empty."""
    return F.concat_ws(sep, *(F.coalesce(col(p).cast("string"), F.lit("")) for p in parts))


def padded_id(prefix: str, c: str | Column, width: int) -> Column:
    return F.concat(F.lit(prefix), F.lpad(col(c).cast("string"), width, "0"))


def frame(c: str | Column, before: str, after: str = "") -> Column:
    return F.concat(F.lit(before), col(c), F.lit(after))


def unframe(c: str | Column, marker: str, end: str) -> Column:
    """What stands between ``marker`` and ``end``, else the whole text."""
    tail = F.substring_index(col(c), marker, -1)
    return F.when(col(c).contains(marker), F.trim(F.substring_index(tail, end, 1) if end else tail)).otherwise(col(c))


def instruct(c: str | Column, task: str) -> Column:
    return F.concat(F.lit(f"Instruct: {task}\nQuery: "), col(c))


def slug(c: str | Column) -> Column:
    return F.translate(col(c), "/-.", "___")


def strip_fence(c: str | Column) -> Column:
    """A reply without the code fence around it."""
    opened = F.regexp_replace(F.trim(col(c)), r"^```[^\n]*\n", "")
    return F.regexp_replace(opened, r"\n?```\s*$", "")


def double_backslashes(c: str | Column) -> Column:
    return F.replace(col(c), F.lit("\\"), F.lit("\\\\"))


def lower_or(c: str | Column, default: str) -> Column:
    return F.lower(F.coalesce(col(c), F.lit(default)))


def day_of(c: str | Column) -> Column:
    """The date of a path that ends in ``-YYYYMMDD``."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(col(c), r"-(\d{8})/?$", 1), F.lit("")), F.lit("yyyyMMdd")).cast("date")


def is_junk_theme(c: str | Column) -> Column:
    low = F.lower(F.coalesce(col(c), F.lit("")))
    out = F.lit(False)
    for part in JUNK_THEMES:
        out = out | low.contains(part)
    return out


def mentions_any(c: str | Column, keywords: list[str]) -> Column:
    """The keywords that the text holds, in any case."""
    low = F.lower(F.coalesce(col(c), F.lit("")))
    return F.filter(F.array(*(F.lit(k.lower()) for k in keywords)), lambda k: F.contains(low, k))


def capitalize(c: str | Column) -> Column:
    return F.concat(F.upper(F.left(col(c), F.lit(1))), F.lower(F.substring(col(c), 2, 1 << 30)))


def format_conversation(messages: str | Column, most: int = 10_000, mark: str = "\n[... truncated ...]") -> Column:
    """``[Role]: content`` of each message with content, parted by blank lines, cut after ``most`` characters."""
    said = F.filter(col(messages), lambda m: F.trim(F.coalesce(m["content"], F.lit(""))) != "")
    lines = F.transform(said, lambda m: F.concat(F.lit("["), capitalize(F.trim(F.coalesce(m["role"], F.lit("unknown")))), F.lit("]: "), F.trim(m["content"])))
    return truncate(F.array_join(lines, "\n\n"), most, mark)


def valid_permutation(numbers: str | Column, n: str | Column, append: bool = True) -> Column:
    """Numbers from 1 to ``n`` in the order of a reply, each once; those missing follow if ``append``."""
    every = F.when(col(n) > 0, F.sequence(F.lit(1), col(n).cast("int"))).otherwise(F.array().cast("array<int>"))
    known = F.array_intersect(F.array_distinct(col(numbers).cast("array<int>")), every)
    return F.concat(known, F.array_except(every, known)) if append else known


def json_list(c: str | Column, element: str) -> Column:
    """The list in a JSON reply: the reply itself, or the first list among the values of an object."""
    text = strip_fence(c)
    direct = F.from_json(text, f"array<{element}>", {"mode": "PERMISSIVE"})
    inner = F.from_json(text, "map<string,string>")
    lists = F.filter(F.map_values(inner), lambda v: F.startswith(F.trim(v), F.lit("[")))
    wrapped = F.from_json(F.get(lists, F.lit(0)), f"array<{element}>")
    return F.when(F.startswith(F.trim(text), F.lit("[")), direct).otherwise(wrapped)
