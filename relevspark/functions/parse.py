"""Parsers that expressions cannot state: HTML, speaker turns with places, balanced braces.  All are Arrow-batched."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Patterns of a speaker's label at the start of a line, one family each; the family with most hits holds, of equal ones the first.
SPEAKER_FAMILIES = [
    # a title and a name, with a dot or colon
    r"^[ \t]*(Senator|Chairman|Chairwoman|Chairperson|Mr\.|Mrs\.|Ms\.|Dr\.|Representative|Rep\.|The CHAIRMAN|The CHAIRWOMAN|The CHAIR|General|Admiral|Secretary|Commissioner|Director|Ambassador|Governor|Mayor|Professor|Judge|Justice)[.\s]+([A-Z][A-Za-z\-\']+(?:\s+[A-Z][A-Za-z\-\']+)?)\s*[.\:]\s*",
    # a full name with a colon, perhaps with a clock mark
    r"^[ \t]*([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\s*:\s*(?:\(\d+:\d+\))?\s*",
    # a name in capitals with a dot
    r"^[ \t]*([A-Z]{2,}(?:\s+[A-Z]{2,})*)\s*[.]\s*",
]
_FAMILIES = [
    r"^[ \t]*((?:Mr|Mrs|Ms|Dr|Senator|Representative|Chairman|Chairwoman|The (?:Chairman|Chairwoman|Chair))\.?\s+[A-Z][A-Za-z'’-]+)[.:]",
    r"^[ \t]*([A-Z][A-Z'’-]+(?:\s+[A-Z][A-Z'’-]+){0,3})[.:]",
    r"^[ \t]*([A-Z][a-z]+(?:\s+[A-Z][A-Za-z'’.-]+){1,3}):",
]
_FAMILIES = [re.compile(p, re.M) for p in SPEAKER_FAMILIES]


class _Text(HTMLParser):
    """All text nodes; the bodies of scripts and styles are text nodes too."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []

    def handle_data(self, data):
        self.parts.append(data)


class _Page(HTMLParser):
    """Main text, title, links with the heading around them, meta author."""

    _SKIP = {"script", "style", "nav", "header", "footer", "aside", "form", "noscript"}
    _BLOCK = {"p", "div", "br", "li", "h1", "h2", "h3", "h4", "section", "article", "tr", "blockquote", "pre"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.all: list[str] = []
        self.article: list[str] = []
        self.title = ""
        self.author = None
        self.links: list[dict] = []
        self.heading = ""
        self._link = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "meta" and (a.get("name") or a.get("property") or "").lower() in ("author", "article:author", "byl"):
            self.author = self.author or a.get("content")
        if tag in ("meta", "br", "img", "link", "input", "hr"):
            if tag == "br":
                self._add("\n")
            return
        if tag in ("h1", "h2", "h3"):
            self.heading = ""
        if tag == "a":
            self._link = {"href": a.get("href") or "", "name": a.get("name"), "text": "", "heading": ""}
        self.stack.append(tag)
        if tag in self._BLOCK:
            self._add("\n")

    def handle_endtag(self, tag):
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass
        if tag == "a" and self._link is not None:
            self._link["heading"] = self.heading.strip()
            self.links.append(self._link)
            self._link = None
        if tag in self._BLOCK:
            self._add("\n")

    def handle_data(self, data):
        if "title" in self.stack:
            self.title += data
            return
        if any(t in ("h1", "h2", "h3") for t in self.stack):
            self.heading += data
        if self._link is not None:
            self._link["text"] += data
        self._add(data)

    def _add(self, data):
        if not self._SKIP.intersection(self.stack):
            self.all.append(data)
            if "article" in self.stack or "main" in self.stack:
                self.article.append(data)


def _tidy(parts: list[str]) -> str:
    lines = (" ".join(x.split()) for x in "".join(parts).split("\n"))
    return "\n".join(x for x in lines if x)


def page(html: str | None) -> dict:
    p = _Page()
    p.feed(html or "")
    p.close()
    return {"title": " ".join(p.title.split()), "text": _tidy(p.article) or _tidy(p.all), "author": p.author, "links": [{k: (v.strip() if isinstance(v, str) else v) for k, v in x.items()} for x in p.links]}


def text_nodes(html: str | None) -> str | None:
    if html is None:
        return None
    p = _Text()
    p.feed(html)
    p.close()
    return "".join(p.parts)


def _udf(f, kind: str, c: str | Column) -> Column:
    """A function of a series as a column; made when it is used, as parsing its type needs a session."""
    return F.pandas_udf(f, kind)(F.col(c) if isinstance(c, str) else c)


def strip_html(c: str | Column) -> Column:
    """All text nodes of a page, entities decoded, comments and declarations dropped."""

    def run(html: pd.Series) -> pd.Series:
        return html.map(text_nodes, na_action="ignore")

    return _udf(run, "string", c)


def parse_page(c: str | Column) -> Column:
    """Title, main text (of ``article`` or ``main`` if there is one), meta author and links of a page."""

    def run(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([page(h) for h in html], columns=["title", "text", "author", "links"])

    return _udf(run, "title string, text string, author string, links array<struct<href: string, name: string, text: string, heading: string>>", c)


def turns_of(text: str | None) -> list[dict]:
    if not text:
        return []
    hits = [list(p.finditer(text)) for p in _FAMILIES]
    best = max(hits, key=len)
    if not best:
        return [{"pos": 0, "speaker": "UNKNOWN", "text": text.strip()}] if text.strip() else []
    out = []
    for m, nxt in zip(best, [*best[1:], None]):
        said = text[m.end() : nxt.start() if nxt else len(text)].strip()
        if said:
            out.append({"pos": len(out), "speaker": " ".join(g for g in m.groups() if g).strip(". "), "text": said})
    return out


def speaker_turns(c: str | Column) -> Column:
    """Turns between the labels of the family with most hits; without a label one turn of UNKNOWN; empty turns are dropped."""

    def run(text: pd.Series) -> pd.Series:
        return text.map(turns_of)

    return _udf(run, "array<struct<pos: int, speaker: string, text: string>>", c)


def first_object(reply: str | None) -> str | None:
    """The first balanced ``{...}`` of a reply (braces in strings count too), or None."""
    depth, start = 0, None
    for i, c in enumerate(reply or ""):
        if c == "{":
            start = i if start is None else start
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                return reply[start : i + 1]
    return None


def balanced_object(c: str | Column) -> Column:
    """The first balanced ``{...}`` of a reply, null if there is none."""

    def run(reply: pd.Series) -> pd.Series:
        return reply.map(first_object, na_action="ignore")

    return _udf(run, "string", c)


def archive_links(links: str = "links", pattern: str = r"-(\d{8})/?$", base: str = ""):
    """Links whose address ends in a date, made absolute, each address once; the heading stands in for an empty text."""
    dated = F.filter(F.col(links), lambda x: F.regexp_like(x["href"], F.lit(pattern)))
    full = F.transform(dated, lambda x: F.struct(F.when(F.startswith(x["href"], F.lit("http")), x["href"]).otherwise(F.concat(F.lit(base.rstrip("/")), x["href"])).alias("href"), F.coalesce(F.nullif(F.trim(x["text"]), F.lit("")), x["heading"]).alias("text")))
    return F.filter(full, lambda x, i: F.array_position(F.transform(full, lambda y: y["href"]), x["href"]) == i + 1)


def carry_author(links: DataFrame, page: str = "page", pos: str = "pos") -> DataFrame:
    """``links`` with ``author``: an anchor named ``Last_First`` holds for the links after it, up to the next such anchor of the page."""
    name = F.regexp_extract("name", r"^([^_]+)_([^_]+)$", 2)
    here = F.when(name != "", F.concat(name, F.lit(" "), F.regexp_extract("name", r"^([^_]+)_([^_]+)$", 1)))
    w = Window.partitionBy(page).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return links.withColumn("author", F.last(here, ignorenulls=True).over(w))


def byline(c: str | Column) -> Column:
    """The name after ``By`` at the start of a line, null if there is none."""
    found = F.regexp_extract(F.col(c) if isinstance(c, str) else c, r"(?m)^\s*By\s+([A-Z][\w'’.-]+(?:\s+[A-Z][\w'’.-]+){0,3})", 1)
    return F.nullif(found, F.lit(""))
