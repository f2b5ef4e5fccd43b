"""Keyword-stuffed and link-list pages, by the mutual information of neighbouring words.

Counts of words and of neighbouring pairs are taken over the whole corpus, each distinct text once.  Each page is cut into windows of words; a window's mean
pointwise mutual information, with the page's own counts left out, tells text (pairs that other pages have too) from word salad,
and the share of words that the window repeats tells excessive repetition.  A window made up of pairs that the page repeats is excessive
repetition whatever their information.  A window is also salad, whether it repeats anything or not, if the pairs of its words that the corpus knows well stand together elsewhere no more often than
chance would have it: their mean information, discounted for small counts and with pairs that never occur weighing as much as they should have occurred, is about nothing, and hardly any is a collocation.
Where a window has few such pairs, those of its page decide; words of a list, with a mark or a line's end between them, are no pairs for this.  Links, hash tags and lines with product codes
are counted as they stand.  A page is stuffed if more than half of its words belong to such windows, links or tags.

Distinct texts are dealt into blocks of bounded size.  Only the distinct pairs of each block travel to be summed, and only the sums of those that
occur elsewhere travel back, so both shuffles stay in proportion to the corpus and no table of counts is broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Characters of text in a block (about a million words at most).
BLOCK_CHARS = 4_000_000
WINDOW = 48
#: Smoothing and limits, all as shares of the corpus so that they hold at any size: a word counts as at least this frequent, a pair as
#: at least that frequent; a word of this share or more joins others into sentences.
WORD_FLOOR, PAIR_FLOOR, GLUE = 7e-5, 1.3e-7, 4e-3
#: A window is salad if its mean information less REPEAT_WEIGHT times its share of repeated words lies below LIMIT.
REPEAT_WEIGHT, LIMIT, LEAST_REPEAT, MOST_GLUE = 4.0, 1.6, 0.12, 0.25
#: A window is repetition if this share of its words is in pairs that the page has TIMES times or more, and it has few joining words or at most FEW of its words are distinct.
TIMES, COVERED, FEW = 4, 0.9, 0.2
#: Words that occur KNOWN times on other pages are known well.  A window is salad without any repetition if, of at least EVIDENCE pairs of such words (else of its page's), the
#: mean discounted information lies below CHANCE and the share of collocations (pairs beyond chance by two standard deviations) below COLLOCATED.
KNOWN, EVIDENCE, CHANCE, COLLOCATED = 20, 12, 0.15, 0.12
#: Lines of so few words are items of a list; their words are no pairs for this either.
ITEM = 4
SHARE = 0.5
#: Hashes of texts that a task remembers, to send each text once.
SEEN = 500_000

_WORD = re.compile(r"[^\W\d_]+")
_LINK = re.compile(r"<a\s[^>]*>[^<]*</a>|\[[^\]\n]*\]\([^)\s]*\)|(?:https?://|www\.)\S+|(?<!\w)#\w+")
_CODE = re.compile(r"\b[A-Z]{2,}-?\d{3,}\b|\d%|[$€£]\s?\d")
_ENDS = re.compile(r"[.!?]\s*$")
#: Marks that part words.
_MARKS = frozenset(",;:|/•·»-–—()@=")
_WORD_OR_MARK = re.compile(r"[^\W\d_]+|[,;:|/•·»\-–—()@=]")


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        v = self[word] = xxhash.xxh3_64_intdigest(word) or 1
        return v


def windows(text: str | None) -> tuple[int, list[list[str]]]:
    """Words in links and tags, and the windows of all other words."""
    tagged, parts = _marked_windows(text)
    return tagged, [w for w, _ in parts]


def _marked_windows(text: str | None, marked: bool = True) -> tuple[int, list[tuple[list[str], list[bool]]]]:
    """As ``windows``, with a sign for each word whether a mark or the line's end follows it (if ``marked``)."""
    tagged, out, rest, rest_cuts = 0, [], [], []
    for line in (text or "").split("\n"):
        if "#" in line or "/" in line or "www." in line:
            tagged += sum(max(1, len(_WORD.findall(m))) for m in _LINK.findall(line))
            line = _LINK.sub(" ", line)
        low = line.lower()
        if marked:
            both = _WORD_OR_MARK.findall(low)
            w = [t for t in both if t not in _MARKS]
        else:
            w = _WORD.findall(low)
        if not w:
            continue
        if len(w) <= 12 and _CODE.search(line) and not _ENDS.search(line):
            tagged += len(w)
            continue
        if not marked or len(w) == len(both) or len(w) <= ITEM:
            cuts = [len(w) <= ITEM] * len(w)
        else:
            cuts = [y in _MARKS for x, y in zip(both, both[1:]) if x not in _MARKS]
            if len(cuts) < len(w):
                cuts.append(True)
        cuts[-1] = True
        if len(w) >= WINDOW // 2:
            if rest:
                out.append((rest, rest_cuts))
                rest, rest_cuts = [], []
            n = max(1, round(len(w) / WINDOW))
            out.extend((w[len(w) * k // n : len(w) * (k + 1) // n], cuts[len(w) * k // n : len(w) * (k + 1) // n]) for k in range(n))
        else:
            rest, rest_cuts = rest + w, rest_cuts + cuts
            if len(rest) >= WINDOW * 3 // 4:
                out.append((rest, rest_cuts))
                rest, rest_cuts = [], []
    if rest:
        out.append((rest, rest_cuts))
    return tagged, out


def _mix(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    a = (a ^ (a >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return a ^ (a >> np.uint64(33))


def _arrays(texts: list[str | None], known: _Words, marked: bool = True):
    """Hashes of all words in windows, their page and window, hashes of the pairs, which of these lie in one window, tagged words per page, and which words a mark follows."""
    flat, cuts, page, window, tagged, n = [], [], [], [], [], 0
    for k, t in enumerate(texts):
        tags, parts = _marked_windows(t, marked)
        tagged.append(tags)
        for w, c in parts:
            flat.extend(w)
            cuts.extend(c)
            page.append((k, len(w)))
            n += 1
    sizes = np.array([s for _, s in page], np.int64)
    window = np.repeat(np.arange(n), sizes)
    owner = np.repeat(np.array([k for k, _ in page], np.int64), sizes)
    h = np.fromiter(map(known.__getitem__, flat), np.uint64, len(flat))
    with np.errstate(over="ignore"):
        pair = _mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) | np.uint64(1)
    inside = window[:-1] == window[1:]
    return h, owner, window, pair, inside, np.array(tagged, np.int64), np.array(cuts, bool)


def _own(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """How often each key occurs with the same owner, at each place."""
    if not len(keys):
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        both = _mix(keys.astype(np.uint64) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(both)
    k = both[order]
    start = np.ones(len(k), bool)
    start[1:] = k[1:] != k[:-1]
    group = np.cumsum(start) - 1
    out = np.empty(len(k), np.int64)
    out[order] = np.bincount(group)[group]
    return out


def count_block(texts: list[str | None], known: _Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words and pairs of a block with their counts; key 0 has the number of words."""
    h, _, _, pair, inside, _, _ = _arrays(texts, known, marked=False)
    keys, n = np.unique(np.concatenate([h, pair[inside]]), return_counts=True)
    return np.append(keys, np.uint64(0)).view(np.int64), np.append(n, len(h)).astype(np.int64)


def score_block(texts: list[str | None], keys: np.ndarray, totals: np.ndarray, known: _Words):
    """Words, tagged words, salad words and mean information of each page; ``totals`` are counts over the corpus by key (absent: none elsewhere)."""
    h, owner, window, pair, inside, tagged, cuts = _arrays(texts, known)
    pages = len(texts)
    words = np.bincount(owner, minlength=pages) if len(h) else np.zeros(pages, np.int64)
    if not len(h):
        return words + tagged, tagged, np.zeros(pages, np.int64), np.full(pages, np.nan)
    order = np.argsort(keys.view(np.uint64))
    keys, totals = keys.view(np.uint64)[order], totals[order]
    total = float(totals[0]) if len(keys) and keys[0] == 0 else float(len(h))

    def elsewhere(k: np.ndarray, own: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, k), max(len(keys) - 1, 0))
        found = keys[at] == k if len(keys) else np.zeros(len(k), bool)
        return np.where(found, np.maximum(totals[at] - own, 0) if len(keys) else 0, 0).astype(np.float64)

    word_count = elsewhere(h, _own(h, owner))
    p, p_owner, left = pair[inside], owner[:-1][inside], np.flatnonzero(inside)
    of_page_count = _own(p, p_owner)
    pair_count = elsewhere(p, of_page_count)
    floor = total * WORD_FLOOR
    info = np.log2((pair_count + total * PAIR_FLOOR) * total / ((word_count[left] + floor) * (word_count[left + 1] + floor)))
    info = np.clip(info, -6, 8)
    n = int(window[-1]) + 1
    size = np.bincount(window, minlength=n)
    pairs = np.bincount(window[left], minlength=n)
    mean = np.bincount(window[left], weights=info, minlength=n) / np.maximum(pairs, 1)
    glue = word_count >= GLUE * total
    in_window = _own(h, window)
    repeated = (in_window >= 3) & ~glue
    rep = np.bincount(window, weights=repeated, minlength=n) / size
    joined = np.bincount(window, weights=glue, minlength=n) / size
    again = left[of_page_count >= TIMES]
    covered = np.zeros(len(h), bool)
    covered[again] = covered[again + 1] = True
    covered = np.bincount(window, weights=covered, minlength=n) / size
    distinct = np.bincount(window, weights=1 / in_window, minlength=n) / size
    # against the words of the other pages, so that a long page doesn't take the joining words from itself
    joins = word_count >= np.maximum(GLUE * (total - words[owner]), 1)
    cycle = (covered >= COVERED) & ((np.bincount(window, weights=joins, minlength=n) / size < MOST_GLUE) | (distinct <= FEW))
    # pairs of well-known words: how often they stand together elsewhere, and how often they would by chance
    rest = total - words[owner[left]]
    chance = word_count[left] * word_count[left + 1] / np.maximum(rest, 1)
    sure = (word_count[left] >= KNOWN) & (word_count[left + 1] >= KNOWN) & ~cuts[left]
    bound = np.log2(np.maximum(pair_count, 1) / np.maximum(chance, 1e-9)) * pair_count / (pair_count + 1)
    bound = np.where(pair_count > 0, bound, -np.log2(1 + chance))
    collocation = pair_count > chance + 2 * np.sqrt(chance)
    sums = np.stack([np.bincount(window[left], weights=x, minlength=n) for x in (sure, bound * sure, collocation & sure)])
    page_of = np.zeros(n, np.int64)
    page_of[window] = owner
    of_pages = np.stack([np.bincount(page_of, weights=x, minlength=pages) for x in sums])[:, page_of]
    evidence, sum_bound, sum_collocated = np.where(sums[0] >= EVIDENCE, sums, of_pages)
    incoherent = (evidence >= EVIDENCE) & (sum_bound < CHANCE * evidence) & (sum_collocated < COLLOCATED * evidence)
    salad = (size >= 8) & (cycle | incoherent | (mean - REPEAT_WEIGHT * rep < LIMIT) & (rep >= LEAST_REPEAT) & (joined < MOST_GLUE))
    bad = np.bincount(owner, weights=salad[window], minlength=pages).astype(np.int64)
    of_page = np.bincount(p_owner, minlength=pages)
    with np.errstate(invalid="ignore", divide="ignore"):
        page_info = np.bincount(p_owner, weights=info, minlength=pages) / of_page
    return words + tagged, tagged, bad, page_info


def page_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``<id>, n_words, tag_words, salad_words, mean_pmi, share, stuffed`` for every row of ``df``.

    Null, empty and wordless texts have no words, a null mean_pmi and share 0 and aren't stuffed; null ids and repeated rows are pages of their own;
    other columns are not read.
    """
    pages = df.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    chars = pages.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    # copies are scored once and counted once: their number changes no page's counts, and however many there are, a block gets at most one from each task
    pages = pages.select("id", "text", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"))

    def fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            keep = []
            for k, v in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                if v not in seen:
                    keep.append(k)
                    seen.add(v)
            if len(seen) > SEEN:
                seen.clear()
            yield b.take(pa.array(keep, pa.int64()))

    texts = pages.select("h", "g", "text").mapInArrow(fresh, "h bigint, g bigint, text string")
    dealt = texts.withColumn("block", F.pmod("h", F.lit(blocks)).cast("int")).repartition(blocks, "block")

    def once(group: pa.Table) -> pa.Table:
        first = {v: k for k, v in enumerate(zip(group.column("h").to_pylist(), group.column("g").to_pylist()))}
        return group if len(first) == len(group) else group.take(pa.array(first.values(), pa.int64()))

    def count(group: pa.Table) -> pa.Table:
        keys, n = count_block(once(group).column("text").to_pylist(), _Words())
        return pa.table({"block": pa.array(np.full(len(keys), group.column("block")[0].as_py(), np.int32)), "key": keys, "n": n})

    counted = dealt.groupBy("block").applyInArrow(count, "block int, key bigint, n bigint")
    # a key has one row a block; what occurs once in the corpus occurs nowhere else and need not travel back
    sums = counted.withColumn("total", F.sum("n").over(Window.partitionBy("key"))).where("total > 1").select("block", "key", "total").repartition(blocks, "block")

    def score(group: pa.Table, sums_: pa.Table) -> pa.Table:
        group = once(group)
        out = score_block(group.column("text").to_pylist(), sums_.column("key").to_numpy(), sums_.column("total").to_numpy(), _Words())
        words, tagged, bad, info = out
        share = (tagged + bad) / np.maximum(words, 1)
        return pa.table({"h": group.column("h"), "g": group.column("g"), "n_words": words.astype(np.int64), "tag_words": tagged.astype(np.int64), "salad_words": bad, "mean_pmi": pa.array(info, mask=np.isnan(info)), "share": share, "stuffed": share > SHARE})

    scored = dealt.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(score, "h bigint, g bigint, n_words bigint, tag_words bigint, salad_words bigint, mean_pmi double, share double, stuffed boolean")
    return pages.select("id", "h", "g").join(scored, ["h", "g"]).drop("h", "g").withColumnRenamed("id", id_col)
