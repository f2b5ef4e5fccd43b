"""Abusive, hateful and sexual content: a chain CRF tags spans, its marginals give document scores.

Records are scanned whole and every sentence goes through the tagger.  The features of a token are its word (disguises undone), its neighbours, and the classes of words at it and near it;
all are looked up once for each distinct word and added up as arrays, so that a sentence costs little more than its split into words.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relevspark.llm import toxic_words as V
from relevspark.llm.crf import ChainCRF
from relevspark.llm.langid import FUNCTION_WORDS

LABELS = ("clean", "abuse", "hate", "sexual")
#: Expansions of each pattern; the labelled sample is bounded by this and the number of patterns.
EXPANSIONS = 24
#: The share of words that the sample shows as unknown ones, and how much rarer toxic words are outside the sample (as a logarithm, taken off their scores).
UNKNOWN, RARER = 0.12, 0.5
#: Clean sentences of function words, unknown words and numbers that the sample has besides.
BACKGROUND = 2500
THRESHOLD = 0.5
#: No word of a class, however disguised, is longer once drawn-out letters are drawn in.
LONGEST = 80

_CLASS_OF: dict[str, tuple[str, ...]] = {}
for _c, _words in V.CLASSES.items():
    for _w in _words.replace("_", " ").split():
        _CLASS_OF[_w] = (*_CLASS_OF.get(_w, ()), re.sub(r"_(?:fr|de|es|x)$", "", _c))
_CLASS_OF = {w: tuple(dict.fromkeys(c)) for w, c in _CLASS_OF.items()}
_CLASSES = sorted({c for cs in _CLASS_OF.values() for c in cs})
#: Classes of words that may be disguised.
_HARSH = {"insult", "insult_adj", "vermin", "sex_noun", "sex_verb", "sex_adj", "sex", "threat", "expel"}

#: Ordinary words that look like a word of a class with a letter written twice.
_WORDS_OF_THEIR_OWN = set("ville bitte coow pigg ratt ratted pitt cann rass mass bass lass matter putta potta nuee bittes villes stabb maggie tootss dilldo assess sluut whoore skinn runn buggs diess butter putter litter fitter hoot loot root noose loose choose bannd been feed seed need buss muss kiss pass cutter cutt hoop loop poor door moor".split())
#: Words of classes with one letter written twice, and the words behind them.
_DOUBLED = {f"{w[: i + 1]}{w[i:]}": w for w in sorted(_CLASS_OF) if len(w) > 3 and _HARSH & set(_CLASS_OF[w]) for i in range(len(w)) if w[i : i + 1] != w[i + 1 : i + 2]}
_DOUBLED = {d: w for d, w in _DOUBLED.items() if d not in _CLASS_OF and d not in _WORDS_OF_THEIR_OWN}

# -- disguises ------------------------------------------------------------------------------------------------------
#: Letters of other scripts that look like Latin ones, and signs that stand for letters.
_LOOKS = str.maketrans("аеорсухіјѕһԁӏѵԛԝɡᴀʙᴄᴅᴇꜰɢʜɪᴊᴋʟᴍɴᴏᴘʀѕᴛᴜᴠᴡʏᴢαοεικνρτυχ", "aeopcyxijshdlvqwgabcdefghijklmnoprstuvwyzaoeiknptux"[: len("аеорсухіјѕһԁӏѵԛԝɡᴀʙᴄᴅᴇꜰɢʜɪᴊᴋʟᴍɴᴏᴘʀѕᴛᴜᴠᴡʏᴢαοεικνρτυχ")].ljust(len("аеорсухіјѕһԁӏѵԛԝɡᴀʙᴄᴅᴇꜰɢʜɪᴊᴋʟᴍɴᴏᴘʀѕᴛᴜᴠᴡʏᴢαοεικνρτυχ"), "x"))
_HIDDEN = "​‌‍⁠﻿­᠎"
_HIDDEN_RE = re.compile(f"[{_HIDDEN}]")
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "9": "g"})
_LEET_L = str.maketrans({"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e", "9": "g"})
_RUNS = re.compile(r"(.)\1{2,}")
_SPACED = r"(?<![\w'’])[^\W\d_]([ .\-_*·])[^\W\d_](?:\1[^\W\d_])+(?![\w'’])"
_SPACED_RE = re.compile(_SPACED)
_TOKEN = rf"[\w@$][\w'’{_HIDDEN}]*(?:[*@$!|#]+(?=[\w*@$!|#])[\w'’{_HIDDEN}]*)*|[,\"“”«»>]"
_FAST = re.compile(_TOKEN)
#: With words whose letters stand apart as one token.
_WORD = re.compile(_SPACED + "|" + _TOKEN)
_SENTENCE = re.compile(r"[^.!?…。！？\n]+(?:[.!?…。！？]+(?![\s.!?…。！？]|$)[^.!?…。！？\n]*)*[.!?…。！？]*")
_BY_LENGTH: dict[tuple[int, str], list[str]] = {}
for _w in _CLASS_OF:
    if len(_w) > 3:
        _BY_LENGTH.setdefault((len(_w), _w[-1]), []).append(_w)


def plain_form(token: str) -> str:
    """The word behind a token: lower case, without look-alike letters, hidden signs, masks and drawn-out letters."""
    if len(token) > LONGEST:
        token = _RUNS.sub(r"\1\1\1", token)
        if len(token) > LONGEST:
            return ""
    w = _HIDDEN_RE.sub("", token)
    if not w.isascii():
        w = unicodedata.normalize("NFKC", w)
        low = w.lower()
        if re.search(r"[a-zA-Z]", w) or low.translate(_LOOKS).isascii():
            w = low.translate(_LOOKS)
    w = w.lower().replace("’", "'")
    if _SPACED_RE.fullmatch(w):
        w = w[::2]
    if w in _CLASS_OF:
        return w
    if w in _DOUBLED:
        return _DOUBLED[w]
    if len(w) > 2 and _RUNS.search(w):
        for form in (_RUNS.sub(r"\1", w), _RUNS.sub(r"\1\1", w)):
            if form in _CLASS_OF:
                return form
    if w and not w.isalpha():
        if "*" in w or "#" in w:
            shape = re.compile("".join("." if c in "*#" else re.escape(c) for c in w))
            for known in _BY_LENGTH.get((len(w), w[-1]), ()):
                if shape.fullmatch(known):
                    return known
        if re.search(r"[^\W\d_]", w):
            for table in (_LEET, _LEET_L):
                form = w.translate(table)
                for f in (form, form.replace("*", ""), _RUNS.sub(r"\1", form)):
                    if f in _CLASS_OF:
                        return f
    return w


# -- features ---------------------------------------------------------------------------------------------------------
def features(words: list[str], shapes: list[str]) -> list[list[str]]:
    """Features of each token: words and classes at it and near it."""
    classes = [_CLASS_OF.get(w, ()) for w in words]
    n = len(words)
    out = []
    for i in range(n):
        here = classes[i]
        f = own_features(words[i], shapes[i])
        if i:
            f.append(f"p{words[i - 1]}")
            f.extend(f"pc{c}" for c in classes[i - 1])
        if i + 1 < n:
            f.append(f"n{words[i + 1]}")
            f.extend(f"nc{c}" for c in classes[i + 1])
        near = set()
        for j in range(max(0, i - 3), min(n, i + 4)):
            near.update(classes[j])
        wide = set()
        for j in range(max(0, i - 9), min(n, i + 10)):
            wide.update(classes[j])
        if any(shapes[j] == "Xx" and not classes[j] for j in range(max(1, i - 3), min(n, i + 4))):
            near.add("GROUP")
        f.extend(f"k{c}" for c in near)
        f.extend(f"v{c}" for c in wide)
        for a in here:
            f.extend(f"x{a}+{c}" for c in near if c != a)
            f.extend(f"y{a}+{c}" for c in wide if c != a)
        out.append(f)
    return out


def own_features(word: str, shape_: str) -> list[str]:
    here = _CLASS_OF.get(word, ())
    f = [f"w{word}"] if here or len(word) < 7 and word != "\x01" else [f"s{shape_}"]
    if here and len(word) > 5:
        f.append(f"h{word[:5]}")
    return f + [f"c{c}" for c in here]


def shape(token: str) -> str:
    if token.isupper():
        return "XX" if len(token) > 1 else "X"
    return "Xx" if token[:1].isupper() else "x" if token.isalpha() else "."


_SLOT = re.compile(r"\{(\w+)\}")
_GROUP_WORDS = {g.lower() for g in V.GROUPS}


def slots(held_out: frozenset = frozenset()) -> dict[str, list[str]]:
    """What the names in patterns stand for; words of ``held_out`` are left out."""
    words = {c: [x for x in w.split() if x not in held_out] for c, w in V.CLASSES.items()}
    return words | {p: a.split(" | ") for p, a in V.PARTS.items()} | {"group": V.GROUPS, "thing": V.THINGS, "place": V.PLACES, "name": V.NAMES}


def expand(pattern: str, of: dict[str, list[str]], rng: random.Random) -> str:
    while "{" in pattern:
        pattern = _SLOT.sub(lambda m: rng.choice(of[m[1]]).replace("_", " "), pattern)
    return pattern


def examples(patterns: dict[str, list[str]] | None = None, held_out: frozenset = frozenset(), seed: int = 20240501) -> tuple[list[list[list[str]]], list[list[int]]]:
    """The labelled sample: each pattern with random words of its classes, in ordinary, lower or upper case; some of the words as unknown ones."""
    rng = random.Random(seed)
    of = slots(held_out)
    patterns = patterns or all_patterns()
    rest = [p for p in patterns["clean"] if "{" not in p or "thing" in p]
    sentences, tags = [], []
    for label, name in enumerate(LABELS):
        for p in patterns[name]:
            n = EXPANSIONS if "{" in p else EXPANSIONS // 2
            for _ in range(n * (2 if label == 0 else 1)):
                words = _FAST.findall(expand(p, of, rng))
                lead = rng.random()
                before = _FAST.findall(expand(rng.choice(rest), of, rng))[: rng.randint(2, 9)] if lead < 0.25 else []
                after = _FAST.findall(expand(rng.choice(rest), of, rng))[: rng.randint(2, 9)] if lead > 0.75 else []
                mood = rng.random()
                tokens = before + words + after
                if mood < 0.1:
                    tokens = [t.lower() for t in tokens]
                elif mood < 0.16:
                    tokens = [t.upper() for t in tokens]
                elif mood < 0.7 and tokens:
                    tokens[0] = tokens[0][:1].upper() + tokens[0][1:]
                # a people's name stays unseen: its word is no feature, only its shape is
                plain = [f if (f := plain_form(t)) in _CLASS_OF or f not in _GROUP_WORDS else "\x01" for t in tokens]
                harsh = sum(bool(_HARSH & set(_CLASS_OF.get(w, ()))) for w in plain)
                for i, w in enumerate(plain):
                    if w.isalpha() and rng.random() < UNKNOWN and (harsh > 1 or w not in _CLASS_OF):
                        plain[i] = "\x01"
                sentences.append(features(plain, [shape(t) for t in tokens]))
                tags.append([0] * len(before) + [label] * len(words) + [0] * len(after))
    more, clean = background(rng)
    return sentences + more, tags + clean


def background(rng: random.Random) -> tuple[list[list[list[str]]], list[list[int]]]:
    """Clean sentences of function words of one language with unknown words, names, numbers and commas between them."""
    sentences = []
    for _ in range(BACKGROUND):
        joining = sorted(FUNCTION_WORDS[rng.choice(sorted(FUNCTION_WORDS))])
        words, shapes = [], []
        # prose, or a list of names or words without joining words
        low, high = rng.choice([(0.0, 1.0), (0.0, 1.0), (0.0, 1.0), (0.72, 1.0), (0.5, 0.8)])
        for i in range(rng.randint(4, 18)):
            r = rng.uniform(low, high)
            word, form = (rng.choice(joining), "x") if r < 0.5 else ("\x01", "x") if r < 0.72 else ("\x01", "Xx") if r < 0.9 else (",", ".") if r < 0.95 else (str(rng.randint(1, 9999)), ".")
            words.append(plain_form(word) if word != "\x01" else word)
            shapes.append("Xx" if form == "x" and (i == 0 or rng.random() < 0.08) else form)
        if rng.random() < 0.08:
            shapes = ["XX" if f in ("x", "Xx") else f for f in shapes]
        sentences.append(features(words, shapes))
    return sentences, [[0] * len(x) for x in sentences]


def all_patterns() -> dict[str, list[str]]:
    return {name: p.strip().splitlines() for name, p in zip(LABELS, (V.CLEAN, V.ABUSE, V.HATE, V.SEXUAL))}


@lru_cache(maxsize=1)
def tagger() -> Tagger:
    """The tagger, trained once in a process on the labelled sample (the same every time)."""
    return Tagger(ChainCRF(LABELS).fit(*examples()))


class _Numbers(dict):
    """Numbers of distinct words, each given when it is first seen."""

    def __init__(self, new):
        super().__init__()
        self.new = new

    def __missing__(self, word: str) -> int:
        return self.new(word)


class Tagger:
    """A trained CRF as tables: what a distinct word adds to the scores of itself and its neighbours, and what classes add."""

    def __init__(self, crf: ChainCRF):
        self.crf = crf
        self.bit = {c: 1 << i for i, c in enumerate(_CLASSES)}
        self.group = 1 << len(_CLASSES)
        self.bias = crf.weight[len(crf.index)] - RARER * (np.arange(len(LABELS)) > 0)
        self._names = {v: k for k, v in self.bit.items()} | {self.group: "GROUP"}
        self._clear()
        self._sums: dict[tuple, np.ndarray] = {}

    def _clear(self) -> None:
        self.known = _Numbers(self._add)
        self.table = np.zeros((4096, 3, len(LABELS)), np.float32)
        self.masks = np.zeros(4096, np.int32)
        self.names = np.zeros(4096, bool)
        self.letters = np.zeros(4096, bool)

    def _sum(self, feats: list[str]) -> np.ndarray:
        rows = [i for f in feats if (i := self.crf.index.get(f)) is not None]
        return self.crf.weight[rows].sum(0) if rows else np.zeros(len(LABELS))

    def _add(self, token: str) -> int:
        k = len(self.known)
        if k == len(self.masks):
            self.table, self.masks, self.names, self.letters = (np.concatenate([a, np.zeros_like(a)]) for a in (self.table, self.masks, self.names, self.letters))
        word, form = plain_form(token), shape(token)
        here = _CLASS_OF.get(word, ())
        if not here and not any(f"{k}{word}" in self.crf.index for k in "wpn"):
            word = "\x01"
        self.table[k] = self.bias + self._sum(own_features(word, form)), self._sum([f"p{word}", *(f"pc{c}" for c in here)]), self._sum([f"n{word}", *(f"nc{c}" for c in here)])
        self.masks[k] = sum(self.bit[c] for c in here)
        self.names[k] = form == "Xx" and not here
        self.letters[k] = len(token) == 1 and token.isalpha()
        self.known[token] = k
        return k

    def ids(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))

    def _classes(self, mask: int) -> list[str]:
        return [n for b, n in self._names.items() if mask & b]

    def _rows(self, kind: str, *masks: np.ndarray) -> np.ndarray:
        """What sets of classes add to the scores; few sets are distinct."""
        packed = masks[0].astype(np.int64)
        if len(masks) == 3:
            cells = np.stack(masks, 1)
            distinct, at = np.unique(cells, axis=0, return_inverse=True)
        else:
            distinct, at = np.unique(packed, return_inverse=True)
            distinct = distinct[:, None]
        out = np.empty((len(distinct), len(LABELS)), np.float32)
        for r, key in enumerate(map(tuple, distinct.tolist())):
            if (v := self._sums.get((kind, *key))) is None:
                if len(self._sums) > 200_000:
                    self._sums.clear()
                sets = [self._classes(m) for m in key]
                if kind == "x":
                    v = self._sum([f"x{a}+{c}" for a in sets[0] for c in sets[1] if c != a] + [f"y{a}+{c}" for a in sets[0] for c in sets[2] if c != a])
                else:
                    v = self._sum([f"{kind}{c}" for c in sets[0]])
                self._sums[(kind, *key)] = v
            out[r] = v
        return out[at.ravel()]

    def marginals(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of the labels at all words of sentences of these lengths (flat), and the places where each sentence starts and ends."""
        ends = np.cumsum(lengths)
        first = ends - lengths
        n = len(ids)
        # sentences lie apart by as many empty places as a window reaches
        gap = 9
        at = np.arange(n) + np.repeat(gap * (1 + np.arange(len(lengths))), lengths)
        size = n + gap * (len(lengths) + 2)

        def wide_or(a: np.ndarray, reach: int) -> np.ndarray:
            width, w = 2 * reach + 1, 1
            while w * 2 <= width:
                a = np.bitwise_or(a, np.append(a[w:], np.zeros(w, a.dtype)))
                w *= 2
            out = np.zeros_like(a)
            out[reach:] = np.bitwise_or(a[: size - reach], np.append(a[width - w :], np.zeros(width - w, a.dtype))[: size - reach])
            return out

        here = self.masks[ids]
        name = self.names[ids]
        name[first[lengths > 0]] = False
        spread = np.zeros(size, np.int32)
        spread[at] = here
        wide = wide_or(spread, 9)[at]
        spread[at] = here | np.where(name, np.int32(self.group), np.int32(0))
        near = wide_or(spread, 3)[at]
        score = self.table[ids, 0]
        if n > 1:
            inner = np.ones(n, bool)
            inner[first[lengths > 0]] = False
            i = np.flatnonzero(inner)
            score[i] += self.table[ids[i - 1], 1]
            score[i - 1] += self.table[ids[i], 2]
        for kind, mask in (("k", near), ("v", wide)):
            some = np.flatnonzero(mask)
            if len(some):
                score[some] += self._rows(kind, mask[some])
        some = np.flatnonzero(here)
        if len(some):
            score[some] += self._rows("x", here[some], near[some], wide[some])
        return self.crf.marginals_of(score, first, lengths), first, ends


def split(texts: list[str | None], tag: Tagger):
    """Sentences of the texts: text, place, numbers of the words, lengths, and which had letters that stand apart put together."""
    where, place, tokens = [], [], []
    for k, t in enumerate(texts):
        if t:
            for m in _SENTENCE.finditer(t):
                if words := _FAST.findall(m.group()):
                    where.append(k)
                    place.append(m.start())
                    tokens.append(words)
    if len(tag.known) > 300_000:
        tag._clear()

    def numbers():
        return tag.ids([w for s in tokens for w in s]), np.fromiter(map(len, tokens), np.int64, len(tokens))

    ids, lengths = numbers()
    single = tag.letters[ids]
    three = np.flatnonzero(single[:-2] & single[1:-1] & single[2:]) if len(single) > 2 else np.zeros(0, np.int64)
    apart: set[int] = set()
    if len(three):
        owner = np.repeat(np.arange(len(tokens)), lengths)
        apart = set(owner[three[owner[three] == owner[three + 2]]].tolist())
        for i in apart:
            tokens[i] = [m.group() for m in _WORD.finditer(_SENTENCE.match(texts[where[i]], place[i]).group())]
        ids, lengths = numbers()
    return where, place, ids, lengths, apart


def score_texts(texts: list[str | None], tag: Tagger) -> list[tuple[list[float], list[tuple[str, int, int, float]]]]:
    """For each text the score of each category (its most certain token) and the offending spans ``(category, start, end, score)``."""
    out = [([0.0, 0.0, 0.0], []) for _ in texts]
    where, place, ids, lengths, apart = split(texts, tag)
    if not where:
        return out
    gamma, first, ends = tag.marginals(ids, lengths)
    # sentences always have a token here
    top, mass = (f.reduceat(gamma[:, 1:], first, axis=0) for f in (np.maximum, np.add))
    # a sentence counts in full for the category that most of its words point to, and for another if nearly as many do
    top = top * np.minimum(1.0, 1.25 * mass / np.maximum(mass.max(1, keepdims=True), 1e-12))
    best_of = np.zeros((len(texts), 3))
    np.maximum.at(best_of, np.array(where), top)
    for k, row in enumerate(best_of.tolist()):
        out[k][0][:] = row
    for i in np.flatnonzero((top >= THRESHOLD).any(1)).tolist():
        k, text = where[i], texts[where[i]]
        s = _SENTENCE.match(text, place[i])
        sp = [(place[i] + m.start(), place[i] + m.end()) for m in (_WORD if i in apart else _FAST).finditer(s.group())]
        g = gamma[first[i] : ends[i]]
        best = g.argmax(1)
        for c in (1, 2, 3):
            if top[i, c - 1] < THRESHOLD:
                continue
            j = 0
            while j < len(sp):
                if best[j] == c:
                    z = j
                    while z + 1 < len(sp) and best[z + 1] == c:
                        z += 1
                    out[k][1].append((LABELS[c], sp[j][0], sp[z][1], float(g[j : z + 1, c].mean())))
                    j = z
                j += 1
    return out


def score(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys`` with ``abuse``, ``hate``, ``sexual`` (scores from 0 to 1) and ``spans`` for every row of ``df``.

    Null and empty texts score 0; keys may be null or repeat, each row is scored; other columns are not read.  Offsets count
    characters of the text.  A narrow map; the tagger is trained on the driver and sent along (a few MB, whatever the data).
    """
    tag = tagger()
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    span_type = pa.list_(pa.struct([("category", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                found = score_texts(part.column(n).to_pylist(), tag)
                marks = np.array([s for s, _ in found]).reshape(-1, 3)
                rows = [[{"category": c, "start": a, "end": z, "score": v} for c, a, z, v in sp] for _, sp in found]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(n)), *(pa.array(marks[:, j]) for j in range(3)), pa.array(rows, span_type)], names=[*keys, "abuse", "hate", "sexual", "spans"])

    return df.select(*keys, F.col(text_col).alias("_text")).mapInArrow(run, schema + ", abuse double, hate double, sexual double, spans array<struct<category: string, start: int, end: int, score: double>>")


def flagged(scored: DataFrame, keys: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """One row of ``keys`` and ``category`` per record and category at or above the threshold."""
    pairs = F.array(*(F.struct(F.lit(c).alias("category"), F.col(c).alias("score")) for c in LABELS[1:]))
    return scored.select(*keys, F.explode(pairs).alias("_p")).where(F.col("_p.score") >= threshold).select(*keys, F.col("_p.category").alias("category"))


def rates(scored: DataFrame, source_col: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """Documents, flagged documents and their share per source and category (null sources form one group)."""
    marks = [F.sum((F.col(c) >= threshold).cast("long")).alias(c) for c in LABELS[1:]]
    by = scored.groupBy(source_col).agg(F.count(F.lit(1)).alias("n_docs"), *marks)
    pairs = F.array(*(F.struct(F.lit(c).alias("category"), F.col(c).alias("n_flagged")) for c in LABELS[1:]))
    return by.select(source_col, "n_docs", F.explode(pairs).alias("_p")).select(source_col, F.col("_p.category").alias("category"), "n_docs", F.col("_p.n_flagged").alias("n_flagged"), F.round(F.col("_p.n_flagged") / F.col("n_docs"), 6).alias("rate"))
