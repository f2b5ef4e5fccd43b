"""Byte-pair encoding by prefix dynamic programming.

For every prefix of a byte string there is exactly one token that can stand last in the encoding of
that prefix.  ``PrefixTable`` stores this token for each prefix, so that appending bytes costs only the new
prefixes, and an edit costs only the prefixes after its place (until the old table is met again).

The candidate last tokens of a prefix are the vocabulary entries that end there; a candidate ``t`` is
right if the shorter prefix before it is empty or has a last token ``s`` such that the boundary between
``s`` and ``t`` survives all merges.  Whether it survives depends on the pair alone, so answers are kept.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import regex

#: The public pattern that cuts a text into pieces before merging.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_FOLDER = "/opt/tokenizers"
#: Pieces whose ids are kept by an encoder; the store is emptied when full, so its memory is bounded.
KEPT_PIECES = 400_000
NEVER = 1 << 60


def _printable_bytes() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    spare = (b for b in range(256) if b not in set(plain))
    return table | {chr(256 + n): b for n, b in enumerate(spare)}


class Vocabulary:
    """Tokens, merges and the boundary test of one byte-level vocabulary file (JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letter = _printable_bytes()
        raw = lambda s: bytes(letter[c] for c in s)
        special = set()
        self.id_of: dict[bytes, int] = {}
        for s, i in model["vocab"].items():
            if all(c in letter for c in s):
                self.id_of[raw(s)] = i
            else:
                special.add(i)
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for order, m in enumerate(model["merges"]):
            a, b = (raw(x) for x in (m if isinstance(m, list) else m.split(" ")))
            left, right, both = self.id_of[a], self.id_of[b], self.id_of[a + b]
            self.rank[left, right] = order
            self.parts.setdefault(both, (order, left, right))
        # an entry that no merge makes (a special token) is never a candidate
        self.id_of = {t: i for t, i in self.id_of.items() if len(t) == 1 or i in self.parts}
        tails: dict[bytes, set[int]] = {}
        for t in self.id_of:
            tails.setdefault(t[-2:], set()).add(len(t))
        for tail in [t for t in tails if len(t) == 2]:
            tails[tail] |= {1}
        self.longest = max(map(len, self.id_of))
        self.lengths = {t: sorted(n, reverse=True) for t, n in tails.items()}
        self._left: dict[int, list[tuple[int, int]]] = {}
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._survives: dict[tuple[int, int], bool] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """Outermost pieces of ``token`` on one side as merging goes on, each with the merge that ends it."""
        kept = self._left if side == 1 else self._right
        if (found := kept.get(token)) is None:
            chain, t, ends = [], token, NEVER
            while True:
                chain.append((t, ends))
                if t not in self.parts:
                    break
                ends, t = self.parts[t][0], self.parts[t][side]
            found = kept[token] = chain[::-1]
        return found

    def survives(self, s: int, t: int) -> bool:
        """Whether merging leaves the boundary between the tokens ``s`` and ``t`` as it is."""
        if (known := self._survives.get((s, t))) is not None:
            return known
        a, b = self._spine(s, 2), self._spine(t, 1)
        i = j = 0
        answer = True
        while True:
            (x, x_ends), (y, y_ends) = a[i], b[j]
            across = self.rank.get((x, y), NEVER)
            # of equal merges the leftmost comes first: inside s, then across, then inside t
            if across < x_ends and across <= y_ends and across != NEVER:
                answer = False
                break
            if x_ends == NEVER and y_ends == NEVER:
                break
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1
        if len(self._survives) > 2_000_000:
            self._survives.clear()
        self._survives[s, t] = answer
        return answer


class PrefixTable:
    """The last token of every prefix of one piece; grows by ``append``, changes by ``replace``."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def _fill(self, end: int) -> int:
        v, data = self.vocabulary, self.data
        for n in v.lengths.get(data[max(0, end - 2) : end], (1,)) if end > 1 else (1,):
            if n > end or (t := v.id_of.get(data[end - n : end])) is None:
                continue
            if n == end or v.survives(self.last[end - n - 1], t):
                return t
        raise ValueError("no token of the vocabulary can end here")

    def append(self, more: bytes) -> None:
        start = len(self.data)
        self.data += more
        for end in range(start + 1, len(self.data) + 1):
            self.last.append(self._fill(end))

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Replace ``data[start:stop]`` and return how many prefixes were computed anew."""
        old, tail = self.last, self.data[stop:]
        self.data, self.last = self.data[:start] + new, old[:start]
        for end in range(start + 1, len(self.data) + 1):
            self.last.append(self._fill(end))
        done, same = len(new), 0
        longest = self.vocabulary.longest
        self.data += tail
        for k in range(len(tail)):
            end = start + len(new) + k + 1
            self.last.append(self._fill(end))
            done += 1
            size = len(self._bytes(self.last[-1]))
            same = same + 1 if self.last[-1] == old[stop + k] and size <= k + 1 else 0
            # once as many prefixes agree as the longest token has bytes, all later ones agree
            if same >= longest:
                self.last += old[stop + k + 1 :]
                break
        return done

    def _bytes(self, token: int) -> bytes:
        if not hasattr(self.vocabulary, "bytes_of"):
            self.vocabulary.bytes_of = {i: t for t, i in self.vocabulary.id_of.items()}
        return self.vocabulary.bytes_of[token]

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= len(self._bytes(out[-1]))
        return out[::-1]


class Encoder:
    """Text to ids, by pieces; strings that look like special tokens are ordinary text."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self._pieces = regex.compile(PIECES)
        self._kept: dict[str, tuple[int, ...]] = {}

    def piece(self, piece: str) -> tuple[int, ...]:
        ids = tuple(PrefixTable(self.vocabulary, piece.encode("utf-8", "replace")).ids())
        if len(piece) <= 64:
            if len(self._kept) >= KEPT_PIECES:
                self._kept.clear()
            self._kept[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of ``text``; the empty list for an empty or null text."""
        out: list[int] = []
        if not text:
            return out
        get, extend = self._kept.get, out.extend
        for p in self._pieces.findall(text):
            extend(get(p) or self.piece(p))
        return out

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        get, n = self._kept.get, 0
        for p in self._pieces.findall(text):
            n += len(get(p) or self.piece(p))
        return n


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=8)
def counter(name: str, folder: str = DEFAULT_FOLDER):
    """A function from a text to its number of tokens, for any of the public tokenizers."""
    if name == "byte_bpe_50k":
        return encoder(os.path.join(folder, "byte_bpe_50k.json")).count
    if name.startswith("byte_bpe"):
        import base64

        import tiktoken

        with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        e = tiktoken.Encoding(name, pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        return lambda t: len(e.encode_ordinary(t)) if t else 0
    if os.path.exists(p := os.path.join(folder, f"{name}.model")):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=p)
        return lambda t: len(sp.encode(t, num_threads=1)) if t else 0
    if os.path.exists(p := os.path.join(folder, f"{name}.json")):
        from tokenizers import Tokenizer

        tk = Tokenizer.from_file(p)
        tk.encode_special_tokens = True
        return lambda t: len(tk.encode(t, add_special_tokens=False).ids) if t else 0
    raise ValueError(f"unknown tokenizer {name!r}")
