"""A small parsing-expression-grammar engine.

A grammar is text, one rule a line, ``name <- expression``.  Expressions: sequence (blank), ordered choice
``/``, ``* + ?``, ``&`` and ``!`` look-ahead, groups, ``"literal"``, a regular expression in ``~...~`` as
terminal, ``@~...~`` for all text before the next match of one, ``%ab...%`` for text from ``a`` to the ``b`` that balances it (nested to any depth, without any character after ``ab``), and rule names.  Rules become closures; a parse gives a tree of ``Node``.  A rule whose name starts with an underscore
leaves no node of its own.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Node(NamedTuple):
    name: str
    start: int
    end: int
    children: tuple[Node, ...]

    def text(self, s: str) -> str:
        return s[self.start : self.end]

    def find(self, name: str):
        for c in self.children:
            if c.name == name:
                return c
        return None


_TOKEN = re.compile(r'\s*(?:(?P<until>@~(?:\\~|[^~])+~)|(?P<re>~(?:\\~|[^~])+~)|(?P<lit>"(?:\\.|[^"\\])*")|(?P<nest>%(?:\\.|[^%\\])+%)|(?P<name>\w+)|(?P<op>[()*+?/&!]))')
_NONE: tuple[Node, ...] = ()


def balanced(opening: str, closing: str, stop: str):
    """A terminal for what lies between balanced brackets.  The ends of all brackets of a text are found in one pass with a stack when the text is first seen."""
    marks = re.compile(f"[{re.escape(opening + closing + stop)}]")
    seen, ends = None, {}

    def run(s, i):
        nonlocal seen, ends
        if not s.startswith(opening, i):
            return None
        if seen is not s:
            seen, ends, stack = s, {}, []
            for m in marks.finditer(s):
                c = m.group()
                if c == opening:
                    stack.append(m.start())
                elif c != closing:
                    stack.clear()
                elif stack:
                    ends[stack.pop()] = m.end()
        end = ends.get(i)
        return None if end is None else (end, _NONE)

    return run


class Grammar:
    def __init__(self, source: str, flags: int = 0):
        self.flags = flags
        self.rules = {}
        self._bodies = {}
        for line in re.split(r"\n(?=\s*\w+\s*<-)", source.strip()):
            name, _, body = line.partition("<-")
            self._bodies[name.strip()] = body.strip()
        for name, body in self._bodies.items():
            self._tokens = [(m.lastgroup, m.group(m.lastgroup)) for m in _TOKEN.finditer(body)]
            self._at = 0
            made = self._choice()
            if self._at != len(self._tokens):
                raise ValueError(f"cannot read rule {name}: {body}")
            self.rules[name] = made if name.startswith("_") else self._noded(name, made)

    @staticmethod
    def _noded(name, inner):
        def run(s, i):
            r = inner(s, i)
            return None if r is None else (r[0], (Node(name, i, r[0], r[1]),))

        return run

    def _peek(self):
        return self._tokens[self._at] if self._at < len(self._tokens) else (None, None)

    def _choice(self):
        options = [self._sequence()]
        while self._peek() == ("op", "/"):
            self._at += 1
            options.append(self._sequence())
        if len(options) == 1:
            return options[0]

        def run(s, i):
            for f in options:
                if (r := f(s, i)) is not None:
                    return r
            return None

        return run

    def _sequence(self):
        parts = []
        while (t := self._peek())[0] and t not in (("op", "/"), ("op", ")")):
            parts.append(self._suffixed())
        if len(parts) == 1:
            return parts[0]

        def run(s, i):
            kept = _NONE
            for f in parts:
                if (r := f(s, i)) is None:
                    return None
                i, more = r
                if more:
                    kept += more
            return i, kept

        return run

    def _suffixed(self):
        kind, t = self._peek()
        if kind == "op" and t in "&!":
            self._at += 1
            inner, want = self._suffixed(), t == "&"
            return lambda s, i: (i, _NONE) if (inner(s, i) is not None) == want else None
        f = self._atom()
        kind, t = self._peek()
        if kind == "op" and t in "*+?":
            self._at += 1
            return self._repeat(f, t)
        return f

    @staticmethod
    def _repeat(f, how):
        if how == "?":
            return lambda s, i: f(s, i) or (i, _NONE)
        least = 1 if how == "+" else 0

        def run(s, i):
            kept, n = [], 0
            while (r := f(s, i)) is not None and (r[0] > i):
                i = r[0]
                kept.extend(r[1])
                n += 1
            return (i, tuple(kept)) if n >= least else None

        return run

    def _atom(self):
        kind, t = self._peek()
        self._at += 1
        if kind == "op" and t == "(":
            f = self._choice()
            if self._peek() != ("op", ")"):
                raise ValueError("a group is not closed")
            self._at += 1
            return f
        if kind == "re":
            match = re.compile(t[1:-1].replace("\\~", "~"), self.flags).match

            def terminal(s, i):
                m = match(s, i)
                return None if m is None else (m.end(), _NONE)

            return terminal
        if kind == "until":
            search = re.compile(t[2:-1].replace("\\~", "~"), self.flags).search

            def before(s, i):
                m = search(s, i)
                end = len(s) if m is None else m.start()
                return (end, _NONE) if end > i else None

            return before
        if kind == "nest":
            return balanced(*re.match(r"(.)(.)([\s\S]*)", t[1:-1].encode().decode("unicode_escape")).groups())
        if kind == "lit":
            text = t[1:-1].encode().decode("unicode_escape")
            n = len(text)
            return lambda s, i: (i + n, _NONE) if s.startswith(text, i) else None
        if kind == "name":
            if t not in self._bodies:
                raise ValueError(f"no rule {t}")
            return lambda s, i: self.rules[t](s, i)
        raise ValueError("an expression is missing")

    def parse(self, s: str, rule: str, at: int = 0, whole: bool = True):
        """The tree of ``rule`` at ``at``, or None if it does not match (to the end, if ``whole``)."""
        r = self.rules[rule](s, at)
        if r is None or (whole and r[0] != len(s)):
            return None
        return r[1][0] if r[1] else Node(rule, at, r[0], _NONE)
