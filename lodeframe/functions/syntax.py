"""Lexers and SLR(1) parsers: compiled on the driver, run per row in batches.

Rules know literals, ``[a-z]`` classes and ``[^...]`` exclusions, groups, ``|``, ``+``, ``*``, ``?`` and the escapes ``\\n \\r \\t \\\\`` and of any
special character. The longest match counts; of equal ones the rule with the fewest repeats, then the first. Compiled tables are
plain dictionaries of bounded size (that of the rules), so they travel with the function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_ESCAPES = {"n": "\n", "r": "\r", "t": "\t"}
OTHER = "other"  # stands for every character that no rule names


class _Nfa:
    def __init__(self):
        self.edges: list[list[tuple[frozenset | None, bool, int]]] = []

    def node(self) -> int:
        self.edges.append([])
        return len(self.edges) - 1

    def link(self, a: int, b: int, chars: frozenset | None = None, excluded: bool = False) -> None:
        """By one of the characters (or none of them, if excluded); without characters, by nothing."""
        self.edges[a].append((chars, excluded, b))

    def free(self, nodes: frozenset[int]) -> frozenset[int]:
        seen, todo = set(nodes), list(nodes)
        while todo:
            for chars, _, b in self.edges[todo.pop()]:
                if chars is None and b not in seen:
                    seen.add(b)
                    todo.append(b)
        return frozenset(seen)


class _Rule:
    """A recursive reader of one rule; ``repeats`` counts its quantifiers."""

    def __init__(self, nfa: _Nfa, text: str):
        self.nfa, self.text, self.at, self.repeats = nfa, text, 0, 0
        self.start, self.end = self._choice()
        if self.at < len(text):
            raise ValueError(f"an unmatched bracket in {text!r}")

    def _peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def _take(self) -> str:
        if self.at >= len(self.text):
            raise ValueError(f"{self.text!r} ends too early")
        self.at += 1
        return self.text[self.at - 1]

    def _char(self) -> str:
        c = self._take()
        if c != "\\":
            return c
        e = self._take()
        return _ESCAPES.get(e, e)

    def _choice(self) -> tuple[int, int]:
        start, end = self.nfa.node(), self.nfa.node()
        while True:
            a, b = self._row()
            self.nfa.link(start, a)
            self.nfa.link(b, end)
            if self._peek() != "|":
                return start, end
            self.at += 1

    def _row(self) -> tuple[int, int]:
        start = end = self.nfa.node()
        while self._peek() and self._peek() not in "|)":
            a, b = self._unit()
            self.nfa.link(end, a)
            end = b
        return start, end

    def _unit(self) -> tuple[int, int]:
        if self._peek() == "(":
            self.at += 1
            a, b = self._choice()
            if self._take() != ")":
                raise ValueError(f"an open group in {self.text!r}")
        else:
            a, b = self.nfa.node(), self.nfa.node()
            if self._peek() == "[":
                self.at += 1
                excluded = self._peek() == "^"
                self.at += excluded
                chars: set[str] = set()
                while self._peek() != "]":
                    low = self._char()
                    if self._peek() == "-" and self.text[self.at + 1 : self.at + 2] not in ("]", ""):
                        self.at += 1
                        chars.update(map(chr, range(ord(low), ord(self._char()) + 1)))
                    else:
                        chars.add(low)
                self.at += 1
                self.nfa.link(a, b, frozenset(chars), excluded)
            else:
                self.nfa.link(a, b, frozenset([self._char()]))
        while self._peek() and self._peek() in "+*?":
            mark, x, y = self._take(), self.nfa.node(), self.nfa.node()
            self.repeats += 1
            self.nfa.link(x, a)
            self.nfa.link(b, y)
            if mark in "+*":
                self.nfa.link(b, a)
            if mark in "*?":
                self.nfa.link(x, y)
            a, b = x, y
        return a, b


class Lexer:
    """A table of states for rules ``(pattern, token)``; ``table[state][character or OTHER]`` is the next state."""

    def __init__(self, rules: list[tuple[str, int]]):
        nfa, ends, starts = _Nfa(), {}, set()
        for order, (pattern, token) in enumerate(rules):
            rule = _Rule(nfa, pattern)
            starts.add(rule.start)
            ends[rule.end] = (rule.repeats, order, token)
        named = sorted({c for edges in nfa.edges for chars, _, _ in edges if chars for c in chars})
        first = nfa.free(frozenset(starts))
        ids, todo = {first: 0}, [first]
        self.table: list[dict[str, int]] = []
        self.tokens: list[int | None] = []
        while todo:
            state = todo.pop(0)
            best = min((ends[n] for n in state if n in ends), default=None)
            self.tokens.append(best[2] if best else None)
            row = {}
            for c in [*named, OTHER]:
                to = {b for n in state for chars, excluded, b in nfa.edges[n] if chars is not None and (c in chars) != excluded}
                if to:
                    key = nfa.free(frozenset(to))
                    if key not in ids:
                        ids[key] = len(ids)
                        todo.append(key)
                    row[c] = ids[key]
            self.table.append(row)
        if self.tokens[0] is not None:
            raise ValueError("a rule matches the empty text")
        self.named = frozenset(named)
        self._merge()

    def _merge(self) -> None:
        """States that nothing tells apart become one."""
        group = [(-1 if t is None else t) for t in self.tokens]
        while True:
            keys = [(g, tuple(sorted((c, group[n]) for c, n in row.items()))) for g, row in zip(group, self.table, strict=True)]
            ids = {k: i for i, k in enumerate(dict.fromkeys(keys))}
            new = [ids[k] for k in keys]
            if len(ids) == len(set(group)):
                break
            group = new
        first = {}
        for s, g in enumerate(new):
            first.setdefault(g, s)
        self.table = [{c: new[n] for c, n in self.table[s].items()} for s in first.values()]
        self.tokens = [self.tokens[s] for s in first.values()]

    def resolve(self, text: str, error: int | None = None) -> list[tuple[str, int, int, int, int]]:
        """``(word, token, row, column, status)``: status 0 for a word of a rule; 1 for a character of none, as ``error``; without an
        ``error`` token such a character, with status 2, is the last."""
        out, at, row, column = [], 0, 1, 1
        while at < len(text):
            state, k, found = 0, at, None
            while k < len(text):
                c = text[k]
                state = self.table[state].get(c if c in self.named else OTHER)
                if state is None:
                    break
                k += 1
                if self.tokens[state] is not None:
                    found = (k, self.tokens[state])
            end, token, status = (*found, 0) if found else (at + 1, error if error is not None else -1, 1 if error is not None else 2)
            word = text[at:end]
            out.append((word, token, row, column, status))
            if status == 2:
                break
            lines = word.count("\n")
            row, column = row + lines, column + len(word) if not lines else len(word) - word.rfind("\n")
            at = end
        return out


_WORDS = "array<struct<word:string,token:int,row:int,column:int,status:int>>"


def lex(text, lexer: Lexer, error: int | None = None) -> Column:
    """The words of a text, in order."""

    @F.pandas_udf(_WORDS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: None if x is None else [dict(zip(("word", "token", "row", "column", "status"), w, strict=True)) for w in lexer.resolve(x, error)])

    return run(text)


class Parser:
    """An SLR(1) parser of productions ``(name, symbols)``, the first name the goal; what is no name is a terminal. Conflicts raise."""

    END = "$"

    def __init__(self, productions: list[tuple[str, list]]):
        self.rules = [("goal'", [productions[0][0]]), *productions]
        names = {n for n, _ in self.rules}
        self.first: dict = {n: set() for n in names}
        empty: set = set()
        changed = True
        while changed:
            changed = False
            for name, body in self.rules:
                before = len(self.first[name]), len(empty)
                for s in body:
                    self.first[name] |= self.first[s] if s in names else {s}
                    if s not in empty:
                        break
                else:
                    empty.add(name)
                changed |= before != (len(self.first[name]), len(empty))
        self.follow: dict = {n: set() for n in names}
        self.follow["goal'"].add(self.END)
        changed = True
        while changed:
            changed = False
            for name, body in self.rules:
                behind = set(self.follow[name])
                for s in reversed(body):
                    if s in names:
                        changed |= not behind <= self.follow[s]
                        self.follow[s] |= behind
                        behind = (behind if s in empty else set()) | self.first[s]
                    else:
                        behind = {s}
        start = self._closed({(0, 0)}, names)
        ids, todo = {start: 0}, [start]
        self.table: dict[tuple[int, object], tuple[str, int]] = {}
        while todo:
            items = todo.pop(0)
            state = ids[items]
            moves: dict = {}
            for rule, dot in items:
                name, body = self.rules[rule]
                if dot < len(body):
                    moves.setdefault(body[dot], set()).add((rule, dot + 1))
                elif rule == 0:
                    self._put(state, self.END, ("accept", 0))
                else:
                    for s in self.follow[name]:
                        self._put(state, s, ("reduce", rule))
            for s, kernel in moves.items():
                closed = self._closed(kernel, names)
                if closed not in ids:
                    ids[closed] = len(ids)
                    todo.append(closed)
                self._put(state, s, ("goto" if s in names else "shift", ids[closed]))

    def _closed(self, items: set, names: set) -> frozenset:
        items, todo = set(items), list(items)
        while todo:
            rule, dot = todo.pop()
            body = self.rules[rule][1]
            if dot < len(body) and body[dot] in names:
                for i, (name, _) in enumerate(self.rules):
                    if name == body[dot] and (i, 0) not in items:
                        items.add((i, 0))
                        todo.append((i, 0))
        return frozenset(items)

    def _put(self, state: int, symbol, action: tuple[str, int]) -> None:
        if self.table.get((state, symbol), action) != action:
            raise ValueError(f"the grammar isn't SLR(1): two actions on {symbol!r}")
        self.table[state, symbol] = action

    def run(self, tokens: list, listener: Callable[[str, object], str | None] | None = None) -> list[tuple[str, object]]:
        """The events shift, reduce, accept and error. A listener may answer "skip" to an error, to leave the token out."""
        states, out, at, row = [0], [], 0, [*tokens, self.END]
        while True:
            kind, n = self.table.get((states[-1], row[at]), ("error", 0))
            event = (kind, row[at] if kind in ("shift", "error", "accept") else n)
            out.append(event)
            answer = listener(*event) if listener else None
            if kind == "shift":
                states.append(n)
                at += 1
            elif kind == "reduce":
                name, body = self.rules[n]
                del states[len(states) - len(body) :]
                states.append(self.table[states[-1], name][1])
            elif kind == "error" and answer == "skip" and row[at] != self.END:
                at += 1
            else:
                return out

    def validate(self, tokens: list) -> bool:
        return self.run(tokens)[-1][0] == "accept"

    def to_rows(self) -> list[tuple[int, str, str, int]]:
        """The table as rows ``(state, symbol, action, number)``, to be kept as a DataFrame; a "rule" row has a rule's number, name and
        length."""
        rules = [(i, str(name), "rule", len(body)) for i, (name, body) in enumerate(self.rules)]
        return rules + sorted((s, str(x), a, n) for (s, x), (a, n) in self.table.items())

    @classmethod
    def from_rows(cls, rows: list[tuple[int, str, str, int]]) -> Parser:
        """The parser of a kept table, without its grammar; tokens are texts. A table without rules, with two actions for a state and
        symbol, or with actions on what isn't there raises ValueError."""
        rules = {number: (name, [None] * length) for number, name, kind, length in rows if kind == "rule"}
        parser = cls.__new__(cls)
        parser.rules = [rules[i] for i in range(len(rules)) if i in rules]
        parser.table = {}
        states = {s for s, _, kind, _ in rows if kind != "rule"}
        if not rules or len(parser.rules) != len(rules):
            raise ValueError("the table lacks rules")
        for state, symbol, kind, number in rows:
            if kind == "rule":
                continue
            if kind not in ("shift", "goto", "reduce", "accept") or (kind in ("shift", "goto") and number not in states) or (kind == "reduce" and number not in rules):
                raise ValueError(f"the table has no {kind} {number}")
            parser._put(state, symbol, (kind, number))
        return parser


def parse_events(tokens, parser: Parser) -> Column:
    """Events of an array of token texts."""

    @F.pandas_udf("array<struct<event:string,detail:string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: None if x is None else [{"event": e, "detail": str(d)} for e, d in parser.run(list(x))])

    return run(tokens)
