"""A generalised LL recogniser with a graph-structured stack.

Grammars are written in a small EBNF and compiled to plain alternatives.  All start symbols given
run together over one stack: a call of a nonterminal at a position is one node, whatever calls
it, so shared parts of dialects are parsed once and ambiguity and left recursion are no trouble.
Alternatives are tried only if the next token can begin them.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Sequence

_TOKEN = re.compile(r"'[^']*'|[A-Za-z_][\w-]*|[\[\]()|*+:;]")


class Grammar:
    """``rules``: lines ``name: alternatives ;`` with ``[x]``, ``x*``, ``x+`` and ``(a | b)``; quoted or upper-case symbols are terminals."""

    def __init__(self, rules: str) -> None:
        self.alternatives: dict[str, list[tuple[str, ...]]] = {}
        self._at, self._tokens, self._fresh = 0, _TOKEN.findall(re.sub(r"(?m)#.*$", "", rules)), 0
        while self._at < len(self._tokens):
            name = self._next()
            self._expect(":")
            self.alternatives.setdefault(name, []).extend(self._choice())
            self._expect(";")
        self._compile()

    # reading

    def _peek(self) -> str | None:
        return self._tokens[self._at] if self._at < len(self._tokens) else None

    def _next(self) -> str:
        self._at += 1
        return self._tokens[self._at - 1]

    def _expect(self, t: str) -> None:
        if (got := self._next()) != t:
            raise ValueError(f"expected {t}, got {got}, near {self._tokens[self._at - 6 : self._at + 3]}")

    def _new(self, alternatives: list[tuple[str, ...]]) -> str:
        self._fresh += 1
        name = f"<{self._fresh}>"
        self.alternatives[name] = alternatives
        return name

    def _choice(self) -> list[tuple[str, ...]]:
        out = [self._sequence()]
        while self._peek() == "|":
            self._next()
            out.append(self._sequence())
        return out

    def _sequence(self) -> tuple[str, ...]:
        out: list[str] = []
        while (t := self._peek()) not in (None, "|", ")", "]", ";"):
            self._next()
            if t == "[":
                x = self._new([*self._choice(), ()])
                self._expect("]")
            elif t == "(":
                x = self._new(self._choice())
                self._expect(")")
            else:
                x = t
            if self._peek() in ("*", "+"):
                repeat = self._new([])
                self.alternatives[repeat] = [(x, repeat), ()]
                if self._next() == "+":
                    out.append(x)
                x = repeat
            out.append(x)
        return tuple(out)

    # tables

    def _compile(self) -> None:
        rules = self.alternatives
        terminal = {s for alts in rules.values() for a in alts for s in a if s not in rules}
        unknown = {s for s in terminal if not (s[0] == "'" or s.isupper())}
        if unknown:
            raise ValueError(f"undefined: {sorted(unknown)}")
        first: dict[str, set[str]] = {n: set() for n in rules}
        nullable: set[str] = set()
        changed = True
        while changed:
            changed = False
            for name, alts in rules.items():
                for a in alts:
                    empty = True
                    for s in a:
                        add = first[s] if s in rules else {s.strip("'")}
                        if not add <= first[name]:
                            first[name] |= add
                            changed = True
                        if s not in nullable:
                            empty = False
                            break
                    if empty and name not in nullable:
                        nullable.add(name)
                        changed = True
        # A slot is a place in an alternative: None ends it, a string is a terminal, a number a nonterminal.
        self.number = {n: i for i, n in enumerate(rules)}
        self.slots: list[str | int | None] = []
        self.entries: list[list[tuple[int, frozenset[str] | None]]] = []
        for alts in rules.values():
            own = []
            for a in alts:
                start: set[str] = set()
                empty = True
                for s in a:
                    start |= first[s] if s in rules else {s.strip("'")}
                    if s not in nullable:
                        empty = False
                        break
                own.append((len(self.slots), None if empty else frozenset(start)))
                self.slots += [self.number[s] if s in rules else s.strip("'") for s in a]
                self.slots.append(None)
            self.entries.append(own)

    def accepts(self, tokens: Sequence[str | frozenset[str]], starts: Collection[str]) -> set[str]:
        """The start symbols that derive the whole input.  A token may be a set of kinds."""
        slots, entries, n = self.slots, self.entries, len(tokens)
        nodes: dict[tuple[int, int], tuple[list, set, set]] = {}  # (nonterminal, position) -> edges, seen edges, ends
        work: list[tuple[int, tuple, int]] = []
        seen: set[tuple[int, int, int]] = set()
        roots = {}

        def call(what: int, at: int) -> tuple[list, set, set]:
            node = nodes[what, at] = ([], set(), set())
            t = tokens[at] if at < n else None
            for slot, start in entries[what]:
                if start is None or t is not None and (t in start if isinstance(t, str) else not start.isdisjoint(t)):
                    work.append((slot, node, at))
            return node

        for s in starts:
            roots[s] = nodes.get((self.number[s], 0)) or call(self.number[s], 0)
        while work:
            slot, node, at = work.pop()
            while True:
                x = slots[slot]
                if x is None:
                    edges, _, ends = node
                    if at not in ends:
                        ends.add(at)
                        for back, caller in edges:
                            key = (back, id(caller), at)
                            if key not in seen:
                                seen.add(key)
                                work.append((back, caller, at))
                    break
                if isinstance(x, str):
                    if at >= n:
                        break
                    t = tokens[at]
                    if t != x if isinstance(t, str) else x not in t:
                        break
                    slot, at = slot + 1, at + 1
                    continue
                callee = nodes.get((x, at))
                if callee is None:
                    callee = call(x, at)
                edges, known, ends = callee
                edge = (slot + 1, id(node))
                if edge not in known:
                    known.add(edge)
                    edges.append((slot + 1, node))
                    for end in tuple(ends):
                        key = (slot + 1, id(node), end)
                        if key not in seen:
                            seen.add(key)
                            work.append((slot + 1, node, end))
                break
        return {s for s, node in roots.items() if n in node[2]}


_OPEN, _CLOSE = frozenset("([{"), frozenset(")]}")


def squeezed(tokens: Sequence[str], long: int = 400, period: int = 12) -> list[str]:
    """Long token lists with runs of equal list items cut to three.

    An item is a balanced stretch that ends in a comma.  Lists repeat their items without a count in every
    grammar here, so three equal items in a row are accepted exactly where more of them are.
    """
    out = list(tokens)
    while len(out) > long:
        before = len(out)
        for p in range(2, period + 1):
            short: list[str] = []
            i, n = 0, len(out)
            while i < n:
                item = out[i : i + p]
                k = 1
                if i + 4 * p <= n and item[-1] == "," and _balanced(item):
                    while out[i + k * p : i + (k + 1) * p] == item:
                        k += 1
                if k > 3:
                    short += item * 3
                    i += k * p
                else:
                    short.append(out[i])
                    i += 1
            out = short
        if len(out) == before:
            break
    return out


def _balanced(item: Sequence[str]) -> bool:
    depth = 0
    for t in item:
        depth += (t in _OPEN) - (t in _CLOSE)
        if depth < 0:
            return False
    return depth == 0
