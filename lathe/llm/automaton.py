"""Regexes over bytes compiled together into one minimal deterministic automaton.

Each rule becomes a Thompson NFA, each NFA a leftmost-first search automaton by subset construction over ordered
state lists, and all of them one product automaton, minimised by partition refinement. A scan of all rules reads
every byte once: the transition array tells, besides the next state, which rules' matches ended before this byte.
The start of a match is found by the automaton of the reversed rule, from the end backwards.

A rule is taken only if a match that has been reached can only be extended byte by byte (as with a trailing ``+``
or ``{n,}``); then nothing has to be read twice. Others raise ValueError.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

MATCH = -1
_CLASSES = {"d": set(range(48, 58)), "w": {*range(48, 58), *range(65, 91), *range(97, 123), 95}, "s": {32, *range(9, 14)}}
_ESCAPES = {"n": 10, "t": 9, "r": 13, "f": 12, "v": 11}


class _Parser:
    """Literals, escapes, classes, groups, ``(?i:...)``, ``|``, ``? * + {m} {m,} {m,n}``; ASCII only."""

    def __init__(self, text: str):
        self.s, self.i, self.fold = text, 0, False

    def peek(self) -> str:
        return self.s[self.i : self.i + 1]

    def take(self) -> str:
        self.i += 1
        return self.s[self.i - 1]

    def parse(self):
        tree = self.alternation()
        if self.i < len(self.s):
            raise ValueError(f"stray {self.peek()!r} in {self.s!r}")
        return tree

    def alternation(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("alt", options)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeat(self.atom()))
        return ("seq", parts)

    def repeat(self, node):
        while (c := self.peek()) and c in "?*+{":
            self.take()
            if c == "{":
                end = self.s.index("}", self.i)
                low, comma, high = self.s[self.i : end].partition(",")
                self.i = end + 1
                lo, hi = int(low), (int(high) if high else None) if comma else int(low)
            else:
                lo, hi = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            node = ("rep", node, lo, hi)
        return node

    def atom(self):
        c = self.take()
        if c == "(":
            before = self.fold
            if self.s.startswith("?i:", self.i):
                self.i, self.fold = self.i + 3, True
            elif self.s.startswith("?:", self.i):
                self.i += 2
            tree = self.alternation()
            if self.peek() != ")":
                raise ValueError(f"no ) in {self.s!r}")
            self.take()
            self.fold = before
            return tree
        if c == "[":
            return ("set", self.folded(self.bracket()))
        if c == ".":
            return ("set", frozenset(set(range(256)) - {10}))
        if c == "\\":
            return ("set", self.folded(self.escape()))
        return ("set", self.folded({self.code(c)}))

    @staticmethod
    def code(c: str) -> int:
        if ord(c) > 127:
            raise ValueError("rules are ASCII")
        return ord(c)

    def escape(self) -> set[int]:
        c = self.take()
        if c == "x":
            self.i += 2
            return {int(self.s[self.i - 2 : self.i], 16)}
        return _CLASSES.get(c) or {_ESCAPES.get(c, ord(c))}

    def bracket(self) -> set[int]:
        negated = self.peek() == "^"
        if negated:
            self.take()
        found: set[int] = set()
        first = True
        while first or self.peek() != "]":
            first = False
            c = self.take()
            one = self.escape() if c == "\\" else {self.code(c)}
            if len(one) == 1 and self.peek() == "-" and self.s[self.i + 1 : self.i + 2] not in ("]", ""):
                self.take()
                d = self.take()
                high = min(self.escape()) if d == "\\" else self.code(d)
                one = set(range(min(one), high + 1))
            found |= one
        self.take()
        return set(range(256)) - found if negated else found

    def folded(self, chars: set[int]) -> frozenset[int]:
        if self.fold:
            chars = chars | {c ^ 32 for c in chars if 65 <= c <= 90 or 97 <= c <= 122}
        return frozenset(chars)


class Nfa:
    """Edges in order of preference: states are ('set', bytes, next), ('split', [nexts]) or ('match',)."""

    def __init__(self, pattern: str, backwards: bool = False):
        self.states: list[tuple] = []
        self.backwards = backwards
        end = self.add(("match",))
        self.start = self.build(_Parser(pattern).parse(), end)

    def add(self, state: tuple) -> int:
        self.states.append(state)
        return len(self.states) - 1

    def build(self, node, to: int) -> int:
        kind = node[0]
        if kind == "set":
            return self.add(("set", node[1], to))
        if kind == "seq":
            for part in node[1] if self.backwards else reversed(node[1]):
                to = self.build(part, to)
            return to
        if kind == "alt":
            return self.add(("split", [self.build(x, to) for x in node[1]]))
        _, inner, lo, hi = node
        if hi is None:
            loop = self.add(("split", []))
            self.states[loop][1].extend([self.build(inner, loop), to])
            to = loop
        else:
            for _ in range(hi - lo):
                to = self.add(("split", [self.build(inner, to), to]))
        for _ in range(lo):
            to = self.build(inner, to)
        return to

    def closure(self, seeds) -> tuple[int, ...]:
        """States that read a byte, best first, up to the first match, written as MATCH."""
        out: list[int] = []
        seen: set[int] = set()
        stack = list(reversed(list(seeds)))
        while stack:
            k = stack.pop()
            if k in seen:
                continue
            seen.add(k)
            state = self.states[k]
            if state[0] == "split":
                stack.extend(reversed(state[1]))
            elif state[0] == "match":
                out.append(MATCH)
                break
            else:
                out.append(k)
        return tuple(out)

    def step(self, now: tuple[int, ...], byte: int) -> tuple[int, ...]:
        return self.closure(self.states[k][2] for k in now if k != MATCH and byte in self.states[k][1])


class Search:
    """Leftmost-first search for one rule; states are (threads, matched before): the start is tried anew until a match."""

    def __init__(self, pattern: str):
        self.nfa = Nfa(pattern)
        if MATCH in self.nfa.closure([self.nfa.start]):
            raise ValueError(f"{pattern!r} matches nothing at all")
        self.first = (self.nfa.closure([self.nfa.start]), False)

    def step(self, state: tuple, byte: int) -> tuple[tuple, bool]:
        """The next state, and whether a match ended before this byte."""
        threads, held = state
        nfa = self.nfa
        seeds = [nfa.states[k][2] for k in threads if k != MATCH and byte in nfa.states[k][1]]
        if held:
            now = nfa.closure(seeds)
            if not now:
                return self.step(self.first, byte)[0], True
            if now[-1] != MATCH:
                raise ValueError("a match of this rule can grow through something that is no match; it would have to be read twice")
            return (now, True), False
        now = nfa.closure([*seeds, nfa.start])
        return (now, now[-1:] == (MATCH,)), False


def _compiled(search: Search, sample: list[int]) -> tuple[list, list, list]:
    """The minimal search automaton of one rule: next states, reports and open matches, by state and byte class."""
    ids, todo, nexts, ends = {search.first: 0}, [search.first], [], []
    for state in todo:
        row = [search.step(state, b) for b in sample]
        for to, _ in row:
            if to not in ids:
                ids[to] = len(todo)
                todo.append(to)
        nexts.append([ids[to] for to, _ in row])
        ends.append([int(e) for _, e in row])
    to, said, open_ = _minimised(np.array(nexts), np.array(ends), np.array([int(state[1]) for state in todo]))
    return to.tolist(), said.tolist(), open_


def _minimised(nexts: np.ndarray, ends: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """Moore's refinement: states stay together while they report alike and lead to the same blocks. State 0 stays first."""
    block = np.unique(np.column_stack([open_, ends]), axis=0, return_inverse=True)[1].ravel()
    while True:
        finer = np.unique(np.column_stack([block, block[nexts]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    name: dict[int, int] = {}
    order = []
    for k, b in enumerate(block.tolist()):
        if b not in name:
            name[b] = len(order)
            order.append(k)
    names = np.array([name[b] for b in range(len(order))])
    return names[block[nexts[order]]], ends[order], open_[order].tolist()


@dataclass(frozen=True)
class Rule:
    """``pattern`` is scanned for; ``kept`` (optional) then says whether a match, as bytes, counts."""

    kind: str
    pattern: str
    kept: object = field(default=None, compare=False)


class Automaton:
    """All rules in one transition array. ``scan`` gives (kind index, start, end) in bytes, ends in ascending order."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        searches = [Search(r.pattern) for r in rules]
        self.backwards = [_Backwards(r.pattern) for r in rules]
        sets = {s[1] for q in searches for s in q.nfa.states if s[0] == "set"}
        kinds: dict[tuple, int] = {}
        self.byte_class = np.array([kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)])
        sample = [int(np.argmax(self.byte_class == k)) for k in range(len(kinds))]
        parts = [_compiled(q, sample) for q in searches]
        start = (0,) * len(parts)
        ids, todo, nexts, ends = {start: 0}, [start], [], []
        for state in todo:
            row = list(zip(*(p[0][s] for p, s in zip(parts, state, strict=True)), strict=True))
            for to in row:
                if to not in ids:
                    ids[to] = len(todo)
                    todo.append(to)
            nexts.append([ids[to] for to in row])
            ends.append([sum(1 << r for r, e in enumerate(es) if e) for es in zip(*(p[1][s] for p, s in zip(parts, state, strict=True)), strict=True)])
        open_ = [sum(1 << r for r, (p, s) in enumerate(zip(parts, state, strict=True)) if p[2][s]) for state in todo]
        to, said, self.still_open = _minimised(np.array(nexts), np.array(ends), np.array(open_))
        self.n_states = len(to)
        #: state * 256 + byte gives the next state * 256, or from ``limit`` on a report: (rules, next state * 256).
        self.limit = self.n_states * 256
        self.reports: list[tuple[list[int], int]] = []
        numbers: dict[tuple[int, int], int] = {}
        table = to * 256
        for s, c in zip(*np.nonzero(said), strict=True):
            key = (int(said[s, c]), int(to[s, c]))
            if key not in numbers:
                numbers[key] = len(self.reports)
                self.reports.append(([r for r in range(len(self.rules)) if key[0] >> r & 1], key[1] * 256))
            table[s, c] = self.limit + numbers[key]
        self.table: list[int] = table[:, self.byte_class].ravel().tolist()

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        table, limit, reports = self.table, self.limit, self.reports
        ends: list[tuple[int, int]] = []
        s = 0
        for at, b in enumerate(data):
            s = table[s + b]
            if s >= limit:
                rules, s = reports[s - limit]
                for r in rules:
                    ends.append((r, at))
        held = self.still_open[s >> 8]
        ends += [(r, len(data)) for r in range(len(self.rules)) if held >> r & 1]
        last = [0] * len(self.rules)
        found = []
        for r, end in ends:
            start = self.backwards[r].longest(data, end, last[r])
            last[r] = end
            kept = self.rules[r].kept
            if kept is None or kept(data[start:end]):
                found.append((r, start, end))
        return found


class _Backwards:
    """The reversed rule, made deterministic as it is needed."""

    def __init__(self, pattern: str):
        self.nfa = Nfa(pattern, backwards=True)
        self.first = self._all([self.nfa.start])
        self.known: dict = {}

    def _all(self, seeds) -> frozenset[int]:
        out, stack = set(), list(seeds)
        while stack:
            k = stack.pop()
            if k not in out:
                out.add(k)
                if self.nfa.states[k][0] == "split":
                    stack.extend(self.nfa.states[k][1])
        return frozenset(out)

    def longest(self, data: bytes, end: int, bound: int) -> int:
        state, at, found = self.first, end, end
        while at > bound:
            key = (state, data[at - 1])
            if key not in self.known:
                self.known[key] = self._all(s[2] for k in state if (s := self.nfa.states[k])[0] == "set" and key[1] in s[1])
            state = self.known[key]
            if not state:
                break
            at -= 1
            if 0 in state:  # the match state is built first
                found = at
        return found
