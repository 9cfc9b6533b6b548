"""Rule expressions to one minimal deterministic automaton over bytes.

The syntax is that of the rules here: literals, escapes, classes of single bytes, groups,
alternatives and the repeats ? * + {m} {m,n}. Everything else is refused.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

_TOKEN = re.compile(r"\\x[0-9A-Fa-f]{2}|\\.|\[(?:\\.|[^\]\\])+\]|\{\d+(?:,\d*)?\}|.", re.S)


def _byte(token: str) -> int:
    return int(token[2:], 16) if token[:2] == "\\x" and len(token) == 4 else ord(token[-1])


def _class(body: str) -> frozenset[int]:
    items, out = re.findall(r"\\x[0-9A-Fa-f]{2}|\\.|.", body, re.S), set()
    i = 0
    while i < len(items):
        if i + 2 < len(items) and items[i + 1] == "-":
            out.update(range(_byte(items[i]), _byte(items[i + 2]) + 1))
            i += 3
        else:
            out.add(_byte(items[i]))
            i += 1
    return frozenset(out)


class Nfa:
    """Thompson's construction; states are integers, `empty` and `step` their edges."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.step: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.step.append(None)
        return len(self.empty) - 1

    def add(self, rule: str, ignore_case: bool = False) -> tuple[int, int]:
        tokens = _TOKEN.findall(rule)

        def either(i: int, a: int) -> tuple[int, int]:
            end = self.state()
            while True:
                begin = self.state()
                self.empty[a].append(begin)
                i, last = sequence(i, begin)
                self.empty[last].append(end)
                if i >= len(tokens) or tokens[i] != "|":
                    return i, end
                i += 1

        def sequence(i: int, a: int) -> tuple[int, int]:
            while i < len(tokens) and tokens[i] not in ("|", ")"):
                low, high, after = 1, 1, unit_end(i)
                if after < len(tokens) and (t := tokens[after])[0] in "?*+{":
                    m, _, n = t.strip("{}").partition(",") if t[0] == "{" else ("", "", "")
                    low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(t) or (int(m), int(n) if n else (None if "," in t else int(m)))
                    follow = after + 1
                else:
                    follow = after
                for _ in range(low):
                    a = unit(i, a)
                if high is None:
                    loop = self.state()
                    self.empty[a].append(loop)
                    back = unit(i, loop)
                    self.empty[back].append(loop)
                    a = loop
                else:
                    skips = [a]
                    for _ in range(high - low):
                        a = unit(i, a)
                        skips.append(a)
                    end = self.state()
                    for s in skips:
                        self.empty[s].append(end)
                    a = end
                i = follow
            return i, a

        def unit_end(i: int) -> int:
            if tokens[i] != "(":
                return i + 1
            depth = 0
            while True:
                depth += (tokens[i] == "(") - (tokens[i] == ")")
                i += 1
                if not depth:
                    return i

        def unit(i: int, a: int) -> int:
            t = tokens[i]
            if t == "(":
                return either(i + 1, a)[1]
            if t in ("*", "+", "?", ".", "^", "$"):
                raise ValueError(f"{t} stands alone in {rule!r}")
            own = _class(t[1:-1]) if t[0] == "[" and len(t) > 1 else frozenset([_byte(t)])
            if ignore_case:
                own |= {b ^ 32 for b in own if chr(b).isalpha() and b < 128}
            b = self.state()
            if self.step[a] is not None:  # a state has one byte edge at most
                self.empty[a].append(fresh := self.state())
                a = fresh
            self.step[a] = (own, b)
            return b

        begin = self.state()
        i, end = either(0, begin)
        if i < len(tokens):
            raise ValueError(f"unbalanced: {rule!r}")
        return begin, end


@dataclass(frozen=True)
class Dfa:
    """A minimal automaton: next state at [state * 256 + byte], accept mask by state; state 0 is the start, and no way leads out of `dead` (-1: there is no such state)."""

    nexts: np.ndarray
    accepts: np.ndarray
    dead: int

    def furthest(self, data: bytes, at: int, stop: int, step: int) -> int | None:
        """The last place in an accepting state on the way from `at` towards `stop`; the byte read at a place p is p, or p - 1 on the way back (step -1)."""
        nexts, accepts, dead, state, found = *self.lists(), 0, None
        while at != stop:
            state = nexts[state << 8 | data[at if step > 0 else at - 1]]
            at += step
            if state == dead:
                break
            if accepts[state]:
                found = at
        return found

    def lists(self) -> tuple[list[int], list[int], int]:
        if "_lists" not in self.__dict__:
            self.__dict__["_lists"] = (self.nexts.tolist(), self.accepts.tolist(), self.dead)
        return self.__dict__["_lists"]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_lists"}


def search_automaton(rules: list[tuple[str, bool]]) -> Dfa:
    """One automaton that finds where a match of any rule ends; matches may begin anywhere. Bit k of a mask stands for rule k."""
    nfa, ends, begins = Nfa(), {}, []
    for k, (rule, ignore_case) in enumerate(rules):
        begin, end = nfa.add(rule, ignore_case)
        begins.append(begin)
        ends[end] = 1 << k
    return _minimal(nfa.empty, [[e] if e else [] for e in nfa.step], begins, ends, anywhere=True)


def match_automaton(rule: str, ignore_case: bool = False) -> Dfa:
    """One rule's automaton, matches beginning at the place where it starts."""
    nfa = Nfa()
    begin, end = nfa.add(rule, ignore_case)
    return _minimal(nfa.empty, [[e] if e else [] for e in nfa.step], [begin], {end: 1}, anywhere=False)


def backward_automaton(rule: str, ignore_case: bool = False) -> Dfa:
    """One rule's automaton read from a match's end to its beginning."""
    nfa = Nfa()
    begin, end = nfa.add(rule, ignore_case)
    empty: list[list[int]] = [[] for _ in nfa.empty]
    steps: list[list[tuple[frozenset[int], int]]] = [[] for _ in nfa.empty]
    for state, (nexts, edge) in enumerate(zip(nfa.empty, nfa.step, strict=True)):
        for to in nexts:
            empty[to].append(state)
        if edge:
            steps[edge[1]].append((edge[0], state))
    return _minimal(empty, steps, [end], {begin: 1}, anywhere=False)


def _minimal(empty: list[list[int]], steps: list[list[tuple[frozenset[int], int]]], begins: list[int], ends: dict[int, int], anywhere: bool) -> Dfa:
    """Subset construction over byte classes (anywhere: with the start set kept alive), then Moore's partition refinement."""

    def closure(states: frozenset[int]) -> frozenset[int]:
        out, todo = set(states), list(states)
        while todo:
            for t in empty[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return frozenset(s for s in out if steps[s] or s in ends)

    distinct = list({edge[0] for edges in steps for edge in edges})
    kinds: dict[tuple[bool, ...], int] = {}
    kind = np.array([kinds.setdefault(tuple(b in c for c in distinct), len(kinds)) for b in range(256)])
    sample = [int(np.flatnonzero(kind == k)[0]) for k in range(len(kinds))]
    again = frozenset(begins if anywhere else [])
    memo: dict[frozenset[int], frozenset[int]] = {}
    start = closure(frozenset(begins))
    index, table, todo = {start: 0}, [], [start]
    for states in todo:
        row = []
        for b in sample:
            moved = frozenset(to for s in states for own, to in steps[s] if b in own)
            if moved not in memo:
                memo[moved] = closure(moved | again)
            to = memo[moved]
            if to not in index:
                index[to] = len(index)
                todo.append(to)
            row.append(index[to])
        table.append(row)
    moves = np.array(table)
    accept = np.array([sum(ends[s] for s in states if s in ends) for states in todo])
    _, block = np.unique(accept, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([block, block[moves]]), axis=0, return_inverse=True)
        if finer.max() == block.max():
            break
        block = finer.reshape(-1)
    number = {int(block[0]): 0}
    for b in block:
        number.setdefault(int(b), len(number))
    block = np.array([number[int(b)] for b in block])
    first = np.zeros(len(number), np.int64)
    first[block[::-1]] = np.arange(len(block))[::-1]
    small, accepts = block[moves[first]], accept[first].astype(np.int32)
    dead = [k for k in range(len(first)) if not accepts[k] and (small[k] == k).all()]
    return Dfa(small[:, kind].astype(np.int32).reshape(-1), accepts, dead[0] if dead and not anywhere else -1)
