"""Deterministic automata as transition arrays, and a scan of many bytes at once.

`Rule`s are compiled by subset construction, joined into one automaton and minimised.
`Automaton.scan` runs it over a buffer cut into equal lanes that advance together: every lane
first starts in the start state; where the lane before ends in another state, the lane runs again
from there until it meets the states it already has.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

LANES = 8192


def chars(text: str, fold: bool = False) -> frozenset[int]:
    """The bytes of a class such as "A-Za-z0-9_"; ranges are read as in a regular expression."""
    out: set[int] = set()
    i = 0
    while i < len(text):
        if i + 2 < len(text) and text[i + 1] == "-":
            out.update(range(ord(text[i]), ord(text[i + 2]) + 1))
            i += 3
        else:
            out.add(ord(text[i]))
            i += 1
    if fold:
        out |= {ord(chr(c).swapcase()) for c in out if chr(c).isalpha()}
    return frozenset(out)


@dataclass
class Part:
    """A fragment of positions: bytes of each, which may come first and last, and which follow which."""

    sets: list[frozenset[int]] = field(default_factory=list)
    first: set[int] = field(default_factory=set)
    last: set[int] = field(default_factory=set)
    follow: dict[int, set[int]] = field(default_factory=dict)
    empty: bool = True

    def moved(self, by: int) -> Part:
        return Part(self.sets, {p + by for p in self.first}, {p + by for p in self.last},
                    {p + by: {q + by for q in qs} for p, qs in self.follow.items()}, self.empty)

    def then(self, other: Part) -> Part:
        o = other.moved(len(self.sets))
        follow = {p: set(q) for p, q in (self.follow | o.follow).items()}
        for p in self.last:
            follow.setdefault(p, set()).update(o.first)
        return Part(self.sets + o.sets, self.first | (o.first if self.empty else set()),
                    o.last | (self.last if o.empty else set()), follow, self.empty and o.empty)

    def either(self, other: Part) -> Part:
        o = other.moved(len(self.sets))
        return Part(self.sets + o.sets, self.first | o.first, self.last | o.last, self.follow | o.follow, self.empty or o.empty)

    def optional(self) -> Part:
        return Part(self.sets, self.first, self.last, self.follow, True)

    def repeated(self) -> Part:
        follow = {p: set(q) for p, q in self.follow.items()}
        for p in self.last:
            follow.setdefault(p, set()).update(self.first)
        return Part(self.sets, self.first, self.last, follow, True)


def one(allowed: frozenset[int]) -> Part:
    return Part([allowed], {0}, {0}, {}, False)


def word(text: str, fold: bool = False) -> Part:
    out = Part()
    for c in text:
        out = out.then(one(chars(c, fold)))
    return out


def sequence(*parts: Part) -> Part:
    out = Part()
    for p in parts:
        out = out.then(p)
    return out


def choice(*parts: Part) -> Part:
    out = parts[0]
    for p in parts[1:]:
        out = out.either(p)
    return out


@dataclass(frozen=True)
class Rule:
    """`head` then a greedy run of one or more `tail` bytes; only runs of `least` tail bytes count.

    A run that is too short is used up all the same. Two heads may not reach their tails at the same
    byte from different starts.
    """

    kind: str
    head: Part
    tail: frozenset[int]
    least: int


def _rule_states(rule: Rule, byte_sets: list[int]) -> tuple[list[list[int]], list[bool]]:
    """Transitions over byte classes (each by one of its bytes) of the leftmost, greedy automaton of one rule."""
    whole = rule.head.then(one(rule.tail))
    tail = len(whole.sets) - 1
    follow = {p: set(q) for p, q in whole.follow.items()}
    follow.setdefault(tail, set()).add(tail)

    def step(state: frozenset[int], byte: int) -> frozenset[int]:
        got = {q for p in state for q in follow.get(p, ()) if byte in whole.sets[q]}
        if tail in state and got:
            return frozenset({tail})
        got |= {q for q in whole.first if byte in whole.sets[q]}
        return frozenset({tail}) if tail in got else frozenset(got)

    states, order, moves = {frozenset(): 0}, [frozenset()], []
    for state in order:
        row = []
        for byte in byte_sets:
            to = step(state, byte)
            if to not in states:
                states[to] = len(order)
                order.append(to)
            row.append(states[to])
        moves.append(row)
    return moves, [tail in s for s in order]


def classes(sets: list[frozenset[int]]) -> tuple[np.ndarray, list[int]]:
    """Bytes that no set tells apart share a class: the class of each byte, and a byte of each class."""
    seen: dict[tuple, int] = {}
    of, some = np.zeros(256, np.uint8), []
    for byte in range(256):
        key = tuple(byte in s for s in sets)
        if key not in seen:
            seen[key] = len(some)
            some.append(byte)
        of[byte] = seen[key]
    return of, some


def minimise(moves: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge states that no input tells apart: block of each state, moves and labels of the blocks."""
    block = np.unique(label, return_inverse=True)[1].ravel()
    while True:
        rows = np.column_stack([block, block[moves]])
        _, first, new = np.unique(rows, axis=0, return_index=True, return_inverse=True)
        new = new.ravel()
        if len(first) == block.max() + 1:
            return block, block[moves[np.unique(block, return_index=True)[1]]], label[np.unique(block, return_index=True)[1]]
        block = new


@dataclass(frozen=True)
class Automaton:
    moves: np.ndarray  # int32, states x classes
    byte_class: np.ndarray  # uint8, 256
    label: np.ndarray  # per state
    start: int

    def scan(self, data: np.ndarray) -> np.ndarray:
        """The state after each byte."""
        n, width = len(data), self.moves.shape[1]
        if not n:
            return np.zeros(0, np.int32)
        lanes = max(1, min(LANES, n // 64))
        steps = -(-n // lanes)
        padded = np.zeros(lanes * steps, np.uint8)
        padded[:n] = self.byte_class[data]
        cls = np.ascontiguousarray(padded.reshape(lanes, steps).T).astype(np.int32)
        table = (self.moves.astype(np.int32) * width).ravel()
        out = np.empty((steps, lanes), np.int32)
        state = np.full(lanes, self.start * width, np.int32)
        for s in range(steps):
            state = table.take(state + cls[s])
            out[s] = state
        begun = np.full(lanes, self.start * width, np.int32)
        while True:
            due = begun.copy()
            due[1:] = out[-1, :-1]
            lane = np.flatnonzero(due != begun)
            if not len(lane):
                break
            begun, state = due, due[lane]
            for s in range(steps):
                state = table.take(state + cls[s, lane])
                differs = state != out[s, lane]
                out[s, lane] = state
                lane, state = lane[differs], state[differs]
                if not len(lane):
                    break
        return (out.T.reshape(-1)[:n]) // width


def combine(rules: list[Rule]) -> Automaton:
    """One minimal automaton for all rules; bit i of a state's label: rule i is inside its tail."""
    of, some = classes([s for r in rules for s in [*r.head.sets, r.tail]])
    parts = [_rule_states(r, some) for r in rules]
    start = (0,) * len(rules)
    states, order, moves = {start: 0}, [start], []
    for state in order:
        row = []
        for c in range(len(some)):
            to = tuple(p[0][s][c] for p, s in zip(parts, state, strict=True))
            if to not in states:
                states[to] = len(order)
                order.append(to)
            row.append(states[to])
        moves.append(row)
    label = np.array([sum(p[1][s] << i for i, (p, s) in enumerate(zip(parts, state, strict=True))) for state in order])
    block, small, labels = minimise(np.array(moves), label)
    return Automaton(small.astype(np.int32), of, labels, int(block[0]))


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of True."""
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
