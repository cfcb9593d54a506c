"""Equivalence classes of acyclic graphs: completed partially directed graphs and the moves between them."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

from factorloom.operators.graph import Edge


class EquivalenceClass:
    """Compelled edges (``out`` and ``into`` by vertex) and reversible ones (``near``) over ordered columns."""

    def __init__(self, columns: list[str], directed: set[Edge] = frozenset(), undirected: set[frozenset[str]] = frozenset()):
        self.columns = columns
        self.out: dict[str, set[str]] = {c: set() for c in columns}
        self.into: dict[str, set[str]] = {c: set() for c in columns}
        self.near: dict[str, set[str]] = {c: set() for c in columns}
        for a, b in directed:
            self.direct(a, b)
        for a, b in map(tuple, undirected):
            self.near[a].add(b)
            self.near[b].add(a)

    def copy(self) -> EquivalenceClass:
        return EquivalenceClass(self.columns, self.directed(), self.undirected())

    def directed(self) -> set[Edge]:
        return {(a, b) for a in self.columns for b in self.out[a]}

    def undirected(self) -> set[frozenset[str]]:
        return {frozenset((a, b)) for a in self.columns for b in self.near[a]}

    def adjacent(self, a: str, b: str) -> bool:
        return b in self.near[a] or b in self.out[a] or b in self.into[a]

    def direct(self, a: str, b: str) -> None:
        self.near[a].discard(b)
        self.near[b].discard(a)
        self.out[a].add(b)
        self.into[b].add(a)

    def separate(self, a: str, b: str) -> None:
        for x, y in ((a, b), (b, a)):
            for kind in (self.near, self.out, self.into):
                kind[x].discard(y)

    def is_clique(self, some: set[str]) -> bool:
        return all(self.adjacent(a, b) for a, b in itertools.combinations(some, 2))

    def shared_neighbours(self, y: str, x: str) -> set[str]:
        """Vertices tied to y by a reversible edge and adjacent to x."""
        return {v for v in self.near[y] if v != x and self.adjacent(v, x)}

    def every_path_meets(self, start: str, end: str, blocked: set[str]) -> bool:
        """Does each path from ``start`` to ``end`` that never goes against a compelled edge pass ``blocked``?"""
        seen, stack = {start}, [start]
        while stack:
            at = stack.pop()
            for v in self.near[at] | self.out[at]:
                if v == end:
                    return False
                if v not in seen and v not in blocked:
                    seen.add(v)
                    stack.append(v)
        return True

    def extension(self) -> list[Edge]:
        """Edges of an acyclic graph of the class: sinks are taken off one by one (the last column first)."""
        rest, edges = self.copy(), self.directed()
        left = list(self.columns)
        while left:
            for x in reversed(left):
                around = rest.near[x] | rest.into[x]
                if not rest.out[x] and all(rest.adjacent(y, z) for y in rest.near[x] for z in around if z != y):
                    break
            else:
                raise ValueError("the marks belong to no acyclic graph")
            edges |= {(y, x) for y in rest.near[x]}
            for y in list(around):
                rest.separate(x, y)
            left.remove(x)
        return [(a, b) for a in self.columns for b in self.columns if (a, b) in edges]

    def completed(self) -> EquivalenceClass:
        """The class of this graph's extension, all marks as compelled as they are."""
        return class_of(self.columns, self.extension())


def orient_by_rules(columns: list[str], adjacent, directed: set[Edge], undirected: set[frozenset[str]]) -> None:
    """Orient undirected edges by Meek's rules 1 to 3 until none applies."""
    changed = True
    while changed:
        changed = False
        for a, b in itertools.permutations(columns, 2):
            if frozenset((a, b)) not in undirected:
                continue
            chain = any((k, a) in directed and not adjacent(k, b) for k in columns)
            cycle = any((a, k) in directed and (k, b) in directed for k in columns)
            kite = [k for k in columns if frozenset((a, k)) in undirected and (k, b) in directed]
            if chain or cycle or any(not adjacent(x, y) for x, y in itertools.combinations(kite, 2)):
                directed.add((a, b))
                undirected.discard(frozenset((a, b)))
                changed = True


def class_of(columns: list[str], edges: list[Edge]) -> EquivalenceClass:
    """Colliders without an edge between their causes are compelled, and what follows from them."""
    pairs = set(edges)
    adjacent = lambda a, b: (a, b) in pairs or (b, a) in pairs
    into: dict[str, list[str]] = {c: [] for c in columns}
    for a, b in edges:
        into[b].append(a)
    directed = {(a, z) for z, causes in into.items() for a in causes if any(a != b and not adjacent(a, b) for b in causes)}
    undirected = {frozenset(e) for e in edges} - {frozenset(e) for e in directed}
    orient_by_rules(columns, adjacent, directed, undirected)
    return EquivalenceClass(columns, directed, undirected)


@dataclass(frozen=True)
class Move:
    """Insert x -> y, directing ``others`` to y, or delete it, directing x and y to ``others``; ``before`` and ``after`` are y's families."""

    kind: str
    x: str
    y: str
    others: frozenset[str]
    before: frozenset[str]
    after: frozenset[str]


def _subsets(some: set[str], columns: list[str], most: int) -> Iterator[frozenset[str]]:
    ordered = [c for c in columns if c in some]
    return (frozenset(s) for k in range(min(len(ordered), most) + 1) for s in itertools.combinations(ordered, k))


def inserts(state: EquivalenceClass, max_parents: int) -> Iterator[Move]:
    """All valid insertions (Chickering's conditions), each another class with one edge more."""
    for x, y in itertools.permutations(state.columns, 2):
        if state.adjacent(x, y):
            continue
        shared, free = state.shared_neighbours(y, x), {v for v in state.near[y] if not state.adjacent(v, x)}
        for t in _subsets(free, state.columns, max_parents):
            tied = shared | t
            after = tied | state.into[y] | {x}
            if len(after) <= max_parents and state.is_clique(tied) and state.every_path_meets(y, x, tied):
                yield Move("insert", x, y, t, frozenset(after - {x}), frozenset(after))


def deletes(state: EquivalenceClass) -> Iterator[Move]:
    """All valid deletions, each another class with one edge less."""
    for x, y in itertools.permutations(state.columns, 2):
        if y not in state.near[x] and y not in state.out[x]:
            continue
        shared = state.shared_neighbours(y, x)
        for h in _subsets(shared, state.columns, len(shared)):
            if state.is_clique(shared - h):
                before = (shared - h) | state.into[y] | {x}
                yield Move("delete", x, y, h, frozenset(before), frozenset(before - {x}))


def apply(state: EquivalenceClass, move: Move) -> EquivalenceClass:
    out = state.copy()
    if move.kind == "insert":
        out.direct(move.x, move.y)
        for t in move.others:
            out.direct(t, move.y)
    else:
        out.separate(move.x, move.y)
        for h in move.others:
            out.direct(move.y, h)
            if h in out.near[move.x]:
                out.direct(move.x, h)
    return out.completed()
