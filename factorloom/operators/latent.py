"""Partial ancestral graphs: what independence tells about causes when some are not observed.

``Marks`` holds the mark at b of each edge a - b: a circle (open), an arrow or a
tail.  ``orient`` applies the rules that are complete without selection
variables (Zhang's 1 to 4 and 8 to 10).
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

Marks = dict[tuple[str, str], str]
CIRCLE, ARROW, TAIL = "circle", "arrow", "tail"


class AncestralGraph:
    def __init__(self, columns: list[str], near: dict[str, set[str]]):
        self.columns, self.near = columns, near
        self.mark: Marks = {(a, b): CIRCLE for a in columns for b in near[a]}

    def colliders(self, separator: dict[frozenset[str], set[str]]) -> None:
        """Arrows into z from x and y that have no edge and were separated without z."""
        for z in self.columns:
            for x, y in itertools.combinations([c for c in self.columns if c in self.near[z]], 2):
                if y not in self.near[x] and z not in separator.get(frozenset((x, y)), set()):
                    self.mark[x, z] = self.mark[y, z] = ARROW

    def possibly_separating(self, x: str) -> set[str]:
        """Vertices that x reaches by paths on which each inner vertex is a collider or the tip of a triangle."""
        seen = {(x, v) for v in self.near[x]}
        stack = list(seen)
        while stack:
            a, b = stack.pop()
            for c in self.near[b]:
                if c not in (a, x) and (b, c) not in seen and (c in self.near[a] or (self.mark[a, b] == ARROW and self.mark[c, b] == ARROW)):
                    seen.add((b, c))
                    stack.append((b, c))
        return {v for _, v in seen} - {x}

    # -- orientation ------------------------------------------------------------

    def _is(self, a: str, b: str, at_a: str, at_b: str) -> bool:
        """Is there an edge a - b with these marks ('' for any)?"""
        return b in self.near[a] and at_a in ("", self.mark[b, a]) and at_b in ("", self.mark[a, b])

    def _set(self, a: str, b: str, mark: str) -> bool:
        if self.mark[a, b] != CIRCLE:
            return False
        self.mark[a, b] = mark
        return True

    def orient(self, separator: dict[frozenset[str], set[str]]) -> None:
        rules: list[Callable[[], bool]] = [self._arrows, lambda: self._discriminating(separator), self._tails]
        while any(rule() for rule in rules):
            pass

    def _arrows(self) -> bool:
        """Rules 1 to 3."""
        changed = False
        for a, b, c in itertools.permutations(self.columns, 3):
            if b not in self.near[a] or c not in self.near[b]:
                continue
            if c not in self.near[a] and self.mark[a, b] == ARROW and self.mark[c, b] == CIRCLE:
                changed |= self._set(c, b, TAIL)
                changed |= self._set(b, c, ARROW)
            if c in self.near[a] and self.mark[a, c] == CIRCLE and (
                (self._is(a, b, TAIL, ARROW) and self._is(b, c, "", ARROW)) or (self._is(a, b, "", ARROW) and self._is(b, c, TAIL, ARROW))
            ):
                changed |= self._set(a, c, ARROW)
            if c not in self.near[a] and self.mark[a, b] == ARROW and self.mark[c, b] == ARROW:
                for d in self.near[a] & self.near[b] & self.near[c]:
                    if self.mark[a, d] == CIRCLE and self.mark[c, d] == CIRCLE and self.mark[d, b] == CIRCLE:
                        changed |= self._set(d, b, ARROW)
        return changed

    def _discriminating_start(self, a: str, b: str, c: str) -> str | None:
        """First vertex of a path <d, .., a, b, c> on which all between d and b are colliders and parents of c, d not adjacent to c."""
        queue, seen = [a], {a, b, c}
        while queue:
            at = queue.pop(0)
            for z in (v for v in self.columns if v in self.near[at] and v not in seen):
                if self.mark[z, at] != ARROW:
                    continue
                if z not in self.near[c]:
                    return z
                if self._is(z, c, TAIL, ARROW) and self.mark[at, z] == ARROW:
                    seen.add(z)
                    queue.append(z)
        return None

    def _discriminating(self, separator: dict[frozenset[str], set[str]]) -> bool:
        """Rule 4: b is a collider between the last vertex before it and c, or no collider, as the separating set says."""
        for b, c in itertools.permutations(self.columns, 2):
            if not self._is(b, c, CIRCLE, ""):
                continue
            for a in (v for v in self.columns if v in self.near[b] and v != c):
                if self.mark[b, a] == ARROW and self._is(a, c, TAIL, ARROW) and (d := self._discriminating_start(a, b, c)) is not None:
                    if b in separator.get(frozenset((d, c)), set()):
                        self.mark[c, b], self.mark[b, c] = TAIL, ARROW
                    else:
                        self.mark[a, b] = self.mark[c, b] = self.mark[b, c] = ARROW
                    return True
        return False

    def _open_paths(self, a: str, end: str) -> Iterator[list[str]]:
        """Uncovered paths from a to ``end`` along which every edge may point away from a."""
        stack = [[a]]
        while stack:
            path = stack.pop()
            for v in self.near[path[-1]]:
                if v in path or self.mark[v, path[-1]] == ARROW or self.mark[path[-1], v] == TAIL or (len(path) > 1 and v in self.near[path[-2]]):
                    continue
                if v == end:
                    yield [*path, v]
                else:
                    stack.append([*path, v])

    def _tails(self) -> bool:
        """Rules 8 to 10: tails of edges that an arrow points along."""
        for a, c in itertools.permutations(self.columns, 2):
            if self._is(a, c, CIRCLE, ARROW) and (self._chained(a, c) or self._uncovered(a, c) or self._two_ways(a, c)):
                self.mark[c, a] = TAIL
                return True
        return False

    def _chained(self, a: str, c: str) -> bool:
        return any(self._is(b, c, TAIL, ARROW) and (self._is(a, b, TAIL, ARROW) or self._is(a, b, TAIL, CIRCLE)) for b in self.near[a] & self.near[c])

    def _uncovered(self, a: str, c: str) -> bool:
        return any(len(p) > 3 and p[1] not in self.near[c] for p in self._open_paths(a, c))

    def _two_ways(self, a: str, c: str) -> bool:
        causes = [v for v in self.columns if self._is(v, c, TAIL, ARROW) and v != a]
        firsts = {b: {p[1] for p in self._open_paths(a, b)} for b in causes}
        return any(m != w and w not in self.near[m] for b, d in itertools.combinations(causes, 2) for m in firsts[b] for w in firsts[d])
