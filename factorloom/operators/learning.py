"""Structure learning: moves on the driver, the scores and tests of families in Spark.

What a search keeps here are graphs, one score a family it looked at and one
separating set a pair; counts stay in Spark (``SufficientStatistics``).
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np

from factorloom.model import Network
from factorloom.operators.equivalence import EquivalenceClass, apply, deletes, inserts, orient_by_rules
from factorloom.operators.graph import Edge, force_acyclic, reaches, topological_order
from factorloom.operators.latent import AncestralGraph
from factorloom.operators.statistics import SufficientStatistics, chi2_sf

TIE = 1e-9
#: Families that are scored or tested together: bounds what is listed and held at a time.
FAMILIES_PER_JOB = 5000


@dataclass
class Learned:
    network: Network
    edges: list[Edge]
    score: float = 0.0
    details: dict = field(default_factory=dict)


class FamilyScores:
    """Memoised local scores; ``ask`` has many families scored together."""

    def __init__(self, stats: SufficientStatistics, kind: str = "bic", sample_prior: float = 1.0, structure_prior: float = 0.0):
        self.stats, self.kind, self.prior, self.structure = stats, kind, sample_prior, structure_prior
        self.memo: dict[tuple[str, frozenset[str]], float] = {}
        #: Sums over many rows in no fixed order differ by rounding.
        self.tie = TIE if stats.local is not None else max(TIE, 1e-13 * stats.n * math.log(stats.n + 1))

    def ask(self, families: Iterable[tuple[str, frozenset[str]]]) -> None:
        for some in itertools.batched((f for f in families if f not in self.memo), FAMILIES_PER_JOB):
            todo = list(dict.fromkeys(some))
            in_order = [(child, tuple(c for c in self.stats.columns if c in parents)) for child, parents in todo]
            for f, score in zip(todo, self.stats.scores(in_order, self.kind, self.prior), strict=True):
                self.memo[f] = score - self.structure * len(f[1])

    def __call__(self, child: str, parents) -> float:
        key = (child, frozenset(parents))
        if key not in self.memo:
            self.ask([key])
        return self.memo[key]

    def total(self, parents: dict[str, set[str]]) -> float:
        return sum(self(c, p) for c, p in parents.items())


def _edges(parents: dict[str, set[str]], columns: list[str]) -> list[Edge]:
    return [(p, c) for p in columns for c in columns if p in parents[c]]


def _improve(scores: FamilyScores, columns: list[str], parents: dict[str, set[str]], moves: set[str], max_parents: int, max_iterations: int) -> list[tuple[str, Edge]]:
    """Best strict improvement at a time; only changed families are rescored; ties go to the first move."""
    made = []
    for _ in range(max_iterations):
        edges = _edges(parents, columns)
        options = []
        for i, j in itertools.permutations(columns, 2):
            if i in parents[j]:
                if "remove" in moves:
                    options.append(("remove", i, j, {j: parents[j] - {i}}))
                rest = [e for e in edges if e != (i, j)]
                if "reverse" in moves and len(parents[i]) < max_parents and not reaches(rest, i, j):
                    options.append(("reverse", i, j, {j: parents[j] - {i}, i: parents[i] | {j}}))
            elif "add" in moves and j not in parents[i] and len(parents[j]) < max_parents and not reaches(edges, j, i):
                options.append(("add", i, j, {j: parents[j] | {i}}))
        scores.ask([(c, frozenset(p)) for *_, change in options for c, p in change.items()])
        best, gain = None, scores.tie
        for option in options:
            delta = sum(scores(c, p) - scores(c, parents[c]) for c, p in option[3].items())
            if delta > gain + (scores.tie if best else 0):
                best, gain = option, delta
        if best is None:
            break
        parents.update({c: set(p) for c, p in best[3].items()})
        made.append((best[0], (best[1], best[2])))
    return made


def _result(stats: SufficientStatistics, scores: FamilyScores, parents: dict[str, set[str]], **details) -> Learned:
    edges = _edges(parents, stats.columns)
    return Learned(stats.laplace_network(edges), edges, scores.total(parents), details)


def hill_climb(stats: SufficientStatistics, score: str = "bic", max_parents: int = 3, max_iterations: int = 1000, restarts: int = 0, seed: int = 1, edge_probability: float = 0.3) -> Learned:
    """Add, remove and reverse edges; restarts begin at seeded random graphs."""
    scores, best = FamilyScores(stats, score), None
    draw = random.Random(seed)
    for turn in range(restarts + 1):
        parents: dict[str, set[str]] = {c: set() for c in stats.columns}
        if turn:
            order = draw.sample(stats.columns, len(stats.columns))
            for a, b in itertools.combinations(order, 2):
                if draw.random() < edge_probability and len(parents[b]) < max_parents:
                    parents[b].add(a)
        moves = _improve(scores, stats.columns, parents, {"add", "remove", "reverse"}, max_parents, max_iterations)
        found = _result(stats, scores, parents, moves=moves)
        if best is None or found.score > best.score + scores.tie:
            best = found
    return best


def greedy_forward_backward(stats: SufficientStatistics, score: str = "bic", max_parents: int = 3, max_iterations: int = 1000) -> Learned:
    """First only additions, then only removals, over directed acyclic graphs."""
    scores = FamilyScores(stats, score)
    parents: dict[str, set[str]] = {c: set() for c in stats.columns}
    moves = _improve(scores, stats.columns, parents, {"add"}, max_parents, max_iterations)
    moves += _improve(scores, stats.columns, parents, {"remove"}, max_parents, max_iterations)
    return _result(stats, scores, parents, moves=moves)


def mulberry32(seed: int):
    """The 32-bit generator whose draws seeded restarts are defined by (a published generator; its constants are fixed values)."""
    state = seed & 0xFFFFFFFF
    while True:
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        x = ((state ^ (state >> 15)) * (state | 1)) & 0xFFFFFFFF
        x ^= (x + (((x ^ (x >> 7)) * (x | 61)) & 0xFFFFFFFF)) & 0xFFFFFFFF
        yield ((x ^ (x >> 14)) & 0xFFFFFFFF) / 4294967296


def order_search(stats: SufficientStatistics, score: str = "bic", max_parents: int = 3, restarts: int = 2, seed: int = 42, structure_prior: float = 0.0, sample_prior: float = 1.0) -> Learned:
    """Search over orders by adjacent swaps; each variable takes its best parents among its predecessors."""
    scores = FamilyScores(stats, score, sample_prior, structure_prior)
    columns, draw = stats.columns, mulberry32(seed)

    def parent_sets(before: list[str]) -> Iterator[frozenset[str]]:
        return (frozenset(s) for k in range(min(len(before), max_parents) + 1) for s in itertools.combinations(before, k))

    def ask(orders: list[list[str]]) -> None:
        """Have the families of several orders scored together; a swap changes the predecessors of one variable."""
        places = dict.fromkeys((c, frozenset(order[:k])) for order in orders for k, c in enumerate(order))
        asked.update(fresh := {p: None for p in places if p not in asked})
        scores.ask((c, o) for c, before in fresh for o in parent_sets(sorted(before, key=columns.index)))

    asked: dict[tuple[str, frozenset[str]], None] = {}

    def best_parents(child: str, before: list[str]) -> frozenset[str]:
        best = frozenset()
        for o in parent_sets(before):
            if scores(child, o) > scores(child, best) + scores.tie:
                best = o
        return best

    def value(order: list[str]) -> tuple[float, dict[str, set[str]]]:
        parents = {c: set(best_parents(c, order[:k])) for k, c in enumerate(order)}
        return scores.total(parents), parents

    def entropy(c: str) -> float:
        p = stats.family((c,)) / stats.n
        return -float((p[p > 0] * np.log(p[p > 0])).sum())

    best: tuple[float, dict] | None = None
    for turn in range(restarts + 1):
        if turn == 0:
            order = sorted(columns, key=lambda c: -entropy(c))
        else:
            order = list(columns)
            for i in range(len(order) - 1, 0, -1):
                j = math.floor(next(draw) * (i + 1))
                order[i], order[j] = order[j], order[i]
        ask([order])
        now = value(order)
        while True:
            swaps = [[*order[:k], order[k + 1], order[k], *order[k + 2 :]] for k in range(len(order) - 1)]
            ask(swaps)
            tries = [(value(swapped), swapped) for swapped in swaps]
            top = max(tries, key=lambda t: t[0][0], default=None)
            if top is None or top[0][0] <= now[0] + scores.tie:
                break
            now, order = top
        if best is None or now[0] > best[0] + scores.tie:
            best = now
    return _result(stats, scores, best[1])


# constraint-based

class PairTests:
    """Tests of pairs of columns given sets, in sub-batches.

    A level of the search is a list of pairs, each with a lazy sequence of
    sets.  Pairs are judged one after the other; when a result is missing, one
    sub-batch of at most ``per_job`` tests fetches what this pair needs next
    and the first sets of the pairs behind it.  A pair that a batch separates
    asks for no more, and results go when their pair is judged.
    """

    def __init__(self, stats: SufficientStatistics, alpha: float, kind: str, per_job: int | None = None):
        self.stats, self.alpha, self.kind = stats, alpha, kind
        self.per_job = per_job or FAMILIES_PER_JOB
        self.results: dict[tuple[str, str], dict[tuple[str, ...], bool]] = {}
        self.made = 0

    def _fetch(self, wanted: list[tuple[str, str, tuple[str, ...]]]) -> None:
        for (x, y, s), (statistic, df) in zip(wanted, self.stats.tests(wanted, self.kind), strict=True):
            self.results.setdefault((x, y), {})[s] = chi2_sf(statistic, df) > self.alpha

    def separator(self, x: str, y: str, sets: Iterator[tuple[str, ...]], behind: Iterator[tuple[str, str, Iterator[tuple[str, ...]]]]) -> tuple[str, ...] | None:
        """The first of ``sets`` given which x and y are independent; ``behind`` are the pairs that come next."""
        ahead: list[tuple[str, ...]] = []
        try:
            while True:
                s = ahead.pop(0) if ahead else next(sets, None)
                if s is None:
                    return None
                known = self.results.setdefault((x, y), {})
                if s not in known:
                    if self.stats.local is not None:
                        self._fetch([(x, y, s)])
                    else:
                        ahead += itertools.islice(sets, max(1, self.per_job // 2) - 1 - len(ahead))
                        batch = [(x, y, o) for o in (s, *ahead) if o not in known]
                        while len(batch) < self.per_job and (pair := next(behind, None)) is not None:
                            if pair[:2] not in self.results:
                                batch += [(*pair[:2], o) for o in itertools.islice(pair[2], min(8, self.per_job - len(batch)))]
                        self._fetch(batch)
                self.made += 1
                if self.results[x, y][s]:
                    return s
                del self.results[x, y][s]
        finally:
            self.results.pop((x, y), None)


def _conditioning_sets(columns: list[str], view: dict[str, set[str]], x: str, y: str, size: int) -> Iterator[tuple[str, ...]]:
    """Sets of neighbours of x, then of y, each once."""
    of_x = [c for c in columns if c in view[x] and c != y]
    yield from itertools.combinations(of_x, size)
    seen = set(of_x)
    yield from (s for s in itertools.combinations([c for c in columns if c in view[y] and c != x], size) if not seen.issuperset(s))


def _skeleton(stats: SufficientStatistics, alpha: float, kind: str, max_conditioning: int | None, stable: bool, per_job: int | None = None, every_level: bool = False):
    """Neighbours, separating sets and number of tests; a level that separates nothing is the last one, unless ``every_level``."""
    columns = stats.columns
    near = {c: {o for o in columns if o != c} for c in columns}
    separator: dict[frozenset[str], set[str]] = {}
    tests = PairTests(stats, alpha, kind, per_job)
    limit = len(columns) - 2 if max_conditioning is None else min(max_conditioning, len(columns) - 2)
    for size in range(limit + 1):
        changed, view = False, {c: set(s) for c, s in near.items()} if stable else near
        linked = [(x, y) for x, y in itertools.combinations(columns, 2) if y in near[x]]
        for k, (x, y) in enumerate(linked):
            behind = ((a, b, _conditioning_sets(columns, view, a, b, size)) for a, b in linked[k + 1 :])
            s = tests.separator(x, y, _conditioning_sets(columns, view, x, y, size), behind)
            if s is not None:
                near[x].discard(y)
                near[y].discard(x)
                separator[frozenset((x, y))] = set(s)
                changed = True
        if not changed and size > 0 and not every_level:
            break
    return near, separator, tests.made


def pc(stats: SufficientStatistics, alpha: float = 0.05, test: str = "chi2", max_conditioning: int | None = None, variant: str = "original") -> Learned:
    """PC: skeleton, colliders, Meek rules; what stays undirected points to the later column."""
    columns = stats.columns
    near, separator, tests = _skeleton(stats, alpha, test, max_conditioning, variant == "stable")
    directed: set[Edge] = set()
    undirected = {frozenset((a, b)) for a in columns for b in near[a]}
    for z in columns:
        for x, y in itertools.combinations([c for c in columns if c in near[z]], 2):
            if y not in near[x] and z not in separator.get(frozenset((x, y)), set()):
                directed |= {(x, z), (y, z)}
                undirected -= {frozenset((x, z)), frozenset((y, z))}
    orient_by_rules(columns, lambda a, b: b in near[a], directed, undirected)
    cpdag = (set(directed), set(undirected))
    place = {c: i for i, c in enumerate(columns)}
    directed |= {tuple(sorted(e, key=place.__getitem__)) for e in undirected}
    edges = force_acyclic(columns, [(a, b) for a in columns for b in columns if (a, b) in directed])
    return Learned(stats.laplace_network(edges), edges, details={"tests": tests, "directed": cpdag[0], "undirected": cpdag[1], "separators": separator})


def fci(stats: SufficientStatistics, alpha: float = 0.05, test: str = "chi2", max_conditioning: int | None = None) -> Learned:
    """FCI without selection variables: the marks that hold whatever causes are not observed.

    The skeleton of PC, then sets of vertices that may separate beyond the
    neighbours (by paths of colliders and triangles), then all orientation
    rules.  Edges that end with two arrows or with a circle at the tail of an
    arrow are left out of the network (a latent cause is not ruled out);
    undirected ones point to the later column.
    """
    columns = stats.columns
    near, separator, tests = _skeleton(stats, alpha, test, max_conditioning, True, every_level=True)
    found = AncestralGraph(columns, near)
    found.colliders(separator)
    tests += _separate_further(stats, found, separator, alpha, test, max_conditioning)
    found = AncestralGraph(columns, near)
    found.colliders(separator)
    found.orient(separator)
    mark, edges, dropped = found.mark, [], []
    for a, b in itertools.combinations(columns, 2):
        if b in near[a]:
            ends = (mark[b, a], mark[a, b])
            if ends == ("tail", "arrow"):
                edges.append((a, b))
            elif ends == ("arrow", "tail"):
                edges.append((b, a))
            elif "arrow" not in ends:
                edges.append((a, b))
            else:
                dropped.append((a, b))
    edges = force_acyclic(columns, edges)
    return Learned(stats.laplace_network(edges), edges, details={"tests": tests, "marks": mark, "dropped": dropped, "separators": separator})


def _separate_further(stats: SufficientStatistics, graph: AncestralGraph, separator: dict, alpha: float, kind: str, max_conditioning: int | None) -> int:
    """Remove edges that a set of possibly separating vertices explains; the sets are those of the graph as it came."""
    columns, tests = stats.columns, PairTests(stats, alpha, kind)
    reach = {x: graph.possibly_separating(x) for x in columns}
    linked = [(x, y) for x, y in itertools.combinations(columns, 2) if y in graph.near[x]]
    limit = len(columns) - 2 if max_conditioning is None else max_conditioning

    def sets(x: str, y: str) -> Iterator[tuple[str, ...]]:
        for size in range(1, limit + 1):
            for end, other in ((x, y), (y, x)):
                # subsets of the neighbours were tried before
                yield from (s for s in itertools.combinations([c for c in columns if c in reach[end] and c != other], size) if not graph.near[end].issuperset(s))

    for k, (x, y) in enumerate(linked):
        s = tests.separator(x, y, sets(x, y), ((a, b, sets(a, b)) for a, b in linked[k + 1 :]))
        if s is not None:
            graph.near[x].discard(y)
            graph.near[y].discard(x)
            separator[frozenset((x, y))] = set(s)
    return tests.made


def ges(stats: SufficientStatistics, score: str = "bdeu", sample_prior: float = 1.0, structure_prior: float = 1.0, max_parents: int = 5) -> Learned:
    """Greedy equivalence search: the best valid insertion, then the best valid deletion, class by class.

    The network is an acyclic graph of the class; ``directed`` are the
    compelled edges and ``undirected`` the reversible ones.
    """
    penalty = math.log(max(stats.n, 2)) * 0.5 * (structure_prior - 1) if structure_prior != 1 else 0.0
    scores = FamilyScores(stats, score, sample_prior, penalty)
    state, moves = EquivalenceClass(stats.columns), []
    for options in (lambda s: inserts(s, max_parents), deletes):
        while True:
            best, gain = None, scores.tie
            # the valid moves are listed in parts, whose families are scored together
            for some in itertools.batched(options(state), FAMILIES_PER_JOB):
                scores.ask((m.y, family) for m in some for family in (m.before, m.after))
                for m in some:
                    delta = scores(m.y, m.after) - scores(m.y, m.before)
                    if delta > gain + (scores.tie if best else 0):
                        best, gain = m, delta
            if best is None:
                break
            state = apply(state, best)
            moves.append((best.kind, (best.x, best.y)))
    edges = state.extension()
    total = scores.total({c: {a for a, b in edges if b == c} for c in stats.columns})
    return Learned(stats.laplace_network(edges), edges, total, {"directed": state.directed(), "undirected": state.undirected(), "moves": moves})


def causal_discovery(stats: SufficientStatistics, algorithm: str = "pc", **options) -> Learned:
    """``pc``, ``fci``, ``ges`` or ``grasp`` by name, always ending in an acyclic network with Laplace tables."""
    try:
        if algorithm in ("pc", "fci"):
            return {"pc": lambda **o: pc(stats, variant="stable", **o), "fci": lambda **o: fci(stats, **o)}[algorithm](**options)
        if algorithm == "ges":
            return ges(stats, **options)
        if algorithm == "grasp":
            return order_search(stats, score="bdeu", **options)
    except Exception as e:
        raise RuntimeError(f"causal discovery with {algorithm!r} failed: {e}") from e
    raise ValueError(f"unknown algorithm {algorithm!r}")


def is_acyclic(columns: list[str], edges: list[Edge]) -> bool:
    return topological_order(columns, edges) is not None
