"""Equivalence classes and partial ancestral graphs held against enumeration."""

import itertools
import random

import pytest

from factorloom.operators import graph, learning, statistics
from factorloom.operators.equivalence import EquivalenceClass, apply, class_of, deletes, inserts


def separated(edges, x, y, given):
    """d-separation by the moral graph of ancestors."""
    keep, stack = set(), [x, y, *given]
    while stack:
        v = stack.pop()
        if v not in keep:
            keep.add(v)
            stack += [a for a, b in edges if b == v]
    near = graph.moral_neighbours(keep, [e for e in edges if e[0] in keep and e[1] in keep])
    seen, stack = {x}, [x]
    while stack:
        for v in near[stack.pop()]:
            if v == y:
                return False
            if v not in seen and v not in given:
                seen.add(v)
                stack.append(v)
    return True


class Oracle:
    """Answers tests of the observed columns of a graph by separation."""

    local, n = True, 1000

    def __init__(self, columns, edges):
        self.columns, self.edges = columns, edges

    def tests(self, families, kind):
        return [(0.0, 1) if separated(self.edges, x, y, set(given)) else (1e6, 1) for x, y, given in families]

    def laplace_network(self, edges):
        return None


def statements(columns, edges):
    return tuple(
        separated(edges, x, y, set(given))
        for x, y in itertools.combinations(columns, 2)
        for k in range(len(columns) - 1)
        for given in itertools.combinations([c for c in columns if c not in (x, y)], k)
    )


def ancestors(edges, v):
    seen, stack = set(), [v]
    while stack:
        at = stack.pop()
        if at not in seen:
            seen.add(at)
            stack += [a for a, b in edges if b == at]
    return seen


def ancestral_marks(columns, edges):
    """Marks of the maximal ancestral graph over some columns of a graph: an edge where nothing separates, arrows where no ancestor."""
    marks = {}
    for x, y in itertools.combinations(columns, 2):
        rest = [c for c in columns if c not in (x, y)]
        if not any(separated(edges, x, y, set(s)) for k in range(len(rest) + 1) for s in itertools.combinations(rest, k)):
            marks[x, y] = "tail" if y in ancestors(edges, x) else "arrow"
            marks[y, x] = "tail" if x in ancestors(edges, y) else "arrow"
    return marks


@pytest.fixture(scope="module")
def partial_graphs():
    """By their separations, the marks shared by all ancestral graphs over four columns (each with its hidden causes spelled out)."""
    columns = list("abcd")
    pairs = list(itertools.combinations(columns, 2))
    shared = {}
    for ways in itertools.product((None, "->", "<-", "<->"), repeat=6):
        edges = []
        for (x, y), way in zip(pairs, ways, strict=True):
            edges += {None: [], "->": [(x, y)], "<-": [(y, x)], "<->": [(f"{x}{y}", x), (f"{x}{y}", y)]}[way]
        if graph.topological_order([*columns, *("".join(p) for p in pairs)], edges) is None:
            continue
        marks = ancestral_marks(columns, edges)
        known = shared.setdefault(statements(columns, edges), dict(marks))
        for end, mark in marks.items():
            if known[end] != mark:
                known[end] = "circle"
    return shared


def random_graph(draw, vertices, share):
    order = draw.sample(vertices, len(vertices))
    return [(a, b) for a, b in itertools.combinations(order, 2) if draw.random() < share]


def test_marks_are_those_of_the_partial_ancestral_graph(partial_graphs):
    draw, kinds = random.Random(5), set()
    for _ in range(150):
        edges = random_graph(draw, [*"abcd", "h", "i", "j"], draw.choice((0.3, 0.45, 0.6)))
        found = learning.fci(Oracle(list("abcd"), edges)).details["marks"]
        assert found == partial_graphs[statements(list("abcd"), edges)]
        kinds |= {(found[a, b], found[b, a]) for a, b in found}
    assert len(kinds) == 6  # no tail meets a circle or a tail


def test_no_mark_is_wrong_on_larger_graphs():
    draw, columns = random.Random(11), list("abcdef")
    for _ in range(40):
        edges = random_graph(draw, [*columns, "h", "i", "j"], draw.choice((0.25, 0.35)))
        want = ancestral_marks(columns, edges)
        found = learning.fci(Oracle(columns, edges)).details["marks"]
        assert found.keys() == want.keys()
        assert all(mark in ("circle", want[end]) for end, mark in found.items())


@pytest.mark.parametrize(
    "edges",
    [
        [("e", "d"), ("b", "a"), ("d", "c"), ("h", "d"), ("h", "a"), ("i", "b"), ("i", "c"), ("j", "b"), ("j", "e")],
        [("c", "f"), ("c", "d"), ("f", "e"), ("f", "b"), ("a", "e"), ("d", "b"), ("h", "e"), ("h", "d"), ("i", "c"), ("i", "a"), ("j", "b"), ("j", "a")],
    ],
)
def test_graphs_that_need_more_than_neighbours(edges):
    columns = sorted({v for e in edges for v in e if v < "h"})
    oracle, want = Oracle(columns, edges), ancestral_marks(columns, edges)
    near, *_ = learning._skeleton(oracle, 0.05, "g2", None, True, every_level=True)
    assert sum(map(len, near.values())) > len(want)  # no set of neighbours separates one pair
    found = learning.fci(oracle).details["marks"]
    assert found.keys() == want.keys() and all(mark in ("circle", want[end]) for end, mark in found.items())


def acyclic_graphs(columns):
    pairs = list(itertools.combinations(columns, 2))
    for ways in itertools.product((None, 0, 1), repeat=len(pairs)):
        edges = [(a, b) if w == 0 else (b, a) for (a, b), w in zip(pairs, ways, strict=True) if w is not None]
        if graph.topological_order(columns, edges) is not None:
            yield edges


def test_classes_and_their_moves_over_four_columns():
    columns = list("abcd")
    by_class = {}
    for edges in acyclic_graphs(columns):
        state = class_of(columns, edges)
        key = (frozenset(state.directed()), frozenset(state.undirected()))
        by_class.setdefault(key, []).append(frozenset(edges))
    assert len(by_class) == 185  # classes of acyclic graphs over four vertices
    of = {e: key for key, members in by_class.items() for e in members}
    for (directed, undirected), members in by_class.items():
        state = EquivalenceClass(columns, set(directed), set(undirected))
        assert frozenset(state.extension()) in members
        skeleton = {frozenset(e) for e in members[0]}
        reach = lambda moves, state=state: {(frozenset(s.directed()), frozenset(s.undirected())) for s in (apply(state, m) for m in moves)}
        more = {of[m | {(a, b)}] for m in members for a, b in itertools.permutations(columns, 2) if frozenset((a, b)) not in skeleton and m | {(a, b)} in of}
        less = {of[m - {e}] for m in members for e in m}
        assert reach(inserts(state, 3)) == more and reach(deletes(state)) == less


def test_search_over_classes_finds_the_best_of_all(spark):
    columns = list("ABCD")
    for seed in range(4):
        draw = random.Random(seed)
        edges = random_graph(draw, columns, 0.6)
        order = graph.topological_order(columns, edges)
        chance: dict = {}
        rows = []
        for _ in range(4000):
            row = {}
            for v in order:
                key = (v, *(row[a] for a, b in edges if b == v))
                row[v] = int(draw.random() < chance.setdefault(key, draw.uniform(0.05, 0.95)))
            rows.append(tuple(str(row[c]) for c in columns))
        stats = statistics.SufficientStatistics(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns)), columns)
        scores = learning.FamilyScores(stats, "bdeu")
        total = lambda some: scores.total({c: {a for a, b in some if b == c} for c in columns})
        best = max(acyclic_graphs(columns), key=total)
        found = learning.ges(stats)
        assert found.score == pytest.approx(total(best))
        want = class_of(columns, best)
        assert (found.details["directed"], found.details["undirected"]) == (want.directed(), want.undirected())
