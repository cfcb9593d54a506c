"""Graphs of networks: moral graph, elimination orders, cliques, junction forests, separation."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.model import Network
from factorloom.plans.lineage import cut

Edge = tuple[str, str]


def moral_neighbours(vertices: Iterable[str], edges: Iterable[Edge]) -> dict[str, set[str]]:
    near: dict[str, set[str]] = {v: set() for v in vertices}
    parents: dict[str, list[str]] = {}
    for a, b in edges:
        parents.setdefault(b, []).append(a)
    for child, ps in parents.items():
        family = [*ps, child]
        for x in family:
            near[x].update(y for y in family if y != x)
    return near


def moral_edges_df(edges: DataFrame) -> DataFrame:
    """Moral graph as a self-join of (src, dst) on the child; each pair once as (a, b), a < b."""
    other = edges.select(F.col("src").alias("src2"), "dst")
    wed = edges.join(other, "dst").where("src < src2").select(F.col("src").alias("a"), F.col("src2").alias("b"))
    own = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return own.unionByName(wed).distinct()


def min_fill(near: dict[str, set[str]], eliminate: Iterable[str] | None = None):
    """Order by fewest fill edges, then degree, then given order; also fill edges and the clique of each step."""
    graph = {v: set(ns) for v, ns in near.items()}
    rank = {v: i for i, v in enumerate(graph)}
    todo = set(graph if eliminate is None else eliminate) & set(graph)
    order, fills, cliques = [], [], []

    def missing(v: str) -> list[Edge]:
        ns = sorted(graph[v], key=rank.__getitem__)
        return [(a, b) for i, a in enumerate(ns) for b in ns[i + 1 :] if b not in graph[a]]

    cost = {v: len(missing(v)) for v in todo}
    while todo:
        v = min(todo, key=lambda x: (cost[x], len(graph[x]), rank[x]))
        new = missing(v)
        for a, b in new:
            graph[a].add(b)
            graph[b].add(a)
        fills += new
        order.append(v)
        cliques.append(frozenset({v, *graph[v]}))
        ring = graph.pop(v)
        for n in ring:
            graph[n].discard(v)
        todo.discard(v)
        cost.pop(v)
        touched = set(ring)
        for n in ring:
            touched |= graph[n]
        for n in touched & todo:
            cost[n] = len(missing(n))
    return order, fills, cliques


def triangulate(near: dict[str, set[str]]) -> tuple[dict[str, set[str]], list[Edge]]:
    _, fills, _ = min_fill(near)
    graph = {v: set(ns) for v, ns in near.items()}
    for a, b in fills:
        graph[a].add(b)
        graph[b].add(a)
    return graph, fills


def maximal_cliques(near: dict[str, set[str]]) -> list[tuple[str, ...]]:
    """Of the triangulated graph: eliminated vertices with their later neighbours, without subsets; members sorted."""
    _, _, found = min_fill(near)
    kept: list[frozenset[str]] = []
    for c in sorted(found, key=len, reverse=True):
        if not any(c <= k for k in kept):
            kept.append(c)
    return sorted(tuple(sorted(c)) for c in kept)


def junction_forest(cliques: list[tuple[str, ...]]) -> list[tuple[int, int, tuple[str, ...]]]:
    """Spanning forest of largest separators: (i, j, separator) a tree per connected component."""
    sets = [set(c) for c in cliques]
    holding: dict[str, list[int]] = {}
    for i, c in enumerate(cliques):
        for v in c:
            holding.setdefault(v, []).append(i)
    pairs = {(i, j) for members in holding.values() for k, i in enumerate(members) for j in members[k + 1 :]}
    ranked = sorted(pairs, key=lambda p: (-len(sets[p[0]] & sets[p[1]]), p))
    root = list(range(len(cliques)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    tree = []
    for i, j in ranked:
        a, b = find(i), find(j)
        if a != b:
            root[a] = b
            tree.append((i, j, tuple(sorted(sets[i] & sets[j]))))
    return tree


def topological_order(vertices: Iterable[str], edges: Iterable[Edge]) -> list[str] | None:
    """None if there is a cycle."""
    vertices, edges = list(vertices), list(edges)
    degree = dict.fromkeys(vertices, 0)
    for _, b in edges:
        degree[b] += 1
    queue, out = deque(v for v in vertices if degree[v] == 0), []
    while queue:
        v = queue.popleft()
        out.append(v)
        for a, b in edges:
            if a == v:
                degree[b] -= 1
                if degree[b] == 0:
                    queue.append(b)
    return out if len(out) == len(vertices) else None


def reaches(edges: Iterable[Edge], start: str, goal: str) -> bool:
    near: dict[str, list[str]] = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
    seen, stack = {start}, [start]
    while stack:
        for n in near.get(stack.pop(), ()):
            if n == goal:
                return True
            if n not in seen:
                seen.add(n)
                stack.append(n)
    return False


def force_acyclic(vertices: list[str], edges: list[Edge]) -> list[Edge]:
    """The edges if acyclic; else those that go forward in a depth-first finishing order."""
    if topological_order(vertices, edges) is not None:
        return edges
    near = {v: [b for a, b in edges if a == v] for v in vertices}
    done: list[str] = []
    seen: set[str] = set()
    for v in vertices:
        if v in seen:
            continue
        seen.add(v)
        stack = [(v, iter(near[v]))]
        while stack:
            at, more = stack[-1]
            step = next((n for n in more if n not in seen), None)
            if step is None:
                done.append(at)
                stack.pop()
            else:
                seen.add(step)
                stack.append((step, iter(near[step])))
    place = {v: -i for i, v in enumerate(done)}
    return [(a, b) for a, b in edges if place[a] < place[b]]


def ancestors(net: Network, names: Iterable[str]) -> set[str]:
    out, stack = set(names), list(names)
    while stack:
        for p in net.parents(stack.pop()):
            if p not in out:
                out.add(p)
                stack.append(p)
    return out


def d_connected(net: Network, start: str, given: Iterable[str] = ()) -> set[str]:
    """Variables reached by an active trail from ``start``, itself left out; observed ones that a trail meets are in."""
    given = set(given)
    net.variable(start)
    opened = ancestors(net, given)  # a collider is open if it or a descendant is observed
    seen, found = set(), set()
    stack = [(start, "up")]
    while stack:
        v, way = state = stack.pop()
        if state in seen:
            continue
        seen.add(state)
        found.add(v)
        if way == "up" and v not in given:
            stack += [(p, "up") for p in net.parents(v)] + [(c, "down") for c in net.children(v)]
        elif way == "down":
            if v not in given:
                stack += [(c, "down") for c in net.children(v)]
            if v in opened:
                stack += [(p, "up") for p in net.parents(v)]
    return found - {start}


def is_d_separated(net: Network, x: str, y: str, given: Iterable[str] = ()) -> bool:
    net.variable(y)
    for g in given:
        net.variable(g)
    return y not in d_connected(net, x, given)


def markov_blanket(net: Network, name: str) -> set[str]:
    net.variable(name)
    children = net.children(name)
    return ({*net.parents(name), *children} | {p for c in children for p in net.parents(c)}) - {name}


def markov_blanket_df(edges: DataFrame) -> DataFrame:
    """(variable, member) for every variable at once, from (src, dst)."""
    pairs = edges.select(F.col("src").alias("variable"), F.col("dst").alias("member"))
    pairs = pairs.unionByName(edges.select(F.col("dst").alias("variable"), F.col("src").alias("member")))
    other = edges.select(F.col("src").alias("src2"), "dst")
    co = edges.join(other, "dst").where("src <> src2").select(F.col("src").alias("variable"), F.col("src2").alias("member"))
    return pairs.unionByName(co).distinct()


def transitive_closure_df(edges: DataFrame) -> DataFrame:
    """(src, dst, distance) of every reachable pair, by doubling joins: each round doubles the length covered."""
    known = edges.select("src", "dst", F.lit(1).alias("distance")).distinct()
    n = known.count()
    while True:
        step = known.alias("l").join(known.alias("r"), F.col("l.dst") == F.col("r.src")).select("l.src", "r.dst", (F.col("l.distance") + F.col("r.distance")).alias("distance"))
        grown = known.unionByName(step).groupBy("src", "dst").agg(F.min("distance").alias("distance"))
        grown = cut(grown)
        m = grown.count()
        if m == n:
            return grown
        known, n = grown, m


def paths(edges: Iterable[Edge], start: str, goal: str) -> list[list[str]]:
    """Simple directed paths."""
    near: dict[str, list[str]] = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
    out, stack = [], [[start]]
    while stack:
        path = stack.pop()
        for n in near.get(path[-1], ()):
            if n == goal:
                out.append([*path, n])
            elif n not in path:
                stack.append([*path, n])
    return sorted(out)


def minimal_cycles(edges: Iterable[Edge]) -> list[list[str]]:
    """Simple directed cycles, each once, from its smallest member."""
    edges = list(edges)
    return [p for v in sorted({a for a, _ in edges}) for p in paths([(a, b) for a, b in edges if a >= v and b >= v], v, v)]


def depths(vertices: Iterable[str], edges: Iterable[Edge]) -> dict[str, int]:
    """Longest distance from a root."""
    vertices, edges = list(vertices), list(edges)
    out: dict[str, int] = {}
    for v in topological_order(vertices, edges) or []:
        out[v] = max((out[a] + 1 for a, b in edges if b == v), default=0)
    return out


def structural_hamming(truth: Iterable[Edge], learned: Iterable[Edge], undirected: Iterable[Edge] = ()) -> int:
    """Extra, missing and reversed edges; an undirected true edge takes either direction."""
    truth, learned = set(truth), set(learned)
    either = {frozenset(e) for e in undirected}
    skeleton = {frozenset(e) for e in truth} | either
    mine = {frozenset(e) for e in learned}
    reversed_ = sum(1 for e in learned if frozenset(e) in skeleton - either and e not in truth)
    return len(mine ^ skeleton) + reversed_


def structural_hamming_df(truth: DataFrame, learned: DataFrame) -> DataFrame:
    """(kind, n) of missing, extra and reversed edges by a full outer join on unordered pairs."""
    pair = lambda df, tag: df.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.col("src").alias(tag))
    both = pair(truth, "t").join(pair(learned, "l"), ["a", "b"], "full")
    kind = F.when(F.col("l").isNull(), "missing").when(F.col("t").isNull(), "extra").when(F.col("t") != F.col("l"), "reversed")
    return both.select(kind.alias("kind")).where("kind is not null").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
