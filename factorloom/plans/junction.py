"""Networks compiled to dense junction forests: exact posteriors for many cases at once.

All cases of a chunk share a leading axis, so a message is one numpy sum or
product over the chunk.  Every connected component is calibrated.
"""

from __future__ import annotations

import functools
import math
import threading
from collections.abc import Mapping

import numpy as np

from factorloom.model import Cpt, Network
from factorloom.operators.graph import junction_forest, maximal_cliques, moral_neighbours

#: Cells of clique tables that a chunk of cases may hold.
CHUNK_CELLS = 4_000_000
#: A network whose joint table has at most so many cells needs no forest for a single case.
JOINT_CELLS = 4096
#: What the forest of a compiled network consists of.
FOREST = frozenset({"cliques", "tree", "base", "held", "home", "cells", "near", "inward", "roots", "root_of"})


def _expand(table: np.ndarray, have: tuple[str, ...], want: tuple[str, ...]) -> np.ndarray:
    """Axes (case, *have) to (case, *want), with length-one axes for what is missing."""
    order = [have.index(v) for v in want if v in have]
    table = np.transpose(table, [0, *[1 + i for i in order]])
    shape = [table.shape[0]]
    at = 1
    for v in want:
        if v in have:
            shape.append(table.shape[at])
            at += 1
        else:
            shape.append(1)
    return table.reshape(shape)


class CompiledNetwork:
    """A network ready for queries.

    A small one (``JOINT_CELLS``) answers single cases from its joint table; the
    junction forest is made when something needs it.
    """

    def __init__(self, net: Network):
        self.names = list(net.variables)
        self.outcomes = {v: x.outcomes for v, x in net.variables.items()}
        self.cards = {v: len(o) for v, o in self.outcomes.items()}
        self.codes = {v: {o: i for i, o in enumerate(os)} for v, os in self.outcomes.items()}
        self.cpts = dict(net.cpts)
        self.edges = net.edges()
        self.joint_cells = math.prod(self.cards.values())

    def __getattr__(self, name: str):
        if name in FOREST:
            self._make_forest()
            return self.__dict__[name]
        raise AttributeError(name)

    def __getstate__(self) -> dict:
        """What travels to executors: no messages of single cases."""
        return {k: v for k, v in self.__dict__.items() if k != "engine"}

    @functools.cached_property
    def engine(self) -> IncrementalEngine:
        return IncrementalEngine(self)

    def _make_forest(self) -> None:
        self.cliques = maximal_cliques(moral_neighbours(self.names, self.edges))
        self.tree = junction_forest(self.cliques)
        sets = [set(c) for c in self.cliques]
        self.base = [np.ones((1, *[self.cards[v] for v in c])) for c in self.cliques]
        self.held: dict[int, list[str]] = {}  # tables of each clique
        for cpt in self.cpts.values():
            k = next(i for i, s in enumerate(sets) if s.issuperset(cpt.scope))
            self.held.setdefault(k, []).append(cpt.variable)
            self.base[k] = self.base[k] * _expand(cpt.table[None], cpt.scope, self.cliques[k])
        self.home = {v: next(i for i, c in enumerate(self.cliques) if v in c) for v in self.names}
        self.cells = max(b.size for b in self.base)
        # a schedule: messages towards each component's root, then back
        self.near: dict[int, list[tuple[int, tuple[str, ...]]]] = {i: [] for i in range(len(self.cliques))}
        for i, j, s in self.tree:
            self.near[i].append((j, s))
            self.near[j].append((i, s))
        self.inward: list[tuple[int, int, tuple[str, ...]]] = []
        self.roots, seen = [], set()
        self.root_of: dict[int, int] = {}
        for root in reversed(range(len(self.cliques))):
            if root in seen:
                continue
            self.roots.append(root)
            self.root_of[root] = root
            order, stack = [], [root]
            seen.add(root)
            while stack:
                at = stack.pop()
                for n, s in self.near[at]:
                    if n not in seen:
                        seen.add(n)
                        self.root_of[n] = root
                        order.append((n, at, s))
                        stack.append(n)
            self.inward += reversed(order)

    @functools.cached_property
    def joint(self) -> tuple[np.ndarray, np.ndarray, dict[str, slice]]:
        """Joint table of a small network, a row of cells for each outcome of each variable, and each variable's rows."""
        names = tuple(self.names)
        table = functools.reduce(np.multiply, (_expand(c.table[None], c.scope, names) for c in self.cpts.values()), np.ones((1, *self.cards.values())))
        at = np.unravel_index(np.arange(self.joint_cells), list(self.cards.values()))
        rows = np.concatenate([at[k] == np.arange(self.cards[v])[:, None] for k, v in enumerate(names)]).astype(float)
        ends = np.cumsum([self.cards[v] for v in names]).tolist()
        return table.ravel(), rows, {v: slice(end - self.cards[v], end) for v, end in zip(names, ends, strict=True)}

    def _infer_small(self, evidence, likelihood, wanted, strict: bool) -> tuple[dict[str, np.ndarray], float]:
        """One case by the joint table."""
        p, rows, place = self.joint
        for v, o in (evidence or {}).items():
            code = self.codes[v].get(o) if v in self.codes else None
            if code is not None:
                p = p * rows[place[v].start + code]
            elif strict:
                raise ValueError(f"unknown evidence {v}={o}")
        if likelihood:
            for v, w in self.weights(None, likelihood, strict).items():
                p = p * (w[0] @ rows[place[v]])
        mass = rows @ p
        first = next(iter(place.values()))
        total = float(mass[first].sum())
        if total > 0:
            mass = mass / total
        else:
            mass = np.zeros_like(mass)
        return {v: mass[place[v]] for v in (place if wanted is None else wanted)}, total

    def propagate(self, weights: Mapping[str, np.ndarray]) -> tuple[list[np.ndarray], dict[int, list[tuple[int, np.ndarray]]]]:
        """Clique potentials with their weights, and the messages each clique receives, with a leading case axis.

        ``weights`` holds (cases, outcomes) likelihoods; each enters once.
        """
        pot = list(self.base)
        for v, w in weights.items():
            k = self.home[v]
            pot[k] = pot[k] * _expand(w, (v,), self.cliques[k])
        gather = list(pot)
        received: dict[int, list[tuple[int, np.ndarray]]] = {}

        def message(table: np.ndarray, source: int, target: int, sep: tuple[str, ...]) -> np.ndarray:
            drop = tuple(1 + i for i, v in enumerate(self.cliques[source]) if v not in sep)
            kept = tuple(v for v in self.cliques[source] if v in sep)
            return _expand(table.sum(axis=drop) if drop else table, kept, self.cliques[target])

        for a, b, sep in self.inward:
            sent = message(gather[a], a, b, sep)
            gather[b] = gather[b] * sent
            received.setdefault(b, []).append((a, sent))
        for a, b, sep in reversed(self.inward):
            # what b knows without a's own message, so that nothing is divided by zero
            others = pot[b]
            for s, m in received[b]:
                if s != a:
                    others = others * m
            received.setdefault(a, []).append((b, message(others, b, a, sep)))
        return pot, received

    def calibrate(self, weights: Mapping[str, np.ndarray], n: int = 1) -> tuple[list[np.ndarray], np.ndarray]:
        """Clique beliefs with a leading case axis, and the probability of each case's evidence."""
        pot, received = self.propagate(weights)
        belief = [functools.reduce(np.multiply, (m for _, m in received.get(k, ())), p) for k, p in enumerate(pot)]
        evidence = np.ones(n)
        for r in self.roots:
            evidence = evidence * belief[r].reshape(belief[r].shape[0], -1).sum(axis=1)
        return belief, evidence

    def family_derivatives(self, weights: Mapping[str, np.ndarray], wanted=None) -> dict[str, np.ndarray]:
        """What P(evidence) gains per unit of each cell of the wanted variables' tables: arrays (case, *scope).

        One propagation serves all of them: a cell's factor is its clique's
        potential without the variable's own table, times what the clique receives.
        """
        pot, received = self.propagate(weights)
        totals = {}
        for r in self.roots:
            belief = functools.reduce(np.multiply, (m for _, m in received.get(r, ())), pot[r])
            totals[r] = belief.reshape(belief.shape[0], -1).sum(axis=1)
        out = {}
        for k, names in self.held.items():
            for name in (v for v in names if wanted is None or v in wanted):
                rest = np.ones((1, *[self.cards[v] for v in self.cliques[k]]))
                for other in names:
                    if other != name:
                        rest = rest * _expand(self.cpts[other].table[None], self.cpts[other].scope, self.cliques[k])
                for v, w in weights.items():
                    if self.home[v] == k:
                        rest = rest * _expand(w, (v,), self.cliques[k])
                rest = functools.reduce(np.multiply, (m for _, m in received.get(k, ())), rest)
                scope = self.cpts[name].scope
                kept = [v for v in self.cliques[k] if v in scope]
                rest = rest.sum(axis=tuple(1 + i for i, v in enumerate(self.cliques[k]) if v not in scope))
                rest = np.transpose(rest, [0, *(1 + kept.index(v) for v in scope)])
                for r, total in totals.items():
                    if r != self.root_of[k]:
                        rest = rest * total.reshape(-1, *[1] * len(scope))
                out[name] = rest
        return out

    def marginal(self, belief: list[np.ndarray], name: str, clique: int | None = None) -> np.ndarray:
        """(cases, outcomes), normalised; zero where the evidence is impossible."""
        k = self.home[name] if clique is None else clique
        axis = self.cliques[k].index(name) + 1
        p = belief[k].sum(axis=tuple(i for i in range(1, belief[k].ndim) if i != axis))
        total = p.sum(axis=1, keepdims=True)
        return np.divide(p, total, out=np.zeros_like(p), where=total > 0)

    def posteriors(self, weights: Mapping[str, np.ndarray], n: int, wanted=None) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """(cases, outcomes) of each wanted variable, and P(evidence); impossible evidence gives zeros."""
        wanted = list(self.names if wanted is None else wanted)
        out = {v: np.zeros((n, self.cards[v])) for v in wanted}
        evidence = np.zeros(n)
        step = max(1, int(CHUNK_CELLS // max(1, sum(b.size for b in self.base))))
        for s in range(0, n, step):
            m = min(step, n - s)
            belief, p = self.calibrate({v: w[s : s + m] for v, w in weights.items()}, m)
            evidence[s : s + m] = p
            possible = (p > 0)[:, None]
            for v in wanted:
                out[v][s : s + m] = np.where(possible, self.marginal(belief, v), 0.0)
        return out, evidence

    def weights(self, evidence: Mapping[str, str] | None = None, likelihood: Mapping[str, Mapping[str, float]] | None = None, strict: bool = False) -> dict[str, np.ndarray]:
        """Likelihood rows of one case. Unknown names are ignored unless ``strict``; a missing weight is one."""
        out: dict[str, np.ndarray] = {}
        for v, o in (evidence or {}).items():
            if v in self.cards and o in self.outcomes[v]:
                out[v] = (np.array(self.outcomes[v]) == o).astype(float)[None]
            elif strict:
                raise ValueError(f"unknown evidence {v}={o}")
        for v, w in (likelihood or {}).items():
            if v in self.cards:
                row = np.array([[float(w.get(o, 1.0)) for o in self.outcomes[v]]])
                out[v] = out[v] * row if v in out else row
            elif strict:
                raise ValueError(f"unknown variable {v}")
        return out

    def infer(self, evidence=None, likelihood=None, wanted=None, strict: bool = False) -> tuple[dict[str, np.ndarray], float]:
        if self.joint_cells <= JOINT_CELLS:
            return self._infer_small(evidence, likelihood, wanted, strict)
        out, p = self.posteriors(self.weights(evidence, likelihood, strict), 1, wanted)
        return {v: d[0] for v, d in out.items()}, float(p[0])

    def calibration_gap(self, evidence=None) -> float:
        """Largest difference between marginals of one variable read from different cliques."""
        belief, _ = self.calibrate(self.weights(evidence))
        gap = 0.0
        for v in self.names:
            seen = np.stack([self.marginal(belief, v, k)[0] for k, c in enumerate(self.cliques) if v in c])
            gap = max(gap, float((seen.max(axis=0) - seen.min(axis=0)).max()))
        return gap


class IncrementalEngine:
    """Single cases of one network in a row; only messages that changed evidence reaches are computed again.

    A message is known by the evidence on its side of the edge, a clique's
    potential by the evidence it holds; the last few of each are kept.
    """

    def __init__(self, kernel: CompiledNetwork, kept: int = 8):
        self.kernel, self.kept, self.computed, self.lock = kernel, kept, 0, threading.Lock()
        self.memo: dict[tuple, dict[tuple, np.ndarray]] = {}
        self.at_home: dict[int, frozenset[str]] = {k: frozenset(v for v, h in kernel.home.items() if h == k) for k in range(len(kernel.cliques))}
        self.between = {(a, b): sep for a in range(len(kernel.cliques)) for b, sep in kernel.near[a]}
        self.behind = {(a, b): self._behind(a, b) for a in range(len(kernel.cliques)) for b, _ in kernel.near[a]}

    def _behind(self, a: int, b: int) -> frozenset[str]:
        out, stack = set(self.at_home[a]), [(n, a) for n, _ in self.kernel.near[a] if n != b]
        while stack:
            at, source = stack.pop()
            out |= self.at_home[at]
            stack += [(n, at) for n, _ in self.kernel.near[at] if n != source]
        return frozenset(out)

    def _remember(self, what: tuple, signature: tuple, make) -> np.ndarray:
        known = self.memo.setdefault(what, {})
        if signature in known:
            known[signature] = value = known.pop(signature)  # the latest last
            return value
        if len(known) >= self.kept:
            known.pop(next(iter(known)))
        self.computed += 1
        known[signature] = value = make()
        return value

    def infer(self, evidence: Mapping[str, str] | None = None, likelihood=None, wanted=None) -> tuple[dict[str, np.ndarray], float]:
        """Posteriors and P(evidence), as the kernel's."""
        with self.lock:
            return self._infer(evidence, likelihood, wanted)

    def _infer(self, evidence, likelihood, wanted) -> tuple[dict[str, np.ndarray], float]:
        kernel = self.kernel
        weights = kernel.weights(evidence, likelihood)
        marks = sorted((v, w.tobytes()) for v, w in weights.items())
        signature = lambda some: tuple(m for m in marks if m[0] in some)
        sent: dict[tuple[int, int], np.ndarray] = {}

        def potential(k: int) -> np.ndarray:
            here = [v for v in weights if v in self.at_home[k]]
            if not here:
                return kernel.base[k]
            return self._remember((k,), signature(self.at_home[k]), lambda: functools.reduce(np.multiply, (_expand(weights[v], (v,), kernel.cliques[k]) for v in here), kernel.base[k]))

        def send(a: int, b: int, sep: tuple[str, ...]) -> np.ndarray:
            def make() -> np.ndarray:
                table = functools.reduce(np.multiply, (message(n, a) for n, _ in kernel.near[a] if n != b), potential(a))
                drop = tuple(1 + i for i, v in enumerate(kernel.cliques[a]) if v not in sep)
                kept = tuple(v for v in kernel.cliques[a] if v in sep)
                return _expand(table.sum(axis=drop) if drop else table, kept, kernel.cliques[b])

            return self._remember((a, b), signature(self.behind[a, b]), make)

        def message(a: int, b: int) -> np.ndarray:
            # from the far end to here, so that deep trees need no deep calls
            order, stack = [], [(a, b)]
            while stack:
                one = stack.pop()
                if one in sent:
                    continue
                known = self.memo.get(one, {}).get(signature(self.behind[one]))
                if known is not None:
                    sent[one] = known
                    continue
                order.append(one)
                stack += [(n, one[0]) for n, _ in kernel.near[one[0]] if n != one[1]]
            for x, y in reversed(order):
                sent[x, y] = send(x, y, self.between[x, y])
            return sent[a, b]

        def belief(k: int) -> np.ndarray:
            return functools.reduce(np.multiply, (message(n, k) for n, _ in kernel.near[k]), potential(k))

        mass = 1.0
        for r in kernel.roots:
            mass *= float(belief(r).sum())
        out = {}
        beliefs: dict[int, np.ndarray] = {}
        for v in kernel.names if wanted is None else wanted:
            k = kernel.home[v]
            if k not in beliefs:
                beliefs[k] = belief(k)
            p = beliefs[k].sum(axis=tuple(1 + i for i, c in enumerate(kernel.cliques[k]) if c != v))[0]
            total = p.sum()
            out[v] = p / total if total > 0 and mass > 0 else np.zeros_like(p)
        return out, mass


class CompilationCache:
    """Compiled networks by content: structure and table values."""

    def __init__(self, limit: int = 16):
        self.limit, self.known = limit, {}

    def get(self, net: Network) -> CompiledNetwork:
        key = net.fingerprint()
        if key not in self.known:
            if len(self.known) >= self.limit:
                self.known.pop(next(iter(self.known)))
            self.known[key] = CompiledNetwork(net)
        return self.known[key]


@functools.cache
def compilations() -> CompilationCache:
    return CompilationCache()
