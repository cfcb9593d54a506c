"""Damped sum-product on the factor graph (loopy belief propagation), for one case or many."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from factorloom.model import Network
from factorloom.operators.inference import POSTERIORS, evidence_cases, posterior_rows
from factorloom.plans.junction import compilations

#: Cells of messages and joined tables that a chunk of cases may hold.
CHUNK_CELLS = 2_000_000


@dataclass
class LoopyResult:
    posteriors: dict[str, np.ndarray]
    converged: bool
    iterations: int

    def frame(self, spark: SparkSession, net: Network) -> DataFrame:
        rows = [(v, i, o, float(p[i])) for v, p in self.posteriors.items() for i, o in enumerate(net.variables[v].outcomes)]
        return spark.createDataFrame(rows, POSTERIORS)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows (cases) scaled to one; a row of zeros stays."""
    s = x.sum(axis=1, keepdims=True)
    return np.divide(x, s, out=x.copy(), where=s > 0)


class LoopyNetwork:
    """Messages between the tables and variables of a network, with a leading axis of cases."""

    def __init__(self, net: Network, max_iterations: int = 100, tolerance: float = 1e-6, damping: float = 0.5):
        self.cards = {v: x.card for v, x in net.variables.items()}
        self.outcomes = {v: x.outcomes for v, x in net.variables.items()}
        self.scopes = [c.scope for c in net.cpts.values()]
        self.tables = [c.table for c in net.cpts.values()]
        self.touching = {v: [f for f, s in enumerate(self.scopes) if v in s] for v in self.cards}
        self.max_iterations, self.tolerance, self.damping = max_iterations, tolerance, damping
        self.cells = max(t.size for t in self.tables)

    def run(self, weights: Mapping[str, np.ndarray], n: int) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Posteriors (cases, outcomes), which cases converged, and after how many rounds; a case that has converged rests."""
        out = {v: np.zeros((n, c)) for v, c in self.cards.items()}
        converged, turns = np.zeros(n, bool), np.full(n, self.max_iterations)
        step = max(1, CHUNK_CELLS // max(1, self.cells))
        for at in range(0, n, step):
            some = slice(at, min(n, at + step))
            self._chunk({v: w[some] for v, w in weights.items()}, some, out, converged, turns)
        return out, converged, turns

    def _chunk(self, weights: dict, some: slice, out: dict, converged: np.ndarray, turns: np.ndarray) -> None:
        place = np.arange(some.start, some.stop)
        to_var = {(f, v): np.full((len(place), self.cards[v]), 1.0 / self.cards[v]) for f, s in enumerate(self.scopes) for v in s}

        def product(v: str, without: int | None = None) -> np.ndarray:
            whole = weights[v].copy() if v in weights else np.ones((len(place), self.cards[v]))
            for f in self.touching[v]:
                if f != without:
                    whole *= to_var[f, v]
            return _unit(whole)

        def finish(cases: np.ndarray) -> None:
            for v in self.cards:
                out[v][place[cases]] = product(v)[cases]

        for turn in range(1, self.max_iterations + 1):
            to_factor = {(f, v): product(v, f) for f, s in enumerate(self.scopes) for v in s}
            change = np.zeros(len(place))
            for f, scope in enumerate(self.scopes):
                for k, v in enumerate(scope):
                    table = self.tables[f][None]
                    for j, u in enumerate(scope):
                        if j != k:
                            shape = [len(place)] + [1] * len(scope)
                            shape[1 + j] = -1
                            table = table * to_factor[f, u].reshape(shape)
                    fresh = table.sum(axis=tuple(1 + j for j in range(len(scope)) if j != k))
                    fresh = _unit(np.broadcast_to(fresh, (len(place), self.cards[v])))
                    fresh = self.damping * to_var[f, v] + (1 - self.damping) * fresh
                    change = np.maximum(change, np.abs(fresh - to_var[f, v]).max(axis=1))
                    to_var[f, v] = fresh
            rests = change < self.tolerance
            if rests.any():
                finish(rests)
                converged[place[rests]], turns[place[rests]] = True, turn
                place, weights = place[~rests], {v: w[~rests] for v, w in weights.items()}
                to_var = {k: m[~rests] for k, m in to_var.items()}
                if not len(place):
                    return
        finish(np.ones(len(place), bool))


def loopy_belief_propagation(net: Network, evidence=None, likelihood=None, max_iterations: int = 100, tolerance: float = 1e-6, damping: float = 0.5) -> LoopyResult:
    """Evidence enters once, as a unary factor of its variable. Exact on trees once converged."""
    found, converged, turns = LoopyNetwork(net, max_iterations, tolerance, damping).run(compilations().get(net).weights(evidence, likelihood), 1)
    return LoopyResult({v: p[0] for v, p in found.items()}, bool(converged[0]), int(turns[0]))


def loopy_batch(
    spark: SparkSession, net: Network, cases: DataFrame, observed: list[str], wanted: list[str], keys: list[str],
    max_iterations: int = 100, tolerance: float = 1e-6, damping: float = 0.5,
) -> DataFrame:
    """Approximate posteriors for every row of ``cases``: (keys.., variable, outcome_idx, outcome, p, converged, iterations).

    As ``inference.infer_batch``, but by loopy propagation, whose cost does not
    grow with the width of the network: map-only, the distinct evidence of a
    batch propagates together, and each case stops by itself.
    """
    for v in (*observed, *wanted):
        net.variable(v)
    shared = spark.sparkContext.broadcast(LoopyNetwork(net, max_iterations, tolerance, damping))

    def run(batches):
        graph: LoopyNetwork = shared.value
        for batch in batches:
            if len(batch):
                weights, which = evidence_cases(batch, observed, graph.outcomes)
                n = int(which.max()) + 1
                found, converged, turns = graph.run(weights, n)
                for out in posterior_rows(batch, keys, wanted, graph.outcomes, found, which):
                    rest = len(out) // len(batch)
                    yield out.assign(converged=np.repeat(converged[which], rest), iterations=np.repeat(turns[which], rest).astype(np.int32))

    kinds = ", ".join(f"`{k}` {cases.schema[k].dataType.simpleString()}" for k in keys)
    return cases.select(*dict.fromkeys([*keys, *observed])).mapInPandas(run, f"{kinds}, {POSTERIORS}, converged boolean, iterations int")
