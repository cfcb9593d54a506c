"""Variable elimination as one Spark plan: prune, order by min-fill, join and sum out."""

from __future__ import annotations

import functools
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from factorloom.model import Network
from factorloom.operators.factor import Factor
from factorloom.operators.graph import ancestors, d_connected, min_fill

#: Networks with more relevant tables than this run on the dense kernel: the plan would be all overhead.
MAX_PLAN_FACTORS = 30


def relevant_tables(net: Network, query: str, observed: set[str]) -> list[str]:
    """Tables that can change P(query | observed): no barren nodes, nothing d-separated from the query."""
    alive = ancestors(net, {query, *observed})
    linked = d_connected(net, query, observed) | {query} | observed
    return [v for v in net.cpts if v in alive and (v == query or v in linked or any(p in linked for p in net.parents(v)))]


def elimination_order(net: Network, names, tables=None) -> list[str]:
    """Min-fill order of ``names`` in the interaction graph of the tables."""
    near: dict[str, set[str]] = {v: set() for v in net.variables}
    for v in net.cpts if tables is None else tables:
        scope = net.cpts[v].scope
        for x in scope:
            near[x].update(y for y in scope if y != x)
    return min_fill(near, names)[0]


def eliminate(
    spark: SparkSession, net: Network, query: str, evidence: Mapping[str, str] | None = None, likelihood: Mapping[str, Mapping[str, float]] | None = None,
    order: list[str] | None = None, factors: Mapping[str, Factor] | None = None,
) -> DataFrame:
    """P(query | evidence) as (variable, outcome_idx, outcome, p).

    ``factors`` may give tables as DataFrames (learned ones stay in Spark);
    others come from the network.  Evidence of unknown variables or outcomes is
    ignored.  Hard evidence filters every factor that mentions its variable;
    a likelihood enters once, at its own variable's table.
    """
    net.variable(query)
    hard = {v: net.variables[v].code(o) for v, o in (evidence or {}).items() if v in net.variables and net.variables[v].code(o) is not None}
    soft = {v: w for v, w in (likelihood or {}).items() if v in net.variables}
    tables = relevant_tables(net, query, set(hard) | set(soft))
    pool = []
    for v in tables:
        f = factors[v] if factors and v in factors else Factor.from_cpt(spark, net, net.cpts[v])
        if v in soft:
            f = f.weigh(v, {net.variables[v].code(o): w for o, w in soft[v].items() if net.variables[v].code(o) is not None})
        for x, code in hard.items():
            f = f.observe(x, code)
        # an observed variable has one value left: its column is dropped unless it is asked for
        pool.append(f.marginalize([x for x in hard if x != query]))
    if not pool:
        card = net.variables[query].card
        pool = [Factor.from_values(spark, {query: card}, [1.0 / card] * card)]
    inside = {v for f in pool for v in f.cards} - {query}
    chosen = [v for v in order if v in inside] if order is not None else []
    chosen += [v for v in elimination_order(net, inside, tables) if v not in chosen]
    for v in chosen:
        mine = sorted((f for f in pool if v in f.cards), key=lambda f: f.cells)
        pool = [f for f in pool if v not in f.cards] + [functools.reduce(Factor.multiply, mine).marginalize([v])]
    return functools.reduce(Factor.multiply, sorted(pool, key=lambda f: f.cells)).distribution(net, query)
