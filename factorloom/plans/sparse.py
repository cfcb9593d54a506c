"""Junction forests over sparse tables: exact posteriors as Spark plans.

A clique is never spelled out: its table is the join of the tables and messages
that it holds, so it has a row a configuration that can occur, however many
outcomes its variables have.  A message is one grouped sum over such a join,
written to the shared folder (messages are used more than once) and joined to
the next clique on the variables that both hold.  A message is remembered by the
evidence behind it: other evidence recomputes only the messages it changes.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.operators.graph import Edge, junction_forest, maximal_cliques
from factorloom.plans.lineage import cut

VALUE = "value_"


def learned_tables(data: DataFrame, columns: list[str], edges: list[Edge]) -> dict[str, DataFrame]:
    """P(column | parents) by relative frequency, a row a combination that occurs; nothing comes to the driver.

    Null and missing outcomes are the category ''.
    """
    clean = data.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])
    out = {}
    for c in columns:
        parents = [p for p in columns if (p, c) in edges]
        counts = clean.groupBy(*parents, c).agg(F.count(F.lit(1)).alias("n_"))
        total = F.sum("n_").over(Window.partitionBy(*parents)) if parents else clean.agg(F.count(F.lit(1))).scalar()
        out[c] = counts.select(*parents, c, (F.col("n_") / total).alias(VALUE))
    return out


def product(factors: list[DataFrame]) -> DataFrame:
    """Natural join of factors; those that share variables with what is joined already come first."""
    rest, out = list(factors[1:]), factors[0]
    while rest:
        have = set(out.columns) - {VALUE}
        k = max(range(len(rest)), key=lambda i: len(have & set(rest[i].columns)))
        other = rest.pop(k)
        shared = [c for c in out.columns if c in other.columns and c != VALUE]
        right = other.withColumnRenamed(VALUE, "more_")
        # factors without a common variable are messages or tables of one row, or parts that a later factor ties
        both = out.join(right, shared) if shared else out.crossJoin(right)
        out = both.withColumn(VALUE, F.col(VALUE) * F.col("more_")).drop("more_")
    return out


def onto(factor: DataFrame, names) -> DataFrame:
    """Sum out all but ``names``."""
    kept = [c for c in factor.columns if c in names]
    return factor.groupBy(*kept).agg(F.sum(VALUE).alias(VALUE))


class SparseForest:
    """``tables`` gives for each variable a DataFrame of its parents, itself and ``value_``; absent rows are zero."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame]):
        self.spark, self.tables = spark, dict(tables)
        self.scope = {v: [c for c in df.columns if c != VALUE] for v, df in self.tables.items()}
        near: dict[str, set[str]] = {v: set() for v in self.tables}
        for scope in self.scope.values():
            for v in scope:
                near[v].update(c for c in scope if c != v)
        self.cliques = maximal_cliques(near)
        self.held = {k: [] for k in range(len(self.cliques))}
        for v, scope in self.scope.items():
            self.held[next(k for k, c in enumerate(self.cliques) if set(scope) <= set(c))].append(v)
        self.near: dict[int, dict[int, tuple[str, ...]]] = {k: {} for k in self.held}
        for a, b, sep in junction_forest(self.cliques):
            self.near[a][b] = self.near[b][a] = tuple(sep)
        self.known: dict[tuple, DataFrame] = {}

    def _behind(self, a: int, b: int) -> frozenset[str]:
        """Variables of the tables on a's side of the edge a - b."""
        out = {v for t in self.held[a] for v in self.scope[t]}
        for n in self.near[a]:
            if n != b:
                out |= self._behind(n, a)
        return frozenset(out)

    def _held_tables(self, k: int, evidence: Mapping[str, str]) -> list[DataFrame]:
        out = []
        for v in self.held[k]:
            df = self.tables[v]
            for c in self.scope[v]:
                if c in evidence:
                    df = df.where(F.col(c) == evidence[c])
            out.append(df)
        return out

    def message(self, a: int, b: int, evidence: Mapping[str, str]) -> DataFrame:
        behind = self._behind(a, b)
        key = (a, b, tuple(sorted((v, o) for v, o in evidence.items() if v in behind)))
        if key not in self.known:
            parts = self._held_tables(a, evidence) + [self.message(n, a, evidence) for n in self.near[a] if n != b]
            self.known[key] = cut(onto(product(parts), self.near[a][b]))
        return self.known[key]

    def belief(self, k: int, evidence: Mapping[str, str]) -> DataFrame:
        """Joint of a clique's variables and the evidence, as far as it is not zero."""
        return product(self._held_tables(k, evidence) + [self.message(n, k, evidence) for n in self.near[k]])

    def posterior(self, name: str, evidence: Mapping[str, str] | None = None) -> DataFrame:
        """(variable, outcome, p) of the outcomes that can occur; no rows where the evidence is impossible."""
        if name not in self.tables:
            raise ValueError(f"unknown variable {name!r}")
        evidence = {v: o for v, o in (evidence or {}).items() if v in self.tables}
        home = next(k for k, c in enumerate(self.cliques) if name in c)
        found = cut(onto(self.belief(home, evidence), [name]))
        total = found.agg(F.sum(VALUE)).scalar()
        possible = [self._mass(r, evidence) for r in self._other_roots(home)]
        found = found.where(F.col(VALUE) > 0) if all(possible) else found.limit(0)
        return found.select(F.lit(name).alias("variable"), F.col(name).alias("outcome"), (F.col(VALUE) / total).alias("p"))

    def posteriors(self, names: list[str], evidence: Mapping[str, str] | None = None) -> DataFrame:
        return functools.reduce(DataFrame.unionByName, [self.posterior(v, evidence) for v in names])

    def _component(self, k: int) -> set[int]:
        seen, stack = {k}, [k]
        while stack:
            for n in self.near[stack.pop()]:
                if n not in seen:
                    seen.add(n)
                    stack.append(n)
        return seen

    def _other_roots(self, home: int) -> list[int]:
        seen, roots = self._component(home), []
        for k in self.near:
            if k not in seen:
                roots.append(k)
                seen |= self._component(k)
        return roots

    def _mass(self, k: int, evidence: Mapping[str, str]) -> float:
        """Probability of a component's evidence."""
        if not any(v in evidence for c in self._component(k) for v in self.cliques[c]):
            return 1.0
        return float(self.belief(k, evidence).agg(F.sum(VALUE)).first()[0] or 0.0)

    def evidence_probability(self, evidence: Mapping[str, str]) -> float:
        out = self._mass(0, evidence)
        for r in self._other_roots(0):
            out *= self._mass(r, evidence)
        return out


def case_posteriors(tables: Mapping[str, DataFrame], query: str, cases: DataFrame, observed: list[str], keys: list[str]) -> DataFrame:
    """P(query | the row's own evidence) for many rows in one plan without Python: (keys.., variable, outcome, p).

    ``observed`` are columns of ``cases`` with outcomes, null where nothing is
    observed.  The evidence is an axis of the elimination: its distinct
    combinations restrict the tables they touch, observed variables stay columns
    of the factors while all others are summed out, and one join takes the
    result to the rows.  Combinations that differ in what is null have a plan
    each.  A row whose evidence is impossible has no result.
    """
    spark = cases.sparkSession
    asked = cases.select(*observed).distinct()
    patterns = asked.select(*(F.col(c).isNotNull().alias(c) for c in observed)).distinct().collect() if observed else [None]
    scope = {v: [c for c in df.columns if c != VALUE] for v, df in tables.items()}
    out = []
    for pattern in patterns:
        seen = [c for c in observed if pattern[c]]
        wanted = functools.reduce(lambda df, c: df.where(F.col(c).isNotNull() if c in seen else F.col(c).isNull()), observed, asked).select(*seen).distinct() if seen else None
        pool = []
        for v in _relevant(scope, query, seen):
            mine = [c for c in scope[v] if c in seen]
            df = tables[v]
            pool.append(df.join(wanted.select(*mine).distinct(), mine, "left_semi") if mine else df)
        for v in _order(pool, {query, *seen}):
            mine = [f for f in pool if v in f.columns]
            joined = product(mine)
            pool = [f for f in pool if v not in f.columns] + [onto(joined, set(joined.columns) - {v, VALUE})]
        if wanted is not None:  # the case axis ties what has no common variable
            tied = wanted.withColumn(VALUE, F.lit(1.0))
            for f in sorted(pool, key=lambda f: query in f.columns):
                tied = product([tied, f])
            joint = tied
        else:
            joint = onto(product(pool), [query])
        joint = onto(joint, {query, *seen}).where(F.col(VALUE) > 0)
        total = F.sum(VALUE).over(Window.partitionBy(*seen)) if seen else joint.agg(F.sum(VALUE)).scalar()
        joint = joint.select(*seen, F.lit(query).alias("variable"), F.col(query).alias("outcome"), (F.col(VALUE) / total).alias("p"))
        rows = functools.reduce(lambda df, c: df.where(F.col(c).isNotNull() if c in seen else F.col(c).isNull()), observed, cases).select(*dict.fromkeys([*keys, *seen]))
        found = rows.join(joint, seen) if seen else rows.crossJoin(F.broadcast(joint))  # the prior: a row an outcome
        out.append(found.select(*keys, "variable", "outcome", "p"))
    kinds = ", ".join(f"`{k}` {cases.schema[k].dataType.simpleString()}" for k in keys)
    return functools.reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], f"{kinds}, variable string, outcome string, p double")


def _relevant(scope: Mapping[str, list[str]], query: str, seen: list[str]) -> list[str]:
    """Tables of the query, the observed variables and their ancestors: the others sum to one."""
    alive, stack = set(), [query, *seen]
    while stack:
        v = stack.pop()
        if v not in alive:
            alive.add(v)
            stack += scope[v]
    return [v for v in scope if v in alive]


def _order(pool: list[DataFrame], kept: set[str]) -> list[str]:
    """The variables to sum out, the one with the smallest joined scope first."""
    scopes, order = [set(f.columns) - {VALUE} for f in pool], []
    todo = set().union(*scopes) - kept
    while todo:
        width = lambda v: len(set().union(*(s for s in scopes if v in s)))
        v = min(sorted(todo), key=width)
        merged = set().union(*(s for s in scopes if v in s)) - {v}
        scopes = [s for s in scopes if v not in s] + [merged]
        todo.discard(v)
        order.append(v)
    return order
