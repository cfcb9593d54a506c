"""How a posterior depends on table cells, and what observing a variable is worth.

With the rest of its row kept in proportion, P(evidence) and P(query, evidence)
are linear in a cell.  Two propagations, with and without the query, give the
slopes of all cells of all tables, so a task that holds any number of cells runs
two and then only evaluates lines.  Candidates of the value of information are
cases of one batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.functions.special import entropy_bits
from factorloom.model import Cpt, Network
from factorloom.operators.graph import d_connected
from factorloom.operators.inference import infer_batch
from factorloom.plans.junction import CompiledNetwork, compilations

PARAMETERS = "param_id long, variable string, parent_config string, row_idx int, outcome_idx int, outcome string, theta double"


def perturb(net: Network, variable: str, row: int, outcome: int, theta: float) -> Network:
    return net.replace_cpt(perturbed_table(net, variable, row, outcome, theta))


def perturbed_table(net: Network, variable: str, row: int, outcome: int, theta: float) -> Cpt:
    """Set one cell (clamped to [0, 1]); the rest of its row keeps its proportions, or is uniform if it was zero."""
    cpt = net.cpts[variable]
    table = cpt.table.reshape(-1, cpt.table.shape[-1]).copy()
    theta = min(1.0, max(0.0, theta))
    old = table[row].copy()
    rest = old.sum() - old[outcome]
    others = np.arange(len(old)) != outcome
    table[row, others] = old[others] * ((1 - theta) / rest) if rest > 0 else (1 - theta) / max(1, len(old) - 1)
    table[row, outcome] = theta
    return Cpt(variable, cpt.parents, table.reshape(cpt.table.shape))


def parameters(spark: SparkSession, net: Network) -> DataFrame:
    rows = []
    for c in net.cpts.values():
        v = net.variables[c.variable]
        for i, theta in enumerate(c.table.ravel()):
            rows.append((len(rows), c.variable, net.parent_label(c.variable, i // v.card), i // v.card, i % v.card, v.outcomes[i % v.card], float(theta)))
    return spark.createDataFrame(rows, PARAMETERS)


def _others(rows: np.ndarray) -> np.ndarray:
    """Of each row the sum of all other rows; nothing is subtracted, so what is impossible stays exactly zero."""
    before = np.r_[0.0, np.cumsum(rows)[:-1]]
    return before + np.r_[np.cumsum(rows[::-1])[::-1][1:], 0.0]


class CellLines:
    """P(evidence) and P(query, evidence) as functions of any one cell of a network's tables."""

    def __init__(self, kernel: CompiledNetwork, query: tuple[str, int], evidence: Mapping[str, str] | None):
        self.kernel = kernel
        weights = kernel.weights(evidence)
        hit = np.eye(kernel.cards[query[0]])[query[1]][None]
        asked = weights | {query[0]: weights[query[0]] * hit if query[0] in weights else hit}
        self.slopes = [kernel.family_derivatives(asked), kernel.family_derivatives(weights)]

    def posterior(self, variable: str, row: np.ndarray, outcome: np.ndarray, at: np.ndarray) -> np.ndarray:
        """P(query | evidence) with the cells (row, outcome) set to ``at`` (cells x points)."""
        table = self.kernel.cpts[variable].table
        table = table.reshape(-1, table.shape[-1])
        cells = np.arange(len(row))
        rest = table[row].copy()
        rest[cells, outcome] = 0.0
        total = rest.sum(axis=1, keepdims=True)
        even = np.ones_like(rest) / max(1, table.shape[1] - 1)
        even[cells, outcome] = 0.0
        share = np.where(total > 0, np.divide(rest, total, out=np.zeros_like(rest), where=total > 0), even)
        values = []
        for slopes in self.slopes:
            slope = slopes[variable][0].reshape(table.shape)
            fixed = _others((table * slope).sum(axis=1))[row]
            one, other = slope[row, outcome], (share * slope[row]).sum(axis=1)
            values.append(fixed[:, None] + at * one[:, None] + (1 - at) * other[:, None])
        return np.divide(values[0], values[1], out=np.zeros_like(values[0]), where=values[1] > 0)


def _posteriors_at(spark: SparkSession, net: Network, frame: DataFrame, query: tuple[str, str], evidence: Mapping[str, str] | None) -> DataFrame:
    """Adds ``posteriors``: P(query) after setting each row's cell to each of its ``at``; one pass without a shuffle of results."""
    code = net.variable(query[0]).code(query[1])
    if code is None:
        raise ValueError(f"unknown outcome {query[1]!r} of {query[0]!r}")
    shared = spark.sparkContext.broadcast(net)

    def solve(batches):
        lines = None
        for batch in batches:
            lines = lines or CellLines(compilations().get(shared.value), (query[0], code), evidence)
            out = pd.Series([None] * len(batch), dtype=object)
            for variable, where in batch.reset_index(drop=True).groupby("variable", sort=False).groups.items():
                some = batch.iloc[where]
                at = np.clip(np.stack(some["at"].tolist()).astype(float), 0.0, 1.0)
                found = lines.posterior(variable, some["row_idx"].to_numpy(), some["outcome_idx"].to_numpy(), at)
                for k, p in zip(where, found.tolist(), strict=True):
                    out[k] = p
            yield batch.assign(posteriors=out.to_numpy())

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema)
    return frame.mapInPandas(solve, f"{kinds}, posteriors array<double>")


def _baseline(net: Network, query: tuple[str, str], evidence) -> float:
    found, _ = compilations().get(net).infer(evidence, wanted=[query[0]])
    return float(found[query[0]][net.variable(query[0]).code(query[1])])


def finite_differences(spark: SparkSession, net: Network, query: tuple[str, str], evidence=None, epsilon: float = 0.01) -> DataFrame:
    """One row a cell: base and perturbed posterior and the one-sided derivative (downwards at the top)."""
    at = F.col("theta") + F.when(F.col("theta") + epsilon > 1, -epsilon).otherwise(epsilon)
    solved = _posteriors_at(spark, net, parameters(spark, net).withColumn("at", F.array(at)), query, evidence)
    solved = solved.withColumn("posterior", F.get("posteriors", F.lit(0))).withColumn("base", F.lit(_baseline(net, query, evidence)))
    return solved.withColumn("derivative", (F.col("posterior") - F.col("base")) / (F.get("at", F.lit(0)) - F.col("theta"))).drop("at", "posteriors")


def most_influential(spark: SparkSession, net: Network, query: tuple[str, str], evidence=None, n: int = 10, epsilon: float = 0.01) -> DataFrame:
    return finite_differences(spark, net, query, evidence, epsilon).orderBy(F.desc(F.abs("derivative")), "param_id").limit(n)


def tornado(spark: SparkSession, net: Network, query: tuple[str, str], evidence=None, steps: int = 5) -> DataFrame:
    """Sweep each cell from 0 to 1: the posteriors in order and their range, widest first."""
    if steps < 2:
        raise ValueError("a sweep needs at least two steps")
    frame = parameters(spark, net).withColumn("at", F.expr(f"transform(sequence(0, {steps - 1}), i -> double(i / {steps - 1}))"))
    swept = _posteriors_at(spark, net, frame, query, evidence).drop("at").withColumnRenamed("posteriors", "curve")
    return swept.withColumn("range", F.array_max("curve") - F.array_min("curve")).orderBy(F.desc("range"), "param_id")


def analytic_sensitivity(spark: SparkSession, net: Network, query: tuple[str, str], evidence=None) -> DataFrame:
    """One row a cell: the exact curve (a x + b) / (c x + 1), its derivative at theta and |P(1) - P(0)|.

    Three posteriors fix the curve: P(0) = b, and P(1/2), P(1) give c and a.
    A curve that three points do not fix (a denominator of zero) is taken as linear.
    """
    points = parameters(spark, net).withColumn("at", F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0)))
    solved = _posteriors_at(spark, net, points, query, evidence)
    keys = ["param_id", "variable", "parent_config", "row_idx", "outcome_idx", "outcome", "theta"]
    curve = solved.select(*keys, *(F.get("posteriors", F.lit(k)).alias(name) for k, name in enumerate(("b", "p_half", "p_one"))))
    # from P(1) (c + 1) = a + b and P(1/2) (c / 2 + 1) = a / 2 + b
    below = F.col("p_half") - F.col("p_one")
    c = F.when(F.abs(below) > 1e-12, (F.col("p_one") + F.col("b") - 2 * F.col("p_half")) / below).otherwise(0.0)
    curve = curve.withColumn("c", c).withColumn("a", F.col("p_one") * (F.col("c") + 1) - F.col("b"))
    bottom = F.col("c") * F.col("theta") + 1
    derivative = F.when(F.abs(bottom) > 1e-12, (F.col("a") - F.col("b") * F.col("c")) / (bottom * bottom)).otherwise(0.0)
    return curve.select(*keys, "a", "b", "c", derivative.alias("derivative"), F.abs(F.col("p_one") - F.col("b")).alias("range"))


def curve_value(theta, a="a", b="b", c="c"):
    """Column: value of a sensitivity curve at ``theta``."""
    theta = F.lit(theta) if isinstance(theta, (int, float)) else theta
    return (F.col(a) * theta + F.col(b)) / (F.col(c) * theta + 1)


def influence_map(curves: DataFrame) -> DataFrame:
    return curves.groupBy("variable").agg(F.max(F.abs("derivative")).alias("influence"))


def top_parameters(curves: DataFrame, n: int = 10) -> DataFrame:
    return curves.orderBy(F.desc(F.abs("derivative")), "param_id").limit(n)


def value_of_information(spark: SparkSession, net: Network, target: str, evidence: Mapping[str, str] | None = None) -> DataFrame:
    """Per candidate: base entropy, expected entropy and their difference in bits (not below 0), greatest first.

    The target, observed and d-separated variables are no candidates; an
    unknown target gives no rows.
    """
    evidence = dict(evidence or {})
    empty = "candidate string, base_entropy double, expected_entropy double, voi double, outcomes array<struct<outcome:string,probability:double,entropy:double>>"
    known = target in net.variables
    linked = d_connected(net, target, set(evidence) & set(net.variables)) if known else set()
    rank = [v for v in net.variables if v in linked and v not in evidence and v != target]
    if not rank:
        return spark.createDataFrame([], empty)
    kernel = compilations().get(net)
    base, _ = kernel.infer(evidence, wanted=[*rank, target])
    entropy = lambda p: -float(sum(x * np.log2(x) for x in p if x > 1e-15))
    cases = [(k, v, o, float(base[v][i])) for k, v in enumerate(rank) for i, o in enumerate(net.variables[v].outcomes)]
    frame = spark.createDataFrame(cases, "rank int, candidate string, candidate_outcome string, probability double")
    # every (candidate, outcome) is one case of a batch: the candidate observed beside the evidence
    observed = list(dict.fromkeys([*[v for v in evidence if v in net.variables], *rank]))
    for v in observed:
        frame = frame.withColumn(v, F.when(F.col("candidate") == v, F.col("candidate_outcome")).otherwise(F.lit(evidence.get(v))))
    keys = ["rank", "candidate", "candidate_outcome", "probability"]
    solved = infer_batch(spark, net, frame.repartition(spark.sparkContext.defaultParallelism), observed, [target], keys)
    per = solved.groupBy(*keys).agg(entropy_bits("p").alias("h"))
    h = F.when(F.col("probability") < 1e-15, 0.0).otherwise(F.col("h"))
    out = per.groupBy("rank", "candidate").agg(
        F.sum(F.col("probability") * h).alias("expected_entropy"),
        F.sort_array(F.collect_list(F.struct(F.col("candidate_outcome").alias("outcome"), "probability", h.alias("entropy")))).alias("outcomes"),
    )
    start = F.lit(entropy(base[target]))
    out = out.withColumn("base_entropy", start).withColumn("voi", F.greatest(F.lit(0.0), start - F.col("expected_entropy")))
    return out.orderBy(F.desc("voi"), "rank").select("candidate", "base_entropy", "expected_entropy", "voi", "outcomes")


def multi_query_voi(spark: SparkSession, net: Network, targets: Iterable[str], evidence=None) -> DataFrame:
    """Sum over several targets; candidates that are targets are left out; one target is the plain form."""
    targets = list(targets)
    if len(targets) <= 1:
        return value_of_information(spark, net, targets[0] if targets else "", evidence)
    parts = [value_of_information(spark, net, t, evidence).withColumn("turn", F.lit(k)) for k, t in enumerate(targets)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    union = union.where(~F.col("candidate").isin(targets))
    summed = union.groupBy("candidate").agg(
        F.sum("base_entropy").alias("base_entropy"), F.sum("expected_entropy").alias("expected_entropy"), F.sum("voi").alias("voi"), F.min_by("outcomes", "turn").alias("outcomes")
    )
    return summed.orderBy(F.desc("voi"), "candidate")
