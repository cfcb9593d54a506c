"""Posterior queries: single cases, batches of evidence rows, soft and Jeffrey evidence, async handles."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from concurrent.futures import Future, ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.model import Network
from factorloom.plans.elimination import MAX_PLAN_FACTORS, eliminate, relevant_tables
from factorloom.plans.junction import JOINT_CELLS, CompiledNetwork, compilations

POSTERIORS = "variable string, outcome_idx int, outcome string, p double"


def _frame(spark: SparkSession, net: Network, found: Mapping[str, np.ndarray]) -> DataFrame:
    rows = [(v, i, o, float(found[v][i])) for v in found for i, o in enumerate(net.variables[v].outcomes)]
    return spark.createDataFrame(rows, POSTERIORS)


def infer(spark: SparkSession, net: Network, evidence=None, likelihood=None, variables=None, strict: bool = False) -> DataFrame:
    """Posteriors of all (or the named) variables; of a larger network only what changed since the last cases is computed again."""
    for v in variables or ():
        net.variable(v)
    kernel = compilations().get(net)
    if kernel.joint_cells <= JOINT_CELLS:
        return _frame(spark, net, kernel.infer(evidence, likelihood, variables, strict)[0])
    kernel.weights(evidence, likelihood, strict)  # names are checked where they have to be known
    return _frame(spark, net, kernel.engine.infer(evidence, likelihood, variables)[0])


def priors(spark: SparkSession, net: Network) -> DataFrame:
    return infer(spark, net)


def query(spark: SparkSession, net: Network, name: str, evidence=None, likelihood=None) -> DataFrame:
    """One variable: a Spark plan for small relevant networks, else the dense kernel."""
    net.variable(name)
    if len(relevant_tables(net, name, {*(evidence or {}), *(likelihood or {})} & set(net.variables))) <= MAX_PLAN_FACTORS:
        return eliminate(spark, net, name, evidence, likelihood)
    return infer(spark, net, evidence, likelihood, [name])


def jeffrey_likelihood(net: Network, targets: Mapping[str, Mapping[str, float]]) -> dict[str, dict[str, float]]:
    """Likelihoods target / prior that move a variable to a target distribution (Jeffrey's rule)."""
    prior, _ = compilations().get(net).infer(wanted=list(targets))
    out = {}
    for v, t in targets.items():
        out[v] = {}
        for i, o in enumerate(net.variable(v).outcomes):
            p, want = float(prior[v][i]), float(t.get(o, 0.0))
            out[v][o] = want / p if p > 1e-10 else (1e6 if want > 0 else 0.0)
    return out


def evidence_cases(batch: pd.DataFrame, observed: list[str], outcomes: Mapping[str, tuple[str, ...]], distinct: bool = True) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Likelihood rows of the (distinct) evidence of a batch, and the case of each of its rows; null and unknown outcomes are not observed."""
    codes = {v: {o: i for i, o in enumerate(outcomes[v])} for v in observed}
    seen = np.stack([batch[v].map(codes[v]).fillna(-1).astype(int).to_numpy() for v in observed], axis=1) if observed else np.zeros((len(batch), 0), int)
    cases, which = np.unique(seen, axis=0, return_inverse=True) if distinct else (seen, np.arange(len(batch)))
    weights = {}
    for k, v in enumerate(observed):
        w = np.ones((len(cases), len(outcomes[v])))
        given = cases[:, k] >= 0
        w[given] = np.eye(len(outcomes[v]))[cases[given, k]]
        weights[v] = w
    return weights, which.reshape(-1)


def posterior_rows(batch: pd.DataFrame, keys: list[str], wanted: list[str], outcomes: Mapping[str, tuple[str, ...]], found: Mapping[str, np.ndarray], which: np.ndarray):
    """Long form: for each wanted variable a frame with a row a case and outcome."""
    for v in wanted:
        card = len(outcomes[v])
        out = batch[keys].iloc[np.repeat(np.arange(len(batch)), card)].reset_index(drop=True)
        out["variable"] = v
        out["outcome_idx"] = np.tile(np.arange(card, dtype=np.int32), len(batch))
        out["outcome"] = np.tile(np.array(outcomes[v], object), len(batch))
        out["p"] = found[v][which].ravel()
        yield out


def _case_batches(shared, observed: list[str], wanted: list[str], keys: list[str], long: bool, soft: Mapping[str, str] | None = None):
    def run(batches):
        net: CompiledNetwork = shared.value
        for batch in batches:
            if not len(batch):
                continue
            # soft weights differ from case to case
            weights, which = evidence_cases(batch, observed, net.outcomes, distinct=not soft)
            n = len(batch) if soft else int(which.max()) + 1
            for v, column in (soft or {}).items():
                own = np.array([np.ones(net.cards[v]) if x is None else np.asarray(x, float) for x in batch[column]])
                weights[v] = weights[v] * own if v in weights else own
            found, p = net.posteriors(weights, n, wanted)
            if long:
                yield from posterior_rows(batch, keys, wanted, net.outcomes, found, which)
            else:
                out = batch[keys].reset_index(drop=True)
                for v in wanted:
                    out[f"p_{v}"] = list(found[v][which])
                out["p_evidence"] = p[which]
                yield out

    return run


def infer_batch(spark: SparkSession, net: Network, cases: DataFrame, observed: list[str], wanted: list[str], keys: list[str], long: bool = True, soft: Mapping[str, str] | None = None) -> DataFrame:
    """Posteriors for every row of ``cases``, whose columns ``observed`` hold outcomes (null: not observed).

    Map-only: the compiled network is broadcast (bounded by the model's tables)
    and distinct evidence within an Arrow batch is solved once.  Long form has
    a row a case, variable and outcome; wide form an array a variable and the
    probability of the evidence.  ``soft`` names columns of weights by variable
    (an array in order of the outcomes, null for none).
    """
    for v in (*observed, *wanted, *(soft or {})):
        net.variable(v)
    shared = spark.sparkContext.broadcast(compilations().get(net))
    kinds = ", ".join(f"`{k}` {cases.schema[k].dataType.simpleString()}" for k in keys)
    tail = POSTERIORS if long else ", ".join([*(f"`p_{v}` array<double>" for v in wanted), "p_evidence double"])
    picked = cases.select(*dict.fromkeys([*keys, *observed, *(soft or {}).values()]))
    return picked.mapInPandas(_case_batches(shared, observed, wanted, keys, long, soft), f"{kinds}, {tail}")


def wide_evidence(rows: DataFrame, variables: list[str], case_col: str = "case_id") -> DataFrame:
    """(case, variable, outcome) rows as one row a case with a column a variable."""
    return rows.groupBy(case_col).pivot("variable", variables).agg(F.first("outcome", ignorenulls=True))


def table_grid(spark: SparkSession, net: Network, name: str) -> DataFrame:
    """P(name | parents) as a grid: a row a parent configuration, a column an outcome."""
    cpt, v = net.cpts[name], net.variable(name)
    rows = []
    for at, p in np.ndenumerate(cpt.table):
        rows.append((*[net.variables[x].outcomes[i] for x, i in zip(cpt.parents, at[:-1], strict=True)], v.outcomes[at[-1]], float(p)))
    kinds = ", ".join(f"`{c}` string" for c in (*cpt.parents, "outcome_")) + ", p_ double"
    return spark.createDataFrame(rows, kinds).groupBy(*cpt.parents).pivot("outcome_", list(v.outcomes)).sum("p_")


def posterior_udf(spark: SparkSession, net: Network, observed: list[str], wanted: str):
    """Pandas UDF over the observed columns: array of posterior probabilities of ``wanted``."""
    shared = spark.sparkContext.broadcast(compilations().get(net))
    run = _case_batches(shared, observed, [wanted], [], False)

    @F.pandas_udf("array<double>")
    def posterior(*columns: pd.Series) -> pd.Series:
        frame = pd.DataFrame(dict(zip(observed, columns, strict=True)))
        return pd.concat([out[f"p_{wanted}"] for out in run([frame])], ignore_index=True)

    return posterior


class AsyncEngine:
    """Posterior queries by a handle: each is a job group that can be cancelled; closing cancels what is pending."""

    def __init__(self, spark: SparkSession, net: Network, threads: int = 4):
        self.spark, self.net = spark, net
        self.pool, self.groups = ThreadPoolExecutor(threads), {}

    def submit(self, evidence=None, likelihood=None, variables=None) -> Future:
        group = f"posterior-{uuid.uuid4().hex}"

        def work():
            self.spark.sparkContext.setJobGroup(group, "posterior query", interruptOnCancel=True)
            return infer(self.spark, self.net, evidence, likelihood, variables).collect()

        future = self.pool.submit(work)
        self.groups[future] = group
        return future

    def cancel(self, future: Future) -> None:
        if not future.cancel():
            self.spark.sparkContext.cancelJobGroup(self.groups[future])

    def close(self) -> None:
        for future in self.groups:
            if not future.done():
                self.cancel(future)
        self.pool.shutdown(cancel_futures=True)
