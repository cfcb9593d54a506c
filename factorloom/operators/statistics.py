"""Joint counts and what is computed from them: tables, tests, scores, discretisation."""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.functions.special import chi2_survival
from factorloom.model import Cpt, Network, Variable
from factorloom.operators.families import FamilyTable, joint_size

#: Cells of counts that the driver may read; a model's tables are bounded by it.
MAX_DRIVER_CELLS = 2_000_000


def joint_counts(data: DataFrame, columns: list[str]) -> DataFrame:
    """One row a combination that occurs, with ``_n``; null and missing values are the category ''."""
    clean = data.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])
    return clean.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))


def domains(counts: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """Sorted outcomes of each column, from joint counts."""
    row = counts.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in columns]).first()
    return {c: list(row[c]) for c in columns}


class SufficientStatistics:
    """Family counts, scores and tests of a data set, by name of column, for learners.

    One scan tells how many combinations occur.  If these are few, their counts
    come to the driver (``max_cells`` at most) and all else follows from them.
    If not, the rows are written as codes and every request is a pass over them
    (``FamilyTable``): scores and tests are numbers a family that Spark computes,
    and only tables that a model is made of are read here, cell by cell.
    """

    def __init__(self, data: DataFrame, columns: list[str], outcomes: dict[str, list[str]] | None = None, max_cells: int = 200_000):
        self.columns = list(columns)
        if not self.columns:
            raise ValueError("no columns")
        clean = data.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in self.columns])
        self.n, combinations, many = joint_size(clean, self.columns)
        if not self.n:
            raise ValueError("no rows")
        if outcomes is None and sum(many) > MAX_DRIVER_CELLS:  # before any outcome comes to the driver
            raise ValueError("the columns have too many outcomes for the driver; bin them first")
        rows = None
        if combinations <= 1.2 * max_cells:  # the number is an estimate
            rows = joint_counts(clean, self.columns).limit(max_cells + 1).collect()
            rows = rows if len(rows) <= max_cells else None
        if outcomes is None:
            outcomes = {c: sorted({r[c] for r in rows}) for c in self.columns} if rows is not None else domains(clean, self.columns)
        self.outcomes = outcomes
        self.variables = [Variable(c, tuple(self.outcomes[c])) for c in self.columns]
        self.cards = {c: len(self.outcomes[c]) for c in self.columns}
        self.code = {c: {o: i for i, o in enumerate(self.outcomes[c])} for c in self.columns}
        self.memo: dict[tuple[str, ...], np.ndarray] = {}
        self.local = self.table = None
        if rows is not None:
            self.local = (np.array([[self.code[c][r[c]] for c in self.columns] for r in rows]), np.array([r["_n"] for r in rows], np.int64))
        else:
            # many rows to a combination are counted first, else each row stands for itself
            coded = joint_counts(clean, self.columns) if combinations < 0.5 * self.n else clean.withColumn("_n", F.lit(1).cast("long"))
            self.table = FamilyTable(coded, self.columns, self.outcomes)

    def release(self) -> None:
        """Delete what was written for the passes, if anything was."""
        if self.table is not None:
            self.table.release()

    def family(self, names: tuple[str, ...]) -> np.ndarray:
        self.prefetch([names])
        return self.memo[names]

    def prefetch(self, families: list[tuple[str, ...]]) -> None:
        """Counts of a model's families, as dense arrays with an axis a name, in one pass."""
        todo = [f for f in dict.fromkeys(families) if f not in self.memo]
        for f in todo:
            if math.prod(self.cards[c] for c in f) > MAX_DRIVER_CELLS:
                raise ValueError(f"the table of {f} has too many cells for the driver")
        if self.local is not None:
            for f in todo:
                self.memo[f] = self._local_counts(f)
        elif todo:
            for f in todo:
                self.memo[f] = np.zeros([self.cards[c] for c in f], np.int64)
            cells = self.table.cells([self.table.family(f[:-1], f[-1:]) for f in todo])
            for r in cells.toLocalIterator():
                self.memo[todo[r["family"]]].reshape(-1)[r["config"] * self.cards[todo[r["family"]][-1]] + r["cell"]] = r["n"]

    def _local_counts(self, family: tuple[str, ...]) -> np.ndarray:
        (codes, n), shape = self.local, [self.cards[c] for c in family]
        cells = np.ravel_multi_index([codes[:, self.columns.index(c)] for c in family], shape)
        return np.bincount(cells, n, math.prod(shape)).astype(np.int64).reshape(shape)

    def scores(self, families: list[tuple[str, tuple[str, ...]]], kind: str = "bic", sample_prior: float = 1.0) -> list[float]:
        """Local score of each (child, parents)."""
        if self.table is not None:
            return self.table.scores(families, kind, self.n, sample_prior)
        return [local_score(self._local_counts((*parents, child)), self.n, kind, sample_prior) for child, parents in families]

    def tests(self, families: list[tuple[str, str, tuple[str, ...]]], kind: str = "chi2") -> list[tuple[float, int]]:
        """Statistic and degrees of freedom of each (x, y, given)."""
        if self.table is not None:
            return self.table.tests(families, kind)
        return [ci_from_counts(self._local_counts((x, y, *given)), kind) for x, y, given in families]

    def laplace_network(self, edges: list[tuple[str, str]], name: str = "learned") -> Network:
        """Tables (n + 1) / (N + card) of a structure; parents in column order."""
        families = {c: tuple(p for p in self.columns if (p, c) in edges) for c in self.columns}
        self.prefetch([(*ps, c) for c, ps in families.items()])
        cpts = []
        for c, ps in families.items():
            n = self.memo[(*ps, c)] + 1.0
            cpts.append(Cpt(c, ps, n / n.sum(axis=-1, keepdims=True)))
        return Network(name, self.variables, cpts)


def laplace_cpt(data: DataFrame, child: str, parents: list[str]) -> DataFrame:
    """P(child | parents) over the full grid of observed outcomes: (parents..., child, p), unseen ones uniform."""
    scope = [*parents, child]
    counts = joint_counts(data, scope)
    # the result is the grid, unrolled from one row that holds each column's outcomes
    grid = counts.agg(*[F.collect_set(c).alias(c) for c in scope])
    for c in scope:
        grid = grid.withColumn(c, F.explode(c))
    full = grid.join(counts, scope, "left").withColumn("_n", F.coalesce("_n", F.lit(0)) + 1)
    total = F.sum("_n").over(Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(1)))
    return full.select(*parents, child, (F.col("_n") / total).alias("p"))


# independence tests

def contingency(data: DataFrame, x: str, y: str, given: list[str]) -> DataFrame:
    """Per stratum the cells that occur, with observed ``_o`` and expected ``_e`` counts.

    What the cells that do not occur add follows from the margins, so no grid is built.
    """
    counts = joint_counts(data, [x, y, *given])
    rows = counts.groupBy(*given, x).agg(F.sum("_n").alias("_r"))
    columns = counts.groupBy(*given, y).agg(F.sum("_n").alias("_c"))
    strata = counts.groupBy(*given).agg(F.sum("_n").alias("_t"))
    cells = counts.join(rows, [*given, x]).join(columns, [*given, y])
    cells = cells.join(strata, given) if given else cells.crossJoin(F.broadcast(strata))  # one row
    return cells.select(x, y, *given, F.col("_n").cast("double").alias("_o"), (F.col("_r") * (F.col("_c") / F.col("_t"))).alias("_e"))


def independence_test(data: DataFrame, x: str, y: str, given: list[str] | None = None, kind: str = "g2") -> DataFrame:
    """One row: statistic, df, p_value. ``kind`` is ``chi2`` or ``g2``; df counts levels seen in each stratum."""
    given = given or []
    cells = contingency(data, x, y, given)
    o, e = F.col("_o"), F.col("_e")
    if kind == "chi2":  # a cell that does not occur adds its expected count
        statistic = F.sum((o - e) * (o - e) / e) + F.sum(o) - F.sum(e)
    else:
        statistic = F.sum(2 * o * F.log(o / e))
    levels = cells.groupBy(*given).agg(F.countDistinct(x).alias("_r"), F.countDistinct(y).alias("_c"))
    df = levels.agg(F.sum((F.col("_r") - 1) * (F.col("_c") - 1)).cast("long").alias("df"))
    total = cells.agg(statistic.alias("statistic")).crossJoin(F.broadcast(df))  # one row each
    return total.withColumn("p_value", chi2_survival(F.col("statistic"), F.col("df")))


def mutual_information(data: DataFrame, x: str, y: str, given: list[str] | None = None) -> DataFrame:
    """One row ``mi``: (conditional) mutual information in nats."""
    o, e = F.col("_o"), F.col("_e")
    return contingency(data, x, y, given or []).agg((F.sum(o * F.log(o / e)) / F.sum("_o")).alias("mi"))


def ci_from_counts(counts: np.ndarray, kind: str) -> tuple[float, int]:
    """Statistic and df from an array with axes (x, y, strata...)."""
    total, df = 0.0, 0
    for o in np.moveaxis(counts.reshape(*counts.shape[:2], -1), -1, 0).astype(float):
        if o.sum() == 0:
            continue
        o = o[o.sum(axis=1) > 0][:, o.sum(axis=0) > 0]
        e = o.sum(axis=1, keepdims=True) * o.sum(axis=0, keepdims=True) / o.sum()
        if kind == "chi2":
            total += float(((o - e) ** 2 / e).sum())
        else:
            seen = o > 0
            total += 2 * float((o[seen] * np.log(o[seen] / e[seen])).sum())
        df += (o.shape[0] - 1) * (o.shape[1] - 1)
    return total, df


def chi2_sf(x: float, df: int, terms: int = 299) -> float:
    """Scalar twin of the Column expression."""
    if df <= 0 or x <= 0:
        return 1.0
    a, h = df / 2, x / 2
    if h > a + 200:
        return 0.0
    term = total = 1 / a
    for k in range(1, terms + 1):
        term *= h / (a + k)
        total += term
    return min(1.0, max(0.0, 1 - math.exp(-h + a * math.log(h) - math.lgamma(a)) * total))


# scores

def local_score(counts: np.ndarray, n_rows: int, kind: str = "bic", sample_prior: float = 1.0) -> float:
    """Score of a family from counts with the child on the last axis.

    ``bic`` smooths counts by one inside the likelihood, as ``aic`` does with
    its own penalty; ``k2`` and ``bdeu`` are marginal likelihoods.
    """
    card, q = counts.shape[-1], counts.size // counts.shape[-1]
    flat = counts.reshape(q, card).astype(float)
    if kind in ("bic", "aic"):
        c = flat + 1
        fit = float((c * np.log(c / c.sum(axis=1, keepdims=True))).sum())
        return fit - (0.5 * math.log(n_rows) if kind == "bic" else 1.0) * (card - 1) * q
    prior = 1.0 if kind == "k2" else sample_prior / (q * card)
    lg = np.vectorize(math.lgamma)
    rows = flat.sum(axis=1)
    return float((lg(np.full(q, prior * card)) - lg(rows + prior * card)).sum() + (lg(flat + prior) - math.lgamma(prior)).sum())


def family_bic(data: DataFrame, child: str, parents: list[str]) -> DataFrame:
    """One row (child, parents, score): local BIC as a Spark plan, on smoothed counts of the full grid.

    Cells that do not occur count one each; what they add follows from the
    number of outcomes, so they are not listed.
    """
    counts = joint_counts(data, [*parents, child])
    distinct = lambda c: counts.agg(F.countDistinct(c)).scalar()  # noqa: E731  a number that the plan looks up
    card, q = distinct(child), functools.reduce(lambda a, b: a * b, [distinct(p).cast("double") for p in parents], F.lit(1.0))
    configs = counts.groupBy(*parents).agg(F.sum("_n").alias("_t"), F.sum((F.col("_n") + 1) * F.log(F.col("_n") + 1.0)).alias("_own")) if parents else counts.agg(
        F.sum("_n").alias("_t"), F.sum((F.col("_n") + 1) * F.log(F.col("_n") + 1.0)).alias("_own")
    )
    configs = configs.withColumn("_card", card)
    total = F.col("_t") + F.col("_card")
    fit = configs.groupBy("_card").agg(F.sum(F.col("_own") - total * F.log(total.cast("double"))).alias("fit"), F.sum("_t").alias("rows"), F.count(F.lit(1)).alias("seen")).withColumn("q", q)
    score = F.col("fit") - (F.col("q") - F.col("seen")) * F.col("_card") * F.log(F.col("_card").cast("double")) - 0.5 * (F.col("_card") - 1) * F.col("q") * F.log("rows")
    return fit.select(F.lit(child).alias("child"), F.lit(",".join(parents)).alias("parents"), score.alias("score"))


def network_bic(spark: SparkSession, data: DataFrame, net: Network) -> DataFrame:
    """One row ``bic``: log likelihood of the rows under given tables less half the parameters times ln n.

    Rows that show an outcome unknown to a family leave that family out.  One
    scan of the data gives the counts of all families by GROUPING SETS; the
    tables (bounded by the model) meet them by family and outcomes.
    """
    used = list(dict.fromkeys(s for c in net.cpts.values() for s in c.scope))
    cells, params, sets = [], 0, []
    for c in net.cpts.values():
        card = net.variables[c.variable].card
        params += (card - 1) * (c.table.size // card)
        sets.append([s for s in used if s in c.scope])
        mark = sum(1 << (len(used) - 1 - i) for i, s in enumerate(used) if s not in c.scope)
        for at, p in np.ndenumerate(c.table):
            shown = {s: net.variables[s].outcomes[i] for s, i in zip(c.scope, at, strict=True)}
            cells.append((mark, [shown[s] for s in sets[-1]], float(p)))
    table = spark.createDataFrame(cells, "_g long, _key array<string>, _p double")
    clean = data.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in used])
    counts = clean.groupingSets(sets, *used).agg(F.count(F.lit(1)).alias("_n"), F.grouping_id(*used).alias("_g"))
    # a column outside the set is null, one of the set never
    keyed = counts.select(F.array_compact(F.array(*used)).alias("_key"), "_g", "_n")
    rows = keyed.where(F.col("_g") == cells[0][0]).agg(F.sum("_n").alias("rows"))
    fit = keyed.join(table, ["_g", "_key"]).where("_p > 0").agg(F.coalesce(F.sum(F.col("_n") * F.log("_p")), F.lit(0.0)).alias("fit"))
    return fit.crossJoin(F.broadcast(rows)).select((F.col("fit") - F.lit(params / 2) * F.log("rows")).alias("bic"))


def marginal_entropy(data: DataFrame, column: str) -> DataFrame:
    """One row ``entropy``: nats."""
    n = F.col("_n").cast("double")
    return joint_counts(data, [column]).agg((F.log(F.sum(n)) - F.sum(n * F.log(n)) / F.sum(n)).alias("entropy"))


def binned(value: Column, thresholds: list[float], labels: list[str]) -> Column:
    out = F.lit(labels[-1])
    for t, label in reversed(list(zip(thresholds, labels, strict=False))):
        out = F.when(value < t, label).otherwise(out)
    return out
