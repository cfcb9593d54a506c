"""Continuous columns: discretisation and conditional linear-Gaussian regressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.special import number_label


def _label(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else f"{x:.2f}"


def bin_labels(thresholds: list[float]) -> list[str]:
    if not thresholds:
        return ["all"]
    texts = [_label(t) for t in thresholds]
    return [f"<{texts[0]}", *[f"{a}-{b}" for a, b in zip(texts, texts[1:], strict=False)], f">={texts[-1]}"]


def thresholds(data: DataFrame, column: str, method: str = "equal-width", bins: int = 3) -> list[float]:
    """Cut points: equal steps between minimum and maximum, or values of equal ranks (each once)."""
    if bins < 1:
        raise ValueError("at least one bin is needed")
    values = data.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    if method == "equal-width":
        row = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
        if row["lo"] is None:
            raise ValueError("no values")
        width = (row["hi"] - row["lo"]) / bins
        return [row["lo"] + i * width for i in range(1, bins)] if width > 0 else []
    if method != "equal-frequency":
        raise ValueError(f"unknown method {method!r}")
    # ranks of distinct values by a running count, so that ties cost one row
    counts = values.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        raise ValueError("no values")
    ranks = [i * total // bins for i in range(1, bins)]
    # a coarse pass by buckets of about equal numbers of distinct values keeps the running sum off a single task
    upto = F.sum("n").over(Window.partitionBy("bucket").orderBy("v"))
    cuts = sorted(set(counts.approxQuantile("v", [k / 256 for k in range(1, 256)], 0.001)))
    placed = counts.withColumn("bucket", F.size(F.filter(F.lit(cuts or [0.0]), lambda c: c <= F.col("v"))))
    sizes = {r["bucket"]: r["n"] for r in placed.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}  # at most 256 rows
    before, start = {}, 0
    for b in range(257):
        before[b] = start
        start += sizes.get(b, 0)
    wanted = {b: [r - before[b] for r in ranks if before[b] <= r < before[b] + sizes.get(b, 0)] for b in before}
    needed = [b for b, rs in wanted.items() if rs]
    running = placed.where(F.col("bucket").isin(needed)).withColumn("upto", upto)
    hit = F.lit(False)
    for b in needed:
        for r in wanted[b]:
            hit = hit | ((F.col("bucket") == b) & (F.col("upto") > r) & (F.col("upto") - F.col("n") <= r))
    return sorted({r["v"] for r in running.where(hit).select("v").collect()})  # at most bins - 1 rows


def discretize(data: DataFrame, column: str, method: str = "equal-width", bins: int = 3, out: str | None = None) -> DataFrame:
    """Adds the bin label of each value: the first bin whose upper end lies above it; null stays null."""
    cuts = thresholds(data, column, method, bins)
    labels = bin_labels(cuts)
    label = F.lit(labels[-1])
    for t, text in reversed(list(zip(cuts, labels, strict=False))):
        label = F.when(F.col(column) < t, text).otherwise(label)
    return data.withColumn(out or f"{column}_bin", F.when(F.col(column).isNotNull(), label))


PARAMETERS = "variable string, config_key string, intercept double, coefficients array<double>, variance double, n long"


def fit_linear_gaussian(data: DataFrame, target: str, continuous: list[str], discrete: list[str]) -> DataFrame:
    """Least squares of ``target`` on ``continuous`` for each configuration of ``discrete``.

    Rows are only summed: means and central co-moments per configuration combine
    before the shuffle (large values such as timestamps lose nothing), and each
    configuration's small system is solved from one row.  A configuration of no
    more rows than columns gets its mean and variance.
    """
    clean = data.dropna(subset=[target, *continuous])
    own = [F.col(c).cast("double") for c in (*continuous, target)]
    key = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in discrete]) if discrete else F.lit("")
    means = [F.avg(c).alias(f"m_{i}") for i, c in enumerate(own)]
    central = [F.covar_pop(a, b).alias(f"s_{i}_{j}") for i, a in enumerate(own) for j, b in enumerate(own) if i <= j]
    moments = clean.groupBy(key.alias("config_key")).agg(*means, *central, F.count(F.lit(1)).alias("n"))
    p = len(continuous)

    def solve(batches):
        for batch in batches:
            rows = []
            for r in batch.to_dict("records"):
                n = int(r["n"])
                whole = np.array([[r[f"s_{min(i, j)}_{max(i, j)}"] for j in range(p + 1)] for i in range(p + 1)])
                mean = np.array([r[f"m_{i}"] for i in range(p + 1)])
                if n <= p:
                    rows.append((target, r["config_key"], float(mean[p]), [0.0] * p, max(0.0, whole[p, p] * n / (n - 1)) if n > 1 else 0.0, n))
                    continue
                # columns on one scale; a constant column takes no part
                scale = np.sqrt(np.diag(whole)[:p])
                scale[scale == 0] = 1.0
                m, t = whole[:p, :p] / np.outer(scale, scale), whole[:p, p] / scale
                beta = np.linalg.lstsq(m, t, rcond=1e-12)[0] / scale if p else np.zeros(0)
                left = n * (whole[p, p] - 2 * beta @ whole[:p, p] + beta @ whole[:p, :p] @ beta)
                rows.append((target, r["config_key"], float(mean[p] - beta @ mean[:p]), beta.tolist(), max(0.0, float(left)) / (n - p - 1) if n > p + 1 else 0.0, n))
            yield pd.DataFrame(rows, columns=["variable", "config_key", "intercept", "coefficients", "variance", "n"])

    return moments.mapInPandas(solve, PARAMETERS)


def predict_linear_gaussian(params: DataFrame, cases: DataFrame, continuous: list[str], discrete: list[str]) -> DataFrame:
    """Adds mean, variance and ``matched``; an unknown configuration uses the first one, a missing value is 0.

    Parameters have a row a configuration; they are broadcast by Spark while small.
    """
    key = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in discrete]) if discrete else F.lit("")
    first = params.agg(F.min(F.struct("config_key", "intercept", "coefficients", "variance")).alias("first"))
    known = params.select("config_key", F.struct("intercept", "coefficients", "variance").alias("own"))
    joined = cases.withColumn("config_key", key).join(known, "config_key", "left").crossJoin(F.broadcast(first))  # one row
    pick = lambda f: F.coalesce(F.col(f"own.{f}"), F.col(f"first.{f}"))
    mean = pick("intercept")
    for i, c in enumerate(continuous):
        mean = mean + F.get(pick("coefficients"), i) * F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    out = joined.withColumn("mean", mean).withColumn("variance_", pick("variance")).withColumn("matched", F.col("own").isNotNull())
    return out.drop("config_key", "own", "first").withColumnRenamed("variance_", "variance")


__all__ = ["bin_labels", "discretize", "fit_linear_gaussian", "number_label", "predict_linear_gaussian", "thresholds"]
