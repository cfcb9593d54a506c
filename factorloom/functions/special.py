"""Column expressions that Spark lacks: log gamma, chi-squared survival, entropies, number labels."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos coefficients (g = 7, n = 9) of the log gamma function.
LANCZOS = [
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
]


def ln_gamma(x: Column) -> Column:
    """For x > 0; below one half by ln(gamma(x + 1)) - ln(x)."""

    def upper(z: Column) -> Column:
        z = z - 1
        series = F.lit(LANCZOS[0])
        for i, c in enumerate(LANCZOS[1:], 1):
            series = series + F.lit(c) / (z + i)
        t = z + 7.5
        return 0.5 * math.log(2 * math.pi) + (z + 0.5) * F.log(t) - t + F.log(series)

    return F.when(x < 0.5, upper(x + 1) - F.log(x)).otherwise(upper(x))


def chi2_survival(x: Column, df: Column, terms: int = 299) -> Column:
    """P(X >= x) for chi-squared with ``df`` degrees; one if df or x is not positive.

    The series of the lower incomplete gamma function, folded by a higher-order
    function, so the whole expression stays in the JVM.
    """
    a, h = df.cast("double") / 2, x.cast("double") / 2
    start = F.struct((1.0 / a).alias("sum"), (1.0 / a).alias("term"))

    def step(s: Column, k: Column) -> Column:
        term = s["term"] * h / (a + k)
        return F.struct((s["sum"] + term).alias("sum"), term.alias("term"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, step)["sum"]
    p = F.exp(-h + a * F.log(h) - ln_gamma(a)) * series
    tail = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - p))
    return F.when((df <= 0) | (x <= 0), 1.0).when(h > a + 200, 0.0).otherwise(tail)


def entropy_bits(p: str | Column) -> Column:
    """Aggregate: Shannon entropy in bits of a group's probabilities."""
    p = F.col(p) if isinstance(p, str) else p
    return -F.sum(F.when(p > 1e-15, p * F.log2(p)).otherwise(0.0))


def entropy_nats(p: str | Column) -> Column:
    p = F.col(p) if isinstance(p, str) else p
    return -F.sum(F.when(p > 0, p * F.log(p)).otherwise(0.0))


def number_label(x: Column) -> Column:
    """Integers as they are, other numbers with two decimals."""
    return F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(F.format_string("%.2f", x))


def percent_text(p: Column) -> Column:
    return F.concat(F.format_number(p * 100, 2), F.lit("%"))
