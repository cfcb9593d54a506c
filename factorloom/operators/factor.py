"""Factor algebra over DataFrames: one int code column a variable, and ``value``.

Product is a natural join, marginalisation a grouped sum, hard evidence a
filter that Catalyst pushes below the joins, normalisation a window.  Zero
cells may be absent; a missing cell reads as zero.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.model import Cpt, Network

#: A factor of at most this many cells is joined by broadcast.
BROADCAST_CELLS = 100_000


class Factor:
    """``cards`` gives the cardinality of each variable; ``df`` has a column for each and ``value``."""

    def __init__(self, df: DataFrame, cards: Mapping[str, int]):
        self.df, self.cards = df, dict(cards)

    @property
    def variables(self) -> list[str]:
        return list(self.cards)

    @property
    def cells(self) -> int:
        n = 1
        for c in self.cards.values():
            n *= c
        return n

    # construction
    @staticmethod
    def constant(spark: SparkSession, value: float) -> Factor:
        return Factor(spark.range(1).select(F.lit(float(value)).alias("value")), {})

    @staticmethod
    def from_values(spark: SparkSession, cards: Mapping[str, int], values) -> Factor:
        """Dense row-major values, the last variable innermost."""
        table = spark.createDataFrame([([float(x) for x in values],)], "t array<double>").select(F.posexplode("t").alias("i", "value"))
        out, below = [], 1
        for v, c in reversed(list(cards.items())):
            out.append((F.floor(F.col("i") / below) % c).cast("int").alias(v))
            below *= c
        return Factor(table.select(*reversed(out), "value"), cards)

    @staticmethod
    def from_cpt(spark: SparkSession, net: Network, cpt: Cpt) -> Factor:
        return Factor.from_values(spark, {v: net.variables[v].card for v in cpt.scope}, cpt.table.ravel())

    # operations
    def _combine(self, other: Factor, how: str, join: Callable[[Column, Column], Column]) -> Factor:
        shared = [v for v in self.cards if v in other.cards]
        right = other.df.withColumnRenamed("value", "value_2")
        right = F.broadcast(right) if other.cells <= BROADCAST_CELLS and how == "inner" else right
        both = self.df.join(right, shared, how) if shared else self.df.crossJoin(right)
        # when one scope holds the other its order is kept
        order = other.cards if set(self.cards) < set(other.cards) else {**self.cards, **other.cards}
        cards = {v: {**self.cards, **other.cards}[v] for v in order}
        return Factor(both.select(*cards, join(F.col("value"), F.col("value_2")).alias("value")), cards)

    def multiply(self, other: Factor) -> Factor:
        """Natural join on the shared variables; without any, every combination of two small tables."""
        small, large = sorted((self, other), key=lambda f: f.cells)
        out = large._combine(small, "inner", lambda a, b: a * b)
        order = other.cards if set(self.cards) < set(other.cards) else {**self.cards, **other.cards}
        return Factor(out.df.select(*order, "value"), {v: out.cards[v] for v in order})

    def add(self, other: Factor) -> Factor:
        """Pointwise sum of two factors of one scope; an absent cell is zero."""
        if set(self.cards) != set(other.cards):
            raise ValueError("a sum needs equal scopes")
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        return self._combine(other, "full", lambda a, b: zero(a) + zero(b))

    def marginalize(self, names) -> Factor:
        """Sum out ``names`` (unknown ones are ignored); summing out all leaves a scalar."""
        kept = {v: c for v, c in self.cards.items() if v not in set(names)}
        if len(kept) == len(self.cards):
            return self
        return Factor(self.df.groupBy(*kept).agg(F.sum("value").alias("value")), kept)

    def invert(self) -> Factor:
        bad = (F.col("value") == 0) | F.isnan("value") | (F.abs("value") == float("inf"))
        return Factor(self.df.withColumn("value", F.when(bad, 0.0).otherwise(1.0 / F.col("value"))), self.cards)

    def normalize(self, norm: float = 1.0) -> Factor:
        """Scale to a total of ``norm``; an all-zero factor stays as it is."""
        total = self.df.agg(F.sum("value").alias("total"))
        both = self.df.crossJoin(F.broadcast(total))  # one row
        return Factor(both.select(*self.cards, F.when(F.col("total") == 0, F.col("value")).otherwise(F.col("value") * norm / F.col("total")).alias("value")), self.cards)

    def observe(self, name: str, code: int) -> Factor:
        return Factor(self.df.where(F.col(name) == code), self.cards) if name in self.cards else self

    def weigh(self, name: str, weights: Mapping[int, float]) -> Factor:
        """Soft evidence: multiply by the outcome's weight, one where none is given."""
        if name not in self.cards:
            return self
        w = F.lit(1.0)
        for code, x in weights.items():
            w = F.when(F.col(name) == code, float(x)).otherwise(w)
        return Factor(self.df.withColumn("value", F.col("value") * w), self.cards)

    def evaluate(self, assignment: Mapping[str, int]) -> float:
        """Cell at an assignment; a missing variable reads as code 0."""
        at = self.df
        for v in self.cards:
            at = at.where(F.col(v) == assignment.get(v, 0))
        row = at.first()
        return float(row["value"]) if row else 0.0

    def distribution(self, net: Network, name: str) -> DataFrame:
        """(variable, outcome_idx, outcome, p) over the whole domain of ``name``."""
        spark = self.df.sparkSession
        one = self.marginalize([v for v in self.cards if v != name]).normalize()
        domain = spark.createDataFrame([(i, o) for i, o in enumerate(net.variable(name).outcomes)], f"`{name}` int, outcome string")
        joined = domain.join(F.broadcast(one.df), name, "left")
        return joined.select(F.lit(name).alias("variable"), F.col(name).alias("outcome_idx"), "outcome", F.coalesce("value", F.lit(0.0)).alias("p"))

    def rms_difference(self, other: Factor) -> float:
        joined = self._combine(other, "full", lambda a, b: F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0)))
        return float(joined.df.agg(F.sqrt(F.avg(F.col("value") * F.col("value")))).first()[0] or 0.0)

    def dense(self) -> list[float]:
        """Row-major values on the driver (a model table, bounded by its cells)."""
        out = [0.0] * self.cells
        for r in self.df.collect():
            at = 0
            for v, c in self.cards.items():
                at = at * c + r[v]
            out[at] += r["value"]
        return out


def normalized(df: DataFrame, keys: list[str], value: str = "value") -> Column:
    """Share of the group's total, zero where the total is zero."""
    total = F.sum(value).over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1)))
    return F.when(total == 0, F.lit(0.0)).otherwise(F.col(value) / total)
