"""Counts of many families of columns in one pass, reduced to scores and tests in Spark.

A family is (columns it depends on, one or two columns of interest).  A task
counts all families of a pass over its rows with numpy; what leaves it are rows
(family, configuration, cell, n), which Spark sums and turns into a score or a
test statistic a family.  Only those numbers reach the driver, never counts, so
it does not matter how many rows or cells there are.  Cells and configurations
that do not occur enter by closed forms.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.special import ln_gamma
from factorloom.plans.lineage import shared_folder

#: Rows that a task counts together.
BLOCK_ROWS = 1 << 16
#: A family of up to so many cells is counted in an array; the arrays of a pass stay below the second number, and partial counts of larger ones below the third.
DENSE_CELLS, PASS_CELLS, HELD_CELLS = 1 << 16, 1 << 22, 1 << 20
#: Configurations are numbered up to here and hashed beyond.
MOST_NUMBERED = 1 << 62

Family = tuple[tuple[int, ...], tuple[int, ...]]


def _numbers(codes: np.ndarray, columns: Sequence[int], cards: Sequence[int]) -> np.ndarray:
    """One number a row for its combination of some columns: mixed radix, or a 64-bit hash where that would overflow."""
    out = np.zeros(len(codes), np.int64)
    if math.prod(cards[c] for c in columns) < MOST_NUMBERED:
        for c in columns:
            out = out * cards[c] + codes[:, c]
        return out
    for c in columns:
        mixed = (out.view(np.uint64) + codes[:, c].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        out = (mixed ^ (mixed >> np.uint64(29))).view(np.int64)
    return out


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate(keys), axis=0, return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, at.ravel(), np.concatenate(counts))
    return key, total


class _Counter:
    """Counts of the families of one pass over the rows of one task."""

    def __init__(self, families: list[Family], cards: list[int]):
        self.families, self.cards = families, cards
        self.pair = [math.prod(cards[c] for c in of) for _, of in families]
        self.size = [math.prod(cards[c] for c in given) * p for (given, _), p in zip(families, self.pair, strict=True)]
        self.dense = {k: np.zeros(s, np.int64) for k, s in enumerate(self.size) if s <= DENSE_CELLS}
        self.loose: dict[int, tuple[list, list]] = {k: ([], []) for k, s in enumerate(self.size) if s > DENSE_CELLS}
        self.held = 0

    def add(self, codes: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k, (given, of) in enumerate(self.families):
            cell = _numbers(codes, of, self.cards)
            config = _numbers(codes, given, self.cards)
            if k in self.dense:
                self.dense[k] += np.bincount(config * self.pair[k] + cell, n, self.size[k]).astype(np.int64)
            else:
                key, total = _summed([np.c_[config, cell]], [n])
                self.loose[k][0].append(key)
                self.loose[k][1].append(total)
                self.held += len(key)
                if self.held > HELD_CELLS:
                    yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        """Hand over the partial counts of large families."""
        for k, (keys, counts) in self.loose.items():
            if keys:
                key, total = _summed(keys, counts)
                self.loose[k] = ([], [])
                yield self._rows(k, key[:, 0], key[:, 1], total)
        self.held = 0

    def _rows(self, k: int, config: np.ndarray, cell: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), k, np.int32)), pa.array(config), pa.array(cell), pa.array(n)], ["family", "config", "cell", "n"])

    def finish(self) -> Iterator[pa.RecordBatch]:
        for k, table in self.dense.items():
            seen = np.flatnonzero(table)
            yield self._rows(k, seen // self.pair[k], seen % self.pair[k], table[seen])
        yield from self.flush()


def _blocks(batches) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes and counts of about ``BLOCK_ROWS`` rows at a time; the last column is the count."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BLOCK_ROWS:
            yield _arrays(held)
            held, rows = [], 0
    if rows:
        yield _arrays(held)


def _arrays(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    table = pa.Table.from_batches(batches)
    columns = [c.to_numpy() for c in table.columns]
    return np.stack(columns[:-1], axis=1), columns[-1]


class FamilyTable:
    """Rows of a data set as codes of outcomes, written to the shared folder, for passes that count families.

    ``rows`` has one string column per name and a count ``_n``.  ``scores`` and
    ``tests`` take any number of families and run as many passes as their cells
    need (see ``PASS_CELLS``).  ``release`` deletes the table.
    """

    def __init__(self, rows: DataFrame, columns: list[str], outcomes: dict[str, list[str]]):
        self.spark, self.columns = rows.sparkSession, columns
        self.cards = [len(outcomes[c]) for c in columns]
        self.place = {c: k for k, c in enumerate(columns)}
        wanted = [pa.array(outcomes[c], pa.string()) for c in columns]

        def code(batches):
            for batch in batches:
                codes = [pc.index_in(batch.column(k), value_set=v) for k, v in enumerate(wanted)]
                if any(c.null_count for c in codes):
                    raise ValueError("an outcome of the data is not among the given ones")
                yield pa.RecordBatch.from_arrays([*codes, batch.column(len(wanted))], [*(f"c{k}" for k in range(len(wanted))), "n"])

        coded = rows.select(*columns, "_n").mapInArrow(code, ", ".join([*(f"c{k} int" for k in range(len(columns))), "n long"]))
        self.path = f"{shared_folder(self.spark)}/families-{uuid.uuid4().hex}"
        coded.write.parquet(self.path)
        self.rows = self.spark.read.schema(coded.schema).parquet(self.path)

    def release(self) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def family(self, given: Sequence[str], of: Sequence[str]) -> Family:
        return tuple(self.place[c] for c in given), tuple(self.place[c] for c in of)

    def _passes(self, families: list[Family]) -> Iterator[tuple[int, list[Family]]]:
        """Runs of families whose arrays fit a task together."""
        first, cells = 0, 0
        for k, (given, of) in enumerate(families):
            more = min(DENSE_CELLS, math.prod(self.cards[c] for c in (*given, *of)))
            if cells + more > PASS_CELLS and k > first:
                yield first, families[first:k]
                first, cells = k, 0
            cells += more
        yield first, families[first:]

    def cells(self, families: list[Family]) -> DataFrame:
        """(family, config, cell, n): the cells that occur, summed over all tasks."""
        used = sorted({c for given, of in families for c in (*given, *of)})
        at = {c: k for k, c in enumerate(used)}
        local = [(tuple(at[c] for c in given), tuple(at[c] for c in of)) for given, of in families]
        cards = [self.cards[c] for c in used]

        def count(batches):
            counter = _Counter(local, cards)
            for codes, n in _blocks(batches):
                yield from counter.add(codes, n)
            yield from counter.finish()

        partial = self.rows.select(*(f"c{c}" for c in used), "n").mapInArrow(count, "family int, config long, cell long, n long")
        return partial.groupBy("family", "config", "cell").agg(F.sum("n").alias("n"))

    def _shapes(self, families: list[Family]) -> DataFrame:
        """One row a family: what its closed forms need."""
        rows = []
        for k, (given, of) in enumerate(families):
            rows.append((k, float(math.prod(self.cards[c] for c in given)), self.cards[of[0]], self.cards[of[-1]]))
        return self.spark.createDataFrame(rows, "family int, q double, card long, card2 long")

    def scores(self, families: list[tuple[str, tuple[str, ...]]], kind: str, n_rows: int, sample_prior: float = 1.0) -> list[float]:
        """The local score of each (child, parents), as ``statistics.local_score`` defines it."""
        specs = [self.family(parents, (child,)) for child, parents in families]
        out: list[float] = []
        for _, some in self._passes(specs):
            found = {r["family"]: r["score"] for r in self._scored(some, kind, n_rows, sample_prior).collect()}
            out += [found[k] for k in range(len(some))]
        return out

    def _scored(self, families: list[Family], kind: str, n_rows: int, sample_prior: float) -> DataFrame:
        cells = self.cells(families).join(self._shapes(families), "family")
        n, card, q = F.col("n"), F.col("card"), F.col("q")
        if kind in ("bic", "aic"):
            each, whole = (n + 1) * F.log(n + 1.0), (F.col("t") + card) * F.log((F.col("t") + card).cast("double"))
            configs = cells.groupBy("family", "q", "card", "config").agg(F.sum("n").alias("t"), F.sum(each).alias("own"))
            families_ = configs.groupBy("family", "q", "card").agg(F.sum(F.col("own") - whole).alias("fit"), F.count(F.lit(1)).alias("seen"))
            # a configuration without rows has card cells of one each
            fit = F.col("fit") - (q - F.col("seen")) * card * F.log(card.cast("double"))
            penalty = 0.5 * math.log(n_rows) if kind == "bic" else 1.0
            return families_.select("family", (fit - F.lit(penalty) * (card - 1) * q).alias("score"))
        prior = F.lit(1.0) if kind == "k2" else F.lit(float(sample_prior)) / (q * card)
        configs = cells.groupBy("family", "q", "card", "config").agg(F.sum("n").alias("t"), F.sum(ln_gamma(n + prior) - ln_gamma(prior)).alias("own"))
        return configs.groupBy("family").agg(F.sum(F.col("own") + ln_gamma(prior * card) - ln_gamma(F.col("t") + prior * card)).alias("score"))

    def tests(self, families: list[tuple[str, str, tuple[str, ...]]], kind: str) -> list[tuple[float, int]]:
        """Statistic and degrees of freedom of each (x, y, given), as ``statistics.ci_from_counts`` defines them."""
        specs = [self.family(given, (x, y)) for x, y, given in families]
        out: list[tuple[float, int]] = []
        for _, some in self._passes(specs):
            found = {r["family"]: (r["statistic"], r["df"]) for r in self._tested(some, kind).collect()}
            out += [found[k] for k in range(len(some))]
        return out

    def _tested(self, families: list[Family], kind: str) -> DataFrame:
        cells = self.cells(families).join(self._shapes(families), "family").repartition("family", "config")
        stratum = ["family", "config"]
        cells = cells.withColumn("x", F.floor(F.col("cell") / F.col("card2"))).withColumn("y", F.col("cell") % F.col("card2"))
        over = lambda *more: Window.partitionBy(*stratum, *more)
        first = lambda c: F.row_number().over(over(c).orderBy("cell")) == 1
        cells = cells.select(
            *stratum, F.col("n").cast("double").alias("n"), F.sum("n").over(over("x")).cast("double").alias("r"), F.sum("n").over(over("y")).cast("double").alias("c"),
            first("x").cast("long").alias("new_x"), first("y").cast("long").alias("new_y"), F.sum("n").over(over()).cast("double").alias("t"),
        )
        n, e = F.col("n"), F.col("r") * F.col("c") / F.col("t")
        # a cell that does not occur adds its expected count to chi-squared: t less the others'
        each = ((n - e) * (n - e) / e - e) if kind == "chi2" else 2 * n * F.log(n / e)
        strata = cells.groupBy(*stratum).agg(F.sum(each).alias("s"), F.first("t").alias("t"), ((F.sum("new_x") - 1) * (F.sum("new_y") - 1)).alias("df"))
        statistic = F.sum(F.col("s") + F.col("t")) if kind == "chi2" else F.sum("s")
        return strata.groupBy("family").agg(statistic.alias("statistic"), F.sum("df").alias("df"))


def joint_size(data: DataFrame, columns: list[str]) -> tuple[int, int, list[int]]:
    """Rows, about how many combinations of all columns, and about how many outcomes of each, in one scan."""
    aggregates = [F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64(*columns)), *(F.approx_count_distinct(c) for c in columns)]
    row = data.agg(*(a.alias(f"a{k}") for k, a in enumerate(aggregates))).first()
    return int(row[0]), int(row[1]), [int(x) for x in row[2:]]


