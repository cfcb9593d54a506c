"""Hard negatives by integer inner product, searched in a rotated space.

Vectors become integers (``floor(scale * x)``) and are turned by an orthogonal
matrix whose leading directions carry most of the variance, which leaves inner
products as they are.  For a pair of rows the products of the leading
components are summed first; by Cauchy-Schwarz the rest lies within the product
of the two residual norms.  With a slack for rounding that gives bounds on the
score: a pair that cannot reach what its anchor still wants is discarded, more
components narrow the bounds of the others, and survivors are verified by
integer products.  So the result is exact whatever the rotation.

Anchors are taken in blocks of bounded size, each broadcast and held against
every row in a map over the table; a task keeps the best few of each anchor,
and only those are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factorloom.llm.common import Scratch, bound_batches, releasing

#: Rows (at most) whose second moments give the rotation; any rotation gives the same result.
FIT_ROWS = 4096
#: Anchors of a block: so many, or as fill so many bytes.
BLOCK_ANCHORS, BLOCK_BYTES = 4096, 32 << 20
#: Anchors and rows that meet in one matrix product, and surviving pairs that are looked at together.
TILE_ANCHORS, TILE_ROWS, TILE_PAIRS = 1024, 2048, 1 << 17
#: Scores are longs, so squared norms stay below this; single components too, before they are squared.
MOST_NORM, MOST_COMPONENT = 2.0**62, 2.0**31
#: Stands for a null id, so that it comes last among equal scores.
NO_ID = np.iinfo(np.int64).max
LEAST = np.iinfo(np.int64).min
FIRST_INDEX_BITS = 33  # of monotonically_increasing_id: the row within its partition


def integer_vectors(batch: pa.RecordBatch, scale: int):
    """Yield (ids, labels, integer matrix, row numbers) for the rows of each dimension that take part.

    Columns: id, label, vec.  Rows without label or vector, or with a component
    that is null or not finite, take no part, nor do rows whose scores could
    exceed a long (a norm of 2^31 or more after scaling).
    """
    ids = pc.fill_null(batch.column(0), NO_ID).to_numpy(zero_copy_only=False)
    labels, vec = batch.column(1), batch.column(2)
    there = (labels.is_valid().to_numpy(zero_copy_only=False)) & (vec.is_valid().to_numpy(zero_copy_only=False))
    labels = pc.fill_null(labels, 0).to_numpy(zero_copy_only=False)
    offsets = vec.offsets.to_numpy().astype(np.int64)
    flat = pc.fill_null(vec.values, float("nan")).to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(offsets)
    for d in np.unique(size[there]).tolist():
        rows = np.flatnonzero(there & (size == d))
        for at in range(0, len(rows), TILE_ROWS):
            some = rows[at : at + TILE_ROWS]
            x = flat[offsets[some][:, None] + np.arange(d)[None, :]]
            with np.errstate(all="ignore"):
                x = np.floor(scale * x)
                good = np.isfinite(x).all(axis=1) & (np.abs(x) < MOST_COMPONENT).all(axis=1)
                good &= np.where(good, (x * x).sum(axis=1), np.inf) < MOST_NORM
            if good.any():
                yield ids[some[good]], labels[some[good]], x[good].astype(np.int64), some[good]


def rotation(sample: np.ndarray) -> tuple[np.ndarray, float]:
    """Orthogonal matrix of the principal directions, the strongest first, and how far it is from orthogonal."""
    turn = np.linalg.eigh(sample.T @ sample)[1][:, ::-1].copy()
    return turn, float(np.linalg.norm(turn.T @ turn - np.eye(len(turn))))


class Turned:
    """Integer vectors with their rotated forms, norms and residual norms at each stage."""

    def __init__(self, vectors: np.ndarray, turn: np.ndarray, slack: float):
        d = vectors.shape[1]
        self.vectors = vectors
        self.turned = vectors.astype(np.float64) @ turn
        self.stages = sorted({max(1, d // 8), max(1, d // 4), max(1, d // 2)}) if d else [0]
        norm = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        self.rest = [np.c_[np.sqrt((self.turned[:, c:] ** 2).sum(axis=1)), norm] for c in self.stages]
        #: The same with the slack on the norms: the product of two such rows bounds what a stage leaves open.
        self.slack = np.array([1.0, slack])

    def part(self, some) -> Turned:
        out = object.__new__(Turned)
        out.vectors, out.turned, out.stages, out.slack = self.vectors[some], self.turned[some], self.stages, self.slack
        out.rest = [r[some] for r in self.rest]
        return out


def surviving_pairs(a: Turned, b: Turned, low: np.ndarray, high: np.ndarray | None, unwanted: np.ndarray | None, counts: dict):
    """Yield (places in ``a``, places in ``b``, exact scores) of the pairs whose bounds meet ``low`` to ``high`` of the row of ``a``."""
    c = a.stages[0]
    partial = a.turned[:, :c] @ b.turned[:, :c].T
    room = (a.rest[0] * a.slack) @ b.rest[0].T
    alive = partial + room >= low[:, None]
    if high is not None:
        alive &= partial - room <= high[:, None]
    if unwanted is not None:
        alive &= ~unwanted
    counts["pairs"] = counts.get("pairs", 0) + alive.size
    left, right = np.nonzero(alive)
    for at in range(0, len(left), TILE_PAIRS):
        i, j = left[at : at + TILE_PAIRS], right[at : at + TILE_PAIRS]
        known = partial[i, j]
        for k in range(1, len(a.stages)):
            c, past = a.stages[k - 1], a.stages[k]
            known = known + np.einsum("ij,ij->i", a.turned[i, c:past], b.turned[j, c:past])
            open_ = np.einsum("ij,ij->i", a.rest[k][i] * a.slack, b.rest[k][j])
            keep = known + open_ >= low[i]
            if high is not None:
                keep &= known - open_ <= high[i]
            i, j, known = i[keep], j[keep], known[keep]
        counts["verified"] = counts.get("verified", 0) + len(i)
        if len(i):
            yield i, j, np.einsum("ij,ij->i", a.vectors[i], b.vectors[j])


class Best:
    """The first ``k`` candidates of each key: higher score, then smaller id, then marked rows."""

    def __init__(self, keys: int, k: int):
        self.k = k
        self.score = np.full((keys, k), LEAST)
        self.id = np.full((keys, k), NO_ID)
        self.mark = np.zeros((keys, k), bool)
        self.full = np.zeros((keys, k), bool)

    def worst(self) -> np.ndarray:
        """Score that a newcomer of each key has to reach."""
        return np.where(self.full[:, -1], self.score[:, -1], LEAST)

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray, mark: np.ndarray | None = None) -> None:
        if not len(key):
            return
        mark = np.zeros(len(key), bool) if mark is None else mark
        touched = np.unique(key)
        old = self.full[touched]
        key = np.r_[np.repeat(touched, self.k)[old.ravel()], key]
        score, ids, mark = np.r_[self.score[touched][old], score], np.r_[self.id[touched][old], ids], np.r_[self.mark[touched][old], mark]
        order = np.lexsort((~mark, ids, -1 - score, key))  # -1 - score: no overflow at the least long
        key = key[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        place = np.arange(len(key)) - np.repeat(starts, np.diff(np.r_[starts, len(key)]))
        first = place < self.k
        order, key, place = order[first], key[first], place[first]
        self.full[touched] = False
        self.score[key, place], self.id[key, place], self.mark[key, place], self.full[key, place] = score[order], ids[order], mark[order], True


class AnchorBlock:
    """Some anchors, by dimension, and what each of them looks for."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: list[np.ndarray], turns: dict[int, tuple[np.ndarray, float]]):
        self.ids, self.labels, self.turns = ids, labels, turns
        size = np.array([len(v) for v in vectors], np.int64)
        self.by_size = {}
        for d in np.unique(size).tolist():
            where = np.flatnonzero(size == d)
            self.by_size[d] = (where, Turned(np.stack([vectors[k] for k in where]).reshape(len(where), d), *self.turn(d)))

    def turn(self, d: int) -> tuple[np.ndarray, float]:
        """Rotation and slack for one dimension; rows of a dimension that the sample lacks are not turned."""
        turn, off = self.turns.get(d, (np.eye(d), 0.0))
        return turn, (d + 16) ** 2 * 2.0**-50 + off

    def _meetings(self, batches, scale: int):
        """(anchor numbers, their vectors, ids, labels, vectors) of every tile of anchors and rows of one dimension."""
        for batch in batches:
            for ids, labels, x, _ in integer_vectors(batch, scale):
                d = x.shape[1]
                if d in self.by_size:
                    where, mine = self.by_size[d]
                    theirs = Turned(x, *self.turn(d))
                    for at in range(0, len(where), TILE_ANCHORS):
                        some = slice(at, at + TILE_ANCHORS)
                        yield where[some], mine.part(some), ids, labels, theirs

    def nearest_alike(self, batches, scale: int, k: int, counts: dict) -> Best:
        """The ``k`` rows of each anchor's own label that score best; a row equal to the anchor is marked."""
        best = Best(len(self.ids), k)
        for who, mine, ids, labels, theirs in self._meetings(batches, scale):
            here = self.labels[who]
            for label in np.intersect1d(here, labels).tolist():
                i_all, j_all = np.flatnonzero(here == label), np.flatnonzero(labels == label)
                a, b = mine.part(i_all), theirs.part(j_all)
                for i, j, score in surviving_pairs(a, b, best.worst()[who[i_all]].astype(np.float64), None, None, counts):
                    one, row = who[i_all[i]], ids[j_all[j]]
                    mark = row == self.ids[one]
                    at = np.flatnonzero(mark)
                    mark[at] = (a.vectors[i[at]] == b.vectors[j[at]]).all(axis=1)
                    enters = score >= best.worst()[one]
                    best.add(one[enters], score[enters], row[enters], mark[enters])
        return best

    def nearest_below(self, batches, scale: int, low: np.ndarray, high: np.ndarray, k: int, counts: dict) -> Best:
        """For each anchor and window (columns of ``low`` and ``high``) the ``k`` best rows of other labels inside."""
        n, windows = low.shape
        best = Best(n * windows, k)
        wanted = low <= high
        top = np.where(wanted, high, LEAST).max(axis=1, initial=LEAST).astype(np.float64)
        for who, mine, ids, labels, theirs in self._meetings(batches, scale):
            still = np.maximum(low, best.worst().reshape(n, windows))[who]
            bottom = np.where(wanted[who], still, np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max).astype(np.float64)
            for i, j, score in surviving_pairs(mine, theirs, bottom, top[who], self.labels[who][:, None] == labels[None, :], counts):
                for w in range(windows):
                    one = who[i]
                    inside = np.flatnonzero((score >= low[one, w]) & (score <= high[one, w]) & (score >= best.worst()[one * windows + w]))
                    best.add(one[inside] * windows + w, score[inside], ids[j[inside]])
        return best


def _share_of(percent: int, score: np.ndarray, up: bool) -> np.ndarray:
    """``percent`` of 100 of each score, rounded up or down, without overflow."""
    whole, rest = score // 100, score % 100
    part = rest * percent
    return whole * percent + (-(-part // 100) if up else part // 100)


def _best_rows(best: Best, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero(best.full if keep is None else best.full & keep)


def _collect(df: DataFrame) -> pa.Table:
    return df.toArrow()


def _anchor_ranges(anchors: DataFrame, most: int) -> list[tuple[int, int]]:
    """Ranges of the number ``no`` with at most ``most`` anchors each."""
    counts = sorted((r["part"], r["n"]) for r in anchors.groupBy(F.shiftright("no", FIRST_INDEX_BITS).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    cuts, held = [0], 0
    for part, n in counts:
        at = 0
        while held + (n - at) > most:
            at += most - held
            held = 0
            cuts.append((part << FIRST_INDEX_BITS) + at)
        held += n - at
    return list(zip(cuts, [*cuts[1:], NO_ID], strict=True)) if counts else []


def hard_negatives(
    spark: SparkSession,
    vectors: DataFrame,
    anchors: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str | Column = "label",
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    scale: int = 256,
    block_anchors: int = BLOCK_ANCHORS,
) -> DataFrame:
    """For each anchor and each of its best same-label rows, the best other-label rows of nearly that score.

    ``anchors`` is a condition on the rows; a score is the inner product of the
    integers ``floor(scale * x)`` with the anchor.  An anchor's positives are its
    first ``positives`` other rows of its label; a negative scores from ``low``
    to ``high`` percent of the positive.  Higher scores come first, ties by
    smaller id (a null id last).  Returns anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score.

    Rows without label or vector, or with a null or non-finite component, take
    no part, nor do those whose scores could exceed a long (a norm of 2^31 or
    more).  Vectors of different lengths have no score.  Repeated ids stay
    separate rows: an anchor leaves out one row equal to itself, and equal rows
    are anchors each.  An empty table, or one without anchors, gives no rows.
    """
    bound_batches(spark)
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"), anchors.alias("anchor")
    ).where("label IS NOT NULL AND vec IS NOT NULL")
    table = rows.select("id", "label", "vec")
    scratch = Scratch(spark, "hard-negatives")
    chosen = scratch.keep(rows.where("anchor").select("id", "label", "vec", F.monotonically_increasing_id().alias("no")), "anchors")
    widest = chosen.agg(F.max(F.size("vec"))).first()[0] or 1
    most = max(1, min(block_anchors, BLOCK_BYTES // (8 * widest)))
    shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    turns = _fit_rotations(vectors, table, scale)
    done = []
    ranges = _anchor_ranges(chosen, most)
    for first, past in ranges:
        block = _load_block(chosen.where((F.col("no") >= first) & (F.col("no") < past)), scale, turns)
        if block is None:
            continue
        shared = spark.sparkContext.broadcast(block)
        found = _positives(table, shared, scale, positives)
        result = _negatives(table, shared, scale, found, low, high, negatives)
        done.append(scratch.keep(result, "negatives") if len(ranges) > 1 else result)
        if len(ranges) > 1:
            shared.unpersist()
    if not done:
        return spark.createDataFrame([], shape)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _fit_rotations(vectors: DataFrame, table: DataFrame, scale: int) -> dict[int, tuple[np.ndarray, float]]:
    """The rotation of each dimension, from at most ``FIT_ROWS`` rows."""
    total = max(1, vectors.count())
    sample = _collect(table.where(F.rand(17) < min(1.0, 4 * FIT_ROWS / total)).limit(FIT_ROWS))
    found: dict[int, list[np.ndarray]] = {}
    for batch in sample.to_batches():
        for _, _, x, _ in integer_vectors(batch, scale):
            found.setdefault(x.shape[1], []).append(x.astype(np.float64))
    return {d: rotation(np.concatenate(xs)) for d, xs in found.items() if d}


def _load_block(anchors: DataFrame, scale: int, turns: dict) -> AnchorBlock | None:
    ids, labels, vectors = [], [], []
    for batch in _collect(anchors.orderBy("no").select("id", "label", "vec")).to_batches():
        for some, kinds, x, _ in integer_vectors(batch, scale):
            ids.append(some)
            labels.append(kinds)
            vectors += list(x)
    return AnchorBlock(np.concatenate(ids), np.concatenate(labels), vectors, turns) if ids else None


def _first_of(candidates: DataFrame, keys: list[str], k: int, *ties: Column) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id", *ties)
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _positives(table: DataFrame, shared, scale: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(there, ids, scores) of each anchor's positives: a bounded block's few rows, merged in Spark and then read here."""

    def run(batches):
        best = shared.value.nearest_alike(batches, scale, k + 1, {})
        a, p = _best_rows(best)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(best.score[a, p]), pa.array(best.id[a, p]), pa.array(best.mark[a, p])], ["a", "score", "id", "mark"])

    candidates = table.mapInArrow(releasing(run), "a long, score long, id long, mark boolean")
    got = _collect(_first_of(candidates, ["a"], k + 1, F.col("mark").desc()).orderBy("a", "rank"))
    n = len(shared.value.ids)
    there, ids, scores = np.zeros((n, k), bool), np.full((n, k), NO_ID), np.zeros((n, k), np.int64)
    a, mark = got.column("a").to_numpy(), got.column("mark").to_numpy()
    starts = np.searchsorted(a, np.arange(n + 1))
    for one in range(n):
        rows = np.arange(starts[one], starts[one + 1])
        own = rows[mark[rows]][:1]  # the anchor itself, or a row equal to it
        rows = rows[rows != own[0]][:k] if len(own) else rows[:k]
        there[one, : len(rows)] = True
        ids[one, : len(rows)], scores[one, : len(rows)] = got.column("id").to_numpy()[rows], got.column("score").to_numpy()[rows]
    return there, ids, scores


def _negatives(table: DataFrame, shared, scale: int, found: tuple, low: int, high: int, k: int) -> DataFrame:
    there, positive, score = found
    bottom = np.where(there, _share_of(low, score, True), 1)
    top = np.where(there, _share_of(high, score, False), 0)
    windows = there.shape[1]

    def run(batches):
        block = shared.value
        best = block.nearest_below(batches, scale, bottom, top, k, {})
        key, p = _best_rows(best)
        a, w = key // windows, key % windows
        null = lambda x: pa.array(x, mask=x == NO_ID)
        columns = [pa.array(a), pa.array(w), null(block.ids[a]), null(positive[a, w]), pa.array(score[a, w]), pa.array(best.score[key, p]), pa.array(best.id[key, p])]
        yield pa.RecordBatch.from_arrays(columns, ["a", "w", "anchor_id", "positive_id", "positive_score", "score", "id"])

    shape = "a long, w long, anchor_id long, positive_id long, positive_score long, score long, id long"
    best = _first_of(table.mapInArrow(releasing(run), shape), ["a", "w"], k)
    negative = F.when(F.col("id") != F.lit(int(NO_ID)), F.col("id"))
    return best.select("anchor_id", "positive_id", "rank", negative.alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
