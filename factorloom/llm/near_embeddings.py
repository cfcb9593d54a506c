"""Near-duplicate embeddings by E8 lattice hashing with probed neighbour cells.

Each table projects a vector at random onto ``blocks`` groups of eight
coordinates, decodes every group to its nearest point of the E8 lattice and
hashes the points to a cell.  A vector stands in its own cell and probes the
cells of the nearest other lattice points.  Vectors that meet are compared by
cosine in double precision.  A pair that meets in several cells counts at the
first one only, which both vectors' keys decide without any exchange of pairs.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm.common import Scratch, connected_components, mix64

#: Rows of a cell that one task compares with one another; larger cells are split into pairs of chunks.
CHUNK_ROWS = 1500


@functools.cache
def minimal_vectors() -> np.ndarray:
    """The 240 shortest non-zero vectors of E8, by their rule."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row: the better of the nearest points of D8 and of D8 + 1/2."""

    def d8(y):
        near = np.rint(y)
        odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
        off = y[odd] - near[odd]
        worst = np.abs(off).argmax(axis=1)
        rows = np.arange(len(odd))
        near[odd, worst] += np.where(off[rows, worst] >= 0, 1.0, -1.0)
        return near

    whole, half = d8(x), d8(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


class LatticeTables:
    """Cell keys of unit vectors: ``own`` (n x tables) and ``probes`` (n x tables x probes)."""

    def __init__(self, dim: int, tables: int, blocks: int, probes: int, scale: float, seed: int):
        self.shape = (tables, blocks)
        self.probes = probes
        self.seed = seed * 1_000_003 + dim
        self.matrix = np.random.default_rng(self.seed).standard_normal((dim, tables * blocks * 8)) * scale

    def _hash(self, table: int, doubled: np.ndarray) -> np.ndarray:
        """Key of points given as integers (twice the coordinates), one row each."""
        out = np.full(len(doubled), (self.seed * 1009 + table) & 0xFFFFFFFFFFFFFFFF, np.uint64)
        for column in doubled.T:
            out = mix64(out * np.uint64(31) + column.astype(np.int64).view(np.uint64) + np.uint64(1))
        return out.view(np.int64)

    def keys(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        tables, blocks = self.shape
        n = len(unit)
        own, probes = np.empty((n, tables), np.int64), np.empty((n, tables, self.probes), np.int64)
        y = (unit @ self.matrix).reshape(n, tables, blocks, 8)
        steps = minimal_vectors()
        for t in range(tables):
            cells = np.stack([nearest_e8(y[:, t, b]) for b in range(blocks)], axis=1)
            own[:, t] = self._hash(t, (2 * cells).reshape(n, -1))
            if self.probes:
                # the squared distance to the neighbour by step v is that to the cell + 2 - 2 r.v
                gain = np.concatenate([(y[:, t, b] - cells[:, b]) @ steps.T for b in range(blocks)], axis=1)
                for k in range(self.probes):
                    best = gain.argmax(axis=1)
                    gain[np.arange(n), best] = -np.inf
                    moved = cells.copy()
                    block, step = np.divmod(best, len(steps))
                    moved[np.arange(n), block] += steps[step]
                    probes[:, t, k] = self._hash(t, (2 * moved).reshape(n, -1))
        return own, probes


@functools.lru_cache(maxsize=8)
def lattice_tables(*args) -> LatticeTables:
    return LatticeTables(*args)


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    scale = np.abs(x).max(axis=1, keepdims=True)  # against overflow of squares
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _vector_batches(double: bool):
    """(id, node, vec): the raw components, or nulls for a vector that links with nothing."""
    import xxhash

    kind = np.float64 if double else np.float32

    def run(batches):
        for batch in batches:
            nodes, vecs = [], []
            for row in batch.column(1):
                v = None
                if row.is_valid and len(row.values) and row.values.null_count == 0:
                    x = row.values.to_numpy(zero_copy_only=False).astype(kind) + kind(0)  # -0 becomes 0
                    if np.isfinite(x).all() and x.any():
                        v = x.tobytes()
                vecs.append(v)
                nodes.append(None if v is None else xxhash.xxh3_64_intdigest(v) - (1 << 63))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(vecs, pa.binary())], ["id", "node", "vec"])

    return run


def _cell_batches(kind: str, options: tuple):
    """(cell, table, probe, node): where each vector stands and what it probes, without the vector."""

    def run(batches):
        for batch in batches:
            vecs, node = batch.column("vec").to_pylist(), batch.column("node").to_numpy()
            for size in sorted({len(v) for v in vecs}):
                at = np.array([k for k, v in enumerate(vecs) if len(v) == size])
                for s in range(0, len(at), 500):
                    some = at[s : s + 500]
                    x = np.frombuffer(b"".join(vecs[k] for k in some), kind).reshape(len(some), -1)
                    own, probes = lattice_tables(x.shape[1], *options).keys(unit_rows(x))
                    cells = np.concatenate([own[:, :, None], probes], axis=2)
                    per = cells.shape[1] * cells.shape[2]
                    probe = np.tile(np.r_[False, np.ones(cells.shape[2] - 1, bool)], len(some) * cells.shape[1])
                    table = np.tile(np.repeat(np.arange(cells.shape[1]), cells.shape[2]), len(some))
                    rows = np.repeat(some, per)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cells.ravel()), pa.array(table, pa.int32()), pa.array(probe), pa.array(node[rows])], ["cell", "table", "probe", "node"]
                    )

    return run


def _meets_first(table: int, cell: np.ndarray, keys, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Is (table, cell) the first place at which rows ``a`` and ``b`` meet?"""
    own, probes = keys
    far = np.int64(2**63 - 1)
    out = np.zeros(len(a), bool)
    left = np.arange(len(a))  # pairs that no earlier table brought together
    for t in range(table + 1):
        own_a, own_b = own[a[left], t], own[b[left], t]
        in_b = (own_a == own_b) | (probes[b[left], t] == own_a[:, None]).any(axis=1)
        in_a = (own_a == own_b) | (probes[a[left], t] == own_b[:, None]).any(axis=1)
        if t == table:
            out[left] = np.minimum(np.where(in_b, own_a, far), np.where(in_a, own_b, far)) == cell
        else:
            left = left[~(in_a | in_b)]
            if not len(left):
                break
    return out


def _compare(run, kind: str, threshold: float, options: tuple, out: list) -> None:
    """Compare one group: rows of one cell and one pair of chunks."""
    probe, chunk = run["probe"], run["chunk"]
    low, high = run["pair"]
    if not (~probe).any() or len(probe) < 2:
        return
    x = unit_rows(np.frombuffer(b"".join(run["vec"]), kind).reshape(len(probe), -1))
    own = np.flatnonzero(~probe)
    links, label = np.zeros(len(probe), np.int64), np.arange(len(probe))
    ends = []
    keys = None
    for s in range(0, len(own), 512):
        rows = own[s : s + 512]
        i, j = np.nonzero(x[rows] @ x.T >= threshold)
        i = rows[i]
        # own rows pair once; an own row and a probe pair as they are; two chunks pair across
        fit = (run["node"][i] != run["node"][j]) & (probe[j] | (i < j)) & ((low == high) | (chunk[i] != chunk[j]))
        i, j = i[fit], j[fit]
        if not len(i):
            continue
        if keys is None:
            keys = lattice_tables(x.shape[1], *options).keys(x)
        first = _meets_first(run["table"], run["cell"], keys, i, j)
        np.add.at(links, i[first], run["mult"][j[first]])
        np.add.at(links, j[first], run["mult"][i[first]])
        ends.append((i, j))
    if not ends:
        return
    i, j = (np.concatenate(e) for e in zip(*ends, strict=True))
    while True:  # smallest index reachable: a forest of at most one edge a row leaves the task
        least = label.copy()
        np.minimum.at(least, i, label[j])
        np.minimum.at(least, j, label[i])
        least = np.minimum(least, least[least])
        if (least == label).all():
            break
        label = least
    node = run["node"]
    tied = np.flatnonzero(label != np.arange(len(label)))
    out.append((node[links > 0], links[links > 0], np.full(int((links > 0).sum()), -1, np.int64), np.zeros(int((links > 0).sum()), bool)))
    out.append((node[tied], np.zeros(len(tied), np.int64), node[label[tied]], np.ones(len(tied), bool)))


def _meeting_batches(kind: str, threshold: float, options: tuple):
    def run(batches):
        held, name = [], None

        def finish():
            out: list = []
            whole = pa.Table.from_batches(held)
            dims = np.array([len(v) for v in whole.column("vec").to_pylist()])
            for dim in np.unique(dims):  # only vectors of one length compare
                part = whole.filter(pa.array(dims == dim))
                group = {c: part.column(c).to_numpy() for c in ("probe", "chunk", "node", "mult")}
                group |= {"vec": part.column("vec").to_pylist(), "pair": name[1:], "cell": name[0], "table": part.column("table")[0].as_py()}
                _compare(group, kind, threshold, options, out)
            if out:
                node, links, other, edge = (np.concatenate(c) for c in zip(*out, strict=True))
                return pa.RecordBatch.from_arrays([pa.array(node), pa.array(links), pa.array(other), pa.array(edge)], ["node", "links", "other", "edge"])
            return None

        for batch in batches:
            cell, low, high = (batch.column(c).to_numpy() for c in ("cell", "low", "high"))
            cut = np.flatnonzero((cell[1:] != cell[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1
            bounds = [0, *cut.tolist(), batch.num_rows]
            for s, e in itertools.pairwise(bounds):
                if s == e:
                    continue
                mine = (int(cell[s]), int(low[s]), int(high[s]))
                if held and mine != name:
                    if sum(b.num_rows for b in held) > 1 and (made := finish()) is not None:
                        yield made
                    held = []
                name = mine
                held.append(batch.slice(s, e - s))
        if held and sum(b.num_rows for b in held) > 1 and (made := finish()) is not None:
            yield made

    return run


def near_embeddings(
    spark: SparkSession, rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95,
    tables: int = 6, blocks: int = 2, probes: int = 2, scale: float = 0.45, seed: int = 7,
) -> DataFrame:
    """Per row: id, n_links, component_id, kept.

    Null, empty and all-zero vectors and those with null or non-finite
    components link with nothing (n_links 0, own component, kept).  Identical
    vectors are collapsed first and counted by their number, so a group of
    copies costs one row.  Cells are counted without their vectors, which go
    only to cells where some meet; large cells are split into pairs of chunks
    of ``CHUNK_ROWS`` rows.  Vectors of different lengths do not compare.  An
    empty table gives an empty result; labels and other columns are not read.
    """
    scratch = Scratch(spark, "near-embeddings")
    double = rows.schema[vector_col].dataType.elementType.simpleString() == "double"
    kind, options = ("<f8" if double else "<f4"), (tables, blocks, probes, scale, seed)
    id_type = rows.schema[id_col].dataType.simpleString()
    slim = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    vectors = scratch.keep(slim.mapInArrow(_vector_batches(double), f"id {id_type}, node long, vec binary"), "vectors")
    members = vectors.select("id", "node")
    distinct = scratch.keep(
        vectors.where("node is not null").groupBy("node").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("mult"), F.min("vec").alias("vec")), "distinct"
    )
    cells = scratch.keep(distinct.repartition("node").mapInArrow(_cell_batches(kind, options), "cell long, table int, probe boolean, node long"), "cells")
    per_cell = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("k"), F.min("probe").alias("no_own")).where("k > 1 and not no_own")
    split = cells.join(per_cell.select("cell", F.ceil(F.col("k") / CHUNK_ROWS).cast("int").alias("m")), "cell")
    split = split.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("m")).cast("int")).withColumn("with", F.explode(F.expr("sequence(0, m - 1)")))
    groups = split.select("cell", F.least("chunk", "with").alias("low"), F.greatest("chunk", "with").alias("high"), "table", "probe", "chunk", "node")
    # vectors join only what meets another in its cell
    groups = groups.join(distinct.select("node", "mult", "vec"), "node")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = groups.repartition(parts, "cell", "low", "high").sortWithinPartitions("cell", "low", "high")
    met = scratch.keep(met.mapInArrow(_meeting_batches(kind, threshold, options), "node long, links long, other long, edge boolean"), "met")
    edges = met.where("edge").select(F.col("node").alias("a"), F.col("other").alias("b"))
    component = connected_components(spark, edges, scratch).withColumnRenamed("id", "node")
    links = met.where("not edge").groupBy("node").agg(F.sum("links").alias("links"))
    of_node = (
        distinct.select("node", "least", "mult").join(links, "node", "left").join(component, "node", "left")
        .select("node", "least", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    )
    named = of_node.groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = of_node.join(named, "component").select("node", "n_links", "component_id")
    return members.join(of_node, "node", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"),
        (F.col("id") == F.coalesce("component_id", "id")).alias("kept"),
    )
