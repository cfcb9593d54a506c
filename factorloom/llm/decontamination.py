"""Benchmark items inside documents: size-partitioned MinHash containment search.

Items are partitioned by the number of their shingles, in classes a factor of
sqrt(2) apart.  A whole long document has a Jaccard similarity of nearly zero
to a short item, so for each class the document is read in windows of twice the
class's size, each half a window on.  Any run of the class's size lies in one
window, whose similarity to the item is then bounded from below.  A window and
an item that agree on any of ``hashes`` minima make a candidate, and every
candidate is verified by exact containment of the item's shingles in the whole
document's set.  A similarity of at least 0.26 misses with 32 minima one pair in
18,000; items of up to four shingles, all of which a document must hold, are
found by one of them exactly.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm.common import WordHashes, bound_batches, releasing, shingle_hashes, words_of

#: Items, and bytes of their texts, whose sketches are broadcast at once; a larger benchmark is searched in blocks of about so many.
ITEMS_PER_BLOCK = 20_000
BYTES_PER_BLOCK = 16 << 20
#: Sets up to this size are contained only as a whole (at 80 per cent), so one shingle finds them.
SMALL_SET = 4
LEAST_WINDOW = 4


def size_class(n: int) -> int:
    """Class of a set of n shingles: the least power of sqrt(2) that is at least n, as an exponent."""
    return max(2 * int(math.log2(LEAST_WINDOW)), math.ceil(2 * math.log2(n) - 1e-9))


def class_size(k: int) -> int:
    return math.ceil(2 ** (k / 2) - 1e-9)


class ItemSketches:
    """A block of items: shingle sets, and per size class and hash function the sorted minima."""

    def __init__(self, items: list[tuple[object, bytes]], size: int, hashes: int, seed: int, percent: int):
        cache = WordHashes()
        self.size = size
        self.factors = np.random.default_rng(seed).integers(1, 2**63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        sets = [(key, np.unique(shingle_hashes(words_of(text), cache, size))) for key, text in items]
        sets = [(key, s) for key, s in sets if len(s)]
        self.ids = [key for key, _ in sets]
        self.sets = [s for _, s in sets]
        self.classes: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        whole = lambda s: -(-percent * len(s) // 100) == len(s) and len(s) <= SMALL_SET
        small = np.array([i for i, s in enumerate(self.sets) if whole(s)], np.int64)
        first = np.array([self.sets[i][0] for i in small], np.uint64)
        order = np.argsort(first, kind="stable")
        self.small_gate = np.zeros(1 << 16, bool)
        self.small_gate[first & np.uint64(0xFFFF)] = True
        self.small_first, self.small_item = first[order], small[order]
        rest = [i for i, s in enumerate(self.sets) if not whole(s)]
        for k in sorted({size_class(len(self.sets[i])) for i in rest}):
            mine = np.array([i for i in rest if size_class(len(self.sets[i])) == k])
            tables = []
            for f in self.factors:
                low = np.array([self.values(self.sets[i], f).min() for i in mine], np.uint32)
                order = np.argsort(low, kind="stable")
                gate = np.zeros(1 << 16, bool)
                gate[low & np.uint32(0xFFFF)] = True
                tables.append((gate, low[order], mine[order]))
            self.classes[k] = tables

    @staticmethod
    def values(shingles: np.ndarray, factor: np.uint64) -> np.ndarray:
        return ((shingles * factor) >> np.uint64(32)).astype(np.uint32)

    def candidates(self, shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """(document, item) pairs to verify; ``bounds`` cuts the shingles into documents."""
        sizes = np.diff(bounds)
        full = np.flatnonzero(sizes)
        found = []
        if len(self.small_first):
            hit = np.flatnonzero(self.small_gate[shingles & np.uint64(0xFFFF)])
            begin, past = np.searchsorted(self.small_first, shingles[hit]), np.searchsorted(self.small_first, shingles[hit], "right")
            many = past - begin
            which = np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            found.append(np.stack([np.repeat(np.searchsorted(bounds, hit, "right") - 1, many), self.small_item[which]], axis=1))
        grids = {}
        for k in self.classes:
            step = class_size(k)
            blocks = -(-sizes[full] // step)
            doc = np.repeat(full, blocks)
            at = np.repeat(bounds[full], blocks) + step * (np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
            grids[k] = (doc, at, np.r_[doc[1:] == doc[:-1], False][: len(doc)])
        for h, factor in enumerate(self.factors):
            value = self.values(shingles, factor)
            for k, tables in self.classes.items():
                gate, low, item = tables[h]
                doc, at, more = grids[k]
                least = np.minimum.reduceat(value, at)
                window = np.where(more, np.minimum(least, np.r_[least[1:], least[-1:]]), least)
                hit = np.flatnonzero(gate[window & np.uint32(0xFFFF)])
                first, past = np.searchsorted(low, window[hit]), np.searchsorted(low, window[hit], "right")
                many = past - first
                if many.any():
                    which = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
                    found.append(np.stack([np.repeat(doc[hit], many), item[which]], axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)

    def search(self, texts: list[bytes | None], cache: WordHashes, percent: int) -> list[tuple[int, int, int]]:
        """(document, item, shared shingles) of every verified containment."""
        hashes = [shingle_hashes(words_of(t), cache, self.size) for t in texts]
        bounds = np.r_[0, np.cumsum([len(h) for h in hashes])]
        if not bounds[-1] or not self.sets:
            return []
        out, last, own = [], -1, np.empty(0, np.uint64)
        for d, i in self.candidates(np.concatenate(hashes), bounds).tolist():
            if d != last:
                last, own = d, np.sort(hashes[d])
            mine = self.sets[i]
            at = np.minimum(np.searchsorted(own, mine), len(own) - 1)
            shared = int((own[at] == mine).sum())
            if 100 * shared >= percent * len(mine):
                out.append((d, i, shared))
        return out


def _slices(texts: pa.Array) -> Iterator[tuple[int, list]]:
    for at in range(0, len(texts), 400):
        yield at, texts.slice(at, 400).to_pylist()


def _search_batches(shared, percent: int):
    def run(batches):
        sketches, cache = shared.value, WordHashes()
        item_type = pa.array(sketches.ids or [0]).type
        for batch in batches:
            for at, texts in _slices(batch.column(1)):
                found = sketches.search(texts, cache, percent)
                rows = pa.array([at + d for d, _, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(rows),
                        pa.array([sketches.ids[i] for _, i, _ in found], item_type),
                        pa.array([len(sketches.sets[i]) for _, i, _ in found], pa.int64()),
                        pa.array([s for _, _, s in found], pa.int64()),
                    ],
                    ["id", "item", "item_shingles", "shared"],
                )

    return releasing(run)


def item_blocks(spark: SparkSession, items: DataFrame, id_col: str, text_col: str, size: int, hashes: int, seed: int, percent: int):
    """Broadcast sketches of the benchmark, a bounded block of items at a time."""
    bound_batches(spark)
    slim = items.select(F.col(id_col).alias("id"), F.encode(F.col(text_col), "UTF-8").alias("text")).where("text is not null")
    whole = slim.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-whole["n"] // ITEMS_PER_BLOCK), -(-whole["bytes"] // BYTES_PER_BLOCK))
    for b in range(blocks):
        rows = slim.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id").collect()
        yield spark.sparkContext.broadcast(ItemSketches([(r["id"], bytes(r["text"])) for r in rows], size, hashes, seed, percent))


def contained_items(
    spark: SparkSession, docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
    size: int = 5, percent: int = 80, hashes: int = 32, seed: int = 11,
) -> DataFrame:
    """One row per (document, item) with 100 x shared >= ``percent`` x the item's shingles: ids, item_shingles, shared, containment.

    Map-only over documents: long texts are read in windows, a hot source or
    copies move nothing.  Null, empty and wordless texts and items match
    nothing.  An item of fewer than ``size`` words is one shingle, which only a
    document of the same words has.  Repeated documents or items each give
    their rows; empty tables give an empty result.
    """
    doc_type, item_type = docs.schema[id_col].dataType.simpleString(), items.schema[item_id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.encode(F.col(text_col), "UTF-8").alias("text"))
    out: DataFrame | None = None
    for shared in item_blocks(spark, items, item_id_col, item_text_col, size, hashes, seed, percent):
        some = slim.mapInArrow(_search_batches(shared, percent), f"id {doc_type}, item {item_type}, item_shingles long, shared long")
        out = some if out is None else out.unionByName(some)
    ratio = (F.col("shared") / F.col("item_shingles")).alias("containment")
    return out.select(F.col("id").alias(id_col), F.col("item").alias("item_id"), "item_shingles", "shared", ratio)


def _flag_arrays(shared, percent: int):
    def flags(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sketches, cache = shared.value, WordHashes()
        for array in arrays:
            flag = np.zeros(len(array), bool)
            for at, texts in _slices(array):
                flag[[at + d for d, _, _ in sketches.search(texts, cache, percent)]] = True
            yield pa.array(flag)

    return releasing(flags)


def leaks_into(spark: SparkSession, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", size: int = 5, percent: int = 80, hashes: int = 32, seed: int = 11) -> Column:
    """Boolean column: does the text hold any item?  The same search, for filters that keep whole rows in place."""
    out = F.lit(False)
    for shared in item_blocks(spark, items, item_id_col, item_text_col, size, hashes, seed, percent):
        out = out | F.arrow_udf(_flag_arrays(shared, percent), "boolean")(F.encode(F.col(text_col), "UTF-8"))
    return out
