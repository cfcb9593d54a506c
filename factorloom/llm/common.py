"""Helpers that several training-data operators share."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the word separators of every shingle operator.
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where the setting is absent on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="factorloom-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Bytes of text in one Arrow batch between the JVM and Python: bounds the memory of a task whatever the texts.
BATCH_BYTES = 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_BYTES``, unless they are smaller already."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, "64m")
    number, unit = now.rstrip("bkmgBKMG"), now.lstrip("0123456789-").lower().rstrip("b")
    size = int(number or -1) << {"": 0, "k": 10, "m": 20, "g": 30}.get(unit, 0)
    if size <= 0 or size > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def release_memory() -> None:
    """Give what a finished task held back to the system: Python workers live on."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def releasing(run):
    """A batch function that gives memory back when its task is over."""

    @functools.wraps(run)  # with its annotations, by which Spark tells the kinds of functions
    def outer(batches):
        yield from run(batches)
        release_memory()

    return outer


@contextlib.contextmanager
def dropped_shuffles(spark: SparkSession):
    """Delete the shuffle files of each query run inside when it ends, not when the JVM next collects garbage.

    A query that is run once more writes them again, and inside one they serve
    retries as ever.  The session's own setting comes back afterwards.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.made = 0

    def keep(self, df: DataFrame, tag: str) -> DataFrame:
        path = f"{self.root}/{self.made:03d}-{tag}"
        self.made += 1
        with dropped_shuffles(self.spark):
            df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept.scratch_path = path
        return kept

    def drop(self, df: DataFrame | None) -> None:
        """Delete a table that nothing reads any more."""
        path = getattr(df, "scratch_path", None)
        if path:
            jvm = self.spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


class WordHashes(dict):
    """64-bit hash of each word, remembered between documents up to ``limit`` words."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        self[word] = value
        return value


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def words_of(text: bytes | None) -> list[bytes]:
    """ASCII-lower-cased words ``[^\\x20\\x09-\\x0D]+`` (bytes methods treat ASCII only)."""
    return text.lower().split() if text else []


def one_at_a_time(texts, step: int = 256):
    """The values of an Arrow array, a few in Python's memory at a time."""
    for at in range(0, len(texts), step):
        yield from texts.slice(at, step).to_pylist()


def shingle_hashes(words: list[bytes], cache: WordHashes, size: int = 5) -> np.ndarray:
    """64-bit hash of each ``size``-word shingle in order; a shorter text is one shingle, an empty one none."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, n)
    width = min(n, size)
    out = h[: n - width + 1] * _ODD[0]
    for k in range(1, width):
        out = mix64(out) + h[k : n - width + 1 + k] * _ODD[k]
    return mix64(out + np.uint64(width))


def connected_components(spark: SparkSession, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Smallest reachable id of every vertex that has an edge.

    ``edges`` holds (a long, b long).  Alternating large-star and small-star
    rounds; each is a grouped minimum (map-side combined) and an equi join
    whose hot keys adaptive execution can split.  Each round is written to the
    shared folder.  Returns (id, component).  Nothing is collected but two
    numbers a round.
    """

    def star(pairs: DataFrame, both: bool) -> DataFrame:
        # large star keeps neighbours above the centre; small star those below it
        flipped = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))
        near = pairs.unionByName(flipped) if both else pairs
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = near.join(least, "a")
        if both:
            out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    # every pair points from the larger id to the smaller one
    current = scratch.keep(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    mark = None
    while True:
        row = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if row == mark or row[0] == 0:
            break
        mark = row
        following = scratch.keep(star(star(current, True), False), "star")
        scratch.drop(current)
        current = following
    roots = current.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
