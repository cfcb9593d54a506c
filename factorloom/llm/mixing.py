"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Means above this are drawn as a sum of independent Poisson counts of smaller means, which has the same distribution.
MAX_DRAWN_RATE = 300.0
#: Sources whose statistics may be broadcast; with more of them the join is salted.
MAX_BROADCAST_SOURCES = 10_000
SALTS = 64
#: Repeated ids that may be broadcast; with more of them the rows meet them in a join that can be split.
MAX_BROADCAST_IDS = 10_000
#: Equal rows that one task numbers.
RANKS = 1000
#: Bits of the shuffle key.
KEY_BITS = 60


def hash_bits(digits: int, *parts: Column) -> Column:
    """A number of 4 x ``digits`` bits of an md5 digest of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, digits), 16, 10)


def hash_unit(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of an md5 digest of the parts."""
    return hash_bits(13, *parts).cast("double") / float(1 << 52)


def numbered_keys(docs: DataFrame, id_col: str, key_col: str) -> DataFrame:
    """Adds a key by which each row draws for itself.

    It is the id where only one row has it.  Rows without an id, or with one
    that others have too, are told apart by a digest of all their columns and a
    number among equal rows.  Equal rows are counted instead of gathered and
    unrolled in pieces of ``RANKS``; which of them gets which number does not
    matter, so the result does not depend on where the rows lie.
    """
    own = docs.columns
    one = F.struct(*own).alias("mix_row")
    per_id = docs.groupBy(F.col(id_col).alias("mix_id")).agg(F.count(F.lit(1)).alias("mix_n"))
    repeated = per_id.where("mix_n > 1 and mix_id is not null").select("mix_id")
    found = per_id.agg(F.count_if(F.col("mix_id").isNull()).alias("nulls"), F.count_if((F.col("mix_n") > 1) & F.col("mix_id").isNotNull()).alias("repeats")).first()
    alone = docs.select("*", F.col(id_col).cast("string").alias(key_col))
    if not found["nulls"] and not found["repeats"]:
        return alone
    marked = docs.select(one, F.col(id_col).alias("mix_id"))
    if found["repeats"]:
        repeated = F.broadcast(repeated) if found["repeats"] <= MAX_BROADCAST_IDS else repeated
        marked = marked.join(repeated.select(F.col("mix_id").alias("mix_again")), F.col("mix_id") == F.col("mix_again"), "left")
        shared = F.col("mix_id").isNull() | F.col("mix_again").isNotNull()
    else:
        shared = F.col("mix_id").isNull()
    equal = marked.where(shared).select("mix_row.*").groupBy(*own).agg(F.count(F.lit(1)).alias("mix_n")).select(one, "mix_n")
    pieces = equal.withColumn("mix_piece", F.explode(F.expr(f"sequence(0L, (mix_n - 1) div {RANKS})"))).repartition(F.xxhash64("mix_row"), "mix_piece")
    ranks = F.expr(f"sequence(mix_piece * {RANKS} + 1, least(mix_n, (mix_piece + 1) * {RANKS}))")
    said = F.concat_ws("\u001f", *[F.coalesce(F.col(f"mix_row.`{c}`").cast("string"), F.lit("\u0000")) for c in own])
    unrolled = pieces.select("mix_row", F.md5(said).alias("mix_digest"), F.explode(ranks).alias("mix_rank"))
    numbered = unrolled.select("mix_row.*", F.concat("mix_digest", F.lit("="), F.col("mix_rank").cast("string")).alias(key_col))
    return marked.where(~shared).select("mix_row.*", F.col("mix_id").cast("string").alias(key_col)).unionByName(numbered)


def mix_sources(
    spark: SparkSession, docs: DataFrame, targets: dict[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0,
    seed: int = 17, id_col: str = "doc_id", source_col: str = "source", copy_col: str = "copy", key_col: str = "shuffle_key",
) -> DataFrame:
    """Repeat each document a Poisson number of times and shuffle all copies.

    A source's mean repetition rate is (its target share x epochs x all
    documents) / its documents.  ``targets`` gives weights by source (absent
    sources get none); without it weights are document counts to the power
    ``alpha``.  The count of a document inverts the Poisson distribution at a
    hash of seed and its key (a rate above ``MAX_DRAWN_RATE`` is a sum of draws
    at as many hashes), so reruns and lost tasks give the same copies.  The key
    is the id, or tells rows without an id of their own apart (see
    ``numbered_keys``): every row, also one of many equal ones, draws for
    itself.  Null sources are a source of their own (weight by ``alpha``, or
    none with ``targets``).  Null and empty texts are documents like any other;
    an empty table gives an empty result.  The result has all columns of ``docs`` (a column named like ``copy_col`` or
    ``key_col`` is replaced) in order of a hash of seed, key and copy: the key is
    uniform, so its leading part is the partition.
    """
    own = [c for c in docs.columns if c.lower() not in (copy_col.lower(), key_col.lower())]
    docs = docs.select(*own)
    sizes = docs.groupBy(F.col(source_col).alias("mix_source")).agg(F.count(F.lit(1)).alias("mix_n"))
    if targets is None:
        sizes = sizes.withColumn("mix_w", F.pow(F.col("mix_n").cast("double"), F.lit(float(alpha))))
    else:
        wanted = spark.createDataFrame([(str(k), float(v)) for k, v in targets.items()], "mix_source string, mix_w double")
        sizes = sizes.join(wanted, "mix_source", "left").fillna(0.0, ["mix_w"])
    # one row: totals over all documents
    totals = sizes.agg(F.sum("mix_n").alias("n"), F.sum("mix_w").alias("w"), F.count(F.lit(1)).alias("k")).first()
    n, w = float(totals["n"] or 0), float(totals["w"] or 0)
    rate = F.col("mix_w") / F.lit(w or 1.0) * F.lit(n * float(epochs)) / F.col("mix_n")
    draws = F.greatest(F.lit(1), F.ceil(F.col("mix_rate") / MAX_DRAWN_RATE)).cast("int")
    cdf = F.expr(
        "aggregate(sequence(1, cast(ceil(mix_drawn + 12 * sqrt(mix_drawn) + 30) as int)),"
        " named_struct('p', exp(-mix_drawn), 'c', exp(-mix_drawn), 'cdf', array(exp(-mix_drawn))),"
        " (s, k) -> named_struct('p', s.p * mix_drawn / k, 'c', s.c + s.p * mix_drawn / k, 'cdf', array_append(s.cdf, s.c + s.p * mix_drawn / k)), s -> s.cdf)"
    )
    rates = (
        sizes.withColumn("mix_rate", rate).withColumn("mix_draws", draws).withColumn("mix_drawn", F.col("mix_rate") / F.col("mix_draws"))
        .withColumn("mix_cdf", cdf).select("mix_source", "mix_draws", "mix_cdf")
    )
    match = F.col("mix_source").eqNullSafe(F.col(source_col))
    docs = numbered_keys(docs, id_col, "mix_key")
    if totals["k"] <= MAX_BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(rates), match)
    else:
        salted = rates.withColumn("mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = docs.withColumn("mix_at", F.pmod(F.xxhash64("mix_key"), F.lit(SALTS)).cast("int")).join(salted, match & (F.col("mix_at") == F.col("mix_salt")))
    key = F.col("mix_key")
    more = F.transform(F.sequence(F.lit(1), F.col("mix_draws") - 1), lambda j: hash_unit(F.concat(F.lit(f"{seed}d"), j.cast("string")), key))
    at = F.when(F.col("mix_draws") > 1, F.concat(F.array(hash_unit(F.lit(seed), key)), more)).otherwise(F.array(hash_unit(F.lit(seed), key)))
    counted = joined.withColumn("mix_u", at).withColumn("mix_count", F.expr("aggregate(mix_u, 0L, (s, u) -> s + size(filter(mix_cdf, c -> c <= u)))"))
    copies = counted.where("mix_count > 0").withColumn(copy_col, F.explode(F.expr("sequence(1L, mix_count)")))
    copies = copies.withColumn(key_col, hash_bits(KEY_BITS // 4, F.lit(f"{seed}s"), key, F.col(copy_col)).cast("long")).select(*own, copy_col, key_col)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return copies.repartitionById(parts, F.floor(F.col(key_col) / float(1 << KEY_BITS) * parts).cast("int")).sortWithinPartitions(key_col)
