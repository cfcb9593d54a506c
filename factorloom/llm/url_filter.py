"""URL rules answered by Bloom filter cascades; DataFrame and SQL functions only.

Every url gives a few candidate keys (host suffix + path prefix, one for each
shape that a rule has).  The distinct candidates of the corpus are the complete
key universe.  Level 0 of a cascade encodes the listed keys, level 1 the keys of
the universe that level 0 takes in wrongly, level 2 the listed keys that level 1
takes in wrongly, and so on until a level errs on nothing.  Over the universe
the cascade is therefore exact, and using it needs no join: its bits are array
literals inside the expression.  A listing too long for one expression is split
by a hash of its keys into shards with a cascade each, asked one after another.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm.common import ASCII_LOWER, ASCII_UPPER, Scratch

#: Bits of one level of one shard: what is collected and shipped with a plan is bounded by it.
MAX_LEVEL_BITS = 1 << 26
SHARD_SEED = 77


def url_host_path(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url column; both empty without ``://`` or for null."""
    rest = F.expr(f"case when instr(`{url}`, '://') > 0 then substring(`{url}`, instr(`{url}`, '://') + 3) else '' end")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), ASCII_UPPER, ASCII_LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


class Level:
    def __init__(self, words: list[int], bits: int, seeds: list[int]):
        self.words, self.bits, self.seeds = words, bits, seeds

    def contains_sql(self, key: str) -> str:
        """SQL predicate: may the level hold ``key``?  The bits stand in it once, as a literal that is folded to an array."""
        table = f"cast(split('{','.join(map(str, self.words))}', ',') as array<bigint>)"
        at = f"pmod(xxhash64({key}, seed), {self.bits}L)"
        bit = f"(shiftright(get({table}, cast(shiftright({at}, 6) as int)), cast({at} & 63 as int)) & 1L) = 1L"
        return f"forall(array({', '.join(f'{s}L' for s in self.seeds)}), seed -> {bit})"


def _bits(n: int, wrong_rate: float) -> int:
    return max(64, math.ceil(-n * math.log(wrong_rate) / math.log(2) ** 2))


def _wrong_rate(n_in: int, n_out: int) -> float:
    """False positives that level 0 may take in, so that later levels are small."""
    return min(0.5, max(1e-9, math.sqrt(0.5) * n_in / n_out)) if n_out else 0.5


def _level(keys: DataFrame, n: int, wrong_rate: float, depth: int) -> Level:
    bits = _bits(n, wrong_rate)
    seeds = [1000 * (depth + 1) + i for i in range(max(1, min(24, round(bits / max(n, 1) * math.log(2)))))]
    at = F.explode(F.array(*[F.expr(f"pmod(xxhash64(key, {s}L), {bits}L)") for s in seeds]))
    words = (
        keys.select(at.alias("at"))
        .groupBy(F.expr("cast(shiftright(at, 6) as int)").alias("w"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("v"))
        .collect()  # bounded: bits / 64 rows
    )
    table = [0] * math.ceil(bits / 64)
    for row in words:
        table[row["w"]] = row["v"]
    return Level(table, bits, seeds)


class BloomCascade:
    """Exact membership of ``listed`` among the keys of ``universe`` (DataFrames with one column ``key``)."""

    def __init__(self, listed: DataFrame, universe: DataFrame, scratch: Scratch):
        inside = listed.select("key").distinct()
        outside = universe.select("key").join(inside, "key", "left_anti")
        n_in, n_out = inside.count(), outside.count()
        rate = _wrong_rate(n_in, n_out)
        self.levels: list[Level] = []
        while n_in:
            level = _level(inside, n_in, rate, len(self.levels))
            self.levels.append(level)
            wrong = scratch.keep(outside.where(level.contains_sql("key")), f"level{len(self.levels)}")
            inside, outside, n_in, rate = wrong, inside, wrong.count(), 0.5

    def contains_sql(self, key: str) -> str:
        """The first level that rejects a key decides: an odd one says listed, an even one not."""
        out = "true" if len(self.levels) % 2 else "false"
        for depth in range(len(self.levels) - 1, -1, -1):
            out = f"(case when not {self.levels[depth].contains_sql(key)} then {'true' if depth % 2 else 'false'} else {out} end)"
        return out


def listed_keys(rows: DataFrame, keys: str, out: str, listed: DataFrame, universe: DataFrame, scratch: Scratch, max_bits: int) -> DataFrame:
    """Adds ``out``: those of the array column ``keys`` that are listed.

    A list whose first level fits ``max_bits`` is one cascade in one
    expression.  A longer one takes as many passes over ``rows`` as it has
    shards, each adding the keys of its shard.
    """
    n_in = listed.select("key").distinct().count()
    shards = -(-_bits(n_in, _wrong_rate(n_in, universe.count())) // max_bits)
    if shards == 1:
        return rows.withColumn(out, F.expr(f"filter({keys}, k -> {BloomCascade(listed, universe, scratch).contains_sql('k')})"))
    shard = lambda key: f"pmod(xxhash64({key}, {SHARD_SEED}L), {shards}L)"
    rows = rows.withColumn(out, F.expr("cast(array() as array<string>)"))
    for s in range(shards):
        some = BloomCascade(listed.where(f"{shard('key')} = {s}"), universe.where(f"{shard('key')} = {s}"), scratch)
        found = F.expr(f"filter({keys}, k -> {shard('k')} = {s} and {some.contains_sql('k')})")
        rows = scratch.keep(rows.withColumn(out, F.concat(F.col(out), found)), f"shard{s}")
    return rows


def url_verdicts(
    spark: SparkSession, pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow",
    max_bits: int = MAX_LEVEL_BITS,
) -> DataFrame:
    """Per page: id, host, path, rule (the longest that fits, else null), verdict.

    ``rules`` holds (action, host, path).  Null urls and urls without ``://``
    have empty host and path and fit no rule; repeated urls and ids keep their
    rows; an empty table gives an empty result; other columns are not read; a
    url of any length gives at most one key a shape of the rules.  A hot host
    costs nothing: the universe is a grouped distinct that combines before its
    shuffle, and the lookup itself never shuffles.
    """
    scratch = Scratch(spark, "url-cascade")
    host, path = url_host_path(url_col)
    parts = pages.select(F.col(id_col).alias("page_key"), host.alias("host"), path.alias("path"))
    shapes = sorted({(h.count(".") + 1, len(p)) for _, h, p in rules})
    candidates = [
        F.expr(
            f"case when length(path) >= {p} and host <> '' and size(split(host, '[.]')) >= {h}"
            f" then concat(substring_index(host, '.', -{h}), substring(path, 1, {p})) end"
        )
        for h, p in shapes
    ]
    keyed = parts.withColumn("keys", F.filter(F.array(*candidates), lambda k: k.isNotNull()) if candidates else F.expr("array('')"))
    universe = scratch.keep(keyed.select(F.explode("keys").alias("key")).distinct(), "universe")
    rows = json.dumps([{"action": a, "key": h + p} for a, h, p in rules])
    listing = spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<action:string,key:string>>")))
    found = listed_keys(keyed, "keys", "hits", listing, universe, scratch, max_bits)
    ruled = found.withColumn("rule", F.expr("array_max(transform(hits, k -> struct(length(k) as n, k as k))).k"))
    # a key outside every list is what the cascade calls not listed: the default verdict
    judged = ruled.withColumn("asked", F.expr("filter(array(rule), k -> k is not null)"))
    judged = listed_keys(judged, "asked", "blocked", listing.where("action = 'block'"), listing, scratch, max_bits)
    verdict = F.expr(f"case when rule is null then '{default}' when size(blocked) > 0 then 'block' else 'allow' end")
    return judged.select(F.col("page_key").alias(id_col), "host", "path", "rule", verdict.alias("verdict"))
