"""The trie of conversations that share prefixes.

A node is a distinct sequence of first turns; the smallest conversation that
starts with it owns it.  Who owns a prefix owns all its longer ones, so a
conversation owns a chain: the nodes from some first depth to its end.  That
depth is found by binary search: in each round every open conversation asks,
in one join, who is the smallest at the digest of the prefix in the middle.
The chains form the tree (a chain hangs from the node above its first one);
sums of subtrees go up chain by chain, then along each chain.

A digest is the exclusive or, in two independent 64-bit halves, of a hash of
each turn with its depth, so running digests of a long conversation come from
bounded blocks like running sums.  Two of 10^10 different prefixes of one
depth share a digest with a probability of about 10^-19.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.llm.common import Scratch, releasing

#: Depths of one conversation or chain that a window sees together.
BLOCK = 1024
#: Ids that are joined to one text before it is hashed.
LISTED = 1 << 16
PARTITION_BITS = 33  # of monotonically_increasing_id: the row within its partition
NO_ENDS = hashlib.sha256(b"").hexdigest()


def numbered_turns(spark: SparkSession, turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, role, text): turns of each conversation numbered from 1 by turn (null first), then role and text.

    Null roles and texts become empty; rows without a conversation take no
    part.  The rows are sorted as a whole, equal ones by a number of their own,
    so that one conversation may fill many tasks; what stands before a task's
    part of a conversation is a sum over the few tasks that hold the rest.
    """
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.xxhash64(F.monotonically_increasing_id()).alias("salt"),
    )
    order = ["conv", "turn", "role", "text", "salt"]
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "role", "text", F.monotonically_increasing_id().alias("at"))
    kept = Scratch(spark, "turns").keep(sorted_rows, "sorted").withColumn("part", F.shiftright("at", PARTITION_BITS))
    runs = kept.groupBy("conv", "part").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("conv", "part", (F.coalesce(before, F.lit(0)) - F.col("start") + 1).alias("shift"))
    return kept.join(runs, ["conv", "part"]).select("conv", (F.col("at") + F.col("shift")).alias("pos"), "role", "text")


def hashed_steps(steps: DataFrame, *more: str | Column) -> DataFrame:
    """Columns ``more`` and, for role and text, two hashes and the number of code points."""
    return steps.select(*more, F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit("second"), "text", "role").alias("h2"), F.char_length("text").cast("long").alias("cp"))


def rebuilt_steps(turns: DataFrame, group: int = 100, shared: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of the first one of their ``group`` ids.

    Conversation c takes the first h turns of c - c % group (all if fewer, none
    if it is absent), h = crc32(c in decimal) % shared, then its own turns after
    its first h.  ``turns`` has conv, pos and the columns of ``hashed_steps``.
    Returns the steps (conv, depth, ..) and the members (conv, len), those
    without turns included.
    """
    lens = turns.groupBy("conv").agg(F.max("pos").alias("n"))
    infos = lens.select("conv", "n", (F.col("conv") - F.col("conv") % group).alias("base"), (F.crc32(F.col("conv").cast("string")) % shared).alias("h"))
    bases = lens.where(F.col("conv") % group == 0).select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    infos = infos.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    own = turns.join(infos.select("conv", "h", "taken"), "conv").where("pos > h")
    own = own.select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "h1", "h2", "cp")
    # at most shared - 1 turns of a base go to at most 2 * group conversations
    lent = turns.where((F.col("conv") % group == 0) & (F.col("pos") < shared)).withColumnRenamed("conv", "base")
    lent = lent.join(infos.where("taken > 0").select("base", "conv", "taken"), "base").where("pos <= taken").select("conv", F.col("pos").alias("depth"), "h1", "h2", "cp")
    return own.unionByName(lent), infos.select("conv", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"))


def running(rows: DataFrame, key: str, order: str, columns: dict[str, str], xor: bool = False) -> DataFrame:
    """Replace ``columns`` (name: input) by running sums (or exclusive ors) along the whole number ``order``, which is unique for a key.

    A window sees one block of ``BLOCK`` numbers; what precedes it is one row a block.
    """
    total = F.bit_xor if xor else F.sum
    blocked = rows.withColumn("block", F.floor(F.col(order) / BLOCK))
    inside = Window.partitionBy(key, "block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    past = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocked.groupBy(key, "block").agg(*(total(c).alias(f"all_{k}") for k, c in enumerate(columns.values())))
    before = before.select(key, "block", *(F.coalesce(total(f"all_{k}").over(past), F.lit(0)).alias(f"before_{k}") for k in range(len(columns))))
    here = blocked.select("*", *(total(c).over(inside).alias(f"here_{k}") for k, c in enumerate(columns.values()))).join(before, [key, "block"])
    both = lambda k: F.col(f"before_{k}").bitwiseXOR(F.col(f"here_{k}")) if xor else F.col(f"before_{k}") + F.col(f"here_{k}")
    gone = [*columns.values(), *columns]
    return here.select(*(c for c in rows.columns if c not in gone), *(both(k).alias(name) for k, name in enumerate(columns)))


def _first_owned(scratch: Scratch, paths: DataFrame, minima: DataFrame, members: DataFrame, longest: int) -> DataFrame:
    """(conv, len, first, above): the first depth a conversation owns, len + 1 if none, and the owner of the depth before it (null: the root's)."""
    state = scratch.keep(members.select("conv", "len", F.lit(1).cast("long").alias("low"), (F.col("len") + 1).alias("high")), "search")
    asks = lambda open_, depth: open_.withColumn("depth", depth).join(paths.select("conv", "depth", "k1", "k2"), ["conv", "depth"]).join(
        minima.select("depth", "k1", "k2", "owner"), ["depth", "k1", "k2"]
    )
    settled = []
    for _ in range(longest.bit_length()):
        found = asks(state.where("low < high"), F.expr("(low + high) div 2"))
        owned = F.col("owner") == F.col("conv")
        found = found.select("conv", "len", F.when(owned, F.col("low")).otherwise(F.col("depth") + 1).alias("low"), F.when(owned, F.col("depth")).otherwise(F.col("high")).alias("high"))
        settled.append(state.where("low = high"))
        state = scratch.keep(found, "search")
    settled.append(state)
    done = reduce(DataFrame.unionByName, settled).select("conv", "len", F.col("low").alias("first"))
    above = asks(done.where("first > 1"), F.col("first") - 1).select("conv", "len", "first", F.col("owner").alias("above"))
    return scratch.keep(above.unionByName(done.where("first = 1").withColumn("above", F.lit(None).cast("long"))), "chains")


def _summed_up(scratch: Scratch, chains: DataFrame) -> DataFrame:
    """Chains with the leaves and savings of all that hangs below their first node; each waits for those that hang from it.

    ``chains`` has conv, parent, at, leaves and saved (their own) and waits
    (how many hang from it).  A round takes the chains that wait for none, so
    there are as many rounds as chains hang below each other, at most the
    number of turns of a conversation.
    """
    open_, finished = scratch.keep(chains, "waiting"), []
    while True:
        ready = open_.where("waits = 0").drop("waits")
        finished.append(ready)
        up = ready.groupBy(F.col("parent").alias("conv")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"), F.count(F.lit(1)).alias("came"))
        rest = open_.where("waits > 0").join(up, "conv", "left")
        add = lambda c, more: (F.col(c) + F.coalesce(more, F.lit(0))).alias(c)
        rest = rest.select("conv", "parent", "at", add("leaves", "more_leaves"), add("saved", "more_saved"), (F.col("waits") - F.coalesce("came", F.lit(0))).alias("waits"))
        open_ = scratch.keep(rest, "waiting")
        if not open_.limit(1).count():
            return reduce(DataFrame.unionByName, finished)


def _listed(batches):
    """Sorted (conv, depth, member) to texts of at most ``LISTED`` comma-joined members of one node."""
    node, held, first = None, [], None
    rows: list[tuple] = []

    def flush():
        if held:
            rows.append((*node, first, ",".join(map(str, held))))
            held.clear()

    def batch():
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.string()], strict=True)], ["conv", "depth", "first", "ids"])
        rows.clear()
        return out

    for some in batches:
        for conv, depth, member in zip(*(c.to_pylist() for c in some.columns), strict=True):
            if (conv, depth) != node or len(held) >= LISTED:
                flush()
                node, first = (conv, depth), member
            held.append(member)
        if rows:
            yield batch()
    flush()
    if rows:
        yield batch()


def _hashed(batches):
    """Sorted (conv, depth, first, ids) to one digest a node, fed text by text."""
    node, digest = None, None
    for some in batches:
        rows = []
        for conv, depth, ids in zip(*(some.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
            if (conv, depth) != node:
                if node is not None:
                    rows.append((*node, digest.hexdigest()))
                node, digest = (conv, depth), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["conv", "depth", "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, digest.hexdigest())], ["conv", "depth", "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending, comma-joined ``member`` ids of each (conv, depth).

    All ids are sorted together, so those of one node may lie in many tasks;
    only their joined texts meet in one, where they are hashed one by one.
    """
    order = ["conv", "depth", "member"]
    texts = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(releasing(_listed), "conv long, depth long, first long, ids string")
    return texts.repartition("conv", "depth").sortWithinPartitions("conv", "depth", "first").mapInArrow(releasing(_hashed), "conv long, depth long, ends_sha256 string")


def prefix_trie(spark: SparkSession, steps: DataFrame, members: DataFrame) -> DataFrame:
    """One row a node of the trie of conversations, by its smallest member and its depth.

    ``steps``: conv long, depth (from 1, without gaps), h1, h2, cp as of
    ``hashed_steps``; ``members``: conv and len, its number of steps (0 too).
    Returns conv_id, depth, parent_conv_id (null for the root), n_convs,
    n_children, n_leaves, saved_tokens (summed over the subtree, (n_convs - 1)
    times the code points of the last text) and ends_sha256 (of the ids of the
    conversations that end there).  No members, no rows; a table whose
    conversations are all without turns gives the root alone.
    """
    scratch = Scratch(spark, "trie")
    members = scratch.keep(members.select("conv", F.col("len").cast("long").alias("len")), "members")
    root = members.agg(F.min("conv").alias("owner"), F.count(F.lit(1)).alias("n"), F.max("len").alias("longest")).first()
    if root["owner"] is None:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    top = F.lit(root["owner"]).cast("long")

    terms = steps.select("conv", F.col("depth").cast("long").alias("depth"), "cp", F.xxhash64("h1", "depth").alias("t1"), F.xxhash64("h2", "depth").alias("t2"))
    paths = scratch.keep(running(terms, "conv", "depth", {"k1": "t1", "k2": "t2"}, xor=True), "paths")
    minima = paths.groupBy("depth", "k1", "k2").agg(F.min("conv").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.min("cp").alias("cp"))
    minima = scratch.keep(minima, "minima")
    found = _first_owned(scratch, paths, minima, members, root["longest"])
    found = found.withColumn("above", F.coalesce("above", top))

    is_top = F.col("conv") == top
    chains = found.where((F.col("first") <= F.col("len")) | is_top).select("conv", "len", F.when(~is_top, F.col("above")).alias("parent"), (F.col("first") - 1).alias("at"))
    nodes = minima.select(F.col("owner").alias("conv"), "depth", "n_convs", ((F.col("n_convs") - 1) * F.col("cp")).alias("own"))
    nodes = nodes.unionByName(spark.range(1).select(top.alias("conv"), F.lit(0).cast("long").alias("depth"), F.lit(root["n"]).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("own")))
    hanging = chains.where("parent is not null").groupBy(F.col("parent").alias("conv"), F.col("at").alias("depth")).agg(F.count(F.lit(1)).alias("hang"))
    hanging = scratch.keep(hanging, "hanging")

    # bottom up over the chains
    at_end = hanging.select("conv", F.col("depth").alias("len"), "hang")
    waits = hanging.groupBy("conv").agg(F.sum("hang").alias("waits"))
    own = nodes.groupBy("conv").agg(F.sum("own").alias("saved"))
    begin = chains.join(own, "conv").join(waits, "conv", "left").join(at_end, ["conv", "len"], "left")
    begin = begin.select("conv", "parent", "at", F.col("hang").isNull().cast("long").alias("leaves"), "saved", F.coalesce("waits", F.lit(0)).alias("waits"))
    sums = _summed_up(scratch, begin)
    below = sums.where("parent is not null").groupBy(F.col("parent").alias("conv"), F.col("at").alias("depth"))
    below = below.agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"), F.count(F.lit(1)).alias("hang"))

    # along each chain, from its end
    zero = F.lit(0).cast("long")
    each = nodes.join(below, ["conv", "depth"], "left").join(chains.select("conv", "len", "parent", (F.col("at") + 1).alias("first")), "conv")
    each = each.withColumn("n_children", (F.coalesce("hang", zero) + (F.col("depth") < F.col("len")).cast("long")))
    each = each.select(
        "conv", "depth", "n_convs", "n_children", (-F.col("depth")).alias("back"),
        F.when(is_top, F.when(F.col("depth") > 0, F.col("conv"))).when(F.col("depth") == F.col("first"), F.col("parent")).otherwise(F.col("conv")).alias("parent"),
        (F.coalesce("more_leaves", zero) + (F.col("n_children") == 0).cast("long")).alias("leaf_part"), (F.coalesce("more_saved", zero) + F.col("own")).alias("saved_part"),
    )
    each = running(each, "conv", "back", {"n_leaves": "leaf_part", "saved_tokens": "saved_part"})

    ends = found.select(F.when((F.col("first") <= F.col("len")) | is_top, F.col("conv")).otherwise(F.col("above")).alias("conv"), F.col("len").alias("depth"), F.col("conv").alias("member"))
    out = each.join(ends_digests(ends), ["conv", "depth"], "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def conversation_trie(spark: SparkSession, turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of conversations as they are, with the role and text of each node's last turn (null for the root).

    Null roles and texts count as empty, null turns come first, repeated turns
    are ordered by role and text, and rows without a conversation take no part.
    """
    numbered = numbered_turns(spark, turns, conv_col, turn_col, role_col, text_col)
    steps = hashed_steps(numbered, "conv", F.col("pos").alias("depth"))
    nodes = prefix_trie(spark, steps, numbered.groupBy("conv").agg(F.max("pos").alias("len")))
    said = numbered.select(F.col("conv").alias("conv_id"), F.col("pos").alias("depth"), "role", "text")
    return nodes.join(said, ["conv_id", "depth"], "left")


def rebuilt_trie(spark: SparkSession, turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", group: int = 100, shared: int = 6) -> DataFrame:
    """The trie of the conversations that ``rebuilt_steps`` makes; otherwise as ``conversation_trie`` without texts."""
    numbered = numbered_turns(spark, turns, conv_col, turn_col, role_col, text_col)
    return prefix_trie(spark, *rebuilt_steps(hashed_steps(numbered, "conv", "pos"), group, shared))
