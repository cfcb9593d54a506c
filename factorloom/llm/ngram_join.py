"""Exact n-gram Jaccard self-join: rare-first prefixes, length, positional and suffix filters.

1. One pass over the texts hashes each document's set of word shingles.  A
   *node* is a distinct set; copies share a node from here on.
2. Shingles meet by hash (packed in binary blocks, not rows) and each learns
   its document frequency.  A shingle of one node only can join nothing, so
   only repeated ones travel back; a node with fewer repeated shingles than any
   partner must share is out.  Shingles that a sample finds in very many
   documents go straight to their nodes as the most frequent of all: the order
   below needs no exact counts, only one order that all nodes share.
3. Nodes order their shingles by (frequency, hash), rare first.  Two sets that
   reach the threshold share a shingle of their prefixes.
4. Candidates meet on prefix shingles, pass length and positional filters, and
   are verified once per pair, where the suffix filter comes first.  A group of
   k mutual copies never becomes k^2 pairs: each prefix group is first linked
   through one leader; afterwards only pairs between different components are
   left, and all of those are verified.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm.common import Scratch, WordHashes, bound_batches, connected_components, one_at_a_time, releasing, shingle_hashes, words_of

#: Entries that are packed into blocks at once: at least, and at most where there are many targets.
BLOCK_ENTRIES, MOST_ENTRIES = 400_000, 4_000_000
#: Bytes of text of one partition as long as ``MOST_PARTS`` are not exceeded, and of the share of it that is in memory at once.
PART_BYTES, SHARE_BYTES = 16 << 20, 4 << 20
MOST_PARTS = 65_536
#: Pairs between components, by prefix row, up to which all are compared at once; beyond, leaders link some first.
CROSS_PAIRS = 256
#: A shingle of this many of so many sampled documents is hot: it skips the counting, so that no part receives it from everywhere.
SAMPLE_DOCS, HOT_DOCS = 2_000, 10
#: The frequency of hot shingles.
HOT_FREQUENCY = 0xFFFFFFFF


class Deal:
    """Where keys and nodes go: to a partition, and there to one of its shares, which a task reads one after another."""

    def __init__(self, parts: int, shares: int):
        self.parts, self.shares = parts, shares
        self.entries = min(MOST_ENTRIES, max(BLOCK_ENTRIES, 32 * parts * shares))

    def target(self, keys: np.ndarray) -> np.ndarray:
        part = keys % np.uint64(self.parts)
        return (part * np.uint64(self.shares) + keys // np.uint64(self.parts) % np.uint64(self.shares)).astype(np.int64)


def _pack(nodes: np.ndarray, sizes: np.ndarray, counts: np.ndarray, keys: np.ndarray, extra: np.ndarray | None = None) -> bytes:
    """Nodes with set sizes and numbers of entries, then the entries: a 64-bit key, a 32-bit value if given."""
    parts = [np.array([len(nodes), len(keys), extra is not None, 0], "<u4"), nodes.astype("<u8"), keys.astype("<u8"), sizes.astype("<u4"), counts.astype("<u4")]
    if extra is not None:
        parts.append(extra.astype("<u4"))
    return b"".join(p.tobytes() for p in parts)


def _read_blocks(blocks: list[bytes]):
    """Entries of some blocks: node, size of its set, key and value of each."""
    node, size, key, extra = [], [], [], []
    for block in blocks:
        n_nodes, n, with_extra, _ = np.frombuffer(block, "<u4", 4).tolist()
        at = 16

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(block, kind, count, at)  # noqa: B023
            at += out.nbytes
            return out

        nodes, keys, sizes, counts = take("<u8", n_nodes), take("<u8", n), take("<u4", n_nodes), take("<u4", n_nodes)
        node.append(np.repeat(nodes, counts))
        size.append(np.repeat(sizes, counts))
        key.append(keys)
        if with_extra:
            extra.append(take("<u4", n))
    join = lambda xs, kind: np.concatenate(xs) if xs else np.empty(0, kind)
    return join(node, np.uint64), join(size, np.uint32), join(key, np.uint64), join(extra, np.uint32)


def _blocks(to: np.ndarray, nodes, sizes, owner, keys, extra=None):
    """(target, block) of each target that has entries; ``owner`` is ascending."""
    if not len(to):
        return
    order = np.argsort(to.astype(np.uint16) if int(to.max()) < 1 << 16 else to, kind="stable")
    ranked = to[order]
    bounds = np.r_[0, np.flatnonzero(ranked[1:] != ranked[:-1]) + 1, len(to)]
    for s, e in itertools.pairwise(bounds.tolist()):
        at = order[s:e]
        mine = owner[at]
        first = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
        used = mine[first]
        yield int(ranked[s]), _pack(nodes[used], sizes[used], np.diff(np.r_[first, len(mine)]), keys[at], None if extra is None else extra[at])


SIGNED = lambda x: np.asarray(x, np.uint64).view(np.int64)


def _sample_batches(size: int):
    """Shingle and number of a batch's different texts that have it."""

    def run(batches):
        cache = WordHashes(100_000)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [np.unique(shingle_hashes(words_of(t), cache, size)) for t in set(batch.column(0).slice(at, 256).to_pylist())]
                keys, counts = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(SIGNED(keys)), pa.array(counts, pa.int64())], ["key", "c"])

    return releasing(run)


def hot_shingles(texts: DataFrame, rows: int, size: int, sample: int, least: int) -> np.ndarray:
    """Sorted shingles of at least ``least`` of about ``sample`` documents; a missed or extra one changes no result."""
    bound = (1 << 62) * min(1.0, sample / max(rows, 1))
    some = texts.where(F.shiftrightunsigned(F.xxhash64("text"), 2) < int(bound)).select(F.encode("text", "UTF-8").alias("text"))
    counts = some.mapInArrow(_sample_batches(size), "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))
    found = [r["key"] for r in counts.where(F.col("c") >= least).select("key").collect()]
    return np.sort(np.array(found, np.int64).view(np.uint64))


def _rows(id_type, deal: Deal, blocks: list[tuple[int, bytes]], first: bool = False) -> pa.RecordBatch:
    """Rows (id, n, node, part, share, block) of blocks; with ``first`` their shares count down from -2 and stand before all others."""
    k = len(blocks)
    parts, shares = [t // deal.shares for t, _ in blocks], [-2 - t % deal.shares if first else t % deal.shares for t, _ in blocks]
    columns = [pa.nulls(k, id_type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(parts, pa.int32()), pa.array(shares, pa.int32()), pa.array([b for _, b in blocks], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ROW_NAMES)


ROW_NAMES = ["id", "n", "node", "part", "share", "block"]


def _shingle_batches(deal: Deal, size: int, hot: np.ndarray):
    """Rows of two kinds: documents (id, n, node) and blocks of shingles (part, share, block).

    Blocks of ``hot`` shingles have a frequency already and go to their nodes' places.
    """
    import xxhash

    def run(batches):
        cache = WordHashes(100_000)
        held, seen, row = [], 0, TaskContext.get().partitionId() if TaskContext.get() else 0

        def flush():
            nonlocal held, seen
            nodes = np.array([h[0] for h in held], np.uint64)
            sizes = np.array([len(h[1]) for h in held], np.int64)
            keys = np.concatenate([h[1] for h in held])
            owner = np.repeat(np.arange(len(held)), sizes)
            known = hot[np.searchsorted(hot, keys).clip(max=len(hot) - 1)] == keys if len(hot) else np.zeros(len(keys), bool)
            much, whose = keys[known], owner[known]
            keys, owner = keys[~known], owner[~known]
            held, seen = [], 0
            yield _rows(id_type, deal, list(_blocks(deal.target(keys), nodes, sizes, owner, keys)))
            yield _rows(id_type, deal, list(_blocks(deal.target(nodes)[whose], nodes, sizes, whose, much, np.full(len(much), HOT_FREQUENCY))), first=True)

        for batch in batches:
            id_type = batch.column(0).type
            n_out, node_out, mine = [], [], set()
            for text in one_at_a_time(batch.column(1)):
                keys = np.unique(shingle_hashes(words_of(text), cache, size))
                n_out.append(len(keys))
                if not len(keys):
                    node_out.append(None)
                    continue
                node = xxhash.xxh3_64_intdigest(keys.tobytes(), seed=len(keys))
                node_out.append(node)
                if node not in mine:  # copies in a batch send their set once
                    mine.add(node)
                    held.append((node, keys))
                    seen += len(keys)
                    if seen >= deal.entries:
                        yield from flush()
            k = len(n_out)
            node_signed = [None if x is None else x - (1 << 64) if x >= 1 << 63 else x for x in node_out]
            dealt = pa.array((np.arange(row, row + k) % deal.parts).astype(np.int32))  # documents only pass through
            row += k
            columns = [batch.column(0), pa.array(n_out, pa.int64()), pa.array(node_signed, pa.int64()), dealt, pa.array(np.full(k, -1, np.int32)), pa.nulls(k, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ROW_NAMES)
        if held:
            yield from flush()

    return releasing(run)


def _repeated(blocks: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of the keys in some blocks those that several nodes have: node, size of its set, key and frequency."""
    node, size, key, _ = _read_blocks(blocks)
    order = np.argsort(key, kind="stable")
    same = key[order]
    again = np.zeros(len(same), bool)
    again[1:] = same[1:] == same[:-1]
    again[:-1] |= again[1:]
    order = order[again]
    node, size, key = node[order], size[order], key[order]
    order = np.lexsort((node, key))
    node, size, key = node[order], size[order], key[order]
    fresh = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])][: len(key)]
    node, size, key = node[fresh], size[fresh], key[fresh]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    count = np.diff(np.r_[starts, len(key)])
    frequency = np.repeat(count, count)
    keep = frequency > 1
    node, size, key, frequency = node[keep], size[keep], key[keep], frequency[keep]
    return node, size, key, frequency


def _by_share(batches, passed):
    """Lists of the blocks of one share each; rows of a negative share go to ``passed``, whose batches come out between."""
    held, now = [], None
    for batch in batches:
        share, block = batch.column("share").to_numpy(), batch.column("block")
        early = share < 0
        if early.any():
            yield from passed(batch.filter(pa.array(early)))
        for at in np.flatnonzero(~early).tolist():
            if share[at] != now and held:
                yield held
                held = []
            now = share[at]
            held.append(block[at].as_py())
    if held:
        yield held


def _frequency_batches(deal: Deal):
    """Per part: pass documents and hot shingles on; give each repeated shingle's frequency back to its nodes."""

    def run(batches):
        kinds = []

        def watched():
            for batch in batches:
                kinds[:] = [batch.column("id").type]
                yield batch

        def passed(batch):
            share = batch.column("share").to_numpy()
            yield batch.set_column(batch.schema.get_field_index("share"), "share", pa.array(np.where(share < -1, -2 - share, share).astype(np.int32)))

        for found in _by_share(watched(), passed):
            if isinstance(found, pa.RecordBatch):
                yield found
                continue
            node, size, key, frequency = _repeated(found)
            if len(key):
                order = np.argsort(node, kind="stable")
                node, size, key, frequency = node[order], size[order], key[order], frequency[order]
                nodes, at, owner = np.unique(node, return_index=True, return_inverse=True)
                out = list(_blocks(deal.target(nodes)[owner], nodes, size[at], owner, key, np.minimum(frequency, HOT_FREQUENCY - 1)))
                yield _rows(kinds[0], deal, out)

    return run


def _prefix_batches(percent: int):
    """Per node: size, unrepeated shingles, the rare-first joinable prefix and the repeated keys."""

    def run(batches):
        rows: list = []
        for blocks in _by_share(batches, None):
            node, size, key, frequency = _read_blocks(blocks)
            order = np.lexsort((key, frequency, node))
            node, size, key = node[order], size[order].astype(np.int64), key[order]
            fresh = np.r_[True, (node[1:] != node[:-1]) | (key[1:] != key[:-1])][: len(node)]  # copies send their hot shingles again
            node, size, key = node[fresh], size[fresh], key[fresh]
            starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]][: len(node)])
            repeated = np.diff(np.r_[starts, len(node)])
            for s, r in zip(starts.tolist(), repeated.tolist(), strict=True):
                n = int(size[s])
                least = (percent * n + 99) // 100
                if r < least:
                    continue
                lone = n - r  # these come first in rare-first order and join nothing
                prefix = n - least + 1 - lone
                mine = key[s : s + r]
                rows.append((int(SIGNED(node[s : s + 1])[0]), n, lone, SIGNED(mine[:prefix]).tolist(), np.sort(mine).tobytes()))
                if len(rows) == 2000:
                    yield _prefix_rows(rows)
                    rows = []
        if rows:
            yield _prefix_rows(rows)

    return releasing(run)


def _prefix_rows(rows):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["node", "n", "lone", "prefix", "keys"])


def _verify_batches(percent: int):
    def run(batches):
        for batch in batches:
            linked = []
            for na, la, ka, nb, lb, kb in zip(*(batch.column(c).to_pylist() for c in ("na", "la", "ka", "nb", "lb", "kb")), strict=True):
                # overlap >= percent / (100 + percent) x (na + nb)
                least = -(-percent * (na + nb) // (100 + percent))
                a, b = np.frombuffer(ka, "<u8"), np.frombuffer(kb, "<u8")
                # suffix filter: unrepeated shingles and unequal counts in 32 key classes cannot be shared
                apart = la + lb + int(np.abs(np.bincount(a >> np.uint64(59), minlength=32) - np.bincount(b >> np.uint64(59), minlength=32)).sum())
                if na + nb - apart < 2 * least:
                    linked.append(False)
                    continue
                both = np.concatenate([a, b])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                linked.append(100 * common >= percent * (na + nb - common))
            out = batch.filter(pa.array(linked, pa.bool_()))
            yield pa.RecordBatch.from_arrays([out.column("a"), out.column("b")], ["a", "b"])

    return releasing(run)


def _filters(percent: int) -> str:
    """Length filter, then positional filter: what is left after the matched position must suffice."""
    return (
        f"100 * least(l.n, m.n) >= {percent} * greatest(l.n, m.n) and "
        f"(1 + least(l.n - l.pos, m.n - m.pos)) * {100 + percent} >= {percent} * (l.n + m.n)"
    )


def shingle_components(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, parts: int | None = None, star_rounds: int = 3
) -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id reachable by links, itself included).

    Sets link when 100 x intersection >= ``percent`` x union.  A null, empty or
    wordless text has the empty set and links with nothing; a text of fewer
    than ``size`` words is one shingle.  Repeated rows and repeated ids keep
    their rows; an empty table gives an empty result; other columns are not
    read; texts of any length are read whole.  Shingles compare by 64-bit
    hashes.  Parts follow the bytes of text, and a task holds one share of its
    part, so its memory does not grow with the input.
    """
    bound_batches(spark)
    scratch = Scratch(spark, "ngram-join")
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.encode(F.col(text_col), "UTF-8").alias("text"))
    texts = docs.select(F.col(text_col).alias("text"))
    total = texts.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    parts = parts or min(MOST_PARTS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total["bytes"] // PART_BYTES)))
    deal = Deal(parts, max(1, -(-total["bytes"] // parts // SHARE_BYTES)))
    hot = hot_shingles(texts, total["rows"], size, SAMPLE_DOCS, HOT_DOCS)
    schema = f"id {kind}, n long, node long, part int, share int, block binary"
    hashed = slim.mapInArrow(_shingle_batches(deal, size, hot), schema)
    dealt = hashed.repartitionById(parts, "part").sortWithinPartitions("share").mapInArrow(releasing(_frequency_batches(deal)), schema)
    both = scratch.keep(dealt, "frequencies")
    members = scratch.keep(both.where("block is null").select("id", "n", "node"), "members")
    replies = both.where("block is not null").select("part", "share", "block")
    replies = replies.repartitionById(parts, "part").sortWithinPartitions("share")
    nodes = scratch.keep(replies.mapInArrow(_prefix_batches(percent), "node long, n long, lone long, prefix array<long>, keys binary"), "nodes")

    scratch.drop(both)
    prefix = nodes.select("node", "n", "lone", F.posexplode("prefix").alias("at", "token")).select("node", "n", "token", (F.col("at") + F.col("lone") + 1).alias("pos"), (F.col("lone") / F.col("n")).cast("float").alias("share"))
    # a token that no other prefix has makes no candidates
    shared = scratch.keep(prefix.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("token"), "shared")
    prefix = scratch.keep(prefix.join(shared, "token"), "prefix")
    keep = _filters(percent)
    component: DataFrame | None = None
    for turn in range(star_rounds + 1):
        if component is None:
            mine, last = prefix.withColumn("comp", F.col("node")), False
        else:
            named = scratch.keep(prefix.join(component, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component"), "named")
            scratch.drop(prefix)
            per_comp = named.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k"))
            major = per_comp.groupBy("token").agg(F.max(F.struct("k", "comp")).alias("top"), F.sum("k").alias("k"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
            major = scratch.keep(major.select("token", F.col("top.comp").alias("major"), "k", (F.col("k") - F.col("top.k")).alias("minor")), "open")
            work = major.agg(F.sum(F.col("k") * F.col("minor")).alias("pairs"), F.sum("k").alias("rows")).first()
            if not work["pairs"]:
                break
            # a token whose nodes are all of one component is done for good
            mine = scratch.keep(named.join(major.select("token", "major"), "token"), "mixed")
            scratch.drop(named)
            prefix = mine.drop("comp", "major")
            prefix.scratch_path = mine.scratch_path
            last = turn == star_rounds or work["pairs"] <= CROSS_PAIRS * work["rows"]
        if last:
            # every pair between different components has a member outside its token's largest one
            left = mine.where("comp <> major").alias("l")
            pairs = left.join(mine.alias("m"), "token").where(f"l.comp <> m.comp and {keep}")
        else:
            # the member with the fewest shingles of its own is the likeliest origin of the others; then any
            order = F.struct(F.col("share"), F.xxhash64("node")) if not turn else F.xxhash64("node", F.lit(turn))
            leader = mine.groupBy("token").agg(F.min(F.struct(order.alias("o"), "node", "n", "pos", "comp")).alias("l")).select("token", "l.node", "l.n", "l.pos", "l.comp")
            # written first: then both sides of the join are plain shuffles, and a hot token is split
            leader = scratch.keep(leader, "leaders").alias("l")
            pairs = mine.alias("m").join(leader, "token").where(f"l.comp <> m.comp and {keep}")
        pairs = pairs.select(F.least("l.node", "m.node").alias("a"), F.greatest("l.node", "m.node").alias("b")).distinct()
        side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("lone").alias(f"l{x}"), F.col("keys").alias(f"k{x}"))
        found = scratch.keep(pairs.join(side("b"), "b").join(side("a"), "a").mapInArrow(_verify_batches(percent), "a long, b long"), "links")
        # what is linked already stays as one edge a node
        edges = found if component is None else found.unionByName(component.select(F.col("node").alias("a"), F.col("component").alias("b")))
        component = scratch.keep(connected_components(spark, edges, scratch).select(F.col("id").alias("node"), "component"), "components")
        if last:
            break

    # the smallest id of each node, then of each component
    least = members.where("node is not null").groupBy("node").agg(F.min("id").alias("least"))
    of_node = least.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    of_comp = of_node.groupBy("component").agg(F.min("least").alias("component_id"))
    named = of_node.join(of_comp, "component").select("node", "component_id")
    out = members.join(named, "node", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    return out
