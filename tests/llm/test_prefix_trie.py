"""The conversation trie held against one built in plain Python."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from factorloom.llm import prefix_trie
from factorloom.llm.prefix_trie import conversation_trie, ends_digests, rebuilt_trie

SCHEMA = "conv_id long, turn long, role string, text string, conv string, depth string, pos string, len string, owner string"


def trie_of(members: dict) -> dict:
    """(conv, depth) -> (parent conv, convs, children, leaves, saved, ends) of conversations as lists of (role, text)."""
    starts = collections.defaultdict(set)
    for c, said in members.items():
        for d in range(len(said) + 1):
            starts[tuple(said[:d])].add(c)
    children = collections.defaultdict(list)
    for path in starts:
        if path:
            children[path[:-1]].append(path)

    def sums(path):
        leaves, saved = int(not children[path]), (len(starts[path]) - 1) * (len(path[-1][1]) if path else 0)
        for child in children[path]:
            more = sums(child)
            leaves, saved = leaves + more[0], saved + more[1]
        return leaves, saved

    out = {}
    for path, who in starts.items():
        ends = ",".join(str(c) for c in sorted(who) if len(members[c]) == len(path))
        out[min(who), len(path)] = (min(starts[path[:-1]]) if path else None, len(who), len(children[path]), *sums(path), hashlib.sha256(ends.encode()).hexdigest())
    return out


def as_lists(rows) -> dict:
    said = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            said[c].append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [(r, t) for _, r, t in sorted(x)] for c, x in said.items()}


def rebuilt(own: dict) -> dict:
    out = {}
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + said[h:]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], SCHEMA).repartition(3)


def found(df) -> dict:
    rows = df.collect()
    got = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(got) == len(rows)
    return got


def random_rows(seed: int, convs: int, most: int, words: str = "ab") -> list:
    draw, rows = random.Random(seed), []
    for c in range(convs):
        for t in range(draw.randint(1, most)):
            rows.append((c * 7 % 1000, t, draw.choice(["u", "a", None]) if t % 3 == 2 else "u", draw.choice([*words, "longer text é😀", None])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_rebuilt_conversations(spark, seed):
    rows = random_rows(seed, 120, 9)
    rows += [(None, 1, "u", "no conversation"), (500, None, "u", "first"), (500, 3, "u", "z"), (500, 3, "u", "b"), (500, 3, "u", "b"), (1205, 1, "u", "only turn")]
    assert found(rebuilt_trie(spark, frame(spark, rows))) == trie_of(rebuilt(as_lists(rows)))


def test_blocks_long_conversations_and_nested_chains(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    monkeypatch.setattr(prefix_trie, "LISTED", 3)
    rows = [(c, t, "u", f"m{t}") for c in range(40, 60) for t in range(70)]  # one hot group of copies
    rows += [(c, t, "u", f"m{t}" if t < 2 * c else f"{c}:{t}") for c in range(1, 12) for t in range(25)]  # each hangs from the one before
    want = trie_of(as_lists(rows))
    got = conversation_trie(spark, frame(spark, rows))
    assert found(got) == want
    last = {(c, d): said[d - 1] for c, said in as_lists(rows).items() for d in range(1, len(said) + 1)}
    assert all((r.role, r.text) == last.get((r.conv_id, r.depth), (None, None)) for r in got.collect())


def test_turnless_and_empty(spark):
    alone = [(c, 0, "u", "x") for c in range(1, 40) if zlib.crc32(str(c).encode()) % 6 > 0]
    got = found(rebuilt_trie(spark, frame(spark, alone)))
    assert got == trie_of(rebuilt(as_lists(alone))) and list(got) == [(1, 0)]
    assert rebuilt_trie(spark, frame(spark, alone).limit(0)).count() == 0
    assert conversation_trie(spark, frame(spark, [(None, 1, "u", "x")])).count() == 0


def test_one_conversation_over_many_tasks(spark):
    rows = [(9, t // 3, "u", str(t % 5)) for t in range(900)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    numbered = prefix_trie.numbered_turns(spark, df)
    got = [r.text for r in numbered.orderBy("pos").collect()]
    assert got == [t for _, _, _, t in sorted(rows)]
    assert [r.pos for r in numbered.orderBy("pos").collect()] == list(range(1, 901))


def test_digests_of_many_ends(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LISTED", 10)
    ends = spark.range(1000).select((F.col("id") % 3).alias("conv"), F.lit(1).cast("long").alias("depth"), F.col("id").alias("member")).repartition(5)
    got = {r.conv: r.ends_sha256 for r in ends_digests(ends).collect()}
    assert got == {k: hashlib.sha256(",".join(str(i) for i in range(1000) if i % 3 == k).encode()).hexdigest() for k in range(3)}
