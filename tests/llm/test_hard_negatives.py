"""Hard negatives held against brute force, with ties, repeats, odd vectors and several blocks of anchors."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.llm.hard_negatives import Best, Turned, hard_negatives, rotation, surviving_pairs

SCHEMA = "vec_id long, embedding array<double>, label int, anchor string, id string, score string, vec string"


def brute(rows, is_anchor, positives=5, negatives=5, scale=256):
    """Result rows as a multiset, by plain Python integers."""
    live = []
    for k, v, label in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            live.append((k, [math.floor(scale * x) for x in v], label))
    out = collections.Counter()
    first = lambda hits, n: sorted(hits, key=lambda h: (-h[0], h[1] is None, h[1] or 0))[:n]
    for at, (k, v, label) in enumerate(live):
        if k is None or not is_anchor(k):
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), j, other) for z, (j, w, other) in enumerate(live) if z != at and len(w) == len(v)]
        for p, pid, _ in first([s for s in scored if s[2] == label], positives):
            inside = [s for s in scored if s[2] != label and 80 * p <= 100 * s[0] <= 100 * p]
            for rank, (n, nid, _) in enumerate(first(inside, negatives), 1):
                out[(k, pid, rank, nid, p, n)] += 1
    return out


def frame(spark, rows):
    return spark.createDataFrame([(k, v, label, "a", "i", "s", "v") for k, v, label in rows], SCHEMA).repartition(3)


def found(df):
    return collections.Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def random_rows(seed, n, d, labels=3, spread=0.3):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, d))
    return [(k, (centres[k % 6] + spread * draw.normal(size=d)).tolist(), int(draw.integers(labels))) for k in range(n)]


@pytest.mark.parametrize("block", [4096, 7])
def test_equal_to_brute_force(spark, block):
    rows = random_rows(4, 300, 12)
    got = found(hard_negatives(spark, frame(spark, rows), F.col("vec_id") % 10 == 0, block_anchors=block))
    assert got == brute(rows, lambda k: k % 10 == 0) and len(got) > 100


def test_odd_vectors_ties_and_repeats(spark):
    rows = random_rows(8, 60, 4, labels=2, spread=1.5)
    rows += [(k, rows[k][1], rows[k][2]) for k in (0, 10, 10, 20)]  # equal rows, anchors too
    rows += [(900 + k, [0.5, 0.25, -0.5, 1.0], k % 3) for k in range(40)]  # ties beyond what is kept
    rows += [(None, [0.5, 0.25, -0.5, 1.0], 1), (10, [1.0, 1.0, 1.0, 1.0], 1), (30, [-9.0, 0.1, 0.2, 0.3], 0)]
    rows += [(1000, None, 1), (1010, [1.0, 2.0, 3.0, 4.0], None), (1020, [1.0, None, 3.0, 4.0], 1), (1030, [1.0, math.nan, 3.0, 4.0], 1), (1040, [math.inf, 0.0, 0.0, 0.0], 1)]
    rows += [(1100, [1.0, 2.0], 0), (1101, [1.0, 2.0], 0), (1102, [1.0, 1.9], 1), (1110, [], 1), (1111, [], 1), (1112, [], 0), (1120, [0.0] * 4, 0), (1130, [3.0], 2)]
    got = found(hard_negatives(spark, frame(spark, rows), F.col("vec_id") % 10 == 0))
    assert got == brute(rows, lambda k: k % 10 == 0)
    assert any(k[0] == 1100 for k in got) and any(k[0] == 1110 for k in got)


def test_no_rows_and_no_anchors(spark):
    rows = random_rows(1, 20, 3)
    assert hard_negatives(spark, frame(spark, rows).limit(0), F.lit(True)).count() == 0
    assert hard_negatives(spark, frame(spark, rows), F.col("vec_id") < 0).count() == 0
    assert hard_negatives(spark, frame(spark, [(1, [1.0], 1)]), F.lit(True)).count() == 0


def test_huge_vectors_leave_the_others_alone(spark):
    rows = random_rows(2, 40, 3)
    want = brute(rows, lambda k: k % 5 == 0)
    got = found(hard_negatives(spark, frame(spark, [*rows, (500, [1e30, 0.0, 0.0], 1), (505, [1e7, 1e7, 1e7], 2)]), F.col("vec_id") % 5 == 0))
    assert got == want


def test_bounds_discard_pairs_and_lose_none():
    draw = np.random.default_rng(3)
    x = np.floor(256 * (draw.normal(size=(900, 32)) * (0.8 ** np.arange(32)))).astype(np.int64)
    turn, off = rotation(x.astype(float))
    rows, counts = Turned(x, turn, 48**2 * 2.0**-50 + off), {}
    exact = x @ x.T
    low = np.sort(exact, axis=1)[:, -6].astype(float)
    high = low * 1.5
    got = {(i, j): s for a, b, c in surviving_pairs(rows, rows, low, high, np.eye(900, dtype=bool), counts) for i, j, s in zip(a.tolist(), b.tolist(), c.tolist())}
    want = {(i, j) for i, j in zip(*np.nonzero((exact >= low[:, None]) & (exact <= high[:, None]))) if i != j}
    assert want <= got.keys() and all(exact[i, j] == s for (i, j), s in got.items())
    assert counts["verified"] < 0.1 * counts["pairs"]


def test_the_best_of_each_key():
    draw, best, seen = random.Random(6), Best(4, 3), collections.defaultdict(list)
    for _ in range(30):
        some = [(draw.randrange(4), draw.randrange(-5, 5), draw.randrange(9)) for _ in range(draw.randint(0, 6))]
        for k, s, i in some:
            seen[k].append((-s, i))
        key, score, ids = (np.array([r[c] for r in some], np.int64) for c in range(3))
        best.add(key, score, ids)
    for k, hits in seen.items():
        assert list(zip((-best.score[k]).tolist(), best.id[k].tolist())) == sorted(hits)[:3]
