"""Sparse junction forests and the case axis held against the numpy kernel and enumeration."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from factorloom.model import Cpt, Network, Variable
from factorloom.operators import inference
from factorloom.plans.junction import CompiledNetwork
from factorloom.plans.sparse import VALUE, SparseForest, case_posteriors, learned_tables

COLUMNS = ["a", "b", "c", "d", "e", "f"]
EDGES = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e")]  # f is a component of its own


@pytest.fixture(scope="module")
def data(spark):
    draw, rows = random.Random(2), []
    for _ in range(1500):
        a = draw.randrange(3)
        b, c = (a + draw.randrange(2)) % 3, draw.choice((a, 2))
        d = (b + c) % 4 if draw.random() < 0.7 else draw.randrange(4)
        rows.append(tuple(map(str, (a, b, c, d, d % 2 if draw.random() < 0.9 else 1, draw.randrange(2)))))
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in COLUMNS))


@pytest.fixture(scope="module")
def tables(data):
    return learned_tables(data, COLUMNS, EDGES)


@pytest.fixture(scope="module")
def dense(tables):
    """The same tables as arrays; combinations of parents that never occur get a uniform row, which no evidence can reach."""
    import numpy as np

    outcomes = {c: sorted(r[c] for r in tables[c].select(c).distinct().collect()) for c in COLUMNS}
    cpts = []
    for v, df in tables.items():
        scope = [c for c in df.columns if c != VALUE]
        table = np.zeros([len(outcomes[c]) for c in scope])
        for r in df.collect():
            table[tuple(outcomes[c].index(r[c]) for c in scope)] = r[VALUE]
        flat = table.reshape(-1, table.shape[-1])
        flat[flat.sum(axis=1) == 0] = 1 / flat.shape[1]
        cpts.append(Cpt(v, tuple(scope[:-1]), table))
    return Network("dense", [Variable(c, tuple(outcomes[c])) for c in COLUMNS], cpts)


def plain(df):
    return {(r["variable"], r["outcome"]): r["p"] for r in df.collect()}


def test_posteriors_equal_the_kernels(spark, tables, dense):
    forest, kernel = SparseForest(spark, tables), CompiledNetwork(dense)
    for evidence in ({}, {"e": "0"}, {"d": "3", "f": "1"}, {"b": "0", "c": "2", "e": "1"}, {"a": "0", "e": "1"}):
        want, mass = kernel.infer(evidence)
        got = plain(forest.posteriors(COLUMNS, evidence))
        for v in COLUMNS:
            for k, o in enumerate(dense.variables[v].outcomes):
                assert got.get((v, o), 0.0) == pytest.approx(want[v][k])
        assert forest.evidence_probability(evidence) == pytest.approx(mass)
    assert plain(forest.posterior("a", {"f": "no such outcome"})) == {} and plain(forest.posterior("f", {"a": "?"})) == {}
    with pytest.raises(ValueError, match="unknown"):
        forest.posterior("nobody")


def test_other_evidence_recomputes_only_what_it_changes(spark, tables):
    forest = SparseForest(spark, tables)
    forest.posteriors(COLUMNS, {"e": "0"}).collect()
    before = set(forest.known)
    forest.posteriors(COLUMNS, {"e": "1"}).collect()
    fresh = set(forest.known) - before
    leaf = next(k for k, c in enumerate(forest.cliques) if "e" in c)
    # messages towards the leaf that holds e know nothing of e
    assert fresh and all(("e", "1") in key[2] for key in fresh) and not any(key[1] == leaf for key in fresh)


def test_one_shuffle_a_message(spark, tables):
    small = {v: df.cache() for v, df in tables.items()}
    assert all(df.count() for df in small.values())  # their sizes are known, so that they are broadcast
    forest = SparseForest(spark, small)
    a, b = next((k, n) for k in forest.near for n in forest.near[k] if len(forest.near[k]) == 1)
    from factorloom.plans.sparse import onto, product

    plan = onto(product(forest._held_tables(a, {})), forest.near[a][b])._jdf.queryExecution().executedPlan().toString()
    assert plan.split("InMemoryRelation")[0].count("Exchange hashpartitioning") <= 1


def test_many_cases_share_a_plan(spark, tables, dense):
    draw, rows = random.Random(4), []
    for k in range(200):
        rows.append((k, draw.choice(("0", "1", "2", None)), draw.choice(("0", "1", "2", "3", None)), draw.choice(("0", "1", None)), draw.choice(("0", "1"))))
    cases = spark.createDataFrame(rows, "case_id long, b string, d string, e string, f string")
    for query, observed in (("a", ["b", "d", "e", "f"]), ("c", ["d", "e"]), ("e", ["b"]), ("b", ["b", "d"]), ("f", ["b"]), ("a", [])):
        got = case_posteriors(tables, query, cases, observed, ["case_id"])
        assert "MapInPandas" not in got._jdf.queryExecution().executedPlan().toString()
        want = inference.infer_batch(spark, dense, cases, observed, [query], ["case_id"]).where("p > 0")
        read = lambda df: {(r["case_id"], r["outcome"]): round(r["p"], 9) for r in df.collect()}
        assert read(got) == read(want)
    assert case_posteriors(tables, "a", cases.limit(0), ["b"], ["case_id"]).count() == 0


def test_a_clique_too_large_for_arrays(spark):
    """Three columns of 3,000 outcomes each: 2.7 x 10^10 cells of which 6,000 occur."""
    data = spark.range(6000).select(
        (F.col("id") % 3000).cast("string").alias("x"), ((F.col("id") * 7) % 2999).cast("string").alias("y"), ((F.col("id") * 13) % 2998).cast("string").alias("z")
    )
    forest = SparseForest(spark, learned_tables(data, ["x", "y", "z"], [("x", "y"), ("x", "z"), ("y", "z")]))
    assert len(forest.cliques) == 1
    some = data.first()
    got = plain(forest.posterior("x", {"z": some["z"]}))
    rows = [r["x"] for r in data.where(F.col("z") == some["z"]).collect()]
    assert got == pytest.approx({("x", x): rows.count(x) / len(rows) for x in set(rows)})


def test_joint_of_all_equals_enumeration(spark, tables, dense):
    joint = {}
    for at in itertools.product(*(range(dense.variables[c].card) for c in COLUMNS)):
        p = 1.0
        for c in dense.cpts.values():
            p *= c.table[tuple(at[COLUMNS.index(v)] for v in c.scope)]
        joint[at] = p
    hit = sum(p for at, p in joint.items() if dense.variables["d"].outcomes[at[3]] == "1")
    assert SparseForest(spark, tables).evidence_probability({"d": "1"}) == pytest.approx(hit)
