"""Statistics, structure learning, continuous columns, streams, the entry module."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from factorloom import catalog
from factorloom.fixtures import ASIA
from factorloom.functions.special import chi2_survival, ln_gamma
from factorloom.operators import gaussian, graph, learning, statistics
from factorloom.sources.readers import forward_sample
from factorloom.streaming.evidence import EVENT_SCHEMA, posterior_stream

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def collider(spark):
    draw = random.Random(4)
    rows = []
    for _ in range(4000):
        a, b = draw.random() < 0.5, draw.random() < 0.4
        c = draw.random() < (0.9 if a and b else 0.6 if a or b else 0.05)
        d = draw.random() < (0.85 if c else 0.1)
        rows.append(tuple(str(int(x)) for x in (a, b, c, d)))
    return spark.createDataFrame(rows, "A string, B string, C string, D string")


@pytest.fixture(scope="module")
def wide(spark):
    """Twelve columns of three outcomes, each but the first two drawn from two before it."""
    draw, rows = random.Random(7), []
    for _ in range(3000):
        row = [draw.randrange(3), draw.randrange(3)]
        for k in range(2, 12):
            row.append((row[k - 1] + row[k - 2]) % 3 if draw.random() < 0.8 else draw.randrange(3))
        rows.append(tuple(map(str, row)))
    return spark.createDataFrame(rows, ", ".join(f"v{k} string" for k in range(12)))


@pytest.fixture(scope="module")
def near_and_far(spark, wide):
    near = statistics.SufficientStatistics(wide, wide.columns)
    far = statistics.SufficientStatistics(wide, wide.columns, max_cells=0)
    assert near.local is not None and far.local is None and far.table is not None
    yield near, far
    far.release()


def test_scores_and_tests_in_spark_equal_the_drivers(near_and_far, monkeypatch):
    from factorloom.operators import families as module

    near, far = near_and_far
    wanted = [("v3", ()), ("v3", ("v2",)), ("v5", ("v0", "v4", "v11")), ("v0", ("v1", "v2", "v3", "v4", "v5", "v6"))]
    pairs = [("v0", "v5", ()), ("v2", "v4", ("v3",)), ("v6", "v9", ("v1", "v2", "v7", "v8"))]
    for dense, cells in ((1 << 16, 1 << 22), (20, 40)):  # counted in arrays and not, in one pass and several
        monkeypatch.setattr(module, "DENSE_CELLS", dense)
        monkeypatch.setattr(module, "PASS_CELLS", cells)
        for kind in ("bic", "aic", "k2", "bdeu"):
            assert far.scores(wanted, kind, 2.0) == pytest.approx(near.scores(wanted, kind, 2.0), rel=1e-9)
        for kind in ("chi2", "g2"):
            assert far.tests(pairs, kind) == [(pytest.approx(s), df) for s, df in near.tests(pairs, kind)]
    assert not far.memo  # no counts came to the driver


def test_hashed_configurations(near_and_far, monkeypatch):
    from factorloom.operators import families as module

    near, far = near_and_far
    monkeypatch.setattr(module, "MOST_NUMBERED", 1)
    monkeypatch.setattr(module, "DENSE_CELLS", 2)
    wanted = [("v5", ("v0", "v4", "v11")), ("v2", ("v1",))]
    assert far.scores(wanted, "bic") == pytest.approx(near.scores(wanted, "bic"), rel=1e-9)


@pytest.mark.parametrize("learner", [learning.hill_climb, learning.greedy_forward_backward, lambda s: learning.order_search(s, max_parents=2, restarts=0), learning.ges, learning.pc, lambda s: learning.pc(s, test="g2", variant="stable")])
def test_learners_are_the_same_over_spark_counts(spark, wide, learner):
    columns = wide.columns[:6]
    near, far = statistics.SufficientStatistics(wide, columns), statistics.SufficientStatistics(wide, columns, max_cells=0)
    a, b = learner(near), learner(far)
    assert a.edges == b.edges and a.score == pytest.approx(b.score) and a.details.get("tests") == b.details.get("tests")
    assert a.network.fingerprint() == b.network.fingerprint()
    assert {f for f in far.memo if len(f) > 1} <= {c.scope for c in b.network.cpts.values()}  # the model's tables and margins alone


def test_sub_batches_of_a_level(near_and_far):
    near, far = near_and_far
    for stable in (True, False):
        want = learning._skeleton(near, 0.01, "g2", 2, stable)
        asked = []
        original, far.tests = far.tests, lambda some, kind: asked.append(len(some)) or near.tests(some, kind)
        try:
            assert learning._skeleton(far, 0.01, "g2", 2, stable, per_job=40) == want
        finally:
            far.tests = original
        assert max(asked) <= 40 and len(asked) >= 3


def test_forty_columns_are_not_listed():
    class Independent:
        columns = [f"c{k}" for k in range(40)]
        local, table, asked = None, object(), 0

        def tests(self, some, kind):
            self.asked += len(some)
            assert len(some) <= learning.FAMILIES_PER_JOB
            # linked until two columns are given
            return [(0.0, 1) if len(given) == 2 else (1e6, 1) for _, _, given in some]

    stats = Independent()
    near, _, made = learning._skeleton(stats, 0.05, "g2", 2, True, every_level=True)
    assert not any(near.values()) and made == 780 * (1 + 38 + 1) and stats.asked < 60_000  # level two alone has 548,340 families


def test_families_agree_between_local_and_spark(spark, collider):
    columns = ["A", "B", "C", "D"]
    near = statistics.SufficientStatistics(collider, columns)
    far = statistics.SufficientStatistics(collider, columns, max_cells=0)
    families = [("A",), ("A", "C"), ("C", "A"), ("B", "A", "D"), ("A", "B", "C", "D")]
    far.prefetch(families)
    assert far.local is None and all((near.family(f) == far.memo[f]).all() for f in families)
    for edges in ([], [("A", "C"), ("B", "C")]):
        assert near.laplace_network(edges).fingerprint() == far.laplace_network(edges).fingerprint()
    with pytest.raises(ValueError, match="no rows"):
        statistics.SufficientStatistics(collider.limit(0), columns)


@pytest.mark.parametrize("learner", [learning.hill_climb, learning.greedy_forward_backward, learning.order_search, learning.ges, learning.pc])
def test_learners_recover_the_skeleton(collider, learner):
    stats = statistics.SufficientStatistics(collider, ["A", "B", "C", "D"])
    found = learner(stats)
    skeleton = {frozenset(e) for e in found.edges}
    assert {frozenset("AC"), frozenset("BC"), frozenset("CD")} <= skeleton
    assert graph.topological_order(stats.columns, found.edges) is not None
    assert graph.structural_hamming([("A", "C"), ("B", "C"), ("C", "D")], found.edges) <= 4


@pytest.mark.parametrize(("kind", "search"), [("bic", learning.order_search), ("bdeu", learning.ges)])
def test_searches_find_the_best_graph_of_all(spark, kind, search):
    stats = catalog.statistics_of(spark, DATA)
    scores = learning.FamilyScores(stats, kind)
    pairs = list(itertools.combinations(stats.columns, 2))
    best = -math.inf
    for ways in itertools.product((None, 0, 1), repeat=len(pairs)):
        edges = [(a, b) if w == 0 else (b, a) for (a, b), w in zip(pairs, ways, strict=True) if w is not None]
        if graph.topological_order(stats.columns, edges) is not None:
            best = max(best, scores.total({c: {a for a, b in edges if b == c} for c in stats.columns}))
    assert search(stats).score == pytest.approx(best)


def test_fci_marks(collider):
    found = learning.fci(statistics.SufficientStatistics(collider, ["A", "B", "C", "D"]))
    marks = found.details["marks"]
    assert {frozenset(e) for e in marks} == {frozenset("AC"), frozenset("BC"), frozenset("CD")}
    assert marks["A", "C"] == marks["B", "C"] == marks["C", "D"] == "arrow" and marks["D", "C"] == "tail" and marks["C", "A"] == "circle"
    assert found.edges == [("C", "D")] and found.details["dropped"] == [("A", "C"), ("B", "C")]  # a latent cause is not ruled out


def test_pc_orients_the_collider_and_options_hold(collider):
    stats = statistics.SufficientStatistics(collider, ["A", "B", "C", "D"])
    for variant in ("original", "stable"):
        assert {("A", "C"), ("B", "C"), ("C", "D")} == set(learning.pc(stats, test="g2", variant=variant).edges)
    assert all(len([e for e in learning.hill_climb(stats, max_parents=1, restarts=2, seed=s).edges if e[1] == c]) <= 1 for s in (1, 2) for c in stats.columns)
    assert learning.hill_climb(stats, score="k2").edges and learning.hill_climb(stats, score="aic").edges
    for name in ("pc", "fci", "ges", "grasp"):
        assert learning.causal_discovery(stats, name).network.variables
    with pytest.raises(ValueError, match="unknown algorithm"):
        learning.causal_discovery(stats, "magic")
    with pytest.raises(RuntimeError, match="failed"):
        learning.causal_discovery(stats, "pc", nonsense=1)


def test_seeded_generator_values():
    draw = learning.mulberry32(42)
    assert [round(next(draw), 6) for _ in range(3)] == [0.601104, 0.448291, 0.852466]


def test_chi2_and_gamma_columns(spark):
    rows = [(3.841459, 1, 0.05), (20.0, 4, 0.0004994), (120.0, 100, 0.0844067), (0.0, 3, 1.0), (5.0, 0, 1.0), (9999.0, 2, 0.0)]
    got = spark.createDataFrame(rows, "x double, df long, want double").withColumn("p", chi2_survival(F.col("x"), F.col("df"))).collect()
    assert all(r["p"] == pytest.approx(r["want"], abs=1e-6) and statistics.chi2_sf(r["x"], r["df"]) == pytest.approx(r["p"], abs=1e-9) for r in got)
    grid = spark.createDataFrame([(x / 7,) for x in range(1, 200)], "x double").withColumn("g", ln_gamma(F.col("x"))).collect()
    assert all(r["g"] == pytest.approx(math.lgamma(r["x"]), abs=1e-10) for r in grid)


@pytest.mark.parametrize("kind", ["g2", "chi2"])
def test_spark_and_driver_tests_agree(spark, collider, kind):
    stats = statistics.SufficientStatistics(collider, ["A", "B", "C", "D"])
    for x, y, given in (("A", "B", []), ("A", "B", ["C"]), ("A", "D", ["C", "B"])):
        row = statistics.independence_test(collider, x, y, given, kind).first()
        want, df = statistics.ci_from_counts(stats.family((x, y, *given)), kind)
        assert row["statistic"] == pytest.approx(want) and row["df"] == df and row["p_value"] == pytest.approx(statistics.chi2_sf(want, df), abs=1e-9)
        g2, _ = statistics.ci_from_counts(stats.family((x, y, *given)), "g2")
        assert statistics.mutual_information(collider, x, y, given).first()["mi"] == pytest.approx(g2 / 2 / stats.n)


def test_scores_agree(spark, collider):
    stats = statistics.SufficientStatistics(collider, ["A", "B", "C", "D"])
    row = statistics.family_bic(collider, "C", ["A", "B"]).first()
    assert row["score"] == pytest.approx(statistics.local_score(stats.family(("A", "B", "C")), stats.n))
    net = stats.laplace_network([("A", "C")])
    want = sum((c.table * 0 + stats.family(c.scope) * np.log(c.table)).sum() for c in net.cpts.values()) - (1 + 1 + 2 + 1) / 2 * math.log(stats.n)
    assert statistics.network_bic(spark, collider, net).first()["bic"] == pytest.approx(want)


def test_nulls_are_a_category(spark):
    df = spark.createDataFrame([(None, "x"), ("", "x"), ("a", None)], "p string, c string")
    assert {(r["p"], r["c"]): r["_n"] for r in statistics.joint_counts(df, ["p", "c"]).collect()} == {("", "x"): 2, ("a", ""): 1}


def test_forward_sample_follows_the_tables(spark):
    drawn = forward_sample(spark, ASIA, 20_000, seed=3)
    share = {(r["smoke"], r["lung"]): r["n"] / 20_000 for r in drawn.groupBy("smoke", "lung").agg(F.count("*").alias("n")).collect()}
    assert share["yes", "yes"] == pytest.approx(0.05, abs=0.01) and share["no", "yes"] == pytest.approx(0.005, abs=0.003)
    assert sorted(map(tuple, forward_sample(spark, ASIA, 50, seed=3).collect())) == sorted(map(tuple, forward_sample(spark, ASIA, 50, seed=3).collect()))


@pytest.mark.parametrize(
    ("values", "method", "bins", "cuts"),
    [(range(10), "equal-width", 3, [3, 6]), (range(10, 50, 10), "equal-width", 2, [25]), (range(1, 10), "equal-frequency", 3, [4, 7]), ([1, 1, 1, 1, 5], "equal-frequency", 3, [1]), ([2, 2], "equal-width", 3, [])],
)
def test_discretize(spark, values, method, bins, cuts):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    assert gaussian.thresholds(df, "v", method, bins) == pytest.approx(cuts)
    labels = {r["v_bin"] for r in gaussian.discretize(df, "v", method, bins).collect()}
    assert labels <= set(gaussian.bin_labels(cuts))


def test_discretize_errors_and_large_ranks(spark):
    df = spark.range(5000).select((F.col("id") * F.col("id")).cast("double").alias("v"))
    assert gaussian.thresholds(df, "v", "equal-frequency", 10) == [float((i * 500) ** 2) for i in range(1, 10)]
    for bad in (lambda: gaussian.thresholds(df.limit(0), "v"), lambda: gaussian.thresholds(df, "v", bins=0), lambda: gaussian.thresholds(df, "v", "other")):
        with pytest.raises(ValueError, match=r"."):
            bad()
    assert gaussian.bin_labels([]) == ["all"] and gaussian.bin_labels([1.0, 2.5]) == ["<1", "1-2.50", ">=2.50"]


def test_linear_gaussian(spark):
    rows = [(float(x1), float(x2), "k", 1 + 2.0 * x1 + 3.0 * x2) for x1 in range(6) for x2 in range(5)] + [(1.0, 2.0, "few", 5.0), (2.0, 2.0, "few", 7.0)]
    df = spark.createDataFrame(rows, "x1 double, x2 double, g string, y double")
    fit = {r["config_key"]: r for r in gaussian.fit_linear_gaussian(df, "y", ["x1", "x2"], ["g"]).collect()}
    assert [fit["k"]["intercept"], *fit["k"]["coefficients"]] == pytest.approx([1, 2, 3]) and fit["k"]["variance"] == pytest.approx(0, abs=1e-6)
    assert (fit["few"]["intercept"], fit["few"]["coefficients"], fit["few"]["variance"]) == (6.0, [0.0, 0.0], 2.0)
    cases = spark.createDataFrame([(1.0, None, "k"), (1.0, 1.0, "unknown")], "x1 double, x2 double, g string")
    out = gaussian.predict_linear_gaussian(gaussian.fit_linear_gaussian(df, "y", ["x1", "x2"], ["g"]), cases, ["x1", "x2"], ["g"]).collect()
    assert sorted((r["g"], round(r["mean"], 6), r["matched"]) for r in out) == [("k", 3.0, True), ("unknown", 6.0, False)]


def test_evidence_stream(spark, tmp_path):
    spark.createDataFrame([("v1", "2024-01-01 00:00:00", "set", "smoke", "yes"), ("v2", "2024-01-01 00:00:01", "set", "smoke", "nonsense")], "view_id string, ts string, action string, variable string, value string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(EVENT_SCHEMA).parquet(str(tmp_path / "in"))
    run = posterior_stream(spark, events, ASIA, ["lung"]).writeStream.format("memory").queryName("posts").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    spark.createDataFrame([("v1", "2024-01-01 00:00:02", "clear", "smoke", None)], "view_id string, ts string, action string, variable string, value string").withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(str(tmp_path / "in"))
    run.processAllAvailable()
    run.stop()
    rows = [(r["view_id"], round(r["p"], 4), r["evidence"]) for r in spark.table("posts").where("outcome = 'yes'").collect()]
    assert ("v1", 0.1, '{"smoke": "yes"}') in rows and ("v2", 0.055, "{}") in rows and ("v1", 0.055, "{}") in rows


def test_late_events_do_not_overwrite_newer_ones(spark):
    """Shuffled arrival in several batches gives what the events say in order of time."""
    import datetime
    import json

    from factorloom.streaming.evidence import replayed

    draw, rows, want = random.Random(8), [], {}
    start = datetime.datetime(2024, 1, 1)
    for view in range(12):
        seen = {}
        for k in range(40):
            action = draw.choice(["set"] * 6 + ["clear", "clear", "clear_all"])
            variable = draw.choice(["smoke", "xray", "asia", "nobody"])
            value = draw.choice(["yes", "no", "maybe"])
            rows.append((f"v{view}", start + datetime.timedelta(seconds=k * 17 + view), action, variable, value))
            if action == "set" and variable in ASIA.variables and value != "maybe":
                seen[variable] = value
            elif action == "clear":
                seen.pop(variable, None)
            elif action == "clear_all":
                seen = {}
        want[f"v{view}"] = json.dumps(seen, sort_keys=True)
    draw.shuffle(rows)
    got = replayed(spark, spark.createDataFrame([*rows, (None, start, "set", "smoke", "yes"), ("v1", None, "set", "smoke", "yes")], EVENT_SCHEMA), ASIA, ["lung"]).collect()
    assert {r["view_id"]: r["evidence"] for r in got} == want and len(got) == 24
    from factorloom.plans.junction import CompiledNetwork

    for r in got:
        p = CompiledNetwork(ASIA).infer(json.loads(r["evidence"]))[0]["lung"]
        assert r["p"] == pytest.approx(p[list(ASIA.variables["lung"].outcomes).index(r["outcome"])])


def test_idle_views_are_forgotten_by_event_time(spark, tmp_path):
    def add(*rows):
        frame = spark.createDataFrame([(v, t, a, n, x) for v, t, a, n, x in rows], "view_id string, ts string, action string, variable string, value string")
        frame.withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(str(tmp_path / "in"))

    add(("v1", "2024-01-01 00:00:00", "set", "smoke", "yes"))
    events = spark.readStream.schema(EVENT_SCHEMA).parquet(str(tmp_path / "in"))
    run = posterior_stream(spark, events, ASIA, ["lung"], idle="10 minutes", delay="1 minute")
    run = run.writeStream.format("memory").queryName("idle").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        run.processAllAvailable()
        add(("v2", "2024-01-01 02:00:00", "set", "smoke", "no"))
        run.processAllAvailable()
        add(("v2", "2024-01-01 02:00:30", "set", "xray", "no"))
        run.processAllAvailable()
    finally:
        run.stop()
    rows = [(r["view_id"], r["evidence"], r["as_of"] is None) for r in spark.table("idle").where("outcome = 'yes'").collect()]
    assert ("v1", '{"smoke": "yes"}', False) in rows and ("v1", "{}", True) in rows
    assert ("v2", '{"smoke": "no", "xray": "no"}', False) in rows and ("v2", "{}", True) not in rows


def test_entry_and_catalogue(spark):
    assert __spark_entry__.entry(spark).count() == 3
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("orders", "part", "lineitem", "events", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    plain = lambda rows: sorted((tuple(round(float(v), 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert plain(tuple(r[c] for c in columns) for r in df.collect()) == plain(want)


def test_regression_on_large_values(spark):
    import numpy as np

    from factorloom.operators.gaussian import fit_linear_gaussian

    draw = np.random.default_rng(4)
    rows = [("a", 1.7e9 + k, 5.0 * k) for k in range(1000)] + [("b", float(k), 1e9 + 5.0 * k + x) for k, x in enumerate(draw.uniform(-0.5, 0.5, 1000).tolist())]
    rows += [("c", 3.0, float(k)) for k in range(5)] + [("d", 1.0, 2.0)]
    got = {r["config_key"]: r for r in fit_linear_gaussian(spark.createDataFrame(rows, "g string, x double, y double"), "y", ["x"], ["g"]).collect()}
    assert abs(got["a"]["coefficients"][0] - 5) < 1e-6 and abs(got["a"]["intercept"] / (-5 * 1.7e9) - 1) < 1e-6 and got["a"]["variance"] < 1e-3
    assert abs(got["b"]["coefficients"][0] - 5) < 1e-3 and abs(got["b"]["variance"] - 1 / 12) < 0.02
    assert got["c"]["coefficients"] == [0] and got["c"]["intercept"] == 2 and got["d"]["intercept"] == 2


def test_skewed_values_have_equal_frequency_bins(spark):
    from factorloom.operators.gaussian import thresholds

    values = spark.range(4000).selectExpr("cast(case when id % 400 = 0 then 1e12 + id else id % 1000 end as double) as v")
    rows = sorted(r["v"] for r in values.collect())
    assert thresholds(values, "v", "equal-frequency", 8) == sorted({rows[i * 4000 // 8] for i in range(1, 8)})
