"""Networks, factors, inference: golden values and agreement between routes."""

import itertools

import numpy as np
import pytest

from factorloom.catalog import BIF_TEXT
from factorloom.fixtures import ASIA, DOG
from factorloom.model import Cpt, Network, Variable
from factorloom.operators import causal, graph, inference, loopy, sensitivity
from factorloom.operators.factor import Factor
from factorloom.plans.elimination import eliminate
from factorloom.plans.junction import CompilationCache, CompiledNetwork
from factorloom.session import Session
from factorloom.sources import formats, readers

# a network of two components, one with a loop
LOOPED = Network(
    "looped",
    [Variable("a", ("x", "y", "z")), Variable("b", ("0", "1")), Variable("c", ("0", "1")), Variable("d", ("0", "1", "2")), Variable("lone", ("u", "v"))],
    [
        Cpt("a", (), np.array([0.2, 0.3, 0.5])), Cpt("b", ("a",), np.array([0.9, 0.1, 0.4, 0.6, 0.25, 0.75])), Cpt("c", ("a",), np.array([0.5, 0.5, 0.2, 0.8, 0.7, 0.3])),
        Cpt("d", ("b", "c"), np.array([0.1, 0.2, 0.7, 0.3, 0.3, 0.4, 0.6, 0.2, 0.2, 0.5, 0.25, 0.25])), Cpt("lone", (), np.array([0.35, 0.65])),
    ],
)


def brute(net, evidence=None, likelihood=None):
    names = list(net.variables)
    totals = {v: np.zeros(net.variables[v].card) for v in names}
    for codes in itertools.product(*[range(net.variables[v].card) for v in names]):
        at = dict(zip(names, codes, strict=True))
        if any(net.variables[v].code(o) != at[v] for v, o in (evidence or {}).items()):
            continue
        p = np.prod([c.table[tuple(at[s] for s in c.scope)] for c in net.cpts.values()])
        for v, w in (likelihood or {}).items():
            p *= w.get(net.variables[v].outcomes[at[v]], 1.0)
        for v in names:
            totals[v][at[v]] += p
    s = totals[names[0]].sum()
    return {v: t / s if s else t for v, t in totals.items()}, s


CASES = [
    ({}, {}), ({"d": "2"}, {}), ({"d": "0", "b": "1"}, {}), ({}, {"b": {"0": 0.8, "1": 0.2}}), ({"c": "1"}, {"a": {"x": 3.0}, "d": {"0": 0.1, "1": 0.0}}), ({"lone": "u", "a": "z"}, {}),
]


@pytest.mark.parametrize(("evidence", "likelihood"), CASES)
def test_exact_routes_agree_with_enumeration(spark, evidence, likelihood):
    want, p = brute(LOOPED, evidence, likelihood)
    kernel = CompiledNetwork(LOOPED)
    got, mass = kernel.infer(evidence, likelihood)
    assert mass == pytest.approx(p) and kernel.calibration_gap(evidence) < 1e-12
    for v in LOOPED.variables:
        assert got[v] == pytest.approx(want[v])
    for v in ("a", "d", "lone"):
        rows = {r["outcome_idx"]: r["p"] for r in eliminate(spark, LOOPED, v, evidence, likelihood).collect()}
        assert [rows[i] for i in range(len(rows))] == pytest.approx(want[v].tolist())
    custom = eliminate(spark, LOOPED, "d", evidence, likelihood, order=["c", "a", "nothing"]).orderBy("outcome_idx").collect()
    assert [r["p"] for r in custom] == pytest.approx(want["d"].tolist())


@pytest.mark.parametrize(
    ("evidence", "light", "bowel", "out", "bark", "family"),
    [({}, 0.1325, 0.01, 0.39583, 0.283123, 0.15), ({"hear-bark": "true"}, 0.23405, 0.024066, 0.97866, 1, 0.334636), ({"dog-out": "false"}, 0.063532, 0.000447, 0, 0.01, 0.024604), ({"family-out": "true"}, 0.6, 0.01, 0.9009, 0.631621, 1)],
)
def test_dog_golden_values(evidence, light, bowel, out, bark, family):
    got, _ = CompiledNetwork(DOG).infer(evidence)
    assert [got[v][0] for v in ("light-on", "bowel-problem", "dog-out", "hear-bark", "family-out")] == pytest.approx([light, bowel, out, bark, family], abs=1e-6)


def test_asia_golden_values():
    got, p = CompiledNetwork(ASIA).infer({"asia": "yes", "xray": "yes"})
    assert p == pytest.approx(0.001450925)
    assert [got[v][0] for v in ("tub", "smoke", "lung", "bronc", "either", "dysp")] == pytest.approx([0.337716, 0.637007, 0.371487, 0.491102, 0.690628, 0.681101], abs=1e-6)


def test_impossible_and_unknown_evidence(spark):
    net = Network("n", [Variable("r", ("t", "f")), Variable("s", ("t", "f"))], [Cpt("r", (), [1.0, 0.0]), Cpt("s", ("r",), [1.0, 0.0, 0.0, 1.0])])
    got, p = CompiledNetwork(net).infer({"s": "f"})
    assert p == 0 and got["r"].tolist() == [0, 0]
    assert [r["p"] for r in eliminate(spark, net, "r", {"s": "f"}).collect()] == [0, 0]
    same, _ = CompiledNetwork(net).infer({"nobody": "x", "s": "unknown"})
    assert same["s"].tolist() == [1, 0]
    with pytest.raises(ValueError, match="unknown"):
        CompiledNetwork(net).infer({"nobody": "x"}, strict=True)
    with pytest.raises(KeyError):
        inference.query(spark, net, "nobody")


def test_soft_evidence_enters_once(spark):
    net = Network("rain", [Variable("Rain", ("T", "F")), Variable("Wet", ("T", "F"))], [Cpt("Rain", (), [0.2, 0.8]), Cpt("Wet", ("Rain",), [0.9, 0.1, 0.1, 0.9])])
    like = {"Rain": {"T": 0.8, "F": 0.2}}
    for rows in (inference.infer(spark, net, likelihood=like), eliminate(spark, net, "Wet", likelihood=like)):
        assert next(r["p"] for r in rows.collect() if r["variable"] == "Wet" and r["outcome"] == "T") == pytest.approx(0.5)
    found = loopy.loopy_belief_propagation(net, likelihood=like)
    assert found.converged and found.posteriors["Wet"][0] == pytest.approx(0.5, abs=1e-5)
    moved, _ = CompiledNetwork(net).infer(likelihood=inference.jeffrey_likelihood(net, {"Wet": {"T": 0.6, "F": 0.4}}))
    assert moved["Wet"].tolist() == pytest.approx([0.6, 0.4])


def test_loopy_is_close_on_asia():
    exact, _ = CompiledNetwork(ASIA).infer({"xray": "yes"})
    got = loopy.loopy_belief_propagation(ASIA, {"xray": "yes"})
    assert got.converged and np.mean([np.abs(got.posteriors[v] - exact[v]).mean() for v in exact]) < 0.05


def test_batches_nulls_and_udf(spark):
    rows = [(1, "yes", None), (2, None, "no"), (3, "yes", "no"), (4, "strange", None), (5, "yes", None)]
    cases = spark.createDataFrame(rows, "case_id long, xray string, smoke string")
    long = inference.infer_batch(spark, ASIA, cases, ["xray", "smoke"], ["lung"], ["case_id"]).where("outcome = 'yes'").collect()
    wide = inference.infer_batch(spark, ASIA, cases, ["xray", "smoke"], ["lung"], ["case_id"], long=False).collect()
    udf = inference.posterior_udf(spark, ASIA, ["xray", "smoke"], "lung")
    scored = {r["case_id"]: r["p"][0] for r in cases.withColumn("p", udf("xray", "smoke")).collect()}
    for k, x, s in rows:
        given = {n: o for n, o in (("xray", x), ("smoke", s)) if o in ("yes", "no")}
        want, p = CompiledNetwork(ASIA).infer(given)
        assert next(r["p"] for r in long if r["case_id"] == k) == pytest.approx(want["lung"][0])
        assert next(r for r in wide if r["case_id"] == k)["p_evidence"] == pytest.approx(p) and scored[k] == pytest.approx(want["lung"][0])
    assert inference.infer_batch(spark, ASIA, cases.limit(0), ["xray"], ["lung"], ["case_id"]).count() == 0


def test_cache_knows_values_and_async_engine(spark):
    cache = CompilationCache()
    assert cache.get(ASIA) is cache.get(ASIA)
    assert cache.get(ASIA) is not cache.get(sensitivity.perturb(ASIA, "smoke", 0, 0, 0.7))
    engine = inference.AsyncEngine(spark, DOG)
    done = engine.submit({"hear-bark": "true"}, variables=["family-out"])
    assert done.result(60)[0]["p"] == pytest.approx(0.334636, abs=1e-6)
    engine.close()


def test_factor_edges(spark):
    f = Factor.from_values(spark, {"a": 2, "b": 3}, [1, 2, 3, 4, 5, 0])
    g = Factor.from_values(spark, {"b": 3, "c": 2}, [1, 0, 2, 1, 1, 1])
    want = np.einsum("ab,bc->abc", np.array([[1, 2, 3], [4, 5, 0]]), np.array([[1, 0], [2, 1], [1, 1]]))
    assert f.multiply(g).dense() == want.ravel().tolist() and f.multiply(g).variables == ["a", "b", "c"]
    assert Factor.from_values(spark, {"b": 3}, [1, 1, 2]).multiply(f).variables == ["a", "b"]  # a scope inside the other keeps its order
    assert f.marginalize(["b", "nothing"]).dense() == [6, 9] and f.marginalize([]) is f and f.marginalize(["a", "b"]).dense() == [15]
    assert f.invert().dense() == pytest.approx([1, 0.5, 1 / 3, 0.25, 0.2, 0]) and f.normalize(3).dense() == pytest.approx([0.2, 0.4, 0.6, 0.8, 1.0, 0])
    zero = Factor.from_values(spark, {"a": 2}, [0, 0])
    assert zero.normalize().dense() == [0, 0]
    assert Factor.constant(spark, 2.0).multiply(f).dense() == [2, 4, 6, 8, 10, 0]
    assert f.evaluate({"a": 1}) == 4 and f.observe("b", 2).dense() == [0, 0, 3, 0, 0, 0] and f.weigh("zz", {0: 5}) is f
    assert f.add(f).dense() == [2, 4, 6, 8, 10, 0] and f.rms_difference(f) == 0


def test_graph_operators():
    near = graph.moral_neighbours(ASIA.variables, ASIA.edges())
    assert "tub" in near["lung"] and "bronc" in near["either"]
    full, fills = graph.triangulate(near)
    assert len(fills) == 1 and all(b in full[a] for a, b in fills)
    cliques = graph.maximal_cliques(near)
    assert len(cliques) == 6 and len(graph.junction_forest(cliques)) == 5
    assert len(graph.junction_forest(graph.maximal_cliques(graph.moral_neighbours(LOOPED.variables, LOOPED.edges())))) == 1
    assert graph.is_d_separated(ASIA, "asia", "smoke") and not graph.is_d_separated(ASIA, "asia", "smoke", ["dysp"])
    assert graph.markov_blanket(ASIA, "either") == {"lung", "tub", "xray", "dysp", "bronc"}
    cyclic = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]
    assert graph.topological_order("abcd", cyclic) is None
    kept = graph.force_acyclic(list("abcd"), cyclic)
    assert graph.topological_order("abcd", kept) and len(kept) == 3
    assert graph.minimal_cycles(cyclic) == [["a", "b", "c", "a"]] and graph.paths(cyclic, "a", "d") == [["a", "b", "c", "d"]]
    assert graph.depths(ASIA.variables, ASIA.edges())["dysp"] == 3
    assert graph.structural_hamming([("a", "b"), ("b", "c")], [("b", "a"), ("c", "d")]) == 3
    assert graph.structural_hamming([], [("b", "a")], [("a", "b")]) == 0
    assert ASIA.roots() == ["asia", "smoke"] and set(ASIA.leaves()) == {"xray", "dysp"} and ASIA.parent_label("dysp", 2) == "bronc=no, either=yes"


def test_formats_round_trip_and_errors(spark, tmp_path):
    odd = Network("a & <b>", [Variable("x & y", ("<1", "2>"), (3, 4)), Variable("q", ("t", "f"))], [Cpt("x & y", (), [0.25, 0.75]), Cpt("q", ("x & y",), [0.1, 0.9, 1.0, 0.0])])
    for net in (odd, ASIA, LOOPED):
        for back in (formats.parse_network(formats.to_xmlbif(net)), formats.parse_network(formats.to_json(net))):
            assert back.fingerprint() == net.fingerprint() and back.name == net.name
    assert formats.parse_network(formats.to_xmlbif(odd)).variables["x & y"].position == (3, 4)
    assert formats.parse_bif(BIF_TEXT).cpts["Wet"].table.tolist() == [[0.9, 0.1], [0.1, 0.9]]
    for bad in (BIF_TEXT.replace("[ 2 ]", "[ 3 ]", 1), BIF_TEXT.replace("0.2, 0.8", "0.2"), BIF_TEXT.replace("(no)", "(maybe)"), BIF_TEXT.replace("| Rain", "| Snow"), BIF_TEXT.replace("(no) 0.1, 0.9;", "")):
        with pytest.raises(ValueError, match=r"."):
            formats.parse_bif(bad)
    with pytest.raises(ValueError, match="cells"):
        formats.parse_xmlbif(formats.to_xmlbif(odd).replace("0.25 0.75", "0.25"))
    two = formats.to_xmlbif(ASIA).replace("</NETWORK>", "</NETWORK><NETWORK><NAME>n2</NAME></NETWORK>")
    assert [n.name for n in formats.parse_xmlbifs(two)] == ["asia", "n2"]
    readers.write_networks(spark, [ASIA, DOG], str(tmp_path / "nets"))
    (tmp_path / "nets" / "bad.txt").write_text("<BIF")
    found = readers.read_networks(spark, str(tmp_path / "nets")).collect()
    assert {r["name"] for r in found} == {"asia", "dog", None} and sum(r["error"] is not None for r in found) == 1
    frames = Network.from_frames(ASIA.variables_df(spark), ASIA.cpts_df(spark))
    assert frames["asia"].fingerprint() == ASIA.fingerprint()


def test_csv_reading(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a; b ;"c,x"\n1; "q ""z""" ;\n\n 2;y\n')
    rows = readers.read_training_csv(spark, str(tmp_path / "t.csv"))
    assert rows.columns == ["a", "b", "c,x"] and sorted(tuple(r) for r in rows.collect()) == [("1", 'q "z"', ""), ("2", "y", "")]
    (tmp_path / "short.csv").write_text("a,b\n")
    with pytest.raises(ValueError, match="header"):
        readers.read_training_csv(spark, str(tmp_path / "short.csv"))


def test_interventions(spark):
    net = Network(
        "confounded", [Variable("Z", ("T", "F")), Variable("X", ("T", "F")), Variable("Y", ("T", "F"))],
        [Cpt("Z", (), [0.5, 0.5]), Cpt("X", ("Z",), [0.8, 0.2, 0.2, 0.8]), Cpt("Y", ("X", "Z"), [0.9, 0.1, 0.7, 0.3, 0.5, 0.5, 0.1, 0.9])],
    )
    row = causal.average_causal_effect(spark, net, "X", "Y").first()
    assert (row["p_do_0"], row["p_do_1"], row["ace"]) == pytest.approx((0.8, 0.3, 0.5))
    assert causal.mutilate(net, {"X": "T"}).parents("X") == []
    with pytest.raises(ValueError, match="unknown"):
        causal.mutilate(net, {"X": "maybe"})
    both = causal.interventional_query(spark, net, "Y", {"X": "T"}, {"X": "F", "Z": "T"}).where("outcome = 'T'").first()
    assert both["p"] == pytest.approx(0.9)


def test_sensitivity_and_information(spark):
    net = Network("rain", [Variable("Rain", ("T", "F")), Variable("Wet", ("T", "F"))], [Cpt("Rain", (), [0.2, 0.8]), Cpt("Wet", ("Rain",), [0.9, 0.1, 0.1, 0.9])])
    plain = {(r["variable"], r["row_idx"], r["outcome_idx"]): r["derivative"] for r in sensitivity.finite_differences(spark, net, ("Wet", "T")).collect()}
    assert plain["Rain", 0, 0] == pytest.approx(0.8) and plain["Wet", 0, 0] == pytest.approx(0.2)
    # with evidence the analytic curve must follow the posterior
    curves = sensitivity.analytic_sensitivity(spark, net, ("Rain", "T"), {"Wet": "T"})
    for r in curves.withColumn("value", sensitivity.curve_value(0.3)).collect():
        moved = sensitivity.perturb(net, r["variable"], r["row_idx"], r["outcome_idx"], 0.3)
        assert CompiledNetwork(moved).infer({"Wet": "T"})[0]["Rain"][0] == pytest.approx(r["value"])
    fine = {r["param_id"]: r["derivative"] for r in sensitivity.finite_differences(spark, net, ("Rain", "T"), {"Wet": "T"}, epsilon=1e-6).collect()}
    assert all(fine[r["param_id"]] == pytest.approx(r["derivative"], abs=1e-4) for r in curves.collect())
    with pytest.raises(ValueError, match="two"):
        sensitivity.tornado(spark, net, ("Rain", "T"), steps=1)
    assert sensitivity.value_of_information(spark, ASIA, "nobody").count() == 0
    voi = sensitivity.value_of_information(spark, ASIA, "lung", {"xray": "yes"}).collect()
    assert [r["voi"] for r in voi] == sorted((r["voi"] for r in voi), reverse=True) and {"lung", "xray"}.isdisjoint(r["candidate"] for r in voi)
    assert all(r["voi"] == pytest.approx(max(0, r["base_entropy"] - r["expected_entropy"])) for r in voi)
    assert sensitivity.multi_query_voi(spark, ASIA, []).count() == 0


def test_session(spark):
    s = Session(spark)
    with pytest.raises(ValueError, match="no network"):
        s.query()
    s.load(BIF_TEXT)
    with pytest.raises(ValueError, match="unknown outcome"):
        s.set_evidence("Wet", "maybe")
    s.set_evidence("Wet", "yes")
    assert s.info()["evidence"] == {"Wet": "yes"}
    assert s.query(["Rain"]).where("outcome = 'yes'").first()["p"] == pytest.approx(0.18 / 0.26)
    assert {r["text"] for r in s.text(["Wet"]).collect()} == {"yes: 100.00%, no: 0.00%"}
    s.clear_evidence("Wet")
    assert s.evidence == {}
    with pytest.raises(Exception, match=r"PATH_NOT_FOUND|exist"):
        s.load("/nowhere/at/all.bif")


@pytest.mark.parametrize("evidence", [{}, {"xray": "yes"}, {"xray": "yes", "dysp": "no", "asia": "yes"}, {"either": "no", "lung": "yes"}])
def test_lines_of_cells_equal_inference_on_changed_tables(spark, evidence):
    # ASIA has zero and one cells; the two added variables are a component of their own
    more = [Variable("left", ("a", "b", "c")), Variable("right", ("x", "y"))]
    tables = [Cpt("left", (), np.array([0.2, 0.0, 0.8])), Cpt("right", ("left",), np.array([[0.5, 0.5], [1.0, 0.0], [0.3, 0.7]]))]
    net = Network("both", [*ASIA.variables.values(), *more], [*ASIA.cpts.values(), *tables])
    for query, given in ((("lung", "yes"), evidence), (("right", "x"), evidence | {"left": "c"})):
        curve = {(r["variable"], r["row_idx"], r["outcome_idx"]): r["curve"] for r in sensitivity.tornado(spark, net, query, given, steps=3).collect()}
        assert len(curve) == sum(c.table.size for c in net.cpts.values())
        for (variable, row, outcome), found in curve.items():
            for at, p in zip((0.0, 0.5, 1.0), found, strict=True):
                want, _ = CompiledNetwork(sensitivity.perturb(net, variable, row, outcome, at)).infer(given)
                assert p == pytest.approx(want[query[0]][net.variable(query[0]).code(query[1])], abs=1e-12)


def test_cells_of_a_network_of_sixty_variables(spark):
    import time

    from factorloom.catalog import LADDER, chain_network

    net = chain_network(LADDER)
    began = time.time()
    rows = sensitivity.analytic_sensitivity(spark, net, (f"v{LADDER - 1}", net.variable(f"v{LADDER - 1}").outcomes[0]), {"v0": net.variable("v0").outcomes[0]}).collect()
    assert len(rows) == sum(c.table.size for c in net.cpts.values()) and time.time() - began < 30
    # v0 is observed: at zero the evidence is impossible and three points fix no curve
    for some in sorted((r for r in rows if r["variable"] != "v0"), key=lambda r: -abs(r["derivative"]))[:5]:
        step = 1e-6 if some["theta"] < 0.5 else -1e-6
        moved = sensitivity.perturb(net, some["variable"], some["row_idx"], some["outcome_idx"], some["theta"] + step)
        before, after = (CompiledNetwork(n).infer({"v0": net.variable("v0").outcomes[0]})[0][f"v{LADDER - 1}"][0] for n in (net, moved))
        assert (after - before) / step == pytest.approx(some["derivative"], abs=1e-4)


def test_loopy_rows_equal_single_cases(spark):
    states = [None, "yes", "no", "unheard of"]
    rows = [(k, states[k % 4], states[k // 4 % 4], "keep") for k in range(32)]
    cases = spark.createDataFrame(rows, "case_id long, xray string, smoke string, variable2 string")
    got = loopy.loopy_batch(spark, ASIA, cases, ["xray", "smoke"], ["lung", "dysp"], ["case_id", "variable2"]).collect()
    assert len(got) == 32 * 4
    for r in got:
        given = {v: x for v, x in zip(("xray", "smoke"), rows[r["case_id"]][1:3], strict=True) if x in ("yes", "no")}
        one = loopy.loopy_belief_propagation(ASIA, given)
        assert r["p"] == pytest.approx(one.posteriors[r["variable"]][r["outcome_idx"]], abs=1e-12)
        assert (r["converged"], r["iterations"]) == (one.converged, one.iterations)
    assert loopy.loopy_batch(spark, ASIA, cases.limit(0), ["xray"], ["lung"], ["case_id"]).count() == 0


def test_loopy_cases_in_chunks(monkeypatch):
    graph_ = loopy.LoopyNetwork(ASIA)
    weights = {"xray": np.array([[1.0, 0.0], [0.0, 1.0], [0.3, 0.7], [0.0, 0.0]])}
    whole = graph_.run(weights, 4)
    monkeypatch.setattr(loopy, "CHUNK_CELLS", 1)
    parts = graph_.run(weights, 4)
    assert all(np.allclose(whole[0][v], parts[0][v], atol=1e-15) for v in whole[0]) and (whole[2] == parts[2]).all()


@pytest.mark.parametrize("evidence", [{}, {"xray": "yes"}, {"either": "no", "lung": "yes"}, {"asia": "?", "nobody": "yes"}])
def test_the_joint_table_equals_the_forest(monkeypatch, evidence):
    from factorloom.plans import junction

    soft = {"dysp": {"yes": 0.3, "no": 0.9}, "smoke": {"yes": 2.0}}
    small = CompiledNetwork(ASIA).infer(evidence, soft)
    monkeypatch.setattr(junction, "JOINT_CELLS", 0)
    large = CompiledNetwork(ASIA).infer(evidence, soft)
    assert small[1] == pytest.approx(large[1]) and all(np.allclose(small[0][v], large[0][v]) for v in ASIA.variables)


def test_incremental_cases_equal_rebuilt_ones_and_are_faster():
    import pickle
    import random
    import time

    from factorloom.catalog import chain_network
    from factorloom.plans.junction import IncrementalEngine

    net = chain_network(40)
    kernel, draw = CompiledNetwork(net), random.Random(1)
    engine, given, spent = IncrementalEngine(kernel), {}, [0.0, 0.0]
    for _ in range(30):
        v = f"v{draw.randrange(40)}"
        if v in given:
            del given[v]
        else:
            given[v] = draw.choice(("yes", "no"))
        soft = {"v7": {"yes": 0.2}} if draw.random() < 0.3 else None
        began = time.perf_counter()
        got = engine.infer(given, soft, ["v0", "v39"])
        spent[0] += time.perf_counter() - began
        began = time.perf_counter()
        want = CompiledNetwork(net).infer(given, soft, ["v0", "v39"])
        spent[1] += time.perf_counter() - began
        assert got[1] == pytest.approx(want[1]) and all(np.allclose(got[0][v], want[0][v]) for v in ("v0", "v39"))
    assert spent[1] > 2 * spent[0]
    before = engine.computed
    engine.infer(given | {"v20": "yes"}, None, ["v39"])
    engine.infer(given | {"v20": "no"}, None, ["v39"])
    assert engine.computed - before < 2 * len(kernel.cliques)
    kernel.engine.infer(given)
    assert "engine" not in pickle.loads(pickle.dumps(kernel)).__dict__
    impossible = CompiledNetwork(ASIA)
    assert IncrementalEngine(impossible).infer({"either": "no", "lung": "yes"})[1] == 0


def test_session_lists_and_loads_examples(spark, tmp_path):
    (tmp_path / "demo.bif").write_text(BIF_TEXT)
    (tmp_path / "asia.xml").write_text(formats.to_xmlbif(ASIA))
    (tmp_path / "broken.bif").write_text("network {")
    s = Session(spark)
    listed = {r["file"].rpartition("/")[2]: (r["name"], r["error"]) for r in s.list_examples(str(tmp_path)).collect()}
    assert listed["demo.bif"] == ("demo", None) and listed["asia.xml"][0].lower() == "asia" and listed["broken.bif"][1]
    s.load(str(tmp_path / "asia.xml"))
    s.set_evidence("xray", "yes")
    want, _ = CompiledNetwork(ASIA).infer({"xray": "yes"})
    got = {(r["variable"], r["outcome"]): r["p"] for r in s.query().collect()}
    assert all(got[v, o] == pytest.approx(want[v][k]) for v, x in ASIA.variables.items() for k, o in enumerate(x.outcomes))
