"""Registered queries of the core engine and their SQL twins.

Most queries work on a view of ``lineitem`` with dependence by construction:
``q`` and ``disc`` (thirds of quantity and discount) determine ``qd`` (thirds of
their product), while ``rf`` (the return flag) stands alone.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.fixtures import ASIA, DOG
from factorloom.functions.special import chi2_survival, entropy_bits
from factorloom.model import Cpt, Network, Variable
from factorloom.operators import causal, gaussian, graph, inference, learning, loopy, sensitivity, statistics
from factorloom.operators.factor import Factor
from factorloom.plans.elimination import eliminate
from factorloom.plans.junction import CompiledNetwork
from factorloom.plans.lineage import shared_folder
from factorloom.plans.sparse import SparseForest, case_posteriors, learned_tables
from factorloom.session import Session
from factorloom.sources import formats, readers
from factorloom.streaming.evidence import replayed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def registered(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CUTS = {"q": ("l_quantity", (17.0, 34.0)), "disc": ("l_discount", (0.035, 0.065)), "qd": ("l_quantity * l_discount", (0.7, 1.6))}


def base_view(spark: SparkSession, sf_dir: str, keys: tuple[str, ...] = ()) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    bins = [statistics.binned(F.expr(e), list(cuts), ["lo", "mid", "hi"]).alias(c) for c, (e, cuts) in CUTS.items()]
    return lines.select(*keys, *bins, F.col("l_returnflag").alias("rf"))


BASE = (
    "b AS (SELECT "
    + ", ".join(f"CASE WHEN {e} < CAST({a} AS DOUBLE) THEN 'lo' WHEN {e} < CAST({b} AS DOUBLE) THEN 'mid' ELSE 'hi' END AS {c}" for c, (e, (a, b)) in CUTS.items())
    + ", l_returnflag AS rf, l_orderkey, l_linenumber FROM lineitem)"
)


def root_sql(c: str) -> str:
    return f"c_{c} AS (SELECT {c}, (count(*) + 1) / (sum(count(*) + 1) OVER ()) AS p FROM b GROUP BY {c})"


QD_SQL = """g AS (SELECT * FROM (SELECT DISTINCT q FROM b), (SELECT DISTINCT disc FROM b), (SELECT DISTINCT qd FROM b)),
n AS (SELECT q, disc, qd, count(*) AS n FROM b GROUP BY ALL),
c_qd AS (SELECT q, disc, qd, (coalesce(n, 0) + 1) / (sum(coalesce(n, 0) + 1) OVER (PARTITION BY q, disc)) AS p FROM g LEFT JOIN n USING (q, disc, qd))"""
JOINT = f"WITH {BASE}, {root_sql('q')}, {root_sql('disc')}, {root_sql('rf')}, {QD_SQL}, j AS (SELECT q, disc, qd, c_q.p * c_disc.p * c_qd.p AS p FROM c_qd JOIN c_q USING (q) JOIN c_disc USING (disc))"
MODEL_EDGES = [("q", "qd"), ("disc", "qd")]
#: A confounded structure over the same columns: q -> disc -> qd <- q.
CONFOUNDED_EDGES = [("q", "disc"), ("disc", "qd"), ("q", "qd")]
COLUMNS = ["q", "disc", "qd", "rf"]


def statistics_of(spark: SparkSession, sf_dir: str) -> statistics.SufficientStatistics:
    return statistics.SufficientStatistics(base_view(spark, sf_dir), COLUMNS)


def model(spark: SparkSession, sf_dir: str, edges=None) -> Network:
    return statistics_of(spark, sf_dir).laplace_network(MODEL_EDGES if edges is None else edges)


def posterior(df: DataFrame) -> DataFrame:
    return df.select("variable", "outcome", F.round("p", 6).alias("p"))


# parameters and posteriors


@registered(f"WITH {BASE}, {QD_SQL} SELECT q, disc, qd, round(p, 6) AS p FROM c_qd")
def cpt_laplace(spark, sf_dir):
    return statistics.laplace_cpt(base_view(spark, sf_dir), "qd", ["q", "disc"]).withColumn("p", F.round("p", 6))


@registered(f"{JOINT} SELECT 'q' AS variable, q AS outcome, round(sum(p) / sum(sum(p)) OVER (), 6) AS p FROM j WHERE qd = 'hi' GROUP BY q")
def ve_posterior_hard(spark, sf_dir):
    return posterior(eliminate(spark, model(spark, sf_dir), "q", {"qd": "hi"}))


SOFT = {"hi": 0.7, "mid": 0.2, "lo": 0.1}
SOFT_SQL = "w(qd, w) AS (VALUES ('hi', 7e-1), ('mid', 2e-1), ('lo', 1e-1))"


@registered(f"{JOINT}, {SOFT_SQL} SELECT 'disc' AS variable, disc AS outcome, round(sum(p * w) / sum(sum(p * w)) OVER (), 6) AS p FROM j JOIN w USING (qd) GROUP BY disc")
def ve_posterior_soft(spark, sf_dir):
    return posterior(eliminate(spark, model(spark, sf_dir), "disc", likelihood={"qd": SOFT}))


@registered(
    f"{JOINT}, t(qd, t) AS (VALUES ('hi', 5e-1), ('mid', 3e-1), ('lo', 2e-1)), m AS (SELECT qd, sum(p) AS m FROM j GROUP BY qd)"
    " SELECT 'q' AS variable, q AS outcome, round(sum(p * t / m) / sum(sum(p * t / m)) OVER (), 6) AS p FROM j JOIN t USING (qd) JOIN m USING (qd) GROUP BY q"
)
def jeffrey_update(spark, sf_dir):
    net = model(spark, sf_dir)
    return posterior(inference.infer(spark, net, likelihood=inference.jeffrey_likelihood(net, {"qd": {"hi": 0.5, "mid": 0.3, "lo": 0.2}}), variables=["q"]))


@registered(
    f"{JOINT}, e AS (SELECT * FROM j WHERE disc = 'lo'), u AS (SELECT 'q' AS variable, q AS outcome, p FROM e UNION ALL SELECT 'disc', disc, p FROM e UNION ALL SELECT 'qd', qd, p FROM e"
    " UNION ALL SELECT 'disc', disc, 0 FROM c_disc UNION ALL SELECT 'rf', rf, p FROM c_rf)"
    " SELECT variable, outcome, round(sum(p) / sum(sum(p)) OVER (PARTITION BY variable), 6) AS p FROM u GROUP BY variable, outcome"
)
def jt_all_posteriors(spark, sf_dir):
    return posterior(inference.infer(spark, model(spark, sf_dir), {"disc": "lo"}))


def values_sql(net: Network) -> str:
    """CPTs of a literal network as SQL values, and the joint of all its variables."""
    ctes, joins = [], []
    for k, c in enumerate(net.cpts.values()):
        cols = [f'"{v}"' for v in c.scope]
        rows = []
        for at, p in _cells(c):
            rows.append("(" + ", ".join(f"'{net.variables[v].outcomes[i]}'" for v, i in zip(c.scope, at, strict=True)) + f", CAST({float(p)!r} AS DOUBLE))")
        ctes.append(f"t{k}({', '.join(cols)}, p{k}) AS (VALUES {', '.join(rows)})")
        joins.append(f"t{k}")
    order = graph.topological_order(net.variables, net.edges())
    names = list(net.cpts)
    sql = f"t{names.index(order[0])}"
    for v in order[1:]:
        ps = net.parents(v)
        using = "USING (" + ", ".join(f'"{p}"' for p in ps) + ")" if ps else "ON true"
        sql += f" JOIN t{names.index(v)} {using}"
    product = " * ".join(f"p{k}" for k in range(len(names)))
    cols = ", ".join(f'"{v}"' for v in net.variables)
    return f"WITH {', '.join(ctes)}, j AS (SELECT {cols}, {product} AS p FROM {sql})"


def _cells(c):
    import numpy as np

    return np.ndenumerate(c.table)


def posteriors_sql(net: Network, where: str) -> str:
    union = " UNION ALL ".join(f"SELECT '{v}' AS variable, \"{v}\" AS outcome, sum(CASE WHEN {where} THEN p ELSE 0 END) AS p FROM j GROUP BY \"{v}\"" for v in net.variables)
    return f"{values_sql(net)}, u AS ({union}) SELECT variable, outcome, round(p / sum(p) OVER (PARTITION BY variable), 6) AS p FROM u"


@registered(posteriors_sql(ASIA, "xray = 'yes' AND asia = 'yes'"))
def fixture_asia_posteriors(spark, sf_dir):
    return posterior(inference.infer(spark, ASIA, {"xray": "yes", "asia": "yes"}))


@registered(posteriors_sql(DOG, "\"hear-bark\" = 'true'"))
def fixture_dog_posteriors(spark, sf_dir):
    return posterior(inference.infer(spark, DOG, {"hear-bark": "true"}))


@registered(posteriors_sql(ASIA, "true"))
def fixture_asia_priors(spark, sf_dir):
    return posterior(inference.priors(spark, ASIA))


@registered(f"{values_sql(DOG)} SELECT 'family-out' AS variable, \"family-out\" AS outcome, round(sum(p) / sum(sum(p)) OVER (), 6) AS p FROM j WHERE \"hear-bark\" = 'true' AND \"light-on\" = 'false' GROUP BY \"family-out\"")
def fixture_dog_elimination(spark, sf_dir):
    return posterior(eliminate(spark, DOG, "family-out", {"hear-bark": "true", "light-on": "false"}))


@registered(
    f"{JOINT}, r AS (SELECT disc, qd, q AS outcome, p / sum(p) OVER (PARTITION BY disc, qd) AS p FROM j)"
    " SELECT l_orderkey, l_linenumber, 'q' AS variable, outcome, round(p, 6) AS p FROM b JOIN r USING (disc, qd)"
)
def batch_posteriors(spark, sf_dir):
    """P(q | the row's own disc and qd) for every line item."""
    cases = base_view(spark, sf_dir, ("l_orderkey", "l_linenumber"))
    keys = ["l_orderkey", "l_linenumber"]
    return inference.infer_batch(spark, model(spark, sf_dir), cases, ["disc", "qd"], ["q"], keys).select(*keys, "variable", "outcome", F.round("p", 6).alias("p"))


@registered(
    f"{JOINT}, t AS (SELECT sum(p) AS t FROM j), e AS (SELECT disc, qd, sum(p) AS p FROM j GROUP BY disc, qd)"
    " SELECT disc, qd, count(*) AS n, round(min(p / t), 6) AS p_evidence FROM b JOIN e USING (disc, qd), t GROUP BY disc, qd"
)
def batch_evidence_probability(spark, sf_dir):
    wide = inference.infer_batch(spark, model(spark, sf_dir), base_view(spark, sf_dir), ["disc", "qd"], ["q"], ["disc", "qd"], long=False)
    return wide.groupBy("disc", "qd").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("p_evidence"), 6).alias("p_evidence"))


@registered(
    f"{JOINT} SELECT l_returnflag, n, round(p, 6) AS p_hi FROM (SELECT rf AS l_returnflag, count(*) AS n, avg(r.p) AS p FROM b JOIN"
    " (SELECT disc, qd, sum(CASE WHEN q = 'hi' THEN p ELSE 0 END) / sum(p) AS p FROM j GROUP BY disc, qd) r USING (disc, qd) GROUP BY rf)"
)
def posterior_udf(spark, sf_dir):
    udf = inference.posterior_udf(spark, model(spark, sf_dir), ["disc", "qd"], "q")
    scored = base_view(spark, sf_dir).withColumn("p", F.get(udf("disc", "qd"), 0))
    return scored.groupBy(F.col("rf").alias("l_returnflag")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("p_hi"))


@registered(
    f"WITH {BASE}, {root_sql('q')}, {root_sql('rf')}, n AS (SELECT q, qd, count(*) AS n FROM b GROUP BY ALL), g AS (SELECT * FROM (SELECT DISTINCT q FROM b), (SELECT DISTINCT qd FROM b)),"
    " c AS (SELECT q, qd, (coalesce(n, 0) + 1) / (sum(coalesce(n, 0) + 1) OVER (PARTITION BY q)) AS p FROM g LEFT JOIN n USING (q, qd))"
    " SELECT 'q' AS variable, q AS outcome, round(c.p * c_q.p / sum(c.p * c_q.p) OVER (), 4) AS p FROM c JOIN c_q USING (q) WHERE qd = 'hi'"
    " UNION ALL SELECT 'rf', rf, round(p, 4) FROM c_rf"
)
def lbp_tree_posteriors(spark, sf_dir):
    net = statistics.SufficientStatistics(base_view(spark, sf_dir), ["q", "qd", "rf"]).laplace_network([("q", "qd")])
    found = loopy.loopy_belief_propagation(net, {"qd": "hi"}, tolerance=1e-9).frame(spark, net)
    return found.where("variable in ('q', 'rf')").select("variable", "outcome", F.round("p", 4).alias("p"))


@registered(
    f"{JOINT}, {SOFT_SQL}, x AS (SELECT disc, q, sum(p * w) AS p FROM j JOIN w USING (qd) GROUP BY ALL), y AS (SELECT disc, q, p / sum(p) OVER (PARTITION BY disc) AS p FROM x)"
    " SELECT disc, count(*) AS n, round(max(p), 6) AS p_hi FROM b JOIN (SELECT disc, p FROM y WHERE q = 'hi') USING (disc) GROUP BY disc"
)
def batch_soft_posteriors(spark, sf_dir):
    """P(q = hi | the row's disc, the same weights on qd) of every line item."""
    weights = F.array(*[F.lit(SOFT[o]) for o in sorted(SOFT)])
    cases = base_view(spark, sf_dir).select("disc", weights.alias("w"))
    found = inference.infer_batch(spark, model(spark, sf_dir), cases, ["disc"], ["q"], ["disc"], soft={"qd": "w"}).where("outcome = 'hi'")
    return found.groupBy("disc").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("p"), 6).alias("p_hi"))


@registered("SELECT * FROM (VALUES ('yes', 'yes', 9e-1, 1e-1), ('yes', 'no', 8e-1, 2e-1), ('no', 'yes', 7e-1, 3e-1), ('no', 'no', 1e-1, 9e-1)) t(bronc, either, yes, no)")
def table_grid(spark, sf_dir):
    return inference.table_grid(spark, ASIA, "dysp")


@registered(
    f"{values_sql(ASIA)}, k(case_id, x, s) AS (VALUES (1, 'yes', NULL), (2, NULL, 'no'), (3, 'yes', 'no'))"
    " SELECT CAST(case_id AS BIGINT) AS case_id, round(sum(CASE WHEN lung = 'yes' THEN p ELSE 0 END) / sum(p), 6) AS p FROM k, j WHERE (x IS NULL OR xray = x) AND (s IS NULL OR smoke = s) GROUP BY case_id"
)
def evidence_rows(spark, sf_dir):
    """Evidence in long form, a row an observation."""
    rows = spark.createDataFrame([(1, "xray", "yes"), (2, "smoke", "no"), (3, "xray", "yes"), (3, "smoke", "no")], "case_id long, variable string, outcome string")
    cases = inference.wide_evidence(rows, ["xray", "smoke"])
    return inference.infer_batch(spark, ASIA, cases, ["xray", "smoke"], ["lung"], ["case_id"]).where("outcome = 'yes'").select("case_id", F.round("p", 6).alias("p"))


# factors

PAIR = "f AS (SELECT o_orderstatus AS s, o_orderpriority AS p, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY ALL), h AS (SELECT p, sum(value) AS value FROM f GROUP BY p)"


def order_factors(spark, sf_dir) -> tuple[Factor, Factor]:
    pair = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    f = Factor(pair, {"s": 3, "p": 5})
    return f, f.marginalize(["s"])


@registered(f"WITH {PAIR} SELECT s, p, f.value * h.value AS value FROM f JOIN h USING (p)")
def factor_product(spark, sf_dir):
    f, h = order_factors(spark, sf_dir)
    return f.multiply(h).df


@registered(f"WITH {PAIR}, k AS (SELECT p_brand AS brand, CAST(count(*) AS DOUBLE) AS value FROM part GROUP BY ALL) SELECT p, brand, h.value * k.value AS value FROM h, k")
def factor_cross_product(spark, sf_dir):
    _, h = order_factors(spark, sf_dir)
    brands = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return h.multiply(Factor(brands, {"brand": 25})).df


@registered(f"WITH {PAIR} SELECT p, value FROM h")
def factor_marginalize(spark, sf_dir):
    return order_factors(spark, sf_dir)[1].df


@registered(f"WITH {PAIR} SELECT sum(value) AS value FROM f")
def factor_scalar(spark, sf_dir):
    return order_factors(spark, sf_dir)[0].marginalize(["s", "p"]).df


@registered(f"WITH {PAIR} SELECT s, p, round(value / sum(value) OVER (), 6) AS value FROM f")
def factor_normalize(spark, sf_dir):
    return order_factors(spark, sf_dir)[0].normalize().df.select("s", "p", F.round("value", 6).alias("value"))


@registered(f"WITH {PAIR} SELECT s, p, CASE WHEN value = 0 THEN 0 ELSE round(1 / value, 8) END AS value FROM f")
def factor_invert(spark, sf_dir):
    return order_factors(spark, sf_dir)[0].invert().df.select("s", "p", F.round("value", 8).alias("value"))


@registered(f"WITH {PAIR} SELECT s, p, value + CASE WHEN s = 'F' THEN 0 ELSE value END AS value FROM f")
def factor_sum(spark, sf_dir):
    f, _ = order_factors(spark, sf_dir)
    return f.add(Factor(f.df.where("s <> 'F'"), f.cards)).df


@registered(f"WITH {PAIR} SELECT round(sqrt(avg(CASE WHEN s = 'F' THEN value * value ELSE 0 END)), 6) AS rms FROM f")
def factor_rms_diff(spark, sf_dir):
    f, _ = order_factors(spark, sf_dir)
    return spark.createDataFrame([(round(f.rms_difference(Factor(f.df.where("s <> 'F'"), f.cards)), 6),)], "rms double")


@registered(f"WITH {PAIR} SELECT s, p, value FROM f WHERE s = 'O'")
def factor_evidence(spark, sf_dir):
    f, _ = order_factors(spark, sf_dir)
    return Factor(f.df.where("s = 'O'"), f.cards).df


@registered(f"WITH {PAIR} SELECT s, p, value * CASE s WHEN 'F' THEN 25e-2 WHEN 'O' THEN 2e0 ELSE 1e0 END AS value FROM f")
def factor_likelihood(spark, sf_dir):
    return order_factors(spark, sf_dir)[0].weigh("s", {"F": 0.25, "O": 2.0}).df


# causal

CONFOUNDED = (
    f"WITH {BASE}, {root_sql('q')}, {QD_SQL}, nd AS (SELECT q, disc, count(*) AS n FROM b GROUP BY ALL), gd AS (SELECT * FROM (SELECT DISTINCT q FROM b), (SELECT DISTINCT disc FROM b)),"
    " c_d AS (SELECT q, disc, (coalesce(n, 0) + 1) / (sum(coalesce(n, 0) + 1) OVER (PARTITION BY q)) AS p FROM gd LEFT JOIN nd USING (q, disc))"
)


@registered(f"{CONFOUNDED} SELECT 'qd' AS variable, qd AS outcome, round(sum(c_q.p * c_qd.p), 6) AS p FROM c_qd JOIN c_q USING (q) WHERE disc = 'lo' GROUP BY qd")
def do_query(spark, sf_dir):
    return posterior(causal.interventional_query(spark, model(spark, sf_dir, CONFOUNDED_EDGES), "qd", {"disc": "lo"}))


@registered(f"{CONFOUNDED} SELECT 'qd' AS variable, qd AS outcome, round(p, 6) AS p FROM c_qd WHERE disc = 'lo' AND q = 'hi'")
def do_with_observation(spark, sf_dir):
    return posterior(causal.interventional_query(spark, model(spark, sf_dir, CONFOUNDED_EDGES), "qd", {"disc": "lo"}, {"q": "hi", "disc": "hi"}))


@registered(
    f"{CONFOUNDED}, a AS (SELECT disc, sum(c_q.p * c_qd.p) AS p FROM c_qd JOIN c_q USING (q) WHERE qd = 'hi' GROUP BY disc)"
    " SELECT round((SELECT p FROM a WHERE disc = 'hi'), 6) AS p_do_0, round((SELECT p FROM a WHERE disc = 'lo'), 6) AS p_do_1, round((SELECT p FROM a WHERE disc = 'hi') - (SELECT p FROM a WHERE disc = 'lo'), 6) AS ace"
)
def average_causal_effect(spark, sf_dir):
    out = causal.average_causal_effect(spark, model(spark, sf_dir, CONFOUNDED_EDGES), "disc", "qd")
    return out.select(*[F.round(c, 6).alias(c) for c in ("p_do_0", "p_do_1", "ace")])


# independence


def test_sql(x: str, y: str, given: str | None, kind: str) -> str:
    keys = f"{given}, " if given else ""
    over = f"PARTITION BY {given}" if given else ""
    also = f"{given}, " if given else ""
    using = f"USING ({given})" if given else "ON true"
    part = "(o - e) * (o - e) / e" if kind == "chi2" else "CASE WHEN o > 0 THEN 2 * o * ln(o / e) ELSE 0 END"
    return f"""WITH {BASE}, n AS (SELECT {keys}{x}, {y}, count(*) AS n FROM b GROUP BY ALL),
g AS (SELECT {keys}{x}, {y} FROM (SELECT DISTINCT {keys}{x} FROM b) JOIN (SELECT DISTINCT {keys}{y} FROM b) {using}),
o AS (SELECT {keys}{x}, {y}, CAST(coalesce(n, 0) AS DOUBLE) AS o FROM g LEFT JOIN n USING ({keys}{x}, {y})),
e AS (SELECT *, sum(o) OVER (PARTITION BY {also}{x}) * sum(o) OVER (PARTITION BY {also}{y}) / sum(o) OVER ({over}) AS e FROM o),
s AS (SELECT sum({part}) AS s, count(DISTINCT {x}) AS r, count(DISTINCT {y}) AS c FROM e {'GROUP BY ' + given if given else ''}),
t AS (SELECT sum(s) AS statistic, CAST(sum((r - 1) * (c - 1)) AS BIGINT) AS df FROM s)
SELECT round(statistic, 4) AS statistic, df, round({PVALUE}, 6) AS p_value FROM t"""


PVALUE = """CASE WHEN df <= 0 OR statistic <= 0 THEN 1 WHEN statistic / 2 > df / 2e0 + 200 THEN 0 ELSE greatest(0, least(1, 1 - exp(-statistic / 2 + df / 2e0 * ln(statistic / 2) - lgamma(df / 2e0))
 * list_sum(list_transform(range(0, 300), lambda n: exp(n * ln(statistic / 2) + lgamma(df / 2e0) - lgamma(df / 2e0 + n + 1)))))) END"""


def _test(df: DataFrame) -> DataFrame:
    return df.select(F.round("statistic", 4).alias("statistic"), "df", F.round("p_value", 6).alias("p_value"))


@registered(test_sql("rf", "qd", None, "chi2"))
def chi2_test(spark, sf_dir):
    return _test(statistics.independence_test(base_view(spark, sf_dir), "rf", "qd", kind="chi2"))


@registered(test_sql("q", "qd", None, "g2"))
def g2_test(spark, sf_dir):
    return _test(statistics.independence_test(base_view(spark, sf_dir), "q", "qd"))


@registered(test_sql("q", "disc", "qd", "g2"))
def g2_conditional(spark, sf_dir):
    return _test(statistics.independence_test(base_view(spark, sf_dir), "q", "disc", ["qd"]))


@registered(test_sql("rf", "disc", "q", "chi2"))
def chi2_conditional(spark, sf_dir):
    return _test(statistics.independence_test(base_view(spark, sf_dir), "rf", "disc", ["q"], kind="chi2"))


@registered(
    f"WITH {BASE}, n AS (SELECT q, qd, CAST(count(*) AS DOUBLE) AS n FROM b GROUP BY ALL), w AS (SELECT n, n * ln(n * sum(n) OVER () / (sum(n) OVER (PARTITION BY q) * sum(n) OVER (PARTITION BY qd))) AS t FROM n)"
    " SELECT round(sum(t) / sum(n), 6) AS mi FROM w"
)
def mutual_information(spark, sf_dir):
    return statistics.mutual_information(base_view(spark, sf_dir), "q", "qd").select(F.round("mi", 6).alias("mi"))


@registered(
    f"WITH {BASE}, n AS (SELECT q, disc, qd, CAST(count(*) AS DOUBLE) AS n FROM b GROUP BY ALL), w AS (SELECT n, n * ln(n * sum(n) OVER (PARTITION BY qd) / (sum(n) OVER (PARTITION BY qd, q) * sum(n) OVER (PARTITION BY qd, disc))) AS t FROM n)"
    " SELECT round(sum(t) / sum(n), 6) AS mi FROM w"
)
def cond_mutual_information(spark, sf_dir):
    return statistics.mutual_information(base_view(spark, sf_dir), "q", "disc", ["qd"]).select(F.round("mi", 6).alias("mi"))


@registered(f"WITH t(statistic, df) AS (VALUES (CAST(3.841459 AS DOUBLE), 1), (20e0, 4), (120e0, 100), (0e0, 3), (5e0, 0)) SELECT statistic, CAST(df AS BIGINT) AS df, round({PVALUE}, 6) AS p_value FROM t")
def chi2_pvalue(spark, sf_dir):
    rows = spark.createDataFrame([(3.841459, 1), (20.0, 4), (120.0, 100), (0.0, 3), (5.0, 0)], "statistic double, df long")
    return rows.withColumn("p_value", F.round(chi2_survival(F.col("statistic"), F.col("df")), 6))


@registered(f"WITH {BASE} SELECT round(-sum(p * ln(p)), 6) AS entropy FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM b GROUP BY qd)")
def marginal_entropy(spark, sf_dir):
    return statistics.marginal_entropy(base_view(spark, sf_dir), "qd").select(F.round("entropy", 6).alias("entropy"))


# scores and structure

FAMILIES = [("qd", ["q", "disc"]), ("qd", ["q"]), ("qd", []), ("q", ["qd"]), ("rf", ["q"])]


def family_sql(child: str, parents: list[str]) -> str:
    scope = [*parents, child]
    grid = " CROSS JOIN ".join(f"(SELECT DISTINCT {c} FROM b)" for c in scope)
    over = f"PARTITION BY {', '.join(parents)}" if parents else ""
    return (
        f"SELECT '{child}' AS child, '{','.join(parents)}' AS parents, round(sum(c * ln(c / t)) - 5e-1 * (count(DISTINCT {child}) - 1) * (count(*) / count(DISTINCT {child})) * ln(sum(n)), 4) AS score FROM"
        f" (SELECT *, sum(c) OVER ({over}) AS t FROM (SELECT {', '.join(scope)}, coalesce(n, 0) AS n, coalesce(n, 0) + 1e0 AS c FROM (SELECT * FROM {grid}) LEFT JOIN (SELECT {', '.join(scope)}, count(*) AS n FROM b GROUP BY ALL) USING ({', '.join(scope)})))"
    )


@registered(f"WITH {BASE} " + " UNION ALL ".join(family_sql(c, ps) for c, ps in FAMILIES))
def local_bic_families(spark, sf_dir):
    base = base_view(spark, sf_dir)
    parts = [statistics.family_bic(base, c, ps) for c, ps in FAMILIES]
    return functools.reduce(DataFrame.unionByName, parts).withColumn("score", F.round("score", 4))


@registered(
    f"{JOINT}, l AS (SELECT sum(ln(c_q.p)) + sum(ln(c_disc.p)) + sum(ln(c_rf.p)) + sum(ln(c_qd.p)) AS fit, count(*) AS n FROM b JOIN c_q USING (q) JOIN c_disc USING (disc) JOIN c_rf USING (rf) JOIN c_qd USING (q, disc, qd))"
    " SELECT round(fit - (2 + 2 + 18 + (SELECT count(*) FROM c_rf) - 1) / 2e0 * ln(n), 3) AS bic FROM l"
)
def network_bic(spark, sf_dir):
    return statistics.network_bic(spark, base_view(spark, sf_dir), model(spark, sf_dir)).select(F.round("bic", 3).alias("bic"))


def _edge_frame(spark, edges) -> DataFrame:
    return spark.createDataFrame(edges or [], "src string, dst string")


@registered("SELECT * FROM (VALUES ('qd', 'disc'), ('qd', 'q'), ('disc', 'q')) t(src, dst)")
def hill_climb_edges(spark, sf_dir):
    return _edge_frame(spark, learning.hill_climb(statistics_of(spark, sf_dir)).edges)


@registered("SELECT * FROM (VALUES ('qd', 'disc'), ('qd', 'q'), ('disc', 'q')) t(src, dst)")
def greedy_edges(spark, sf_dir):
    return _edge_frame(spark, learning.greedy_forward_backward(statistics_of(spark, sf_dir)).edges)


@registered("SELECT * FROM (VALUES ('q', 'qd'), ('disc', 'qd')) t(src, dst)")
def pc_edges(spark, sf_dir):
    return _edge_frame(spark, learning.pc(statistics_of(spark, sf_dir)).edges)


@registered("SELECT * FROM (VALUES ('q', 'qd'), ('disc', 'qd')) t(src, dst)")
def pc_stable_edges(spark, sf_dir):
    return _edge_frame(spark, learning.causal_discovery(statistics_of(spark, sf_dir), "pc", test="g2").edges)


# the best of all acyclic graphs over the four columns, by enumeration (tests/test_learning.py)
@registered("SELECT * FROM (VALUES ('q', 'qd'), ('disc', 'qd')) t(src, dst)")
def grasp_edges(spark, sf_dir):
    return _edge_frame(spark, learning.order_search(statistics_of(spark, sf_dir)).edges)


@registered("SELECT * FROM (VALUES ('q', 'qd', 'directed'), ('disc', 'qd', 'directed')) t(src, dst, kind)")
def ges_edges(spark, sf_dir):
    found = learning.causal_discovery(statistics_of(spark, sf_dir), "ges")
    rows = [(a, b, "directed") for a, b in sorted(found.details["directed"])] + [(*sorted(e), "undirected") for e in sorted(found.details["undirected"], key=sorted)]
    return spark.createDataFrame(rows, "src string, dst string, kind string")


@registered("SELECT * FROM (VALUES ('q', 'qd', 'arrow'), ('qd', 'q', 'circle'), ('disc', 'qd', 'arrow'), ('qd', 'disc', 'circle')) t(a, b, mark_at_b)")
def fci_marks(spark, sf_dir):
    marks = learning.causal_discovery(statistics_of(spark, sf_dir), "fci").details["marks"]
    return spark.createDataFrame([(a, b, m) for (a, b), m in sorted(marks.items())], "a string, b string, mark_at_b string")


# graphs

EDGE_SQL = "e(src, dst) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in ASIA.edges()) + ")"


@registered(
    f"WITH {EDGE_SQL} SELECT DISTINCT variable, member FROM (SELECT src AS variable, dst AS member FROM e UNION ALL SELECT dst, src FROM e UNION ALL"
    " SELECT a.src, b.src FROM e a JOIN e b ON a.dst = b.dst AND a.src <> b.src)"
)
def markov_blanket(spark, sf_dir):
    return graph.markov_blanket_df(ASIA.edges_df(spark))


@registered(f"WITH {EDGE_SQL} SELECT DISTINCT a, b FROM (SELECT least(src, dst) AS a, greatest(src, dst) AS b FROM e UNION ALL SELECT x.src, y.src FROM e x JOIN e y ON x.dst = y.dst AND x.src < y.src)")
def moral_edges(spark, sf_dir):
    return graph.moral_edges_df(ASIA.edges_df(spark))


@registered(
    f"WITH RECURSIVE {EDGE_SQL}, given(v) AS (VALUES ('xray')), anc(v) AS (SELECT v FROM given UNION SELECT src FROM e JOIN anc ON dst = v),"
    " r(v, way) AS (SELECT 'tub', 'up' UNION SELECT * FROM (SELECT CASE WHEN m.to_parent THEN e.src ELSE e.dst END, CASE WHEN m.to_parent THEN 'up' ELSE 'down' END"
    " FROM r, e, (VALUES (true), (false)) m(to_parent) WHERE CASE WHEN m.to_parent THEN e.dst = r.v AND ((r.way = 'up' AND r.v NOT IN (SELECT v FROM given)) OR (r.way = 'down' AND r.v IN (SELECT v FROM anc)))"
    " ELSE e.src = r.v AND r.v NOT IN (SELECT v FROM given) END)) SELECT DISTINCT v AS variable FROM r WHERE v <> 'tub'"
)
def d_connected(spark, sf_dir):
    return spark.createDataFrame([(v,) for v in sorted(graph.d_connected(ASIA, "tub", ["xray"]))], "variable string")


@registered(
    f"WITH {EDGE_SQL}, v AS (SELECT DISTINCT v FROM (SELECT src AS v FROM e UNION ALL SELECT dst FROM e)) SELECT v AS variable,"
    " CASE WHEN v NOT IN (SELECT dst FROM e) THEN 'root' WHEN v NOT IN (SELECT src FROM e) THEN 'leaf' ELSE 'middle' END AS kind FROM v"
)
def roots_leaves(spark, sf_dir):
    edges = ASIA.edges_df(spark)
    v = edges.select(F.col("src").alias("variable")).unionByName(edges.select(F.col("dst").alias("variable"))).distinct()
    to = edges.select(F.col("dst").alias("variable")).distinct().withColumn("has_parent", F.lit(True))
    out = edges.select(F.col("src").alias("variable")).distinct().withColumn("has_child", F.lit(True))
    kind = F.when(F.col("has_parent").isNull(), "root").when(F.col("has_child").isNull(), "leaf").otherwise("middle")
    return v.join(to, "variable", "left").join(out, "variable", "left").select("variable", kind.alias("kind"))


@registered(f"WITH RECURSIVE {EDGE_SQL}, r(src, dst, n) AS (SELECT src, dst, 1 FROM e UNION SELECT r.src, e.dst, n + 1 FROM r JOIN e ON r.dst = e.src) SELECT src, dst, min(n) AS distance FROM r GROUP BY src, dst")
def transitive_closure(spark, sf_dir):
    return graph.transitive_closure_df(ASIA.edges_df(spark))


LEARNED_EDGES = [("asia", "tub"), ("lung", "smoke"), ("smoke", "bronc"), ("either", "xray"), ("xray", "dysp")]


@registered(
    f"WITH {EDGE_SQL}, l(src, dst) AS (VALUES {', '.join(f'({a!r}, {b!r})' for a, b in LEARNED_EDGES)}), k AS (SELECT CASE WHEN l.src IS NULL THEN 'missing' WHEN e.src IS NULL THEN 'extra' WHEN l.src <> e.src THEN 'reversed' END AS kind"
    " FROM e FULL JOIN l ON least(e.src, e.dst) = least(l.src, l.dst) AND greatest(e.src, e.dst) = greatest(l.src, l.dst)) SELECT kind, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY kind"
)
def structural_hamming(spark, sf_dir):
    return graph.structural_hamming_df(ASIA.edges_df(spark), _edge_frame(spark, LEARNED_EDGES))


@registered("SELECT * FROM (VALUES ('asia,tub'), ('bronc,dysp,either'), ('bronc,either,lung'), ('bronc,lung,smoke'), ('either,lung,tub'), ('either,xray')) t(clique)")
def junction_cliques(spark, sf_dir):
    cliques = graph.maximal_cliques(graph.moral_neighbours(ASIA.variables, ASIA.edges()))
    return spark.createDataFrame([(",".join(c),) for c in cliques], "clique string")


# sensitivity: P(q = hi | qd = hi) in the network q -> qd

SENS = (
    f"WITH {BASE}, {root_sql('q')}, n AS (SELECT q, qd, count(*) AS n FROM b GROUP BY ALL), g AS (SELECT * FROM (SELECT DISTINCT q FROM b), (SELECT DISTINCT qd FROM b)),"
    " c AS (SELECT q, qd, (coalesce(n, 0) + 1) / (sum(coalesce(n, 0) + 1) OVER (PARTITION BY q)) AS p FROM g LEFT JOIN n USING (q, qd)),"
    " cell AS (SELECT 'q' AS variable, '(none)' AS parent_config, q AS outcome, p AS theta FROM c_q UNION ALL SELECT 'qd', 'q=' || q, qd, p FROM c)"
)


def at_sql(points: str) -> str:
    """post(variable, parent_config, outcome, theta, x, p): the posterior with each cell set to each x."""
    return (
        f"{SENS}, pt AS ({points}), pr AS (SELECT pt.*, c_q.q AS q, CASE WHEN pt.variable = 'q' THEN CASE WHEN c_q.q = pt.outcome THEN x ELSE c_q.p * (1 - x) / (1 - theta) END ELSE c_q.p END"
        " * CASE WHEN pt.variable = 'qd' AND pt.parent_config = 'q=' || c_q.q THEN CASE WHEN pt.outcome = 'hi' THEN x ELSE c.p * (1 - x) / (1 - theta) END ELSE c.p END AS w"
        " FROM pt, c_q JOIN c ON c.q = c_q.q AND c.qd = 'hi'), post AS (SELECT variable, parent_config, outcome, theta, x, CASE WHEN sum(w) > 0 THEN sum(CASE WHEN q = 'hi' THEN w ELSE 0 END) / sum(w) ELSE 0 END AS p FROM pr GROUP BY ALL)"
    )


def small_model(spark, sf_dir) -> Network:
    return statistics.SufficientStatistics(base_view(spark, sf_dir), ["q", "qd"]).laplace_network([("q", "qd")])


ASKED, GIVEN = ("q", "hi"), {"qd": "hi"}


@registered(
    at_sql("SELECT *, CASE WHEN theta + 1e-2 > 1 THEN greatest(0, theta - 1e-2) ELSE theta + 1e-2 END AS x FROM cell UNION ALL SELECT *, theta FROM cell")
    + " SELECT a.variable, a.parent_config, a.outcome, round((a.p - z.p) / (CASE WHEN a.theta + 1e-2 > 1 THEN -1e-2 ELSE 1e-2 END), 4) AS derivative FROM post a JOIN post z USING (variable, parent_config, outcome) WHERE a.x <> a.theta AND z.x = z.theta"
)
def sensitivity_fd(spark, sf_dir):
    return sensitivity.finite_differences(spark, small_model(spark, sf_dir), ASKED, GIVEN).select("variable", "parent_config", "outcome", F.round("derivative", 4).alias("derivative"))


ANALYTIC = at_sql("SELECT cell.*, x FROM cell, (VALUES (0e0), (5e-1), (1e0)) v(x)") + (
    ", s AS (SELECT variable, parent_config, outcome, theta, max(CASE WHEN x = 0 THEN p END) AS b, max(CASE WHEN x = 5e-1 THEN p END) AS h, max(CASE WHEN x = 1 THEN p END) AS o FROM post GROUP BY ALL),"
    " k AS (SELECT *, CASE WHEN abs(h - o) > 1e-12 THEN (o + b - 2 * h) / (h - o) ELSE 0 END AS c FROM s), d AS (SELECT *, (o * (c + 1) - b - b * c) / ((c * theta + 1) * (c * theta + 1)) AS derivative FROM k)"
)


@registered(ANALYTIC + " SELECT variable, parent_config, outcome, round(derivative, 4) AS derivative, round(abs(o - b), 4) AS range FROM d")
def sensitivity_analytic(spark, sf_dir):
    out = sensitivity.analytic_sensitivity(spark, small_model(spark, sf_dir), ASKED, GIVEN)
    return out.select("variable", "parent_config", "outcome", F.round("derivative", 4).alias("derivative"), F.round("range", 4).alias("range"))


@registered(ANALYTIC + " SELECT variable, round(max(abs(derivative)), 4) AS influence FROM d GROUP BY variable")
def influence_map(spark, sf_dir):
    curves = sensitivity.analytic_sensitivity(spark, small_model(spark, sf_dir), ASKED, GIVEN)
    return sensitivity.influence_map(curves).select("variable", F.round("influence", 4).alias("influence"))


@registered(ANALYTIC + " SELECT variable, parent_config, outcome, round(abs(derivative), 4) AS size FROM d ORDER BY abs(derivative) DESC LIMIT 1")
def top_params(spark, sf_dir):
    curves = sensitivity.analytic_sensitivity(spark, small_model(spark, sf_dir), ASKED, GIVEN)
    return sensitivity.top_parameters(curves, 1).select("variable", "parent_config", "outcome", F.round(F.abs("derivative"), 4).alias("size"))


@registered(at_sql("SELECT cell.*, i / 4e0 AS x FROM cell, range(0, 5) r(i)") + " SELECT variable, parent_config, outcome, round(max(p) - min(p), 4) AS range FROM post GROUP BY variable, parent_config, outcome")
def tornado(spark, sf_dir):
    return sensitivity.tornado(spark, small_model(spark, sf_dir), ASKED, GIVEN).select("variable", "parent_config", "outcome", F.round("range", 4).alias("range"))


# information

H = "-sum(CASE WHEN p > 1e-15 THEN p * log2(p) ELSE 0 END)"
VOI_PARTS = f"""{JOINT}, m AS (SELECT qd, sum(p) AS p FROM j GROUP BY qd), h0 AS (SELECT {H} AS h FROM m),
x AS (SELECT 'q' AS candidate, q AS o, qd, sum(p) AS p FROM j GROUP BY ALL UNION ALL SELECT 'disc', disc, qd, sum(p) FROM j GROUP BY ALL),
y AS (SELECT candidate, o, sum(p) AS w FROM x GROUP BY ALL), z AS (SELECT candidate, w, -sum(CASE WHEN p / w > 1e-15 THEN p / w * log2(p / w) ELSE 0 END) AS h FROM x JOIN y USING (candidate, o) GROUP BY candidate, o, w)"""


@registered(f"{JOINT}, m AS (SELECT qd, sum(p) AS p FROM j GROUP BY qd) SELECT round({H}, 6) AS bits FROM m")
def entropy_of_prior(spark, sf_dir):
    return inference.infer(spark, model(spark, sf_dir), variables=["qd"]).agg(F.round(entropy_bits("p"), 6).alias("bits"))


@registered(f"{VOI_PARTS} SELECT candidate, round(max(h0.h), 6) AS base_entropy, round(greatest(0, max(h0.h) - sum(w * z.h)), 6) AS voi FROM z, h0 GROUP BY candidate")
def value_of_information(spark, sf_dir):
    out = sensitivity.value_of_information(spark, model(spark, sf_dir), "qd")
    return out.select("candidate", F.round("base_entropy", 6).alias("base_entropy"), F.round("voi", 6).alias("voi"))


@registered(f"{VOI_PARTS} SELECT candidate, round(greatest(0, max(h0.h) - sum(w * z.h)), 6) AS voi FROM z, h0 GROUP BY candidate")
def voi_multi(spark, sf_dir):
    """Two targets; rf is separated from every candidate, so it adds none."""
    return sensitivity.multi_query_voi(spark, model(spark, sf_dir), ["qd", "rf"]).select("candidate", F.round("voi", 6).alias("voi"))


# continuous columns

PRICE = "o_totalprice"


@registered(
    f"WITH t AS (SELECT min({PRICE}) AS lo, (max({PRICE}) - min({PRICE})) / 3 AS w FROM orders), c AS (SELECT lo + w AS a, lo + 2 * w AS b FROM t)"
    f" SELECT CASE WHEN {PRICE} < a THEN 0 WHEN {PRICE} < b THEN 1 ELSE 2 END AS bin, count(*) AS n FROM orders, c GROUP BY 1"
)
def discretize_width(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    labels = gaussian.bin_labels(gaussian.thresholds(orders, PRICE))
    binned = gaussian.discretize(orders, PRICE, out="label")
    return binned.groupBy((F.array_position(F.lit(labels), F.col("label")) - 1).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@registered(
    "WITH r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL), c AS (SELECT max(CASE WHEN i = n // 4 THEN value END) AS a, max(CASE WHEN i = 2 * n // 4 THEN value END) AS b, max(CASE WHEN i = 3 * n // 4 THEN value END) AS d FROM r)"
    " SELECT CASE WHEN value < a THEN 0 WHEN value < b THEN 1 WHEN value < d THEN 2 ELSE 3 END AS bin, count(*) AS n FROM events, c WHERE value IS NOT NULL GROUP BY 1"
)
def discretize_freq(spark, sf_dir):
    events = table(spark, sf_dir, "events").where("value is not null")
    cuts = gaussian.thresholds(events, "value", "equal-frequency", 4)
    bin_of = functools.reduce(lambda a, t: a + (F.col("value") >= t).cast("int"), cuts, F.lit(0))
    return events.groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@registered(
    "SELECT l_returnflag AS config_key, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,"
    " round(regr_syy(l_extendedprice, l_quantity) * (1 - regr_r2(l_extendedprice, l_quantity)) / (count(*) - 2), 0) AS variance, count(*) AS n FROM lineitem GROUP BY l_returnflag"
)
def clg_fit(spark, sf_dir):
    fit = gaussian.fit_linear_gaussian(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity"], ["l_returnflag"])
    return fit.select("config_key", F.round("intercept", 3).alias("intercept"), F.round(F.get("coefficients", 0), 4).alias("slope"), F.round("variance", 0).alias("variance"), "n")


@registered(
    "WITH f AS (SELECT l_returnflag, regr_intercept(l_extendedprice, l_quantity) AS i, regr_slope(l_extendedprice, l_quantity) AS s FROM lineitem GROUP BY 1)"
    " SELECT l_orderkey, l_linenumber, round(i + s * l_quantity, 2) AS mean, true AS matched FROM lineitem JOIN f USING (l_returnflag)"
)
def clg_predict(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    fit = gaussian.fit_linear_gaussian(lines, "l_extendedprice", ["l_quantity"], ["l_returnflag"])
    out = gaussian.predict_linear_gaussian(fit, lines.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"), ["l_quantity"], ["l_returnflag"])
    return out.select("l_orderkey", "l_linenumber", F.round("mean", 2).alias("mean"), "matched")


# formats

BIF_TEXT = """network demo { }
// a comment
variable Rain { type discrete [ 2 ] { yes, no }; }
variable Wet { type discrete [ 2 ] { yes, no }; property position = (3, 4) ; }
probability ( Rain ) { table 0.2, 0.8; }
probability ( Wet | Rain ) { (no) 0.1, 0.9; (yes) 0.9, 0.1; }
"""
CELLS_SQL = (
    "SELECT * FROM (VALUES ('demo', 'Rain', 0, 0, 2e-1), ('demo', 'Rain', 0, 1, 8e-1), ('demo', 'Wet', 0, 0, 9e-1), ('demo', 'Wet', 0, 1, 1e-1),"
    " ('demo', 'Wet', 1, 0, 1e-1), ('demo', 'Wet', 1, 1, 9e-1)) t(network, variable, row_idx, outcome_idx, p)"
)


@registered(CELLS_SQL)
def bif_parse(spark, sf_dir):
    return formats.parse_network(BIF_TEXT).cells_df(spark)


@registered(CELLS_SQL)
def xmlbif_roundtrip(spark, sf_dir):
    return formats.parse_network(formats.to_xmlbif(formats.parse_bif(BIF_TEXT))).cells_df(spark)


@registered("SELECT * FROM (VALUES ('demo', 'Rain', '', 2), ('demo', 'Wet', 'Rain', 4)) t(network, variable, parents, cells)")
def json_roundtrip(spark, sf_dir):
    made = readers.cpts_from_json(spark.createDataFrame([(formats.to_json(formats.parse_bif(BIF_TEXT)),)], "json string"))
    return made.select("network", "variable", F.array_join("parents", ",").alias("parents"), F.size("table").alias("cells"))


@registered("SELECT * FROM (VALUES ('a;b;\"c,d,e,f\"', ';'), ('a,b', ','), ('a' || chr(9) || 'b', chr(9))) t(header, delimiter)")
def csv_sniff(spark, sf_dir):
    heads = ['a;b;"c,d,e,f"', "a,b", "a\tb"]
    return spark.createDataFrame([(h, readers.sniff_delimiter(h)) for h in heads], "header string, delimiter string")


@registered()
def forward_sample(spark, sf_dir):
    """Frequencies of 20 000 seeded draws of the chest-clinic network."""
    drawn = readers.forward_sample(spark, ASIA, 20_000, seed=5)
    return drawn.groupBy("smoke", "lung").agg(F.count(F.lit(1)).alias("n"))


# more of the model: files, samples, sessions, paths, a mid-size and a loopy network


def saved(spark: SparkSession, df: DataFrame, name: str, form: str = "text", **options) -> str:
    """Write to the shared folder and return the path."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.format(form).options(**options).save(path)
    return path


@registered("SELECT r_name AS name, CAST(r_regionkey AS VARCHAR) AS key FROM region")
def csv_file(spark, sf_dir):
    """A delimited file, written and read through the sniffing reader."""
    path = saved(spark, table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("key")).coalesce(1), "csv", "csv", header=True, sep=";")
    return readers.read_training_csv(spark, path).select("name", "key")


@registered(CELLS_SQL)
def json_cells(spark, sf_dir):
    """Every cell's value through the JSON text of a network in a file."""
    path = saved(spark, spark.createDataFrame([(formats.to_json(formats.parse_bif(BIF_TEXT)),)], "value string"), "json")
    return formats.from_json(spark.read.text(path, wholetext=True).first()["value"]).cells_df(spark)


@registered(f"{values_sql(ASIA)} SELECT lung, smoke, true AS near FROM j GROUP BY lung, smoke")
def forward_sample_share(spark, sf_dir):
    """Shares of 20 000 draws lie within four standard errors of the model's joint distribution."""
    drawn = readers.forward_sample(spark, ASIA, 20_000, seed=5).groupBy("smoke", "lung").agg((F.count(F.lit(1)) / 20_000).alias("share"))
    truth = spark.createDataFrame([("yes", "yes", 0.05), ("yes", "no", 0.45), ("no", "yes", 0.005), ("no", "no", 0.495)], "smoke string, lung string, p double")
    return truth.join(drawn, ["smoke", "lung"]).select("lung", "smoke", (F.abs(F.col("share") - F.col("p")) <= 4 * F.sqrt(F.col("p") * (1 - F.col("p")) / 20_000)).alias("near"))


@registered("SELECT 'yes' AS rain, 'yes' AS wet, 9e-1 AS p")
def point_lookup(spark, sf_dir):
    """P(Wet = yes | Rain = yes) from the table's factor."""
    net = formats.parse_bif(BIF_TEXT)
    value = Factor.from_cpt(spark, net, net.cpts["Wet"]).evaluate({"Rain": 0, "Wet": 0})
    return spark.createDataFrame([("yes", "yes", value)], "rain string, wet string, p double")


@registered(ANALYTIC + ", abc AS (SELECT variable, parent_config, outcome, o * (c + 1) - b AS a, b, c FROM d) SELECT variable, parent_config, outcome, round((a * 25e-2 + b) / (c * 25e-2 + 1), 4) AS p FROM abc")
def curve_at_quarter(spark, sf_dir):
    """The analytic curves evaluated at 1/4."""
    curves = sensitivity.analytic_sensitivity(spark, small_model(spark, sf_dir), ASKED, GIVEN)
    return curves.select("variable", "parent_config", "outcome", F.round(sensitivity.curve_value(0.25), 4).alias("p"))


@registered("SELECT 'Rain' AS variable, 'yes' AS outcome, round(CAST(18 AS DOUBLE) / 26, 6) AS p UNION ALL SELECT 'Rain', 'no', round(CAST(8 AS DOUBLE) / 26, 6)")
def session_query(spark, sf_dir):
    """A session: load a text, observe, query."""
    session = Session(spark)
    session.load(BIF_TEXT)
    session.set_evidence("Wet", "yes")
    return posterior(session.query(["Rain"]))


@registered("SELECT * FROM (VALUES ('Rain', 'yes: 69.23%, no: 30.77%')) t(variable, text)")
def session_text(spark, sf_dir):
    session = Session(spark)
    session.load(BIF_TEXT)
    session.set_evidence("Wet", "yes")
    return session.text(["Rain"])


@registered("SELECT true AS calibrated, count(*) AS cliques FROM range(0, 6)")
def calibration_gap(spark, sf_dir):
    """Marginals of one variable read from different cliques agree."""
    kernel = CompiledNetwork(ASIA)
    return spark.createDataFrame([(kernel.calibration_gap({"xray": "yes"}) < 1e-12, len(kernel.cliques))], "calibrated boolean, cliques long")


ASIA_EDGES = "e(src, dst) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in ASIA.edges()) + ")"


@registered(f"WITH RECURSIVE {ASIA_EDGES}, r AS (SELECT src, dst, src || '>' || dst AS way FROM e UNION ALL SELECT r.src, e.dst, r.way || '>' || e.dst FROM r JOIN e ON e.src = r.dst) SELECT way FROM r WHERE src = 'smoke' AND dst = 'dysp'")
def all_paths(spark, sf_dir):
    return spark.createDataFrame([(">".join(p),) for p in graph.paths(ASIA.edges(), "smoke", "dysp")], "way string")


@registered(
    f"WITH RECURSIVE {ASIA_EDGES}, v AS (SELECT src AS v FROM e UNION SELECT dst FROM e), r AS (SELECT v, 0 AS d FROM v UNION SELECT e.dst, r.d + 1 FROM r JOIN e ON e.src = r.v)"
    " SELECT v AS variable, max(d) AS depth FROM r GROUP BY v"
)
def node_depths(spark, sf_dir):
    found = graph.depths(list(ASIA.variables), ASIA.edges())
    return spark.createDataFrame(list(found.items()), "variable string, depth int")


def chain_network(n: int, rows: int = 3) -> Network:
    """A ladder of ``n`` binary variables, each with up to two parents: v(k) depends on v(k-1) and v(k-3)."""
    names = [f"v{k}" for k in range(n)]
    cpts = []
    for k in range(n):
        parents = tuple(names[p] for p in (k - 1, k - rows) if p >= 0) if k != 1 else (names[0],)
        parents = tuple(dict.fromkeys(parents))
        p = np.array([0.2 + 0.6 * ((7 * k + 3 * i) % 11) / 11 for i in range(2 ** len(parents))]).reshape([2] * len(parents))
        cpts.append(Cpt(names[k], parents, np.stack([p, 1 - p], axis=-1)))
    return Network("ladder", [Variable(v, ("yes", "no")) for v in names], cpts)


#: Of the ladder, by the three latest variables: the joint distribution moves along in SQL.
def ladder_sql(n: int) -> str:
    cell = lambda k, i: f"{0.2 + 0.6 * ((7 * k + 3 * i) % 11) / 11:.17f}".rstrip("0")
    net = chain_network(n)
    out = ["s0(a, b, c, p) AS (SELECT v, -1, -1, CASE WHEN v = 0 THEN CAST(%s AS DOUBLE) ELSE 1 - CAST(%s AS DOUBLE) END FROM range(0, 2) r(v))" % (cell(0, 0), cell(0, 0))]
    for k in range(1, n):
        parents = net.parents(f"v{k}")
        index = "a" if len(parents) == 1 else "2 * a + c"
        case = "CASE " + index + "".join(f" WHEN {i} THEN CAST({cell(k, i)} AS DOUBLE)" for i in range(2 ** len(parents))) + " END"
        out.append(f"s{k} AS (SELECT v AS a, a AS b, b AS c, sum(p * CASE WHEN v = 0 THEN {case} ELSE 1 - {case} END) AS p FROM s{k - 1}, range(0, 2) r(v) GROUP BY 1, 2, 3)")
    return f"WITH {', '.join(out)} SELECT 'v{n - 1}' AS variable, CASE WHEN a = 0 THEN 'yes' ELSE 'no' END AS outcome, round(sum(p), 6) AS p FROM s{n - 1} GROUP BY a"


LADDER = 60


@registered(ladder_sql(LADDER))
def midsize_posterior(spark, sf_dir):
    """A network of 60 variables through its text form and the junction forest."""
    net = formats.parse_network(formats.to_xmlbif(chain_network(LADDER)))
    return posterior(inference.infer(spark, net, variables=[f"v{LADDER - 1}"]))


@registered("SELECT true AS converged, true AS near")
def lbp_loopy(spark, sf_dir):
    """Loopy propagation on a network with loops ends near the exact posteriors."""
    found = loopy.loopy_belief_propagation(ASIA, {"xray": "yes"})
    exact, _ = CompiledNetwork(ASIA).infer({"xray": "yes"})
    gap = max(float(np.abs(found.posteriors[v] - exact[v]).max()) for v in exact)
    return spark.createDataFrame([(bool(found.converged), gap < 0.05)], "converged boolean, near boolean")


@registered(
    "WITH t AS (SELECT l_returnflag AS f, l_orderkey * CAST(1e1 AS DOUBLE) + CAST(17e8 AS DOUBLE) AS x, l_quantity + 5 * (l_orderkey * CAST(1e1 AS DOUBLE)) AS y FROM lineitem)"
    " SELECT f AS config_key, round(regr_slope(y, x), 3) AS slope, count(*) AS n FROM t GROUP BY f"
)
def clg_fit_timestamps(spark, sf_dir):
    """A regression on values of the size of timestamps."""
    far = F.col("l_orderkey") * F.lit(10.0)
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", (far + 1.7e9).alias("x"), (F.col("l_quantity") + 5 * far).alias("y"))
    fit = gaussian.fit_linear_gaussian(lines, "y", ["x"], ["l_returnflag"])
    return fit.select("config_key", F.round(F.get("coefficients", 0), 3).alias("slope"), "n")

# the same over counts that stay in Spark

PASS_FAMILIES = [(c, []) for c in COLUMNS] + [(c, [p]) for c in COLUMNS for p in COLUMNS if p != c] + [("qd", ["q", "disc"]), ("rf", ["q", "disc", "qd"])]
PASS_TESTS = [(x, y, g) for x, y in (("q", "disc"), ("q", "qd"), ("disc", "qd"), ("qd", "rf"), ("q", "rf"), ("disc", "rf")) for g in [None, *(c for c in COLUMNS if c not in (x, y))]]


def spark_statistics_of(spark: SparkSession, sf_dir: str) -> statistics.SufficientStatistics:
    """Statistics whose counts never come to the driver, however few they are."""
    return statistics.SufficientStatistics(base_view(spark, sf_dir), COLUMNS, max_cells=0)


@registered(f"WITH {BASE} " + " UNION ALL ".join(family_sql(c, ps) for c, ps in PASS_FAMILIES))
def family_scores_one_pass(spark, sf_dir):
    """BIC of many families from one pass over the rows."""
    stats = spark_statistics_of(spark, sf_dir)
    scores = stats.scores([(c, tuple(ps)) for c, ps in PASS_FAMILIES])
    return spark.createDataFrame([(c, ",".join(ps), round(s, 4)) for (c, ps), s in zip(PASS_FAMILIES, scores, strict=True)], "child string, parents string, score double")


@registered(" UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, '{g or ''}' AS given, '{kind}' AS kind, statistic, df FROM ({test_sql(x, y, g, kind)})" for kind in ("chi2", "g2") for x, y, g in PASS_TESTS))
def pair_tests_one_pass(spark, sf_dir):
    """Tests of all pairs, alone and given each other column, from one pass for each kind."""
    stats, rows = spark_statistics_of(spark, sf_dir), []
    for kind in ("chi2", "g2"):
        found = stats.tests([(x, y, (g,) if g else ()) for x, y, g in PASS_TESTS], kind)
        rows += [(x, y, g or "", kind, round(s, 4), int(df)) for (x, y, g), (s, df) in zip(PASS_TESTS, found, strict=True)]
    return spark.createDataFrame(rows, "x string, y string, given string, kind string, statistic double, df long")


@registered("SELECT * FROM (VALUES ('qd', 'disc'), ('qd', 'q'), ('disc', 'q')) t(src, dst)")
def hill_climb_spark_edges(spark, sf_dir):
    return _edge_frame(spark, learning.hill_climb(spark_statistics_of(spark, sf_dir)).edges)


@registered("SELECT * FROM (VALUES ('q', 'qd'), ('disc', 'qd')) t(src, dst)")
def pc_spark_edges(spark, sf_dir):
    return _edge_frame(spark, learning.pc(spark_statistics_of(spark, sf_dir)).edges)


# plans over sparse tables, and evidence in order of time


SPARSE_EDGES = [("part", "supp"), ("part", "rf"), ("supp", "rf"), ("part", "q")]
SPARSE = (
    "b AS (SELECT CAST(l_partkey AS VARCHAR) AS part, CAST(l_suppkey AS VARCHAR) AS supp, l_returnflag AS rf, CASE WHEN l_quantity < 17 THEN 'lo' WHEN l_quantity < 34 THEN 'mid' ELSE 'hi' END AS q FROM lineitem),"
    " p1 AS (SELECT part, count(*) / sum(count(*)) OVER () AS p1 FROM b GROUP BY part), p2 AS (SELECT part, supp, count(*) / sum(count(*)) OVER (PARTITION BY part) AS p2 FROM b GROUP BY part, supp),"
    " p3 AS (SELECT part, supp, rf, count(*) / sum(count(*)) OVER (PARTITION BY part, supp) AS p3 FROM b GROUP BY part, supp, rf), p4 AS (SELECT part, q, count(*) / sum(count(*)) OVER (PARTITION BY part) AS p4 FROM b GROUP BY part, q),"
    " j AS (SELECT part, supp, rf, q, p1 * p2 * p3 * p4 AS p FROM p1 JOIN p2 USING (part) JOIN p3 USING (part, supp) JOIN p4 USING (part))"
)


@registered(f"WITH {SPARSE} SELECT 'supp' AS variable, supp AS outcome, round(sum(p) / sum(sum(p)) OVER (), 9) AS p FROM j WHERE rf = 'R' AND q = 'hi' GROUP BY supp")
def sparse_posterior(spark, sf_dir):
    """P(supplier | return flag, quantity) in a network over all parts and suppliers, whose clique no array could hold."""
    lines = table(spark, sf_dir, "lineitem")
    q = statistics.binned(F.col("l_quantity"), [17.0, 34.0], ["lo", "mid", "hi"]).alias("q")
    view = lines.select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_returnflag").alias("rf"), q)
    forest = SparseForest(spark, learned_tables(view, ["part", "supp", "rf", "q"], SPARSE_EDGES))
    return forest.posterior("supp", {"rf": "R", "q": "hi"}).withColumn("p", F.round("p", 9))


@registered(
    f"WITH {BASE}, g1 AS (SELECT q, count(*) / sum(count(*)) OVER () AS p1 FROM b GROUP BY q), g2 AS (SELECT disc, count(*) / sum(count(*)) OVER () AS p2 FROM b GROUP BY disc),"
    " g3 AS (SELECT q, disc, qd, count(*) / sum(count(*)) OVER (PARTITION BY q, disc) AS p3 FROM b GROUP BY q, disc, qd), j AS (SELECT q, disc, qd, p1 * p2 * p3 AS p FROM g3 JOIN g1 USING (q) JOIN g2 USING (disc)),"
    " c AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 <> 0 THEN disc END AS disc, qd FROM b), d AS (SELECT DISTINCT disc, qd FROM c),"
    " r AS (SELECT d.disc, d.qd, j.q, sum(p) / sum(sum(p)) OVER (PARTITION BY d.disc, d.qd) AS p FROM d JOIN j ON d.qd = j.qd AND (d.disc IS NULL OR d.disc = j.disc) GROUP BY d.disc, d.qd, j.q)"
    " SELECT l_orderkey, l_linenumber, 'q' AS variable, r.q AS outcome, round(r.p, 6) AS p FROM c JOIN r ON r.qd = c.qd AND r.disc IS NOT DISTINCT FROM c.disc"
)
def case_axis_posteriors(spark, sf_dir):
    """P(q | the row's qd and, in two rows of three, disc) for every line item: one plan of joins and sums, no Python."""
    keys = ["l_orderkey", "l_linenumber"]
    view = base_view(spark, sf_dir, tuple(keys))
    tables = learned_tables(view, ["q", "disc", "qd"], MODEL_EDGES)
    cases = view.withColumn("disc", F.when(F.col("l_linenumber") % 3 != 0, F.col("disc")))
    return case_posteriors(tables, "q", cases, ["disc", "qd"], keys).withColumn("p", F.round("p", 6))


@registered(
    f"{JOINT}, r AS (SELECT disc, qd, q AS outcome, p / sum(p) OVER (PARTITION BY disc, qd) AS p FROM j)"
    " SELECT l_orderkey, l_linenumber, 'q' AS variable, outcome, round(p, 4) AS p, true AS converged FROM b JOIN r USING (disc, qd)"
)
def lbp_row_posteriors(spark, sf_dir):
    """Loopy propagation for every line item's own evidence; on a network without loops it ends at the exact posterior."""
    keys = ["l_orderkey", "l_linenumber"]
    found = loopy.loopy_batch(spark, model(spark, sf_dir), base_view(spark, sf_dir, tuple(keys)), ["disc", "qd"], ["q"], keys, tolerance=1e-9)
    return found.select(*keys, "variable", "outcome", F.round("p", 4).alias("p"), "converged")


#: What an event says of its user's evidence.
EVENT_SETS = {"click": "q", "view": "disc", "purchase": "qd"}


@registered(
    f"{JOINT}, v AS (SELECT CAST(user_id AS VARCHAR) AS view_id, ts, event_type, value, CASE WHEN value < 20 THEN 'lo' WHEN value < 60 THEN 'mid' ELSE 'hi' END AS o FROM events),"
    " a AS (SELECT view_id, ts, CASE event_type WHEN 'click' THEN 'q' WHEN 'view' THEN 'disc' WHEN 'purchase' THEN 'qd' ELSE CASE WHEN value < 50 THEN 'q' ELSE 'qd' END END AS var,"
    " CASE WHEN event_type <> 'error' THEN o END AS o FROM v WHERE event_type <> 'signup'), l AS (SELECT view_id, max(ts) AS ts FROM v WHERE event_type = 'signup' GROUP BY view_id),"
    " k AS (SELECT a.view_id, var, arg_max(struct_pack(o := o, ts := a.ts), a.ts) AS s FROM a GROUP BY a.view_id, var),"
    " e AS (SELECT v.view_id, max(CASE WHEN var = 'q' AND (l.ts IS NULL OR s.ts >= l.ts) THEN s.o END) AS eq, max(CASE WHEN var = 'disc' AND (l.ts IS NULL OR s.ts >= l.ts) THEN s.o END) AS ed,"
    " max(CASE WHEN var = 'qd' AND (l.ts IS NULL OR s.ts >= l.ts) THEN s.o END) AS eqd FROM (SELECT DISTINCT view_id FROM v) v LEFT JOIN l USING (view_id) LEFT JOIN k ON k.view_id = v.view_id GROUP BY v.view_id),"
    " w AS (SELECT view_id, j.disc, sum(CASE WHEN (eq IS NULL OR eq = q) AND (ed IS NULL OR ed = j.disc) AND (eqd IS NULL OR eqd = qd) THEN p ELSE 0 END) AS p FROM e, j GROUP BY view_id, j.disc)"
    " SELECT view_id, 'disc' AS variable, disc AS outcome, round(p / sum(p) OVER (PARTITION BY view_id), 6) AS p FROM w"
)
def evidence_replay(spark, sf_dir):
    """The last posterior of each user after ``events`` went through the evidence stream in shuffled order.

    Clicks, views and purchases set a variable, errors clear one, a signup clears all.
    """
    events = table(spark, sf_dir, "events")
    of = F.create_map(*[F.lit(x) for pair in EVENT_SETS.items() for x in pair])
    kind = F.col("event_type")
    variable = F.when(kind == "error", F.when(F.col("value") < 50, "q").otherwise("qd")).otherwise(F.try_element_at(of, kind))
    action = F.when(kind == "signup", "clear_all").when(kind == "error", "clear").otherwise("set")
    actions = events.select(
        F.col("user_id").cast("string").alias("view_id"), F.col("ts").cast("timestamp").alias("ts"), action.alias("action"), variable.alias("variable"),
        statistics.binned(F.col("value"), [20.0, 60.0], ["lo", "mid", "hi"]).alias("value"),
    )
    found = replayed(spark, actions, model(spark, sf_dir), ["disc"])
    return found.select("view_id", "variable", "outcome", F.round("p", 6).alias("p"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
