"""Interventions: graph surgery, do-queries, average causal effects."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.model import Cpt, Network
from factorloom.operators.inference import infer, query


def mutilate(net: Network, interventions: Mapping[str, str]) -> Network:
    """Each intervened variable loses its parents and is sure of its value."""
    out = net
    for name, value in interventions.items():
        code = net.variable(name).code(value)
        if code is None:
            raise ValueError(f"unknown value {value!r} of {name!r}")
        out = out.replace_cpt(Cpt(name, (), np.eye(net.variable(name).card)[code]))
    return out


def interventional_query(spark: SparkSession, net: Network, target: str, interventions: Mapping[str, str], evidence: Mapping[str, str] | None = None) -> DataFrame:
    """P(target | do(interventions), evidence); an intervention wins over evidence on the same variable."""
    return query(spark, mutilate(net, interventions), target, {**(evidence or {}), **interventions})


def interventional_posteriors(spark: SparkSession, net: Network, interventions: Mapping[str, str], evidence=None) -> DataFrame:
    return infer(spark, mutilate(net, interventions), {**(evidence or {}), **interventions})


def average_causal_effect(spark: SparkSession, net: Network, treatment: str, outcome: str) -> DataFrame:
    """One row: P(y0 | do(x0)), P(y0 | do(x1)) and their difference, by the first two declared values."""
    x, y = net.variable(treatment), net.variable(outcome)
    if x.card < 2 or y.card < 2:
        raise ValueError("two outcomes are needed")
    arms = []
    for k in (0, 1):
        arm = interventional_query(spark, net, outcome, {treatment: x.outcomes[k]}).where("outcome_idx = 0")
        arms.append(arm.select(F.lit(k).alias("arm"), "p"))
    pick = lambda k: F.max(F.when(F.col("arm") == k, F.col("p")))
    both = arms[0].unionByName(arms[1]).agg(pick(0).alias("p_do_0"), pick(1).alias("p_do_1"))
    return both.withColumn("ace", F.col("p_do_0") - F.col("p_do_1"))
