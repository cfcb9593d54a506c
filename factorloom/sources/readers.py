"""Spark readers and writers: network files, delimited training data, forward samples."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.model import CPT_SCHEMA, Network
from factorloom.sources.formats import parse_network, to_json, to_xmlbif


def read_networks(spark: SparkSession, path: str) -> DataFrame:
    """Parse every file under ``path`` on the executors: (file, name, json, error)."""

    def parse(batches):
        for batch in batches:
            rows = []
            for file, text in zip(batch["file"], batch["value"], strict=True):
                try:
                    net = parse_network(text)
                    rows.append((file, net.name, to_json(net), None))
                except Exception as e:  # one bad file is a row with its error
                    rows.append((file, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["file", "name", "json", "error"])

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return files.mapInPandas(parse, "file string, name string, json string, error string")


def load_network(spark: SparkSession, path: str) -> Network:
    """One network through Spark's readers; raises for a missing or malformed file."""
    return parse_network(spark.read.text(path, wholetext=True).first()[0])


NETWORK_JSON = (
    "name string, variables array<struct<name:string,outcomes:array<string>,position:struct<x:int,y:int>>>, "
    "edges array<struct<from:string,to:string>>, cpts array<struct<variable:string,parents:array<string>,table:array<double>>>"
)


def cpts_from_json(networks: DataFrame, column: str = "json") -> DataFrame:
    """Conditional tables of JSON networks as rows, without leaving the JVM."""
    parsed = networks.select(F.from_json(column, NETWORK_JSON).alias("n")).select(F.col("n.name").alias("network"), F.explode("n.cpts").alias("c"))
    return parsed.select("network", "c.variable", "c.parents", "c.table")


def write_networks(spark: SparkSession, networks: list[Network], path: str, form: str = "xmlbif") -> None:
    text = {"xmlbif": to_xmlbif, "json": to_json}[form]
    spark.createDataFrame([(text(n),) for n in networks], "value string").repartition(max(1, len(networks))).write.text(path)


def unquoted_counts(header: str) -> dict[str, int]:
    counts, quoted = {",": 0, "\t": 0, ";": 0}, False
    for c in header:
        if c == '"':
            quoted = not quoted
        elif not quoted and c in counts:
            counts[c] += 1
    return counts


def sniff_delimiter(header: str) -> str:
    counts = unquoted_counts(header)
    return max(counts, key=lambda c: counts[c])


def read_training_csv(spark: SparkSession, path: str) -> DataFrame:
    """Delimited text with a header, all columns string; a missing or empty field is the category ``''``."""
    head = spark.read.text(path).where(F.trim("value") != "").limit(2).collect()
    if len(head) < 2:
        raise ValueError("a header and at least one row are needed")
    sep = sniff_delimiter(head[0][0])
    frame = spark.read.csv(path, header=True, sep=sep, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return frame.fillna("")


def forward_sample(spark: SparkSession, net: Network, n: int, seed: int = 1) -> DataFrame:
    """``n`` independent rows: each variable drawn by its table's cumulative row, parents first."""
    order, left = [], list(net.variables)
    while left:
        ready = [v for v in left if all(p in order for p in net.parents(v))]
        order += ready
        left = [v for v in left if v not in ready]
    df = spark.range(n)
    for k, name in enumerate(order):
        cpt, v = net.cpts[name], net.variable(name)
        rows = cpt.table.reshape(-1, v.card).cumsum(axis=1)
        index = F.lit(0)
        for p, s in zip(cpt.parents, net.strides(cpt.parents), strict=True):
            index = index + F.col(f"code_{p}") * s
        cumulative = F.lit([x for r in rows for x in r[:-1].tolist()])
        draw = F.rand(seed * 1000 + k)
        df = df.withColumn(f"u_{name}", draw).withColumn(f"row_{name}", index)
        above = F.lit(0)
        for j in range(v.card - 1):
            above = above + (F.col(f"u_{name}") >= F.get(cumulative, (F.col(f"row_{name}") * (v.card - 1) + j).cast("int"))).cast("int")
        df = df.withColumn(f"code_{name}", above)
    return df.select("id", *[F.get(F.lit(list(net.variable(v).outcomes)), F.col(f"code_{v}")).alias(v) for v in net.variables])


__all__ = ["CPT_SCHEMA", "cpts_from_json", "forward_sample", "load_network", "read_networks", "read_training_csv", "sniff_delimiter", "write_networks"]
