"""A stateful session over one network: load, observe, query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.functions.special import percent_text
from factorloom.model import Network
from factorloom.operators.inference import infer
from factorloom.sources.formats import parse_network
from factorloom.sources.readers import load_network, read_networks


class Session:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.net: Network | None = None
        self.evidence: dict[str, str] = {}

    def list_examples(self, path: str) -> DataFrame:
        return read_networks(self.spark, path).select("file", "name", "error")

    def load(self, source: str) -> Network:
        """A network text, or a path that Spark can read; a missing path raises. Clears the evidence."""
        text = source.lstrip()
        known = text.startswith(("network", "//", "/*", "<", "{"))
        self.net, self.evidence = (parse_network(source) if known else load_network(self.spark, source)), {}
        return self.net

    def _network(self) -> Network:
        if self.net is None:
            raise ValueError("no network is loaded")
        return self.net

    def set_evidence(self, name: str, outcome: str) -> None:
        v = self._network().variable(name)
        if v.code(outcome) is None:
            raise ValueError(f"unknown outcome {outcome!r} of {name!r}; known: {', '.join(v.outcomes)}")
        self.evidence[name] = outcome

    def clear_evidence(self, name: str | None = None) -> None:
        self.evidence = {} if name is None else {k: v for k, v in self.evidence.items() if k != name}

    def info(self) -> dict:
        net = self._network()
        return {"name": net.name, "variables": {v.name: list(v.outcomes) for v in net.variables.values()}, "edges": net.edges(), "evidence": dict(self.evidence)}

    def query(self, variables: list[str] | None = None, evidence: dict[str, str] | None = None, source: str | None = None) -> DataFrame:
        if source is not None:
            self.load(source)
        return infer(self.spark, self._network(), {**self.evidence, **(evidence or {})}, variables=variables)

    def text(self, variables: list[str] | None = None) -> DataFrame:
        """Posteriors as percent texts, one line a variable."""
        found = self.query(variables)
        line = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("outcome_idx", F.concat("outcome", F.lit(": "), percent_text(F.col("p"))).alias("t")))), lambda x: x["t"]), ", ")
        return found.groupBy("variable").agg(line.alias("text"))
