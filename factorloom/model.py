"""Discrete networks: variables, conditional tables, navigation and DataFrame forms."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

VARIABLE_SCHEMA = "network string, var_id int, name string, outcomes array<string>, position struct<x:int,y:int>"
CPT_SCHEMA = "network string, variable string, parents array<string>, table array<double>"
CELL_SCHEMA = "network string, variable string, row_idx int, outcome_idx int, p double"


@dataclass(frozen=True)
class Variable:
    """A finite domain; the order of the outcomes gives their codes."""

    name: str
    outcomes: tuple[str, ...]
    position: tuple[int, int] | None = None

    @property
    def card(self) -> int:
        return len(self.outcomes)

    def code(self, outcome: str) -> int | None:
        return self.outcomes.index(outcome) if outcome in self.outcomes else None


@dataclass(frozen=True)
class Cpt:
    """P(variable | parents); ``table`` has the parents' axes in order, then the variable's."""

    variable: str
    parents: tuple[str, ...]
    table: np.ndarray = field(compare=False)

    @property
    def scope(self) -> tuple[str, ...]:
        return (*self.parents, self.variable)


class Network:
    """Immutable collection of variables and their tables. Names are unique."""

    def __init__(self, name: str, variables: list[Variable], cpts: list[Cpt]):
        self.name = name
        self.variables = {v.name: v for v in variables}
        if len(self.variables) != len(variables):
            raise ValueError("variable names must be unique")
        self.cpts: dict[str, Cpt] = {}
        for c in cpts:
            for v in c.scope:
                if v not in self.variables:
                    raise ValueError(f"unknown variable {v!r} in the table of {c.variable!r}")
            shape = tuple(self.variables[v].card for v in c.scope)
            table = np.asarray(c.table, np.float64)
            if table.size != int(np.prod(shape)):
                raise ValueError(f"the table of {c.variable!r} has {table.size} cells, not {int(np.prod(shape))}")
            self.cpts[c.variable] = Cpt(c.variable, tuple(c.parents), table.reshape(shape))

    # navigation
    def variable(self, name: str) -> Variable:
        if name not in self.variables:
            raise KeyError(f"unknown variable {name!r}")
        return self.variables[name]

    def parents(self, name: str) -> list[str]:
        return list(self.cpts[name].parents) if name in self.cpts else []

    def children(self, name: str) -> list[str]:
        return [c.variable for c in self.cpts.values() if name in c.parents]

    def edges(self) -> list[tuple[str, str]]:
        return [(p, c.variable) for c in self.cpts.values() for p in c.parents]

    def roots(self) -> list[str]:
        return [v for v in self.variables if not self.parents(v)]

    def leaves(self) -> list[str]:
        return [v for v in self.variables if not self.children(v)]

    def table_size(self, names) -> int:
        return int(np.prod([self.variable(n).card for n in names], dtype=np.int64)) if names else 1

    def strides(self, names) -> list[int]:
        cards = [self.variable(n).card for n in names]
        return [int(np.prod(cards[i + 1 :], dtype=np.int64)) for i in range(len(cards))]

    def parent_label(self, name: str, row: int) -> str:
        """``A=x, B=y`` of a parent configuration; ``(none)`` for roots."""
        parts = []
        for p, s in zip(self.parents(name), self.strides(self.parents(name)), strict=True):
            v = self.variable(p)
            parts.append(f"{p}={v.outcomes[row // s % v.card]}")
        return ", ".join(parts) or "(none)"

    def evaluate(self, name: str, assignment: dict[str, str]) -> float:
        """Table cell at an assignment; a missing variable reads as its first outcome."""
        cpt = self.cpts[name]
        return float(cpt.table[tuple(self.variables[v].code(assignment[v]) if v in assignment else 0 for v in cpt.scope)])

    def fingerprint(self) -> str:
        """Hash of structure and values: a cached compilation is valid only for both."""
        h = hashlib.sha256()
        for v in self.variables.values():
            h.update(repr((v.name, v.outcomes)).encode())
        for c in self.cpts.values():
            h.update(repr((c.variable, c.parents)).encode())
            h.update(c.table.tobytes())
        return h.hexdigest()

    def replace_cpt(self, cpt: Cpt) -> Network:
        return Network(self.name, list(self.variables.values()), [cpt if c.variable == cpt.variable else c for c in self.cpts.values()])

    def __str__(self) -> str:
        lines = [f"Network {self.name}"]
        for c in self.cpts.values():
            lines.append(f"P({c.variable} | {', '.join(c.parents)})" if c.parents else f"P({c.variable})")
        return "\n".join(lines)

    # DataFrames
    def variables_df(self, spark: SparkSession) -> DataFrame:
        rows = [(self.name, i, v.name, list(v.outcomes), v.position) for i, v in enumerate(self.variables.values())]
        return spark.createDataFrame(rows, VARIABLE_SCHEMA)

    def cpts_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.name, c.variable, list(c.parents), c.table.ravel().tolist()) for c in self.cpts.values()], CPT_SCHEMA)

    def cells_df(self, spark: SparkSession) -> DataFrame:
        rows = []
        for c in self.cpts.values():
            card = self.variables[c.variable].card
            rows += [(self.name, c.variable, i // card, i % card, float(p)) for i, p in enumerate(c.table.ravel())]
        return spark.createDataFrame(rows, CELL_SCHEMA)

    def edges_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.edges(), "src string, dst string")

    @staticmethod
    def from_frames(variables: DataFrame, cpts: DataFrame) -> dict[str, Network]:
        """Networks by name from their two tables (models are small; they are read by the driver)."""
        made: dict[str, tuple[list, list]] = {}
        for r in sorted(variables.collect(), key=lambda r: (r["network"], r["var_id"])):
            p = r["position"]
            made.setdefault(r["network"], ([], []))[0].append(Variable(r["name"], tuple(r["outcomes"]), (p["x"], p["y"]) if p else None))
        for r in cpts.collect():
            made[r["network"]][1].append(Cpt(r["variable"], tuple(r["parents"]), np.array(r["table"])))
        return {n: Network(n, vs, cs) for n, (vs, cs) in made.items()}
