"""Indexes and constraints: names, what they cover, and the checks they ask for."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import ExecutionFailed, SemanticError
from .graph import Graph
from .plans.ast import Command


@dataclass
class Catalog:
    indexes: dict[str, Command] = field(default_factory=dict)
    constraints: dict[str, Command] = field(default_factory=dict)

    def run(self, session, c: Command) -> DataFrame:
        kept = self.indexes if c.what == "index" else self.constraints
        if c.action == "show":
            return self.show(session, c.what)
        if c.action == "drop":
            if c.name not in kept and not c.lenient:
                raise SemanticError(f"there is no {c.what} {c.name}")
            kept.pop(c.name, None)
        else:
            name = c.name or "_".join([c.what, c.kind, *c.label, *c.keys]).lower()
            same = [n for n, o in kept.items() if (o.kind, o.entity, o.label, o.keys) == (c.kind, c.entity, c.label, c.keys)]
            if name in kept or same:
                if not c.lenient:
                    raise SemanticError(f"there is such an {c.what} already: {name if name in kept else same[0]}")
            else:
                kept[name] = c
                if c.what == "constraint":
                    try:
                        self.check(session.graph, [name])
                    except ExecutionFailed:
                        del kept[name]
                        raise
        return session.spark.createDataFrame([], "nothing string").drop("nothing")

    def show(self, session, what: str) -> DataFrame:
        kept = self.indexes if what == "index" else self.constraints
        rows = [(n, c.kind.upper(), c.entity.upper(), list(c.label), list(c.keys)) for n, c in sorted(kept.items())]
        return session.spark.createDataFrame(rows, "name string, type string, entityType string, labelsOrTypes array<string>, properties array<string>")

    def check(self, graph: Graph, names: list[str] | None = None) -> None:
        """Raise if the tables break a constraint."""
        for name in names if names is not None else list(self.constraints):
            c = self.constraints[name]
            if c.entity == "node":
                tables = [graph.nodes[k] for k in graph.tables(c.label)]
            else:
                tables = [df for k, df in graph.rels.items() if k[0] in c.label]
            if not tables:
                continue
            cols = [[(F.col(f"`{p}`") if p in df.columns else F.lit(None).cast("string")).alias(f"k{i}") for i, p in enumerate(c.keys)] for df in tables]
            rows = reduce(DataFrame.union, [df.select(*x) for df, x in zip(tables, cols, strict=True)])
            known = reduce(lambda a, b: a & b, [F.col(f"k{i}").isNotNull() for i in range(len(c.keys))])
            if c.kind in ("not_null", "key") and rows.where(~known).limit(1).count():
                raise ExecutionFailed(f"the constraint {name} asks for {', '.join(c.keys)}")
            if c.kind in ("unique", "key"):
                twice = rows.where(known).groupBy(*[f"k{i}" for i in range(len(c.keys))]).count().where("count > 1")
                if twice.limit(1).count():
                    raise ExecutionFailed(f"the constraint {name} asks that {', '.join(c.keys)} be unique")
