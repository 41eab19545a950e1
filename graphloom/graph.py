"""The property graph: one table for each label set and one for each kind of relationship.

A node table has ``id`` and typed properties; a relationship table has ``id, src, dst`` and
properties, and stands for one (type, label set of the source, label set of the target).
So a pattern's labels choose tables when it is planned, and the end of a hop need not be
joined to its node table unless a property of it is read.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LabelSet = frozenset
RelKey = tuple[str, LabelSet, LabelSet]


@dataclass
class Graph:
    """A snapshot; updates make a new one (``replace``) and never change tables in place."""

    spark: SparkSession
    nodes: dict[LabelSet, DataFrame] = field(default_factory=dict)
    rels: dict[RelKey, DataFrame] = field(default_factory=dict)

    def copy(self) -> Graph:
        return replace(self, nodes=dict(self.nodes), rels=dict(self.rels))

    def add_nodes(self, labels: Iterable[str] | str, df: DataFrame) -> Graph:
        """Register a node table (``id`` and properties)."""
        key = LabelSet([labels] if isinstance(labels, str) else labels)
        df = df.withColumn("id", F.col("id").cast("long"))
        self.nodes[key] = self.nodes[key].unionByName(df, allowMissingColumns=True) if key in self.nodes else df
        return self

    def add_rels(self, kind: str, src: Iterable[str] | str, dst: Iterable[str] | str, df: DataFrame) -> Graph:
        """Register a relationship table (``id, src, dst`` and properties)."""
        ends = [LabelSet([x] if isinstance(x, str) else x) for x in (src, dst)]
        key = (kind, ends[0], ends[1])
        df = df.withColumns({c: F.col(c).cast("long") for c in ("id", "src", "dst")})
        self.rels[key] = self.rels[key].unionByName(df, allowMissingColumns=True) if key in self.rels else df
        return self

    def tables(self, labels: Iterable[str] = ()) -> list[LabelSet]:
        """The node tables whose label set holds all of ``labels``."""
        want = set(labels)
        return [k for k in self.nodes if want <= k]

    def labels(self) -> list[str]:
        return sorted({x for k in self.nodes for x in k})

    def types(self) -> list[str]:
        return sorted({k[0] for k in self.rels})

    def property_keys(self) -> list[str]:
        out = {c for df in self.nodes.values() for c in df.columns} | {c for df in self.rels.values() for c in df.columns}
        return sorted(out - {"id", "src", "dst"})
