"""What a variable stands for while a query is planned."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..graph import LabelSet
from .types import T, Typed


@dataclass
class NodeVar:
    """A node: the column of its id; property columns once its table is joined.

    ``tables`` are the node tables it can come from.  ``props`` is None until then.
    """

    id: str
    tables: list[LabelSet]
    props: dict[str, tuple[str, T]] | None = None
    labels: str | None = None
    nullable: bool = False

    def columns(self) -> list[str]:
        return [self.id, *([self.labels] if self.labels else []), *(c for c, _ in (self.props or {}).values())]


@dataclass
class RelVar:
    id: str
    src: str
    dst: str
    type: str
    props: dict[str, tuple[str, T]] = field(default_factory=dict)
    nullable: bool = False
    kinds: tuple[str, ...] = ()

    def columns(self) -> list[str]:
        return [self.id, self.src, self.dst, self.type, *(c for c, _ in self.props.values())]


@dataclass
class ValueVar:
    col: str
    t: T

    def columns(self) -> list[str]:
        return [self.col]

    def typed(self) -> Typed:
        return Typed(F.col(self.col), self.t)


Binding = NodeVar | RelVar | ValueVar


def node_struct(v: NodeVar) -> Typed:
    props = v.props or {}
    fields = tuple((n, t) for n, (_, t) in sorted(props.items()))
    body = F.struct(*[F.col(props[n][0]).alias(n) for n, _ in fields]) if fields else F.struct(F.lit(None).cast("string").alias("_"))
    fields = fields or (("_", T("str")),)
    whole = F.struct(F.col(v.id).alias("id"), F.col(v.labels).alias("labels"), body.alias("properties"))
    return Typed(F.when(F.col(v.id).isNotNull(), whole), T("node", None, fields))


def rel_struct(v: RelVar) -> Typed:
    fields = tuple((n, t) for n, (_, t) in sorted(v.props.items()))
    body = F.struct(*[F.col(v.props[n][0]).alias(n) for n, _ in fields]) if fields else F.struct(F.lit(None).cast("string").alias("_"))
    fields = fields or (("_", T("str")),)
    whole = F.struct(F.col(v.id).alias("id"), F.col(v.src).alias("src"), F.col(v.dst).alias("dst"), F.col(v.type).alias("type"), body.alias("properties"))
    return Typed(F.when(F.col(v.id).isNotNull(), whole), T("rel", None, fields))


def same(a: Column, b: Column, nullable: bool) -> Column:
    return a.eqNullSafe(b) if nullable else a == b
