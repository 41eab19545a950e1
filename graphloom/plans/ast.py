"""Syntax trees: expressions, patterns, clauses and commands."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class Node:
    """Anything in the tree; ``children`` walks one level down."""

    def children(self) -> Iterator[Node]:
        for f in fields(self):
            yield from _nodes(getattr(self, f.name))

    def walk(self) -> Iterator[Node]:
        yield self
        for c in self.children():
            yield from c.walk()


def _nodes(x) -> Iterator[Node]:
    if isinstance(x, Node):
        yield x
    elif isinstance(x, tuple):
        for y in x:
            yield from _nodes(y)


class Expr(Node):
    pass


def _expr(name: str, spec: str):
    """An expression class whose attributes are named in ``spec``."""
    from dataclasses import make_dataclass

    return make_dataclass(name, [(n, object) for n in spec.split()], bases=(Expr,), frozen=True, namespace={"__module__": __name__})


Lit = _expr("Lit", "value")
Param = _expr("Param", "name")
Var = _expr("Var", "name")
Prop = _expr("Prop", "of key")
Index = _expr("Index", "of at")
Slice = _expr("Slice", "of low high")
Call = _expr("Call", "name args distinct star")
Bin = _expr("Bin", "op left right")
Not = _expr("Not", "of")
Neg = _expr("Neg", "of")
IsNull = _expr("IsNull", "of negated")
ListLit = _expr("ListLit", "items")
MapLit = _expr("MapLit", "items")  # ((key, expr), ...)
Case = _expr("Case", "subject arms otherwise")
ListComp = _expr("ListComp", "var of where item")
Reduce = _expr("Reduce", "acc start var of step")
Quantifier = _expr("Quantifier", "kind var of where")
HasLabels = _expr("HasLabels", "of labels")
MapProjection = _expr("MapProjection", "of items")  # ((kind, key, expr), ...)
PatternTest = _expr("PatternTest", "path")
PatternComp = _expr("PatternComp", "path where item")
Exists = _expr("Exists", "query")
CountOf = _expr("CountOf", "query")
CollectOf = _expr("CollectOf", "query")


@dataclass(frozen=True)
class NodePattern(Node):
    var: str | None
    labels: tuple[str, ...]
    props: Expr | None


@dataclass(frozen=True)
class RelPattern(Node):
    var: str | None
    types: tuple[str, ...]
    direction: str  # out, in, both
    props: Expr | None
    low: int | None = None  # None: exactly one hop
    high: int | None = None


@dataclass(frozen=True)
class Path(Node):
    var: str | None
    kind: str  # walk, shortest, all_shortest
    elements: tuple[Node, ...]


@dataclass(frozen=True)
class Item(Node):
    expr: Expr
    name: str
    aliased: bool


@dataclass(frozen=True)
class Projection(Node):
    items: tuple[Item, ...]
    star: bool
    distinct: bool
    order: tuple[tuple[Expr, bool], ...]
    skip: Expr | None
    limit: Expr | None
    where: Expr | None = None
    final: bool = False
    where_last: bool = False


@dataclass(frozen=True)
class Match(Node):
    paths: tuple[Path, ...]
    where: Expr | None
    optional: bool
    clauses: tuple[int, ...] = ()  # of each path, where several clauses were made one (see ``order``); -1: a node must exist


@dataclass(frozen=True)
class Unwind(Node):
    of: Expr
    var: str


@dataclass(frozen=True)
class Create(Node):
    paths: tuple[Path, ...]


@dataclass(frozen=True)
class SetItem(Node):
    kind: str  # prop, replace, merge, labels
    target: Expr
    key: str | None
    value: Expr | None
    labels: tuple[str, ...] = ()


@dataclass(frozen=True)
class SetClause(Node):
    items: tuple[SetItem, ...]


@dataclass(frozen=True)
class Remove(Node):
    items: tuple[SetItem, ...]


@dataclass(frozen=True)
class Merge(Node):
    path: Path
    on_create: tuple[SetItem, ...]
    on_match: tuple[SetItem, ...]


@dataclass(frozen=True)
class Delete(Node):
    targets: tuple[Expr, ...]
    detach: bool


@dataclass(frozen=True)
class Foreach(Node):
    var: str
    of: Expr
    body: tuple[Node, ...]


@dataclass(frozen=True)
class CallQuery(Node):
    query: Query
    imports: tuple[str, ...] | None  # None: a leading WITH says it
    all_: bool = False


@dataclass(frozen=True)
class CallProcedure(Node):
    name: str
    args: tuple[Expr, ...]
    yields: tuple[tuple[str, str], ...] | None
    where: Expr | None


@dataclass(frozen=True)
class Query(Node):
    arms: tuple[tuple[Node, ...], ...]
    keep_all: bool = True


@dataclass(frozen=True)
class Command:
    """A schema command."""

    action: str  # create, drop, show
    what: str  # index, constraint
    kind: str = ""
    name: str | None = None
    entity: str = "node"
    label: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()
    lenient: bool = False
    options: dict = field(default_factory=dict)
