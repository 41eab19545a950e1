"""Lowering of clauses to DataFrames.

Rows in flight are one DataFrame with uniquely named columns and a scope that says which
columns a variable stands for.  A node is only its id until a property or its labels are
read; then its table is joined once.  Everything stays lazy: a query is one DataFrame.

Subqueries are decorrelated: they are planned once for all outer rows, keyed by the ids or
values they take from outside, and joined back (semi join, anti join, or left join with a
count or list).
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import ArgumentError, NotSupported, SemanticError
from ..functions import compare as C
from ..functions import scalar
from ..functions.temporal import component
from ..graph import Graph, LabelSet
from ..operators import paths as P
from ..storage import staged
from . import ast as A
from . import order
from .scope import Binding, NodeVar, RelVar, ValueVar, node_struct, rel_struct
from .types import BOOL, ENTITY, FLOAT, INT, NULL, NUMBER, STR, TEMPORAL, T, Typed, coerce, from_spark, join_types, list_of, nothing, to_spark

AGGREGATES = {"count", "sum", "avg", "min", "max", "collect", "stdev", "stdevp", "percentilecont", "percentiledisc"}


class Names:
    """Fresh column names, unique within a session."""

    n = 0

    @classmethod
    def new(cls, hint: str = "c") -> str:
        cls.n += 1
        return f"_{hint}{cls.n}"


def conjuncts(e) -> list:
    if e is None:
        return []
    return conjuncts(e.left) + conjuncts(e.right) if isinstance(e, A.Bin) and e.op == "AND" else [e]


def free(e) -> set[str]:
    """Variables an expression or clause may take from outside (bound ones inside included where harmless)."""
    out: set[str] = set()
    if isinstance(e, tuple):
        for x in e:
            out |= free(x)
        return out
    if not isinstance(e, A.Node):
        return out
    if isinstance(e, A.Var):
        return {e.name}
    if isinstance(e, (A.ListComp, A.Quantifier)):
        inner = free(e.where) | (free(e.item) if isinstance(e, A.ListComp) else set())
        return free(e.of) | (inner - {e.var})
    if isinstance(e, A.Reduce):
        return free(e.start) | free(e.of) | (free(e.step) - {e.acc, e.var})
    if isinstance(e, (A.NodePattern, A.RelPattern)):
        return ({e.var} if e.var else set()) | free(e.props)
    for c in e.children():
        out |= free(c)
    return out


def is_aggregate(e) -> bool:
    return isinstance(e, A.Call) and e.name in AGGREGATES


def has_aggregate(e) -> bool:
    if not isinstance(e, A.Node) or isinstance(e, (A.Exists, A.CountOf, A.CollectOf)):
        return False
    return is_aggregate(e) or any(has_aggregate(c) for c in e.children())


def has_subquery(e) -> bool:
    return any(isinstance(n, (A.Exists, A.CountOf, A.CollectOf, A.PatternTest, A.PatternComp)) for n in e.walk())


def only_counts(clauses: tuple) -> bool:
    """MATCH clauses and then ``count(*)``, of all rows or of groups."""
    last = clauses[-1]
    if not isinstance(last, A.Projection) or last.star:
        return False
    exprs = [*(i.expr for i in last.items), *(e for e, _ in last.order)]
    calls = [n for e in exprs for n in e.walk() if is_aggregate(n)]
    return (
        all(isinstance(c, A.Match) for c in clauses[:-1])
        and len(clauses) > 1
        and any(has_aggregate(i.expr) for i in last.items)
        and all(n == A.Call("count", (), False, True) for n in calls)
        and not any(has_subquery(e) for e in exprs)
        and not any(p.var for c in clauses[:-1] for p in c.paths)
    )


class Rows:
    """The rows of a query at some clause."""

    def __init__(self, graph: Graph, params: dict, df: DataFrame | None = None, scope: dict[str, Binding] | None = None, corr: list[str] | None = None):
        self.graph, self.params = graph, params
        self.df = df
        self.scope: dict[str, Binding] = dict(scope or {})
        #: Key columns of the outer rows, kept through every clause of a subquery.
        self.corr = list(corr or [])
        self.base: DataFrame | None = None
        self.session = None
        #: Whether the rows are those of a CALL { } that updates the graph.
        self.updating = False
        self.closed: set[str] | None = None
        #: Set where the query only counts rows: then equal rows are kept once, with a weight.
        self.folding = False
        self.weight: str | None = None
        self.later: set[str] = set()

    #: Turn off to compare the folded plan with the plain one.
    fold_counts = True
    #: Turn off to take hops as written.
    order_hops = True

    def like(self, df: DataFrame | None, scope: dict[str, Binding]) -> Rows:
        out = Rows(self.graph, self.params, df, scope, self.corr)
        out.base, out.session, out.updating = self.base, self.session, self.updating
        return out

    def frame(self) -> DataFrame:
        """The rows; a single empty one before the first clause."""
        if self.df is None:
            self.df = self.graph.spark.range(1).select(F.lit(1).alias(Names.new("unit")))
        return self.df

    # --- entities

    def node_table(self, tables: list[LabelSet], with_props: bool = True) -> tuple[DataFrame, NodeVar]:
        """A scan of node tables under fresh names."""
        v = NodeVar(Names.new("n"), tables, {}, Names.new("l"))
        types: dict[str, T] = {}
        for k in tables:
            for f in self.graph.nodes[k].schema.fields:
                if f.name != "id":
                    t = from_spark(f.dataType)
                    types[f.name] = t if f.name not in types else (join_types(types[f.name], t) or STR)
        v.props = {n: (Names.new("p"), t) for n, t in types.items()}
        parts = []
        for k in tables:
            df = self.graph.nodes[k]
            own = {f.name: from_spark(f.dataType) for f in df.schema.fields}
            cols = [F.col("id").alias(v.id), F.array(*[F.lit(x) for x in sorted(k)]).cast("array<string>").alias(v.labels)]
            for n, (c, t) in v.props.items():
                if n not in own:
                    cols.append(F.lit(None).cast(to_spark(t)).alias(c))
                elif own[n] == t:
                    cols.append((F.col(f"`{n}`").cast("double") if t == FLOAT else F.col(f"`{n}`").cast("bigint") if t == INT else F.col(f"`{n}`")).alias(c))
                else:
                    x = Typed(F.col(f"`{n}`"), own[n])
                    cols.append((coerce(x, t) if join_types(own[n], t) == t else x.col.cast("string")).alias(c))
            parts.append(df.select(*cols))
        if not parts:
            empty = self.graph.spark.range(0).select(F.col("id").alias(v.id), F.array().cast("array<string>").alias(v.labels))
            return empty, v
        return reduce(DataFrame.union, parts), v

    def hydrate(self, name: str) -> NodeVar:
        """Join a node variable's table, once."""
        v = self.scope[name]
        if v.props is not None:
            return v
        table, new = self.node_table(v.tables)
        cond = F.col(v.id) == F.col(new.id)
        self.df = self.frame().join(table, cond, "left" if v.nullable else "inner").drop(new.id)
        out = replace(new, id=v.id, nullable=v.nullable)
        for k, b in self.scope.items():
            if isinstance(b, NodeVar) and b.id == v.id:
                self.scope[k] = out
        return out

    # --- expressions

    def expr(self, e, env: dict[str, Typed] | None = None) -> Typed:
        env = env or {}
        build = getattr(self, "x_" + type(e).__name__.lower(), None)
        if build is None:
            raise NotSupported(type(e).__name__)
        return build(e, env)

    def test(self, e, env=None) -> Column:
        return C.truth(self.expr(e, env))

    def x_lit(self, e, env):
        return self.literal(e.value)

    def literal(self, v) -> Typed:
        if v is None:
            return nothing()
        if isinstance(v, bool):
            return Typed(F.lit(v), BOOL, v)
        if isinstance(v, int):
            if not -(1 << 63) <= v < 1 << 63:
                raise ArgumentError(f"{v} is no 64-bit integer")
            return Typed(F.lit(v).cast("bigint"), INT, v)
        if isinstance(v, float):
            return Typed(F.lit(v), FLOAT, v)
        if isinstance(v, str):
            return Typed(F.lit(v), STR, v)
        if isinstance(v, (list, tuple)):
            items = [self.literal(x) for x in v]
            out = self.make_list(items)
            return Typed(out.col, out.t, list(v))
        if isinstance(v, dict):
            return self.make_map([(k, self.literal(x)) for k, x in v.items()])
        import datetime

        if isinstance(v, datetime.datetime):
            return Typed(F.lit(v), T("datetime" if v.tzinfo else "localdatetime"), v) if v.tzinfo else Typed(F.lit(v).cast("timestamp_ntz"), T("localdatetime"), v)
        if isinstance(v, datetime.date):
            return Typed(F.lit(v), T("date"), v)
        raise ArgumentError(f"a parameter of type {type(v).__name__}")

    def x_param(self, e, env):
        if e.name not in self.params:
            raise ArgumentError(f"the parameter ${e.name} is not given")
        return self.literal(self.params[e.name])

    def x_var(self, e, env):
        if e.name in env:
            return env[e.name]
        if e.name not in self.scope:
            raise SemanticError(f"the variable {e.name} is not defined")
        v = self.scope[e.name]
        if isinstance(v, NodeVar):
            return node_struct(self.hydrate(e.name))
        return rel_struct(v) if isinstance(v, RelVar) else v.typed()

    def entity(self, e, env) -> NodeVar | RelVar | None:
        if isinstance(e, A.Var) and e.name not in env:
            v = self.scope.get(e.name)
            return v if isinstance(v, (NodeVar, RelVar)) else None
        return None

    def x_prop(self, e, env):
        v = self.entity(e.of, env)
        if v is not None:
            if isinstance(v, NodeVar):
                v = self.hydrate(e.of.name)
            found = v.props.get(e.key)
            return Typed(F.col(found[0]), found[1]) if found else nothing()
        return self.get(self.expr(e.of, env), e.key)

    def get(self, x: Typed, key: str) -> Typed:
        k = x.t.kind
        if k == "null":
            return nothing()
        if k in ENTITY:
            t = x.t.field(key)
            return Typed(x.col["properties"][key], t) if t else nothing()
        if k == "map" and x.t.fields is not None:
            t = x.t.field(key)
            return Typed(x.col[key], t) if t else nothing()
        if k == "map":
            return Typed(F.try_element_at(x.col, F.lit(key)), x.t.elem)
        if k in (*TEMPORAL, "duration"):
            return component(x, key)
        raise ArgumentError(f"{x.t} has no properties")

    def x_index(self, e, env):
        v = self.entity(e.of, env)
        at = self.expr(e.at, env)
        if v is not None and isinstance(at.value, str):
            return self.x_prop(A.Prop(e.of, at.value), env)
        x = self.expr(e.of, env)
        if "null" in (x.t.kind, at.t.kind):
            return nothing()
        if at.t.kind == "str":
            if isinstance(at.value, str):
                return self.get(x, at.value)
            if x.t.kind == "map" and x.t.fields is None:
                return Typed(F.try_element_at(x.col, at.col), x.t.elem)
            props, fields = scalar.property_struct(x)
            t = reduce(lambda a, b: a and join_types(a, b[1]), fields, NULL)
            if t is None:
                t = STR
            out = F.lit(None).cast(to_spark(t))
            for n, ft in fields:
                value = Typed(props[n], ft)
                out = F.when(at.col == n, coerce(value, t) if join_types(ft, t) == t else value.col.cast("string")).otherwise(out)
            return Typed(out, t)
        if x.t.kind != "list" or at.t.kind != "int":
            raise ArgumentError(f"cannot index {x.t} by {at.t}")
        place = F.when(at.col >= 0, at.col + 1).otherwise(at.col).cast("int")
        return Typed(F.try_element_at(x.col, place), x.t.elem)

    def x_slice(self, e, env):
        x = self.expr(e.of, env)
        low = self.expr(e.low, env) if e.low is not None else None
        high = self.expr(e.high, env) if e.high is not None else None
        if x.t.kind == "null" or any(b is not None and b.t.kind == "null" for b in (low, high)):
            return nothing()
        n = F.size(x.col)
        clamp = lambda b: F.greatest(F.least(F.when(b.col < 0, b.col + n).otherwise(b.col), n), F.lit(0))
        a = clamp(low) if low else F.lit(0)
        b = clamp(high) if high else n
        return Typed(F.when(a.isNotNull() & b.isNotNull(), F.slice(x.col, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))), x.t)

    def make_list(self, items: list[Typed]) -> Typed:
        t = NULL
        for x in items:
            j = join_types(t, x.t)
            if j is None:
                raise NotSupported(f"a list that mixes {t} and {x.t}")
            t = j
        if not items:
            return Typed(F.array().cast("array<string>"), list_of(NULL))
        return Typed(F.array(*[coerce(x, t) for x in items]), list_of(t))

    def x_listlit(self, e, env):
        items = [self.expr(x, env) for x in e.items]
        out = self.make_list(items)
        if all(isinstance(x, A.Lit) for x in e.items):
            out.value = [x.value for x in e.items]
        return out

    def make_map(self, items: list[tuple[str, Typed]]) -> Typed:
        known = dict(items)
        if not known:
            return Typed(F.struct(F.lit(None).cast("string").alias("_")), T("map", None, ()))
        return Typed(F.struct(*[coerce(x, x.t).alias(k) if x.t.kind != "null" else F.lit(None).cast("string").alias(k) for k, x in known.items()]), T("map", None, tuple((k, x.t) for k, x in known.items())))

    def x_maplit(self, e, env):
        items = [(k, self.expr(x, env)) for k, x in e.items]
        out = self.make_map(items)
        if items and all(isinstance(x.value, (int, float, str)) for _, x in items):
            out.value = {k: x.value for k, x in items}
        return out

    def x_mapprojection(self, e, env):
        out: dict[str, Typed] = {}
        for kind, key, value in e.items:
            if kind == "all":
                x = self.expr(e.of, env)
                props, fields = scalar.property_struct(x)
                for n, t in fields:
                    out[n] = Typed(props[n], t)
            elif kind == "prop":
                out[key] = self.x_prop(A.Prop(e.of, key), env)
            else:
                out[key] = self.expr(value, env)
        made = self.make_map(list(out.items()))
        v = self.entity(e.of, env)
        known = F.col(v.id).isNotNull() if v is not None else self.expr(e.of, env).col.isNotNull()
        return Typed(F.when(known, made.col), made.t)

    def x_not(self, e, env):
        return Typed(~C.truth(self.expr(e.of, env)), BOOL)

    def x_neg(self, e, env):
        x = self.expr(e.of, env)
        if x.t.kind == "null":
            return x
        if x.t.kind == "duration":
            return C.arithmetic("*", x, self.literal(-1))
        if x.t.kind not in NUMBER:
            raise ArgumentError(f"cannot negate {x.t}")
        return Typed(-x.col, x.t)

    def x_isnull(self, e, env):
        v = self.entity(e.of, env)
        col = F.col(v.id) if v is not None else self.expr(e.of, env).col
        return Typed(col.isNotNull() if e.negated else col.isNull(), BOOL)

    def x_bin(self, e, env):
        op = e.op
        if op in ("AND", "OR", "XOR"):
            a, b = self.test(e.left, env), self.test(e.right, env)
            return Typed({"AND": a & b, "OR": a | b, "XOR": a != b}[op], BOOL)
        if op in ("=", "<>"):
            va, vb = self.entity(e.left, env), self.entity(e.right, env)
            if va is not None and vb is not None:  # entities are equal by id; no table is needed
                out = F.col(va.id) == F.col(vb.id) if type(va) is type(vb) else C.both_known(F.col(va.id), F.col(vb.id), F.lit(False))
            else:
                out = C.equal(self.expr(e.left, env), self.expr(e.right, env))
            return Typed(out if op == "=" else ~out, BOOL)
        a, b = self.expr(e.left, env), self.expr(e.right, env)
        if op in ("<", "<=", ">", ">="):
            return Typed(C.less(op, a, b), BOOL)
        if op == "IN":
            return Typed(C.contained(a, b), BOOL)
        if op in ("STARTS WITH", "ENDS WITH", "CONTAINS"):
            return Typed(C.text_test(op, a, b), BOOL)
        if op == "=~":
            return Typed(C.full_match(a, b), BOOL)
        return C.arithmetic(op, a, b)

    def x_case(self, e, env):
        arms, values = [], []
        subject = self.expr(e.subject, env) if e.subject is not None else None
        for test, value in e.arms:
            arms.append(C.equal(subject, self.expr(test, env)) if subject is not None else self.test(test, env))
            values.append(self.expr(value, env))
        values.append(self.expr(e.otherwise, env) if e.otherwise is not None else nothing())
        t = NULL
        for x in values:
            j = join_types(t, x.t)
            if j is None:
                raise NotSupported(f"a CASE that mixes {t} and {x.t}")
            t = j
        if t == NULL:
            return nothing()
        out = None
        for test, x in zip(arms, values, strict=False):
            out = F.when(test, coerce(x, t)) if out is None else out.when(test, coerce(x, t))
        return Typed(out.otherwise(coerce(values[-1], t)), t)

    def _list(self, e, env) -> Typed | None:
        x = self.expr(e, env)
        if x.t.kind not in ("list", "null"):
            raise ArgumentError(f"a list is needed, not {x.t}")
        return None if x.t.kind == "null" else x

    def x_listcomp(self, e, env):
        x = self._list(e.of, env)
        if x is None:
            return nothing()
        self.settle([e.where, e.item], {**env, e.var: Typed(F.lit(None), x.t.elem)})
        col = x.col
        if e.where is not None:
            col = F.filter(col, lambda v: self.test(e.where, {**env, e.var: Typed(v, x.t.elem)}))
        if e.item is None:
            return Typed(col, x.t)
        seen: list[T] = []

        def item(v):
            y = self.expr(e.item, {**env, e.var: Typed(v, x.t.elem)})
            seen.append(y.t)
            return y.col if y.t.kind != "null" else F.lit(None).cast("string")

        col = F.transform(col, item)
        return Typed(col, list_of(seen[-1]))

    def settle(self, exprs, env) -> None:
        """Join the tables that lambda bodies read before the lambda is built."""
        for e in exprs:
            for n in e.walk() if e is not None else ():
                if isinstance(n, A.Prop) and isinstance(n.of, A.Var) and n.of.name not in env and isinstance(self.scope.get(n.of.name), NodeVar):
                    self.hydrate(n.of.name)

    def x_reduce(self, e, env):
        start, x = self.expr(e.start, env), self._list(e.of, env)
        if x is None:
            return nothing()
        probe = self.expr(e.step, {**env, e.acc: start, e.var: Typed(F.lit(None), x.t.elem)})
        t = join_types(start.t, probe.t)
        if t is None:
            raise NotSupported(f"a reduce from {start.t} to {probe.t}")
        return Typed(F.aggregate(x.col, coerce(start, t), lambda a, v: coerce(self.expr(e.step, {**env, e.acc: Typed(a, t), e.var: Typed(v, x.t.elem)}), t)), t)

    def x_quantifier(self, e, env):
        x = self._list(e.of, env)
        if x is None:
            return Typed(F.lit(None).cast("boolean"), BOOL)
        self.settle([e.where], {**env, e.var: Typed(F.lit(None), x.t.elem)})
        test = lambda v: self.test(e.where, {**env, e.var: Typed(v, x.t.elem)})
        if e.kind == "any":
            return Typed(F.exists(x.col, test), BOOL)
        if e.kind == "all":
            return Typed(F.forall(x.col, test), BOOL)
        if e.kind == "none":
            return Typed(~F.exists(x.col, test), BOOL)
        sure = F.size(F.filter(x.col, test))
        open_ = F.size(F.filter(x.col, lambda v: test(v).isNull()))
        return Typed(F.when(x.col.isNull(), F.lit(None).cast("boolean")).when(sure > 1, F.lit(False)).when(open_ > 0, F.lit(None).cast("boolean")).otherwise(sure == 1), BOOL)

    def x_haslabels(self, e, env):
        v = self.entity(e.of, env)
        if isinstance(v, RelVar):
            return Typed(reduce(lambda a, b: a & b, [F.col(v.type) == x for x in e.labels]), BOOL)
        if isinstance(v, NodeVar):
            fits = [set(e.labels) <= k for k in v.tables]
            if all(fits) or not any(fits):  # the tables decide
                return Typed(F.when(F.col(v.id).isNotNull(), F.lit(bool(fits) and all(fits))), BOOL)
            col = F.col(self.hydrate(e.of.name).labels)
        else:
            x = self.expr(e.of, env)
            if x.t.kind == "null":
                return Typed(F.lit(None).cast("boolean"), BOOL)
            if x.t.kind == "rel":
                return Typed(reduce(lambda a, b: a & b, [x.col["type"] == n for n in e.labels]), BOOL)
            col = x.col["labels"]
        return Typed(reduce(lambda a, b: a & b, [F.array_contains(col, x) for x in e.labels]), BOOL)

    def x_call(self, e, env):
        if e.name in AGGREGATES:
            raise SemanticError(f"{e.name} is an aggregate and may not stand here")
        if e.name not in scalar.FUNCTIONS and e.name not in ("startnode", "endnode"):
            raise SemanticError(f"there is no function {e.name}")
        if e.distinct or e.star:
            raise SemanticError(f"{e.name} takes neither DISTINCT nor *")
        v = self.entity(e.args[0], env) if e.args else None
        if v is not None:
            if e.name == "id":
                return Typed(F.col(v.id), INT)
            if e.name == "elementid":
                return Typed(F.concat(F.lit("n:" if isinstance(v, NodeVar) else "r:"), F.col(v.id).cast("string")), STR)
            if e.name == "type" and isinstance(v, RelVar):
                return Typed(F.col(v.type), STR)
            if e.name == "labels" and isinstance(v, NodeVar):
                return Typed(F.col(self.hydrate(e.args[0].name).labels), list_of(STR))
        if e.name in ("startnode", "endnode"):
            x = self.expr(e.args[0], env)
            if x.t.kind == "null":
                return nothing()
            if x.t.kind != "rel":
                raise ArgumentError(f"{e.name} cannot take {x.t}")
            name = Names.new("end")
            self.df = self.frame().withColumn(name, x.col["src" if e.name == "startnode" else "dst"])
            self.scope[name] = NodeVar(name, list(self.graph.nodes), nullable=True)
            return node_struct(self.hydrate(name))
        return scalar.apply(e.name, [self.expr(a, env) for a in e.args])

    # --- subquery expressions

    def outside(self, e) -> list[str]:
        return sorted(n for n in free(e) if n in self.scope)

    def drive(self, names: list[str]) -> tuple[Rows, list[tuple[str, str, bool]]]:
        """Distinct outer values as the first rows of a subquery; pairs of outer and inner key columns."""
        keys, scope, cols = [], {}, []
        for n in names:
            v = self.scope[n]
            fresh = {c: Names.new("k") for c in ([v.id] if isinstance(v, NodeVar) else v.columns())}
            cols += [F.col(a).alias(b) for a, b in fresh.items()]
            if isinstance(v, NodeVar):
                scope[n] = NodeVar(fresh[v.id], v.tables, None, None, v.nullable)
                keys.append((v.id, fresh[v.id], v.nullable))
            elif isinstance(v, RelVar):
                scope[n] = RelVar(fresh[v.id], fresh[v.src], fresh[v.dst], fresh[v.type], {p: (fresh[c], t) for p, (c, t) in v.props.items()}, v.nullable, v.kinds)
                keys.append((v.id, fresh[v.id], v.nullable))
            else:
                scope[n] = ValueVar(fresh[v.col], v.t)
                keys.append((v.col, fresh[v.col], True))
        for c in self.corr:
            f = Names.new("k")
            cols.append(F.col(c).alias(f))
            keys.append((c, f, True))
        inner = Rows(self.graph, self.params, None, scope)
        inner.session = self.session
        if cols:
            inner.df = self.frame().select(*cols).dropDuplicates([k[1] for k in keys])
            inner.corr = [k[1] for k in keys]
            inner.base = inner.df.select(*inner.corr)
        return inner, keys

    def pattern_rows(self, match: A.Match) -> tuple[Rows, list[tuple[str, str, bool]]]:
        """The matches of a subquery pattern, with the keys that tie them to the outer rows.

        A pattern that only takes nodes from outside, each at a fixed hop, is matched on its own
        tables; else it is driven by the distinct outer values.
        """
        names = self.outside(match)
        hops = {n.var for p in match.paths for n in p.elements if len(p.elements) > 1 and p.kind == "walk" and all(r.low is None for r in p.elements[1::2]) and isinstance(n, A.NodePattern)}
        if names and not self.corr and all(isinstance(self.scope[n], NodeVar) and n in hops for n in names):
            inner = Rows(self.graph, self.params)
            inner.session = self.session
            given = {n: self.scope[n].tables for n in names}
            inner.match(replace(match, optional=False), given)
            return inner, [(self.scope[n].id, inner.scope[n].id, self.scope[n].nullable) for n in names]
        inner, keys = self.drive(names)
        inner.match(replace(match, optional=False))
        return inner, keys

    def query_rows(self, q: A.Query) -> tuple[Rows, list[tuple[str, str, bool]]]:
        if len(q.arms) == 1 and len(q.arms[0]) == 1 and isinstance(q.arms[0][0], A.Match):
            return self.pattern_rows(q.arms[0][0])
        inner, keys = self.drive(self.outside(q))
        return inner.run(q), keys

    def _on(self, keys) -> Column:
        return reduce(lambda a, b: a & b, [(F.col(o).eqNullSafe(F.col(i)) if null else F.col(o) == F.col(i)) for o, i, null in keys], F.lit(True))

    def _attach(self, inner: DataFrame, keys, col: str) -> Column:
        """Left join one value for each outer key (null where there is none)."""
        if keys:
            self.df = self.frame().join(inner, self._on(keys), "left").drop(*[i for _, i, _ in keys])
        else:
            self.df = self.frame().crossJoin(F.broadcast(inner))  # one row
        return F.col(col)

    def _count(self, q: A.Query) -> Column:
        inner, keys = self.query_rows(q)
        name = Names.new("cnt")
        if keys:
            counted = inner.df.groupBy(*[i for _, i, _ in keys]).agg(F.count(F.lit(1)).alias(name))
        else:
            counted = inner.frame().agg(F.count(F.lit(1)).alias(name))
        return F.coalesce(self._attach(counted, keys, name), F.lit(0).cast("bigint"))

    def x_countof(self, e, env):
        return Typed(self._count(e.query), INT)

    def x_exists(self, e, env):
        inner, keys = self.query_rows(e.query)
        if not keys:
            return Typed(self._count(e.query) > 0, BOOL)
        name = Names.new("some")
        flags = inner.df.select(*[i for _, i, _ in keys]).distinct().withColumn(name, F.lit(True))
        return Typed(F.coalesce(self._attach(flags, keys, name), F.lit(False)), BOOL)

    def x_patterntest(self, e, env):
        return self.x_exists(A.Exists(A.Query(((A.Match((e.path,), None, False),),))), env)

    def x_collectof(self, e, env):
        inner, keys = self.query_rows(e.query)
        (value,) = [v for n, v in inner.scope.items()]
        x = inner.expr(A.Var(next(iter(inner.scope))))
        return self._collected(inner, keys, x)

    def x_patterncomp(self, e, env):
        inner, keys = self.pattern_rows(A.Match((e.path,), e.where, False))
        return self._collected(inner, keys, inner.expr(e.item))

    def _collected(self, inner: Rows, keys, x: Typed) -> Typed:
        name, item = Names.new("list"), Names.new("item")
        t = x.t if x.t.kind != "null" else STR
        rows = inner.frame().withColumn(item, x.col if x.t.kind != "null" else F.lit(None).cast("string"))
        whole = F.collect_list(F.struct(F.col(item).alias("v")))  # keeps nulls, as a comprehension does
        agg = rows.groupBy(*[i for _, i, _ in keys]).agg(whole.alias(name)) if keys else rows.agg(whole.alias(name))
        col = self._attach(agg, keys, name)
        return Typed(F.coalesce(F.transform(col, lambda s: s["v"]), F.array().cast(to_spark(list_of(t)))), list_of(x.t))

    def keep_if(self, e) -> None:
        """Filter by one conjunct; subqueries become semi and anti joins."""
        negated, inner_e = False, e
        while isinstance(inner_e, A.Not):
            negated, inner_e = not negated, inner_e.of
        query = None
        if isinstance(inner_e, A.Exists):
            query = inner_e.query
        elif isinstance(inner_e, A.PatternTest):
            query = A.Query(((A.Match((inner_e.path,), None, False),),))
        if query is not None:
            inner, keys = self.query_rows(query)
            if keys:
                right = inner.df.select(*[i for _, i, _ in keys])
                self.df = self.frame().join(right, self._on(keys), "left_anti" if negated else "left_semi")
                return
        test = self.test(e)  # may join tables first
        self.df = self.frame().where(test)

    def filter(self, e) -> None:
        parts = conjuncts(e)
        for p in [*(p for p in parts if not has_subquery(p)), *(p for p in parts if has_subquery(p))]:
            self.check(p)
            self.keep_if(p)

    def check(self, e, env: set[str] = frozenset()) -> None:
        """Refuse unknown variables and functions before anything is read."""
        for n in sorted(free(e)):
            if n not in self.scope and n not in env and not has_subquery(e):
                raise SemanticError(f"the variable {n} is not defined")
        for n in e.walk():
            if isinstance(n, A.Call) and n.name not in AGGREGATES and n.name not in scalar.FUNCTIONS and n.name not in ("startnode", "endnode"):
                raise SemanticError(f"there is no function {n.name}")

    # --- clauses

    def run(self, q: A.Query) -> Rows:
        arms = []
        for clauses in q.arms:
            rows = self.like(self.df, self.scope)
            rows.closed = self.closed
            rows.reach = getattr(self, "reach", False)
            rows.folding = self.fold_counts and not self.scope and not self.corr and only_counts(clauses)
            if self.order_hops and not self.scope and not self.corr and self.df is None:
                clauses = order.arranged(self.graph, clauses, rows.folding)
            for i, c in enumerate(clauses):
                rows.later = {n for x in clauses[i + 1 :] for n in free(x)}
                rows.clause(c)
            arms.append(rows)
        if len(arms) == 1:
            return arms[0]
        names = list(arms[0].scope)
        if any(list(a.scope) != names for a in arms):
            raise SemanticError("the arms of a UNION must return the same columns")
        out = self.like(None, {})
        frames, kinds = [], []
        values = [{n: a.expr(A.Var(n)) for n in names} for a in arms]
        for n in names:
            t = NULL
            for v in values:
                j = join_types(t, v[n].t)
                if j is None:
                    raise NotSupported(f"a UNION that mixes {t} and {v[n].t}")
                t = j
            kinds.append(t)
        cols = [Names.new("u") for _ in names]
        corr = [Names.new("k") for _ in self.corr]
        for a, v in zip(arms, values, strict=True):
            frames.append(a.df.select(*[F.col(c).alias(k) for c, k in zip(a.corr, corr, strict=True)], *[(coerce(v[n], t) if t != NULL else F.lit(None).cast("string")).alias(c) for n, t, c in zip(names, kinds, cols, strict=True)]))
        df = reduce(DataFrame.union, frames)
        df = df.select(*[F.col(k).alias(c) for c, k in zip(self.corr, corr, strict=True)], *cols)
        out.df = df if q.keep_all else df.distinct()
        out.scope = {n: ValueVar(c, t) for n, c, t in zip(names, cols, kinds, strict=True)}
        return out

    def clause(self, c) -> None:
        name = type(c).__name__.lower()
        if name in ("create", "merge", "setclause", "remove", "delete", "foreach"):
            if self.session is None or (self.corr and not self.updating):
                raise NotSupported(f"{name} inside a subquery")
            from ..operators import writes

            writes.apply(self, c)
            return
        getattr(self, {"match": "match", "unwind": "unwind", "projection": "project", "callquery": "call", "callprocedure": "procedure"}[name])(c)

    def unwind(self, c: A.Unwind) -> None:
        self.check(c.of)
        x = self.expr(c.of)
        if x.t.kind not in ("list", "null"):
            x = Typed(F.array(x.col), list_of(x.t))
        col = Names.new("u")
        if x.t.kind == "null":
            self.df = self.frame().withColumn(col, F.lit(None).cast("string")).where(F.lit(False))
            self.scope[c.var] = ValueVar(col, NULL)
            return
        if isinstance(x.value, list) and x.value and isinstance(x.value[0], dict):
            self.scope[c.var] = self._unwind_rows(x.value, col)
            return
        self.df = self.frame().withColumn(col, F.explode(x.col))
        self.bind_value(c.var, col, x.t.elem)

    def _unwind_rows(self, rows: list, col: str) -> ValueVar:
        """A list of maps given as a parameter is a table; it need not become one literal."""
        typed = [self.literal(r) for r in rows[:1]]
        del typed
        t = NULL
        for r in rows:
            t = join_types(t, self.literal(r).t)
            if t is None:
                raise NotSupported("rows whose fields mix types")
        from pyspark.sql.types import StructType

        full = [tuple(float(r[n]) if ft == FLOAT and r.get(n) is not None else r.get(n) for n, ft in t.fields) for r in rows]
        schema = StructType.fromDDL(", ".join(f"`{n}` {to_spark(ft)}" for n, ft in t.fields))
        table = self.graph.spark.createDataFrame(full, schema)
        table = table.select(F.struct(*[F.col(f"`{n}`") for n, _ in t.fields]).alias(col))
        self.df = table if self.df is None and not self.scope else self.frame().crossJoin(table)
        return ValueVar(col, t)

    def bind_value(self, name: str, col: str, t: T) -> None:
        """A node that comes as a value is a variable again, so patterns can start from it."""
        if t.kind == "node":
            idc, lab = Names.new("n"), Names.new("l")
            props = {n: (Names.new("p"), ft) for n, ft in t.fields or ()}
            self.df = self.frame().withColumns({idc: F.col(col)["id"], lab: F.col(col)["labels"], **{c: F.col(col)["properties"][n] for n, (c, _) in props.items()}})
            self.scope[name] = NodeVar(idc, list(self.graph.nodes), props, lab, True)
        else:
            self.scope[name] = ValueVar(col, t)

    # --- patterns

    def match(self, c: A.Match, given: dict[str, list[LabelSet]] | None = None) -> None:
        for e in conjuncts(c.where):
            names = {n.var for p in c.paths for n in p.elements if n.var} | {p.var for p in c.paths if p.var}
            self.check(e, names)
        if c.optional:
            self.optional(c)
            return
        P.match_paths(self, c, given or {})

    def optional(self, c: A.Match) -> None:
        inner, keys = self.pattern_rows(c)
        new = {n: b for n, b in inner.scope.items() if n not in self.scope}
        if self.folding and keys and not set(new) & self.later:
            # Only how often it matches counts, and no match counts as one row.
            n, weight = Names.new("cnt"), Names.new("w")
            right = inner.df.groupBy(*[i for _, i, _ in keys]).agg(F.count(F.lit(1)).alias(n))
            before = F.col(self.weight) if self.weight else F.lit(1).cast("bigint")
            times = before * F.coalesce(F.col(n), F.lit(1).cast("bigint"))
            joined = self.frame().join(right, self._on(keys), "left").drop(*[i for _, i, _ in keys])
            self.df = joined.withColumn(weight, times).drop(n, *([self.weight] if self.weight else []))
            self.weight = weight
            return
        for n, b in new.items():
            if not isinstance(b, ValueVar):
                new[n] = replace(b, nullable=True)
        cols = [c for b in new.values() for c in b.columns()]
        right = inner.frame().select(*[i for _, i, _ in keys], *dict.fromkeys(cols))
        if keys:
            self.df = self.frame().join(right, self._on(keys), "left").drop(*[i for _, i, _ in keys])
        else:
            self.df = self.frame().join(right, F.lit(True), "left")
        self.scope |= new

    # --- projection

    def project(self, c: A.Projection) -> None:
        items = list(c.items)
        if c.star:
            if not self.scope and not items:
                raise SemanticError("there is nothing for * to stand for")
            items = [A.Item(A.Var(n), n, False) for n in sorted(self.scope) if n not in {i.name for i in items}] + items
        for i in items:
            self.check(i.expr)
        if any(has_aggregate(i.expr) for i in items):
            self.aggregate(c, items)
        elif c.distinct:
            self.plain(items)
            self.distinct()
            self.arrange(c, {i.expr: i.name for i in items})
        else:
            before = dict(self.scope)
            self.plain(items, keep=True)
            self.arrange(c, {i.expr: i.name for i in items}, before)
        if c.final:
            self.closed = None

    def plain(self, items: list[A.Item], keep: bool = False) -> None:
        """Evaluate items; the scope becomes what they name (columns of the old one stay if ``keep``)."""
        scope: dict[str, Binding] = {}
        made: dict[str, Column] = {}
        for i in items:
            if isinstance(i.expr, A.Var) and i.expr.name in self.scope:
                scope[i.name] = i.expr.name  # resolved below: later items may still join its table
                continue
            x = self.expr(i.expr)
            col = Names.new("v")
            made[col] = x.col if x.t.kind != "null" else F.lit(None).cast("string")
            scope[i.name] = ValueVar(col, x.t)
        if made:
            self.df = self.frame().withColumns(made)
        old = self.scope
        self.scope = {n: old[b] if isinstance(b, str) else b for n, b in scope.items()}
        if not keep:
            self.trim()

    def trim(self) -> None:
        cols = dict.fromkeys([*self.corr, *(c for b in self.scope.values() for c in b.columns())])
        self.df = self.frame().select(*cols) if cols else self.frame()

    def distinct(self) -> None:
        """Entities by id, values by equality."""
        keys, rest = list(self.corr), []
        for b in self.scope.values():
            if isinstance(b, ValueVar):
                keys.append(b.col)
            else:
                keys.append(b.id)
                rest += [c for c in b.columns() if c != b.id]
        keys, rest = list(dict.fromkeys(keys)), [c for c in dict.fromkeys(rest)]
        maps = [b.col for b in self.scope.values() if isinstance(b, ValueVar) and b.t.kind == "map" and b.t.fields is None]
        if maps:
            raise NotSupported("DISTINCT over maps of unknown keys")
        if rest:
            self.df = self.df.groupBy(*keys).agg(*[F.first(c).alias(c) for c in rest])
        else:
            self.df = self.df.select(*keys).distinct()

    def arrange(self, c: A.Projection, known: dict, before: dict[str, Binding] | None = None) -> None:
        """WHERE, ORDER BY, SKIP and LIMIT of a projection, in the order written."""
        if c.where is not None and not c.where_last:
            self.filter(c.where)
        order = []
        if c.order:
            after = self.scope
            self.scope = {**(before or {}), **after}
            for e, down in c.order:
                e = A.Var(known[e]) if e in known else e
                if has_aggregate(e):
                    raise SemanticError("an aggregate in ORDER BY must also be returned")
                v = self.scope.get(e.name) if isinstance(e, A.Var) else None
                col = F.col(v.id) if isinstance(v, (NodeVar, RelVar)) else self.expr(e).col
                order.append(col.desc_nulls_first() if down else col.asc_nulls_last())
            self.scope = {n: self.scope[n] for n in after}
        skip = self.amount(c.skip, "SKIP")
        limit = self.amount(c.limit, "LIMIT")
        if self.corr and (skip is not None or limit is not None):
            rank = Names.new("rank")
            w = W.partitionBy(*self.corr).orderBy(*(order or [F.lit(1)]))
            self.df = self.frame().withColumn(rank, F.row_number().over(w))
            if skip:
                self.df = self.df.where(F.col(rank) > skip)
            if limit is not None:
                self.df = self.df.where(F.col(rank) <= limit + (skip or 0))
            self.df = self.df.drop(rank)
        else:
            if order:
                self.df = self.frame().orderBy(*order)
            if skip:
                self.df = self.frame().offset(skip)
            if limit is not None:
                self.df = self.frame().limit(limit)
        if c.where is not None and c.where_last:
            self.filter(c.where)
        self.trim()

    def amount(self, e, what: str) -> int | None:
        if e is None:
            return None
        n = self._constant(e)
        if not isinstance(n, int) or isinstance(n, bool) or n < 0:
            raise ArgumentError(f"{what} needs a whole number of 0 or more")
        return n

    def _constant(self, e):
        if isinstance(e, A.Lit):
            return e.value
        if isinstance(e, A.Param):
            return self.x_param(e, {}).value
        if free(e):
            raise SemanticError("SKIP and LIMIT cannot use variables")
        x = Rows(self.graph, self.params).expr(e)
        return self.graph.spark.range(1).select(x.col.alias("v")).first()[0]

    # --- aggregation

    def aggregate(self, c: A.Projection, items: list[A.Item]) -> None:
        calls: dict[A.Call, tuple[str, T]] = {}
        aggs: list[Column] = []
        pre: dict[str, Column] = {}
        keys: list[A.Item] = [i for i in items if not has_aggregate(i.expr)]
        scope: dict[str, Binding] = {}
        known: dict = {}
        values: dict[str, Column] = {}
        for i in keys:
            if isinstance(i.expr, A.Var) and isinstance(self.scope.get(i.expr.name), (NodeVar, RelVar)):
                known[i.expr] = i.name
                continue
            x = self.expr(i.expr)
            col = Names.new("g")
            values[col] = x.col if x.t.kind != "null" else F.lit(None).cast("string")
            scope[i.name] = ValueVar(col, x.t)
            known[i.expr] = i.name
        mixed = [i for i in items if has_aggregate(i.expr)]
        exprs = [i.expr for i in mixed] + [e for e, _ in c.order if has_aggregate(e)]
        for e in exprs:
            for n in e.walk():
                if is_aggregate(n) and n not in calls:
                    calls[n] = self.fold(n, pre, aggs)
        # Properties of grouped nodes that a mixed item reads must be there before the fold.
        for e in [*exprs, *(e for e, _ in c.order)]:
            self.settle([e], {})
        for i in keys:
            if isinstance(i.expr, A.Var) and isinstance(self.scope.get(i.expr.name), (NodeVar, RelVar)):
                scope[i.name] = self.scope[i.expr.name]
        if values or pre:
            self.df = self.frame().withColumns({**values, **pre})
        by, rest = list(self.corr), []
        for b in scope.values():
            if isinstance(b, ValueVar):
                by.append(b.col)
            else:
                by.append(b.id)
                rest += [F.first(x).alias(x) for x in b.columns() if x != b.id]
        by = list(dict.fromkeys(by))
        rest_names = set()
        rest = [r for r in rest if not (str(r) in rest_names or rest_names.add(str(r)))]
        empty_groups = self.corr and not keys
        self.df = self.frame().groupBy(*by).agg(*aggs, *rest) if by else self.frame().agg(*aggs)
        if empty_groups and self.base is not None:
            twin = {k: Names.new("k") for k in self.corr}
            right = self.df.select(*[F.col(k).alias(t) for k, t in twin.items()], *[x for x, _ in calls.values()])
            on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(t)) for k, t in twin.items()])
            self.df = self.base.join(right, on, "left").drop(*twin.values())
            fill = {}
            for call, (col, t) in calls.items():
                if call.name in ("count", "sum"):
                    fill[col] = F.coalesce(F.col(col), F.lit(0).cast(to_spark(t)))
                elif call.name == "collect":
                    fill[col] = F.coalesce(F.col(col), F.array().cast(to_spark(t)))
            if fill:
                self.df = self.df.withColumns(fill)
        post = dict(scope)
        for call, (col, t) in calls.items():
            post["\0" + col] = ValueVar(col, t)
        swap = {call: A.Var("\0" + col) for call, (col, _) in calls.items()}
        swap |= {e: A.Var(n) for e, n in known.items() if not isinstance(e, A.Lit)}
        self.scope = post
        final = [A.Item(A.Var(i.name) if i in keys else rewrite(i.expr, swap), i.name, True) for i in items]
        order = tuple((rewrite(e, {**{i.expr: A.Var(i.name) for i in items}, **swap}) if not isinstance(e, A.Var) else e, d) for e, d in c.order)
        before = dict(self.scope)
        self.plain(final, keep=True)
        if c.distinct:
            self.trim()
            self.distinct()
            before = None
        self.arrange(replace(c, order=order), {}, before)

    def fold(self, call: A.Call, pre: dict, aggs: list) -> tuple[str, T]:
        """Add one aggregate; its column and type."""
        out, name = Names.new("a"), call.name
        if call.star:
            aggs.append((F.coalesce(F.sum(self.weight), F.lit(0).cast("bigint")) if self.weight else F.count(F.lit(1))).alias(out))
            return out, INT
        if any(has_aggregate(a) for a in call.args):
            raise SemanticError("an aggregate inside an aggregate")
        need = 2 if name.startswith("percentile") else 1
        if len(call.args) != need:
            raise SemanticError(f"{name} takes {need} argument{'s' * (need > 1)}")
        v = self.entity(call.args[0], {})
        if name == "count" and v is not None:
            aggs.append((F.count_distinct if call.distinct else F.count)(F.col(v.id)).alias(out))
            return out, INT
        x = self.expr(call.args[0])
        col = Names.new("x")
        pre[col] = x.col if x.t.kind != "null" else F.lit(None).cast("string")
        c, t = F.col(col), x.t
        if name == "count":
            if t.kind in ENTITY:
                c = c["id"]
            aggs.append((F.count_distinct if call.distinct else F.count)(c).alias(out))
            return out, INT
        if name == "collect":
            if call.distinct and t.kind in ENTITY:
                whole = F.collect_list(c)
                firsts = F.filter(whole, lambda e, i: F.array_position(F.transform(whole, lambda y: y["id"]), e["id"]) == i + 1)
                aggs.append(F.array_sort(firsts, lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)).alias(out))
            else:
                aggs.append((F.collect_set if call.distinct else F.collect_list)(c).alias(out))
            return out, list_of(t)
        if name in ("min", "max"):
            aggs.append((F.min if name == "min" else F.max)(c).alias(out))
            return out, t
        if t.kind == "null":
            aggs.append((F.lit(0).cast("bigint") if name == "sum" else F.max(F.lit(None).cast("double"))).alias(out))
            return out, INT if name == "sum" else FLOAT
        if t.kind == "duration" and name in ("sum", "avg"):
            parts = [F.sum(c[n]) for n in ("months", "days", "seconds", "nanos")]
            aggs.append(F.struct(*[p.alias(n) for p, n in zip(parts, ("months", "days", "seconds", "nanos"), strict=True)]).alias(out))
            return out, t
        if t.kind not in NUMBER:
            raise ArgumentError(f"{name} cannot take {t}")
        if name == "sum":
            zero = F.lit(0).cast("bigint") if t == INT else F.lit(0.0)
            aggs.append(F.coalesce((F.sum_distinct if call.distinct else F.sum)(c), zero).alias(out))
            return out, t
        c = c.cast("double")
        if name == "avg":
            one = F.sum_distinct(c) / F.count_distinct(c) if call.distinct else F.avg(c)
            aggs.append(one.alias(out))
        elif name == "stdev":
            aggs.append(F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(out))
        elif name == "stdevp":
            aggs.append(F.coalesce(F.stddev_pop(c), F.lit(0.0)).alias(out))
        else:
            p = self._constant(call.args[1])
            if not isinstance(p, (int, float)) or not 0 <= p <= 1:
                raise ArgumentError(f"{name} needs a number between 0 and 1")
            fn = "percentile_cont" if name == "percentilecont" else "percentile_disc"
            whole = F.expr(f"{fn}({float(p)!r}D) WITHIN GROUP (ORDER BY {col})")
            if name == "percentiledisc" and t == INT:
                aggs.append(whole.cast("bigint").alias(out))
                return out, INT
            aggs.append(whole.cast("double").alias(out))
        return out, FLOAT

    # --- CALL

    def call(self, c: A.CallQuery) -> None:
        from .parser import UPDATES

        q = c.query
        imports = self._imports(c)
        if not any(isinstance(n, UPDATES) for n in q.walk()):
            inner, keys = self.drive(imports)
            self._meet(q, inner.run(q), keys, imports)
            return
        from ..operators import writes

        if len(q.arms) > 1:
            raise NotSupported("updates inside a UNION")
        row = Names.new("row")  # equal rows update the graph once each, so a number tells them apart
        writes.freeze(self, (row, F.monotonically_increasing_id()))
        self.corr.append(row)
        inner, keys = self.drive(imports)
        self.corr.pop()
        inner.updating = True
        out = inner.run(q)
        if returns(q):
            out.df = staged(out.frame(), "returned")
            self._meet(q, out, keys, imports)
        writes.forget(self)

    def _imports(self, c: A.CallQuery) -> list[str]:
        """The variables that a CALL { } takes from outside."""
        imports: list[str]
        q = c.query
        if c.all_:
            imports = self.outside(q)
        elif c.imports is not None:
            imports = list(c.imports)
        else:
            first = q.arms[0][0]
            imports = [i.expr.name for i in first.items if isinstance(i.expr, A.Var)] if isinstance(first, A.Projection) and not first.final and not self._local(first) else []
            imports = [n for n in imports if n in self.scope]
        missing = [n for n in imports if n not in self.scope]
        if missing:
            raise SemanticError(f"the variable {missing[0]} is not defined")
        return imports

    def _meet(self, q: A.Query, out: Rows, keys: list, imports: list[str]) -> None:
        """Join what a CALL { } returned to the rows that it was called for."""
        clash = [n for n in out.scope if n in self.scope]
        if clash and any(not isinstance(a[-1], A.Projection) or a[-1].final for a in q.arms):
            clash = [n for n in clash if n not in imports or True]
            raise SemanticError(f"the variable {clash[0]} is already defined")
        new = out.scope
        cols = dict.fromkeys(x for b in new.values() for x in b.columns())
        right = out.frame().select(*[i for _, i, _ in keys], *[x for x in cols if x not in {i for _, i, _ in keys}])
        if keys:
            self.df = self.frame().join(right, self._on(keys), "inner")
        else:
            self.df = right if self.df is None else self.frame().crossJoin(right)
        self.scope |= new

    def _local(self, p: A.Projection) -> bool:
        return any(not isinstance(i.expr, A.Var) for i in p.items)

    def procedure(self, c: A.CallProcedure) -> None:
        from ..operators import procedures

        procedures.call(self, c)

    # --- the result

    def result(self) -> DataFrame:
        out = []
        for n in list(self.scope):
            x = self.expr(A.Var(n))
            out.append((x.col if x.t.kind != "null" else F.lit(None).cast("string")).alias(n))
        return self.frame().select(*out)


def returns(q: A.Query) -> bool:
    """Whether a query ends in RETURN."""
    last = q.arms[0][-1]
    return isinstance(last, A.Projection) and last.final


def rewrite(e, swap: dict):
    """The expression with some subexpressions replaced."""
    if isinstance(e, A.Expr) and e in swap:
        return swap[e]
    if isinstance(e, tuple):
        return tuple(rewrite(x, swap) for x in e)
    if isinstance(e, A.Expr) and not isinstance(e, (A.Exists, A.CountOf, A.CollectOf)):
        from dataclasses import fields

        return type(e)(**{f.name: rewrite(getattr(e, f.name), swap) for f in fields(e)})
    return e
