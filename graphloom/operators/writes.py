"""Updates: each clause reads the rows before it as a whole and makes a new snapshot.

The rows in flight are written to a table first, so what an update reads cannot change
under it, and new ids are fixed.  Tables are replaced, never edited.  A MERGE looks all its
rows up at once, creates each missing pattern once for equal keys, and binds all matches.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ArgumentError, ExecutionFailed, NotSupported, SemanticError
from ..graph import Graph, LabelSet
from ..plans import ast as A
from ..plans.scope import NodeVar, RelVar, ValueVar
from ..plans.types import T, Typed, from_spark, join_types, to_spark
from ..storage import staged


def apply(rows, c) -> None:
    {A.Create: create, A.Merge: merge, A.SetClause: set_, A.Remove: remove, A.Delete: delete, A.Foreach: foreach}[type(c)](rows, c)


def freeze(rows, *extra: tuple[str, Column]) -> None:
    df = rows.frame()
    for name, col in extra:
        df = df.withColumn(name, col)
    rows.df = staged(df, "rows")


def next_id(tables: list[DataFrame]) -> int:
    top = [df.agg(F.max("id")).first()[0] for df in tables]
    return max([0, *(x + 1 for x in top if x is not None)])


def aligned(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables as one; a column whose types differ takes the wider."""
    a, b = dict(old.dtypes), dict(new.dtypes)
    for c in set(a) & set(b):
        if a[c] != b[c]:
            wide = join_types(from_spark(old.schema[c].dataType), from_spark(new.schema[c].dataType))
            kind = to_spark(wide) if wide else "string"
            old, new = old.withColumn(c, F.col(f"`{c}`").cast(kind)), new.withColumn(c, F.col(f"`{c}`").cast(kind))
    return old.unionByName(new, allowMissingColumns=True)


def put_nodes(graph: Graph, key: LabelSet, df: DataFrame) -> None:
    graph.nodes[key] = aligned(graph.nodes[key], df) if key in graph.nodes else df


def put_rels(graph: Graph, key: tuple, df: DataFrame) -> None:
    graph.rels[key] = aligned(graph.rels[key], df) if key in graph.rels else df


def value_column(x: Typed, name: str) -> Column:
    if x.t.kind in ("map", "node", "rel", "path"):
        raise ArgumentError(f"{name} cannot hold {x.t}")
    if x.t.kind == "null":
        return F.lit(None).cast("string")
    if x.t.kind == "list" and x.t.elem.kind == "null":
        return x.col.cast("array<string>")
    return x.col


def forget(rows) -> None:
    """Properties that were read before an update are read anew after it."""
    seen: dict[str, NodeVar] = {}
    for n, v in list(rows.scope.items()):
        if isinstance(v, NodeVar):
            seen.setdefault(v.id, NodeVar(v.id, list(rows.graph.nodes), None, None, True))
            rows.scope[n] = seen[v.id]
        elif isinstance(v, RelVar):
            rows.scope[n] = refreshed(rows, v)
    cols = dict.fromkeys([*rows.corr, *(c for b in rows.scope.values() for c in b.columns())])
    if cols:
        rows.df = rows.df.select(*cols)


def refreshed(rows, v: RelVar) -> RelVar:
    from ..plans.compiler import Names

    tables = [(k, df) for k, df in rows.graph.rels.items() if not v.kinds or k[0] in v.kinds]
    types: dict[str, T] = {}
    for _, df in tables:
        for f in df.schema.fields:
            if f.name not in ("id", "src", "dst"):
                t = from_spark(f.dataType)
                types[f.name] = (join_types(types[f.name], t) or T("str")) if f.name in types else t
    props = {n: (Names.new("p"), t) for n, t in types.items()}
    rid, kind = Names.new("r"), Names.new("t")
    parts = [df.select(F.col("id").alias(rid), F.lit(k[0]).alias(kind), *[(F.col(f"`{n}`").cast(to_spark(t)) if n in df.columns else F.lit(None).cast(to_spark(t))).alias(c) for n, (c, t) in props.items()]) for k, df in tables]
    if parts:
        table = reduce(DataFrame.union, parts)
        rows.df = rows.df.join(table, (F.col(v.id) == F.col(rid)) & (F.col(v.type) == F.col(kind)), "left").drop(rid, kind)
    return replace(v, props=props if parts else {}, nullable=True)


# --- CREATE -----------------------------------------------------------------------------


def _props(rows, props) -> dict[str, Typed]:
    if props is None:
        return {}
    if isinstance(props, A.Param):
        value = rows.params.get(props.name)
        if not isinstance(value, dict):
            raise ArgumentError(f"${props.name} must be a map")
        return {k: rows.literal(v) for k, v in value.items()}
    return {k: rows.expr(e) for k, e in props.items}


def create(rows, c: A.Create) -> None:
    for p in c.paths:
        create_path(rows, p)


def create_path(rows, p: A.Path) -> None:
    from ..plans.compiler import Names

    graph: Graph = rows.graph
    if p.kind != "walk":
        raise SemanticError("a shortest path cannot be created")
    nodes, rels = p.elements[0::2], p.elements[1::2]
    names = [n.var or "\0" + Names.new("made") for n in nodes]
    new: dict[str, tuple[A.NodePattern, dict[str, str]]] = {}
    made: dict[str, Column] = {}
    for n, name in zip(nodes, names, strict=True):
        if name in rows.scope or name in new:
            if not rels:
                raise SemanticError(f"the variable {name} is already defined")
            if n.labels or n.props is not None:
                raise SemanticError(f"{name} is bound and cannot get labels or properties here")
            continue
        cols = {}
        for k, x in _props(rows, n.props).items():
            cols[k] = Names.new("p")
            made[cols[k]] = value_column(x, k)
        new[name] = (n, cols)
    rel_cols = []
    rel_names = []
    for r in rels:
        if len(r.types) != 1 or r.low is not None:
            raise SemanticError("a created relationship has exactly one type and one hop")
        if r.direction == "both":
            raise SemanticError("a created relationship has a direction")
        if r.var and r.var in rows.scope:
            raise SemanticError(f"the variable {r.var} is already defined")
        cols = {}
        for k, x in _props(rows, r.props).items():
            cols[k] = Names.new("p")
            made[cols[k]] = value_column(x, k)
        rel_cols.append(cols)
        rel_names.append(r.var or "\0" + Names.new("made"))
    # Labels of bound ends that can come from several tables are needed to file the relationships.
    ends = {name for i in range(len(rels)) for name in (names[i], names[i + 1])}
    for name in ends - set(new):
        if not isinstance(rows.scope[name], NodeVar):
            raise SemanticError(f"{name} is no node")
        if len(rows.scope[name].tables) > 1:
            rows.hydrate(name)
    if made:
        rows.df = rows.frame().withColumns(made)
    base = next_id(list(graph.nodes.values())) if new else 0
    rbase = next_id(list(graph.rels.values())) if rels else 0
    ids = {name: Names.new("n") for name in new}
    rids = [Names.new("r") for _ in rels]
    row = F.monotonically_increasing_id()
    extra = [(col, F.lit(base) + row * len(ids) + i) for i, col in enumerate(ids.values())]
    extra += [(col, F.lit(rbase) + row * len(rids) + i) for i, col in enumerate(rids)]
    freeze(rows, *extra)
    for name, (n, cols) in new.items():
        key = LabelSet(n.labels)
        put_nodes(graph, key, rows.df.select(F.col(ids[name]).alias("id"), *[F.col(c).alias(k) for k, c in cols.items()]))
        rows.scope[name] = NodeVar(ids[name], [key])
    for i, r in enumerate(rels):
        a, b = (names[i], names[i + 1]) if r.direction == "out" else (names[i + 1], names[i])
        va, vb = rows.scope[a], rows.scope[b]
        for ka in va.tables:
            for kb in vb.tables:
                part = rows.df
                for v, k in ((va, ka), (vb, kb)):
                    if len(v.tables) > 1:
                        part = part.where(F.col(v.labels) == F.array(*[F.lit(x) for x in sorted(k)]).cast("array<string>"))
                part = part.where(F.col(va.id).isNotNull() & F.col(vb.id).isNotNull())
                if (len(va.tables) > 1 or len(vb.tables) > 1) and part.limit(1).count() == 0:
                    continue
                put_rels(graph, (r.types[0], ka, kb), part.select(F.col(rids[i]).alias("id"), F.col(va.id).alias("src"), F.col(vb.id).alias("dst"), *[F.col(c).alias(k) for k, c in rel_cols[i].items()]))
        kind = Names.new("t")
        src, dst = Names.new("s"), Names.new("d")
        rows.df = rows.df.withColumns({kind: F.lit(r.types[0]), src: F.col(va.id), dst: F.col(vb.id)})
        props = {k: (c, from_spark(rows.df.schema[c].dataType)) for k, c in rel_cols[i].items()}
        rows.scope[rel_names[i]] = RelVar(rids[i], src, dst, kind, props, False, (r.types[0],))
    if p.var:
        from .paths import Matcher

        m = Matcher(rows, A.Match((), None, False), {})
        m.bind_path(p.var, names, [(n, "one", None) for n in rel_names])
    for name in [*names, *rel_names]:
        if name.startswith("\0"):
            rows.scope.pop(name, None)


# --- MERGE ------------------------------------------------------------------------------


def merge(rows, c: A.Merge) -> None:
    from ..plans.compiler import Names, free

    p = c.path
    nodes, rels = p.elements[0::2], p.elements[1::2]
    if not rels and nodes[0].var in rows.scope:
        raise SemanticError(f"the variable {nodes[0].var} is already defined")
    for r in rels:
        if len(r.types) != 1 or r.low is not None:
            raise SemanticError("a merged relationship has exactly one type and one hop")
        if r.var in rows.scope and r.var:
            raise SemanticError(f"the variable {r.var} is already defined")
    for e in p.elements:
        if isinstance(e.props, A.Param):
            raise SemanticError("a parameter cannot be the properties of MERGE")
    keys = {}
    for e in p.elements:
        for k, x in _props(rows, e.props).items():
            keys[Names.new("m")] = value_column(x, k)
    if keys:
        rows.df = rows.frame().withColumns(keys)
    freeze(rows)
    for k in keys:
        if rows.df.where(F.col(k).isNull()).limit(1).count():
            raise ExecutionFailed("MERGE cannot look for a null property")
    bound = [e.var for e in nodes if e.var in rows.scope]
    match = A.Match((replace(p, var=None),), None, False)
    scope = dict(rows.scope)
    used = sorted(n for n in free(match) if n in rows.scope)
    del used
    inner, on = rows.pattern_rows(match)
    flag = Names.new("met")
    if on:
        flags = inner.df.select(*[i for _, i, _ in on]).distinct().withColumn(flag, F.lit(True))
        rows.df = rows.df.join(flags, rows._on(on), "left").drop(*[i for _, i, _ in on]).withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
    else:
        rows.df = rows.df.withColumn(flag, F.lit(inner.frame().limit(1).count() > 0))
    freeze(rows)
    rows.scope = scope
    missing = rows.like(None, dict(rows.scope))
    by = list(dict.fromkeys([*keys, *[rows.scope[n].id for n in bound]]))
    todo = rows.df.where(~F.col(flag))
    missing.df = todo.dropDuplicates(by) if by else todo.limit(1)
    made = replace(p, var=None, elements=tuple(replace(e, direction="out") if isinstance(e, A.RelPattern) and e.direction == "both" else _bare(e, rows.scope) for e in p.elements))
    missing.graph = rows.graph
    if missing.df.limit(1).count():
        create_path(missing, made)
    rows.match(A.Match((p,), None, False))
    for items, test in ((c.on_create, ~F.col(flag)), (c.on_match, F.col(flag))):
        if items:
            assign(rows, items, test)
    if c.on_create or c.on_match:
        forget(rows)


def _bare(e, scope):
    return replace(e, labels=(), props=None) if isinstance(e, A.NodePattern) and e.var in scope else e


# --- SET and REMOVE ---------------------------------------------------------------------


def set_(rows, c: A.SetClause) -> None:
    assign(rows, c.items, None)
    forget(rows)


def remove(rows, c: A.Remove) -> None:
    for i in c.items:
        if i.kind == "labels":
            assign(rows, (replace(i, kind="unlabel"),), None)
        else:
            assign(rows, (i,), None)
    forget(rows)


def assign(rows, items, test: Column | None) -> None:
    from ..plans.compiler import Names

    for i in items:
        if not isinstance(i.target, A.Var) or i.target.name not in rows.scope:
            raise SemanticError("SET needs a bound node or relationship")
        v = rows.scope[i.target.name]
        if isinstance(v, ValueVar):
            raise SemanticError(f"{i.target.name} is no node or relationship")
        changes: dict[str, Column] = {}
        whole = False
        if i.kind == "prop":
            x = rows.expr(i.value)
            changes[i.key] = value_column(x, i.key)
        elif i.kind in ("replace", "merge"):
            x = rows.expr(i.value)
            if x.t.kind not in ("map", "node", "rel") or x.t.fields is None:
                raise ArgumentError(f"SET needs a map, not {x.t}")
            body = x.col["properties"] if x.t.kind in ("node", "rel") else x.col
            changes = {n: value_column(Typed(body[n], t), n) for n, t in x.t.fields if n != "_"}
            whole = i.kind == "replace"
        v = rows.scope[i.target.name]
        cols = {k: Names.new("set") for k in changes}
        rows.df = rows.frame().withColumns({cols[k]: x for k, x in changes.items()}) if cols else rows.frame()
        freeze(rows)
        mine = rows.df if test is None else rows.df.where(test)
        update = mine.where(F.col(v.id).isNotNull()).select(F.col(v.id).alias("_id"), *[F.col(c).alias(f"_{k}") for k, c in cols.items()], *([F.col(v.type).alias("_type")] if isinstance(v, RelVar) else [])).dropDuplicates(["_id"])
        if isinstance(v, NodeVar):
            if i.kind in ("labels", "unlabel"):
                relabel(rows.graph, update, v.tables, set(i.labels), i.kind == "labels")
                forget(rows)  # nodes have moved to other tables
            else:
                for k in v.tables:
                    rows.graph.nodes[k] = updated(rows.graph.nodes[k], update, list(changes), whole, ("id",))
        else:
            if i.kind in ("labels", "unlabel"):
                raise SemanticError("a relationship has no labels")
            for k in list(rows.graph.rels):
                if not v.kinds or k[0] in v.kinds:
                    rows.graph.rels[k] = updated(rows.graph.rels[k], update.where(F.col("_type") == k[0]), list(changes), whole, ("id", "src", "dst"))


def updated(df: DataFrame, update: DataFrame, names: list[str], whole: bool, fixed: tuple[str, ...]) -> DataFrame:
    have = dict(df.dtypes)
    joined = df.join(update.withColumn("_hit", F.lit(True)), F.col("id") == F.col("_id"), "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    cols = [F.col(c) for c in fixed]
    for c in [*(c for c in df.columns if c not in fixed), *(n for n in names if n not in have)]:
        if c in names:
            new = F.col(f"`_{c}`")
            if c in have:
                wide = join_types(from_spark(df.schema[c].dataType), from_spark(update.schema[f"_{c}"].dataType))
                kind = have[c] if _all_null(update, f"_{c}") else to_spark(wide) if wide else "string"
                cols.append(F.when(hit, new.cast(kind)).otherwise(F.col(f"`{c}`").cast(kind)).alias(c))
            else:
                cols.append(F.when(hit, new).alias(c))
        elif whole:
            cols.append(F.when(~hit, F.col(f"`{c}`")).alias(c))
        else:
            cols.append(F.col(f"`{c}`"))
    return staged(joined.select(*cols), "updated")


def _all_null(df: DataFrame, col: str) -> bool:
    return dict(df.dtypes)[col] == "string" and df.where(F.col(f"`{col}`").isNotNull()).limit(1).count() == 0


def relabel(graph: Graph, update: DataFrame, tables: list[LabelSet], labels: set[str], add: bool) -> None:
    """Move nodes, and the relationships at them, to the tables of their new label sets."""
    ids = update.select(F.col("_id").alias("id"))
    for k in list(tables):
        target = LabelSet(k | labels if add else k - labels)
        if target == k or k not in graph.nodes:
            continue
        moved = staged(graph.nodes[k].join(ids, "id", "left_semi"), "moved")
        if moved.limit(1).count() == 0:
            continue
        graph.nodes[k] = staged(graph.nodes[k].join(ids, "id", "left_anti"), "stayed")
        put_nodes(graph, target, moved)
        mine = moved.select("id")
        for end, place in (("src", 1), ("dst", 2)):
            for key in [x for x in graph.rels if x[place] == k]:
                df = graph.rels[key]
                at = mine.select(F.col("id").alias(end))
                gone = staged(df.join(at, end, "left_semi").select(*df.columns), "moved-rels")
                if gone.limit(1).count() == 0:
                    continue
                graph.rels[key] = staged(df.join(at, end, "left_anti").select(*df.columns), "stayed-rels")
                new = (key[0], target, key[2]) if place == 1 else (key[0], key[1], target)
                put_rels(graph, new, gone)


# --- DELETE and FOREACH -----------------------------------------------------------------


def _targets(rows, e) -> tuple[list[DataFrame], list[DataFrame]]:
    """Ids of the nodes, and (id, type) of the relationships, that a target names."""
    if isinstance(e, A.Var) and isinstance(rows.scope.get(e.name), NodeVar):
        return [rows.df.select(F.col(rows.scope[e.name].id).alias("id"))], []
    if isinstance(e, A.Var) and isinstance(rows.scope.get(e.name), RelVar):
        v = rows.scope[e.name]
        return [], [rows.df.select(F.col(v.id).alias("id"), F.col(v.type).alias("type"))]
    x = rows.expr(e)

    def take(col: Column, t: T, df: DataFrame):
        if t.kind == "null":
            return [], []
        if t.kind == "node":
            return [df.select(col["id"].alias("id"))], []
        if t.kind == "rel":
            return [], [df.select(col["id"].alias("id"), col["type"].alias("type"))]
        if t.kind == "path":
            a = take(F.col("_x"), t.field("nodes").elem, df.select(F.explode(col["nodes"]).alias("_x")))
            b = take(F.col("_x"), t.field("rels").elem, df.select(F.explode(col["rels"]).alias("_x")))
            return a[0] + b[0], a[1] + b[1]
        if t.kind == "list":
            return take(F.col("_x"), t.elem, df.select(F.explode(col).alias("_x")))
        raise ArgumentError(f"DELETE cannot take {t}")

    return take(x.col, x.t, rows.frame())


def delete(rows, c: A.Delete) -> None:
    for e in c.targets:
        if isinstance(e, A.Var) and isinstance(rows.scope.get(e.name), NodeVar):
            continue
        rows.expr(e)
    freeze(rows)
    graph: Graph = rows.graph
    nodes, rels = [], []
    for e in c.targets:
        n, r = _targets(rows, e)
        nodes += n
        rels += r
    spark = graph.spark
    gone = staged(reduce(DataFrame.union, nodes, spark.createDataFrame([], "id bigint")).where("id is not null").distinct(), "gone")
    cut = staged(reduce(DataFrame.union, rels, spark.createDataFrame([], "id bigint, type string")).where("id is not null").distinct(), "cut")
    for key, df in list(graph.rels.items()):
        left = df.join(cut.where(F.col("type") == key[0]).select("id"), "id", "left_anti").select(*df.columns)
        for end in ("src", "dst"):
            at = gone.select(F.col("id").alias(end))
            if c.detach:
                left = left.join(at, end, "left_anti").select(*df.columns)
            elif left.join(at, end, "left_semi").limit(1).count():
                raise ExecutionFailed("a node that still has relationships cannot be deleted without DETACH")
        graph.rels[key] = staged(left, "rels")
    for key, df in list(graph.nodes.items()):
        graph.nodes[key] = staged(df.join(gone, "id", "left_anti"), "nodes")
    forget(rows)


def foreach(rows, c: A.Foreach) -> None:
    from ..plans.compiler import Names

    x = rows.expr(c.of)
    if x.t.kind == "null":
        return
    if x.t.kind != "list":
        raise ArgumentError(f"FOREACH needs a list, not {x.t}")
    if c.var in rows.scope:
        raise SemanticError(f"the variable {c.var} is already defined")
    freeze(rows)
    inner = rows.like(rows.df, dict(rows.scope))
    inner.graph = rows.graph
    col = Names.new("f")
    inner.df = rows.df.withColumn(col, F.explode(x.col))
    inner.bind_value(c.var, col, x.t.elem)
    for clause in c.body:
        apply(inner, clause)
    forget(rows)


__all__ = ["NotSupported", "apply"]
