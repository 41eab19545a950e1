"""Procedures: introspection, search, and algorithms in four modes.

``CALL <anything>.algo.<name>.<mode>(config)``; a configuration key that does not exist is
refused with the nearest one that does.
"""

from __future__ import annotations

import difflib
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ArgumentError, SemanticError
from ..graph import Graph, LabelSet
from ..plans import ast as A
from ..plans.scope import NodeVar, ValueVar
from ..plans.types import from_spark
from . import algorithms as G
from . import search

KEYS = ("nodeLabels", "relationshipTypes", "orientation", "relationshipWeightProperty", "maxIterations", "tolerance", "dampingFactor", "resolution", "sourceNode", "targetNode", "k", "mutateKey", "writeProperty", "writeBatchSize", "concurrency", "graphalytics", "projection")
MAX_ITERATIONS = 100


#: Different arguments that one call in a query may have; each runs the procedure once.
MAX_CALLS = 1000


def call(rows, c: A.CallProcedure) -> None:
    """Add the rows of a procedure to the rows in flight.

    Constant arguments run it once.  Else it runs once for each different value of what the
    arguments read from the rows, and every row meets the result of its own value.
    """
    from ..plans.compiler import Names, free

    name = c.name.lower()
    read = list(dict.fromkeys(x for a in c.args for x in _computed(a) if free(x) & set(rows.scope)))
    if read:
        df, node_column, turn = _per_value(rows, name, c.args, read)
    else:
        df, node_column = run(rows, name, [_plain(rows, a, {}) for a in c.args])
        turn = None
    fields = {f.name: f.dataType for f in df.schema.fields if f.name != turn}
    yields = c.yields if c.yields is not None else tuple((n, n) for n in ([*fields, "node"] if node_column and "node" not in fields else fields))
    known = [*fields, *(["node"] if node_column else [])]
    cols, scope = [], {}
    for field, alias in yields:
        if field not in known:
            raise SemanticError(f"{c.name} yields no {field}")
        if alias in rows.scope or alias in scope:
            raise SemanticError(f"the variable {alias} is already defined")
        col = Names.new("y")
        if field == "node":
            cols.append(F.col(node_column).alias(col))
            scope[alias] = NodeVar(col, list(rows.graph.nodes))
        else:
            cols.append(F.col(f"`{field}`").alias(col))
            scope[alias] = ValueVar(col, from_spark(fields[field]))
    if turn:
        rows.df = rows.frame().join(df.select(turn, *cols), turn).drop(turn)
    else:
        out = df.select(*cols) if cols else df
        rows.df = out if rows.df is None else rows.df.crossJoin(out)
    rows.scope |= scope
    if c.where is not None:
        rows.filter(c.where)


def _computed(e):
    """The parts of an argument that are neither constants nor lists and maps."""
    if isinstance(e, (A.Lit, A.Param)):
        return
    if isinstance(e, A.ListLit):
        for x in e.items:
            yield from _computed(x)
    elif isinstance(e, A.MapLit):
        for _, v in e.items:
            yield from _computed(v)
    else:
        yield e


def _per_value(rows, name: str, args: tuple, read: list) -> tuple[DataFrame, str | None, str]:
    """The results for all different values of ``read``; the rows get a column that names their result."""
    from ..plans.compiler import Names
    from ..storage import staged

    typed = [rows.expr(x) for x in read]
    cols = [Names.new("arg") for _ in read]
    turn = Names.new("turn")
    values = [(x.col if x.t.kind != "null" else F.lit(None).cast("string")).alias(c) for x, c in zip(typed, cols, strict=True)]
    frame = rows.frame().select("*", *values)
    different = staged(frame.select(*cols).distinct().limit(MAX_CALLS + 1).withColumn(turn, F.monotonically_increasing_id()), "arguments")
    found = different.collect()  # at most MAX_CALLS + 1 rows
    if len(found) > MAX_CALLS:
        raise ArgumentError(f"{name} is called with more than {MAX_CALLS} different arguments")
    parts, node = [], None
    for r in found:
        given = {x: r[c] for x, c in zip(read, cols, strict=True)}
        df, node = run(rows, name, [_plain(rows, a, given) for a in args])
        parts.append(df.withColumn(turn, F.lit(r[turn])))
    if not found:  # no row asks: only the columns matter
        sample = {"int": 0, "float": 0.0, "list": [1.0], "bool": False}
        df, node = run(rows, name, [_plain(rows, a, {x: sample.get(t.t.kind, "") for x, t in zip(read, typed, strict=True)}) for a in args])
        parts.append(df.withColumn(turn, F.lit(0).cast("bigint")).limit(0))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in cols])
    named = different.select(*[F.col(c).alias(f"{c}_") for c in cols], turn)
    rows.df = frame.join(F.broadcast(named), same).drop(*cols, *[f"{c}_" for c in cols])
    return reduce(DataFrame.union, parts), node, turn


def _plain(rows, e, given: dict):
    """The value of an argument: literals, parameters, lists and maps of them, and what was read from the rows."""
    if e in given:
        return given[e]
    if isinstance(e, A.Lit):
        return e.value
    if isinstance(e, A.Param):
        if e.name not in rows.params:
            raise ArgumentError(f"the parameter ${e.name} is not given")
        return rows.params[e.name]
    if isinstance(e, A.ListLit):
        return [_plain(rows, x, given) for x in e.items]
    if isinstance(e, A.MapLit):
        return {k: _plain(rows, v, given) for k, v in e.items}
    x = rows.expr(e)
    return rows.graph.spark.range(1).select(x.col.alias("v")).first()[0]


def run(rows, name: str, args: list) -> tuple[DataFrame, str | None]:
    graph, spark = rows.graph, rows.graph.spark
    if name == "db.labels":
        return spark.createDataFrame([(x,) for x in graph.labels()], "label string"), None
    if name == "db.relationshiptypes":
        return spark.createDataFrame([(x,) for x in graph.types()], "relationshipType string"), None
    if name == "db.propertykeys":
        return spark.createDataFrame([(x,) for x in graph.property_keys()], "propertyKey string"), None
    if name == "dbms.components":
        return spark.createDataFrame([("graphloom", ["1.0"], "community")], "name string, versions array<string>, edition string"), None
    if name == "db.awaitindexes":
        return spark.createDataFrame([], "state string"), None
    if name in ("db.index.fulltext.querynodes", "db.index.vector.querynodes"):
        return _search(rows, name, args), "nodeId"
    if ".algo." in name:
        return _algorithm(rows, name.split(".algo.", 1)[1], args)
    raise SemanticError(f"there is no procedure {name}")


def _search(rows, name: str, args: list) -> DataFrame:
    index = rows.session.catalog.indexes.get(args[0]) if rows.session else None
    kind = "fulltext" if "fulltext" in name else "vector"
    if index is None or index.kind != kind:
        raise ArgumentError(f"there is no {kind} index {args[0]}")
    parts = []
    tables = {k for label in index.label for k in rows.graph.tables([label])}
    for k in sorted(tables, key=sorted):
        df = rows.graph.nodes[k]
        cols = [F.col(f"`{p}`").alias(p) if p in df.columns else F.lit(None).cast("string").alias(p) for p in index.keys]
        parts.append(df.select(F.col("id").alias("nodeId"), *cols))
    table = parts[0]
    for p in parts[1:]:
        table = table.union(p)
    if kind == "fulltext":
        return search.full_text(table, "nodeId", list(index.keys), args[1], str(index.options.get("scorer", "bm25")).lower())
    return search.nearest(table, "nodeId", index.keys[0], int(args[1]), list(args[2]))


# --- algorithms -------------------------------------------------------------------------


def config(given) -> dict:
    given = given or {}
    if not isinstance(given, dict):
        raise ArgumentError("the configuration must be a map")
    for k in given:
        if k not in KEYS:
            near = difflib.get_close_matches(k, KEYS, 1, 0.5)
            raise ArgumentError(f"there is no configuration key {k}" + (f"; did you mean {near[0]}?" if near else ""))
    damping = given.get("dampingFactor", 0.85)
    if not 0 <= damping < 1:
        raise ArgumentError("dampingFactor must be in [0, 1)")
    if given.get("orientation", "NATURAL") not in ("NATURAL", "REVERSE", "UNDIRECTED"):
        raise ArgumentError("orientation is NATURAL, REVERSE or UNDIRECTED")
    return given


def projection(graph: Graph, cfg: dict) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges; edges with an end outside the vertices are left out."""
    labels, types = cfg.get("nodeLabels") or [], cfg.get("relationshipTypes") or []
    labels = [labels] if isinstance(labels, str) else labels
    types = [types] if isinstance(types, str) else types
    tables = [k for k in graph.nodes if not labels or k & LabelSet(labels)]
    spark = graph.spark
    V = spark.range(0).select("id")
    for k in tables:
        V = V.union(graph.nodes[k].select("id"))
    weight = cfg.get("relationshipWeightProperty")
    E = spark.createDataFrame([], "src bigint, dst bigint, weight double")
    for (kind, s, d), df in graph.rels.items():
        if (types and kind not in types) or s not in tables or d not in tables:
            continue
        numeric = weight in df.columns and dict(df.dtypes)[weight] in ("bigint", "int", "double", "float", "smallint")
        w = F.coalesce(F.col(f"`{weight}`").cast("double"), F.lit(1.0)) if numeric else F.lit(1.0)
        E = E.union(df.select("src", "dst", w.alias("weight")))
    return V, oriented(E, cfg.get("orientation", "NATURAL"))


def oriented(E: DataFrame, orientation: str) -> DataFrame:
    back = E.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return E if orientation == "NATURAL" else back if orientation == "REVERSE" else E.union(back.where("src <> dst"))


def _algorithm(rows, name: str, args: list) -> tuple[DataFrame, str | None]:
    spark, session = rows.graph.spark, rows.session
    if name == "project":
        return _project(rows, args[0] if args else {}), None
    if name.startswith("result."):
        return _results(session, name.split(".")[1], args)
    algorithm, _, mode = name.rpartition(".")
    cfg = config(args[0] if args else None)
    if cfg.get("projection"):
        handle = cfg["projection"]
        if session is None or handle not in session.projections:
            raise ArgumentError(f"there is no projection {handle}")
        V, E = session.projections[handle]
    else:
        V, E = projection(rows.graph, cfg)
    if algorithm == "kshortestpaths" and mode == "stream":
        found = G.k_shortest(V, E, source=cfg.get("sourceNode"), target=cfg.get("targetNode"), k=cfg.get("k", 1))
        data = [(i, cfg["sourceNode"], cfg["targetNode"], float(c), p, 0) for i, (c, p) in enumerate(found)]
        return spark.createDataFrame(data, "index bigint, sourceNode bigint, targetNode bigint, totalCost double, nodeIds array<bigint>, asOf bigint"), None
    if algorithm not in G.ALGORITHMS or mode not in ("stream", "stats", "mutate", "write"):
        raise SemanticError(f"there is no procedure algo.{name}")
    fn, column, kind = G.ALGORITHMS[algorithm]
    if algorithm in ("bfs", "sssp") and cfg.get("sourceNode") is None:
        raise ArgumentError(f"{algorithm} needs a sourceNode")
    cap = min(int(cfg.get("maxIterations", 20)), MAX_ITERATIONS)
    result = fn(V, E, damping=cfg.get("dampingFactor", 0.85), tolerance=cfg.get("tolerance", 1e-7), max_iterations=cap, resolution=cfg.get("resolution", 1.0), source=cfg.get("sourceNode"), graphalytics=bool(cfg.get("graphalytics")), weighted=bool(cfg.get("relationshipWeightProperty")), undirected=cfg.get("orientation") == "UNDIRECTED")
    values = result.values.select("id", F.col("value").cast("bigint" if kind == "int" else "double").alias("value"))
    if mode == "stream":
        return values.select(F.col("id").alias("nodeId"), F.col("value").alias(column), F.lit(0).cast("bigint").alias("asOf")), "nodeId"
    if mode == "stats":
        return _stats(spark, values, E, result), None
    if mode == "mutate":
        if not cfg.get("mutateKey"):
            raise ArgumentError("mutate needs a mutateKey")
        from ..storage import staged

        session.results[cfg["mutateKey"]] = staged(values.withColumnRenamed("value", column), "result")
        return spark.createDataFrame([(cfg["mutateKey"], values.count(), result.rounds, bool(result.settled), 0)], "mutateKey string, nodeCount bigint, iterations bigint, converged boolean, asOf bigint"), None
    if not cfg.get("writeProperty"):
        raise ArgumentError("write needs a writeProperty")
    return _write(rows, values, cfg["writeProperty"], result), None


def _stats(spark, values: DataFrame, E: DataFrame, result) -> DataFrame:
    """Counts and the distribution of the values, percentiles by nearest rank."""
    known = values.where("value is not null").select(F.col("value").cast("double").alias("v"))
    n, low, high, mean = known.agg(F.count("v"), F.min("v"), F.max("v"), F.avg("v")).first()
    spread = {}
    if n:
        spread = {"min": low, "max": high, "mean": mean}
        at = {p: int((n - 1) * p + 0.5) for p in (0.5, 0.75, 0.9, 0.99)}
        # percentile_disc picks the first value whose share reaches p: aim inside the wanted rank
        exprs = [F.expr(f"percentile_disc({(i + 0.5) / n!r}D) WITHIN GROUP (ORDER BY v)").alias(f"p{int(p * 100)}") for p, i in at.items()]
        spread |= known.agg(*exprs).first().asDict()
    spread |= {k: float(v) for k, v in result.extra.items()}
    row = (values.count(), E.count(), result.rounds, bool(result.settled), 0, spread)
    return spark.createDataFrame([row], "nodeCount bigint, relationshipCount bigint, iterations bigint, converged boolean, asOf bigint, distribution map<string,double>")


def _write(rows, values: DataFrame, prop: str, result) -> DataFrame:
    from ..storage import staged

    values = staged(values.where("value is not null"), "write")
    written = 0
    for k, df in list(rows.graph.nodes.items()):
        mine = values.select("id", F.col("value").alias("_new"))
        joined = df.drop(prop).join(mine, "id", "left").withColumnRenamed("_new", prop)
        rows.graph.nodes[k] = joined
    written = values.count()
    if rows.session is not None:
        rows.session.graph = rows.graph.copy()
    return rows.graph.spark.createDataFrame([(prop, written, result.rounds, bool(result.settled), 0, 0)], "writeProperty string, nodesWritten bigint, iterations bigint, converged boolean, asOf bigint, committedAt bigint")


def _project(rows, cfg: dict) -> DataFrame:
    extra = set(cfg) - {"name", "nodeLabels", "edges", "orientation"}
    if extra or not cfg.get("name") or "#" in cfg["name"]:
        raise ArgumentError("project takes name, nodeLabels, edges and orientation")
    spark = rows.graph.spark
    V, _ = projection(rows.graph, {"nodeLabels": cfg.get("nodeLabels")})
    data = []
    for e in cfg.get("edges") or []:
        w = e.get("weight", 1.0) if "weight" not in e or isinstance(e["weight"], (int, float)) else None
        if w is None or isinstance(w, bool):
            raise ArgumentError("an edge has a weight that is no number")
        data.append((int(e["source"]), int(e["target"]), float(w)))
    E = spark.createDataFrame(data, "src bigint, dst bigint, weight double")
    inside = E.join(V.select(F.col("id").alias("src")), "src", "left_semi").join(V.select(F.col("id").alias("dst")), "dst", "left_semi")
    kept, n = inside.count(), V.count()
    handle = cfg["name"]
    rows.session.projections[handle] = (V, oriented(inside.select("src", "dst", "weight"), cfg.get("orientation", "NATURAL")))
    return spark.createDataFrame([(handle, n, kept, len(data) - kept, 0)], "projection string, nodeCount bigint, relationshipCount bigint, outsideProjection bigint, asOf bigint")


def _results(session, what: str, args: list) -> tuple[DataFrame, str | None]:
    spark = session.spark
    if what == "list":
        return spark.createDataFrame([(k, df.count()) for k, df in sorted(session.results.items())], "mutateKey string, nodeCount bigint"), None
    if what == "drop":
        gone = session.results.pop(args[0], None) is not None
        return spark.createDataFrame([(args[0], gone)], "mutateKey string, dropped boolean"), None
    if args[0] not in session.results:
        raise ArgumentError(f"there is no result {args[0]}")
    df = session.results[args[0]]
    return df.select(F.col("id").alias("nodeId"), F.col(df.columns[1]).cast("double").alias("value")), "nodeId"
