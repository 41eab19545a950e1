"""Pattern matching: hops as joins, variable-length hops, shortest paths.

A hop joins the relationship tables whose type and end labels fit.  Relationships of one
MATCH are pairwise different; the comparison is planned only where types can coincide.
Conditions are applied as soon as what they read is bound.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import ArgumentError, NotSupported, SemanticError
from ..functions import compare as C
from ..graph import LabelSet, RelKey
from ..plans import ast as A
from ..plans.scope import NodeVar, RelVar, ValueVar, node_struct, rel_struct
from ..plans.types import STR, T, Typed, coerce, from_spark, join_types, list_of, to_spark
from ..storage import staged

#: Hops of a bounded variable-length pattern that are planned as one lazy join chain.
UNROLL = 4
#: Levels after which an unbounded search gives up.
MAX_LEVELS = 1000


def _fits(key: RelKey, types: tuple[str, ...]) -> bool:
    return not types or key[0] in types


class Edges:
    """The relationships a hop can use, seen from one end: columns for both ends, id and properties."""

    def __init__(self, rows, types: tuple[str, ...], direction: str, near: list[LabelSet], far: list[LabelSet]):
        from ..plans.compiler import Names

        graph = rows.graph
        self.near_id, self.far_id = Names.new("a"), Names.new("b")
        self.var = RelVar(Names.new("r"), Names.new("s"), Names.new("d"), Names.new("t"))
        parts: list[tuple[RelKey, bool, bool]] = []
        self.near, self.far, kinds = set(), set(), set()
        for key in graph.rels:
            if not _fits(key, types):
                continue
            _, s, d = key
            ahead = direction in ("out", "both") and s in near and d in far
            back = direction in ("in", "both") and d in near and s in far
            if ahead:
                parts.append((key, True, False))
                self.near.add(s)
                self.far.add(d)
            if back:
                parts.append((key, False, ahead))
                self.near.add(d)
                self.far.add(s)
            if ahead or back:
                kinds.add(key[0])
        types_of: dict[str, T] = {}
        for key, _, _ in parts:
            for f in graph.rels[key].schema.fields:
                if f.name not in ("id", "src", "dst"):
                    t = from_spark(f.dataType)
                    types_of[f.name] = t if f.name not in types_of else (join_types(types_of[f.name], t) or STR)
        self.var.props = {n: (Names.new("p"), t) for n, t in types_of.items()}
        self.var.kinds = tuple(sorted(kinds))
        self.loops = bool(self.near & self.far)
        frames = [self._part(graph.rels[key], key, ahead, twice) for key, ahead, twice in parts]
        if frames:
            self.df = reduce(DataFrame.union, frames)
        else:
            zero = F.col("id")
            cols = [zero.alias(c) for c in (self.near_id, self.far_id, self.var.id, self.var.src, self.var.dst)]
            self.df = graph.spark.range(0).select(*cols, F.lit("").alias(self.var.type))

    def _part(self, df: DataFrame, key: RelKey, ahead: bool, twice: bool) -> DataFrame:
        own = {f.name: from_spark(f.dataType) for f in df.schema.fields}
        v = self.var
        a, b = ("src", "dst") if ahead else ("dst", "src")
        cols = [F.col(a).alias(self.near_id), F.col(b).alias(self.far_id), F.col("id").alias(v.id), F.col("src").alias(v.src), F.col("dst").alias(v.dst), F.lit(key[0]).alias(v.type)]
        for n, (c, t) in v.props.items():
            if n not in own:
                cols.append(F.lit(None).cast(to_spark(t)).alias(c))
            else:
                x = Typed(F.col(f"`{n}`"), own[n])
                cols.append((x.col if own[n] == t and t.kind not in ("int", "float") else x.col.cast(to_spark(t)) if t.kind in ("int", "float") else coerce(x, t) if join_types(own[n], t) == t else x.col.cast("string")).alias(c))
        if twice:  # a loop is met once
            df = df.where("src <> dst")
        return df.select(*cols)


class Matcher:
    def __init__(self, rows, match: A.Match, given: dict[str, list[LabelSet]]):
        from ..plans.compiler import conjuncts, free, has_subquery

        self.rows, self.given = rows, given
        self.waiting = conjuncts(match.where)
        self.free, self.has_subquery = free, has_subquery
        self.used: list[tuple[str, str, set[str], int]] = []  # (one or many, column, kinds, clause)
        self.clause_of = dict(zip(map(id, match.paths), match.clauses, strict=True)) if match.clauses else {}
        self.clause = 0
        self.hidden: list[str] = []
        self.todo: list[A.Path] = []

    def name(self, var: str | None) -> str:
        from ..plans.compiler import Names

        if var:
            if var.startswith("\0"):  # named only to join hops
                self.hidden.append(var)
            return var
        n = "\0" + Names.new("anon")
        self.hidden.append(n)
        return n

    def apply_ready(self, last: bool = False) -> None:
        """Filter by the conditions that can be decided now."""
        rest = []
        for e in self.waiting:
            if last or (not self.has_subquery(e) and self.free(e) <= set(self.rows.scope)):
                if self.has_subquery(e):
                    rest.append(e)
                else:
                    self.rows.keep_if(e)
            else:
                rest.append(e)
        self.waiting = rest
        if last:
            for e in rest:
                self.rows.keep_if(e)

    # --- nodes

    def candidates(self, p: A.NodePattern, name: str) -> list[LabelSet]:
        out = self.rows.graph.tables(p.labels)
        if name in self.given:
            out = [k for k in out if k in self.given[name]]
        v = self.rows.scope.get(name)
        if isinstance(v, NodeVar):
            out = [k for k in out if k in v.tables]
        return out

    def narrow(self, p: A.NodePattern, name: str) -> None:
        """Labels and property map of a node that is bound."""
        v = self.rows.scope[name]
        if not isinstance(v, NodeVar):
            raise SemanticError(f"{name} is no node")
        if p.labels and any(not set(p.labels) <= k for k in v.tables):
            self.rows.keep_if(A.HasLabels(A.Var(name), p.labels))
            v = self.rows.scope[name]
            tables = [k for k in v.tables if set(p.labels) <= k]
            from dataclasses import replace

            self.rows.scope[name] = replace(v, tables=tables)
        self.props(A.Var(name), p.props)

    def props(self, of, props) -> None:
        for k, e in self.items(props):
            self.rows.keep_if(A.Bin("=", A.Prop(of, k), e))

    def items(self, props) -> list[tuple]:
        if props is None:
            return []
        if isinstance(props, A.Param):
            value = self.rows.params.get(props.name)
            if not isinstance(value, dict):
                raise ArgumentError(f"${props.name} must be a map")
            return [(k, A.Index(A.Param(props.name), A.Lit(k))) for k in value]
        return list(props.items)

    def scan(self, p: A.NodePattern, name: str) -> None:
        """Bind a node from its tables."""
        rows = self.rows
        df, v = rows.node_table(self.candidates(p, name))
        rows.df = df if rows.df is None else rows.df.crossJoin(df)
        rows.scope[name] = v
        self.props(A.Var(name), p.props)

    # --- paths

    def path(self, p: A.Path) -> None:
        nodes, rels = p.elements[0::2], p.elements[1::2]
        names = [self.name(n.var) for n in nodes]
        rel_names = [self.name(r.var) for r in rels]
        scope = self.rows.scope
        self.clause = self.clause_of.get(id(p), 0)
        if not rels:
            if names[0] in scope:
                self.narrow(nodes[0], names[0])
                if self.clause < 0:  # as if it had been scanned first
                    df, v = self.rows.node_table(self.candidates(nodes[0], names[0]))
                    self.rows.df = self.rows.frame().join(df.select(F.col(v.id)), F.col(scope[names[0]].id) == F.col(v.id), "left_semi")
            else:
                self.scan(nodes[0], names[0])
            self.apply_ready()
            if p.var:
                self.bind_path(p.var, names, [])
            return
        bound = [i for i, n in enumerate(names) if n in scope]
        at = bound[0] if bound else self.start(nodes, rels)
        if bound:
            for i in bound:
                self.narrow(nodes[i], names[i])
        want_path = p.var is not None
        kept: dict[int, tuple] = {}
        order = [*range(at, len(rels)), *range(at - 1, -1, -1)]
        for done, i in enumerate(order, 1):
            near, far, flipped = (i, i + 1, False) if i >= at else (i + 1, i, True)
            kept[i] = self.hop(p, nodes[near], names[near], rels[i], rel_names[i], nodes[far], names[far], flipped, want_path)
            ahead = order[done:]
            self.fold({names[k] for j in ahead for k in (j, j + 1)}, [rels[j] for j in ahead])
        if p.var:
            self.bind_path(p.var, names, [(rel_names[i], *kept[i]) for i in range(len(rels))])
            self.apply_ready()

    def start(self, nodes, rels) -> int:
        """Where an unbound path begins: at a node with a property map, else at the end of fewer tables."""
        for i, n in enumerate(nodes):
            if n.props is not None:
                return i
        first, last = (len(self.rows.graph.tables(n.labels)) for n in (nodes[0], nodes[-1]))
        return 0 if first <= last else len(nodes) - 1

    def hop(self, p, near_p, near, rel, rel_name, far_p, far, flipped: bool, want_path: bool):
        direction = rel.direction
        if flipped and direction != "both":
            direction = "in" if direction == "out" else "out"
        if rel.low is not None or p.kind != "walk":
            return self.far_hop(p.kind, near_p, near, rel, rel_name, far_p, far, direction, flipped, want_path)
        rows, scope = self.rows, self.rows.scope
        edges = Edges(rows, rel.types, direction, self.candidates(near_p, near), self.candidates(far_p, far))
        new_near, new_far = near not in scope, far not in scope
        loop = near == far
        cond = None
        if not new_near:
            cond = F.col(scope[near].id) == F.col(edges.near_id)
        if not new_far:
            c = F.col(scope[far].id) == F.col(edges.far_id)
            cond = c if cond is None else cond & c
        v = edges.var
        if rel_name in scope:
            old = scope[rel_name]
            if not isinstance(old, RelVar):
                raise SemanticError(f"{rel_name} is no relationship")
            c = F.col(old.id) == F.col(v.id)
            cond = c if cond is None else cond & c
        if rows.df is None:
            rows.df = edges.df
        elif cond is None:
            rows.df = rows.df.crossJoin(edges.df)
        else:
            rows.df = rows.df.join(edges.df, cond)
        if loop and new_near:
            rows.df = rows.df.where(F.col(edges.near_id) == F.col(edges.far_id))
        tables = rows.graph.nodes
        if new_near:
            scope[near] = NodeVar(edges.near_id, [k for k in tables if k in edges.near])
        if far not in scope:
            scope[far] = NodeVar(edges.far_id, [k for k in tables if k in edges.far])
        scope.setdefault(rel_name, v)
        self.differ("one", v.id, set(v.kinds))
        self.props(A.Var(rel_name), rel.props)
        if new_near:
            self.props(A.Var(near), near_p.props)
        if new_far and not loop:
            self.props(A.Var(far), far_p.props)
        self.apply_ready()
        return ("one", None)

    def differ(self, how: str, col: str, kinds: set[str]) -> None:
        for other, c, k, clause in self.used:
            if not kinds & k or c == col or clause != self.clause:
                continue
            if how == other == "one":
                test = F.col(col) != F.col(c)
            elif how == other == "many":
                test = ~F.arrays_overlap(F.col(col), F.col(c))
            else:
                many, one = (col, c) if how == "many" else (c, col)
                test = ~F.array_contains(F.col(many), F.col(one))
            self.rows.df = self.rows.df.where(test)
        self.used.append((how, col, kinds, self.clause))

    # --- variable length and shortest paths

    def edge_filter(self, edges: Edges, rel: A.RelPattern, rel_name: str) -> DataFrame:
        """What each relationship of a walk must satisfy, applied before the walk."""
        from ..plans.compiler import Rows

        df = edges.df
        sub = Rows(self.rows.graph, self.rows.params, df, {"\0e": edges.var})
        for k, e in self.items(rel.props):
            if self.free(e):
                raise NotSupported("a variable-length relationship whose properties refer to variables")
            sub.keep_if(A.Bin("=", A.Prop(A.Var("\0e"), k), e))
        rest = []
        for e in self.waiting:
            if isinstance(e, A.Quantifier) and e.kind == "all" and e.of == A.Var(rel_name) and self.free(e.where) <= {e.var}:
                each = Rows(self.rows.graph, self.rows.params, sub.df, {e.var: edges.var})
                each.filter(e.where)
                sub.df = each.df
            else:
                rest.append(e)
        self.waiting = rest
        return sub.df

    def far_hop(self, kind, near_p, near, rel, rel_name, far_p, far, direction, flipped, want_path):
        from ..plans.compiler import Names

        rows, scope, graph = self.rows, self.rows.scope, self.rows.graph
        all_tables = list(graph.nodes)
        if near not in scope:
            self.scan(near_p, near)
            self.apply_ready()
        asked = far_p.props is not None or any(far in self.free(e) and not self.has_subquery(e) for e in self.waiting)
        if kind != "walk" and far not in scope and asked:
            self.scan(far_p, far)  # few ends: the search can stop once all are met
            self.apply_ready()
        edges = Edges(rows, rel.types, direction, all_tables, all_tables)
        low, high = (rel.low, rel.high) if rel.low is not None else (1, 1)
        want_rels = not rel_name.startswith("\0") or want_path
        one = rel_struct(edges.var)
        node_t = None
        E = truncated(self.edge_filter(edges, rel, rel_name), edges, getattr(rows.session, "expand_truncation", None))
        E = E.select(F.col(edges.near_id).alias("a"), F.col(edges.far_id).alias("b"), F.col(edges.var.id).alias("rid"), *([one.col.alias("rel")] if want_rels else []))
        starts = rows.frame().select(F.col(scope[near].id).alias("s")).distinct()
        if want_path:
            met = edges.near | edges.far | set(scope[near].tables)  # no other table has a node of the walk
            table, nv = rows.node_table([k for k in all_tables if k in met])
            nodes = table.select(F.col(nv.id).alias("nid"), node_struct(nv).col.alias("node"))
            node_t = node_struct(nv).t
            E = E.join(nodes, F.col("b") == F.col("nid")).drop("nid")
            starts = starts.join(nodes, F.col("s") == F.col("nid")).drop("nid")
        state = [F.col("s"), F.col("s").alias("e"), F.array().cast("array<bigint>").alias("rids")]
        if want_rels:
            state.append(F.array().cast(f"array<{to_spark(one.t)}>").alias("rels"))
        if want_path:
            state.append(F.array("node").alias("nodes"))
        zero = starts.where(F.col("s").isNotNull()).select(*state)
        ends = None
        if kind == "walk":
            found = reach(zero, E, low, high) if getattr(rows, "reach", False) and not want_rels and (direction != "both" or low == 0) and low <= 1 else trails(zero, E, low, high)
        else:
            if far in scope:
                ends = rows.frame().select(F.col(scope[near].id).alias("s"), F.col(scope[far].id).alias("e")).distinct()
            ends = staged(ends, "ends") if ends is not None else None
            found = shortest(zero, staged(E, "edges"), high, kind == "all_shortest", ends)  # each level reads them again
        names = {c: Names.new("w") for c in found.columns}
        found = found.select(*[F.col(c).alias(n) for c, n in names.items()])
        cond = F.col(scope[near].id) == F.col(names["s"])
        targets = self.candidates(far_p, far)
        if far in scope:
            cond = cond & (F.col(scope[far].id) == F.col(names["e"]))
        rows.df = rows.frame().join(found, cond)
        if far not in scope:
            reachable = edges.far | (set(scope[near].tables) if low == 0 else set())
            scope[far] = NodeVar(names["e"], [k for k in all_tables if k in reachable])
            self.narrow(far_p, far)
            if not [k for k in targets if k in reachable]:
                rows.df = rows.df.where(F.lit(False))
        if "rids" in names:
            self.differ("many", names["rids"], set(edges.var.kinds))
        if not rel_name.startswith("\0"):
            col = F.reverse(F.col(names["rels"])) if flipped else F.col(names["rels"])
            c = Names.new("rl")
            rows.df = rows.df.withColumn(c, col)
            scope[rel_name] = ValueVar(c, list_of(one.t))
        self.apply_ready()
        return ("many", (names.get("rels"), names.get("nodes"), one.t, node_t, flipped))

    def bind_path(self, var: str, names: list[str], hops: list[tuple]) -> None:
        """The named path: its nodes and relationships in order."""
        from ..plans.compiler import Names

        rows = self.rows
        for n in names:
            rows.hydrate(n)
        structs = [node_struct(rows.scope[n]) for n in names]
        node_t = reduce(lambda a, b: join_types(a, b) or a, [s.t for s in structs] + [h[2][3] for h in hops if h[1] == "many"])
        rel_ts = [rel_struct(rows.scope[h[0]]).t if h[1] == "one" else h[2][2] for h in hops]
        rel_t = reduce(lambda a, b: join_types(a, b) or a, rel_ts) if rel_ts else T("rel", None, (("_", STR),))
        nodes = [F.array(coerce(structs[0], node_t))]
        rels = []
        for i, h in enumerate(hops):
            if h[1] == "one":
                rels.append(F.array(coerce(rel_struct(rows.scope[h[0]]), rel_t)))
                nodes.append(F.array(coerce(structs[i + 1], node_t)))
            else:
                rl, nl, rt, nt, flipped = h[2]
                turn = F.reverse if flipped else (lambda c: c)
                rels.append(coerce(Typed(turn(F.col(rl)), list_of(rt)), list_of(rel_t)))
                walk = coerce(Typed(turn(F.col(nl)), list_of(nt)), list_of(node_t))
                nodes.append(F.slice(walk, F.lit(2), F.greatest(F.size(walk) - 1, F.lit(0))))
        empty = F.array().cast(f"array<{to_spark(rel_t)}>")
        col = Names.new("path")
        rows.df = rows.df.withColumn(col, F.struct(F.concat(*nodes).alias("nodes"), (F.concat(*rels) if rels else empty).alias("rels")))
        rows.scope[var] = ValueVar(col, T("path", None, (("nodes", list_of(node_t)), ("rels", list_of(rel_t)))))

    def fold(self, ahead: set[str], rels: list) -> None:
        """Where only a count is asked for: sum up the rows that agree on all that is still read.

        A variable that nothing later reads leaves the rows; how often each combination of the
        others occurred is kept as a weight.  Relationship ids stay while a later hop of this
        MATCH could meet the same relationship.
        """
        from ..plans.compiler import Names

        rows = self.rows
        if not rows.folding or rows.df is None:
            return
        ahead_of = [(r, self.clause) for r in rels] + [(e, self.clause_of.get(id(p), 0)) for p in self.todo for e in p.elements[1::2]]
        needed = ahead | rows.later | {e.var for p in self.todo for e in p.elements if e.var} | {n for e in self.waiting for n in self.free(e)}
        keep = {n: v for n, v in rows.scope.items() if n in needed}
        if len(keep) == len(rows.scope) or not keep or any(not isinstance(v, NodeVar) for v in keep.values()):
            return
        kinds = {(k[0], c) for r, c in ahead_of for k in rows.graph.rels if _fits(k, r.types)}
        self.used = [u for u in self.used if any((k, u[3]) in kinds for k in u[2])]
        by = dict.fromkeys([*(v.id for v in keep.values()), *(u[1] for u in self.used)])
        weight = Names.new("w")
        total = F.sum(rows.weight) if rows.weight else F.count(F.lit(1))
        read = [c for n, v in keep.items() if n in rows.later for c in v.columns() if c != v.id]  # properties the groups may ask for
        rows.df = rows.df.groupBy(*by).agg(total.alias(weight), *[F.first(c).alias(c) for c in dict.fromkeys(read)])
        rows.weight = weight
        rows.scope = {n: v if n in rows.later else NodeVar(v.id, v.tables, None, None, v.nullable) for n, v in keep.items()}

    def run(self, match: A.Match) -> None:
        self.todo = todo = list(match.paths)
        while todo:
            known = set(self.rows.scope)
            nxt = next((p for p in todo if any(n.var in known for n in p.elements[0::2])), todo[0])
            todo.remove(nxt)
            self.path(nxt)
            self.fold(set(), [])
        self.apply_ready(last=True)
        for n in self.hidden:
            self.rows.scope.pop(n, None)


def truncated(df: DataFrame, edges: Edges, rule: tuple[int, str] | None) -> DataFrame:
    """At most ``k`` relationships from each node of a walk, those of largest property first (ties by id)."""
    if rule is None or rule[1] not in edges.var.props:
        return df
    k, prop = rule
    rank = F.row_number().over(W.partitionBy(edges.near_id).orderBy(F.col(edges.var.props[prop][0]).desc_nulls_last(), edges.var.id))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def match_paths(rows, match: A.Match, given: dict[str, list[LabelSet]]) -> None:
    Matcher(rows, match, given).run(match)


def _step(front: DataFrame, E: DataFrame) -> DataFrame:
    """One more hop of each walk, over a relationship it has not used."""
    cols = front.columns
    joined = front.join(E, F.col("e") == F.col("a")).where(~F.array_contains("rids", F.col("rid")))
    out = [F.col("s"), F.col("b").alias("e"), F.array_append("rids", F.col("rid")).alias("rids")]
    if "rels" in cols:
        out.append(F.array_append("rels", F.col("rel")).alias("rels"))
    if "nodes" in cols:
        out.append(F.array_append("nodes", F.col("node")).alias("nodes"))
    return joined.select(*out)


def trails(zero: DataFrame, E: DataFrame, low: int, high: int) -> DataFrame:
    """All walks of ``low`` to ``high`` hops (-1: any number) that use no relationship twice."""
    if 0 <= high < low:
        return zero.where(F.lit(False))
    parts = [zero] if low == 0 else []
    front, k = zero, 0
    if high < 0 or high > UNROLL:
        E = staged(E, "edges")
    while high < 0 or k < high:
        k += 1
        front = _step(front, E)
        if high < 0 or k > UNROLL:
            front = staged(front, f"walk-{k}")
            if front.limit(1).count() == 0:
                break
        if k >= low:
            parts.append(front)
        if k > MAX_LEVELS:
            raise NotSupported("a walk of more than 1000 hops")
    return reduce(DataFrame.union, parts) if parts else front


def reach(zero: DataFrame, E: DataFrame, low: int, high: int) -> DataFrame:
    """Pairs (s, e) within ``high`` hops: breadth first, each pair met once."""
    pairs = zero.select("s", "e")
    seen = pairs if low == 0 else pairs.where(F.lit(False))
    front, hops, k = pairs, E.select("a", "b").distinct(), 0
    if high < 0 or high > 2:
        hops = staged(hops, "hops")
    while high < 0 or k < high:
        k += 1
        front = front.join(hops, F.col("e") == F.col("a")).select("s", F.col("b").alias("e")).distinct().join(seen, ["s", "e"], "left_anti")
        if high < 0 or k > 2:
            front = staged(front, f"reach-{k}")
            if front.limit(1).count() == 0:
                break
        seen = seen.union(front)
        if k > 2 and k % 8 == 0:  # keep the plan short on long chains
            seen = staged(seen, f"seen-{k}")
    return seen


def shortest(zero: DataFrame, E: DataFrame, high: int, every: bool, ends: DataFrame | None) -> DataFrame:
    """The shortest walks from each start to each end: one of them (least relationship ids) or all."""
    seen = zero.select("s", "e")
    front, parts, k = zero, [], 0
    cols = zero.columns
    while high < 0 or k < high:
        k += 1
        nxt = _step(front, E).join(seen, ["s", "e"], "left_anti").select(*cols)
        if not every:
            rest = [c for c in cols if c not in ("s", "e")]
            nxt = nxt.groupBy("s", "e").agg(F.min_by(F.struct(*rest), F.col("rids")).alias("best")).select("s", "e", *[F.col("best")[c].alias(c) for c in rest])
        front = staged(nxt, f"level-{k}")
        if front.limit(1).count() == 0:
            break
        parts.append(front if ends is None else front.join(ends, ["s", "e"], "left_semi").select(*cols))
        seen = seen.union(front.select("s", "e").distinct())
        if k % 8 == 0:  # keep the plan short on long chains
            seen = staged(seen, f"seen-{k}")
        if ends is not None and ends.join(seen, ["s", "e"], "left_anti").limit(1).count() == 0:
            break
        if k > MAX_LEVELS:
            raise NotSupported("a path of more than 1000 hops")
    return reduce(DataFrame.union, parts) if parts else zero.where(F.lit(False))
