"""Graph algorithms over ``vertices(id)`` and ``edges(src, dst, weight)``.

Most are loops of joins and pre-aggregated sums or minima; each round is a table in the
shared folder, so lineage never grows and a lost executor costs a round's tasks at most.
Betweenness and closeness need random access to the whole graph, Louvain to each connected
component, k shortest paths to what lies on short routes: they check its size first and
refuse what would not fit.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ArgumentError, NotSupported
from ..storage import staged, unstage

#: Largest graph (vertices plus edges) that is held in one process.
MAX_LOCAL = 20_000_000
#: Vertices plus edges up to which k shortest paths reads the whole graph at once.
SMALL = 500_000
#: Vertices times edges beyond which all-pairs work is refused.
MAX_PAIRS_WORK = 10**10
NEVER = (1 << 63) - 1


class Result:
    """``values(id, value)``, how many rounds it took, whether it settled, and extra figures."""

    def __init__(self, values: DataFrame, rounds: int = 0, settled: bool = True, extra: dict | None = None):
        self.values, self.rounds, self.settled, self.extra = values, rounds, settled, extra or {}


def apart(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the graph: shuffled, never sent to all by way of the driver."""
    return df.hint("merge")


def both_ways(edges: DataFrame) -> DataFrame:
    """The undirected simple graph: no loops, no parallel edges, both directions."""
    e = edges.where("src <> dst").select("src", "dst")
    return e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def degree(vertices: DataFrame, edges: DataFrame, weighted: bool = False, **_) -> Result:
    one = F.sum("weight") if weighted else F.count(F.lit(1))
    d = edges.groupBy(F.col("src").alias("id")).agg(one.cast("double").alias("value"))
    return Result(vertices.join(d, "id", "left").select("id", F.coalesce("value", F.lit(0.0)).alias("value")))


def page_rank(vertices: DataFrame, edges: DataFrame, *, damping: float = 0.85, tolerance: float = 1e-7, max_iterations: int = 20, **_) -> Result:
    """Pull form; the rank of vertices without out-edges is spread over all; parallel edges count."""
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    E = staged(edges.join(out, "src").select("src", "dst", "deg"), "edges")
    V = staged(vertices.join(out.select(F.col("src").alias("id"), F.lit(True).alias("flows")), "id", "left").select("id", F.coalesce("flows", F.lit(False)).alias("flows")), "vertices")
    n = V.count()
    if n == 0:
        return Result(V.select("id", F.lit(0.0).alias("value")))
    now = V.withColumn("value", F.lit(1.0 / n))
    dangling = V.where(~F.col("flows")).count() / n
    k, settled, last = 0, False, None
    while k < max_iterations and not settled:
        k += 1
        pulled = E.join(apart(now.select(F.col("id").alias("src"), "value")), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("value") / F.col("deg")).alias("in"))
        base = (1 - damping) / n + damping * dangling / n
        new = now.join(apart(pulled), "id", "left").select("id", "flows", (F.lit(base) + damping * F.coalesce("in", F.lit(0.0))).alias("value"), F.col("value").alias("old"))
        new = staged(new, f"rank-{k}")
        change, lost = new.agg(F.sum(F.abs(F.col("value") - F.col("old"))), F.sum(F.when(~F.col("flows"), F.col("value")))).first()
        dangling, settled = lost or 0.0, change <= tolerance
        unstage(last)
        last, now = new, new.drop("old")
    return Result(now.select("id", "value"), k, settled)


def _spread_min(V: DataFrame, E: DataFrame, sign: int = 1) -> DataFrame:
    """``(id, value)``: the least ``id * sign`` of all vertices that reach each along ``E``, to the fixpoint.

    A vertex takes the least label of those before it, and that of the vertex its label names:
    what reaches that one reaches this one too.  So on a path whose ids go up a label travels
    twice as far in each round.
    """
    now, last = V.select("id", (F.col("id") * sign).alias("value")), None
    while True:
        low = E.join(apart(now.select(F.col("id").alias("src"), "value")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("value").alias("low"))
        jump = now.where(F.col("id") * sign != F.col("value")).select((F.col("id") * sign).alias("value"), F.col("value").alias("far"))
        new = now.join(apart(low), "id", "left").join(apart(jump), "value", "left").select("id", F.least("value", "low", "far").alias("value"), F.col("value").alias("old"))
        new = staged(new, "spread")
        unstage(last)
        last, now = new, new.drop("old")
        if new.where("value <> old").limit(1).count() == 0:
            return now


def wcc(vertices: DataFrame, edges: DataFrame, **_) -> Result:
    """Least id of each weakly connected component, by label minima and pointer jumping."""
    E = staged(both_ways(edges), "edges")
    now, last = vertices.select("id", F.col("id").alias("value")), None
    k = 0
    while True:
        k += 1
        low = E.join(apart(now.select(F.col("id").alias("src"), "value")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("value").alias("low"))
        met = now.join(apart(low), "id", "left").select("id", F.least("value", F.coalesce("low", "value")).alias("value"), F.col("value").alias("old"))
        met = staged(met, f"met-{k}")
        jump = met.where("id <> value").select(F.col("id").alias("value"), F.col("value").alias("far"))
        new = staged(met.join(apart(jump), "value", "left").select("id", F.least("value", F.coalesce("far", "value")).alias("value"), "old"), f"jump-{k}")
        unstage(met, last)
        last, now = new, new.drop("old")
        if new.where("value <> old").limit(1).count() == 0:
            break
    unstage(E)
    return Result(now, k, True, {"componentCount": now.select("value").distinct().count()})


def scc(vertices: DataFrame, edges: DataFrame, **_) -> Result:
    """Least id of each strongly connected component, forward and backward at once.

    Vertices without an edge in or out are components of their own and leave first.  Then each
    vertex learns the least label that reaches it and the least that it reaches: where both
    are one vertex, it is in that vertex's component and leaves.  A component never crosses
    a border between different pairs of labels, so edges that do are dropped, which takes a
    path apart in one round.  Rounds take the least and the greatest ids in turn.
    """
    left = staged(vertices.select("id"), "left")
    E = staged(edges.where("src <> dst").select("src", "dst").distinct(), "edges")
    done, k = [], 0
    while left.limit(1).count():
        k += 1
        core = staged(E.select(F.col("src").alias("id")).distinct().join(apart(E.select(F.col("dst").alias("id")).distinct()), "id", "left_semi"), "core")
        done.append(staged(left.join(apart(core), "id", "left_anti").select("id", F.col("id").alias("root")), f"single-{k}"))
        inner = E.join(apart(core.select(F.col("id").alias("src"))), "src", "left_semi").join(apart(core.select(F.col("id").alias("dst"))), "dst", "left_semi")
        inner = staged(inner.select("src", "dst"), "inner")
        sign = 1 if k % 2 else -1
        ahead = _spread_min(core, inner, sign)
        back = _spread_min(core, inner.select(F.col("dst").alias("src"), F.col("src").alias("dst")), sign)
        both = staged(ahead.join(apart(back.select("id", F.col("value").alias("other"))), "id"), "both")
        done.append(staged(both.where("value = other").select("id", (F.col("value") * sign).alias("root")), f"scc-{k}"))
        rest = both.where("value <> other")
        mark = lambda end: rest.select(F.col("id").alias(end), F.struct("value", "other").alias(f"of_{end}"))  # noqa: B023, E731
        kept = inner.join(apart(mark("src")), "src").join(apart(mark("dst")), "dst").where("of_src = of_dst").select("src", "dst")
        new_left, new_edges = staged(rest.select("id"), f"left-{k}"), staged(kept, f"edges-{k}")
        unstage(left, E, core, inner, both)
        left, E = new_left, new_edges
    out = vertices.select("id", F.col("id").alias("root")).limit(0)
    for d in done:
        out = out.union(d)
    out = staged(out, "roots")
    unstage(*done)
    least = out.groupBy("root").agg(F.min("id").alias("value"))
    values = out.join(apart(least), "root").select("id", "value")
    return Result(values, k, True, {"componentCount": out.select("root").distinct().count()})


def bfs(vertices: DataFrame, edges: DataFrame, *, source: int, graphalytics: bool = False, **_) -> Result:
    hops = staged(edges.select("src", "dst").distinct(), "edges")
    front = vertices.where(F.col("id") == source).select("id", F.lit(0).cast("bigint").alias("value"))
    seen, k = front, 0
    while True:
        k += 1
        nxt = hops.join(front.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        front = staged(nxt.withColumn("value", F.lit(k).cast("bigint")), f"level-{k}")
        if front.limit(1).count() == 0:
            break
        seen = seen.union(front)
        if k % 8 == 0:  # keep the plan short on long chains
            seen = staged(seen, f"seen-{k}")
    miss = F.lit(NEVER if graphalytics else None).cast("bigint")
    return Result(vertices.join(seen, "id", "left").select("id", F.coalesce("value", miss).alias("value")), k)


def sssp(vertices: DataFrame, edges: DataFrame, *, source: int, graphalytics: bool = False, **_) -> Result:
    """Least distances by repeated relaxation of the edges whose start has just improved."""
    E = staged(edges.groupBy("src", "dst").agg(F.min("weight").alias("weight")), "edges")
    if E.where("weight < 0").limit(1).count():
        raise ArgumentError("a negative weight")
    known = vertices.select("id", F.when(F.col("id") == source, F.lit(0.0)).alias("value"))
    front = known.where("value is not null")
    k, last = 0, None
    while True:
        k += 1
        offers = E.join(front.select(F.col("id").alias("src"), "value"), "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.col("value") + F.col("weight")).alias("new"))
        better = F.col("new").isNotNull() & (F.col("value").isNull() | (F.col("new") < F.col("value")))
        step = staged(known.join(offers, "id", "left").select("id", F.when(better, F.col("new")).otherwise(F.col("value")).alias("value"), F.coalesce(better, F.lit(False)).alias("moved")), f"relax-{k}")
        unstage(last)
        last = step
        known, front = step.select("id", "value"), step.where("moved").select("id", "value")
        if front.limit(1).count() == 0:
            break
    if graphalytics:
        known = known.select("id", F.coalesce("value", F.lit(float("inf"))).alias("value"))
    return Result(known, k)


def _triangles(edges: DataFrame) -> DataFrame:
    """Each triangle once: edges point from the smaller (degree, id) to the larger, which bounds every star."""
    E = both_ways(edges)
    deg = E.groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("d"))
    up = E.join(deg.select(F.col("v").alias("src"), F.col("d").alias("ds")), "src").join(deg.select(F.col("v").alias("dst"), F.col("d").alias("dd")), "dst")
    up = staged(up.where((F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))).select("src", "dst"), "up")
    wedge = up.select(F.col("src").alias("a"), F.col("dst").alias("b")).join(up.select(F.col("src").alias("a"), F.col("dst").alias("c")), "a").where("b <> c")
    return wedge.join(up.select(F.col("src").alias("b"), F.col("dst").alias("c")), ["b", "c"])


def triangle_count(vertices: DataFrame, edges: DataFrame, **_) -> Result:
    each = _triangles(edges).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return Result(vertices.join(each, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("bigint").alias("value")))


def local_clustering(vertices: DataFrame, edges: DataFrame, **_) -> Result:
    n = triangle_count(vertices, edges).values
    deg = both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    out = n.join(deg, "id", "left").select("id", F.when(F.col("d") >= 2, 2.0 * F.col("value") / (F.col("d") * (F.col("d") - 1))).otherwise(F.lit(0.0)).alias("value"))
    return Result(out)


def label_propagation(vertices: DataFrame, edges: DataFrame, *, max_iterations: int = 20, graphalytics: bool = False, **_) -> Result:
    """Synchronous; the most frequent label around, the smallest on a tie; stops when it repeats itself."""
    if graphalytics:
        E = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    else:
        E = both_ways(edges)
    E = staged(E, "edges")
    now = staged(vertices.select("id", F.col("id").alias("value"), F.lit(None).cast("bigint").alias("before")), "labels-0")
    k, settled, swung, last = 0, False, False, now
    while k < max_iterations and not settled and not swung:
        k += 1
        votes = E.join(apart(now.select(F.col("id").alias("dst"), "value")), "dst").groupBy("src", "value").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy(F.col("src").alias("id")).agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("best"))
        new = now.join(apart(best), "id", "left").select("id", F.coalesce("best", "value").alias("value"), F.col("value").alias("before"), F.col("before").alias("older"))
        new = staged(new, f"labels-{k}")
        changed, again = new.agg(F.sum((F.col("value") != F.col("before")).cast("int")), F.sum((F.col("older").isNull() | (F.col("value") != F.col("older"))).cast("int"))).first()
        settled, swung = not changed, k >= 2 and not again and bool(changed) and not graphalytics
        unstage(last)
        last, now = new, new.drop("older")
    out = now.select("id", "value")
    return Result(out, k, settled, {"communityCount": out.select("value").distinct().count(), "oscillated": swung})


# --- kernels in one process -------------------------------------------------------------


class Local:
    """A graph of checked size in compressed rows, vertices in id order."""

    def __init__(self, vertices: DataFrame, edges: DataFrame, simple: bool, work: bool = False):
        n, m = vertices.count(), edges.count()
        if n + m > MAX_LOCAL:
            raise NotSupported(f"{n} vertices and {m} edges; this algorithm takes {MAX_LOCAL} together")
        if work and n * m > MAX_PAIRS_WORK:
            raise NotSupported(f"{n} vertices times {m} edges is more than {MAX_PAIRS_WORK}")
        self.ids = np.sort(vertices.toPandas()["id"].to_numpy(np.int64))
        e = edges.select("src", "dst", "weight").toPandas()
        a, b = np.searchsorted(self.ids, e["src"].to_numpy(np.int64)), np.searchsorted(self.ids, e["dst"].to_numpy(np.int64))
        w = e["weight"].to_numpy(float)
        if simple:
            both = np.unique(a * len(self.ids) + b)
            a, b, w = both // max(len(self.ids), 1), both % max(len(self.ids), 1), np.ones(len(both))
        order = np.lexsort((b, a))
        self.to, self.weight = b[order], w[order]
        self.start = np.searchsorted(a[order], np.arange(len(self.ids) + 1))

    def next(self, v: int) -> np.ndarray:
        return self.to[self.start[v] : self.start[v + 1]]


def _moves(ids: np.ndarray, start: np.ndarray, to: np.ndarray, total: float, resolution: float, max_iterations: int):
    """Local moves over vertices in id order: the community of each, rounds, and whether the last still moved one."""
    n = len(ids)
    deg = np.diff(start).astype(float)
    home, mass = np.arange(n), deg.copy()
    rounds, moved = 0, False
    while rounds < max_iterations:
        rounds += 1
        moved = False
        for v in range(n):
            links = defaultdict(float)
            for u in to[start[v] : start[v + 1]].tolist():
                links[int(home[u])] += 1.0
            old = int(home[v])
            mass[old] -= deg[v]
            worth = lambda c: links.get(c, 0.0) - resolution * mass[c] * deg[v] / total  # noqa: B023, E731
            best, top = old, worth(old)
            for c in sorted(links):
                if c != old and worth(c) > top:
                    best, top = c, worth(c)
            mass[best] += deg[v]
            if best != old:
                home[v] = best
                moved = True
        if not moved:
            break
    return home, rounds, moved


def louvain(vertices: DataFrame, edges: DataFrame, *, max_iterations: int = 20, resolution: float = 1.0, **_) -> Result:
    """One level of local moves over vertices in id order, unweighted and undirected; communities bear their least id.

    A move looks at the communities of neighbours only, so connected components do not touch
    each other: each is worked out whole in one task, and gives what one pass over all would.
    """
    spark = vertices.sparkSession
    E = staged(both_ways(edges), "edges")
    total = E.count()
    single = vertices.select("id", F.col("id").alias("value"))
    if total == 0:
        return Result(single, 0, True, {"modularity": 0.0, "communityCount": vertices.count()})
    parts = wcc(vertices, edges).values.select(F.col("id").alias("src"), F.col("value").alias("part"))
    E = staged(E.join(apart(parts), "src").select("src", "dst", "part"), "edges")
    if total > MAX_LOCAL:
        most = E.groupBy("part").count().agg(F.max("count")).first()[0]
        if most > MAX_LOCAL:
            raise NotSupported(f"a connected component of {most} edges; this algorithm takes {MAX_LOCAL}")

    def run(batches):
        cols = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not sum(len(a) for a, _ in cols):
            return
        src, dst = np.concatenate([a for a, _ in cols]), np.concatenate([b for _, b in cols])
        del cols
        ids = np.unique(src)
        src, dst = np.searchsorted(ids, src), np.searchsorted(ids, dst)
        order = np.lexsort((dst, src))
        src, dst = src[order], dst[order]
        start = np.searchsorted(src, np.arange(len(ids) + 1))
        home, rounds, moved = _moves(ids, start, dst, float(total), resolution, max_iterations)
        inside = np.bincount(src, home[src] == home[dst], len(ids)).astype(np.int64)
        least = np.full(len(ids), NEVER)
        np.minimum.at(least, home, ids)
        full = [ids, least[home], inside, np.diff(start).astype(np.int64), np.full(len(ids), rounds), np.full(len(ids), int(moved))]
        for at in range(0, len(ids), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000], pa.int64()) for x in full], names=["id", "value", "inside", "deg", "rounds", "moved"])

    tasks = max(spark.sparkContext.defaultParallelism, total // 2_000_000)
    found = staged(E.repartition(tasks, "part").mapInArrow(run, "id bigint, value bigint, inside bigint, deg bigint, rounds bigint, moved bigint"), "communities")
    unstage(E)
    rounds, moved = found.agg(F.max("rounds"), F.max("moved")).first()
    groups = found.groupBy("value").agg(F.sum("inside").alias("i"), F.sum("deg").alias("d"))
    share = F.col("d") / F.lit(float(total))
    quality, n = groups.agg(F.sum(F.col("i") / F.lit(float(total)) - F.lit(resolution) * share * share), F.count(F.lit(1))).first()
    out = staged(single.join(apart(found.select("id", F.col("value").alias("best"))), "id", "left").select("id", F.coalesce("best", "value").alias("value"), F.col("best").isNull().alias("alone")), "values")
    return Result(out.select("id", "value"), rounds, not moved, {"modularity": float(quality), "communityCount": n + out.where("alone").count()})


def _per_source(vertices: DataFrame, g: Local, one) -> DataFrame:
    """Run ``one(graph, source offset)`` for every vertex, spread over the executors; gives (id, value) parts."""
    sent = vertices.sparkSession.sparkContext.broadcast(g)  # its size has been checked

    def run(batches):
        for batch in batches:
            total = defaultdict(float)
            for v in np.searchsorted(sent.value.ids, batch.column(0).to_numpy()).tolist():
                for u, x in one(sent.value, v):
                    total[u] += x
            yield pa.RecordBatch.from_arrays([pa.array([int(sent.value.ids[u]) for u in total], pa.int64()), pa.array(list(total.values()), pa.float64())], names=["id", "part"])

    parts = max(vertices.sparkSession.sparkContext.defaultParallelism, 1)
    return vertices.select("id").repartition(parts).mapInArrow(run, "id bigint, part double").groupBy("id").agg(F.sum("part").alias("value"))


def _brandes(g: Local, s: int):
    n = len(g.ids)
    far, ways = np.full(n, -1), np.zeros(n)
    far[s], ways[s] = 0, 1.0
    order, before = [s], defaultdict(list)
    for v in order:
        for u in g.next(v).tolist():
            if u == v:
                continue
            if far[u] < 0:
                far[u] = far[v] + 1
                order.append(u)
            if far[u] == far[v] + 1:
                ways[u] += ways[v]
                before[u].append(v)
    lean = np.zeros(n)
    for u in reversed(order):
        for v in before[u]:
            lean[v] += ways[v] / ways[u] * (1 + lean[u])
        if u != s:
            yield u, float(lean[u])
    yield s, 0.0


def betweenness(vertices: DataFrame, edges: DataFrame, *, undirected: bool = False, **_) -> Result:
    """Exact, unweighted, parallel edges once; halved where edges have no direction."""
    g = Local(vertices, edges, simple=True, work=True)
    out = _per_source(vertices, g, _brandes)
    return Result(vertices.join(out, "id", "left").select("id", (F.coalesce("value", F.lit(0.0)) / (2 if undirected else 1)).alias("value")))


def _closeness(g: Local, s: int):
    n = len(g.ids)
    far = np.full(n, -1)
    far[s] = 0
    order = [s]
    for v in order:
        for u in g.next(v).tolist():
            if far[u] < 0:
                far[u] = far[v] + 1
                order.append(u)
    reached, total = len(order) - 1, int(far[order].sum())
    yield s, (reached / total) * (reached / (n - 1)) if total and n > 1 else 0.0


def closeness(vertices: DataFrame, edges: DataFrame, **_) -> Result:
    """Of each vertex, over what it reaches: ``(r / sum of distances) * (r / (n - 1))``."""
    g = Local(vertices, edges, simple=True, work=True)
    out = _per_source(vertices, g, _closeness)
    return Result(vertices.join(out, "id", "left").select("id", F.coalesce("value", F.lit(0.0)).alias("value")))


def _distances(E: DataFrame, start: int, bound: float, stop: int | None = None) -> tuple[DataFrame, bool, float | None]:
    """``(id, value)``: distances from ``start`` up to ``bound``; whether some were longer; the distance of ``stop``.

    With ``stop`` the bound falls to its distance as soon as a route to it is known.
    """
    known = front = staged(E.sparkSession.range(1).select(F.lit(start).cast("bigint").alias("id"), F.lit(0.0).alias("value")), "distances")
    cut, met = False, None
    while True:
        offers = E.join(front.select(F.col("id").alias("src"), "value"), "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.col("value") + F.col("weight")).alias("value"))
        better = offers.join(known.withColumnRenamed("value", "old"), "id", "left").where("old IS NULL OR value < old").select("id", "value")
        better = staged(better, "better")
        n, far, at = better.agg(F.count(F.lit(1)), F.max("value"), F.min(F.when(F.col("id") == F.lit(stop), F.col("value")))).first()
        if at is not None:
            met, bound = at, min(bound, at * (1 + 1e-9))
        if n and far > bound:
            cut, better = True, better.where(F.col("value") <= bound)
        front = better
        if not n or not front.limit(1).count():
            return known, cut, met
        known = staged(known.join(apart(better.select("id")), "id", "left_anti").union(better), "distances")


def k_shortest(vertices: DataFrame, edges: DataFrame, *, source: int, target: int, k: int = 1, **_) -> list[tuple[float, list[int]]]:
    """The ``k`` cheapest loopless routes, cheapest first, ties by their nodes.

    A graph of more than ``SMALL`` vertices and edges stays where it is: only the vertices that lie on
    a route of at most ``bound`` are held in one process, and the bound grows until it takes in
    the ``k``-th route (or nothing lies beyond it).
    """
    if vertices.count() + edges.count() <= SMALL:
        return _yen(Local(vertices, edges, simple=False), source, target, k)
    ends = vertices.where(F.col("id").isin(source, target)).distinct().count()
    if ends < len({source, target}):
        return []
    E = staged(edges.groupBy("src", "dst").agg(F.min("weight").alias("weight")), "edges")
    least, positive = E.agg(F.min("weight"), F.min(F.when(F.col("weight") > 0, F.col("weight")))).first()
    if least is not None and least < 0:
        raise ArgumentError("a negative weight")
    if source == target:
        return [(0.0, [source])]
    back = E.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    _, _, first = _distances(E, source, float("inf"), target)
    if first is None:
        return []
    step = max(first, positive or 1.0)
    bound = first + (step if k > 1 else 0.0)
    while True:
        limit = bound * (1 + 1e-9)
        ahead, cut, _ = _distances(E, source, limit)
        behind, cut_back, _ = _distances(back, target, limit)
        within = ahead.join(behind.withColumnRenamed("value", "rest"), "id")
        if cut or cut_back:
            within = within.where(F.col("value") + F.col("rest") <= limit)
        within = staged(within.select("id"), "within")
        inner = E.join(within.select(F.col("id").alias("src")), "src", "left_semi").join(within.select(F.col("id").alias("dst")), "dst", "left_semi")
        found = _yen(Local(within, staged(inner.select("src", "dst", "weight"), "inner"), simple=False), source, target, k)
        full = len(found) >= k
        if (full and found[-1][0] <= limit) or not (cut or cut_back):
            return found
        bound = found[-1][0] if full else bound + step
        step *= 2


def _yen(g: Local, source: int, target: int, k: int) -> list[tuple[float, list[int]]]:
    """The routes of ``k_shortest`` in a graph that is held here."""
    spot = {int(v): i for i, v in enumerate(g.ids)}
    if source not in spot or target not in spot:
        return []
    a, b = spot[source], spot[target]

    def route(start: int, closed: set, cut: set) -> tuple[float, list[int]] | None:
        heap, done = [(0.0, [start])], set()
        while heap:
            cost, path = heapq.heappop(heap)
            v = path[-1]
            if v == b:
                return cost, path
            if v in done:
                continue
            done.add(v)
            for i in range(g.start[v], g.start[v + 1]):
                u = int(g.to[i])
                if u not in closed and u not in done and (len(path) > 1 or u not in cut):
                    heapq.heappush(heap, (cost + float(g.weight[i]), [*path, u]))
        return None

    def cost_of(path: list[int]) -> float:
        return sum(min(float(g.weight[i]) for i in range(g.start[v], g.start[v + 1]) if g.to[i] == u) for v, u in zip(path, path[1:], strict=False))

    if len(g.weight) and g.weight.min() < 0:
        raise ArgumentError("a negative weight")
    first = route(a, set(), set())
    found, offers = [first] if first else [], []
    while found and len(found) < k:
        last = found[-1][1]
        for i in range(len(last) - 1):
            root = last[: i + 1]
            cut = {p[i + 1] for _, p in found if p[: i + 1] == root and len(p) > i + 1}
            spur = route(root[-1], set(root[:-1]), cut)
            if spur:
                path = root[:-1] + spur[1]
                offer = (cost_of(root) + spur[0], path)
                if offer not in offers and all(path != p for _, p in found):
                    heapq.heappush(offers, offer)
        if not offers:
            break
        found.append(heapq.heappop(offers))
    return [(c, [int(g.ids[v]) for v in p]) for c, p in found]


#: Name, function, value column and its type.
ALGORITHMS = {
    "pagerank": (page_rank, "score", "float"),
    "wcc": (wcc, "componentId", "int"),
    "scc": (scc, "componentId", "int"),
    "degree": (degree, "degree", "float"),
    "bfs": (bfs, "depth", "int"),
    "sssp": (sssp, "distance", "float"),
    "trianglecount": (triangle_count, "triangleCount", "int"),
    "localclusteringcoefficient": (local_clustering, "coefficient", "float"),
    "labelpropagation": (label_propagation, "communityId", "int"),
    "louvain": (louvain, "communityId", "int"),
    "betweenness": (betweenness, "score", "float"),
    "closeness": (closeness, "score", "float"),
}
