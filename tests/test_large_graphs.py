"""Algorithms on graphs that no single process should hold, and with long paths."""

import os
import random

import numpy as np
import pytest

import __spark_entry__ as entry
from graphloom.operators import algorithms as G


def graph(spark, ids, edges):
    return spark.createDataFrame([(i,) for i in ids], "id bigint"), spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], "src bigint, dst bigint, weight double")


@pytest.fixture
def stages(monkeypatch):
    """The names of the tables that are staged and the plans that made them."""
    seen = []
    real = G.staged

    def keep(df, name="table"):
        seen.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return real(df, name)

    monkeypatch.setattr(G, "staged", keep)
    return seen


def test_strong_components_of_a_long_path(spark, stages):
    n = 200
    V, E = graph(spark, range(n), [(i, i + d, 1) for i in range(n) for d in (1, 2) if i + d < n])
    r = G.scc(V, E)
    assert r.extra["componentCount"] == n and r.rounds < 4
    assert sum(name == "spread" for name, _ in stages) <= 30


@pytest.mark.parametrize("algorithm", [G.wcc, G.label_propagation])
def test_loops_send_no_table_to_the_driver(spark, stages, algorithm):
    V, E = graph(spark, range(30), [(i, i + 1, 1) for i in range(29) if i % 10 != 9])
    got = dict(map(tuple, algorithm(V, E).values.collect()))
    if algorithm is G.wcc:
        assert got == {i: i // 10 * 10 for i in range(30)}
    assert len(got) == 30
    rounds = [plan for name, plan in stages if name.startswith(("met-", "jump-", "labels-"))]
    assert rounds and not any("Broadcast" in p for p in rounds)


def test_louvain_by_components_is_louvain(spark, monkeypatch):
    monkeypatch.setattr(G, "Local", None)
    draw = random.Random(7)
    edges = {tuple(sorted((c * 40 + draw.randrange(38), c * 40 + draw.randrange(38)))) for c in range(6) for _ in range(70)}
    edges = [(a, b, 1) for a, b in edges if a != b]
    V, E = graph(spark, range(240), edges)
    for cap in (20,):
        r = G.louvain(V, E, max_iterations=cap, resolution=1.0)
        got = dict(map(tuple, r.values.collect()))
        both = sorted({(a, b) for a, b, _ in edges} | {(b, a) for a, b, _ in edges})
        src, dst = np.array([a for a, _ in both]), np.array([b for _, b in both])
        home, rounds, moved = G._moves(np.arange(240), np.searchsorted(src, np.arange(241)), dst, float(len(both)), 1.0, cap)
        least = {}
        for v in range(240):
            least.setdefault(home[v], v)
        assert got == {v: least[home[v]] for v in range(240)}
        assert (r.rounds, r.settled, r.extra["communityCount"]) == (rounds, not moved, len(least))
        mass = {c: sum(a == v for a, _ in both for v in [a] if home[v] == c) for c in least}
        want = sum(home[a] == home[b] for a, b in both) / len(both) - sum((m / len(both)) ** 2 for m in mass.values())
        assert abs(r.extra["modularity"] - want) < 1e-12


def test_k_shortest_reads_what_lies_on_short_routes(spark, monkeypatch):
    held = []
    real = G._yen

    def keep(g, *args):
        held.append(len(g.ids))
        return real(g, *args)

    monkeypatch.setattr(G, "_yen", keep)
    draw = random.Random(3)
    near = [(a, a + d, draw.choice([0.5, 1, 2])) for a in range(120) for d in (1, 2, 3) if a + d < 120]
    V, E = graph(spark, range(120), near + [(b, a, w) for a, b, w in near])
    few = graph(spark, range(4), [(0, 1, 1), (1, 2, 1), (0, 2, 5), (2, 3, 0)])
    for (V, E), source, target, k in (((V, E), 0, 3, 4), (few, 0, 3, 5)):
        monkeypatch.setattr(G, "SMALL", 500_000)
        want = G.k_shortest(V, E, source=source, target=target, k=k)
        monkeypatch.setattr(G, "SMALL", 0)
        held.clear()
        assert G.k_shortest(V, E, source=source, target=target, k=k) == want
        assert held and all(n < 60 for n in held)


@pytest.mark.parametrize("name", ["algo_bfs", "algo_sssp"])
def test_what_the_source_does_not_reach_is_left_out(spark, small, tmp_path, name):
    import duckdb

    con = duckdb.connect()
    shifted = {"customer": ["c_custkey"], "supplier": ["s_suppkey"], "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_suppkey"]}
    for f in os.listdir(small):
        t = f.removesuffix(".parquet")
        if t in shifted:
            again = ", ".join(f"{c} + 1000000 AS {c}" for c in shifted[t])
            con.execute(f"COPY (SELECT * FROM '{small}/{f}' UNION ALL SELECT * REPLACE ({again}) FROM '{small}/{f}') TO '{tmp_path}/{f}' (FORMAT parquet)")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{f}'")
        else:
            os.symlink(f"{small}/{f}", tmp_path / f)
    got = sorted(str(tuple(r)) for r in entry.queries()[name](spark, str(tmp_path)).collect())
    assert got == sorted(str(r) for r in con.execute(entry.oracle_sql()[name]).fetchall())
