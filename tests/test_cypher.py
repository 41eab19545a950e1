"""The query engine on small graphs: rules of the language, refusals, updates, files, streams."""

import json
import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from graphloom import errors as E
from graphloom.graph import Graph
from graphloom.operators import algorithms
from graphloom.plans.compiler import Rows
from graphloom.plans.parser import parse
from graphloom.session import GraphSession
from graphloom.sources import files
from graphloom.sources.tables import with_row_id
from graphloom.storage import staged, unstage
from graphloom.streaming.changes import follow, tail


@pytest.fixture(scope="module")
def g(spark):
    """People a-b-c-d with KNOWS (one pair twice, one loop) and two cities."""
    graph = Graph(spark)
    people = [(1, "ann", 30, 1.5), (2, "bob", None, 2.5), (3, "cid", 41, None), (4, "dot", 30, 0.0)]
    graph.add_nodes("P", spark.createDataFrame(people, "id long, name string, age long, f double"))
    graph.add_nodes(["C", "Big"], spark.createDataFrame([(10, "x")], "id long, name string"))
    graph.add_nodes("C", spark.createDataFrame([(11, "y")], "id long, name string"))
    graph.add_rels("K", "P", "P", spark.createDataFrame([(1, 1, 2, 5), (2, 1, 2, 6), (3, 2, 3, 7), (4, 3, 3, 8), (5, 3, 4, None)], "id long, src long, dst long, w long"))
    graph.add_rels("IN", "P", ["C", "Big"], spark.createDataFrame([(6, 1, 10), (7, 2, 10)], "id long, src long, dst long"))
    graph.add_rels("IN", "P", "C", spark.createDataFrame([(8, 3, 11)], "id long, src long, dst long"))
    return GraphSession(spark, graph)


def rows(session, text, **params):
    return sorted((tuple(r) for r in session.cypher(text, **params).collect()), key=str)


CASES = [
    ("MATCH (a:P)-[:K]->(b) RETURN count(*) AS n", [(5,)]),
    ("MATCH (a:P)-[:K]-(b) RETURN count(*) AS n", [(9,)]),  # a loop is met once
    ("MATCH (a)-[x:K]->(b)<-[y:K]-(c) RETURN count(*) AS n", [(4,)]),  # two ways each over 1-2 and into 3
    ("MATCH (a)-[x:K]->(b) MATCH (c)-[y:K]->(b) RETURN count(*) AS n", [(9,)]),
    ("MATCH (a {name: 'ann'})-[:K*1..3]->(b) RETURN b.name AS b, count(*) AS n", [("bob", 2), ("cid", 4), ("dot", 2)]),
    ("MATCH (a {name: 'ann'})-[:K*]->(b) RETURN count(*) AS n", [(10,)]),
    ("MATCH (a {name: 'ann'})-[:K*]->(b) RETURN DISTINCT b.name AS b", [("bob",), ("cid",), ("dot",)]),
    ("MATCH (a {name: 'cid'})-[r:K*0..1]->(b) RETURN size(r) AS n, b.name AS b", [(0, "cid"), (1, "cid"), (1, "dot")]),
    ("MATCH p = shortestPath((a {name: 'ann'})-[:K*]->(b {name: 'dot'})) RETURN length(p) AS n, [x IN nodes(p) | x.name] AS s", [(3, ["ann", "bob", "cid", "dot"])]),
    ("MATCH p = allShortestPaths((a {name: 'ann'})-[:K*]->(b {name: 'dot'})) RETURN reduce(s = 0, r IN relationships(p) | s + coalesce(r.w, 0)) AS w", [(12,), (13,)]),
    ("MATCH (a)-[rs:K*1..2]->(b) WHERE all(r IN rs WHERE r.w > 5) RETURN count(*) AS n", [(5,)]),
    ("MATCH (n:C:Big) RETURN n.name AS n", [("x",)]),
    ("MATCH (c:C) RETURN c.name AS c, c:Big AS b, labels(c) AS l", [("x", True, ["Big", "C"]), ("y", False, ["C"])]),
    ("MATCH (a:P) OPTIONAL MATCH (a)-[:IN]->(c:Big) RETURN a.name AS a, c.name AS c", [("ann", "x"), ("bob", "x"), ("cid", None), ("dot", None)]),
    ("MATCH (a:P) WHERE (a)-[:IN]->(:Big) RETURN a.name AS a", [("ann",), ("bob",)]),
    ("MATCH (a:P) WHERE NOT (a)-[:IN]->() OR a.age > 40 RETURN a.name AS a", [("cid",), ("dot",)]),
    ("MATCH (a:P) RETURN a.age AS a, count(*) AS n, collect(a.f) AS f", [(30, 2, [1.5, 0.0]), (41, 1, []), (None, 1, [2.5])]),
    ("MATCH (a:P) RETURN a.age + count(*) AS n, a.age AS k", [(32, 30), (42, 41), (None, None)]),
    ("MATCH (a:P) WITH a ORDER BY a.age DESC, a.name LIMIT 2 RETURN a.name AS n", [("bob",), ("cid",)]),
    ("MATCH (a:P) RETURN a.name", [("ann",), ("bob",), ("cid",), ("dot",)]),
    ("MATCH (a:P)-[r:K]->(b) RETURN DISTINCT a, b.name AS b", None),
    ("MATCH (a:P)-[:IN]->(c) WITH c, collect(a) AS xs UNWIND xs AS x MATCH (x)-[:K]->(y) RETURN c.name AS c, y.name AS y", [("x", "bob"), ("x", "bob"), ("x", "cid"), ("y", "cid"), ("y", "dot")]),
    ("MATCH (a:P) CALL (a) { MATCH (a)-[:K]->(b) RETURN b ORDER BY b.name LIMIT 1 } RETURN a.name AS a, b.name AS b", [("ann", "bob"), ("bob", "cid"), ("cid", "cid")]),
    ("MATCH (a:P) CALL (a) { MATCH (a)-[:K]->(b) RETURN count(DISTINCT b) AS n } RETURN a.name AS a, n", [("ann", 1), ("bob", 1), ("cid", 2), ("dot", 0)]),
    ("MATCH (a:P) RETURN a.name AS a, COUNT { (a)-[:K]->() } AS n, [(a)-[r:K]->(b) WHERE r.w > 5 | b.name] AS b", [("ann", 2, ["bob"]), ("bob", 1, ["cid"]), ("cid", 2, ["cid"]), ("dot", 0, [])]),
    ("RETURN 1 = 1.0 AS a, 1 = 'a' AS b, 1 < 'a' AS c, [1, 2] = [1, null] AS d, [1] = [1, 2] AS e, null = null AS f, {a: 1} = {a: 1} AS g", [(True, False, None, None, False, None, True)]),
    ("RETURN 7 / 2 AS a, -7 / 2 AS b, 7 % -3 AS c, 2 ^ 3 ^ 2 AS d, 1.0 / 0 AS e, -1.0 / 0 AS f, 'a' + 1 AS g, [1] + 2 AS h, 0 + [1] AS i", [(3, -3, 1, 64.0, float("inf"), float("-inf"), "a1", [1, 2], [0, 1])]),
    ("RETURN [1, 2, 3][0] AS a, [1, 2, 3][-1] AS b, [1][5] AS c, [1, 2, 3][1..] AS d, [1, 2, 3][..-1] AS e, [1, 2, 3][2..1] AS f, [1][null] AS g", [(1, 3, None, [2, 3], [1, 2], [], None)]),
    ("RETURN 'abc' =~ 'a.*' AS a, 'abc' =~ 'b' AS b, 'A1' STARTS WITH 'A' AS c, 'x' CONTAINS null AS d, 5 STARTS WITH 'a' AS e", [(True, False, True, None, None)]),
    ("RETURN toInteger('12') AS a, toInteger('2.9') AS b, toInteger('z') AS c, toFloat('1e2') AS d, toBoolean('TRUE') AS e, toString(1.0) AS f, toString(0.5) AS g, toInteger(-2.9) AS h", [(12, 2, None, 100.0, True, "1.0", "0.5", -2)]),
    ("RETURN date('2020-01-31') + duration('P1M') = date('2020-02-29') AS a, duration.between(date('2020-02-29'), date('2019-01-31')).months AS b, date('2021-01-01') > date('2020-12-31') AS c, localtime('12:00') + duration('PT13H') = localtime('01:00') AS d", [(True, -12, True, True)]),
    ("RETURN duration.between(datetime('2020-01-01T00:00Z'), datetime('2020-01-02T01:00Z') + duration('PT2H')).hours AS h, datetime({year: 2020, month: 7, timezone: 'Europe/Berlin'}).month AS m, toStringOrNull([1]) AS t", [(3, 6, None)]),
    ("RETURN date.truncate('week', date('2024-05-16')) = date('2024-05-13') AS a, date({year: 2020, week: 1}) = date('2019-12-30') AS b, datetime('2020-01-01T00:00:00+02:00') = datetime('2019-12-31T22:00:00Z') AS c", [(True, True, True)]),
    ("UNWIND [] AS x RETURN count(x) AS n, sum(x) AS s, collect(x) AS c", [(0, 0, [])]),
    ("UNWIND null AS x RETURN x", []),
    ("UNWIND [1, 2, 2] AS x RETURN x UNION UNWIND [2, 3] AS x RETURN x", [(1,), (2,), (3,)]),
    ("WITH 1 AS a, 2 AS b RETURN *", [(1, 2)]),
    ("UNWIND [3, 1, 2] AS x WITH x ORDER BY x SKIP 1 RETURN collect(x) AS xs", [([2, 3],)]),
    ("RETURN CASE 2 WHEN 1 THEN 'a' WHEN 2 THEN 'b' END AS x, CASE WHEN null THEN 1 ELSE 2 END AS y", [("b", 2)]),
    ("RETURN any(x IN [1, null] WHERE x = 1) AS a, all(x IN [1, null] WHERE x = 1) AS b, none(x IN [] WHERE x = 1) AS c, single(x IN [1, 1] WHERE x = 1) AS d", [(True, None, True, False)]),
    ("RETURN range(3, 1) AS a, range(3, 1, -1) AS b, size('日本') AS c, substring('hello', 1, 3) AS d, split('a.b', '.') AS e, trim('\\t x \\n') AS f", [([], [3, 2, 1], 2, "ell", ["a", "b"], "x")]),
    ("MATCH (a:P {name: 'ann'}) RETURN a {.name, .age, z: 1} AS m", None),
    ("CALL db.propertyKeys() YIELD propertyKey AS k RETURN collect(k) AS ks", [(["age", "f", "name", "w"],)]),
]


@pytest.mark.parametrize("text,want", CASES, ids=range(len(CASES)))
def test_statement(g, text, want):
    got = rows(g, text)
    if want is not None:
        assert got == sorted(want, key=str)
    else:
        assert got


COUNTS = [
    "MATCH (a)-[:K]->(b)<-[:K]-(c)-[:IN]->(d) RETURN count(*) AS n",
    "MATCH (a)-[:K]-(b)-[:K]-(c)-[:K]-(a) RETURN count(*) AS n",
    "MATCH (a:P)-[:IN]->(c)<-[:IN]-(b:P), (a)-[:K]-(x)-[:K]-(y) WHERE a <> b RETURN count(*) AS n",
    "MATCH (a:P) OPTIONAL MATCH (a)-[:K]->(b) OPTIONAL MATCH (a)-[:IN]->(c) RETURN count(*) AS n",
    "MATCH (a)-[:K]-(b)-[:K]-(c) WHERE NOT (a)-[:K]-(c) AND a <> c RETURN count(*) AS n",
    "MATCH (a)-[r:K]->(b)-[:IN]->(c) WHERE r.w > 5 RETURN count(*) AS n",
]


@pytest.mark.parametrize("text", COUNTS)
def test_folded_counts_equal_plain_ones(g, text, monkeypatch):
    folded = rows(g, text)
    monkeypatch.setattr(Rows, "fold_counts", False)
    assert rows(g, text) == folded


REFUSED = [
    ("MATCH (n) RETURN m", E.SemanticError),
    ("MATCH (n) WHERE m.x = 1 RETURN n", E.SemanticError),
    ("RETURN nosuch(1) AS x", E.SemanticError),
    ("MATCH (n)", E.SyntaxError_),
    ("RETURN 1 AS a UNION RETURN 1 AS b", E.SemanticError),
    ("RETURN 1 AS a UNION RETURN 1 AS a UNION ALL RETURN 1 AS a", E.SyntaxError_),
    ("WITH 1 + 1 RETURN 2 AS x", E.SemanticError),
    ("MATCH (n) RETURN (n)-->() AS x", E.SemanticError),
    ("MATCH (n) RETURN n.name AS x ORDER BY count(*)", E.CypherError),
    ("RETURN 'a' =~ '(a)\\\\1' AS x", E.ArgumentError),
    ("RETURN $missing AS x", E.ArgumentError),
    ("CALL db.labels() YIELD nothing RETURN nothing", E.SemanticError),
    ("CALL graph.algo.pageRank.stream({toleranc: 1}) YIELD score RETURN score", E.ArgumentError),
    ("RETURN 9223372036854775808 AS x", E.SyntaxError_),
    ("MATCH (n) RETURN sum(n.name) AS x", E.ArgumentError),
]


@pytest.mark.parametrize("text,kind", REFUSED)
def test_refusals_come_before_anything_runs(g, text, kind):
    with pytest.raises(kind):
        g.cypher(text)


def test_truncated_walks(g):
    s = GraphSession(g.spark, g.graph, expand_truncation=(1, "w"))
    assert rows(s, "MATCH (a {name: 'ann'})-[r:K*1..2]->(b) RETURN b.name AS b, size(r) AS n") == [("bob", 1), ("cid", 2)]


def test_deep_nesting_is_refused():
    with pytest.raises(E.SyntaxError_):
        parse("RETURN " + "(" * 200 + "1" + ")" * 200 + " AS x")


def test_updates_in_a_row(spark):
    s = GraphSession(spark)
    s.cypher("CREATE (a:P {name: 'a', x: 1})-[:K {w: 2}]->(b:P {name: 'b', x: 2.5}), (c:Q {name: 'c'})")
    assert rows(s, "MATCH (p:P) RETURN p.name AS n, p.x AS x") == [("a", 1.0), ("b", 2.5)]
    assert rows(s, "UNWIND ['x', 'y', 'x'] AS n MERGE (t:T {name: n}) ON CREATE SET t.new = true RETURN t.name AS n, t.new AS m") == [("x", True), ("x", True), ("y", True)]
    assert rows(s, "UNWIND ['x', 'z'] AS n MERGE (t:T {name: n}) ON MATCH SET t.met = true RETURN n, t.met AS m") == [("x", True), ("z", None)]
    assert rows(s, "MATCH (a:P {name: 'a'}) SET a.x = a.x + 10, a:New RETURN a.x AS x, labels(a) AS l") == [(11.0, ["New", "P"])]
    assert rows(s, "MATCH (a:New)-[r:K]->(b) SET r.w = 9 RETURN r.w AS w, b.name AS b") == [(9, "b")]
    assert rows(s, "MATCH (a:New) REMOVE a:New, a.x RETURN labels(a) AS l, a.x AS x") == [(["P"], None)]
    with pytest.raises(E.ExecutionFailed):
        s.cypher("MATCH (a:P {name: 'b'}) DELETE a")
    assert rows(s, "MATCH (n) RETURN count(*) AS n") == [(6,)]
    s.cypher("MATCH (a:P {name: 'b'}) DETACH DELETE a")
    assert rows(s, "MATCH (n) OPTIONAL MATCH (n)-[r]->() RETURN count(DISTINCT n) AS n, count(r) AS r") == [(5, 0)]
    s.cypher("CREATE CONSTRAINT one FOR (t:T) REQUIRE t.name IS UNIQUE")
    with pytest.raises(E.ExecutionFailed):
        s.cypher("CREATE (:T {name: 'x'})")
    with pytest.raises(E.ExecutionFailed):
        s.cypher("MERGE (:T {name: null})")
    assert rows(s, "MATCH (t:T) RETURN count(*) AS n") == [(3,)]
    s.cypher("DROP CONSTRAINT one")
    with pytest.raises(E.SemanticError):
        s.cypher("DROP CONSTRAINT one")


def test_algorithms_on_known_graphs(spark):
    graph = Graph(spark)
    graph.add_nodes("V", spark.createDataFrame([(i,) for i in range(1, 8)], "id long"))
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6)]
    graph.add_rels("E", "V", "V", spark.createDataFrame([(i, a, b, 1.0 + i) for i, (a, b) in enumerate(edges)], "id long, src long, dst long, w double"))
    s = GraphSession(spark, graph)
    run = lambda name, col, cfg="{}": dict(rows(s, f"CALL x.algo.{name}.stream({cfg}) YIELD nodeId, {col} RETURN nodeId, {col}"))
    assert run("wcc", "componentId") == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6, 7: 7}
    assert run("scc", "componentId") == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7}
    assert run("bfs", "depth", "{sourceNode: 1}") == {1: 0, 2: 1, 3: 2, 4: 3, 5: 4, 6: None, 7: None}
    assert run("sssp", "distance", "{sourceNode: 1, relationshipWeightProperty: 'w'}") == {1: 0.0, 2: 1.0, 3: 3.0, 4: 7.0, 5: 12.0, 6: None, 7: None}
    assert run("triangleCount", "triangleCount") == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0, 7: 0}
    assert run("localClusteringCoefficient", "coefficient")[3] == pytest.approx(1 / 3)
    rank = run("pageRank", "score", "{maxIterations: 60}")
    assert sum(rank.values()) == pytest.approx(1) and rank[4] > rank[3] > rank[7]
    assert run("betweenness", "score")[3] == 5.0 and run("closeness", "score")[1] == pytest.approx((4 / 10) * (4 / 6))
    assert run("labelPropagation", "communityId")[7] == 7 and run("louvain", "communityId")[2] == 1
    assert rows(s, "CALL x.algo.kShortestPaths.stream({sourceNode: 1, targetNode: 4, k: 2}) YIELD totalCost, nodeIds RETURN totalCost, nodeIds") == [(3.0, [1, 2, 3, 4])]
    assert rows(s, "CALL x.algo.wcc.stats({}) YIELD nodeCount, distribution RETURN nodeCount, distribution.componentCount AS c") == [(7, 3.0)]


def test_a_call_is_configured_by_each_row(spark):
    """0 is isolated, 1 to 5 form a weighted chain."""
    graph = Graph(spark).add_nodes("V", spark.createDataFrame([(i, i) for i in range(6)], "id long, k long"))
    graph.add_rels("E", "V", "V", spark.createDataFrame([(i, i, i + 1, float(i)) for i in range(1, 5)], "id long, src long, dst long, w double"))
    s = GraphSession(spark, graph)
    each = (
        "MATCH (s:V) WHERE s.k IN $ks WITH s ORDER BY s.k {} CALL x.algo.sssp.stream({{nodeLabels: ['V'], relationshipTypes: ['E'], orientation: 'UNDIRECTED', "
        "relationshipWeightProperty: 'w', sourceNode: id(s)}}) YIELD nodeId, distance WITH s, count(distance) AS reached, sum(distance) AS total RETURN s.k AS k, reached, total"
    )
    want = {0: (0, 1, 0.0), 1: (1, 5, 20.0), 3: (3, 5, 15.0)}
    for order in ("ASC", "DESC"):
        assert rows(s, each.format(order), ks=[0, 1, 3]) == list(want.values())
    for k, row in want.items():
        assert rows(s, each.format("ASC"), ks=[k]) == [row]
    assert rows(s, each.format("ASC"), ks=[99]) == []
    assert rows(s, "UNWIND [1, 3, 3] AS x CALL a.algo.bfs.stream({sourceNode: x}) YIELD nodeId, depth WHERE depth = 0 RETURN x, nodeId") == [(1, 1), (3, 3), (3, 3)]
    assert rows(s, "UNWIND range(1, 4) AS i CALL x.algo.wcc.stream({}) YIELD nodeId RETURN count(*) AS n") == [(24,)]
    s.cypher("CREATE FULLTEXT INDEX t FOR (d:V) ON EACH [d.name]")
    s.cypher("MATCH (v:V) SET v.name = CASE v.k WHEN 1 THEN 'हिन्दी text' WHEN 2 THEN 'other words' ELSE 'none' END")
    assert rows(s, "UNWIND ['हिन्दी', 'OTHER', '', 'absent'] AS q CALL db.index.fulltext.queryNodes('t', q) YIELD node RETURN q, node.k AS k") == [("OTHER", 2), ("हिन्दी", 1)]


def test_strong_components_against_brute_force(spark):
    rng = random.Random(2)
    graphs = [[(i, i + 1) for i in range(40)], [(i + 1, i) for i in range(40)], [(i, (i + 1) % 30) for i in range(30)] + [(40, 41)]]
    graphs += [[(rng.randrange(40), rng.randrange(40)) for _ in range(m)] for m in (30, 60)]
    for edges in graphs:
        reach = {v: {v} for v in range(42)}
        for _ in range(42):
            for a, b in edges:
                reach[a] |= reach[b]
        want = {v: min(u for u in reach[v] if v in reach[u]) for v in range(42)}
        frame = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "src long, dst long, weight double")
        found = algorithms.scc(spark.range(42), frame)
        assert {r.id: r.value for r in found.values.collect()} == want and found.extra["componentCount"] == len(set(want.values()))
        assert found.rounds <= 6, "rounds do not grow with a path"


def test_rows_of_many_files_keep_different_ids(spark, tmp_path):
    for folder in ("one part", "two"):
        for i in range(150):
            where = tmp_path / folder
            where.mkdir(exist_ok=True)
            pq.write_table(pa.table({"a": [i, i, 7], "_x": [1, 2, 3]}), where / f"part-{i}.parquet")
    df = spark.read.parquet(str(tmp_path / "one part"), str(tmp_path / "two"))
    out = with_row_id(df)
    assert out.count() == 900 and out.select("row_id").distinct().count() == 900
    some = with_row_id(df).where("a = 7")
    assert some.join(out.select("row_id", F.col("_x").alias("x")), "row_id").where("x = _x").count() == some.count()


def test_search(spark):
    graph = Graph(spark).add_nodes("D", spark.createDataFrame([(1, "Red fox, red-hot"), (2, "blue fox"), (3, None), (4, "nothing")], "id long, text string"))
    graph.add_nodes("E", spark.createDataFrame([(5, [1.0, 0.0]), (6, [0.0, 2.0]), (7, [0.0, 0.0]), (8, None), (9, [1.0, 1.0, 1.0])], "id long, v array<double>"))
    s = GraphSession(spark, graph)
    s.cypher("CREATE FULLTEXT INDEX t FOR (d:D) ON EACH [d.text]")
    s.cypher("CREATE VECTOR INDEX v FOR (e:E) ON (e.v)")
    found = rows(s, "CALL db.index.fulltext.queryNodes('t', 'RED') YIELD node, score RETURN id(node) AS i, score > 0 AS p")
    assert found == [(1, True)]
    near = s.cypher("CALL db.index.vector.queryNodes('v', 5, $q) YIELD node, score RETURN id(node) AS i, score", q=[1.0, 1.0]).collect()
    assert [(r.i, round(r.score, 6)) for r in near] == [(5, 0.707107), (6, 0.707107)]
    with pytest.raises(E.ArgumentError):
        s.cypher("CALL db.index.vector.queryNodes('v', 5, [0.0, 0.0])")


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "nodes.jsonl").write_text("\n".join(json.dumps(x) for x in [{"i": "p:1", "l": ["P"], "p": {"name": "a", "n": {"~bigint": "7"}}}, {"i": "p:2", "l": ["P", "Q"], "p": {"name": "b"}}]))
    (tmp_path / "rels.jsonl").write_text("\n".join(json.dumps(x) for x in [{"s": "p:1", "d": "p:2", "t": "K", "p": {"w": 1}}, {"s": "p:1", "d": "p:9", "t": "K"}]))
    s = GraphSession(spark, files.read_jsonl(spark, str(tmp_path)))
    assert rows(s, "MATCH (a:P)-[r:K]->(b:Q) RETURN a.name AS a, a.n AS n, r.w AS w, b.name AS b") == [("a", 7, 1, "b")]
    files.write_jsonl(s.graph, str(tmp_path / "out"))
    again = GraphSession(spark, files.read_jsonl(spark, str(tmp_path / "out")))
    assert rows(again, "MATCH (a)-[r:K]->(b) RETURN a.name AS a, r.w AS w, b.name AS b") == [("a", 1, "b")]
    files.write_import_csv(s.graph, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv/rels_0_K"), header=True).columns == [":START_ID", ":END_ID", "w", ":TYPE"]
    (tmp_path / "g.v").write_text("1\n2\n3\n")
    (tmp_path / "g.e").write_text("1 2 0.5\n2 3\n")
    adj = GraphSession(spark, files.read_adjacency(spark, str(tmp_path / "g.v"), str(tmp_path / "g.e"), directed=False))
    assert rows(adj, "MATCH (a:V)-[e:E]->(b) RETURN a.vid AS a, b.vid AS b, e.weight AS w") == [(1, 2, 0.5), (2, 1, 0.5), (2, 3, 1.0), (3, 2, 1.0)]
    (tmp_path / "A.csv").write_text("k|name\n1|x\n2|y\n")
    (tmp_path / "AtoA.csv").write_text("f|t|amount\n1|2|5\n1|2|6\n")
    table = files.TableMap([("A", ("A",), "k")], [("AtoA", "PAY", ("A", "f"), ("A", "t"))])
    pay = GraphSession(spark, files.read_tables(spark, str(tmp_path), table))
    assert rows(pay, "MATCH (a:A)-[p:PAY]->(b) RETURN a.name AS a, b.name AS b, sum(p.amount) AS s") == [("x", "y", 11)]
    social = tmp_path / "social"
    for name, text in {
        "Person": "id|firstName|LocationCityId\n7|ann|1\n8|bob|\n",
        "Place": "id|name|type|PartOfPlaceId\n1|Ulm|City|2\n2|DE|Country|3\n3|Europe|Continent|\n",
        "Post": "id|content|CreatorPersonId|ContainerForumId|LocationCountryId\n1|hello|7|5|2\n",
        "Comment": "id|content|CreatorPersonId|LocationCountryId|ParentPostId|ParentCommentId\n1|yes|8|2|1|\n2|no|7|2||1\n",
        "Person_likes_Post": "creationDate|PersonId|PostId\n2012|8|1\n",
    }.items():
        (social / name).mkdir(parents=True)
        (social / name / "part-0.csv").write_text(text)
    s = GraphSession(spark, files.read_tables(spark, str(social), files.SOCIAL.part({"Person", "Place", "Post", "Comment", "Person_likes_Post"})))
    assert rows(s, "MATCH (c:Message)-[:REPLY_OF*1..]->(p:Post) RETURN c.content AS c, p.content AS p") == [("no", "hello"), ("yes", "hello")]
    assert rows(s, "MATCH (p:Person)-[:IS_LOCATED_IN]->(c:City)-[:IS_PART_OF*2]->(k) RETURN p.firstName AS p, k.name AS k") == [("ann", "Europe")]
    assert rows(s, "MATCH (p:Person)-[l:LIKES]->(m:Message)-[r:HAS_CREATOR]->(q) RETURN p.key AS p, l.creationDate AS d, keys(r) AS k, q.key AS q") == [(8, 2012, [], 7)]


def test_changes_are_applied_once_and_in_order(spark, tmp_path):
    (tmp_path / "log").mkdir()
    line = lambda n, t, **p: json.dumps({"seq": n, "statement": t, "params": json.dumps(p)}) + "\n"
    (tmp_path / "log/1.json").write_text(line(2, "MATCH (a:A {k: $k}) SET a.v = 2", k=1) + line(1, "CREATE (:A {k: $k, v: 1})", k=1))
    s = GraphSession(spark)
    follow(s, str(tmp_path / "log"), str(tmp_path / "state")).awaitTermination()
    assert rows(s, "MATCH (a:A) RETURN a.k AS k, a.v AS v") == [(1, 2)]
    assert tail(s, str(tmp_path / "log"), 2).count() == 1
    follow(s, str(tmp_path / "log"), str(tmp_path / "state")).awaitTermination()  # nothing new changes nothing
    assert rows(s, "MATCH (a:A) RETURN count(*) AS n") == [(1,)] and s.applied == [(1, 2)]


def test_changes_of_files_out_of_order_restarts_and_late_ones(spark, tmp_path):
    log, state = tmp_path / "log", str(tmp_path / "state")
    log.mkdir()
    line = lambda n, t: json.dumps({"seq": n, "statement": t}) + "\n"
    for at, (name, n) in enumerate([("a", 4), ("b", 2), ("c", 3), ("d", 1)]):
        text = "CREATE (:A {v: 0})" if n == 1 else f"MATCH (a:A) SET a.v = a.v * 10 + {n}"
        (log / f"{name}.json").write_text(line(n, text))
        os.utime(log / f"{name}.json", (1000 + at, 1000 + at))
    s = GraphSession(spark)
    follow(s, str(log), state, files_per_batch=1).awaitTermination()
    assert rows(s, "MATCH (a:A) RETURN a.v AS v") == [(234,)] and s.applied == [(1, 4)]
    (log / "e.json").write_text(line(5, "MATCH (a:A) SET a.v = a.v * 10 + 5") + line(5, "MATCH (a:A) SET a.v = a.v * 10 + 5") + line(8, "CREATE (:B)"))
    follow(s, str(log), state).awaitTermination()
    assert rows(s, "MATCH (a:A) RETURN a.v AS v") == [(2345,)]
    again = GraphSession(spark)  # a new session knows nothing and applies the whole log, whatever the stream has read
    follow(again, str(log), state).awaitTermination()
    assert rows(again, "MATCH (a:A) RETURN a.v AS v") == [(2345,)] and again.applied == [(1, 5), (8, 8)]
    (log / "f.json").write_text(line(7, "CREATE (:C)"))
    with pytest.raises(Exception, match="comes after"):
        follow(s, str(log), state).awaitTermination()
    (log / "f.json").unlink()
    (log / "g.json").write_text(line(9, "CREATE (:D)") + line(9, "CREATE (:E)"))
    with pytest.raises(E.ExecutionFailed):
        follow(again, str(log), state)


def test_staged_tables_go_when_they_are_no_longer_read(spark):
    df = staged(spark.range(3), "x")
    folder = df.staged_in.removeprefix("file://")
    assert os.path.isdir(folder) and df.count() == 3
    unstage(df, spark.range(1), None)
    assert not os.path.exists(folder)


def test_updates_inside_call(spark):
    s = GraphSession(spark, Graph(spark))
    assert rows(s, "UNWIND [1, 2, 2] AS x CALL (x) { CREATE (:N {k: x}) } RETURN x") == [(1,), (2,), (2,)]
    assert rows(s, "MATCH (n:N) RETURN n.k") == [(1,), (2,), (2,)]  # equal rows create once each
    assert rows(s, "UNWIND [5, 6] AS x CALL { WITH x CREATE (m:M {k: x}) RETURN m } RETURN x, m.k AS k") == [(5, 5), (6, 6)]
    assert rows(s, "MATCH (m:M) CALL { WITH m SET m.w = m.k * 2 } IN TRANSACTIONS OF 10 ROWS RETURN m.w AS w") == [(10,), (12,)]
    assert rows(s, "MATCH (n:N) CALL (n) { MATCH (m:M) WHERE m.k > 5 CREATE (n)-[:T]->(m) RETURN count(m) AS c } RETURN n.k, c") == [(1, 1), (2, 1), (2, 1)]
    assert rows(s, "MATCH (n:N)-[:T]->(m:M) RETURN n.k, m.k") == [(1, 6), (2, 6), (2, 6)]
    assert rows(s, "UNWIND [1, 1, 9] AS x CALL (x) { MERGE (q:Q {k: x}) ON CREATE SET q.s = 'new' }") == []
    assert rows(s, "MATCH (q:Q) RETURN q.k, q.s") == [(1, "new"), (9, "new")]
    s.cypher("MATCH (q:Q) CALL (q) { DETACH DELETE q }")
    assert rows(s, "MATCH (q:Q) RETURN count(q) AS n") == [(0,)]
    assert rows(s, "MATCH (n:N {k: 1}) CALL (n) { UNWIND [1, 2] AS i CALL (n, i) { CREATE (:Y {i: i}) } RETURN sum(i) AS t } RETURN t") == [(3,)]
    assert rows(s, "MATCH (y:Y) RETURN y.i") == [(1,), (2,)]
    with pytest.raises(E.NotSupported):
        s.cypher("UNWIND [1] AS x CALL (x) { CREATE (:A) RETURN 1 AS o UNION CREATE (:B) RETURN 2 AS o } RETURN x")
    assert rows(s, "MATCH (a:A) RETURN a") == []
