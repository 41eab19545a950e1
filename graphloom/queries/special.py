"""Queries of several statements: indexes, search, updates, commands."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ExecutionFailed
from ..graph import Graph
from ..session import GraphSession
from ..sources import files
from ..sources.tables import graph_of
from ..storage import shared_dir
from .texts import KNOWS

CALLS: dict = {}
CALLS_SQL: dict[str, str] = {}


def add(name: str, sql: str | None):
    def keep(fn):
        CALLS[name] = fn
        if sql:
            CALLS_SQL[name] = sql
        return fn

    return keep


def _session(spark: SparkSession, sf_dir: str) -> GraphSession:
    return GraphSession(spark, graph_of(spark, sf_dir))


def _places(spark: SparkSession, sf_dir: str) -> GraphSession:
    """A session that may be updated: nations and regions only."""
    whole = graph_of(spark, sf_dir)
    g = Graph(spark)
    for k, df in whole.nodes.items():
        if k & {"Nation", "Region"}:
            g.nodes[k] = df
    for k, df in whole.rels.items():
        if k[0] == "IN_REGION":
            g.rels[k] = df
    return GraphSession(spark, g)


_BM25 = """
WITH tok AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[^\\pL\\pM\\p{Nd}\\p{Nl}\\p{No}]+'), lambda t: lower(t)), lambda t: t <> '') AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, len(t) AS dl, len(list_filter(t, lambda x: x = 'idiot')) AS a, len(list_filter(t, lambda x: x = 'nicht')) AS b FROM tok),
s AS (SELECT count(*) AS n, avg(dl) AS m, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM c)
SELECT doc_id AS k, round(1000 * (ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / m)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / m)))) AS s
FROM c, s WHERE a > 0 OR b > 0
"""


@add("fulltext_bm25", _BM25)
def fulltext_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir)
    s.cypher("CREATE FULLTEXT INDEX texts FOR (d:Document) ON EACH [d.text]")
    return s.cypher("CALL db.index.fulltext.queryNodes('texts', 'Idiot nicht') YIELD node, score RETURN node.key AS k, round(score * 1000) AS s")


@add("vector_knn", "WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 3) SELECT vec_id AS k, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) * 100000) AS s FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) DESC, vec_id LIMIT 10")
def vector_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir)
    s.cypher("CREATE VECTOR INDEX vectors FOR (v:Vector) ON (v.embedding)")
    q = s.cypher("MATCH (v:Vector {key: 3}) RETURN v.embedding AS e").first()["e"]
    return s.cypher("CALL db.index.vector.queryNodes('vectors', 10, $q) YIELD node, score RETURN node.key AS k, round(score * 100000) AS s", q=[float(x) for x in q])


@add("create_then_match", "SELECT n_name AS n, r_name AS r, n_nationkey * 10 AS w FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 10")
def create_then_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _places(spark, sf_dir)
    s.cypher("MATCH (n:Nation)-[:IN_REGION]->(r) WHERE n.key < 10 CREATE (n)<-[:ABOUT {w: n.key * 10}]-(:Note {text: n.name + '!'})-[:SEEN]->(r)")
    return s.cypher("MATCH (n:Nation)<-[a:ABOUT]-(x:Note)-[:SEEN]->(r:Region) WHERE x.text = n.name + '!' RETURN n.name AS n, r.name AS r, a.w AS w")


@add("merge_idempotent", "SELECT 'first' AS state, count(DISTINCT n_nationkey % 4) AS tags, count(*) AS links FROM nation")
def merge_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _places(spark, sf_dir)
    for _ in range(2):
        s.cypher("MATCH (n:Nation) MERGE (t:Tag {k: n.key % 4}) ON CREATE SET t.state = 'first' ON MATCH SET t.met = true MERGE (n)-[:HAS]->(t)")
    return s.cypher("MATCH (n:Nation)-[h:HAS]->(t:Tag) RETURN min(t.state) AS state, count(DISTINCT t) AS tags, count(h) AS links")


@add("set_remove", "SELECT n_nationkey AS k, n_nationkey % 2 = 0 AS even, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey + 100 END AS x, CASE WHEN n_nationkey % 2 = 0 THEN NULL ELSE n_name END AS name FROM nation")
def set_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _places(spark, sf_dir)
    s.cypher("MATCH (n:Nation) WHERE n.key % 2 = 0 SET n.x = n.key + 100, n:Even REMOVE n.name")
    return s.cypher("MATCH (n:Nation) RETURN n.key AS k, n:Even AS even, n.x AS x, n.name AS name")


@add("set_map", "SELECT r_regionkey AS k, 'a' AS a, CASE WHEN r_regionkey = 0 THEN NULL ELSE r_name END AS name FROM region")
def set_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _places(spark, sf_dir)
    s.cypher("MATCH (r:Region {key: 0}) SET r = {key: 0, a: 'a'}")
    s.cypher("MATCH (r:Region) WHERE r.key > 0 SET r += {a: 'a'}")
    return s.cypher("MATCH (r:Region) RETURN r.key AS k, r.a AS a, r.name AS name")


@add("detach_delete", "SELECT (SELECT count(*) FROM nation) AS n, count(*) FILTER (WHERE n_regionkey <> 1) AS links, 4 AS regions FROM nation")
def detach_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _places(spark, sf_dir)
    s.cypher("MATCH (r:Region {key: 1}) DETACH DELETE r")
    return s.cypher("MATCH (n:Nation) OPTIONAL MATCH (n)-[r:IN_REGION]->(x) WITH count(DISTINCT n) AS n, count(r) AS links MATCH (y:Region) RETURN n, links, count(y) AS regions")


@add("delete_relationship", "SELECT count(*) AS n FROM nation WHERE n_nationkey >= 5")
def delete_relationship(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _places(spark, sf_dir)
    s.cypher("MATCH (n:Nation)-[r:IN_REGION]->() WHERE n.key < 5 DELETE r")
    return s.cypher("MATCH ()-[r:IN_REGION]->() RETURN count(r) AS n")


@add("foreach_create", "SELECT i, count(*) AS n FROM region, range(1, 4) t(i) GROUP BY 1")
def foreach_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _places(spark, sf_dir)
    s.cypher("MATCH (r:Region) FOREACH (i IN range(1, 3) | CREATE (:Copy {i: i, of: r.name}))")
    return s.cypher("MATCH (c:Copy) RETURN c.i AS i, count(*) AS n")


@add("show_indexes", "SELECT 'names' AS name, 'RANGE' AS type, 'NODE' AS entityType, 'Nation' AS labels, 'name' AS keys")
def show_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _places(spark, sf_dir)
    s.cypher("CREATE INDEX names FOR (n:Nation) ON (n.name)")
    s.cypher("CREATE CONSTRAINT keys FOR (n:Nation) REQUIRE n.key IS UNIQUE")
    found = s.cypher("SHOW INDEXES")
    return found.select("name", "type", "entityType", F.array_join("labelsOrTypes", ",").alias("labels"), F.array_join("properties", ",").alias("keys"))


@add("algo_mutate_and_write", "SELECT n_regionkey AS r, count(*) AS n FROM nation GROUP BY 1")
def algo_mutate_and_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _places(spark, sf_dir)
    s.cypher("CALL graph.algo.wcc.mutate({mutateKey: 'parts'})").collect()
    s.cypher("CALL graph.algo.wcc.write({writeProperty: 'part'})").collect()
    return s.cypher("MATCH (n:Nation)-[:IN_REGION]->(r) WHERE n.part = r.part RETURN r.key AS r, count(n) AS n")


@add("algo_project", "SELECT 3 AS n, 2.5::DOUBLE AS s")
def algo_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _places(spark, sf_dir)
    a, b, c = (0, 1, 2)
    edges = [{"source": a, "target": b, "weight": 1.0}, {"source": b, "target": c, "weight": 1.5}, {"source": a, "target": c, "weight": 9.0}, {"source": a, "target": 10**18, "weight": 1.0}]
    s.cypher("CALL graph.algo.project($cfg)", cfg={"name": "own", "nodeLabels": ["Region"], "edges": edges}).collect()
    return s.cypher("CALL graph.algo.sssp.stream({projection: 'own', sourceNode: 0}) YIELD distance WHERE distance IS NOT NULL RETURN count(*) AS n, max(distance) AS s")


@add("show_constraints", "SELECT 'keys' AS name, 'UNIQUE' AS type, 'NODE' AS entityType, 'Nation' AS labels, 'key' AS keys")
def show_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _places(spark, sf_dir)
    s.cypher("CREATE CONSTRAINT keys FOR (n:Nation) REQUIRE n.key IS UNIQUE")
    s.cypher("CREATE CONSTRAINT gone FOR (r:Region) REQUIRE r.name IS NOT NULL")
    s.cypher("DROP CONSTRAINT gone")
    found = s.cypher("SHOW CONSTRAINTS")
    return found.select("name", "type", "entityType", F.array_join("labelsOrTypes", ",").alias("labels"), F.array_join("properties", ",").alias("keys"))


@add("constraint_refuses", "SELECT 2 AS refused, count(*) AS n, count(DISTINCT n_nationkey) AS k FROM nation")
def constraint_refuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What breaks a constraint is refused whole; the graph stays as it was."""
    s = _places(spark, sf_dir)
    s.cypher("CREATE CONSTRAINT keys FOR (n:Nation) REQUIRE n.key IS UNIQUE")
    s.cypher("CREATE CONSTRAINT named FOR (n:Nation) REQUIRE n.name IS NOT NULL")
    refused = 0
    for text in ("CREATE (:Nation {key: 3, name: 'again'})", "CREATE (:Nation {key: 1000})"):
        try:
            s.cypher(text)
        except ExecutionFailed:
            refused += 1
    return s.cypher("MATCH (n:Nation) RETURN $refused AS refused, count(*) AS n, count(DISTINCT n.key) AS k", refused=refused)


@add("vector_knn_per_row", "WITH q AS (SELECT vec_id AS q, embedding AS e FROM embeddings WHERE vec_id IN (3, 8)) SELECT q, vec_id AS k, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) * 100000) AS s FROM embeddings, q QUALIFY row_number() OVER (PARTITION BY q ORDER BY list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) DESC, vec_id) <= 5")
def vector_knn_per_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir)
    s.cypher("CREATE VECTOR INDEX vectors FOR (v:Vector) ON (v.embedding)")
    return s.cypher("MATCH (v:Vector) WHERE v.key IN [3, 8] CALL db.index.vector.queryNodes('vectors', 5, v.embedding) YIELD node, score RETURN v.key AS q, node.key AS k, round(score * 100000) AS s")


@add("truncated_walks", f"WITH {KNOWS}, top AS (SELECT a, max(b) AS b FROM k1 GROUP BY a) SELECT a, count(*) AS n, sum(b)::BIGINT AS s FROM (SELECT a, b FROM top UNION ALL SELECT x.a, y.b FROM top x JOIN top y ON x.b = y.a) GROUP BY a")
def truncated_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At each step only the relationship of largest weight is followed."""
    g = graph_of(spark, sf_dir)
    own = Graph(spark)
    own.nodes = {k: df for k, df in g.nodes.items() if "Customer" in k}
    own.rels = {k: df.withColumn("w", F.col("dst")) for k, df in g.rels.items() if k[0] == "KNOWS"}
    s = GraphSession(spark, own, expand_truncation=(1, "w"))
    return s.cypher("MATCH (a:Customer)-[:KNOWS*1..2]->(b) RETURN a.key AS a, count(*) AS n, sum(b.key) AS s")


@add("algo_results", "SELECT 'parts' AS key, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS n, (SELECT count(*) FROM region) AS c, true AS dropped")
def algo_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _places(spark, sf_dir)
    s.cypher("CALL graph.algo.wcc.mutate({mutateKey: 'parts'})").collect()
    c = s.cypher("CALL graph.algo.result.stream('parts') YIELD value RETURN count(DISTINCT value) AS c").first()["c"]
    listed = s.cypher("CALL graph.algo.result.list()").collect()
    gone = s.cypher("CALL graph.algo.result.drop('parts')").first()["dropped"]
    rows = [(r["mutateKey"], r["nodeCount"], c, gone) for r in listed]
    return spark.createDataFrame(rows, "key string, n bigint, c bigint, dropped boolean")


@add("jsonl_round_trip", "SELECT n_name AS n, r_name AS r, n_nationkey AS k FROM nation JOIN region ON n_regionkey = r_regionkey")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and regions written as JSON lines and read again."""
    folder = f"{shared_dir(spark)}/graphloom-graph/{uuid.uuid4().hex}"
    files.write_jsonl(_places(spark, sf_dir).graph, folder)
    s = GraphSession(spark, files.read_jsonl(spark, folder))
    return s.cypher("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.name AS n, r.name AS r, n.key AS k")


@add("adjacency_components", "SELECT c_custkey AS k, min(c_custkey) OVER (PARTITION BY c_nationkey) AS c FROM customer")
def adjacency_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The KNOWS relationships written as vertex and edge lines and read again."""
    folder = f"{shared_dir(spark)}/graphloom-graph/{uuid.uuid4().hex}"
    g = graph_of(spark, sf_dir)
    key = lambda c: (F.col(c) % (1 << 48)).cast("string")
    people = next(df for k, df in g.nodes.items() if "Customer" in k)
    knows = next(df for k, df in g.rels.items() if k[0] == "KNOWS")
    people.select(key("id").alias("value")).write.text(f"{folder}/v")
    knows.select(F.concat_ws(" ", key("src"), key("dst")).alias("value")).write.text(f"{folder}/e")
    s = GraphSession(spark, files.read_adjacency(spark, f"{folder}/v", f"{folder}/e", directed=False))
    return s.cypher("CALL graph.algo.wcc.stream({}) YIELD node, componentId RETURN node.vid AS k, componentId AS c")


@add("call_updates", "SELECT r_regionkey AS r, count(n_nationkey) AS n, sum(n_nationkey)::BIGINT AS s FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def call_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region's subquery creates a note for each of its nations and tells how many."""
    s = _places(spark, sf_dir)
    made = s.cypher("MATCH (r:Region) CALL (r) { MATCH (n:Nation)-[:IN_REGION]->(r) CREATE (r)-[:HAS]->(:Note {k: n.key}) RETURN count(n) AS n } RETURN r.key AS r, n")
    s.cypher("MATCH (r:Region) CALL (r) { MATCH (r)-[:HAS]->(x:Note) SET x.of = r.key } IN TRANSACTIONS OF 2 ROWS")
    told = s.cypher("MATCH (x:Note) RETURN x.of AS r, sum(x.k) AS s")
    return made.join(told, "r")


@add("finance_csv", "SELECT c_custkey AS p, count(*) AS n, sum(l)::BIGINT AS lines FROM customer JOIN orders ON o_custkey = c_custkey JOIN (SELECT l_orderkey, count(*) AS l FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1")
def finance_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as persons, orders as accounts and lines as sign-ins, written in the financial benchmark's format."""
    folder = f"{shared_dir(spark)}/graphloom-graph/{uuid.uuid4().hex}"
    customer, orders, lines, parts = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "orders", "lineitem", "part"))
    tables = {
        "Person": customer.select(F.col("c_custkey").alias("personId"), F.col("c_name").alias("personName")),
        "Account": orders.select(F.col("o_orderkey").alias("accountId"), F.col("o_totalprice").alias("balance")),
        "Medium": parts.select(F.col("p_partkey").alias("mediumId")),
        "PersonOwnAccount": orders.select(F.col("o_custkey").alias("personId"), F.col("o_orderkey").alias("accountId")),
        "MediumSignInAccount": lines.select(F.col("l_partkey").alias("mediumId"), F.col("l_orderkey").alias("accountId"), F.col("l_linenumber").alias("line")),
    }
    for name, df in tables.items():
        df.write.csv(f"{folder}/{name}.csv", header=True, sep="|")
    s = GraphSession(spark, files.read_tables(spark, folder, files.FINANCE.part(set(tables))))
    return s.cypher("MATCH (p:Person)-[:OWN]->(a:Account)<-[x:SIGN_IN]-(:Medium) RETURN p.personId AS p, count(DISTINCT a) AS n, count(x) AS lines")


@add("social_csv", f"WITH {KNOWS} SELECT r_name AS r, n_name AS n, count(*) AS c, sum(c_custkey)::BIGINT AS s FROM k1 JOIN customer ON c_custkey = b JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2")
def social_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as persons, nations as cities and regions as countries, written in the social benchmark's format."""
    folder = f"{shared_dir(spark)}/graphloom-graph/{uuid.uuid4().hex}"
    customer, nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation", "region"))
    cities = nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("City").alias("type"), F.col("n_regionkey").alias("PartOfPlaceId"))
    countries = region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit("Country").alias("type"), F.lit(None).cast("int").alias("PartOfPlaceId"))
    knows = next(df for k, df in graph_of(spark, sf_dir).rels.items() if k[0] == "KNOWS")
    tables = {
        "Place": cities.union(countries),
        "Person": customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("firstName"), F.col("c_nationkey").alias("LocationCityId")),
        "Person_knows_Person": knows.select((F.col("src") % (1 << 48)).alias("Person1Id"), (F.col("dst") % (1 << 48)).alias("Person2Id")),
    }
    for name, df in tables.items():
        df.write.csv(f"{folder}/{name}", header=True, sep="|")
    s = GraphSession(spark, files.read_tables(spark, folder, files.SOCIAL.part(set(tables))))
    return s.cypher("MATCH (:Person)-[:KNOWS]->(p:Person)-[:IS_LOCATED_IN]->(c:City)-[:IS_PART_OF]->(k:Country) RETURN k.name AS r, c.name AS n, count(*) AS c, sum(p.key) AS s")
