"""A property graph over the star-schema tables: views only, nothing is copied.

Node ids are ``label number * 2**48 + key``, so labels never collide and a key is found
again by plain arithmetic.  Relationship ids come from the row's place in its file, so rows
that are equal in all columns stay different relationships.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import NotSupported
from ..graph import Graph

#: Label numbers.
ORDER = ("Region", "Nation", "Customer", "Supplier", "Part", "Order", "User", "Event", "Document", "Page", "Vector", "Conversation")
SHIFT = 48
#: Bits of a row id for the row's place in its file, and the files that then have a number.
ROW_BITS = 40
MAX_FILES = 1 << (62 - ROW_BITS)


def node_id(label: str, key: Column) -> Column:
    return (F.lit(ORDER.index(label)).cast("bigint") * (1 << SHIFT) + key.cast("bigint")).cast("bigint")


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """A file table with a number for each row, the same whatever is filtered or pruned.

    It is the number of the file among the sorted paths and the row's place in it, so no two rows
    share one.  The list of files, which the driver holds anyway, is joined by path.
    """
    files = sorted(df.inputFiles())
    index = F.col("_metadata.row_index")
    if len(files) <= 1:
        return df.select("*", index.alias(name))
    if len(files) > MAX_FILES:
        raise NotSupported(f"{len(files)} files; row ids are made for {MAX_FILES} at most")
    slashes = "^file:/+"  # local files are listed with three slashes and read with one
    numbers = df.sparkSession.createDataFrame([(re.sub(slashes, "file:/", f), i << ROW_BITS) for i, f in enumerate(files)], "row_file string, row_base bigint")
    placed = df.select("*", F.regexp_replace(F.col("_metadata.file_path"), slashes, "file:/").alias("row_file"), index.alias("row_place"))
    return placed.join(numbers, "row_file").select(*df.columns, (F.col("row_base") + F.col("row_place")).alias(name))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nodes(df: DataFrame, label: str, key: str, prefix: str, skip: tuple[str, ...] = ()) -> DataFrame:
    cols = [F.col(c).alias(c.removeprefix(prefix)) for c in df.columns if c != key and c not in skip]
    return df.select(node_id(label, F.col(key)).alias("id"), F.col(key).cast("bigint").alias("key"), *cols)


def star_schema(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph of the twelve labels and nine relationship types."""
    t = {n: _read(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "conversations")}
    g = Graph(spark)
    g.add_nodes("Region", _nodes(t["region"], "Region", "r_regionkey", "r_"))
    g.add_nodes("Nation", _nodes(t["nation"], "Nation", "n_nationkey", "n_", ("n_regionkey",)))
    g.add_nodes("Customer", _nodes(t["customer"], "Customer", "c_custkey", "c_", ("c_nationkey",)))
    g.add_nodes("Supplier", _nodes(t["supplier"], "Supplier", "s_suppkey", "s_", ("s_nationkey",)))
    g.add_nodes("Part", _nodes(t["part"], "Part", "p_partkey", "p_"))
    g.add_nodes("Order", _nodes(t["orders"], "Order", "o_orderkey", "o_", ("o_custkey",)))
    users = t["events"].select("user_id").distinct()
    g.add_nodes("User", users.select(node_id("User", F.col("user_id")).alias("id"), F.col("user_id").alias("key")))
    g.add_nodes("Event", _nodes(t["events"], "Event", "event_id", "event_", ("user_id",)))
    g.add_nodes("Document", _nodes(t["documents"], "Document", "doc_id", "doc_"))
    g.add_nodes("Page", _nodes(t["pages"], "Page", "page_id", "page_"))
    g.add_nodes("Vector", _nodes(t["embeddings"], "Vector", "vec_id", "vec_"))
    turns = t["conversations"].groupBy("conv_id").agg(F.count("*").alias("turns"))
    g.add_nodes("Conversation", turns.select(node_id("Conversation", F.col("conv_id")).alias("id"), F.col("conv_id").alias("key"), "turns"))

    def rel(kind: str, src: str, s: str, dst: str, d: str, df: DataFrame, rid: Column, **props: str) -> None:
        g.add_rels(kind, src, dst, df.select(rid.cast("bigint").alias("id"), node_id(src, F.col(s)).alias("src"), node_id(dst, F.col(d)).alias("dst"), *[F.col(c).alias(n) for n, c in props.items()]))

    line = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "linenumber": "l_linenumber", "returnflag": "l_returnflag", "shipdate": "l_shipdate"}
    rel("PLACED", "Customer", "o_custkey", "Order", "o_orderkey", t["orders"], F.col("o_orderkey"))
    lines = with_row_id(t["lineitem"])
    rel("CONTAINS", "Order", "l_orderkey", "Part", "l_partkey", lines, F.col("row_id"), **line)
    rel("SUPPLIED_BY", "Order", "l_orderkey", "Supplier", "l_suppkey", lines, F.col("row_id"), linenumber="l_linenumber")
    rel("IN_NATION", "Customer", "c_custkey", "Nation", "c_nationkey", t["customer"], F.col("c_custkey") * 2)
    rel("IN_NATION", "Supplier", "s_suppkey", "Nation", "s_nationkey", t["supplier"], F.col("s_suppkey") * 2 + 1)
    rel("IN_REGION", "Nation", "n_nationkey", "Region", "n_regionkey", t["nation"], F.col("n_nationkey"))
    rel("DID", "User", "user_id", "Event", "event_id", t["events"], F.col("event_id"))
    after = t["events"].select("event_id", F.lead("event_id").over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("next")).where("next is not null")
    rel("NEXT", "Event", "event_id", "Event", "next", after, F.col("event_id"))
    supplies = t["lineitem"].select("l_suppkey", "l_partkey").distinct()
    rel("SUPPLIES", "Supplier", "l_suppkey", "Part", "l_partkey", supplies, F.col("l_suppkey") * (1 << 32) + F.col("l_partkey"))
    w = W.partitionBy("c_nationkey").orderBy("c_custkey")
    ahead = t["customer"].select("c_custkey", F.lead("c_custkey", 1).over(w).alias("one"), F.lead("c_custkey", 2).over(w).alias("two"))
    near = ahead.select("c_custkey", F.posexplode(F.array("one", "two")).alias("k", "to")).where("to is not null")
    rel("KNOWS", "Customer", "c_custkey", "Customer", "to", near, F.col("c_custkey") * 2 + F.col("k"))
    return g


_GRAPHS: dict[tuple[str, str], Graph] = {}


def graph_of(spark: SparkSession, sf_dir: str) -> Graph:
    """``star_schema`` of a folder, planned once in an application: its schemas and file lists are kept."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _GRAPHS:
        _GRAPHS[key] = star_schema(spark, sf_dir)
    return _GRAPHS[key].copy()
