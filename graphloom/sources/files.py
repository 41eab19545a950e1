"""Graphs in files: JSON lines, delimited text, adjacency lists; and export.

JSON lines: ``nodes.jsonl`` (``i`` id, ``l`` labels, ``p`` properties) and ``rels.jsonl`` (``s``,
``d``, ``t``, ``p``).  External ids are text; numbers are given by a sorted table, so loading
the same files again gives the same ids.  Relationships with an unknown end are left out.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..graph import Graph, LabelSet
from ..storage import staged

#: Single-key maps that stand for a value: key and the type it is read as.
TAGS = {"~bigint": "bigint", "~dt": "timestamp", "~dur": "string"}


def _numbered(df: DataFrame, key: str) -> DataFrame:
    """``(key, id)``: ids by range of the key, counted per partition so that no task sees all rows."""
    keys = staged(df.select(key).distinct().repartitionByRange(key).sortWithinPartitions(key).withColumn("_part", F.spark_partition_id()), "keys")
    sizes = keys.groupBy("_part").agg(F.count("*").alias("n"))
    before = sizes.select("_part", (F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("before"))  # one row a partition
    at = F.row_number().over(W.partitionBy("_part").orderBy(key))
    return keys.withColumn("_at", at).join(F.broadcast(before), "_part").select(key, (F.col("before") + F.col("_at") - 1).cast("bigint").alias("id"))


def _value(col: Column, t: S.DataType) -> Column:
    if isinstance(t, S.StructType) and len(t.fields) == 1 and t.fields[0].name in TAGS:
        tag = t.fields[0].name
        return col[tag].cast(TAGS[tag])
    return col


def read_jsonl(spark: SparkSession, folder: str) -> Graph:
    """A graph from ``nodes.jsonl`` and ``rels.jsonl``; property types are inferred for each label set."""
    nodes = spark.read.json(f"{folder}/nodes.jsonl")
    rels = spark.read.json(f"{folder}/rels.jsonl")
    labels = F.array_sort("l") if "l" in nodes.columns else F.array().cast("array<string>")
    ids = staged(_numbered(nodes.withColumn("i", F.col("i").cast("string")), "i"), "ids")
    full = staged(nodes.withColumn("i", F.col("i").cast("string")).withColumn("l", labels).dropDuplicates(["i"]).join(ids, "i"), "nodes")
    g = Graph(spark)
    sets = [tuple(r[0]) for r in full.select("l").distinct().collect()]  # one row for each label set
    for ls in sets:
        mine = full.where(F.col("l") == F.array(*[F.lit(x) for x in ls]).cast("array<string>"))
        g.add_nodes(ls, _spread(mine, ["id"]))
    ends = full.select("i", "id", "l")
    linked = rels.withColumn("s", F.col("s").cast("string")).withColumn("d", F.col("d").cast("string")).withColumn("_rel", F.monotonically_increasing_id())
    linked = linked.join(ends.select(F.col("i").alias("s"), F.col("id").alias("src"), F.col("l").alias("sl")), "s").join(ends.select(F.col("i").alias("d"), F.col("id").alias("dst"), F.col("l").alias("dl")), "d")
    linked = staged(linked.withColumnRenamed("_rel", "id"), "rels")
    for r in linked.select("t", "sl", "dl").distinct().collect():
        same = (F.col("t") == r.t) & (F.col("sl") == F.array(*[F.lit(x) for x in r.sl]).cast("array<string>")) & (F.col("dl") == F.array(*[F.lit(x) for x in r.dl]).cast("array<string>"))
        g.add_rels(r.t, r.sl, r.dl, _spread(linked.where(same), ["id", "src", "dst"]))
    return g


def _spread(df: DataFrame, keep: list[str]) -> DataFrame:
    """Properties as columns; those that no row of the table has are left out."""
    if "p" not in df.columns or not isinstance(df.schema["p"].dataType, S.StructType):
        return df.select(*keep)
    fields = df.schema["p"].dataType.fields
    seen = df.agg(*[F.count(F.col("p")[f.name]).alias(f.name) for f in fields]).first()
    return df.select(*keep, *[_value(F.col("p")[f.name], f.dataType).alias(f.name) for f in fields if seen[f.name]])


def write_jsonl(graph: Graph, folder: str) -> None:
    """The graph as JSON lines; ids are written as text."""
    parts = []
    for k, df in graph.nodes.items():
        props = [F.col(f"`{c}`") for c in df.columns if c != "id"]
        parts.append(df.select(F.to_json(F.struct(F.col("id").cast("string").alias("i"), F.array(*[F.lit(x) for x in sorted(k)]).alias("l"), F.struct(*props).alias("p") if props else F.create_map().alias("p"))).alias("value")))
    reduce(DataFrame.union, parts).write.mode("overwrite").text(f"{folder}/nodes.jsonl")
    parts = []
    for k, df in graph.rels.items():
        props = [F.col(f"`{c}`") for c in df.columns if c not in ("id", "src", "dst")]
        parts.append(df.select(F.to_json(F.struct(F.col("src").cast("string").alias("s"), F.col("dst").cast("string").alias("d"), F.lit(k[0]).alias("t"), *([F.struct(*props).alias("p")] if props else []))).alias("value")))
    if parts:
        reduce(DataFrame.union, parts).write.mode("overwrite").text(f"{folder}/rels.jsonl")


@dataclass
class TableMap:
    """How delimited files become a graph.

    ``nodes``: file, labels, id column, and perhaps a condition that picks the rows of these labels.
    ``rels``: file, type, (label, column) of both ends, and perhaps a condition; rows without one of
    the ends are no relationships.  A relationship read from a node's own file (a foreign key) has
    no properties.  Ids are ``number of the label * 2**48 + key``; a key must be a whole number below 2**48.
    """

    nodes: list[tuple] = field(default_factory=list)
    rels: list[tuple] = field(default_factory=list)
    separator: str = "|"
    #: What follows a file's name; empty where each name is a folder of files.
    suffix: str = ".csv"

    def part(self, files: set[str]) -> TableMap:
        """The map of these files alone, for exports that lack the others; relationships need both their nodes' files."""
        nodes = [n for n in self.nodes if n[0] in files]
        known = {n[1][0] for n in nodes}
        return replace(self, nodes=nodes, rels=[r for r in self.rels if r[0] in files and {r[2][0], r[3][0]} <= known])


#: The snapshot files of the financial benchmark.
FINANCE = TableMap(
    nodes=[("Person", ("Person",), "personId"), ("Company", ("Company",), "companyId"), ("Medium", ("Medium",), "mediumId"), ("Account", ("Account",), "accountId"), ("Loan", ("Loan",), "loanId")],
    rels=[
        ("PersonOwnAccount", "OWN", ("Person", "personId"), ("Account", "accountId")),
        ("CompanyOwnAccount", "OWN", ("Company", "companyId"), ("Account", "accountId")),
        ("AccountTransferAccount", "TRANSFER", ("Account", "fromId"), ("Account", "toId")),
        ("AccountWithdrawAccount", "WITHDRAW", ("Account", "fromId"), ("Account", "toId")),
        ("PersonApplyLoan", "APPLY", ("Person", "personId"), ("Loan", "loanId")),
        ("CompanyApplyLoan", "APPLY", ("Company", "companyId"), ("Loan", "loanId")),
        ("LoanDepositAccount", "DEPOSIT", ("Loan", "loanId"), ("Account", "accountId")),
        ("AccountRepayLoan", "REPAY", ("Account", "accountId"), ("Loan", "loanId")),
        ("PersonGuaranteePerson", "GUARANTEE", ("Person", "fromId"), ("Person", "toId")),
        ("CompanyGuaranteeCompany", "GUARANTEE", ("Company", "fromId"), ("Company", "toId")),
        ("PersonInvestCompany", "INVEST", ("Person", "investorId"), ("Company", "companyId")),
        ("CompanyInvestCompany", "INVEST", ("Company", "investorId"), ("Company", "companyId")),
        ("MediumSignInAccount", "SIGN_IN", ("Medium", "mediumId"), ("Account", "accountId")),
    ],
)


#: The files of the social network benchmark, foreign keys merged into the files of the nodes.
SOCIAL = TableMap(
    nodes=[
        ("Place", ("City", "Place"), "id", "type = 'City'"),
        ("Place", ("Country", "Place"), "id", "type = 'Country'"),
        ("Place", ("Continent", "Place"), "id", "type = 'Continent'"),
        ("Organisation", ("University", "Organisation"), "id", "type = 'University'"),
        ("Organisation", ("Company", "Organisation"), "id", "type = 'Company'"),
        ("TagClass", ("TagClass",), "id"),
        ("Tag", ("Tag",), "id"),
        ("Person", ("Person",), "id"),
        ("Forum", ("Forum",), "id"),
        ("Post", ("Post", "Message"), "id"),
        ("Comment", ("Comment", "Message"), "id"),
    ],
    rels=[
        ("Place", "IS_PART_OF", ("City", "id"), ("Country", "PartOfPlaceId"), "type = 'City'"),
        ("Place", "IS_PART_OF", ("Country", "id"), ("Continent", "PartOfPlaceId"), "type = 'Country'"),
        ("Organisation", "IS_LOCATED_IN", ("University", "id"), ("City", "LocationPlaceId"), "type = 'University'"),
        ("Organisation", "IS_LOCATED_IN", ("Company", "id"), ("Country", "LocationPlaceId"), "type = 'Company'"),
        ("TagClass", "IS_SUBCLASS_OF", ("TagClass", "id"), ("TagClass", "SubclassOfTagClassId")),
        ("Tag", "HAS_TYPE", ("Tag", "id"), ("TagClass", "TypeTagClassId")),
        ("Person", "IS_LOCATED_IN", ("Person", "id"), ("City", "LocationCityId")),
        ("Person_knows_Person", "KNOWS", ("Person", "Person1Id"), ("Person", "Person2Id")),
        ("Person_hasInterest_Tag", "HAS_INTEREST", ("Person", "PersonId"), ("Tag", "TagId")),
        ("Person_studyAt_University", "STUDY_AT", ("Person", "PersonId"), ("University", "UniversityId")),
        ("Person_workAt_Company", "WORK_AT", ("Person", "PersonId"), ("Company", "CompanyId")),
        ("Person_likes_Post", "LIKES", ("Person", "PersonId"), ("Post", "PostId")),
        ("Person_likes_Comment", "LIKES", ("Person", "PersonId"), ("Comment", "CommentId")),
        ("Forum", "HAS_MODERATOR", ("Forum", "id"), ("Person", "ModeratorPersonId")),
        ("Forum_hasMember_Person", "HAS_MEMBER", ("Forum", "ForumId"), ("Person", "PersonId")),
        ("Forum_hasTag_Tag", "HAS_TAG", ("Forum", "ForumId"), ("Tag", "TagId")),
        ("Post", "HAS_CREATOR", ("Post", "id"), ("Person", "CreatorPersonId")),
        ("Post", "CONTAINER_OF", ("Forum", "ContainerForumId"), ("Post", "id")),
        ("Post", "IS_LOCATED_IN", ("Post", "id"), ("Country", "LocationCountryId")),
        ("Post_hasTag_Tag", "HAS_TAG", ("Post", "PostId"), ("Tag", "TagId")),
        ("Comment", "HAS_CREATOR", ("Comment", "id"), ("Person", "CreatorPersonId")),
        ("Comment", "IS_LOCATED_IN", ("Comment", "id"), ("Country", "LocationCountryId")),
        ("Comment", "REPLY_OF", ("Comment", "id"), ("Post", "ParentPostId")),
        ("Comment", "REPLY_OF", ("Comment", "id"), ("Comment", "ParentCommentId")),
        ("Comment_hasTag_Tag", "HAS_TAG", ("Comment", "CommentId"), ("Tag", "TagId")),
    ],
    suffix="",
)


def read_tables(spark: SparkSession, folder: str, how: TableMap) -> Graph:
    """A graph from delimited files with headers, one for each entry of the map."""
    g = Graph(spark)
    number = {n[1][0]: i for i, n in enumerate(how.nodes)}
    tables = {n[1][0]: LabelSet(n[1]) for n in how.nodes}
    files = {n[0] for n in how.nodes}
    known: dict[str, DataFrame] = {}

    def read(name: str) -> DataFrame:
        if name not in known:
            known[name] = spark.read.csv(f"{folder}/{name}{how.suffix}", header=True, sep=how.separator, inferSchema=True)
        return known[name]

    def picked(name: str, rest: list[str]) -> DataFrame:
        return read(name).where(rest[0]) if rest else read(name)

    def node(label: str, col: str) -> Column:
        return F.lit(number[label]).cast("bigint") * (1 << 48) + F.col(f"`{col}`").cast("bigint")

    keys = {(n[0], n[2]) for n in how.nodes}
    foreign = {(r[0], c) for r in how.rels if r[0] in files for _, c in r[2:4]} - keys
    for name, labels, key, *rest in how.nodes:
        df = picked(name, rest)
        own = [F.col(f"`{c}`") for c in df.columns if (name, c) not in foreign and c != "id"]
        if key == "id":  # ``id`` is the number of a node in the graph; the file's own is kept as ``key``
            own.append(F.col("id").alias("key"))
        g.add_nodes(labels, df.select(node(labels[0], key).alias("id"), *own))
    for name, kind, (sl, sc), (dl, dc), *rest in how.rels:
        df = picked(name, rest).where(F.col(f"`{sc}`").isNotNull() & F.col(f"`{dc}`").isNotNull()).withColumn("_id", F.monotonically_increasing_id())
        props = [] if name in files else [F.col(f"`{c}`") for c in df.columns if c not in (sc, dc, "_id")]
        # Up to 2**21 tasks a file keep their row numbers below 2**54.
        row = F.col("_id") + (len(g.rels) << 54)
        g.add_rels(kind, tables[sl], tables[dl], staged(df.select(row.alias("id"), node(sl, sc).alias("src"), node(dl, dc).alias("dst"), *props), name))
    return g


def read_adjacency(spark: SparkSession, vertices: str, edges: str, directed: bool = True) -> Graph:
    """``.v`` (an id a line) and ``.e`` (two ids and perhaps a weight a line) files as ``(:V {vid})-[:E]->(:V)``."""
    v = spark.read.text(vertices).where(F.trim("value") != "").select(F.trim("value").cast("bigint").alias("id")).withColumn("vid", F.col("id"))
    parts = F.split(F.trim("value"), "\\s+")
    e = spark.read.text(edges).where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("id"), parts[0].cast("bigint").alias("src"), parts[1].cast("bigint").alias("dst"), F.coalesce(F.try_element_at(parts, F.lit(3)).try_cast("double"), F.lit(1.0)).alias("weight"))
    if not directed:
        e = e.union(e.select((F.col("id") + (1 << 60)).alias("id"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return Graph(spark).add_nodes("V", v).add_rels("E", "V", "V", staged(e, "edges"))


def write_import_csv(graph: Graph, folder: str) -> None:
    """CSV with the headers that bulk importers of property graphs expect (``:ID``, ``:LABEL``, ``:TYPE``)."""
    plain = lambda df, c: F.to_json(F.col(f"`{c}`")) if isinstance(df.schema[c].dataType, (S.ArrayType, S.StructType, S.MapType)) else F.col(f"`{c}`").cast("string")
    for k, df in graph.nodes.items():
        cols = [plain(df, c).alias(c) for c in df.columns if c != "id"]
        df.select(F.col("id").cast("string").alias(":ID"), *cols, F.lit(";".join(sorted(k))).alias(":LABEL")).write.mode("overwrite").csv(f"{folder}/nodes_{'_'.join(sorted(k)) or 'none'}", header=True)
    for i, (k, df) in enumerate(graph.rels.items()):
        cols = [plain(df, c).alias(c) for c in df.columns if c not in ("id", "src", "dst")]
        df.select(F.col("src").cast("string").alias(":START_ID"), F.col("dst").cast("string").alias(":END_ID"), *cols, F.lit(k[0]).alias(":TYPE")).write.mode("overwrite").csv(f"{folder}/rels_{i}_{k[0]}", header=True)
