"""Connected components of a link table, by alternating large and small stars.

Each round points all larger neighbours of a node, then all smaller ones, at its smallest
neighbour, until the table is a set of stars.  Minima are pre-aggregated before they are
shuffled and meet the links in a plain equi-join, which Spark can split where one node has
many links.  Each round's links are a table in the shared folder; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_path, new_path

MAX_ROUNDS = 60


def _stars(links: DataFrame, center: str, leaf: str, both: bool) -> DataFrame:
    """Leaves and centers of each star, pointed at the star's smallest node."""
    arms = links.select(F.col(center).alias("c"), F.col(leaf).alias("l"))
    if both:
        arms = arms.union(links.select(F.col(leaf).alias("c"), F.col(center).alias("l")))
    low = arms.groupBy("c").agg(F.min("l").alias("m")).select("c", F.least("c", "m").alias("m"))
    return arms.join(low, "c")


def connected_components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` of longs to ``(node, component)``, the component being its smallest node.

    Null ends and loops are ignored; nodes without links do not appear; an empty table gives none.
    """
    spark = links.sparkSession
    schema = "a long, b long"

    def kept(df: DataFrame, k: int) -> tuple[DataFrame, str, tuple]:
        path = new_path(spark, f"links-{k}")
        df.write.parquet(path)
        out = spark.read.schema(schema).parquet(path)
        # An order-free mark of the table: equal marks mean that a round changed nothing.
        mark = out.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return out, path, tuple(mark)

    # a is the larger end, b the smaller
    start = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, path, mark = kept(start, 0)
    for k in range(1, MAX_ROUNDS):
        if mark[0] == 0:
            break
        large = _stars(now, "a", "b", both=True).where("l > c").select(F.col("l").alias("a"), F.col("m").alias("b")).distinct()
        arms = _stars(large, "a", "b", both=False)
        small = arms.where("l <> m").select(F.col("l").alias("a"), F.col("m").alias("b")).union(arms.select(F.col("c").alias("a"), F.col("m").alias("b"))).distinct()
        new, new_p, new_mark = kept(small, k)
        drop_path(spark, path)
        now, path, same = new, new_p, new_mark == mark
        mark = new_mark
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())
