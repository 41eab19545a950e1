"""Tables that live in the folder all machines share, and small DataFrame helpers.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir`` and reading it
again, so a lost executor never costs more than the tasks it was running.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one of our own only on a local master."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    sc.setCheckpointDir(base)
    return base


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/graphloom/{uuid.uuid4().hex}/{name}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; its lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that Spark hands to a Python worker at a time, at most: texts can be long.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to ``BATCH_ROWS`` if it is larger."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, BATCH_ROWS)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; what reads texts from here gets them in small batches."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of text that a sample brings to the driver at most.
SAMPLE_BYTES = 64 << 20


def below(share: float) -> int:
    """The signed 64-bit number below which about this share of all hashes lies; it keeps its precision at any size."""
    return min(max(int(share * 2**64), 1), 2**64 - 1) - 2**63


def sampled_texts(rows: DataFrame, key: str, label: str, max_bytes: int = SAMPLE_BYTES):
    """A bounded sample as a pandas table ``(key, label, text)``, sorted.

    ``rows`` are already few; equal ids with one label count once (their least text).  In the order
    of a hash of the id, texts are taken whole while they fit into ``max_bytes``.
    """
    once = rows.groupBy(F.col(key).alias("key"), F.col(label).alias("label")).agg(F.min("text").alias("text"))
    kept = stage(once.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0))), "sample")
    sizes = kept.select("key", "label", "size", F.xxhash64("key").alias("at")).collect()  # a few numbers for each sampled row
    if sum(r.size for r in sizes) > max_bytes:
        left, fits = max_bytes, []
        for r in sorted(sizes, key=lambda r: (r["at"], str(r.label))):
            if r.size <= left:
                left -= r.size
                fits.append((r.key, r.label))
        some = rows.sparkSession.createDataFrame(fits, kept.select("key", "label").schema)
        kept = kept.join(F.broadcast(some), ["key", "label"], "left_semi")  # at most the sampled ids
    return kept.select("key", "label", "text").toPandas().sort_values(["key", "label"], kind="stable").reset_index(drop=True)


def crc_fold(column: str, n: int):
    """``crc32`` of the id written as text, modulo ``n``: the fold of a row."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)
