"""Tables that cut lineage, written to the folder all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own only where that is unset on a local master."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    sc.setCheckpointDir(base)
    return base


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def staged(df: DataFrame, name: str = "table") -> DataFrame:
    """Write and read again; what follows does not depend on how ``df`` was made.

    The table goes when the application ends, or with ``unstage`` as soon as nothing reads it.
    """
    folder = f"{shared_dir(df.sparkSession)}/graphloom-graph/{uuid.uuid4().hex}"
    where, system = _at(df.sparkSession, folder)
    system.deleteOnExit(where)
    df.write.parquet(f"{folder}/{name}")
    out = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")
    out.staged_in = folder
    return out


def unstage(*tables: DataFrame | None) -> None:
    """Delete staged tables that nothing will read again; others are left alone."""
    for df in tables:
        if folder := getattr(df, "staged_in", None):
            where, system = _at(df.sparkSession, folder)
            system.delete(where, True)
