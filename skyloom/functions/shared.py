"""The folder that every executor and the driver can reach, and tables written there to cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_SHARED = "file:///tmp/checkpoints/skyloom"


def shared_root(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir, else the checkpoint folder that the session was given; where both are unset a
    default on this machine, which only a local master may use."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(DEFAULT_SHARED)
    return DEFAULT_SHARED


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path of its own below the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the lineage is cut and lost executors lose nothing."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    schema = df.schema
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete what materialize() or a round wrote, once nothing reads it any more."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def drop_tables(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote, once nothing reads them any more."""
    for table in tables:
        for path in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            drop_folder(table.sparkSession, path)
