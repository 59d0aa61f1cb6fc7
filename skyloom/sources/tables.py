"""The star-schema tables and their readings as particles, memberships and points, in Spark and as SQL views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as particles: position, velocity, mass and potential from the first seven numbers and the label."""
    e = table(spark, sf_dir, "embeddings")
    axis = lambda i, name: F.col("embedding")[i].cast("double").alias(name)
    return e.select(
        F.col("vec_id").alias("id"), *(axis(i, n) for i, n in enumerate(("x", "y", "z", "vx", "vy", "vz"))),
        (F.lit(1.0) + F.col("label")).alias("mass"), axis(6, "potential"),
    )


PARTICLES_SQL = """particles AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y,
  CAST(embedding[3] AS DOUBLE) AS z, CAST(embedding[4] AS DOUBLE) AS vx, CAST(embedding[5] AS DOUBLE) AS vy,
  CAST(embedding[6] AS DOUBLE) AS vz, CAST(1.0 + label AS DOUBLE) AS mass, CAST(embedding[7] AS DOUBLE) AS potential FROM embeddings)"""


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as snapshots: (timestep, halo_tag, id), a supplier's distinct parts in each year of shipping."""
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.year("l_shipdate") - 1995).alias("timestep"), F.col("l_suppkey").alias("halo_tag"), F.col("l_partkey").alias("id")).distinct()


MEMBERSHIP_SQL = """members AS (SELECT DISTINCT CAST(year(l_shipdate) - 1995 AS INTEGER) AS timestep, l_suppkey AS halo_tag, l_partkey AS id FROM lineitem)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as points: quantity, and discount and tax in hundredths, in a box of 60 x 12 x 12."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("okey"), F.col("l_linenumber").alias("lnum"), F.col("l_quantity").alias("x"),
        F.round(F.abs(F.col("l_discount")) * 100).alias("y"), F.round(F.abs(F.col("l_tax")) * 100).alias("z"),
    )


POINTS_SQL = """points AS (SELECT l_orderkey AS okey, l_linenumber AS lnum, l_quantity AS x, round(abs(l_discount) * 100) AS y,
  round(abs(l_tax) * 100) AS z FROM lineitem)"""
