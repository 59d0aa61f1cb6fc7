"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from skyloom.functions.shared import drop_folder, shared_path


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Label every node that has an edge with the smallest node id it can reach.

    Returns (node, component). Self-loops and rows with a null end are ignored, repeated edges count once, an empty
    edge table gives an empty result. Every round is a min-aggregate and an equi-join, so a hub's edges are combined
    map-side and its join partition can be split; rounds grow with the logarithm of the graph, not its diameter.
    Each round is written to the shared folder, which cuts the lineage, and observed while it is; the round before goes.
    """
    a, b = F.col(src), F.col(dst)
    first = edges.filter(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    cur, path, before = _written(first)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        nxt, there, after = _written(_small_star(_large_star(cur)))
        drop_folder(cur.sparkSession, path)
        cur, path = nxt, there
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = cur.select(F.col("v").alias("node")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )


def _written(pairs: DataFrame) -> tuple[DataFrame, str, tuple]:
    """The pairs from the shared folder, where they lie, and a signature taken on the way: their count and two order-free
    checksums, equal exactly when a round changed nothing (up to 128-bit chance)."""
    spark, seen = pairs.sparkSession, Observation()
    path = shared_path(spark, "components")
    signed = pairs.observe(
        seen, F.count("*").alias("n"),
        F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("a"), F.coalesce(F.bit_xor(F.xxhash64("v", "u", F.lit(1))), F.lit(0)).alias("b"),
    )
    signed.write.parquet(path)
    got = seen.get
    return spark.read.schema(pairs.schema).parquet(path), path, (got["n"], got["a"], got["b"])


def _large_star(pairs: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the least of its neighbourhood."""
    both = pairs.union(pairs.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours, and itself, to the least of them. Rows have u > v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    moved = pairs.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()
