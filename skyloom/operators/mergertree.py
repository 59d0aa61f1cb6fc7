"""Merger trees: overlaps of groups in consecutive snapshots, their events, and carried-over dead groups.

members: (timestep, halo_tag, id). A progenitor's share in a descendant is rounded per cent of the progenitor's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions.shared import materialize


def overlaps(members: DataFrame) -> DataFrame:
    """(timestep, halo_tag, next_tag, shared, size, pct) for groups of a snapshot and the one after it that share ids.

    One equi-join on the id, for all intervals at once: the snapshot number is part of the key.
    """
    sizes = members.groupBy("timestep", "halo_tag").agg(F.count("*").alias("size"))
    later = members.select((F.col("timestep") - 1).alias("timestep"), F.col("halo_tag").alias("next_tag"), "id")
    shared = members.join(later, ["timestep", "id"]).groupBy("timestep", "halo_tag", "next_tag").agg(F.count("*").alias("shared"))
    return shared.join(sizes, ["timestep", "halo_tag"]).withColumn("pct", F.round(100 * F.col("shared") / F.col("size")).cast("int"))


def matches(members: DataFrame, threshold: int) -> DataFrame:
    """Overlaps at or above the threshold, with the number of matches of each side."""
    row = F.count("*").over(Window.partitionBy("timestep", "halo_tag"))
    col = F.count("*").over(Window.partitionBy("timestep", "next_tag"))
    return overlaps(members).filter(F.col("pct") >= threshold).select("timestep", "halo_tag", "next_tag", "pct", row.alias("n_next"), col.alias("n_prev"))


def interval_events(members: DataFrame, threshold: int) -> DataFrame:
    """(timestep, halo_tag, event_mask): what happened to each group of a snapshot as seen from the one before.

    No match before: birth (8). One: continuation (4), and split (1) if the progenitor has others. More: merge (2), and
    split if the first matching progenitor, by tag, has others. Groups with no match after die (see deaths)."""
    m = matches(members, threshold)
    first = Window.partitionBy("timestep", "next_tag").orderBy("halo_tag")
    seen = m.withColumn("place", F.row_number().over(first)).filter("place = 1")
    mask = F.when(F.col("n_prev") == 1, 4).otherwise(2) + F.when(F.col("n_next") > 1, 1).otherwise(0)
    known = seen.select((F.col("timestep") + 1).alias("timestep"), F.col("next_tag").alias("halo_tag"), mask.alias("mask"))
    groups = members.select("timestep", "halo_tag").distinct()
    return groups.join(known, ["timestep", "halo_tag"], "left").select("timestep", "halo_tag", F.coalesce("mask", F.lit(8)).cast("int").alias("event_mask"))


def deaths(members: DataFrame, threshold: int) -> DataFrame:
    """(timestep, halo_tag): groups of all snapshots but the last that no later group continues."""
    groups = members.select("timestep", "halo_tag").distinct()
    last = groups.agg(F.max("timestep").alias("last"))
    alive = matches(members, threshold).select("timestep", "halo_tag").distinct()
    return groups.join(F.broadcast(last), F.col("timestep") < F.col("last")).drop("last").join(alive, ["timestep", "halo_tag"], "left_anti")


def interval(before: DataFrame, after: DataFrame, threshold: int, cutoff: int, aged: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One step of the tree. before: (node_id, tag, zombie, age, id), after: (tag, id) of the next snapshot; aged: zombies
    past the cut-off (node_id, tag, zombie, age), which are carried on but compared no more.

    Returns links (node_id, tag) and nodes of the next snapshot without ids of their own: (tag, zombie, age, event_mask,
    source), source being the node that a zombie continues."""
    size = before.groupBy("node_id", "tag", "zombie", "age").agg(F.count("*").alias("size"))
    live = before.filter((~F.col("zombie")) | (F.col("age") <= cutoff))
    shared = live.join(after.withColumnRenamed("tag", "next_tag"), "id").groupBy("node_id", "next_tag").agg(F.count("*").alias("shared"))
    found = shared.join(size, "node_id").filter(F.round(100 * F.col("shared") / F.col("size")) >= threshold)
    row = F.count("*").over(Window.partitionBy("node_id"))
    col = F.count("*").over(Window.partitionBy("next_tag"))
    first = F.row_number().over(Window.partitionBy("next_tag").orderBy("node_id"))
    found = found.select("node_id", "next_tag", "zombie", row.alias("n_next"), col.alias("n_prev"), first.alias("place"))
    bits = F.when(F.col("n_prev") == 1, 4).otherwise(2) + F.when(F.col("n_next") > 1, 1).otherwise(0) + F.when(F.col("zombie"), 32).otherwise(0)
    known = found.filter("place = 1").select(F.col("next_tag").alias("tag"), bits.alias("mask"))
    fresh = after.select("tag").distinct().join(known, "tag", "left").select(
        "tag", F.lit(False).alias("zombie"), F.lit(0).alias("age"), F.coalesce("mask", F.lit(8)).cast("int").alias("event_mask"), F.lit(None).cast("long").alias("source")
    )
    gone = size.join(found.select("node_id").distinct(), "node_id", "left_anti").drop("size")
    if aged is not None:
        gone = gone.unionByName(aged)
    ghosts = gone.select("tag", F.lit(True).alias("zombie"), (F.col("age") + 1).alias("age"), F.lit(16).alias("event_mask"), F.col("node_id").alias("source"))
    return found.select("node_id", F.col("next_tag").alias("tag")), fresh.unionByName(ghosts)


def build_tree(members: DataFrame, threshold: int = 50, cutoff: int = 5) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) over all snapshots, dead groups carried along as zombies and reborn if matched again.

    nodes: node_id, timestep, halo_tag, zombie, age, event_mask, descendant_id; edges: node_id, descendant_id. Only the
    carry-over is sequential: one round for each snapshot, its state written to the shared folder. Ids run on by
    (timestep, zombie, tag, source). Particles of zombies are carried until these are past the cut-off.

    A node's descendant is the most massive one, by its particles here (sinks.tree_table has masses); of equals that of the
    least id."""
    members = materialize(members.select("timestep", F.col("halo_tag").alias("tag"), "id").distinct(), "members")
    steps = sorted(r[0] for r in members.select("timestep").distinct().collect())
    sizes: list[DataFrame] = []
    nodes, edges, state, aged, following = [], [], None, None, 0
    for step in steps:
        after = members.filter(F.col("timestep") == step).select("tag", "id")
        if state is None:
            fresh = after.select("tag").distinct().select("tag", F.lit(False).alias("zombie"), F.lit(0).alias("age"), F.lit(8).alias("event_mask"), F.lit(None).cast("long").alias("source"))
            links = None
        else:
            links, fresh = interval(state, after, threshold, cutoff, aged)
            links = materialize(links, "tree-links")
        numbered = materialize(_number(fresh, following).withColumn("timestep", F.lit(step)), "tree-nodes")
        if links is not None:
            kept = links.join(numbered.filter("NOT zombie").select("tag", F.col("node_id").alias("descendant_id")), "tag").select("node_id", "descendant_id")
            carried = numbered.filter("zombie").select(F.col("source").alias("node_id"), F.col("node_id").alias("descendant_id"))
            edges.append(kept.unionByName(carried))
        own = numbered.filter("NOT zombie").join(after, "tag").select("node_id", "tag", "zombie", "age", "id")
        if state is not None:
            own = own.unionByName(carried_ids(numbered, state, cutoff))
        aged = numbered.filter(F.col("zombie") & (F.col("age") > cutoff)).select("node_id", "tag", "zombie", "age")
        state = materialize(own, "tree-state")
        sizes.append(state.groupBy("node_id").agg(F.count("*").alias("size")))
        following += numbered.count()
        nodes.append(numbered)
    all_nodes = _union(nodes)
    if not edges:
        return all_nodes.select("node_id", "timestep", F.col("tag").alias("halo_tag"), "zombie", "age", "event_mask", F.lit(-1).cast("long").alias("descendant_id")), all_nodes.select("node_id", F.col("node_id").alias("descendant_id")).limit(0)
    all_edges = _union(edges)
    heavy = all_edges.join(_union(sizes).withColumnRenamed("node_id", "descendant_id"), "descendant_id", "left")
    first = F.struct(F.coalesce("size", F.lit(0)).alias("size"), (-F.col("descendant_id")).alias("near"))
    best = heavy.groupBy("node_id").agg(F.max_by("descendant_id", first).alias("descendant_id"))
    out = all_nodes.join(best, "node_id", "left").select("node_id", "timestep", F.col("tag").alias("halo_tag"), "zombie", "age", "event_mask", F.coalesce("descendant_id", F.lit(-1)).alias("descendant_id"))
    return out, all_edges


def carried_ids(numbered: DataFrame, state: DataFrame, cutoff: int) -> DataFrame:
    """The particles of zombies that may yet be matched, from those of the nodes they continue."""
    old = state.select(F.col("node_id").alias("source"), "id")
    return numbered.filter(F.col("zombie") & (F.col("age") <= cutoff)).join(old, "source").select("node_id", "tag", "zombie", "age", "id")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _number(fresh: DataFrame, following: int) -> DataFrame:
    """Contiguous ids by (zombie, tag, source): ranks within parts of a range sort, and the sums of the parts before them."""
    spark = fresh.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    laid = materialize(fresh.repartitionByRange(tasks, "zombie", "tag", "source").withColumn("part", F.spark_partition_id()), "tree-order")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = laid.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("zombie", "tag", "source"))
    return laid.join(F.broadcast(starts), "part").withColumn("node_id", F.col("start") + place - 1 + following).drop("part", "start")


def text_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, line): the tree as text, progenitors and descendants listed in order."""
    down = edges.groupBy("node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("descendant_id")), lambda x: x.cast("string")), " ").alias("down"))
    up = edges.groupBy(F.col("descendant_id").alias("node_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("node_id")), lambda x: x.cast("string")), " ").alias("up"))
    from skyloom.functions.expr import event_names

    joined = nodes.join(down, "node_id", "left").join(up, "node_id", "left")
    line = F.concat_ws("\t", F.col("node_id").cast("string"), F.concat_ws(".", "timestep", "halo_tag"), event_names(F.col("event_mask")), F.coalesce("up", F.lit("-")), F.coalesce("down", F.lit("FINAL TIMESTEP")))
    return joined.select("node_id", line.alias("line"))


def tree_counts(nodes: DataFrame) -> DataFrame:
    """Nodes, zombies and events of each snapshot."""
    from skyloom.functions.expr import EVENTS

    return nodes.groupBy("timestep").agg(
        F.count("*").alias("nodes"), F.count_if("zombie").alias("zombies"), *(F.count_if(F.col("event_mask").bitwiseAND(bit) != 0).alias(f"n_{name.lower()}") for name, bit in EVENTS.items())
    )
