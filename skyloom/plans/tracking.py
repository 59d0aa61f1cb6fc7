"""Groups of every snapshot found, or a catalog taken as it is, and the merger tree over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions.shared import materialize
from skyloom.operators import halos, mergertree
from skyloom.sources.sinks import tree_table


def find_members(particles: DataFrame, radius: float, least: int) -> tuple[DataFrame, DataFrame]:
    """Of particles(timestep, redshift, ...): members (timestep, halo_tag, id) and a catalog with the columns of a tree file.
    Snapshots are searched one after the other, each distributed; the driver holds their numbers only."""
    members, catalogs = [], []
    for row in sorted(particles.select("timestep", "redshift").distinct().collect()):
        own = particles.filter(F.col("timestep") == row["timestep"]).drop("timestep", "redshift")
        inside = materialize(halos.halo_particles(own, halos.membership(own, radius, least)), "tracked")
        at = (F.lit(row["timestep"]).alias("timestep"), F.lit(row["redshift"]).alias("redshift"))
        members.append(inside.select(at[0], "halo_tag", "id"))
        p = halos.properties(inside)
        names = {f"fof_halo_center_{a}": f"center_{a}" for a in "xyz"} | {f"fof_halo_mean_{a}": f"mean_center_{a}" for a in "xyz"} | {f"fof_halo_mean_v{a}": f"v_{a}" for a in "xyz"}
        catalogs.append(p.select(*at, "halo_tag", F.col("fof_halo_mass").alias("halo_mass"), *(F.col(k).alias(v) for k, v in names.items())))
    return mergertree._union(members), mergertree._union(catalogs)


def track(particles: DataFrame, radius: float, least: int, threshold: int = 50, cutoff: int = 5) -> DataFrame:
    """The tree file's rows of all snapshots."""
    members, catalog = find_members(particles, radius, least)
    return track_catalog(members, catalog, threshold, cutoff)


def track_catalog(members: DataFrame, catalog: DataFrame, threshold: int = 50, cutoff: int = 5) -> DataFrame:
    """As track, of groups that were found before."""
    nodes, edges = mergertree.build_tree(members, threshold, cutoff)
    return tree_table(nodes, edges, catalog)
