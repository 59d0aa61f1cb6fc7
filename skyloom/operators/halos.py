"""Friends-of-friends groups, their properties, centers, density profiles and mass histograms."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions.expr import AXES, dist2, sph_kernel
from skyloom.functions.shared import materialize
from skyloom.operators.components import connected_components
from skyloom.operators.spatial import close_pairs, nearest, within


def membership(points: DataFrame, radius: float, least: int = 1) -> DataFrame:
    """(id, halo_tag, halo_size): the component of each particle, named by its least id; -1 if smaller than `least`."""
    return membership_of(points, close_pairs(points, radius), least)


def membership_of(points: DataFrame, pairs: DataFrame, least: int = 1) -> DataFrame:
    """As membership, of given pairs (id1, id2)."""
    reach = connected_components(pairs, "id1", "id2").withColumnRenamed("node", "id")
    tagged = points.select("id").join(reach, "id", "left").select("id", F.coalesce("component", "id").alias("halo_tag"))
    sizes = tagged.groupBy("halo_tag").agg(F.count("*").alias("halo_size"))
    return tagged.join(sizes, "halo_tag").select("id", F.when(F.col("halo_size") >= least, F.col("halo_tag")).otherwise(F.lit(-1)).alias("halo_tag"), "halo_size")


def linked_by_neighbours(points: DataFrame, radius: float, neighbours: int) -> DataFrame:
    """(id1, id2): close pairs both of whose ends have at least so many close others."""
    pairs = close_pairs(points, radius).select("id1", "id2")
    ends = pairs.select(F.col("id1").alias("id")).unionAll(pairs.select(F.col("id2").alias("id"))).groupBy("id").count().filter(F.col("count") >= neighbours).select("id")
    return pairs.join(ends.withColumnRenamed("id", "id1"), "id1", "left_semi").join(ends.withColumnRenamed("id", "id2"), "id2", "left_semi").select("id1", "id2")


def halo_particles(points: DataFrame, members: DataFrame) -> DataFrame:
    """Particles of halos with their tag."""
    return points.join(members.filter("halo_tag >= 0").select("id", "halo_tag", "halo_size"), "id")


def dispersion(prefix: str = "v") -> Column:
    """One-dimensional velocity dispersion of a group; rounding never makes the radicand negative."""
    v = [F.col(f"{prefix}{a}") for a in AXES]
    mean2 = sum((F.avg(c) * F.avg(c) for c in v[1:]), F.avg(v[0]) * F.avg(v[0]))
    return F.sqrt(F.greatest(F.lit(0.0), (F.avg(v[0] * v[0] + v[1] * v[1] + v[2] * v[2]) - mean2) / 3))


def properties(own: DataFrame) -> DataFrame:
    """One row for each halo: count, mass, center of mass, means, dispersion, bounding box, potential minimum."""
    mass = F.sum("mass")
    return own.groupBy("halo_tag").agg(
        F.count("*").alias("fof_halo_count"), mass.alias("fof_halo_mass"),
        *((F.sum(F.col("mass") * F.col(a)) / mass).alias(f"fof_halo_center_{a}") for a in AXES),
        *(F.avg(a).alias(f"fof_halo_mean_{a}") for a in AXES), *(F.avg(f"v{a}").alias(f"fof_halo_mean_v{a}") for a in AXES),
        dispersion().alias("fof_halo_vel_disp"),
        *(f(a).alias(f"{n}_{a}") for a in AXES for f, n in ((F.min, "min"), (F.max, "max"))),
        F.min_by("id", F.struct("potential", "id")).alias("min_potential_id"),
    )


def most_connected(own: DataFrame, radius: float) -> DataFrame:
    """The particle of each halo with most friends below the radius; ties go to the lesser id. (halo_tag, mcp_id, friends)"""
    pairs = close_pairs(own, radius).select("id1", "id2")
    both = pairs.select(F.col("id1").alias("id")).unionAll(pairs.select(F.col("id2").alias("id")))
    # friends of other halos cannot be this near when the radius is no larger than the linking length
    friends = both.groupBy("id").agg(F.count("*").alias("friends"))
    ranked = own.select("id", "halo_tag").join(friends, "id", "left").select("halo_tag", "id", F.coalesce("friends", F.lit(0)).alias("friends"))
    best = F.max_by(F.struct("id", "friends"), F.struct("friends", (-F.col("id")).alias("near")))
    return ranked.groupBy("halo_tag").agg(best.alias("b")).select("halo_tag", F.col("b.id").alias("mcp_id"), F.col("b.friends").alias("friends"))


def most_bound(own: DataFrame) -> DataFrame:
    """The particle of each halo with the least potential -sum m / r over its others at another place. (halo_tag, mbp_id,
    potential). Halos are joined with themselves on their tag."""
    cols = ["id", *AXES]
    a = own.select("halo_tag", *(F.col(c).alias(f"a_{c}") for c in cols))
    b = own.select("halo_tag", F.col("mass").alias("b_mass"), *(F.col(c).alias(f"b_{c}") for c in cols))
    met = a.join(b, "halo_tag").filter(F.col("a_id") != F.col("b_id")).withColumn("d2", dist2("a_", "b_")).filter("d2 > 0")
    phi = met.groupBy("halo_tag", "a_id").agg(F.round(F.sum(-F.col("b_mass") / F.sqrt("d2")), 9).alias("phi"))
    best = F.min_by(F.struct("a_id", "phi"), F.struct("phi", "a_id"))
    return phi.groupBy("halo_tag").agg(best.alias("b")).select("halo_tag", F.col("b.a_id").alias("mbp_id"), F.col("b.phi").alias("potential"))


def most_bound_in_blocks(own: DataFrame, block: int = 4096) -> DataFrame:
    """As most_bound, for halos of any size: (halo_tag, mbp_id, potential), the potential rounded to nine digits.

    A halo's particles are cut into blocks by a hash of the id; a task sums up the potential of one block in another, so
    it holds two blocks and no row is made for a pair of particles. Sums of blocks are added in the engine.
    """
    sizes = own.groupBy("halo_tag").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    at = own.select("halo_tag", "id", *AXES, "mass").join(sizes, "halo_tag").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    of = at.withColumn("a", F.col("block")).withColumn("b", every).withColumn("source", F.lit(False))
    by = at.withColumn("b", F.col("block")).withColumn("a", every).withColumn("source", F.lit(True))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mine, other = pdf[~pdf["source"]], pdf[pdf["source"]]
        xyz, mass = other[list(AXES)].to_numpy(), other["mass"].to_numpy()
        out = np.zeros(len(mine))
        for lo in range(0, len(mine), 256):
            gap = mine[list(AXES)].to_numpy()[lo : lo + 256, None] - xyz[None]
            d2 = np.einsum("ijk,ijk->ij", gap, gap)
            out[lo : lo + 256] = np.where(d2 > 0, -mass / np.sqrt(np.where(d2 > 0, d2, 1)), 0.0).sum(1)
        return pd.DataFrame({"halo_tag": mine["halo_tag"], "id": mine["id"], "phi": out})

    tag, key = own.schema["halo_tag"].dataType.simpleString(), own.schema["id"].dataType.simpleString()
    parts = of.unionByName(by).groupBy("halo_tag", "a", "b").applyInPandas(run, f"halo_tag {tag}, id {key}, phi double")
    phi = parts.groupBy("halo_tag", "id").agg(F.round(F.sum("phi"), 9).alias("phi"))
    best = F.min_by(F.struct("id", "phi"), F.struct("phi", "id"))
    return phi.groupBy("halo_tag").agg(best.alias("b")).select("halo_tag", F.col("b.id").alias("mbp_id"), F.col("b.phi").alias("potential"))


def sizes(members: DataFrame, above: int) -> DataFrame:
    """(halo_tag, halo_size) of groups with more members than `above`."""
    return members.filter((F.col("halo_tag") >= 0) & (F.col("halo_size") > above)).select("halo_tag", "halo_size").distinct()


def particles_of(points: DataFrame, members: DataFrame, halo_tag: int) -> DataFrame:
    """The particles of one group: ids, places and all else that points have."""
    return points.join(members.filter(F.col("halo_tag") == halo_tag).select("id"), "id", "left_semi")


def massive(catalog: DataFrame, mass: float) -> DataFrame:
    """Groups heavier than a mass, strictly: those that overdensity halos are built around."""
    return catalog.filter(F.col("fof_halo_mass") > mass)


def large_enough(catalog: DataFrame, mass: float, size: int) -> DataFrame:
    """Groups of at least a mass and a size."""
    return catalog.filter((F.col("fof_halo_mass") >= mass) & (F.col("fof_halo_count") >= size))


def with_substructure(own: DataFrame, size: int) -> DataFrame:
    """Particles of groups that have more members than `size`, strictly: those searched for subhalos."""
    return own.filter(F.col("halo_size") > size)


def overdensity_radii(centers: DataFrame, spacing: float, unit_mass: float, low: tuple, high: tuple) -> DataFrame:
    """Adds r_min and r_max to centers with fof_halo_mass and center_*: half the particles' mean spacing, and twice the cube
    root of the mass in units of `unit_mass`, cut where the sphere would leave the box from `low` to `high`."""
    r = F.lit(2.0) * F.pow(F.col("fof_halo_mass") / F.lit(unit_mass), F.lit(1 / 3))
    walls = [x for a, lo, hi in zip(AXES, low, high) for x in (F.col(f"center_{a}") - lo, F.lit(hi) - F.col(f"center_{a}"))]
    return centers.withColumns({"r_min": F.lit(0.5 * spacing), "r_max": F.least(r, *walls)})


def profile_without_core(profile: DataFrame) -> DataFrame:
    """A profile's bins but the innermost."""
    return profile.filter("bin >= 1")


def group_report(points: DataFrame, radius: float, least: int, mass: float, spacing: float, unit_mass: float, low: tuple, high: tuple, bins: int, rho_c: float) -> tuple[DataFrame, DataFrame]:
    """Two tables of a snapshot: its groups with halo_id, mass, center, mean velocity, dispersion and, of those heavier than
    `mass`, the overdensity radius and mass; and its particles with halo_id (-1: none)."""
    members = membership(points, radius, least)
    own = halo_particles(points, members)
    groups = properties(own).withColumnsRenamed({f"fof_halo_mean_{a}": f"center_{a}" for a in AXES} | {f"fof_halo_mean_v{a}": f"mean_v{a}" for a in AXES})
    heavy = overdensity_radii(massive(groups, mass).select("halo_tag", "fof_halo_mass", *(f"center_{a}" for a in AXES), *(f"mean_v{a}" for a in AXES)), spacing, unit_mass, low, high).filter("r_max > r_min")
    sod = overdensity_radius(overdensity_profile(heavy, points, None, None, bins, rho_c)).select("halo_tag", "sod_radius", "sod_mass")
    keep = ["fof_halo_mass", *(f"center_{a}" for a in AXES), *(f"mean_v{a}" for a in AXES), "fof_halo_vel_disp"]
    table = groups.join(sod, "halo_tag", "left").select(F.col("halo_tag").alias("halo_id"), *keep, "sod_radius", "sod_mass")
    return table, points.join(members.select("id", F.col("halo_tag").alias("halo_id")), "id")


def chosen_center(own: DataFrame, method: str, radius: float) -> DataFrame:
    """(halo_tag, center_x, center_y, center_z) by AVERAGE, CENTER_OF_MASS, MCP, MBP or POTENTIAL."""
    if method in ("AVERAGE", "CENTER_OF_MASS"):
        kind = "mean" if method == "AVERAGE" else "center"
        return properties(own).select("halo_tag", *(F.col(f"fof_halo_{kind}_{a}").alias(f"center_{a}") for a in AXES))
    if method == "MCP":
        best = most_connected(own, radius).select("halo_tag", F.col("mcp_id").alias("id"))
    elif method == "MBP":
        best = most_bound(own).select("halo_tag", F.col("mbp_id").alias("id"))
    else:
        best = properties(own).select("halo_tag", F.col("min_potential_id").alias("id"))
    return best.join(own.select("halo_tag", "id", *AXES), ["halo_tag", "id"]).select("halo_tag", *(F.col(a).alias(f"center_{a}") for a in AXES))


def _binned(centers: DataFrame, points: DataFrame, r_min: float | None, r_max: float | None, bins: int) -> DataFrame:
    """The points within r_max of each center with their distance r, logarithmic bin and radial velocity vr.

    Without r_min and r_max each center brings its own, in columns of these names; the grid then has the widest."""
    if r_max is None:
        widest = centers.agg(F.max("r_max")).first()[0] or 1.0
        near = within(centers, points, widest).filter(F.col("d2") < F.col("r_max") * F.col("r_max")).withColumn("r", F.sqrt("d2"))
        low, delta = F.col("r_min"), F.log10(F.col("r_max") / F.col("r_min")) / bins
    else:
        near = within(centers, points, r_max).withColumn("r", F.sqrt("d2"))
        low, delta = F.lit(r_min), F.lit(math.log10(r_max / r_min) / bins)
    number = F.when(F.col("r") <= low, 0).otherwise(F.least(F.floor(F.log10(F.col("r") / low) / delta) + 1, F.lit(bins))).cast("int")
    along = sum(((F.col(a) - F.col(f"center_{a}")) * (F.col(f"v{a}") - F.col(f"mean_v{a}")) for a in AXES[1:]), (F.col("x") - F.col("center_x")) * (F.col("vx") - F.col("mean_vx")))
    return near.withColumn("bin", number).withColumn("vr", F.when(F.col("r") > 0, along / F.col("r")).otherwise(0.0))


def overdensity_profile(centers: DataFrame, points: DataFrame, r_min: float | None, r_max: float | None, bins: int, rho_c: float) -> DataFrame:
    """Logarithmic bins about each center: count, mass, mean radius, mean radial velocity, cumulative mass and density
    ratio. centers: halo_tag, center_*, mean_v*. Bin 0 holds what is within r_min; empty bins are there, with ratio 0."""
    return _profile(_binned(centers, points, r_min, r_max, bins), centers, bins, rho_c)


def _profile(near: DataFrame, centers: DataFrame, bins: int, rho_c: float) -> DataFrame:
    filled = near.groupBy("halo_tag", "bin").agg(
        F.count("*").alias("n"), F.sum("mass").alias("m"), F.avg("r").alias("radius"), F.avg("vr").alias("rad_vel")
    )
    every = centers.select("halo_tag", F.explode(F.sequence(F.lit(0), F.lit(bins))).alias("bin"))
    up = Window.partitionBy("halo_tag").orderBy("bin")
    dense = every.join(filled, ["halo_tag", "bin"], "left").select("halo_tag", "bin", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "m", "radius", "rad_vel")))
    dense = dense.withColumn("cum_mass", F.sum("m").over(up.rowsBetween(Window.unboundedPreceding, 0)))
    volume = F.lit(4 * math.pi / 3) * F.col("radius") * F.col("radius") * F.col("radius")
    return dense.withColumn("rho_ratio", F.when(F.col("radius") > 0, F.col("cum_mass") / volume / rho_c).otherwise(0.0))


def overdensity_radius(profile: DataFrame, ratio: float = 200.0) -> DataFrame:
    """The first bin past 0 whose density is above the ratio and whose next is below, and the radius there."""
    up = Window.partitionBy("halo_tag").orderBy("bin")
    both = profile.withColumns({"next_ratio": F.lead("rho_ratio").over(up), "next_radius": F.lead("radius").over(up), "next_mass": F.lead("cum_mass").over(up)})
    crossing = both.filter((F.col("bin") >= 1) & (F.col("rho_ratio") > ratio) & (F.col("next_ratio") < ratio))
    return crossing.groupBy("halo_tag").agg(F.min_by(F.struct((F.col("bin") + 1).alias("critical_bin"), "next_radius", "next_mass"), "bin").alias("c")).select(
        "halo_tag", "c.critical_bin", F.col("c.next_radius").alias("sod_radius"), F.col("c.next_mass").alias("sod_mass")
    )


def overdensity_members(centers: DataFrame, points: DataFrame, r_min: float, r_max: float, bins: int, rho_c: float, ratio: float = 200.0) -> DataFrame:
    """The points inside each center's overdensity radius: halo_tag, r, sod_radius and the columns of points.

    All bins below the critical one belong to it. In the critical bin points are taken by distance, then id, until the
    density up to and with the next one is below the ratio; that one's distance is the radius and it stays outside.
    Centers without a critical bin have no rows; an empty critical bin gives a null radius. Only the critical bin is
    walked in order; what lies below comes in as its sum.
    """
    binned = materialize(_binned(centers, points, r_min, r_max, bins), "sod-near")  # read three times below
    profile = _profile(binned, centers, bins, rho_c)
    found = overdensity_radius(profile, ratio).select("halo_tag", "critical_bin")
    lower = profile.select("halo_tag", (F.col("bin") + 1).alias("critical_bin"), F.col("cum_mass").alias("lower_mass"))
    near = binned.join(found.join(lower, ["halo_tag", "critical_bin"]), "halo_tag")
    up = Window.partitionBy("halo_tag").orderBy("r", "id").rowsBetween(Window.unboundedPreceding, 0)
    ball = F.lit(4 * math.pi / 3) * F.col("r") * F.col("r") * F.col("r")
    rim = near.filter("bin = critical_bin").withColumn("to_here", F.col("lower_mass") + F.sum("mass").over(up))
    rim = rim.withColumn("past", F.max(F.col("to_here") / ball / rho_c < ratio).over(up))
    radius = rim.filter("past").groupBy("halo_tag").agg(F.min("r").alias("sod_radius"))
    keep = ["halo_tag", "r", *points.columns]
    inside = near.filter("bin < critical_bin").select(*keep).unionByName(rim.filter("NOT past").select(*keep))
    return inside.join(radius, "halo_tag", "left")


def density_profile(centers: DataFrame, points: DataFrame, radius: float, spheres: int) -> DataFrame:
    """Particles within (k + 1) radius / spheres of each center, for each sphere k: count and count per volume."""
    near = within(centers, points, radius, inclusive=True)
    shell = F.greatest(F.ceil(F.sqrt("d2") * spheres / radius).cast("int") - 1, F.lit(0))
    shells = near.withColumn("sphere", shell).groupBy("center_id", "sphere").agg(F.count("*").alias("n"))
    every = centers.select("center_id", F.explode(F.sequence(F.lit(0), F.lit(spheres - 1))).alias("sphere"))
    up = Window.partitionBy("center_id").orderBy("sphere").rowsBetween(Window.unboundedPreceding, 0)
    out = every.join(shells, ["center_id", "sphere"], "left").withColumn("n_particles", F.sum(F.coalesce("n", F.lit(0))).over(up))
    r = (F.col("sphere") + 1) * F.lit(radius / spheres)
    return out.select("center_id", "sphere", "n_particles", (F.col("n_particles") / (F.lit(4 * math.pi / 3) * r * r * r)).alias("density"))


def mass_histogram(halos: DataFrame, particle: float, low: float, high: float, bins: int) -> DataFrame:
    """Halos by the logarithm of count times particle mass, in half-open bins: number, mean mass and its logarithm."""
    m = F.col("n") * F.lit(particle)
    step = (high - low) / bins
    number = F.floor((F.log10(m) - low) / step).cast("int")
    found = halos.withColumn("bin", number).withColumn("m", m).filter((F.col("bin") >= 0) & (F.col("bin") < bins)).groupBy("bin").agg(F.count("*").alias("halos"), F.avg("m").alias("mean_mass"))
    return found.withColumn("log_mean", F.log10("mean_mass"))


def smoothed_density(own: DataFrame, k: int, particle: float = 1.0) -> DataFrame:
    """Density of each halo particle: the kernel over its k nearest, with the k-th distance as support."""
    near = nearest(own, "halo_tag", k).withColumn("r", F.sqrt("d2"))
    h = near.groupBy("id").agg(F.max("r").alias("h"))
    return near.join(h, "id").filter("h > 0").groupBy("id", "h").agg((F.sum(sph_kernel(F.col("r"), F.col("h"))) * particle).alias("density"))
