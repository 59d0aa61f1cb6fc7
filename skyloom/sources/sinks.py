"""Sinks: what the operators make, in the columns, lines and files that other tools expect, and the readers of these.

Tables go through Spark's own writers, so any store and format it knows will do; binary record files go through the
shared file helper, a file for each task or block, streamed batch by batch.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions.expr import AXES
from skyloom.functions.files import make_folder, write_bytes
from skyloom.operators import halos
from skyloom.sources.snapshots import COLUMNS, record_bytes

#: The formats of tree files by their number; an unknown one is written as the last.
TREE_FORMATS = {0: "json", 1: "orc", 2: "parquet"}
#: The columns of a tree file, in order.
TREE_COLUMNS = [
    "tree_node_id", "halo_tag", "halo_mass", "timestep", "redshift", "center_x", "center_y", "center_z",
    "mean_center_x", "mean_center_y", "mean_center_z", "v_x", "v_y", "v_z", "descendant_id", "event_mask",
]


def saved(df: DataFrame, path: str, kind: str = "parquet") -> DataFrame:
    """Write df and read it back from there."""
    df.write.format(kind).save(path)
    return df.sparkSession.read.schema(df.schema).format(kind).load(path)


def sampled(key: Column, fraction: float, seed: int = 0) -> Column:
    """Whether a row is in a sample of about the fraction: the same rows in every run and every engine."""
    mixed = (F.pmod(key, F.lit(1 << 31)) * 1103515245 + F.lit(12345 + seed)) % (1 << 31)
    return mixed < F.lit(int(fraction * (1 << 31)))


def tagged_particles(points: DataFrame, members: DataFrame, least: int = 0, fraction: float = 1.0, velocities: bool = True) -> DataFrame:
    """Positions, velocities, id and fof_halo_tag (-1: none) of particles; with `least` those of groups so large alone, with
    `fraction` a sample of them by id."""
    tagged = points.join(members.select("id", F.col("halo_tag").alias("fof_halo_tag"), "halo_size"), "id", "left")
    tagged = tagged.withColumn("fof_halo_tag", F.coalesce("fof_halo_tag", F.lit(-1)))
    if least > 0:
        tagged = tagged.filter((F.col("fof_halo_tag") >= 0) & (F.col("halo_size") >= least))
    if fraction < 1:
        tagged = tagged.filter(sampled(F.col("id"), fraction))
    return tagged.select(*AXES, *(f"v{a}" for a in AXES if velocities), "id", "fof_halo_tag")


def halo_catalog(own: DataFrame) -> DataFrame:
    """fof_halo_tag, fof_halo_mass, center and mean velocity of each group."""
    keep = ["fof_halo_mass", *(f"fof_halo_center_{a}" for a in AXES), *(f"fof_halo_mean_v{a}" for a in AXES)]
    return halos.properties(own).select(F.col("halo_tag").alias("fof_halo_tag"), *keep)


def _triple(names: list[str]) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *(F.format_string("%.6f", n) for n in names)), F.lit("]"))


def property_lines(catalog: DataFrame) -> DataFrame:
    """(halo_tag, text): a paragraph for each group of halos.properties, numbers with six digits."""
    own = F.concat_ws(
        "\n",
        F.format_string("Halo: %d", "halo_tag"), F.format_string("  FOF count = %d", "fof_halo_count"), F.format_string("  FOF mass = %.6f", "fof_halo_mass"),
        F.concat(F.lit("  FOF center of mass = "), _triple([f"fof_halo_center_{a}" for a in AXES])),
        F.concat(F.lit("  FOF avg loc = "), _triple([f"fof_halo_mean_{a}" for a in AXES])),
        F.concat(F.lit("  FOF avg vel = "), _triple([f"fof_halo_mean_v{a}" for a in AXES])),
        F.format_string("  FOF velocity dispersion = %.6f", "fof_halo_vel_disp"),
    )
    return catalog.select("halo_tag", own.alias("text"))


def overdensity_lines(sod: DataFrame, profile: DataFrame) -> DataFrame:
    """(halo_tag, text): a paragraph for each overdensity halo (halo_tag, sod_count, sod_radius, sod_mass) and a line for
    each bin of its profile."""
    line = F.format_string("    Bin %d count: %d mass: %.6f radius: %.6f rho ratio: %.4f rad vel: %.6f", "bin", "n", "m", "radius", "rho_ratio", "rad_vel")
    bins = profile.groupBy("halo_tag").agg(F.array_sort(F.collect_list(F.struct("bin", line.alias("line")))).alias("bins"))
    head = F.concat_ws("\n", F.format_string("Halo %d", "halo_tag"), F.format_string("  SOD count = %d", "sod_count"), F.format_string("  SOD radius = %.6f", "sod_radius"), F.format_string("  SOD mass = %.6f", "sod_mass"))
    return sod.join(bins, "halo_tag").select("halo_tag", F.concat_ws("\n", head, F.array_join(F.transform("bins", lambda b: b["line"]), "\n")).alias("text"))


def subhalo_lines(subhalos: DataFrame) -> DataFrame:
    """(halo_tag, subhalo, text): a paragraph for each subhalo of subhalo.properties."""
    own = F.concat_ws("\n", F.format_string("  Subhalo: %d", "subhalo"), F.format_string("    count = %d", "subhalo_count"), F.format_string("    mass = %.6f", "subhalo_mass"), F.format_string("    velocity dispersion = %.6f", "subhalo_vel_disp"))
    return subhalos.select("halo_tag", "subhalo", own.alias("text"))


def particle_lines(points: DataFrame, members: DataFrame, digits: int = 6) -> DataFrame:
    """(id, line): x vx y vy z vz, the group's tag (-1: none) and the particle's, by white space."""
    tagged = points.join(members.select("id", "halo_tag"), "id", "left")
    numbers = [F.format_string(f"%.{digits}f", c) for a in AXES for c in (a, f"v{a}")]
    return tagged.select("id", F.concat_ws(" ", *numbers, F.coalesce("halo_tag", F.lit(-1)).cast("string"), F.col("id").cast("string")).alias("line"))


def write_record_files(df: DataFrame, folder: str, by: str | None = None, tag: str = "i8", order: str = "<") -> DataFrame:
    """Write particles as record files, one for each task or, with `by`, one or more for each value of that column (of few
    values); (path, by, n). Files are named anew by each attempt, and only those that the result lists are whole."""
    make_folder(folder)
    names = list(COLUMNS) + ([by] if by else [])
    if by:
        df = df.repartition(by).sortWithinPartitions(by)

    def run(batches):
        batches = iter(b for b in batches if b.num_rows)
        held = next(batches, None)
        while held is not None:
            key = held.column(by)[0].as_py() if by else None
            path, n = f"{folder}/part-{'' if key is None else f'{key}-'}{uuid.uuid4().hex}.cosmo", 0

            def parts(key=key):
                nonlocal held, n
                while held is not None:
                    same = np.flatnonzero(np.array(held.column(by).to_pylist()) != key) if by else []
                    end = int(same[0]) if len(same) else held.num_rows
                    n += end
                    if end:
                        yield record_bytes({c: np.asarray(held.column(c))[:end] for c in COLUMNS}, tag, order)
                    if end < held.num_rows:
                        held = held.slice(end)
                        return
                    held = next(batches, None)

            write_bytes(path, parts())
            yield pa.record_batch([pa.array([path]), pa.array([None if key is None else str(key)], pa.string()), pa.array([n])], ["path", "by", "n"])

    return df.select(*names).mapInArrow(run, "path string, by string, n bigint")


def one_halo(own: DataFrame, halo_tag: int, size: int) -> DataFrame:
    """The particles of a group if it has just so many."""
    return own.filter((F.col("halo_tag") == halo_tag) & (F.col("halo_size") == size))


def subhalo_records(own: DataFrame, members: DataFrame) -> DataFrame:
    """Particles of groups whose mass is their subhalo's number (-1: none), for record files by halo_tag."""
    return own.join(members.select("id", "subhalo"), "id", "left").withColumn("mass", F.coalesce("subhalo", F.lit(-1)).cast("double")).drop("subhalo")


def tree_table(nodes: DataFrame, edges: DataFrame, catalog: DataFrame) -> DataFrame:
    """The tree's nodes with what is known of their groups: TREE_COLUMNS.

    catalog: timestep, halo_tag, halo_mass, redshift, center_*, mean_center_*, v_*. A zombie has what its group had when it
    was last seen. The descendant is the most massive one, of equals that of the least id; -1 if there is none."""
    known = catalog.select("timestep", "halo_tag", *TREE_COLUMNS[2:3], *TREE_COLUMNS[4:14])
    known = known.withColumnsRenamed({"timestep": "_seen", "halo_tag": "_tag"})
    placed = nodes.join(known, (F.col("timestep") - F.col("age") == F.col("_seen")) & (F.col("halo_tag") == F.col("_tag")), "left").drop("_seen", "_tag")
    best = heaviest_descendant(edges, placed.select("node_id", "halo_mass"))
    out = placed.drop("descendant_id").join(best, "node_id", "left").withColumn("descendant_id", F.coalesce("descendant_id", F.lit(-1)))
    return out.withColumnRenamed("node_id", "tree_node_id").select(*TREE_COLUMNS)


def heaviest_descendant(edges: DataFrame, masses: DataFrame) -> DataFrame:
    """(node_id, descendant_id): of each node's descendants the most massive, of equals the least id; null masses last."""
    heavy = edges.join(masses.withColumnsRenamed({"node_id": "descendant_id", "halo_mass": "_mass"}), "descendant_id", "left")
    first = F.struct(F.coalesce("_mass", F.lit(float("-inf"))).alias("m"), (-F.col("descendant_id")).alias("d"))
    return heavy.groupBy("node_id").agg(F.max_by("descendant_id", first).alias("descendant_id"))


def write_tree(table: DataFrame, path: str, kind: int | str = 2) -> DataFrame:
    """Write a tree in the format of that number and read it back."""
    return saved(table, path, TREE_FORMATS.get(int(kind) if str(kind).isdigit() else -1, TREE_FORMATS[2]))


def write_cells(cells: DataFrame, path: str) -> None:
    """Voronoi cells, nested."""
    cells.write.parquet(path)


def read_cells(spark: SparkSession, path: str, areas: tuple | None = None, volumes: tuple | None = None) -> DataFrame:
    """Cells written by write_cells, within closed ranges that reach the scan."""
    out = spark.read.parquet(path)
    for name, span in (("area", areas), ("volume", volumes)):
        if span:
            out = out.filter(F.col(name).between(*span))
    return out


def polyhedra(cells: DataFrame) -> DataFrame:
    """(id, area, volume, face, neighbour, corner, x, y, z): a row for each corner of each face."""
    face = cells.select("id", "area", "volume", F.posexplode("faces").alias("face", "f"))
    corner = face.select("id", "area", "volume", "face", F.col("f.neighbour").alias("neighbour"), F.col("f.corners").alias("c"), F.explode(F.sequence(F.lit(0), F.expr("size(f.corners) div 3 - 1"))).alias("corner"))
    return corner.select("id", "area", "volume", "face", "neighbour", "corner", *(F.expr(f"c[3 * corner + {i}]").alias(a) for i, a in enumerate(AXES)))
