"""Voronoi cells by half-space clipping, their statistics, regions and shape functionals."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions.expr import AXES
from skyloom.operators.components import connected_components
from skyloom.operators.spatial import ghost_exchange


def _clip(faces: list, normal: np.ndarray, offset: float, label: int) -> list | None:
    """Cut a convex polyhedron (label, corners of each face) by normal . x <= offset; None if nothing is cut."""
    cut_any, kept, rim = False, [], []
    for name, corners in faces:
        d = corners @ normal - offset
        if (d <= 1e-12).all():
            kept.append((name, corners))
            continue
        cut_any = True
        out = []
        for i in range(len(corners)):
            j = (i + 1) % len(corners)
            if d[i] <= 0:
                out.append(corners[i])
            if (d[i] < 0 < d[j]) or (d[j] < 0 < d[i]):
                x = corners[i] + (corners[j] - corners[i]) * (d[i] / (d[i] - d[j]))
                out.append(x)
                rim.append(x)
            elif d[i] == 0:
                rim.append(corners[i])
        if len(out) >= 3:
            kept.append((name, np.array(out)))
    if not cut_any:
        return None
    if len(rim) >= 3:
        rim = np.array(rim)
        mid = rim.mean(0)
        a = np.cross(normal, [1.0, 0, 0] if abs(normal[0]) < 0.9 * np.linalg.norm(normal) else [0, 1.0, 0])
        b = np.cross(normal, a)
        order = np.argsort(np.arctan2((rim - mid) @ b, (rim - mid) @ a))
        ring = rim[order]
        ring = ring[np.linalg.norm(ring - np.roll(ring, 1, axis=0), axis=1) > 1e-12]
        if len(ring) >= 3:
            kept.append((label, ring))
    return kept


def _cube(low: np.ndarray, high: np.ndarray) -> list:
    corner = lambda bits: np.where(np.array(bits), high, low)
    rings = [((0, 0, 0), (0, 1, 0), (0, 1, 1), (0, 0, 1)), ((1, 0, 0), (1, 0, 1), (1, 1, 1), (1, 1, 0))]
    out = []
    for axis in range(3):
        for side in rings:
            out.append((-1 - len(out), np.array([corner(np.roll(c, axis)) for c in side])))
    return out


def cell(site: np.ndarray, others: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray) -> list:
    """Faces of the cell of a site among its neighbours, nearest first until none can reach a corner."""
    faces = _cube(low, high)
    gap = np.linalg.norm(others - site, axis=1)
    for i in np.argsort(gap, kind="stable"):
        reach = max(np.linalg.norm(c - site, axis=1).max() for _, c in faces)
        if gap[i] > 2 * reach:
            break
        normal = others[i] - site
        cut = _clip(faces, normal, normal @ (site + others[i]) / 2, int(labels[i]))
        faces = faces if cut is None else cut
    return faces


def measures(faces: list, site: np.ndarray) -> tuple[float, float]:
    """Volume and area: triangles of each face from its first corner, and their pyramids to the site."""
    volume = area = 0.0
    for _, c in faces:
        normal = np.cross(c[1:-1] - c[0], c[2:] - c[0])
        area += np.linalg.norm(normal.sum(0)) / 2
        volume += abs((normal @ (c[0] - site)).sum()) / 6
    return volume, area


def cells(points: DataFrame, box: float, blocks: int, depth: float) -> DataFrame:
    """id, volume, area, n_faces, complete, faces (neighbour and corners) of every point's cell in the periodic box.

    Each block gets its own points and the ghosts within depth (at most half a block side's neighbours are seen); a cell
    is complete if its security radius stays within that depth. Blocks bound what a task holds; use more for more points.
    """
    side = box / blocks
    owners = {f"block_{a}": F.least(F.floor(F.col(a) / side), F.lit(blocks - 1)).cast("int") for a in AXES}
    own = points.select("id", *AXES).withColumns(owners).withColumn("ghost", F.lit(False))
    ghosts = ghost_exchange(points.select("id", *AXES), box, blocks, depth).select("id", *AXES, *(F.col(f"ghost_{a}").alias(f"block_{a}") for a in AXES), F.lit(True).alias("ghost"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        xyz, ids, ghost = pdf[list(AXES)].to_numpy(), pdf["id"].to_numpy(), pdf["ghost"].to_numpy()
        low = np.array([pdf[f"block_{a}"].iloc[0] * side for a in AXES]) - depth
        high = low + side + 2 * depth
        rows = []
        for i in np.flatnonzero(~ghost):
            rest = np.arange(len(ids)) != i
            faces = cell(xyz[i], xyz[rest], ids[rest], low, high)
            volume, area = measures(faces, xyz[i])
            reach = max(np.linalg.norm(c - xyz[i], axis=1).max() for _, c in faces)
            wall = min((xyz[i] - low).min(), (high - xyz[i]).min())
            rows.append((ids[i], volume, area, len(faces), all(n >= 0 for n, _ in faces) and 2 * reach <= wall, [{"neighbour": n, "corners": c.ravel().tolist()} for n, c in faces]))
        return pd.DataFrame(rows, columns=["id", "volume", "area", "n_faces", "complete", "faces"])

    both = own.unionByName(ghosts)
    return both.groupBy(*(f"block_{a}" for a in AXES)).applyInPandas(run, "id long, volume double, area double, n_faces int, complete boolean, faces array<struct<neighbour:long,corners:array<double>>>")


def volume_bounds(df: DataFrame, least: float = -1.0, most: float = -1.0) -> DataFrame:
    """Complete cells whose volume is not below `least` nor above `most`; a bound that is not positive is none."""
    out = df.filter("complete")
    if least > 0:
        out = out.filter(F.col("volume") >= least)
    return out.filter(F.col("volume") <= most) if most > 0 else out


def cell_filter(df: DataFrame, areas: tuple[float, float], volumes: tuple[float, float]) -> DataFrame:
    """Cells within closed ranges of area and volume."""
    return df.filter(F.col("area").between(*areas) & F.col("volume").between(*volumes))


def summary(df: DataFrame) -> DataFrame:
    """Totals, averages and ranges of cells; densities of cells with volume only."""
    density = F.when(F.col("volume") > 0, 1 / F.col("volume"))
    return df.agg(
        F.count("*").alias("cells"), F.avg("volume").alias("avg_volume"), F.min("volume").alias("min_volume"), F.max("volume").alias("max_volume"),
        F.min(density).alias("min_density"), F.max(density).alias("max_density"), F.avg(density).alias("avg_density"),
    )


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, n) between the least and the greatest value, the last bin closed. The range, one row, is broadcast."""
    span = df.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    number = F.when(width > 0, F.least(F.floor((F.col(column) - F.col("low")) / width), F.lit(bins - 1))).otherwise(0)
    return df.crossJoin(F.broadcast(span)).filter(F.col(column).isNotNull()).groupBy(number.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def regions(edges: DataFrame, volumes: DataFrame) -> DataFrame:
    """(region_id, cells, volume): connected cells merged, regions numbered by their least cell."""
    reach = connected_components(edges, "a", "b").withColumnRenamed("node", "id")
    own = volumes.join(reach, "id", "left").withColumn("root", F.coalesce("component", "id"))
    return own.groupBy("root").agg(F.count("*").alias("cells"), F.sum("volume").alias("volume")).withColumnRenamed("root", "region_id")


def boundary_faces(face_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Faces that occur once."""
    return face_rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n = 1").select(*keys)


def region_offsets(counts: DataFrame) -> DataFrame:
    """(block, n, first_id): where each block's region ids begin, by a running sum over blocks (a row for each)."""
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("block", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_id"))


def shapefinders(df: DataFrame) -> DataFrame:
    """Genus, thickness, breadth, length, planarity and filamentarity from surface s, volume v, curvature c, Euler x."""
    g, t, b = 1 - F.col("x") / 2, 3 * F.col("v") / F.col("s"), F.col("s") / F.col("c")
    out = df.withColumns({"g": g, "t": t, "b": b}).withColumn("l", F.col("c") / (4 * math.pi * (F.col("g") + 1)))
    return out.withColumns({"p": (F.col("b") - F.col("t")) / (F.col("b") + F.col("t")), "f": (F.col("l") - F.col("b")) / (F.col("l") + F.col("b"))})


def minkowski(df: DataFrame) -> DataFrame:
    """id, s, v, c, x of polyhedra given as faces: surface, volume, integrated mean curvature over edges, F - E + V."""

    def run(batches):
        for pdf in batches:
            rows = []
            for i, faces in zip(pdf["id"], pdf["faces"]):
                rows.append((i, *polyhedron_functionals([np.array(f["corners"]).reshape(-1, 3) for f in faces])))
            yield pd.DataFrame(rows, columns=["id", "s", "v", "c", "x"])

    return df.select("id", "faces").mapInPandas(run, "id long, s double, v double, c double, x int")


def polyhedron_functionals(faces: list[np.ndarray]) -> tuple[float, float, float, int]:
    """Of a closed convex polyhedron; corners that agree to nine digits are one."""
    middle = np.concatenate(faces).mean(0)
    number: dict[tuple, int] = {}
    edges: dict[tuple, list] = {}
    s = v = 0.0
    for ring in faces:
        normal = np.cross(ring[1:-1] - ring[0], ring[2:] - ring[0]).sum(0)
        if normal @ (ring[0] - middle) < 0:
            normal = -normal
        size = np.linalg.norm(normal)
        s += size / 2
        v += normal @ (ring[0] - middle) / 6
        at = [number.setdefault(tuple(np.round(p, 9)), len(number)) for p in ring]
        for i in range(len(ring)):
            a, b = at[i], at[(i + 1) % len(ring)]
            if a != b:
                edges.setdefault((min(a, b), max(a, b)), []).append((normal / max(size, 1e-300), np.linalg.norm(ring[i] - ring[(i + 1) % len(ring)])))
    c = sum(0.5 * sides[0][1] * math.acos(float(np.clip(sides[0][0] @ sides[1][0], -1, 1))) for sides in edges.values() if len(sides) == 2)
    return s, v, c, len(faces) - len(edges) + len(number)


def deposit(df: DataFrame, grid: int, box: float) -> DataFrame:
    """(i, j, k, density): each cell's unit mass over its volume, shared by the grid points inside the cell.

    A cell proposes the grid points of its bounds and keeps those on the site's side of all its faces."""

    def run(batches):
        step = box / grid
        for pdf in batches:
            rows = []
            for volume, faces in zip(pdf["volume"], pdf["faces"]):
                rings = [np.array(f["corners"]).reshape(-1, 3) for f in faces]
                corners = np.concatenate(rings)
                low, high = np.floor(corners.min(0) / step).astype(int), np.ceil(corners.max(0) / step).astype(int)
                axes = [np.arange(a, b + 1) for a, b in zip(low, high)]
                ijk = np.stack(np.meshgrid(*axes, indexing="ij"), -1).reshape(-1, 3)
                xyz, inside, middle = ijk * step, np.ones(len(ijk), bool), corners.mean(0)
                for ring in rings:
                    normal = np.cross(ring[1:-1] - ring[0], ring[2:] - ring[0]).sum(0)
                    side = np.sign(normal @ (middle - ring[0]))
                    inside &= ((xyz - ring[0]) @ normal) * side >= 0
                own = ijk[inside] % grid
                rows += [(int(a), int(b), int(c), 1 / volume / len(own)) for a, b, c in own]
            yield pd.DataFrame(rows, columns=["i", "j", "k", "density"])

    spread = df.filter("volume > 0").select("volume", "faces").mapInPandas(run, "i int, j int, k int, density double")
    return spread.groupBy("i", "j", "k").agg(F.sum("density").alias("density"))


def deposit_weighted(df: DataFrame, grid: int, box: float) -> DataFrame:
    """(i, j, k, density): each cell's unit mass over its volume, dealt to the grid points of the cell's bounds by the
    inverse of the volume of the box between the cell's middle and the point. Cells bring volume and faces."""

    def run(batches):
        step, eps = box / grid, 1e-9 * box
        for pdf in batches:
            rows = []
            for volume, faces in zip(pdf["volume"], pdf["faces"]):
                corners = np.concatenate([np.array(f["corners"]).reshape(-1, 3) for f in faces])
                low, high, middle = np.floor(corners.min(0) / step).astype(int), np.ceil(corners.max(0) / step).astype(int), np.unique(np.round(corners, 12), axis=0).mean(0)
                ijk = np.stack(np.meshgrid(*(np.arange(a, b + 1) for a, b in zip(low, high)), indexing="ij"), -1).reshape(-1, 3)
                gap = np.abs(ijk * step - middle)
                weight = 1 / np.where(gap < eps, 2 * eps, gap).prod(1)
                rows += [(*map(int, p % grid), float(w)) for p, w in zip(ijk, weight / weight.sum() / volume)]
            yield pd.DataFrame(rows, columns=["i", "j", "k", "density"])

    spread = df.filter("volume > 0").select("volume", "faces").mapInPandas(run, "i int, j int, k int, density double")
    return spread.groupBy("i", "j", "k").agg(F.sum("density").alias("density"))
