"""Range joins by grid cells: the one physical device behind friends, ghosts, profiles and neighbours."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions.expr import AXES, dist2, grid_index, periodic_gap

_AROUND = list(product((-1, 0, 1), repeat=3))
#: Half of the neighbour cells: each unordered pair of cells once.
_AHEAD = [o for o in _AROUND if o > (0, 0, 0)]


def cells(df: DataFrame, side: float, prefix: str = "c") -> DataFrame:
    """Adds the integer cell of each axis."""
    return df.withColumns({f"{prefix}{a}": F.floor(F.col(a) / side).cast("long") for a in AXES})


def _offsets(offsets) -> Column:
    return F.array(*(F.struct(*(F.lit(v).alias(f"o{a}") for v, a in zip(o, AXES))) for o in offsets))


def close_pairs(points: DataFrame, radius: float, key: str = "id") -> DataFrame:
    """(id1, id2, d2): all pairs with id1 < id2 and distance below radius, strictly.

    Each point is sent to its own cell and the 13 ahead of it, so a pair of cells meets once and the equi-join on the
    cell does the work; a hot cell's join partition can be split by the engine.
    """
    cols = [key, *AXES]
    at = cells(points.select(*cols), radius)
    left = at.select(*(F.col(c).alias(f"a_{c}") for c in cols), "cx", "cy", "cz")
    sent = at.withColumn("o", F.explode(_offsets([(0, 0, 0), *_AHEAD])))
    right = sent.select(*(F.col(c).alias(f"b_{c}") for c in cols), *((F.col(f"c{a}") + F.col(f"o.o{a}")).alias(f"c{a}") for a in AXES), ((F.col("o.ox") == 0) & (F.col("o.oy") == 0) & (F.col("o.oz") == 0)).alias("same"))
    met = left.join(right, ["cx", "cy", "cz"]).filter((~F.col("same")) | (F.col(f"a_{key}") < F.col(f"b_{key}")))
    d2 = dist2("a_", "b_")
    return met.filter((d2 < radius * radius) & (F.col(f"a_{key}") != F.col(f"b_{key}"))).select(
        F.least(f"a_{key}", f"b_{key}").alias("id1"), F.greatest(f"a_{key}", f"b_{key}").alias("id2"), d2.alias("d2")
    )


def close_pairs_periodic(points: DataFrame, radius: float, box: float, key: str = "id") -> DataFrame:
    """As close_pairs on a torus of side box; positions lie in [0, box). Cells are at least the radius wide."""
    n = int(box // radius)
    if n < 3:
        raise ValueError("the box must hold three cells of the radius")
    side = box / n
    cols = [key, *AXES]
    cell = lambda a: F.least(F.floor(F.col(a) / side).cast("long"), F.lit(n - 1)).alias(f"c{a}")
    at = points.select(*cols, *(cell(a) for a in AXES))
    left = at.select(*(F.col(c).alias(f"a_{c}") for c in cols), "cx", "cy", "cz")
    sent = at.withColumn("o", F.explode(_offsets(_AROUND)))
    right = sent.select(*(F.col(c).alias(f"b_{c}") for c in cols), *(F.pmod(F.col(f"c{a}") + F.col(f"o.o{a}"), F.lit(n)).alias(f"c{a}") for a in AXES))
    gaps = [periodic_gap(F.col(f"a_{a}"), F.col(f"b_{a}"), box) for a in AXES]
    d2 = gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2]
    met = left.join(right, ["cx", "cy", "cz"]).filter((F.col(f"a_{key}") < F.col(f"b_{key}")) & (d2 < radius * radius))
    return met.select(F.col(f"a_{key}").alias("id1"), F.col(f"b_{key}").alias("id2"), d2.alias("d2"))


def within(centers: DataFrame, points: DataFrame, radius: float, inclusive: bool = False) -> DataFrame:
    """Every point within the radius of every center; centers bring columns center_x, center_y, center_z.

    Centers, the few, are sent to the 27 cells about theirs; points stay in their own.
    """
    c = centers.withColumn("o", F.explode(_offsets(_AROUND)))
    c = c.withColumns({f"c{a}": F.floor(F.col(f"center_{a}") / radius).cast("long") + F.col(f"o.o{a}") for a in AXES}).drop("o")
    met = cells(points, radius).join(c, ["cx", "cy", "cz"]).drop("cx", "cy", "cz")
    d2 = dist2("", "center_")
    return met.withColumn("d2", d2).filter(F.col("d2") <= radius * radius if inclusive else F.col("d2") < radius * radius)


def ghost_exchange(points: DataFrame, box: float, blocks: int, depth: float) -> DataFrame:
    """Copies of points for the 26 neighbour blocks in whose closed share region they lie, shifted across the box.

    Positions lie in [0, box). Adds owner_*, ghost_* (blocks) and x, y, z as the neighbour sees them.
    """
    side = box / blocks
    at = points.withColumns({f"owner_{a}": F.least(F.floor(F.col(a) / side), F.lit(blocks - 1)).cast("int") for a in AXES})
    at = at.withColumn("o", F.explode(_offsets([o for o in _AROUND if o != (0, 0, 0)])))
    keep, ghost, moved = F.lit(True), {}, {}
    for a in AXES:
        low = F.col(f"owner_{a}") * F.lit(side)
        step = F.col(f"o.o{a}")
        keep = keep & F.when(step < 0, F.col(a) <= low + depth).when(step > 0, F.col(a) >= low + side - depth).otherwise(True)
        block = F.col(f"owner_{a}") + step
        ghost[f"ghost_{a}"] = F.pmod(block, F.lit(blocks)).cast("int")
        moved[a] = F.col(a) + F.when(block < 0, box).when(block >= blocks, -box).otherwise(0.0)
    return at.filter(keep).withColumns(ghost | moved).drop("o")


def nearest(points: DataFrame, group: str, k: int, key: str = "id") -> DataFrame:
    """The k nearest others of each point within its group: id, other, d2, rank from 1. Ties go to the lesser id.

    A group is joined with itself on the group key; groups are halos, whose size the caller has bounded.
    """
    from pyspark.sql import Window

    a = points.select(group, *(F.col(c).alias(f"a_{c}") for c in (key, *AXES)))
    b = points.select(group, *(F.col(c).alias(f"b_{c}") for c in (key, *AXES)))
    met = a.join(b, group).filter(F.col(f"a_{key}") != F.col(f"b_{key}")).withColumn("d2", dist2("a_", "b_"))
    order = Window.partitionBy(f"a_{key}").orderBy("d2", f"b_{key}")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(group, F.col(f"a_{key}").alias(key), F.col(f"b_{key}").alias("other"), "d2", "rank")


def owners(points: DataFrame, box: float, blocks: int, prefix: str = "owner_") -> DataFrame:
    """Adds the block along each axis that owns a position: half-open, `blocks` along each side of the box."""
    return points.withColumns({f"{prefix}{a}": F.least(F.floor(F.col(a) / (box / blocks)), F.lit(blocks - 1)).cast("int") for a in AXES})


def rehome(points: DataFrame, box: float, blocks: int) -> DataFrame:
    """Points with the blocks home_* that owned them, after they moved: positions on the torus, owner_* and orphan, which is
    true where the new owner is not the old one nor one of its 26 neighbours."""
    inside = points.withColumns({a: F.col(a) - F.floor(F.col(a) / box) * box for a in AXES})
    out = owners(inside, box, blocks)
    far = F.lit(False)
    for a in AXES:
        gap = F.abs(F.col(f"owner_{a}") - F.col(f"home_{a}"))
        far = far | (F.least(gap, F.lit(blocks) - gap) > 1)
    return out.withColumn("orphan", far)


def grid_ghosts(spark: SparkSession, n: int, blocks: int, low: int, high: int) -> DataFrame:
    """Which cells of an n cubed periodic grid each block gets from others: block_*, the place i, j, k in the block's own
    array and cell, its number, i fastest. A block has `low` dead planes before its own cells and `high` behind them."""
    size = n // blocks
    out = spark.range(blocks**3 * (size + low + high) ** 3)
    wide = size + low + high
    place, block = F.expr(f"id % {wide**3}"), F.expr(f"id div {wide**3}")
    out = out.select(block.alias("_b"), place.alias("_p"))
    for step, (a, name) in enumerate(zip(AXES, "ijk")):
        out = out.withColumn(f"block_{a}", F.expr(f"_b div {blocks**step} % {blocks}")).withColumn(name, F.expr(f"_p div {wide**step} % {wide}"))
    dead = F.lit(False)
    for name in "ijk":
        dead = dead | (F.col(name) < low) | (F.col(name) >= low + size)
    at = [F.pmod(F.col(f"block_{a}") * size + F.col(name) - low, F.lit(n)) for a, name in zip(AXES, "ijk")]
    return out.filter(dead).select(*(f"block_{a}" for a in AXES), *"ijk", grid_index(*at, n, n).alias("cell"))
