"""Phase-space probing: a lattice split into tetrahedra, displaced, and sampled by a grid of points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions.expr import determinant3, tet_volume

#: Corners of the five tetrahedra of a voxel, by bits x + 2y + 4z, for even and odd voxels. The middle one
#: touches every second corner and is listed last.
EVEN_TETS = ((0, 1, 2, 4), (3, 2, 1, 7), (5, 1, 4, 7), (6, 4, 2, 7), (1, 2, 4, 7))
ODD_TETS = ((1, 3, 0, 5), (2, 0, 3, 6), (4, 5, 0, 6), (7, 3, 5, 6), (0, 3, 5, 6))


def lattice(spark: SparkSession, cells: int) -> DataFrame:
    """Nodes of a cubic lattice of so many cells a side: node_id, i, j, k; i runs fastest."""
    n = cells + 1
    return spark.range(n**3).select(F.col("id").alias("node_id"), (F.col("id") % n).alias("i"), (F.expr(f"id div {n}") % n).alias("j"), F.expr(f"id div {n * n}").alias("k"))


def displaced(nodes: DataFrame, cells: int, strength: float) -> DataFrame:
    """x, y, z of the nodes in the unit box, moved by a polynomial that vanishes at the faces."""
    u = {a: F.col(i) / F.lit(float(cells)) for a, i in zip("xyz", "ijk")}
    bump = {a: u[a] * (1 - u[a]) * (1 - 2 * u[a]) for a in u}
    nxt = {"x": "y", "y": "z", "z": "x"}
    return nodes.select("node_id", *((u[a] - F.lit(strength) * bump[a] * (F.lit(1.0) + u[nxt[a]])).alias(a) for a in "xyz"))


def tetrahedra(spark: SparkSession, cells: int, compat: bool = False) -> DataFrame:
    """Five tetrahedra for each voxel: tet_id, n0..n3, oriented positively. Voxels alternate so that faces conform; with
    `compat` by the parity of their first node's number, which alternates along all axes for an even number of cells only."""
    n = cells + 1
    voxel = spark.range(cells**3).select(F.col("id").alias("voxel"), (F.col("id") % cells).alias("i"), (F.expr(f"id div {cells}") % cells).alias("j"), F.expr(f"id div {cells * cells}").alias("k"))
    node = lambda b: F.col("i") + (b & 1) + n * (F.col("j") + (b >> 1 & 1) + n * (F.col("k") + (b >> 2 & 1)))
    pattern = lambda tets: F.array(*(F.struct(*(node(b).alias(f"n{s}") for s, b in enumerate(t))) for t in tets))
    parity = node(0) if compat else F.col("i") + F.col("j") + F.col("k")
    chosen = F.when(parity % 2 == 0, pattern([_positive(t) for t in EVEN_TETS])).otherwise(pattern([_positive(t) for t in ODD_TETS]))
    return voxel.select("voxel", F.posexplode(chosen).alias("s", "t")).select((F.col("voxel") * 5 + F.col("s")).alias("tet_id"), "t.n0", "t.n1", "t.n2", "t.n3")


def _positive(t: tuple[int, ...]) -> tuple[int, ...]:
    """The corners in an order of positive volume."""
    p = [(b & 1, b >> 1 & 1, b >> 2 & 1) for b in t]
    a, b, c = ([p[k][i] - p[0][i] for i in range(3)] for k in (1, 2, 3))
    det = a[0] * (b[1] * c[2] - b[2] * c[1]) + a[1] * (b[2] * c[0] - b[0] * c[2]) + a[2] * (b[0] * c[1] - b[1] * c[0])
    return t if det > 0 else (t[0], t[2], t[1], t[3])


def placed(tets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Tetrahedra with the positions of their corners and signed volume; those that miss a node are left out."""
    out = tets
    for s in range(4):
        own = nodes.select(F.col("node_id").alias(f"n{s}"), F.struct("x", "y", "z").alias(f"p{s}"))
        out = out.join(own, f"n{s}")
    corner = lambda s: [F.col(f"p{s}.{a}") for a in "xyz"]
    return out.withColumn("volume", tet_volume(*(corner(s) for s in range(4))))


def inside_fringe(tets: DataFrame, cells: int, fringe: int) -> DataFrame:
    """Tetrahedra all of whose nodes lie at least `fringe` cells off the faces of the lattice."""
    n = cells + 1
    ok = F.lit(True)
    for s in range(4):
        c = F.col(f"n{s}")
        for part in (c % n, F.floor(c / n) % n, F.floor(c / (n * n))):
            ok = ok & (part >= fringe) & (part <= cells - fringe)
    return tets.filter(ok)


def faces(tets: DataFrame) -> DataFrame:
    """(tet_id, a, b, c): the four faces of each, corners in order."""
    corners = [[s for s in range(4) if s != skip] for skip in range(4)]
    made = F.array(*(F.array_sort(F.array(*(F.col(f"n{s}") for s in f))) for f in corners))
    keep = [c for c in tets.columns if c == "volume"]
    return tets.select("tet_id", *keep, F.explode(made).alias("f")).select("tet_id", *keep, *(F.col("f")[i].alias(n) for i, n in enumerate("abc")))


def adjacency(tets: DataFrame) -> DataFrame:
    """(tet_id, other): tetrahedra that share a face, each pair once."""
    g = faces(tets).groupBy("a", "b", "c").agg(F.min("tet_id").alias("tet_id"), F.max("tet_id").alias("other"), F.count("*").alias("n"))
    return g.filter("n = 2").select("tet_id", "other")


def caustics(tets: DataFrame) -> DataFrame:
    """(a, b, c): faces between two placed tetrahedra whose volumes differ in sign."""
    g = faces(tets).groupBy("a", "b", "c").agg(F.count("*").alias("n"), F.min("volume").alias("low"), F.max("volume").alias("high"))
    return g.filter("n = 2 AND low < 0 AND high > 0").select("a", "b", "c")


def _same_side(point: list[Column], p: list[list[Column]], whole: Column | None = None) -> Column:
    """Whether the five determinants of a point and a tetrahedron agree in sign; points on a face are outside. whole: a
    number with the sign of the tetrahedron's own, where it is known."""

    def volume(q):
        edge = lambda s: [q[s][i] - q[0][i] for i in range(3)]
        return determinant3(edge(1), edge(2), edge(3))

    whole = volume(p) if whole is None else whole
    ok = F.lit(True)
    for s in range(4):
        ok = ok & (whole * volume([point if t == s else p[t] for t in range(4)]) > 0)
    return ok


def probe(points: DataFrame, tets: DataFrame, side: float) -> DataFrame:
    """(point_id, streams, rho): how many tetrahedra hold each point, and their mean volume; 0 where there is none.

    Tetrahedra go to every bucket of the given side that their bounds touch, points to the one they lie in.
    """
    least = lambda a: F.least(*(F.col(f"p{s}.{a}") for s in range(4)))
    most = lambda a: F.greatest(*(F.col(f"p{s}.{a}") for s in range(4)))
    put = tets.select("tet_id", "p0", "p1", "p2", "p3", "volume")
    for a in "xyz":
        put = put.withColumn(f"b{a}", F.explode(F.sequence(F.floor(least(a) / side), F.floor(most(a) / side))))
    at = points.select("point_id", *(F.col(a).alias(f"q{a}") for a in "xyz"), *(F.floor(F.col(a) / side).alias(f"b{a}") for a in "xyz"))
    bound = F.lit(True)
    for a in "xyz":
        bound = bound & (F.col(f"q{a}") >= least(a)) & (F.col(f"q{a}") <= most(a))
    hit = _same_side([F.col(f"q{a}") for a in "xyz"], [[F.col(f"p{s}.{a}") for a in "xyz"] for s in range(4)], F.col("volume"))
    found = at.join(put, ["bx", "by", "bz"]).filter(bound).filter(hit).groupBy("point_id").agg(F.count("*").alias("streams"), F.avg(F.abs("volume")).alias("rho"))
    return points.select("point_id").join(found, "point_id", "left").select("point_id", F.coalesce("streams", F.lit(0)).alias("streams"), F.coalesce("rho", F.lit(0.0)).alias("rho"))


def probe_uniform(tets: DataFrame, n: int) -> DataFrame:
    """probe() of the points of probe_grid(n), without a join: each tetrahedron makes the grid points of its own bounds and
    keeps those inside, so only hits are shuffled, added up in their tasks before."""
    put = tets.select("p0", "p1", "p2", "p3", "volume")
    size = F.lit(1)
    for a in "xyz":
        corners = [F.col(f"p{s}.{a}") * n - 0.5 for s in range(4)]
        first, last = F.ceil(F.least(*corners) - 1e-9), F.floor(F.greatest(*corners) + 1e-9)
        put = put.withColumn(f"_{a}", F.greatest(first, F.lit(0))).withColumn(f"_n{a}", F.least(last, F.lit(n - 1)) - F.col(f"_{a}") + 1)
        put = put.filter(F.col(f"_n{a}") > 0)
        size = size * F.col(f"_n{a}")
    put = put.withColumn("_at", F.explode(F.sequence(F.lit(0), size - 1)))
    i = F.col("_x") + F.col("_at") % F.col("_nx")
    j = F.col("_y") + F.expr("_at div _nx % _ny")
    k = F.col("_z") + F.expr("_at div (_nx * _ny)")
    hit = _same_side([(c + F.lit(0.5)) / n for c in (i, j, k)], [[F.col(f"p{s}.{a}") for a in "xyz"] for s in range(4)], F.col("volume"))
    found = put.filter(hit).select(((k * n + j) * n + i).alias("point_id"), F.abs("volume").alias("v"))
    found = found.groupBy("point_id").agg(F.count("*").alias("streams"), F.avg("v").alias("rho"))
    every = tets.sparkSession.range(n**3).withColumnRenamed("id", "point_id")
    return every.join(found, "point_id", "left").select("point_id", F.coalesce("streams", F.lit(0)).alias("streams"), F.coalesce("rho", F.lit(0.0)).alias("rho"))


def occupancy(tets: DataFrame, side: float) -> DataFrame:
    """(bx, by, bz, n): tetrahedra whose bounds touch each bucket of the given side; buckets without any are left out."""
    put = tets.select("p0", "p1", "p2", "p3")
    for a in "xyz":
        corners = [F.col(f"p{s}.{a}") for s in range(4)]
        put = put.withColumn(f"b{a}", F.explode(F.sequence(F.floor(F.least(*corners) / side), F.floor(F.greatest(*corners) / side))))
    return put.groupBy("bx", "by", "bz").agg(F.count("*").alias("n"))


def probe_grid(spark: SparkSession, n: int) -> DataFrame:
    """n cubed points at cell middles of the unit box."""
    mid = lambda c: (F.expr(c) + F.lit(0.5)) / n
    return spark.range(n**3).select(F.col("id").alias("point_id"), mid(f"id % {n}").alias("x"), mid(f"(id div {n}) % {n}").alias("y"), mid(f"id div {n * n}").alias("z"))


def split_extent(extent: tuple[int, ...], parts: int) -> list[tuple[int, ...]]:
    """Halve the longest side of the first of a queue until there are so many parts; halves share their plane."""
    queue = [tuple(extent)]
    while len(queue) < parts:
        e = queue.pop(0)
        axis = max(range(3), key=lambda a: (e[2 * a + 1] - e[2 * a], -a))
        low, high = e[2 * axis], e[2 * axis + 1]
        if high - low < 2:
            queue.append(e)
            break
        mid = (low + high) // 2
        for a, b in ((low, mid), (mid, high)):
            queue.append(e[: 2 * axis] + (a, b) + e[2 * axis + 2 :])
    return queue
