import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions import expr
from skyloom.operators import halos, mergertree, probe, voronoi
from skyloom.operators.components import connected_components
from skyloom.plans import config
from skyloom.sources import snapshots
from skyloom.streaming.tracker import track_files

TRACKER = [(t, g, i) for t, g, a, b in ((0, 0, 0, 5), (0, 1, 6, 10), (0, 2, 11, 20), (1, 0, 0, 10), (1, 1, 25, 30), (2, 0, 0, 10), (2, 1, 25, 27), (2, 2, 28, 30)) for i in range(a, b + 1)]
#: node: timestep, tag, zombie, event mask; then edges.
TREE = {0: (0, 0, False, 8), 1: (0, 1, False, 8), 2: (0, 2, False, 8), 3: (1, 0, False, 2), 4: (1, 1, False, 8), 5: (1, 2, True, 16), 6: (2, 0, False, 4), 7: (2, 1, False, 5), 8: (2, 2, False, 5), 9: (2, 2, True, 16)}
EDGES = {(0, 3), (1, 3), (2, 5), (3, 6), (4, 7), (4, 8), (5, 9)}


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(500 + i, 501 + i) for i in range(60)] + [(7, 7)]
    parent = {n: n for e in edges if e[0] != e[1] for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame([*edges, (None, 3)], "src long, dst long")).collect()}
    assert got == {n: find(n) for n in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def members(spark):
    return spark.createDataFrame(TRACKER, "timestep int, halo_tag long, id long")


def test_golden_tree(spark):
    nodes, edges = mergertree.build_tree(members(spark), 50)
    got = {r["node_id"]: (r["timestep"], r["halo_tag"], r["zombie"], r["event_mask"]) for r in nodes.collect()}
    assert got == TREE
    assert {tuple(r) for r in edges.collect()} == EDGES
    lines = {r["node_id"]: r["line"] for r in mergertree.text_lines(nodes, edges).collect()}
    assert lines[7] == "7\t2.1\tSPLIT|CONTINUATION\t4\tFINAL TIMESTEP"


def test_rebirth(spark):
    rows = [(0, 1, 1), (0, 1, 2), (0, 2, 9), (1, 2, 9), (2, 5, 1), (2, 5, 2), (2, 2, 9)]
    nodes, _ = mergertree.build_tree(spark.createDataFrame(rows, "timestep int, halo_tag long, id long"), 50)
    assert {r["event_mask"] for r in nodes.filter("timestep = 2 AND halo_tag = 5").collect()} == {4 | 32}


def test_stream_equals_batch(spark, tmp_path):
    for step in range(3):
        members(spark).filter(F.col("timestep") == step).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    t = track_files(spark, str(tmp_path / "in"), str(tmp_path / "cp"), 50)
    got = {r["node_id"]: (r["timestep"], r["tag"], r["zombie"], r["event_mask"]) for n in t.nodes for r in n.collect()}
    assert got == TREE


@pytest.mark.parametrize("order", ["<", ">"])
def test_binary_sources(spark, tmp_path, order):
    rng = np.random.default_rng(2)
    cols = {c: rng.random(50).astype("f4") for c in snapshots.COLUMNS[:6]} | {"mass": np.full(50, 2.0), "id": np.arange(50) + 2**40}
    (tmp_path / "a.cosmo").write_bytes(snapshots.record_bytes(cols, "i8", order))
    (tmp_path / "b.gadget").write_bytes(snapshots.block_bytes(cols, order=order))
    snapshots.register(spark)
    for kind, name in (("particle_records", "a.cosmo"), ("particle_blocks", "b.gadget")):
        got = spark.read.format(kind).option("path", str(tmp_path / name)).option("order", order).option("split", "7").load().orderBy("id").toPandas()
        for c in snapshots.COLUMNS:
            np.testing.assert_allclose(got[c].to_numpy(), np.asarray(cols[c], float if c != "id" else np.int64))


def test_config_round_trip():
    text = "VERSION 1\nANALYSISTOOL HALOFINDER YES\nANALYSISTOOL TESS off\n# a note\n# HALOFINDER SECTION\nBB 0.2\nFREQUENCY_TYPE EXPLICIT\nTIMESTEPS 3 5\n"
    c = config.parse(text)
    assert config.parse(config.write(c)) == c
    own = c.sections["HALOFINDER"]
    assert c.tools == {"HALOFINDER": True, "TESS": False} and own.number("bb") == 0.2 and own.due(5) and not own.due(4)


def test_config_runs_halo_finder(spark):
    p = spark.createDataFrame([(1, i, x, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, float(i)) for i, x in enumerate((0.0, 0.1, 0.2, 0.9))], "timestep int, id long, x double, y double, z double, vx double, vy double, vz double, mass double, potential double")
    out = config.run(config.parse("ANALYSISTOOL HALOFINDER YES\n# HALOFINDER SECTION\nBB 0.15\nPMIN 2\n"), p)
    (row,) = out["HALOFINDER", 1].collect()
    assert (row["halo_tag"], row["fof_halo_count"], row["min_potential_id"]) == (0, 3, 0)


def test_unit_cube_functionals():
    cube = [c for _, c in voronoi._cube(np.zeros(3), np.ones(3))]
    s, v, _, x = voronoi.polyhedron_functionals(cube)
    assert (round(s, 9), round(v, 9), x) == (6.0, 1.0, 2)


def test_voronoi_fills_the_box(spark):
    rng = np.random.default_rng(4)
    grid = np.stack(np.meshgrid(*[np.arange(4)] * 3), -1).reshape(-1, 3) / 4 + 0.125 + rng.uniform(-0.05, 0.05, (64, 3))
    p = spark.createDataFrame([(i, *map(float, g)) for i, g in enumerate(grid)], "id long, x double, y double, z double")
    cells = voronoi.cells(p, 1.0, 2, 0.45).toPandas()
    assert cells["complete"].all() and abs(cells["volume"].sum() - 1) < 1e-9


def test_undistorted_lattice_has_one_stream(spark):
    tets = probe.placed(probe.tetrahedra(spark, 4), probe.displaced(probe.lattice(spark, 4), 4, 0.0))
    assert abs(tets.agg(F.sum("volume")).first()[0] - 1) < 1e-12
    assert tets.filter("volume <= 0").count() == 0
    inner = probe.probe_grid(spark, 5).withColumns({"x": F.col("x") + 0.013, "y": F.col("y") + 0.027, "z": F.col("z") - 0.031})
    assert {r["streams"] for r in probe.probe(inner, tets, 0.3).collect()} == {1}
    assert probe.caustics(tets).count() == 0


def test_extent_split():
    parts = probe.split_extent((0, 8, 0, 4, 0, 4), 4)
    assert len(parts) == 4 and parts[0] == (0, 4, 0, 2, 0, 4) or len(set(parts)) == 4


def test_empty_particles(spark):
    p = spark.createDataFrame([], "id long, x double, y double, z double")
    assert halos.membership(p, 0.1).count() == 0


def test_event_names(spark):
    row = spark.range(1).select(expr.event_names(F.lit(37)).alias("e"), expr.int_set(F.lit(" 3 1  3")).alias("i")).first()
    assert row["e"] == "SPLIT|CONTINUATION|REBIRTH" and row["i"] == [1, 3]
