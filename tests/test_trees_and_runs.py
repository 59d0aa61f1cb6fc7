"""Golden trees past the published fixture, restarts of the stream, the batch run, and small operators by brute force."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions import expr
from skyloom.operators import halos, mergertree, spatial, voronoi
from skyloom.plans import batch, config, tracking
from skyloom.plans.timers import Timers
from skyloom.sources import sinks, snapshots
from skyloom.streaming.tracker import StreamTracker, track_files

MEMBERS = "timestep int, halo_tag long, id long"


def _nodes(nodes):
    return {r["node_id"]: (r["timestep"], r["halo_tag"], r["zombie"], r["age"], r["event_mask"]) for r in nodes.collect()}


def test_zombie_past_the_cut_off_is_carried_but_not_matched(spark):
    rows = [(0, 1, 1), (0, 1, 2)] + [(t, 2, 9) for t in range(6)] + [(5, 7, 1), (5, 7, 2)]
    nodes, _ = mergertree.build_tree(spark.createDataFrame(rows, MEMBERS), 50, cutoff=2)
    got = set(_nodes(nodes).values())
    assert {(t, 1, True, t, 16) for t in range(1, 6)} <= got
    assert (5, 7, False, 0, 8) in got  # born, not reborn: its zombie was three steps old


def test_every_halo_dies_in_one_step(spark):
    rows = [(0, 1, 1), (0, 2, 2), (1, 5, 8), (2, 5, 8)]
    nodes, edges = mergertree.build_tree(spark.createDataFrame(rows, MEMBERS), 50)
    got = set(_nodes(nodes).values())
    assert {(1, 5, False, 0, 8), (1, 1, True, 1, 16), (1, 2, True, 1, 16), (2, 5, False, 0, 4)} <= got
    assert edges.count() == 5


def test_descendant_is_the_most_massive(spark):
    rows = [(0, 1, i) for i in range(10)] + [(1, 1, i) for i in range(3)] + [(1, 2, i) for i in range(3, 10)]
    members = spark.createDataFrame(rows, MEMBERS)
    nodes, edges = mergertree.build_tree(members, 20)
    by_tag = {(r["timestep"], r["halo_tag"]): r for r in nodes.collect()}
    assert by_tag[0, 1]["descendant_id"] == by_tag[1, 2]["node_id"]
    catalog = spark.createDataFrame([(0, 1, 5.0), (1, 1, 9.0), (1, 2, 7.0)], "timestep int, halo_tag long, halo_mass double")
    catalog = catalog.withColumns({c: F.lit(0.0) for c in sinks.TREE_COLUMNS[4:14]})
    table = sinks.tree_table(nodes, edges, catalog)
    assert table.columns == sinks.TREE_COLUMNS
    assert {r["tree_node_id"]: r["descendant_id"] for r in table.collect()}[by_tag[0, 1]["node_id"]] == by_tag[1, 1]["node_id"]


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    members = snapshots.synthetic_halos(spark)
    want, _ = mergertree.build_tree(members, 50)
    for step in range(3):
        members.filter(F.col("timestep") == step).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        tracker = track_files(spark, str(tmp_path / "in"), str(tmp_path / "cp"), 50)  # a new tracker each time
    got = {r["node_id"]: (r["timestep"], r["tag"], r["zombie"], r["age"], r["event_mask"]) for n in tracker.nodes for r in n.collect()}
    assert got == _nodes(want) and len(tracker.edges) == 2
    replayed = StreamTracker(spark, str(tmp_path / "cp" / "tracker"), 50)
    replayed(members.filter("timestep = 2"), 2)
    assert len(replayed.done) == 3
    with pytest.raises(ValueError):
        replayed(members.filter("timestep = 1"), 9)


def test_cells_called_complete_keep_their_volume(spark):
    rng = np.random.default_rng(8)
    p = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(rng.random((60, 3)))], "id long, x double, y double, z double")
    near, far = (voronoi.cells(p, 1.0, 2, depth).toPandas().set_index("id") for depth in (0.45, 0.5))
    done = near[near["complete"]]
    assert len(done) and np.allclose(done["volume"], far.loc[done.index, "volume"])


def test_most_bound_in_blocks_equals_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 3, *map(float, rng.random(3)), float(rng.integers(1, 5))) for i in range(120)]
    own = spark.createDataFrame(rows + [(500, 0, *rows[0][2:5], 1.0)], "id long, halo_tag long, x double, y double, z double, mass double")
    a, b = (sorted(map(tuple, f.withColumn("potential", F.round("potential", 6)).collect())) for f in (halos.most_bound(own), halos.most_bound_in_blocks(own, 16)))
    assert a == b


def test_batch_run_from_a_keyword_file(spark, tmp_path):
    rng = np.random.default_rng(1)
    middle = np.repeat(rng.random((4, 3)) * 8 + 1, 40, axis=0)
    xyz = middle + rng.normal(0, 0.05, middle.shape)
    cols = {c: xyz[:, i] for i, c in enumerate("xyz")} | {f"v{c}": rng.normal(0, 1, 160) for c in "xyz"} | {"mass": np.full(160, 2e12), "id": np.arange(160)}
    (tmp_path / "in.cosmo").write_bytes(snapshots.record_bytes(cols))
    text = f"# a note\nINPUT_BASE_NAME {tmp_path}/in.cosmo\nOUTPUT_BASE_NAME {tmp_path}/out\nBOX_SIZE 10\nNUMBER_OF_PARTICLES 10\nMINIMUM_PARTICLE_DISTANCE 0.3\nMINIMUM_PARTICLES_PER_HALO 20\nUSE_MBP_CENTER_FINDER 1\nUSE_MINIMUM_POTENTIAL 0\nUNKNOWN 3\n"
    text += "".join(f"OUTPUT_{x} 1\n" for x in ("PARTICLES", "HALO_CATALOG", "FOF_PROPERTIES", "SOD_PROPERTIES", "SUBHALO_PROPERTIES")) + "MIN_FOF_SUBHALO 30\n"
    (tmp_path / "run.txt").write_text(text)
    out = batch.run_file(spark, str(tmp_path / "run.txt"))
    assert batch.parse(text).center == "MBP" and set(out) == {"members", "fof", "centers", "particles", "catalog", "fof_lines", "sod", "sod_profile", "subhalos", "subhalo_properties"}
    assert sorted(r["fof_halo_count"] for r in out["fof"].collect()) == [40] * 4
    assert out["particles"].count() == 160 and out["sod_profile"].filter("bin = 0").count() == 0
    assert out["centers"].count() == 4 and out["subhalos"].select("halo_tag").distinct().count() == 4


def test_scheduler_reads_its_file_anew(spark, tmp_path):
    p = spark.createDataFrame([(i, x, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, float(i)) for i, x in enumerate((0.0, 0.1, 0.9))], "id long, x double, y double, z double, vx double, vy double, vz double, mass double, potential double")
    path = tmp_path / "tools.dat"
    path.write_text("ANALYSISTOOL HALOFINDER YES\n# HALOFINDER SECTION\nBB 0.15\nPMIN 2\n")
    timers = Timers()
    tools = config.Scheduler(str(path), timers)
    assert tools.step(p, 0)["HALOFINDER"].count() == 1
    path.write_text("ANALYSISTOOL HALOFINDER YES\n# HALOFINDER SECTION\nBB 0.95\nPMIN 1\nFREQUENCY 2\n")
    assert tools.step(p, 1) == {} and tools.step(p, 2)["HALOFINDER"].first()["fof_halo_count"] == 3
    assert [(r["event"], r["runs"]) for r in timers.totals(spark).collect()] == [("HALOFINDER", 2)]


def test_spline_passes_through_its_points_and_is_natural():
    x = np.array([0.0, 1.0, 2.5, 4.0, 7.0])
    y = np.sin(x)
    second = expr.natural_spline(x, y)
    assert second[0] == second[-1] == 0 and np.allclose(expr.spline_at(x, y, second, x), y)
    e = 1e-5
    for k in x[1:-1]:  # slope and curvature do not jump
        f = lambda t: expr.spline_at(x, y, second, np.array([t]))[0]  # noqa: E731, B023
        assert abs((f(k + e) - f(k)) / e - (f(k) - f(k - e)) / e) < 1e-4
    assert np.allclose(expr.spline_at(x, 2 * x + 1, expr.natural_spline(x, 2 * x + 1), np.array([0.3, 6.0])), [1.6, 13.0])


def test_sources_by_uri_and_bounds(spark, tmp_path):
    cols = {c: np.linspace(0, 1, 9) for c in snapshots.COLUMNS[:7]} | {"id": np.arange(9)}
    for name in ("a", "b"):
        (tmp_path / f"{name}.cosmo").write_bytes(snapshots.record_bytes(cols))
    snapshots.register(spark)
    for path, n in ((f"file://{tmp_path}", 18), (f"{tmp_path}/a*", 9), (f"file://{tmp_path}/b.cosmo", 9)):
        assert spark.read.format("particle_records").option("path", path).load().count() == n
    assert spark.read.format("particle_records").option("path", str(tmp_path)).option("split", "file").load().rdd.getNumPartitions() == 2
    points = spark.read.format("particle_records").option("path", f"{tmp_path}/a.cosmo").load()
    assert snapshots.reject_outside(points, 1.0).agg(F.sum("x")).first()[0] > 0
    with pytest.raises(Exception, match="beyond the box"):
        snapshots.reject_outside(points, 0.5).agg(F.sum("x")).first()
    (tmp_path / "steps.txt").write_text("5 3\n\n11\n")
    assert snapshots.time_steps(spark, str(tmp_path / "steps.txt")) == [3, 5, 11]


def test_tree_formats(spark, tmp_path):
    table = spark.createDataFrame([(1, "a")], "k long, v string")
    for kind in (0, 1, 2, "9", "x"):
        assert [tuple(r) for r in sinks.write_tree(table, str(tmp_path / f"t{kind}"), kind).collect()] == [(1, "a")]


def test_text_of_overdensity_and_subhalos(spark):
    sod = spark.createDataFrame([(7, 3, 0.5, 2.0)], "halo_tag long, sod_count long, sod_radius double, sod_mass double")
    profile = spark.createDataFrame([(7, b, 1, 1.0, 0.1, 2.0, 0.0) for b in (2, 1)], "halo_tag long, bin int, n long, m double, radius double, rho_ratio double, rad_vel double")
    lines = sinks.overdensity_lines(sod, profile).first()["text"].split("\n")
    assert lines[0] == "Halo 7" and [x.split()[1] for x in lines[4:]] == ["1", "2"]


def test_ghost_planes_of_one_block_are_the_whole_rim(spark):
    got = spatial.grid_ghosts(spark, 4, 1, 1, 1)
    assert got.count() == 6**3 - 4**3 and got.filter("cell < 0 OR cell >= 64").count() == 0


def test_state_of_a_step_is_plain_json(tmp_path, spark):
    tracker = StreamTracker(spark, str(tmp_path / "t"), 50)
    tracker(spark.createDataFrame([(0, 1, 1)], MEMBERS), 0)
    assert json.loads((tmp_path / "t" / "0.json").read_text())["step"] == 0


def test_tracking_finds_groups_of_each_snapshot(spark):
    rows = [(t, 2.0 - t, 10 * g + i, g + 0.01 * i + 0.02 * t, 0.0, 0.0, 0.1, 0.0, 0.0, 1.0 + g, 0.0) for t in range(3) for g in range(3) for i in range(4)]
    names = "timestep int, redshift double, id long, x double, y double, z double, vx double, vy double, vz double, mass double, potential double"
    tree = tracking.track(spark.createDataFrame(rows, names), 0.05, 3)
    got = {(r["timestep"], r["halo_tag"]): r for r in tree.collect()}
    assert set(got) == {(t, 10 * g) for t in range(3) for g in range(3)} and got[1, 10]["halo_mass"] == 8.0 and got[2, 0]["redshift"] == 0.0
    assert got[0, 20]["descendant_id"] == got[1, 20]["tree_node_id"] and got[2, 20]["descendant_id"] == -1 and got[1, 0]["event_mask"] == 4


def test_simulation_input_and_redshift():
    own = config.parse_parameters("# a note\nZ_IN 200.0\nN_STEPS 300\nALPHA 1.0 extra\nRL 256\n")
    assert own == {"Z_IN": "200.0", "N_STEPS": "300", "RL": "256"}
