"""Registered queries against their SQL on the smallest tables."""

import math

import duckdb
import pytest

from skyloom import catalog_files as catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHEAP = [
    "fof_pairs", "fof_membership", "fof_halo_catalog", "halo_mcp_center", "halo_mbp_center", "sod_profile", "density_profile",
    "overlap_matrix", "merger_events", "merger_deaths", "ghost_exchange", "grid_exchange", "redshift_schedule", "triggers_and_bits",
    "euler_mesh", "caustic_faces", "face_adjacency", "fringe_tets", "probe_grid", "boundary_faces", "region_merge", "shapefinders",
    "volume_histogram", "knn_density", "record_roundtrip", "sod_radius", "sod_members", "sod_halos",
    "particle_sink", "halo_catalog_sink", "particle_text_sink", "one_halo_sink", "split_records_sink", "fof_text_sink",
    "sod_profile_by_mass", "halo_gates", "halo_mbp_in_blocks", "group_report", "group_report_particles", "jittered_particles",
    "voronoi_files", "voronoi_polyhedra", "voronoi_density_weighted", "read_with_ghosts", "synthetic_halos", "rehoming_3d",
    "grid_ghost_planes", "extents", "periodic_fringe", "node_keys", "particle_masses", "merger_tree", "merger_tree_counts",
    "merger_tree_text", "stream_merger_tree", "merger_tree_table", "probe_uniform", "tet_tessellation_by_index",
    "bucket_occupancy", "halo_sizes", "halo_information", "fof_pairs_periodic",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(catalog.ORACLE_SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda df: sorted(str(tuple(plain(v) for v in r)) for r in df[cols].astype(object).itertuples(index=False, name=None))
    assert rows(got) == rows(want)


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
