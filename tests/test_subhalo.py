"""Unbinding and properties of subhalos on a halo with one fast particle."""

import numpy as np
import pytest

from skyloom import catalog
from skyloom.operators import subhalo

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def halo(spark):
    xyz = np.random.default_rng(4).normal(0, 0.05, (20, 3)).tolist()
    rows = [(1, i, *p, 50.0 if i == 7 else 0.0, 0.0, 0.0) for i, p in enumerate(xyz)]
    return spark.createDataFrame(rows, "halo_tag long, id long, x double, y double, z double, vx double, vy double, vz double")


def test_fast_particle_is_unbound(spark, halo):
    got = {r["id"]: r["subhalo"] for r in subhalo.subhalos(halo, least=20, gravity=0.0).collect()}
    kept = {r["id"]: r["subhalo"] for r in subhalo.subhalos(halo, gravity=1.0).collect()}
    assert got[7] >= 0 and kept[7] == -1 and sum(v >= 0 for v in kept.values()) >= 10
    xyz, v = np.zeros((4, 3)), np.zeros((4, 3))
    xyz[:, 0], v[3] = [0, 1, 2, 3], [9, 0, 0]
    assert subhalo.unbound(xyz, v, 1.0, 1.0).tolist() == [0, 1, 2]


def test_properties_of_subhalos(spark, halo):
    found = subhalo.subhalos(halo, gravity=1.0)
    rows = {(r["id"]): r for r in halo.collect()}
    own = {}
    for r in found.collect():
        if r["subhalo"] >= 0:
            own.setdefault(r["subhalo"], []).append(rows[r["id"]])
    got = {r["subhalo"]: r for r in subhalo.properties(found, halo).collect()}
    assert set(got) == set(own)
    for k, members in own.items():
        assert got[k]["subhalo_count"] == len(members) and got[k]["subhalo_mass"] == len(members)
        assert abs(got[k]["subhalo_mean_x"] - np.mean([m["x"] for m in members])) < 1e-12
        assert got[k]["subhalo_vel_disp"] == 0.0


def test_registered_query_unbinds(spark, monkeypatch):
    seen = []
    real = subhalo.subhalos
    monkeypatch.setattr(subhalo, "subhalos", lambda own, **named: seen.append(named) or real(own, **named))
    catalog.QUERIES["subhalos"](spark, SF)
    assert seen[0]["gravity"] > 0
