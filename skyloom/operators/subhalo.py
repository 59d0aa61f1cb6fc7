"""Substructure of halos: neighbours, smoothed densities, grouping in order of density, and unbinding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The gravitational constant of the registered queries: one, as tables have no physical units (with Mpc, km/s and solar
#: masses the survey's source has 43.015e-10).
GRAVITY = 1.0


def kernel_density(xyz: np.ndarray, k: int, mass: float) -> tuple[np.ndarray, np.ndarray]:
    """Density by the spline over the k nearest, and the neighbours of each, nearest first. In blocks of rows."""
    n = len(xyz)
    k = min(k, n - 1)
    density, near = np.zeros(n), np.zeros((n, k), np.int64)
    for at in range(0, n, 512):
        d = np.linalg.norm(xyz[at : at + 512, None] - xyz[None], axis=2)
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        order = np.argsort(d, axis=1, kind="stable")[:, :k]
        r = np.take_along_axis(d, order, 1)
        h = np.maximum(r[:, -1:], 1e-300)
        u = r / h
        w = np.where(u <= 0.5, 1 - 6 * u**2 + 6 * u**3, 2 * (1 - u) ** 3) * 8 / (np.pi * h**3)
        density[at : at + 512] = mass * w.sum(1)
        near[at : at + 512] = order
    return density, near


def grow_groups(density: np.ndarray, near: np.ndarray, grouping: int, least: int) -> np.ndarray:
    """A group number for each particle, in order of falling density.

    A particle with no denser neighbour among its nearest starts a group; with one it joins; where it touches two, it is
    a saddle: the smaller group is kept apart if it has `least` members by then, else absorbed into the larger."""
    n = len(density)
    parent, size = np.full(n, -1), np.zeros(n, int)
    root = np.arange(n)

    def find(g):
        while root[g] != g:
            root[g] = root[root[g]]
            g = root[g]
        return g

    rank = np.empty(n, int)
    order = np.lexsort((np.arange(n), -density))
    rank[order] = np.arange(n)
    for p in order:
        denser = [q for q in near[p, :grouping] if rank[q] < rank[p]][:2]
        groups = list(dict.fromkeys(find(parent[q]) for q in denser))
        if not groups:
            parent[p] = p
            size[p] = 1
            continue
        groups.sort(key=lambda g: -size[g])
        if len(groups) == 2 and size[groups[1]] < least:
            root[groups[1]] = groups[0]
            size[groups[0]] += size[groups[1]]
        parent[p] = groups[0]
        size[groups[0]] += 1
    return np.array([find(g) for g in parent])


def _inverse_distances(xyz: np.ndarray) -> np.ndarray:
    """Of each point the sum of one over its distance to every other; in blocks of rows."""
    out = np.zeros(len(xyz))
    for at in range(0, len(xyz), 512):
        d = np.linalg.norm(xyz[at : at + 512, None] - xyz[None], axis=2)
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        out[at : at + 512] = (1 / np.maximum(d, 1e-12)).sum(1)
    return out


def unbound(xyz: np.ndarray, v: np.ndarray, mass: float, gravity: float) -> np.ndarray:
    """Which particles stay bound: those of positive energy go in rounds, the worst first (one, or a quarter of them
    when there are many), until none is left over."""
    keep = np.arange(len(xyz))
    while len(keep) > 1:
        energy = 0.5 * ((v[keep] - v[keep].mean(0)) ** 2).sum(1) - gravity * mass * _inverse_distances(xyz[keep])
        bad = np.flatnonzero(energy > 0)
        if not len(bad):
            break
        worst = bad[np.argsort(-energy[bad], kind="stable")][: 1 if len(bad) < 8 else len(bad) // 4 + 1]
        keep = np.delete(keep, worst)
    return keep


def subhalos(own: DataFrame, k: int = 8, grouping: int = 4, least: int = 3, mass: float = 1.0, gravity: float = 0.0) -> DataFrame:
    """(halo_tag, id, subhalo): 0 the largest group of each halo, -1 for particles in none. A halo is one task's work, as
    the grouping is sequential; halos are bounded by the linking that made them. gravity 0 leaves all bound."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        xyz, v = pdf[["x", "y", "z"]].to_numpy(), pdf[["vx", "vy", "vz"]].to_numpy()
        out = np.full(len(pdf), -1)
        if len(pdf) >= 2:
            density, near = kernel_density(xyz, k, mass)
            groups = grow_groups(density, near, grouping, least)
            members = []
            for g in np.unique(groups):
                own = np.flatnonzero(groups == g)
                if gravity > 0:
                    own = own[unbound(xyz[own], v[own], mass, gravity)]
                if len(own) >= least:
                    members.append(own)
            for number, own in enumerate(sorted(members, key=lambda m: (-len(m), m[0]))):
                out[own] = number
        return pd.DataFrame({"halo_tag": pdf["halo_tag"], "id": pdf["id"], "subhalo": out})

    return own.select("halo_tag", "id", "x", "y", "z", "vx", "vy", "vz").groupBy("halo_tag").applyInPandas(run, "halo_tag long, id long, subhalo long")


def properties(found: DataFrame, own: DataFrame, mass: float = 1.0) -> DataFrame:
    """Per subhalo of `found`, by halo_tag and number: count, mass, mean position and velocity, velocity dispersion. All
    particles have the same mass, as in the unbinding, so the centre of mass is the mean position."""
    axes = [f"{v}{a}" for v in ("", "v") for a in "xyz"]
    means = [F.avg(a).alias(f"subhalo_mean_{a}") for a in axes]
    square = F.avg(F.expr("vx*vx + vy*vy + vz*vz")) - sum(F.avg(v) * F.avg(v) for v in axes[3:])
    spread = F.sqrt(F.greatest(F.lit(0.0), square / 3)).alias("subhalo_vel_disp")
    rows = found.filter("subhalo >= 0").join(own.select("id", "halo_tag", *axes), ["halo_tag", "id"])
    n = F.count("*")
    return rows.groupBy("halo_tag", "subhalo").agg(n.alias("subhalo_count"), (n * F.lit(mass)).alias("subhalo_mass"), *means, spread)
