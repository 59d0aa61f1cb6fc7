"""Column functions of particle analysis: geometry, periodicity, cosmology, event bits and parsing."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
#: The bits of tree events, lowest first.
EVENTS = {"SPLIT": 1, "MERGE": 2, "CONTINUATION": 4, "BIRTH": 8, "DEATH": 16, "REBIRTH": 32}
#: Words that mean yes in a configuration.
YES_WORDS = ("YES", "TRUE", "ON", "ENABLED")


def dist2(a: str = "", b: str = "") -> Column:
    """Squared distance of the points with column prefixes a and b."""
    return sum(((F.col(f"{a}{c}") - F.col(f"{b}{c}")) * (F.col(f"{a}{c}") - F.col(f"{b}{c}")) for c in AXES[1:]), (F.col(f"{a}x") - F.col(f"{b}x")) * (F.col(f"{a}x") - F.col(f"{b}x")))


def periodic_gap(a: Column, b: Column, box: float) -> Column:
    """Distance along an axis on a ring of length box."""
    d = F.abs(a - b)
    return F.least(d, F.lit(box) - d)


def wrap(x: Column, box: float) -> Column:
    """One subtraction for positions at or above the box; negatives stay."""
    return F.when(x >= box, x - box).otherwise(x)


def grid_index(i: Column, j: Column, k: Column, ni: int, nj: int) -> Column:
    """Linear index, i fastest."""
    return (k * nj + j) * ni + i


def redshift(step: Column, z_in: float, z_fin: float, steps: int, alpha: float) -> Column:
    """Redshift after a step of equal size in the power alpha of the expansion factor."""
    first, last = (1 / (1 + z_in)) ** alpha, (1 / (1 + z_fin)) ** alpha
    return F.pow(F.lit(first) + (step + 1) * F.lit((last - first) / steps), F.lit(-1 / alpha)) - 1


def particle_mass(rho_c: float, box: float, np: int, omega_dm: float, deut: float, hubble: float) -> float:
    """Mass of one of np**3 particles that fill a box at the given matter density."""
    return rho_c * box**3 * (omega_dm + deut / hubble**2) / np**3


def event_names(mask: Column) -> Column:
    """The names of a mask's bits, lowest first, joined by a bar."""
    return F.concat_ws("|", *(F.when(mask.bitwiseAND(bit) != 0, F.lit(name)) for name, bit in EVENTS.items()))


def set_event(mask: Column, name: str) -> Column:
    return mask.bitwiseOR(EVENTS[name])


def unset_event(mask: Column, name: str) -> Column:
    return mask.bitwiseAND(~EVENTS[name])


def is_event(mask: Column, name: str) -> Column:
    return mask.bitwiseAND(EVENTS[name]) != 0


def parse_yes(text: Column) -> Column:
    return F.coalesce(F.upper(F.trim(text)).isin(*YES_WORDS), F.lit(False))


def int_set(text: Column) -> Column:
    """The distinct integers of a list separated by white space, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(F.split(text, r"\s+"), lambda s: s != ""), lambda s: s.cast("int"))))


def triggered(step: Column, explicit: list[int] | None = None, every: int | None = None) -> Column:
    """Whether a tool runs at a step: one of the explicit ones, or each `every`-th."""
    if explicit is not None:
        return step.isin(*explicit) if explicit else F.lit(False)
    return step % every == 0


def determinant3(a, b, c) -> Column:
    """a . (b x c) of three column triples."""
    return a[0] * (b[1] * c[2] - b[2] * c[1]) + a[1] * (b[2] * c[0] - b[0] * c[2]) + a[2] * (b[0] * c[1] - b[1] * c[0])


def tet_volume(p0, p1, p2, p3) -> Column:
    """Signed volume of a tetrahedron by its corners."""
    edge = lambda p: [p[i] - p0[i] for i in range(3)]
    return determinant3(edge(p1), edge(p2), edge(p3)) / 6


def sph_kernel(r: Column, h: Column) -> Column:
    """Cubic spline of support h, 8 / (pi h^3) at the middle."""
    u, scale = r / h, F.lit(8 / math.pi) / (h * h * h)
    inner = scale * (1 - 6 * u * u + 6 * u * u * u)
    outer = scale * 2 * (1 - u) * (1 - u) * (1 - u)
    return F.when(u <= 0.5, inner).when(u <= 1, outer).otherwise(0.0)


def natural_spline(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Second derivatives of the cubic through (x, y), x rising, that has none at its ends."""
    n = len(x)
    out = np.zeros(n)
    if n > 2:
        h = np.diff(x)
        slope = np.diff(y) / h
        band = np.diag(2 * (h[:-1] + h[1:])) + np.diag(h[1:-1], 1) + np.diag(h[1:-1], -1)
        out[1:-1] = np.linalg.solve(band, 6 * np.diff(slope))
    return out


def spline_at(x: np.ndarray, y: np.ndarray, second: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Values of the cubic at the places `at`; outside x the end pieces go on."""
    i = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(x) - 2)
    h = x[i + 1] - x[i]
    a, b = (x[i + 1] - at) / h, (at - x[i]) / h
    return a * y[i] + b * y[i + 1] + ((a**3 - a) * second[i] + (b**3 - b) * second[i + 1]) * h * h / 6


def in_periodic_fringe(position: list[Column], low: list[float], high: list[float], percent: float) -> Column:
    """Whether a point lies in the outer band of a box, so many per cent of each side wide; the band's inner face is out."""
    out = F.lit(False)
    for c, lo, hi in zip(position, low, high):
        band = (hi - lo) * percent / 100.0
        out = out | (c < lo + band) | (c > hi - band)
    return out


def extent_dimensions(extent: list[Column]) -> list[Column]:
    """Nodes along each axis of an extent (low and high, inclusive, by axis)."""
    return [extent[2 * a + 1] - extent[2 * a] + 1 for a in range(3)]


def extent_nodes(extent: list[Column]) -> Column:
    i, j, k = extent_dimensions(extent)
    return i * j * k


def extent_cells(extent: list[Column]) -> Column:
    i, j, k = extent_dimensions(extent)
    return (i - 1) * (j - 1) * (k - 1)


def is_3d(extent: list[Column]) -> Column:
    """Whether an extent has cells along each axis."""
    return (extent[1] > extent[0]) & (extent[3] > extent[2]) & (extent[5] > extent[4])


def node_key(timestep: Column, tag: Column) -> Column:
    """The key of a group in a tree: its snapshot and tag, by a dot."""
    return F.concat_ws(".", timestep.cast("string"), tag.cast("string"))


def unit_mass(mass: Column, particle: float) -> Column:
    """Masses of 1 stand for the particle mass."""
    return F.when(mass == 1.0, F.lit(particle)).otherwise(mass)
