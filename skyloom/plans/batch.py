"""The batch run over one snapshot: keyword file in, groups, centers, overdensity halos, substructure and files out.

A keyword file has a keyword and its value on each line; lines that begin with # and unknown keywords are left out.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions.expr import particle_mass, unit_mass, wrap
from skyloom.functions.files import read_text
from skyloom.operators import halos, subhalo
from skyloom.plans.timers import Timers
from skyloom.sources import sinks, snapshots

#: Critical density in solar masses per cubed megaparsec, the mass gate and unit of overdensity halos.
RHO_C, MIN_SOD_MASS, SOD_MASS, SOD_BINS = 2.77536627e11, 5e12, 1e14, 20


@dataclass
class Input:
    """The keywords, in lower case, and what holds where a file does not say."""

    input_base_name: str = ""
    output_base_name: str = ""
    input_type: str = "RECORD"
    distribute_type: str = "ROUND_ROBIN"
    mass_convert_factor: float = 1.0
    dist_convert_factor: float = 1.0
    rhoc_convert_factor: float = 1.0
    sod_mass_convert_factor: float = 1.0
    box_size: float = 1.0
    overload_size: float = 0.0
    number_of_particles: int = 1
    minimum_particle_distance: float = 0.2
    minimum_neigh_for_linking: int = 1
    minimum_particles_per_halo: int = 10
    omegadm: float = 0.22
    hubble_constant: float = 0.71
    deut: float = 0.02258
    num_sph_density: int = 64
    num_subhalo_neighbors: int = 20
    min_subhalo_size: int = 20
    min_fof_subhalo: int = 1000
    alpha_subhalo: float = 1.0
    beta_subhalo: float = 0.0
    use_mcp_center_finder: int = 0
    use_mbp_center_finder: int = 0
    use_minimum_potential: int = 0
    output_particles: int = 0
    output_halo_catalog: int = 0
    output_fof_properties: int = 0
    output_sod_properties: int = 0
    output_subhalo_properties: int = 0
    minimum_particles_per_output_halo: int = 0
    output_particle_fraction: float = 1.0
    output_particle_pos_vel: int = 1

    @property
    def center(self) -> str:
        """The method of centers: of several that are asked for, the potential minimum first, then the most connected."""
        if self.use_minimum_potential:
            return "POTENTIAL"
        return "MCP" if self.use_mcp_center_finder else "MBP" if self.use_mbp_center_finder else "CENTER_OF_MASS"

    @property
    def spacing(self) -> float:
        """Mean distance of particles; number_of_particles counts them along a side of the box."""
        return self.box_size / self.number_of_particles


def parse(text: str) -> Input:
    kinds = {f.name: {"str": str, "float": float, "int": lambda v: int(float(v))}[f.type] for f in fields(Input)}
    out = Input()
    for line in text.splitlines():
        words = line.split()
        if len(words) >= 2 and not line.startswith("#") and words[0].lower() in kinds:
            setattr(out, words[0].lower(), kinds[words[0].lower()](words[1]))
    return out


def read(spark: SparkSession, own: Input) -> DataFrame:
    """The snapshot's particles in the run's units, on the torus; potential is 0 where files have none."""
    snapshots.register(spark)
    kind = "particle_records" if own.input_type.upper() == "RECORD" else "particle_blocks"
    raw = spark.read.format(kind).option("path", own.input_base_name).load()
    mass = particle_mass(RHO_C * own.rhoc_convert_factor, own.box_size, own.number_of_particles, own.omegadm, own.deut, own.hubble_constant) / own.mass_convert_factor
    at = {a: wrap(F.col(a) * F.lit(own.dist_convert_factor), own.box_size) for a in "xyz"}
    return raw.withColumns(at | {"mass": unit_mass(F.col("mass") * F.lit(own.mass_convert_factor), mass), "potential": F.lit(0.0)})


def run(points: DataFrame, own: Input, timers: Timers | None = None) -> dict[str, DataFrame]:
    """The tables that the input asks for: members, fof, centers always; particles, catalog, fof_lines, sod, sod_profile,
    subhalos, subhalo_properties where their output is on. Groups link below the particle distance times the spacing; a
    search that cannot be made of lazy tables is timed, if timers are given."""
    timers = timers or Timers()
    radius = own.minimum_particle_distance * own.spacing
    with timers.event("fof"):
        if own.minimum_neigh_for_linking > 1:
            members = halos.membership_of(points, halos.linked_by_neighbours(points, radius, own.minimum_neigh_for_linking), own.minimum_particles_per_halo)
        else:
            members = halos.membership(points, radius, own.minimum_particles_per_halo)
    inside = halos.halo_particles(points, members)
    fof = halos.properties(inside)
    centers = halos.chosen_center(inside, own.center, radius)
    out = {"members": members, "fof": fof, "centers": centers}
    if own.output_particles:
        out["particles"] = sinks.tagged_particles(points, members, own.minimum_particles_per_output_halo, own.output_particle_fraction, bool(own.output_particle_pos_vel))
    if own.output_halo_catalog:
        out["catalog"] = sinks.halo_catalog(inside)
    if own.output_fof_properties:
        out["fof_lines"] = sinks.property_lines(fof)
    if own.output_sod_properties:
        with timers.event("sod"):
            heavy = halos.massive(fof, MIN_SOD_MASS * own.sod_mass_convert_factor).select("halo_tag", "fof_halo_mass", *(F.col(f"fof_halo_mean_v{a}").alias(f"mean_v{a}") for a in "xyz")).join(centers, "halo_tag")
            heavy = halos.overdensity_radii(heavy, own.spacing, SOD_MASS * own.sod_mass_convert_factor, (0.0,) * 3, (own.box_size,) * 3).filter("r_max > r_min")
            profile = halos.overdensity_profile(heavy, points, None, None, SOD_BINS, RHO_C * own.rhoc_convert_factor)
        out |= {"sod": halos.overdensity_radius(profile), "sod_profile": halos.profile_without_core(profile)}
    if own.output_subhalo_properties:
        large = halos.with_substructure(inside, own.min_fof_subhalo)
        out["subhalos"] = subhalo.subhalos(large, gravity=subhalo.GRAVITY)
        out["subhalo_properties"] = subhalo.properties(out["subhalos"], large)
    return out


def run_file(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Read a keyword file and its snapshot, run, and write each table under the output name; what was written is returned."""
    own = parse(read_text(path) or "")
    tables = run(read(spark, own), own)
    return {name: sinks.saved(df, f"{own.output_base_name}.{name}") for name, df in tables.items()}
