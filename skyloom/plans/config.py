"""Tool configuration as text, and the tools it names run over snapshots.

Lines are `KEY value`; `ANALYSISTOOL name YES` lists tools; a `# name SECTION` line opens a tool's own parameters; other
lines that begin with # are comments. What is written can be read again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions.expr import YES_WORDS
from skyloom.functions.files import read_text
from skyloom.plans.timers import Timers


@dataclass
class Section:
    name: str
    values: dict[str, str] = field(default_factory=dict)

    def text(self, key: str, default: str | None = None) -> str | None:
        return self.values.get(key.upper(), default)

    def integer(self, key: str, default: int | None = None) -> int | None:
        v = self.text(key)
        return default if v is None else int(v)

    def number(self, key: str, default: float | None = None) -> float | None:
        v = self.text(key)
        return default if v is None else float(v)

    def yes(self, key: str, default: bool = False) -> bool:
        v = self.text(key)
        return default if v is None else v.strip().upper() in YES_WORDS

    def integers(self, key: str) -> set[int]:
        return {int(x) for x in (self.text(key) or "").split()}

    def due(self, step: int) -> bool:
        """EXPLICIT lists steps; otherwise every FREQUENCY-th."""
        if (self.text("FREQUENCY_TYPE") or "IMPLICIT").upper() == "EXPLICIT":
            return step in self.integers("TIMESTEPS")
        return step % max(1, self.integer("FREQUENCY", 1)) == 0


@dataclass
class Config:
    top: Section
    tools: dict[str, bool]
    sections: dict[str, Section]


def parse(text: str) -> Config:
    """Read a configuration; a key given twice keeps its last value."""
    top, tools, sections = Section(""), {}, {}
    at = top
    for line in text.splitlines():
        words = line.split()
        if len(words) == 3 and words[0] == "#" and words[2].upper() == "SECTION":
            at = sections.setdefault(words[1].upper(), Section(words[1].upper()))
        elif not words or words[0].startswith("#"):
            continue
        elif words[0].upper() == "ANALYSISTOOL" and len(words) >= 3:
            tools[words[1].upper()] = words[2].upper() in YES_WORDS
        else:
            at.values[words[0].upper()] = " ".join(words[1:])
    return Config(top, tools, sections)


def write(config: Config) -> str:
    """The text of a configuration."""
    lines = [f"{k} {v}" for k, v in config.top.values.items()]
    lines += [f"ANALYSISTOOL {name} {'YES' if on else 'NO'}" for name, on in config.tools.items()]
    for s in config.sections.values():
        lines += ["", f"# {s.name} SECTION", *(f"{k} {v}" for k, v in s.values.items())]
    return "\n".join(lines) + "\n"


def parse_parameters(text: str) -> dict[str, str]:
    """Two-word lines of a simulation's input or a keyword file; others are left out."""
    return {w[0]: w[1] for w in (line.split() for line in text.splitlines()) if len(w) == 2 and not w[0].startswith("#")}


TOOLS: dict[str, Callable[[DataFrame, Section], DataFrame]] = {}


def tool(name: str):
    """Register a tool: a function of a snapshot's particles and its section."""

    def add(f):
        TOOLS[name.upper()] = f
        return f

    return add


@tool("HALOFINDER")
def find_halos(particles: DataFrame, own: Section) -> DataFrame:
    """Groups with at least PMIN members linked below BB times the mean spacing RL / NP, their properties and centers."""
    from skyloom.operators import halos

    radius = own.number("BB", 0.2) * own.number("RL", 1.0) / own.number("NP", 1.0)
    inside = halos.halo_particles(particles, halos.membership(particles, radius, own.integer("PMIN", 1)))
    out = halos.properties(inside)
    method = (own.text("CENTER_FINDER_METHOD") or "CENTER_OF_MASS").upper()
    return out.join(halos.chosen_center(inside, method, radius), "halo_tag", "left")


@tool("TESS")
def tessellate(particles: DataFrame, own: Section) -> DataFrame:
    from skyloom.operators import voronoi

    return voronoi.cells(particles, own.number("RL", 1.0), own.integer("BLOCKS", 2), own.number("GHOST", 0.25))


@tool("HALOTRACKER")
def track(members: DataFrame, own: Section) -> DataFrame:
    from skyloom.operators import mergertree

    return mergertree.build_tree(members, own.integer("MERGER_TREE_THRESHOLD", 50), own.integer("ZOMBIE_CUT_OFF", 5))[0]


@tool("SFPROBE")
def probe(particles: DataFrame, own: Section) -> DataFrame:
    """Streams at a grid of points; particles carry the lattice node as id."""
    from skyloom.operators import probe as p

    cells = own.integer("CELLS")
    spark = particles.sparkSession
    tets = p.placed(p.inside_fringe(p.tetrahedra(spark, cells), cells, own.integer("FRINGE", 0)), particles.withColumnRenamed("id", "node_id"))
    return p.probe(p.probe_grid(spark, own.integer("GRID", 8)), tets, own.number("BUCKET", 0.25))


class Scheduler:
    """Runs the tools of a configuration file step by step; the file is read anew at each step, so that what changes in it
    holds from the next step on."""

    def __init__(self, path: str, timers: Timers | None = None):
        self.path, self.timers = path, timers or Timers()

    def step(self, particles: DataFrame, step: int) -> dict[str, DataFrame]:
        """The results of the tools that are on and due."""
        config, out = parse(read_text(self.path) or ""), {}
        for name, on in config.tools.items():
            own = config.sections.get(name, Section(name))
            if on and own.due(step):
                if name not in TOOLS:
                    raise ValueError(f"no tool named {name}")
                with self.timers.event(name, step):
                    out[name] = TOOLS[name](particles, own)
        return out


def run(config: Config, snapshots: DataFrame, step_col: str = "timestep") -> dict[tuple[str, int], DataFrame]:
    """The results of the tools that are on and due at each snapshot."""
    steps = sorted(r[0] for r in snapshots.select(step_col).distinct().collect())
    out = {}
    for name, on in config.tools.items():
        own = config.sections.get(name, Section(name))
        if not on:
            continue
        if name not in TOOLS:
            raise ValueError(f"no tool named {name}")
        for step in steps:
            if own.due(step):
                out[name, step] = TOOLS[name](snapshots.filter(F.col(step_col) == step).drop(step_col), own)
    return out
