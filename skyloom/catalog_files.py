"""Registered queries of sources, sinks and the operators built on whole snapshots, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.catalog import CELLS, CORNERS, FOF_SQL, GRID, LEAST, LINK, MATCH, ORACLE_SQL, PLACED_SQL, QUERIES, SOD_SQL, TET_SQL, _own, _placed, query, rounded
from skyloom.functions import expr
from skyloom.functions.files import make_folder
from skyloom.functions.shared import shared_path
from skyloom.operators import halos, mergertree, probe, spatial, voronoi
from skyloom.sources import sinks, snapshots
from skyloom.sources.tables import MEMBERSHIP_SQL, PARTICLES_SQL, memberships, particles, table

_SAMPLE = "(((id % 2147483648) * 1103515245 + 12345) % 2147483648) < 644245094"


@query(f"WITH RECURSIVE {FOF_SQL} SELECT round(x,6) AS x, round(y,6) AS y, round(z,6) AS z, round(vx,6) AS vx, round(vy,6) AS vy, round(vz,6) AS vz, id, halo_tag AS fof_halo_tag FROM own WHERE halo_size >= 4 AND {_SAMPLE}")
def particle_sink(spark, sf_dir):
    p = particles(spark, sf_dir)
    out = sinks.tagged_particles(p, halos.membership(p, LINK, LEAST), 4, 0.3)
    return rounded(sinks.saved(out, shared_path(spark, "haloparticles")))


@query(f"""WITH RECURSIVE {FOF_SQL} SELECT halo_tag AS fof_halo_tag, round(sum(mass),6) AS fof_halo_mass, {', '.join(f'round(sum(mass*{a})/sum(mass),6) AS fof_halo_center_{a}' for a in 'xyz')},
 {', '.join(f'round(avg(v{a}),6) AS fof_halo_mean_v{a}' for a in 'xyz')} FROM own GROUP BY halo_tag""")
def halo_catalog_sink(spark, sf_dir):
    return rounded(sinks.saved(sinks.halo_catalog(_own(spark, sf_dir)), shared_path(spark, "halocatalog")))


@query(f"""WITH RECURSIVE {FOF_SQL}, l AS (SELECT p.id, coalesce(o.halo_tag, -1) AS tag, p.* EXCLUDE (id) FROM particles p LEFT JOIN own o USING (id))
SELECT id, {" || ' ' || ".join(f"printf('%.3f', round({c}, 3) + 0.0)" for a in 'xyz' for c in (a, 'v' + a))} || ' ' || tag || ' ' || id AS line FROM l""")
def particle_text_sink(spark, sf_dir):
    p = particles(spark, sf_dir).withColumns({c: F.round(c, 3) for c in ("x", "y", "z", "vx", "vy", "vz")})
    lines = sinks.particle_lines(p, halos.membership(particles(spark, sf_dir), LINK, LEAST), 3)
    return sinks.saved(lines, shared_path(spark, "ascii"))


@query(f"""WITH RECURSIVE {FOF_SQL} SELECT halo_tag, count(*) AS n, round(sum(mass),3) AS mass FROM own WHERE halo_size = (SELECT max(halo_size) FROM own)
 AND halo_tag = (SELECT min(halo_tag) FROM own WHERE halo_size = (SELECT max(halo_size) FROM own)) GROUP BY halo_tag""")
def one_halo_sink(spark, sf_dir):
    own = _own(spark, sf_dir)
    first = own.agg(F.min(F.struct((-F.col("halo_size")).alias("size"), "halo_tag")).alias("f")).select("f.*").first()
    folder = shared_path(spark, "one-halo")
    sinks.write_record_files(sinks.one_halo(own, first["halo_tag"], -first["size"]), folder).count()
    snapshots.register(spark)
    back = spark.read.format("particle_records").option("path", folder).load()
    return back.agg(F.lit(first["halo_tag"]).alias("halo_tag"), F.count("*").alias("n"), F.round(F.sum("mass"), 3).alias("mass"))


@query(f"""WITH {PARTICLES_SQL} SELECT CAST(floor((x+1)/0.25) AS BIGINT) AS block, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM particles GROUP BY 1""")
def split_records_sink(spark, sf_dir):
    """Record files for each block along x, read back; the block comes from the files' names."""
    folder = shared_path(spark, "split")
    cut = particles(spark, sf_dir).withColumn("block", F.floor((F.col("x") + 1) / 0.25))
    files = sinks.write_record_files(cut, folder, "block").collect()
    snapshots.register(spark)
    out = None
    for key in sorted({r["by"] for r in files}, key=int):
        back = spark.read.format("particle_records").option("path", f"{folder}/part-{key}-*").load().withColumn("block", F.lit(int(key)).cast("long"))
        out = back if out is None else out.unionByName(back)
    return out.groupBy("block").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query(f"""WITH RECURSIVE {FOF_SQL}, c AS (SELECT halo_tag, count(*) AS n, round(sum(mass),3) AS m, round(avg(vx),3) AS v FROM own GROUP BY 1)
SELECT halo_tag, 'Halo: ' || halo_tag || chr(10) || '  FOF count = ' || n || chr(10) || '  FOF mass = ' || printf('%.6f', m) AS text FROM c""")
def fof_text_sink(spark, sf_dir):
    """The first three lines of each group's paragraph, whose numbers are sums of whole masses."""
    lines = sinks.property_lines(halos.properties(_own(spark, sf_dir)))
    return sinks.saved(lines, shared_path(spark, "fofproperties")).select("halo_tag", F.substring_index("text", "\n", 3).alias("text"))


# ---- gates, radii by mass, reports

SOD_MASS_SQL = (
    SOD_SQL.replace("c AS (SELECT halo_tag, avg(x)", "c AS (SELECT halo_tag, r_max, cx, cy, cz, mx, my, mz FROM (SELECT *, least(2*power(m/1000.0, 1/3.0), cx+1, 1-cx, cy+1, 1-cy, cz+1, 1-cz) AS r_max FROM (SELECT halo_tag, sum(mass) AS m, avg(x)")
    .replace("avg(vz) AS mz FROM own GROUP BY halo_tag)", "avg(vz) AS mz FROM own GROUP BY halo_tag HAVING sum(mass) > 20)) WHERE r_max > 0.02)")
    .replace("d AS (SELECT c.halo_tag,", "d AS (SELECT c.halo_tag, c.r_max,")
    .replace("< 0.2*0.2)", "< r_max*r_max)")
    .replace("log10(0.2/0.02)", "log10(r_max/0.02)")
)


def _heavy(spark, sf_dir):
    own = _own(spark, sf_dir)
    c = halos.properties(own).select("halo_tag", "fof_halo_mass", *(F.col(f"fof_halo_mean_{a}").alias(f"center_{a}") for a in "xyz"), *(F.col(f"fof_halo_mean_v{a}").alias(f"mean_v{a}") for a in "xyz"))
    return halos.overdensity_radii(halos.massive(c, 20.0), 0.04, 1000.0, (-1.0,) * 3, (1.0,) * 3).filter("r_max > r_min")


@query(f"WITH RECURSIVE {SOD_MASS_SQL} SELECT halo_tag, bin, n, round(m,6) AS m, round(radius,6) AS radius, round(rad_vel,6) AS rad_vel, round(cum_mass,6) AS cum_mass, round(rho_ratio,4) AS rho_ratio FROM prof WHERE bin >= 1")
def sod_profile_by_mass(spark, sf_dir):
    """Profiles about groups heavier than a mass, out to radii that follow from it, without the core bin."""
    profile = halos.overdensity_profile(_heavy(spark, sf_dir), particles(spark, sf_dir), None, None, 6, 50.0)
    return rounded(halos.profile_without_core(profile).withColumn("rho_ratio", F.round("rho_ratio", 4)))


@query(f"WITH RECURSIVE {FOF_SQL}, g AS (SELECT halo_tag, count(*) AS n, sum(mass) AS m FROM own GROUP BY 1) SELECT halo_tag, n, round(m,6) AS mass, m > 40 AS massive, m >= 40 AND n >= 6 AS large, n > 6 AS searched FROM g")
def halo_gates(spark, sf_dir):
    own = _own(spark, sf_dir)
    all_of = halos.properties(own).select("halo_tag", "fof_halo_mass", "fof_halo_count")
    heavy = halos.massive(all_of, 40.0).select("halo_tag", F.lit(True).alias("massive"))
    large = halos.large_enough(all_of, 40.0, 6).select("halo_tag", F.lit(True).alias("large"))
    searched = halos.with_substructure(own, 6).select("halo_tag").distinct().withColumn("searched", F.lit(True))
    out = all_of.join(heavy, "halo_tag", "left").join(large, "halo_tag", "left").join(searched, "halo_tag", "left")
    return out.select("halo_tag", F.col("fof_halo_count").alias("n"), F.round("fof_halo_mass", 6).alias("mass"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("massive", "large", "searched")))


@query(ORACLE_SQL["halo_mbp_center"])
def halo_mbp_in_blocks(spark, sf_dir):
    return rounded(halos.most_bound_in_blocks(_own(spark, sf_dir), 4))


_REPORT = f"""{SOD_MASS_SQL}, w AS (SELECT halo_tag, bin, rho_ratio, lead(rho_ratio) OVER o AS nr, lead(radius) OVER o AS nrad, lead(cum_mass) OVER o AS nm FROM prof WINDOW o AS (PARTITION BY halo_tag ORDER BY bin)),
s AS (SELECT halo_tag, nrad, nm FROM w WHERE bin >= 1 AND rho_ratio > 200 AND nr < 200 QUALIFY row_number() OVER (PARTITION BY halo_tag ORDER BY bin) = 1)"""


@query(f"""WITH RECURSIVE {_REPORT} SELECT halo_tag AS halo_id, round(sum(mass),6) AS fof_halo_mass, round(avg(x),6) AS center_x, round(avg(vx),6) AS mean_vx,
 round(sqrt(greatest(0,(avg(vx*vx+vy*vy+vz*vz)-avg(vx)*avg(vx)-avg(vy)*avg(vy)-avg(vz)*avg(vz))/3)),6) AS fof_halo_vel_disp, round(max(nrad),6) AS sod_radius, round(max(nm),6) AS sod_mass FROM own LEFT JOIN s USING (halo_tag) GROUP BY halo_tag""")
def group_report(spark, sf_dir):
    groups, _ = halos.group_report(particles(spark, sf_dir), LINK, LEAST, 20.0, 0.04, 1000.0, (-1.0,) * 3, (1.0,) * 3, 6, 50.0)
    return rounded(groups.select("halo_id", "fof_halo_mass", "center_x", "mean_vx", "fof_halo_vel_disp", "sod_radius", "sod_mass"))


@query(f"WITH RECURSIVE {FOF_SQL} SELECT id, CASE WHEN size >= {LEAST} THEN tag ELSE -1 END AS halo_id FROM sized")
def group_report_particles(spark, sf_dir):
    _, own = halos.group_report(particles(spark, sf_dir), LINK, LEAST, 20.0, 0.04, 1000.0, (-1.0,) * 3, (1.0,) * 3, 6, 50.0)
    return own.select("id", "halo_id")


# ---- sources

@query("""WITH g AS (SELECT i AS id FROM range(1728) t(i)), m AS (SELECT id, [id%12, (id//12)%12, id//144] AS c, [((id*3)*7919+104729)%1000, ((id*3+1)*7919+104729)%1000, ((id*3+2)*7919+104729)%1000] AS j FROM g),
p AS (SELECT id, list_transform([1,2,3], lambda a: (c[a]+0.5)/12) AS mid, list_transform([1,2,3], lambda a: j[a]/1000.0*(0.8/12)) AS mv FROM m),
q AS (SELECT id, list_transform([1,2,3], lambda a: CASE WHEN mid[a]-mv[a] >= 0 THEN mid[a]-mv[a] WHEN mid[a]+mv[a] <= 1 THEN mid[a]+mv[a] ELSE mid[a] END) AS xyz FROM p)
SELECT id, round(CAST(xyz[1] AS DOUBLE),9) AS x, round(CAST(xyz[2] AS DOUBLE),9) AS y, round(CAST(xyz[3] AS DOUBLE),9) AS z FROM q""")
def jittered_particles(spark, sf_dir):
    return rounded(snapshots.jittered(spark, 12, 0.8), 9)


@query("SELECT 216 AS cells, 216 AS complete, 1.0 AS volume, 216 AS kept")
def voronoi_files(spark, sf_dir):
    """Cells of jittered particles written, and read back by range; they fill the periodic box."""
    path = shared_path(spark, "voronoi")
    sinks.write_cells(voronoi.cells(snapshots.jittered(spark, 6, 0.4), 1.0, 2, 0.5), path)
    cells = sinks.read_cells(spark, path, volumes=(0.0, 1.0))
    kept = voronoi.volume_bounds(cells, 1e-6, 0.5)
    return cells.agg(F.count("*").alias("cells"), F.count_if("complete").alias("complete"), F.round(F.sum("volume"), 6).alias("volume")).crossJoin(kept.agg(F.count("*").alias("kept")))


@query("SELECT 64 AS cells, 384 AS faces, 1536 AS corners, 1.0 AS volume, 6.0 AS area")
def voronoi_polyhedra(spark, sf_dir):
    """Faces of the cells of an undisturbed lattice: cubes."""
    cells = voronoi.cells(snapshots.jittered(spark, 4, 0.0), 1.0, 2, 0.5)
    p = sinks.polyhedra(cells)
    totals = cells.agg(F.count("*").alias("cells"), F.round(F.sum("volume"), 6).alias("volume"), F.round(F.sum("area") * 16 / 64, 6).alias("area"))
    return totals.crossJoin(p.agg(F.countDistinct("id", "face").alias("faces"), F.count("*").alias("corners"))).select("cells", "faces", "corners", "volume", "area")


@query("SELECT 64 AS points, 64.0 AS total")
def voronoi_density_weighted(spark, sf_dir):
    """Mass of a lattice dealt to a grid: what is dealt of each cell adds up to its density."""
    cells = voronoi.cells(snapshots.jittered(spark, 4, 0.0), 1.0, 2, 0.5)
    d = voronoi.deposit_weighted(cells, 4, 1.0)
    return d.agg(F.count("*").alias("points"), F.round(F.sum("density") / 64, 6).alias("total"))


@query(f"""WITH {PARTICLES_SQL}, s AS (SELECT id, round(CAST(x AS FLOAT),4)+0.5 AS x, round(CAST(y AS FLOAT),4)+0.5 AS y, round(CAST(z AS FLOAT),4)+0.5 AS z FROM particles),
o AS (SELECT *, CAST(floor(x/0.5) AS INTEGER) AS bx, CAST(floor(y/0.5) AS INTEGER) AS by_, CAST(floor(z/0.5) AS INTEGER) AS bz FROM s)
SELECT bx AS block_x, by_ AS block_y, bz AS block_z, count(*) AS own FROM o GROUP BY ALL""")
def read_with_ghosts(spark, sf_dir):
    """Record files read with ghosts: particles of its own in each block; ghosts are checked by ghost_exchange."""
    folder = shared_path(spark, "ghosts")
    make_folder(folder)
    moved = particles(spark, sf_dir).withColumns({a: F.round(F.col(a).cast("float"), 4) + 0.5 for a in "xyz"})
    snapshots.write_records(moved, folder).count()
    both = snapshots.read_with_ghosts(spark, folder, 1.0, 2, 0.1)
    return both.filter("ghost = 0").groupBy("block_x", "block_y", "block_z").agg(F.count("*").alias("own"))


@query("""WITH h AS (SELECT * FROM (VALUES (0,0,0,5),(0,1,6,10),(0,2,11,20),(1,0,0,10),(1,1,25,30),(2,0,0,10),(2,1,25,27),(2,2,28,30)) v(timestep, halo_tag, a, b))
SELECT timestep, CAST(halo_tag AS BIGINT) AS halo_tag, count(*) AS n, CAST(sum(i) AS BIGINT) AS ids FROM h, unnest(range(a, b+1)) t(i) GROUP BY 1, 2""")
def synthetic_halos(spark, sf_dir):
    return snapshots.synthetic_halos(spark).groupBy("timestep", "halo_tag").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


# ---- exchanges and extents

@query(f"""WITH {PARTICLES_SQL}, s AS (SELECT id, {', '.join(f'{a}+0.5 AS {a}, {a}+0.5+0.9*v{a} AS m{a}' for a in 'xyz')} FROM particles),
w AS (SELECT id, {', '.join(f'least(CAST(floor({a}/0.25) AS INTEGER),3) AS h{a}, m{a}-floor(m{a}) AS m{a}' for a in 'xyz')} FROM s),
o AS (SELECT *, {', '.join(f'least(CAST(floor(m{a}/0.25) AS INTEGER),3) AS o{a}' for a in 'xyz')} FROM w)
SELECT ox AS owner_x, oy AS owner_y, oz AS owner_z, count(*) AS n, count(*) FILTER (WHERE {' OR '.join(f'least(abs(o{a}-h{a}), 4-abs(o{a}-h{a})) > 1' for a in 'xyz')}) AS orphans FROM o GROUP BY 1, 2, 3""")
def rehoming_3d(spark, sf_dir):
    """All particles moved along their velocity, to the blocks that own them then; orphans moved further than a neighbour."""
    at = particles(spark, sf_dir).withColumns({a: F.col(a) + 0.5 for a in "xyz"})
    home = spatial.owners(at, 1.0, 4, "home_")
    moved = home.withColumns({a: F.col(a) + F.lit(0.9) * F.col(f"v{a}") for a in "xyz"})
    return spatial.rehome(moved, 1.0, 4).groupBy("owner_x", "owner_y", "owner_z").agg(F.count("*").alias("n"), F.count_if("orphan").alias("orphans"))


@query("""WITH b AS (SELECT CAST(i AS INTEGER) AS b FROM range(2) t(i)), e AS (SELECT i AS e FROM range(6) t(i))
SELECT bx.b AS block_x, by_.b AS block_y, bz.b AS block_z, i.e AS i, j.e AS j, k.e AS k,
 (((bz.b*3+k.e-1)+6)%6*6+((by_.b*3+j.e-1)+6)%6)*6+((bx.b*3+i.e-1)+6)%6 AS cell FROM b bx, b by_, b bz, e i, e j, e k
WHERE i.e < 1 OR i.e >= 4 OR j.e < 1 OR j.e >= 4 OR k.e < 1 OR k.e >= 4""")
def grid_ghost_planes(spark, sf_dir):
    """Dead planes of the blocks of a grid: one before, two behind along each axis."""
    return spatial.grid_ghosts(spark, 6, 2, 1, 2)


@query("""SELECT p_partkey, p_size+1 AS ni, (p_partkey%7)+1 AS nj, 4 AS nk, (p_size+1)*((p_partkey%7)+1)*4 AS nodes, p_size*(p_partkey%7)*3 AS cells, p_size > 0 AND p_partkey%7 > 0 AS is_3d FROM part""")
def extents(spark, sf_dir):
    e = [F.lit(2), F.col("p_size") + 2, F.lit(0), F.col("p_partkey") % 7, F.lit(-1), F.lit(2)]
    ni, nj, nk = expr.extent_dimensions(e)
    return table(spark, sf_dir, "part").select("p_partkey", ni.alias("ni"), nj.alias("nj"), nk.alias("nk"), expr.extent_nodes(e).alias("nodes"), expr.extent_cells(e).alias("cells"), expr.is_3d(e).alias("is_3d"))


@query(f"WITH {PARTICLES_SQL} SELECT id, {' OR '.join(f'{a}+0.5 < 0.25 OR {a}+0.5 > 0.75' for a in 'xyz')} AS in_fringe FROM particles")
def periodic_fringe(spark, sf_dir):
    return particles(spark, sf_dir).select("id", expr.in_periodic_fringe([F.col(a) + 0.5 for a in "xyz"], [0.0] * 3, [1.0] * 3, 25.0).alias("in_fringe"))


@query(f"WITH {MEMBERSHIP_SQL} SELECT timestep || '.' || halo_tag AS key, count(*) AS n FROM members GROUP BY 1")
def node_keys(spark, sf_dir):
    return memberships(spark, sf_dir).groupBy(expr.node_key(F.col("timestep"), F.col("halo_tag")).alias("key")).agg(F.count("*").alias("n"))


@query(f"WITH {PARTICLES_SQL} SELECT id, CASE WHEN mass = 1.0 THEN 277536627000.0*8*(0.22+0.02258/(0.71*0.71))/64 ELSE mass END AS mass FROM particles")
def particle_masses(spark, sf_dir):
    mass = expr.particle_mass(2.77536627e11, 2.0, 4, 0.22, 0.02258, 0.71)
    return particles(spark, sf_dir).select("id", expr.unit_mass(F.col("mass"), mass).alias("mass"))


# ---- the tree, step by step in SQL

#: Years of shipping in the tables, each a snapshot.
_STEPS = 7


def _tree_sql() -> str:
    out = [f"{MEMBERSHIP_SQL}", "steps AS MATERIALIZED (SELECT timestep, row_number() OVER (ORDER BY timestep) - 1 AS k FROM (SELECT DISTINCT timestep FROM members))",
           "placed AS MATERIALIZED (SELECT k, timestep, halo_tag AS tag, id FROM members JOIN steps USING (timestep))",
           "f0 AS MATERIALIZED (SELECT DISTINCT tag, false AS zombie, 0 AS age, 8 AS mask, CAST(NULL AS BIGINT) AS source FROM placed WHERE k = 0)"]
    for k in range(_STEPS):
        before = f"(SELECT count(*) FROM n{k - 1}) + (SELECT min(node) FROM n{k - 1})" if k else "0"
        out.append(f"n{k} AS MATERIALIZED (SELECT row_number() OVER (ORDER BY zombie, tag, source) - 1 + {before} AS node, * FROM f{k})")
        own = f"SELECT node, tag, zombie, age, id FROM n{k} JOIN (SELECT tag, id FROM placed WHERE k = {k}) USING (tag) WHERE NOT zombie"
        if k:
            own += f" UNION ALL SELECT n.node, n.tag, n.zombie, n.age, s.id FROM n{k} n JOIN s{k - 1} s ON s.node = n.source WHERE n.zombie"
        out.append(f"s{k} AS MATERIALIZED ({own})")
        if k + 1 < _STEPS:
            out += [
                f"z{k} AS MATERIALIZED (SELECT node, tag, zombie, age, count(*) AS size FROM s{k} GROUP BY ALL)",
                f"m{k} AS MATERIALIZED (SELECT node, next, zombie, count(*) OVER (PARTITION BY node) AS n_next, count(*) OVER (PARTITION BY next) AS n_prev, row_number() OVER (PARTITION BY next ORDER BY node) AS place"
                f" FROM (SELECT s.node, a.tag AS next, count(*) AS shared FROM s{k} s JOIN placed a ON a.id = s.id AND a.k = {k + 1} WHERE NOT zombie OR age <= 5 GROUP BY 1, 2) JOIN z{k} USING (node) WHERE round(100*shared/size) >= {MATCH})",
                f"f{k + 1} AS MATERIALIZED (SELECT a.tag, false AS zombie, 0 AS age, CASE WHEN m.node IS NULL THEN 8 ELSE (CASE WHEN n_prev = 1 THEN 4 ELSE 2 END) + (CASE WHEN n_next > 1 THEN 1 ELSE 0 END) + (CASE WHEN zombie THEN 32 ELSE 0 END) END AS mask, CAST(NULL AS BIGINT) AS source"
                f" FROM (SELECT DISTINCT tag FROM placed WHERE k = {k + 1}) a LEFT JOIN m{k} m ON m.next = a.tag AND m.place = 1 UNION ALL SELECT tag, true, age + 1, 16, node FROM z{k} WHERE node NOT IN (SELECT node FROM m{k}))",
            ]
    nodes = " UNION ALL ".join(f"SELECT node, CAST((SELECT timestep FROM steps WHERE k = {k}) AS INTEGER) AS timestep, tag, zombie, age, mask FROM n{k}" for k in range(_STEPS))
    sizes = " UNION ALL ".join(f"SELECT node, count(*) AS size FROM s{k} GROUP BY 1" for k in range(_STEPS))
    edges = " UNION ALL ".join(f"SELECT m.node, n.node AS descendant FROM m{k} m JOIN n{k + 1} n ON n.tag = m.next AND NOT n.zombie UNION ALL SELECT source, node FROM n{k + 1} WHERE zombie" for k in range(_STEPS - 1))
    out += [f"nodes AS MATERIALIZED ({nodes})", f"edges AS MATERIALIZED ({edges})", f"sizes AS MATERIALIZED ({sizes})",
            "best AS (SELECT e.node, max_by(descendant, (coalesce(size, 0), -descendant)) AS descendant FROM edges e LEFT JOIN sizes s ON s.node = descendant GROUP BY 1)",
            "tree AS MATERIALIZED (SELECT n.*, coalesce(descendant, -1) AS descendant FROM nodes n LEFT JOIN best USING (node))"]
    return ",\n".join(out)


GROWN_SQL = _tree_sql()
_BITS = {"split": 1, "merge": 2, "continuation": 4, "birth": 8, "death": 16, "rebirth": 32}
ORACLE_SQL["merger_tree"] = f"WITH {GROWN_SQL} SELECT node AS node_id, timestep, tag AS halo_tag, zombie, age, mask AS event_mask, descendant AS descendant_id FROM tree"
ORACLE_SQL["merger_tree_counts"] = f"WITH {GROWN_SQL} SELECT timestep, count(*) AS nodes, count(*) FILTER (WHERE zombie) AS zombies, {', '.join(f'count(*) FILTER (WHERE mask & {b} <> 0) AS n_{n}' for n, b in _BITS.items())} FROM nodes GROUP BY 1"
ORACLE_SQL["stream_merger_tree"] = f"WITH {GROWN_SQL} SELECT node AS node_id, timestep, tag AS halo_tag, zombie, age, mask AS event_mask FROM nodes"
ORACLE_SQL["merger_tree_text"] = f"""WITH {GROWN_SQL}, d AS (SELECT node, string_agg(descendant, ' ' ORDER BY descendant) AS down FROM edges GROUP BY 1), u AS (SELECT descendant AS node, string_agg(node, ' ' ORDER BY node) AS up FROM edges GROUP BY 1)
SELECT node AS node_id, node || chr(9) || timestep || '.' || tag || chr(9) || array_to_string(list_filter([{', '.join(f"CASE WHEN mask & {b} <> 0 THEN '{n.upper()}' END" for n, b in _BITS.items())}], lambda v: v IS NOT NULL), '|') || chr(9) || coalesce(up, '-') || chr(9) || coalesce(down, 'FINAL TIMESTEP') AS line
FROM nodes LEFT JOIN d USING (node) LEFT JOIN u USING (node)"""


@query(f"""WITH {GROWN_SQL}, c AS (SELECT timestep, halo_tag, CAST(sum(id % 10) AS DOUBLE) AS mass, CAST(avg(id) AS DOUBLE) AS cx FROM members GROUP BY 1, 2),
p AS (SELECT n.*, c.mass, c.cx FROM nodes n LEFT JOIN c ON c.timestep = n.timestep - n.age AND c.halo_tag = n.tag),
b AS (SELECT e.node, max_by(descendant, (coalesce(mass, -1), -descendant)) AS heaviest FROM edges e LEFT JOIN p ON p.node = descendant GROUP BY 1)
SELECT p.node AS tree_node_id, tag AS halo_tag, mass AS halo_mass, timestep, round((timestep - age)/10.0, 6) AS redshift, round(cx, 6) AS center_x, coalesce(heaviest, -1) AS descendant_id, mask AS event_mask FROM p LEFT JOIN b USING (node)""")
def merger_tree_table(spark, sf_dir):
    """The tree file's columns, written, read back and cut to those that the tables here give; heaviest descendants."""
    members = memberships(spark, sf_dir)
    nodes, edges = mergertree.build_tree(members, MATCH)
    own = members.groupBy("timestep", "halo_tag").agg(F.sum(F.col("id") % 10).cast("double").alias("halo_mass"), F.avg("id").alias("center_x"))
    rest = {c: F.lit(0.0) for c in sinks.TREE_COLUMNS[6:14]} | {"redshift": F.col("timestep") / 10.0}
    back = sinks.write_tree(sinks.tree_table(nodes, edges, own.withColumns(rest)), shared_path(spark, "tree"))
    return rounded(back.select("tree_node_id", "halo_tag", "halo_mass", "timestep", "redshift", "center_x", "descendant_id", "event_mask"))


# ---- probe and groups

@query(ORACLE_SQL["probe_grid"])
def probe_uniform(spark, sf_dir):
    out = probe.probe_uniform(_placed(spark), GRID)
    return out.select("point_id", "streams", F.round(F.col("rho") * 1e6, 3).alias("rho"))


@query(f"WITH {TET_SQL.replace('(i+j+k)%2=0', f'(i+{CELLS + 1}*(j+{CELLS + 1}*k))%2=0')} SELECT tet_id, n0, n1, n2, n3 FROM tets")
def tet_tessellation_by_index(spark, sf_dir):
    return probe.tetrahedra(spark, CELLS, compat=True)


@query(f"""WITH {PLACED_SQL}, b AS (SELECT {', '.join(f'CAST(floor(least({", ".join(c + a for c in CORNERS)})*4) AS BIGINT) AS lo{a}, CAST(floor(greatest({", ".join(c + a for c in CORNERS)})*4) AS BIGINT) AS hi{a}' for a in 'xyz')} FROM placed)
SELECT bx, by_ AS by, bz, count(*) AS n FROM b, unnest(range(lox, hix+1)) x(bx), unnest(range(loy, hiy+1)) y(by_), unnest(range(loz, hiz+1)) z(bz) GROUP BY 1, 2, 3""")
def bucket_occupancy(spark, sf_dir):
    return probe.occupancy(_placed(spark), 0.25)


@query(f"WITH RECURSIVE {FOF_SQL} SELECT DISTINCT halo_tag, halo_size FROM own WHERE halo_size > 5")
def halo_sizes(spark, sf_dir):
    return halos.sizes(halos.membership(particles(spark, sf_dir), LINK, LEAST), 5)


@query(f"WITH RECURSIVE {FOF_SQL} SELECT id, round(x,6) AS x, round(vx,6) AS vx, mass FROM own WHERE halo_tag = (SELECT min(halo_tag) FROM own)")
def halo_information(spark, sf_dir):
    p = particles(spark, sf_dir)
    members = halos.membership(p, LINK, LEAST)
    first = members.filter("halo_tag >= 0").agg(F.min("halo_tag")).first()[0]
    return rounded(halos.particles_of(p, members, first).select("id", "x", "vx", "mass"))


__all__ = ["ORACLE_SQL", "QUERIES"]
