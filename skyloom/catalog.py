"""Registered queries of the engine and, where SQL can express them, the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.functions import expr
from skyloom.functions.files import make_folder
from skyloom.functions.shared import shared_path
from skyloom.operators import halos, mergertree, probe, spatial, subhalo, voronoi
from skyloom.sources import snapshots
from skyloom.sources.tables import MEMBERSHIP_SQL, PARTICLES_SQL, POINTS_SQL, memberships, particles, points, table
from skyloom.streaming.tracker import track_files, windowed_counts

LINK, LEAST, MATCH = 0.03, 3, 10
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


FOF_SQL = f"""{PARTICLES_SQL},
pairs AS (SELECT a.id AS id1, b.id AS id2 FROM particles a JOIN particles b ON a.id < b.id AND abs(a.x-b.x) < {LINK} AND
  (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) < {LINK}*{LINK}),
links AS (SELECT id1 AS a, id2 AS b FROM pairs UNION ALL SELECT id2, id1 FROM pairs),
reach AS (SELECT id, id AS root FROM particles UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id),
tagged AS (SELECT id, min(root) AS tag FROM reach GROUP BY id),
sized AS (SELECT id, tag, count(*) OVER (PARTITION BY tag) AS size FROM tagged),
own AS (SELECT p.*, s.tag AS halo_tag, s.size AS halo_size FROM particles p JOIN sized s USING (id) WHERE s.size >= {LEAST})"""


def _own(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = particles(spark, sf_dir)
    return halos.halo_particles(p, halos.membership(p, LINK, LEAST))


@query(f"WITH RECURSIVE {FOF_SQL} SELECT id1, id2 FROM pairs")
def fof_pairs(spark, sf_dir):
    return spatial.close_pairs(particles(spark, sf_dir), LINK).select("id1", "id2")


@query(f"""WITH {PARTICLES_SQL}, s AS (SELECT id, x+0.5-floor(x+0.5) AS x, y+0.5-floor(y+0.5) AS y, z+0.5-floor(z+0.5) AS z FROM particles)
SELECT a.id AS id1, b.id AS id2 FROM s a JOIN s b ON a.id < b.id AND
 power(least(abs(a.x-b.x), 1-abs(a.x-b.x)),2)+power(least(abs(a.y-b.y), 1-abs(a.y-b.y)),2)+power(least(abs(a.z-b.z), 1-abs(a.z-b.z)),2) < 0.0049""")
def fof_pairs_periodic(spark, sf_dir):
    at = particles(spark, sf_dir).select("id", *((F.col(a) + 0.5 - F.floor(F.col(a) + 0.5)).alias(a) for a in "xyz"))
    return spatial.close_pairs_periodic(at, 0.07, 1.0).select("id1", "id2")


@query(f"WITH RECURSIVE {FOF_SQL} SELECT id, CASE WHEN size >= {LEAST} THEN tag ELSE -1 END AS halo_tag, size AS halo_size FROM sized")
def fof_membership(spark, sf_dir):
    return halos.membership(particles(spark, sf_dir), LINK, LEAST)


@query(f"""WITH RECURSIVE {FOF_SQL}, n AS (SELECT id FROM links_c), links_c AS (SELECT a AS id FROM links GROUP BY a HAVING count(*) >= 2)
SELECT id1, id2 FROM pairs WHERE id1 IN (SELECT id FROM links_c) AND id2 IN (SELECT id FROM links_c)""".replace("n AS (SELECT id FROM links_c), ", ""))
def fof_min_neighbours(spark, sf_dir):
    return halos.linked_by_neighbours(particles(spark, sf_dir), LINK, 2)


@query(f"""WITH RECURSIVE {FOF_SQL} SELECT halo_tag, count(*) AS fof_halo_count, round(sum(mass),6) AS fof_halo_mass,
 round(sum(mass*x)/sum(mass),6) AS fof_halo_center_x, round(sum(mass*y)/sum(mass),6) AS fof_halo_center_y, round(sum(mass*z)/sum(mass),6) AS fof_halo_center_z,
 round(avg(x),6) AS fof_halo_mean_x, round(avg(y),6) AS fof_halo_mean_y, round(avg(z),6) AS fof_halo_mean_z,
 round(avg(vx),6) AS fof_halo_mean_vx, round(avg(vy),6) AS fof_halo_mean_vy, round(avg(vz),6) AS fof_halo_mean_vz,
 round(sqrt(greatest(0,(avg(vx*vx+vy*vy+vz*vz)-avg(vx)*avg(vx)-avg(vy)*avg(vy)-avg(vz)*avg(vz))/3)),6) AS fof_halo_vel_disp FROM own GROUP BY halo_tag""")
def fof_halo_catalog(spark, sf_dir):
    keep = ["halo_tag", "fof_halo_count", "fof_halo_mass", *(f"fof_halo_{k}{a}" for k in ("center_", "mean_", "mean_v") for a in "xyz"), "fof_halo_vel_disp"]
    return rounded(halos.properties(_own(spark, sf_dir)).select(*keep))


@query(f"WITH RECURSIVE {FOF_SQL} SELECT halo_tag, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM own GROUP BY halo_tag")
def halo_bbox(spark, sf_dir):
    return halos.properties(_own(spark, sf_dir)).select("halo_tag", *(f"{n}_{a}" for a in "xyz" for n in ("min", "max")))


@query(f"WITH RECURSIVE {FOF_SQL} SELECT halo_tag, id AS min_potential_id FROM own QUALIFY row_number() OVER (PARTITION BY halo_tag ORDER BY potential, id) = 1")
def halo_min_potential_center(spark, sf_dir):
    return halos.properties(_own(spark, sf_dir)).select("halo_tag", "min_potential_id")


@query(f"""WITH RECURSIVE {FOF_SQL}, f AS (SELECT o.halo_tag, o.id, count(l.b) AS friends FROM own o LEFT JOIN links l ON l.a = o.id GROUP BY 1, 2)
SELECT halo_tag, id AS mcp_id, friends FROM f QUALIFY row_number() OVER (PARTITION BY halo_tag ORDER BY friends DESC, id) = 1""")
def halo_mcp_center(spark, sf_dir):
    return halos.most_connected(_own(spark, sf_dir), LINK)


@query(f"""WITH RECURSIVE {FOF_SQL}, f AS (SELECT a.halo_tag, a.id, round(sum(-b.mass/sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))),9) AS phi
 FROM own a JOIN own b ON a.halo_tag = b.halo_tag AND a.id <> b.id WHERE (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) > 0 GROUP BY 1, 2)
SELECT halo_tag, id AS mbp_id, round(phi,6) AS potential FROM f QUALIFY row_number() OVER (PARTITION BY halo_tag ORDER BY phi, id) = 1""")
def halo_mbp_center(spark, sf_dir):
    return rounded(halos.most_bound(_own(spark, sf_dir)))


@query(f"""WITH RECURSIVE {FOF_SQL}, f AS (SELECT o.halo_tag, o.id, o.x, o.y, o.z, count(l.b) AS friends FROM own o LEFT JOIN links l ON l.a = o.id GROUP BY ALL),
m AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY halo_tag ORDER BY friends DESC, id) = 1)
SELECT halo_tag, 'AVERAGE' AS method, round(avg(x),6) AS center_x, round(avg(y),6) AS center_y, round(avg(z),6) AS center_z FROM own GROUP BY halo_tag
UNION ALL SELECT halo_tag, 'CENTER_OF_MASS', round(sum(mass*x)/sum(mass),6), round(sum(mass*y)/sum(mass),6), round(sum(mass*z)/sum(mass),6) FROM own GROUP BY halo_tag
UNION ALL SELECT halo_tag, 'MCP', round(x,6), round(y,6), round(z,6) FROM m
UNION ALL SELECT halo_tag, 'POTENTIAL', round(x,6), round(y,6), round(z,6) FROM (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY halo_tag ORDER BY potential, id) = 1)""")
def halo_centers(spark, sf_dir):
    own = _own(spark, sf_dir)
    out = None
    for method in ("AVERAGE", "CENTER_OF_MASS", "MCP", "POTENTIAL"):
        one = rounded(halos.chosen_center(own, method, LINK)).withColumn("method", F.lit(method))
        out = one if out is None else out.unionByName(one)
    return out.select("halo_tag", "method", "center_x", "center_y", "center_z")


@query(f"WITH RECURSIVE {FOF_SQL} SELECT count(*) AS particles, (SELECT count(*) FROM own) AS halo_particles, (SELECT count(DISTINCT halo_tag) FROM own) AS halos FROM particles")
def halo_statistics(spark, sf_dir):
    members = halos.membership(particles(spark, sf_dir), LINK, LEAST)
    return members.agg(F.count("*").alias("particles"), F.count_if(F.col("halo_tag") >= 0).alias("halo_particles"), F.countDistinct(F.when(F.col("halo_tag") >= 0, F.col("halo_tag"))).alias("halos"))


@query(f"WITH RECURSIVE {FOF_SQL} SELECT id, x, y, z, halo_tag FROM own WHERE halo_size >= 5")
def tagged_particles(spark, sf_dir):
    return _own(spark, sf_dir).filter("halo_size >= 5").select("id", "x", "y", "z", "halo_tag")


R_MIN, R_MAX, BINS, RHO = 0.02, 0.2, 6, 50.0
SOD_SQL = f"""{FOF_SQL}, c AS (SELECT halo_tag, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, avg(vx) AS mx, avg(vy) AS my, avg(vz) AS mz FROM own GROUP BY halo_tag),
d AS (SELECT c.halo_tag, p.id, p.mass, sqrt((p.x-cx)*(p.x-cx)+(p.y-cy)*(p.y-cy)+(p.z-cz)*(p.z-cz)) AS r, (p.x-cx)*(p.vx-mx)+(p.y-cy)*(p.vy-my)+(p.z-cz)*(p.vz-mz) AS along
  FROM c JOIN particles p ON (p.x-cx)*(p.x-cx)+(p.y-cy)*(p.y-cy)+(p.z-cz)*(p.z-cz) < {R_MAX}*{R_MAX}),
b AS (SELECT halo_tag, id, CAST(CASE WHEN r <= {R_MIN} THEN 0 ELSE least(floor(log10(r/{R_MIN})/(log10({R_MAX}/{R_MIN})/{BINS}))+1, {BINS}) END AS INTEGER) AS bin, mass, r, CASE WHEN r > 0 THEN along/r ELSE 0 END AS vr FROM d),
g AS (SELECT halo_tag, bin, count(*) AS n, sum(mass) AS m, avg(r) AS radius, avg(vr) AS rad_vel FROM b GROUP BY 1, 2),
e AS (SELECT halo_tag, CAST(bin AS INTEGER) AS bin FROM c, range(0, {BINS + 1}) t(bin)),
f AS (SELECT halo_tag, bin, coalesce(n,0) AS n, coalesce(m,0) AS m, coalesce(radius,0) AS radius, coalesce(rad_vel,0) AS rad_vel, sum(coalesce(m,0)) OVER (PARTITION BY halo_tag ORDER BY bin) AS cum_mass FROM e LEFT JOIN g USING (halo_tag, bin)),
prof AS (SELECT *, CASE WHEN radius > 0 THEN cum_mass/(4*pi()/3*radius*radius*radius)/{RHO} ELSE 0 END AS rho_ratio FROM f)"""


def _sod_centers(spark, sf_dir):
    return _own(spark, sf_dir).groupBy("halo_tag").agg(*(F.avg(a).alias(f"center_{a}") for a in "xyz"), *(F.avg(f"v{a}").alias(f"mean_v{a}") for a in "xyz"))


def _profile(spark, sf_dir):
    return halos.overdensity_profile(_sod_centers(spark, sf_dir), particles(spark, sf_dir), R_MIN, R_MAX, BINS, RHO)


@query(f"WITH RECURSIVE {SOD_SQL} SELECT halo_tag, bin, n, round(m,6) AS m, round(radius,6) AS radius, round(rad_vel,6) AS rad_vel, round(cum_mass,6) AS cum_mass, round(rho_ratio,4) AS rho_ratio FROM prof")
def sod_profile(spark, sf_dir):
    return rounded(_profile(spark, sf_dir).withColumn("rho_ratio", F.round("rho_ratio", 4)))


@query(f"""WITH RECURSIVE {SOD_SQL}, w AS (SELECT halo_tag, bin, rho_ratio, lead(rho_ratio) OVER o AS nr, lead(radius) OVER o AS nrad, lead(cum_mass) OVER o AS nm FROM prof WINDOW o AS (PARTITION BY halo_tag ORDER BY bin))
SELECT halo_tag, CAST(bin+1 AS INTEGER) AS critical_bin, round(nrad,6) AS sod_radius, round(nm,6) AS sod_mass FROM w WHERE bin >= 1 AND rho_ratio > 200 AND nr < 200 QUALIFY row_number() OVER (PARTITION BY halo_tag ORDER BY bin) = 1""")
def sod_radius(spark, sf_dir):
    return rounded(halos.overdensity_radius(_profile(spark, sf_dir)))


SOD_MEMBERS_SQL = f"""{SOD_SQL}, w AS (SELECT halo_tag, bin, cum_mass, rho_ratio, lead(rho_ratio) OVER (PARTITION BY halo_tag ORDER BY bin) AS nr FROM prof),
crit AS (SELECT halo_tag, bin+1 AS cb, cum_mass AS lower_mass FROM w WHERE bin >= 1 AND rho_ratio > 200 AND nr < 200 QUALIFY row_number() OVER (PARTITION BY halo_tag ORDER BY bin) = 1),
rim AS (SELECT b.halo_tag, b.id, r, lower_mass+sum(mass) OVER (PARTITION BY b.halo_tag ORDER BY r, b.id ROWS UNBOUNDED PRECEDING) AS to_here FROM b JOIN crit ON b.halo_tag = crit.halo_tag AND b.bin = cb),
walk AS (SELECT halo_tag, id, r, bool_or(to_here/(4*pi()/3*r*r*r)/{RHO} < 200) OVER (PARTITION BY halo_tag ORDER BY r, id ROWS UNBOUNDED PRECEDING) AS past FROM rim),
sod AS (SELECT b.halo_tag, b.id, r FROM b JOIN crit USING (halo_tag) WHERE bin < cb UNION ALL SELECT halo_tag, id, r FROM walk WHERE NOT past),
edge AS (SELECT halo_tag, min(r) AS sod_radius FROM walk WHERE past GROUP BY halo_tag)"""


@query(f"WITH RECURSIVE {SOD_MEMBERS_SQL} SELECT halo_tag, id, round(r,6) AS r, round(sod_radius,6) AS sod_radius FROM sod LEFT JOIN edge USING (halo_tag)")
def sod_members(spark, sf_dir):
    own = halos.overdensity_members(_sod_centers(spark, sf_dir), particles(spark, sf_dir), R_MIN, R_MAX, BINS, RHO)
    return rounded(own.select("halo_tag", "id", "r", "sod_radius"))


@query(f"""WITH RECURSIVE {SOD_MEMBERS_SQL} SELECT halo_tag, count(*) AS sod_count, round(sum(mass),6) AS sod_mass, round(max(sod_radius),6) AS sod_radius,
 round(avg(x),6) AS mean_x, round(avg(y),6) AS mean_y, round(avg(z),6) AS mean_z, round(sum(mass*x)/sum(mass),6) AS com_x, round(sum(mass*y)/sum(mass),6) AS com_y, round(sum(mass*z)/sum(mass),6) AS com_z,
 round(avg(vx),6) AS mean_vx, round(avg(vy),6) AS mean_vy, round(avg(vz),6) AS mean_vz,
 round(sqrt(greatest(0,(avg(vx*vx+vy*vy+vz*vz)-avg(vx)*avg(vx)-avg(vy)*avg(vy)-avg(vz)*avg(vz))/3)),6) AS vel_disp
FROM sod JOIN particles USING (id) LEFT JOIN edge USING (halo_tag) GROUP BY halo_tag""")
def sod_halos(spark, sf_dir):
    own = halos.overdensity_members(_sod_centers(spark, sf_dir), particles(spark, sf_dir), R_MIN, R_MAX, BINS, RHO)
    return rounded(own.groupBy("halo_tag").agg(
        F.count("*").alias("sod_count"), F.sum("mass").alias("sod_mass"), F.max("sod_radius").alias("sod_radius"),
        *(F.avg(a).alias(f"mean_{a}") for a in "xyz"), *((F.sum(F.col("mass") * F.col(a)) / F.sum("mass")).alias(f"com_{a}") for a in "xyz"),
        *(F.avg(f"v{a}").alias(f"mean_v{a}") for a in "xyz"), halos.dispersion().alias("vel_disp"),
    ))


@query(f"""WITH {PARTICLES_SQL}, c AS (SELECT id AS center_id, x AS cx, y AS cy, z AS cz FROM particles WHERE mass = 1.0),
d AS (SELECT center_id, greatest(CAST(ceil(sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz))*4/0.1) AS INTEGER)-1,0) AS s FROM c JOIN particles ON (x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz) <= 0.1*0.1),
g AS (SELECT center_id, s, count(*) AS n FROM d GROUP BY 1, 2), e AS (SELECT center_id, CAST(s AS INTEGER) AS sphere FROM c, range(0, 4) t(s))
SELECT center_id, sphere, CAST(n AS BIGINT) AS n_particles, round(n/(4*pi()/3*power((sphere+1)*0.025,3)),4) AS density FROM
 (SELECT center_id, sphere, sum(coalesce(n,0)) OVER (PARTITION BY center_id ORDER BY sphere) AS n FROM e LEFT JOIN g ON e.center_id = g.center_id AND e.sphere = g.s) q""".replace("SELECT center_id, sphere, sum", "SELECT e.center_id AS center_id, sphere, sum").replace("PARTITION BY center_id ORDER BY sphere", "PARTITION BY e.center_id ORDER BY sphere"))
def density_profile(spark, sf_dir):
    p = particles(spark, sf_dir)
    centers = p.filter("mass = 1.0").select(F.col("id").alias("center_id"), *(F.col(a).alias(f"center_{a}") for a in "xyz"))
    return halos.density_profile(centers, p, 0.1, 4).select("center_id", "sphere", "n_particles", F.round("density", 4).alias("density"))


@query("""WITH h AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1), m AS (SELECT n*5.383578e10 AS m FROM h),
b AS (SELECT CAST(floor((log10(m)-11.0)/(5.0/15)) AS INTEGER) AS bin, m FROM m) SELECT bin, count(*) AS halos, round(avg(m)/1e10,4) AS mean_mass, round(log10(avg(m)),6) AS log_mean FROM b WHERE bin >= 0 AND bin < 15 GROUP BY bin""")
def halo_mass_histogram(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    out = halos.mass_histogram(counts, 5.383578e10, 11.0, 16.0, 15)
    return out.select("bin", "halos", F.round(F.col("mean_mass") / 1e10, 4).alias("mean_mass"), F.round("log_mean", 6).alias("log_mean"))


TREE_SQL = f"""{MEMBERSHIP_SQL}, s AS (SELECT timestep, halo_tag, count(*) AS size FROM members GROUP BY 1, 2),
o AS (SELECT a.timestep, a.halo_tag, b.halo_tag AS next_tag, count(*) AS shared FROM members a JOIN members b ON a.id = b.id AND b.timestep = a.timestep+1 GROUP BY 1, 2, 3),
p AS (SELECT o.*, size, CAST(round(100*shared/size) AS INTEGER) AS pct FROM o JOIN s USING (timestep, halo_tag)),
m AS (SELECT timestep, halo_tag, next_tag, pct, count(*) OVER (PARTITION BY timestep, halo_tag) AS n_next, count(*) OVER (PARTITION BY timestep, next_tag) AS n_prev FROM p WHERE pct >= {MATCH}),
f AS (SELECT timestep+1 AS timestep, next_tag AS halo_tag, (CASE WHEN n_prev = 1 THEN 4 ELSE 2 END)+(CASE WHEN n_next > 1 THEN 1 ELSE 0 END) AS mask FROM m QUALIFY row_number() OVER (PARTITION BY timestep, next_tag ORDER BY halo_tag) = 1),
ev AS (SELECT s.timestep, s.halo_tag, CAST(coalesce(mask, 8) AS INTEGER) AS event_mask FROM s LEFT JOIN f USING (timestep, halo_tag)),
dead AS (SELECT timestep, halo_tag FROM s WHERE timestep < (SELECT max(timestep) FROM s) AND (timestep, halo_tag) NOT IN (SELECT (timestep, halo_tag) FROM m))"""


@query(f"WITH {TREE_SQL} SELECT timestep, halo_tag, next_tag, shared, size, pct FROM p")
def overlap_matrix(spark, sf_dir):
    return mergertree.overlaps(memberships(spark, sf_dir)).select("timestep", "halo_tag", "next_tag", "shared", "size", "pct")


@query(f"WITH {TREE_SQL} SELECT timestep, halo_tag, next_tag, pct, n_next, n_prev FROM m")
def merger_edges(spark, sf_dir):
    return mergertree.matches(memberships(spark, sf_dir), MATCH)


@query(f"""WITH {TREE_SQL} SELECT timestep, halo_tag, event_mask, array_to_string(list_filter([CASE WHEN event_mask & 1 <> 0 THEN 'SPLIT' END, CASE WHEN event_mask & 2 <> 0 THEN 'MERGE' END,
 CASE WHEN event_mask & 4 <> 0 THEN 'CONTINUATION' END, CASE WHEN event_mask & 8 <> 0 THEN 'BIRTH' END], lambda v: v IS NOT NULL), '|') AS events FROM ev""")
def merger_events(spark, sf_dir):
    return mergertree.interval_events(memberships(spark, sf_dir), MATCH).withColumn("events", expr.event_names(F.col("event_mask")))


@query(f"WITH {TREE_SQL} SELECT timestep, halo_tag FROM dead")
def merger_deaths(spark, sf_dir):
    return mergertree.deaths(memberships(spark, sf_dir), MATCH)


@query(f"""WITH {TREE_SQL} SELECT timestep, count(*) AS halos, count(*) FILTER (WHERE event_mask & 1 <> 0) AS splits, count(*) FILTER (WHERE event_mask & 2 <> 0) AS merges,
 count(*) FILTER (WHERE event_mask & 8 <> 0) AS births FROM ev GROUP BY timestep""")
def merger_counts(spark, sf_dir):
    has = lambda name: F.count_if(expr.is_event(F.col("event_mask"), name))
    return mergertree.interval_events(memberships(spark, sf_dir), MATCH).groupBy("timestep").agg(F.count("*").alias("halos"), has("SPLIT").alias("splits"), has("MERGE").alias("merges"), has("BIRTH").alias("births"))


@query(f"WITH {TREE_SQL} SELECT timestep, halo_tag, max_by(next_tag, (pct, -next_tag)) AS descendant FROM m GROUP BY 1, 2")
def main_descendant(spark, sf_dir):
    best = F.max_by("next_tag", F.struct("pct", (-F.col("next_tag")).alias("near"))).alias("descendant")
    return mergertree.matches(memberships(spark, sf_dir), MATCH).groupBy("timestep", "halo_tag").agg(best)


@query()
def merger_tree(spark, sf_dir):
    return mergertree.build_tree(memberships(spark, sf_dir), MATCH)[0]


@query()
def merger_tree_text(spark, sf_dir):
    return mergertree.text_lines(*mergertree.build_tree(memberships(spark, sf_dir), MATCH))


@query()
def merger_tree_counts(spark, sf_dir):
    return mergertree.tree_counts(mergertree.build_tree(memberships(spark, sf_dir), MATCH)[0])


@query()
def stream_merger_tree(spark, sf_dir):
    folder = shared_path(spark, "snapshots")
    for (step,) in sorted(memberships(spark, sf_dir).select("timestep").distinct().collect()):
        memberships(spark, sf_dir).filter(F.col("timestep") == step).select("timestep", "halo_tag", "id").coalesce(1).write.mode("append").parquet(folder)
    tracker = track_files(spark, folder, shared_path(spark, "stream"), MATCH)
    return mergertree._union(tracker.nodes).select("node_id", "timestep", F.col("tag").alias("halo_tag"), "zombie", "age", "event_mask")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value),4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    return windowed_counts(table(spark, sf_dir, "events"))


@query(f"WITH {POINTS_SQL} SELECT okey, lnum, CAST(floor(x/20.0) AS BIGINT) AS block_x, CAST(floor(y/4.0) AS BIGINT) AS block_y, CAST(floor(z/4.0) AS BIGINT) AS block_z FROM points")
def block_ownership(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.select("okey", "lnum", F.floor(F.col("x") / 20.0).alias("block_x"), F.floor(F.col("y") / 4.0).alias("block_y"), F.floor(F.col("z") / 4.0).alias("block_z"))


GHOST_SQL = f"""{PARTICLES_SQL}, s AS (SELECT id, x+0.5 AS x, y+0.5 AS y, z+0.5 AS z FROM particles),
w AS (SELECT id, x, y, z, least(CAST(floor(x/0.5) AS INTEGER),1) AS ox, least(CAST(floor(y/0.5) AS INTEGER),1) AS oy, least(CAST(floor(z/0.5) AS INTEGER),1) AS oz FROM s),
d AS (SELECT CAST(a AS INTEGER) AS dx, CAST(b AS INTEGER) AS dy, CAST(c AS INTEGER) AS dz FROM range(-1,2) t(a), range(-1,2) u(b), range(-1,2) v(c) WHERE NOT (a = 0 AND b = 0 AND c = 0))"""


def _ghost_axis(a: str) -> str:
    return f"(d{a} = 0 OR (d{a} < 0 AND {a} <= o{a}*0.5+0.1) OR (d{a} > 0 AND {a} >= o{a}*0.5+0.5-0.1))"


def _moved(a: str) -> str:
    return f"round({a} + CASE WHEN o{a}+d{a} < 0 THEN 1.0 WHEN o{a}+d{a} >= 2 THEN -1.0 ELSE 0.0 END, 6) AS {a}"


@query(f"WITH {GHOST_SQL} SELECT id, {', '.join(f'((o{a}+d{a}+2)%2) AS ghost_{a}' for a in 'xyz')}, {', '.join(map(_moved, 'xyz'))} FROM w, d WHERE {' AND '.join(map(_ghost_axis, 'xyz'))}")
def ghost_exchange(spark, sf_dir):
    moved = particles(spark, sf_dir).select("id", *((F.col(a) + 0.5).alias(a) for a in "xyz"))
    return spatial.ghost_exchange(moved, 1.0, 2, 0.1).select("id", *(f"ghost_{a}" for a in "xyz"), *(F.round(a, 6).alias(a) for a in "xyz"))


@query(f"""WITH {PARTICLES_SQL}, s AS (SELECT id, x+0.5+0.05*vx AS x FROM particles), h AS (SELECT id, CASE WHEN x >= 1.0 THEN x-1.0 ELSE x END AS x FROM s)
SELECT CAST(floor(x/0.25) AS BIGINT) AS block, count(*) AS n FROM h WHERE x >= 0 GROUP BY 1""")
def rehoming(spark, sf_dir):
    moved = particles(spark, sf_dir).select("id", (F.col("x") + 0.5 + F.lit(0.05) * F.col("vx")).alias("x"))
    return moved.select(expr.wrap(F.col("x"), 1.0).alias("x")).filter("x >= 0").groupBy(F.floor(F.col("x") / 0.25).alias("block")).agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT i, i%6 AS ix, (i//6)%6 AS iy, i//36 AS iz FROM range(216) t(i)), d AS (SELECT unnest([-1,1]) AS d)
SELECT a.i AS cell, axis, d AS side, b.i AS neighbour FROM g a, d, (SELECT unnest(['x','y','z']) AS axis) x, g b
WHERE b.ix = CASE WHEN axis='x' THEN (a.ix+d+6)%6 ELSE a.ix END AND b.iy = CASE WHEN axis='y' THEN (a.iy+d+6)%6 ELSE a.iy END AND b.iz = CASE WHEN axis='z' THEN (a.iz+d+6)%6 ELSE a.iz END""")
def grid_exchange(spark, sf_dir):
    n = 6
    g = spark.range(n**3).select(F.col("id").alias("cell"), (F.col("id") % n).alias("ix"), (F.expr(f"id div {n}") % n).alias("iy"), F.expr(f"id div {n * n}").alias("iz"))
    sent = g.withColumn("side", F.explode(F.array(F.lit(-1), F.lit(1)))).withColumn("axis", F.explode(F.array(*map(F.lit, "xyz"))))
    at = [F.pmod(F.col(f"i{a}") + F.when(F.col("axis") == a, F.col("side")).otherwise(0), F.lit(n)) for a in "xyz"]
    return sent.select("cell", "axis", "side", expr.grid_index(*at, n, n).alias("neighbour"))


@query("WITH s AS (SELECT i AS step FROM range(0, 20) t(i)) SELECT step, round(power(power(1/201.0, 0.8)+(step+1)*((1.0-power(1/201.0, 0.8))/20), -1/0.8)-1, 6) AS redshift FROM s")
def redshift_schedule(spark, sf_dir):
    s = spark.range(20).select(F.col("id").alias("step"))
    return s.select("step", F.round(expr.redshift(F.col("step"), 200.0, 0.0, 20, 0.8), 6).alias("redshift"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 25 THEN l_quantity-25 ELSE l_quantity END AS wrapped, l_quantity*0.71 AS scaled, CASE WHEN l_quantity = 1.0 THEN 2.5 ELSE l_quantity END AS mass FROM lineitem")
def wrap_and_convert(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", expr.wrap(q, 25.0).alias("wrapped"), (q * F.lit(0.71)).alias("scaled"), F.when(q == 1.0, 2.5).otherwise(q).alias("mass"))


@query("""SELECT event_id, upper(trim(event_type)) IN ('YES','TRUE','ON','ENABLED') AS yes, event_id%7 = 0 AS by_frequency, event_id IN (1,5,9) AS by_list,
 CASE WHEN event_id%2=0 THEN 3 ELSE 12 END | 16 AS set_mask, (CASE WHEN event_id%2=0 THEN 3 ELSE 12 END) & ~4 AS unset_mask FROM events""")
def triggers_and_bits(spark, sf_dir):
    e, mask = table(spark, sf_dir, "events"), F.when(F.col("event_id") % 2 == 0, 3).otherwise(12)
    return e.select("event_id", expr.parse_yes(F.col("event_type")).alias("yes"), expr.triggered(F.col("event_id"), every=7).alias("by_frequency"), expr.triggered(F.col("event_id"), [1, 5, 9]).alias("by_list"), expr.set_event(mask, "DEATH").alias("set_mask"), expr.unset_event(mask, "CONTINUATION").alias("unset_mask"))


@query("""SELECT o_orderkey, list_sort(list_distinct(list_transform(list_filter(regexp_split_to_array(regexp_replace(o_orderkey || ' ' || o_custkey || '  ' || o_orderkey, 'x', ''), '\\s+'), lambda s: s <> ''), lambda s: CAST(s AS INTEGER))))::VARCHAR AS ints FROM orders""")
def int_lists(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    joined = F.concat(F.col("o_orderkey").cast("string"), F.lit(" "), F.col("o_custkey").cast("string"), F.lit("  "), F.col("o_orderkey").cast("string"))
    return o.select("o_orderkey", F.concat(F.lit("["), F.array_join(F.transform(expr.int_set(joined), lambda x: x.cast("string")), ", "), F.lit("]")).alias("ints"))


@query("SELECT DISTINCT CAST(year(l_shipdate)-1995 AS INTEGER) AS timestep FROM lineitem")
def analysis_timesteps(spark, sf_dir):
    return memberships(spark, sf_dir).select("timestep").distinct()


@query("""WITH a AS (SELECT l_suppkey AS tag, count(*) AS n FROM lineitem WHERE l_quantity > 49 GROUP BY 1), b AS (SELECT s_suppkey AS tag, s_acctbal AS mass FROM supplier WHERE s_acctbal > 0)
SELECT tag, n, mass FROM a FULL JOIN b USING (tag)""")
def halo_lookup_or_create(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").groupBy(F.col("l_suppkey").alias("tag")).agg(F.count("*").alias("n"))
    b = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("tag"), F.col("s_acctbal").alias("mass"))
    return a.join(b, "tag", "full")


CELLS, STRENGTH, GRID = 8, 2.5, 8
LATTICE_SQL = f"""nodes AS (SELECT i AS node_id, (i%{CELLS + 1})/{float(CELLS)} AS a, ((i//{CELLS + 1})%{CELLS + 1})/{float(CELLS)} AS b, (i//{(CELLS + 1) ** 2})/{float(CELLS)} AS c FROM range({(CELLS + 1) ** 3}) t(i)),
euler AS (SELECT node_id, a-{STRENGTH}*(a*(1-a)*(1-2*a))*(1.0+b) AS x, b-{STRENGTH}*(b*(1-b)*(1-2*b))*(1.0+c) AS y, c-{STRENGTH}*(c*(1-c)*(1-2*c))*(1.0+a) AS z FROM nodes)"""


def _pattern_sql(tets) -> str:
    node = lambda b: f"i+{b & 1}+{CELLS + 1}*(j+{b >> 1 & 1}+{CELLS + 1}*(k+{b >> 2 & 1}))"
    return "[" + ", ".join("[" + ", ".join(node(b) for b in probe._positive(t)) + "]" for t in tets) + "]"


TET_SQL = f"""v AS (SELECT q AS voxel, q%{CELLS} AS i, (q//{CELLS})%{CELLS} AS j, q//{CELLS * CELLS} AS k FROM range({CELLS**3}) t(q)),
l AS (SELECT voxel, CASE WHEN (i+j+k)%2=0 THEN {_pattern_sql(probe.EVEN_TETS)} ELSE {_pattern_sql(probe.ODD_TETS)} END AS t FROM v),
tets AS (SELECT voxel*5+s-1 AS tet_id, t[s][1] AS n0, t[s][2] AS n1, t[s][3] AS n2, t[s][4] AS n3 FROM l, range(1,6) u(s))"""


#: Names of a tetrahedron's corners in SQL.
CORNERS = ["ca", "cb", "cc", "cd"]


def _det_sql(p: list[str]) -> str:
    e = [[f"({q}{a}-{p[0]}{a})" for a in "xyz"] for q in p[1:]]
    a, b, c = e
    return f"({a[0]}*({b[1]}*{c[2]}-{b[2]}*{c[1]})+{a[1]}*({b[2]}*{c[0]}-{b[0]}*{c[2]})+{a[2]}*({b[0]}*{c[1]}-{b[1]}*{c[0]}))"


PLACED_SQL = f"""{LATTICE_SQL}, {TET_SQL}, placed AS (SELECT *, {_det_sql(CORNERS)}/6 AS volume FROM (SELECT t.*, {', '.join(f'p{s}.{a} AS {n}{a}' for s, n in enumerate(CORNERS) for a in 'xyz')}
 FROM tets t {' '.join(f'JOIN euler p{s} ON p{s}.node_id = t.n{s}' for s in range(4))}))"""
FACE_SQL = "faces AS (SELECT tet_id, volume, list_sort(f) AS f FROM (SELECT tet_id, volume, unnest([[n1,n2,n3],[n0,n2,n3],[n0,n1,n3],[n0,n1,n2]]) AS f FROM placed))"


def _placed(spark):
    return probe.placed(probe.tetrahedra(spark, CELLS), probe.displaced(probe.lattice(spark, CELLS), CELLS, STRENGTH))


@query(f"WITH {TET_SQL} SELECT tet_id, n0, n1, n2, n3 FROM tets")
def tet_tessellation(spark, sf_dir):
    return probe.tetrahedra(spark, CELLS)


@query(f"WITH {PLACED_SQL} SELECT tet_id, round(volume*1e6,3) AS volume FROM placed")
def euler_mesh(spark, sf_dir):
    return _placed(spark).select("tet_id", F.round(F.col("volume") * 1e6, 3).alias("volume"))


@query(f"WITH {PLACED_SQL}, {FACE_SQL} SELECT f[1] AS a, f[2] AS b, f[3] AS c FROM faces GROUP BY f HAVING count(*) = 2 AND min(volume) < 0 AND max(volume) > 0")
def caustic_faces(spark, sf_dir):
    return probe.caustics(_placed(spark))


@query(f"WITH {PLACED_SQL}, {FACE_SQL} SELECT min(tet_id) AS tet_id, max(tet_id) AS other FROM faces GROUP BY f HAVING count(*) = 2")
def face_adjacency(spark, sf_dir):
    return probe.adjacency(probe.tetrahedra(spark, CELLS))


@query(f"""WITH {TET_SQL} SELECT tet_id, n0, n1, n2, n3 FROM tets WHERE {' AND '.join(f'{part} >= 1 AND {part} <= {CELLS - 1}' for s in range(4) for part in (f'(n{s}%{CELLS + 1})', f'((n{s}//{CELLS + 1})%{CELLS + 1})', f'(n{s}//{(CELLS + 1) ** 2})'))}""")
def fringe_tets(spark, sf_dir):
    return probe.inside_fringe(probe.tetrahedra(spark, CELLS), CELLS, 1)


_INSIDE = " AND ".join(f"{_det_sql(CORNERS)}*{_det_sql([('q.' if t == s else n) for t, n in enumerate(CORNERS)])} > 0" for s in range(4))
_BOUNDS = " AND ".join(f"q.{a} BETWEEN least({', '.join(c + a for c in CORNERS)}) AND greatest({', '.join(c + a for c in CORNERS)})" for a in "xyz")


@query(f"""WITH {PLACED_SQL}, q AS (SELECT i AS point_id, (i%{GRID}+0.5)/{GRID} AS x, ((i//{GRID})%{GRID}+0.5)/{GRID} AS y, (i//{GRID * GRID}+0.5)/{GRID} AS z FROM range({GRID**3}) t(i)),
hit AS (SELECT q.point_id, volume FROM q JOIN placed ON {_BOUNDS} WHERE {_INSIDE})
SELECT q.point_id, count(h.point_id) AS streams, round(coalesce(avg(abs(volume)),0)*1e6,3) AS rho FROM q LEFT JOIN hit h ON h.point_id = q.point_id GROUP BY 1""")
def probe_grid(spark, sf_dir):
    out = probe.probe(probe.probe_grid(spark, GRID), _placed(spark), 1 / 8)
    return out.select("point_id", "streams", F.round(F.col("rho") * 1e6, 3).alias("rho"))


@query("SELECT p_partkey AS id, p_retailprice AS volume, CAST(p_size AS DOUBLE) AS area FROM part WHERE p_size BETWEEN 10 AND 30 AND p_retailprice BETWEEN 1000 AND 1500")
def voronoi_cell_filter(spark, sf_dir):
    cells = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("volume"), F.col("p_size").cast("double").alias("area"))
    return voronoi.cell_filter(cells, (10, 30), (1000, 1500))


@query("SELECT count(*) AS cells, round(avg(p_retailprice),4) AS avg_volume, min(p_retailprice) AS min_volume, max(p_retailprice) AS max_volume, round(min(1/p_retailprice),9) AS min_density, round(max(1/p_retailprice),9) AS max_density, round(avg(1/p_retailprice),9) AS avg_density FROM part WHERE p_retailprice > 0")
def voronoi_summary(spark, sf_dir):
    s = voronoi.summary(table(spark, sf_dir, "part").filter("p_retailprice > 0").select(F.col("p_retailprice").alias("volume")))
    return s.select("cells", F.round("avg_volume", 4).alias("avg_volume"), "min_volume", "max_volume", *(F.round(c, 9).alias(c) for c in ("min_density", "max_density", "avg_density")))


@query("""WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) SELECT CAST(least(floor((l_extendedprice-lo)/((hi-lo)/50)),49) AS INTEGER) AS bin, count(*) AS n FROM lineitem, s GROUP BY 1""")
def volume_histogram(spark, sf_dir):
    return voronoi.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 50)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT n_nationkey AS a, n_nationkey+5 AS b FROM nation WHERE n_nationkey+5 < 25), l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT n_nationkey AS id, n_nationkey AS root FROM nation UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id), t AS (SELECT id, min(root) AS root FROM r GROUP BY id),
v AS (SELECT s_nationkey AS id, round(sum(s_acctbal),2) AS volume FROM supplier GROUP BY 1) SELECT CAST(root AS BIGINT) AS region_id, count(*) AS cells, round(sum(volume),2) AS volume FROM v JOIN t USING (id) GROUP BY 1""")
def region_merge(spark, sf_dir):
    n = table(spark, sf_dir, "nation").filter("n_nationkey + 5 < 25").select(F.col("n_nationkey").cast("long").alias("a"), (F.col("n_nationkey") + 5).cast("long").alias("b"))
    v = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("id")).agg(F.round(F.sum("s_acctbal"), 2).alias("volume"))
    return voronoi.regions(n, v).select("region_id", "cells", F.round("volume", 2).alias("volume"))


@query("WITH c AS (SELECT n_regionkey AS block, count(*) AS n FROM nation GROUP BY 1) SELECT block, n, CAST(coalesce(sum(n) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) AS first_id FROM c")
def region_ids(spark, sf_dir):
    return voronoi.region_offsets(table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("block")).agg(F.count("*").alias("n")))


@query(f"WITH {PLACED_SQL}, {FACE_SQL} SELECT f[1] AS a, f[2] AS b, f[3] AS c FROM faces GROUP BY f HAVING count(*) = 1")
def boundary_faces(spark, sf_dir):
    return voronoi.boundary_faces(probe.faces(probe.tetrahedra(spark, CELLS)), ["a", "b", "c"])


@query("""WITH q AS (SELECT p_partkey AS id, 6.0+p_size AS s, p_retailprice/997.0 AS v, 9.13+1.07*p_size AS c, 2 AS x FROM part), g AS (SELECT *, 1-x/2.0 AS g, 3*v/s AS t, s/c AS b, c/(4*pi()*(2-x/2.0)) AS l FROM q)
SELECT id, round(g,6) AS g, round(t,6) AS t, round(b,6) AS b, round(l,6) AS l, round((b-t)/(b+t),6) AS p, round((l-b)/(l+b),6) AS f FROM g""")
def shapefinders(spark, sf_dir):
    q = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.lit(6.0) + F.col("p_size")).alias("s"), (F.col("p_retailprice") / 997.0).alias("v"), (F.lit(9.13) + F.lit(1.07) * F.col("p_size")).alias("c"), F.lit(2).alias("x"))
    return rounded(voronoi.shapefinders(q).select("id", "g", "t", "b", "l", "p", "f"))


def _unit(spark, sf_dir):
    return particles(spark, sf_dir).select("id", *((F.col(a) + 0.5).alias(a) for a in "xyz")).filter("x >= 0 AND y >= 0 AND z >= 0 AND x < 1 AND y < 1 AND z < 1")


@query()
def voronoi_cells(spark, sf_dir):
    return voronoi.cells(_unit(spark, sf_dir), 1.0, 2, 0.25)


@query()
def voronoi_density(spark, sf_dir):
    return voronoi.deposit(voronoi.cells(_unit(spark, sf_dir), 1.0, 2, 0.25), 16, 1.0)


@query()
def minkowski_functionals(spark, sf_dir):
    return voronoi.shapefinders(voronoi.minkowski(voronoi.cells(_unit(spark, sf_dir), 1.0, 2, 0.25).filter("complete")))


@query(f"""WITH RECURSIVE {FOF_SQL}, d AS (SELECT a.id, b.id AS other, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) AS d2 FROM own a JOIN own b ON a.halo_tag = b.halo_tag AND a.id <> b.id),
k AS (SELECT id, other, sqrt(d2) AS r FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY d2, other) <= 8), h AS (SELECT id, max(r) AS h FROM k GROUP BY id)
SELECT id, round(h,6) AS h, round(sum(CASE WHEN r/h <= 0.5 THEN 1-6*(r/h)*(r/h)+6*(r/h)*(r/h)*(r/h) WHEN r/h <= 1 THEN 2*(1-r/h)*(1-r/h)*(1-r/h) ELSE 0 END*8/(pi()*h*h*h)),1) AS density FROM k JOIN h USING (id) WHERE h > 0 GROUP BY id, h""")
def knn_density(spark, sf_dir):
    return halos.smoothed_density(_own(spark, sf_dir), 8).select("id", F.round("h", 6).alias("h"), F.round("density", 1).alias("density"))


@query()
def subhalos(spark, sf_dir):
    return subhalo.subhalos(_own(spark, sf_dir), gravity=subhalo.GRAVITY)


@query()
def subhalo_properties(spark, sf_dir):
    own = _own(spark, sf_dir)
    return subhalo.properties(subhalo.subhalos(own, gravity=subhalo.GRAVITY), own)


@query(f"WITH {PARTICLES_SQL} SELECT id, round(x,5) AS x, round(vz,5) AS vz, mass FROM particles")
def record_roundtrip(spark, sf_dir):
    folder = shared_path(spark, "records")
    make_folder(folder)
    snapshots.write_records(particles(spark, sf_dir), folder).count()
    snapshots.register(spark)
    back = spark.read.format("particle_records").option("path", folder).load()
    return back.select("id", F.round("x", 5).alias("x"), F.round("vz", 5).alias("vz"), "mass")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey*7+l_linenumber)%10 < 3")
def sampled_particles(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").filter((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 10 < 3).select("l_orderkey", "l_linenumber")


@query(f"WITH RECURSIVE {FOF_SQL}, c AS (SELECT halo_tag, count(*) AS n, sum(mass) AS m FROM own GROUP BY 1) SELECT halo_tag, halo_tag || ' ' || n || ' ' || CAST(CAST(m AS BIGINT) AS VARCHAR) AS line FROM c")
def halo_text_lines(spark, sf_dir):
    c = halos.properties(_own(spark, sf_dir))
    return c.select("halo_tag", F.concat_ws(" ", F.col("halo_tag").cast("string"), F.col("fof_halo_count").cast("string"), F.col("fof_halo_mass").cast("long").cast("string")).alias("line"))


@query("SELECT l_suppkey AS halo_tag, l_linenumber AS bin, CAST(sum(count(*)) OVER (PARTITION BY l_suppkey ORDER BY l_linenumber) AS BIGINT) AS up_to FROM lineitem GROUP BY 1, 2")
def cumulative_counts(spark, sf_dir):
    up = Window.partitionBy("halo_tag").orderBy("bin")
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("halo_tag"), F.col("l_linenumber").alias("bin")).agg(F.count("*").alias("n"))
    return g.select("halo_tag", "bin", F.sum("n").over(up).alias("up_to"))
