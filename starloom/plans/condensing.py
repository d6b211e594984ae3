"""Queries that condense and compare inside catalogs: J5-J8, J12, J13, A5, A6."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.operators import condensing as C
from starloom.operators import histograms as H
from starloom.operators import neighbours as N
from starloom.plans.oracle import bin_rows, nudged, query, rounded, sql
from starloom.sources.fixtures import detections, table, truth

LINK = 0.75
PAIRS = """
n AS (SELECT field_id, sample_id, sample_id * 2147483648 + src AS id, x, y, f0, CAST(FLOOR(x/0.75e0) AS BIGINT) AS cx,
  CAST(FLOOR(y/0.75e0) AS BIGINT) AS cy FROM det),
off AS (SELECT * FROM (VALUES (-1),(0),(1)) a(ox), (VALUES (-1),(0),(1)) b(oy)),
nb AS (SELECT n.*, cx + ox AS bx, cy + oy AS by_ FROM n, off),
fp AS (SELECT a.field_id, a.id AS i, b.id AS j, a.sample_id AS si, b.sample_id AS sj, a.f0 <> b.f0 AS differs,
  (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) AS d2 FROM n a JOIN nb b ON a.field_id = b.field_id AND a.cx = b.bx AND a.cy = b.by_
  AND a.id < b.id AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 0.75e0*0.75e0)"""


@query("j5_friend_graph", sql(f"""
WITH {PAIRS} SELECT field_id, i, j, ROUND(d2, 9) AS d2 FROM fp WHERE differs""", "det"))
def j5_friend_graph(spark, sf):
    return rounded(C.friend_graph(C.stacked(detections(spark, sf, True)), LINK), 9, "d2")


# Pruned edges: in each other sample the nearest partner only, and both ends agree.
PRUNED = PAIRS.replace("fp AS (", "fp AS MATERIALIZED (").replace("n AS (", "n AS MATERIALIZED (") + """,
dr AS (SELECT field_id, i, sj AS s, d2, j FROM fp WHERE si <> sj UNION ALL SELECT field_id, j, si, d2, i FROM fp WHERE si <> sj),
best AS MATERIALIZED (SELECT field_id, i, s, MIN({'d': d2, 'j': j}) AS b, COUNT(*) AS c FROM dr GROUP BY 1, 2, 3),
chosen AS (SELECT field_id, i, b.j AS j, b.d AS d2 FROM best WHERE c = 1 OR b.d < 0.75e0*0.75e0),
pruned AS MATERIALIZED (SELECT field_id, i, j, d2 FROM fp WHERE differs AND si = sj
 UNION ALL SELECT f.field_id, f.i, f.j, f.d2 FROM fp f JOIN chosen a ON f.field_id = a.field_id AND f.i = a.i AND f.j = a.j
  JOIN chosen b ON f.field_id = b.field_id AND f.j = b.i AND f.i = b.j WHERE f.differs AND f.si <> f.sj)"""


@query("j6_prune_edges", sql(f"WITH {PRUNED} SELECT field_id, i, j, ROUND(d2, 9) AS d2 FROM pruned", "det"))
def j6_prune_edges(spark, sf):
    return rounded(C.pruned_edges(C.stacked(detections(spark, sf, True)), LINK), 9, "d2")


# Seeds by rounds: a node that is highest within two hops is picked before anything near it changes.
SEEDS = PRUNED + """,
rounds AS (SELECT 0 AS it, field_id, i, j, CAST(NULL AS BIGINT) AS deg FROM (SELECT field_id, i, j FROM pruned UNION ALL SELECT field_id, j, i FROM pruned) e
 UNION ALL
 SELECT u.it, u.field_id, u.i, u.j, u.deg FROM (
  WITH alive AS (SELECT * FROM rounds WHERE deg IS NULL),
  deg AS (SELECT it, field_id, i, {'d': COUNT(*), 'i': i} AS own FROM alive GROUP BY it, field_id, i),
  one AS (SELECT a.field_id, a.i, MAX(d.own) AS top FROM alive a JOIN deg d ON a.field_id = d.field_id AND a.j = d.i GROUP BY 1, 2),
  two AS (SELECT a.field_id, a.i, MAX(o.top) AS top FROM alive a JOIN one o ON a.field_id = o.field_id AND a.j = o.i GROUP BY 1, 2),
  win AS (SELECT d.it, d.field_id, d.i, d.own.d AS deg FROM deg d JOIN one o ON d.field_id = o.field_id AND d.i = o.i JOIN two t ON d.field_id = t.field_id AND d.i = t.i
   WHERE d.own >= o.top AND d.own >= t.top),
  gone AS (SELECT field_id, i FROM win UNION SELECT a.field_id, a.j FROM alive a JOIN win w ON a.field_id = w.field_id AND a.i = w.i)
  SELECT it + 1 AS it, field_id, i, CAST(NULL AS BIGINT) AS j, deg FROM win
  UNION ALL SELECT it + 1, field_id, i, i, -1 FROM gone g JOIN (SELECT MAX(it) AS it FROM alive) m ON true WHERE NOT EXISTS (SELECT 1 FROM win w WHERE w.field_id = g.field_id AND w.i = g.i)
  UNION ALL SELECT it + 1, field_id, i, j, deg FROM alive a WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.field_id = a.field_id AND g.i = a.i)
   AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.field_id = a.field_id AND g.i = a.j)) u),
seeds AS MATERIALIZED (SELECT n.field_id, n.id, n.x, n.y, COALESCE(r.deg, 0) AS degree FROM n LEFT JOIN (SELECT field_id, i, MAX(deg) AS deg FROM rounds WHERE deg IS NOT NULL GROUP BY 1, 2) r
 ON n.field_id = r.field_id AND n.id = r.i WHERE COALESCE(r.deg, 0) >= 0)"""


@query("j7_seed_catalog", sql(f"WITH RECURSIVE {SEEDS} SELECT field_id, id, ROUND(x, 9) AS x, ROUND(y, 9) AS y, degree FROM seeds", "det"))
def j7_seed_catalog(spark, sf):
    return rounded(C.seed_catalog(detections(spark, sf, True), LINK), 9, "x", "y")


# Claims with the true sources as seeds, brightest first.
TRUE_SEEDS = """
s AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY field_id ORDER BY f0 DESC, truth_id) AS prio FROM truth),"""
CLAIMS = TRUE_SEEDS + """
c0 AS (SELECT s.field_id, d.sample_id, s.truth_id, s.prio, LIST(d.src ORDER BY d.src) AS srcs FROM s JOIN det d
  ON s.field_id = d.field_id AND abs(s.x-d.x) <= 0.75e0 AND abs(s.y-d.y) <= 0.75e0
  AND (s.x-d.x)*(s.x-d.x)+(s.y-d.y)*(s.y-d.y) <= 0.75e0*0.75e0 GROUP BY 1, 2, 3, 4),
c AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY field_id, sample_id ORDER BY prio) AS step FROM c0),
rec AS (SELECT DISTINCT field_id, sample_id, CAST(0 AS BIGINT) AS step, CAST(NULL AS BIGINT) AS truth_id,
   CAST(NULL AS BIGINT) AS src, CAST([] AS BIGINT[]) AS taken FROM c
  UNION ALL
  SELECT r.field_id, r.sample_id, c.step, c.truth_id, list_filter(c.srcs, lambda v: NOT list_contains(r.taken, v))[1],
   list_concat(r.taken, list_filter(c.srcs, lambda v: NOT list_contains(r.taken, v))[1:1])
  FROM rec r JOIN c ON r.field_id = c.field_id AND r.sample_id = c.sample_id AND c.step = r.step + 1),
claims AS (SELECT field_id, sample_id, truth_id, src FROM rec WHERE src IS NOT NULL)"""


def _claims(spark, sf):
    seeds = truth(spark, sf)
    ens = detections(spark, sf, slots=True)
    return C.claim(seeds, ens, LINK, "truth_id", -F.floor("f0"), [F.desc("f0"), F.asc("truth_id")]), ens


@query("j8_claim", sql(f"WITH RECURSIVE {CLAIMS} SELECT * FROM claims", "truth", "det"))
def j8_claim(spark, sf):
    return _claims(spark, sf)[0]


def _condensed_sql(scale: str, claims: str = CLAIMS) -> str:
    cols = ["AVG(d.x) AS mx", "AVG(d.y) AS my", "COUNT(*) AS n"]
    out = []
    for c in ("x", "y", "f0", "f1", "f2"):
        cols += [f"QUANTILE_CONT(d.{c}, 0.16e0) AS lo_{c}", f"QUANTILE_CONT(d.{c}, 0.84e0) AS hi_{c}"]
        out.append(nudged(f"CASE WHEN n > 1 THEN {scale}*(hi_{c}-lo_{c}) ELSE 0e0 END", 6) + f" AS err_{c}")
    for b in ("f0", "f1", "f2"):
        cols.append(f"AVG(d.{b}) AS m_{b}")
        out.append(nudged(f"m_{b}", 6) + f" AS mean_{b}")
        out += [f"CASE WHEN n > 1 THEN {nudged(f'{end}_{b}', 6)} END AS {end}pct_{b}" for end in ("hi", "lo")]
    return f"""WITH RECURSIVE {claims}, ns AS (SELECT field_id, COUNT(DISTINCT sample_id) AS nsamp FROM det GROUP BY 1),
q AS (SELECT k.field_id, k.truth_id, {', '.join(cols)} FROM claims k JOIN det d ON k.field_id = d.field_id
 AND k.sample_id = d.sample_id AND k.src = d.src GROUP BY 1, 2)
SELECT q.field_id, q.truth_id, {nudged('mx', 6)} AS mean_x, {nudged('my', 6)} AS mean_y,
{nudged('n / CAST(nsamp AS DOUBLE)', 6)} AS confidence, {', '.join(out)} FROM q JOIN ns ON q.field_id = ns.field_id"""


@query("a5_condense", sql(_condensed_sql("0.5e0"), "truth", "det"))
def a5_condense(spark, sf):
    claims, ens = _claims(spark, sf)
    return rounded(C.condense(claims, ens, "truth_id", ("f0", "f1", "f2")), 6, nudge=True)


@query("a5_condense_full_width", sql(_condensed_sql("1e0"), "truth", "det"))
def a5_condense_full_width(spark, sf):
    claims, ens = _claims(spark, sf)
    return rounded(C.condense(claims, ens, "truth_id", ("f0", "f1", "f2"), err="full"), 6, nudge=True)


# The seeds of the ensemble itself, most friends first.
OWN_CLAIMS = SEEDS + """,
s AS (SELECT field_id, id AS truth_id, x, y, ROW_NUMBER() OVER (PARTITION BY field_id ORDER BY degree DESC, id DESC) AS prio FROM seeds WHERE degree > 0.1e0 * 30),""" + CLAIMS[len(TRUE_SEEDS):]


@query("a5_condensed_catalog", sql(_condensed_sql("0.5e0", OWN_CLAIMS).replace("SELECT q.field_id, q.truth_id,", "SELECT q.field_id, q.truth_id AS id,"), "det"))
def a5_condensed_catalog(spark, sf):
    """The whole way: friends, pruning, seeds, cut, claims, catalog."""
    ens = detections(spark, sf, slots=True)
    seeds = C.prevalence_cut(C.seed_catalog(ens, LINK), 0.1, 30)
    claims = C.claim(seeds, ens, LINK, "id", -F.col("degree"), [F.desc("degree"), F.desc("id")])
    return rounded(C.condense(claims, ens, "id", ("f0", "f1", "f2")), 6, nudge=True)


# Seeds given as a table: every part with the number of samples it is seen in.
SEEN = "sn AS (SELECT l_partkey AS id, COUNT(DISTINCT l_orderkey % 30) AS degree FROM lineitem GROUP BY 1)"


def _seen(spark, sf):
    return (
        table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), (F.col("l_orderkey") % 30).alias("s"))
        .distinct().groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    )


@query("a6_prevalence_cut", f"WITH {SEEN} SELECT id, degree FROM sn WHERE degree > 0.6e0 * 30")
def a6_prevalence_cut(spark, sf):
    return C.prevalence_cut(_seen(spark, sf), 0.6, 30)


PREV_EDGES = [0.0, 0.2, 0.4, 0.5, 0.55, 0.6, 0.65, 0.7, 0.8, 1.0]


@query("a6_prevalence_histogram", f"""WITH {SEEN}
SELECT b.bin, b.lo, b.hi, COUNT(sn.id) AS n FROM {bin_rows(PREV_EDGES)} b LEFT JOIN sn
ON degree / 30e0 >= b.lo AND (degree / 30e0 < b.hi OR (b.bin = 8 AND degree / 30e0 = b.hi)) GROUP BY 1, 2, 3""")
def a6_prevalence_histogram(spark, sf):
    prevalence = _seen(spark, sf).select((F.col("degree") / 30.0).alias("prevalence"))
    return H.histogram(prevalence, "prevalence", PREV_EDGES)


J12 = """
p AS (SELECT a.field_id, a.truth_id, a.f0 AS flux, b.truth_id AS neighbour, b.f0 AS nf,
  SQRT((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS dist,
  ROW_NUMBER() OVER (PARTITION BY a.field_id, a.truth_id ORDER BY b.f0 DESC, b.truth_id DESC) AS k
  FROM truth a JOIN truth b ON a.field_id = b.field_id AND a.truth_id <> b.truth_id AND abs(a.x-b.x) < 3e0 AND abs(a.y-b.y) < 3e0
  AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) < 9e0 AND (a.x <> b.x OR a.y <> b.y)),
q AS (SELECT field_id, truth_id, flux, neighbour, nf, dist, GREATEST(flux, nf) AS f1, LEAST(flux, nf) AS f2,
  (3e0/2.355e0)*(3e0/2.355e0) AS s2 FROM p WHERE k = 1)"""


@query("j12_brightest_neighbour", sql(f"""
WITH {J12} SELECT field_id, truth_id, ROUND(flux, 9) AS flux, neighbour, ROUND(nf, 9) AS neighbour_flux, ROUND(dist, 9) AS dist FROM q
""", "truth"))
def j12_brightest_neighbour(spark, sf):
    return rounded(N.brightest_neighbour(truth(spark, sf), 3.0), 9)


@query("j12_blend_odds", sql(f"""
WITH RECURSIVE {J12},
bi AS (SELECT 0 AS it, field_id, truth_id, dist AS d, f1, f2, s2, 0e0 AS lo, dist/2e0 AS hi FROM q UNION ALL
  SELECT it + 1, field_id, truth_id, d, f1, f2, s2,
   CASE WHEN f2*exp(-0.25e0*(d-(lo+hi)/2e0)*(d-(lo+hi)/2e0)/s2)*(d-(lo+hi)/2e0) > f1*exp(-0.25e0*(lo+hi)/2e0*(lo+hi)/2e0/s2)*(lo+hi)/2e0
    THEN (lo+hi)/2e0 ELSE lo END,
   CASE WHEN f2*exp(-0.25e0*(d-(lo+hi)/2e0)*(d-(lo+hi)/2e0)/s2)*(d-(lo+hi)/2e0) > f1*exp(-0.25e0*(lo+hi)/2e0*(lo+hi)/2e0/s2)*(lo+hi)/2e0
    THEN hi ELSE (lo+hi)/2e0 END FROM bi WHERE it < 50),
x AS (SELECT field_id, truth_id, d, f1, f2, s2, exp(-0.25e0*((lo+hi)/2e0)*((lo+hi)/2e0)/s2) AS e1,
  exp(-0.25e0*(d-(lo+hi)/2e0)*(d-(lo+hi)/2e0)/s2) AS e2, exp(-0.25e0*d*d/s2) AS e12 FROM bi WHERE it = 50),
g AS (SELECT *, f1*e1+f2*e2 AS bf FROM x),
l AS (SELECT *, 0.5e0*(bf*bf - 2e0*e1*bf*f1 + f1*f1 - 2e0*e2*bf*f2 + 2e0*e12*f1*f2 + f2*f2)/(4e0*pi()*s2*50e0) - 1.5e0 AS dl FROM g)
SELECT q.field_id, q.truth_id, q.neighbour, ROUND(bf, 6) AS best_flux, ROUND(dl, 6) + 0e0 AS dlogl, ROUND(1e0/(1e0+exp(-dl)), 6) AS p_two
FROM l JOIN q ON l.field_id = q.field_id AND l.truth_id = q.truth_id""", "truth"))
def j12_blend_odds(spark, sf):
    out = N.blend_odds(truth(spark, sf), 3.0, 3.0, 50.0, 1.0)
    return rounded(out.select("field_id", "truth_id", "neighbour", "best_flux", "dlogl", "p_two"), 6)


@query("j13_neighbour_weight", sql("""
WITH w AS (SELECT a.field_id, a.sample_id, a.src, SUM(exp(-((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))/(2e0*0.25e0))) AS w
 FROM det a JOIN det b ON a.field_id = b.field_id AND a.sample_id = b.sample_id AND a.src <> b.src
 AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 1.849e1 GROUP BY 1, 2, 3)
SELECT d.field_id, d.sample_id, d.src, ROUND(COALESCE(w.w, 0e0), 9) AS weight FROM det d LEFT JOIN w
ON d.field_id = w.field_id AND d.sample_id = w.sample_id AND d.src = w.src""", "det"))
def j13_neighbour_weight(spark, sf):
    return rounded(N.neighbour_weight(detections(spark, sf, slots=True), 0.5), 9)
