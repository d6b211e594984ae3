"""Queries that match catalogs: J1-J4, J14, J15, A2-A4, A19, A20, A23."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.operators import matching as M
from starloom.operators import summaries as S
from starloom.operators.bins import log_edges
from starloom.operators.filters import edge_mask
from starloom.plans.oracle import bin_case, bin_rows, query, rounded, sql
from starloom.sources import archives
from starloom.sources.fixtures import detections, pair_detections, truth

# Field size, margin, flux floor and match limits of the flagship comparison.
WIDTH, MARGIN, FMIN = 100.0, 2.0, 2.0
POS, FRAC = 1.0, 0.5
EDGES = log_edges(2.0, 100.0, 15)

MASK = "x > 2e0 AND x < 98e0 AND y > 2e0 AND y < 98e0 AND f0 > 2e0"
J3_BODY = """
j3 AS (SELECT field_id, sample_id, truth_id, f0, flux, flux - f0 AS error FROM (
  SELECT t.field_id, d.sample_id, t.truth_id, t.f0, d.f0 AS flux,
         ROW_NUMBER() OVER (PARTITION BY t.field_id, d.sample_id, t.truth_id
           ORDER BY (t.x-d.x)*(t.x-d.x)+(t.y-d.y)*(t.y-d.y), d.f0 DESC) AS rn
  FROM tm t JOIN det d ON t.field_id = d.field_id AND abs(t.x-d.x) < 1e0 AND abs(t.y-d.y) < 1e0
   AND (t.x-d.x)*(t.x-d.x)+(t.y-d.y)*(t.y-d.y) < 1e0 AND abs(d.f0-t.f0)/t.f0 < 0.5e0) q WHERE rn = 1)"""
TM = f"tm AS (SELECT * FROM truth WHERE {MASK})"
NS = "ns AS (SELECT field_id, COUNT(DISTINCT sample_id) AS nsamp FROM det GROUP BY field_id)"
PER_SOURCE = f"""{TM}, {J3_BODY}, {NS},
per AS (SELECT t.field_id, t.truth_id, t.f0, COALESCE(h.hits, 0) / CAST(ns.nsamp AS DOUBLE) AS completeness
  FROM tm t JOIN ns ON t.field_id = ns.field_id LEFT JOIN
  (SELECT field_id, truth_id, COUNT(*) AS hits FROM j3 GROUP BY 1, 2) h
  ON t.field_id = h.field_id AND t.truth_id = h.truth_id)"""


def masked_truth(spark, sf):
    return edge_mask(truth(spark, sf), WIDTH, WIDTH, MARGIN, FMIN)


def with_mag(df):
    return df.withColumn("mag", F.lit(-2.5) * F.log10("f0"))


@query("j1_associate", sql("""
WITH t AS (SELECT *, -2.5e0*log10(f0) AS mag FROM truth),
d AS (SELECT *, -2.5e0*log10(f0) AS mag, f1/f0 AS conf, f2/1e1 AS sig FROM det),
m AS (SELECT t.field_id, t.truth_id, MAX(d.conf) AS c, MIN(d.sig) AS s FROM t JOIN d
  ON t.field_id = d.field_id AND (t.x-d.x)*(t.x-d.x)+(t.y-d.y)*(t.y-d.y) <= 0.25e0 AND abs(t.mag-d.mag) < 0.1e0
  GROUP BY 1, 2)
SELECT t.field_id, t.truth_id, m.truth_id IS NOT NULL AS matched, ROUND(COALESCE(m.c, 0e0), 9) AS best_conf,
  ROUND(COALESCE(m.s, CAST('infinity' AS DOUBLE)), 9) AS best_sig
FROM t LEFT JOIN m ON t.field_id = m.field_id AND t.truth_id = m.truth_id""", "truth", "det"))
def j1_associate(spark, sf):
    dets = with_mag(detections(spark, sf)).withColumn("conf", F.col("f1") / F.col("f0")).withColumn(
        "sig", F.col("f2") / 10.0
    )
    out = M.associate(with_mag(truth(spark, sf)), dets, 0.5, dmag=0.1, conf="conf", sig="sig")
    return rounded(out, 9, "best_conf", "best_sig")


@query("j1_associate_fraction", sql("""
WITH m AS (SELECT DISTINCT t.field_id, t.truth_id FROM truth t JOIN det d
  ON t.field_id = d.field_id AND (t.x-d.x)*(t.x-d.x)+(t.y-d.y)*(t.y-d.y) <= 0.04e0 AND abs(t.f0-d.f0)/d.f0 < 0.05e0)
SELECT t.field_id, t.truth_id, m.truth_id IS NOT NULL AS matched
FROM truth t LEFT JOIN m ON t.field_id = m.field_id AND t.truth_id = m.truth_id""", "truth", "det"))
def j1_associate_fraction(spark, sf):
    return M.associate(truth(spark, sf), detections(spark, sf), 0.2, frac=0.05, value="f0")


@query("j2_completeness", sql(f"""
WITH {NS}, m AS (SELECT t.field_id, t.truth_id, COUNT(DISTINCT d.sample_id) AS hits FROM truth t JOIN det d
  ON t.field_id = d.field_id AND (t.x-d.x)*(t.x-d.x)+(t.y-d.y)*(t.y-d.y) <= 0.25e0
  AND abs(-2.5e0*log10(t.f0) + 2.5e0*log10(d.f0)) < 0.5e0 GROUP BY 1, 2)
SELECT t.field_id, t.truth_id, ROUND(COALESCE(m.hits, 0) / CAST(ns.nsamp AS DOUBLE), 9) AS completeness
FROM truth t JOIN ns ON t.field_id = ns.field_id LEFT JOIN m ON t.field_id = m.field_id AND t.truth_id = m.truth_id
""", "truth", "det"))
def j2_completeness(spark, sf):
    out = M.completeness(with_mag(truth(spark, sf)), with_mag(detections(spark, sf)), 0.5, dmag=0.5)
    return rounded(out.select("field_id", "truth_id", "completeness"), 9)


def three_bands(df):
    return df.withColumn("f1", F.col("f0") * 0.95).withColumn("f2", F.col("f0") * 1.15)


@query("j3_match_nearest", sql("""
WITH t AS (SELECT *, f0 * 0.95e0 AS f1, f0 * 1.15e0 AS f2 FROM truth),
p AS (SELECT t.field_id, d.sample_id, t.truth_id, (t.x-d.x)*(t.x-d.x)+(t.y-d.y)*(t.y-d.y) AS d2,
  t.f0 AS a0, t.f1 AS a1, t.f2 AS a2, d.f0, d.f1, d.f2
  FROM t JOIN det d ON t.field_id = d.field_id AND abs(t.x-d.x) < 1e0 AND abs(t.y-d.y) < 1e0
  AND (t.x-d.x)*(t.x-d.x)+(t.y-d.y)*(t.y-d.y) < 1e0),
b AS (SELECT field_id, sample_id, truth_id, d2, f0, f1, f2, 0 AS band, a0 AS true_flux, f0 AS flux FROM p
  UNION ALL SELECT field_id, sample_id, truth_id, d2, f0, f1, f2, 1, a1, f1 FROM p
  UNION ALL SELECT field_id, sample_id, truth_id, d2, f0, f1, f2, 2, a2, f2 FROM p),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY field_id, sample_id, truth_id, band ORDER BY d2, f0 DESC, f1, f2) AS rn
  FROM b WHERE abs(flux - true_flux) / true_flux < 0.5e0)
SELECT field_id, sample_id, truth_id, CAST(band AS BIGINT) AS band, ROUND(true_flux, 9) AS true_flux,
  ROUND(flux, 9) AS flux, ROUND(flux - true_flux, 9) + 0e0 AS error FROM r WHERE rn = 1""", "truth", "det"))
def j3_match_nearest(spark, sf):
    out = M.match_nearest(
        three_bands(truth(spark, sf)), detections(spark, sf), POS, FRAC, ("f0", "f1", "f2")
    )
    return rounded(out, 9)


J4_MATCH = """(SELECT DISTINCT d.field_id, d.sample_id, d.src FROM dm d JOIN tm t ON t.field_id = d.field_id
  AND abs(t.x-d.x) < 0.3e0 AND abs(t.y-d.y) < 0.3e0
  AND (t.x-d.x)*(t.x-d.x)+(t.y-d.y)*(t.y-d.y) < 0.3e0*0.3e0 AND abs(t.f0-d.f0)/d.f0 < 0.2e0)"""


def masked_detections(spark, sf, slots=False):
    return edge_mask(detections(spark, sf, slots), WIDTH, WIDTH, MARGIN, FMIN)


@query("j4_false_discoveries", sql(f"""
WITH {TM}, dm AS (SELECT * FROM det WHERE {MASK}), m AS {J4_MATCH}
SELECT d.field_id, d.sample_id, d.src, ROUND(d.f0, 9) AS f0 FROM dm d LEFT JOIN m
  ON d.field_id = m.field_id AND d.sample_id = m.sample_id AND d.src = m.src WHERE m.src IS NULL""", "truth", "det"))
def j4_false_discoveries(spark, sf):
    out = M.false_discoveries(masked_detections(spark, sf, True), masked_truth(spark, sf), 0.3, 0.2)
    return rounded(out.select("field_id", "sample_id", "src", "f0"), 9, "f0")


@query("a2_binned_completeness", sql(f"""
WITH {PER_SOURCE},
s AS (SELECT {bin_case('f0', EDGES)} AS bin, COUNT(*) AS n, AVG(completeness) AS c,
  STDDEV_POP(completeness) / SQRT(COUNT(*)) AS e FROM per GROUP BY 1)
SELECT b.bin, b.lo, b.hi, COALESCE(s.n, 0) AS n, ROUND(s.c, 9) AS completeness, ROUND(s.e, 9) AS error
FROM {bin_rows(EDGES)} b LEFT JOIN s ON b.bin = s.bin""", "truth", "det"))
def a2_binned_completeness(spark, sf):
    """The flagship: mask, match, and the completeness curve."""
    ref, ens = masked_truth(spark, sf), detections(spark, sf)
    per_source = M.match_completeness(ref, ens, M.match_nearest(ref, ens, POS, FRAC))
    return rounded(M.binned_completeness(per_source, EDGES), 9, "completeness", "error")


S1_SAMPLES = 31  # one more than detections have: the last one is empty


def _archived(spark, sf):
    """Detections written to archives, one per field, and parsed again."""
    tables = archives.parse_chain(archives.pack_chain(detections(spark, sf, slots=True), 3, S1_SAMPLES))
    field = F.col("field_id").cast("bigint")
    return tuple(t.withColumn("field_id", field) for t in (archives.as_ensemble(tables["sources"], 3), archives.as_samples(tables["samples"])))


@query("s1_archive_sources", sql("SELECT field_id, sample_id, src, x, y, f0, f1, f2 FROM det", "det"))
def s1_archive_sources(spark, sf):
    return _archived(spark, sf)[0]


@query("s1_archive_completeness", sql(f"""
WITH {PER_SOURCE}, p AS (SELECT f0, completeness * 30e0 / 31e0 AS completeness FROM per),
s AS (SELECT {bin_case('f0', EDGES)} AS bin, COUNT(*) AS n, AVG(completeness) AS c,
  STDDEV_POP(completeness) / SQRT(COUNT(*)) AS e FROM p GROUP BY 1)
SELECT b.bin, b.lo, b.hi, COALESCE(s.n, 0) AS n, ROUND(s.c, 9) AS completeness, ROUND(s.e, 9) AS error
FROM {bin_rows(EDGES)} b LEFT JOIN s ON b.bin = s.bin""", "truth", "det"))
def s1_archive_completeness(spark, sf):
    """From archives to the completeness curve; their empty sample counts."""
    ref, (ens, samples) = masked_truth(spark, sf), _archived(spark, sf)
    per_source = M.match_completeness(ref, ens, M.match_nearest(ref, ens, POS, FRAC), samples=samples)
    return rounded(M.binned_completeness(per_source, EDGES), 9, "completeness", "error")


@query("a3_binned_fdr", sql(f"""
WITH {TM}, dm AS (SELECT * FROM det WHERE {MASK}), m AS {J4_MATCH},
s AS (SELECT {bin_case('d.f0', EDGES)} AS bin, COUNT(*) AS n, COUNT(m.src) AS matched FROM dm d LEFT JOIN m
  ON d.field_id = m.field_id AND d.sample_id = m.sample_id AND d.src = m.src GROUP BY 1)
SELECT b.bin, b.lo, b.hi, COALESCE(s.n, 0) AS n, COALESCE(s.matched, 0) AS matched,
  ROUND(s.matched / CAST(s.n AS DOUBLE), 9) AS precision, ROUND(1e0 - s.matched / CAST(s.n AS DOUBLE), 9) AS fdr
FROM {bin_rows(EDGES)} b LEFT JOIN s ON b.bin = s.bin""", "truth", "det"))
def a3_binned_fdr(spark, sf):
    out = M.binned_fdr(masked_detections(spark, sf), masked_truth(spark, sf), 0.3, 0.2, EDGES)
    return rounded(out, 9, "precision", "fdr")


A4_PER = """e AS (SELECT field_id, truth_id, f0, COUNT(*) AS hits, MEDIAN(error) AS med, QUANTILE_CONT(error, 0.16e0) AS p16,
  QUANTILE_CONT(error, 0.84e0) AS p84, MEDIAN(flux) AS fmed, QUANTILE_CONT(flux, 0.16e0) AS f16,
  QUANTILE_CONT(flux, 0.84e0) AS f84 FROM j3 GROUP BY 1, 2, 3)"""


@query("a4_flux_error_summary", sql(f"""
WITH {TM}, {J3_BODY}, {A4_PER}
SELECT field_id, truth_id, 0::BIGINT AS band, hits, ROUND(med, 9) + 0e0 AS med_err, ROUND(p16, 9) + 0e0 AS p16_err,
  ROUND(p84, 9) + 0e0 AS p84_err, ROUND(fmed, 9) AS med_flux, ROUND(f16, 9) AS p16_flux, ROUND(f84, 9) AS p84_flux
FROM e""", "truth", "det"))
def a4_flux_error_summary(spark, sf):
    matches = M.match_nearest(masked_truth(spark, sf), detections(spark, sf), POS, FRAC)
    return rounded(S.flux_error_summary(matches).drop("true_flux"), 9)


@query("a4_bin_flux_errors", sql(f"""
WITH {TM}, {J3_BODY}, {A4_PER},
s AS (SELECT {bin_case('f0', EDGES)} AS bin, COUNT(*) AS n, MEDIAN(med) AS m, QUANTILE_CONT(med, 0.16e0) AS a,
  QUANTILE_CONT(med, 0.84e0) AS b FROM e GROUP BY 1)
SELECT 0::BIGINT AS band, bin, n, ROUND(m, 9) + 0e0 AS med_err, ROUND(a, 9) + 0e0 AS p16_err, ROUND(b, 9) + 0e0 AS p84_err
FROM s WHERE bin IS NOT NULL""", "truth", "det"))
def a4_bin_flux_errors(spark, sf):
    matches = M.match_nearest(masked_truth(spark, sf), detections(spark, sf), POS, FRAC)
    return rounded(S.bin_flux_errors(S.flux_error_summary(matches), EDGES), 9)


@query("a23_bin_bars", sql(f"""
WITH {TM}, {J3_BODY}, {A4_PER},
s AS (SELECT {bin_case('f0', EDGES)} AS bin, COUNT(*) AS n, MEDIAN(med) AS m, QUANTILE_CONT(med, 0.16e0) AS a,
  QUANTILE_CONT(med, 0.84e0) AS b FROM e GROUP BY 1)
SELECT b.bin, s.n, ROUND(SQRT(b.lo*b.hi), 9) AS centre, ROUND(SQRT(b.lo*b.hi) - b.lo, 9) AS x_lo,
  ROUND(b.hi - SQRT(b.lo*b.hi), 9) AS x_hi, ROUND((s.m - s.a)/SQRT(s.n), 9) AS y_lo, ROUND((s.b - s.m)/SQRT(s.n), 9) AS y_hi
FROM s JOIN {bin_rows(EDGES)} b ON s.bin = b.bin""", "truth", "det"))
def a23_bin_bars(spark, sf):
    matches = M.match_nearest(masked_truth(spark, sf), detections(spark, sf), POS, FRAC)
    binned = S.bin_flux_errors(S.flux_error_summary(matches), EDGES)
    return rounded(S.bin_bars(binned, EDGES), 9)


# Two sources, 0.3 px apart along x; the second is five times brighter.
SRC1, SRC2, FLUX1, FLUX2 = (0.0, 0.0), (0.3, 0.0), 250.0, 1250.0
J14 = """
p AS (SELECT *, x*x + y*y AS d1, (x-0.3e0)*(x-0.3e0) + y*y AS d2, COUNT(*) OVER (PARTITION BY cfg_id, sample_id) AS n FROM pairs),
r2 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY cfg_id, sample_id ORDER BY d2, det_id, f) AS k FROM p),
t2 AS (SELECT * FROM r2 WHERE k = 1 AND (n = 1 OR d2 < 4e0*(0.3e0*0.3e0))),
r1 AS (SELECT r.*, ROW_NUMBER() OVER (PARTITION BY r.cfg_id, r.sample_id ORDER BY r.d1, r.det_id, r.f) AS k1
  FROM r2 r LEFT JOIN t2 ON r.cfg_id = t2.cfg_id AND r.sample_id = t2.sample_id
  WHERE r.n > 1 AND (t2.det_id IS NULL OR r.det_id <> t2.det_id)),
t1 AS (SELECT * FROM r1 WHERE k1 = 1 AND d1 < 4e0*(0.3e0*0.3e0)),
g AS (SELECT DISTINCT cfg_id, sample_id, n FROM p),
j14 AS (SELECT g.cfg_id, g.sample_id, g.n, ABS(t1.x) AS dx1, ABS(t1.f-2.5e2)/2.5e2 AS df1, ABS(t2.x-0.3e0) AS dx2,
  ABS(t2.f-1.25e3)/1.25e3 AS df2 FROM g LEFT JOIN t1 ON g.cfg_id = t1.cfg_id AND g.sample_id = t1.sample_id
  LEFT JOIN t2 ON g.cfg_id = t2.cfg_id AND g.sample_id = t2.sample_id)"""


@query("j14_associate_pair", sql(f"""
WITH {J14} SELECT cfg_id, sample_id, n, ROUND(dx1, 9) AS dx1, ROUND(df1, 9) AS df1, ROUND(dx2, 9) AS dx2,
ROUND(df2, 9) AS df2 FROM j14""", "pairs"))
def j14_associate_pair(spark, sf):
    return rounded(M.associate_pair(pair_detections(spark, sf), SRC1, SRC2, FLUX1, FLUX2), 9)


@query("j15_recovery", sql(f"""
WITH t AS (SELECT *, f0 * 0.95e0 AS f1, f0 * 1.15e0 AS f2 FROM truth), {NS},
p AS (SELECT t.field_id, d.sample_id, t.truth_id, (t.x-d.x)*(t.x-d.x)+(t.y-d.y)*(t.y-d.y) AS d2,
  t.f0 AS a0, t.f1 AS a1, t.f2 AS a2, d.f0, d.f1, d.f2
  FROM t JOIN det d ON t.field_id = d.field_id AND abs(t.x-d.x) < 1e0 AND abs(t.y-d.y) < 1e0
  AND (t.x-d.x)*(t.x-d.x)+(t.y-d.y)*(t.y-d.y) < 1e0),
b AS (SELECT field_id, sample_id, truth_id, d2, f0, f1, f2, 0 AS band, a0 AS tf, f0 AS flux FROM p
  UNION ALL SELECT field_id, sample_id, truth_id, d2, f0, f1, f2, 1, a1, f1 FROM p
  UNION ALL SELECT field_id, sample_id, truth_id, d2, f0, f1, f2, 2, a2, f2 FROM p),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY field_id, sample_id, truth_id, band ORDER BY d2, f0 DESC, f1, f2) AS rn
  FROM b WHERE abs(flux - tf) / tf < 0.5e0),
h AS (SELECT field_id, truth_id, band, COUNT(*) AS hits, AVG((flux-tf)/tf) AS ferr FROM r WHERE rn = 1 GROUP BY 1, 2, 3),
inj AS (SELECT field_id, truth_id, 0 AS band, f0 AS f FROM t UNION ALL SELECT field_id, truth_id, 1, f1 FROM t
  UNION ALL SELECT field_id, truth_id, 2, f2 FROM t),
q AS (SELECT i.*, {bin_case('i.f', EDGES)} AS bin, h.hits, h.ferr, ns.nsamp FROM inj i JOIN ns ON i.field_id = ns.field_id
  LEFT JOIN h ON i.field_id = h.field_id AND i.truth_id = h.truth_id AND i.band = h.band)
SELECT CAST(band AS BIGINT) AS band, bin, COUNT(*) AS n, ROUND(AVG(COALESCE(hits, 0) / CAST(nsamp AS DOUBLE)), 9) AS prevalence,
  ROUND(AVG(ferr), 9) + 0e0 AS frac_error FROM q WHERE bin IS NOT NULL GROUP BY 1, 2""", "truth", "det"))
def j15_recovery(spark, sf):
    out = M.recovery(
        three_bands(truth(spark, sf)), detections(spark, sf), POS, FRAC, EDGES, ("f0", "f1", "f2")
    )
    return rounded(out, 9)


@query("a19_multiplicity", sql("""
WITH s AS (SELECT cfg_id, sample_id, COUNT(CASE WHEN x > -0.1e0 AND x < 0.4e0 AND y > -0.1e0 AND y < 0.1e0 THEN 1 END) AS k
  FROM pairs GROUP BY 1, 2),
c AS (SELECT cfg_id, 30 - COUNT(*) AS none, SUM(CASE WHEN k = 1 THEN 1 ELSE 0 END) AS one,
  SUM(CASE WHEN k = 2 THEN 1 ELSE 0 END) AS two, SUM(CASE WHEN k > 2 THEN 1 ELSE 0 END) AS more FROM s GROUP BY 1)
SELECT cfg_id, ROUND(one/3e1, 9) AS one, ROUND(two/3e1, 9) AS two, ROUND(more/3e1, 9) AS more FROM c""", "pairs"))
def a19_multiplicity(spark, sf):
    return rounded(S.multiplicity(pair_detections(spark, sf), (-0.1, 0.4, -0.1, 0.1), nsamp=30), 9)


@query("a20_error_panel", sql(f"""
WITH {J14},
q AS (SELECT cfg_id % 3 AS case_, cfg_id % 5 AS offset_, (cfg_id % 7) // 3 AS realization, df2 FROM j14 WHERE df2 IS NOT NULL),
m AS (SELECT case_, offset_, realization, AVG(df2) AS e FROM q GROUP BY 1, 2, 3),
grid_ AS (SELECT * FROM (VALUES (0),(1),(2)) c(case_), (VALUES (0),(1),(2),(3),(4),(5)) o(offset_))
SELECT CAST(g.case_ AS BIGINT) AS case_, CAST(g.offset_ AS BIGINT) AS offset_, ROUND(AVG(m.e), 9) AS mean_err,
  ROUND(COALESCE(STDDEV_POP(m.e), 0e0)/SQRT(3e1*3e0), 9) AS std_err
FROM grid_ g LEFT JOIN m ON g.case_ = m.case_ AND g.offset_ = m.offset_ GROUP BY 1, 2""", "pairs"))
def a20_error_panel(spark, sf):
    errors = M.associate_pair(pair_detections(spark, sf), SRC1, SRC2, FLUX1, FLUX2).where(
        F.col("df2").isNotNull()
    )
    k = F.col("cfg_id")
    per_run = (
        errors.select(
            (k % 3).alias("case_"), (k % 5).alias("offset_"),
            F.floor((k % 7) / 3.0).alias("realization"), "df2",
        )
        .groupBy("case_", "offset_", "realization")
        .agg(F.avg("df2").alias("err"))
    )
    out = S.error_panel(per_run, cases=range(3), offsets=range(6), nsamp=30, nreal=3)
    return rounded(out, 9)
