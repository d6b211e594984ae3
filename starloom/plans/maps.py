"""Queries over maps: S8, J9, J11, J16, A14, A17, A21, A25, A32, A33, A35, W5, G1-G11."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from starloom.functions import photometry as P
from starloom.operators import background as B
from starloom.operators import lookups as L
from starloom.operators import maps as G
from starloom.operators import matching as M
from starloom.operators import spectra as Z
from starloom.operators import summaries as S
from starloom.operators.quantiles import exact_quantiles
from starloom.plans.matching import FRAC, POS
from starloom.plans.oracle import bin_case, bin_rows, nudged, num, query, rounded, sql
from starloom.sources.fixtures import amplitudes, coefficients, detections, models, pixels, table, truth
from starloom.sources.pixels import assemble_pixels

SIDE = 32
PI = "pi()"


@query("s8_read_pixels", """
WITH o AS (SELECT CAST(FLOOR(o_orderkey / 1.024e3) AS BIGINT) AS map_id, CAST(FLOOR((o_orderkey % 1024) / 3.2e1) AS BIGINT) AS row_,
 (o_orderkey % 1024) % 32 AS col_, o_totalprice / 1e5 AS a, o_custkey / 1e3 AS b, o_custkey FROM orders)
SELECT map_id, row_, col_, ROUND(SUM(CASE WHEN o_custkey % 50 = 0 THEN 0e0 ELSE a END + CASE WHEN o_custkey % 20 = 1 THEN 0e0 ELSE b END), 9) AS image,
ROUND(SUM(0.5e0 * b), 9) AS error, CAST(1 AS BIGINT) AS mask FROM o GROUP BY 1, 2, 3""")
def s8_read_pixels(spark, sf):
    p, cust = F.col("o_orderkey") % 1024, F.col("o_custkey")
    nan = F.lit(float("nan"))
    planes = table(spark, sf, "orders").select(
        F.floor(F.col("o_orderkey") / 1.024e3).alias("map_id"), F.floor(p / 3.2e1).alias("row_"), (p % 32).alias("col_"),
        F.explode(F.create_map(
            F.lit("SIGNAL"), F.when(cust % 50 == 0, nan).otherwise(F.col("o_totalprice") / 1e5),
            F.lit("DUST"), F.when(cust % 20 == 1, nan).otherwise(cust / 1e3),
            F.lit("ERROR"), cust / 1e3 * 0.5,
        )).alias("plane", "value"),
    )
    return rounded(assemble_pixels(planes, ["SIGNAL", "DUST"]), 9, "image", "error")


def half_pixel_mapping(spark, sf):
    return pixels(spark, sf).select(
        "map_id", F.col("row_").alias("row2"), F.col("col_").alias("col2"),
        (F.col("col_") / 2.0 + F.col("image") / 1e2).alias("xp"), (F.col("row_") / 2.0 + F.col("error") / 1e1).alias("yp"),
    )


W5 = """
h AS (SELECT map_id, row_ AS r, col_ AS c, col_/2e0+image/1e2 AS xp, row_/2e0+error/1e1 AS yp FROM pix),
grid AS (SELECT a.map_id, a.r // 2 AS row_, a.c // 2 AS col_, a.xp - 0.25e0 AS xp, a.yp + 0.5e0 AS yp, e.xp-w.xp AS dxdx, e.yp-w.yp AS dydx,
 n.xp-s.xp AS dxdy, n.yp-s.yp AS dydy FROM h a JOIN h e ON e.map_id=a.map_id AND e.r=a.r AND e.c=a.c+1 JOIN h w ON w.map_id=a.map_id AND w.r=a.r AND w.c=a.c-1
 JOIN h n ON n.map_id=a.map_id AND n.c=a.c AND n.r=a.r+1 JOIN h s ON s.map_id=a.map_id AND s.c=a.c AND s.r=a.r-1 WHERE a.r % 2 = 0 AND a.c % 2 = 0)"""
_GRID_COLS = ", ".join(f"ROUND({c}, 9) + 0e0 AS {c}" for c in ("xp", "yp", "dxdx", "dydx", "dxdy", "dydy"))


@query("w5_astrometry_grid", sql(f"WITH {W5} SELECT map_id, row_, col_, {_GRID_COLS} FROM grid", "pix"))
def w5_astrometry_grid(spark, sf):
    return rounded(G.astrom_grid(half_pixel_mapping(spark, sf), shift_x=0.25, shift_y=-0.5), 9)


@query("j9_transform", sql(f"""
WITH {W5}, s AS (SELECT field_id AS map_id, sample_id, src, x/7.001e0 AS x, y/7.001e0 AS y FROM det)
SELECT s.map_id, s.sample_id, s.src, ROUND(g.xp+(s.x-g.col_)*g.dxdx+(s.y-g.row_)*g.dxdy, 9) + 0e0 AS x_new,
ROUND(g.yp+(s.x-g.col_)*g.dydx+(s.y-g.row_)*g.dydy, 9) + 0e0 AS y_new FROM s JOIN grid g ON g.map_id = s.map_id
AND g.row_ = CAST(FLOOR(s.y+0.5e0) AS BIGINT) AND g.col_ = CAST(FLOOR(s.x+0.5e0) AS BIGINT)""", "det", "pix"))
def j9_transform(spark, sf):
    grid = G.astrom_grid(half_pixel_mapping(spark, sf), shift_x=0.25, shift_y=-0.5)
    dets = detections(spark, sf, slots=True).select(
        F.col("field_id").alias("map_id"), "sample_id", "src", (F.col("x") / 7.001).alias("x"), (F.col("y") / 7.001).alias("y")
    )
    return rounded(L.transform(dets, grid).drop("x", "y"), 9)


def _smooth_sql(source: str, value: str, sigma: float, prefix: str = "") -> str:
    """Gather form of the smoothing: each target reads its reflected sources."""
    radius = int(4.0 * sigma + 0.5)
    n = num(SIDE)
    refl = lambda c: f"(CASE WHEN (({c} % 64) + 64) % 64 < 32 THEN (({c} % 64) + 64) % 64 ELSE 63 - (({c} % 64) + 64) % 64 END)"
    return f"""
{prefix}k0 AS (SELECT CAST(d AS BIGINT) AS d, exp(-0.5e0*d*d/({num(sigma)}*{num(sigma)})) AS g FROM (SELECT UNNEST(range({-radius}, {radius + 1})) AS d)),
{prefix}k AS (SELECT d, g / (SELECT SUM(g) FROM {prefix}k0) AS w FROM {prefix}k0),
{prefix}a AS (SELECT p.map_id, t.row_, p.col_, k.w, {refl('(t.row_ + k.d)')} AS rr FROM (SELECT DISTINCT map_id, col_ FROM {source}) p,
 (SELECT CAST(range AS BIGINT) AS row_ FROM range(32)) t, {prefix}k k),
{prefix}b AS (SELECT a.map_id, a.row_, a.col_, SUM(a.w * s.{value}) AS v FROM {prefix}a a JOIN {source} s ON s.map_id = a.map_id AND s.row_ = a.rr AND s.col_ = a.col_ GROUP BY 1, 2, 3),
{prefix}c AS (SELECT p.map_id, p.row_, p.col_, k.w, {refl('(p.col_ + k.d)')} AS cc FROM {source} p, {prefix}k k),
{prefix}s AS (SELECT c.map_id, c.row_, c.col_, SUM(c.w * b.v) AS v FROM {prefix}c c JOIN {prefix}b b ON b.map_id = c.map_id AND b.row_ = c.row_ AND b.col_ = c.cc GROUP BY 1, 2, 3)"""


@query("g3_smooth", sql(f"WITH {_smooth_sql('pix', 'image', 1.5)} SELECT map_id, row_, col_, ROUND(v, 9) AS image FROM s", "pix"))
def g3_smooth(spark, sf):
    return rounded(G.smooth(pixels(spark, sf), "image", 1.5, SIDE, SIDE), 9)


_S2 = "((3e0/2.355e0)*(3e0/2.355e0))"


@query("j11_degradation", sql(f"""
WITH o AS (SELECT map_id, row_, col_, SQRT(error*error/(4e0*{PI}*{_S2})) AS e FROM pix), {_smooth_sql('o', 'e', 5.0)},
m AS (SELECT * FROM (SELECT t.field_id, d.sample_id, t.truth_id, t.x, t.y, d.f0 AS flux,
  ROW_NUMBER() OVER (PARTITION BY t.field_id, d.sample_id, t.truth_id ORDER BY (t.x-d.x)*(t.x-d.x)+(t.y-d.y)*(t.y-d.y), d.f0 DESC) AS rn
  FROM truth t JOIN det d ON t.field_id = d.field_id AND abs(t.x-d.x) < 1e0 AND abs(t.y-d.y) < 1e0
   AND (t.x-d.x)*(t.x-d.x)+(t.y-d.y)*(t.y-d.y) < 1e0 AND abs(d.f0-t.f0)/t.f0 < 0.5e0) q WHERE rn = 1),
e AS (SELECT field_id, truth_id, x, y, 0.5e0*(QUANTILE_CONT(flux, 0.84e0)-QUANTILE_CONT(flux, 0.16e0)) AS err FROM m GROUP BY 1, 2, 3, 4)
SELECT e.field_id, e.truth_id, ROUND(e.err / s.v, 6) AS degradation FROM e JOIN s ON s.map_id = e.field_id
AND s.row_ = CAST(FLOOR(e.y) AS BIGINT) AND s.col_ = CAST(FLOOR(e.x) AS BIGINT)""", "truth", "det", "pix"))
def j11_degradation(spark, sf):
    ref = truth(spark, sf)
    summary = S.flux_error_summary(M.match_nearest(ref, detections(spark, sf), POS, FRAC))
    cond = summary.join(ref.select("field_id", "truth_id", "x", "y"), ["field_id", "truth_id"]).withColumn(
        "err", (F.col("p84_flux") - F.col("p16_flux")) * 0.5
    )
    optimal = pixels(spark, sf).withColumn("optimal", L.optimal_error(F.col("error"), 3.0))
    smoothed = G.smooth(optimal, "optimal", 5.0, SIDE, SIDE)
    return rounded(L.degradation(cond, smoothed, "err").select("field_id", "truth_id", "degradation"), 6, "degradation")


@query("j16_apply_templates", sql("""
WITH t AS (SELECT 0 AS tmpl, map_id % 3 AS band, map_id, row_, col_, image AS v FROM pix UNION ALL SELECT 1, map_id % 3, map_id, row_, col_, error FROM pix)
SELECT a.sample_id, a.band, t.map_id, t.row_, t.col_, ROUND(SUM(a.amp*t.v), 9) AS value FROM amps a JOIN t ON a.tmpl = t.tmpl AND a.band = t.band
GROUP BY 1, 2, 3, 4, 5""", "pix", "amps"))
def j16_apply_templates(spark, sf):
    planes = pixels(spark, sf).select(
        (F.col("map_id") % 3).alias("band"), "map_id", "row_", "col_", F.posexplode(F.array("image", "error")).alias("tmpl", "value")
    ).withColumn("tmpl", F.col("tmpl").cast("bigint"))
    return rounded(L.apply_templates(amplitudes(spark, sf), planes, (0, 1)), 9, "value")


WPIX = "w AS (SELECT *, CASE WHEN error > 0 THEN 1e0/(error*error) ELSE 0e0 END AS weight FROM pix)"


def weighted(spark, sf):
    # The image stays as it is where the weight is zero.
    return P.weights(pixels(spark, sf).withColumn("data", F.col("image"))).withColumn("image", F.col("data")).drop("data")


@query("a14_chi2", sql(f"""
WITH {WPIX} SELECT w.map_id, m.sample_id, ROUND(SUM(weight*(image-model)*(image-model)), 5) AS chi2, SUM(CASE WHEN weight > 0 THEN 1 ELSE 0 END)::BIGINT AS npix,
ROUND(SUM(weight*(image-model)*(image-model))/SUM(CASE WHEN weight > 0 THEN 1e0 ELSE 0e0 END), 7) AS reduced
FROM w JOIN models m ON w.map_id = m.map_id AND w.row_ = m.row_ AND w.col_ = m.col_ GROUP BY 1, 2""", "pix", "models"))
def a14_chi2(spark, sf):
    out = G.chi2(weighted(spark, sf), models(spark, sf))
    return rounded(rounded(out, 5, "chi2"), 7, "reduced")


@query("a14_chi2_tiles", sql(f"""
WITH {WPIX}, t AS (SELECT CAST(range AS BIGINT) AS t FROM range(5)),
x AS (SELECT w.*, a.t AS tile_y, b.t AS tile_x FROM w JOIN t a ON row_ >= a.t*8-1-2 AND row_ < (a.t+1)*8-1+2 JOIN t b ON col_ >= b.t*8-1-2 AND col_ < (b.t+1)*8-1+2)
SELECT x.map_id, m.sample_id, tile_y, tile_x, ROUND(SUM(weight*(image-model)*(image-model)), 5) AS chi2
FROM x JOIN models m ON x.map_id = m.map_id AND x.row_ = m.row_ AND x.col_ = m.col_ GROUP BY 1, 2, 3, 4""", "pix", "models"))
def a14_chi2_tiles(spark, sf):
    tiled = G.with_tiles(weighted(spark, sf), 8, 2, 5, off=1)
    out = G.chi2(tiled, models(spark, sf), by=["map_id", "sample_id", "tile_y", "tile_x"])
    return rounded(out.select("map_id", "sample_id", "tile_y", "tile_x", "chi2"), 5, "chi2")


@query("a14_best_chi2", sql(f"""
WITH {WPIX}, c AS (SELECT w.map_id, m.sample_id, SUM(weight*(image-model)*(image-model)) AS chi2
FROM w JOIN models m ON w.map_id = m.map_id AND w.row_ = m.row_ AND w.col_ = m.col_ GROUP BY 1, 2),
l AS (SELECT map_id, MAX(sample_id) AS last FROM c GROUP BY 1)
SELECT c.map_id, ROUND(MIN(chi2), 5) AS best FROM c JOIN l ON c.map_id = l.map_id WHERE sample_id >= FLOOR((last+1)*0.5e0) GROUP BY 1""", "pix", "models"))
def a14_best_chi2(spark, sf):
    return rounded(G.best_chi2(G.chi2(weighted(spark, sf), models(spark, sf)), 0.5), 5, "best")


@query("a14_gaussian_chi2", sql("""
SELECT truth_id, ROUND((4e0*x*x - 2e0*0.5e0*x*y + 9e0*y*y)/(9e0*4e0-0.5e0*0.5e0), 6) AS chi2 FROM truth""", "truth"))
def a14_gaussian_chi2(spark, sf):
    c = [F.lit(v) for v in (9.0, 0.5, 4.0)]
    return rounded(truth(spark, sf).select("truth_id", G.gaussian_chi2(F.col("x"), F.col("y"), *c).alias("chi2")), 6, "chi2")


@query("g2_residuals", sql(f"""
WITH {WPIX}, m AS (SELECT * FROM models WHERE sample_id = 3)
SELECT w.map_id, w.row_, w.col_, ROUND(image - COALESCE(model, 0e0), 9) + 0e0 AS resid, ROUND((image - COALESCE(model, 0e0))*SQRT(weight), 9) + 0e0 AS scaled
FROM w LEFT JOIN m ON w.map_id = m.map_id AND w.row_ = m.row_ AND w.col_ = m.col_""", "pix", "models"))
def g2_residuals(spark, sf):
    model = models(spark, sf).where(F.col("sample_id") == 3).drop("sample_id")
    out = G.residuals(weighted(spark, sf), model, "weight")
    return rounded(out.select("map_id", "row_", "col_", "resid", "scaled"), 9)


@query("a21_stack_maps", sql(f"""
SELECT map_id, row_, col_, {nudged('MEDIAN(model)', 9)} AS median, {nudged('AVG(model)', 9)} AS mean, {nudged('STDDEV_POP(model)', 9)} AS std
FROM models GROUP BY 1, 2, 3""", "models"))
def a21_stack_maps(spark, sf):
    return rounded(G.stack_maps(models(spark, sf)), 9, nudge=True)


@query("a21_observed_percentiles", sql("""
SELECT map_id, COUNT(*) AS n, ROUND(QUANTILE_CONT(image, 0.05e0), 9) AS p5, ROUND(QUANTILE_CONT(image, 0.95e0), 9) AS p95 FROM pix WHERE mask = 1 GROUP BY 1""", "pix"))
def a21_observed_percentiles(spark, sf):
    seen = pixels(spark, sf).where(F.col("mask") == 1)
    return rounded(exact_quantiles(seen, ["map_id"], "image", {"p5": 0.05, "p95": 0.95}), 9)


@query("a25_mask_bounds", sql("""
SELECT map_id, MIN(row_) AS row_lo, MAX(row_) AS row_hi, MIN(col_) AS col_lo, MAX(col_) AS col_hi FROM pix WHERE mask = 1 AND row_ > 3 AND col_ < 30 GROUP BY 1""", "pix"))
def a25_mask_bounds(spark, sf):
    return G.mask_bounds(pixels(spark, sf).where((F.col("row_") > 3) & (F.col("col_") < 30)))


NTERMS, PHASES, NC, W = 3, 4, 5, 100


def psf_table(spark):
    """Gaussian stencils of the 4 x 4 sub-pixel phases, 5 x 5 pixels each."""
    k = F.col("id")
    px, py = F.floor(k / 100.0), F.floor(k % 100 / 25.0)
    dr, dc = F.floor(k % 25 / 5.0) - 2, k % 5 - 2
    dx, dy = dc + (px + 0.5) / PHASES, dr + (py + 0.5) / PHASES
    return spark.range(PHASES * PHASES * NC * NC).select(
        px.alias("phase_x"), py.alias("phase_y"), dr.alias("drow"), dc.alias("dcol"), (F.exp(-(dx * dx + dy * dy) / 2.0) / 6.0).alias("w")
    )


@query("g1_render", sql("""
WITH psf AS (SELECT k // 100 AS px, k % 100 // 25 AS py, k % 25 // 5 - 2 AS dr, k % 5 - 2 AS dc,
 exp(-((k%5-2+(k//100+0.5e0)/4e0)*(k%5-2+(k//100+0.5e0)/4e0)+(k%25//5-2+(k%100//25+0.5e0)/4e0)*(k%25//5-2+(k%100//25+0.5e0)/4e0))/2e0)/6e0 AS w
 FROM (SELECT UNNEST(range(400)) AS k)),
s AS (SELECT field_id, sample_id, f0, f1, f2, CAST(CEIL(x) AS BIGINT) AS ix, CAST(CEIL(y) AS BIGINT) AS iy, LEAST(CAST(FLOOR((CEIL(x)-x)*4) AS BIGINT), 3) AS px,
 LEAST(CAST(FLOOR((CEIL(y)-y)*4) AS BIGINT), 3) AS py FROM det WHERE x > 0 AND x < 99 AND y > 0 AND y < 99),
st AS (SELECT field_id, sample_id, iy+dr AS row_, ix+dc AS col_, f0*w AS f0, f1*w AS f1, f2*w AS f2 FROM s JOIN psf ON s.px = psf.px AND s.py = psf.py),
g AS (SELECT field_id, sample_id, r.r AS row_, c.c AS col_ FROM (SELECT DISTINCT field_id, sample_id FROM det), (SELECT UNNEST(range(100)) AS r) r, (SELECT UNNEST(range(100)) AS c) c),
t AS (SELECT field_id, sample_id, row_, col_, SUM(f0) AS f0, SUM(f1) AS f1, SUM(f2) AS f2 FROM st GROUP BY 1, 2, 3, 4)
SELECT g.field_id, g.sample_id, g.row_, g.col_, ROUND(g.sample_id/1e2+COALESCE(t.f0, 0e0), 6) AS f0, ROUND(g.sample_id/1e2+COALESCE(t.f1, 0e0), 6) AS f1,
ROUND(g.sample_id/1e2+COALESCE(t.f2, 0e0), 6) AS f2 FROM g LEFT JOIN t ON g.field_id = t.field_id AND g.sample_id = t.sample_id AND g.row_ = t.row_ AND g.col_ = t.col_""", "det"))
def g1_render(spark, sf):
    ens = detections(spark, sf)
    level = (F.col("sample_id") / 100.0)
    bkg = ens.select("field_id", "sample_id").distinct().select("field_id", "sample_id", *[level.alias(b) for b in ("f0", "f1", "f2")])
    return rounded(G.render(ens, psf_table(spark), bkg, W, W, PHASES, ("f0", "f1", "f2")), 6)


def _basis_sql(shift: str = "0e0") -> str:
    return f"""m AS (SELECT CAST(k // 3 AS BIGINT) AS i, CAST(k % 3 AS BIGINT) AS j FROM (SELECT UNNEST(range(9)) AS k)),
q AS (SELECT g.*, m.i, m.j, sin((i+1-{shift})*{PI}*col_/3.2e1) AS sx, cos((i+1)*{PI}*col_/3.2e1) AS cx, sin((j+1-{shift})*{PI}*row_/3.2e1) AS sy, cos((j+1)*{PI}*row_/3.2e1) AS cy FROM g, m),
basis AS (SELECT * EXCLUDE (sx, cx, sy, cy), 0::BIGINT AS k, sx*sy AS value FROM q UNION ALL SELECT * EXCLUDE (sx, cx, sy, cy), 1, sx*cy FROM q
 UNION ALL SELECT * EXCLUDE (sx, cx, sy, cy), 2, cx*sy FROM q UNION ALL SELECT * EXCLUDE (sx, cx, sy, cy), 3, cx*cy FROM q)"""


@query("g4_fourier_basis", sql(f"""
WITH g AS (SELECT map_id, row_, col_ FROM pix), {_basis_sql('0.5e0')} SELECT map_id, row_, col_, i, j, k, ROUND(value*2e0, 9) + 0e0 AS value FROM basis""", "pix"))
def g4_fourier_basis(spark, sf):
    grid = pixels(spark, sf).select("map_id", "row_", "col_")
    return rounded(B.fourier_basis(grid, NTERMS, SIDE, SIDE, shift=True, scale=2.0), 9)


GRID32 = "g AS (SELECT a.r AS row_, b.c AS col_ FROM (SELECT UNNEST(range(32)) AS r) a, (SELECT UNNEST(range(32)) AS c) b)"


@query("g5_synthesise", sql(f"""
WITH {GRID32}, {_basis_sql()}
SELECT c.sample_id, b.row_, b.col_, ROUND(SUM(c.value*b.value), 6) + 0e0 AS model FROM coeffs c JOIN basis b ON c.i = b.i AND c.j = b.j AND c.k = b.k GROUP BY 1, 2, 3""", "coeffs"))
def g5_synthesise(spark, sf):
    return rounded(B.synthesise(coefficients(spark, sf), SIDE, SIDE), 6)


POWER_EDGES = [10 ** (math.log10(NTERMS + 2) * k / 5) for k in range(6)]


@query("a32_mode_power", sql(f"""
WITH p AS (SELECT sample_id, {bin_case('SQRT((i+1)*(i+1)+(j+1)*(j+1))', POWER_EDGES)} AS bin, AVG(value*value) AS p FROM coeffs GROUP BY 1, 2)
SELECT bin, ROUND(MEDIAN(p), 9) AS median, ROUND(STDDEV_POP(p), 9) AS std FROM p WHERE bin IS NOT NULL GROUP BY 1""", "coeffs"))
def a32_mode_power(spark, sf):
    return rounded(B.mode_power(coefficients(spark, sf), POWER_EDGES), 9)


MEDC = "mc AS (SELECT i, j, k, MEDIAN(value) AS value FROM coeffs WHERE sample_id > (SELECT MAX(sample_id) FROM coeffs) - 100 GROUP BY 1, 2, 3)"


@query("a33_median_coeffs", sql(f"WITH {MEDC} SELECT i, j, k, ROUND(value, 9) + 0e0 AS value FROM mc", "coeffs"))
def a33_median_coeffs(spark, sf):
    return rounded(B.median_coeffs(coefficients(spark, sf), 100), 9)


@query("a33_model_difference", sql(f"""
WITH {MEDC}, {GRID32}, {_basis_sql()}, t AS (SELECT b.row_, b.col_, SUM(c.value*b.value) AS model FROM mc c JOIN basis b ON c.i = b.i AND c.j = b.j AND c.k = b.k GROUP BY 1, 2)
SELECT p.map_id, ROUND(SUM((t.model-p.image)*(t.model-p.image)), 6) AS diff2 FROM pix p JOIN t ON p.row_ = t.row_ AND p.col_ = t.col_ GROUP BY 1""", "coeffs", "pix"))
def a33_model_difference(spark, sf):
    medians = B.median_coeffs(coefficients(spark, sf), 100).withColumn("sample_id", F.lit(0))
    model = B.synthesise(medians, SIDE, SIDE).drop("sample_id")
    return rounded(B.model_diff(model, pixels(spark, sf)), 6)


@query("a35_template_norm", sql("""
SELECT map_id, band, ROUND(STDDEV_POP(image)*2.2e0*r, 9) AS norm FROM pix, (VALUES ('S', 1e0), ('M', 16.65e-3/86.29e-4*1.6e6/3e6), ('L', 34.52e-3/86.29e-4*8e5/3e6)) v(band, r) GROUP BY map_id, band, r""", "pix"))
def a35_template_norm(spark, sf):
    return rounded(G.template_norm(pixels(spark, sf), "image", 2.2, P.BAND_UNITS, P.DUST_INTENSITY), 9)


@query("a35_integrate_template", sql("SELECT map_id, ROUND(SUM(error)*0.7e0*1.3e0, 6) AS flux FROM pix GROUP BY 1", "pix"))
def a35_integrate_template(spark, sf):
    return rounded(G.integrate_template(pixels(spark, sf), "error", 0.7, 1.3), 6)


@query("g6_normal_sums", sql(f"""
WITH g AS (SELECT * FROM pix WHERE error <> 0), {_basis_sql()},
v AS (SELECT map_id, row_, col_, error, (i*3+j)*4+k AS p, value FROM basis UNION ALL SELECT map_id, row_, col_, error, 36, image FROM g)
SELECT a.map_id, a.p, b.p AS q, ROUND(SUM(a.value*b.value/(a.error*a.error)), 5) + 0e0 AS s FROM v a JOIN v b
ON a.map_id = b.map_id AND a.row_ = b.row_ AND a.col_ = b.col_ AND a.p <= b.p GROUP BY 1, 2, 3""", "pix"))
def g6_normal_sums(spark, sf):
    return rounded(B.normal_sums(pixels(spark, sf), NTERMS, SIDE, SIDE), 5)


# Gauss-Jordan on lists: with the ridge the matrix is positive definite, so rows need no exchange.
@query("g6_ridge_fit", sql(f"""
WITH RECURSIVE g AS (SELECT * FROM pix WHERE error <> 0), {_basis_sql()},
v AS (SELECT map_id, row_, col_, error, (i*3+j)*4+k AS p, value FROM basis UNION ALL SELECT map_id, row_, col_, error, 36, image FROM g),
n AS (SELECT a.map_id, a.p, b.p AS q, SUM(a.value*b.value/(a.error*a.error)) + CASE WHEN a.p = b.p
  THEN 1e1*POW(SQRT(POW(FLOOR(a.p/1.2e1)+1, 2)+POW(FLOOR(a.p/4e0)-3e0*FLOOR(a.p/1.2e1)+1, 2))/SQRT(2e0), 1.5e0) ELSE 0e0 END AS s
 FROM v a JOIN v b ON a.map_id = b.map_id AND a.row_ = b.row_ AND a.col_ = b.col_ WHERE a.p < 36 GROUP BY 1, 2, 3),
rows_ AS (SELECT map_id, p, LIST(s ORDER BY q) AS r FROM n GROUP BY 1, 2),
e AS (SELECT map_id, CAST(1 AS BIGINT) AS c, LIST(r ORDER BY p) AS m FROM rows_ GROUP BY 1
 UNION ALL
 SELECT map_id, c + 1, list_transform(m, lambda r, i: CASE WHEN i = c THEN list_transform(r, lambda x: x / m[c][c])
  ELSE list_transform(r, lambda x, j: x - r[c] / m[c][c] * m[c][j]) END) FROM e WHERE c <= 36),
x AS (SELECT map_id, UNNEST(range(36)) AS p, UNNEST(list_transform(m, lambda r: r[37])) AS value FROM e WHERE c = 37)
SELECT map_id, CAST(FLOOR(p/1.2e1) AS BIGINT) AS i, CAST(FLOOR(p/4e0) AS BIGINT) % 3 AS j, p % 4 AS k, ROUND(value, 6) + 0e0 AS value FROM x""", "pix"))
def g6_ridge_fit(spark, sf):
    sums = B.normal_sums(pixels(spark, sf), NTERMS, SIDE, SIDE)
    return rounded(B.ridge_fit(sums, NTERMS, lam=10.0, alpha=1.5), 6)


UNIT = 2.0 * Z.ARCSEC / 7.0 / SIDE
RINGS = [UNIT * k for k in (0.5, 1.7, 3.3, 5.9, 9.1, 13.3, 18.7, 23.1)]
SR = "((7e0/3600e0/180e0*pi())*(7e0/3600e0/180e0*pi()))"
DFT = f"""
mu AS (SELECT map_id, AVG(image) AS ma, AVG(error) AS mb FROM pix WHERE mask = 1 GROUP BY 1),
x AS (SELECT p.map_id, row_, col_, (image*mask-ma)*{SR} AS a, (error*mask-mb)*{SR} AS b FROM pix p JOIN mu ON p.map_id = mu.map_id),
kk AS (SELECT CAST(range AS BIGINT) AS k FROM range(32)),
r AS (SELECT map_id, row_, k AS kx, SUM(a*cos(2e0*{PI}*(k*col_%32)/3.2e1)) AS ar, -SUM(a*sin(2e0*{PI}*(k*col_%32)/3.2e1)) AS ai,
 SUM(b*cos(2e0*{PI}*(k*col_%32)/3.2e1)) AS br, -SUM(b*sin(2e0*{PI}*(k*col_%32)/3.2e1)) AS bi FROM x, kk GROUP BY 1, 2, 3),
z AS (SELECT map_id, kx, k AS ky, SUM(ar*cos(t)+ai*sin(t)) AS ar, SUM(ai*cos(t)-ar*sin(t)) AS ai, SUM(br*cos(t)+bi*sin(t)) AS br, SUM(bi*cos(t)-br*sin(t)) AS bi
 FROM (SELECT r.*, k, 2e0*{PI}*(k*row_%32)/3.2e1 AS t FROM r, kk) q GROUP BY 1, 2, 3),
ps AS (SELECT map_id, ky, kx, SQRT(pow(CASE WHEN ky < 16 THEN ky ELSE ky-32 END/3.2e1, 2)+pow(CASE WHEN kx < 16 THEN kx ELSE kx-32 END/3.2e1, 2))*(2e0*648000e0/7e0) AS ell,
 ar*br+ai*bi AS cross_, ar*ar+ai*ai AS auto_ FROM z)"""


@query("g7_cross_power", sql(f"""
WITH {DFT} SELECT map_id, ky, kx, ROUND(ell, 4) AS ell, ROUND(cross_/(1024e0*{SR})*1e9, 6) + 0e0 AS power FROM ps""", "pix"))
def g7_cross_power(spark, sf):
    ps = Z.cross_power(pixels(spark, sf), "image", "error", SIDE, SIDE, mask="mask")
    return rounded(rounded(ps.withColumn("power", F.col("power") * 1e9), 6, "power"), 4, "ell")


@query("a17_radial_average", sql(f"""
WITH {DFT}, w AS (SELECT map_id, {bin_case('ell', RINGS)} AS bin, auto_/(1024e0*{SR})*1e9 AS p, 1e0/(1e0+ell/1e4) AS w FROM ps),
s AS (SELECT map_id, bin, SUM(p*w)/SUM(w) AS cl, STDDEV_POP(p)/SQRT(COUNT(*)) AS e, COUNT(*) AS modes, SUM(w)*SUM(w)/SUM(w*w) AS n_eff FROM w WHERE bin IS NOT NULL GROUP BY 1, 2)
SELECT s.map_id, s.bin, ROUND(SQRT(b.lo*b.hi), 4) AS ell, ROUND(cl*SQRT(b.lo*b.hi)*(SQRT(b.lo*b.hi)+1e0)/(2e0*{PI})/1e6, 6) AS cl, ROUND(e, 6) AS cl_err, modes, ROUND(n_eff, 6) AS n_eff
FROM s JOIN {bin_rows(RINGS)} b ON s.bin = b.bin""", "pix"))
def a17_radial_average(spark, sf):
    ps = Z.cross_power(pixels(spark, sf), "image", "image", SIDE, SIDE, mask="mask")
    ps = ps.withColumn("power", F.col("power") * 1e9).withColumn("w", 1.0 / (1.0 + F.col("ell") / 1e4))
    out = Z.radial_average(ps, RINGS, weight="w", as_dl=True).withColumn("cl", F.col("cl") / 1e6)
    return rounded(rounded(out, 4, "ell"), 6, "cl", "cl_err", "n_eff")


@query("g8_tile_templates", sql("""
WITH t AS (SELECT CAST(range AS BIGINT) AS t FROM range(5)),
o AS (SELECT map_id, row_, col_, a.t AS tile_y, b.t AS tile_x, LEAST(row_+1, (a.t+1)*6.4e0)-GREATEST(row_, a.t*6.4e0) AS oy, LEAST(col_+1, (b.t+1)*6.4e0)-GREATEST(col_, b.t*6.4e0) AS ox FROM pix, t a, t b)
SELECT map_id, row_, col_, tile_y, tile_x, ROUND(oy*ox*1.41e0, 9) AS weight FROM o WHERE oy > 1e-9 AND ox > 1e-9""", "pix"))
def g8_tile_templates(spark, sf):
    grid = pixels(spark, sf).select("map_id", "row_", "col_")
    return rounded(G.tile_templates(grid, 5, SIDE, SIDE, amp=1.41), 9)


@query("g9_cutout", sql("""
WITH d AS (SELECT CAST(range AS BIGINT) AS d FROM range(9)), c AS (SELECT DISTINCT map_id, map_id*7 % 32 AS cx, map_id*11 % 32 AS cy FROM pix)
SELECT c.map_id, a.d AS dr, b.d AS dc, ROUND(p.image, 9) AS image FROM c CROSS JOIN d a CROSS JOIN d b LEFT JOIN pix p
ON p.map_id = c.map_id AND p.row_ = cy-4+a.d AND p.col_ = cx-4+b.d""", "pix"))
def g9_cutout(spark, sf):
    px = pixels(spark, sf)
    m = F.col("map_id")
    centres = px.select("map_id").distinct().select("map_id", (m * 7 % 32).alias("cx"), (m * 11 % 32).alias("cy"))
    return rounded(G.cutout(px, centres, 9), 9, "image")


@query("g10_pad", sql("""
WITH r AS (SELECT CAST(range AS BIGINT) AS r FROM range(35)), m AS (SELECT DISTINCT map_id FROM pix)
SELECT m.map_id, a.r AS row_, b.r AS col_, ROUND(COALESCE(p.image, 0e0), 9) AS image, COALESCE(p.error, 0e0) AS error
FROM m CROSS JOIN r a CROSS JOIN r b LEFT JOIN pix p ON p.map_id = m.map_id AND p.row_ = a.r AND p.col_ = b.r AND a.r < 30 AND b.r < 30""", "pix"))
def g10_pad(spark, sf):
    return rounded(G.pad(pixels(spark, sf), 35, ["image", "error"], pivot=30), 9, "image")


@query("g11_upsample", sql("""
WITH f AS (SELECT CAST(range AS BIGINT) AS t, range*31e0/95e0 AS c FROM range(96)), m AS (SELECT DISTINCT map_id FROM pix),
q AS (SELECT m.map_id, a.t AS row_, b.t AS col_, LEAST(CAST(FLOOR(a.c) AS BIGINT), 30) AS r, LEAST(CAST(FLOOR(b.c) AS BIGINT), 30) AS s, a.c AS ac, b.c AS bc FROM m, f a, f b)
SELECT q.map_id, q.row_, q.col_, ROUND((1e0-(ac-r))*((1e0-(bc-s))*COALESCE(p.image, 0e0)+(bc-s)*COALESCE(p1.image, 0e0))
 +(ac-r)*((1e0-(bc-s))*COALESCE(p2.image, 0e0)+(bc-s)*COALESCE(p3.image, 0e0)), 8) AS image
FROM q LEFT JOIN pix p ON p.map_id=q.map_id AND p.row_=r AND p.col_=s LEFT JOIN pix p1 ON p1.map_id=q.map_id AND p1.row_=r AND p1.col_=s+1
LEFT JOIN pix p2 ON p2.map_id=q.map_id AND p2.row_=r+1 AND p2.col_=s LEFT JOIN pix p3 ON p3.map_id=q.map_id AND p3.row_=r+1 AND p3.col_=s+1
WHERE (p.image IS NOT NULL OR (1e0-(ac-r))*(1e0-(bc-s)) < 1e-9) AND (p1.image IS NOT NULL OR (1e0-(ac-r))*(bc-s) < 1e-9)
 AND (p2.image IS NOT NULL OR (ac-r)*(1e0-(bc-s)) < 1e-9) AND (p3.image IS NOT NULL OR (ac-r)*(bc-s) < 1e-9)""", "pix"))
def g11_upsample(spark, sf):
    return rounded(G.upsample(pixels(spark, sf), 3, SIDE, SIDE), 8, "image")
