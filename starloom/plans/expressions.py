"""Filters, expressions, ranks and run sets: P, T, W4, O, A24."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.functions import densities as D
from starloom.functions import photometry as P
from starloom.operators import filters as R
from starloom.operators import histograms as H
from starloom.operators import ranking as K
from starloom.operators import runsets as O
from starloom.operators.bins import log_edges
from starloom.plans.oracle import bin_case, num, query, rounded, sql
from starloom.sources.fixtures import chain, detections, pixels, runs, table, truth

DET_OUT = "field_id, sample_id, ROUND(x, 9) + 0e0 AS x, ROUND(y, 9) + 0e0 AS y, ROUND(f0, 9) AS f0"


def shown(df):
    return rounded(df.select("field_id", "sample_id", "x", "y", "f0"), 9)


@query("p1_tail_samples", sql(f"""
SELECT {DET_OUT} FROM (SELECT *, MAX(sample_id) OVER (PARTITION BY field_id) AS last FROM det) q
WHERE sample_id > last - 10""", "det"))
def p1_tail_samples(spark, sf):
    return shown(R.tail_samples(detections(spark, sf), 10))


@query("p1_burn_in", sql(f"""
SELECT {DET_OUT} FROM (SELECT *, MAX(sample_id) OVER (PARTITION BY field_id) AS last FROM det) q
WHERE sample_id >= FLOOR((last + 1) * 0.35e0)""", "det"))
def p1_burn_in(spark, sf):
    return shown(R.burn_in(detections(spark, sf), 0.35))


@query("p2_thin", sql("SELECT chain_id, i // 5 AS step, value FROM chain WHERE i % 5 = 0", "chain"))
def p2_thin(spark, sf):
    return R.thin(chain(spark, sf), 5).select("chain_id", F.floor(F.col("i") / 5.0).alias("step"), "value")


@query("p3_drop_padding", """
SELECT l_orderkey, l_linenumber, ROUND(l_discount * l_quantity, 9) AS f0 FROM lineitem WHERE l_discount * l_quantity > 0""")
def p3_drop_padding(spark, sf):
    slots = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_discount") * F.col("l_quantity")).alias("f0")
    )
    return rounded(R.drop_padding(slots), 9)


@query("p4_edge_mask", sql(f"""
SELECT {DET_OUT} FROM det WHERE x > 3e0 AND x < 97e0 AND y > 3e0 AND y < 97e0 AND f0 > 1e1""", "det"))
def p4_edge_mask(spark, sf):
    return shown(R.edge_mask(detections(spark, sf), 100, 100, 3, 10))


@query("p5_crop", sql("""
SELECT field_id, sample_id, ROUND(x - 2e1, 9) + 0e0 AS x, ROUND(y - 3e1, 9) + 0e0 AS y, ROUND(f0, 9) AS f0
FROM det WHERE x >= 2e1 AND x < 6e1 AND y >= 3e1 AND y < 8e1""", "det"))
def p5_crop(spark, sf):
    return shown(R.crop(detections(spark, sf), 20, 60, 30, 80))


@query("p6_magnitudes", sql("""
SELECT truth_id, ROUND(-2.5e0*log10(f0), 9) AS mag, ROUND(22.5e0-2.5e0*log10(f0*5e-3), 9) AS cal_mag,
ROUND(pow(1e1, (22.5e0-(2e1+f0/1e2))/2.5e0)/5e-3, 6) AS counts FROM truth""", "truth"))
def p6_magnitudes(spark, sf):
    f = F.col("f0")
    out = truth(spark, sf).select(
        "truth_id",
        P.flux_to_mag(f).alias("mag"),
        P.flux_to_mag(f, F.lit(5e-3)).alias("cal_mag"),
        P.mag_to_flux(F.lit(20.0) + f / 100.0, F.lit(5e-3)).alias("counts"),
    )
    return rounded(rounded(out, 9, "mag", "cal_mag"), 6, "counts")


@query("p7_colours", sql("""
SELECT field_id, sample_id, src, ROUND(f0/f1, 9) AS ratio, ROUND(2.5e0*log10(f1/f2), 9) + 0e0 AS log_colour,
ROUND((22.5e0-2.5e0*log10(f0*5e-3))-(22.5e0-2.5e0*log10(f2*7e-3)), 9) + 0e0 AS mag_colour FROM det""", "det"))
def p7_colours(spark, sf):
    out = detections(spark, sf, slots=True).select(
        "field_id", "sample_id", "src",
        P.color(F.col("f0"), F.col("f1")).alias("ratio"),
        P.color(F.col("f1"), F.col("f2"), "log").alias("log_colour"),
        P.color(F.col("f0"), F.col("f2"), "mag", 5e-3, 7e-3).alias("mag_colour"),
    )
    return rounded(out, 9)


@query("p8_colour_error", sql("""
SELECT field_id, sample_id, src, ROUND(SQRT((SQRT(f0)/f0)*(SQRT(f0)/f0)+(SQRT(f2)/f2)*(SQRT(f2)/f2))*f0/f2, 9) AS err
FROM det""", "det"))
def p8_colour_error(spark, sf):
    a, b = F.col("f0"), F.col("f2")
    out = detections(spark, sf, slots=True).select(
        "field_id", "sample_id", "src", P.color_error(a, F.sqrt(a), b, F.sqrt(b)).alias("err")
    )
    return rounded(out, 9)


@query("p9_red_sources", sql("""
SELECT field_id, sample_id, COUNT(*) AS n, ROUND(SUM(f2), 6) AS total FROM det
WHERE f2/f0 > 1e0 AND f0/f1 > 1e0 AND f0 > 2e1 AND f1/f0 > 0.92e0 GROUP BY 1, 2""", "det"))
def p9_red_sources(spark, sf):
    dets = detections(spark, sf).withColumn("confidence", F.col("f1") / F.col("f0"))
    red = R.red_sources(dets, ("f2", "f0", "f1"), flux_cut=20.0, flux="f0", prevalence_cut=0.92)
    out = red.groupBy("field_id", "sample_id").agg(F.count(F.lit(1)).alias("n"), F.sum("f2").alias("total"))
    return rounded(out, 6)


@query("p10_convert_units", sql("""
SELECT map_id, row_, col_, band, ROUND(image * c * 1e3, 12) AS image FROM
(SELECT *, CASE map_id % 3 WHEN 0 THEN 'S' WHEN 1 THEN 'M' ELSE 'L' END AS band,
 CASE map_id % 3 WHEN 0 THEN 86.29e-4 WHEN 1 THEN 16.65e-3 ELSE 34.52e-3 END AS c FROM pix) q""", "pix"))
def p10_convert_units(spark, sf):
    m = F.col("map_id") % 3
    banded = pixels(spark, sf).withColumn("band", F.when(m == 0, "S").when(m == 1, "M").otherwise("L"))
    out = P.convert_units(banded, "image", scale=P.JY_TO_MJY)
    return rounded(out.select("map_id", "row_", "col_", "band", "image"), 12)


@query("p11_weights", sql("""
SELECT map_id, row_, col_, ROUND(CASE WHEN error = 0 OR error > 0.5e0 THEN 0e0 ELSE 1e0/(error*error) END, 9) AS weight,
ROUND(CASE WHEN error = 0 OR error > 0.5e0 THEN 0e0 ELSE image END, 9) AS image,
ROUND(3e0/(image + 2e0), 9) AS gain_weight FROM pix""", "pix"))
def p11_weights(spark, sf):
    raw = pixels(spark, sf).withColumn("gain_weight", P.gain_weight(F.col("image"), -2.0, 3.0))
    out = P.weights(raw, threshold=0.5).select("map_id", "row_", "col_", "weight", "image", "gain_weight")
    return rounded(out, 9)


@query("p12_noise_and_injection", sql("""
SELECT map_id, row_, col_, ROUND(CASE WHEN error <> 0 THEN SQRT(error*error+0.04e0) ELSE error END, 9) AS error,
ROUND(error - AVG(error) OVER (PARTITION BY map_id), 9) + 0e0 AS centred,
ROUND(image + 0.5e0*error*3e0*86.29e-4, 9) AS injected FROM pix""", "pix"))
def p12_noise_and_injection(spark, sf):
    out = P.centre_plane(pixels(spark, sf), "error", ["map_id"], "centred").select(
        "map_id", "row_", "col_",
        P.add_scalar_noise_var(F.col("error"), 0.2).alias("error"), "centred",
        P.inject_template(F.col("image"), F.col("error"), 3.0, 0.5, P.BAND_UNITS["S"]).alias("injected"),
    )
    return rounded(out, 9)


@query("p13_mask_saturated", sql("""
WITH hot AS (SELECT map_id, row_, col_ FROM pix WHERE image > 4.98e0)
SELECT map_id, row_, col_, CASE WHEN EXISTS (SELECT 1 FROM hot h WHERE h.map_id = p.map_id AND abs(h.row_-p.row_) <= 10
 AND abs(h.col_-p.col_) <= 10) THEN 0e0 ELSE 1e0 END AS weight FROM pix p""", "pix"))
def p13_mask_saturated(spark, sf):
    return R.mask_saturated(pixels(spark, sf), 4.98, 10).select("map_id", "row_", "col_", "weight")


LAW = D.DoublePowerLaw(1.0, 200.0, 20.0, 1.5, 2.5)
_M = "pow(2e1, -1e0)"
_BELOW = f"({_M}*(pow(2e1,-0.5e0)-1e0)/(-0.5e0))"
_ABOVE = "((pow(2e2,-1.5e0)-pow(2e1,-1.5e0))/(-1.5e0))"
_A = f"(1e0/({_BELOW}+{_ABOVE}))"


@query("p14_power_law_densities", sql(f"""
WITH q AS (SELECT truth_id, f0, f0 * 1.1e0 AS g, (truth_id % 1000) / 1e3 AS u FROM truth)
SELECT truth_id,
ROUND(CASE WHEN f0 <= 2e1 THEN {_A}*{_M}*pow(f0,-1.5e0) ELSE {_A}*pow(f0,-2.5e0) END, 12) AS pdf,
ROUND(CASE WHEN u <= {_A}*{_BELOW} THEN pow(u/({_A}*{_M}/(-0.5e0))+1e0, -2e0)
  ELSE pow((-1.5e0)*(u-{_A}*{_BELOW})/{_A}+pow(2e1,-1.5e0), -1e0/1.5e0) END, 6) AS icdf,
ROUND(CASE WHEN f0 > 2e1 THEN 1e0*ln(2e1)-2.5e0*ln(f0) ELSE -1.5e0*ln(f0) END, 9) AS logprior,
ROUND(ln(CASE WHEN g <= 2e1 THEN {_M}*pow(g,-1.5e0) ELSE pow(g,-2.5e0) END)
  - ln(CASE WHEN f0 <= 2e1 THEN {_M}*pow(f0,-1.5e0) ELSE pow(f0,-2.5e0) END), 9) AS log_ratio,
ROUND(-2e0*ln(g/f0), 9) AS spl_ratio, ROUND(-(u-0.3e0)*(u-0.3e0)/(2e0*0.25e0), 9) + 0e0 AS colour_prior FROM q""", "truth"))
def p14_power_law_densities(spark, sf):
    f, u = F.col("f0"), (F.col("truth_id") % 1000) / 1e3
    out = truth(spark, sf).select(
        "truth_id",
        LAW.pdf(f).alias("pdf"), LAW.icdf(u).alias("icdf"),
        LAW.unnormalised_log(f).alias("logprior"), LAW.log_ratio(f * 1.1, f).alias("log_ratio"),
        D.spl_log_ratio(f * 1.1, f, 2.0).alias("spl_ratio"), D.color_logprior(u, 0.3, 0.5).alias("colour_prior"),
    )
    return rounded(
        rounded(rounded(out, 12, "pdf"), 6, "icdf"), 9, "logprior", "log_ratio", "spl_ratio", "colour_prior"
    )


PSF3 = (0.05, 0.1, 0.05, 0.1, 0.4, 0.1, 0.05, 0.1, 0.05)
_INFO = " + ".join(f"{num(p)}*{num(p)}/(179e0+{num(p)}*f0)" for p in PSF3)


@query("p15_penalties_and_snr", sql(f"""
SELECT truth_id, ROUND((1e4+f0)/((1e4+f0)-5e0*5e2), 9) AS alpha, ROUND(SQRT(4.6e0)*f0/SQRT(17.5e0*179e0+f0), 9) AS snr,
ROUND(1e0/SQRT(4.6e0*({_INFO})), 9) AS ferr,
ROUND(1.08573620476e0*SQRT(pow(1e0/SQRT(4.6e0*({_INFO}))/f0, 2)+1e-4), 9) AS merr FROM truth""", "truth"))
def p15_penalties_and_snr(spark, sf):
    f = F.col("f0")
    ferr = D.flux_error(f, 4.6, 179.0, PSF3)
    out = truth(spark, sf).select(
        "truth_id", D.fstat_alpha(F.lit(1e4) + f, 3, 500).alias("alpha"), D.point_snr(f, 4.6).alias("snr"),
        ferr.alias("ferr"), D.mag_error(f, ferr).alias("merr"),
    )
    return rounded(out, 9)


@query("p15_n_eff", sql("""
SELECT map_id, ROUND(SUM(error)*SUM(error)/SUM(error*error), 6) AS n_eff FROM pix GROUP BY map_id""", "pix"))
def p15_n_eff(spark, sf):
    return rounded(D.n_eff(pixels(spark, sf), "error", ["map_id"]), 6)


@query("p16_tile", sql("""
SELECT field_id, tile_x, tile_y, tile_x % 2 AS parity_x, tile_y % 2 AS parity_y, COUNT(*) AS n,
CAST(CEIL(MAX(x)/8e0)*8 AS BIGINT) AS up, CAST(FLOOR(MIN(x)/8e0)*8 AS BIGINT) AS down FROM
(SELECT field_id, x, CAST(FLOOR((x+3e0)/2.5e1) AS BIGINT) AS tile_x, CAST(FLOOR((y+3e0)/2.5e1) AS BIGINT) AS tile_y FROM det) q
GROUP BY 1, 2, 3, 4, 5""", "det"))
def p16_tile(spark, sf):
    keys = ["tile_x", "tile_y", "parity_x", "parity_y"]
    return D.tile(detections(spark, sf), 25, 3.0).groupBy("field_id", *keys).agg(
        F.count(F.lit(1)).alias("n"), D.round_up(F.max("x"), 8).alias("up"), D.round_down(F.min("x"), 8).alias("down")
    )


LOOKUP_EDGES = [5.0, 10.0, 20.0, 40.0, 60.0, 80.0]


@query("p17_hist_lookup", sql(f"""
WITH h AS (SELECT {bin_case('f0', LOOKUP_EDGES, True)} AS bin, COUNT(*) / 1e3 AS v FROM truth GROUP BY 1)
SELECT d.field_id, d.sample_id, d.src, ROUND(COALESCE(h.v, 0e0), 9) AS bar FROM det d
LEFT JOIN h ON {bin_case('d.f0', LOOKUP_EDGES)} = h.bin""", "det"))
def p17_hist_lookup(spark, sf):
    hist = H.histogram(truth(spark, sf), "f0", LOOKUP_EDGES).select("bin", (F.col("n") / 1e3).alias("value"))
    out = H.hist_lookup(detections(spark, sf, slots=True), "f0", hist, LOOKUP_EDGES, "bar")
    return rounded(out.select("field_id", "sample_id", "src", "bar"), 9, "bar")


@query("w4_rank_flux", sql("SELECT field_id, sample_id, src AS slot, ROUND(f0, 9) AS f0 FROM det", "det"))
def w4_rank_flux(spark, sf):
    ranked = K.rank_flux(detections(spark, sf), ties=("x", "y", "f1", "f2"))
    return rounded(ranked.select("field_id", "sample_id", "slot", "f0"), 9, "f0")


@query("t1_sort_flux", sql("SELECT truth_id, ROUND(f0, 9) AS f0 FROM truth ORDER BY f0 DESC", "truth"))
def t1_sort_flux(spark, sf):
    return rounded(K.sort_flux(truth(spark, sf).select("truth_id", "f0"), descending=True), 9, "f0")


@query("t2_brightest", sql("""
SELECT d.field_id, d.sample_id, d.src + 1 AS rank, ROUND(d.f0, 9) AS f0 FROM det d
JOIN (SELECT field_id, sample_id, LEAST(50, FLOOR(COUNT(*) / 3e0)) AS k FROM det GROUP BY 1, 2) c
ON d.field_id = c.field_id AND d.sample_id = c.sample_id WHERE d.src + 1 <= c.k""", "det"))
def t2_brightest(spark, sf):
    top = K.brightest(detections(spark, sf), 50, share=3, ties=("x", "y", "f1", "f2"))
    return rounded(top.select("field_id", "sample_id", "rank", "f0"), 9, "f0")


@query("t3_extremes", sql("""
SELECT field_id, sample_id, ROUND(MIN(f0), 9) AS min_f0, ROUND(MAX(f0), 9) AS max_f0,
ROUND(FIRST(x ORDER BY f0, x, y), 9) + 0e0 AS argmin_x, ROUND(FIRST(y ORDER BY f0, x, y), 9) + 0e0 AS argmin_y,
ROUND(FIRST(x ORDER BY f0 DESC, x, y), 9) + 0e0 AS argmax_x, ROUND(FIRST(y ORDER BY f0 DESC, x, y), 9) + 0e0 AS argmax_y
FROM det GROUP BY 1, 2""", "det"))
def t3_extremes(spark, sf):
    return rounded(K.extremes(detections(spark, sf), ["field_id", "sample_id"], "f0", ["x", "y"]), 9)


@query("o1_stack_runs", sql("""
SELECT status, COUNT(*) AS n, SUM(started)::BIGINT AS total FROM (SELECT * FROM runs WHERE status = 'F'
UNION ALL SELECT * FROM runs WHERE status = 'O' UNION ALL SELECT * FROM runs WHERE status = 'P') q GROUP BY 1""", "runs"))
def o1_stack_runs(spark, sf):
    r = runs(spark, sf)
    pooled = O.stack([r.where(F.col("status") == s) for s in ("F", "O", "P")])
    return pooled.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("started").alias("total"))


@query("o2_first_per_sim", sql("""
SELECT sim, run_id, started FROM (SELECT right(tail_name, 3) AS sim, run_id, started,
ROW_NUMBER() OVER (PARTITION BY right(tail_name, 3) ORDER BY started, run_id) AS k FROM runs) q WHERE k = 1""", "runs"))
def o2_first_per_sim(spark, sf):
    return O.first_per_sim(runs(spark, sf))


@query("o3_exclude", sql("""
SELECT right(tail_name, 3) AS sim, run_id FROM runs WHERE right(tail_name, 3) NOT IN
(SELECT LPAD(CAST(n_nationkey * 11 AS VARCHAR), 3, '0') FROM nation)""", "runs"))
def o3_exclude(spark, sf):
    listed = table(spark, sf, "nation").select(
        F.lpad((F.col("n_nationkey") * 11).cast("string"), 3, "0").alias("sim")
    )
    return O.exclude(runs(spark, sf), listed).select("sim", "run_id")


@query("o4_todo", sql("""
WITH s AS (SELECT DISTINCT right(tail_name, 3) AS sim FROM runs),
g AS (SELECT sim, CAST(n AS BIGINT) AS n_terms FROM s, (VALUES (3), (4), (5), (6)) v(n))
SELECT sim, n_terms FROM g EXCEPT SELECT right(tail_name, 3), 3 + started % 4 FROM runs WHERE status = 'P'""", "runs"))
def o4_todo(spark, sf):
    r = O.sim_key(runs(spark, sf))
    started = r.where(F.col("status") == "P").select("sim", (F.col("started") % 4 + 3).alias("n_terms"))
    return O.todo(r, (3, 4, 5, 6), started)


@query("a24_runs_by_sim", sql("""
SELECT right(tail_name, 3) AS sim, run_id,
CAST(ROW_NUMBER() OVER (PARTITION BY right(tail_name, 3) ORDER BY started) - 1 AS BIGINT) AS place FROM runs""", "runs"))
def a24_runs_by_sim(spark, sf):
    return O.runs_by_sim(runs(spark, sf))
