"""Queries over catalogs and events: A7-A10, A18, A22, A27-A31, A34, J10."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.functions import photometry as P
from starloom.operators import ellipses as E
from starloom.operators import histograms as H
from starloom.operators import lookups as L
from starloom.operators import ranking as K
from starloom.operators import xray as X
from starloom.operators.bins import linear_edges, log_edges
from starloom.plans.oracle import bin_case, bin_rows, query, rounded, sql
from starloom.sources.fixtures import chain, detections, photons, pixels, table, truth

FLUX_EDGES = log_edges(1.0, 150.0, 16)


@query("a7_histogram", sql(f"""
WITH s AS (SELECT {bin_case('f0', FLUX_EDGES, True)} AS bin, COUNT(*) AS n FROM det GROUP BY 1)
SELECT b.bin, b.lo, b.hi, COALESCE(s.n, 0) AS n,
ROUND(COALESCE(s.n, 0) / (CAST((SELECT SUM(n) FROM s WHERE bin IS NOT NULL) AS DOUBLE) * (b.hi - b.lo)), 9) AS density
FROM {bin_rows(FLUX_EDGES)} b LEFT JOIN s ON b.bin = s.bin""", "det"))
def a7_histogram(spark, sf):
    return rounded(H.histogram(detections(spark, sf), "f0", FLUX_EDGES, density=True), 9, "density")


@query("a7_histogram_by_move", f"""
WITH g AS (SELECT event_type AS move, b.bin, b.lo, b.hi FROM (SELECT DISTINCT event_type FROM events) e, {bin_rows(linear_edges(0, 400, 20))} b),
s AS (SELECT event_type AS move, {bin_case('value', linear_edges(0, 400, 20), True)} AS bin, COUNT(*) AS n FROM events GROUP BY 1, 2)
SELECT g.move, g.bin, g.lo, g.hi, COALESCE(s.n, 0) AS n FROM g LEFT JOIN s ON g.move = s.move AND g.bin = s.bin""")
def a7_histogram_by_move(spark, sf):
    events = table(spark, sf, "events").select(F.col("event_type").alias("move"), "value")
    return H.histogram(events, "value", linear_edges(0, 400, 20), by=["move"])


@query("a7_uniform_histogram", """
WITH m AS (SELECT MIN(value) AS lo, MAX(value) AS hi FROM events),
s AS (SELECT CAST(LEAST(FLOOR((value - lo) / (hi - lo) * 25e0), 24) AS BIGINT) AS bin, COUNT(*) AS n FROM events, m GROUP BY 1)
SELECT g.bin, COALESCE(s.n, 0) AS n FROM (SELECT CAST(range AS BIGINT) AS bin FROM range(25)) g LEFT JOIN s ON g.bin = s.bin""")
def a7_uniform_histogram(spark, sf):
    return H.uniform_histogram(table(spark, sf, "events"), "value", 25)


GRID = linear_edges(0, 100, 20)


def _density_sql(norm: str) -> str:
    return f"""c AS (SELECT {bin_case('x', GRID, True)} AS bx, {bin_case('y', GRID, True)} AS by_, COUNT(*) AS n FROM det GROUP BY 1, 2),
g AS (SELECT a.bin AS bx, b.bin AS by_ FROM {bin_rows(GRID)} a, {bin_rows(GRID)} b),
f AS (SELECT g.bx, g.by_, COALESCE(c.n, 0) AS n FROM g LEFT JOIN c ON g.bx = c.bx AND g.by_ = c.by_),
d AS (SELECT bx, by_, n, n / CAST({norm}(n) OVER () AS DOUBLE) AS density FROM f)"""


@query("a8_density2d", sql(f"WITH {_density_sql('MAX')} SELECT bx, by_, n, ROUND(density, 9) AS density FROM d", "det"))
def a8_density2d(spark, sf):
    return rounded(H.density2d(detections(spark, sf), GRID, GRID), 9, "density")


@query("a8_density2d_sum", sql(f"WITH {_density_sql('SUM')} SELECT bx, by_, n, ROUND(density, 9) AS density FROM d", "det"))
def a8_density2d_sum(spark, sf):
    return rounded(H.density2d(detections(spark, sf), GRID, GRID, norm="sum"), 9, "density")


@query("a31_density_region", sql(f"""
WITH {_density_sql('MAX')} SELECT bx, by_, n, ROUND(density, 9) AS density FROM d WHERE density >= 1e0 - exp(-0.5e0 * 2.25e0)""", "det"))
def a31_density_region(spark, sf):
    dens = H.density2d(detections(spark, sf), GRID, GRID)
    return rounded(H.density_region(dens, 1.5), 9, "density")


COUNT_EDGES = linear_edges(3.2, 5.2, 10)


@query("a9_number_counts", sql(f"""
WITH k AS (SELECT DISTINCT field_id, sample_id FROM det),
g AS (SELECT field_id, sample_id, bin, lo, hi FROM k, {bin_rows(COUNT_EDGES)} b),
c AS (SELECT field_id, sample_id, {bin_case('log10(f0)+3e0', COUNT_EDGES, True)} AS bin, COUNT(*) AS n FROM det GROUP BY 1, 2, 3),
d AS (SELECT g.field_id, g.bin, COALESCE(c.n, 0) AS n, pow(1e1, 0.5e0*(lo+hi)-3e0) AS s, pow(1e1, hi-3e0)-pow(1e1, lo-3e0) AS ds
 FROM g LEFT JOIN c ON g.field_id = c.field_id AND g.sample_id = c.sample_id AND g.bin = c.bin),
e AS (SELECT field_id, bin, n, pow(s, 2.5e0)/8e-6/ds AS sc FROM d)
SELECT field_id, bin, ROUND(MEDIAN(n*sc)/1e9, 9) AS median, ROUND(QUANTILE_CONT(n*sc, 0.16e0)/1e9, 9) AS p16,
ROUND(QUANTILE_CONT(n*sc, 0.84e0)/1e9, 9) AS p84, ROUND(SQRT(AVG(n))*MAX(sc)/1e9, 9) AS root_n FROM e GROUP BY 1, 2""", "det"))
def a9_number_counts(spark, sf):
    out = H.number_counts(detections(spark, sf), COUNT_EDGES, 8e-6)
    names = ("median", "p16", "p84", "root_n")
    return rounded(out.withColumns({c: F.col(c) / 1e9 for c in names}), 9, *names)


@query("a10_scott_edges", """
WITH s AS (SELECT COUNT(value) AS n, STDDEV_POP(value) AS sd, MIN(value) AS lo, MAX(value) AS hi FROM events),
k AS (SELECT lo, hi, CAST(CEIL((hi-lo)/(3.5e0*sd/pow(n, 1e0/3e0))) AS BIGINT) AS k FROM s)
SELECT CAST(e AS BIGINT) AS edge_id, ROUND(lo+(hi-lo)*e/(k-1), 9) AS edge FROM (SELECT *, UNNEST(range(k)) AS e FROM k) q""")
def a10_scott_edges(spark, sf):
    return rounded(H.scott_edges(table(spark, sf, "events"), "value"), 9, "edge")


@query("a10_scott_histogram", """
WITH s AS (SELECT COUNT(value) AS n, STDDEV_POP(value) AS sd, MIN(value) AS lo, MAX(value) AS hi FROM events),
k AS (SELECT lo, hi, CAST(CEIL((hi-lo)/(3.5e0*sd/pow(n, 1e0/3e0))) AS BIGINT) AS k FROM s),
e AS (SELECT CAST(i AS BIGINT) AS i, lo+(hi-lo)*i/(k-1) AS a, lo+(hi-lo)*(i+1)/(k-1) AS b, i = k-2 AS closed FROM (SELECT *, UNNEST(range(k-1)) AS i FROM k) q)
SELECT e.i AS bin, ROUND(e.a, 9) AS lo, ROUND(e.b, 9) AS hi, COUNT(v.value) AS n
FROM e LEFT JOIN events v ON v.value >= e.a AND (v.value < e.b OR (e.closed AND v.value = e.b)) GROUP BY 1, 2, 3""")
def a10_scott_histogram(spark, sf):
    events = table(spark, sf, "events")
    return rounded(H.histogram_over(events, "value", H.scott_edges(events, "value")), 9, "lo", "hi")


HD_EDGES = linear_edges(0, 200, 40)


@query("a12_hdpi", sql(f"""
WITH RECURSIVE c AS (SELECT chain_id, {bin_case('value', HD_EDGES, True)} AS bin, COUNT(*) AS n FROM chain GROUP BY 1, 2),
k AS (SELECT DISTINCT chain_id FROM chain),
h AS (SELECT k.chain_id, b.bin, 0.5e0*(b.lo+b.hi) AS t,
 COALESCE(c.n, 0) / CAST(SUM(COALESCE(c.n, 0)) OVER (PARTITION BY k.chain_id) AS DOUBLE) AS p
 FROM k, {bin_rows(HD_EDGES)} b LEFT JOIN c ON c.chain_id = k.chain_id AND c.bin = b.bin),
mo AS (SELECT chain_id, FIRST(bin ORDER BY p DESC, bin) AS m, MAX(p) AS p FROM h GROUP BY 1),
r AS (SELECT chain_id, m AS lo, m AS hi, p AS mass FROM mo UNION ALL
 SELECT r.chain_id, CASE WHEN COALESCE(x.p, -1) > COALESCE(l.p, -1) THEN r.lo ELSE r.lo - 1 END,
 CASE WHEN COALESCE(x.p, -1) > COALESCE(l.p, -1) THEN r.hi + 1 ELSE r.hi END,
 r.mass + CASE WHEN COALESCE(x.p, -1) > COALESCE(l.p, -1) THEN x.p ELSE l.p END
 FROM r LEFT JOIN h l ON l.chain_id = r.chain_id AND l.bin = r.lo - 1 LEFT JOIN h x ON x.chain_id = r.chain_id AND x.bin = r.hi + 1
 WHERE r.mass < 0.68e0 AND (l.p IS NOT NULL OR x.p IS NOT NULL)),
z AS (SELECT chain_id, MIN(lo) AS lo, MAX(hi) AS hi, MAX(mass) AS mass FROM r GROUP BY 1)
SELECT z.chain_id, a.t AS t_lo, b.t AS t_hi, ROUND(z.mass, 9) AS mass, z.hi - z.lo + 1 AS bars FROM z
JOIN h a ON a.chain_id = z.chain_id AND a.bin = z.lo JOIN h b ON b.chain_id = z.chain_id AND b.bin = z.hi""", "chain"))
def a12_hdpi(spark, sf):
    hist = H.histogram(chain(spark, sf), "value", HD_EDGES, density=True, by=["chain_id"])
    bars = hist.select(
        "chain_id", "bin", ((F.col("lo") + F.col("hi")) * 0.5).alias("t"),
        (F.col("density") * (F.col("hi") - F.col("lo"))).alias("p"),
    )
    return rounded(H.hdpi(bars, 0.68, ["chain_id"]), 9, "mass")


@query("a18_offset_fit", sql("""
SELECT field_id, ROUND(AVG(f1-f0), 9) AS mean_dx, ROUND(AVG(f2-f0), 9) AS mean_dy,
ROUND(REGR_SLOPE(f1-f0, f0), 9) + 0e0 AS slope, ROUND(REGR_INTERCEPT(f1-f0, f0), 9) + 0e0 AS intercept FROM det GROUP BY 1""", "det"))
def a18_offset_fit(spark, sf):
    dets = detections(spark, sf).withColumns({"dx": F.col("f1") - F.col("f0"), "dy": F.col("f2") - F.col("f0")})
    return rounded(E.offset_fit(dets, "f0", "dx", "dy", ["field_id"]), 9)


J10 = """seen AS (SELECT d.field_id, d.sample_id, d.src, d.f0, p.image, p.error, p.mask FROM det d JOIN pix p
 ON p.map_id = d.field_id AND p.row_ = CAST(FLOOR(d.y) AS BIGINT) AND p.col_ = CAST(FLOOR(d.x) AS BIGINT))"""


@query("j10_at_pixel", sql(f"""
WITH {J10} SELECT field_id, sample_id, src, ROUND(image, 9) AS image, error, mask FROM seen WHERE mask = 1 AND error > 0""", "det", "pix"))
def j10_at_pixel(spark, sf):
    out = L.at_pixel(detections(spark, sf, True), pixels(spark, sf)).where((F.col("mask") == 1) & (F.col("error") > 0))
    return rounded(out.select("field_id", "sample_id", "src", "image", "error", "mask"), 9, "image")


@query("a22_source_number", sql(f"""
WITH {J10}, k AS (SELECT DISTINCT field_id, sample_id FROM det),
n AS (SELECT k.field_id, k.sample_id, COUNT(seen.src) AS nsrc FROM k LEFT JOIN seen ON k.field_id = seen.field_id
 AND k.sample_id = seen.sample_id AND seen.mask = 1 AND seen.error > 0 GROUP BY 1, 2)
SELECT field_id, sample_id, nsrc, MEDIAN(nsrc) OVER (PARTITION BY field_id) AS median FROM n""", "det", "pix"))
def a22_source_number(spark, sf):
    return L.source_number(detections(spark, sf), pixels(spark, sf))


X_EDGES = log_edges(500.0, 20000.0, 12)
AREA = "area AS (SELECT 5e2 + s_suppkey * 1.5e2 AS energy, 3e2 + s_acctbal / 1e2 AS area FROM supplier)"


@query("a27_spectrum", sql(f"""
WITH {AREA},
c AS (SELECT {bin_case('energy', X_EDGES, True)} AS bin, COUNT(*) AS n FROM xev WHERE x > 1e1 AND x < 9e1 AND y > 1e1 AND y < 9e1 GROUP BY 1),
a AS (SELECT {bin_case('energy', X_EDGES, True)} AS bin, AVG(area) AS area FROM area GROUP BY 1)
SELECT b.bin, b.lo, b.hi, COALESCE(c.n, 0) AS n, ROUND(a.area, 6) AS area,
ROUND(COALESCE(c.n, 0)/(5e1*2e-4*(b.hi-b.lo)*a.area), 9) AS flux
FROM {bin_rows(X_EDGES)} b LEFT JOIN c ON b.bin = c.bin LEFT JOIN a ON b.bin = a.bin""", "xev"))
def a27_spectrum(spark, sf):
    area = table(spark, sf, "supplier").select(
        (F.lit(5e2) + F.col("s_suppkey") * 1.5e2).alias("energy"), (F.lit(3e2) + F.col("s_acctbal") / 1e2).alias("area")
    )
    out = X.spectrum(photons(spark, sf), area, X_EDGES, 50.0, 2e-4, (10, 90, 10, 90))
    return rounded(rounded(out, 6, "area"), 9, "flux")


BANDS = [500.0, 2000.0, 4000.0, 20000.0]


@query("a28_event_image", sql(f"""
SELECT obsid, {bin_case('energy', BANDS)} AS band, CAST(FLOOR(y) AS BIGINT) AS row_, CAST(FLOOR(x) AS BIGINT) AS col_, COUNT(*) AS n
FROM xev WHERE energy >= 5e2 AND energy < 2e4 GROUP BY 1, 2, 3, 4""", "xev"))
def a28_event_image(spark, sf):
    return X.event_image(photons(spark, sf), BANDS, ["obsid"])


@query("a28_merge_observations", sql(f"""
SELECT {bin_case('energy', BANDS)} AS band, CAST(FLOOR(y) AS BIGINT) AS row_, CAST(FLOOR(x) AS BIGINT) AS col_,
SUM(CASE obsid WHEN 0 THEN 1e0 WHEN 1 THEN 0.5e0 ELSE 0.25e0 END) AS value
FROM xev WHERE energy >= 5e2 AND energy < 2e4 GROUP BY 1, 2, 3""", "xev"))
def a28_merge_observations(spark, sf):
    images = X.event_image(photons(spark, sf), BANDS, ["obsid"])
    return X.merge_observations(images, {0: 1.0, 1: 0.5, 2: 0.25})


@query("a29_adjust_cov", sql("""
WITH c AS (SELECT field_id, VAR_SAMP(f1-f0) AS a, COVAR_SAMP(f1-f0, f2-f0) AS b, VAR_SAMP(f2-f0) AS d FROM det GROUP BY 1),
e AS (SELECT field_id, (a+0.02e0*0.02e0)*1.5e0+(1.2e0-1e0)*0.4e0 AS a, b*1.5e0 AS b, (d+0.008e0*0.008e0)*1.5e0+(1.14e0-1e0)*0.9e0 AS d FROM c)
SELECT field_id, CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c, ROUND(CASE WHEN r = 0 OR c = 0 THEN 0e0 WHEN r = 1 AND c = 1 THEN a
 WHEN r = 2 AND c = 2 THEN d ELSE b END, 9) + 0e0 AS value FROM e, (VALUES (0),(1),(2)) v(r), (VALUES (0),(1),(2)) w(c)""", "det"))
def a29_adjust_cov(spark, sf):
    dets = detections(spark, sf).select(
        "field_id", (F.col("f1") - F.col("f0")).alias("a"), (F.col("f2") - F.col("f0")).alias("b")
    )
    cov = E.pair_covariance(dets, "a", "b", ["field_id"])
    return rounded(E.adjust_cov(cov, (0.02, 0.008), 1.5, (1.2, 1.14), (0.4, 0.9), ["field_id"]), 9)


@query("a29_rotate_axes", sql("""
SELECT truth_id, ROUND(cos(p)*cos(p)*a*a+sin(p)*sin(p)*b*b, 9) AS caa, ROUND(cos(p)*sin(p)*(b*b-a*a), 9) + 0e0 AS cab,
ROUND(sin(p)*sin(p)*a*a+cos(p)*cos(p)*b*b, 9) AS cbb FROM (SELECT truth_id, f0 AS a, x/1e1 AS b, y/5e1 AS p FROM truth) q""", "truth"))
def a29_rotate_axes(spark, sf):
    caa, cab, cbb = E.rotated_cov(F.col("f0"), F.col("x") / 10.0, F.col("y") / 50.0)
    return rounded(truth(spark, sf).select("truth_id", caa.alias("caa"), cab.alias("cab"), cbb.alias("cbb")), 9)


def _ring(spark, sf):
    # Events laid on an ellipse with some scatter, one ellipse per user group.
    t = F.col("event_id") * 0.01
    u, v = F.cos(t) * (4.0 + F.col("value") / 1e3), F.sin(t) * (2.0 + F.col("value") / 1e3)
    return table(spark, sf, "events").select(
        (F.col("user_id") % 4).alias("group_id"), (u * 0.8 - v * 0.6 + 10.0).alias("x"), (u * 0.6 + v * 0.8 - 3.0).alias("y")
    )


RING = """ring AS (SELECT user_id % 4 AS group_id, u*0.8e0-v*0.6e0+1e1 AS x, u*0.6e0+v*0.8e0-3e0 AS y FROM
 (SELECT user_id, cos(event_id*0.01e0)*(4e0+value/1e3) AS u, sin(event_id*0.01e0)*(2e0+value/1e3) AS v FROM events) q)"""
_SUMS = ", ".join(
    f"ROUND(SUM({'*'.join(['(x-mx)'] * a + ['(y-my)'] * b) or '1e0'}), 5) + 0e0 AS m{a}{b}" for a, b in E.MOMENTS
)


@query("a30_ellipse_sums", f"""
WITH {RING}, c AS (SELECT group_id, AVG(x) AS mx, AVG(y) AS my FROM ring GROUP BY 1)
SELECT r.group_id, ROUND(ANY_VALUE(mx), 9) AS mean_x, ROUND(ANY_VALUE(my), 9) AS mean_y, {_SUMS}
FROM ring r JOIN c ON r.group_id = c.group_id GROUP BY 1""")
def a30_ellipse_sums(spark, sf):
    out = E.ellipse_moments(_ring(spark, sf), ["group_id"])
    return rounded(rounded(out, 9, "mean_x", "mean_y"), 5, *[f"m{a}{b}" for a, b in E.MOMENTS])


def _ellipse_sql() -> str:
    """The fit in plain SQL: the 3 x 3 eigenproblem has a cubic, and an eigenvector is a cross product of two rows."""
    curved, flat = [(2, 0), (1, 1), (0, 2)], [(1, 0), (0, 1), (0, 0)]
    m = lambda p, q: f"m{p[0] + q[0]}{p[1] + q[1]}"
    sums = ", ".join(f"SUM({'*'.join(['(x-mx)'] * a + ['(y-my)'] * b) or '1e0'}) AS m{a}{b}" for a, b in E.MOMENTS)
    t = [[m(p, q) for q in flat] for p in flat]
    minor = lambda r, c: "({}*{}-{}*{})".format(*(t[(r + 1) % 3][(c + 1) % 3], t[(r + 2) % 3][(c + 2) % 3], t[(r + 1) % 3][(c + 2) % 3], t[(r + 2) % 3][(c + 1) % 3]))
    det = "+".join(f"{t[0][c]}*{minor(0, c)}" for c in range(3))
    follow = ", ".join("-(" + "+".join(f"{minor(k, r)}*{m(flat[k], curved[c])}" for k in range(3)) + f")/dt AS t{r}{c}" for r in range(3) for c in range(3))
    rest = ", ".join(m(curved[r], curved[c]) + "".join(f"+{m(curved[r], flat[k])}*t{k}{c}" for k in range(3)) + f" AS r{r}{c}" for r in range(3) for c in range(3))
    form = ", ".join([f"0.5e0*r2{c} AS n0{c}, -r1{c} AS n1{c}, 0.5e0*r0{c} AS n2{c}" for c in range(3)])
    cross = lambda a, b: [f"({a}{(k + 1) % 3}*{b}{(k + 2) % 3}-{a}{(k + 2) % 3}*{b}{(k + 1) % 3})" for k in range(3)]
    shifted = ", ".join(f"n{r}{c}{'-l' if r == c else ''} AS s{r}{c}" for r in range(3) for c in range(3))
    crosses = ", ".join(f"{e} AS {name}{k}" for name, (a, b) in (("u", ("s0", "s1")), ("v", ("s0", "s2")), ("w", ("s1", "s2"))) for k, e in enumerate(cross(a, b)))
    size = lambda n: f"({n}0*{n}0+{n}1*{n}1+{n}2*{n}2)"
    longest = ", ".join(f"CASE WHEN {size('u')} >= {size('v')} AND {size('u')} >= {size('w')} THEN u{k} WHEN {size('v')} >= {size('w')} THEN v{k} ELSE w{k} END AS q{k}" for k in range(3))
    return f"""
WITH {RING}, c AS (SELECT group_id, AVG(x) AS mx, AVG(y) AS my FROM ring GROUP BY 1),
m AS (SELECT r.group_id, ANY_VALUE(mx) AS mx, ANY_VALUE(my) AS my, {sums} FROM ring r JOIN c ON r.group_id = c.group_id GROUP BY 1),
d AS (SELECT *, {det} AS dt FROM m), f AS (SELECT *, {follow} FROM d), r AS (SELECT *, {rest} FROM f), n AS (SELECT *, {form} FROM r),
e AS (SELECT *, n00+n11+n22 AS tr, n00*n11-n01*n10+n00*n22-n02*n20+n11*n22-n12*n21 AS mi,
 n00*(n11*n22-n12*n21)-n01*(n10*n22-n12*n20)+n02*(n10*n21-n11*n20) AS de FROM n),
g AS (SELECT *, (tr*tr-3e0*mi)/9e0 AS q, (2e0*tr*tr*tr-9e0*tr*mi+27e0*de)/54e0 AS r FROM e),
l AS (SELECT g.*, tr/3e0 + 2e0*SQRT(q)*COS((ACOS(GREATEST(-1e0, LEAST(1e0, r/(q*SQRT(q))))) + 2e0*PI()*k)/3e0) AS l FROM g, (SELECT UNNEST(range(3)) AS k) kk),
s AS (SELECT *, {shifted} FROM l), x AS (SELECT *, {crosses} FROM s), v AS (SELECT *, {longest} FROM x),
b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY group_id ORDER BY (4e0*q0*q2-q1*q1)/{size('q')} DESC) AS rn FROM v),
o AS (SELECT group_id, mx, my, q0, q1, q2, {', '.join(f't{k}0*q0+t{k}1*q1+t{k}2*q2 AS q{k + 3}' for k in range(3))} FROM b WHERE rn = 1),
z AS (SELECT *, (q1*q4-2e0*q2*q3)/(4e0*q0*q2-q1*q1) AS cx, (q1*q3-2e0*q0*q4)/(4e0*q0*q2-q1*q1) AS cy, 0.5e0*ATAN(q1/(q0-q2)) AS phi FROM o),
h AS (SELECT *, -(q5+0.5e0*(q3*cx+q4*cy)) AS lv FROM z),
a AS (SELECT *, SQRT(lv/(q0*COS(phi)*COS(phi)+q1*COS(phi)*SIN(phi)+q2*SIN(phi)*SIN(phi))) AS a1,
 SQRT(lv/((q0+q2-SQRT((q0-q2)*(q0-q2)+q1*q1))/2e0)) AS h1, SQRT(lv/((q0+q2+SQRT((q0-q2)*(q0-q2)+q1*q1))/2e0)) AS h2 FROM h)
SELECT group_id, ROUND(cx+mx, 6) + 0e0 AS x0, ROUND(cy+my, 6) + 0e0 AS y0, ROUND(phi, 6) + 0e0 AS phi, ROUND(a1, 6) + 0e0 AS axis_1,
 ROUND(CASE WHEN ABS(h1-a1) > ABS(h2-a1) THEN h1 ELSE h2 END, 6) + 0e0 AS axis_2 FROM a"""


@query("a30_fit_ellipse", _ellipse_sql())
def a30_fit_ellipse(spark, sf):
    return rounded(E.fit_ellipse(_ring(spark, sf), ["group_id"]), 6)


MAG_EDGES = linear_edges(14.0, 22.0, 16)
COLOUR_EDGES = linear_edges(-0.3, 0.3, 12)


def _posterior_sql(source: str, column: str, edges) -> str:
    return f"""
k AS (SELECT DISTINCT field_id, sample_id FROM {source}),
g AS (SELECT field_id, sample_id, bin, hi - lo AS width FROM k, {bin_rows(edges)} b),
c AS (SELECT field_id, sample_id, {bin_case(column, edges, True)} AS bin, COUNT(*) AS n FROM {source} GROUP BY 1, 2, 3),
m AS (SELECT g.field_id, g.bin, MEDIAN(COALESCE(c.n, 0)+0.01e0) AS med, STDDEV_POP(COALESCE(c.n, 0)+0.01e0) AS sd, ANY_VALUE(g.width) AS width
 FROM g LEFT JOIN c ON g.field_id = c.field_id AND g.sample_id = c.sample_id AND g.bin = c.bin GROUP BY 1, 2)
SELECT field_id, bin, ROUND(med, 9) AS median, ROUND(sd, 9) AS std,
ROUND(med/(SUM(med) OVER (PARTITION BY field_id)*width), 9) AS density FROM m"""


@query("a34_magnitude_posterior", sql(f"WITH d AS (SELECT *, 22.5e0-2.5e0*log10(f0*5e-1) AS mag FROM det), {_posterior_sql('d', 'mag', MAG_EDGES)}", "det"))
def a34_magnitude_posterior(spark, sf):
    dets = detections(spark, sf).withColumn("mag", P.flux_to_mag(F.col("f0"), F.lit(5e-1)))
    return rounded(H.sample_posterior(dets, "mag", MAG_EDGES), 9)


@query("a34_bright_colour_posterior", sql(f"""
WITH d AS (SELECT d.*, 2.5e0*log10(f0/f2) AS colour FROM det d
JOIN (SELECT field_id, sample_id, LEAST(50, FLOOR(COUNT(*) / 3e0)) AS k FROM det GROUP BY 1, 2) c
ON d.field_id = c.field_id AND d.sample_id = c.sample_id WHERE d.src + 1 <= c.k), {_posterior_sql('d', 'colour', COLOUR_EDGES)}""", "det"))
def a34_bright_colour_posterior(spark, sf):
    top = K.brightest(detections(spark, sf), 50, share=3, ties=("x", "y", "f1", "f2"))
    coloured = top.withColumn("colour", P.color(F.col("f0"), F.col("f2"), "log"))
    return rounded(H.sample_posterior(coloured, "colour", COLOUR_EDGES), 9)
