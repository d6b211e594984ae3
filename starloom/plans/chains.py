"""Queries over chains, proposals and streams: A1, A11-A16, A26, A36, W1-W3, W6, ST."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.operators import chains as C
from starloom.operators.summaries import PERCENTS
from starloom.plans.oracle import ORACLES, query, rounded, sql
from starloom.sources.fixtures import chain, coefficients, proposals, table
from starloom.streaming.monitor import monitor, monitored, running_state, running_states


def _summary_sql(by: str) -> str:
    return f"""SELECT {by}, COUNT(*) AS n, {', '.join(f'ROUND(QUANTILE_CONT(value, {p}e0), 9) AS {name}' for name, p in PERCENTS.items())},
ROUND(AVG(value), 9) AS mean, ROUND(STDDEV_POP(value), 9) AS std, ROUND(MEDIAN(value) - 5e1, 9) + 0e0 AS "offset",
ROUND(QUANTILE_CONT(value, 0.84e0) - MEDIAN(value), 9) AS up, ROUND(MEDIAN(value) - QUANTILE_CONT(value, 0.16e0), 9) AS down
FROM (SELECT user_id % 4 AS run, event_type AS band, value FROM events) q GROUP BY {by}"""


def _draws(spark, sf):
    return table(spark, sf, "events").select((F.col("user_id") % 4).alias("run"), F.col("event_type").alias("band"), "value")


@query("a1_posterior_summary", _summary_sql("run, band"))
def a1_posterior_summary(spark, sf):
    return rounded(C.posterior_summary(_draws(spark, sf), ["run", "band"], PERCENTS, injected=50.0), 9)


@query("a1_pooled_summary", _summary_sql("band"))
def a1_pooled_summary(spark, sf):
    return rounded(C.posterior_summary(_draws(spark, sf), ["band"], PERCENTS, injected=50.0), 9)


# R-hat compares chains of equal length: all are cut to the shortest here.
EQUAL = "(SELECT * FROM chain WHERE i < (SELECT MIN(n) FROM (SELECT COUNT(*) AS n FROM chain GROUP BY chain_id) q))"


def _equal(spark, sf):
    whole = chain(spark, sf)
    sizes = whole.groupBy("chain_id").agg(F.count(F.lit(1)).alias("n"))
    return whole.where(F.col("i") < sizes.agg(F.min("n")).scalar())


RHAT = """
s AS (SELECT chain_id, COUNT(*) AS n, AVG(value) AS mean, VAR_SAMP(value) AS v FROM c GROUP BY 1),
g AS (SELECT COUNT(*) AS m, MIN(n) AS n, AVG(mean) AS grand, AVG(v) AS w FROM s),
b AS (SELECT SUM((s.mean-g.grand)*(s.mean-g.grand))*ANY_VALUE(g.n)/(ANY_VALUE(g.m)-1) AS b FROM s, g)
SELECT g.m, g.n, ROUND(SQRT(((g.n-1)/CAST(g.n AS DOUBLE)*g.w + b.b/g.n)/g.w), 9) AS rhat FROM g, b"""


@query("a11_rhat", sql(f"WITH c AS {EQUAL}, {RHAT}", "chain"))
def a11_rhat(spark, sf):
    return rounded(C.rhat(_equal(spark, sf)), 9, "rhat")


@query("a11_rhat_thinned", sql(f"WITH c AS (SELECT * FROM {EQUAL} e WHERE i % 3 = 0 AND i >= 99), {RHAT}", "chain"))
def a11_rhat_thinned(spark, sf):
    return rounded(C.rhat(_equal(spark, sf), i0=100, nthin=3), 9, "rhat")


@query("w1_moving_average", sql("""
SELECT chain_id, i, ROUND(average, 9) AS average FROM (SELECT chain_id, i,
AVG(value) OVER (PARTITION BY chain_id ORDER BY i ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) AS average FROM chain) q WHERE i >= 24""", "chain"))
def w1_moving_average(spark, sf):
    return rounded(C.moving_average(chain(spark, sf), 25), 9, "average")


def _xi_sql(source: str) -> str:
    return f"""
s AS MATERIALIZED (SELECT chain_id, i, value - AVG(value) OVER (PARTITION BY chain_id) AS v, COUNT(*) OVER (PARTITION BY chain_id) AS n FROM {source}),
a AS MATERIALIZED (SELECT chain_id, n, v, i, UNNEST(range(n // 2)) AS lag FROM s),
p AS MATERIALIZED (SELECT chain_id, lag, v, (i + lag) % n AS j FROM a),
l AS (SELECT p.chain_id, p.lag, SUM(p.v*b.v) AS c FROM p JOIN s b ON p.chain_id = b.chain_id AND b.i = p.j GROUP BY 1, 2),
xi AS (SELECT l.chain_id, l.lag, l.c / z.c AS xi FROM l JOIN l z ON l.chain_id = z.chain_id AND z.lag = 0)"""


@query("w2_autocorrelation", sql(f"WITH {_xi_sql('chain')} SELECT chain_id, lag, ROUND(xi, 9) + 0e0 AS xi FROM xi", "chain"))
def w2_autocorrelation(spark, sf):
    return rounded(C.autocorr(chain(spark, sf)), 9, "xi")


@query("w2_autocorrelation_time", sql(f"""
WITH m AS (SELECT chain_id, i - 24 AS i, average AS value FROM (SELECT chain_id, i,
 AVG(value) OVER (PARTITION BY chain_id ORDER BY i ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) AS average FROM chain) q WHERE i >= 24),
{_xi_sql('m')}
SELECT chain_id, COUNT(*) - 1 AS tau, MEDIAN(COUNT(*) - 1) OVER () AS median_tau FROM xi WHERE xi > 0.2e0 GROUP BY 1""", "chain"))
def w2_autocorrelation_time(spark, sf):
    """Of the averaged chains, which remember about a window's length."""
    slow = C.moving_average(chain(spark, sf), 25).select(
        "chain_id", (F.col("i") - 24).alias("i"), F.col("average").alias("value")
    )
    return C.median_tau(C.tau(C.autocorr(slow)))


@query("w3_geweke", sql("""
WITH n AS (SELECT chain_id, COUNT(*) AS len FROM chain GROUP BY 1),
st AS (SELECT chain_id, len, k, CASE WHEN k = 19 THEN CAST(FLOOR(len*0.5e0) AS BIGINT) ELSE CAST(FLOOR(k*(FLOOR(len*0.5e0)/19e0)) AS BIGINT) END AS s
 FROM n, (SELECT UNNEST(range(20)) AS k) g),
sl AS (SELECT chain_id, k, s, 0 AS part, s AS a, s + CAST(FLOOR((len-s)*0.1e0) AS BIGINT) AS b FROM st UNION ALL
 SELECT chain_id, k, s, 1, s + CAST(FLOOR((len-s)*0.5e0) AS BIGINT), len FROM st),
r AS (SELECT sl.chain_id, sl.k, sl.s, sl.part, c.i, c.value - AVG(c.value) OVER w AS x, AVG(c.value) OVER w AS m, COUNT(*) OVER w AS n
 FROM sl JOIN chain c ON c.chain_id = sl.chain_id AND c.i >= sl.a AND c.i < sl.b WINDOW w AS (PARTITION BY sl.chain_id, sl.k, sl.part)),
q AS (SELECT *, LAG(x, 1) OVER (PARTITION BY chain_id, k, part ORDER BY i) AS x1, LAG(x, 2) OVER (PARTITION BY chain_id, k, part ORDER BY i) AS x2 FROM r),
t AS (SELECT chain_id, k, s, part, ANY_VALUE(m) AS m, ANY_VALUE(n) AS n, SUM(x*x)/ANY_VALUE(n) AS r0, SUM(x*x1)/(ANY_VALUE(n)-1) AS r1, SUM(x*x2)/(ANY_VALUE(n)-2) AS r2 FROM q GROUP BY 1, 2, 3, 4),
b AS (SELECT *, (r1*r0-r1*r2)/(r0*r0-r1*r1) AS b1, (r0*r2-r1*r1)/(r0*r0-r1*r1) AS b2 FROM t),
v AS (SELECT *, (r0-r1*b1-r2*b2)/((1-b1-b2)*(1-b1-b2))/n AS v FROM b)
SELECT f.chain_id, f.k, f.s AS start, ROUND((f.m-l.m)/SQRT(f.v+l.v), 6) + 0e0 AS z FROM v f JOIN v l
ON f.chain_id = l.chain_id AND f.k = l.k AND f.part = 0 AND l.part = 1""", "chain"))
def w3_geweke(spark, sf):
    return rounded(C.geweke(chain(spark, sf)), 6, "z")


@query("w6_trace", sql("SELECT chain_id, i, value FROM chain WHERE i >= 500", "chain"))
def w6_trace(spark, sf):
    return C.trace(chain(spark, sf), 500)


@query("a13_cov_matrix", sql("""
WITH v AS (SELECT sample_id, i*3+j AS param, AVG(value) AS value FROM coeffs GROUP BY 1, 2)
SELECT a.param AS i, b.param AS j, ROUND(COVAR_SAMP(a.value, b.value), 9) + 0e0 AS cov, ROUND(CORR(a.value, b.value), 9) + 0e0 AS corr
FROM v a JOIN v b ON a.sample_id = b.sample_id AND a.param <= b.param GROUP BY 1, 2""", "coeffs"))
def a13_cov_matrix(spark, sf):
    means = (
        coefficients(spark, sf).groupBy("sample_id", (F.col("i") * 3 + F.col("j")).alias("param"))
        .agg(F.avg("value").alias("value"))
    )
    return rounded(C.cov_matrix(means, 9), 9)


@query("a15_acceptance", sql("""
SELECT sample, move, COUNT(*) AS n, ROUND(AVG(accepted), 9) AS acceptance, ROUND(AVG(out_of_bounds), 9) AS out_of_bounds
FROM proposals GROUP BY GROUPING SETS ((sample, move), (sample))""", "proposals"))
def a15_acceptance(spark, sf):
    return rounded(C.acceptance(proposals(spark, sf)), 9)


@query("a16_time_budget", sql("""
SELECT move, ROUND(SUM(ms), 6) AS total, ROUND(SUM(ms)/SUM(SUM(ms)) OVER (), 9) AS share FROM proposals GROUP BY 1""", "proposals"))
def a16_time_budget(spark, sf):
    return rounded(rounded(C.time_budget(proposals(spark, sf)), 6, "total"), 9, "share")


@query("a26_background_means", sql("""
SELECT chain_id, i % 3 AS band, ROUND(AVG(value), 9) AS mean FROM chain WHERE i >= 400 GROUP BY 1, 2""", "chain"))
def a26_background_means(spark, sf):
    banded = chain(spark, sf).withColumn("band", F.col("i") % 3)
    return rounded(C.background_means(banded, 400, ["chain_id", "band"]), 9, "mean")


@query("a36_corrected_posterior", sql("""
WITH u AS (SELECT chain_id, i, value, MEDIAN(value) OVER (PARTITION BY chain_id) AS med,
 (CAST('0x' || SUBSTR(MD5('7|' || chain_id || '|' || i), 1, 8) AS BIGINT) + 0.5e0) / 4294967296e0 AS u1,
 (CAST('0x' || SUBSTR(MD5('7|' || chain_id || '|' || i), 9, 8) AS BIGINT) + 0.5e0) / 4294967296e0 AS u2 FROM chain)
SELECT chain_id, i, value, ROUND((value - med) + SQRT(-2e0 * LN(u1)) * COS(2e0 * PI() * u2) * 0.02e0
 + SQRT(-2e0 * LN(u1)) * SIN(2e0 * PI() * u2) * 0.005e0 + (0.3e0 + med), 9) AS corrected FROM u""", "chain"))
def a36_corrected_posterior(spark, sf):
    return rounded(C.corrected_posterior(chain(spark, sf), 0.3, 0.02, 0.005, seed=7, by=["chain_id"]), 9, "corrected")


MOVES = ("click", "error", "purchase", "signup", "view")


def samples(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        (F.col("user_id") % 4).alias("run_id"), "ts", F.col("event_type").alias("move"),
        F.when(F.col("value") < 50, 1.0).otherwise(0.0).alias("accepted"),
        F.when(F.col("value") > 150, 1.0).otherwise(0.0).alias("out_of_bounds"),
        (F.col("value") * 2.0).alias("chi2"), (F.col("event_id") % 500).alias("nsrc"), F.col("value").alias("ms"),
    )


_PER_MOVE = ", ".join(f"ROUND(AVG(CASE WHEN event_type = '{m}' AND value < 50 THEN 1e0 WHEN event_type = '{m}' THEN 0e0 END), 9) AS acceptance_{m}" for m in MOVES)


@query("st1_chain_monitor", f"""
SELECT user_id % 4 AS run_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, COUNT(*) AS steps,
ROUND(AVG(CASE WHEN value < 50 THEN 1e0 ELSE 0e0 END), 9) AS acceptance, {_PER_MOVE},
ROUND(AVG(CASE WHEN value > 150 THEN 1e0 ELSE 0e0 END), 9) AS out_of_bounds, ROUND(AVG(value*2e0), 9) AS chi2,
MAX_BY(event_id % 500, ts) AS nsrc, ROUND(SUM(value), 6) AS total_ms FROM events GROUP BY 1, 2""")
def st1_chain_monitor(spark, sf):
    out = monitor(samples(spark, sf), MOVES)
    shown = out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))
    return rounded(rounded(shown, 6, "total_ms"), 9, *[c for c, t in shown.dtypes if t == "double" and c != "total_ms"])


@query("st2_chain_state", sql("""
SELECT chain_id, COUNT(*) AS n, ROUND(AVG(value), 9) AS mean, ROUND(VAR_SAMP(value), 6) AS var FROM chain GROUP BY 1""", "chain"))
def st2_chain_state(spark, sf):
    return rounded(rounded(running_state(chain(spark, sf)), 9, "mean"), 6, "var")


@query("st1_monitor_stream", ORACLES["st1_chain_monitor"])
def st1_monitor_stream(spark, sf):
    """The monitor as a stream: events arrive in three parts, the query is restarted after each."""
    out = monitored(samples(spark, sf), MOVES)
    shown = out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))
    return rounded(rounded(shown, 6, "total_ms"), 9, *[c for c, t in shown.dtypes if t == "double" and c != "total_ms"])


@query("st2_state_stream", ORACLES["st2_chain_state"])
def st2_state_stream(spark, sf):
    """The running state of the chains as a stream, as it stands after the last part."""
    rows = table(spark, sf, "events").select("ts", (F.col("user_id") % 4).alias("chain_id"), "value")
    return rounded(rounded(running_states(rows, ["chain_id", "value"]), 9, "mean"), 6, "var")
