"""Queries through the sources and sinks: S2-S7, S9, S10."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from starloom.operators import filters as R
from starloom.plans.oracle import query, rounded, sql
from starloom.session import shared_folder
from starloom.sources import sinks, text
from starloom.sources.events import read_events, select_events
from starloom.sources.fixtures import detections, photons, table, truth


def _fresh(spark, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("s2_text_catalog", sql("SELECT x, y, ROUND(f0, 9) AS f0, ROUND(f0*0.95e0, 9) AS f1, ROUND(f0*1.15e0, 9) AS f2 FROM truth", "truth"))
def s2_text_catalog(spark, sf):
    """Truth written as whitespace text to the shared folder and read back."""
    path = _fresh(spark, "catalog")
    cat = truth(spark, sf).withColumns({"f1": F.col("f0") * 0.95, "f2": F.col("f0") * 1.15})
    sinks.write_text_catalog(cat, path, ["x", "y", "f0", "f1", "f2"])
    return rounded(text.read_text_catalog(spark, path), 9, "f0", "f1", "f2")


@query("s3_photometry", sql("""
SELECT truth_id, ROUND(x-20e0-1e0, 9) + 0e0 AS x, ROUND(y-30e0-1e0, 9) + 0e0 AS y, ROUND(pow(1e1, (22.5e0-(15e0+f0/5e1))/2.5e0)/5e-3, 6) AS counts_r,
ROUND(pow(1e1, (22.5e0-(14e0+f0/4e1))/2.5e0)/6e-3, 6) AS counts_i, ROUND(pow(1e1, (22.5e0-(16e0+f0/6e1))/2.5e0)/4e-3, 6) AS counts_g
FROM truth WHERE x > 2e1 AND x < 8e1 AND y > 3e1 AND y < 9e1""", "truth"))
def s3_photometry(spark, sf):
    """Wide photometry rows made from the truth table, as text."""
    f = F.col("f0")
    at = {20: F.col("x"), 21: F.col("y"), 22: f / 5e1 + 15.0, 29: f / 4e1 + 14.0, 15: f / 6e1 + 16.0, 36: f / 3e1}
    words = [at.get(k, F.lit(k)).cast("string") for k in range(40)]
    lines = truth(spark, sf).select("truth_id", F.concat_ws("  ", *words).alias("value"))
    out = text.parse_photometry(lines, {"r": 5e-3, "i": 6e-3, "g": 4e-3}, (20, 80, 30, 90))
    return rounded(rounded(out, 9, "x", "y"), 6, "counts_r", "counts_i", "counts_g")


@query("s4_point_sources", """
WITH e AS (SELECT vec_id, (vec_id*7919) % 1489/1e1 AS r, (vec_id*104729) % 1487/1e1 AS c, label, embedding FROM embeddings)
SELECT vec_id, ROUND(r-20e0-1e0, 9) + 0e0 AS x, ROUND(c-10e0-1e0, 9) + 0e0 AS y, ROUND(CAST(embedding[2] AS DOUBLE)/5e-3, 6) AS counts_g,
ROUND(CAST(embedding[3] AS DOUBLE)/6e-3, 6) AS counts_r, ROUND(CAST(embedding[4] AS DOUBLE)/7e-3, 6) AS counts_i, ROUND(CAST(embedding[5] AS DOUBLE)/8e-3, 6) AS counts_z
FROM e WHERE r > 2e1 AND r < 1.4e2 AND c > 1e1 AND c < 1.4e2 AND label = 6 AND embedding[2] > 0 AND embedding[3] > 0 AND embedding[4] > 0 AND embedding[5] > 0""")
def s4_point_sources(spark, sf):
    k = F.col("vec_id")
    objects = table(spark, sf, "embeddings").select(
        "vec_id", ((k * 7919) % 1489 / 1e1).alias("objc_rowc"), ((k * 104729) % 1487 / 1e1).alias("objc_colc"),
        F.array("label").alias("type"), F.col("embedding").cast("array<double>").alias("psfflux"),
        F.array(*[F.lit(v) for v in (4e-3, 5e-3, 6e-3, 7e-3, 8e-3)]).alias("nmgypercount"),
    )
    out = R.select_point_sources(objects, (20, 140, 10, 140))
    return rounded(rounded(out, 9, "x", "y"), 6, "counts_g", "counts_r", "counts_i", "counts_z")


@query("s5_reference_curve", "SELECT CAST(o_orderkey AS DOUBLE) AS x, o_totalprice AS y, 'prices' AS name FROM orders")
def s5_reference_curve(spark, sf):
    path = _fresh(spark, "curve")
    table(spark, sf, "orders").select("o_orderkey", "o_totalprice").write.csv(path)
    return text.read_curve(spark, path, "prices")


@query("s6_pix_header", """
SELECT s_suppkey, CAST(100 + s_suppkey % 50 AS INTEGER) AS w, CAST(90 AS INTEGER) AS h, CAST(1 AS INTEGER) AS nb, CAST(s_nationkey AS DOUBLE) AS bias,
s_acctbal AS gain, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 0.005e0 END AS k, CASE WHEN s_suppkey % 3 = 1 THEN 179e0 END AS background FROM supplier""")
def s6_pix_header(spark, sf):
    n = F.col("s_suppkey")
    last = F.when(n % 3 == 0, "").when(n % 3 == 1, "\n0.005 179.0").otherwise("\n0.005")
    texts = table(spark, sf, "supplier").select(
        n.alias("s_suppkey"),
        F.concat((n % 50 + 100).cast("string"), F.lit("\t90\t1\n"), F.col("s_nationkey").cast("string"), F.lit(" "), F.col("s_acctbal").cast("string"), last).alias("value"),
    )
    return text.parse_pix_header(texts)


@query("s7_run_registry", """
SELECT strftime(o_orderdate + to_seconds(o_orderkey), '%Y%m%d-%H%M%S') || '-' || CAST(o_orderkey AS VARCHAR) AS run_id,
'map: ' || o_orderstatus AS tail_name, CAST(o_custkey AS VARCHAR) AS max_nsrc, CAST(3 AS INTEGER) AS n_params FROM orders""")
def s7_run_registry(spark, sf):
    """Parameter lines of one run per order; a value may itself hold ': '."""
    k = F.col("o_orderkey")
    stamp = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + k), "yyyyMMdd-HHmmss")
    run = F.concat(stamp, F.lit("-"), k.cast("string"))
    lines = table(spark, sf, "orders").select(
        run.alias("run_id"),
        F.explode(F.array(
            F.concat(F.lit("tail_name: map: "), F.col("o_orderstatus")), F.concat(F.lit("max_nsrc: "), F.col("o_custkey").cast("string")),
            F.lit("verbosity: 0"), F.lit("not a parameter"),
        )).alias("value"),
    )
    out = text.parse_params(lines)
    return out.select("run_id", F.col("params")["tail_name"].alias("tail_name"), F.col("params")["max_nsrc"].alias("max_nsrc"), F.size("params").alias("n_params"))


@query("s9_result_sink", sql("SELECT truth_id, field_id, ROUND(x, 9) AS x, ROUND(f0, 9) AS f0 FROM truth", "truth"))
def s9_result_sink(spark, sf):
    """Two appends to a table partitioned by field, read back."""
    path = _fresh(spark, "results")
    cat = truth(spark, sf).select("truth_id", "field_id", "x", "f0")
    sinks.write_table(cat.where(F.col("f0") < 50), path, ["field_id"])
    sinks.write_table(cat.where(F.col("f0") >= 50), path, ["field_id"])
    back = spark.read.schema(cat.schema).parquet(path)
    return rounded(back.select("truth_id", "field_id", "x", "f0"), 9, "x", "f0")


@query("s10_read_events", """
SELECT event_id, value AS energy FROM events WHERE value >= 2e1 AND value <= 9e1""")
def s10_read_events(spark, sf):
    raw = table(spark, sf, "events").withColumnRenamed("value", "energy")
    return select_events(raw, energy=(20.0, 90.0), columns=["event_id", "energy"])


@query("s10_sky_region", sql("""
SELECT event_id, obsid, x, y, ROUND(energy, 6) AS energy FROM xev WHERE energy >= 1e3 AND energy <= 4e3 AND x BETWEEN 1e1 AND 6e1 AND y BETWEEN 2e1 AND 9e1""", "xev"))
def s10_sky_region(spark, sf):
    out = select_events(photons(spark, sf), (1000, 4000), (10, 60, 20, 90), ["event_id", "obsid", "x", "y", "energy"])
    return rounded(out, 6, "energy")
