"""Catalogs, chains, maps and events derived from the given tables.

Each function has a twin in plans/oracle.py: the same rows in plain SQL. No
view sorts or counts a whole group in one task (see operators/ordering.py).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from starloom.operators.ordering import distinct_positions, position_in_group

ID_BLOCK = 1 << 18
SLICE = 16.0  # flux of a sample's detections that are sorted together
TASK_ROWS = 1 << 18  # rows of a table that one task takes, see spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tasks_for(rows: DataFrame) -> int | None:
    """Tasks of some TASK_ROWS each for the rows of a table, none for a small one."""
    n = rows.count()
    return None if n <= TASK_ROWS else max(math.ceil(n / TASK_ROWS), rows.sparkSession.sparkContext.defaultParallelism)


def spread(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of a table dealt by `columns` to tasks of some TASK_ROWS each. What follows often
    makes several rows of one, so their number must not grow with the table; the count
    is read from the files' footers. Small tables are left to AQE."""
    n = tasks_for(rows)
    return rows.repartition(n, *columns) if n else rows.repartition(*columns)


def truth(spark: SparkSession, sf: str) -> DataFrame:
    """One true source per part."""
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        k.alias("truth_id"),
        F.floor(k / 2e3).alias("field_id"),
        ((k * 7919) % 10007 / 1e2).alias("x"),
        ((k * 104729) % 10009 / 1e2).alias("y"),
        (F.lit(2e0) + (k * 13) % 997 / 1e1).alias("f0"),
    )


def detections(spark: SparkSession, sf: str, slots: bool = False) -> DataFrame:
    """One noisy detection of a part per line item, in one of 30 samples.

    `slots` adds `src`, the slot of the detection in its sample, brightest
    first. `det_id` names a detection without any ordering.
    """
    ok, ln = F.col("l_orderkey"), F.col("l_linenumber")
    # Duplicates fall on the six raw columns everything else is computed from.
    raw_lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"
    )
    keep = [
        "field_id",
        "sample_id",
        "x",
        "y",
        "f0",
        (F.col("f0") * (F.lit(1e0) - F.col("disc"))).alias("f1"),
        (F.col("f0") * (F.lit(1e0) + F.col("tax")) * 1.1e0).alias("f2"),
    ]

    def noisy(lines, sources, *more):
        return lines.join(sources, F.col("l_partkey") == F.col("truth_id")).select(
            "field_id",
            (ok % 30).alias("sample_id"),
            "truth_id",
            ok.alias("okey"),
            ln.alias("lnum"),
            (F.col("x") + ((ok * 31 + ln * 17) % 101 - 50) / 2e2).alias("x"),
            (F.col("y") + ((ok * 37 + ln * 29) % 103 - 51) / 2e2).alias("y"),
            (F.col("f0") * (F.lit(0.75e0) + F.col("l_quantity") / 1e2)).alias("f0"),
            F.col("l_discount").alias("disc"),
            F.col("l_tax").alias("tax"),
            *more,
        )

    if not slots:
        return noisy(spread(raw_lines, raw_lines.columns).distinct(), truth(spark, sf)).select(*keep)
    # Lines are told apart where they are numbered, so they move once. A part that is
    # there several times keeps its copies apart.
    sources = truth(spark, sf)
    sources = sources.groupBy(*sources.columns).agg(F.count(F.lit(1)).alias("n")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    placed = distinct_positions(
        noisy(raw_lines, sources, "l_quantity", "copy"),
        ["field_id", "sample_id"],
        -F.floor(F.col("f0") / SLICE),
        [F.desc("f0"), F.asc("x"), F.asc("y"), F.asc("truth_id"), F.asc("okey"), F.asc("lnum")],
        "src",
        tasks_for(raw_lines),
    )
    return placed.select(*keep, "src")


def chain(spark: SparkSession, sf: str) -> DataFrame:
    """Four scalar chains, each as long as it is; i counts from 0."""
    events = table(spark, sf, "events").select(
        (F.col("user_id") % 4).alias("chain_id"), "event_id", "value"
    )
    placed = position_in_group(
        events, ["chain_id"], F.floor(F.col("event_id") / float(ID_BLOCK)), [F.asc("event_id")], "i"
    )
    return placed.select("chain_id", "i", "value")


def proposals(spark: SparkSession, sf: str) -> DataFrame:
    """Proposal log: move type, acceptance and cost of each step."""
    return table(spark, sf, "events").select(
        F.col("event_id").alias("step"),
        F.floor(F.col("event_id") / 1e3).alias("sample"),
        F.col("event_type").alias("move"),
        "ts",
        F.when(F.col("value") < 50, 1e0).otherwise(0e0).alias("accepted"),
        F.when(F.col("value") > 150, 1e0).otherwise(0e0).alias("out_of_bounds"),
        F.col("value").alias("ms"),
    )


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """32 x 32 maps; of the last one some pixels are not observed."""
    orders = table(spark, sf, "orders")
    p = F.col("o_orderkey") % 1024
    cust = F.col("o_custkey")
    return orders.select(
        F.floor(F.col("o_orderkey") / 1.024e3).alias("map_id"),
        F.floor(p / 3.2e1).alias("row_"),
        (p % 32).alias("col_"),
        (F.col("o_totalprice") / 1e5).alias("image"),
        F.when(cust % 97 == 0, 0e0).otherwise(F.lit(0.1e0) + cust % 10 / 2e1).alias("error"),
        F.when(F.col("o_orderstatus") == "P", 0).otherwise(1).alias("mask"),
    )


def photons(spark: SparkSession, sf: str) -> DataFrame:
    """Photon events with position, energy and observation."""
    k = F.col("event_id")
    return table(spark, sf, "events").select(
        k.alias("event_id"),
        "ts",
        ((k * 7919) % 10007 / 1e2).alias("x"),
        ((k * 104729) % 10009 / 1e2).alias("y"),
        (F.lit(5e2) + F.col("value") * 4e1).alias("energy"),
        (F.col("user_id") % 3).alias("obsid"),
    )


def models(spark: SparkSession, sf: str) -> DataFrame:
    """Model value of a pixel in each of seven samples."""
    p = F.col("l_orderkey") % 1024
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_linenumber").cast("bigint").alias("sample_id"), "l_orderkey")
        .agg(F.avg("l_extendedprice").alias("price"))
        .select(
            "sample_id",
            F.floor(F.col("l_orderkey") / 1.024e3).alias("map_id"),
            F.floor(p / 3.2e1).alias("row_"),
            (p % 32).alias("col_"),
            (F.col("price") / 3e4).alias("model"),
        )
    )


def coefficients(spark: SparkSession, sf: str) -> DataFrame:
    """Fourier coefficients of 3 x 3 terms, 4 products each, per sample; the last sample may lack some."""
    events = table(spark, sf, "events")
    p = F.col("event_id") % 36
    return events.select(
        F.floor(F.col("event_id") / 3.6e1).alias("sample_id"),
        F.floor(p / 1.2e1).alias("i"),
        F.floor(p % 12 / 4e0).alias("j"),
        (p % 4).alias("k"),
        ((F.col("value") - 5e1) / 1e2).alias("value"),
    )


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Run registry: one run per order, its simulation in the tail name."""
    return table(spark, sf, "orders").select(
        F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("run_id"),
        F.col("o_orderkey").alias("started"),
        F.concat(
            F.lit("field_sim_"), F.lpad((F.col("o_custkey") % 300).cast("string"), 3, "0")
        ).alias("tail_name"),
        F.col("o_orderstatus").alias("status"),
    )


def amplitudes(spark: SparkSession, sf: str) -> DataFrame:
    """Template amplitude per (sample, template, band)."""
    return (
        table(spark, sf, "events")
        .groupBy(
            F.floor(F.col("event_id") / 1e3).alias("sample_id"),
            (F.col("user_id") % 2).alias("tmpl"),
            (F.col("event_id") % 3).alias("band"),
        )
        .agg((F.avg("value") / 5e1).alias("amp"))
    )


def pair_detections(spark: SparkSession, sf: str) -> DataFrame:
    """Detections of two-source set-ups: one set-up per part, two sources near
    the origin, 30 samples."""
    ok, ln = F.col("l_orderkey"), F.col("l_linenumber")
    return (
        table(spark, sf, "lineitem")
        .select(
            F.col("l_partkey").alias("cfg_id"),
            (ok % 30).alias("sample_id"),
            (ok * 8 + ln).alias("det_id"),
            (((ok * 31 + ln * 17) % 101 - 50) / 2e2).alias("x"),
            (((ok * 37 + ln * 29) % 103 - 51) / 2e2).alias("y"),
            (F.lit(2.5e2) + F.col("l_quantity") * 2e1).alias("f"),
        )
        .distinct()
    )
