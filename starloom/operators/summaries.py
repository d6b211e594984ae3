"""Summaries of matches, catalogs, proposals and runs."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, functions as F

from starloom.operators.bins import bin_index, edge_table
from starloom.operators.quantiles import exact_quantiles


# Percent points of a posterior summary.
PERCENTS = {"p5": 0.05, "p16": 0.16, "p50": 0.5, "p84": 0.84, "p95": 0.95}


def flux_error_summary(matches: DataFrame, on: Sequence[str] = ("field_id", "truth_id")) -> DataFrame:
    """Per truth and band over its matched samples: median, p16, p84 of the
    error and of the recovered flux. A group holds one value per sample."""
    points = {"p16": 0.16, "med": 0.5, "p84": 0.84}
    probs = F.array(*[F.lit(p) for p in points.values()])
    stats = matches.groupBy(*on, "band").agg(
        F.count(F.lit(1)).alias("hits"), F.first("true_flux").alias("true_flux"),
        F.percentile("error", probs).alias("_err"), F.percentile("flux", probs).alias("_flux"),
    )
    picked = [
        F.element_at(f"_{source}", k).alias(f"{tag}_{source}")
        for source in ("err", "flux")
        for k, tag in enumerate(points, start=1)
    ]
    return stats.select(*on, "band", "hits", "true_flux", *picked)


def bin_flux_errors(summary: DataFrame, edges: Sequence[float]) -> DataFrame:
    """Per band and flux bar: median, p16, p84 of the sources' median errors.
    Sources pool over all fields, so the percentiles are the distributed ones."""
    binned = summary.withColumn("bin", bin_index(F.col("true_flux"), edges)).where(
        F.col("bin").isNotNull()
    )
    return exact_quantiles(
        binned, ["band", "bin"], "med_err", {"med_err": 0.5, "p16_err": 0.16, "p84_err": 0.84}
    )


def bin_bars(binned: DataFrame, edges: Sequence[float]) -> DataFrame:
    """Geometric bar centre, both half widths, and error bars over sqrt(n)."""
    centre = F.sqrt(F.col("lo") * F.col("hi"))
    root = F.sqrt("n")
    return binned.join(edge_table(binned.sparkSession, edges), "bin").select(
        "bin", "n", centre.alias("centre"), (centre - F.col("lo")).alias("x_lo"), (F.col("hi") - centre).alias("x_hi"),
        ((F.col("med_err") - F.col("p16_err")) / root).alias("y_lo"),
        ((F.col("p84_err") - F.col("med_err")) / root).alias("y_hi"),
    )


def multiplicity(dets: DataFrame, box: Sequence[float], nsamp: int) -> DataFrame:
    """Share of samples with one, two and more detections in the box. A sample
    without detections counts as none of the three."""
    x0, x1, y0, y1 = box
    x, y = F.col("x"), F.col("y")
    inside = ((x > x0) & (x < x1) & (y > y0) & (y < y1)).cast("int")
    per_sample = dets.groupBy("cfg_id", "sample_id").agg(F.sum(inside).alias("k"))
    share = lambda cond: F.sum(cond.cast("int")) / F.lit(float(nsamp))
    return per_sample.groupBy("cfg_id").agg(
        share(F.col("k") == 1).alias("one"), share(F.col("k") == 2).alias("two"), share(F.col("k") > 2).alias("more")
    )


def error_panel(
    df: DataFrame, cases: Iterable[int], offsets: Iterable[int], nsamp: int, nreal: int
) -> DataFrame:
    """Mean error and its scatter over sqrt(samples * realisations) on the full
    (case, offset) grid; NULL mean and zero scatter where nothing was run."""
    spark = df.sparkSession
    cases, offsets = list(cases), list(offsets)
    n = len(offsets)
    grid = spark.range(len(cases) * n).select(
        F.element_at(F.array(*[F.lit(int(c)) for c in cases]), (F.floor(F.col("id") / n) + 1).cast("int"))
        .cast("bigint").alias("case_"),
        F.element_at(F.array(*[F.lit(int(o)) for o in offsets]), (F.col("id") % n + 1).cast("int"))
        .cast("bigint").alias("offset_"),
    )
    stats = df.groupBy("case_", "offset_").agg(
        F.avg("err").alias("mean_err"),
        (F.stddev_pop("err") / F.sqrt(F.lit(float(nsamp * nreal)))).alias("std_err"),
    )
    return grid.join(stats, ["case_", "offset_"], "left").withColumn(
        "std_err", F.coalesce("std_err", F.lit(0.0))
    )
