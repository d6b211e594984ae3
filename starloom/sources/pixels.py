"""Pixel planes to pixel rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def assemble_pixels(
    planes: DataFrame, signal: Sequence[str], error: str = "ERROR", mask: str = "MASK", templates: Sequence[str] = ()
) -> DataFrame:
    """One row per pixel from plane rows (map_id, row_, col_, plane, value).
    Signal planes are summed, NaN counts as zero, a missing mask observes
    everything, templates become a map."""
    clean = F.coalesce(F.nanvl("value", F.lit(0.0)), F.lit(0.0))
    name = F.col("plane")
    pick = lambda cond: F.sum(F.when(cond, clean))
    zero = F.lit(0.0)
    cols = [
        F.coalesce(pick(name.isin(list(signal))), zero).alias("image"),
        F.coalesce(pick(name == error), zero).alias("error"),
        F.coalesce(pick(name == mask), F.lit(1.0)).cast("bigint").alias("mask"),
        *[pick(name == t).alias(f"_t_{t}") for t in templates],
    ]
    out = planes.groupBy("map_id", "row_", "col_").agg(*cols)
    if templates:
        entries = [e for t in templates for e in (F.lit(t), F.col(f"_t_{t}"))]
        out = out.withColumn("tmpl", F.create_map(*entries)).drop(*[f"_t_{t}" for t in templates])
    return out


def read_pixels(
    spark: SparkSession, path: str, signal: Sequence[str] = ("SIGNAL",), error: str = "ERROR", mask: str = "MASK",
    templates: Sequence[str] = (),
) -> DataFrame:
    """Pixel rows from a Parquet table of planes; only the planes asked for
    leave the scan."""
    wanted = [*signal, error, mask, *templates]
    planes = spark.read.parquet(path).where(F.col("plane").isin(wanted))
    return assemble_pixels(planes, signal, error, mask, templates)
