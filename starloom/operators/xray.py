"""Photon events: spectra and images."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from starloom.operators.bins import bin_index, edge_table


def spectrum(
    events: DataFrame, area: DataFrame, edges: Sequence[float], exposure: float, steradians: float, box: Sequence[float]
) -> DataFrame:
    """Counts per energy bar over exposure, bar width, solid angle and the mean
    effective area of the bar; NULL where no area is listed."""
    x0, x1, y0, y1 = box
    x, y = F.col("x"), F.col("y")
    inside = events.where((x > x0) & (x < x1) & (y > y0) & (y < y1))
    counts = (
        inside.select(bin_index(F.col("energy"), edges, True).alias("bin"))
        .where(F.col("bin").isNotNull()).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    )
    mean_area = (
        area.select(bin_index(F.col("energy"), edges, True).alias("bin"), "area")
        .where(F.col("bin").isNotNull()).groupBy("bin").agg(F.avg("area").alias("area"))
    )
    out = edge_table(events.sparkSession, edges).join(counts, "bin", "left").join(mean_area, "bin", "left")
    n = F.coalesce("n", F.lit(0).cast("bigint"))
    rate = n / (F.lit(float(exposure) * steradians) * (F.col("hi") - F.col("lo")) * F.col("area"))
    return out.select("bin", "lo", "hi", n.alias("n"), "area", rate.alias("flux"))


def event_image(events: DataFrame, edges: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Photons per energy band and pixel."""
    return (
        events.select(
            *by, bin_index(F.col("energy"), edges).alias("band"), F.floor("y").alias("row_"), F.floor("x").alias("col_")
        )
        .where(F.col("band").isNotNull())
        .groupBy(*by, "band", "row_", "col_")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def merge_observations(images: DataFrame, weights: dict[int, float] | None = None) -> DataFrame:
    """Pixel sum over observations, weighted when weights are given."""
    value = F.col("n").cast("double")
    if weights:
        entries = [F.lit(v) for pair in weights.items() for v in pair]
        value = value * F.element_at(F.create_map(*entries), F.col("obsid").cast("int"))
    return images.groupBy("band", "row_", "col_").agg(F.sum(value).alias("value"))
