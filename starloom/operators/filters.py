"""Row selections on catalogs, chains and maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def _per_run(df: DataFrame, run: str, sample: str) -> DataFrame:
    # One row per run, combined before its shuffle; AQE broadcasts it when its
    # measured size allows and joins by shuffle otherwise.
    return df.groupBy(run).agg(F.max(sample).alias("_last"))


def tail_samples(df: DataFrame, n: int, run: str = "field_id", sample: str = "sample_id") -> DataFrame:
    """The last n samples of every run."""
    return (
        df.join(_per_run(df, run, sample), run)
        .where(F.col(sample) > F.col("_last") - n)
        .drop("_last")
    )


def burn_in(df: DataFrame, frac: float, run: str = "field_id", sample: str = "sample_id") -> DataFrame:
    """Drop the first `frac` of every run's samples."""
    return (
        df.join(_per_run(df, run, sample), run)
        .where(F.col(sample) >= F.floor((F.col("_last") + 1) * F.lit(float(frac))))
        .drop("_last")
    )


def thin(df: DataFrame, nthin: int, sample: str = "i") -> DataFrame:
    """Every nthin-th sample, from the first."""
    return df.where(F.pmod(F.col(sample), F.lit(nthin)) == 0)


def drop_padding(df: DataFrame, flux: str = "f0") -> DataFrame:
    """Zero flux marks an unused source slot."""
    return df.where(F.col(flux) > 0)


def edge_mask(
    df: DataFrame, width: float, height: float, margin: float, fmin: float, flux: str = "f0"
) -> DataFrame:
    """Sources strictly inside the margin and above the flux floor."""
    x, y = F.col("x"), F.col("y")
    return df.where(
        (x > margin) & (x < width - margin) & (y > margin) & (y < height - margin) & (F.col(flux) > fmin)
    )


def crop(df: DataFrame, x0: float, x1: float, y0: float, y1: float) -> DataFrame:
    """Sources in [x0, x1) x [y0, y1), with the corner as new origin."""
    x, y = F.col("x"), F.col("y")
    return (
        df.where((x >= x0) & (x < x1) & (y >= y0) & (y < y1))
        .withColumn("x", x - float(x0))
        .withColumn("y", y - float(y0))
    )


def red_sources(
    df: DataFrame,
    order: Sequence[str],
    flux_cut: float | None = None,
    flux: str | None = None,
    prevalence_cut: float | None = None,
    prevalence: str = "confidence",
) -> DataFrame:
    """Sources whose flux falls along the bands of `order`."""
    a, b, c = (F.col(name) for name in order)
    keep: Column = (F.try_divide(a, b) > 1.0) & (F.try_divide(b, c) > 1.0)
    if flux_cut is not None:
        keep = keep & (F.col(flux or order[0]) > flux_cut)
    if prevalence_cut is not None:
        keep = keep & (F.col(prevalence) > prevalence_cut)
    return df.where(keep)


def select_point_sources(df: DataFrame, box: Sequence[float], kind: int = 6) -> DataFrame:
    """Point sources of an object table in a box (rows, then columns) with all
    of bands 2-5 lit; 0-based positions from the box corner, fluxes in counts."""
    x0, x1, y0, y1 = map(float, box)
    row, col = F.col("objc_rowc"), F.col("objc_colc")
    flux, unit = F.col("psfflux"), F.col("nmgypercount")
    keep = (row > x0) & (row < x1) & (col > y0) & (col < y1) & (F.element_at("type", 1) == kind)
    for band in range(2, 6):
        keep = keep & (F.element_at(flux, band) > 0)
    bands = [
        (F.element_at(flux, band) / F.element_at(unit, band)).alias(f"counts_{name}")
        for band, name in zip(range(2, 6), "griz")
    ]
    rest = [c for c in df.columns if c not in ("type", "psfflux", "nmgypercount", "objc_rowc", "objc_colc")]
    return df.where(keep).select(*rest, (row - x0 - 1.0).alias("x"), (col - y0 - 1.0).alias("y"), *bands)


def mask_saturated(df: DataFrame, threshold: float, radius: int, plane: str = "image") -> DataFrame:
    """`weight` 0 in the square around every pixel above `threshold`, else 1.

    The square is grown one axis at a time, so a hot pixel is copied
    2(2r+1) times and not (2r+1)^2 times, and duplicates fall away between.
    """
    hot = df.where(F.col(plane) > threshold).select("map_id", "row_", "col_")
    reach = F.sequence(F.lit(-radius).cast("bigint"), F.lit(radius).cast("bigint"))
    grown = hot
    for axis in ("row_", "col_"):
        grown = (
            grown.withColumn("_d", F.explode(reach))
            .withColumn(axis, F.col(axis) + F.col("_d"))
            .drop("_d")
            .distinct()
        )
    grown = grown.withColumn("_hot", F.lit(True))
    return (
        df.join(grown, ["map_id", "row_", "col_"], "left")
        .withColumn("weight", F.when(F.col("_hot"), 0.0).otherwise(1.0))
        .drop("_hot")
    )
