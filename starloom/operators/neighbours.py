"""Neighbour sums and blending odds inside one catalog."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from starloom.operators.spatial import radius_pairs

# FWHM of a Gaussian beam over its sigma, as used throughout.
FWHM_PER_SIGMA = 2.355
BISECTIONS = 60


def _others(cat: DataFrame, radius: float, on: Sequence[str], key: str, flux: str, inclusive: bool) -> DataFrame:
    left = cat.select(*on, F.col(key).alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col(flux).alias("a_f"))
    right = cat.select(*on, F.col(key).alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col(flux).alias("b_f"))
    return radius_pairs(left, right, radius, on, inclusive=inclusive).where(F.col("a_id") != F.col("b_id"))


def neighbour_weight(
    cat: DataFrame, h: float, on: Sequence[str] = ("field_id", "sample_id"), key: str = "src", reach: float = 8.6
) -> DataFrame:
    """Sum of exp(-d^2 / 2h^2) over the other sources. `reach` is in units of h;
    beyond the default a term is below 2^-53, the last bit of a double of 1."""
    near = (
        _others(cat, reach * h, on, key, "x", True)
        .groupBy(*on, F.col("a_id").alias(key))
        .agg(F.sum(F.exp(-F.col("d2") / F.lit(2.0 * h * h))).alias("_w"))
    )
    return cat.select(*on, key).join(near, [*on, key], "left").select(
        *on, key, F.coalesce("_w", F.lit(0.0)).alias("weight")
    )


def brightest_neighbour(
    cat: DataFrame, rmax: float, on: Sequence[str] = ("field_id",), key: str = "truth_id", flux: str = "f0"
) -> DataFrame:
    """The brightest other source closer than rmax, not at the same place."""
    best = F.max(F.struct("b_f", F.col("b_id"), F.sqrt("d2").alias("dist"))).alias("_m")
    return (
        _others(cat, rmax, on, key, flux, False)
        .where(F.col("d2") > 0)
        .groupBy(*on, F.col("a_id").alias(key))
        .agg(best, F.first("a_f").alias("flux"))
        .select(*on, key, "flux", F.col("_m.b_id").alias("neighbour"), F.col("_m.b_f").alias("neighbour_flux"), F.col("_m.dist").alias("dist"))
    )


FIT = T.StructType([T.StructField("best_flux", T.DoubleType()), T.StructField("dlogl", T.DoubleType())])


@F.pandas_udf(FIT)
def _one_source_fit(d: pd.Series, bright: pd.Series, faint: pd.Series, sigma: pd.Series, var: pd.Series) -> pd.DataFrame:
    """Best single source for a pair, and what two sources gain over it.

    The position solves a bracketed equation between the brighter source and
    the middle, by a fixed number of halvings over the whole batch.
    """
    d, f1, f2, s, bg = (v.to_numpy(dtype="float64") for v in (d, bright, faint, sigma, var))
    beam = lambda r: np.exp(-0.25 * r * r / (s * s))
    lo, hi = np.zeros_like(d), 0.5 * d
    for _ in range(BISECTIONS):
        mid = 0.5 * (lo + hi)
        up = f2 * beam(d - mid) * (d - mid) > f1 * beam(mid) * mid
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    x = 0.5 * (lo + hi)
    near, far = beam(x), beam(d - x)
    f0 = f1 * near + f2 * far
    # |one-source model - two-source truth|^2 with all beam overlaps.
    power = f0 * f0 + f1 * f1 + f2 * f2 + 2.0 * (f1 * f2 * beam(d) - f0 * (f1 * near + f2 * far))
    return pd.DataFrame({"best_flux": f0, "dlogl": power / (8.0 * np.pi * s * s * bg)})


def blend_odds(
    cat: DataFrame, rmax: float, fwhm: float, var: float, alpha: float,
    on: Sequence[str] = ("field_id",), key: str = "truth_id", flux: str = "f0",
) -> DataFrame:
    """For each source and its brightest neighbour: gain in log-likelihood of
    two sources over one, less the penalty, and the odds of seeing two."""
    pairs = brightest_neighbour(cat, rmax, on, key, flux)
    fit = _one_source_fit(
        "dist", F.greatest("flux", "neighbour_flux"), F.least("flux", "neighbour_flux"),
        F.lit(fwhm / FWHM_PER_SIGMA), F.lit(float(var)),
    )
    gain = F.col("_fit.dlogl") - F.lit(1.5 * alpha)
    return pairs.withColumn("_fit", fit).select(
        *pairs.columns, F.col("_fit.best_flux").alias("best_flux"), gain.alias("dlogl"),
        (F.lit(1.0) / (F.lit(1.0) + F.exp(-gain))).alias("p_two"),
    )
