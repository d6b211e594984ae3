"""Covariances, their adjustment, and ellipse fits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

MOMENTS = [(a, b) for a in range(5) for b in range(5 - a)]


def pair_covariance(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.var_samp(a).alias("caa"), F.covar_samp(a, b).alias("cab"), F.var_samp(b).alias("cbb")
    )


def adjust_cov(
    cov: DataFrame,
    bkg_err: Sequence[float] | None = None,
    mult: float | None = None,
    rhat: Sequence[float] | None = None,
    observed: Sequence[float] | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Add the fixed-background variance, multiply, add (R-hat - 1) of the
    observed variance, and lay the 2 x 2 into the corner of a 3 x 3 matrix."""
    caa, cab, cbb = F.col("caa"), F.col("cab"), F.col("cbb")
    if bkg_err:
        caa, cbb = caa + bkg_err[0] ** 2, cbb + bkg_err[1] ** 2
    if mult is not None:
        caa, cab, cbb = caa * mult, cab * mult, cbb * mult
    if rhat and observed:
        caa, cbb = caa + (rhat[0] - 1.0) * observed[0], cbb + (rhat[1] - 1.0) * observed[1]
    zero = F.lit(0.0)
    cells = [[zero, zero, zero], [zero, caa, cab], [zero, cab, cbb]]
    entries = F.array(
        *[
            F.struct(F.lit(r).cast("bigint").alias("r"), F.lit(c).cast("bigint").alias("c"), cells[r][c].alias("value"))
            for r in range(3)
            for c in range(3)
        ]
    )
    return cov.select(*by, F.inline(entries))


def rotated_cov(major: Column, minor: Column, phi: Column) -> tuple[Column, Column, Column]:
    """Covariance entries (aa, ab, bb) of principal axes turned by phi."""
    c, s, m2, n2 = F.cos(phi), F.sin(phi), major * major, minor * minor
    return c * c * m2 + s * s * n2, c * s * (n2 - m2), s * s * m2 + c * c * n2


def ellipse_moments(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sums of x^a y^b, a + b <= 4, about the mean of each group."""
    means = points.groupBy(*by).agg(F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"))
    dx, dy = F.col("x") - F.col("mean_x"), F.col("y") - F.col("mean_y")

    def power(c, k):
        out = F.lit(1.0)
        for _ in range(k):
            out = out * c
        return out

    sums = [F.sum(power(dx, a) * power(dy, b)).alias(f"m{a}{b}") for a, b in MOMENTS]
    return points.join(means, list(by)).groupBy(*by, "mean_x", "mean_y").agg(*sums)


def fit_ellipse(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """Direct least-squares ellipse of each group: centre, angle and axes, NULL
    where the points determine none. Spark reduces the points to fifteen sums;
    the eigenvector step takes whole batches of groups at a time."""
    curved, flat = [(2, 0), (1, 1), (0, 2)], [(1, 0), (0, 1), (0, 0)]
    keys, shape = list(by), ["x0", "y0", "phi", "axis_1", "axis_2"]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # 4 A C - B^2 as a quadratic form of (A, B, C), inverted.
        unbend = np.linalg.inv(np.array([[0.0, 0.0, 2.0], [0.0, -1.0, 0.0], [2.0, 0.0, 0.0]]))
        for pdf in batches:
            def block(rows, cols):
                return np.stack([np.stack([pdf[f"m{a + c}{b + d}"].to_numpy(float) for c, d in cols], 1) for a, b in rows], 1)

            straight = block(flat, flat)
            lost = ~(np.abs(np.linalg.det(straight)) > 0)
            straight[lost] = np.eye(3)
            # The straight part follows from the curved one, which leaves a
            # 3 x 3 problem that stays solvable for points exactly on an
            # ellipse; its one elliptic solution is the fit.
            follow = -np.linalg.solve(straight, block(flat, curved))
            rest = block(curved, curved) + block(curved, flat) @ follow
            rest[~np.isfinite(rest).all((1, 2))] = 0.0
            vectors = np.real(np.linalg.eig(unbend @ rest)[1])
            bend = 4.0 * vectors[:, 0] * vectors[:, 2] - vectors[:, 1] ** 2
            q = np.take_along_axis(vectors, bend.argmax(1)[:, None, None], 2)[:, :, 0]
            conic = np.hstack([q, (follow @ q[:, :, None])[:, :, 0]])
            found = _geometry(conic, pdf["mean_x"].to_numpy(float), pdf["mean_y"].to_numpy(float))
            found[lost | ~np.isfinite(found).all(1)] = np.nan
            yield pdf[keys].assign(**{c: pd.Series(found[:, k], index=pdf.index, dtype=object).where(~np.isnan(found[:, k]), None) for k, c in enumerate(shape)})

    moments = ellipse_moments(points, by)
    fields = ", ".join(f"{k} {dict(points.dtypes)[k]}" for k in keys)
    return moments.mapInPandas(solve, f"{fields}, " + ", ".join(f"{c} double" for c in shape))


def _geometry(q: np.ndarray, mx: np.ndarray, my: np.ndarray) -> np.ndarray:
    """Centre, angle and half axes of the conics A x^2 + B xy + C y^2 + D x + E y + F = 0, one per row."""
    form = np.stack([np.stack([q[:, 0], q[:, 1] / 2], 1), np.stack([q[:, 1] / 2, q[:, 2]], 1)], 1)
    curved = np.abs(np.linalg.det(form)) > 0
    slope = q[:, 3:5]
    with np.errstate(all="ignore"):
        centre = np.full((len(q), 2), np.nan)
        centre[curved] = np.linalg.solve(2.0 * form[curved], -slope[curved][:, :, None])[:, :, 0]
        level = -(q[:, 5] + 0.5 * (slope * centre).sum(1))
        # The first axis belongs to the direction nearer to x.
        half = np.sqrt(level[:, None] / np.linalg.eigvalsh(form))
        phi = 0.5 * np.arctan(q[:, 1] / (q[:, 0] - q[:, 2]))
        along = np.stack([np.cos(phi), np.sin(phi)], 1)
        first = np.sqrt(level / np.einsum("ni,nij,nj->n", along, form, along))
        second = np.take_along_axis(half, np.abs(half - first[:, None]).argmax(1)[:, None], 1)[:, 0]
    return np.stack([centre[:, 0] + mx, centre[:, 1] + my, phi, first, second], 1)


def offset_fit(df: DataFrame, x: str, dx: str, dy: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean offsets, and the straight line of dx on x."""
    return df.groupBy(*by).agg(
        F.avg(dx).alias("mean_dx"), F.avg(dy).alias("mean_dy"),
        F.regr_slope(dx, x).alias("slope"), F.regr_intercept(dx, x).alias("intercept"),
    )
