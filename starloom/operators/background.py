"""Fourier backgrounds: basis, synthesis, mode power and ridge fits."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from starloom.functions.gram import outer_sums
from starloom.operators.bins import bin_index
from starloom.operators.quantiles import exact_quantiles
from starloom.session import cut_lineage

HELD = 1 << 17  # pixels of maps that a task holds at a time


def _wave(fn, order: Column, at: Column, length: float, shift: float = 0.0) -> Column:
    return fn((order + (1.0 - shift)) * math.pi * at / float(length))


def fourier_basis(
    grid: DataFrame, n_terms: int, width: float, height: float, shift: bool = False, scale: float = 1.0
) -> DataFrame:
    """Four products of sines and cosines per pixel and mode (i, j); modes are
    rows copied from each pixel, products come out as rows k = 0..3."""
    top = F.sequence(F.lit(0).cast("bigint"), F.lit(n_terms - 1).cast("bigint"))
    modes = grid.withColumn("i", F.explode(top)).withColumn("j", F.explode(top))
    half = 0.5 if shift else 0.0
    sx, cx = _wave(F.sin, F.col("i"), F.col("col_"), width, half), _wave(F.cos, F.col("i"), F.col("col_"), width)
    sy, cy = _wave(F.sin, F.col("j"), F.col("row_"), height, half), _wave(F.cos, F.col("j"), F.col("row_"), height)
    rows = F.posexplode(F.array(*[p * scale for p in (sx * sy, sx * cy, cx * sy, cx * cy)])).alias("k", "value")
    return modes.select(*grid.columns, "i", "j", rows).withColumn("k", F.col("k").cast("bigint"))


def synthesise(coeffs: DataFrame, height: int, width: int, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Map of each coefficient set (keys, i, j, k, value).

    The sum over modes separates: first over j for every row of the map, then
    over i for every pixel. One map's coefficients, at most 4 n^2 numbers, are
    one row of arrays; tasks turn some of them at a time into lines of their maps,
    so only coefficients are shuffled and no sum per pixel is kept. An incomplete
    coefficient adds nothing; a map without any mode i has no values.
    """
    given = F.col("i").isNotNull() & F.col("j").isNotNull() & F.col("k").isNotNull() & F.col("value").isNotNull()
    term = F.struct(*[F.col(c).cast("double").alias(c) for c in ("i", "j", "k", "value")])
    packed = coeffs.groupBy(*keys).agg(F.collect_list(F.when(given, term)).alias("_c"), F.count("i").alias("_modes"))
    packed = packed.select(*keys, "_modes", *[F.col(f"_c.{c}").alias(f"_{c}") for c in ("i", "j", "k", "value")])
    names = list(keys)
    columns, lines = np.arange(width), max(1, HELD // width)

    def turn(pdf: pd.DataFrame, first: int, last: int) -> np.ndarray:
        """Rows first to last - 1 of the maps of pdf."""
        sizes = [len(c) for c in pdf["_i"]]
        i, j, k, value = (np.concatenate(pdf[f"_{c}"].to_list()) for c in ("i", "j", "k", "value"))
        out = np.zeros((len(pdf), last - first, width))
        if not len(i):
            return out
        at = np.repeat(np.arange(len(pdf)), sizes)
        order = np.lexsort((i, at))
        i, j, k, value, at = i[order], j[order], k[order], value[order], at[order]
        angle = (j + 1.0)[:, None] * math.pi * np.arange(first, last) / float(height)
        # k = 0, 1 carry sin x, k = 2, 3 cos x; even k carries sin y, odd k cos y.
        part = value[:, None] * np.where((k % 2 == 0)[:, None], np.sin(angle), np.cos(angle))
        starts = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (i[1:] != i[:-1])))
        s = np.add.reduceat(np.where((k < 2)[:, None], part, 0.0), starts)
        c = np.add.reduceat(np.where((k >= 2)[:, None], part, 0.0), starts)
        at, i = at[starts], i[starts]
        place = np.arange(len(at)) - np.searchsorted(at, at)  # which mode of its map
        for mode in range(place.max() + 1):
            now = place == mode
            wave = (i[now] + 1.0)[:, None] * math.pi * columns / float(width)
            out[at[now]] += s[now][:, :, None] * np.sin(wave)[:, None, :] + c[now][:, :, None] * np.cos(wave)[:, None, :]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first in range(0, height, lines):
                last = min(height, first + lines)
                step = max(1, HELD // (width * (last - first)))
                for start in range(0, len(batch), step):
                    pdf = batch.iloc[start : start + step]
                    z = turn(pdf, first, last).reshape(-1, width)
                    rows = pdf[names].loc[pdf.index.repeat(last - first)].reset_index(drop=True)
                    yield rows.assign(_modes=np.repeat(pdf["_modes"].to_numpy(), last - first), row_=np.tile(np.arange(first, last), len(pdf)), _v=list(z))

    fields = ", ".join(f"{k} {dict(coeffs.dtypes)[k]}" for k in names)
    done = packed.mapInPandas(run, f"{fields}, _modes bigint, row_ bigint, _v array<double>")
    return done.select(*keys, "row_", "_modes", F.posexplode("_v").alias("_at", "_model")).select(
        *keys, "row_", F.col("_at").cast("bigint").alias("col_"), F.when(F.col("_modes") > 0, F.col("_model")).alias("model")
    )


def mode_power(coeffs: DataFrame, edges: Sequence[float]) -> DataFrame:
    """Mean square of the coefficients per bar of k = sqrt(i^2 + j^2), i and j
    from 1: median and scatter over samples."""
    i, j = F.col("i") + 1.0, F.col("j") + 1.0
    per = (
        coeffs.withColumn("bin", bin_index(F.sqrt(i * i + j * j), edges))
        .where(F.col("bin").isNotNull())
        .groupBy("sample_id", "bin")
        .agg(F.avg(F.col("value") * F.col("value")).alias("power"))
    )
    # Few bars, and as many values in each as there are samples.
    per = cut_lineage(per)
    medians = exact_quantiles(per, ["bin"], "power", {"median": 0.5}).select("bin", "median")
    return medians.join(per.groupBy("bin").agg(F.stddev_pop("power").alias("std")), "bin")


def median_coeffs(coeffs: DataFrame, last: int | None = None) -> DataFrame:
    """Median of each coefficient over the (last) samples: few groups, one value
    per sample in each, so ranks are selected without holding a group."""
    if last is not None:
        end = coeffs.agg(F.max("sample_id")).scalar()
        coeffs = coeffs.where(F.col("sample_id") > end - last)
    found = exact_quantiles(coeffs, ["i", "j", "k"], "value", {"median": 0.5})
    return found.select("i", "j", "k", F.col("median").alias("value"))


def model_diff(model: DataFrame, pixels: DataFrame) -> DataFrame:
    """Squared distance of one model map to every map. The model is one map's
    pixels; Catalyst broadcasts it when its size is under the limit."""
    d = F.col("model") - F.col("image")
    return pixels.join(model, ["row_", "col_"]).groupBy("map_id").agg(F.sum(d * d).alias("diff2"))


def normal_sums(
    pixels: DataFrame, n_terms: int, height: int, width: int, by: Sequence[str] = ("map_id",), mean_sigma: bool = False
) -> DataFrame:
    """Sums of the weighted normal equations, as rows (by, p, q >= p, s). The
    last index is the data, so its row holds B^T S^-1 y. Pixels without data or
    error do not count; with `mean_sigma` all others weigh the same."""
    usable = pixels.where(
        F.col("image").isNotNull() & F.col("error").isNotNull() & ~F.isnan("image") & ~F.isnan("error") & (F.col("error") != 0)
    )

    def design(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        orders = np.arange(1, n_terms + 1) * np.pi
        ax = np.outer(pdf["col_"].to_numpy() / width, orders)
        ay = np.outer(pdf["row_"].to_numpy() / height, orders)
        x, y = np.stack([np.sin(ax), np.cos(ax)], 2), np.stack([np.sin(ay), np.cos(ay)], 2)
        # rows x i x j x (sin/cos x) x (sin/cos y), flattened as ((i n + j) 4 + k)
        basis = np.einsum("rip,rjq->rijpq", x, y).reshape(len(pdf), -1)
        v = np.hstack([basis, pdf[["image"]].to_numpy()])
        err = pdf["error"].to_numpy()
        return v, np.ones(len(pdf)) if mean_sigma else err**-2.0

    return outer_sums(usable, by, ["row_", "col_", "image", "error"], design)


def ridge_fit(
    sums: DataFrame, n_terms: int, lam: float = 0.0, alpha: float | None = None, by: Sequence[str] = ("map_id",)
) -> DataFrame:
    """Coefficients (by, i, j, k, value) from the normal equations plus a ridge
    that grows as k^alpha from the fundamental mode. One map's equations, at
    most 4 n^2 squared numbers, are one row of arrays for the solver."""
    size = 4 * n_terms * n_terms
    packed = sums.groupBy(*by).agg(F.collect_list(F.struct("p", "q", "s")).alias("e"))
    packed = packed.select(*by, F.col("e.p").alias("p"), F.col("e.q").alias("q"), F.col("e.s").alias("s"))
    order = np.arange(size) // 4
    kmag = np.hypot(order // n_terms + 1, order % n_terms + 1) / np.sqrt(2.0)
    ridge = lam * (kmag**alpha if alpha is not None else np.ones(size))
    keys = list(by)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p, q, s in zip(pdf["p"], pdf["q"], pdf["s"]):
                full = np.zeros((size + 1, size + 1))
                full[p, q] = s
                full[q, p] = s
                out.append(np.linalg.solve(full[:size, :size] + np.diag(ridge), full[:size, size]))
            yield pdf[keys].assign(v=out)

    fields = ", ".join(f"{k} {dict(sums.dtypes)[k]}" for k in keys)
    solved = packed.mapInPandas(solve, f"{fields}, v array<double>")
    at = F.col("at").cast("bigint")
    mode = F.floor(at / 4.0)
    return solved.select(*keys, F.posexplode("v").alias("at", "value")).select(
        *keys, F.floor(mode / float(n_terms)).alias("i"), (mode % n_terms).alias("j"), (at % 4).alias("k"), "value"
    )
