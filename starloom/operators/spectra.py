"""Power spectra of maps."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from starloom.functions.fourier import fft2
from starloom.operators.bins import bin_index, edge_table

# Multipole of the Nyquist scale uses 180 * 3600 arc seconds.
ARCSEC = 180.0 * 3600.0


def cross_power(
    pixels: DataFrame, a: str, b: str, height: int, width: int, pixsize: float = 7.0, mask: str | None = None
) -> DataFrame:
    """2-D cross power of two planes, per map and wave number: rows
    (map_id, ky, kx, ell, power). The mean of the observed pixels is taken off
    first; transforms run along rows and columns of each map."""
    sr = (pixsize / 3600.0 / 180.0 * math.pi) ** 2
    planes = [a] if a == b else [a, b]
    seen = pixels.where(F.col(mask) == 1) if mask else pixels
    means = seen.groupBy("map_id").agg(*[F.avg(p).alias(f"_m_{p}") for p in planes])
    joined = pixels.join(means, "map_id")
    cut = (lambda p: F.col(p) * F.col(mask)) if mask else F.col
    stacked = F.explode(
        F.array(*[F.struct(F.lit(n).alias("plane"), ((cut(p) - F.col(f"_m_{p}")) * sr).alias("re")) for n, p in enumerate(planes)])
    )
    rows = joined.select("map_id", "row_", "col_", stacked.alias("_s")).select(
        "map_id", "_s.plane", "row_", "col_", "_s.re", F.lit(0.0).alias("im")
    )
    z = fft2(rows, ["map_id", "plane"], "row_", "col_", height, width)
    part = lambda n, c: F.max(F.when(F.col("plane") == n, F.col(c)))
    last = len(planes) - 1
    power = (part(0, "re") * part(last, "re") + part(0, "im") * part(last, "im")) / (height * width * sr)

    def wave(c, n):
        k = F.col(c)
        return F.when(k < (n + 1) // 2, k).otherwise(k - n) / float(n) * (2.0 * ARCSEC / pixsize)

    ly, lx = wave("row_", height), wave("col_", width)
    return z.groupBy("map_id", "row_", "col_").agg(power.alias("power")).select(
        "map_id", F.col("row_").alias("ky"), F.col("col_").alias("kx"), F.sqrt(ly * ly + lx * lx).alias("ell"), "power"
    )


def ell_edges(height: int, width: int, pixsize: float, bins: int, log: bool = True) -> list[float]:
    """`bins` edges from the smallest to the largest nonzero multipole, the
    last one raised by one percent."""
    unit = 2.0 * ARCSEC / pixsize
    lo = unit / max(height, width)
    hi = unit * math.hypot(height // 2 / height, width // 2 / width)
    step = lambda t: lo * (hi / lo) ** t if log else lo + (hi - lo) * t
    edges = [step(k / (bins - 1)) for k in range(bins)]
    edges[-1] *= 1.01
    return edges


def radial_average(
    ps2d: DataFrame, edges: Sequence[float], by: Sequence[str] = ("map_id",), weight: str | None = None,
    log: bool = True, as_dl: bool = False,
) -> DataFrame:
    """Mean power per ring of multipoles, std / sqrt(N), N and effective N;
    with `as_dl` times l (l + 1) / 2 pi at the ring's centre."""
    w = F.col(weight) if weight else F.lit(1.0)
    ring = ps2d.withColumn("bin", bin_index(F.col("ell"), edges)).where(F.col("bin").isNotNull())
    stats = ring.groupBy(*by, "bin").agg(
        (F.sum(F.col("power") * w) / F.sum(w)).alias("cl"),
        (F.stddev_pop("power") / F.sqrt(F.count(F.lit(1)))).alias("cl_err"),
        F.count(F.lit(1)).alias("modes"), (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("n_eff"),
    )
    centre: Column = F.sqrt(F.col("lo") * F.col("hi")) if log else (F.col("lo") + F.col("hi")) / 2.0
    out = stats.join(edge_table(ps2d.sparkSession, edges), "bin").withColumn("ell", centre)
    if as_dl:
        out = out.withColumn("cl", F.col("cl") * F.col("ell") * (F.col("ell") + 1.0) / (2.0 * math.pi))
    return out.select(*by, "bin", "ell", "cl", "cl_err", "modes", "n_eff")
