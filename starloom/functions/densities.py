"""Flux and colour priors, evidence penalties, signal to noise."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class DoublePowerLaw:
    """Flux density distribution with slope `low` below the break and `high`
    above it, on [fmin, fmax]. The constants fold when the plan is made."""

    fmin: float
    fmax: float
    brk: float
    low: float
    high: float

    @property
    def _match(self) -> float:
        # Makes both branches meet at the break.
        return self.brk ** (self.low - self.high)

    @property
    def _below(self) -> float:
        e = 1.0 - self.low
        return self._match * (self.brk**e - self.fmin**e) / e

    @property
    def norm(self) -> float:
        e = 1.0 - self.high
        return 1.0 / (self._below + (self.fmax**e - self.brk**e) / e)

    def pdf(self, f: Column) -> Column:
        return F.lit(self.norm) * F.when(
            f <= self.brk, F.lit(self._match) * F.pow(f, F.lit(-self.low))
        ).otherwise(F.pow(f, F.lit(-self.high)))

    def icdf(self, u: Column) -> Column:
        """Flux at cumulative probability u."""
        split = self.norm * self._below
        el, eh = 1.0 - self.low, 1.0 - self.high
        lower = F.pow(u * (el / (self.norm * self._match)) + self.fmin**el, F.lit(1.0 / el))
        upper = F.pow((u - split) * (eh / self.norm) + self.brk**eh, F.lit(1.0 / eh))
        return F.when(u <= split, lower).otherwise(upper)

    def unnormalised_log(self, f: Column) -> Column:
        """Log prior without the normalisation."""
        lift = (self.high - self.low) * F.log(F.lit(self.brk))
        return F.when(f > self.brk, lift - self.high * F.log(f)).otherwise(-self.low * F.log(f))

    def log_ratio(self, new: Column, old: Column) -> Column:
        return F.log(self.pdf(new)) - F.log(self.pdf(old))


def spl_log_ratio(new: Column, old: Column, alpha: float) -> Column:
    """Log prior ratio of a single power law."""
    return F.lit(-float(alpha)) * F.log(new / old)


def color_logprior(colour: Column, mu: float, sigma: float) -> Column:
    """Gaussian log prior; an undefined colour sits at the mean."""
    c = F.coalesce(F.nanvl(colour, F.lit(None)), F.lit(float(mu))) - mu
    return -(c * c) / (2.0 * sigma * sigma)


def fstat_alpha(npix: Column, nbands: int, nsrc: int) -> Column:
    """Expected gain in log-likelihood per degree of freedom, relative to the
    limit of infinite data."""
    return npix / (npix - (2.0 + nbands) * nsrc)


def point_snr(flux: Column, gain: float) -> Column:
    """Signal to noise of an isolated source; the noise constants are fixed."""
    return F.sqrt(F.lit(gain)) * flux / F.sqrt(F.lit(17.5 * 179) + flux)


def flux_error(flux: Column, gain: float, back: float, psf: Sequence[float]) -> Column:
    """Flux error of an isolated source with stencil `psf` on background
    `back`; the stencil has a few hundred entries at most."""
    stencil = F.array(*[F.lit(float(p)) for p in psf])
    info = F.aggregate(
        F.transform(stencil, lambda p: p * p / (F.lit(float(back)) + p * flux)), F.lit(0.0), lambda s, v: s + v
    )
    return F.lit(1.0) / F.sqrt(F.lit(float(gain)) * info)


# 2.5 / ln 10, and the floor of the relative flux error.
MAG_PER_FRACTION = 1.08573620476
CALIBRATION_FLOOR = 0.01


def mag_error(flux: Column, error: Column) -> Column:
    rel = error / flux
    return F.lit(MAG_PER_FRACTION) * F.sqrt(rel * rel + CALIBRATION_FLOOR**2)


def band_weights(present: Sequence[bool]) -> list[float]:
    """Equal weights over the bands that are there."""
    n = sum(bool(p) for p in present)
    return [1.0 / n if p else 0.0 for p in present]


def n_eff(df: DataFrame, weight: str, by: Sequence[str] = ()) -> DataFrame:
    """Effective number of modes, (sum w)^2 / sum w^2."""
    w = F.col(weight)
    return df.groupBy(*by).agg((F.sum(w) * F.sum(w) / F.sum(w * w)).alias("n_eff"))


def tile(df: DataFrame, size: float, off: float = 0.0) -> DataFrame:
    """Integer region of each source and its parity."""
    tx = F.floor((F.col("x") + off) / float(size))
    ty = F.floor((F.col("y") + off) / float(size))
    return df.withColumns(
        {"tile_x": tx, "tile_y": ty, "parity_x": F.pmod(tx, F.lit(2)), "parity_y": F.pmod(ty, F.lit(2))}
    )


def round_up(value: Column, multiple: int) -> Column:
    return F.ceil(value / float(multiple)) * multiple


def round_down(value: Column, multiple: int) -> Column:
    return F.floor(value / float(multiple)) * multiple
