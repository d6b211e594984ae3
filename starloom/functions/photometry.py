"""Magnitudes, colours, units and weights as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

# Map units to flux density per band.
BAND_UNITS = {"S": 86.29e-4, "M": 16.65e-3, "L": 34.52e-3}
# Dust intensity per band, Jy/sr.
DUST_INTENSITY = {"S": 3e6, "M": 1.6e6, "L": 8e5}
ZERO_POINT = 22.5
JY_TO_MJY = 1e3
MEGA = 1e6


def flux_to_mag(flux: Column, k: float | Column | None = None) -> Column:
    """-2.5 log10 f, or 22.5 - 2.5 log10(f k) when counts carry a unit k."""
    if k is None:
        return F.lit(-2.5) * F.log10(flux)
    return F.lit(ZERO_POINT) - F.lit(2.5) * F.log10(flux * k)


def mag_to_flux(mag: Column, k: float | Column = 1.0) -> Column:
    return F.pow(F.lit(10.0), (F.lit(ZERO_POINT) - mag) / 2.5) / k


def color(a: Column, b: Column, kind: str = "ratio", ka: float = 1.0, kb: float = 1.0) -> Column:
    """`ratio` a/b, `log` 2.5 log10(a/b), `mag` difference of magnitudes."""
    if kind == "ratio":
        return F.try_divide(a, b)
    if kind == "log":
        return F.lit(2.5) * F.log10(F.try_divide(a, b))
    return flux_to_mag(a, F.lit(ka)) - flux_to_mag(b, F.lit(kb))


def color_error(fa: Column, sa: Column, fb: Column, sb: Column) -> Column:
    """Error of fa/fb from both relative errors in quadrature."""
    ra, rb = F.try_divide(sa, fa), F.try_divide(sb, fb)
    return F.sqrt(ra * ra + rb * rb) * F.try_divide(fa, fb)


def convert_units(
    df: DataFrame, column: str, band: str = "band", units: Mapping[str, float] = BAND_UNITS, scale: float = 1.0
) -> DataFrame:
    """Multiply `column` by its band's constant. The constants are a map
    literal in the plan, so there is no join at all; an unknown band is NULL."""
    entries = [F.lit(v) for pair in units.items() for v in pair]
    factor = F.element_at(F.create_map(*entries), F.col(band))
    return df.withColumn(column, F.col(column) * factor * F.lit(float(scale)))


def weights(df: DataFrame, threshold: float | None = None, image: str = "image", error: str = "error") -> DataFrame:
    """Inverse-variance weight; zero and over-threshold errors weigh nothing,
    and the image is zeroed where the weight is."""
    s = F.col(error)
    usable = s > 0
    if threshold is not None:
        usable = usable & (s <= threshold)
    w = F.when(usable, F.lit(1.0) / (s * s)).otherwise(0.0)
    return df.withColumn("weight", w).withColumn(
        image, F.when(F.col("weight") == 0, 0.0).otherwise(F.col(image))
    )


def gain_weight(data: Column, bias: float, gain: float) -> Column:
    """Photon-noise weight of a detector image."""
    return F.try_divide(F.lit(gain), data - F.lit(bias))


def add_scalar_noise_var(error: Column, noise: float) -> Column:
    """Add scalar noise in quadrature where the error is set."""
    return F.when(error != 0, F.sqrt(error * error + noise * noise)).otherwise(error)


def inject_template(image: Column, template: Column, amp: float | Column, frac: float = 1.0, conv: float = 1.0) -> Column:
    return image + F.lit(frac) * template * amp * F.lit(conv)


def centre_plane(df: DataFrame, plane: str, by: list[str], out: str) -> DataFrame:
    """A plane minus its mean per group: the means are one combined aggregate
    joined back, so a large map is never gathered for its own mean."""
    means = df.groupBy(*by).agg(F.avg(plane).alias("_mean"))
    return df.join(means, by).withColumn(out, F.col(plane) - F.col("_mean")).drop("_mean")
