"""Radius joins as equi-joins on tiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

# Pads the box a point is copied into, so that rounding at a tile border never
# loses a pair; the exact distance decides afterwards.
PAD = 1.0 + 1e-9


def radius_pairs(
    a: DataFrame,
    b: DataFrame,
    radius: float,
    on: Sequence[str] = (),
    a_xy: tuple[str, str] = ("ax", "ay"),
    b_xy: tuple[str, str] = ("bx", "by"),
    inclusive: bool = True,
    tile: float | None = None,
    salts: int = 1,
) -> DataFrame:
    """All (a, b) with equal `on` columns and distance within `radius`.

    Each a row stays in the one tile it lies in; each b row is copied to the
    tiles its radius box touches, at most four with the default tile of two
    radii. So a pair meets in exactly one tile. Give the larger side as `a`.

    The join keys are (on, tile): a crowded field spreads over its tiles. A
    crowded tile is split by AQE's skew join, which may cut either side of an
    inner equi-join; `salts` > 1 does the same by hand where the caller knows
    the crowding (a's rows of a tile are dealt to `salts` keys, b is copied to
    each).

    Adds `d2`, the squared distance.
    """
    width = float(tile or 2.0 * radius)
    reach = radius * PAD
    (ax, ay), (bx, by) = a_xy, b_xy
    left = a.withColumn("_tx", F.floor(F.col(ax) / width)).withColumn(
        "_ty", F.floor(F.col(ay) / width)
    )

    def touched(c):
        return F.explode(
            F.sequence(F.floor((F.col(c) - reach) / width), F.floor((F.col(c) + reach) / width))
        )

    right = b.withColumn("_tx", touched(bx)).withColumn("_ty", touched(by))
    keys = [*on, "_tx", "_ty"]
    if salts > 1:
        left = left.withColumn("_salt", F.pmod(F.xxhash64(*a.columns), F.lit(salts)))
        right = right.withColumn(
            "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))
        )
        keys.append("_salt")
    dx, dy = F.col(ax) - F.col(bx), F.col(ay) - F.col(by)
    d2 = dx * dx + dy * dy
    limit = F.lit(float(radius) * float(radius))
    near = d2 <= limit if inclusive else d2 < limit
    # Catalyst does not count the copies and would broadcast a b of any size
    # whose source is small; so both sides go by shuffle.
    return left.join(right.hint("merge"), keys).where(near).withColumn("d2", d2).drop("_tx", "_ty", "_salt")
