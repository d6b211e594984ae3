"""Ranks, top-n and arg-extrema inside samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from starloom.operators.ordering import position_in_group, quantile_cells
from starloom.session import cut_lineage


def rank_flux(
    df: DataFrame, flux: str = "f0", by: Sequence[str] = ("field_id", "sample_id"), ties: Sequence[str] = ("x", "y")
) -> DataFrame:
    """Slot of each source in its sample, brightest first. Samples are cut at
    approximate quantiles of their fluxes, so a crowded one is ranked by many
    tasks with like shares, also where most of its fluxes are nearly the same."""
    df = cut_lineage(df)  # read three times: cuts, counts and rows
    cells = quantile_cells(df, by, -F.col(flux), "_rank_cell")
    return position_in_group(
        cells, list(by), F.col("_rank_cell"), [F.desc(flux), *[F.asc(c) for c in ties]], "slot"
    ).drop("_rank_cell")


def brightest(
    df: DataFrame, n: int, flux: str = "f0", by: Sequence[str] = ("field_id", "sample_id"),
    ties: Sequence[str] = ("x", "y"), share: int | None = None,
) -> DataFrame:
    """The n brightest of every sample; with `share`, min(n, count / share).

    The constant bound lets Spark limit each group before the shuffle, so a
    task keeps n rows of a group however large the group is.
    """
    order = W.partitionBy(*by).orderBy(F.desc(flux), *[F.asc(c) for c in ties])
    top = df.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= n)
    if share is None:
        return top
    counts = df.groupBy(*by).agg(F.floor(F.count(F.lit(1)) / float(share)).alias("_share"))
    return top.join(counts, list(by)).where(F.col("rank") <= F.col("_share")).drop("_share")


def sort_flux(df: DataFrame, flux: str = "f0", descending: bool = False) -> DataFrame:
    """Total order by flux: one range shuffle."""
    return df.orderBy(F.desc(flux) if descending else F.asc(flux))


def extremes(df: DataFrame, by: Sequence[str], value: str, keep: Sequence[str]) -> DataFrame:
    """Row of the smallest and of the largest value per group; ties fall to the
    smaller `keep` columns. Running extremes, combined before the shuffle."""
    low = F.min(F.struct(value, *keep))
    high = F.min(F.struct((-F.col(value)).alias("neg"), *keep))
    return df.groupBy(*by).agg(low.alias("_a"), high.alias("_b")).select(
        *by,
        F.col(f"_a.{value}").alias(f"min_{value}"), *[F.col(f"_a.{c}").alias(f"argmin_{c}") for c in keep],
        (-F.col("_b.neg")).alias(f"max_{value}"), *[F.col(f"_b.{c}").alias(f"argmax_{c}") for c in keep],
    )
