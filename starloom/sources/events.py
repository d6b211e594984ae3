"""Photon events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def select_events(
    events: DataFrame, energy: tuple[float, float] | None = None, region: Sequence[float] | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Energy range [a, b], sky box, column subset. Predicates compare plain
    columns, so a Parquet scan applies them and reads only what is left."""
    if energy:
        events = events.where((F.col("energy") >= float(energy[0])) & (F.col("energy") <= float(energy[1])))
    if region:
        x0, x1, y0, y1 = map(float, region)
        events = events.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
    return events.select(*columns) if columns else events


def read_events(spark: SparkSession, path: str, **selection) -> DataFrame:
    return select_events(spark.read.parquet(path), **selection)
