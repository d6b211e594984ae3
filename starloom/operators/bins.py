"""Bin rules shared by histograms and curves."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def bin_index(value: Column, edges: Sequence[float], last_closed: bool = False) -> Column:
    """0-based bar [e_i, e_i+1) of `value`, NULL outside; the last bar also
    takes its right edge when `last_closed`. Plain comparisons, so it stays in
    generated code; meant for edge lists of a few dozen."""
    top = value <= F.lit(float(edges[-1])) if last_closed else value < F.lit(float(edges[-1]))
    passed = [(value >= F.lit(float(e))).cast("bigint") for e in edges[1:-1]]
    index = reduce(lambda p, q: p + q, passed, F.lit(0).cast("bigint"))
    return F.when((value >= F.lit(float(edges[0]))) & top, index)


def in_bins(value: Column, edges: Sequence[float], last_closed: bool = False) -> Column:
    """Whether some bar holds `value`."""
    top = value <= F.lit(float(edges[-1])) if last_closed else value < F.lit(float(edges[-1]))
    return (value >= F.lit(float(edges[0]))) & top


def held_bin(value: Column, edges: Sequence[float], last_closed: bool = False) -> Column:
    """bin_index of a value that is in_bins, for a key. Its type has no NULL: where a bin
    may be NULL, the optimizer moves the test for it, from a filter or a join on the bin,
    below whatever makes the value, which is then made once for every edge."""
    return F.coalesce(bin_index(value, edges, last_closed), F.lit(-1).cast("bigint"))


def edge_table(spark: SparkSession, edges: Sequence[float]) -> DataFrame:
    """(bin, lo, hi) for every bar, so empty bars can be filled in."""
    table = F.array(*[F.lit(float(e)) for e in edges])
    return spark.range(len(edges) - 1).select(
        F.col("id").alias("bin"),
        F.element_at(table, (F.col("id") + 1).cast("int")).alias("lo"),
        F.element_at(table, (F.col("id") + 2).cast("int")).alias("hi"),
    )


def fill_bins(df: DataFrame, spark: SparkSession, edges: Sequence[float]) -> DataFrame:
    """Every bar of `edges`, with df's columns NULL where a bar is empty."""
    return edge_table(spark, edges).join(df, "bin", "left")


def log_edges(lo: float, hi: float, count: int) -> list[float]:
    """`count` edges, evenly spaced in the logarithm, rounded to 6 digits."""
    return [round(lo * (hi / lo) ** (k / (count - 1)), 6) for k in range(count)]


def linear_edges(lo: float, hi: float, bars: int) -> list[float]:
    return [lo + (hi - lo) * k / bars for k in range(bars + 1)]
