"""Exact positions inside groups of any size.

A window over a whole group sorts that group in one task. Here the group is
first cut into cells that follow the sort order, so a task sorts one cell, and
the rows of earlier cells enter as a count.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from starloom.session import cut_lineage

CELLS = 128


def quantile_cells(df: DataFrame, keys: Sequence[str], value: Column, out: str) -> DataFrame:
    """Adds the number of a row's cell among about CELLS of its group that follow `value`.

    The cuts are approximate quantiles, from a sketch per group that is merged
    on the way, so cells hold like shares of a group however its values crowd;
    only equal values stay together. NULL values have a NULL cell.
    """
    shares = F.array(*[F.lit(k / CELLS) for k in range(1, CELLS)])
    rows = df.withColumn("_value", value.cast("double"))
    cuts = rows.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("_value", shares, 8 * CELLS)).alias("_cuts"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_q{n}")) for n, c in enumerate(keys)])
    joined = rows.join(cuts.select(*(F.col(c).alias(f"_q{n}") for n, c in enumerate(keys)), "_cuts"), same)
    number = F.when(F.col("_value").isNotNull(), F.size(F.filter("_cuts", lambda c: c < F.col("_value"))))
    return joined.withColumn(out, number).drop("_value", "_cuts", *(f"_q{n}" for n in range(len(keys))))


def position_in_group(
    df: DataFrame, keys: Sequence[str], cell: Column, order: Sequence[Column], out: str, nulls_first: bool = False
) -> DataFrame:
    """0-based position of each row in its group under `order`.

    `cell` must never fall along `order`; it decides only how the sort is
    spread, not the result. A NULL cell comes last, or first where `order` puts
    NULL first. A NULL key is a group like any other. The cell counts are
    combined before the shuffle, and the rows move once, to (keys, cell).
    """
    rows = df.withColumn("_cell", cell)
    counts = rows.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(*keys).orderBy(F.asc_nulls_first("_cell") if nulls_first else F.asc_nulls_last("_cell")).rowsBetween(W.unboundedPreceding, -1)
    names = [*keys, "_cell"]
    before = counts.select(
        *(F.col(c).alias(f"_k{n}") for n, c in enumerate(names)), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{n}")) for n, c in enumerate(names)])
    inside = W.partitionBy(*keys, "_cell").orderBy(*order)
    return (
        rows.withColumn("_pos", F.row_number().over(inside) - 1)
        .join(before, same)
        .withColumn(out, F.col("_before") + F.col("_pos"))
        .drop("_cell", "_pos", "_before", *(f"_k{n}" for n in range(len(names))))
    )


def distinct_positions(rows: DataFrame, keys: Sequence[str], cell: Column, order: Sequence[Column], out: str, tasks: int | None = None) -> DataFrame:
    """Different rows of `rows`, with position_in_group's position of each.

    Rows move once, to (keys, cell), and one sort there drops repeats and numbers what is
    left; the numbered rows are written, so counts by cell and every use of the result
    read them again instead of sorting again. `order` need not tell all rows apart.
    """
    spread = [*keys, "_cell"]
    dealt = rows.withColumn("_cell", cell)
    dealt = dealt.repartition(*([tasks] if tasks else []), *spread)
    inside = W.partitionBy(*spread).orderBy(*order, *rows.columns)
    placed = dealt.withColumn("_pos", F.dense_rank().over(inside)).withColumn("_last", F.lag("_pos").over(inside))
    placed = cut_lineage(placed.where(F.col("_last").isNull() | (F.col("_last") < F.col("_pos"))).drop("_last"))
    earlier = W.partitionBy(*keys).orderBy(F.asc_nulls_last("_cell")).rowsBetween(W.unboundedPreceding, -1)
    before = placed.groupBy(*spread).agg(F.max("_pos").cast("bigint").alias("_n")).select(
        *(F.col(c).alias(f"_k{n}") for n, c in enumerate(spread)), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{n}")) for n, c in enumerate(spread)])
    return (
        placed.join(before, same).withColumn(out, F.col("_before") + F.col("_pos") - 1)
        .drop("_cell", "_pos", "_before", *(f"_k{n}" for n in range(len(spread))))
    )


def with_halo(df: DataFrame, index: str, block: int, ahead: int) -> DataFrame:
    """Copy each row to its own block of `index` and to the blocks whose
    windows still look back at it; `_own` marks the home copy.

    Frames of `ahead` rows then need only (group, block) as window key.
    """
    home = F.floor(F.col(index) / F.lit(float(block)))
    last = F.floor((F.col(index) + F.lit(ahead)) / F.lit(float(block)))
    return df.withColumn("_block", F.explode(F.sequence(home, last))).withColumn(
        "_own", F.col("_block") == home
    )
