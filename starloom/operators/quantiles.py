"""Exact percentiles of groups too large for one task.

`percentile` keeps every distinct value of a group in one task. Values pooled
over runs have no bound, so here equal values are counted first, each group is
cut into cells of values, and only the few cells that hold a wanted rank are
sorted. Linear interpolation between ranks, as numpy does by default.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

CELLS = 128
CELL_VALUES = 1 << 16
MOST_STEPS = 1 << 10
INFINITE = 1e300


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]
) -> DataFrame:
    """One row per group: keys, `n` and one column per entry of `probs`. A NULL
    key is a group like any other; NULL values do not count.

    A group is cut at 128 of its approximate quantiles, and between two cuts
    into equal steps, the more of them the more values it has: so a cell holds
    some 65,000 different values however large the group is, unless they crowd.
    """
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    shares = F.array(*[F.lit(k / CELLS) for k in range(1, CELLS)])
    groups = counted.groupBy(*keys).agg(
        F.percentile_approx("_v", shares, 4 * CELLS).alias("_cuts"), F.sum("_n").alias("n"),
        F.count(F.lit(1)).alias("_d"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
    )
    celled = _with_groups(counted, groups, keys).withColumn(
        "_cut", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
    )
    steps = F.least(F.lit(MOST_STEPS), F.lit(1) + F.floor(F.col("_d") / float(CELLS * CELL_VALUES)))
    lo = F.when(F.col("_cut") > 0, F.get("_cuts", F.col("_cut") - 1)).otherwise(F.col("_min"))
    hi = F.coalesce(F.get("_cuts", F.col("_cut")), F.col("_max"))
    part = F.when((steps > 1) & (hi > lo) & (hi - lo < INFINITE), F.greatest(F.lit(0), F.least(steps - 1, F.floor((F.col("_v") - lo) / (hi - lo) * steps)))).otherwise(0)
    celled = celled.withColumn("_cell", F.col("_cut") * MOST_STEPS + part).drop("_cut", "_d", "_min", "_max")
    earlier = W.partitionBy(*keys).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    cells = (
        celled.groupBy(*keys, "_cell")
        .agg(F.sum("_n").alias("_in"), F.first("n").alias("n"))
        .withColumn("_before", F.coalesce(F.sum("_in").over(earlier), F.lit(0)))
    )
    ranks = [F.col("n") * 0 + f(F.lit(p) * (F.col("n") - 1)) for p in probs.values() for f in (F.floor, F.ceil)]
    holds = F.exists(
        F.array(*ranks),
        lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_in")),
    )
    wanted = cells.where(holds).select(*keys, "_cell", "_before")
    upto = W.partitionBy(*keys, "_cell").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    placed = (
        celled.drop("_cuts")
        .join(wanted.select(*(F.col(c).alias(f"_k{n}") for n, c in enumerate([*keys, "_cell"])), "_before"), _same([*keys, "_cell"]))
        .withColumn("_end", F.col("_before") + F.sum("_n").over(upto))
        .withColumn("_start", F.col("_end") - F.col("_n"))
    )

    def at(rank):
        return F.max(F.when((F.col("_start") <= rank) & (rank < F.col("_end")), F.col("_v")))

    picks = []
    for name, p in probs.items():
        h = F.lit(p) * (F.col("n") - 1)
        picks += [at(F.floor(h)).alias(f"_lo_{name}"), at(F.ceil(h)).alias(f"_hi_{name}")]
    picked = placed.groupBy(*keys, "n").agg(*picks)
    out = []
    for name, p in probs.items():
        h = F.lit(p) * (F.col("n") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (h - F.floor(h))).alias(name))
    return picked.select(*keys, "n", *out)


def _with_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    extra = [c for c in groups.columns if c not in keys]
    if keys:
        return rows.join(groups.select(*(F.col(c).alias(f"_k{n}") for n, c in enumerate(keys)), *extra), _same(keys)).drop(*(f"_k{n}" for n in range(len(keys))))
    return rows.select("*", *(groups.select(c).scalar().alias(c) for c in extra))


def _same(names: Sequence[str]) -> Column:
    """Equal in all these columns and their copies _k0, _k1 ...; NULL equals NULL."""
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{n}")) for n, c in enumerate(names)])
