"""Sets of runs: pooling, grouping, exclusion and remaining work."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from starloom.operators.ordering import position_in_group


def stack(frames: Iterable[DataFrame]) -> DataFrame:
    """Samples of many runs, one below the other."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def sim_key(df: DataFrame, tail: str = "tail_name") -> DataFrame:
    return df.withColumn("sim", F.right(F.col(tail), F.lit(3)))


def runs_by_sim(runs: DataFrame, block: int = 1 << 18) -> DataFrame:
    """Runs grouped by simulation key, as rows (sim, place in its list, run).
    Rows and not one array per simulation, so a popular simulation stays
    spread over tasks."""
    return position_in_group(
        sim_key(runs), ["sim"], F.floor(F.col("started") / float(block)), [F.asc("started")], "place", nulls_first=True
    ).select("sim", "place", "run_id")


def first_per_sim(runs: DataFrame) -> DataFrame:
    """The earliest run of every simulation."""
    return (
        sim_key(runs).groupBy("sim").agg(F.min(F.struct("started", "run_id")).alias("_r"))
        .select("sim", F.col("_r.run_id").alias("run_id"), F.col("_r.started").alias("started"))
    )


def exclude(runs: DataFrame, sims: DataFrame) -> DataFrame:
    """Runs whose simulation is not listed."""
    return sim_key(runs).join(sims, "sim", "left_anti")


def todo(sims: DataFrame, terms: Sequence[int], started: DataFrame) -> DataFrame:
    """(sim, n_terms) pairs not started yet. The grid comes from copying each
    simulation once per term count."""
    grid = sims.select("sim").distinct().withColumn(
        "n_terms", F.explode(F.array(*[F.lit(int(t)).cast("bigint") for t in terms]))
    )
    return grid.join(started, ["sim", "n_terms"], "left_anti")
