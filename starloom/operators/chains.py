"""Scalar chains: convergence, autocorrelation, windows, proposal logs."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from starloom.functions.fourier import long_fft, split_columns
from starloom.functions.gram import outer_sums
from starloom.operators.ordering import with_halo
from starloom.operators.quantiles import exact_quantiles

# Rows of a chain one window task sorts.
BLOCK = 1 << 18


def chain_state(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean and variance per chain: all that R-hat needs. Also valid on
    a stream, in update mode."""
    return df.groupBy(*by, "chain_id").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("var")
    )


def rhat_of_state(state: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Gelman-Rubin statistic from the per-chain state."""
    n = F.col("n")
    return (
        state.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("m"), F.min("n").alias("n"),
            F.var_samp("mean").alias("_b"), F.avg("var").alias("_w"),
        )
        .select(*by, "m", "n", F.sqrt(((n - 1) / n * F.col("_w") + F.col("_b")) / F.col("_w")).alias("rhat"))
    )


def rhat(df: DataFrame, by: Sequence[str] = (), i0: int = 0, nthin: int = 1) -> DataFrame:
    """R-hat of chains of equal length, thinned and cut at i0 // nthin."""
    kept = df.where((F.pmod(F.col("i"), F.lit(nthin)) == 0) & (F.col("i") >= (i0 // nthin) * nthin))
    return rhat_of_state(chain_state(kept, by), by)


def moving_average(df: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """Mean of the last k values; only full windows. Chains are cut into
    blocks with k - 1 rows of overlap, so a long chain is many windows."""
    w = W.partitionBy("chain_id", "_block").orderBy("i").rowsBetween(-(k - 1), 0)
    return (
        with_halo(df, "i", block, k - 1)
        .withColumn("average", F.avg("value").over(w))
        .withColumn("_n", F.count("value").over(w))
        .where(F.col("_own") & (F.col("_n") == k))
        .select("chain_id", "i", "average")
    )


def trace(df: DataFrame, i0: int) -> DataFrame:
    """The series from i0 on."""
    return df.where(F.col("i") >= i0).select("chain_id", "i", "value")


def autocorr(df: DataFrame) -> DataFrame:
    """Circular autocorrelation of each demeaned chain over its value at lag 0,
    for lags below n / 2.

    Each chain is padded to a power of two of at least twice its own length; the
    power spectrum's transform then holds the plain lag sums, and the circular
    one at lag l adds those of l and n - l.
    """
    stats = df.groupBy("chain_id").agg(
        F.count(F.lit(1)).alias("_n"), F.avg("value").alias("_m"),
        (F.var_pop("value") * F.count(F.lit(1))).alias("_c0"),
    )
    stats = stats.withColumns(dict(zip(("_n1", "_n2"), split_columns(2 * F.col("_n")))))
    keys = ["chain_id", "_n1", "_n2"]
    series = df.join(stats, "chain_id").select(
        *keys, "i", (F.col("value") - F.col("_m")).alias("re"), F.lit(0.0).alias("im")
    )
    spectrum = long_fft(series, keys, "i", "_n1", "_n2")
    power = spectrum.select(
        *keys, "i", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("re"), F.lit(0.0).alias("im")
    )
    lagged = long_fft(power, keys, "i", "_n1", "_n2").join(stats.select("chain_id", "_n", "_c0"), "chain_id")
    lagged = lagged.where(F.col("i") < F.col("_n"))
    mirror = F.when(F.col("i") > 0, F.array("i", F.col("_n") - F.col("i"))).otherwise(F.array("i"))
    # The transform of a power spectrum is n1 * n2 times the lag sums; lag 0,
    # the highest, is the plain sum of squares.
    return (
        lagged.withColumn("lag", F.explode(mirror))
        .where(F.col("lag") < F.floor(F.col("_n") / 2.0))
        .groupBy("chain_id", "lag")
        .agg((F.sum("re") / F.first("_c0") / F.first(F.col("_n1") * F.col("_n2"))).alias("xi"))
    )


def tau(xi: DataFrame, floor: float = 0.2) -> DataFrame:
    """Autocorrelation time of each chain: lags above the floor, less one."""
    return xi.where(F.col("xi") > floor).groupBy("chain_id").agg((F.count(F.lit(1)) - 1).alias("tau"))


def median_tau(times: DataFrame) -> DataFrame:
    """Adds the median time over the chains; one row per chain goes in."""
    return times.withColumn("median_tau", times.agg(F.percentile("tau", F.lit(0.5))).scalar())


def geweke(
    df: DataFrame, first: float = 0.1, last: float = 0.5, intervals: int = 20, block: int = BLOCK
) -> DataFrame:
    """z score of an early against a late slice, from `intervals` starts.

    The variance of a slice mean is the AR(2) spectrum at zero, which needs
    the slice's sums and its lag-1 and lag-2 products. The slices of a chain
    begin and end at a few places; rows are summed between those, each row
    once, and a slice adds up the sums that lie in it.
    """
    w = W.partitionBy("chain_id", "_block").orderBy("i")
    lagged = (
        with_halo(df, "i", block, 2)
        .withColumn("x1", F.lag("value", 1).over(w))
        .withColumn("x2", F.lag("value", 2).over(w))
        .where("_own")
    )
    sizes = df.groupBy("chain_id").agg(F.count(F.lit(1)).alias("len"))
    stop = F.floor(F.col("len") * (1.0 - last))
    start = F.when(F.col("k") == intervals - 1, stop).otherwise(
        F.floor(F.col("k") * (stop / F.lit(float(intervals - 1))))
    )
    rest = F.col("len") - F.col("s")
    bounds = ((F.col("s"), F.col("s") + F.floor(rest * first)), (F.col("s") + F.floor(rest * last), F.col("len")))
    ranges = F.array(*(F.struct(F.lit(n).cast("bigint").alias("part"), a.alias("a"), b.alias("b")) for n, (a, b) in enumerate(bounds)))
    slices = (
        sizes.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(intervals - 1).cast("bigint"))))
        .withColumn("s", start)
        .select("chain_id", "k", "s", F.inline(ranges))
    )
    # Products with earlier rows begin one or two rows into a slice, so those places count too.
    places = slices.select("chain_id", F.explode(F.array("a", F.col("a") + 1, F.col("a") + 2, "b")).alias("at"))
    cuts = places.groupBy("chain_id", F.floor(F.col("at") / float(block)).alias("_block")).agg(F.collect_set("at").alias("_cuts"))
    x = F.col("value")
    pieces = (
        lagged.join(cuts, ["chain_id", "_block"], "left")
        .withColumn("_piece", F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col("i"))), F.lit(0)))
        .groupBy("chain_id", "_block", "_piece")
        .agg(
            F.min("i").alias("i"), F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"),
            *(F.sum(e).alias(c) for d in (1, 2) for c, e in ((f"p{d}", x * F.col(f"x{d}")), (f"e{d}", x + F.col(f"x{d}")))),
        )
        .drop("_block", "_piece")
    )
    inside = pieces.join(slices, "chain_id").where((F.col("i") >= F.col("a")) & (F.col("i") < F.col("b")))
    later = {d: F.col("i") >= F.col("a") + d for d in (1, 2)}
    sums = inside.groupBy("chain_id", "k", "s", "part").agg(
        *(F.sum(c).alias(c) for c in ("n", "sx", "sxx")),
        *(F.sum(F.when(later[d], F.col(f"{c}{d}"))).alias(f"{c}{d}") for d in (1, 2) for c in ("p", "e")),
    )
    n, m = F.col("n"), F.col("m")
    cov = lambda k: (F.col(f"p{k}") - m * F.col(f"e{k}") + (n - k) * m * m) / (n - k)
    r0, r1, r2 = F.col("r0"), F.col("r1"), F.col("r2")
    det = r0 * r0 - r1 * r1
    spec = (
        sums.withColumn("m", F.col("sx") / n)
        .withColumns({"r0": F.col("sxx") / n - m * m, "r1": cov(1), "r2": cov(2)})
        .withColumns({"b1": r1 * (r0 - r2) / det, "b2": (r0 * r2 - r1 * r1) / det})
        .withColumn("gap", 1.0 - F.col("b1") - F.col("b2"))
        .withColumn(
            "v", (r0 - r1 * F.col("b1") - r2 * F.col("b2")) / (F.col("gap") * F.col("gap")) / n
        )
    )
    pick = lambda part, c: F.max(F.when(F.col("part") == part, F.col(c)))
    return spec.groupBy("chain_id", "k", "s").agg(
        ((pick(0, "m") - pick(1, "m")) / F.sqrt(pick(0, "v") + pick(1, "v"))).alias("z")
    ).select("chain_id", "k", F.col("s").alias("start"), "z")


def acceptance(props: DataFrame) -> DataFrame:
    """Mean acceptance and out-of-bounds rate per sample and move type, and
    over all moves (move NULL), in one pass."""
    return props.groupingSets(
        [[F.col("sample"), F.col("move")], [F.col("sample")]], F.col("sample"), F.col("move")
    ).agg(
        F.count(F.lit(1)).alias("n"), F.avg("accepted").alias("acceptance"), F.avg("out_of_bounds").alias("out_of_bounds")
    )


def time_budget(props: DataFrame, stage: str = "move", cost: str = "ms") -> DataFrame:
    """Total cost per stage and its share. The window runs over one row per
    stage."""
    per = props.groupBy(stage).agg(F.sum(cost).alias("total"))
    return per.withColumn("share", F.col("total") / F.sum("total").over(W.partitionBy(F.lit(0))))


def background_means(chain: DataFrame, i0: int, keys: Sequence[str]) -> DataFrame:
    """Mean background per run after burn-in."""
    return chain.where(F.col("i") >= i0).groupBy(*keys).agg(F.avg("value").alias("mean"))


def posterior_summary(
    df: DataFrame, by: Sequence[str], probs: dict[str, float], injected: float | Column | None = None
) -> DataFrame:
    """Percent points, mean and scatter of each group, however large; with an
    injected value also the offset of the median and the error bars."""
    points = exact_quantiles(df, by, "value", probs)
    spread = df.groupBy(*by).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    out = points.join(spread, list(by)) if by else points.withColumns(
        {c: spread.select(c).scalar() for c in ("mean", "std")}
    )
    if injected is not None:
        out = out.withColumns(
            {"offset": F.col("p50") - injected, "up": F.col("p84") - F.col("p50"), "down": F.col("p50") - F.col("p16")}
        )
    return out


def cov_matrix(df: DataFrame, size: int) -> DataFrame:
    """Covariance and correlation of each pair of `size` parameters over the
    samples that have both, from rows (sample_id, param, value).

    A sample is the vector of its values with 0 for a missing one, of marks for
    those it has and of the squares; sums of products of these three say all.
    They are added up task by task.
    """
    values = F.map_from_entries(F.collect_list(F.struct("param", "value")))
    known = df.where(F.col("value").isNotNull() & F.col("param").between(0, size - 1))
    vectors = (
        known.groupBy("sample_id").agg(values.alias("_v"))
        .select(F.lit(0).alias("all_"), F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda p: F.try_element_at("_v", p.cast(df.schema["param"].dataType))).alias("v"))
    )

    def design(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        v = np.array(pdf["v"].tolist(), dtype=float)
        mark = (~np.isnan(v)).astype(float)
        v = np.nan_to_num(v)
        return np.hstack([mark, v, v * v]), np.ones(len(v))

    sums = outer_sums(vectors, ["all_"], ["v"], design)
    pairs = df.sparkSession.range(size).select(F.col("id").alias("i"), F.explode(F.sequence("id", F.lit(size - 1).cast("bigint"))).alias("j"))
    # The six sums a pair needs, picked from the table by their places; it has 9 size^2 / 2 rows.
    i, j = F.col("i"), F.col("j")
    places = {"n": (i, j), "a": (j, i + size), "b": (i, j + size), "ab": (i + size, j + size), "aa": (j, i + 2 * size), "bb": (i, j + 2 * size)}
    wanted = pairs.select("i", "j", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), r.alias("p"), c.alias("q")) for k, (r, c) in places.items()))).alias("w")).select("i", "j", "w.*")
    picked = wanted.join(sums.select("p", "q", "s"), ["p", "q"]).groupBy("i", "j").agg(*(F.max(F.when(F.col("k") == k, F.col("s"))).alias(k) for k in places))
    n = F.col("n")
    part = lambda xy, x, y: (F.col(xy) - F.col(x) * F.col(y) / n) / (n - 1)
    cov = part("ab", "a", "b")
    many = picked.where(n > 1)
    return many.select("i", "j", cov.alias("cov"), (cov / F.sqrt(part("aa", "a", "a") * part("bb", "b", "b"))).alias("corr"))


def corrected_posterior(
    df: DataFrame, observed: float, bkg_sigma: float, conv_sigma: float, seed: int, by: Sequence[str] = (), row: str = "i"
) -> DataFrame:
    """Bias samples centred on their median, widened for the fixed background
    and for imperfect convergence, and moved to the corrected observation.

    The draws are a function of (seed, by, row), so neither another partitioning
    nor a task run again changes them.
    """
    med = exact_quantiles(df, by, "value", {"_med": 0.5}).drop("n")
    if by:
        same = reduce(lambda p, q: p & q, [F.col(c).eqNullSafe(F.col(f"_m{n}")) for n, c in enumerate(by)])
        rows = df.join(med.select(*(F.col(c).alias(f"_m{n}") for n, c in enumerate(by)), "_med"), same).drop(*(f"_m{n}" for n in range(len(by))))
    else:
        rows = df.withColumn("_med", med.scalar())
    first, second = normal_pair(F.concat_ws("|", F.lit(seed).cast("string"), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*by, row))))
    noise = first * bkg_sigma + second * conv_sigma
    # The centring and the shift by the median cancel; the median stays in the
    # corrected observation.
    return rows.withColumn("corrected", (F.col("value") - F.col("_med")) + noise + (F.lit(observed) + F.col("_med"))).drop("_med")


def normal_pair(key: Column) -> tuple[Column, Column]:
    """Two independent standard normal numbers of a key: Box-Muller on 64 bits of its hash."""
    word = lambda at: (F.conv(F.substring(F.md5(key), at, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
    radius, turn = F.sqrt(-2.0 * F.log(word(1))), word(9) * (2.0 * math.pi)
    return radius * F.cos(turn), radius * F.sin(turn)
