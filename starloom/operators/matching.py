"""Cross-matching a reference catalog with an ensemble of catalogs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from starloom.operators.bins import bin_index, fill_bins
from starloom.operators.spatial import radius_pairs

INFINITY = float("inf")


def _named(df: DataFrame, prefix: str, keep: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def _flux_agrees(a: Column, b: Column, dmag: float | None, frac: float | None) -> Column:
    if frac is not None:
        return F.abs(a - b) / b < frac
    return F.abs(a - b) < dmag


def associate(
    a: DataFrame,
    b: DataFrame,
    dr: float,
    dmag: float | None = None,
    frac: float | None = None,
    key: str = "truth_id",
    on: Sequence[str] = ("field_id",),
    value: str = "mag",
    conf: str | None = None,
    sig: str | None = None,
) -> DataFrame:
    """For each a: does any b lie within dr and agree in `value`; the best
    confidence and the smallest sigma among those that do (0 and infinity if
    none)."""
    left = _named(a.select(*on, key, "x", "y", value), "a_", [*on, key])
    extra = [c for c in (conf, sig) if c]
    right = _named(b.select(*on, "x", "y", value, *extra), "b_", on)
    pairs = radius_pairs(
        right, left, dr, on, a_xy=("b_x", "b_y"), b_xy=("a_x", "a_y"), inclusive=True
    ).where(_flux_agrees(F.col(f"a_{value}"), F.col(f"b_{value}"), dmag, frac))
    best = [F.lit(True).alias("_hit")]
    best += [F.max(f"b_{conf}").alias("best_conf")] if conf else []
    best += [F.min(f"b_{sig}").alias("best_sig")] if sig else []
    found = pairs.groupBy(*on, key).agg(F.count(F.lit(1)).alias("_n"), *best[1:])
    out = a.select(*on, key).join(found, [*on, key], "left")
    cols = [*on, key, F.col("_n").isNotNull().alias("matched")]
    cols += [F.coalesce("best_conf", F.lit(0.0)).alias("best_conf")] if conf else []
    cols += [F.coalesce("best_sig", F.lit(INFINITY)).alias("best_sig")] if sig else []
    return out.select(*cols)


def sample_counts(ens: DataFrame, on: Sequence[str] = ("field_id",), samples: DataFrame | None = None) -> DataFrame:
    """Samples per run: distinct pairs first, so a large run is combined
    before it is counted. `samples` lists (on, sample_id) of all samples, those
    without a detection too; without it only samples with detections count."""
    return (ens if samples is None else samples).select(*on, "sample_id").distinct().groupBy(*on).agg(F.count(F.lit(1)).alias("nsamp"))


def completeness(
    ref: DataFrame,
    ens: DataFrame,
    dr: float,
    dmag: float | None = None,
    frac: float | None = None,
    key: str = "truth_id",
    on: Sequence[str] = ("field_id",),
    value: str = "mag",
    samples: DataFrame | None = None,
) -> DataFrame:
    """Per reference source: the share of samples that hold a match, 0 in a
    field without any. `samples`: see sample_counts."""
    left = _named(ref.select(*on, key, "x", "y", value), "a_", [*on, key])
    right = _named(ens.select(*on, "sample_id", "x", "y", value), "b_", [*on, "sample_id"])
    hits = (
        radius_pairs(right, left, dr, on, a_xy=("b_x", "b_y"), b_xy=("a_x", "a_y"))
        .where(_flux_agrees(F.col(f"a_{value}"), F.col(f"b_{value}"), dmag, frac))
        .select(*on, key, "sample_id")
        .distinct()
        .groupBy(*on, key)
        .agg(F.count(F.lit(1)).alias("_hits"))
    )
    return (
        ref.join(hits, [*on, key], "left")
        .join(sample_counts(ens, on, samples), list(on), "left")
        .withColumn("nsamp", F.coalesce("nsamp", F.lit(0).cast("bigint")))
        .withColumn("completeness", _share("_hits"))
        .drop("_hits")
    )


def _share(hits: str) -> Column:
    """hits / nsamp, 0 where there is no sample or no hit."""
    return F.when(F.col("nsamp") > 0, F.coalesce(hits, F.lit(0)) / F.col("nsamp")).otherwise(0.0)


def match_nearest(
    truth: DataFrame,
    ens: DataFrame,
    pos: float,
    frac: float,
    bands: Sequence[str] = ("f0",),
    on: Sequence[str] = ("field_id",),
    key: str = "truth_id",
) -> DataFrame:
    """Per (sample, truth, band): the nearest detection closer than `pos` whose
    flux lies within `frac` of the truth. Equal distances go to the brighter.

    The nearest is a running minimum, combined before the shuffle; no group of
    candidates is ever gathered. All bands of a pair are compared in one row, and
    become rows of their own when the nearest are known.
    """
    left = _named(truth.select(*on, key, "x", "y", *bands), "t_", [*on, key])
    right = _named(ens.select(*on, "sample_id", "x", "y", *bands), "d_", [*on, "sample_id"])
    pairs = radius_pairs(
        right, left, pos, on, a_xy=("d_x", "d_y"), b_xy=("t_x", "t_y"), inclusive=False
    )
    tie = [(-F.col(f"d_{bands[0]}")).alias("t0")] + [F.col(f"d_{b}").alias(f"t_{b}") for b in bands[1:]]
    agrees = [F.abs(F.col(f"d_{b}") - F.col(f"t_{b}")) / F.col(f"t_{b}") < frac for b in bands]
    best = [
        F.min(F.when(a, F.struct("d2", *tie, F.col(f"d_{b}").alias("flux"), F.col(f"t_{b}").alias("true_flux")))).alias(f"_m{k}")
        for k, (a, b) in enumerate(zip(agrees, bands))
    ]
    found = [
        F.when(
            F.col(f"_m{k}").isNotNull(),
            F.struct(F.lit(k).cast("bigint").alias("band"), F.col(f"_m{k}.true_flux").alias("true_flux"), F.col(f"_m{k}.flux").alias("flux")),
        )
        for k in range(len(bands))
    ]
    return (
        pairs.where(reduce(lambda a, b: a | b, agrees))
        .groupBy(*on, "sample_id", key)
        .agg(*best)
        .select(*on, "sample_id", key, F.inline(F.array_compact(F.array(*found))))
        .withColumn("error", F.col("flux") - F.col("true_flux"))
    )


def false_discoveries(
    ens: DataFrame,
    truth: DataFrame,
    pos: float,
    frac: float,
    flux: str = "f0",
    on: Sequence[str] = ("field_id",),
    matched: bool = False,
) -> DataFrame:
    """Detections without a truth within `pos` and `frac` of the detection's
    flux (or, with `matched`, those that have one). A semi or anti join on
    tiles: one row per detection comes out, whatever the number of truths."""
    width, reach = 2.0 * pos, pos * (1.0 + 1e-9)
    det = ens.withColumn("_tx", F.floor(F.col("x") / width)).withColumn(
        "_ty", F.floor(F.col("y") / width)
    )

    def touched(c):
        return F.explode(F.sequence(F.floor((F.col(c) - reach) / width), F.floor((F.col(c) + reach) / width)))

    ref = truth.select(
        *[F.col(c).alias(f"t_{c}") for c in on],
        F.col("x").alias("t_x"), F.col("y").alias("t_y"), F.col(flux).alias("t_flux"),
    ).withColumn("t_tx", touched("t_x")).withColumn("t_ty", touched("t_y"))
    dx, dy = F.col("x") - F.col("t_x"), F.col("y") - F.col("t_y")
    cond = (F.col("_tx") == F.col("t_tx")) & (F.col("_ty") == F.col("t_ty"))
    for c in on:
        cond = cond & (F.col(c) == F.col(f"t_{c}"))
    cond = cond & (dx * dx + dy * dy < pos * pos) & (F.abs(F.col("t_flux") - F.col(flux)) / F.col(flux) < frac)
    return det.join(ref.hint("merge"), cond, "left_semi" if matched else "left_anti").drop("_tx", "_ty")


def match_completeness(
    truth: DataFrame, ens: DataFrame, matches: DataFrame, on: Sequence[str] = ("field_id",), key: str = "truth_id",
    samples: DataFrame | None = None,
) -> DataFrame:
    """Share of samples in which each truth was matched, zero included, also in
    a field without a detection. `samples`: see sample_counts."""
    hits = matches.groupBy(*on, key).agg(F.count(F.lit(1)).alias("_hits"))
    return (
        truth.join(hits, [*on, key], "left")
        .join(sample_counts(ens, on, samples), list(on), "left")
        .withColumn("nsamp", F.coalesce("nsamp", F.lit(0).cast("bigint")))
        .withColumn("completeness", _share("_hits"))
        .drop("_hits")
    )


def binned_completeness(per_source: DataFrame, edges: Sequence[float], flux: str = "f0") -> DataFrame:
    """Mean completeness per flux bar [lo, hi), with std / sqrt(n)."""
    stats = (
        per_source.withColumn("bin", bin_index(F.col(flux), edges))
        .where(F.col("bin").isNotNull())
        .groupBy("bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("completeness").alias("completeness"),
            (F.stddev_pop("completeness") / F.sqrt(F.count(F.lit(1)))).alias("error"),
        )
    )
    filled = fill_bins(stats, per_source.sparkSession, edges)
    return filled.withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def binned_fdr(
    ens: DataFrame, truth: DataFrame, pos: float, frac: float, edges: Sequence[float], flux: str = "f0"
) -> DataFrame:
    """False-discovery rate and precision per flux bar; empty bars are NULL."""
    bar = bin_index(F.col(flux), edges)
    total = ens.select(bar.alias("bin"), F.lit(1).alias("t"), F.lit(0).alias("m"))
    found = false_discoveries(ens, truth, pos, frac, flux, matched=True).select(
        bar.alias("bin"), F.lit(0).alias("t"), F.lit(1).alias("m")
    )
    stats = (
        total.unionByName(found)
        .where(F.col("bin").isNotNull())
        .groupBy("bin")
        .agg(F.sum("t").alias("n"), F.sum("m").alias("matched"))
        .withColumn("precision", F.col("matched") / F.col("n"))
        .withColumn("fdr", F.lit(1.0) - F.col("precision"))
    )
    zero = F.lit(0).cast("bigint")
    return fill_bins(stats, ens.sparkSession, edges).withColumns(
        {"n": F.coalesce("n", zero), "matched": F.coalesce("matched", zero)}
    )


def associate_pair(
    dets: DataFrame, src1: tuple[float, float], src2: tuple[float, float], flux1: float, flux2: float
) -> DataFrame:
    """Share out the detections of a two-source set-up, per (cfg, sample).

    With several detections source 2 takes the nearest if closer than twice
    the separation, then source 1 the nearest of the rest under the same rule.
    A single detection goes to the brighter source, or to the nearer if both
    are equally bright. All steps are running minima on the same key, so the
    rows are shuffled once for each of the two picks.
    """
    keys = ["cfg_id", "sample_id"]
    sep2 = (src1[0] - src2[0]) ** 2 + (src1[1] - src2[1]) ** 2
    limit = F.lit(4.0 * sep2)

    def to(s):
        dx, dy = F.col("x") - float(s[0]), F.col("y") - float(s[1])
        return F.struct((dx * dx + dy * dy).alias("d2"), F.col("det_id").alias("id"), "f", F.abs(dx).alias("adx"))

    first = dets.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(to(src2)).alias("p2"), F.min(to(src1)).alias("p1")
    )
    takes2 = F.when(F.col("n") > 1, F.col("p2.d2") < limit).otherwise(
        F.lit(True) if flux2 > flux1 else F.col("p2.d2") < F.col("p1.d2")
    )
    first = first.withColumn("_two", takes2)
    rest = (
        dets.join(first.where(F.col("n") > 1).select(*keys, F.col("p2.id").alias("_taken"), "_two"), keys)
        .where(~F.col("_two") | (F.col("det_id") != F.col("_taken")))
        .groupBy(*keys)
        .agg(F.min(to(src1)).alias("q1"))
    )
    one = F.when(F.col("n") > 1, F.when(F.col("q1.d2") < limit, F.col("q1"))).otherwise(
        F.when(~F.col("_two"), F.col("p1"))
    )
    two = F.when(F.col("_two"), F.col("p2"))
    return (
        first.join(rest, keys, "left")
        .select(*keys, "n", one.alias("a1"), two.alias("a2"))
        .select(
            *keys, "n",
            F.col("a1.adx").alias("dx1"),
            (F.abs(F.col("a1.f") - flux1) / flux1).alias("df1"),
            F.col("a2.adx").alias("dx2"),
            (F.abs(F.col("a2.f") - flux2) / flux2).alias("df2"),
        )
    )


def recovery(
    injected: DataFrame,
    ens: DataFrame,
    pos: float,
    frac: float,
    edges: Sequence[float],
    bands: Sequence[str] = ("f0",),
    on: Sequence[str] = ("field_id",),
    key: str = "truth_id",
    samples: DataFrame | None = None,
) -> DataFrame:
    """Injected against recovered sources, per band and flux bar: sources,
    mean prevalence (matched samples / samples) and mean fractional error of
    the matched ones."""
    found = (
        match_nearest(injected, ens, pos, frac, bands, on, key)
        .groupBy(*on, key, "band")
        .agg(F.count(F.lit(1)).alias("_hits"), F.avg(F.col("error") / F.col("true_flux")).alias("_ferr"))
    )
    per_band = F.explode(
        F.array(
            *[
                F.struct(F.lit(k).cast("bigint").alias("band"), F.col(b).alias("flux"))
                for k, b in enumerate(bands)
            ]
        )
    )
    return (
        injected.withColumn("_b", per_band)
        .select(*on, key, "_b.band", bin_index(F.col("_b.flux"), edges).alias("bin"))
        .where(F.col("bin").isNotNull())
        .join(found, [*on, key, "band"], "left")
        .join(sample_counts(ens, on, samples), list(on), "left")
        .groupBy("band", "bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(_share("_hits")).alias("prevalence"),
            F.avg("_ferr").alias("frac_error"),
        )
    )
