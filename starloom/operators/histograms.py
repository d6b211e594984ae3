"""Histograms, densities, number counts and intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from starloom.operators.bins import bin_index, edge_table, fill_bins, held_bin, in_bins


def histogram(
    df: DataFrame, column: str, edges: Sequence[float], density: bool = False, by: Sequence[str] = (), groups: DataFrame | None = None
) -> DataFrame:
    """Counts per bar, zero filled; bars are [a, b), the last one closed. With
    `density` also count / (total * width). `by` gives one histogram per group;
    `groups` lists the groups, so that one without rows gets empty bars."""
    counted = (
        df.where(in_bins(F.col(column), edges, last_closed=True))
        .select(*by, held_bin(F.col(column), edges, last_closed=True).alias("bin"))
        .groupBy(*by, "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    zero = F.lit(0).cast("bigint")
    bars = edge_table(df.sparkSession, edges)
    if by:
        # Every group gets every bar by copying the group keys along the bars.
        table = F.array(*[F.lit(float(e)) for e in edges])
        last = F.lit(len(edges) - 2).cast("bigint")
        grid = (df if groups is None else groups).select(*by).distinct().withColumn("bin", F.explode(F.sequence(zero, last)))
        grid = grid.withColumn("lo", F.element_at(table, (F.col("bin") + 1).cast("int"))).withColumn(
            "hi", F.element_at(table, (F.col("bin") + 2).cast("int"))
        )
        out = grid.join(counted, [*by, "bin"], "left").withColumn("n", F.coalesce("n", zero))
    else:
        out = bars.join(counted, "bin", "left").withColumn("n", F.coalesce("n", zero))
    if density:
        # The window runs over the bars of one histogram, a few dozen rows.
        total = F.sum("n").over(W.partitionBy(*by) if by else W.partitionBy(F.lit(0)))
        out = out.withColumn("density", F.col("n") / (total * (F.col("hi") - F.col("lo"))))
    return out


def histogram_over(df: DataFrame, column: str, edges: DataFrame, edge: str = "edge") -> DataFrame:
    """Counts per bar (bin, lo, hi, n) between edges that come as rows, for
    instance from scott_edges; zero filled, the last bar closed.

    The edges, whose number grows as the cube root of the data's, are one sorted
    array in the plan. Each value finds its bar in it by halving.
    """
    table = edges.agg(F.array_sort(F.array_distinct(F.collect_list(edge))).alias("_e"))
    rows = df.select(F.col(column).cast("double").alias("_v")).withColumn("_e", table.scalar())
    steps = F.array(*[F.lit(1 << k).cast("int") for k in range(29, -1, -1)])
    # The last edge that is not above the value; beyond the array there is none.
    found = F.aggregate(steps, F.lit(-1), lambda at, step: F.when(F.get("_e", at + step) <= F.col("_v"), at + step).otherwise(at))
    last = F.size("_e") - 1
    at = F.when((found == last) & (F.col("_v") == F.get("_e", last)), last - 1).otherwise(found)
    counted = rows.withColumn("_at", at).where((F.col("_at") >= 0) & (F.col("_at") < last)).groupBy(F.col("_at").cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    ends = F.arrays_zip(F.slice("_e", 1, F.size("_e") - 1).alias("lo"), F.slice("_e", 2, F.size("_e") - 1).alias("hi"))
    bars = table.where(F.size("_e") > 1).select(F.posexplode(ends).alias("bin", "_b")).select(F.col("bin").cast("bigint").alias("bin"), F.col("_b.lo").alias("lo"), F.col("_b.hi").alias("hi"))
    return bars.join(counted, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def uniform_histogram(df: DataFrame, column: str, bars: int) -> DataFrame:
    """Histogram of `bars` equal bars between the extremes of the data. The
    extremes come from one small aggregate, read by the plan as a constant."""
    ends = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    value = df.select(F.col(column).alias("_v")).withColumns({"_lo": lo, "_hi": hi})
    bar = F.least(
        F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.lit(float(bars))),
        F.lit(bars - 1).cast("bigint"),
    )
    counted = value.where(F.col("_v").isNotNull()).groupBy(bar.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(bars).select(F.col("id").alias("bin"))
    return grid.join(counted, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def hist_lookup(df: DataFrame, column: str, hist: DataFrame, edges: Sequence[float], out: str) -> DataFrame:
    """Value of the bar [lo, hi) that holds `column`, 0 outside. `hist` has one
    row per bar, so its size is that of `edges`."""
    bars = hist.select("bin", F.col("value").alias(out))
    return (
        df.withColumn("bin", bin_index(F.col(column), edges))
        .join(bars, "bin", "left")
        .withColumn(out, F.coalesce(out, F.lit(0.0)))
        .drop("bin")
    )


def density2d(
    df: DataFrame, x_edges: Sequence[float], y_edges: Sequence[float], norm: str = "max", x: str = "x", y: str = "y"
) -> DataFrame:
    """2-D histogram, zero filled, with counts over their maximum or sum. The
    normalising window runs over the cells of the grid, not over the rows."""
    nx, ny = len(x_edges) - 1, len(y_edges) - 1
    counted = (
        df.where(in_bins(F.col(x), x_edges, True) & in_bins(F.col(y), y_edges, True))
        .select(held_bin(F.col(x), x_edges, True).alias("bx"), held_bin(F.col(y), y_edges, True).alias("by_"))
        .groupBy("bx", "by_")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    grid = df.sparkSession.range(nx * ny).select(F.floor(F.col("id") / float(ny)).alias("bx"), (F.col("id") % ny).alias("by_"))
    out = grid.join(counted, ["bx", "by_"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    whole = W.partitionBy(F.lit(0))
    scale = F.max("n").over(whole) if norm == "max" else F.sum("n").over(whole)
    return out.withColumn("density", F.col("n") / scale)


def density_region(dens: DataFrame, sigma: float = 1.0) -> DataFrame:
    """Cells of a max-normalised density at or above 1 - exp(-sigma^2 / 2)."""
    return dens.where(F.col("density") >= 1.0 - F.exp(F.lit(-0.5 * sigma * sigma)))


def number_counts(
    src: DataFrame, edges: Sequence[float], sr: float, flux: str = "f0", by: Sequence[str] = ("field_id",),
    samples: DataFrame | None = None,
) -> DataFrame:
    """Euclidean-normalised counts N S^2.5 / sr / dS in bars of log10 S + 3:
    median, p16 and p84 over samples, with the sqrt(n) error of the mean.
    `samples` lists all samples; one without a source counts as 0 in each bar."""
    logs = src.select(*by, "sample_id", (F.log10(F.col(flux)) + 3.0).alias("_s"))
    per = histogram(logs, "_s", edges, by=[*by, "sample_id"], groups=samples)
    ten = F.lit(10.0)
    s = F.pow(ten, (F.col("lo") + F.col("hi")) * 0.5 - 3.0)
    ds = F.pow(ten, F.col("hi") - 3.0) - F.pow(ten, F.col("lo") - 3.0)
    scale = F.pow(s, F.lit(2.5)) / F.lit(float(sr)) / ds
    points = F.percentile("dn", F.array(F.lit(0.16), F.lit(0.5), F.lit(0.84))).alias("_p")
    return (
        per.withColumn("dn", F.col("n") * scale)
        .groupBy(*by, "bin")
        .agg(points, (F.sqrt(F.avg("n")) * F.first(scale)).alias("root_n"))
        .select(
            *by, "bin", F.element_at("_p", 2).alias("median"), F.element_at("_p", 1).alias("p16"),
            F.element_at("_p", 3).alias("p84"), "root_n",
        )
    )


def scott_edges(df: DataFrame, column: str) -> DataFrame:
    """k edges between the extremes, k from Scott's width 3.5 std n^(-1/3)."""
    c = F.col(column)
    stats = df.agg(
        F.count(c).alias("n"), F.stddev_pop(c).alias("std"), F.min(c).alias("lo"), F.max(c).alias("hi")
    )
    width = F.lit(3.5) * F.col("std") / F.pow(F.col("n"), F.lit(1.0 / 3.0))
    k = F.ceil((F.col("hi") - F.col("lo")) / width)
    return (
        stats.withColumn("k", k)
        .withColumn("edge_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)))
        .select("edge_id", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("edge_id") / (F.col("k") - 1)).alias("edge"))
    )


def hdpi(hist: DataFrame, frac: float, by: Sequence[str] = ()) -> DataFrame:
    """Highest-density interval of a histogram (bin, t, p): from the mode, add
    the higher neighbouring bar (the left one on equality) until the mass
    reaches `frac` or the bars run out. Bars of a histogram are few, so they
    fold as one array."""
    bars = hist.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("bin", "t", "p"))).alias("h"))
    h = F.col("h")
    mode = F.array_position(F.transform(h, lambda b: b["p"]), F.array_max(F.transform(h, lambda b: b["p"])))
    start = F.struct(
        mode.cast("int").alias("lo"), mode.cast("int").alias("hi"), F.element_at(h, mode.cast("int"))["p"].alias("mass")
    )

    def step(s, _):
        none = F.lit(-1.0)
        left = F.when(s["lo"] > 1, F.try_element_at(h, F.when(s["lo"] > 1, s["lo"] - 1).otherwise(F.lit(1)))["p"]).otherwise(none)
        right = F.coalesce(F.try_element_at(h, s["hi"] + 1)["p"], none)
        done = (s["mass"] >= frac) | ((left < 0) & (right < 0))
        go_right = right > left
        return F.when(done, s).otherwise(
            F.struct(
                F.when(go_right, s["lo"]).otherwise(s["lo"] - 1).alias("lo"),
                F.when(go_right, s["hi"] + 1).otherwise(s["hi"]).alias("hi"),
                (s["mass"] + F.when(go_right, right).otherwise(left)).alias("mass"),
            )
        )

    folded = bars.withColumn("_s", F.aggregate(h, start, step))
    return folded.select(
        *by, F.element_at(h, F.col("_s.lo"))["t"].alias("t_lo"), F.element_at(h, F.col("_s.hi"))["t"].alias("t_hi"),
        F.col("_s.mass").alias("mass"), (F.col("_s.hi") - F.col("_s.lo") + 1).cast("bigint").alias("bars"),
    )


def sample_posterior(
    df: DataFrame, column: str, edges: Sequence[float], by: Sequence[str] = ("field_id",), samples: DataFrame | None = None
) -> DataFrame:
    """Median and scatter over samples of each sample's histogram (+0.01), and
    the medians as a density: over their sum and the bar width. `samples` lists
    all samples, those without a source too."""
    per = histogram(df, column, edges, by=[*by, "sample_id"], groups=samples)
    bars = per.groupBy(*by, "bin").agg(
        F.percentile(F.col("n") + 0.01, F.lit(0.5)).alias("median"), F.stddev_pop(F.col("n") + 0.01).alias("std"),
        F.first(F.col("hi") - F.col("lo")).alias("width"),
    )
    scale = F.sum("median").over(W.partitionBy(*by)) * F.col("width")
    return bars.select(*by, "bin", "median", "std", (F.col("median") / scale).alias("density"))
