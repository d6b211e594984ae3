"""Maps as pixel rows: rendering, residuals, smoothing, stacking, regridding."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

PIXEL = ["map_id", "row_", "col_"]


def _range(lo: int | Column, hi: int | Column) -> Column:
    as_long = lambda v: (F.lit(v) if isinstance(v, int) else v).cast("bigint")
    return F.explode(F.sequence(as_long(lo), as_long(hi)))


def full_grid(maps: DataFrame, height: int, width: int) -> DataFrame:
    """Every pixel of every map named in `maps`."""
    return maps.withColumn("row_", _range(0, height - 1)).withColumn("col_", _range(0, width - 1))


def render(
    ens: DataFrame, psf: DataFrame, background: DataFrame, height: int, width: int, phases: int,
    bands: Sequence[str] = ("f0",), keys: Sequence[str] = ("field_id", "sample_id"), templates: DataFrame | None = None,
) -> DataFrame:
    """Model image per sample: sources times the PSF of their sub-pixel phase,
    plus background and templates. Sources on the border are dropped.

    Sources move once, to the square blocks of the map that their stencils touch,
    and those of one pixel and phase are added up there, so a crowded pixel costs
    one stencil. Stencils, background and templates become pixels block by block
    in the tasks, so neither stencils nor pixels are shuffled.

    `psf` has (phase_x, phase_y, drow, dcol, w), phases squared stencils of fixed
    size; `background` has the keys and one column per band, `templates` keys,
    row_, col_ and one column per band.
    """
    x, y = F.col("x"), F.col("y")
    inside = ens.where((x > 0) & (x < width - 1) & (y > 0) & (y < height - 1))
    phase = lambda c: F.least(F.floor((F.ceil(c) - c) * phases), F.lit(phases - 1).cast("bigint"))
    stencils = np.array([tuple(r) for r in psf.select(*(F.col(c).cast("double") for c in PSF)).dropna().collect()]).reshape(-1, len(PSF))
    at, block, values = ["_iy", "_ix", "_phase"], [*keys, "_br", "_bc"], list(bands)

    def touched(c, reach, n):
        lo, hi = F.greatest(F.col(c) + int(reach.min()), F.lit(0)), F.least(F.col(c) + int(reach.max()), F.lit(n - 1))
        return F.when(lo <= hi, F.sequence(F.floor(lo / float(BLOCK)).cast("int"), F.floor(hi / float(BLOCK)).cast("int")))

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit((n - 1) // BLOCK)))
    none = F.lit(None).cast("int")
    parts = background.select(*keys, none.alias("_iy"), none.alias("_ix"), F.lit(FLAT).alias("_phase"), *values)
    parts = parts.withColumn("_br", every(height)).withColumn("_bc", every(width))
    if len(stencils):
        sources = inside.select(
            *keys, F.ceil(y).cast("int").alias("_iy"), F.ceil(x).cast("int").alias("_ix"), (phase(x) * phases + phase(y)).cast("int").alias("_phase"), *values
        )
        sources = sources.withColumn("_br", F.explode(touched("_iy", stencils[:, 2], height)))
        parts = parts.unionByName(sources.withColumn("_bc", F.explode(touched("_ix", stencils[:, 3], width))))
    if templates is not None:
        home = [F.floor(F.col(c) / float(BLOCK)).cast("int").alias(b) for c, b in (("row_", "_br"), ("col_", "_bc"))]
        place = [F.col("row_").cast("int").alias("_iy"), F.col("col_").cast("int").alias("_ix")]
        parts = parts.unionByName(templates.select(*keys, *place, F.lit(PIXELS).alias("_phase"), *values, *home))
    merged = parts.repartition(*block).groupBy(*block, *at).agg(*[F.sum(b).alias(b) for b in values])
    known = [F.col(b).isNotNull().cast("double").alias(f"_has_{b}") for b in values]
    terms = F.struct(*(F.coalesce(F.col(c), F.lit(-1)).alias(c) for c in at), *(F.coalesce(F.col(b).cast("double"), F.lit(0.0)).alias(b) for b in values), *known)
    packed = merged.groupBy(*block).agg(F.collect_list(terms).alias("_t"))
    fields = [*at, *values, *(f"_has_{b}" for b in values)]
    packed = packed.select(*block, *[F.col(f"_t.{c}").alias(f"_t_{c}") for c in fields])
    types = dict(ens.dtypes)
    out = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "row_ bigint", "col_ bigint", *(f"`{b}` double" for b in values)])
    return packed.mapInArrow(_painter(stencils, height, width, phases, list(keys), values), out)


PSF = ["phase_x", "phase_y", "drow", "dcol", "w"]
BLOCK = 32  # side of the blocks of a map that are painted at once
FLAT, PIXELS = -1, -2  # in place of a phase: the whole block, one pixel
STAMPED = 1 << 20  # pixels of stencils that a task holds at a time


def _painter(stencils: np.ndarray, height: int, width: int, phases: int, keys: list[str], bands: list[str]):
    """Batches of blocks (keys, _br, _bc, lists of what is added there) to batches of pixels."""
    number = (stencils[:, 0] * phases + stencils[:, 1]).astype(np.int64)
    order = np.argsort(number, kind="stable")
    number, (drow, dcol), w = number[order], stencils[order, 2:4].T.astype(np.int64), stencils[order, 4]
    starts, ends = (np.searchsorted(number, np.arange(phases * phases), side) for side in ("left", "right"))
    cells = BLOCK * BLOCK

    def paint(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        sizes = pc.list_value_length(batch.column("_t__phase")).to_numpy()
        of = np.repeat(np.arange(n), sizes)
        flat = lambda c: batch.column(f"_t_{c}").flatten().to_numpy()
        iy, ix, kind = (flat(c).astype(np.int64) for c in ("_iy", "_ix", "_phase"))
        top, left = (batch.column(c).to_numpy().astype(np.int64) * BLOCK for c in ("_br", "_bc"))
        stamps, ones, whole = (np.flatnonzero(m) for m in (kind >= 0, kind == PIXELS, kind == FLAT))
        count = (ends - starts)[kind[stamps]]
        which = np.repeat(stamps, count)
        cell = np.repeat(starts[kind[stamps]], count) + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        row, col, weight = iy[which] + drow[cell], ix[which] + dcol[cell], w[cell]
        on_map = (row >= 0) & (row < height) & (col >= 0) & (col < width)
        which, row, col, weight = (np.concatenate([a[on_map], b]) for a, b in ((which, ones), (row, iy[ones]), (col, ix[ones]), (weight, np.ones(len(ones)))))
        r, c = row - top[of[which]], col - left[of[which]]
        here = (r >= 0) & (r < BLOCK) & (c >= 0) & (c < BLOCK)
        which, weight, to = which[here], weight[here], (of[which] * cells + r * BLOCK + c)[here]
        # Pixels of each block that lie on the map.
        rows, cols = top[:, None] + np.arange(BLOCK), left[:, None] + np.arange(BLOCK)
        inside = (((rows >= 0) & (rows < height))[:, :, None] & ((cols >= 0) & (cols < width))[:, None, :]).reshape(n, cells)
        under = inside & (np.bincount(of[whole], minlength=n) > 0)[:, None]
        shown = np.flatnonzero((np.bincount(to, minlength=n * cells) > 0) | under.ravel())
        block = shown // cells
        planes = []
        for b in bands:
            v, has = flat(b), flat(f"_has_{b}")
            z = np.bincount(to, weights=v[which] * weight, minlength=n * cells).reshape(n, cells)
            known = np.bincount(to, weights=has[which], minlength=n * cells).reshape(n, cells)
            z = z + np.where(under, np.bincount(of[whole], weights=v[whole], minlength=n)[:, None], 0.0)
            known = known + np.where(under, np.bincount(of[whole], weights=has[whole], minlength=n)[:, None], 0.0)
            planes.append(pa.array(z.ravel()[shown], mask=known.ravel()[shown] == 0))
        places = [pa.array(top[block] + shown % cells // BLOCK), pa.array(left[block] + shown % BLOCK)]
        return pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(block)) for k in keys), *places, *planes], names=[*keys, "row_", "col_", *bands])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        largest = max(1, int((ends - starts).max(initial=1)))
        for batch in batches:
            size = pc.list_value_length(batch.column("_t__phase")).to_numpy()
            total = np.cumsum(size * largest + cells)
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + STAMPED, side="right")))
                yield paint(batch.slice(at, to - at))
                at = to

    return run


def residuals(pixels: DataFrame, model: DataFrame, weight: str | None = None) -> DataFrame:
    """Data minus model, and times the root of the weight when one is named.
    A pixel without a model keeps its data."""
    out = pixels.join(model, PIXEL, "left").withColumn("resid", F.col("image") - F.coalesce("model", F.lit(0.0)))
    if weight:
        out = out.withColumn("scaled", F.col("resid") * F.sqrt(weight))
    return out


def chi2(pixels: DataFrame, models: DataFrame, by: Sequence[str] = ("map_id", "sample_id")) -> DataFrame:
    """Weighted squared residual and its value per observed pixel. The sums
    start before the shuffle, so a large map is shared by its tasks."""
    r = F.col("image") - F.col("model")
    used = (F.col("weight") > 0).cast("int")
    return (
        pixels.join(models, PIXEL)
        .groupBy(*by)
        .agg(F.sum(F.col("weight") * r * r).alias("chi2"), F.sum(used).alias("npix"))
        .withColumn("reduced", F.try_divide(F.col("chi2"), F.col("npix")))
    )


def with_tiles(pixels: DataFrame, size: int, margin: int, tiles: int, off: int = 0) -> DataFrame:
    """Copy each pixel to every region whose margin reaches it."""
    def reach(c):
        lo = F.greatest(F.floor((F.col(c) + off - margin) / float(size)), F.lit(0).cast("bigint"))
        hi = F.least(F.floor((F.col(c) + off + margin) / float(size)), F.lit(tiles - 1).cast("bigint"))
        return _range(lo, hi)

    return pixels.withColumn("tile_y", reach("row_")).withColumn("tile_x", reach("col_"))


def best_chi2(chi: DataFrame, frac: float) -> DataFrame:
    """Smallest chi-squared of each map after burn-in."""
    last = chi.groupBy("map_id").agg(F.max("sample_id").alias("_last"))
    kept = chi.join(last, "map_id").where(F.col("sample_id") >= F.floor((F.col("_last") + 1) * frac))
    return kept.groupBy("map_id").agg(F.min("chi2").alias("best"))


def gaussian_chi2(d1: Column, d2: Column, caa: Column, cab: Column, cbb: Column) -> Column:
    """Difference^T C^-1 difference for two values."""
    return (cbb * d1 * d1 - 2.0 * cab * d1 * d2 + caa * d2 * d2) / (caa * cbb - cab * cab)


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    total = sum(raw)
    return [w / total for w in raw]


def smooth(
    df: DataFrame, value: str, sigma: float, height: int, width: int, keys: Sequence[str] = ("map_id",)
) -> DataFrame:
    """Gaussian smoothing, cut at four sigma, edges reflected. A missing pixel
    adds nothing and gets no value.

    One axis at a time: the lines of that axis travel as arrays, long ones in
    stretches that know as many neighbours as the kernel reaches, and are
    convolved a batch at a time. So a pixel moves once per axis, however wide
    the kernel is.
    """
    weights = np.array(gaussian_weights(sigma))
    out = df.select(*keys, "row_", "col_", F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull())
    for axis, n in (("row_", height), ("col_", width)):
        out = _convolve_lines(out, [*keys, "col_" if axis == "row_" else "row_"], axis, n, value, weights)
    return out.select(*keys, "row_", "col_", value).join(df.select(*keys, "row_", "col_"), [*keys, "row_", "col_"], "left_semi")


STRETCH = 1 << 12  # pixels of a line that one task row holds, besides the kernel's reach


def _convolve_lines(df: DataFrame, line: Sequence[str], axis: str, n: int, value: str, weights: np.ndarray) -> DataFrame:
    """Every line (its keys, then pixels 0 to n - 1 along `axis`) convolved with a kernel of odd length, reflected at its ends."""
    radius = len(weights) // 2
    stretch = max(STRETCH, 4 * radius)
    if n > stretch:
        last = F.lit((n - 1) // stretch).cast("bigint")
        to = lambda d: F.greatest(F.lit(0).cast("bigint"), F.least(last, F.floor((F.col(axis) + d) / float(stretch))))
        df = df.withColumn("_part", F.explode(F.sequence(to(-radius), to(radius))))
    else:
        df = df.withColumn("_part", F.lit(0).cast("bigint"))
    lines = df.groupBy(*line, "_part").agg(F.collect_list(F.struct(axis, value)).alias("_line"))
    packed = lines.select(*line, "_part", F.col(f"_line.{axis}").alias("_at"), F.col(f"_line.{value}").alias("_v"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, pdf in batch.groupby("_part", sort=False):
                low, high = part * stretch, min(n, (part + 1) * stretch)
                places = np.arange(low - radius, high + radius)
                z = np.zeros((len(pdf), len(places)))
                row = np.repeat(np.arange(len(pdf)), [len(a) for a in pdf["_at"]])
                at, v = (np.concatenate(pdf[c].to_list()) for c in ("_at", "_v"))
                near = (at >= places[0]) & (at <= places[-1])
                z[row[near], at[near] - places[0]] = v[near]
                turned = places % (2 * n)
                turned = np.where(turned < n, turned, 2 * n - 1 - turned)
                beyond = (places < 0) | (places >= n)
                z[:, beyond] = z[:, turned[beyond] - places[0]]
                done = sum(w * z[:, k : k + high - low] for k, w in enumerate(weights))
                yield pdf[list(line)].assign(_part=part, _v=list(done))

    fields = ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in line)
    done = packed.mapInPandas(run, f"{fields}, _part bigint, _v array<double>")
    return done.select(*line, "_part", F.posexplode("_v").alias("_k", value)).select(*line, (F.col("_part") * stretch + F.col("_k")).alias(axis), value)


def stack_maps(models: DataFrame, value: str = "model", keys: Sequence[str] = tuple(PIXEL)) -> DataFrame:
    """Median, mean and scatter of every pixel over its samples."""
    return models.groupBy(*keys).agg(
        F.percentile(value, F.lit(0.5)).alias("median"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")
    )


def mask_bounds(pixels: DataFrame, by: Sequence[str] = ("map_id",)) -> DataFrame:
    """First and last observed row and column."""
    return pixels.where(F.col("mask") == 1).groupBy(*by).agg(
        F.min("row_").alias("row_lo"), F.max("row_").alias("row_hi"), F.min("col_").alias("col_lo"), F.max("col_").alias("col_hi")
    )


def cutout(pixels: DataFrame, centres: DataFrame, size: int) -> DataFrame:
    """Square of `size` pixels about each centre (map_id, cx, cy); pixels off
    the map are NULL."""
    half = size // 2
    grid = (
        centres.withColumn("dr", _range(0, size - 1)).withColumn("dc", _range(0, size - 1))
        .withColumn("row_", F.col("cy") - half + F.col("dr")).withColumn("col_", F.col("cx") - half + F.col("dc"))
    )
    return grid.join(pixels.select(*PIXEL, "image"), PIXEL, "left").select("map_id", "dr", "dc", "image")


def pad(pixels: DataFrame, side: int, values: Sequence[str], pivot: int | None = None) -> DataFrame:
    """Copy each map into a square; zero outside it and beyond the pivot. Zero
    rows and pixels meet in one sum instead of a join. Hardly any two of them are
    the same pixel, so they are summed after the shuffle only; and the lines of
    the squares are dealt before they become pixels."""
    lines = pixels.select("map_id").distinct().withColumn("row_", _range(0, side - 1)).repartition("map_id", "row_")
    zeros = lines.withColumn("col_", _range(0, side - 1)).select(*PIXEL, *[F.lit(0.0).alias(v) for v in values])
    limit = side if pivot is None else min(side, pivot)
    inside = pixels.where((F.col("row_") < limit) & (F.col("col_") < limit)).select(*PIXEL, *values)
    return zeros.unionByName(inside).repartition(*PIXEL).groupBy(*PIXEL).agg(*[F.sum(v).alias(v) for v in values])


def upsample(grid: DataFrame, k: int, height: int, width: int, value: str = "image", keys: Sequence[str] = ("map_id",)) -> DataFrame:
    """Bilinear zoom by k, corners on corners: each coarse pixel adds its share
    to the fine pixels less than one coarse step away. A fine pixel that lacks
    one of the coarse pixels it needs has no value."""
    out = grid.select(*keys, "row_", "col_", value)
    for axis, n in (("row_", height), ("col_", width)):
        m = n * k
        step = (n - 1) / (m - 1)
        fine = out.withColumn("_t", _range(
            F.greatest(F.floor((F.col(axis) - 1) / step), F.lit(0).cast("bigint")),
            F.least(F.ceil((F.col(axis) + 1) / step), F.lit(m - 1).cast("bigint")),
        ))
        share = F.lit(1.0) - F.abs(F.col("_t") * step - F.col(axis))
        other = "col_" if axis == "row_" else "row_"
        out = (
            fine.withColumn("_w", share).where(F.col("_w") > 0)
            .groupBy(*keys, other, F.col("_t").alias(axis)).agg(F.sum(F.col("_w") * F.col(value)).alias(value), F.sum("_w").alias("_all"))
            .where(F.col("_all") > 1.0 - 1e-9)
            .select(*keys, "row_", "col_", value)
        )
    return out


def upsample_edges(edges: Sequence[float], k: int) -> list[float]:
    """Linear zoom by k of a list of bin edges."""
    n, m = len(edges), len(edges) * k
    out = []
    for t in range(m):
        at = t * (n - 1) / (m - 1)
        i = min(int(at), n - 2)
        out.append(edges[i] + (edges[i + 1] - edges[i]) * (at - i))
    return out


def tile_templates(pixels: DataFrame, nregion: int, height: int, width: int, amp: float = 1.0) -> DataFrame:
    """Share of each pixel in each of nregion^2 boxes, times the band amplitude."""
    def axis(df, c, n, name):
        size = n / nregion
        lo, hi = F.col(c).cast("double"), F.col(c) + 1.0
        first = F.floor(lo / size)
        last = F.least(F.floor(hi / size), F.lit(nregion - 1).cast("bigint"))
        df = df.withColumn(name, _range(first, last))
        part = F.least(hi, (F.col(name) + 1) * size) - F.greatest(lo, F.col(name) * size)
        return df.withColumn(f"_{name}", F.greatest(part, F.lit(0.0)))

    out = axis(axis(pixels, "row_", height, "tile_y"), "col_", width, "tile_x")
    return out.withColumn("weight", F.col("_tile_x") * F.col("_tile_y") * amp).where(F.col("weight") > 1e-12).drop("_tile_x", "_tile_y")


def astrom_grid(half: DataFrame, keys: Sequence[str] = ("map_id",), shift_x: float = 0.0, shift_y: float = 0.0) -> DataFrame:
    """Mapping and its central differences at whole pixels, from a mapping
    given at half pixels (row2, col2) with values xp, yp. Windows run along
    single rows and single columns of a map."""
    along_x = W.partitionBy(*keys, "row2").orderBy("col2")
    along_y = W.partitionBy(*keys, "col2").orderBy("row2")
    diff = lambda c, w: F.lead(c).over(w) - F.lag(c).over(w)
    out = half.withColumns({"dxdx": diff("xp", along_x), "dydx": diff("yp", along_x)}).withColumns(
        {"dxdy": diff("xp", along_y), "dydy": diff("yp", along_y)}
    )
    whole = out.where((F.col("row2") % 2 == 0) & (F.col("col2") % 2 == 0))
    complete = whole.where(F.col("dxdx").isNotNull() & F.col("dxdy").isNotNull())
    return complete.select(
        *keys, F.floor(F.col("row2") / 2.0).alias("row_"), F.floor(F.col("col2") / 2.0).alias("col_"),
        (F.col("xp") - shift_x).alias("xp"), (F.col("yp") - shift_y).alias("yp"), "dxdx", "dydx", "dxdy", "dydy",
    )


def template_norm(pixels: DataFrame, value: str, rms_scale: float, units: dict[str, float], intensity: dict[str, float]) -> DataFrame:
    """RMS of each map's coarse template, scaled to every band."""
    first = next(iter(units))
    base = pixels.groupBy("map_id").agg((F.stddev_pop(value) * rms_scale).alias("_n"))
    ratios = [
        F.struct(F.lit(b).alias("band"), F.lit(1.0 if b == first else units[b] / units[first] * intensity[b] / intensity[first]).alias("ratio"))
        for b in units
    ]
    return base.withColumn("_r", F.explode(F.array(*ratios))).select(
        "map_id", F.col("_r.band").alias("band"), (F.col("_n") * F.col("_r.ratio")).alias("norm")
    )


def integrate_template(pixels: DataFrame, template: str, amp: float, solid_angle: float) -> DataFrame:
    """Flux of a template: sum of amplitude x template x solid angle."""
    return pixels.groupBy("map_id").agg((F.sum(template) * amp * solid_angle).alias("flux"))
