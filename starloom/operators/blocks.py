"""Neighbour searches inside spatial blocks, a few arrays at a time.

Points are dealt to square blocks of their field, with copies of those nearby. A task
holds the arrays of one block and looks neighbours up through a grid of cells, so no
list of all pairs is made where only nearest partners are asked for. A crowded block is
shared by several tasks: each searches for some of its points, all see the whole block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from starloom.operators.spatial import PAD
from starloom.session import cut_lineage

WIDTH = 32.0  # block side in radii
CROWDED = 50_000  # points of a block that one task searches for
FEW = 48  # points compared one by one; above, a grid is laid
PAIRS = 1 << 20  # pairs held at a time


def deal(points: DataFrame, radius: float, halo: float, keys: Sequence[str] = ("field_id",), written: bool = False) -> DataFrame:
    """points(*keys, x, y, ...) with a row per block that sees them.

    Adds _bx, _by (the block), _share of _shares (which of its tasks) and _own: the one
    copy that is searched for. halo: how many radii a block sees beyond its border. Blocks with
    more than CROWDED points go to several tasks; which ones comes from counts by block.
    """
    if not written:
        points = cut_lineage(points)  # read twice below, whatever they cost to make
    width, reach = WIDTH * radius, halo * radius * PAD
    home = [F.floor(F.col(c) / width) for c in ("x", "y")]
    block = [*keys, "_bx", "_by"]
    shares = (
        points.groupBy(*keys, home[0].alias("_bx"), home[1].alias("_by")).agg(F.count(F.lit(1)).alias("_n"))
        .select(*block, F.ceil(F.col("_n") / CROWDED).cast("int").alias("_shares")).where("_shares > 1")
    )
    seen = points.withColumns({"_hx": home[0], "_hy": home[1]})
    for c, b in (("x", "_bx"), ("y", "_by")):
        seen = seen.withColumn(b, F.explode(F.sequence(F.floor((F.col(c) - reach) / width), F.floor((F.col(c) + reach) / width))))
    seen = seen.withColumn("_home", (F.col("_bx") == F.col("_hx")) & (F.col("_by") == F.col("_hy"))).drop("_hx", "_hy")
    seen = seen.join(shares, block, "left").withColumn("_shares", F.coalesce("_shares", F.lit(1)))
    mine = F.pmod(F.xxhash64("x", "y", *keys), F.col("_shares"))
    seen = seen.withColumn("_mine", mine).withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)))
    return seen.withColumn("_own", F.col("_home") & (F.col("_mine") == F.col("_share"))).drop("_home", "_mine")


class Grid:
    """Points sorted by cell; cells are looked up by number."""

    def __init__(self, x: np.ndarray, y: np.ndarray, cell: float) -> None:
        self.cell, self.x0, self.y0 = cell, x.min(), y.min()
        self.columns = int((x.max() - self.x0) / cell) + 1
        self.rows = int((y.max() - self.y0) / cell) + 1
        number = self.number(*self.place(x, y))
        self.order = np.argsort(number, kind="stable")
        self.sorted = number[self.order]

    def place(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.floor((x - self.x0) / self.cell).astype(np.int64), np.floor((y - self.y0) / self.cell).astype(np.int64)

    def number(self, cx: np.ndarray, cy: np.ndarray) -> np.ndarray:
        return cy * self.columns + cx

    def crowd(self) -> np.ndarray:
        """Points in the nine cells around each point, in order of the grid."""
        cells, n = np.unique(self.sorted, return_counts=True)
        around = np.zeros(len(cells), dtype=np.int64)
        x = cells % self.columns
        for oy in (-1, 0, 1):
            for ox in (-1, 0, 1):
                to = np.searchsorted(cells, cells + oy * self.columns + ox)
                hit = (to < len(cells)) & (x + ox >= 0) & (x + ox < self.columns)
                hit[hit] = cells[to[hit]] == (cells + oy * self.columns + ox)[hit]
                around[hit] += n[to[hit]]
        return np.repeat(around, n)

    def members(self, cx: np.ndarray, cy: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(which of the asked, point) for the points in the cells (cx, cy), some at a time."""
        inside = (cx >= 0) & (cx < self.columns) & (cy >= 0) & (cy < self.rows)
        asked = np.flatnonzero(inside)
        number = self.number(cx[asked], cy[asked])
        lo, hi = np.searchsorted(self.sorted, number), np.searchsorted(self.sorted, number, side="right")
        full = hi > lo
        asked, lo, size = asked[full], lo[full], (hi - lo)[full]
        total = np.cumsum(size)
        at = 0
        while at < len(asked):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, side="right")))
            n = size[at:to]
            first = np.cumsum(n) - n
            yield np.repeat(asked[at:to], n), self.order[np.repeat(lo[at:to], n) + np.arange(n.sum()) - np.repeat(first, n)]
            at = to


def pairs_within(
    x: np.ndarray, y: np.ndarray, of: np.ndarray, radius: float, grid: Grid | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, d2) of points i in `of` and all points j != i within the radius, some at a time."""
    yield np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not len(of):
        return
    grid = grid or Grid(x, y, radius * PAD)
    cx, cy = grid.place(x[of], y[of])
    for ox in (-1, 0, 1):
        for oy in (-1, 0, 1):
            for asked, j in grid.members(cx + ox, cy + oy):
                i = of[asked]
                d2 = (x[i] - x[j]) ** 2 + (y[i] - y[j]) ** 2
                near = (d2 <= radius * radius) & (i != j)
                yield i[near], j[near], d2[near]


def close_pairs(x: np.ndarray, y: np.ndarray, radius: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(i, j, d2) of all pairs of points within the radius, each once, either way round; None
    where more than `most` pairs of points in touching cells would have to be looked at.

    Cells of a row have numbers in a row, so a point's later partners are two runs of the
    sorted points: up to the end of the next cell, and three cells of the next row.
    """
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    cell = radius * PAD
    cx, cy = (np.floor((c - c.min()) / cell).astype(np.int64) for c in (x, y))
    number = cy * (cx.max() + 2) + cx  # a column stays empty, so rows don't touch
    order = np.argsort(number, kind="stable")
    number, sx, sy = number[order], x[order], y[order]
    at = np.arange(len(x))
    below = number + cx.max() + 2
    runs = [(at + 1, np.searchsorted(number, number + 1, side="right")), (np.searchsorted(number, below - 1), np.searchsorted(number, below + 1, side="right"))]
    lo = np.concatenate([a for a, _ in runs])
    n = np.concatenate([b for _, b in runs]) - lo
    if (total := int(n.sum())) > most:
        return None
    i = np.repeat(np.append(at, at), n)
    j = np.arange(total) + np.repeat(lo - (np.cumsum(n) - n), n)
    d2 = (sx[i] - sx[j]) ** 2 + (sy[i] - sy[j]) ** 2
    near = np.flatnonzero(d2 <= radius * radius)
    return order[i[near]], order[j[near]], d2[near]


def between(x: np.ndarray, y: np.ndarray, qx: np.ndarray, qy: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(q, j) of places (qx, qy) and the points (x, y) within the radius, some at a time."""
    if not len(x):
        return
    grid = Grid(x, y, radius * PAD)
    cx, cy = grid.place(qx, qy)
    for ox in (-1, 0, 1):
        for oy in (-1, 0, 1):
            for q, j in grid.members(cx + ox, cy + oy):
                near = (x[j] - qx[q]) ** 2 + (y[j] - qy[q]) ** 2 <= radius * radius
                yield q[near], j[near]


class Nearest:
    """Nearest of a set of points, ties to the least name, and how many points are as near."""

    def __init__(self, x: np.ndarray, y: np.ndarray, name: np.ndarray, radius: float) -> None:
        self.x, self.y, self.name, self.radius = x, y, name, radius
        self.grid = None
        if len(x) > FEW:
            area = max((x.max() - x.min()) * (y.max() - y.min()), (radius / 64) ** 2)
            self.grid = Grid(x, y, min(radius, max(radius / 64, float(np.sqrt(2 * area / len(x))))))

    def of(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point or -1, d2, ties) within the radius of each (x, y)."""
        best = np.full(len(x), -1, dtype=np.int64)
        d2, ties = np.full(len(x), np.inf), np.zeros(len(x), dtype=np.int64)
        if self.grid is None:
            step = max(1, PAIRS // max(1, len(self.x)))
            for at in range(0, len(x), step):
                part = slice(at, at + step)
                d = (x[part, None] - self.x) ** 2 + (y[part, None] - self.y) ** 2
                least = d.min(axis=1)
                same = d == least[:, None]
                ties[part] = same.sum(axis=1)
                # names are below this everywhere, so a miss never wins
                best[part] = np.where(same, self.name, np.iinfo(np.int64).max).argmin(axis=1)
                d2[part] = least
        else:
            self.by_rings(x, y, best, d2, ties)
        far = ~(d2 <= self.radius * self.radius)
        best[far], ties[far] = -1, 0
        return best, d2, ties

    def by_rings(self, x: np.ndarray, y: np.ndarray, best: np.ndarray, d2: np.ndarray, ties: np.ndarray) -> None:
        """Cells around each place, ring by ring, until what lies farther out can't be nearer."""
        grid = self.grid
        cx, cy = grid.place(x, y)
        open_ = np.arange(len(x))
        ring = 0
        # A point beyond ring k is at least k cells away.
        while len(open_) and (ring - 1) * grid.cell <= self.radius * PAD:
            for ox in range(-ring, ring + 1):
                for oy in range(-ring, ring + 1) if abs(ox) == ring else (-ring, ring):
                    for asked, j in grid.members(cx[open_] + ox, cy[open_] + oy):
                        i = open_[asked]
                        d = (x[i] - self.x[j]) ** 2 + (y[i] - self.y[j]) ** 2
                        order = np.lexsort((self.name[j], d, i))
                        i, j, d = i[order], j[order], d[order]
                        first = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
                        count = np.add.reduceat((d == np.repeat(d[first], np.diff(np.append(first, len(d))))).astype(np.int64), first)
                        i, j, d = i[first], j[first], d[first]
                        same = d == d2[i]
                        ties[i[same]] += count[same]
                        better = (d < d2[i]) | (same & (self.name[j] < self.name[best[i]]))
                        nearer = d < d2[i]
                        ties[i[nearer]] = count[nearer]
                        best[i[better]], d2[i[better]] = j[better], d[better]
            open_ = open_[~(d2[open_] < (ring * grid.cell) ** 2)]
            ring += 1
