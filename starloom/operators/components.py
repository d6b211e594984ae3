"""Connected components: contracted inside tasks first, then joined across them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from starloom.session import cut_lineage

# Links between parts that one task joins by itself (16 bytes each); more go through rounds.
ONE_TASK = 1 << 20


def labels_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least node number of each node's component, for edges between numbers below n."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return label
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:  # every node follows its label to the end
            further = label[label]
            if (further == label).all():
                break
            label = further


def star_round(links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One alternation of the star operations on links (*keys, a, b): every node's larger
    neighbours, then its smaller ones, are hung on its least neighbour."""

    def both(df: DataFrame) -> DataFrame:
        return df.unionByName(df.select(*keys, F.col("a").alias("b"), F.col("b").alias("a")))

    def hung(df: DataFrame, larger: bool) -> DataFrame:
        """df (a, b) lists neighbours b of a; which are hung on the least of them and a itself."""
        least = df.groupBy(*keys, "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = df.join(least, [*keys, "a"])
        if larger:
            out = out.where("b > a").select(*keys, F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            moved = out.select(*keys, F.col("b").alias("a"), F.col("m").alias("b"))
            out = moved.unionByName(least.select(*keys, "a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    # Small stars read each link at its larger end.
    return hung(hung(both(links), True), False)


def star_roots(links: DataFrame, keys: Sequence[str], rounds: list[int] | None = None) -> DataFrame:
    """(*keys, a, root) of the nodes of links (*keys, a, b), by rounds whose number is
    logarithmic in the nodes. Appends the number of links after each round to `rounds`."""
    now = cut_lineage(links.where("a <> b").select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        # Links are the same from round to round when their number and checksum are.
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*keys, "a", "b").cast("decimal(20,0)"))).first()
        if mark == before:
            break
        if rounds is not None and before is not None:
            rounds.append(mark[0])
        before = mark
        now = cut_lineage(star_round(now, keys))
    return now.select(*keys, "a", F.col("b").alias("root"))


def roots(links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(*keys, a, root): the least node of each component, for nodes that are not it."""
    links = cut_lineage(links.where("a <> b"))
    if links.count() > ONE_TASK:
        return star_roots(links, keys)
    kinds = [links.schema[c].dataType.simpleString() for c in (*keys, "a")]
    schema = ", ".join(f"{c} {t}" for c, t in zip((*keys, "a", "root"), (*kinds, kinds[-1])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None  # at most ONE_TASK rows
        if table is None or not table.num_rows:
            return
        group = [table.column(c).combine_chunks() for c in keys]
        key = np.zeros(table.num_rows, dtype=np.int64)
        for column in group:
            code = column.dictionary_encode(null_encoding="encode")
            key = np.unique(key * (len(code.dictionary) + 1) + code.indices.to_numpy(), return_inverse=True)[1]
        a, b = table.column("a").to_numpy(), table.column("b").to_numpy()
        # Nodes numbered by (key, name), so the least number is the least name of its key.
        names, at = np.unique(np.stack([np.tile(key, 2), np.append(a, b)], axis=1), axis=0, return_inverse=True)
        ia, ib = np.split(at.ravel(), 2)
        label = labels_of(len(names), ia, ib)
        some = np.empty(len(names), dtype=np.int64)
        some[at.ravel()] = np.tile(np.arange(len(a)), 2)
        moved = np.flatnonzero(label != np.arange(len(names)))
        columns = [c.take(pa.array(some[moved])) for c in group] + [pa.array(names[moved, 1]), pa.array(names[label[moved], 1])]
        yield pa.RecordBatch.from_arrays(columns, names=[*keys, "a", "root"])

    return links.select(*keys, "a", "b").coalesce(1).mapInArrow(run, schema)


def part_roots(shared: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(*keys, part, root) of parts that share nodes, where the root is another part.

    shared: (*keys, node, part); parts are numbers. A part whose root it is itself has no row.
    """
    least = shared.groupBy(*keys, "node").agg(F.min("part").alias("lo"), F.collect_set("part").alias("parts")).where(F.size("parts") > 1)
    links = least.select(*keys, F.col("lo").alias("b"), F.explode("parts").alias("a")).where("a <> b").distinct()
    return roots(links, keys).withColumnRenamed("a", "part")


def numbers_of(names: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Numbers from 0 for names that occur in several arrays, in order of names, and the names."""
    every, at = np.unique(np.concatenate(names), return_inverse=True)
    return [every, *np.split(at, np.cumsum([len(n) for n in names])[:-1])]


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
