"""From an ensemble of catalogs to one catalog: friends, seeds, claims."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from starloom.operators import blocks, components
from starloom.operators.matching import sample_counts
from starloom.operators.ordering import position_in_group
from starloom.session import cut_lineage

# Slots of a sample and samples of a field both stay below this, so
# sample * SLOTS + slot is a BIGINT that numbers the stacked detections of a
# field in sample order, brightest first, each with a number of its own.
SLOTS = 1 << 31
FEW_PAIRS = 64  # partners of a detection that may be listed, besides four from each sample
SOLVED = 1 << 18  # edges of small components solved at a time
LARGE = 1 << 22  # edges of a component that one task may hold (16 bytes each)
LOOKED_AT = 1 << 20  # pairs of a block that may be listed at once (some 100 bytes each)
CHUNK = 4096  # detections whose partners are looked up at a time
# (degree, id) as one number that sorts the same way, for any BIGINT id. A
# running maximum of a number stays in a hash table; one of a struct would sort.
OWN = "cast(deg as decimal(18,0)) * cast(18446744073709551616 as decimal(20,0)) + cast(i as decimal(19,0))"


def stacked(det: DataFrame) -> DataFrame:
    fits = F.col("src").between(0, SLOTS - 1) & F.col("sample_id").between(0, SLOTS - 1)
    number = F.col("sample_id").cast("bigint") * SLOTS + F.col("src")
    return det.withColumn("id", F.when(fits, number).otherwise(F.raise_error(F.lit("slot or sample out of range")).cast("bigint")))


def friend_graph(det: DataFrame, radius: float, cross_sample_only: bool = False) -> DataFrame:
    """Edges (field, i < j, d2) between stacked detections of different flux."""
    seen = blocks.deal(det.select("field_id", "sample_id", "id", "x", "y", "f0"), radius, 1.0)

    def edges(t: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        own, name = t["_own"], t["id"]
        # Where few pairs are looked at, each is once; both ends see the other at the same distance.
        if t["_shares"][0] == 1 and (found := blocks.close_pairs(t["x"], t["y"], radius, LOOKED_AT)) is not None:
            i, j, d2 = found
            turned = name[i] > name[j]
            i, j = np.where(turned, j, i), np.where(turned, i, j)
            good = own[i] & (name[i] != name[j]) & (t["f0"][i] != t["f0"][j])
            if cross_sample_only:
                good &= t["sample_id"][i] != t["sample_id"][j]
            yield name[i[good]], name[j[good]], d2[good]
            return
        for i, j, d2 in blocks.pairs_within(t["x"], t["y"], np.flatnonzero(t["_own"]), radius):
            good = (t["id"][i] < t["id"][j]) & (t["f0"][i] != t["f0"][j])
            if cross_sample_only:
                good &= t["sample_id"][i] != t["sample_id"][j]
            yield t["id"][i[good]], t["id"][j[good]], d2[good]

    return _by_block(seen, edges, lambda f, i, j, d2: [f, i, j, d2], "field_id bigint, i bigint, j bigint, d2 double")


def pruned_edges(det: DataFrame, radius: float) -> DataFrame:
    """Edges (field, i < j, d2) left when every detection keeps, in each other sample, only
    its nearest partner, and both ends agree; partners in its own sample all stay.

    A block's task looks up the nearest partner per (detection, other sample) through a
    grid, so what it holds follows detections x samples and not the pairs of a crowded
    field. The partner's own choice is looked up in the same block, which sees far enough.
    """
    seen = _seen_for_pruning(det, radius)
    return _by_block(seen, lambda t: _pruned(t, radius), lambda f, i, j, d2: [f, i, j, d2], "field_id bigint, i bigint, j bigint, d2 double")


def _seen_for_pruning(det: DataFrame, radius: float, written: bool = False) -> DataFrame:
    return blocks.deal(det.select("field_id", "sample_id", "id", "x", "y", "f0"), radius, 2.0, written=written)


Triple = tuple[np.ndarray, np.ndarray, np.ndarray]


def _pruned(t: dict[str, np.ndarray], radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pruned edges whose lesser end is searched for by this task."""
    own = np.flatnonzero(t["_own"])
    if not len(own):
        return
    samples, t["sample"] = np.unique(t["sample_id"], return_inverse=True)
    if t["_shares"][0] == 1 and len(own) * len(samples) <= LOOKED_AT:
        found = blocks.close_pairs(t["x"], t["y"], radius, LOOKED_AT)
        if found is not None and len(t["x"]) * len(samples) <= 2 * LOOKED_AT:
            yield _pruned_of_pairs(t, len(samples), radius, *found)
            return
    grid = blocks.Grid(t["x"], t["y"], radius * blocks.PAD)
    crowd = grid.crowd()  # points in the cells around each point
    by_list = crowd.mean() <= 4 * len(samples) + FEW_PAIRS
    choose = _choices_from_pairs(t, grid, radius) if by_list else _choices_from_samples(t, len(samples), radius)
    own = own[np.argsort(grid.number(*grid.place(t["x"][own], t["y"][own])), kind="stable")]
    chunk = max(1, int(blocks.PAIRS / crowd.mean())) if by_list else CHUNK
    x, y, flux, name, sample = t["x"], t["y"], t["f0"], t["id"], t["sample"]
    for at in range(0, len(own), chunk):
        some = own[at : at + chunk]
        (i, j, d2), (si, sj, s2) = choose(some, None)
        good = (name[si] < name[sj]) & (flux[si] != flux[sj])
        yield name[si[good]], name[sj[good]], s2[good]
        good = (name[i] < name[j]) & (flux[i] != flux[j])
        i, j, d2 = i[good], j[good], d2[good]
        # What the partners choose in turn, in the samples they were asked from.
        of = np.unique(j)
        (back, choice, _), _ = choose(of, sample[i])
        key = np.sort(back * np.int64(len(x)) + choice)
        asked = j * np.int64(len(x)) + i
        place = np.searchsorted(key, asked)
        agreed = key[np.minimum(place, len(key) - 1)] == asked if len(key) else np.zeros(len(asked), dtype=bool)
        yield name[i[agreed]], name[j[agreed]], d2[agreed]


def _pruned_of_pairs(t: dict[str, np.ndarray], n_samples: int, radius: float, i: np.ndarray, j: np.ndarray, d2: np.ndarray) -> Triple:
    """The same from the list of all pairs of a block: least distances per (detection, other
    sample) are kept in one table, and what both ends choose is read off the same pair."""
    name, sample = t["id"], t["sample"]
    turned = name[i] > name[j]
    i, j = np.where(turned, j, i), np.where(turned, i, j)
    inside = sample[i] == sample[j]
    same = np.flatnonzero(inside & (name[i] != name[j]))
    cross = np.flatnonzero(~inside)
    a, b, d = i[cross], j[cross], d2[cross]
    slots = (a * np.int64(n_samples) + sample[b], b * np.int64(n_samples) + sample[a])
    size = len(name) * n_samples
    n = sum(np.bincount(s, minlength=size) for s in slots)
    least = np.full(size, np.inf)
    for s in slots:
        np.minimum.at(least, s, d)
    chosen = np.full(size, np.iinfo(np.int64).max)  # of the nearest, the least name
    for s, other in zip(slots, (b, a)):
        at = np.flatnonzero(d == least[s])
        np.minimum.at(chosen, s[at], name[other[at]])
    agreed = np.ones(len(cross), dtype=bool)
    for s, other in zip(slots, (b, a)):
        # One match stays; of several, the nearest does if it lies inside the radius.
        agreed &= (d == least[s]) & (name[other] == chosen[s]) & ((n[s] == 1) | (d < radius * radius))
    kept = np.append(same, cross[agreed])
    kept = kept[t["_own"][i[kept]] & (t["f0"][i[kept]] != t["f0"][j[kept]])]
    return name[i[kept]], name[j[kept]], d2[kept]


def _choices_from_pairs(t: dict[str, np.ndarray], grid: blocks.Grid, radius: float) -> Callable[..., tuple[Triple, Triple]]:
    """Of given points: (i, j, d2) to the nearest in each other sample, where it is kept, and to
    all in the own one. From the pairs of those points; for fields where these are few."""
    x, y, sample, name = t["x"], t["y"], t["sample"], t["id"]

    def choose(of: np.ndarray, _: np.ndarray | None) -> tuple[Triple, Triple]:
        i, j, d2 = (np.concatenate(c) for c in zip(*blocks.pairs_within(x, y, of, radius, grid)))
        same = sample[i] == sample[j]
        inside = i[same], j[same], d2[same]
        i, j, d2 = i[~same], j[~same], d2[~same]
        key = i * np.int64(len(x)) + sample[j]
        order = np.lexsort((name[j], d2, key))
        key, i, j, d2 = key[order], i[order], j[order], d2[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(i) else np.zeros(0, int)
        n = np.diff(np.append(first, len(i)))
        # One match stays; of several, the nearest does if it lies inside the radius.
        kept = first[(n == 1) | (d2[first] < radius * radius)]
        return (i[kept], j[kept], d2[kept]), inside

    return choose


def _choices_from_samples(t: dict[str, np.ndarray], n_samples: int, radius: float) -> Callable[..., tuple[Triple, Triple]]:
    """The same, looked up sample by sample: what is read follows points x samples, however crowded the field is."""
    x, y, sample, name = t["x"], t["y"], t["sample"], t["id"]
    order = np.argsort(sample, kind="stable")
    parts = np.split(order, np.cumsum(np.bincount(sample, minlength=n_samples))[:-1])
    near = [blocks.Nearest(x[p], y[p], name[p], radius) for p in parts]

    def choose(of: np.ndarray, only: np.ndarray | None) -> tuple[Triple, Triple]:
        found, inside = [], []
        for s in np.unique(only) if only is not None else range(n_samples):
            asked = of[sample[of] != s]
            j, d2, ties = near[s].of(x[asked], y[asked])
            kept = (j >= 0) & ((d2 < radius * radius) | (ties == 1))
            found.append((asked[kept], parts[s][j[kept]], d2[kept]))
            if only is None:
                mine = np.searchsorted(parts[s], of[sample[of] == s])
                inside += [(parts[s][i], parts[s][j], d2) for i, j, d2 in blocks.pairs_within(x[parts[s]], y[parts[s]], mine, radius)]
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        joined = lambda rows: tuple(np.concatenate(c) for c in zip(*rows)) if rows else none
        return joined(found), joined(inside)

    return choose


def _by_block(seen: DataFrame, work: Callable, row: Callable, schema: str) -> DataFrame:
    """row(field, *arrays) as columns of `schema`, for what work makes of the arrays of a block."""
    keys = ["field_id", "_bx", "_by", "_share"]
    types = to_arrow_schema(_parse_datatype_string(schema))

    def run(table: pa.Table) -> pa.Table:
        t = {c: table.column(c).to_numpy() for c in table.column_names}
        found = [row(np.full(len(part[0]), t["field_id"][0]), *part) for part in work(t)]
        return pa.table([np.concatenate(c) for c in zip(*found)], schema=types) if found else types.empty_table()

    return seen.groupBy(*keys).applyInArrow(run, schema)


def _seeds_by_rounds(edges: DataFrame) -> DataFrame:
    """Every node of some edges with the degree at which it is picked, null if it left as a neighbour.

    Degrees only fall, so a node that is highest within two hops will be picked
    before anything near it changes. All such nodes are picked at once, per
    round. Each round works on the written edges of the last one. The node side
    of its joins has one row per node, so its hash tables are even and the edges
    need no sorting.
    """
    # Both directions of each edge, from one pass over the edges.
    ends = F.array(F.struct(F.col("i"), F.col("j")), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    both = edges.select("field_id", F.inline(ends))
    alive = cut_lineage(both)
    gone: list[DataFrame] = []
    node = ["field_id", "i"]
    while not alive.isEmpty():
        degree = alive.groupBy(*node).agg(F.count(F.lit(1)).alias("deg"))
        own = degree.select(*node, "deg", F.expr(OWN).alias("own"))

        def spread(keys: DataFrame, column: str) -> DataFrame:
            heard = alive.join(keys.hint("shuffle_hash"), node).groupBy("field_id", F.col("j").alias("i")).agg(F.max(column).alias("heard"))
            return keys.join(heard, node).withColumn(column, F.greatest(column, "heard")).drop("heard")

        reach = spread(spread(own.withColumn("top", F.col("own")), "top"), "top")
        seeds = reach.where(F.col("own") == F.col("top")).select(*node, F.col("deg").alias("degree"))
        # A seed tells its neighbours, so they arrive together with it.
        told = F.array_union(F.array(F.col("i")), F.array(F.col("j")))
        leaving = cut_lineage(
            alive.join(seeds.hint("shuffle_hash"), node)
            .select("field_id", "degree", F.col("i").alias("seed"), F.explode(told).alias("i"))
            .groupBy(*node)
            .agg(F.max(F.when(F.col("i") == F.col("seed"), F.col("degree"))).alias("degree"))
        )
        gone.append(leaving)
        left = leaving.select(*node).hint("shuffle_hash")
        alive = cut_lineage(
            alive.join(left, node, "left_anti").join(left.withColumnRenamed("i", "j"), ["field_id", "j"], "left_anti").select(*node, "j")
        )
    out = reduce(DataFrame.unionByName, gone).select("field_id", "i", "degree")
    # Left by all rounds: no friends any more, so a seed of degree zero.
    every = both.select(*node).distinct()
    return every.join(out.withColumn("_left", F.lit(True)), node, "left").select(
        *node, F.when(F.col("_left"), F.col("degree")).otherwise(F.lit(0)).cast("bigint").alias("degree")
    )


PARTS = "field_id bigint, part bigint, i array<bigint>, j array<bigint>, shared array<bigint>"


def _packed(field: int, i: np.ndarray, j: np.ndarray, inner: np.ndarray) -> pa.Table:
    """Edges by local component: a row each, with the least node as its name and the nodes that
    other tasks may know too (all but `inner`)."""
    ints = pa.list_(pa.int64())
    types = pa.schema([("field_id", pa.int64()), ("part", pa.int64()), ("i", ints), ("j", ints), ("shared", ints)])
    if not len(i):
        return types.empty_table()
    names, a, b = components.numbers_of([i, j])
    label = components.labels_of(len(names), a, b)
    order = np.argsort(label[a], kind="stable")
    part, first = np.unique(label[a][order], return_index=True)
    ends = np.append(first, len(order)).astype(np.int32)
    known = np.flatnonzero(~np.isin(names, inner))
    known = known[np.argsort(label[known], kind="stable")]
    at = np.searchsorted(label[known], np.append(part, len(names))).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(c[order])) for c in (i, j)]
    lists.append(pa.ListArray.from_arrays(pa.array(at), pa.array(names[known])))
    return pa.table([pa.array(np.full(len(part), field)), pa.array(names[part]), *lists], schema=types)


def _parts_of(edges: DataFrame) -> DataFrame:
    """Any edges as packed local components, contracted in the tasks they lie in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            field, i, j = (batch.column(c).to_numpy() for c in ("field_id", "i", "j"))
            for f in np.unique(field):
                here = field == f
                yield from _packed(f, i[here], j[here], i[:0]).to_batches()

    return edges.select("field_id", "i", "j").mapInArrow(run, PARTS)


def _parts_of_blocks(det: DataFrame, radius: float) -> DataFrame:
    """Pruned edges of a field's blocks as packed local components; det is a written table."""

    def work(t: dict[str, np.ndarray]) -> pa.Table:
        low = [t[b][0] * blocks.WIDTH * radius for b in ("_bx", "_by")]
        inside = t["_own"] & (t["_shares"] == 1)
        for c, lo in zip(("x", "y"), low):
            inside &= (t[c] - lo > 2 * radius) & (lo + blocks.WIDTH * radius - t[c] > 2 * radius)
        found = list(_pruned(t, radius)) or [(t["id"][:0], t["id"][:0], t["x"][:0])]
        i, j, _ = (np.concatenate(c) for c in zip(*found))
        return _packed(t["field_id"][0], i, j, t["id"][inside])

    return _seen_for_pruning(det, radius, written=True).groupBy("field_id", "_bx", "_by", "_share").applyInArrow(lambda table: work({c: table.column(c).to_numpy() for c in table.column_names}), PARTS)


def sequential_seeds(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of some edges and their degree when picked, -1 if they left as a neighbour.

    Again and again the node of the highest (degree, id) is picked and leaves together
    with its neighbours. Degrees only fall, so a node whose entry is out of date goes
    back into the heap with its present one.
    """
    names, a, b = components.numbers_of([i, j])
    ends = np.append(a, b)
    order = np.argsort(ends, kind="stable")
    other = np.append(b, a)[order]
    start = np.searchsorted(ends[order], np.arange(len(names) + 1))
    degree = np.diff(start)
    alive, out = np.ones(len(names), dtype=bool), np.full(len(names), -1, dtype=np.int64)
    heap = list(zip((-degree).tolist(), range(0, -len(names), -1)))
    heapq.heapify(heap)
    while heap:
        d, n = heapq.heappop(heap)
        d, n = -d, -n
        if not alive[n]:
            continue
        if degree[n] != d:
            heapq.heappush(heap, (-int(degree[n]), -n))
            continue
        out[n], alive[n] = d, False
        gone = other[start[n] : start[n + 1]]
        gone = gone[alive[gone]]
        alive[gone] = False
        for g in gone.tolist():
            near = other[start[g] : start[g + 1]]
            degree[near] -= 1  # each neighbour is there once
    return names, out


def _solved(parts: DataFrame) -> DataFrame:
    """Nodes of whole components (field_id, root, i, j) with the degree at which they are picked, null if never.

    Components go through a task one after the other, some thousand edges at a time:
    they don't touch, so several are one graph without harm.
    """
    rows = parts.repartition("field_id", "root").sortWithinPartitions("field_id", "root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        key, size = None, 0

        def done() -> pa.RecordBatch:
            i, j = (np.concatenate(c) for c in zip(*held))
            node, degree = sequential_seeds(i, j)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(node), key[0])), pa.array(node), pa.array(degree, mask=degree < 0)], names=["field_id", "i", "degree"])

        for batch in batches:
            field, root, i, j = (batch.column(c) for c in ("field_id", "root", "i", "j"))
            for row, now in enumerate(zip(field.to_pylist(), root.to_pylist())):
                if held and now != key and (size >= SOLVED or now[0] != key[0]):
                    yield done()
                    held, size = [], 0
                key = now
                held.append((i[row].values.to_numpy(), j[row].values.to_numpy()))
                size += len(held[-1][0])
        if held:
            yield done()

    return rows.select("field_id", "root", "i", "j").mapInArrow(run, "field_id bigint, i bigint, degree bigint")


def _seeds_of_parts(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    node = ["field_id", "i"]
    parts = cut_lineage(parts)
    moved = components.part_roots(parts.select("field_id", "part", F.explode("shared").alias("node")), ["field_id"])
    whole = parts.join(moved, ["field_id", "part"], "left").select("field_id", F.coalesce("root", "part").alias("root"), "i", "j")
    large = whole.groupBy("field_id", "root").agg(F.sum(F.size("i")).alias("_n")).where(F.col("_n") > LARGE).select("field_id", "root")
    large = cut_lineage(large)
    if large.isEmpty():
        left = _solved(whole)
    else:
        edges = whole.join(large, ["field_id", "root"]).select("field_id", F.inline(F.arrays_zip("i", "j")))
        left = _solved(whole.join(large, ["field_id", "root"], "left_anti")).unionByName(_seeds_by_rounds(edges))
    base = nodes.select("field_id", F.col("id").alias("i"), "x", "y").join(left.withColumn("_left", F.lit(True)), node, "left")
    # Without friends from the start: a seed of degree zero.
    kept = base.where(F.col("_left").isNull() | F.col("degree").isNotNull())
    return kept.select("field_id", F.col("i").alias("id"), "x", "y", F.coalesce("degree", F.lit(0).cast("bigint")).alias("degree"))


def greedy_seeds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Seeds as the sequential rule picks them: again and again the node of the
    highest (degree, id), which then leaves together with its neighbours.

    Connected components don't know of each other, so each is solved by the sequential
    rule itself, many to a task; only one of more than LARGE edges goes through rounds.
    The recorded degrees are those of the sequential rule, and so is the order
    (degree desc, id desc). Edges come once, either way round.
    """
    return _seeds_of_parts(nodes, _parts_of(edges))


def seed_catalog(det: DataFrame, radius: float) -> DataFrame:
    """Friends, pruning and seeds of an ensemble with slots."""
    nodes = cut_lineage(stacked(det).select("field_id", "sample_id", "id", "x", "y", "f0"))
    return _seeds_of_parts(nodes, _parts_of_blocks(nodes, radius))


def prevalence_cut(seeds: DataFrame, cut: float, nsamp: int) -> DataFrame:
    """Seeds seen in more than the share `cut` of samples."""
    return seeds.where(F.col("degree") > cut * nsamp)


def claim(
    seeds: DataFrame, ens: DataFrame, radius: float, seed: str, cell: Column, priority: Sequence[Column]
) -> DataFrame:
    """Which detection each seed takes in each sample: seeds choose in the
    order of `priority`, each the brightest (lowest slot) unclaimed detection
    within the radius. `cell` follows that order and spreads its numbering.

    Seeds and detections of a sample that no pair joins don't know of each other,
    so each component is settled by the sequential rule itself, however long its
    chain of priorities: at once in the block that holds it whole, and else when the
    blocks' parts are joined. Only one of more than LARGE pairs goes through rounds.
    """
    turns = cut_lineage(
        position_in_group(seeds.select("field_id", seed, "x", "y", *_used(seeds, seed)), ["field_id"], cell, priority, "turn")
        .select("field_id", seed, "turn", "x", "y")
    )
    base = ["field_id", "sample_id"]
    points = ens.select(*base, F.col("src").alias("n"), "x", "y").where("sample_id >= 0")
    points = points.unionByName(turns.select("field_id", F.lit(-1).cast("bigint").alias("sample_id"), F.col("turn").alias("n"), "x", "y"))
    found = cut_lineage(
        blocks.deal(points, radius, 1.0).groupBy("field_id", "_bx", "_by", "_share")
        .applyInArrow(lambda table: _claims_of_block({c: table.column(c).to_numpy() for c in table.column_names}, radius), CLAIMS)
    )
    open_ = found.where("part is not null")
    moved = components.part_roots(open_.select(*base, F.col("turn").alias("node"), "part"), base)
    whole = open_.join(moved, [*base, "part"], "left").select(*base, F.coalesce("root", "part").alias("root"), "turn", "src")
    large = cut_lineage(whole.groupBy(*base, "root").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > LARGE).select(*base, "root"))
    taken = found.where("part is null").select(*base, "turn", "src")
    if large.isEmpty():
        taken = taken.unionByName(_claims_of_components(whole))
    else:
        taken = taken.unionByName(_claims_of_components(whole.join(large, [*base, "root"], "left_anti")))
        taken = taken.unionByName(_claims_by_rounds(whole.join(large, [*base, "root"]).drop("root")))
    return taken.join(turns.select("field_id", "turn", seed), ["field_id", "turn"]).select(*base, seed, "src")


CLAIMS = "field_id bigint, sample_id bigint, turn bigint, src bigint, part bigint"


def _claims_of_block(t: dict[str, np.ndarray], radius: float) -> pa.Table:
    """Claims of the components that a block holds whole (part null); all pairs of the others."""
    seeds = np.flatnonzero(t["sample_id"] < 0)
    dets = np.flatnonzero((t["sample_id"] >= 0) & t["_own"])
    schema = pa.schema([(c, pa.int64()) for c in ("field_id", "sample_id", "turn", "src", "part")])
    pairs = list(blocks.between(t["x"][dets], t["y"][dets], t["x"][seeds], t["y"][seeds], radius))
    if not pairs:
        return schema.empty_table()
    q, j = (np.concatenate(c) for c in zip(*pairs))
    sample, turn, src = t["sample_id"][dets[j]], t["n"][seeds[q]], t["n"][dets[j]]
    order = np.lexsort((src, turn, sample))
    q, j, sample, turn, src = q[order], j[order], sample[order], turn[order], src[order]
    # A seed is another node in each sample; a detection stands for itself.
    node = np.unique(np.stack([sample, turn], axis=1), axis=0, return_inverse=True)[1].ravel()
    n = int(node.max()) + 1 if len(node) else 0
    label = components.labels_of(n + len(dets), node, j + n)[node]
    # A seed whose reach leaves the block may have pairs elsewhere.
    beyond = np.zeros(len(seeds), dtype=bool) if t["_shares"][0] == 1 else np.ones(len(seeds), dtype=bool)
    for c, b in (("x", "_bx"), ("y", "_by")):
        low, reach = t[b][0] * blocks.WIDTH * radius, radius * blocks.PAD
        beyond |= (t[c][seeds] - low <= reach) | (low + blocks.WIDTH * radius - t[c][seeds] <= reach)
    is_open = np.isin(label, np.unique(label[beyond[q]]))
    out = np.flatnonzero(is_open)
    won = np.flatnonzero(~is_open)
    won = won[_picked(sample[won], turn[won], src[won])]
    rows = np.append(won, out)
    least = np.full(n + len(dets), np.iinfo(np.int64).max)
    np.minimum.at(least, label, turn)
    field = np.full(len(rows), t["field_id"][0])
    part = pa.array(least[label[rows]], mask=np.arange(len(rows)) < len(won))
    return pa.table([pa.array(field), pa.array(sample[rows]), pa.array(turn[rows]), pa.array(src[rows]), part], schema=schema)


def _picked(group: np.ndarray, turn: np.ndarray, src: np.ndarray) -> list[int]:
    """Pairs that win, of pairs sorted by (group, turn, src): each turn takes its first source still free."""
    won, taken, last, done = [], set(), None, None
    for k, (g, n, s) in enumerate(zip(group.tolist(), turn.tolist(), src.tolist())):
        if g != last:
            last, taken, done = g, set(), None
        if n != done and s not in taken:
            taken.add(s)
            done = n
            won.append(k)
    return won


def _claims_of_components(pairs: DataFrame) -> DataFrame:
    """Claims of pairs by whole component (root), one component after the other."""
    base = ["field_id", "sample_id"]
    rows = pairs.repartition(*base, "root").sortWithinPartitions(*base, "root", "turn", "src")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, taken, done = None, set(), None
        for batch in batches:
            won = []
            for k, (*key, turn, src) in enumerate(zip(*(batch.column(c).to_pylist() for c in (*base, "root", "turn", "src")))):
                if key != last:
                    last, taken, done = key, set(), None
                if turn != done and src not in taken:
                    taken.add(src)
                    done = turn
                    won.append(k)
            yield batch.select([*base, "turn", "src"]).take(pa.array(won, pa.int64()))

    return rows.mapInArrow(run, "field_id bigint, sample_id bigint, turn bigint, src bigint")


def _claims_by_rounds(pairs: DataFrame) -> DataFrame:
    """Whenever a detection is a seed's first choice and that seed comes first
    among all seeds near the detection, the sequential order gives the same
    pair; such pairs are settled together, per round, and leave. Both first
    choices are running minima, so no sample is gathered in one place."""
    base = ["field_id", "sample_id"]
    open_ = cut_lineage(pairs)
    settled: list[DataFrame] = []
    while not open_.isEmpty():
        wish = open_.groupBy(*base, "turn").agg(F.min("src").alias("src"))
        first = open_.groupBy(*base, "src").agg(F.min("turn").alias("turn"))
        pairs = cut_lineage(wish.join(first, [*base, "turn", "src"]).select(*base, "turn", "src"))
        settled.append(pairs)
        open_ = cut_lineage(
            open_.join(pairs.select(*base, "turn"), [*base, "turn"], "left_anti")
            .join(pairs.select(*base, "src"), [*base, "src"], "left_anti")
            .select(*base, "turn", "src")
        )
    return reduce(lambda a, b: a.unionByName(b), settled or [open_])


def _used(seeds: DataFrame, seed: str) -> list[str]:
    return [c for c in seeds.columns if c not in ("field_id", seed, "x", "y")]


def condense(
    claims: DataFrame, ens: DataFrame, seed: str, bands: Sequence[str] = ("f0",), err: str = "half", samples: DataFrame | None = None
) -> DataFrame:
    """One row per seed: position, prevalence and band fluxes with errors from
    the 16th and 84th percentiles (half their distance, or all of it). A seed
    claimed once has errors 0; missing percentiles are NULL. A group holds at
    most one value per sample."""
    scale = 0.5 if err == "half" else 1.0
    values = claims.join(
        ens.select("field_id", "sample_id", "src", "x", "y", *bands), ["field_id", "sample_id", "src"]
    )
    stats = _group_stats(values, ["field_id", seed], ["x", "y", *bands], (0.16, 0.84))
    many = F.col("n") > 1
    lo, hi = (lambda c: F.col(f"_p0_{c}")), (lambda c: F.col(f"_p1_{c}"))

    def width(c):
        return F.when(many, (hi(c) - lo(c)) * scale).otherwise(0.0).alias(f"err_{c}")

    cols = ["mean_x", width("x"), "mean_y", width("y"), (F.col("n") / F.col("nsamp")).alias("confidence")]
    for b in bands:
        cols += [f"mean_{b}", width(b), F.when(many, hi(b)).alias(f"hipct_{b}"), F.when(many, lo(b)).alias(f"lopct_{b}")]
    return stats.join(sample_counts(ens, samples=samples), ["field_id"]).select("field_id", seed, *cols)


def _group_stats(values: DataFrame, keys: list[str], columns: list[str], ends: Sequence[float]) -> DataFrame:
    """(*keys, n, mean_<c>, _p0_<c>, _p1_<c> ...) of each group: rows, and the means and interpolated
    percentiles of the columns' values that are not null.

    Groups are short and many: rows move once, sorted by group, and a task sorts the values of
    thousands of groups at a time. Only a group that a batch cuts off is held until the next.
    """
    rows = values.select(*keys, *(F.col(c).cast("double").alias(c) for c in columns))
    made = [f"{kind}_{c}" for c in columns for kind in ("mean", *(f"_p{k}" for k in range(len(ends))))]
    types = [*(rows.schema[k] for k in keys), *_parse_datatype_string(", ".join(["n bigint", *(f"`{m}` double" for m in made)])).fields]
    schema = StructType(types)

    def starts_of(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows - 1, dtype=bool)
        for k in keys:
            c = t.column(k).combine_chunks()
            null = c.is_null().to_numpy(zero_copy_only=False)
            same = pc.fill_null(pc.equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
            new |= ~(same | (null[1:] & null[:-1]))
        return np.flatnonzero(np.append(True, new))

    def stats(t: pa.Table, first: np.ndarray) -> pa.RecordBatch:
        size = np.diff(np.append(first, t.num_rows))
        group = np.repeat(np.arange(len(first)), size)
        out = [*(t.column(k).combine_chunks().take(pa.array(first)) for k in keys), pa.array(size)]
        for c in columns:
            column = t.column(c).combine_chunks()
            none = column.is_null().to_numpy(zero_copy_only=False)
            v = column.fill_null(0.0).to_numpy()
            n = size - np.add.reduceat(none.astype(np.int64), first)
            empty = n == 0
            out.append(pa.array(np.add.reduceat(v, first) / np.maximum(n, 1), mask=empty))
            v = v[np.lexsort((v, none, group))]
            for p in ends:
                place = (np.maximum(n, 1) - 1) * p
                lower, upper = np.floor(place), np.ceil(place)
                low, high = v[first + lower.astype(np.int64)], v[first + upper.astype(np.int64)]
                out.append(pa.array(np.where(low == high, low, np.where(lower == upper, low, (upper - place) * low + (place - lower) * high)), mask=empty))
        return pa.RecordBatch.from_arrays(out, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            if not t.num_rows:
                continue
            first = starts_of(t)
            held = t.slice(first[-1])
            if len(first) > 1:
                yield stats(t.slice(0, first[-1]), first[:-1])
        if held is not None and held.num_rows:
            yield stats(held, np.zeros(1, dtype=np.int64))

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
