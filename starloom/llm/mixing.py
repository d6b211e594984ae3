"""Mixing sources to target weights in a tree of domains, languages and sources.

Budgets go down the tree. Siblings share their parent's budget by weight; a node
gets no more than it can supply in the allowed number of epochs, and what it cannot
take goes to its siblings, again by weight. A parent's own supply is that of its
children, so only what all siblings together cannot take falls to the ancestors'
siblings. Each level is one row per node and one window per parent, without rounds: in
the order of supply per unit of weight, the saturated ones come first.

A leaf's documents are ordered anew in each epoch by a seeded hash. Whole epochs take
every document, the last one takes the prefix of documents before which less than
the budget has been taken. Cumulated tokens come from sums over 4096 ranges of the
hash; only documents in the one range that holds the border are ordered themselves,
so a leaf with a third of all rows is not sorted in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from starloom.session import cut_lineage

NONE = "(none)"    # name of a null in the tree
RANGE_BITS = 12    # ranges of the hash: 2^12


def weight_of(weights: Mapping[tuple[str, ...], float], default: Sequence[float], level: int) -> Column:
    """Weight of a node of this level by its path _p0.._p<level>; paths that are not listed have the level's default."""
    out = F.lit(float(default[level]))
    for path, weight in weights.items():
        if len(path) == level + 1:
            cond = F.lit(True)
            for k, name in enumerate(path):
                if name != "*":
                    cond = cond & (F.col(f"_p{k}") == name)
            out = F.when(cond, F.lit(float(weight))).otherwise(out)
    return out


def shared(nodes: DataFrame, siblings: Sequence[Column | str], path: Sequence[str]) -> DataFrame:
    """nodes (_s supply, _w weight, _b budget of the parent) with _b their own budgets.

    In the order of supply per unit of weight the saturated ones come first; the others
    share the rest by weight.
    """
    live = F.col("_s") > 0
    nodes = nodes.withColumn("_w", F.when(live, F.col("_w")).otherwise(0.0)).withColumn("_r", F.when(live, F.col("_s") / F.col("_w")).otherwise(0.0))
    every = W.partitionBy(*siblings)
    upto = every.orderBy("_r", *path).rowsBetween(W.unboundedPreceding, W.currentRow)
    nodes = nodes.withColumn("_before", F.sum("_s").over(upto) - F.col("_s"))
    nodes = nodes.withColumn("_heavy", F.sum("_w").over(every) - F.sum("_w").over(upto) + F.col("_w"))
    # With all nodes before saturated, this one and those after share the rest by weight.
    mark = F.when((F.col("_heavy") > 0) & live, (F.col("_b") - F.col("_before")) / F.col("_heavy"))
    # The rest per weight at the first node that is not saturated; it only falls after that.
    nodes = nodes.withColumn("_mark", mark).withColumn("_water", F.max(F.when(F.col("_mark") < F.col("_r"), F.col("_mark"))).over(every))
    share = F.when(F.col("_water").isNull() | (F.col("_r") <= F.col("_water")), F.col("_s")).otherwise(F.col("_water") * F.col("_w"))
    return nodes.withColumn("_b", F.when(live, F.greatest(share, F.lit(0.0))).otherwise(0.0))


def budgets(leaves: DataFrame, depth: int, total: float | None, weights: Mapping[tuple[str, ...], float], default: Sequence[float], max_epochs: float) -> DataFrame:
    """leaves (_p0.., tokens) with each leaf's budget; total is all their tokens if None.

    Supplies are summed up level by level, budgets joined down again. A level has one row
    per node and a window per parent, so only the domains meet in a common one.
    """
    path = [f"_p{k}" for k in range(depth)]
    open_ = F.lit(True)
    for level in range(depth):
        open_ = open_ & (weight_of(weights, default, level) > 0)
    tree = [leaves.select(*path, "tokens", F.when(open_, F.col("tokens") * F.lit(float(max_epochs))).otherwise(0.0).alias("_s"))]
    for level in range(depth - 1, 0, -1):
        tree.append(tree[-1].groupBy(*path[:level]).agg(F.sum("tokens").alias("tokens"), F.sum("_s").alias("_s")))
    top = W.partitionBy(F.lit(0))
    goal = F.sum("tokens").over(top).cast("double") if total is None else F.lit(float(total))
    nodes = shared(tree[-1].withColumn("_b", F.least(goal, F.sum("_s").over(top))).withColumn("_w", weight_of(weights, default, 0)), [F.lit(0)], path[:1])
    for level in range(1, depth):
        above = nodes.select(*path[:level], "_b")
        below = tree[depth - 1 - level].withColumn("_w", weight_of(weights, default, level))
        nodes = shared(below.join(above, path[:level]), path[:level], path[:level + 1])
    return nodes.select(*path, "tokens", F.col("_b").alias("budget"))


def mix(
    docs: DataFrame, path: Sequence[Column], tokens: Column, weights: Mapping[tuple[str, ...], float], default: Sequence[float] | None = None,
    total: float | None = None, max_epochs: int = 2, seed: int = 0, id_col: str = "doc_id",
) -> DataFrame:
    """docs with a struct `mix` (path, tokens, budget, leaf_tokens, copies): how often each row is taken.

    path: columns from the domain down to the source; weights: by path prefix, "*"
    stands for any name; default: weight of paths not listed, by level (1 each).
    total: tokens to take, all there are if None. copies is the number of epochs that
    take the row, 0 to max_epochs. Nulls in the path are a name of their own, null
    tokens count as 0 and a null id has a place in the order like others. Rows equal
    in id are ordered together by their other place in the table's order, which for
    equal rows makes no difference. A column `mix` of docs is replaced. An empty table gives no rows.
    """
    depth = len(path)
    names = [f"_p{k}" for k in range(depth)]
    plain = [c for c in docs.columns if c != "mix"]
    rows = docs.select(F.struct(*plain).alias("row"), *(F.coalesce(c.cast("string"), F.lit(NONE)).alias(n) for n, c in zip(names, path)), F.coalesce(tokens, F.lit(0)).cast("long").alias("_t"))
    # Written: every level of the tree reads the leaves.
    leaves = cut_lineage(rows.groupBy(*names).agg(F.sum("_t").alias("tokens")))
    plan = budgets(leaves, depth, total, weights, default or [1.0] * depth, max_epochs)
    whole = F.when(F.col("tokens") > 0, F.least(F.floor(F.col("budget") / F.col("tokens") + 1e-12), F.lit(max_epochs))).otherwise(F.when(F.col("budget") > 0, 1).otherwise(0))
    plan = plan.withColumn("_whole", whole).withColumn("_rest", F.greatest(F.round(F.col("budget") - F.col("_whole") * F.col("tokens"), 6), F.lit(0.0)))
    # Written: its size then tells Catalyst whether it may be sent to all tasks.
    plan = cut_lineage(plan)
    order = F.xxhash64(F.lit(seed), F.col("_whole"), F.col(f"row.{id_col}"))
    seen = rows.join(plan, names).withColumn("_u", order).withColumn("_range", F.shiftrightunsigned("_u", 64 - RANGE_BITS))
    # Where the prefix of the last epoch ends: one range of the hash per leaf.
    sums = seen.filter("_rest > 0").groupBy(*names, "_rest", "_range").agg(F.sum("_t").alias("n"))
    inside = W.partitionBy(*names).orderBy("_range").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = sums.withColumn("_before", F.sum("n").over(inside) - F.col("n"))
    border = sums.filter((F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("n") >= F.col("_rest"))).select(*names, F.col("_range").alias("_border"), "_before")
    seen = seen.join(cut_lineage(border), names, "left")
    upto = W.partitionBy(*names, "_range").orderBy(F.shiftrightunsigned("_u", 1), "_u", F.col(f"row.{id_col}")).rowsBetween(W.unboundedPreceding, W.currentRow)
    at_border = F.col("_range") == F.col("_border")
    on = seen.filter(at_border).withColumn("_more", F.col("_before") + F.sum("_t").over(upto) - F.col("_t") < F.col("_rest"))
    off = seen.filter(~F.coalesce(at_border, F.lit(False))).withColumn("_more", F.coalesce(F.col("_range") < F.col("_border"), F.lit(False)))
    return on.unionByName(off).select(
        *(F.col(f"row.`{c}`").alias(c) for c in plain),
        F.struct(F.array(*names).alias("path"), F.col("_t").alias("tokens"), "budget", F.col("tokens").alias("leaf_tokens"), (F.col("_whole") + F.col("_more").cast("long")).cast("int").alias("copies")).alias("mix"),
    )


def repeated(mixed: DataFrame) -> DataFrame:
    """The rows as often as they are taken, without the struct: the mixture itself."""
    row = F.struct(*(F.col(f"`{c}`") for c in mixed.columns if c != "mix")).alias("_row")
    return mixed.filter("mix.copies > 0").select(row, F.explode(F.array_repeat(F.lit(1), F.col("mix.copies"))).alias("_copy")).select("_row.*")
