"""Budgets against a rebuild by rounds, and the prefixes they take."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from starloom.llm import mixing as M


def poured(total, items):
    """items: name to (weight, supply). Rounds: who cannot take a share is filled and the rest shared out again."""
    out, open_, left = {k: 0.0 for k in items}, {k for k, (w, s) in items.items() if w > 0 and s > 0}, total
    while open_ and left > 1e-9:
        share = left / sum(items[k][0] for k in open_)
        full = {k for k in open_ if items[k][1] <= share * items[k][0] + 1e-12}
        if not full:
            return out | {k: share * items[k][0] for k in open_}
        for k in full:
            out[k] = items[k][1]
            left -= items[k][1]
        open_ -= full
    return out


WEIGHTS = {("A",): 0.7, ("B",): 0.2, ("C",): 0.0, ("*", "x"): 0.9, ("A", "y"): 0.05, ("*", "*", "p"): 3.0}


@pytest.mark.parametrize("total", [None, 9000.0, 100_000.0])
def test_budgets_and_prefixes(spark, total):
    rng = random.Random(4)
    rows = [(i if i % 50 else None, rng.choice("ABC"), rng.choice(["x", "y", None]), rng.choice("pqr"), rng.choice([0, 1, 5, 20, 100, None]), "m") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, d string, l string, s string, tokens long, mix string").repartition(3)
    mixed = M.mix(df, [F.col("d"), F.col("l"), F.col("s")], F.col("tokens"), WEIGHTS, [1, 1, 1], total, 2, seed=3).cache()
    got = mixed.select("doc_id", "tokens", F.col("mix.path").alias("path"), F.col("mix.budget").alias("budget"), F.col("mix.copies").alias("copies")).collect()
    assert len(got) == 500
    tokens = Counter()
    for _, d, l, s, t, _ in rows:
        tokens[d, l or M.NONE, s] += t or 0
    supply = {k: 2.0 * v * (k[0] != "C") for k, v in tokens.items()}
    first = poured(min(total or sum(tokens.values()), sum(supply.values())), {d: ({"A": 0.7, "B": 0.2, "C": 0.0}[d], sum(v for k, v in supply.items() if k[0] == d)) for d in "ABC"})
    budget = {}
    for d, b in first.items():
        second = poured(b, {l: (0.05 if (d, l) == ("A", "y") else 0.9 if l == "x" else 1.0, sum(v for k, v in supply.items() if k[:2] == (d, l))) for l in {k[1] for k in supply if k[0] == d}})
        for l, c in second.items():
            budget |= {(d, l, s): v for s, v in poured(c, {s: (3.0 if s == "p" else 1.0, supply[d, l, s]) for s in {k[2] for k in supply if k[:2] == (d, l)}}).items()}
    taken = Counter()
    for r in got:
        assert abs(r.budget - budget[tuple(r.path)]) < 1e-6
        taken[tuple(r.path)] += r.copies * (r.tokens or 0)
    # Each leaf takes its budget and at most the rest of one document.
    assert all(-1e-6 <= taken[k] - b < 100 for k, b in budget.items())
    leaves = defaultdict(set)
    for r in got:
        leaves[tuple(r.path)].add(r.copies)
    assert all(max(c) - min(c) <= 1 for k, c in leaves.items() if k[0] != "C")
    again = M.mix(df.repartition(7), [F.col("d"), F.col("l"), F.col("s")], F.col("tokens"), WEIGHTS, [1, 1, 1], total, 2, seed=3)
    same = lambda m: sorted((str(r.doc_id), r.d, str(r.l), r.s, str(r.tokens), r.mix.copies) for r in m.filter("doc_id is not null").collect())
    assert same(mixed) == same(again)
    assert M.repeated(mixed).count() == sum(r.copies for r in got)


def test_edges(spark):
    df = spark.createDataFrame([(1, "A", 0)], "doc_id long, d string, t long")
    args = ([F.col("d")], F.col("t"), {("A",): 1.0})
    assert M.mix(df, *args).count() == 1
    assert M.mix(df.limit(0), *args).count() == 0
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("A").alias("d"), F.lit(10).cast("long").alias("t"))
    got = M.mix(hot, *args, total=12_345.0).agg(F.sum(F.col("mix.copies") * 10)).first()[0]
    assert got == 12_350


def test_budgets_of_many_leaves(spark):
    leaves = [(f"d{k % 3}", f"l{k % 7}", f"s{k}", 10 + k * k % 97) for k in range(300)]
    got = {(r._p0, r._p1, r._p2): r.budget for r in M.budgets(spark.createDataFrame(leaves, "_p0 string, _p1 string, _p2 string, tokens long"), 3, 9000.0, {("d1",): 5.0}, [1, 1, 1], 2).collect()}
    supply = {leaf[:3]: 2.0 * leaf[3] for leaf in leaves}
    under = lambda *path: {k: v for k, v in supply.items() if k[:len(path)] == path}
    want = {}
    for d, b in poured(9000.0, {d: (5.0 if d == "d1" else 1.0, sum(under(d).values())) for d in ("d0", "d1", "d2")}).items():
        for lang, c in poured(b, {lang: (1.0, sum(under(d, lang).values())) for lang in {k[1] for k in under(d)}}).items():
            want |= poured(c, {k: (1.0, v) for k, v in under(d, lang).items()})
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-6 for k, v in want.items())
