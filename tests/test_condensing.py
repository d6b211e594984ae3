"""Seeds and claims against the sequential rules."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from starloom.operators import condensing as C


def sequential_seeds(nodes, edges):
    near = {n: set() for n in nodes}
    for i, j in edges:
        near[i].add(j)
        near[j].add(i)
    out = []
    while near:
        top = max(near, key=lambda n: (len(near[n]), n))
        out.append((top, len(near[top])))
        for gone in [top, *near[top]]:
            for other in near.pop(gone):
                if other in near:
                    near[other].discard(gone)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_greedy_seeds_equal_the_sequential_rule(spark, seed):
    rng = np.random.default_rng(seed)
    nodes, edges = [], []
    for field in range(12):
        n = int(rng.integers(1, 25))
        nodes += [(field, i, float(i), 0.0) for i in range(n)]
        p = rng.random() * 0.3
        edges += [(field, i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < p]
    nodes_df = spark.createDataFrame(nodes, "field_id long, id long, x double, y double")
    edges_df = spark.createDataFrame(edges, "field_id long, i long, j long")
    got = C.greedy_seeds(nodes_df, edges_df).toPandas()
    for field in range(12):
        ids = [n[1] for n in nodes if n[0] == field]
        want = sequential_seeds(ids, [(i, j) for f, i, j in edges if f == field])
        mine = got[got.field_id == field].sort_values(["degree", "id"], ascending=False)
        # The pick order is the order by (degree, id), both falling.
        assert list(zip(mine.id, mine.degree)) == want


@pytest.mark.parametrize("large", [0, 40])
def test_large_components_go_through_rounds(spark, monkeypatch, large):
    """Whether a component is solved in a task or by rounds, the seeds are those of the sequential rule."""
    rng = np.random.default_rng(large)
    nodes = [(0, i, 0.0, 0.0) for i in range(120)]
    edges = [(0, i, j) for i in range(120) for j in range(i + 1, 120) if i // 30 == j // 30 and rng.random() < 0.1 + (i < 30) * 0.3]
    edges += [(0, 200 + i, 201 + i) for i in range(60)]  # a path along which the ids rise
    nodes += [(0, 200 + i, 0.0, 0.0) for i in range(61)]
    monkeypatch.setattr(C, "LARGE", large)
    got = C.greedy_seeds(spark.createDataFrame(nodes, "field_id long, id long, x double, y double"), spark.createDataFrame(edges, "field_id long, i long, j long").repartition(3)).toPandas()
    mine = got.sort_values(["degree", "id"], ascending=False)
    assert list(zip(mine.id, mine.degree)) == sequential_seeds([n[1] for n in nodes], [e[1:] for e in edges])


def test_long_ascending_path_settles_in_one_task():
    i = np.arange(200_000)
    names, degree = C.sequential_seeds(i, i + 1)
    assert len(names) == 200_001 and names[degree == 2].max() == 199_999


def test_shared_blocks_change_nothing(spark, monkeypatch):
    pdf = ensemble(7, n=250, size=3.0)
    det = C.stacked(spark.createDataFrame(pdf))
    want = sorted(map(tuple, C.pruned_edges(det, 0.75).collect()))
    seeds = sorted(map(tuple, C.seed_catalog(spark.createDataFrame(pdf), 0.75).collect()))
    for name, value in (("CROWDED", 40), ("WIDTH", 1.5), ("PAIRS", 500)):
        monkeypatch.setattr(C.blocks, name, value)
    monkeypatch.setattr(C, "SOLVED", 5)
    assert sorted(map(tuple, C.pruned_edges(det, 0.75).collect())) == want
    assert sorted(map(tuple, C.seed_catalog(spark.createDataFrame(pdf), 0.75).collect())) == seeds


def test_greedy_seeds_without_edges(spark):
    nodes = spark.createDataFrame([(0, 5, 1.0, 2.0)], "field_id long, id long, x double, y double")
    none = spark.createDataFrame([], "field_id long, i long, j long")
    assert [(r.id, r.degree) for r in C.greedy_seeds(nodes, none).collect()] == [(5, 0)]


def ensemble(seed, n=150, samples=4, size=4.0):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"field_id": rng.integers(0, 2, n), "sample_id": rng.integers(0, samples, n), "x": rng.random(n) * size, "y": rng.random(n) * size, "f0": np.round(rng.random(n) * 20) + 1})
    pdf = pdf.sort_values(["field_id", "sample_id", "f0", "x"], ascending=[True, True, False, True]).reset_index(drop=True)
    pdf["src"] = pdf.groupby(["field_id", "sample_id"]).cumcount()
    return pdf


def sequential_prune(det, r):
    """Graph and pruning, one detection at a time."""
    ids = det["id"].tolist()
    row = det.set_index("id")
    d2 = {(i, j): (row.x[i] - row.x[j]) ** 2 + (row.y[i] - row.y[j]) ** 2 for i in ids for j in ids}
    match = {i: [j for j in ids if j != i and d2[i, j] <= r * r] for i in ids}
    edges = {frozenset((i, j)) for i in ids for j in match[i] if row.f0[i] != row.f0[j]}
    for i in ids:
        for s in set(row.sample_id[match[i]]) - {row.sample_id[i]}:
            there = [j for j in match[i] if row.sample_id[j] == s]
            if len(there) > 1:
                best = min(there, key=lambda j: (d2[i, j], j))
                edges -= {frozenset((i, j)) for j in there if j != best}
    return sorted(tuple(sorted(e)) for e in edges)


@pytest.mark.parametrize("seed", range(2))
def test_pruned_edges_and_seeds_brute_force(spark, seed):
    pdf = ensemble(seed)
    det = C.stacked(spark.createDataFrame(pdf))
    local = det.toPandas()
    got = C.pruned_edges(det, 0.75).toPandas()
    seeds = C.seed_catalog(spark.createDataFrame(pdf), 0.75).toPandas()
    for field, part in local.groupby("field_id"):
        want = sequential_prune(part, 0.75)
        assert sorted(zip(got[got.field_id == field].i, got[got.field_id == field].j)) == want
        mine = seeds[seeds.field_id == field].sort_values(["degree", "id"], ascending=False)
        assert list(zip(mine.id, mine.degree)) == sequential_seeds(part["id"].tolist(), want)


@pytest.mark.parametrize("seed", range(2))
def test_claims_equal_the_sequential_rule(spark, seed):
    pdf = ensemble(seed + 10, n=400, size=3.0)
    rng = np.random.default_rng(seed)
    seeds = pd.DataFrame({"field_id": rng.integers(0, 2, 60), "sid": np.arange(60), "x": rng.random(60) * 3, "y": rng.random(60) * 3})
    got = C.claim(spark.createDataFrame(seeds), spark.createDataFrame(pdf), 0.6, "sid", -F.floor(F.col("sid") / 7.0), [F.desc("sid")]).toPandas()
    want = []
    for (field, sample), part in pdf.groupby(["field_id", "sample_id"]):
        free = part.sort_values("src")
        for _, s in seeds[seeds.field_id == field].sort_values("sid", ascending=False).iterrows():
            near = free[(free.x - s.x) ** 2 + (free.y - s.y) ** 2 <= 0.36]
            if len(near):
                want.append((field, sample, s.sid, near.src.iloc[0]))
                free = free.drop(near.index[0])
    assert sorted(map(tuple, got[["field_id", "sample_id", "sid", "src"]].to_numpy())) == sorted(want)
    assert not got.duplicated(["field_id", "sample_id", "src"]).any()


@pytest.mark.parametrize("large", [0, 1 << 22])
def test_a_chain_of_priorities_settles_at_once(spark, monkeypatch, large):
    """1,000 seeds in a row, each of which would take its neighbour's detection: every choice hangs on the one before."""
    n = 1000 if large else 40
    seeds = [(0, k, k * 1.0, 0.5) for k in range(n)]
    dets = [(0, 0, 2 * n - k, k + 0.5, 0.5) for k in range(n)]
    monkeypatch.setattr(C, "LARGE", large)
    rounds = []
    monkeypatch.setattr(C, "_claims_by_rounds", lambda pairs, f=C._claims_by_rounds: rounds.append(1) or f(pairs))
    got = C.claim(
        spark.createDataFrame(seeds, "field_id long, sid long, x double, y double"), spark.createDataFrame(dets, "field_id long, sample_id long, src long, x double, y double"),
        0.6, "sid", F.lit(0), [F.asc("sid")],
    ).collect()
    assert sorted((r.sid, r.src) for r in got) == [(k, 2 * n - k) for k in range(n)] and len(rounds) == (large == 0)


def test_condense_of_single_claims(spark):
    ens = spark.createDataFrame([(0, 0, 0, 1.0, 2.0, 5.0), (0, 1, 0, 1.5, 2.0, 7.0), (0, 1, 1, 9.0, 9.0, 3.0)], "field_id long, sample_id long, src long, x double, y double, f0 double")
    claims = spark.createDataFrame([(0, 0, 1, 0), (0, 1, 1, 0), (0, 1, 2, 1)], "field_id long, sample_id long, seed long, src long")
    got = {r.seed: r for r in C.condense(claims, ens, "seed").collect()}
    assert got[1].confidence == 1.0 and abs(got[1].err_x - 0.17) < 1e-12 and got[1].mean_f0 == 6.0
    assert got[2].confidence == 0.5 and got[2].err_x == 0.0 and got[2].hipct_f0 is None


def test_few_pairs_are_listed_once_and_not_searched_for_twice(monkeypatch):
    """A block with few pairs is pruned from one list of them, with the edges of the longer way."""
    rng = np.random.default_rng(11)
    n, radius = 400, 0.75
    t = {
        "x": np.round(rng.random(n) * 4, 1), "y": np.round(rng.random(n) * 4, 1), "f0": rng.integers(1, 9, n).astype(float),
        "id": rng.permutation(n), "sample_id": rng.integers(0, 7, n), "_own": rng.random(n) < 0.7, "_shares": np.ones(n, dtype=int),
    }
    edges = lambda: sorted(zip(*(np.concatenate(c).tolist() for c in zip(*C._pruned(dict(t), radius)))))
    monkeypatch.setattr(C, "LOOKED_AT", 0)
    want = edges()
    monkeypatch.undo()
    monkeypatch.setattr(C.blocks, "pairs_within", None)
    assert edges() == want and len(want) > 100
    i, j, _ = C.blocks.close_pairs(t["x"], t["y"], radius, 1 << 20)
    d2 = (t["x"][:, None] - t["x"]) ** 2 + (t["y"][:, None] - t["y"]) ** 2
    near = np.argwhere(np.triu(d2 <= radius * radius, 1))
    assert sorted(map(tuple, np.sort(np.stack([i, j], 1), 1).tolist())) == sorted(map(tuple, near.tolist()))
    assert C.blocks.close_pairs(t["x"], t["y"], radius, 100) is None


def test_group_stats_sort_values_by_batch(spark):
    """Means and percentiles of many short groups: nulls left out, groups that batches cut, no hash map per group."""
    rng = np.random.default_rng(5)
    rows = [(int(k), None if v < -1 else float(v)) for k, v in zip(rng.integers(0, 4000, 30_000), rng.normal(size=30_000))]
    df = spark.createDataFrame([*rows, (None, 1.0), (None, 2.0), (-1, None)], "k long, v double").repartition(2)
    out = C._group_stats(df, ["k"], ["v"], (0.16, 0.84))
    assert "ObjectHashAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    want = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean_v"), F.percentile("v", F.array(F.lit(0.16), F.lit(0.84))).alias("p"))
    got = {r[0]: r[1:] for r in out.collect()}
    assert len(got) == want.count()
    for r in want.collect():
        assert got[r.k][0] == r.n and list(got[r.k][2:]) == (r.p or [None, None])
        assert got[r.k][1] == (None if r.mean_v is None else pytest.approx(r.mean_v, abs=1e-12))
