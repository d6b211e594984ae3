"""Components by tasks and by rounds; neighbour searches in blocks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.operators import blocks, components, condensing as C


def union_find(edges):
    root = {}

    def find(n):
        root.setdefault(n, n)
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in list(root)}


def random_links(seed, n=300, m=260):
    rng = np.random.default_rng(seed)
    return [(k, int(a) - 50, int(b) - 50) for k in range(3) for a, b in rng.integers(0, n, (m, 2))]


@pytest.mark.parametrize("one_task", [0, 1 << 20])
def test_roots(spark, monkeypatch, one_task):
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    links = random_links(1)
    df = spark.createDataFrame(links, "k long, a long, b long").repartition(3)
    got = {(r.k, r.a): r.root for r in components.roots(df, ["k"]).collect()}
    for k in range(3):
        want = union_find([(a, b) for kk, a, b in links if kk == k])
        assert {n: r for (kk, n), r in got.items() if kk == k} == {n: r for n, r in want.items() if n != r}
    assert components.roots(df.where("false"), ["k"]).count() == 0


def test_rounds_are_logarithmic_on_an_ascending_path(spark):
    n, rounds = 4096, []
    path = spark.range(n).select(F.lit(0).alias("k"), "id", (F.col("id") + 1).alias("b")).withColumnRenamed("id", "a")
    got = components.star_roots(path, ["k"], rounds).agg(F.max("root"), F.count("a")).first()
    assert tuple(got) == (0, n) and len(rounds) <= 2 * math.log2(n)


def test_labels():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 5000, (2, 4000))
    want = union_find(list(zip(a.tolist(), b.tolist())))
    label = components.labels_of(5000, a, b)
    assert all(label[n] == r for n, r in want.items())
    path = np.arange(100_000)
    assert (components.labels_of(100_001, path, path + 1) == 0).all()


@pytest.mark.parametrize("n", [5, 47, 400, 3000])
def test_nearest(n):
    rng = np.random.default_rng(n)
    x, y = np.round(rng.random((2, n)) * 3, 2)  # rounded, so that distances tie
    name = rng.permutation(n)
    qx, qy = np.round(rng.random((2, 500)) * 4 - 0.5, 2)
    j, d2, ties = blocks.Nearest(x, y, name, 0.5).of(qx, qy)
    for k in range(500):
        d = (x - qx[k]) ** 2 + (y - qy[k]) ** 2
        least = d.min()
        if least > 0.25:
            assert j[k] == -1
        else:
            same = np.flatnonzero(d == least)
            assert j[k] == same[name[same].argmin()] and ties[k] == len(same) and d2[k] == least


def test_pairs_within_some_at_a_time(monkeypatch):
    rng = np.random.default_rng(3)
    x, y = rng.random((2, 300))
    d2 = (x[:, None] - x) ** 2 + (y[:, None] - y) ** 2
    want = {(i, j) for i, j in zip(*np.nonzero(d2 <= 0.04)) if i != j and i % 3 == 0}
    monkeypatch.setattr(blocks, "PAIRS", 50)
    got = [p for i, j, _ in blocks.pairs_within(x, y, np.arange(0, 300, 3), 0.2) for p in zip(i, j)]
    assert set(got) == want and len(got) == len(want)


def crowd(n=10_000, samples=10):
    rng = np.random.default_rng(2)
    sample = np.arange(n) % samples
    x, y = np.round(rng.random((2, n)) * 0.5, 4)
    return {"sample_id": sample, "x": x, "y": y, "f0": rng.random(n), "id": sample * C.SLOTS + np.arange(n), "_own": np.ones(n, dtype=bool)}


def test_a_crowd_is_searched_sample_by_sample(monkeypatch):
    """10,000 detections within one radius: what is read follows detections x samples, not the pairs."""
    read = 0
    plain = blocks.Grid.members

    def counted(self, cx, cy):
        nonlocal read
        for asked, j in plain(self, cx, cy):
            read += len(j)
            yield asked, j

    table = crowd()
    monkeypatch.setattr(blocks.Grid, "members", counted)
    choose = C._choices_from_samples({**table, "sample": table["sample_id"]}, 10, 0.75)
    (i, _, _), _ = choose(np.arange(10_000), np.arange(10))
    assert len(i) == 10_000 * 9 and read < 60 * 10_000 * 9 < 10_000**2 / 4


def test_both_ways_of_choosing_agree():
    table = crowd(600, 7)
    table = {**table, "sample": table["sample_id"]}
    a = C._choices_from_samples(table, 7, 0.1)(np.arange(0, 600, 2), None)
    b = C._choices_from_pairs(table, blocks.Grid(table["x"], table["y"], 0.1 * blocks.PAD), 0.1)(np.arange(0, 600, 2), None)
    for p, q in zip(a, b):
        assert sorted(zip(*(c.tolist() for c in p))) == sorted(zip(*(c.tolist() for c in q)))
