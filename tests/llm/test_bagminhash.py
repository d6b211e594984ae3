"""Weighted minimum hashing: unbiased, and classes as from all pairs."""

import random
from collections import Counter, defaultdict

import numpy as np

from starloom.llm import bagminhash as B
from starloom.llm.components import components


def bags_of(rng):
    n = rng.integers(1, 60)
    element = np.sort(rng.choice(2**62, n, replace=False).astype(np.uint64))
    a = rng.integers(0, 9, n)
    b = np.where(rng.random(n) < 0.6, a, rng.integers(0, 40, n))
    return (element[a > 0], a[a > 0]), (element[b > 0], b[b > 0]), np.minimum(a, b).sum() / max(1, np.maximum(a, b).sum())


def test_slots_agree_as_often_as_bags_overlap():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(40):
        a, b, true = bags_of(rng)
        assert abs(B.overlap(a, b) - true) < 1e-12 or not len(a[0]) + len(b[0])
        times = B.signatures([a, b], 1024)
        if len(a[0]) and len(b[0]):
            errors.append((times[0] == times[1]).mean() - true)
    assert abs(np.mean(errors)) < 0.006 and np.sqrt(np.mean(np.square(errors))) < 0.025


def test_signature_does_not_depend_on_the_batch():
    rng = np.random.default_rng(2)
    bags = [bags_of(rng)[0] for _ in range(20)] + [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    together = B.signatures(bags, 32)
    assert all((B.signatures([b], 32)[0] == row).all() for b, row in zip(bags, together))
    assert np.isinf(together[-1]).all()


def classes_by_all_pairs(texts, least=0.8):
    bags = []
    for t in texts:
        w = (t or "").split()
        k = min(5, len(w))
        bags.append(Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if w else Counter())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            total = sum((bags[i] | bags[j]).values())
            if (texts[i] or "") == (texts[j] or "") or (total and both >= least * total):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def drifting_texts(seed):
    """Copies, chains of copies of copies that drift apart, repeated text and unrelated ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    texts = [None, "", " ", "one two", "one two", "one  two"]
    for _ in range(12):
        words = [word() for _ in range(rng.randint(30, 120))]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 8)):
            words = list(words)
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = word()
            texts.append(" ".join(words))
    base = " ".join(word() for _ in range(12))
    return texts + [" ".join([base] * n) for n in (1, 2, 10, 11, 12)]


def test_classes_as_from_all_pairs(spark):
    texts = drifting_texts(3)
    df = spark.createDataFrame([(k, t, 1, False) for k, t in enumerate(texts)], "doc_id long, text string, class_id int, kept boolean").repartition(4)
    got = {r.doc_id: r for r in B.near_duplicates(df, bands=32, rows=3).collect()}
    want = classes_by_all_pairs(texts)
    assert [got[k].class_id for k in range(len(texts))] == want
    sizes = Counter(want)
    assert all(got[k].class_size == sizes[c] and got[k].kept == (k == c) for k, c in enumerate(want))
    left = B.without_near_duplicates(df, bands=32, rows=3)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == sorted(set(want))


def test_repeated_rows_and_null_ids(spark):
    text = "a b c d e f g h"
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (None, "z"), (2, "other words here")], "doc_id long, text string")
    got = B.near_duplicates(df).collect()
    assert sum(r.kept for r in got) == 3 and sum(r.class_size == 3 and r.class_id == 1 for r in got) == 3
    assert sorted(r.text for r in B.without_near_duplicates(df).collect()) == sorted([text, "z", "other words here"])
    assert B.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rng.randint(50, 90), rng.randint(50, 90)) for _ in range(25)] + [(100, k) for k in range(101, 130)]
    root = {n: n for e in edges for n in e}

    def find(n):
        return n if root[n] == n else find(root[n])

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root}
