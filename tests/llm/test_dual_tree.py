"""The dual-tree ranking against scores of all pairs."""

import math
import random
import re
from collections import Counter

import pytest

from starloom.llm import dual_tree

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, doc_id string, item int, term string"
DOCS = "doc_id long, text string, n string, ids int, rank int"


def words(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranking(items, docs, k=10):
    counts = [(d, Counter(words(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    said = {}
    for i, text in items:
        said.setdefault(i, set()).update(words(text))
    out = []
    for i, wanted in said.items():
        found = []
        for d, c in counts:
            m = 10 + (90 * c.total() * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in wanted if c[t])
            if score > 0:
                found.append((-score, d is None, d, score))
        found.sort(key=lambda f: (f[0], f[1], f[2] or 0))
        out += [(i, r + 1, f[2], f[3]) for r, f in enumerate(found[:k])]
    return sorted(out, key=repr)


def fixture(seed, n=400, items=30):
    rng = random.Random(seed)
    lexicon = [f"{c}{k}" for k in range(60) for c in ("a", "É", "z", "B")]
    text = lambda m: " ".join(lexicon[int(rng.random() ** 2 * len(lexicon))] + rng.choice(["", ".", "-X", "\n", " "]) for _ in range(m))
    docs = [(k, text(rng.choice([0, 1, 5, 20, 60]))) for k in range(n)]
    docs += [(k, docs[k][1]) for k in range(5)] + [(n + k, docs[3][1]) for k in range(150)]  # repeated rows, a hot text
    docs += [(None, docs[9][1]), (n + 200, None), (n + 201, ""), (n + 202, " .-!\x7f")]
    docs += [(n + 203 + k, t) for k, t in enumerate(said for _, said in [(0, "a1 z2 B3 " * 4)])]
    ask = [(k, text(rng.choice([1, 4, 25]))) for k in range(items)] + [(3, "a1 a1 É2"), (None, "z1 z2"), (90, None), (91, ""), (92, "nowhere"), (93, docs[3][1])]
    return ask, docs


def searched(spark, items, docs, k=10):
    ask = spark.createDataFrame([(*i, "x", 1, "y") for i in items], ITEMS)
    rows = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], DOCS).repartition(3)
    return sorted((tuple(r) for r in dual_tree.search_documents(ask, rows, k).collect()), key=repr)


@pytest.mark.parametrize("k", [1, 10, 1000])
def test_all_pairs(spark, k):
    items, docs = fixture(k)
    assert searched(spark, items, docs, k) == ranking(items, docs, k)


def test_many_groups_trees_and_nodes(spark, monkeypatch):
    """Limits on what is held at once change nothing; neither do whole numbers in place of doubles."""
    items, docs = fixture(5)
    want = ranking(items, docs)
    for name, value in (("ITEM_BYTES", 300), ("BLOCK_TERMS", 20), ("CELLS", 2000), ("PIECE", 7)):
        monkeypatch.setattr(dual_tree, name, value)
    assert searched(spark, items, docs) == want
    monkeypatch.setattr(dual_tree, "SAFE", 1)
    assert searched(spark, items[:12], docs) == ranking(items[:12], docs)


def test_long_text(spark):
    long = "a1 " * 700_000 + "Z9" + "é" * 1_500_000 + " b2"
    items, docs = [(1, "a1 z9 b2"), (2, "q")], [(1, long), (2, "b2 Z9"), (3, "c")]
    assert searched(spark, items, docs) == ranking(items, docs)


def test_empty_tables(spark):
    items, docs = fixture(1, n=20, items=3)
    assert searched(spark, [], docs) == searched(spark, items, []) == searched(spark, [(1, None)], docs) == []


def test_pairs_are_pruned(monkeypatch):
    """With kth scores known, most node pairs go before any score is computed."""
    import numpy as np

    rng = np.random.default_rng(0)
    weight = rng.integers(1000, 9000, 400)
    lists = [np.unique(rng.integers(0, 400, 12)) for _ in range(128)]
    trees = dual_tree.item_trees(lists, weight, np.ones(400))
    table = np.zeros((256, 400))
    table[np.arange(256), np.arange(256)] = 1000.0
    for row, i in enumerate(range(0, 128, 16)):
        table[row, lists[i]] = 900_000.0
    told = []
    monkeypatch.setattr(dual_tree.Best, "add", lambda self, item, score, doc: told.append((item, doc)))
    for tree in trees:
        dual_tree.search(tree, table[:, tree.columns], list(range(256)), dual_tree.Best(np.array([int(weight[x].sum()) * 900_000 for x in lists]), 1))
    assert {(i, row) for row, i in enumerate(range(0, 128, 16))} == set(told)
