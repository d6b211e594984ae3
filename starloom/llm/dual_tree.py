"""Ranked lexical search: the best documents of each item, by a dual-tree search.

Items and documents are vectors over terms. Hierarchies over both hold, per node, the
greatest weight of each term below it; the product of two such maxima bounds every
score between the two nodes. A pair of nodes goes when its bound is below the weakest
kth score among the items of its item node, so what is left is exact.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from starloom.llm.common import SLICE
from starloom.session import cut_lineage

ITEM_BYTES = 4 << 20  # of item texts that are broadcast at once; more items take more passes
BLOCK_TERMS = 1 << 14  # different terms of the items under one item tree
FAN = 8, 8  # items under an item node, item nodes under the next one
LEAF, LEAVES = 16, 16  # documents under a leaf, leaves under a document node
CELLS = 1 << 22  # numbers in a dense table of documents by terms
SEEDS = 16  # one document in so many is searched first, for kth scores to prune by
PIECE = 1 << 20
SAFE = 1 << 53  # whole numbers below this are exact in doubles

_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
TO_TERMS = bytes(b if b >= 0x80 or b in _KEPT else b + 32 if b + 32 in _KEPT[10:] else 32 for b in range(256))


def terms(text: bytes) -> Counter:
    """Terms of a text by their number: runs of ASCII letters, digits and all other signs beyond ASCII, A-Z lower-cased."""
    text = text.translate(TO_TERMS)
    if len(text) <= PIECE:
        return Counter(text.split())
    found, at = Counter(), 0
    while at < len(text):
        cut = text.find(b" ", at + PIECE)
        cut = len(text) if cut < 0 else cut
        found.update(text[at:cut].split())
        at = cut
    return found


def vectors(docs: DataFrame, vocabulary) -> DataFrame:
    """doc_id, n (terms with repeats), ids and tfs of the broadcast vocabulary's terms, of documents with a term."""
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).where("text is not null")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                keep, total, ids, tfs = [], [], [], []
                for k, text in enumerate(part.column(1).to_pylist()):
                    counts = terms(text)
                    if not counts:
                        continue
                    found = sorted((known[t], counts[t]) for t in counts.keys() & known.keys())
                    keep.append(k)
                    total.append(counts.total())
                    ids.append([t for t, _ in found])
                    tfs.append([c for _, c in found])
                if keep:
                    arrays = [part.column(0).take(pa.array(keep)), pa.array(total, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "ids", "tfs"])

    return rows.mapInArrow(run, f"doc_id {kind}, n bigint, ids array<int>, tfs array<bigint>")


class ItemTree:
    """Items under nodes under nodes; each level a table of the greatest weights of terms below."""

    def __init__(self, chosen: np.ndarray, lists: list[np.ndarray], weight: np.ndarray) -> None:
        self.items = chosen
        self.columns = np.unique(np.concatenate([lists[i] for i in chosen]))
        most = max(int(weight[lists[i]].sum()) for i in chosen) * 1_000_000
        kind = np.float64 if most < SAFE else np.int64
        self.weight = weight[self.columns].astype(kind)
        has = np.zeros((len(chosen), len(self.columns)), dtype=kind)
        for row, i in enumerate(chosen):
            has[row, np.searchsorted(self.columns, lists[i])] = 1
        self.levels = [has]  # 1 where an item below has the term: its weight goes with the documents' side
        for fan in FAN:
            low = self.levels[-1]
            self.levels.append(np.maximum.reduceat(low, np.arange(0, len(low), fan), axis=0))


def item_trees(lists: list[np.ndarray], weight: np.ndarray, df: np.ndarray) -> list[ItemTree]:
    """Trees over all items with a term; items that share their most frequent terms stand together."""
    order = sorted((i for i in range(len(lists)) if len(lists[i])), key=lambda i: sorted(lists[i], key=lambda t: -df[t])[:4])
    trees, block, seen = [], [], set()
    for i in order:
        more = seen | set(lists[i].tolist())
        if block and len(more) > BLOCK_TERMS:
            trees.append(ItemTree(np.array(block), lists, weight))
            block, more = [], set(lists[i].tolist())
        block.append(i)
        seen = more
    if block:
        trees.append(ItemTree(np.array(block), lists, weight))
    return trees


class Best:
    """The k best documents of each item so far: highest score first, then least doc_id, null last."""

    def __init__(self, least: np.ndarray, k: int) -> None:
        self.k, self.heaps = k, [[] for _ in least]
        self.least = least.copy()  # scores below this are not among the k best; never below 1

    def add(self, item: int, score: int, doc) -> None:
        entry = (score, doc is not None, -doc if doc is not None else 0)
        heap = self.heaps[item]
        if len(heap) < self.k:
            heapq.heappush(heap, entry)
        elif entry > heap[0]:
            heapq.heapreplace(heap, entry)
        else:
            return
        if len(heap) == self.k:
            self.least[item] = max(self.least[item], heap[0][0])


def search(tree: ItemTree, docs: np.ndarray, ids: list, best: Best) -> None:
    """Scores between a tree's items and one document node: rows of impacts, cut off node pair by node pair."""
    live = docs.any(axis=0)
    docs = docs[:, live] * tree.weight[live]
    leaves = np.maximum.reduceat(docs, np.arange(0, len(docs), LEAF), axis=0)
    top = leaves.max(axis=0)
    least = best.least[tree.items]
    weakest = [least]
    for fan in FAN:
        weakest.append(np.minimum.reduceat(weakest[-1], np.arange(0, len(weakest[-1]), fan)))
    # Down the item tree against the whole document node ...
    nodes = np.arange(len(tree.levels[-1]))
    for level in range(len(FAN), 0, -1):
        nodes = nodes[tree.levels[level][nodes][:, live] @ top >= weakest[level][nodes]]
        if not len(nodes):
            return
        if level > 1:
            nodes = children(nodes, FAN[level - 1], len(tree.levels[level - 1]))
    # ... then the lowest item nodes and their items against the document leaves.
    near = tree.levels[1][nodes][:, live] @ leaves.T >= weakest[1][nodes, None]
    nodes, near = nodes[near.any(axis=1)], near[near.any(axis=1)]
    items = children(nodes, FAN[0], len(tree.items))
    if not len(items):
        return
    rows = tree.levels[0][items][:, live]
    near = near[np.searchsorted(nodes, items // FAN[0])] & (rows @ leaves.T >= least[items, None])
    # Leaves with the highest bounds go first: they raise the kth scores for the others.
    for leaf in np.argsort(-leaves.sum(axis=1), kind="stable"):
        chosen = np.flatnonzero(near[:, leaf])
        if not len(chosen):
            continue
        at = slice(leaf * LEAF, (leaf + 1) * LEAF)
        scores = rows[chosen] @ docs[at].T
        for r, c in zip(*np.nonzero(scores >= best.least[tree.items[items[chosen]]][:, None])):
            best.add(int(tree.items[items[chosen[r]]]), int(scores[r, c]), ids[leaf * LEAF + c])


def children(nodes: np.ndarray, fan: int, n: int) -> np.ndarray:
    found = (nodes[:, None] * fan + np.arange(fan)).ravel()
    return found[found < n]


def document_nodes(batch: pa.RecordBatch, tree: ItemTree, weight: np.ndarray, norm: tuple[int, int]) -> Iterator[tuple[np.ndarray, list]]:
    """Documents of a batch as rows of impacts, those with the same heaviest term side by side, node by node."""
    total, (n_docs, n_terms) = batch.column(1).to_numpy(), norm
    lists, tfs = batch.column(2), batch.column(3)
    starts = lists.offsets.to_numpy()
    ids, tf = lists.values.to_numpy()[starts[0] : starts[-1]], tfs.values.to_numpy()[tfs.offsets.to_numpy()[0] : tfs.offsets.to_numpy()[-1]]
    row = np.repeat(np.arange(batch.num_rows), np.diff(starts))
    m = 100 - 90 + (90 * total * n_docs) // n_terms
    impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[row])
    at = np.searchsorted(tree.columns, ids)
    inside = (at < len(tree.columns)) & (tree.columns[np.minimum(at, len(tree.columns) - 1)] == ids)
    row, at, impact, ids = row[inside], at[inside], impact[inside], ids[inside]
    if not len(row):
        return
    order = np.lexsort((impact * weight[ids], row))
    last = np.append(row[order][1:] != row[order][:-1], True)
    heaviest = dict(zip(row[order][last].tolist(), at[order][last].tolist()))
    docs = np.array(sorted(heaviest, key=lambda r: (heaviest[r], r)))
    place = np.full(batch.num_rows, -1)
    place[docs] = np.arange(len(docs))
    by = np.argsort(place[row], kind="stable")
    row, at, impact = place[row][by], at[by], impact[by]
    names = batch.column(0).to_pylist()
    size = max(1, min(LEAF * LEAVES, CELLS // len(tree.columns) // LEAF * LEAF))
    for first in range(0, len(docs), size):
        lo, hi = np.searchsorted(row, (first, first + size))
        table = np.zeros((min(size, len(docs) - first), len(tree.columns)), dtype=tree.weight.dtype)
        table[row[lo:hi] - first, at[lo:hi]] = impact[lo:hi]
        yield table, [names[d] for d in docs[first : first + size]]


def best_documents(rows: DataFrame, plan, least: np.ndarray, k: int) -> DataFrame:
    """item (its number), doc_id, score: per task the k best of each item that reach its least score."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, weight, norm = plan.value
        best, arrow = Best(least, k), None
        for batch in batches:
            arrow = batch.schema.field("doc_id").type
            for tree in trees:
                for table, names in document_nodes(batch, tree, weight, norm):
                    search(tree, table, names, best)
        found = [(i, -e[2] if e[1] else None, e[0]) for i, heap in enumerate(best.heaps) for e in heap if e[0] >= best.least[i] or len(heap) < k]
        if found:
            item, doc, score = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, arrow), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return rows.select("doc_id", "n", "ids", "tfs").mapInArrow(run, f"item int, doc_id {kind}, score bigint")


def top(found: DataFrame, k: int) -> DataFrame:
    first = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def search_group(spark: SparkSession, texts: list[tuple[object, list[str]]], docs: DataFrame, k: int, kind: str) -> DataFrame | None:
    """The ranking of a bounded group of items, or None where no document has a term of theirs."""
    wanted = [sorted({t for text in said for t in terms(text.encode())}) for _, said in texts]
    vocabulary = {t: n for n, t in enumerate(sorted(set().union(*wanted)))}
    rows = cut_lineage(vectors(docs, spark.sparkContext.broadcast(vocabulary)))
    n_docs, n_terms = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), dtype=np.int64)
    for r in rows.select(F.explode("ids").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("c")).toLocalIterator():
        df[r.t] = r.c  # a row per term of the group
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(c) + 1))) if c else 0 for c in df], dtype=np.int64)
    lists = [np.array([vocabulary[t] for t in found if df[vocabulary[t]]], dtype=np.int64) for found in wanted]
    trees = item_trees(lists, weight, df)
    if not trees:
        return None
    plan = spark.sparkContext.broadcast((trees, weight, (int(n_docs), int(n_terms))))
    least = np.ones(len(texts), dtype=np.int64)
    seeds = rows.where(F.pmod(F.xxhash64("doc_id", "n", "ids"), F.lit(SEEDS)) == 0)
    for r in top(best_documents(seeds, plan, least, k), k).where(F.col("rank") == k).collect():  # a row per item
        least[r.item] = max(1, r.score)
    found = top(best_documents(rows.where(F.size("ids") > 0), plan, least, k), k)
    names = spark.createDataFrame([(n, item) for n, (item, _) in enumerate(texts)], f"item int, item_id {kind}")
    return found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # as many names as items in the group


def search_documents(items: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """The k highest-scoring documents of each item: item_id, rank (from 1), doc_id, score.

    items: item_id, text; docs: doc_id (a whole number), text. Other columns are not read.
    Scores are those of the module's contract in whole numbers: a term's weight times its
    saturated share of the document, summed over the item's terms. Only scores above 0
    count; equal ones go by ascending doc_id, null last.

    Null and empty texts have no terms: such documents count nowhere, such items have no
    rows. Rows of one item_id (null is one) are one item with the terms of all of them.
    Each row of docs is a document, also with a doc_id that occurs twice. Empty tables
    give none. Items are broadcast in groups of at most ITEM_BYTES of text (an item
    beyond that alone); each group is a pass over the documents.
    """
    spark = docs.sparkSession
    rows = items.select("item_id", "text").where("text is not null")
    kind = rows.schema["item_id"].dataType.simpleString()
    result = f"item_id {kind}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score bigint"
    size, groups = F.sum(F.octet_length("text")), 1
    number = lambda n: F.pmod(F.xxhash64("item_id"), F.lit(n))
    bytes_of = rows.groupBy("item_id").agg(size.alias("b"))
    total = bytes_of.agg(F.sum("b"), F.max("b")).first()
    if total[0] is None:
        return spark.createDataFrame([], result)
    room = max(ITEM_BYTES, total[1])
    while bytes_of.groupBy(number(groups).alias("g")).agg(F.sum("b").alias("b")).agg(F.max("b")).first()[0] > room:
        groups *= 2
    parts = []
    for g in range(groups):
        said: dict[object, list[str]] = {}
        for r in rows.where(number(groups) == g).collect():  # at most ITEM_BYTES, or one item
            said.setdefault(r.item_id, []).append(r.text)
        found = search_group(spark, list(said.items()), docs, k, kind) if said else None
        parts += [found] if found is not None else []
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], result)
