"""Near duplicates by weighted minimum hashing of word shingles with their numbers of occurrences.

A text is the bag of its shingles of five words. Each shingle has one Poisson
process of points (time, level, slot) per dyadic range of levels [0, 1), [1, 2),
[2, 4), [4, 8) ..., whose rate is the width of the range; a bag in which it occurs
c times takes the points below level c. A slot's signature is the earliest time
among all points that fall into it, so two bags agree in a slot with a probability
of exactly their weighted Jaccard likeness, sum of minima over sum of maxima.
Processes are only followed up to the latest time still in the signature.

Signatures are cut into bands; texts that agree in a band are candidates. Every
link is verified on the bags themselves.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from starloom.llm.common import map_rows, per_process
from starloom.llm.components import components
from starloom.session import cut_lineage

WORDS = 5          # words in a shingle
LIKENESS = 0.8     # least weighted Jaccard likeness of a link
BANDS, ROWS = 16, 4  # at likeness 0.8 a link is missed with probability (1 - 0.8^4)^16 = 0.0002
REMEMBERED = 200_000  # words whose hash a worker remembers
STEP = np.uint64(0x9E3779B97F4A7C15)  # fixed value: 2^64 over the golden ratio


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash; fixed multipliers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes in order and how often each occurs. Fewer than five words make one shingle, none an empty bag."""
    known = per_process("bagminhash", "words", dict)
    words = text.split()
    try:
        codes = [known[w] for w in words]
    except KeyError:
        codes = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                if len(known) < REMEMBERED and len(w) < 64:
                    known[w] = h
            codes.append(h)
    h = np.array(codes, np.uint64)
    n = len(h)
    if n == 0:
        return h, np.zeros(0, np.int64)
    width = min(WORDS, n)
    out = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        out = mix(out + h[k:n - width + 1 + k] + STEP)
    return np.unique(out, return_counts=True)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], slots: int) -> np.ndarray:
    """Earliest times by bag and slot; infinite throughout for an empty bag. All bags go through each step together."""
    sizes = np.array([len(e) for e, _ in bags], np.int64)
    times = np.full(len(bags) * slots, np.inf)
    if not sizes.sum():
        return times.reshape(len(bags), slots)
    element = np.concatenate([e for e, _ in bags])
    count = np.concatenate([c for _, c in bags])
    owner = np.repeat(np.arange(len(bags)), sizes)
    # One process per shingle and dyadic range of levels that starts below its count.
    levels = np.ceil(np.log2(count)).astype(np.int64) + 1
    row = np.repeat(np.arange(len(element)), levels)
    level = np.arange(len(row)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    width = np.maximum(low, 1)
    seed, count, owner = mix(element[row] + STEP * (level + 1).astype(np.uint64)), count[row], owner[row]
    time, point = np.zeros(len(row)), np.zeros(1, np.uint64)
    while len(seed):
        draw = mix(seed + STEP * (np.uint64(2) * point + np.uint64(1)))
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / width
        draw = mix(seed + STEP * (np.uint64(2) * point + np.uint64(2)))
        slot = (draw % np.uint64(slots)).astype(np.int64)
        at = low + (width * (mix(draw) >> np.uint64(11)).astype(np.float64) * 2.0**-53).astype(np.int64)
        below = at < count
        np.minimum.at(times, owner[below] * slots + slot[below], time[below])
        point += np.uint64(1)
        go = time <= times.reshape(-1, slots).max(axis=1)[owner]
        seed, count, owner, low, width, time = (x[go] for x in (seed, count, owner, low, width, time))
    return times.reshape(len(bags), slots)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard likeness of two bags; 1 for two empty ones."""
    total = int(a[1].sum() + b[1].sum())
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (total - both) if total else 1.0


def text_key(text: F.Column) -> F.Column:
    """16 bytes of a cryptographic hash: equal for equal texts only."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def sign(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int) -> DataFrame:
    """(id, row, key, bands) of each row; bands null for a text without words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    numbered = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), text.alias("text"), text_key(text).alias("key"))
    kind = numbered.schema["id"].dataType.simpleString()

    def signed(part: dict[str, list]) -> dict[str, object]:
        bags = [bag(t) for t in part["text"]]
        bits = signatures(bags, bands * rows).view(np.uint64).reshape(len(bags), bands, rows)
        out = np.zeros((len(bags), bands), np.uint64)
        for k in range(rows):
            out = mix(out + bits[:, :, k] + STEP)
        return {"id": part["id"], "row": part["row"], "key": part["key"], "bands": [v if len(e) else None for v, (e, _) in zip(out.view(np.int64), bags)]}

    return map_rows(numbered, signed, f"id {kind}, row long, key binary, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b) of text keys with the likeness of their bags; texts: (key, text), a row per key."""
    both = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")

    def compared(part: dict[str, list]) -> dict[str, object]:
        bags = {t: bag(t) for t in {*part["text_a"], *part["text_b"]}}
        return {"a": part["a"], "b": part["b"], "likeness": [overlap(bags[x], bags[y]) for x, y in zip(part["text_a"], part["text_b"])]}

    return map_rows(both, compared, "a binary, b binary, likeness double")


def overlapping(apart: DataFrame, texts: DataFrame, likeness: float) -> DataFrame:
    """Pairs (a, b) of keys in different components that may reach the likeness, each once.

    apart: (band, hash, node, leader, label). Two bags of n and m shingles that
    reach likeness t share at least t (n + m) / (1 + t). So, in any common order of
    all shingles, they share one among the first n - t n + 1 of each, at places behind
    which enough of both is left. Rare shingles come first in the order used here:
    those an edit has made are in no other text, and a text with too many of them for
    any link meets no other one. Of two texts in different components one is not in
    the component of their bucket's leader; only pairs with such a text are looked for.
    """
    led = apart.filter(F.col("node") == F.col("leader")).select("band", "hash", F.col("label").alias("led"))
    nodes = apart.join(led, ["band", "hash"]).groupBy("node").agg(F.first("label").alias("label"), F.max(F.col("label") != F.col("led")).alias("out"))

    def bagged(part: dict[str, list]) -> dict[str, object]:
        tokens = []
        for text in part["text"]:
            shingles, counts = bag(text)
            # The second occurrence of a shingle is a shingle of its own, and so on.
            again = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            tokens.append(mix(np.repeat(shingles, counts) + STEP * again.astype(np.uint64)).view(np.int64))
        return {"node": part["node"], "label": part["label"], "out": part["out"], "tokens": tokens}

    wanted = texts.withColumnRenamed("key", "node").join(nodes, "node").select("node", "label", "out", "text")
    bags = cut_lineage(map_rows(wanted, bagged, "node binary, label binary, out boolean, tokens array<long>"))
    tokens = bags.select("node", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("often"))
    place = F.row_number().over(W.partitionBy("node").orderBy("often", "token")) - 1
    first = F.col("n") - F.ceil(F.col("n") * likeness - 1e-9) + 1
    placed = tokens.join(often, "token").withColumn("place", place).filter((F.col("place") < first) & (F.col("often") > 1))
    prefix = cut_lineage(placed.join(bags.select("node", "label", "out"), "node").select("token", "node", "label", "out", "place", "n"))
    x, y = prefix.filter("out").alias("x"), prefix.alias("y")
    needed = (F.col("x.n") + F.col("y.n")) * (likeness / (1 + likeness)) - 1e-9
    enough = (F.col("x.n") - F.col("x.place") >= needed) & (F.col("y.n") - F.col("y.place") >= needed)
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.label") != F.col("y.label")) & enough)
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", likeness: float = LIKENESS, bands: int = BANDS, rows: int = ROWS, with_key: bool = False) -> DataFrame:
    """(id, class_id, class_size, kept) of each row: its class of near duplicates, the class's least id, one row kept.

    Classes are the connected components of links of at least the likeness. Equal
    texts are one node from the start, however many there are. Within a bucket of a
    band every text is compared with its leader, the member that shares most buckets
    with others: of near copies that is the one the others were made from. Where
    members stay apart, the leader of those is compared in the same way. For what is
    then still apart an exact prefix join finds the pairs that may be links (see
    overlapping). So no link between bucket mates is lost, and neither a group of
    near copies nor one of texts not quite near enough is compared pair by pair.

    Null texts count as empty; empty texts and texts without words are alike only to
    equal ones. Repeated rows are copies of each other; of rows with one least id one is
    kept. Null ids are in the classes of their texts but give class_id only where a
    class has no other. Other columns are not read; an empty table gives no rows.
    with_key adds the text's key.
    """
    signed = cut_lineage(sign(docs, id_col, text_col, bands, rows))
    nodes = signed.filter(F.col("bands").isNotNull()).groupBy("key").agg(F.first("bands").alias("bands"))
    members = nodes.select(F.col("key").alias("node"), F.posexplode("bands").alias("band", "hash"))
    buckets = members.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = cut_lineage(members.join(buckets, ["band", "hash"]))
    weights = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    mates = cut_lineage(shared.drop("n").join(weights, "node"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Texts go by their key at every size: whether their keys are few must not change the plan.
    wanted = mates.select(F.col("node").alias("key")).distinct().hint("shuffle_merge")
    texts = cut_lineage(docs.select(text_key(text).alias("key"), text.alias("text")).join(wanted, "key", "left_semi").dropDuplicates(["key"]))

    leaders = mates.groupBy("band", "hash").agg(F.max(F.struct("weight", "node")).alias("lead")).select("band", "hash", F.col("lead.node").alias("leader"))
    mates = cut_lineage(mates.join(leaders, ["band", "hash"]))
    pairs = cut_lineage(mates.filter("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct())
    first = cut_lineage(verified(pairs, texts))
    labels = components(first.filter(F.col("likeness") >= likeness))

    def labelled() -> DataFrame:
        """Bucket mates and leaders with the components they are in by now; buckets all in one component are done."""
        own = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        rows = mates.join(own, mates.node == own._n, "left").withColumn("label", F.coalesce("_l", "node")).drop("_n", "_l")
        several = rows.groupBy("band", "hash").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least <> most").select("band", "hash")
        return cut_lineage(rows.join(several, ["band", "hash"], "left_semi"))

    def joined(found: DataFrame) -> DataFrame:
        return components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(found))

    apart = labelled()
    if not apart.isEmpty():
        led = apart.filter(F.col("node") == F.col("leader")).select("band", "hash", F.col("label").alias("led"))
        others = apart.join(led, ["band", "hash"]).filter("label <> led").groupBy("band", "hash").agg(F.max(F.struct("weight", "node", "label")).alias("lead"))
        more = apart.join(others, ["band", "hash"]).filter("label <> lead.label").select(F.col("node").alias("a"), F.col("lead.node").alias("b")).distinct()
        second = cut_lineage(verified(more.join(pairs, ["a", "b"], "left_anti"), texts))
        labels = joined(second.filter(F.col("likeness") >= likeness).select("a", "b"))
        done = pairs.union(second.select("a", "b"))
        rest = overlapping(labelled(), texts, likeness).join(done, ["a", "b"], "left_anti").join(done.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
        third = cut_lineage(verified(rest, texts).filter(F.col("likeness") >= likeness).select("a", "b"))
        if not third.isEmpty():
            labels = joined(third)

    placed = signed.select("id", "row", "key").join(labels.withColumnRenamed("node", "key"), "key", "left").select("id", "row", "key", F.coalesce("label", "key").alias("class"))
    heads = placed.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("head"), F.count(F.lit(1)).alias("class_size"))
    return placed.join(heads, "class").select(
        F.col("id").alias(id_col), F.col("head.id").alias("class_id"), "class_size", (F.col("row") == F.col("head.row")).alias("kept"),
        *(["key"] if with_key else []),
    )


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of docs that near_duplicates keeps, with all their columns; of rows equal in id and text one."""
    kept = near_duplicates(docs, id_col, text_col, with_key=True, **settings).filter("kept").select(F.col(id_col).alias("_id"), F.col("key").alias("_k"))
    # Rows travel as one column, whatever their own columns are called.
    keyed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(f"`{id_col}`").alias("_own"), text_key(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("_key")
    )
    found = keyed.join(kept, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_k")), "left_semi")
    return found.dropDuplicates(["_own", "_key"]).select("_row.*")
