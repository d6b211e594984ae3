"""Quality classifier by co-training of two views of a document.

The content view sees which words, beginnings of words and signs occur in the text
and, in steps, how often; the metadata view sees
language, source and layout (lengths, lines, shares of kinds of characters,
repetition) but no word. Each view is a logistic regression. It starts from labelled
rows. In each round every view labels all unlabelled rows in their tasks; what it is
confident of, after calibration on held-out labelled rows, joins the training of the
*other* view as sums over those rows: of features by class, and of the gradient and
curvature of their loss, which the next fit adds to that of the labelled rows. In the
end both calibrated views are combined on the held-out rows.

Which words the content view reads is decided by counts over the whole corpus too: those
that differ between the rows that the metadata view labels (or that have labels).

This is done for two targets, high quality and not toxic, which have little in common.
A document is kept where it reaches the cut-offs of both; its score is the product of
the two combined probabilities.
Labels of at most MAX_LABELLED rows are used, those of least hashed id; everything else
covers all rows and whole texts.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from starloom.llm.common import SLICE, map_rows, slices
from starloom.session import cut_lineage

MAX_LABELLED = 8_000  # labelled rows to fit on: four fifths train, one fifth calibrates
SURE = (0.995, 0.99, 0.98)  # by round: calibrated probability from which a view labels for the other
READ = 1 << 13        # words, beginnings and signs that the content view reads at most, the most telling ones
FEWEST, PROOF = 5, 20.0  # rows and chi-square from which a feature can tell something
PLACES = 1 << 20      # hashed words, their beginnings and signs, of which the telling ones are read
BEGINNINGS = (3, 5, 7)  # characters
OFTEN = (2, 4, 8)     # times from which a word, beginning or sign is a feature of its own
CONTENT = READ * (1 + len(OFTEN))
METADATA = 1 << 10    # hashed languages, sources and steps of the layout's measures
LONGEST = 64          # bytes up to which words are hashed together
TARGETS = ("quality", "clean")
WIDTHS = {"content": CONTENT, "metadata": METADATA}

EDGES = re.compile(r"^[^\w]+|[^\w]+$")
BEGUN = zlib.crc32(b"\1")
SIGNS = re.compile(r"[^\w\s.,;:?'\"()-]+")
PUNCTUATION = ".,;:?'\"()-"  # edges of words that are no signs


def word_ids(word: str) -> tuple[int, ...]:
    plain = word.isalnum()
    bare = word.lower() if plain else EDGES.sub("", word).lower()
    data = bare.encode()
    found = [zlib.crc32(data) % PLACES] if bare else []
    if len(data) == len(bare):  # one byte a character: the checksum goes on from beginning to beginning
        at, sum_ = 0, BEGUN
        for k in BEGINNINGS:
            if k >= len(bare):
                break
            sum_, at = zlib.crc32(data[at:k], sum_), k
            found.append(sum_ % PLACES)
    else:
        found += [zlib.crc32(bare[:k].encode(), BEGUN) % PLACES for k in BEGINNINGS if k < len(bare)]
    return tuple(found) if plain else tuple(found + [zlib.crc32(b"\0" + x.encode()) % PLACES for x in SIGNS.findall(word)])


def checksum_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CHECKSUM = checksum_table()


def checksums(data: np.ndarray, start: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """zlib.crc32(data[start:start + size], first) of many short strings at once, a byte of each at a time."""
    order = np.argsort(-size, kind="stable")
    at, sums = start[order], ~first[order]
    left = len(size) - np.cumsum(np.bincount(size)) if len(size) else []  # strings of more than j bytes
    for j, m in enumerate(left[:-1]):
        sums[:m] = CHECKSUM[(sums[:m] ^ data[at[:m] + j]) & 255] ^ (sums[:m] >> 8)
    out = np.empty_like(sums)
    out[order] = ~sums
    return out


def places_of(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, place) of all word_ids of the words, by word.

    Words of letters and digits within punctuation are hashed together, the others by word_ids.
    """
    bare = pc.utf8_trim(words, characters=PUNCTUATION)
    plain = pc.and_(pc.utf8_is_alnum(bare), pc.less_equal(pc.binary_length(bare), LONGEST))
    # Python lowers these by their neighbours or to two characters.
    plain = pc.and_not(plain, pc.match_substring_regex(bare, "[\u0130\u03a3]")).to_numpy(zero_copy_only=False)
    own = np.flatnonzero(plain)
    lower = pc.utf8_lower(bare.take(pa.array(own)))
    data = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), lower), "").cast(pa.binary())[0].as_buffer(), np.uint8)
    size = pc.binary_length(lower).to_numpy().astype(np.int64)
    start = np.cumsum(size) - size
    chars = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # where characters begin
    length = pc.utf8_length(lower).to_numpy().astype(np.int64)
    first = np.cumsum(length) - length
    found = [(own, checksums(data, start, size, np.zeros(len(own), np.uint32)))]
    at, sums = np.zeros(len(own), np.int64), np.full(len(own), BEGUN, np.uint32)
    for k in BEGINNINGS:  # the checksum goes on from beginning to beginning
        longer = np.flatnonzero(length > k)
        end = chars[first[longer] + k] - start[longer]
        sums[longer] = checksums(data, start[longer] + at[longer], end - at[longer], sums[longer])
        at[longer] = end
        found.append((own[longer], sums[longer]))
    odd = np.flatnonzero(~plain)
    hashed = [word_ids(w) for w in words.take(pa.array(odd)).to_numpy(zero_copy_only=False)]
    found.append((np.repeat(odd, [len(h) for h in hashed]), np.array([p for h in hashed for p in h], np.int64)))
    word, place = (np.concatenate([f[k] for f in found]).astype(np.int64) for k in (0, 1))
    order = np.argsort(word, kind="stable")
    return word[order], place[order] % PLACES


@dataclass
class Words:
    """Words of some texts: the different ones (the empty one may be among them), and of each occurrence the word's number and the text."""

    words: pa.StringArray
    token: np.ndarray
    owner: np.ndarray
    texts: list[str]

    @staticmethod
    def of(texts: list[str | None]) -> Words:
        texts = [t or "" for t in texts]
        split = pc.utf8_split_whitespace(pa.array(texts, pa.string()))
        coded = split.flatten().dictionary_encode()
        return Words(coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(texts)), split.value_lengths().to_numpy()), texts)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(word, text), once for each."""
        both = np.unique(self.owner * len(self.words) + self.token)
        return both % len(self.words), both // len(self.words)

    def per_text(self) -> np.ndarray:
        """Of each text its words, their characters, those in upper case and the different ones."""
        size = pc.utf8_length(self.words).to_numpy()
        upper = np.fromiter(map(str.isupper, self.words.to_numpy(zero_copy_only=False)), bool, len(size))
        word, text = self.pairs()
        add = lambda owner, weights: np.bincount(owner, weights=weights, minlength=len(self.texts)).astype(np.int64)
        return np.stack([add(self.owner, (size > 0)[self.token]), add(self.owner, size[self.token]), add(self.owner, upper[self.token]), add(text, (size > 0)[word])], axis=1)


def content_ids(told: Words, read: np.ndarray) -> Sparse:
    """Words, beginnings of words and sign runs of each text, of those that are read, with the steps of their counts.

    read: the number of each hashed place, -1 if it isn't read. A feature's number is
    that of its place times four, plus the step.
    """
    words, token, owner = told.words, told.token, told.owner
    word, place = places_of(words)
    number = read[place].astype(np.int64)
    word, number = word[number >= 0], number[number >= 0]
    width = np.bincount(word, minlength=len(words))
    begin = np.cumsum(width) - width
    seen = width[token] > 0
    token, owner = token[seen], owner[seen]
    times = width[token]
    at = np.repeat(begin[token] - (np.cumsum(times) - times), times) + np.arange(times.sum())
    ids, count = np.unique(number[at] + np.repeat(owner * READ, times), return_counts=True)
    steps = 1 + len(OFTEN)
    ids = np.sort(np.concatenate([ids * steps, *(ids[count >= k] * steps + n for n, k in enumerate(OFTEN, 1))]))
    return Sparse((ids % CONTENT).astype(np.int32), np.bincount(ids // CONTENT, minlength=len(told.texts)))


KNOWN_SIGNS: dict[str, bool] = {}


def sign_chars(text: str) -> int:
    """Characters that SIGNS matches."""
    total = 0
    for c in set(text):
        sign = KNOWN_SIGNS.get(c)
        if sign is None:
            sign = KNOWN_SIGNS[c] = SIGNS.fullmatch(c) is not None
        if sign:
            total += text.count(c)
    return total


def metadata_ids(lang: str | None, source: str | None, text: str, words: int, letters: int, upper: int, types: int) -> list[int]:
    """Hashed language, source and steps of the layout's measures; words and what follows: as told by Words.per_text."""
    n = len(text) or 1
    lines = text.split("\n")
    letters = letters or 1
    signs = sign_chars(text)
    digits = sum(map(text.count, "0123456789"))
    measures = {
        "chars": math.log2(n), "words": math.log2(words + 1), "lines": math.log2(len(lines)),
        "line": math.log2(n / len(lines) + 1), "word": letters / (words or 1),
        "upper": 10 * (upper / (words or 1)), "signs": min(20.0, 40 * signs / letters), "digits": min(20.0, 40 * digits / letters),
        "types": 10 * types / (words or 1), "same_lines": 10 * len(set(lines)) / len(lines),
    }
    named = [f"lang={lang}", f"source={source}", *(f"{k}={round(v)}" for k, v in measures.items())]
    return [zlib.crc32(x.encode()) % METADATA for x in named]


@dataclass
class Sparse:
    """Rows of distinct feature numbers."""

    ids: np.ndarray
    sizes: np.ndarray

    @staticmethod
    def of(rows: list) -> Sparse:
        return Sparse(np.concatenate([np.asarray(r, np.int32) for r in rows]) if rows else np.zeros(0, np.int32), np.array([len(r) for r in rows], np.int64))

    def rows(self) -> list[np.ndarray]:
        return np.split(self.ids, np.cumsum(self.sizes)[:-1])

    def take(self, chosen: np.ndarray) -> Sparse:
        ends = np.cumsum(self.sizes)
        return Sparse.of([self.ids[ends[i] - self.sizes[i]:ends[i]] for i in chosen])

    def dot(self, weights: np.ndarray) -> np.ndarray:
        out, ends = np.zeros(len(self.sizes)), np.cumsum(self.sizes)
        for at in range(0, len(out), 1000):  # rows at a time, for the memory
            sizes = self.sizes[at:at + 1000]
            own = self.ids[ends[at] - sizes[0]:ends[at + len(sizes) - 1]]
            out[at:at + 1000] = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=weights[own], minlength=len(sizes))
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Sums:
    """What pseudo-labelled rows say about a view's weights: per class (bad, good) the rows, and per
    feature (the offset last) their count, gradient and curvature at the weights `at`."""

    rows: np.ndarray
    each: np.ndarray  # (class, count / gradient / curvature, feature)
    at: np.ndarray


def telling(inside: np.ndarray, total: np.ndarray, n_good: float, n: float) -> np.ndarray:
    """Whether features' presence and the class depend on each other beyond chance (one degree of freedom).

    Of a million words many would fit the training rows by accident.
    """
    spread = total * (n - total) * float(n_good) * (n - n_good)
    return (total >= FEWEST) & (n * (inside * n - total * n_good) ** 2 >= PROOF * np.maximum(spread, 1))


def fit(rows: Sparse, good: np.ndarray, width: int, sums: Sums | None = None, steps: int = 80, ridge: float = 0.05) -> np.ndarray:
    """Weights of a logistic regression with balanced classes, the last one the offset.

    sums: of pseudo-labelled rows, whose loss enters as a quadratic about the weights it
    was taken at, with no more weight than the labelled rows. Features that tell nothing
    in either weigh nothing.
    """
    owner = np.repeat(np.arange(len(rows.sizes), dtype=np.int32), rows.sizes)
    n = len(good)
    used = telling(np.bincount(rows.ids[good[owner]], minlength=width).astype(float), np.bincount(rows.ids, minlength=width), good.sum(), n)
    part, pull, bend = 0.0, 0.0, 0.0
    if sums is not None and sums.rows.min() >= FEWEST:
        count = sums.each[:, 0, :-1]
        used |= telling(count[1], count.sum(axis=0), sums.rows[1], sums.rows.sum())
        part = min(0.5, sums.rows.sum() / (sums.rows.sum() + n))
        pull, bend = (part * 0.5 * (sums.each[:, k] / sums.rows[:, None]).sum(axis=0) for k in (1, 2))
    kept = used[rows.ids]
    ids, owner = rows.ids[kept], owner[kept]
    share = (1 - part) * np.where(good, 0.5 / max(good.sum(), 1), 0.5 / max((~good).sum(), 1))
    idle = np.append(~used, False)
    w, speed, square = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        z = np.bincount(owner, weights=w[ids], minlength=n) + w[-1]
        rest = (sigmoid(z) - good) * share
        g = np.append(np.bincount(ids, weights=rest[owner], minlength=width), rest.sum()) + ridge * w / n
        if part:
            g += pull + bend * (w - sums.at)
        g[idle] = 0
        speed, square = 0.9 * speed + 0.1 * g, 0.99 * square + 0.01 * g * g
        w -= 0.15 * (speed / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-7)
    return w


def calibrate(x: np.ndarray, good: np.ndarray, steps: int = 50) -> np.ndarray:
    """Coefficients of a small logistic regression on dense columns, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w += np.linalg.solve(hess, x.T @ (good - p) - 1e-2 * w)
    return w


def views_of(content: Sparse, metadata: Sparse, model: dict) -> np.ndarray:
    z = np.column_stack([content.dot(model["content"][:-1]) + model["content"][-1], metadata.dot(model["metadata"][:-1]) + model["metadata"][-1]])
    return np.clip(z, -12, 12)


def combined(z: np.ndarray, model: dict) -> np.ndarray:
    """Both views' calibrated log-odds and the lower of the two, joined to a probability."""
    own = np.column_stack([z[:, k] * model["own"][k][0] + model["own"][k][1] for k in range(2)])
    x = np.column_stack([own, own.min(axis=1), np.ones(len(own))])
    return sigmoid(x @ model["joint"])


def fitted(name: str, rows: Sparse, good: np.ndarray, sums: Sums | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A view's weights and its calibration, for which every fifth row is held out."""
    held = np.arange(len(good)) % 5 == 4
    w = fit(rows.take(np.flatnonzero(~held)), good[~held], WIDTHS[name], sums)
    z = np.clip(rows.take(np.flatnonzero(held)).dot(w[:-1]) + w[-1], -12, 12)
    return w, calibrate(z[:, None], good[held].astype(float))


def finished(model: dict, content: Sparse, metadata: Sparse, good: np.ndarray) -> dict:
    """The model with its views combined, and the cut-off, on the held-out rows."""
    hold = np.flatnonzero(np.arange(len(good)) % 5 == 4)
    z = views_of(content.take(hold), metadata.take(hold), model)
    own = np.column_stack([z[:, k] * model["own"][k][0] + model["own"][k][1] for k in range(2)])
    model["joint"] = calibrate(np.column_stack([own, own.min(axis=1)]), good[hold].astype(float))
    model["threshold"] = cut_off(combined(z, model), good[hold])
    return model


def added(model: dict, content: Sparse, metadata: Sparse, sure: float) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of unlabelled rows, for each view what the *other* one is sure of: rows per class, and features with
    their counts, gradients and curvatures per class."""
    z = views_of(content, metadata, model)
    out = {}
    for k, (name, rows) in enumerate((("content", content), ("metadata", metadata))):
        teacher = sigmoid(z[:, 1 - k] * model["own"][1 - k][0] + model["own"][1 - k][1])
        label = np.where(teacher >= sure, 1, np.where(teacher <= 1 - sure, 0, -1))
        owner = np.repeat(np.arange(len(rows.sizes)), rows.sizes)
        chosen = label[owner] >= 0
        ids, owner = rows.ids[chosen], owner[chosen]
        # The offset is a feature of every row.
        every = np.flatnonzero(label >= 0)
        ids, owner = np.append(ids, np.full(len(every), WIDTHS[name])), np.append(owner, every)
        p = sigmoid(z[:, k])
        names, at = np.unique(ids, return_inverse=True)
        place = label[owner] * len(names) + at
        values = [np.bincount(place, weights=v[owner], minlength=2 * len(names)).reshape(2, -1) for v in (np.ones(len(p)), p - label, p * (1 - p))]
        out[name] = np.bincount(label[every], minlength=2), names, np.stack(values, axis=1), every
    return out


def gathered(parts: list, model: dict, name: str) -> Sums:
    """Sums of a view from parts (rows per class, features, values)."""
    rows, each = np.zeros(2), np.zeros((2, 3, WIDTHS[name] + 1))
    for count, names, values in parts:
        rows += count
        each[:, :, names] += values
    return Sums(rows, each, model[name])


def cut_off(p: np.ndarray, good: np.ndarray) -> float:
    """The probability from which fewest of the rows are judged wrongly, good ones lost and bad ones kept together.

    Cuts lie halfway, in log-odds, between neighbouring rows or at even odds. Of those that differ from
    the best by no more than the standard error of its count the nearest to even odds is taken, so that a few odd
    rows do not move it.
    """
    order = np.argsort(p, kind="stable")
    good = good[order]
    z = np.log(np.clip(p[order], 1e-9, 1 - 1e-9))
    z = z - np.log1p(-np.exp(z))
    cuts = np.unique(np.r_[0.0, (z[1:] + z[:-1]) / 2])
    below = np.searchsorted(z, cuts)  # rows below each cut
    lost = np.r_[0, np.cumsum(good)][below]
    kept = (~good).sum() - np.r_[0, np.cumsum(~good)][below]
    wrong = lost + kept
    best = cuts[wrong <= wrong.min() + math.sqrt(wrong.min() + 1)]
    return float(sigmoid(best[np.argmin(np.abs(best))]))


FIELDS = ("id", "text", "lang", "source")


def sample(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """The bounded labelled rows: (id, text, lang, source, quality, clean), the labels null where unknown."""
    known = labels.filter(F.col("id").isNotNull() & (F.col("quality").isNotNull() | F.col("toxic").isNotNull()))
    known = known.groupBy("id").agg(F.min(F.col("quality") == 1).alias("quality"), F.min(F.col("toxic") == 0).alias("clean"))
    ids = docs.select("id").filter("id is not null").distinct()
    first = known.join(ids, "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(max_labelled)  # at most so many ids
    rows = docs.join(F.broadcast(first), "id")
    # A document that occurs several times counts once: the row of least hash.
    return rows.groupBy("id").agg(F.min_by(F.struct("text", "lang", "source", *TARGETS), F.xxhash64("text", "lang", "source")).alias("row")).select("id", "row.*")


def metadata_of(part: dict[str, list], told: Words) -> list[list[int]]:
    return [sorted(set(metadata_ids(*row, *counts))) for *row, counts in zip(part["lang"], part["source"], told.texts, told.per_text().tolist())]


def word_counts(docs: DataFrame, sampled, starts) -> DataFrame:
    """(target, place, good, bad): in how many rows per class the words of each hashed place occur.

    Rows of sampled (id: labels by target) count by their labels, others by what the
    metadata view of a target is sure of. A task sums up before it tells.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, models = sampled.value, starts.value
        sums = np.zeros((len(TARGETS), 2, PLACES), np.int32)
        rows = np.zeros((len(TARGETS), 2), np.int64)
        for part in slices(batches):
            words = Words.of(part["text"])
            meta = Sparse.of(metadata_of(part, words))
            label = np.full((len(part["id"]), len(TARGETS)), -1)
            for t, target in enumerate(TARGETS):
                if target in models:
                    w, own = models[target]
                    p = sigmoid(np.clip(meta.dot(w[:-1]) + w[-1], -12, 12) * own[0] + own[1])
                    label[:, t] = np.where(p >= SURE[-1], 1, np.where(p <= 1 - SURE[-1], 0, -1))
            for row, key in enumerate(part["id"]):
                if key in labels:
                    label[row] = [-1 if v is None or target not in models else int(v) for target, v in zip(TARGETS, labels[key])]
            # A word counts once a row, a place once a word.
            token, owner = words.pairs()
            word, place = places_of(words.words)
            both = np.unique(word * PLACES + place)
            word, place = both // PLACES, both % PLACES
            for t in range(len(TARGETS)):
                for c in (0, 1):
                    rows[t, c] += np.count_nonzero(label[:, t] == c)
                    times = np.bincount(token[label[owner, t] == c], minlength=len(words.words)).astype(np.int32)
                    np.add.at(sums[t, c], place, times[word])
        for t in range(len(TARGETS)):
            places = np.flatnonzero(sums[t].any(axis=0))
            columns = [np.full(len(places) + 1, t), np.append(places, -1), *(np.append(sums[t, c, places], rows[t, c]) for c in (1, 0))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["target", "place", "good", "bad"])

    counted = docs.select(*FIELDS).mapInArrow(run, "target bigint, place bigint, good bigint, bad bigint")
    return counted.groupBy("target", "place").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))


def words_to_read(counts: DataFrame) -> np.ndarray:
    """Numbers of the places whose words tell something about a target, -1 elsewhere: at most READ, those of the highest chi-square."""
    counts = cut_lineage(counts)
    rows = counts.filter("place < 0").select("target", F.col("good").alias("g"), F.col("bad").alias("b"))  # a row per target
    n, k = (F.col("g") + F.col("b")).cast("double"), (F.col("good") + F.col("bad")).cast("double")
    spread = F.greatest(k * (n - k) * F.col("g") * F.col("b"), F.lit(1.0))
    proof = n * F.pow(F.col("good") * n - k * F.col("g"), F.lit(2.0)) / spread
    found = counts.filter("place >= 0").join(F.broadcast(rows), "target").withColumn("proof", proof).filter((k >= FEWEST) & (F.col("proof") >= PROOF))
    best = found.groupBy("place").agg(F.max("proof").alias("proof")).orderBy(F.desc("proof"), "place").limit(READ)
    read = np.full(PLACES, -1, np.int32)
    chosen = sorted(r.place for r in best.select("place").collect())
    read[chosen] = np.arange(len(chosen))
    return read


def features(rows: DataFrame, read, more: str = "") -> DataFrame:
    """rows (id, text, lang, source and the columns in more, a schema) as (content, metadata, more)."""
    names = [c.split(" ")[0] for c in more.split(", ") if c]

    def made(part: dict[str, list]) -> dict[str, object]:
        words = Words.of(part["text"])
        return {"content": content_ids(words, read.value).rows(), "metadata": metadata_of(part, words)} | {c: part[c] for c in names}

    return map_rows(rows, made, "content array<int>, metadata array<int>" + (f", {more}" if more else ""))


def sparse(column) -> Sparse:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return Sparse(column.flatten().to_numpy(), column.value_lengths().to_numpy().astype(np.int64))


def exchange(rows: DataFrame, models: dict, sampled, sure: float) -> dict[str, dict[str, Sums]]:
    """By target and view, the sums over all rows (id, content, metadata) outside the sample that the other view is sure of."""
    shared = rows.sparkSession.sparkContext.broadcast(slim(models))
    sides = [(t, v) for t in models for v in WIDTHS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        total = {k: (np.zeros(2), np.zeros((2, 3, WIDTHS[k[1]] + 1), np.float32)) for k in sides}
        for batch in batches:
            known = pa.array([k not in sampled.value for k in batch.column(0).to_pylist()])
            batch = batch.filter(known)
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                content, metadata = sparse(part.column(1)), sparse(part.column(2))
                for target in model:
                    for view, (count, names, values, _) in added(model[target], content, metadata, sure).items():
                        own = total[target, view]
                        own[0][:] += count
                        own[1][:, :, names] += values
        for side, (count, each) in enumerate(total[k] for k in sides):
            places = np.flatnonzero(each[:, 0].any(axis=0))
            columns = [np.full(len(places) + 1, side), np.append(places, -1)] + [np.append(each[c, k, places], count[c] if k == 0 else 0) for c in (0, 1) for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 2 else pa.float64()) for k, c in enumerate(columns)], names=SUMMED)

    told = rows.select("id", "content", "metadata").mapInArrow(run, "side bigint, place bigint, " + ", ".join(f"{c} double" for c in SUMMED[2:]))
    # A row per side and feature: the words that are read, their steps and the metadata's places.
    found = told.groupBy("side", "place").agg(*(F.sum(c).alias(c) for c in SUMMED[2:])).toArrow()
    out: dict[str, dict[str, Sums]] = {t: {} for t in models}
    for side, (target, view) in enumerate(sides):
        own = found.filter(pc.equal(found["side"], side))
        place = own["place"].to_numpy()
        values = np.stack([own[c].to_numpy() for c in SUMMED[2:]]).reshape(2, 3, -1)
        inside = place >= 0
        out[target][view] = gathered([(values[:, 0, ~inside].sum(axis=1), place[inside], values[:, :, inside])], models[target], view)
    return out


SUMMED = ["side", "place", *(f"{k}{c}" for c in (0, 1) for k in ("n", "g", "h"))]


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[dict, DataFrame, object] | None:
    """(a model per target, the rows of docs as features, what the content view reads).

    Targets without five labelled rows of either kind are left out; None where none is left.
    """
    sc = docs.sparkSession.sparkContext
    rows = cut_lineage(sample(docs, labels, max_labelled))
    told = map_rows(rows, lambda part: {"metadata": metadata_of(part, Words.of(part["text"]))} | {c: part[c] for c in ("id", *TARGETS)}, f"metadata array<int>, id {rows.schema['id'].dataType.simpleString()}, quality boolean, clean boolean").toArrow()
    ids = told["id"].to_pylist()
    # In the order of a hash, so that every fifth is a fair sample.
    order = sorted(range(len(ids)), key=lambda k: (zlib.crc32(str(ids[k]).encode()), str(ids[k])))
    metadata = sparse(told["metadata"]).take(np.array(order, np.int64))
    given = {t: told[t].to_pylist() for t in TARGETS}
    marks = {t: [given[t][k] for k in order] for t in TARGETS}
    known = {t: np.flatnonzero([m is not None for m in marks[t]]) for t in TARGETS}
    goods = {t: np.array([bool(marks[t][k]) for k in known[t]], dtype=bool) for t in TARGETS}
    targets = [t for t in TARGETS if min(goods[t].sum(), (~goods[t]).sum()) >= 5]
    if not targets:
        return None
    models: dict[str, dict] = {t: {"exchanged": []} for t in targets}
    for t in targets:
        models[t]["metadata"], own = fitted("metadata", metadata.take(known[t]), goods[t])
        models[t]["own"] = [None, own]
    sampled = sc.broadcast({ids[k]: tuple(marks[t][n] for t in TARGETS) for n, k in enumerate(order)})
    read = sc.broadcast(words_to_read(word_counts(docs, sampled, sc.broadcast({t: (models[t]["metadata"], models[t]["own"][1]) for t in targets}))))
    kind = f"id {rows.schema['id'].dataType.simpleString()}"
    mine = features(rows, read, kind).select("id", "content").toArrow()
    at = {k: n for n, k in enumerate(mine["id"].to_pylist())}
    content = sparse(mine["content"]).take(np.array([at[ids[k]] for k in order], np.int64))
    views = {"content": content, "metadata": metadata}
    for t in targets:
        models[t]["content"], models[t]["own"][0] = fitted("content", content.take(known[t]), goods[t])
    every = cut_lineage(features(docs, read, kind))
    for sure in SURE:
        sums = exchange(every, models, sampled, sure)
        for t in targets:
            models[t]["exchanged"].append({v: sums[t][v].rows.tolist() for v in views})
            for k, v in enumerate(views):
                models[t][v], models[t]["own"][k] = fitted(v, views[v].take(known[t]), goods[t], sums[t][v])
    for t in targets:
        finished(models[t], content.take(known[t]), metadata.take(known[t]), goods[t])
    return models, every, read


def slim(models: dict) -> dict:
    """The models with single-precision weights: CONTENT + METADATA of each."""
    return {t: {k: v.astype(np.float32) if k in ("content", "metadata") else v for k, v in m.items()} for t, m in models.items()}


def scores(models: dict, content: Sparse, metadata: Sparse) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Products over the targets of both views' calibrated probabilities and of the combined ones; whether all cut-offs are reached."""
    n = len(metadata.sizes)
    own, whole, kept = [np.ones(n), np.ones(n)], np.ones(n), np.ones(n, bool)
    for model in models.values():
        z = views_of(content, metadata, model)
        own = [v * sigmoid(z[:, k] * model["own"][k][0] + model["own"][k][1]) for k, v in enumerate(own)]
        p = combined(z, model)
        whole, kept = whole * p, kept & (p >= model["threshold"])
    return own, whole, kept


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(id, content_score, metadata_score, score, kept) of each row.

    labels: (id, quality, toxic); null labels say nothing, of several labels of one id
    the worst counts, labels of unknown ids are ignored. The two views' scores are
    calibrated probabilities of a good document, score combines them, kept says
    whether quality and toxicity both reach their cut-offs. A target without enough labels
    of both kinds rejects nothing; without any target scores are null. Null texts count as empty, null languages and sources
    are values of their own; repeated rows and null ids are scored like others; other
    columns are not read; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"))
    learned = train(rows, labels.select(F.col(id_col).alias("id"), "quality", "toxic"), max_labelled)
    none = F.lit(None).cast("double")
    if learned is None:
        return rows.select(F.col("id").alias(id_col), none.alias("content_score"), none.alias("metadata_score"), none.alias("score"), F.lit(True).alias("kept"))
    models, every, _ = learned
    shared = docs.sparkSession.sparkContext.broadcast(slim(models))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                own, p, kept = scores(shared.value, sparse(part.column(1)), sparse(part.column(2)))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in (*own, p, kept))], names=["id", "content_score", "metadata_score", "score", "kept"])

    kind = rows.schema["id"].dataType.simpleString()
    return every.select("id", "content", "metadata").mapInArrow(scored, f"id {kind}, content_score double, metadata_score double, score double, kept boolean").withColumnRenamed("id", id_col)


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of docs that classify keeps, with all their columns; nothing is shuffled."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"))
    learned = train(rows, labels.select(F.col(id_col).alias("id"), "quality", "toxic"), max_labelled)
    if learned is None:
        return docs
    models, _, read = learned
    shared = docs.sparkSession.sparkContext.broadcast(slim(models))
    names = docs.columns

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                told = {c: [None if v is None else str(v) for v in part.column(names.index(col)).to_pylist()] for c, col in (("text", text_col), ("lang", lang_col), ("source", source_col))}
                words = Words.of(told["text"])
                found = content_ids(words, read.value), Sparse.of(metadata_of(told, words))
                yield part.filter(pa.array(scores(shared.value, *found)[2]))

    return docs.mapInArrow(kept, docs.schema)
