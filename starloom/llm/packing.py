"""Best-fit decreasing packing of token pieces into sequences.

Which bin a piece goes to depends on nothing but its length and the bins open at
that time, so best-fit decreasing is run on the *numbers of pieces per length*:
at most as many lengths as a sequence has tokens, however many documents there
are. A segment tree over remaining capacities finds the tightest open bin. Bins of
equal history are handled as one run of consecutive numbers. The result, a list of
runs of bins per length whose size depends on the capacity alone, then places every
piece by its position among those of its length, which tasks work out on their own.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from starloom.llm.common import per_process, slices
from starloom.session import cut_lineage

REMEMBERED = 800_000  # words whose ids a worker remembers, and as many parts of words; beyond, it begins anew
LONG = 1 << 24  # characters of words of more than 64 that a worker remembers
JOINED = 256  # words that go to the library in one string
BLANKS = re.compile(r"[ \n\t\r]+")
CONTROLS = re.compile("[\x1c-\x1f]")
LATIN = "\u024f"  # the last sign up to which letters have the same lower case everywhere


def words_of(text: str | None) -> list[str]:
    """The text without white space; the few signs that only Python takes for white space stay."""
    if not text:
        return []
    return BLANKS.sub(" ", text).split(" ") if CONTROLS.search(text) else text.split()


class Encoder:
    """Ids of words, from a tokenizers file whose vocabulary drops white space.

    Words are remembered, and so are the parts that the file's own pattern cuts them
    into: different words share most of their parts. Only parts not seen before go to
    the library, many in one string, from which they are told apart by their places.
    """

    def __init__(self, path: str) -> None:
        import json
        import os

        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {}
        self.long = 0  # characters of the long words among them
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        steps = (stored.get("normalizer") or {}).get("normalizers", [])
        cuts = (stored.get("pre_tokenizer") or {}).get("pretokenizers", [])
        # Parts are looked up in lower case; this is what the file does with Latin letters, if it does this.
        plain = [n["type"] for n in steps] == ["NFC", "Replace", "Lowercase"] and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
        plain = plain and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"] and not cuts[1]["use_regex"] and not cuts[1]["add_prefix_space"]
        self.cut = regex.compile(cuts[0]["pattern"]["Regex"]).findall if plain else None
        self.special = re.compile("|".join(re.escape(t["content"]) for t in stored.get("added_tokens", [])) or r"(?!)").search
        suffix = stored["model"].get("end_of_word_suffix")
        self.last = None  # ids that end a part
        if suffix:
            vocabulary = self.library.get_vocab(with_added_tokens=True)
            self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def encoded(self, words: list[str]) -> dict[str, bytes]:
        """Ids of different words from the library, by the places of their tokens."""
        found: dict[str, bytes] = {}
        groups = [words[k : k + JOINED] for k in range(0, len(words), JOINED)]
        for group, e in zip(groups, self.library.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)):
            # A token is in the word in which it begins.
            ends = np.cumsum([len(w) + 1 for w in group])
            self.split(group, np.array(e.ids, np.uint32), np.searchsorted([o[0] for o in e.offsets], ends), found)
        return found

    def encoded_parts(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of parts, each of which ends with the first token that can end one."""
        if self.last is None:
            return self.encoded(parts)
        found: dict[str, bytes] = {}
        groups = [parts[k : k + JOINED] for k in range(0, len(parts), JOINED)]
        for group, e in zip(groups, self.library.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(group):
                self.split(group, ids, ends, found)
            else:
                found.update(self.encoded(group))
        return found

    @staticmethod
    def split(group: list[str], ids: np.ndarray, ends: np.ndarray, found: dict[str, bytes]) -> None:
        data, first = ids.tobytes(), 0
        for word, last in zip(group, (4 * ends).tolist()):
            found[word] = data[first:last]
            first = last

    def learn(self, words: set[str]) -> None:
        """Afterwards self.words has the ids of all these words."""
        if len(self.words) > REMEMBERED or self.long > LONG:
            self.words, self.long = {"": b""}, 0
            self.parts = {}
        if len(self.parts) > REMEMBERED:
            self.parts = {}
        known, parts = self.words, self.parts
        whole, later, missing = [], [], set()
        for word in words.difference(known):
            if len(word) > 64:
                self.long += len(word)
            if self.cut and (word.isascii() or max(word) <= LATIN and is_normalized("NFC", word)) and not self.special(word):
                own = self.cut(word.lower())
                try:
                    known[word] = b"".join([parts[p] for p in own])
                except KeyError:
                    later.append(word)
                    missing.update(own)
            else:
                whole.append(word)
        known.update(self.encoded(whole))
        parts.update(self.encoded_parts(list(missing.difference(parts))))
        for word in later:
            known[word] = b"".join([parts[p] for p in self.cut(word.lower())])


class OpenBins:
    """Runs of open bins by remaining capacity, over a segment tree of which capacities occur."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = bytearray(2 * self.leaves)
        self.runs: dict[int, list[tuple[int, int]]] = {}  # remaining: [(first bin, bins)]

    def add(self, remaining: int, first: int, bins: int) -> None:
        if remaining == 0 or bins == 0:
            return
        self.runs.setdefault(remaining, []).append((first, bins))
        at = self.leaves + remaining
        while at and not self.tree[at]:
            self.tree[at] = 1
            at >>= 1

    def tightest(self, length: int) -> int | None:
        """Least remaining capacity of an open bin that is not below length."""
        # Next set leaf from the leaf of length on: climb until a right sibling is set, then go down leftmost.
        at = self.leaves + length
        if self.tree[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.tree[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None

    def take(self, remaining: int) -> tuple[int, int]:
        runs = self.runs[remaining]
        run = runs.pop()
        if not runs:
            del self.runs[remaining]
            at = self.leaves + remaining
            while at and not (at < self.leaves and (self.tree[2 * at] or self.tree[2 * at + 1])):
                self.tree[at] = 0
                at >>= 1
        return run


def best_fit_decreasing(pieces: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Placements (length, position of its first piece, first bin, pieces per bin, offset) and the number of bins.

    A placement fills its bins one after another until the next placement of the
    same length begins. pieces: number of pieces per length.
    """
    bins, placed, total = OpenBins(capacity), [], 0
    for length in sorted(pieces, reverse=True):
        left, position = pieces[length], 0
        while left:
            remaining = bins.tightest(length)
            if remaining is None:  # no bin fits: a run of new ones, as many as the pieces fill
                remaining, each = capacity, capacity // length
                first, run = total, -(-left // each)
                total += run
            else:
                first, run = bins.take(remaining)
                each = remaining // length
            # Best fit puts the next piece of a length into the bin just used while that still has room.
            full = min(run, left // each)
            rest = left - full * each if full < run else 0
            placed.append((length, position, first, each, capacity - remaining))
            bins.add(remaining - each * length, first, full)
            if rest:
                bins.add(remaining - rest * length, first + full, 1)
            bins.add(remaining, first + full + bool(rest), run - full - bool(rest))
            position += full * each + rest
            left -= full * each + rest
    return placed, total


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most capacity tokens: (id, piece, start, length, ids_crc32, block, place[, ids]).

    tokenizer: path of a tokenizers file; a text's ids, then end_id, are cut where
    they are longer than capacity. (block, place): the task that made the piece and
    its position there among pieces of its length. keep_ids adds the ids themselves.
    A null text counts as empty and gives one piece of end_id alone.

    Words between blanks are tokenized on their own and remembered: the vocabulary
    drops white space and no token reaches across it.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, block int, place long" + (", ids array<long>" if keep_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = per_process("packing", tokenizer, lambda: Encoder(tokenizer))
        block, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end, width = np.uint32(end_id).tobytes(), 4 * capacity
        for part in slices(batches):
            out: dict[str, list] = {name: [] for name in ("id", "piece", "start", "length", "ids_crc32", "block", "place", "ids")}
            texts = [words_of(t) for t in part["text"]]
            encoder.learn(set().union(*texts))
            ids_of = encoder.words.__getitem__
            for doc, words in zip(part["id"], texts):
                data = b"".join(map(ids_of, words)) + end
                for k, at in enumerate(range(0, len(data), width)):
                    ids = data[at:at + width]
                    n = len(ids) // 4
                    out["id"].append(doc)
                    out["piece"].append(k)
                    out["start"].append(at // 4)
                    out["length"].append(n)
                    out["ids_crc32"].append(zlib.crc32(ids))
                    out["block"].append(block)
                    out["place"].append(int(seen[n]))
                    if keep_ids:
                        out["ids"].append(np.frombuffer(ids, np.uint32).astype(np.int64))
                    seen[n] += 1
            names = [f.split(" ")[0] for f in schema.split(", ")]
            if out["id"]:
                kinds = {"id": part_type, "piece": pa.int32(), "block": pa.int32(), "ids": pa.list_(pa.int64())}
                yield pa.RecordBatch.from_arrays([pa.array(out[c], type=kinds.get(c, pa.int64())) for c in names], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    part_type = to_arrow_type(rows.schema["id"].dataType)
    return rows.mapInArrow(cut, schema)


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces with sequence_id and offset in place of (block, place).

    pieces: rows with a length from 1 to capacity and with (block, place) as
    token_pieces gives them; written once, so that a task run again cannot deal
    them otherwise. Every row is placed, copies too; sequences have no gaps. Rows
    of one length may be a third of all: each block places its own.
    """
    spark = pieces.sparkSession
    rows = cut_lineage(pieces)
    blocks = rows.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    # One row per length and task that made pieces; per length there are as many as such tasks.
    before = blocks.select(
        "length", "block",
        (F.sum("n").over(W.partitionBy("length").orderBy("block").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("before"),
    )
    counts = {r["length"]: r["n"] for r in blocks.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    if any(not 1 <= n <= capacity for n in counts):
        raise ValueError(f"pieces must have 1 to {capacity} tokens")
    placed, _ = best_fit_decreasing(counts, capacity)
    table = np.array(placed, np.int64).reshape(-1, 5)
    # Positions of a length below 2^40, lengths below 2^23: one sorted key for both.
    keys = (table[:, 0] << 40) + table[:, 1]
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((keys[order], table[order]))  # its size depends on the capacity alone

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, table = shared.value
        for batch in batches:
            length, position = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "position"))
            row = table[np.searchsorted(keys, (length << 40) + position, side="right") - 1]
            k = position - row[:, 1]
            sequence, offset = row[:, 2] + k // row[:, 3], row[:, 4] + k % row[:, 3] * length
            names = [n for n in batch.schema.names if n != "position"]
            kept = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    kept = [c for c in rows.columns if c not in ("block", "place")]
    positions = rows.join(before, ["length", "block"]).select(*kept, (F.col("before") + F.col("place")).alias("position"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema]
    return positions.mapInArrow(place, ", ".join([*fields, "sequence_id long", "offset long"]))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the pieces' ids one after another; a sequence is bounded by its capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their places: (id, piece, start, length, ids_crc32[, ids], sequence_id, offset).

    Repeated rows are packed as often as they occur, null ids stay null, columns
    other than id and text are not read, an empty table gives no rows.
    """
    pieces = token_pieces(docs, tokenizer, end_id, capacity, keep_ids, id_col, text_col)
    return pack(pieces, capacity).withColumnRenamed("id", id_col)
