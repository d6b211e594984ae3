"""Repeated passages of at least a given number of bytes, found exactly.

Anchors. Of all substrings of K bytes inside any passage of L bytes the one with the
least hash is an anchor. The choice looks at the passage alone, so equal passages
have an anchor at the same place, and about 2 L / (L - K) anchors stand for L bytes.

Enhanced suffix arrays. All occurrences of an anchor meet with the bytes around them.
Their suffixes, sorted, and the lengths of common prefixes of neighbours form an
enhanced suffix array. A scan with a stack walks through its interval tree; an
interval of prefix length r, with the anchor, is a repeat of all its occurrences.
Sorting an interval's occurrences by what stands before them shows where the repeat
goes on to the left and where it stops (left-extension diversity), and so gives its
maximal extensions: a passage of l + K + r bytes with l and r as large as possible.
Every repeated passage of L bytes lies in one of them.

Equal texts are one text, and equal surroundings of an anchor are one row with a
count, collapsed before the shuffle. A group that still has more than GROUP
different surroundings, such as the edge of a passage that is everywhere, is split:
a passage of L bytes reaches at least half of what it lacks to one side, so its
occurrences are dealt by the anchor with half of that at its right, and once more
by the anchor with half of that at its left.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from starloom.llm.bagminhash import STEP, mix, text_key
from starloom.llm.common import map_rows, per_process, slices
from starloom.session import cut_lineage

BLOCK = 1 << 18          # bytes of a text looked at together
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse
GROUP = 20_000           # different surroundings of an anchor in one suffix array


def anchor_length(least: int) -> int:
    """K for passages of at least this many bytes: 128 for 400."""
    return max(1, least * 8 // 25)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64."""
    inverse = pow(BASE, -1, 1 << 64)
    one = [np.full(n, b, np.uint64) for b in (BASE, inverse)]
    for p in one:
        p[0] = 1
    return tuple(np.multiply.accumulate(p) for p in one)


def anchors_of(data: bytes | np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of the anchors of a text's bytes, or of other numbers in a row, block by block."""
    k = anchor_length(least)
    window = least - k + 1
    span = BLOCK + least
    up, down = per_process("repeats", span, lambda: powers(span))
    all_bytes = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
    hashes, places = [], []
    for at in range(0, len(data) - least + 1, BLOCK):
        part = all_bytes[at:at + BLOCK + least - 1]
        n = len(part)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(part.astype(np.uint64) * up[:n], out=sums[1:])
        m = n - k + 1
        h = mix((sums[k:] - sums[:m]) * down[:m] + STEP)
        # Order by hash, then by place: the low bits of the sort key hold the place.
        keys = (h & ~np.uint64((1 << 20) - 1)) | np.arange(m, dtype=np.uint64)
        padded = np.full(-(-m // window) * window, np.uint64((1 << 64) - 1))
        padded[:m] = keys
        rows = padded.reshape(-1, window)
        before = np.minimum.accumulate(rows, axis=1).ravel()
        after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least_keys = np.minimum(after[:m - window + 1], before[window - 1:m])
        chosen = (least_keys & np.uint64((1 << 20) - 1)).astype(np.int64)
        chosen = chosen[np.r_[True, chosen[1:] != chosen[:-1]]]
        hashes.append(h[chosen])
        places.append(chosen + at)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    place, first = np.unique(np.concatenate(places), return_index=True)
    return np.concatenate(hashes)[first], place


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """Intervals (length, first, last) of a suffix array's interval tree; lcp[i] belongs to suffixes i - 1 and i."""
    stack: list[list[int]] = []
    for i in range(1, len(lcp) + 1):
        value, first = lcp[i] if i < len(lcp) else -1, i - 1
        while stack and stack[-1][0] > value:
            length, first = stack.pop()
            yield length, first, i - 1
        if value >= 0 and (not stack or stack[-1][0] < value):
            stack.append([value, first])


def extensions(around: list[tuple[bytes, bytes, bytes]], counts: list[int], least: int) -> list[tuple[int, int] | None]:
    """How far repeats reach to the left and right of an anchor, for each of its different surroundings.

    around: (what stands before, core, what stands after); counts: occurrences of
    each. None where no repeat of least bytes holds the anchor. All repeats at one
    occurrence hold its anchor, so their union is one passage.
    """
    best: list[list[int] | None] = [[len(a), len(c)] if n > 1 and len(a) + len(b) + len(c) >= least else None for (a, b, c), n in zip(around, counts)]
    if len(around) > 1:
        core = len(around[0][1])
        order = sorted(range(len(around)), key=lambda i: around[i][2])
        lcp = [0] + [common(around[p][2], around[q][2]) for p, q in zip(order, order[1:])]
        reverse = [a[::-1] for a, _, _ in around]
        for right, first, last in intervals(lcp):
            members = sorted(order[first:last + 1], key=reverse.__getitem__)
            reach = [common(reverse[p], reverse[q]) for p, q in zip(members, members[1:])]
            for k, i in enumerate(members):
                left = max(reach[k - 1] if k else 0, reach[k] if k < len(reach) else 0)
                if left + core + right >= least:
                    best[i] = [left, right] if best[i] is None else [max(best[i][0], left), max(best[i][1], right)]
    return [None if b is None else (b[0], b[1]) for b in best]


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of a sorted stream, group by group of the first column."""
    now, rows = None, []
    for part in slices(batches):
        for row in zip(*part.values()):
            if rows and row[0] != now:
                yield rows
                rows = []
            now = row[0]
            rows.append(row)
    if rows:
        yield rows


def surroundings(texts: DataFrame, places: DataFrame, least: int, with_bytes: bool) -> DataFrame:
    """(group, around, key, place[, before, core, after]) of each anchor that occurs twice or more.

    around: 16 bytes of a hash of what stands before, in and after the core.
    """
    k = anchor_length(least)

    def made(part: dict[str, list]) -> dict[str, object]:
        out: dict[str, list] = {c: [] for c in ("group", "around", "key", "place", "before", "core", "after")}
        for key, text, found in zip(part["key"], part["text"], part["places"]):
            data = text.encode()
            for p in sorted(found):
                three = data[max(0, p - least + k):p], data[p:p + k], data[p + k:p + least]
                for c, v in zip(out, (hashlib.blake2b(three[1], digest_size=16).digest(), around_of(*three), key, p, *three)):
                    out[c].append(v)
        return out if with_bytes else {c: out[c] for c in ("around", "key", "place")}

    schema = "group binary, around binary, key binary, place long, before binary, core binary, after binary" if with_bytes else "around binary, key binary, place long"
    return map_rows(texts.join(places, "key").select("key", "n", "text", "places"), made, schema)


def around_of(before: bytes, core: bytes, after: bytes) -> bytes:
    h = hashlib.blake2b(len(before).to_bytes(8, "little") + len(core).to_bytes(8, "little"), digest_size=16)
    h.update(before + core + after)
    return h.digest()


def reaches(rows: DataFrame, least: int) -> DataFrame:
    """(around, left, right) for rows (group, around, before, core, after, n), one per group and surroundings."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list] = ([], [], [])

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(out[0], type=pa.binary()), pa.array(out[1], type=pa.int64()), pa.array(out[2], type=pa.int64())], names=["around", "left", "right"])

        for group in grouped(batches):
            for row, reach in zip(group, extensions([r[2:5] for r in group], [r[5] for r in group], least)):
                if reach is not None:
                    for column, value in zip(out, (row[1], *reach)):
                        column.append(value)
            if len(out[0]) > 4096:
                yield batch()
                out = ([], [], [])
        yield batch()

    ordered = rows.select("group", "around", "before", "core", "after", "n").repartition("group").sortWithinPartitions("group")
    return ordered.mapInArrow(found, "around binary, left long, right long")


def halved(rows: DataFrame, least: int) -> DataFrame:
    """(group, around, before, core, after, n, origin, moved): both halves of each row of a group that is too large.

    origin: the row's own surroundings; moved: bytes from its core's start back to
    the new core's start. A passage that holds the core holds one of the two new cores.
    """
    def made(part: dict[str, list]) -> dict[str, object]:
        out: dict[str, list] = {c: [] for c in ("group", "around", "before", "core", "after", "n", "origin", "moved")}
        for group, origin, a, b, c, n in zip(part["group"], part["around"], part["before"], part["core"], part["after"], part["n"]):
            lacking = least - len(b)
            half = (lacking + 1) // 2
            keep = lacking - half
            options = []
            if len(c) >= half:
                options.append((a[len(a) - min(len(a), keep):], b + c[:half], c[half:half + keep], 0))
            if len(a) >= half:
                options.append((a[max(0, len(a) - half - keep):len(a) - half], a[len(a) - half:] + b, c[:keep], half))
            for before, core, after, moved in options:
                # Groups and sides stay apart: else one occurrence, seen from two anchors, would look like two.
                side = hashlib.blake2b(group + (b"l" if moved else b"r") + core, digest_size=16).digest()
                for name, v in zip(out, (side, around_of(before, side + core, after), before, core, after, n, origin, moved)):
                    out[name].append(v)
        return out

    return map_rows(rows, made, "group binary, around binary, before binary, core binary, after binary, n long, origin binary, moved long")


def collapsed(rows: DataFrame) -> DataFrame:
    """One row per group and surroundings, counts added up before the shuffle."""
    return rows.groupBy("group", "around").agg(F.first("before").alias("before"), F.first("core").alias("core"), F.first("after").alias("after"), F.sum("n").alias("n"))


def reaches_split(rows: DataFrame, least: int, group: int) -> DataFrame:
    """reaches, with groups of more than so many rows halved until none is that large or cores are whole passages."""
    sizes = rows.groupBy("group").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > group).select("group")
    large = cut_lineage(rows.join(sizes, "group", "left_semi").filter(F.length("core") < least))
    small = reaches(rows.join(sizes, "group", "left_anti"), least)
    whole = rows.join(sizes, "group", "left_semi").filter(F.length("core") >= least)
    if large.isEmpty():
        return small.union(reaches(whole, least))
    parts = cut_lineage(halved(large, least))
    own = parts.select("origin", "moved", "around").distinct()
    deeper = reaches_split(cut_lineage(collapsed(parts)), least, group)
    lengths = large.select(F.col("around").alias("origin"), F.length("core").alias("core")).distinct()
    back = deeper.join(own, "around").join(lengths, "origin")
    # The new core is (lacking + 1) div 2 bytes longer, to the right (moved 0) or to the left.
    longer = F.floor((F.lit(least) - F.col("core") + 1) / 2)
    back = back.select(F.col("origin").alias("around"), (F.col("left") + F.col("moved")).alias("left"), (F.col("right") + longer - F.col("moved")).alias("right"))
    return small.union(reaches(whole, least)).union(back).groupBy("around").agg(F.max("left").alias("left"), F.max("right").alias("right"))


def repeated_spans(docs: DataFrame, least: int, text_col: str, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): texts (key, n, text), each different text once with its number of rows; spans (key, start, stop), which may overlap."""
    k = anchor_length(least)
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(text_key(F.col("text")).alias("key"), "text")
    texts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first("text").alias("text"))

    def anchored(part: dict[str, list]) -> dict[str, object]:
        out: dict[str, list] = {"hash": [], "key": [], "place": []}
        for key, text in zip(part["key"], part["text"]):
            hashes, places = anchors_of(text.encode(), least)
            out["hash"].extend(hashes.view(np.int64).tolist())
            out["key"].extend([key] * len(places))
            out["place"].extend(places.tolist())
        return out

    found = cut_lineage(map_rows(rows.filter(F.octet_length("text") >= least), anchored, "hash long, key binary, place long"))
    # Written, so that the join deals both sides anew and AQE can split an anchor that is everywhere.
    several = cut_lineage(found.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash"))
    places = found.join(several, "hash", "left_semi").groupBy("key").agg(F.collect_set("place").alias("places"))
    places = cut_lineage(places)
    different = cut_lineage(collapsed(surroundings(texts, places, least, True).withColumn("n", F.lit(1).cast("long"))))
    reach = cut_lineage(reaches_split(different, least, group))
    occurrences = surroundings(texts, places, least, False)
    spans = occurrences.join(reach, "around").select("key", (F.col("place") - F.col("left")).alias("start"), (F.col("place") + k + F.col("right")).alias("stop"))
    return texts, spans


def merged(spans: list | None, n: int, copies: int, least: int) -> list[tuple[int, int]]:
    """Maximal removed runs of a text of n bytes; all of it if it has copies and is long enough."""
    if copies > 1 and n >= least:
        return [(0, n)]
    out: list[list[int]] = []
    for span in sorted((s["start"], s["stop"]) for s in spans or []):
        if out and span[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], span[1])
        else:
            out.append(list(span))
    return [tuple(s) for s in out]


def cut_texts(docs: DataFrame, least: int, text_col: str, group: int, with_text: bool) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, removed[, kept]) of each different text; kept: what is left, without parts of characters."""
    texts, spans = repeated_spans(docs, least, text_col, group)
    spans = spans.groupBy("key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))

    def cut(part: dict[str, list]) -> dict[str, object]:
        out: dict[str, list] = {c: [] for c in ("key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept")}
        for key, copies, text, found in zip(part["key"], part["n"], part["text"], part["spans"]):
            data = text.encode()
            runs = merged(found, len(data), copies, least)
            kept, at = [], 0
            for start, stop in [*runs, (len(data), len(data))]:
                kept.append(data[at:start])
                at = stop
            left = b"".join(kept)
            whole = left.decode(errors="ignore") if with_text else None
            for c, v in zip(out, (key, len(data), sum(b - a for a, b in runs), len(runs), hashlib.sha256(left).hexdigest(), [{"start": a, "stop": b} for a, b in runs], whole)):
                out[c].append(v)
        return out

    schema = "key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start: long, stop: long>>" + (", kept string" if with_text else "")
    return map_rows(texts.join(spans, "key", "left").select("key", "n", "text", "spans"), cut, schema)


def strip_repeats(docs: DataFrame, least: int = 400, text_col: str = "text", group: int = GROUP) -> DataFrame:
    """docs with each text cut as in without_repeats; rows of which nothing but white space is left are dropped.

    Empty texts stay empty (a null one becomes empty). Characters of which only some bytes are removed go too.
    """
    kept = cut_texts(docs, least, text_col, group, True).filter((F.col("n_removed") == 0) | (F.trim("kept") != "")).select("key", "kept")
    # Texts move once, by their key; the other columns are joined to what is left of them.
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rest = docs.select(text_key(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), F.struct(*others).alias("row"))
    return rest.join(kept, "key").select(*(F.col("kept").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def without_repeats(docs: DataFrame, least: int = 400, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, removed) of each row.

    removed: maximal runs (start, stop) of bytes, in order, that a passage of least
    bytes covers which starts anywhere else too, in any row. Copies of a text lose
    all of it (if it has least bytes). Null texts count as empty; repeated rows are
    copies; null ids stay; other columns are not read; an empty table gives no rows.
    """
    result = cut_texts(docs, least, text_col, group, False)
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.coalesce(F.col(text_col), F.lit(""))).alias("key"))
    return rows.join(result, "key").select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed")


def word_numbers(texts: list[str]) -> list[np.ndarray]:
    """A number for each word of each text, equal for equal words."""
    split = pc.utf8_split_whitespace(pa.array(texts, pa.string()))
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
    number = mix(np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) + STEP)
    full = pc.binary_length(coded.dictionary).to_numpy() > 0
    tokens = np.split(coded.indices.to_numpy(), np.cumsum(split.value_lengths().to_numpy())[:-1])
    return [number[t[full[t]]] for t in tokens]


def repeated_runs(docs: DataFrame, least: int, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(texts, starts): texts (key, n, text) as in repeated_spans; starts (key, starts): words at which a run of least words begins that begins anywhere else too.

    Anchors, as above but of words, tell which runs may occur twice; those are compared by digests of their whole words.
    """
    k = anchor_length(least)
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(text_key(F.col("text")).alias("key"), "text")
    texts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first("text").alias("text"))

    def anchored(part: dict[str, list]) -> dict[str, object]:
        out: dict[str, list] = {"hash": [], "key": [], "place": []}
        for key, numbers in zip(part["key"], word_numbers(part["text"])):
            hashes, places = anchors_of(numbers, least)
            out["hash"].extend(hashes.view(np.int64).tolist())
            out["key"].extend([key] * len(places))
            out["place"].extend(places.tolist())
        return out

    def digests(part: dict[str, list]) -> dict[str, object]:
        out: dict[str, list] = {"run": [], "key": [], "place": [], "n": []}
        for key, n, text, places in zip(part["key"], part["n"], part["text"], part["places"]):
            words = text.split()
            # A run holds its anchor.
            for s in sorted({s for p in places for s in range(max(0, p + k - least), min(p, len(words) - least) + 1)}):
                for c, v in zip(out, (hashlib.blake2b(" ".join(words[s:s + least]).encode(), digest_size=16).digest(), key, s, n)):
                    out[c].append(v)
        return out

    # A run of so many words has as many bytes, and white space between them.
    found = cut_lineage(map_rows(rows.filter(F.octet_length("text") >= 2 * least - 1), anchored, "hash long, key binary, place long"))
    several = cut_lineage(found.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash"))
    places = cut_lineage(found.join(several, "hash", "left_semi").groupBy("key").agg(F.collect_set("place").alias("places")))
    runs = cut_lineage(map_rows(texts.join(places, "key").select("key", "n", "text", "places"), digests, "run binary, key binary, place long, n long"))
    twice = cut_lineage(runs.groupBy("run").agg(F.sum("n").alias("n")).filter("n > 1").select("run"))
    return texts, runs.join(twice, "run", "left_semi").groupBy("key").agg(F.collect_set("place").alias("starts"))


def strip_repeated_runs(docs: DataFrame, least: int = 51, text_col: str = "text") -> DataFrame:
    """docs without the runs of least words that begin anywhere else too, in any row; white space between words counts as equal.

    Overlaps count, and runs are judged on the input. From a run's first word to its last all goes; rows of which nothing
    but white space is left are dropped. Other texts, null ones too, stay as they are; repeated rows are copies.
    """
    texts, starts = repeated_runs(docs, least, text_col)

    def cut(part: dict[str, list]) -> dict[str, object]:
        kept = []
        for text, found in zip(part["text"], part["starts"]):
            at = [m.span() for m in re.finditer(r"\S+", text)]
            left, end = [], 0
            for start, stop in merged([{"start": s, "stop": s + least} for s in found], len(at), 1, least):
                left.append(text[end:at[start][0]])
                end = at[stop - 1][1]
            kept.append("".join(left) + text[end:])
        return {"key": part["key"], "kept": kept}

    kept = cut_lineage(map_rows(texts.join(starts, "key").select("key", "text", "starts"), cut, "key binary, kept string"))
    rows = docs.select(text_key(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = rows.join(kept, "key", "left").filter(F.col("kept").isNull() | (F.regexp_replace("kept", r"(?U)\s+", "") != ""))
    return rows.select(*(F.coalesce("kept", F.col(f"row.`{c}`")).alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
