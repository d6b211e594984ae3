"""Repeated passages against brute force over all substrings."""

import hashlib
import random
import re
from collections import Counter

import pytest

from starloom.llm import repeats


def brute(texts, least):
    counts, data = Counter(), [(t or "").encode() for t in texts]
    for d in data:
        counts.update(d[i:i + least] for i in range(len(d) - least + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - least + 1):
            if counts[d[i:i + least]] > 1:
                gone[i:i + least] = b"\1" * least
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), sum(1 for i in range(len(d)) if gone[i] and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def texts_with_repeats(seed, least):
    rng = random.Random(seed)
    noise = lambda n, of="abcdefgh é": "".join(rng.choice(of) for _ in range(n))
    shared = [noise(rng.randint(least // 2, 3 * least)) for _ in range(6)]
    texts = [None, "", ""]
    for _ in range(60):
        parts = [rng.choice([noise(rng.randint(0, least)), rng.choice(shared), rng.choice(shared)[rng.randint(0, 5):], "ab" * rng.randint(0, least), "a" * rng.randint(0, 2 * least), noise(least, "ab")]) for _ in range(rng.randint(0, 6))]
        texts.append("".join(parts))
    return texts + texts[5:9]


# Groups of over 2 or 3 surroundings are halved, again and again.
@pytest.mark.parametrize("least,group", [(12, 20_000), (12, 2), (40, 3)])
def test_as_brute_force(spark, least, group):
    texts = texts_with_repeats(least + group, least)
    df = spark.createDataFrame([(k, t, 1, b"k") for k, t in enumerate(texts)], "doc_id long, text string, n long, key binary").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.without_repeats(df, least, group=group).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts, least)


def test_blocks_of_a_long_text_have_the_same_anchors(monkeypatch):
    rng = random.Random(1)
    data = bytes(rng.choice(b"abc") for _ in range(20_000))
    whole = repeats.anchors_of(data, 40)
    monkeypatch.setattr(repeats, "BLOCK", 1000)
    parts = repeats.anchors_of(data, 40)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    # Every window of 40 bytes holds an anchor of 12.
    starts = set(whole[1].tolist())
    assert all(any(p in starts for p in range(at, at + 29)) for at in range(len(data) - 39))


def test_interval_tree():
    assert sorted(repeats.intervals([0, 1, 3, 0, 2])) == [(0, 0, 4), (1, 0, 2), (2, 3, 4), (3, 1, 2)]


def test_stripped_rows(spark):
    passage = "0123456789é" * 4
    rows = [(1, "left " + passage + " right", "a"), (2, passage, "b"), (3, "alone", "c"), (4, None, "d"), (None, "x" + passage, "e"), (5, "alone", "f")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, n_removed int")
    got = {r.lang: r.text for r in repeats.strip_repeats(df, 40).collect()}
    assert got == {"a": "left  right", "c": "alone", "d": "", "e": "x", "f": "alone"}
    assert repeats.strip_repeats(df, 40).columns == df.columns
    assert repeats.without_repeats(df.limit(0)).count() == 0


def brute_runs(texts, least):
    """Texts without runs of least words that begin twice or more."""
    words = [(t or "").split() for t in texts]
    counts = Counter(tuple(w[i:i + least]) for w in words for i in range(len(w) - least + 1))
    out = []
    for text, w in zip(texts, words):
        gone = [False] * len(w)
        for i in range(len(w) - least + 1):
            if counts[tuple(w[i:i + least])] > 1:
                gone[i:i + least] = [True] * least
        left, end = "", 0
        for k, m in enumerate(re.finditer(r"\S+", text or "")):
            left += "" if gone[k] and k and gone[k - 1] else (text or "")[end:m.start()]
            left += "" if gone[k] else m.group()
            end = m.end()
        out.append((text if not any(gone) else left + (text or "")[end:], any(gone)))
    return out


@pytest.mark.parametrize("least", [5, 20])
def test_runs_of_words_as_brute_force(spark, least):
    rng = random.Random(least)
    noise = lambda n, of=900: "".join(f"w{rng.randrange(of)}é" + rng.choice([" ", " ", "\n", "  ", " "]) for _ in range(n))
    shared = [noise(rng.randint(least // 2, 3 * least)) for _ in range(6)]
    texts = [None, "", " \n", " ".join("a" * (least - 1)), " ".join("a" * (least + 2))]
    for _ in range(60):
        texts.append("".join(rng.choice([noise(rng.randint(0, least)), rng.choice(shared), rng.choice(shared)[rng.randint(0, 9):], "of " * rng.randint(0, 2 * least), noise(least, 2)]) for _ in range(rng.randint(0, 5))))
    texts += texts[9:12]
    df = spark.createDataFrame([(k, t, "x", b"k") for k, t in enumerate(texts)], "doc_id long, text string, kept string, key binary").repartition(3)
    got = {r.doc_id: r for r in repeats.strip_repeated_runs(df, least).collect()}
    for k, (want, cut) in enumerate(brute_runs(texts, least)):
        if cut and not want.strip():
            assert k not in got
        else:
            assert got[k].text == want and got[k].kept == "x" and got[k].key == b"k"
    assert sum(c for _, c in brute_runs(texts, least)) > 20
    assert repeats.strip_repeated_runs(df.limit(0), least).count() == 0
