"""Syncmers, sketches and edits against plain Python."""

import hashlib
import random
import struct

import xxhash

from starloom.llm import fingerprints as P


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def of_string(s):
    return xxhash.xxh64_intdigest(s.encode(), seed=42)


def of_longs(*xs):
    seed = 42
    for x in xs:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", x), seed=seed)
    return signed(seed)


def sketch(text, size=P.SIZE):
    words = [w for w in __import__("re").split(r"[ \t\n\x0b\f\r]+", text) if w]
    if not words:
        return []
    if len(words) < 5:
        return [of_string(" ".join(words)) >> 16]
    h = [signed(of_string(w)) for w in words]
    g = [of_longs(a, b) for a, b in zip(h, h[1:])]
    out = set()
    for i in range(len(words) - 4):
        inner = g[i:i + 4]
        if min(inner) in (inner[0], inner[3]):
            out.add((of_longs(g[i], g[i + 2], h[i + 4]) & (1 << 64) - 1) >> 16)
    return sorted(out)[:size]


def near(a, b, size=P.SIZE):
    least = sorted(set(a) | set(b))[:size]
    return sum(x in a and x in b for x in least) / len(least) if least else 1.0


def test_rows(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdé日") for _ in range(rng.randint(1, 5)))
    texts = {k: " ".join(word() for _ in range(rng.randint(0, 300))) for k in rng.sample(range(1000), 40)}
    texts |= {1001: None, 1002: "", 1003: "one", 1004: "one", 1005: "x" * 5000, 1006: " a \n b\tc ", 1007: "same words " * 300, 1008: "same words " * 300}
    texts[-5] = " ".join(word() for _ in range(20))
    df = spark.createDataFrame([(k, t, 1, "s") for k, t in texts.items()], "doc_id long, text string, sketch int, next string").repartition(5)
    got = {r.doc_id: r for r in P.fingerprint_with_edits(df).collect()}
    order = sorted(texts)
    assert sorted(got) == order
    for k, after in zip(order, order[1:] + order[:1]):
        text, then = texts[k] or "", texts[after] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + then[:half]
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == "".join(f"{x:012x}" for x in sketch(text))
        assert r.edited_fingerprint == "".join(f"{x:012x}" for x in sketch(edited))
        assert abs(r.near_edited - near(sketch(text), sketch(edited))) < 1e-12
        assert abs(r.near_next - near(sketch(text), sketch(then))) < 1e-12
    assert got[1007].near_next == 1.0 and got[1003].near_next == 1.0


def test_repeated_and_null_ids(spark):
    rows = [(None, "a b c d e f g h"), (1, "i j k l m n o p"), (1, "i j k l m n o p"), (1, "short")]
    got = P.fingerprint_with_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.n_chars) for r in got) == sorted((k is None, len(t)) for k, t in rows)
    one = P.fingerprint_with_edits(spark.createDataFrame(rows[:1], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert P.fingerprint_with_edits(spark.createDataFrame(rows[:1], "doc_id long, text string").limit(0)).count() == 0


def test_anchors_stand_where_a_passage_stands(spark):
    rng = random.Random(9)
    words = [str(rng.random()) for _ in range(60)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(["q"] * 7 + words))], "doc_id long, text string")
    rows = P.anchors(df).collect()
    one = {(r.place, r.hash) for r in rows if r.doc_id == 1}
    two = {(r.place - 7, r.hash) for r in rows if r.doc_id == 2}
    assert one and one <= two
    places = sorted(p for p, _ in one)
    assert max(b - a for a, b in zip(places, places[1:])) <= 4


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "a b")], "doc_id long, text string")
    plan = P.fingerprint_with_edits(df)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))
