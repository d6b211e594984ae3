"""Spans of personal data: base spans against plain regular expressions, the labelers' model, added spans."""

import hashlib
import random
import re
import time

import numpy as np

from starloom.llm import private_data as P, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum((int(c) * 2 - 9 * (int(c) > 4)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def passes(kind, said):
    d = re.sub("[^0-9]", "", said)
    if kind == "ip":
        return all(int(x) <= 255 for x in said.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    return kind != "phone" or 9 <= len(d) <= 15


def base(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, text or "") if passes(k, m.group())]


def found(spark, texts):
    rows = spark.createDataFrame([(k, t, 1, "x") for k, t in texts], "doc_id long, text string, found int, code string").repartition(3)
    return {r.doc_id: [(s.kind, s.start, s.end, s.base) for s in r.spans] for r in P.find_private(rows).collect()}


def told(spans):
    return [f"{k}:{a}:{b}" for k, a, b, is_base in spans if is_base]


def noise(rng, n):
    parts = ["@", ".", "+", "-", " ", "(", ")", "1", "25", "255", "256", "0", "007", "a", "é", "b_c", "%", "\n", "😀", "x.y", "4111 1111 1111 1111", "+1 (555) 555-0100", "10.0.0.1", "me@mail.example.com"]
    return "".join(rng.choice(parts) for _ in range(n))


def test_base_spans_of_random_texts(spark):
    rng = random.Random(2)
    texts = [(k, noise(rng, rng.randint(0, 40))) for k in range(1500)] + [(9000, None), (9001, ""), (9002, "a@b.c_d@e.f"), (9003, "1.2.3.4.5.6.7.8 300.1.1.1")]
    got = found(spark, texts)
    for k, text in texts:
        assert told(got[k]) == base(text), text
        for kind in P.KINDS:  # no two spans of a kind overlap
            own = sorted(s[1:3] for s in got[k] if s[0] == kind)
            assert all(a[1] <= b[0] for a, b in zip(own, own[1:])), text


def test_added_spans(spark):
    rng = random.Random(4)
    clean = [(k, " ".join(rng.choice(["the", "order", "is", "1999", "version", "3.1", "of", "12345", "A-77", "7:30"]) for _ in range(30))) for k in range(100)]
    decoys = [(200 + k, f"order number {d} shipped") for k, d in enumerate(d for d in (str(rng.randrange(10**15, 10**16)) for _ in range(80)) if not luhn(d))]
    real = [(400 + k, f"write to bob.{k}@mail{k % 9}.example.com or call +1 (555) 555-{1000 + k}, host 44.{k}.3.9") for k in range(40)]
    hidden = [
        (600, "pay 4111111111111111 4012888888881881 now"), (601, "call +1 (555) 555-4081 190.137.223.204 now"),
        (602, 'my token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" here'), (603, "mail: jane.doe [at] example [dot] org today"),
    ]
    got = found(spark, clean + decoys + real + hidden)
    assert [(t, s) for k, t in clean + decoys for s in got[k] if not s[3]] == []
    assert all(told(got[k]) == base(t) for k, t in real) and all(len(got[k]) == 3 for k, _ in real)
    said = {k: [(s[0], t[s[1] : s[2]]) for s in got[k] if not s[3]] for k, t in hidden}
    assert said[600] == [("card", "4111111111111111"), ("card", "4012888888881881")]
    assert said[601] == [("phone", "+1 (555) 555-4081")] and ("ip", 23, 38, True) in got[601]
    assert said[602] == [("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962")]
    assert said[603] == [("email", "jane.doe [at] example [dot] org")]


def test_reliabilities_are_learned():
    """Votes drawn from known reliabilities: EM finds which labelers can be relied upon, and the classes."""
    rng = np.random.default_rng(1)
    z = rng.random(20_000) < 0.4
    right = rng.random((20_000, 5)) < np.array([0.97, 0.9, 0.75, 0.6, 0.5])
    said = np.where(right == z[:, None], P.YES, P.NO)
    patterns, which, n = np.unique(said, axis=0, return_inverse=True, return_counts=True)
    p, table = P.posteriors(patterns, n.astype(float))
    assert ((p[which.ravel()] > 0.5) == z).mean() > 0.96
    learned = table[1][np.arange(5), P.YES]
    assert list(np.argsort(-learned)) == [0, 1, 2, 3, 4] and 0.75 < learned[1] < 0.9  # half of it is the trust it starts from


def test_codes_are_bounded():
    codes = np.arange(P.CODES)
    kinds, said, shapes = P.decode(codes)
    assert kinds.max() == len(P.KINDS) - 1 and said.max() == 2 and P.CODES < 120_000
    assert P.private_codes({}) == []


def test_very_long_texts(spark):
    """Runs that plain patterns would walk over and over, and 20,000 spans in a text."""
    many = "é bob@mail.example.com, 10.0.0.1 " * 10_000
    texts = [(1, "a" * 1_000_000 + "@b.c"), (2, "1" * 300_000), (3, "1 " * 100_000), (4, "+1" * 50_000), (5, "+1" + " " * 300_000), (6, many), (7, "1." * 100_000), (8, "9" * 4000 + "@")]
    start = time.time()
    got = found(spark, texts)
    assert time.time() - start < 60
    for k, text in texts:
        if k not in (2, 8):
            assert told(got[k]) == base(text)
    assert not got[2] and not got[8]


def test_empty_and_repeated(spark):
    assert found(spark, []) == {}
    rows = spark.createDataFrame([(1, "a@b.cd"), (1, "a@b.cd"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, len(r.spans)) for r in P.find_private(rows).collect()) == [(0, 0), (1, 1), (1, 1)]


def test_query(spark):
    rows = {r.doc_id: r for r in queries.op11_weak_supervision_pii(spark, "/root/testdata/sf0.001").collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert rows.keys() == texts.keys()
    for k, r in rows.items():
        want = base(texts[k])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(kind) for w in want) for kind in PLAIN]
        assert set(want) <= set(r.spans.split(",")) or not want


def test_no_python_in_the_plan(spark):
    rows = spark.createDataFrame([(1, "a@b.cd")], "doc_id long, text string")
    for plan in (P.candidates(rows), P.find_private(rows)):
        assert "Python" not in plan._jdf.queryExecution().toString() and "Arrow" not in plan._jdf.queryExecution().executedPlan().toString()
