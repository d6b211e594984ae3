"""The ledger against a plain reading of the rules, policies and ablations."""

import random

from pyspark.sql import functions as F

from starloom.llm import quality_rules as Q


def plain(text):
    words, word = [], ""
    for c in text + " ":
        if c in " \t\n\v\f\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    hit = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in (i, i + 1, i + 2)}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if x.strip(" \t\n\v\f\r") and x in lines[:i])
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def random_text(rng):
    return "".join(rng.choice(["a ", "b ", "a b c ", "\n", "x y", "é ", "#|", "\t", "line\n", "line\n", " \n", "\x1c"]) for _ in range(rng.randint(0, 40)))


def test_measures():
    rng = random.Random(1)
    for _ in range(800):
        text = random_text(rng)
        assert Q.measure(text)[:5] == plain(text), repr(text)


def test_ledger_policies_and_ablations(spark):
    rng = random.Random(2)
    texts = [None, "", "word " * 60, " ".join(chr(97 + k % 26) + chr(97 + k // 26) for k in range(80)), " ".join(chr(97 + k % 26) + chr(97 + k // 26) + " #$" for k in range(80)), "Z" * 100_000] + [random_text(rng) for _ in range(50)]
    df = spark.createDataFrame([(k, t, 1, 1) for k, t in enumerate(texts)] + [(None, "x", 1, 1)], "doc_id long, text string, failures int, n_words int").repartition(3)
    ledger = Q.ledger(df).cache()
    rows = {r.doc_id: r for r in Q.apply_policies(ledger, ["v1", "v2", "v3"]).collect()}
    assert len(rows) == len(texts) + 1
    for k, text in enumerate(texts):
        n, _, _, _, repeat = plain(text or "")
        base = n < 50 or 100 * repeat > 50 * n
        assert (rows[k].n_words, rows[k].kept_v1) == (n, not base)
        assert not (base and (rows[k].kept_v2 or rows[k].kept_v3))
    assert rows[3].kept_v2 and not rows[4].kept_v2 and not rows[2].kept_v1
    policy = Q.POLICIES["v3"]
    kept = lambda bits: Q.verdict(F.lit(bits).cast("long"), policy)
    for r in Q.ablations(ledger, policy).collect():
        bit = Q.BIT[r.rule]
        want = sum(1 for x in rows.values() if spark.range(1).select(kept(x.failures & ~bit)).first()[0]) if r.rule in ("few_words", "symbols") else r.n_kept_without
        assert r.n_rows == len(rows) and r.n_failed == sum(bool(x.failures & bit) for x in rows.values()) and r.n_kept_without == want
        assert r.n_only == sum(x.failures & policy.mask == bit for x in rows.values())
    assert Q.ledger(df.limit(0)).count() == 0
