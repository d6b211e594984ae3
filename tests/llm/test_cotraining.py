"""Co-training: held-out accuracy on the labelled documents, exchange of labels, edges."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from starloom.llm import cotraining as C
from starloom.llm.common import read

SF = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_held_out_labels(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    used = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2500).select("doc_id")
    scored = C.classify(docs, labels.join(used, "doc_id", "left_semi"), max_labelled=2500).cache()
    assert scored.count() == docs.count()
    held = labels.join(used, "doc_id", "left_anti").join(scored, "doc_id")
    rate = {(r.quality, r.toxic): r.kept for r in held.groupBy("quality", "toxic").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert rate[1, 0] > 0.985 and rate[0, 0] < 0.1 and rate[1, 1] < 0.1
    good = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1.0).otherwise(0.0)
    # Calibrated: scores are as high as good documents are frequent.
    assert abs(held.select(F.avg(good - F.col("score"))).first()[0]) < 0.05


def test_views_exchange_labels():
    rng = np.random.default_rng(1)
    n, pool_size = 600, 800
    good = rng.random(n + pool_size) < 0.7
    rows = lambda width, signal: [np.unique(np.r_[rng.integers(50, width, 12), rng.integers(0, 20, 3) + (0 if g else 20)] if rng.random() < signal else rng.integers(50, width, 12)) for g in good]
    content, metadata = rows(5000, 0.97), rows(C.METADATA, 0.9)
    views = {"content": C.Sparse.of(content[:n]), "metadata": C.Sparse.of(metadata[:n])}
    pool = C.Sparse.of(content[n:]), C.Sparse.of(metadata[n:])
    model, given = {"own": [None, None]}, []
    for k, v in enumerate(views):
        model[v], model["own"][k] = C.fitted(v, views[v], good[:n])
    for sure in C.SURE:
        told = C.added(model, *pool, sure)
        # Sums over parts are sums over all.
        halves = [C.added(model, pool[0].take(half), pool[1].take(half), sure) for half in (np.arange(300), np.arange(300, pool_size))]
        sums = {v: C.gathered([h[v][:3] for h in halves], model, v) for v in views}
        for v in views:
            whole = C.gathered([told[v][:3]], model, v)
            np.testing.assert_allclose(whole.each, sums[v].each, atol=1e-9)
            assert (whole.rows == sums[v].rows).all()
        given.append(sum(sums[v].rows.sum() for v in views))
        for k, v in enumerate(views):
            model[v], model["own"][k] = C.fitted(v, views[v], good[:n], sums[v])
    assert given[-1] > 100
    model = C.finished(model, views["content"], views["metadata"], good[:n])
    p = C.combined(C.views_of(*pool, model), model)
    assert ((p > 0.5) == good[n:]).mean() > 0.95


def test_edges(spark):
    texts = {0: None, 1: "", 2: "word " * 30_000, 3: "a b", 4: "a b"}
    docs = spark.createDataFrame([(k, t, None if k == 3 else "en", None if k == 4 else "src", 0.5, True) for k, t in texts.items()] + [(None, "x", "en", "s", 0.1, False)], "doc_id long, text string, lang string, source string, score double, kept boolean")
    labels = spark.createDataFrame([(0, 1, None), (1, None, None), (99, 0, 0)], "doc_id long, quality int, toxic int")
    few = C.classify(docs, labels).collect()  # too few labels: nothing is rejected
    assert len(few) == 6 and all(r.kept and r.score is None for r in few)
    assert C.good_documents(docs, labels).count() == 6
    rows = [(k, ("fine words here " if k % 2 else "bad ### stuff ") * 5 + str(k), "en", "s", 0.0, False) for k in range(10, 110)]
    docs = docs.union(spark.createDataFrame(rows, docs.schema))
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(10, 110)] + [(11, 1, 0), (None, 1, 1), (13, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in C.classify(docs, labels).collect()}
    assert len(got) == 106 and all(got[k].kept == bool(k % 2) for k in range(10, 110))
    left = C.good_documents(docs, labels)
    assert left.columns == docs.columns and sorted(str(r.doc_id) for r in left.collect()) == sorted(str(k) for k, r in got.items() if r.kept)
    assert C.classify(docs.limit(0), labels).count() == 0


def test_toxic_texts_of_rare_word_forms(spark):
    """No toxic word occurs twice, only their beginning is common; one good label is wrong."""
    rng = np.random.default_rng(5)
    word = lambda n: "".join(chr(97 + k) for k in rng.integers(0, 26, n))
    plain = [word(6) for _ in range(300)]
    docs, labels = [], []
    for k in range(1500):
        toxic, low = k % 8 == 1, k % 8 == 2
        words = list(rng.choice(plain, 40)) + ["grumf" + word(5) for _ in range(3 * toxic)] + ["### @@@"] * (5 * low)
        docs.append((k, " ".join(rng.permutation(words)), "en", "s"))
        labels.append((k, int(not low), int(toxic and k != 9)))
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame(labels[:1000], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in C.classify(docs, labels).collect()}
    kept = lambda which: np.mean([got[k] for k in range(1000, 1500) if which(k % 8)])
    assert kept(lambda m: m == 1) < 0.03 and kept(lambda m: m == 2) < 0.03 and kept(lambda m: m not in (1, 2)) > 0.98


def test_sample_has_one_row_per_id(spark):
    rows = [(1, f"text {k % 7}", "en", "s") for k in range(500)] + [(k, "other", "en", "s") for k in range(2, 12)]
    docs = spark.createDataFrame(rows, "id long, text string, lang string, source string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "id long, quality int, toxic int")
    got = [r.id for r in C.sample(docs, labels, 5).select("id").collect()]
    assert sorted(got) == [1, 2]


def test_words_of_unlabelled_rows_are_learned(spark):
    """A word that no labelled row holds, in rows whose source gives them away, is read and weighs after the exchange."""
    rng = np.random.default_rng(2)
    plain = [f"word{k}" for k in range(200)]
    rows, labels = [], []
    for k in range(2400):
        bad, known = k % 3 == 0, k < 900
        words = list(rng.choice(plain, 30)) + (["oldsign"] if bad and known else ["newsign"] if bad else [])
        source = ("s_bad" if bad else "s_good") if k % 2 or known else "s_any"  # half of the unlabelled rows have a telling source
        rows.append((k, " ".join(rng.permutation(words)), "en", source))
        labels.append((k, int(not bad), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    told = spark.createDataFrame(labels[:900], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in C.classify(docs, told).collect()}
    hidden = [k for k in range(900, 2400) if k % 2 == 0]
    assert np.mean([got[k].content_score < 0.5 for k in hidden if k % 3 == 0]) > 0.9
    assert np.mean([got[k].content_score > 0.5 for k in hidden if k % 3]) > 0.9


def test_words_are_hashed_together(monkeypatch):
    """places_of says what word_ids says, and asks it only for words with signs inside and the like."""
    rng = np.random.default_rng(3)
    letters = list("abcXYZ019.,;:?!'\"()-_#*@éßÖİΣσς中٣’🙂")
    words = sorted({"".join(rng.choice(letters, rng.integers(1, 9))) for _ in range(3000)} | {"", "a" * 64, "a" * 65, "é" * 33, "Straße", "(Über-)"})
    want = [sorted(C.word_ids(w)) for w in words]
    told = C.Words.of([" ".join(words), None, " ", "A bc  bc D."])
    assert set(told.words.to_pylist()) == set(words) | {"A", "bc", "D."}
    assert told.per_text()[1:].tolist() == [[0, 0, 0, 0], [0, 0, 0, 0], [4, 7, 2, 3]]
    asked, ask = [], C.word_ids
    monkeypatch.setattr(C, "word_ids", lambda w: asked.append(w) or ask(w))
    number, place = C.places_of(pa.array(words))
    assert [sorted(place[number == k].tolist()) for k in range(len(words))] == want
    assert not any(w.strip(C.PUNCTUATION).isascii() and w.strip(C.PUNCTUATION).isalnum() and len(w) < 64 for w in asked)
    for no in ([], [""], ["..."]):
        assert len(C.places_of(pa.array(no, pa.string()))[0]) == 0
