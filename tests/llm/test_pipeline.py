"""The pipeline: each stage on its own input, and that the stages' decisions take effect."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from starloom.llm import bagminhash, cotraining, queries
from starloom.llm.common import read
from starloom.session import cut_lineage

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_stages(spark):
    docs = read(spark, SF, "documents")
    schema, before, seen = docs.schema, docs, {}
    for name, stage in C.STAGES:
        after = cut_lineage(stage(spark, before, SF))
        seen[name] = (before, after)
        if name != "best_fit_packing":
            assert after.columns == schema.names and [f.dataType for f in after.schema] == [f.dataType for f in schema]
        before = after
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    given, kept = seen["quality_classifier"]
    assert ids(kept) == ids(cotraining.classify(given, read(spark, SF, "labels")).filter("kept"))
    given, kept = seen["near_dedup"]
    classes = bagminhash.near_duplicates(given)
    assert ids(kept) == ids(classes.filter("kept")) and kept.count() == classes.select("class_id").distinct().count()
    given, kept = seen["repeated_passages"]
    texts = [r.text.encode() for r in given.collect()]
    windows = Counter(t[i:i + 400] for t in texts for i in range(len(t) - 399))
    cut = {r.doc_id: r.text for r in kept.collect()}
    for r in given.collect():
        data, gone = r.text.encode(), bytearray(len(r.text.encode()))
        for i in range(len(data) - 399):
            if windows[data[i:i + 400]] > 1:
                gone[i:i + 400] = b"\1" * 400
        want = bytes(b for b, g in zip(data, gone) if not g).decode(errors="ignore")
        assert cut.get(r.doc_id, "") == want or (r.doc_id not in cut and not want.strip())
    given, kept = seen["source_mixing"]
    copies = queries.mixed(given.withColumn("n_words", F.regexp_count("text", F.lit(r"\S+")))).select("doc_id", "mix.copies").collect()
    assert Counter(ids(kept)) == Counter({r.doc_id: r.copies for r in copies if r.copies})
    given, packed = seen["best_fit_packing"]
    assert Counter(ids(packed.filter("piece = 0"))) == Counter(ids(given))
    used = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert used.filter("n <> end or n > 4096").count() == 0


def test_run(spark):
    assert C.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


CLASHING = ["_key", "_id", "_copy", "_row", "row", "n_words", "mix", "key", "kept", "id", "n", "content", "place"]


def clashing_docs(spark, rows):
    columns = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame([(*r, *(f"{c}{r[0]}" for c in CLASHING)) for r in rows], columns)


def test_nulls_repeated_rows_and_clashing_columns(spark, tmp_path):
    """Each stage keeps all columns of what it keeps; nulls, empty texts and repeated rows pass through."""
    long = " ".join(f"word{k}" for k in range(300))
    rows = [(k, f"some text number {k} of its own " * (1 + k % 3), "en", f"src{k % 4}", 5) for k in range(12)]
    rows += [(20, long, None, None, None), (21, long + " more", "en", "src1", 1), (22, None, None, None, None), (23, "", "en", "src0", 0), (None, "no id at all", None, "x", 2)]
    rows += rows[:2]
    docs = clashing_docs(spark, rows)
    spark.createDataFrame([(k, k % 2, 0) for k in range(3)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    before = docs
    for name, stage in C.STAGES:
        after = cut_lineage(stage(spark, before, str(tmp_path)))
        if name != "best_fit_packing":
            assert after.columns == docs.columns
            for r in after.collect():
                assert [r[c] for c in CLASHING] == [f"{c}{r.doc_id}" for c in CLASHING], name
        if name == "quality_classifier":
            assert after.count() == len(rows)  # too few labels: nothing is rejected
        if name == "near_dedup":
            kept = [r.doc_id for r in after.collect()]
            assert len(kept) == len(set(kept)) and (20 in kept) + (21 in kept) == 1 and (22 in kept) + (23 in kept) >= 1
        before = after
    assert before.filter("length > 4096").count() == 0


def test_empty_table(spark, tmp_path):
    docs = clashing_docs(spark, [])
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in C.STAGES:
        docs = cut_lineage(stage(spark, docs, str(tmp_path)))
        assert docs.count() == 0


def test_short_passages_of_over_50_words_go(spark, tmp_path):
    """51 words of 203 bytes in two otherwise different texts, and 50 words in two more, which stay."""
    of = lambda name, n: " ".join(f"{name}{k:02}" for k in range(n))
    own = lambda k: " ".join(f"own{k}x{j}" for j in range(120))
    shared, fewer = of("p", 51), of("q", 50)
    rows = [(k, f"{own(k)} {shared if k < 2 else fewer} {own(k + 9)}", "en", f"s{k}", 5) for k in range(4)]
    docs = clashing_docs(spark, rows)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in C.STAGES[:C.STAGES.index(("source_mixing", C.source_mixing))]:
        docs = cut_lineage(stage(spark, docs, str(tmp_path)))
    got = {r.doc_id: r for r in docs.collect()}
    for k in range(4):
        assert got[k].text == f"{own(k)} {'' if k < 2 else fewer} {own(k + 9)}" and got[k].n_chars == len(got[k].text)
