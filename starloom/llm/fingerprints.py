"""Document fingerprints from closed syncmers, in DataFrame functions only.

A k-mer of words is a closed syncmer when the least hash of its inner s-mers is
that of its first or its last one. The choice looks at the k-mer alone, so equal
passages choose equal anchors whatever stands around them. With k = 5 and s = 2
half of all k-mers are anchors, and at least every third.

The fingerprint is the bottom sketch of the anchors' hashes: the least ones, in
order. Two sketches give an unbiased estimate of the Jaccard likeness of the sets
of anchors; texts with no more anchors than the sketch holds are compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from starloom.session import cut_lineage

K, S = 5, 2
SIZE = 64     # hashes in a fingerprint
BITS = 48     # of each hash


def with_anchors(df: DataFrame, text: str, out: str = "anchors") -> DataFrame:
    """df and an array: at each place of a k-mer its hash where it is an anchor, else null.

    A text of one to four words has one anchor, its words; one of none has none.
    Step by step, so that no array is worked out inside another one's lambda.
    """
    others = [c for c in df.columns if c != out]
    words = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    df = df.withColumn("_h", F.transform(words, lambda w: F.xxhash64(w))).withColumn("_n", F.size("_h"))
    pair = F.zip_with("_h", F.slice("_h", 2, F.greatest(F.col("_n"), F.lit(1))), lambda a, b: F.xxhash64(a, b))
    # The last pair lacks its second word; after the cut there is one s-mer per place.
    df = df.withColumn("_g", F.slice(pair, 1, F.greatest(F.col("_n") - 1, F.lit(0))))
    shifted = lambda c, by: F.slice(c, by + 1, F.greatest(F.col("_n"), F.lit(1)))
    df = df.withColumn("_m2", F.zip_with("_g", shifted("_g", 1), lambda a, b: F.least(a, b)))
    df = df.withColumn("_m4", F.zip_with("_m2", shifted("_m2", 2), lambda a, b: F.least(a, b)))
    least = F.slice("_m4", 1, F.greatest(F.col("_n") - K + 1, F.lit(0)))
    kmer = lambda i: F.xxhash64(F.get("_g", i), F.get("_g", i + 2), F.get("_h", i + 4))
    chosen = F.transform(least, lambda m, i: F.when((m == F.get("_g", i)) | (m == F.get("_g", i + 3)), F.shiftrightunsigned(kmer(i), 64 - BITS)))
    short = F.array(F.shiftrightunsigned(F.xxhash64(F.concat_ws(" ", words)), 64 - BITS))
    return df.select(*others, F.when(F.col("_n") >= K, chosen).when(F.col("_n") > 0, short).otherwise(F.array().cast("array<bigint>")).alias(out))


def anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, place, hash) of every anchor: place in words. For matching passages by position."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    placed = with_anchors(rows, "text").select("id", F.posexplode("anchors").alias("place", "hash"))
    return placed.filter(F.col("hash").isNotNull()).withColumnRenamed("id", id_col)


def with_sketch(df: DataFrame, text: str, out: str, size: int = SIZE) -> DataFrame:
    """df and the bottom sketch of the text's anchors, an ordered array of at most size hashes."""
    df = with_anchors(df, text, "_a")
    kept = F.slice(F.sort_array(F.array_distinct(F.filter("_a", lambda a: a.isNotNull()))), 1, size)
    return df.withColumn(out, kept).drop("_a")


def fingerprint(sketch: Column | str) -> Column:
    """A sketch as a string of 12 hexadecimal digits per hash."""
    return F.concat_ws("", F.transform(sketch, lambda a: F.lower(F.lpad(F.hex(a), BITS // 4, "0"))))


def likeness(a: str, b: str, size: int = SIZE) -> Column:
    """Estimated Jaccard likeness of the texts behind two sketches, 0 to 1; of two without words 1."""
    least = F.slice(F.sort_array(F.array_union(a, b)), 1, size)
    shared = F.size(F.array_intersect(least, F.array_intersect(a, b))).cast("double")
    return F.when(F.size(F.array_union(a, b)) == 0, F.lit(1.0)).otherwise(shared / F.size(least))


def key_of(id_col: str) -> Column:
    return F.struct(F.col(id_col).isNotNull().alias("given"), F.col(id_col).alias("id"))


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, before, need) per distinct id: the key before it and half the characters of that one's longest text.

    Keys are structs (given, id) that are never null, so that joins on them need no
    other partitioning than sums over them.

    Ids are sorted by ranges and written with the range they fell into; only one row
    per range goes through a common window. The first follows the last.
    """
    ids = docs.select(key_of(id_col).alias("key"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n"))
    rows = ids.groupBy("key").agg(F.max("n").alias("n")).repartitionByRange("key").withColumn("range", F.spark_partition_id())
    rows = cut_lineage(rows)
    last = rows.groupBy("range").agg(F.max(F.struct("key", "n")).alias("last"))
    ends = last.select(
        "range",
        F.coalesce(F.lag("last").over(W.orderBy("range")), F.max("last").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("end"),
    )
    inside = W.partitionBy("range").orderBy("key")
    before = F.coalesce(F.lag(F.struct("key", "n")).over(inside), F.col("end"))
    return rows.join(ends, "range").select("key", before.alias("b")).select(
        "key", F.col("b.key").alias("before"), F.expr("b.n div 2").cast("int").alias("need"),
    )


def fingerprint_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row.

    The edited text has its last n_chars div 2 code points replaced by the first as
    many of the next document (or all it has): next by ascending id, after the last
    the first, a null id before all others. A null text counts as empty. Rows of one
    id stay apart and share the next document; if that id has several rows, the one
    whose beginning sorts first is taken. A single document follows itself. Other columns are not
    read; an empty table gives no rows.
    """
    base = with_sketch(docs.select(key_of(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "text", "sketch")
    order = neighbours(docs, id_col, text_col)
    heads = base.alias("d").join(order.alias("o"), F.col("d.key") == F.col("o.key")).select(
        F.col("o.before").alias("before"), F.struct(F.expr("substring(d.text, 1, o.need)").alias("head"), F.col("d.sketch").alias("sketch")).alias("next"),
    ).groupBy("before").agg(F.min("next").alias("next"))
    both = base.alias("d").join(heads.alias("h"), F.col("d.key") == F.col("h.before")).select(
        F.col("d.key.id").alias("id"), F.length("d.text").alias("n"), F.col("d.sketch").alias("sketch"), F.col("h.next.sketch").alias("next_sketch"),
        F.expr("concat(substring(d.text, 1, length(d.text) - length(d.text) div 2), substring(h.next.head, 1, int(length(d.text) div 2)))").alias("edited"),
    )
    both = with_sketch(both, "edited", "edited_sketch")
    return both.select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint("sketch").alias("fingerprint"), fingerprint("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch").alias("near_edited"), likeness("sketch", "next_sketch").alias("near_next"),
    )
