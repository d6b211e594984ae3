"""Registered queries of the subpackage; each returns its operator's full result over a whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from starloom.llm import bagminhash, chat, cotraining, dual_tree, fingerprints, html_extract, mixing, packing, private_data, quality_rules, repair, repeats, token_counts
from starloom.llm.common import read


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.read_back(chat.format_turns(told.unionByName(extra))).withColumnRenamed("conv", "conv_id")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"), end_id=1, capacity=4096)


def op3_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_bagminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(read(spark, sf_dir, "documents"))


def op5_maximal_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(read(spark, sf_dir, "documents"), least=400)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(read(spark, sf_dir, "documents"))
    base = quality_rules.POLICIES["v1"]
    rows = quality_rules.apply_policies(rows, ["v2"])
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~quality_rules.verdict(F.col("failures"), base)).alias("base_failed"), F.col("kept_v2").alias("kept"), "failures")


def op7_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_with_edits(read(spark, sf_dir, "documents"))


# The mixture that op8 and the pipeline aim at. Domains are groups of sources.
WEIGHTS = {
    ("crawl",): 0.4, ("web",): 0.3, ("reference",): 0.3, ("other",): 0.05,
    ("*", "en"): 0.6, ("*", "de"): 0.12, ("*", "es"): 0.12, ("*", "fr"): 0.12, ("*", mixing.NONE): 0.02,
}
DEFAULT = [0.05, 0.04, 1.0]
MAX_EPOCHS, SEED = 2, 17


def mixed(docs: DataFrame) -> DataFrame:
    """docs mixed to the target weights by words as tokens, with as many tokens as there are."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), r"^src(\d{1,9})$", 1)
    domain = F.when(number == "", "other").when(number == "0", "crawl").when(F.length(number) == 1, "web").otherwise("reference")
    return mixing.mix(docs, [domain, F.col("lang"), F.col("source")], F.col("n_words"), WEIGHTS, DEFAULT, None, MAX_EPOCHS, SEED)


def op8_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_count("text", F.lit(r"\S+")).alias("n_words")
    rows = mixed(read(spark, sf_dir, "documents").select("doc_id", "lang", "source", words))
    return rows.select("doc_id", "mix.path", "mix.tokens", "mix.leaf_tokens", F.round("mix.budget", 3).alias("budget"), "mix.copies")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op11_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = private_data.find_private(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = [F.size(F.array_compact(F.transform(base, lambda s: F.when(s["kind"] == F.lit(k), 1)))).cast("long").alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return rows.select("doc_id", *number, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def damaged(turns: DataFrame) -> DataFrame:
    """Conversation rows with the faults that a checksum of their key deals out."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = turns.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), (F.crc32(key) % 20).alias("_fault")).where("_fault <> 0")
    fault = F.col("_fault")
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(fault == 4, "user").otherwise(F.col("role"))
    copies = F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def op12_lr_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = read(spark, sf_dir, "conversations")
    found = repair.summaries(repair.repair_turns(damaged(told))).withColumnRenamed("conv_id", "_conv")
    every = told.select("conv_id").distinct()
    gone = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    rest = [F.coalesce(c, F.lit(gone.get(c, 0))).alias(c) for c in found.columns if c != "_conv"]
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select("conv_id", *rest)


def op13_dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.search_documents(read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents"), 10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    fn.__name__: fn for fn in (op1_chat_format, op2_best_fit_packing, op3_cotrained_quality, op4_bagminhash_dedup, op5_maximal_repeats, op6_quality_rules, op7_syncmer_fingerprints, op8_hierarchical_mixing, op9_token_counts, op10_html_extraction, op11_weak_supervision_pii, op12_lr_conversation_repair, op13_dual_tree_search)
}
# The columns the contract names, said again in DuckDB's SQL.
_ESCAPED = r"regexp_replace(text, '(### |</turn>)', '\\\1', 'g')"
ORACLES: dict[str, str] = {
    "op1_chat_format": rf"""
WITH t AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (SELECT *, {_ESCAPED} AS body, LENGTH('### ' || role || ': </turn>') + 1 AS frame FROM t)
SELECT conv_id, COUNT(*) AS n_turns, SHA256(STRING_AGG(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(SUM(CASE WHEN role = 'assistant' THEN LENGTH(text) ELSE 0 END) AS BIGINT) AS loss_chars,
 SHA256(COALESCE(STRING_AGG(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
 CAST(SUM(LENGTH(body) + frame + CASE WHEN ends_with(text, chr(92)) THEN 2 ELSE 0 END) AS BIGINT) AS formatted_chars,
 CAST(SUM(CASE WHEN body <> text OR ends_with(text, chr(92)) THEN 1 ELSE 0 END) AS BIGINT) AS n_escaped FROM f GROUP BY conv_id""",
    "op6_quality_rules": r"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS text FROM documents),
w AS (SELECT doc_id, UNNEST(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
g AS (SELECT doc_id, i, word, LEAD(word, 1) OVER a AS w1, LEAD(word, 2) OVER a AS w2 FROM w WINDOW a AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, COUNT(*) OVER (PARTITION BY doc_id, word, w1, w2) AS n FROM g WHERE w2 IS NOT NULL),
r AS (SELECT doc_id, COUNT(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, UNNEST([i, i + 1, i + 2]) AS j FROM c WHERE n > 1) q GROUP BY 1),
l AS (SELECT doc_id, UNNEST(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d),
ll AS (SELECT doc_id, line, ROW_NUMBER() OVER (PARTITION BY doc_id, line ORDER BY k) AS rn FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dl AS (SELECT doc_id, COUNT(*) AS n_lines, COUNT(*) FILTER (rn > 1) AS n_dup_lines, COALESCE(SUM(LENGTH(line)) FILTER (rn > 1), 0) AS dup_line_chars FROM ll GROUP BY 1),
ws AS (SELECT doc_id, COUNT(*) AS n_words, SUM(LENGTH(word)) AS word_chars,
 COUNT(*) FILTER (word = UPPER(word) AND word <> LOWER(word)) AS n_upper,
 COUNT(*) FILTER (regexp_matches(TRIM(word, '.,;:!?''"()-'), '^\p{L}+$')) AS n_letter_words FROM w GROUP BY 1),
m AS (SELECT d.doc_id, LENGTH(text) AS n_chars, COALESCE(n_words, 0) AS n_words, COALESCE(word_chars, 0) AS word_chars, LENGTH(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
 COALESCE(n_dup_lines, 0) AS n_dup_lines, COALESCE(n_repeat_words, 0) AS n_repeat_words, COALESCE(n_lines, 0) AS n_lines, COALESCE(dup_line_chars, 0) AS dup_line_chars,
 COALESCE(n_upper, 0) AS n_upper, COALESCE(n_letter_words, 0) AS n_letter_words FROM d LEFT JOIN ws USING (doc_id) LEFT JOIN dl USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END) + (CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END)
 + (CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END) + (CASE WHEN 2 * dup_line_chars > n_chars THEN 16 ELSE 0 END) + (CASE WHEN 10 * n_upper > 5 * n_words THEN 32 ELSE 0 END)
 + (CASE WHEN word_chars < 2 * n_words THEN 64 ELSE 0 END) + (CASE WHEN word_chars > 15 * n_words THEN 128 ELSE 0 END) + (CASE WHEN 10 * n_letter_words < 5 * n_words THEN 256 ELSE 0 END)
 + (CASE WHEN n_words > 100000 THEN 512 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 1024 ELSE 0 END) AS failures FROM m)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & 3) <> 0 AS base_failed, (failures & 511) = 0 AS kept, CAST(failures AS BIGINT) AS failures FROM b""",
    "op12_lr_conversation_repair": r"""
WITH RECURSIVE k AS (SELECT conv_id, turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text, COALESCE(CAST(conv_id AS VARCHAR), ' ') || ':' || COALESCE(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
c AS (SELECT *, xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(name, ''), lambda x: CAST(ord(x) AS BIGINT)), lambda r, b: list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 20 AS h FROM k),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, UNNEST(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy FROM c WHERE h <> 0),
q AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth FROM d),
o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM q),
f AS (SELECT *, role[1:1] AS ini, CASE WHEN body = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN body[-1:] NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, LAG(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
g AS (SELECT conv_id, COALESCE(MAX(turn) - MIN(turn) + 1 - COUNT(DISTINCT turn), 0) AS gaps, COUNT(*) FILTER (fault = 'b') AS blank, COUNT(*) FILTER (fault = 'd') AS duplicate, COUNT(*) FILTER (fault = 't') AS truncated,
 COUNT(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal, list({'r': role, 'i': ini, 't': text, 'f': fault} ORDER BY i) AS rows FROM f GROUP BY conv_id),
-- n: nothing yet, s: after system, u: after user, b: after assistant; each the least (cost, audit).
z AS (SELECT conv_id, rows, 0 AS done, {'c': 0, 'a': ''} AS n, {'c': 9999999, 'a': ''} AS s, {'c': 2, 'a': 'I'} AS u, {'c': 4, 'a': 'II'} AS b FROM g
 UNION ALL SELECT conv_id, rows, done, n, s, list_sort([u, {'c': b.c + 2, 'a': b.a || 'I'}])[1], list_sort([b, {'c': u.c + 2, 'a': u.a || 'I'}])[1] FROM (
  SELECT conv_id, rows, done, n, s, list_sort([u, {'c': n.c + 2, 'a': n.a || 'I'}, {'c': s.c + 2, 'a': s.a || 'I'}])[1] AS u, b FROM (
   SELECT conv_id, rows, done + 1 AS done, {'c': n.c + 3, 'a': n.a || 'D'} AS n,
    list_sort([{'c': s.c + 3, 'a': s.a || 'D'}, {'c': n.c + t + k + CASE WHEN e.i = 's' THEN 0 ELSE 8999999 END, 'a': n.a || 'K'}])[1] AS s,
    list_sort([{'c': u.c + 3, 'a': u.a || 'D'}, {'c': least(n.c, s.c, b.c) + t + k + CASE WHEN e.i = 'u' THEN 0 ELSE 2 END, 'a': list_sort([n, s, b])[1].a || CASE WHEN e.i = 'u' THEN 'K' ELSE 'R' END}])[1] AS u,
    list_sort([{'c': b.c + 3, 'a': b.a || 'D'}, {'c': u.c + t + k + CASE WHEN e.i = 'a' THEN 0 ELSE 2 END, 'a': u.a || CASE WHEN e.i = 'a' THEN 'K' ELSE 'R' END}])[1] AS b
   FROM (SELECT *, rows[done + 1] AS e, CASE WHEN rows[done + 1].f = 't' THEN 1 ELSE 0 END AS t, CASE WHEN rows[done + 1].f IN ('b', 'd') THEN 8999999 ELSE 0 END AS k FROM z WHERE done < len(rows)) v) v) v),
e AS (SELECT conv_id, rows, list_sort([n, b])[1] AS best FROM z WHERE done = len(rows)),
x AS (SELECT conv_id, best, rows, UNNEST(string_split(best.a, '')) AS letter, generate_subscripts(string_split(best.a, ''), 1) AS j FROM e),
y AS (SELECT *, COUNT(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS r, COUNT(*) FILTER (letter <> 'D') OVER (PARTITION BY conv_id ORDER BY j) AS p FROM x),
m AS (SELECT conv_id, STRING_AGG(CASE WHEN letter = 'K' THEN rows[r].r WHEN (p + has_s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE rows[r].t END, chr(10) ORDER BY j) AS said
 FROM (SELECT *, MAX(CASE WHEN letter = 'K' AND p = 1 AND rows[r].i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS has_s FROM y) w WHERE letter <> 'D' GROUP BY conv_id)
SELECT a.conv_id, COALESCE(gaps, 0) AS gaps, COALESCE(blank, 0) AS blank, COALESCE(duplicate, 0) AS duplicate, COALESCE(truncated, 0) AS truncated, COALESCE(illegal, 0) AS illegal,
 CAST(COALESCE(best.c, 0) AS BIGINT) AS cost, COALESCE(best.a, '') AS audit, SHA256(COALESCE(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN g ON a.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN e ON a.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN m ON a.conv_id IS NOT DISTINCT FROM m.conv_id""",
    "op13_dual_tree_search": r"""
WITH t AS (SELECT doc_id, UNNEST(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
c AS (SELECT doc_id, term, COUNT(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT doc_id, SUM(tf) AS n FROM c GROUP BY 1),
g AS (SELECT COUNT(*) AS n_docs, SUM(n) AS n_terms FROM n),
w AS (SELECT term, CAST(FLOOR(1000 * LN((2 * MAX(n_docs) + 2) / (2 * COUNT(*) + 1))) AS BIGINT) AS w FROM c, g GROUP BY term),
q AS (SELECT DISTINCT item_id, UNNEST(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, CAST(SUM(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + CAST((90 * n * n_docs) // n_terms AS BIGINT))))) AS BIGINT) AS score
 FROM q JOIN w USING (term) JOIN c USING (term) JOIN n USING (doc_id), g GROUP BY ALL),
r AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10""",
}
