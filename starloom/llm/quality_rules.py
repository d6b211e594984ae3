"""Quality rules as a ledger: measurements and one bit per failed rule, policies on top.

Every rule is evaluated once, over whole texts. A policy is a version, a mask of
the rules it enforces and a number of failures it forgives; applying one, or
finding out what dropping a rule would change, reads the bits only.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from starloom.llm.common import map_rows

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = re.compile(r"[#*$%&|<>]")

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "dup_line_chars", "n_upper", "n_letter_words", "n_chars")


def measure(text: str) -> tuple[int, ...]:
    """COUNTS of one text.

    n_dup_lines: lines that hold a word and equal an earlier line. n_repeat_words:
    words in some window of three that occurs twice or more, the first occurrence too.
    """
    words = WORDS.findall(text)
    n = len(words)
    seen: set[str] = set()
    dup = dup_chars = lines = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            lines += 1
            if line in seen:
                dup, dup_chars = dup + 1, dup_chars + len(line)
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    repeat = 0
    if len(set(windows)) < len(windows):
        count: dict[tuple, int] = {}
        for w in windows:
            count[w] = count.get(w, 0) + 1
        end = 0  # words before this one are accounted for
        for i, w in enumerate(windows):
            if count[w] > 1:
                repeat += i + 3 - max(i, end)
                end = i + 3
    joined = "".join(words)
    upper = sum(map(str.isupper, words))
    letters = sum([w.isalpha() for w in (w.strip(".,;:!?'\"()-") for w in words)])
    return n, len(joined), len(SYMBOLS.findall(text)), dup, repeat, lines, dup_chars, upper, letters, len(text)


@dataclass(frozen=True)
class Rule:
    """Fails where its condition on the measurements holds."""

    name: str
    fails: Callable[[dict[str, Column]], Column]


# Bit k of the ledger belongs to rule k; rules are only ever added at the end.
RULES = (
    Rule("few_words", lambda m: m["n_words"] < 50),
    Rule("repeated_words", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    Rule("symbols", lambda m: 10 * m["n_symbols"] > 3 * m["n_words"]),
    Rule("duplicate_lines", lambda m: 2 * m["n_dup_lines"] > m["n_lines"]),
    Rule("duplicate_line_chars", lambda m: 2 * m["dup_line_chars"] > m["n_chars"]),
    Rule("shouting", lambda m: 10 * m["n_upper"] > 5 * m["n_words"]),
    Rule("short_words", lambda m: m["word_chars"] < 2 * m["n_words"]),
    Rule("long_words", lambda m: m["word_chars"] > 15 * m["n_words"]),
    Rule("no_words_of_letters", lambda m: 10 * m["n_letter_words"] < 5 * m["n_words"]),
    Rule("many_words", lambda m: m["n_words"] > 100_000),
    Rule("repeated_words_mild", lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"]),
)
BIT = {rule.name: 1 << k for k, rule in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    version: str
    enforced: tuple[str, ...]
    forgiven: int = 0  # failures of other than base rules that are let pass

    @property
    def mask(self) -> int:
        return reduce(lambda a, b: a | b, (BIT[name] for name in self.enforced), 0)


BASE = ("few_words", "repeated_words")
POLICIES = {
    "v1": Policy("v1", BASE),
    "v2": Policy("v2", (*BASE, "symbols", "duplicate_lines", "duplicate_line_chars", "shouting", "short_words", "long_words", "no_words_of_letters")),
    "v3": Policy("v3", (*BASE, "symbols", "duplicate_lines", "duplicate_line_chars", "shouting", "short_words", "long_words", "no_words_of_letters", "many_words", "repeated_words_mild"), forgiven=1),
}


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, COUNTS, failures): each rule evaluated once per row.

    A null text counts as empty: no words, so it fails few_words. Repeated rows and
    null ids stay, other columns are not read, an empty table gives no rows.
    """
    def measured(part: dict[str, list]) -> dict[str, object]:
        rows = list(zip(*(measure(t or "") for t in part["text"])))
        return {"id": part["id"], **dict(zip(COUNTS, rows))}

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    counts = map_rows(rows, measured, f"id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))
    columns = {c: F.col(c) for c in COUNTS}
    bits = reduce(lambda a, b: a.bitwiseOR(b), (F.when(rule.fails(columns), F.lit(BIT[rule.name])).otherwise(F.lit(0)) for rule in RULES))
    return counts.select(F.col("id").alias(id_col), *COUNTS, bits.cast("long").alias("failures"))


def verdict(failures: Column, policy: Policy) -> Column:
    """Kept under a policy: no base rule failed and no more of the other rules than it forgives."""
    base = policy.mask & (BIT[BASE[0]] | BIT[BASE[1]])
    rest = policy.mask & ~base
    return (failures.bitwiseAND(F.lit(base)) == 0) & (F.bit_count(failures.bitwiseAND(F.lit(rest))) <= policy.forgiven)


def apply_policies(ledger_rows: DataFrame, versions: list[str]) -> DataFrame:
    """The ledger with a boolean kept_<version> for each policy."""
    return ledger_rows.select("*", *(verdict(F.col("failures"), POLICIES[v]).alias(f"kept_{v}") for v in versions))


def ablations(ledger_rows: DataFrame, policy: Policy) -> DataFrame:
    """Per enforced rule: (version, rule, n_failed, n_only, n_kept_without, n_rows).

    n_only: rows this rule alone rejects; n_kept_without: rows kept if it were not
    enforced. Rows are first summed by their bits, of which there are as many as
    combinations that occur, so hot combinations are one row per task.
    """
    by_bits = ledger_rows.groupBy(F.col("failures").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in policy.enforced))).alias("r")
    each = by_bits.select("bits", "n", rules).select("bits", "n", "r.rule", "r.bit")
    failed = F.col("bits").bitwiseAND(F.col("bit")) != 0
    without = verdict(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))), policy)
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy("rule").agg(
        n(failed).alias("n_failed"), n(F.col("bits") == F.col("bit")).alias("n_only"), n(without).alias("n_kept_without"), F.sum("n").alias("n_rows"),
    ).select(F.lit(policy.version).alias("version"), "*")
