"""Personal data in texts by weak supervision, in DataFrame functions only.

Patterns find candidates; regex, gazetteer, context and shape labelers vote on each.
Expectation-maximisation over the counts of vote patterns estimates how reliable every
labeler is, and the posteriors train a span classifier on votes and shape. Spans of the
base patterns stay; the classifier adds spans that those patterns miss or run past.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from starloom.session import cut_lineage

KINDS = ("email", "ip", "card", "phone", "secret")
ABSTAIN, YES, NO = 0, 1, 2
LABELERS = ("check", "gazetteer", "context", "shape", "border")
SHAPES = (("base", 2), ("digits", 4), ("separators", 2), ("letters", 2), ("after", 3))
# A code holds kind, votes and shape of a candidate; there are this many, whatever the corpus.
CODES = len(KINDS) * 3 ** len(LABELERS) * int(np.prod([n for _, n in SHAPES]))
ROUNDS, RIDGE = 40, 1.0
# How often a labeler that votes is right, before any text is seen. This counts as much as the
# candidates themselves, and as PSEUDO of them at least: what decoys and private data have in
# common doesn't outvote a checksum.
TRUST, PSEUDO = (0.97, 0.75, 0.75, 0.6, 0.6), 10.0
CONTEXT = 40  # characters before a candidate that the context labeler reads
BLOCK = 128

# --- Fixed values: patterns of the base spans and of further candidates -------------------------
# Possessive repeats match what plain ones would, without a stack that grows with the text.
_LOCAL = r"[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# In what a base pattern matched but failed its check.
INSIDE = {
    "card": r"(?<![0-9])(?:[0-9]{4}(?:[\x20-][0-9]{4}){3}|[0-9]{13,19})(?![0-9])",
    "phone": r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)[\x20.-]?[0-9]{2,4}[\x20.-][0-9]{2,4}|[0-9]{2,4}(?:[\x20.-][0-9]{2,4}){2,3})(?!\.?[0-9])",
}
# Between base matches.
BETWEEN = {
    "email": r"(?i)(?<![\p{L}0-9._%+-])[a-z0-9][a-z0-9._%+-]{0,63}\x20?(?:@|\[at\]|\(at\)|\x20at\x20)\x20?[a-z0-9-]{1,63}(?:\x20?(?:\.|\[dot\]|\(dot\)|\x20dot\x20)\x20?[a-z0-9-]{2,63}){1,4}",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "phone": r"(?<![0-9A-Za-z+(.,/-])(?:00[1-9][0-9]{0,2}[\x20.-])?(?:\([0-9]{2,5}\)[\x20]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
    "secret": r"(?i)(?<![a-z])(?:[a-z]{1,12}[_-])?(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key)[\"']?[\x20]{0,3}[=:][\x20]{0,3}[\"']?[a-z0-9+/_-]{8,256}(?![a-z0-9+/_-])",
}
SECRET_NAME = r"(?i)^[^=:]*[=:][\x20]{0,3}[\"']?"
# A text is searched only where its kind's pattern can match at all.
NEEDS = {
    "email": lambda t: F.contains(t, F.lit("@")) | t.rlike(r"(?i)[\[(](?:at|dot)[\])]|\x20dot\x20"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]|:[0-9A-Fa-f]{1,4}:"),
    "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"),
    "phone": lambda t: t.rlike(r"\+[0-9]|[0-9][\x20.)-][\x20]?[0-9]"),
    "secret": lambda t: t.rlike(r"(?i)token|secret|passw|pwd|key"),
}
TOP_DOMAINS = "com org net edu gov mil int info biz name io co me dev app de fr es it nl be at ch pt pl se no dk fi ie uk us ca au nz in cn jp kr br mx ru za eu".split()
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 218 351 352 353 354 355 358 359 370 371 372 380 381 385 386 420 421 852 880 886 961 962 965 966 971 972".split()
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[0-689]|6)"
WORDS = {
    "email": "e-?mail|mail|contact|write|reach|adresse|correo|courriel|kontakt",
    "ip": "ip|address|host|server|adresse|client|login",
    "card": "card|visa|mastercard|amex|credit|debit|payment|karte|tarjeta|carte",
    "phone": "tel|phone|call|mobile|cell|fax|telefon|telefono|telephone|whatsapp|sms",
    "secret": "config|credential|login|export|header|bearer|env",
}
AGAINST = {
    "email": "example of|matches|regex",
    "ip": "version|release|section|chapter|v",
    "card": "order|invoice|tracking|serial|isbn|reference|ref|ticket|item",
    "phone": "version|isbn|issn|order|invoice|serial|page|seite|doi",
    "secret": "sample|placeholder|dummy|fake",
}
# ------------------------------------------------------------------------------------------------


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(steps: Column) -> Column:
    """Sums of the first 1, 2, ... numbers of an array, by blocks."""
    number = lambda i: (i / BLOCK).cast("int")
    add = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)

    def of(s: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), number(F.greatest(F.size(s) - 1, F.lit(0)))), lambda b: add(F.slice(s, b * BLOCK + 1, F.lit(BLOCK))))
        starts = let(blocks, lambda all_: F.transform(all_, lambda _, b: add(F.slice(all_, F.lit(1), b))))
        return let(starts, lambda at: F.transform(s, lambda _, i: F.element_at(at, number(i) + 1) + add(F.slice(s, number(i) * BLOCK + 1, i % BLOCK + 1))))

    return let(steps, of)


def matches(text: Column, pattern: str, offset: Column | None = None) -> Column:
    """Array of (start, end, said, gap before it, next character), by position in code points, and a last one for the rest (said null)."""
    offset = F.lit(0).cast("long") if offset is None else offset

    def of(v: Column) -> Column:
        size = lambda s: F.coalesce(F.length(s), F.lit(0)).cast("long")
        ends = running(F.zip_with(v["gaps"], v["said"], lambda g, s: size(g) + size(s)))
        return let(
            F.struct(ends.alias("ends"), v["gaps"].alias("gaps"), v["said"].alias("said")),
            lambda w: F.transform(
                w["ends"],
                lambda end, i: let(
                    F.get(w["said"], i),
                    lambda said: F.struct(
                        (end - size(said) + offset).alias("start"), (end + offset).alias("end"), said.alias("said"),
                        F.get(w["gaps"], i).alias("gap"), F.coalesce(F.substring(F.get(w["gaps"], i + 1), 1, 1), F.lit("")).alias("after"),
                    ),
                ),
            ),
        )

    return let(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("said")), of)


def vote(yes: Column, no: Column | None = None) -> Column:
    said = F.when(yes, YES)
    return F.coalesce((said.when(no, NO) if no is not None else said).otherwise(ABSTAIN), F.lit(ABSTAIN))


def digits(said: Column) -> Column:
    return F.regexp_replace(said, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether 13 to 19 digits pass Luhn's check."""
    n = F.length(d)
    double = lambda x: F.when(x > 4, x * 2 - 9).otherwise(x * 2)
    each = lambda i: let(F.substring(d, i, F.lit(1)).cast("int"), lambda x: F.when((n - i) % 2 == 1, double(x)).otherwise(x))
    return F.when(n.between(13, 19), F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda a, i: a + each(i)) % 10 == 0).otherwise(False)


_PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9][0-9]|[1-9])?+"
PASSES: dict[str, Callable[[Column], Column]] = {
    "email": lambda said: F.lit(True),
    "ip": lambda said: said.rlike(rf"\A(?:{_PART}\.){{3}}{_PART}\z"),
    "card": lambda said: let(digits(said), luhn),
    "phone": lambda said: F.length(digits(said)).between(9, 15),
}


def votes(kind: str, said: Column, before: Column, after: Column) -> list[Column]:
    """One column per labeler."""
    d = digits(said)
    context = vote(before.rlike(rf"(?i)(?<![\p{{L}}])(?:{WORDS[kind]})[^\p{{L}}0-9\n]{{0,6}}\z"), before.rlike(rf"(?i)(?<![\p{{L}}])(?:{AGAINST[kind]})[^\p{{L}}0-9\n]{{0,6}}\z"))
    border = vote(~(before.rlike(r"[\p{L}0-9]\z") | after.rlike(r"[\p{L}0-9]")), before.rlike(r"[\p{L}0-9]\z") | after.rlike(r"[\p{L}0-9]"))
    dull = said.rlike(r"([0-9A-Za-z])\1{7}")
    if kind == "email":
        plain = F.regexp_replace(F.regexp_replace(said, r"(?i)\x20?(?:\[at\]|\(at\)|\x20at\x20|@)\x20?", "@"), r"(?i)\x20?(?:\[dot\]|\(dot\)|\x20dot\x20)\x20?", ".")
        check = plain.rlike(r"\A[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,63})@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,}\z")
        known = F.lower(F.regexp_extract(plain, r"\.([A-Za-z0-9-]+)\z", 1)).isin(TOP_DOMAINS)
        odd = plain.rlike(r"\.\.|\.@|-\.")
        return [vote(check, ~check), vote(known, ~known), context, vote(said.rlike("@"), odd | said.rlike(r"(?i)\x20at\x20")), border]
    if kind == "ip":
        v4 = said.rlike(r"\A[0-9.]+\z")
        check = F.when(v4, PASSES["ip"](said)).otherwise(True)
        reserved = said.rlike(r"\A(?:0|127|255)\.")
        return [vote(check, ~check), vote(~reserved, reserved), context, vote(~said.rlike(r"(?:\A|\.)0[0-9]"), said.rlike(r"(?:\A|\.)0[0-9]")), border]
    if kind == "card":
        check, known = let(d, luhn), d.rlike(ISSUERS)
        return [vote(check, ~check), vote(known, ~known), context, vote((F.length(d) == 16) & ~dull, dull), border]
    if kind == "phone":
        check = F.length(d).between(10, 15)
        plus = said.rlike(r"\A(?:\+|00)")
        known = F.regexp_extract(said, r"\A(?:\+|00)([0-9]{1,3})", 1)
        listed = known.isin(CALLING_CODES) | F.substring(known, 1, 2).isin(CALLING_CODES) | F.substring(known, 1, 1).isin(CALLING_CODES)
        return [vote(check, ~check), vote(plus & listed, plus & ~listed), context, vote(said.rlike(r"\([0-9]{2,5}\)"), dull | said.rlike(r"\A[0-9]{3}\.[0-9]{3}\.")), border]
    value = F.regexp_replace(said, SECRET_NAME, "")
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    long = F.length(value) >= 16
    return [vote(mixed & long, ~mixed), vote(said.rlike(r"(?i)\A(?:token|secret|password|api[_-]?key|access[_-]?key)"), F.lit(False)), context, vote(value.rlike(r"\A(?:[0-9a-fA-F]{16,}|[A-Za-z0-9+/_-]{20,})\z") & ~dull, dull | value.rlike(r"\A[A-Za-z_-]+\z")), border]


def shape(base: Column, said: Column, after: Column) -> list[Column]:
    n = F.length(digits(said))
    return [
        base.cast("int"), F.when(n <= 10, 0).when(n <= 12, 1).when(n <= 15, 2).otherwise(3),
        said.rlike(r"[\x20().-]").cast("int"), said.rlike(r"[A-Za-z]").cast("int"),
        F.when((after == "") | after.rlike(r"\s"), 0).when(after.rlike(r"[\p{L}0-9]"), 2).otherwise(1),
    ]


def coded(kind: str, found: Column, base: bool) -> Column:
    """(kind, start, end, base, code) of each match."""
    k = KINDS.index(kind)

    def of(m: Column) -> Column:
        before = F.substring(m["gap"], -CONTEXT, CONTEXT)
        code = F.lit(k)
        for part in votes(kind, m["said"], before, m["after"]):
            code = code * 3 + part
        for part, (_, n) in zip(shape(F.lit(base), m["said"], m["after"]), SHAPES):
            code = code * n + part
        start = m["start"] + F.length(F.regexp_extract(m["said"], SECRET_NAME, 0)) if kind == "secret" else m["start"]
        return F.struct(F.lit(k).alias("kind"), start.alias("start"), m["end"].alias("end"), F.lit(base).alias("base"), code.cast("int").alias("code"))

    return F.transform(found, of)


def within(outer: Column, found: Column) -> Column:
    """Matches inside another one, with what stands around it."""
    before = F.substring(outer["gap"], -CONTEXT, CONTEXT)
    return F.transform(
        found,
        lambda m, i: F.struct(
            m["start"].alias("start"), m["end"].alias("end"), m["said"].alias("said"),
            F.when(i == 0, F.concat(before, m["gap"])).otherwise(m["gap"]).alias("gap"),
            F.when(m["end"] == outer["end"], outer["after"]).otherwise(m["after"]).alias("after"),
        ),
    )


def candidates_of(kind: str, text: Column) -> Column:
    """All candidates of a kind in a text: base spans, what failed base matches hold, what stands between them."""
    if kind not in BASE:
        found = coded(kind, F.filter(matches(text, BETWEEN[kind]), lambda m: m["said"].isNotNull()), False)
    else:

        def of(all_: Column) -> Column:
            told = lambda m: m["said"].isNotNull()
            good = F.filter(all_, lambda m: told(m) & PASSES[kind](m["said"]))
            parts = [coded(kind, good, True)]
            if kind in INSIDE:
                bad = F.filter(all_, lambda m: told(m) & ~PASSES[kind](m["said"]))
                inner = F.flatten(F.transform(bad, lambda m: within(m, matches(m["said"], INSIDE[kind], m["start"]))))
                parts.append(coded(kind, F.filter(inner, told), False))
            if kind in BETWEEN:
                inner = F.flatten(F.transform(all_, lambda m: matches(m["gap"], BETWEEN[kind], m["start"] - F.length(m["gap"]))))
                parts.append(coded(kind, F.filter(inner, told), False))
            return F.concat(*parts)

        found = let(matches(text, BASE[kind]), of)
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint,base:boolean,code:int>>")
    return F.when(NEEDS[kind](text), found).otherwise(none)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and its candidates: array of (kind, start, end, base, code)."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text")).select("doc_id", F.concat(*(candidates_of(k, F.col("text")) for k in KINDS)).alias("found"))


def decode(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kinds, votes and shapes of codes."""
    rest, shapes = codes.copy(), []
    for _, n in reversed(SHAPES):
        shapes.append(rest % n)
        rest //= n
    said = []
    for _ in LABELERS:
        said.append(rest % 3)
        rest //= 3
    return rest, np.array(said[::-1]).T.reshape(-1, len(LABELERS)), np.array(shapes[::-1]).T.reshape(-1, len(SHAPES))


def posteriors(said: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability that vote patterns are private data, and P(vote | class) per labeler, by EM from counts.

    It starts from TRUST and never leaves it wholly.
    """
    trust, pseudo = np.array(TRUST), max(PSEUDO, n.sum())
    cast = np.array([[(n * (said[:, k] == v)).sum() for v in range(3)] for k in range(said.shape[1])]) + 1.0
    silent = cast[:, ABSTAIN] / cast.sum(axis=1)
    start = np.stack([np.stack([silent, (1 - silent) * p, (1 - silent) * (1 - p)], axis=1) for p in (1 - trust, trust)])
    table, prior = start, 0.5
    labelers = np.arange(said.shape[1])
    for _ in range(ROUNDS):
        logs = np.stack([np.log(table[z][labelers, said]).sum(axis=1) for z in (0, 1)]) + np.log([[1 - prior], [prior]])
        p = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        weight = np.stack([n * (1 - p), n * p])
        seen = np.stack([np.stack([(weight[z][:, None] * (said == v)).sum(axis=0) for v in range(3)], axis=1) for z in (0, 1)])
        table = seen + pseudo * start
        table = table / table.sum(axis=2, keepdims=True)
        prior = (weight[1].sum() + PSEUDO / 2) / (n.sum() + PSEUDO)
    return p, table


def features(kinds: np.ndarray, said: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """Every vote and shape as indicators, apart for each kind."""
    columns = [np.ones(len(kinds))] + [said[:, k] == v for k in range(said.shape[1]) for v in (YES, NO)]
    columns += [shapes[:, k] == v for k, (name, n) in enumerate(SHAPES) if name != "base" for v in range(1, n)]
    one = np.array(columns, dtype=float).T
    return np.concatenate([one * (kinds == k)[:, None] for k in range(len(KINDS))], axis=1)


def fitted(x: np.ndarray, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic regression on soft labels, by Newton's steps."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * q * (1 - q))[:, None]).T @ x + RIDGE * np.eye(len(w)), x.T @ (n * (p - q)) - RIDGE * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def private_codes(counts: dict[int, int]) -> list[int]:
    """Codes the span classifier takes for private data, learned from how often each code occurs."""
    if not counts:
        return []
    codes, n = np.array(sorted(counts), dtype=np.int64), np.array([counts[c] for c in sorted(counts)], dtype=float)
    kinds, said, shapes = decode(codes)
    p = np.zeros(len(codes))
    for k in np.unique(kinds):
        own = kinds == k
        p[own] = posteriors(said[own], n[own])[0]
    x = features(kinds, said, shapes)
    return codes[x @ fitted(x, p, n) > 0].tolist()


def find_private(docs: DataFrame) -> DataFrame:
    """doc_id and spans: array of (kind, start, end, base), by KINDS' order and start; ends are exclusive, in code points.

    docs: doc_id, text; other columns are not read. Base spans are all there; others are
    those of the span classifier, which never overlap a base span of their kind. Null
    texts are empty and have no spans; every row has its own result, also with a doc_id
    that occurs twice. An empty table gives none. What is learned hangs on the whole
    table; only counts by code reach the driver, at most CODES rows.
    """
    found = cut_lineage(candidates(docs))
    counts = found.select(F.explode("found.code").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    private = private_codes({r.code: r.n for r in counts.collect()})
    kept = F.filter("found", lambda c: c["base"] | c["code"].isin(private))
    name = lambda c: F.element_at(F.array(*map(F.lit, KINDS)), c["kind"] + 1)
    spans = F.transform(F.array_sort(kept), lambda c: F.struct(name(c).alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base")))
    return found.select("doc_id", spans.alias("spans"))
