"""Conversation structure repair: generalised LR parsing of roles with weighted edits.

A conversation's role initials should read (s?(ua)+)?. The rows that do not fit are
deleted, reroled, or missing turns inserted, at the least total cost. Stacks of the
LR automaton live in one graph of shared nodes; equal stack tops are one node and keep
the least (cost, audit) only, so a row costs a handful of steps however many repairs
there are. Edits on which all live stacks agree are given out at once, so a long
conversation is never held whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from starloom.llm.common import slices

# The role grammar: a conversation is nothing, or a head and a body of exchanges.
GRAMMAR = (("C", ""), ("C", "HB"), ("H", ""), ("H", "s"), ("B", "Bua"), ("B", "ua"))
START, END, INSERTED = "C", "$", "ua"
ROLES = {"u": "user", "a": "assistant"}
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1  # Keep costs nothing
SPACE = " \t\n\x0b\x0c\r"
# From any stack, two insertions and one row deleted lead to where any other repair may end, so
# a repair dearer than the cheapest by more than this can't win.
REACH = 2 * INSERT + DELETE
PENDING = 512  # rows between two looks for edits that are settled

TURNS = "conv_id bigint, step bigint, action string, role string, text string, turn bigint, was_role string, fault string, cost bigint"
DIGESTS = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


class Automaton:
    """SLR(1) tables of a grammar of one-letter symbols; capitals are its nonterminals."""

    def __init__(self, grammar: tuple[tuple[str, str], ...], start: str) -> None:
        self.rules = ((start + "'", start), *grammar)
        heads = {head for head, _ in self.rules}
        empty, first, follow = set(), {h: set() for h in heads}, {h: set() for h in heads}
        follow[start + "'"].add(END)
        for _ in range(len(self.rules) * len(heads) + 1):  # more rounds than sets can grow in
            for head, body in self.rules:
                for symbol in body:
                    first[head] |= first.get(symbol, {symbol})
                    if symbol not in empty:
                        break
                else:
                    empty.add(head)
                after = set(follow[head])
                for symbol in reversed(body):
                    if symbol in heads:
                        follow[symbol] |= after
                        after = first[symbol] | (after if symbol in empty else set())
                    else:
                        after = {symbol}
        self.follow = follow
        self.states = [self.closure({(0, 0)})]
        self.goto: dict[tuple[int, str], int] = {}
        for number, state in enumerate(self.states):  # grows while it is read
            for symbol in sorted({self.rules[r][1][at] for r, at in state if at < len(self.rules[r][1])}):
                to = self.closure({(r, at + 1) for r, at in state if self.rules[r][1][at : at + 1] == symbol})
                if to not in self.states:
                    self.states.append(to)
                self.goto[number, symbol] = self.states.index(to)

    def closure(self, items: set[tuple[int, int]]) -> frozenset:
        todo, found = list(items), set(items)
        while todo:
            r, at = todo.pop()
            symbol = self.rules[r][1][at : at + 1]
            for k, (head, _) in enumerate(self.rules):
                if head == symbol and (k, 0) not in found:
                    found.add((k, 0))
                    todo.append((k, 0))
        return frozenset(found)


class Stack:
    """A node of the stack graph: a state on top of a shared lower part."""

    __slots__ = ("above", "below", "machine", "next", "state")

    def __init__(self, machine: Automaton, state: int = 0, below: Stack | None = None) -> None:
        self.machine, self.state, self.below = machine, state, below
        self.above: dict[int, Stack] = {}
        self.next: dict[str, tuple[Stack, ...]] = {}

    def push(self, state: int) -> Stack:
        if state not in self.above:
            self.above[state] = Stack(self.machine, state, self)
        return self.above[state]

    def after(self, symbol: str) -> tuple[Stack, ...]:
        """All stacks after the reductions that symbol allows and its shift; at the end mark, those that accept."""
        if symbol not in self.next:
            m, found, seen, todo = self.machine, {}, {self}, [self]
            while todo:
                top = todo.pop()
                if symbol != END and (top.state, symbol) in m.goto:
                    found[top.push(m.goto[top.state, symbol])] = None
                for r, at in m.states[top.state]:
                    head, body = m.rules[r]
                    if at < len(body) or symbol not in m.follow[head]:
                        continue
                    if r == 0:
                        found[top] = None
                        continue
                    low = top
                    for _ in body:
                        low = low.below
                    reduced = low.push(m.goto[low.state, head])
                    if reduced not in seen:
                        seen.add(reduced)
                        todo.append(reduced)
            self.next[symbol] = tuple(found)
        return self.next[symbol]


class Edit:
    """The last edit of a repair; earlier ones are shared with other repairs."""

    __slots__ = ("before", "cost", "count", "letter", "role")

    def __init__(self, before: Edit | None, letter: str, role: str | None, cost: int) -> None:
        self.before, self.letter, self.role, self.cost = before, letter, role, cost
        self.count = before.count + 1 if before else 0


def beats(a: Edit, b: Edit) -> bool:
    """Whether repair a has the lower (cost, audit)."""
    if a.cost != b.cost:
        return a.cost < b.cost
    left, right = [], []
    while a is not b:
        longer = a.count >= b.count
        if b.count >= a.count:
            right.append(b.letter)
            b = b.before
        if longer:
            left.append(a.letter)
            a = a.before
    return left[::-1] < right[::-1]


class Repair:
    """The repair of one conversation, row by row."""

    def __init__(self, root: Stack) -> None:
        self.root, self.settled = root, Edit(None, "", None, 0)
        self.tops: dict[Stack, Edit] = {root: self.settled}
        self.insertions()

    def merge(self, tops: dict[Stack, Edit], stack: Stack, edit: Edit) -> bool:
        old = tops.get(stack)
        if old is None or beats(edit, old):
            tops[stack] = edit
            return True
        return False

    def insertions(self) -> None:
        todo = list(self.tops)
        while todo:
            top = todo.pop()
            edit = self.tops[top]
            for symbol in INSERTED:
                for to in top.after(symbol):
                    if self.merge(self.tops, to, Edit(edit, "I", ROLES[symbol], edit.cost + INSERT)):
                        todo.append(to)

    def row(self, initial: str, must_go: bool, truncated: bool) -> None:
        tops: dict[Stack, Edit] = {}
        more = TRUNCATED if truncated else 0
        for top, edit in self.tops.items():
            self.merge(tops, top, Edit(edit, "D", None, edit.cost + DELETE))
            if must_go:
                continue
            for to in top.after(initial) if initial else ():
                self.merge(tops, to, Edit(edit, "K", None, edit.cost + more))
            for symbol, role in ROLES.items():
                for to in top.after(symbol):
                    self.merge(tops, to, Edit(edit, "R", role, edit.cost + REROLE + more))
        least = min(edit.cost for edit in tops.values())
        self.tops = {top: edit for top, edit in tops.items() if edit.cost <= least + REACH}
        self.insertions()

    def take(self, last: Edit) -> list[Edit]:
        """Edits from the last settled one to this one, which is settled now."""
        out, edit = [], last
        while edit is not self.settled:
            out.append(edit)
            edit = edit.before
        self.settled = last
        return out[::-1]

    def agreed(self) -> list[Edit]:
        """Edits that all live repairs share."""
        ends = list(self.tops.values())
        common = ends[0]
        for other in ends[1:]:
            while common is not other:
                a, b = common.count, other.count
                common = common.before if a >= b else common
                other = other.before if b >= a else other
        return self.take(common)

    def finish(self) -> list[Edit]:
        best = None
        for top, edit in self.tops.items():
            if top.after(END) and (best is None or beats(edit, best)):
                best = edit
        return self.take(best)


def faults(text: str, seen: bool) -> str | None:
    kept = text.rstrip(SPACE)
    if not kept:
        return "blank"
    if seen:
        return "duplicate"
    return None if kept[-1] in ".!?" else "truncated"


def repair_turns(turns: DataFrame) -> DataFrame:
    """The edits that repair each conversation, in order, with the least cost and then the least audit.

    turns: conv_id, turn, role, text; other columns are not read. Returns a row per edit:
    action K (kept), R (reroled), D (deleted) or I (inserted), the role and text it
    leaves (null if deleted), the row's turn, role and first fault, and its cost; step
    counts from 0 within the conversation. Rows of a conversation come in order of
    turn (nulls first), role, text. The partitions are by conversation and sorted.

    Null roles and texts count as one space, which fits no role. Repeated rows are
    duplicates from the second on. Null conversation ids are one conversation. An empty
    table gives none.
    """
    rows = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    # The first of equal rows is found by a shuffle of its own: no set of earlier texts in a task.
    same = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    first = Window.partitionBy("conv_id", "_same").orderBy(F.col("turn").asc_nulls_first())
    rows = rows.withColumn("_same", same).withColumn("_seen", F.row_number().over(first) > 1).drop("_same")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "_seen")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in TURNS.split(", ")]
        types = [pa.string() if part.endswith("string") else pa.int64() for part in TURNS.split(", ")]
        root = Stack(Automaton(GRAMMAR, START))
        repair, conv, step, last_cost, pending, out = None, None, 0, 0, [], []

        def tell(edits: list[Edit]) -> None:
            nonlocal step, last_cost, pending
            used = 0
            for edit in edits:
                turn = was = text = fault = None
                if edit.letter != "I":
                    turn, was, text, fault = pending[used]
                    used += 1
                role = edit.role if edit.letter in "IR" else was if edit.letter == "K" else None
                text = "" if edit.letter == "I" else None if edit.letter == "D" else text
                out.append((conv, step, edit.letter, role, text, turn, was, fault, edit.cost - last_cost))
                step, last_cost = step + 1, edit.cost
            pending = pending[used:]

        def drained() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), types)], names=names)
                out.clear()

        for part in slices(batches):
            for key, turn, role, text, seen in zip(part["conv_id"], part["turn"], part["role"], part["text"], part["_seen"]):
                if repair is None or key != conv:
                    if repair:
                        tell(repair.finish())
                    repair, conv, step, last_cost, pending = Repair(root), key, 0, 0, []
                fault = faults(text, seen)
                pending.append((turn, role, text, fault))
                repair.row(role[:1], fault in ("blank", "duplicate"), fault == "truncated")
                if len(pending) % PENDING == 0:
                    tell(repair.agreed())
            yield from drained()
        if repair:
            tell(repair.finish())
            yield from drained()

    return rows.mapInArrow(run, TURNS)


def summaries(edits: DataFrame) -> DataFrame:
    """A row per conversation of repair_turns: faults, cost, audit and the digest of what is left.

    Reads edits as repair_turns leaves them, partitioned by conversation and in order.
    gaps: turns missing between the least and the greatest; illegal: neighbours among the
    original rows whose initials are not su, ua or au.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, state = [], None

        def done() -> tuple:
            counts, turns = state["counts"], state["turns"]
            gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
            return (state["conv"], gaps, *counts, state["illegal"], state["cost"], "".join(state["audit"]), state["sha"].hexdigest())

        def batch() -> pa.RecordBatch:
            fields = [part.split() for part in DIGESTS.split(", ")]
            arrays = [pa.array(c, type=pa.string() if t == "string" else pa.int64()) for c, (_, t) in zip(zip(*out), fields)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in fields])

        for part in slices(batches):
            for conv, step, action, role, text, turn, was, fault, cost in zip(*(part[c.split()[0]] for c in TURNS.split(", "))):
                if step == 0:
                    if state:
                        out.append(done())
                    state = {"conv": conv, "counts": [0, 0, 0], "turns": None, "illegal": 0, "cost": 0, "audit": [], "sha": hashlib.sha256(), "any": False, "was": None}
                state["audit"].append(action)
                state["cost"] += cost
                if fault:
                    state["counts"][("blank", "duplicate", "truncated").index(fault)] += 1
                if action != "I":
                    initial = was[:1]
                    if state["was"] is not None and state["was"] + initial not in ("su", "ua", "au"):
                        state["illegal"] += 1
                    state["was"] = initial
                    if turn is not None:
                        low, high, n = state["turns"] or (turn, turn, 0)
                        state["turns"] = (low, turn, n + (n == 0 or turn != high))
                if action != "D":
                    state["sha"].update((("\n" if state["any"] else "") + f"{role}:{text}").encode())
                    state["any"] = True
            if out:
                yield batch()
        if state:
            out.append(done())
            yield batch()

    return edits.mapInArrow(run, DIGESTS)
