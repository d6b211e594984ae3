r"""Chat formatting with a grammar round trip.

A formatted conversation is a sequence of turns

    ### Role: text</turn>\n

Role is the role with its first letter in upper case where that can be undone, or
the role as it is after a colon (`### :Role: `). The control strings are the
headers' `### `, the `: ` inside a header and `</turn>`. A deterministic parser
reads a formatted text back: backslashes before a control string of a text stand
for one backslash less, and a control string without one ends the text.

Each turn is first rendered as it is, reparsed and compared. What does not come
back identical is rendered anew with the next stronger escaping until it does: one
more backslash before each control string in the text, then also after the text
where it ends in backslashes or in the beginning of a control string.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from starloom.llm.common import slices

HEAD, MID, END = "### ", ": ", "</turn>"
GUARD = "\\."  # after a text whose end would run into the closing mark; not part of the text
CONTROL = re.compile(r"(\\*)(### |</turn>)")
HEADER_CONTROL = re.compile(r"(\\*)(: |\n)")
CLOSE = re.compile(r"(\\*)</turn>")


def header(role: str) -> str:
    """Header of a turn. Lower-case roles are capitalised; all others follow a colon as they are."""
    if role and role == role.lower() and role.capitalize().lower() == role and ":" not in role and "\n" not in role and "\\" not in role:
        return HEAD + role.capitalize() + MID
    return HEAD + ":" + role.replace("\\", "\\\\").replace("\n", "\\n").replace(":", "\\:") + MID


def role_of(head: str) -> str:
    """The role between the marks of a header."""
    if not head.startswith(":"):
        return head.lower()
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], head[1:])


def render(role: str, text: str, strength: int) -> tuple[str, int, int]:
    """(formatted turn, start, end of its text). Strength 0: as it is, 1: control strings escaped, 2: end guarded."""
    head = header(role)
    body = CONTROL.sub(r"\1\\\2", text) if strength else text
    return head + body + (GUARD if strength > 1 else "") + END + "\n", len(head), len(head) + len(body)


def parse(formatted: str, at: int = 0) -> tuple[str, str, int] | None:
    """(role, text, where the next turn starts) of the turn at this place, or None if none stands there."""
    if not formatted.startswith(HEAD, at):
        return None
    own = formatted.startswith(":", at + len(HEAD))
    body = re.compile(r"(?:[^\\:]|\\.|:(?! ))*: " if not own else r":(?:[^\\:]|\\.)*: ", re.S).match(formatted, at + len(HEAD))
    if body is None:
        return None
    role = role_of(body[0][: -len(MID)])
    for close in CLOSE.finditer(formatted, body.end()):
        if not close[1]:
            text = formatted[body.end():close.start()]
            if text.endswith(GUARD):
                text = text[: -len(GUARD)]
            if any(not m[1] for m in CONTROL.finditer(text)):  # an open header inside a text
                return None
            if formatted[close.end():close.end() + 1] != "\n":
                return None
            return role, CONTROL.sub(lambda m: m[1][:-1] + m[2] if m[1] else m[0], text), close.end() + 1
    return None


def parse_all(formatted: str) -> list[tuple[str, str]] | None:
    """Turns (role, text) of a formatted conversation; None if it is not one."""
    out, at = [], 0
    while at < len(formatted):
        turn = parse(formatted, at)
        if turn is None:
            return None
        out.append(turn[:2])
        at = turn[2]
    return out


def format_turn(role: str, text: str) -> tuple[str, int, int, int]:
    """(formatted, start, end of the text, strength) with the least escaping that reads back identical."""
    for strength in range(3):
        out, start, end = render(role, text, strength)
        turn = parse(out)
        if turn is not None and turn[:2] == (role, text) and turn[2] == len(out):
            return out, start, end, strength
    raise ValueError(f"no escaping brings back the turn of role {role!r}")


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Formatted turns, in order within each task: (conv, position, formatted, start, loss_start, loss_end, escaping).

    start: the turn's first code point in its conversation; loss_start, loss_end:
    the span of an assistant's text there, null for other roles. Null roles and
    texts count as empty; turns of one number go by role and text, a null number
    first; repeated rows are repeated turns; a null conversation is one of its own.
    A conversation streams through its task turn by turn and is never held whole.
    """
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["conv"].dataType.simpleString()
    ordered = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, position, at = (), 0, 0
        for part in slices(batches):
            out = {c: [] for c in ("position", "formatted", "start", "loss_start", "loss_end", "escaping", "role")}
            for conv, role, text in zip(part["conv"], part["role"], part["text"]):
                if now != (conv,):
                    now, position, at = (conv,), 0, 0
                turn, start, end, strength = format_turn(role, text)
                loss = role == "assistant"
                for c, v in (("position", position), ("formatted", turn), ("start", at), ("loss_start", at + start if loss else None), ("loss_end", at + end if loss else None), ("escaping", strength), ("role", role)):
                    out[c].append(v)
                position, at = position + 1, at + len(turn)
            ints = ("position", "start", "loss_start", "loss_end")
            yield pa.RecordBatch.from_arrays(
                [pa.array(part["conv"], type=conv_type), *(pa.array(v, type=pa.int64() if c in ints else pa.int32() if c == "escaping" else pa.string()) for c, v in out.items())],
                names=["conv", *out],
            )

    from pyspark.sql.pandas.types import to_arrow_type

    conv_type = to_arrow_type(rows.schema["conv"].dataType)
    return ordered.mapInArrow(formatted, f"conv {kind}, position long, formatted string, start long, loss_start long, loss_end long, escaping int, role string")


def conversations(formatted: DataFrame) -> DataFrame:
    """(conv, formatted, loss_spans): one row per conversation, whole texts; each is one value in the end."""
    parts = F.array_sort(F.collect_list(F.struct("position", "formatted", "loss_start", "loss_end")))
    return formatted.groupBy("conv").agg(parts.alias("p")).select(
        "conv", F.concat_ws("", F.transform("p", lambda t: t["formatted"])).alias("formatted"),
        F.transform(F.filter("p", lambda t: t["loss_start"].isNotNull()), lambda t: F.struct(t["loss_start"], t["loss_end"])).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Digest of each conversation, parsed from the output of format_turns in its order.

    (conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_escaped).
    Keeps two running hashes per task, whatever a conversation's length.
    """
    kind = formatted.schema["conv"].dataType.simpleString()
    columns = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_escaped")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, turns, loss, count = (), None, None, None

        def batch(done: list) -> pa.RecordBatch:
            cols = list(zip(*done))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], type=conv_type), *(pa.array(c) for c in cols[1:])], names=["conv", *columns])

        def closed() -> tuple:
            return now[0], count[0], turns.hexdigest(), count[1], loss.hexdigest(), count[2], count[3]

        for part in slices(batches):
            done = []
            for conv, text, start, a, b, strength in zip(part["conv"], part["formatted"], part["start"], part["loss_start"], part["loss_end"], part["escaping"]):
                if now != (conv,):
                    if now:
                        done.append(closed())
                    now, turns, loss, count = (conv,), hashlib.sha256(), hashlib.sha256(), [0, 0, 0, 0]
                role, said, _ = parse(text)
                turns.update(f"{role}\n{said}\n".encode())
                if a is not None:
                    masked = CONTROL.sub(lambda m: m[1][:-1] + m[2] if m[1] else m[0], text[a - start:b - start])
                    loss.update(masked.encode())
                    count[1] += len(masked)
                count[0] += 1
                count[2] += len(text)
                count[3] += strength > 0
            if done:
                yield batch(done)
        if now:
            yield batch([closed()])

    from pyspark.sql.pandas.types import to_arrow_type

    conv_type = to_arrow_type(formatted.schema["conv"].dataType)
    return formatted.mapInArrow(digest, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_escaped long")
