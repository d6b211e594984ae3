"""Chat formatting: the round trip, its escapes and the digest read back from the output."""

import hashlib
import random

from starloom.llm import chat

PARTS = ["\\", "### ", "###", " ", "</turn>", "</turn", "<", "/turn>", ": ", ":", "\n", "a", "Assistant", "é", "\\.", "."]
ROLES = ["user", "assistant", "system", "", "User", "ß", "ǅ", "a b", "x:y", "x: y", "\n", "\\", "\\n", ":", ": ", "tool"]


def test_every_turn_reads_back():
    rng = random.Random(2)
    turns = [(rng.choice(ROLES), "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 9)))) for _ in range(8000)]
    made = [chat.format_turn(*t) for t in turns]
    assert {m[3] for m in made} == {0, 1, 2}
    for at in range(0, len(turns), 9):
        assert chat.parse_all("".join(m[0] for m in made[at:at + 9])) == turns[at:at + 9]


def test_control_strings_are_escaped():
    out, start, end, strength = chat.format_turn("assistant", "\\### Assistant: </turn> ok")
    assert strength == 1 and out == "### Assistant: \\\\### Assistant: \\</turn> ok</turn>\n"
    assert chat.format_turn("user", "### User: hi")[3] == 1
    assert chat.parse("### Assistant: ### User: open</turn>\n") is None and chat.parse("text") is None


def test_digest_of_conversations(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "a</turn>"), (1, 1, "assistant", None), (1, None, "system", "first"),
        (2, 5, None, ""), (None, 0, "assistant", "x\\"), (3, 0, "user", "y" * 100_000), (4, 0, "user", "same"), (4, 0, "user", "same"),
    ]
    # Extra columns with the names of the output must not matter.
    df = spark.createDataFrame([(*r, "z", 7) for r in rows], "conv_id long, turn long, role string, text string, formatted string, position int").repartition(3)
    made = chat.format_turns(df)
    got = {r.conv: r for r in chat.read_back(made).collect()}
    whole = {r.conv: r for r in chat.conversations(made).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for conv in got:
        turns = sorted(((-1 if t is None else t), r or "", x or "") for c, t, r, x in rows if c == conv)
        turns = [t[1:] for t in turns]
        said = "".join(x for r, x in turns if r == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert chat.parse_all(whole[conv].formatted) == turns and len(whole[conv].formatted) == got[conv].formatted_chars
        assert len(whole[conv].loss_spans) == sum(r == "assistant" for r, _ in turns)
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0
