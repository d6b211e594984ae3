"""Token counts by a byte-pair tokenizer compiled to deterministic transducers.

Two machines read a text once:

* the *splitter*, a transducer over character classes, cuts the text into pieces
  with a delay of at most two characters;
* the *piece transducer* reads a piece's bytes. Its state after a byte is the last
  token of each prefix that the longest token can reach back to; each transition
  carries the change of the number of emitted tokens. A prefix has exactly one
  last token: the token that ends it and may follow the last token of what
  precedes. Two tokens may follow each other when merging their joined bytes
  gives these two tokens again.

A text is read in chunks. A chunk's state map is (head, count, tail). Between two
characters of different kinds every state of the splitter goes over to the same
state (but for an apostrophe before a letter, and after white space), so what lies
between the first and the last such place of a chunk has one count whatever came
before, and only the open head and tail, parts of one piece each, wait for the
neighbours. State maps compose associatively, and the up-sweep of a prefix scan
composes those of a text. Parts of a piece stay in the chunks they came from until
the piece is whole, so every character is read a fixed number of times.
"""

from __future__ import annotations

import json
import re
import unicodedata

from pyspark.sql import DataFrame, functions as F

from starloom.llm.common import map_rows, per_process

CHUNK = 1 << 14      # code points in a chunk
REMEMBERED = 800_000  # words whose path through the transducers a worker remembers

# White space as Unicode's White_Space property has it.
SPACES = set("\t\n\v\f\r \x85\xa0                　")
# An apostrophe and these letters make a piece of their own.
ENDINGS = {"s": None, "t": None, "m": None, "d": None, "r": "e", "v": "e", "l": "l"}
_SPACE = "".join(sorted(SPACES))
# Words with the white space before them: what follows other characters begins anew at white space.
WORDS = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
STRETCH = 1 << 12    # bytes of a piece between two cuts of what the transducer remembers


def byte_letters() -> dict[str, int]:
    """Printable stand-ins of bytes: printable ones for themselves, others from 256 on."""
    plain = {b for lo, hi in ((33, 126), (161, 172), (174, 255)) for b in range(lo, hi + 1)}
    out, others = {}, 0
    for b in range(256):
        if b in plain:
            out[chr(b)] = b
        else:
            out[chr(256 + others)] = b
            others += 1
    return out


class Splitter:
    """Pieces of a text: words with the space before them, digits, signs, white space, endings.

    States: S start or after a full stop of a piece, P one space, W one other white
    space, R a longer run of white space, L letters, N digits, O other signs,
    A an apostrophe that starts a piece, E an apostrophe and r, v or l, C a whole ending.
    """

    def __init__(self):
        self.kinds: dict[str, str] = {}

    def kind(self, c: str) -> str:
        k = self.kinds.get(c)
        if k is None:
            k = "w" if c in SPACES else {"L": "l", "N": "n"}.get(unicodedata.category(c)[0], "o")
            self.kinds[c] = k
        return k

    def resets(self, a: str, b: str) -> bool:
        """Whether a piece ends between these two characters and the next begins as at a text's start, whatever came before."""
        before, after = self.kind(a), self.kind(b)
        return before != after and before != "w" and not (a == "'" and after == "l")

    def pieces(self, text: str) -> list[str]:
        out: list[str] = []
        start, state, n = 0, "S", len(text)
        for i in range(n):
            c = text[i]
            k = self.kind(c)
            if state == "E":
                if c == ENDINGS[text[i - 1]]:
                    state = "C"
                    continue
                out.append(text[start:i - 1])  # a bare apostrophe; the letter starts a word
                start, state = i - 1, "L"
            if state == "A" and k == "l" and c in ENDINGS:
                state = "C" if ENDINGS[c] is None else "E"
                continue
            if k == "w":
                if state in "PWR":
                    state = "R"
                    continue
            elif k == {"L": "l", "N": "n", "O": "o", "A": "o"}.get(state):
                state = "O" if k == "o" else state
                continue
            elif state == "P":  # the space belongs to what follows
                state = k.upper()
                continue
            elif state == "R":  # of a run of white space, the last character is left over
                out.append(text[start:i - 1])
                start = i - 1
                if text[start] == " ":
                    state = k.upper()
                    continue
            if start < i:
                out.append(text[start:i])
            start = i
            state = ("P" if c == " " else "W") if k == "w" else "A" if c == "'" else k.upper()
        if state == "E":
            out.append(text[start:n - 1])
            start = n - 1
        if start < n:
            out.append(text[start:])
        return out


class PieceTransducer:
    """Reads bytes; each transition adds a number of tokens (it may be none or below none)."""

    def __init__(self, vocab: dict[str, int], merges: list):
        letters = byte_letters()
        code = lambda s: bytes(letters[c] for c in s)
        self.token = {code(s): i for s, i in vocab.items()}
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(merges):
            a, b = (code(s) for s in (pair.split(" ") if isinstance(pair, str) else pair))
            key = (self.token[a], self.token[b])
            self.merged[key] = rank
            self.parts[self.token[a + b]] = (rank, *key)
        self.backward: dict[int, int] = {}  # trie of the tokens read from their ends: (node, byte) to node
        self.ends = [-1]  # the token that starts at a node, if any
        for t, number in self.token.items():
            node = 0
            for byte in reversed(t):
                key = node << 8 | byte
                node = self.backward.get(key) or self.backward.setdefault(key, len(self.ends))
                if node == len(self.ends):
                    self.ends.append(-1)
            self.ends[node] = number
        self.longest = max(map(len, self.token))
        self.follows: dict[int, bool] = {}
        self.edges: dict[tuple[int, int], list] = {}

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """Symbols at an edge of a token while it is being merged, each with the rank that ends it."""
        found = self.edges.get((token, side))
        if found is None:
            found, until, at = [], float("inf"), token
            while True:
                found.append((at, until))
                if at not in self.parts:
                    break
                until, *both = self.parts[at]
                at = both[side]
            self.edges[token, side] = found
        return found

    def may_follow(self, a: int, b: int) -> bool:
        """No merge joins the two across their border. Of equal merges the leftmost comes first."""
        key = a << 32 | b
        known = self.follows.get(key)
        if known is None:
            known = True
            for x, x_ends in self.edge(a, 1):
                for y, y_ends in self.edge(b, 0):
                    rank = self.merged.get((x, y))
                    if rank is not None and rank < x_ends and rank <= y_ends:
                        known = False
            self.follows[key] = known
        return known

    def emitted(self, piece: bytes) -> int:
        if piece in self.token:
            return 1
        backward, ends, follows = self.backward, self.ends, self.follows
        # The state: last token and count at the places that the longest token can reach back to. -1 is the piece's start.
        last, count, read = [-1], [0], b""
        for at in range(0, len(piece), STRETCH):
            part = read + piece[at:at + STRETCH]
            for i in range(len(last), len(part) + 1):
                node, j = 0, i
                while True:
                    j -= 1
                    node = backward[node << 8 | part[j]]
                    t = ends[node]
                    if t >= 0:
                        before = last[j]
                        if before < 0:
                            break
                        ok = follows.get(before << 32 | t)
                        if ok or (ok is None and self.may_follow(before, t)):
                            break
                last.append(t)
                count.append(count[j] + 1)
            gone = max(0, len(part) - self.longest)
            del last[:gone], count[:gone]
            read = part[gone:]
        return count[-1]


Parts = tuple[str, ...]  # of one piece, in order


class TokenCounter:
    """The compiled tokenizer of one file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        simple = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not simple or spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex"):
            raise ValueError(f"{path}: only byte-level pair encoding without a normalizer is compiled")
        marks = [t for t in spec["added_tokens"] if t["content"]]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in marks):
            raise ValueError(f"{path}: added tokens that take in their surroundings are not compiled")
        self.special = re.compile("|".join(re.escape(t["content"]) for t in sorted(marks, key=lambda t: -len(t["content"])))) if marks else None
        self.splitter, self.machine = Splitter(), PieceTransducer(model["vocab"], model["merges"])
        self.known: dict[str, int] = {}

    def words(self, words: list[str]) -> int:
        """Emitted tokens of strings that each start at a reset of the splitter."""
        known = self.known
        try:
            return sum([known[w] for w in words])
        except KeyError:
            pass
        total = 0
        for w in words:
            n = known.get(w)
            if n is None:
                n = sum(self.machine.emitted(p.encode()) for p in self.splitter.pieces(w))
                if len(known) < REMEMBERED and len(w) < 64:
                    known[w] = n
            total += n
        return total

    def chunk_map(self, chunk: str) -> tuple[Parts, int, Parts | None]:
        """(head, count, tail); tail None where the chunk has no reset and all of it is head."""
        resets, n = self.splitter.resets, len(chunk)
        first = next((i for i in range(1, n) if resets(chunk[i - 1], chunk[i])), None)
        if first is None:
            return (chunk,) if chunk else (), 0, None
        last = next(i for i in range(n - 1, 0, -1) if resets(chunk[i - 1], chunk[i]))
        return (chunk[:first],), self.words(WORDS.findall(chunk[first:last])), (chunk[last:],)

    def whole(self, parts: Parts) -> int:
        return self.words(["".join(parts)]) if parts else 0

    def compose(self, a: tuple, b: tuple) -> tuple:
        """Associative. Heads and tails hold no reset, so there may be one between a tail and a head only."""
        (head, count, tail), (head_b, count_b, tail_b) = a, b
        open_ = head if tail is None else tail
        if not open_ or not head_b:  # an empty text
            return a if open_ else b
        if self.splitter.resets(open_[-1][-1], head_b[0][0]):
            count += count_b + (0 if tail is None else self.whole(tail))
            return (head, count, head_b) if tail_b is None else (head, count + self.whole(head_b), tail_b)
        open_ += head_b
        if tail is None:
            return open_, count_b, tail_b
        return (head, count, open_) if tail_b is None else (head, count + self.whole(open_) + count_b, tail_b)

    def composed(self, maps: list[tuple]) -> tuple:
        """The up-sweep of a prefix scan: neighbours in pairs, in a logarithmic number of steps."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i:i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def plain(self, text: str) -> int:
        if len(text) <= CHUNK:
            return self.words(WORDS.findall(text))
        head, count, tail = self.composed([self.chunk_map(text[at:at + CHUNK]) for at in range(0, len(text), CHUNK)])
        return self.whole(head) + count + (0 if tail is None else self.whole(tail))

    def __call__(self, text: str) -> int:
        if self.special is None:
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self.plain(p) for p in parts)


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of each row.

    tokenizer: the path of a byte-level pair-encoding file. A null text counts as
    empty and has 0 tokens; repeated rows stay, null ids stay, other columns are not
    read, an empty table gives no rows. Nothing is cut: a text of any length is read
    chunk by chunk.
    """
    def counted(part: dict[str, list]) -> dict[str, object]:
        counter = per_process("token_counts", tokenizer, lambda: TokenCounter(tokenizer))
        texts = [t or "" for t in part["text"]]
        return {"id": part["id"], "n_bytes": [len(t.encode()) for t in texts], "n_tokens": [counter(t) for t in texts]}

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return map_rows(rows, counted, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
