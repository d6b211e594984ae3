"""Counts of the compiled transducers against the library."""

import random
import time

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from starloom.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "s", "t", "'", "'re", "'ll", "'v", " ", "  ", "\n", "\t", "1", "23", "é", "ß", "#", "!!", "***", "\x85", "\u3000", "日本", "<|endoftext|>", "ve", "'S", "r", "l", " '", "\x1c", "\u0301"]


@pytest.fixture(scope="module")
def counter():
    return token_counts.TokenCounter(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts(n, seed, longest=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_as_the_library(counter, library):
    for text in [*odd_texts(3000, 1), "a" * 3000, " " * 300 + "x", "'" * 77, "\n" * 50, "x" * 40_000 + " y " * 3000]:
        assert counter(text) == len(library.encode(text, add_special_tokens=False).ids), text[:100]


def test_chunks_compose(counter, library, monkeypatch):
    monkeypatch.setattr(token_counts, "CHUNK", 7)
    for text in odd_texts(600, 2, 60):
        assert counter(text) == len(library.encode(text, add_special_tokens=False).ids), text


def test_composition_is_associative(counter):
    for text in odd_texts(200, 3, 60):
        text = text.replace("<|endoftext|>", "")
        a, b, c = (counter.chunk_map(p) for p in (text[:9], text[9:30], text[30:]))
        left, right = counter.compose(counter.compose(a, b), c), counter.compose(a, counter.compose(b, c))
        joined = [("".join(head), count, None if tail is None else "".join(tail)) for head, count, tail in (left, right)]
        assert joined[0] == joined[1]


@pytest.mark.parametrize("unit", ["abcdefgh\n", "x", "a1", "日本語", "'", " ", "\n", "ab'r", "é#"])
def test_long_texts_without_blanks_take_time_in_proportion(counter, library, unit):
    text = unit * (300_000 // len(unit))
    begun = time.process_time()
    got = counter(text)
    assert time.process_time() - begun < 5
    assert got == len(library.encode(text, add_special_tokens=False).ids)


def test_composition_reads_no_part_twice(counter, monkeypatch):
    read = []
    monkeypatch.setattr(counter, "words", lambda words: read.extend(map(len, words)) or 0)
    text = "abcdefg" * 50_000 + "1" * 70_000
    counter(text)
    assert sum(read) == len(text)


def test_rows(spark, library):
    texts = [None, "", "a b", "a b", "<|endoftext|>", "word " * 20_000]
    df = spark.createDataFrame([(k, t, 5, "x") for k, t in enumerate(texts)] + [(None, "q", 1, None)], "doc_id long, text string, n_tokens int, id string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(df, PATH).collect()}
    assert got == {k: (len((t or "").encode()), len(library.encode(t or "").ids)) for k, t in enumerate(texts)} | {None: (1, 1)}
    assert token_counts.count_tokens(df.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        token_counts.TokenCounter(public_tokenizers.path("word_bpe_49k.json"))
