"""Best-fit decreasing on numbers per length against the plain method, and packing of documents."""

import bisect
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from starloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_bins(lengths, capacity):
    """Best fit decreasing piece by piece, with a sorted list of open bins."""
    bins, number = [], 0
    for length in sorted(lengths, reverse=True):
        i = bisect.bisect_left(bins, (length, -1))
        if i < len(bins):
            left, b = bins.pop(i)
        else:
            left, b, number = capacity, number, number + 1
        bisect.insort(bins, (left - length, b))
    return number


def test_as_many_bins_as_piece_by_piece():
    for seed in range(120):
        rng = random.Random(seed)
        capacity = rng.choice([1, 10, 37, 100, 4096])
        counts = defaultdict(int)
        for _ in range(rng.randint(0, 400)):
            counts[rng.randint(1, capacity if rng.random() < 0.5 else max(1, capacity // 5))] += 1
        placed, bins = packing.best_fit_decreasing(counts, capacity)
        assert bins == plain_bins([n for n, c in counts.items() for _ in range(c)], capacity)
        used, rows = defaultdict(list), defaultdict(list)
        for length, position, first, each, offset in placed:
            rows[length].append((position, first, each, offset))
        for length, count in counts.items():
            for k in range(count):
                position, first, each, offset = sorted(rows[length])[bisect.bisect_right(sorted(rows[length]), (k, 1 << 60)) - 1]
                used[first + (k - position) // each].append((offset + (k - position) % each * length, length))
        assert len(used) == bins
        for pieces in used.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= capacity


def test_size_of_the_plan_depends_on_the_capacity_only():
    few, _ = packing.best_fit_decreasing({n: 50 + n % 7 for n in range(1, 513)}, 512)
    many, _ = packing.best_fit_decreasing({n: 5_000_000 + n % 7 for n in range(1, 513)}, 512)
    assert max(len(few), len(many)) < 6 * 512


def test_documents_are_packed_whole(spark):
    rng = random.Random(5)
    words = ["alpha", "Be", "ga-mma", "x", "<|endoftext|>", "don't", "é́", "日本", "12", "  ", "\n", "\t\x0b", "\u00a0"]
    texts = [None, "", " ", "one", "one"] + [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["word " * 3000]
    df = spark.createDataFrame([(k, t, k, "c") for k, t in enumerate(texts)] + [(None, "one", 0, "c"), (3, "one", 3, "c")], "doc_id long, text string, length long, block string").repartition(5)
    capacity = 64
    packed = packing.pack_documents(df, PATH, 1, capacity, keep_ids=True)
    got = packed.collect()
    library = Tokenizer.from_file(PATH)
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        assert list(r.ids) and len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    for k, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        want = [(i, i * capacity, ids[i * capacity:(i + 1) * capacity]) for i in range(-(-len(ids) // capacity))]
        mine = sorted((r.piece, r.start, list(r.ids)) for r in pieces[k])
        assert mine == (sorted(want * 2) if k == 3 else want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for used in bins.values():
        at = 0
        for offset, length in sorted(used):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) == plain_bins([r.length for r in got], capacity)
    assert {r.sequence_id: len(r.ids) for r in packing.sequences(packed).collect()} == {b: sum(n for _, n in used) for b, used in bins.items()}
    assert packing.pack_documents(df.limit(0), PATH).count() == 0


ODD = [
    "x y\x1cz", "DON'T I'LL 'S ''s \u0130stanbul \u03a3\u03af\u03c3\u03c5\u03c6\u03bf\u03c2 \u039f\u0394\u039f\u03a3 e\u0301 \u00e9 \ufb01 \u00df \u1e9e \u0149 \u00aa \u00ba \u00b2 \u00bd a\u0308",
    "<|endoftext|>a<|startoftext|> <|END", "\u0301 \u0301a a\u200bb \u3000 \ufeff x\x85y", "a_b__c 1\uff123 a'S b'Re c'", "\u212b \u00c5 \u212a \u017f", "ab\x0bcd\x0cef \x1f\x1e", "\u0130'll",
    "", " \n", "w" * 5000 + " " + "#" * 3000, "\u4e2d\u6587 \U0001f600\U0001f601!",
]


def test_words_and_parts_give_the_ids_of_the_library(monkeypatch):
    library = Tokenizer.from_file(PATH)
    rng = random.Random(9)
    signs = "aZ\u00e9 '.-#1_\n"
    texts = ODD + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    for remembered, long in ((1_000_000, 1 << 24), (50, 1 << 24), (1_000_000, 100)):
        monkeypatch.setattr(packing, "REMEMBERED", remembered)
        monkeypatch.setattr(packing, "LONG", long)
        encoder = packing.Encoder(PATH)
        for text in texts:
            words = packing.words_of(text)
            encoder.learn(set(words))
            got = np.frombuffer(b"".join(encoder.words[w] for w in words), np.uint32).tolist()
            assert got == library.encode(text, add_special_tokens=False).ids, text
