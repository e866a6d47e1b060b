"""Texts without spaces and very long labelled texts: same results in bounded memory."""

import random
import tracemalloc

import numpy as np
import public_tokenizers
import xxhash

from dustloom.llm import piece_sampling, toxicity


def test_long_chunks_equal_lattices(monkeypatch):
    """A chunk that is sampled without its lattice has the pieces that the lattice gives; spaces, copies and letters without pieces too."""
    pieces = piece_sampling.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    draw = random.Random(1)
    blob = "".join(draw.choices("abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/éß日本語😀", k=3000))
    texts = [blob, f"a {blob} b  {blob}", blob, "   " + blob[:900], "short text", "", "▁" * 700 + "x"]
    keys = np.array([5, 6, 5, 7, 8, 9, 10])
    want = piece_sampling.encode(pieces, texts, keys, 3)
    monkeypatch.setattr(piece_sampling, "LONG_CHUNK", 500)
    again = piece_sampling.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    got = piece_sampling.encode(again, texts, keys, 3)
    assert all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))
    assert np.array_equal(got[0], got[2])
    assert [again.decode(ids.tolist()) if len(ids) else "" for ids in got] == texts


def test_a_chunk_of_hundreds_of_thousands_of_letters():
    """Beyond LONG_CHUNK memory is a few bytes a character, and the text comes back."""
    pieces = piece_sampling.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    blob = "".join(random.Random(2).choices("ABCDEFGHabcdefgh01234567+/", k=piece_sampling.LONG_CHUNK + 1000))
    pieces.by_text()
    tracemalloc.start()
    ids = piece_sampling.encode(pieces, [blob], np.array([1]), 3)[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pieces.decode(ids.tolist()) == blob and peak < 60 * len(blob)


def every_pair(text):
    """Pairs of different words at most PAIR_WORDS apart, by the plain definition."""
    words = toxicity._WORDS.findall(text.lower())
    return {frozenset((a, b)) for i, a in enumerate(words) for b in words[i + 1 : i + 1 + toxicity.PAIR_WORDS] if a != b}


def test_pairs_in_passes(monkeypatch):
    """Any bound of pairs held at once gives the same pairs, each once."""
    draw = random.Random(4)
    known = toxicity._Known(lambda word: xxhash.xxh3_64_intdigest(word.encode()) - (1 << 63))
    for text in (" ".join(draw.choices([f"w{i}" for i in range(60)], k=1500)), "a", "", None, "a a a", "one two"):
        want = {tuple(sorted(known[w] for w in p)) for p in every_pair(text or "")}
        for bound in (1 << 22, 4000, 300):
            monkeypatch.setattr(toxicity, "PASS_PAIRS", bound)
            parts = list(toxicity._pairs(text, known))
            got = [pair for _, low, high in parts for pair in zip(low.tolist(), high.tolist(), strict=True)]
            assert len(got) == len(set(got)) and set(got) == want


def test_pairs_of_a_long_text_in_bounded_memory(monkeypatch):
    monkeypatch.setattr(toxicity, "PASS_PAIRS", 1 << 19)
    text = " ".join(f"w{x}" for x in np.random.default_rng(5).integers(0, 50_000, 400_000))
    known = toxicity._Known(lambda word: xxhash.xxh3_64_intdigest(word.encode()) - (1 << 63))
    tracemalloc.start()
    count = sum(len(key) for key, _, _ in toxicity._pairs(text, known))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count > 3_000_000 and peak < 150 << 20


def test_bits_of_pairs(spark):
    """Every given pair has its bit, and few other bits are set."""
    draw = np.random.default_rng(6)
    low, high = draw.integers(-(2**62), 2**62, (2, 3000))
    pairs = spark.createDataFrame([(int(a), int(b)) for a, b in zip(low, high, strict=True)], "low long, high long").repartition(3)
    bits = np.unpackbits(toxicity._pair_bits(pairs), bitorder="little")
    assert bits[toxicity._pair_key(low, high) & np.uint64(toxicity.PAIR_BITS - 1)].all() and bits.sum() <= 3000
    assert not toxicity._pair_bits(pairs.limit(0)).any()
