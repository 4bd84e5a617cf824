import random
import time

import numpy as np

from tallyloom.llm.near_dedup import NearDedup, near_duplicates
from tallyloom.llm.substring_dedup import parse
from tallyloom.llm.words import word_bounds, word_hashes


def thue_morse(n):
    """Two words of 2^n letters that collide in every polynomial hash with an odd base once n is about ten."""
    bits = "".join("ab"[i.bit_count() % 2] for i in range(1 << n))
    return bits, bits.translate(str.maketrans("ab", "ba"))


def hashes(words, **how):
    raw = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
    starts, ends, _ = word_bounds(raw, np.array([0, len(raw)]))
    return word_hashes(raw, starts, ends, **how)


def test_equal_words_and_no_others_are_equal():
    r = random.Random(1)
    words = ["".join(r.choice("abÉ0") for _ in range(r.randint(1, 40))) for _ in range(20_000)] + [w for n in (3, 9, 10, 11, 14) for w in thue_morse(n)]
    words += ["a" * n for n in range(1, 60)] + ["x" * (3 << 20), "x" * (3 << 20) + "y", "\0", "\0\0", "\0" * 9]
    found = hashes(words)
    first = {}
    for w, h in zip(words, found.tolist(), strict=True):
        assert first.setdefault(h, w) == w
    assert len(first) == len(set(words))
    again = hashes(["lead", *words[::-1]])[1:][::-1]  # the place doesn't count
    assert (found == again).all()
    assert not np.intersect1d(found, hashes(words, salt=1)).size
    assert (hashes(["abzÉ", "q" * 20]) == hashes(["ABzÉ", "Q" * 20], lower=True)).all()


def test_bits_are_even():
    found = hashes([f"w{i}" for i in range(50_000)])
    ones = np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1).mean(axis=0)
    assert np.abs(ones - 0.5).max() < 0.015


def test_words_that_a_polynomial_confuses(spark):
    a, b = thue_morse(10)
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    found = near_duplicates(docs, NearDedup(words=2)).select("doc_id", "component_id", "kept").collect()
    assert sorted(map(tuple, found)) == [(1, 1, True), (2, 2, True)]
    lead = " ".join(f"w{i}" for i in range(19))
    docs = spark.createDataFrame([(1, f"{lead} {a}"), (2, f"{lead} {b}"), (3, f"{lead} {a}")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in parse(docs).collect()) == [(1, 0), (2, 0), (3, 20)]


def test_speed_is_that_of_arrays():
    raw = np.frombuffer(b"word and another one, sometimes-longer " * 50_000, dtype=np.uint8)
    starts, ends, _ = word_bounds(raw, np.array([0, len(raw)]))
    began = time.time()
    word_hashes(raw, starts, ends)
    assert time.time() - began < 2
