import itertools
import random
import re

import pytest
import xxhash

from tallyloom.llm.covering_simhash import LEVELS, Covering, fingerprint, links, simhash_duplicates, submasks
from tallyloom.llm.scratch import Scratch

SCHEMA = "doc_id long, text string, fp string, fingerprint int"


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(fps), 2):
        if (a ^ b).bit_count() <= 3:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {f: find(f) for f in fps}


def brute(rows):
    fps = [(d, brute_fingerprint(t)) for d, t in rows]
    roots = brute_roots({f for _, f in fps})
    least = {}
    for d, f in fps:
        if d is not None:
            least[roots[f]] = min(d, least.get(roots[f], d))
    return sorted(((d, f"{f:016x}", least.get(roots[f])) for d, f in fps), key=str)


def run(spark, rows, params=Covering()):
    docs = spark.createDataFrame([(d, t, "clash", 3) for d, t in rows], SCHEMA)
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash_duplicates(docs, params).collect()), key=str)


def test_matches_brute_force(spark):
    r = random.Random(1)
    rows = [(0, None), (1, ""), (2, " \n\x0b"), (3, "one"), (4, "ONE "), (5, "one two"), (6, "É one two"), (7, "é one two"), (None, "one"), (None, "alone"), (5, "other words of five")]
    for g in range(15):
        base = [f"w{r.randint(0, 500)}" for _ in range(r.choice([3, 60, 400]))]
        for k in range(8):
            words = list(base)
            for _ in range(k // 2):
                words[r.randrange(len(words))] = f"x{r.randint(0, 9)}"
            rows.append((1000 - len(rows), " ".join(words)))
    found = run(spark, rows)
    assert found == brute(rows)
    assert len({f for _, f, _ in found}) > len({c for _, _, c in found}) > 15


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_every_pair_within_the_radius_meets(seed):
    r = random.Random(seed)
    masks = {0}
    for level in range(LEVELS):
        family = {m: submasks(m, 3, 7 + level) for m in masks}
        for m in r.sample(sorted(masks), min(len(masks), 20)):
            hidden = [b for b in range(64) if not m >> b & 1]
            for _ in range(200):
                differ = sum(1 << b for b in r.sample(hidden, 3))
                assert any(differ & s == 0 for s in family[m])
        masks = {s for subs in family.values() for s in subs}
        assert len(masks) <= 15 ** (level + 1)
    assert max(64 - m.bit_count() for m in masks) <= 8


@pytest.mark.parametrize("members", [2, 4, 128])
def test_large_buckets_are_cut_up_without_losing_links(spark, members):
    r, fps = random.Random(9), set()
    for centre in [r.getrandbits(64) for _ in range(6)]:
        for _ in range(60):  # all within a few bits of a centre: most buckets hold many
            fps.add(centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))))
    fps |= {fps.copy().pop() ^ 0xFF << 20, 0, 7, (1 << 64) - 1}
    rows = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    edges = [(r.u % (1 << 64), r.v % (1 << 64)) for r in links(rows, Scratch(spark, "covering-test"), Covering(members=members)).collect()]
    assert len(set(edges)) == len(edges)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert {f: find(f) for f in fps} == brute_roots(fps)


def test_long_texts_and_repeats(spark):
    text = " ".join(f"w{i % 977} v{i % 31}" for i in range(40_000))
    assert fingerprint(text, 3) == brute_fingerprint(text)
    rows = [(1, text), (2, text + " end"), (3, text), (9, "a b c d"), (9, "a b c d"), (9, "q r s t")]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []
