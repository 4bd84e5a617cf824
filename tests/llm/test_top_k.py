import math
import random

from tallyloom.llm.top_k import TopK, top_k

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def brute(rows, k=10, every=100):
    fine = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(1024 * x) for x in v]
            fine[i] = min(fine.get(i, w), w)
    out = []
    for q in fine:
        if q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(fine[q], w, strict=False)), i) for i, w in fine.items() if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    return sorted(out)


def run(spark, rows, p=TopK()):
    return sorted(tuple(r) for r in top_k(spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA), p).collect())


def test_matches_brute_force(spark):
    r = random.Random(6)
    centres = [[r.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    rows = []
    for i in range(900):
        c = r.choice(centres)
        rows.append((i, [float.fromhex((x + r.gauss(0, 0.3)).hex()) for x in c]))
    rows += [(i, [0.25] * 8) for i in range(1000, 1400)]  # one very common vector
    rows = [(i, [float(int(x * 4096)) / 4096 for x in v]) for i, v in rows]
    rows += [(2000, None), (2001, []), (2100, [1.0, None] + [0.0] * 6), (2200, [float("nan")] + [0.0] * 7), (2300, [float("inf")] + [0.0] * 7), (2400, [0.0] * 8), (2500, [0.5, 0.5]), (None, [1.0] * 8), (100, [9.0] * 8), (100, [9.0] * 8)]
    for p in (TopK(), TopK(pivots=3, annuli=4, rows=64, queries=2, sample=20)):
        assert run(spark, rows, p) == brute(rows)


def test_few_and_none(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (100, [-1.0, 0.5])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(0, [1.0])]) == [] and run(spark, []) == [] and run(spark, [(0, None)]) == []
    assert run(spark, [(0, [1.0]), (1, []), (2, [-1.0])]) == [(0, 1, 1, 0), (0, 2, 2, -(1 << 20))] and run(spark, [(0, []), (1, [])]) == [(0, 1, 1, 0)]
    big = [(0, [2.0**41, -(2.0**40)]), (5, [1.0, 1.0]), (7, [-1.0, 0.0])]
    assert run(spark, big) == brute(big)
    far = [(0, [2.0**41]), (5, [2.0**41]), (7, [-(2.0**41)]), (9, [3.0])]
    assert run(spark, far) == [(0, 1, 5, 2**63 - 1), (0, 2, 9, 2**51 * 3072), (0, 3, 7, 1 - 2**63)]
