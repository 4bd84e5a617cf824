import hashlib
import math
import random

import numpy as np
import pytest

from tallyloom.llm.vector_codes import Codebook, VectorCodes, assign, entry_groups, squared_distances, vector_codes, with_label_errors

SCHEMA = "vec_id long, embedding array<float>, label int, code string, part int"


def brute(rows, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in e], label) for i, e, label in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    if not kept:
        return []
    width = max(1, -(-max(len(e) for _, e, _ in kept) // 4)) * 4
    kept = sorted(((i, [*e, *[0] * (width - len(e))], label) for i, e, label in kept), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    step, codes, books = width // 4, [], []
    for k in range(4):
        x = [e[k * step : (k + 1) * step] for _, e, _ in kept]
        book = [list(v) for v in x[:entries]]

        def nearest(v, book=book):
            return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(book))

        for _ in range(rounds):
            own = [nearest(v)[1] for v in x]
            for j in set(own):
                members = [v for v, o in zip(x, own, strict=True) if o == j]
                book[j][:] = [sum(c) // len(members) for c in zip(*members, strict=True)]
        codes.append([nearest(v) for v in x])
        books.append(book)
    digest = hashlib.sha256(",".join(str(c) for b in books for v in b for c in v).encode()).hexdigest()
    out = [(i, "".join(f"{codes[k][r][1]:02x}" for k in range(4)), sum(codes[k][r][0] for k in range(4)), label) for r, (i, _, label) in enumerate(kept)]
    total = {}
    for _, _, error, label in out:
        total[label] = total.get(label, 0) + error
    return sorted(((i, code, error, total[label], digest) for i, code, error, label in out), key=str)


def run(spark, rows, params=VectorCodes()):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)
    found = with_label_errors(vector_codes(df, params)).collect()
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in found), key=str)


def test_matches_brute_force(spark):
    r = random.Random(2)
    rows = [(i, [r.choice([r.gauss(0, 0.3), -0.25, 0.5]) for _ in range(8)], r.choice([None, 1, 2])) for i in range(400)]
    rows += [(1000 + i, rows[i][1], 3) for i in range(40)]  # repeats and many equal distances
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, VectorCodes(entries=20, group=3, rows=50)) == brute(rows, entries=20)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [0.1, None, 0.2, 0.3], 1), (3, [nan] * 4, 1), (4, [inf, 0.0, 0.0, 0.0], 1), (5, [], None), (6, [0.5], None), (6, [0.25, -0.75, 0.1, 0.2, 0.3], 2), (None, [0.1, 0.1, 0.1, 0.1], 2)]
    found = run(spark, rows)
    assert found == brute(rows) and len(found) == 4
    assert run(spark, []) == [] and run(spark, rows[:3]) == []


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="64 bits"):
        run(spark, [(1, [3e38, 0.0, 0.0, 0.0], 1)])


def test_large_integers_stay_exact():
    x = np.array([[2**28, -(2**28) + 1], [3, 2**29]])
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, e, strict=True)) for e in x[::-1]] for v in x]
    assert squared_distances(x, x[::-1]).tolist() == want


def test_bounds_hold_and_spare_distances():
    """Over some rounds the bounds stay below the distances that they bound, codes stay exact, and most distances aren't computed."""
    r = np.random.default_rng(0)
    centres = r.integers(-500, 500, (64, 16))
    x = centres[r.integers(0, 64, 3000)] + r.integers(-12, 13, (3000, 16))
    entries = x[:64].copy()
    book, state, work = Codebook(entries, entry_groups(entries, 8), np.zeros(64)), (None, None, None), []
    for _ in range(8):
        code, upper, lower, n = assign(x, book, *state)
        d = squared_distances(x, book.entries)
        work.append(n)
        assert (code == d.argmin(axis=1)).all()
        real = np.sqrt(d)
        assert (upper >= real[np.arange(len(x)), code] - 1e-6).all()
        real[np.arange(len(x)), code] = np.inf
        for g in range(book.n_groups):
            assert (lower[:, g] <= real[:, book.groups == g].min(axis=1, initial=np.inf) + 1e-6).all()
        after = book.entries.copy()
        for j in np.unique(code):
            after[j] = x[code == j].sum(axis=0) // (code == j).sum()
        book = Codebook(after, book.groups, np.sqrt(((after - book.entries) ** 2).sum(axis=1)))
        state = (code, upper, lower)
    assert work[-1] < work[0] / 5
