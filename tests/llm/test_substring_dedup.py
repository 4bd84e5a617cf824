import hashlib
import random
import re

from tallyloom.llm.substring_dedup import FACTORS, KEPT, SubstringDedup, parse


def brute(rows, n=20):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in words:
        for s in range(len(w) - n + 1):
            key = tuple(w[s : s + n])
            first[key] = min(first.get(key, (d, s)), (d, s))
    out = []
    for d, w in words:
        gone = set()
        for s in range(len(w) - n + 1):
            if first[tuple(w[s : s + n])] < (d, s):
                gone.update(range(s, s + n))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out)


def corpus(r, n):
    vocabulary = [f"w{i}" for i in range(60)] + ["É東", "x" * 40]
    passages = [[r.choice(vocabulary) for _ in range(r.choice([20, 25, 60]))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(r.randrange(5)):
            words += [r.choice(vocabulary) for _ in range(r.choice([0, 1, 18, 19, 20, 70]))]
            p = list(r.choice(passages))
            if r.random() < 0.3:
                p[r.randrange(len(p))] = "edit"
            words += p[r.randrange(3) :] if r.random() < 0.5 else p
        rows.append((i * 7 % 1000, r.choice([" ", "\n", " \t"]).join(words)))
    return rows


def test_matches_brute_force(spark):
    r = random.Random(11)
    rows = corpus(r, 150) + [(2000, None), (2001, ""), (2002, "a b c a b c " * 30), (2003, "same " * 19), (2004, "same " * 20), (2005, "same " * 21), (2006, "same " * 500)]
    r.shuffle(rows)
    docs = spark.createDataFrame([(d, t, "z", 1) for d, t in rows], "doc_id long, text string, block string, part int").repartition(5)
    want = brute(rows)
    for block in (1 << 9, 4 << 20):  # many blocks, and one for each partition
        p = SubstringDedup(block=block)
        assert sorted(tuple(x)[:4] for x in parse(docs, p).collect()) == [w[:4] for w in want]
    assert sorted(tuple(x) for x in parse(docs, p, KEPT).collect()) == [(w[0], w[4]) for w in want]
    text = dict(rows)
    for f in parse(docs, p, FACTORS).collect():
        a, b = text[f.doc_id].split(), text[f.ref_doc_id].split()
        assert f.n_words >= 20 and a[f.start : f.start + f.n_words] == b[f.ref_start : f.ref_start + f.n_words]
        assert (f.ref_doc_id, f.ref_start) < (f.doc_id, f.start)


def test_repeated_ids_null_ids_long_and_empty(spark):
    long = " ".join(f"v{i % 70_000}" for i in range(100_000))
    rows = [(5, " ".join(f"a{i}" for i in range(30))), (5, " ".join(f"a{i}" for i in range(30))), (5, " ".join(f"a{i}" for i in range(5, 40))), (9, long), (9, long), (None, " ".join(f"v{i}" for i in range(25)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = brute([(-1 if d is None else d, t) for d, t in rows])
    got = sorted((-1 if x.doc_id is None else x.doc_id, *x[1:4]) for x in parse(docs).collect())
    assert got == [w[:4] for w in want]
    assert parse(docs.limit(0)).count() == 0
    assert parse(docs.where("doc_id = 77").unionByName(spark.createDataFrame([(1, None)], "doc_id long, text string"))).count() == 1
