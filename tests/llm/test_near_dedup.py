import random
import re

from tallyloom.llm.near_dedup import NearDedup, drop_near_duplicates, near_duplicates

COLUMNS = ["doc_id", "n_shingles", "component_id", "kept"]
SCHEMA = "doc_id long, text string, u string, component_id int"


def brute(rows, n, percent=80):
    def shingles(text):
        words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} - {()}

    sets, parent = {d: shingles(t) for d, t in rows}, {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted((d, len(sets[d]), root(d), root(d) == d) for d in sets)


def run(spark, rows, n=2):
    docs = spark.createDataFrame([(d, t, "u", 7) for d, t in rows], SCHEMA)
    return sorted(tuple(r) for r in near_duplicates(docs, NearDedup(words=n)).select(*COLUMNS).collect())


def test_matches_brute_force(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}É" for i in range(300)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "ONE "), (5, "one two"), (6, "Lone\x0bword")]
    for _ in range(12):
        base = [r.choice(vocabulary) for _ in range(r.choice([8, 40, 200]))]
        chain = list(base)
        for _ in range(6):  # a chain: far ends are less similar than the threshold
            rows.append((len(rows), " ".join(chain)))
            for _ in range(max(1, len(chain) // 30)):
                chain[r.randrange(len(chain))] = r.choice(vocabulary)
        rows.append((len(rows), " ".join(base).upper().replace("É", "É")))
    rows += [(len(rows) + i, " ".join(f"same{j}" for j in range(50))) for i in range(60)]
    for n in (2, 5):
        assert run(spark, rows, n) == brute(rows, n)


def test_long_text_and_empty_table(spark):
    long = " ".join(f"word{i}" for i in range(60_000))
    got = run(spark, [(1, long), (2, long + " tail"), (3, "x" * 3_000_000)])
    assert got == [(1, 59_999, 1, True), (2, 60_000, 1, False), (3, 1, 3, True)]
    assert run(spark, []) == []


def test_repeated_and_null_ids(spark):
    got = near_duplicates(spark.createDataFrame([(4, "a b c"), (4, "a b c"), (None, "a b c"), (9, "A b C")], "doc_id long, text string"), NearDedup(words=2)).select(*COLUMNS)
    assert sorted(map(str, got.collect())) == sorted(map(str, got.sparkSession.createDataFrame([(None, 2, 4, True), (4, 2, 4, True), (4, 2, 4, True), (9, 2, 4, False)], got.schema).collect()))


def test_rows_are_told_apart_by_text(spark):
    t, u, v = "one two three four five six", "an entirely different text of some words", "one two three four five six seven"
    rows = [(2, u, "x"), (4, t, "x"), (4, u, "x"), (9, t, "x"), (5, t, "y"), (7, "own words only here", "b"), (7, "own words only here", "a"), (None, t, "n"), (None, t, "n"), (8, None, "z"), (8, None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, first string")
    got = sorted(map(tuple, drop_near_duplicates(docs, NearDedup(words=2)).collect()), key=str)
    assert got == sorted([(2, u, "x"), (4, t, "x"), (7, "own words only here", "a"), (None, t, "n"), (None, t, "n"), (8, None, "y")], key=str)
    both = spark.createDataFrame([(3, t, "x"), (3, v, "x")], docs.schema)
    assert drop_near_duplicates(both, NearDedup(words=2)).count() == 1
    assert drop_near_duplicates(docs.where("false")).count() == 0


def test_a_large_group_whose_members_are_not_all_near(spark):
    """Every member has other words changed, so that many pairs stay below the threshold."""
    r = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for d in range(150):
        own = list(base)
        for i in r.sample(range(60), r.choice([1, 2, 3, 4, 9])):
            own[i] = f"n{d}x{i}"
        rows.append((d, " ".join(own)))
    assert run(spark, rows, 2) == brute(rows, 2)


def test_blocks_of_a_group_find_the_same_links(monkeypatch, spark):
    """A group whose members are near a centre and not each other, cut into several blocks."""
    from tallyloom.llm import near_dedup

    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 7)
    r = random.Random(11)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for d in range(80):
        words = list(base)
        for _ in range(r.choice([0, 4, 9, 14, 22])):
            words[r.randrange(100)] = f"x{r.randrange(40)}"
        rows.append((d, " ".join(words)))
    assert run(spark, rows) == brute(rows, 2)


def test_intersections_by_products():
    import numpy as np

    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 9000, n)).astype(np.uint64) for n in (0, 1, 50, 6000, 400, 6000)]
    got = near_common([len(s) for s in sets], np.concatenate(sets), 4)
    assert got.tolist() == [[len(np.intersect1d(a, b)) if i != j else int(np.isin(a, np.concatenate([s for k, s in enumerate(sets) if k != i])).sum()) for j, b in enumerate(sets)] for i, a in enumerate(sets[:4])]


def near_common(sizes, shingles, n):
    import numpy as np

    from tallyloom.llm.near_dedup import common_shingles

    return common_shingles(np.array(sizes), shingles, n)
