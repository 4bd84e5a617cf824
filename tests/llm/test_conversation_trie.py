import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from tallyloom.llm.conversation_trie import Trie, conversation_trie
from tallyloom.llm.prefix_sums import before

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, node string, depth int"


def brute(rows):
    given = {}
    for c, turn, role, text in rows:
        if c is not None:
            given.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in given.items()}
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(turns.get(c - (abs(c) % 20) * (1 if c > 0 else -1), [])[:h] + turns[c][h:])
    nodes = {}
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        saved = sum((len(nodes[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        children = {p: sum(len(q) == len(p) + 1 and q[: len(p)] == p for q in nodes) for p in below}
        ends = ",".join(str(c) for c in sorted(members) if len(rebuilt[c]) == len(path))
        parent = min(nodes[path[:-1]]) if path else None
        out.append((min(members), len(path), parent, len(members), children[path], sum(n == 0 for n in children.values()), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, params=Trie(), parts=3):
    df = spark.createDataFrame([(*r, "clash", 5) for r in rows], SCHEMA).repartition(parts)
    return conversation_trie(df, params).collect()


def plain(found):
    return sorted((tuple(r[c] for c in COLUMNS) for r in found), key=str)


def random_rows(seed, n, words):
    r = random.Random(seed)
    rows = [(c, t, r.choice(["user", "assistant"]), " ".join(r.choice(words) for _ in range(r.randint(0, 3)))) for c in range(n) for t in range(r.randint(1, 7))]
    copies = [(c + 1000, t, role, text) for c, t, role, text in rows if c % 3 == 0]
    return rows + copies


def test_matches_brute_force(spark):
    rows = random_rows(3, 60, ["a", "b"])
    assert plain(run(spark, rows)) == brute(rows)
    assert plain(run(spark, rows, Trie(block=2, ids=3))) == brute(rows)


def test_intervals_are_a_preorder(spark):
    found = run(spark, random_rows(4, 40, ["x"]))
    assert sorted(r.preorder for r in found) == list(range(1, len(found) + 1))
    at = {(r.conv_id, r.depth): r for r in found}
    for r in found:
        if r.depth:
            up = at[r.parent_conv_id, r.depth - 1]
            assert up.preorder < r.preorder <= r.subtree_end <= up.subtree_end
        inside = [x for x in found if r.preorder <= x.preorder <= r.subtree_end]
        assert sum(x.n_children == 0 for x in inside) == r.n_leaves and all(x.depth > r.depth or x is r for x in inside)


def test_nulls_ties_and_turnless_conversations(spark):
    rows = [
        (None, 1, "user", "lost"), (7, None, None, None), (7, 1, "user", "b"), (7, 1, "user", "a"), (7, 1, "user", "a"), (-3, 0, "user", " \t"), (-25, 2, "", "x y"),
        (44, 0, "user", "hi"), (46, 0, "user", "hi"), (40, 0, "user", "hi"), (1000003, 0, "user", "É" * 300), (9223372036854775000, 5, "user", "w " * 5000)]
    lent = {c: zlib.crc32(str(c).encode()) % 4 for c in range(100)}
    lonely = [c for c, h in lent.items() if h and c % 20 and c > 60][:2]
    rows += [(c, 0, "user", "gone") for c in lonely]  # their base is absent: no turn is left
    found = plain(run(spark, rows))
    assert found == brute(rows)
    assert any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in found)


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 0, "user", "x")]) == []


def test_one_long_conversation_and_prefixes_of_it(spark):
    rows = [(20, t, "user", f"t{t % 5}") for t in range(300)] + [(c, t, "user", f"t{t % 5}") for c in range(21, 40) for t in range(c)]
    assert plain(run(spark, rows, Trie(block=4))) == brute(rows)


def test_running_values_over_blocks(spark):
    rows = [(k, i, (i * 7 + k) % 11) for k in (1, 2) for i in range(1, 200)]
    df = spark.createDataFrame(rows, "k long, i long, v long")
    for how, f in (("sum", sum), ("max", max)):
        got = {(r.k, r.i): r.before_v for r in before(df, ["k"], "i", ["v"], getattr(F, how), block=3).collect()}
        for k, i, _ in rows:
            earlier = [v for a, b, v in rows if a == k and b < i]
            assert got[k, i] == (f(earlier) if earlier else None)
