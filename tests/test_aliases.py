import random

import pytest

from tallyloom.operators.components import alias_calls, forest_roots

SCHEMA = "at long, message_id string, request_id string, model string, input_tokens long, output_tokens long"


def brute(rows):
    """The rule as a loop over records in order; a record that breaks it changes nothing but is reported."""
    calls, names, broken = [], {}, []
    for at, m, r, model, i, o in sorted(rows):
        if i + o == 0:
            continue
        keys = [k for k in (m and "m:" + m, r and "r:" + r) if k]
        if not keys:
            broken.append((at, "no_identity"))
            continue
        known = {names[k] for k in keys if k in names}
        if len(known) > 1:
            broken.append((at, "bridge"))
            continue
        if known:
            call = calls[known.pop()]
            if call[1] != model:
                broken.append((at, "model_conflict"))
            call[2:] = [max(call[2], i), max(call[3], o), call[4] + 1]
            index = calls.index(call)
        else:
            index = len(calls)
            calls.append([at, model, i, o, 1])
        for k in keys:
            names[k] = index
    return sorted(map(tuple, calls)), sorted(broken)


def run(spark, folder, rows):
    calls, broken = alias_calls(spark.createDataFrame(rows, SCHEMA), ["input_tokens", "output_tokens"], str(folder))
    return sorted(map(tuple, calls.collect())), sorted(map(tuple, broken.collect()))


def test_stated_cases(spark, tmp_path):
    rows = [(1, "a", "x", "m1", 1, 1), (2, "a", None, "m1", 5, 0), (3, None, "x", "m1", 0, 7), (4, "a", "y", "m1", 1, 1), (5, None, "y", "m2", 1, 1), (6, "b", "z", "m1", 2, 2), (7, "a", "z", "m1", 9, 9), (8, None, None, "m1", 1, 0), (9, None, None, "m1", 0, 0), (10, "c", "x", "m1", 3, 3)]
    want = brute(rows)
    assert want[1] == [(5, "model_conflict"), (7, "bridge"), (8, "no_identity")] and want[0][0] == (1, "m1", 5, 7, 6)
    assert run(spark, tmp_path, rows) == want
    assert run(spark, tmp_path / "none", []) == ([], [])


@pytest.mark.parametrize("seed", [1, 2])
def test_random_orders(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = [(i, r.choice([None, *"abcdefghij"]), r.choice([None, *"stuvwxyz"]), r.choice(["m1", "m1", "m2"]), r.randrange(4), r.randrange(4)) for i in range(40)]
    rows += [(100 + i, f"n{i // 3}", f"q{i // 2}", "m1", 1, i) for i in range(30)]
    assert run(spark, tmp_path, rows) == brute(rows)


def test_a_long_chain_of_ids_is_one_call(spark, tmp_path):
    rows = [(i, f"m{i // 2}", f"r{(i + 1) // 2}", "m1", 1, 1) for i in range(70)] + [(100, None, "r0", "m1", 5, 0), (101, "m34", None, "m2", 0, 9)]
    assert run(spark, tmp_path, rows) == brute(rows) == ([(0, "m1", 5, 9, 72)], [(101, "model_conflict")])


def test_roots_need_few_rounds(spark, tmp_path):
    parents = spark.createDataFrame([(i, i - 1) for i in range(1, 33)] + [(100, 50)], "node long, parent long")
    assert sorted(map(tuple, forest_roots(parents, str(tmp_path)).collect())) == [(i, 0) for i in range(1, 33)] + [(100, 50)]
    (tables,) = tmp_path.iterdir()
    assert len(list(tables.iterdir())) == 6  # 1, 2, 4, ... 32 steps


def test_copies_of_a_record_count_once_each(spark, tmp_path):
    rows = [(1, "a", "x", "m1", 1, 1), (2, "a", "y", "m1", 2, 0), (2, "a", "y", "m1", 2, 0), (3, None, "y", "m1", 0, 4)]
    assert run(spark, tmp_path, rows) == ([(1, "m1", 2, 4, 4)], [])
