import random

import pytest

from tallyloom.functions.columns import FALLBACK_MODEL
from tallyloom.operators.usage import dedup_calls
from tallyloom.streaming.usage import drained, merged_call_stream, signed_totals

COUNTERS = ["input_tokens", "output_tokens"]
SCHEMA = "call_key string, at long, model string, day string, time_ms long, input_tokens long, output_tokens long"


def stream_of(spark, folder, parts):
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_and_cut_gives_the_batch_rows(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = [(f"c{r.randrange(12)}", i, r.choice([FALLBACK_MODEL, "m1", "m2"]), r.choice([None, "2026-01-02", "2026-01-01"]), r.choice([None, 5, 9]), r.randrange(9), r.randrange(9)) for i in range(60)]
    batch = dedup_calls(spark.createDataFrame(rows, SCHEMA), ["call_key"], COUNTERS, ["at"])
    columns = ["call_key", "model", "day", "time_ms", *COUNTERS, "copies"]
    want = sorted(str(tuple(x)) for x in batch.select(*columns).collect())
    r.shuffle(rows)
    cuts = sorted(r.sample(range(1, 60), 3))
    changes = drained(merged_call_stream(stream_of(spark, tmp_path / "in", [rows[a:b] for a, b in zip([0, *cuts], [*cuts, 60], strict=True)]), COUNTERS), spark)
    found = changes.collect()
    alive = {}
    for c in sorted(found, key=lambda c: (c.version, -c.sign)):  # a taken-back row is the one that stood there
        at = tuple(c[x] for x in columns)
        if c.sign > 0:
            alive[c.call_key] = at
        else:
            assert alive[c.call_key] == at
    taken = [c for c in found if c.sign < 0]
    assert len(taken) > 3 and len(found) == len(alive) + 2 * len(taken)
    assert sorted(map(str, alive.values())) == want
    totals = {x.model: tuple(x[1:]) for x in signed_totals(changes, ["model"], COUNTERS).collect()}
    sums = {}
    for row in batch.collect():
        n, a, b = sums.get(row.model, (0, 0, 0))
        sums[row.model] = (n + 1, a + row.input_tokens, b + row.output_tokens)
    assert totals == sums


def test_calls_are_merged_without_python_or_kept_state(spark, tmp_path):
    rows = [(f"c{i % 3}", i, "m1", None, i, i, 1) for i in range(9)]
    stream = merged_call_stream(stream_of(spark, tmp_path / "in", [rows[:4], rows[4:]]), COUNTERS)
    changes = drained(stream, spark)
    plan = changes._jdf.queryExecution().toString()
    assert "Pandas" not in plan and "StateStore" not in plan
    assert [tuple(r) for r in signed_totals(changes, ["model"], COUNTERS).collect()] == [("m1", 3, 6 + 7 + 8, 3)]
