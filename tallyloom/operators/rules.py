"""Reconciliation rules as data: a rule is a name and a condition, violations are rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rows: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """(keys, code) of every rule that a row doesn't meet, in one pass; a null condition isn't met."""
    broken = F.filter(F.array(*(F.when(F.coalesce(ok, F.lit(False)), None).otherwise(F.lit(code)) for code, ok in rules.items())), lambda c: c.isNotNull())
    return rows.select(*keys, F.explode(broken).alias("code"))


def closed_keys(json: Column, keys: list[str]) -> Column:
    """The object has exactly these keys."""
    return F.coalesce(F.array_sort(F.json_object_keys(json)) == F.array_sort(F.array(*map(F.lit, keys))), F.lit(False))


def histogram_feasible(counts: DataFrame, buckets: tuple) -> DataFrame:
    """One row: whether the total of counts(bucket, n, tokens) lies between what its buckets allow at least and at most."""
    low = F.coalesce(*(F.when(F.col("bucket") == name, F.lit(lo)) for name, lo, _ in buckets))
    high = F.coalesce(*(F.when(F.col("bucket") == name, F.lit(hi if hi is not None else 1 << 53).cast("double")) for name, _, hi in buckets))
    out = counts.agg(F.sum("n").alias("sessions"), F.sum(F.col("n") * low).alias("least"), F.sum(F.col("n") * high).alias("most"), F.sum("tokens").alias("total"))
    return out.withColumn("feasible", (F.col("least") <= F.col("total")) & (F.col("total") <= F.col("most")))


def report_rules() -> dict[str, Column]:
    """Rules of one by-model row of a report."""
    parts = F.col("input_tokens") + F.col("cache_write_input_tokens") + F.col("cache_read_input_tokens") + F.col("output_tokens")
    return {
        "total_is_the_sum": F.col("total_tokens") == parts,
        "reasoning_within_output": F.col("reasoning_output_tokens") <= F.col("output_tokens"),
        "records_within_tokens": F.col("usage_records") <= F.col("total_tokens"),
        "null_model_null_total": F.col("model").isNull() == F.col("total_tokens").isNull(),
    }


def attempt_rules() -> dict[str, Column]:
    """Rules of a pilot attempt: what is set once it is frozen, percentiles in order, results only where they belong.

    A paired attempt that is invalidated later keeps its actual value, and whatever was frozen keeps its percentiles.
    """
    state, values = F.col("state"), [F.col(c) for c in ("p10_usd", "p50_usd", "p90_usd", "actual_usd")]
    p10, p50, p90, actual = values
    positive = F.lit(True)
    for v in values:
        positive = positive & (v.isNull() | (v > 0))
    draft, bare = state == "draft", F.col("invalidation_reason").isNull()
    return {
        "known_state": state.isin("draft", "frozen", "paired", "invalidated"),
        "values_positive": positive,
        "frozen_has_class": draft | F.col("task_class").isNotNull(),
        "percentiles_in_order": draft | ((p10 > 0) & (p10 <= p50) & (p50 <= p90)),
        "open_has_no_result": ~state.isin("draft", "frozen") | (actual.isNull() & bare),
        "paired_has_actual": (state != "paired") | ((actual > 0) & bare),
        "invalidated_has_reason": (state != "invalidated") | ~bare,
    }
