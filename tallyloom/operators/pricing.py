"""Rates and cost: exact look-ups, ranges, snapshot deltas and the status of an amount. Unknown cost is null, never zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = ("input", "output", "cache_write", "cache_read")


def with_cost(usage: DataFrame, rates: DataFrame, key: str = "model") -> DataFrame:
    """Adds cost in dollars by an exact match of the model; null where there is no rate, never that of a model nearby.

    rates(model, input, output, cache_write, cache_read) in dollars for a million
    tokens is a table of some dozen rows, which Spark broadcasts by its size.
    """
    dollars = sum((F.col(f"{p}_tokens") * F.col(f"rate_{p}") for p in PARTS[1:]), F.col("input_tokens") * F.col("rate_input")) / 1e6
    named = rates.select(F.col("model").alias(key), *(F.col(p).alias(f"rate_{p}") for p in PARTS))
    return usage.join(named, key, "left").withColumn("cost", dollars).drop(*(f"rate_{p}" for p in PARTS))


def derived_rates(rates: DataFrame) -> DataFrame:
    """Cache writes cost 1.25 times and reads 0.1 times the input."""
    return rates.withColumns({"cache_write": F.col("input") * 1.25, "cache_read": F.col("input") * 0.1})


def equivalent_range(tokens: dict[str, Column], rates: DataFrame, usage: DataFrame) -> DataFrame:
    """Least and most that the usage would cost over all rates; rates are a fixed table of some dozen rows."""
    each = usage.crossJoin(F.broadcast(rates))
    cost = sum((tokens[p] * F.col(p) for p in PARTS[1:]), tokens["input"] * F.col("input")) / 1e6
    return each.groupBy(*usage.columns).agg(F.min(cost).alias("least"), F.max(cost).alias("most"), F.min_by("model", F.struct(cost, "model")).alias("cheapest"))


def snapshot_delta(before: DataFrame, after: DataFrame, key: str, counters: list[str]) -> DataFrame:
    """Differences of two snapshots by key; a side without a row counts zeros, and a counter that fell fails the job."""
    a = before.select(key, *(F.col(c).alias(f"before_{c}") for c in counters))
    b = after.select(key, *(F.col(c).alias(f"after_{c}") for c in counters))
    both = a.join(b, key, "full_outer")
    delta = {c: F.coalesce(f"after_{c}", F.lit(0)) - F.coalesce(f"before_{c}", F.lit(0)) for c in counters}
    fell = F.raise_error(F.concat(F.lit("a counter fell for "), F.col(key))).cast("long")
    return both.select(key, *(F.when(d < 0, fell).otherwise(d).alias(c) for c, d in delta.items()))


def cost_status(rows: Column, known: Column, estimated: Column, covered: Column) -> Column:
    """Status of a sum from its numbers of rows: all, with a recorded amount, with an estimate, covered by a subscription."""
    return (
        F.when((rows > 0) & (covered == rows), "subscription_covered")
        .when((known == rows) & (rows > 0), "recorded")
        .when((estimated == rows) & (rows > 0), "estimated")
        .when((known + estimated == rows) & (rows > 0), "mixed")
        .when(known + estimated > 0, "partial")
        .otherwise("unavailable")
    )
