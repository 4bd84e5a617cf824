"""Calls: deduplication, roll-ups by model, session and month, counter series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.columns import COUNTERS, FALLBACK_MODEL, checked_sum, month_of, total_tokens


def dedup_calls(calls: DataFrame, keys: list[str], counters: list[str], order: list[str]) -> DataFrame:
    """One row a call: the largest of each counter, the earliest day and time, a recognised model before the fallback.

    One exchange with partial aggregation; repeats of a hot call meet as one row
    a task.
    """
    first = F.struct((F.col("model") == FALLBACK_MODEL).alias("unknown"), *order)
    return calls.groupBy(*keys).agg(*(F.max(c).alias(c) for c in counters), F.min("day").alias("day"), F.min("time_ms").alias("time_ms"), F.min_by("model", first).alias("model"), F.count(F.lit(1)).alias("copies"))


def usage_by(calls: DataFrame, *keys: str) -> DataFrame:
    """Sums of the counters and the total; a sum that isn't an exact integer of a double any more fails."""
    return calls.groupBy(*keys).agg(*(checked_sum(F.col(c)).alias(c) for c in COUNTERS)).withColumn("total_tokens", total_tokens())


def session_rollup(calls: DataFrame, session: str = "session_key") -> DataFrame:
    """Counters, first and last day and time of each session, and whether all its days and times are known."""
    return calls.groupBy(session).agg(
        F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("records"), F.min("day").alias("first_day"), F.min("time_ms").alias("first_ms"), F.max("time_ms").alias("last_ms"),
        F.bool_and(F.col("day").isNotNull()).alias("days_known"), F.bool_and(F.col("time_ms").isNotNull()).alias("times_known"),
    )


def session_starts(sessions: DataFrame) -> DataFrame:
    """Sessions by the month of their first day, undated unless all days are known."""
    period = F.when(F.col("days_known"), month_of(F.col("first_day"))).otherwise(F.lit("undated"))
    return sessions.groupBy(period.alias("period")).agg(F.count(F.lit(1)).alias("session_starts"))


def counter_deltas(rows: DataFrame, by: list[str], order: list[str], total: str, last: Column | None = None) -> DataFrame:
    """Usage between cumulative totals of a series.

    Adds previous, repeated (the same total again), reset (a smaller total) and
    usage: the first total, a difference, after a reset `last` if there is one,
    else null; repeats give null.  One sort on the series serves everything.
    """
    before = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = rows.withColumn("previous", F.last(total, ignorenulls=True).over(before))
    repeated, reset = F.col(total) == F.col("previous"), F.col(total) < F.col("previous")
    usage = F.when(F.col("previous").isNull(), F.col(total)).when(repeated, None).when(reset, last).otherwise(F.col(total) - F.col("previous"))
    return out.withColumns({"repeated": F.coalesce(repeated, F.lit(False)), "reset": F.coalesce(reset, F.lit(False)), "usage": usage})


def forward_fill(rows: DataFrame, by: list[str], order: list[str], setter: Column, name: str, fallback: str = FALLBACK_MODEL) -> DataFrame:
    """The last value that `setter` set in the series; null leaves it as it was, before the first it is the fallback."""
    upto = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(name, F.coalesce(F.last(setter, ignorenulls=True).over(upto), F.lit(fallback)))


def keep_recent(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The n rows of each key that come first in `order`; the limit also runs before the exchange."""
    return rows.withColumn("_rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")
