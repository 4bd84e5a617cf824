"""Running sums and maxima over numbered rows, by blocks of numbers, so that no task holds a whole series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def before(rows: DataFrame, by: list[str], at: str, values: list[str], how: Callable = F.sum, block: int = 4096, levels: int = 2) -> DataFrame:
    """Adds before_<value>: `how` over the rows of the same `by` with a smaller `at`; null where there is none.

    `at` numbers the rows of each key, `by` holds no null.  Values are combined
    by block of numbers first, with `levels` of blocks above each other, so the
    largest sort is one of max(block, numbers / block^levels) rows.
    """
    slot, earlier = f"_slot{levels}", lambda w, v: how(v).over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn(slot, F.floor(F.col(at) / block))
    sums = rows.groupBy(*by, slot).agg(*(how(v).alias(v) for v in values))
    if levels > 1:
        sums = before(sums, by, slot, values, how, block, levels - 1)
    else:
        sums = sums.select("*", *(earlier(W.partitionBy(*by).orderBy(slot), v).alias(f"before_{v}") for v in values))
    carried = sums.select(*by, slot, *(F.col(f"before_{v}").alias(f"_carried_{v}") for v in values))
    inside = W.partitionBy(*by, slot).orderBy(at)
    rows = rows.join(carried, [*by, slot])
    return rows.select(*(c for c in rows.columns if c != slot and not c.startswith("_carried_")), *(_both(how, F.col(f"_carried_{v}"), earlier(inside, v)).alias(f"before_{v}") for v in values))


def _both(how: Callable, a: Column, b: Column) -> Column:
    """The combination of two parts that may be missing."""
    if how is F.max:
        return F.greatest(a, b)
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
