"""Exact order statistics of groups of any size, from counts of value ranges.

A median or quantile over a whole group would sort or collect the group in one
task.  Here ranges of values are counted first, a running sum of the counts
says which range holds a wanted rank, and only the rows of that range are
sorted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.columns import interpolated
from tallyloom.plans.shared import written

#: Value ranges of a group; the largest sort is about a group's rows by this number.
RANGES = 64


def ranked_values(rows: DataFrame, by: list[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """by, n and, under each name, the value of the rank (from 1) that its function makes of n; ranks beyond the ends are clamped.

    Rows without a value are left out.  Equal values of `by` form a group, null
    too; without `by` all rows do.
    """
    keys = [F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")]
    # What follows reads the rows several times.
    rows = written(rows.where(F.col(value).isNotNull()).select(*by, keys[0].alias("_key"), F.col(value).cast("double").alias("_x")), "ranked")
    shares = [i / RANGES for i in range(1, RANGES)]
    groups = written(rows.groupBy("_key", *by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.percentile_approx(F.when(~F.isnan("_x"), F.col("_x")), shares, 1000), F.array().cast("array<double>")).alias("_edges")), "ranked-groups")  # NaN is above all edges
    at = F.size(F.filter("_edges", lambda e: e < F.col("_x")))
    tagged = rows.select("_key", "_x").join(groups.select("_key", "_edges"), "_key").select("_key", at.alias("_range"), "_x")
    counts = tagged.groupBy("_key", "_range").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(W.partitionBy("_key").orderBy("_range").rowsBetween(W.unboundedPreceding, 0))
    counts = counts.withColumn("_upto", upto)  # at most RANGES rows a group

    rank = lambda f: F.least(F.greatest(f(F.col("n")).cast("long"), F.lit(1)), F.col("n"))
    wanted = groups.select("_key", F.explode(F.array(*(F.struct(F.lit(name).alias("name"), rank(f).alias("rank")) for name, f in ranks.items()))).alias("w")).select("_key", "w.*")
    wanted = wanted.join(counts, "_key").where((F.col("rank") <= F.col("_upto")) & (F.col("rank") > F.col("_upto") - F.col("_n")))
    wanted = wanted.select("_key", "_range", "name", (F.col("rank") - F.col("_upto") + F.col("_n")).alias("_place"))
    sorted_ = tagged.join(wanted.select("_key", "_range").distinct(), ["_key", "_range"]).withColumn("_place", F.row_number().over(W.partitionBy("_key", "_range").orderBy("_x")))
    found = sorted_.join(wanted, ["_key", "_range", "_place"]).groupBy("_key").agg(*(F.max(F.when(F.col("name") == name, F.col("_x"))).alias(name) for name in ranks))
    return groups.join(found, "_key").select(*by, "n", *ranks)


def quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float | Callable[[Column], Column]], between: Callable[[Column, Column, Column], Column] = interpolated) -> DataFrame:
    """by, n and each quantile, between two values by linear interpolation; a share may be a function of n."""
    at = {name: (lambda n, s=s: (s(n) if callable(s) else F.lit(float(s))) * (n - 1)) for name, s in shares.items()}
    ranks = {}
    for name, f in at.items():
        ranks[f"{name}_low"], ranks[f"{name}_high"] = (lambda n, f=f: F.floor(f(n)) + 1), (lambda n, f=f: F.ceil(f(n)) + 1)
    found = ranked_values(rows, by, value, ranks)
    return found.select(*by, "n", *(between(F.col(f"{name}_low"), F.col(f"{name}_high"), f(F.col("n")) - F.floor(f(F.col("n")))).alias(name) for name, f in at.items()))


def medians(rows: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """by and the median of each value column."""
    each = F.array(*(F.struct(F.lit(v).alias("_value"), F.col(v).cast("double").alias("_y")) for v in values))
    found = quantiles(rows.select(*by, F.explode(each).alias("v")).select(*by, "v.*"), [*by, "_value"], "_y", {"median": 0.5})
    return found.groupBy(*by).agg(*(F.max(F.when(F.col("_value") == v, F.col("median"))).alias(v) for v in values))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds the place of each row (from 1) in the order of some columns, which together are unique: sorted by ranges, counts of the ranges are summed."""
    placed = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row a range
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    place = F.col("_before") + F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return placed.join(counts.select("_part", before.alias("_before")), "_part").withColumn(name, place).drop("_part", "_before")
