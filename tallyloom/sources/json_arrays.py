"""Elements of JSON arrays of any size: one file is read in many tasks, and no row holds more than one element.

The text reader cuts a file at every `}`, wherever its byte ranges begin.  What
such a piece does to the parser's state depends only on whether it starts
inside a string, so both cases are summed up for each piece and for each byte
range; sums over the ranges before, and over the pieces before, then tell each
piece's true state.  An element ends where a `}` outside of strings brings the
depth back to the array's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _depth(segments: Column, parity: int) -> Column:
    """Brackets opened less brackets closed in every second segment between quotes."""
    outside = F.array_join(F.filter(segments, lambda _, i: i % 2 == parity), "")
    return F.length(F.regexp_replace(outside, r"[^{\[]", "")) - F.length(F.regexp_replace(outside, r"[^}\]]", ""))


def json_array_elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, element): the objects of the JSON array in each file below a path, in order of place within a file.

    Strings may hold any brackets, quotes and escapes.  What follows the last
    whole object is left out, so a file that breaks off loses only its last
    element; a file without an array of objects gives none.
    """
    pieces = spark.read.option("recursiveFileLookup", True).option("lineSep", "}").text(path)
    pieces = pieces.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"), "value")
    bare = F.regexp_replace("value", r"(?s)\\.", "")  # escapes never end a string, and none crosses a `}`
    segments = F.split(bare, '"', -1)
    rows = pieces.withColumn("_s", segments).select("file", "start", "row", "value", ((F.size("_s") - 1) % 2).alias("odd"), _depth(F.col("_s"), 0).alias("out_first"), _depth(F.col("_s"), 1).alias("in_first"))
    # The `}` after a piece counts if the piece ends outside of strings.
    rows = rows.withColumns({"out_first": F.col("out_first") - (F.col("odd") == 0).cast("int"), "in_first": F.col("in_first") - (F.col("odd") == 1).cast("int")})

    split = W.partitionBy("file", "start").orderBy("row")  # a byte range of a file, as Spark cut it
    upto = split.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({"odd_before": F.coalesce(F.sum("odd").over(upto), F.lit(0)) % 2, "_last": F.lead("row").over(split).isNull()})
    flipped = lambda a, b: F.when(F.col("odd_before") == 0, F.col(a)).otherwise(F.col(b))
    rows = rows.withColumns({"d_out": flipped("out_first", "in_first"), "d_in": flipped("in_first", "out_first")})

    ranges = rows.groupBy("file", "start").agg(F.sum("odd").alias("odd"), F.sum("d_out").alias("d_out"), F.sum("d_in").alias("d_in"))  # a row a byte range
    of_file = W.partitionBy("file").orderBy("start")
    earlier = of_file.rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.withColumn("inside", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2).withColumn("d", F.when(F.col("inside") == 0, F.col("d_out")).otherwise(F.col("d_in")))
    ranges = ranges.select("file", "start", "inside", F.coalesce(F.sum("d").over(earlier), F.lit(0)).alias("base"), F.lead("start").over(of_file).isNull().alias("_final"))

    rows = rows.join(ranges, ["file", "start"]).withColumn("d", F.when(F.col("inside") == 0, F.col("d_out")).otherwise(F.col("d_in")))
    depth = F.col("base") + F.sum("d").over(split.rowsBetween(W.unboundedPreceding, 0))
    outside = (F.col("inside") + F.col("odd_before") + F.col("odd")) % 2 == 0
    ends = (depth == 1) & outside & ~(F.col("_last") & F.col("_final"))
    rows = rows.withColumn("ends", ends.cast("int"))
    counts = rows.groupBy("file", "start").agg(F.sum("ends").alias("n"))
    counts = counts.select("file", "start", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("elements"))
    rows = rows.join(counts, ["file", "start"])
    place = F.col("elements") + F.coalesce(F.sum("ends").over(upto), F.lit(0))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "row", "value"))), lambda p: p["value"]), "}")
    elements = rows.withColumn("place", place).groupBy("file", "place").agg(text.alias("element"), F.max("ends").alias("whole")).where("whole = 1")
    return elements.select("file", "place", F.concat(F.regexp_replace("element", r"^[^{]*", ""), F.lit("}")).alias("element"))
