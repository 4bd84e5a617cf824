"""Usage as a stream: hourly totals, counter deltas, calls merged over the whole run, and rollouts line by line."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.columns import FALLBACK_MODEL
from tallyloom.plans.shared import shared_folder
from tallyloom.sources.session_logs import USAGE_FIELDS, rollout_events


def drained(stream: DataFrame | MergedCalls, spark: SparkSession, mode: str = "append") -> DataFrame:
    """What a stream gives when all present input is read, as a table in the shared folder; a restart goes on from its checkpoint."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    if isinstance(stream, MergedCalls):
        write = lambda batch, number: stream.partial(batch).write.mode("overwrite").parquet(f"{root}/rows/version={number}")
        stream.calls.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        schema = stream.partial(spark.createDataFrame([], stream.calls.schema)).schema.add("version", "long")
        return stream.changes(spark.read.schema(schema).parquet(f"{root}/rows"))
    stream.writeStream.outputMode(mode).format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


def hourly_totals(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records and value by hour and type.

    Rows arrive in any order, so late ones still count: each micro-batch appends
    its partial sums, a few rows an hour, and the reader adds them up.
    """
    def partial(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("records"), F.sum("value").alias("value"))
        sums.write.mode("overwrite").parquet(f"{root}/batch={number}")  # a repeated batch replaces itself

    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    folder, _, name = path.rpartition("/")
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}*")
    source.writeStream.foreachBatch(partial).option("checkpointLocation", f"{root}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    parts = spark.read.schema("hour string, event_type string, records long, value double").parquet(root)
    return parts.groupBy("hour", "event_type").agg(F.sum("records").alias("records"), F.round(F.sum("value"), 4).alias("value"))


def watermarked_totals(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling windows of a stream; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("records"), F.sum("value").alias("value"))


DELTA = "series string, at long, usage long, reset boolean"
STATE = "total long"


def counter_delta_stream(snapshots: DataFrame) -> DataFrame:
    """Usage from a stream of cumulative totals (series, at, total), each series' last total as state.

    A smaller total is a reset: it is flagged and its usage is null.  Equal
    totals give nothing.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        previous = state.get[0] if state.exists else None
        rows = []
        for at, total in pd.concat(list(batches)).sort_values("at")[["at", "total"]].itertuples(index=False):
            if previous is None or total > previous:
                rows.append((key[0], at, total - (previous or 0), False))
            elif total < previous:
                rows.append((key[0], at, None, True))
            previous = total
        if previous is not None:
            state.update((int(previous),))
        yield pd.DataFrame(rows, columns=["series", "at", "usage", "reset"]).astype({"usage": "Int64"})

    return snapshots.groupBy("series").applyInPandasWithState(step, DELTA, STATE, "append", "NoTimeout")


@dataclass(frozen=True)
class MergedCalls:
    """A stream of calls whose micro-batches are merged each by itself, and what their log gives; `drained` writes and reads it."""

    calls: DataFrame
    counters: list[str]

    def partial(self, batch: DataFrame) -> DataFrame:
        """A row for each call of a micro-batch; `first` is (fallback, at, model) of the record that names its model."""
        first = F.struct((F.coalesce(F.col("model") == FALLBACK_MODEL, F.lit(False))).alias("fallback"), "at", "model")
        return batch.groupBy("call_key").agg(F.min(first).alias("first"), F.min("day").alias("day"), F.min("time_ms").alias("time_ms"), *(F.max(F.col(c).cast("long")).alias(c) for c in self.counters), F.count(F.lit(1)).alias("copies"))

    def changes(self, log: DataFrame) -> DataFrame:
        """call_key, sign, version and values from partial rows with a version: each call as it stood after every micro-batch that had it, and the row taken back then."""
        upto = W.partitionBy("call_key").orderBy("version").rowsBetween(W.unboundedPreceding, 0)
        kept = {"first": F.min("first"), "day": F.min("day"), "time_ms": F.min("time_ms"), **{c: F.max(c) for c in self.counters}, "copies": F.sum("copies")}
        stood = log.select("call_key", "version", *(f.over(upto).alias(c) for c, f in kept.items()), (F.lead("version").over(W.partitionBy("call_key").orderBy("version")).isNotNull()).alias("replaced"))
        one = F.lit(1).cast("long")
        signs = F.explode(F.when(F.col("replaced"), F.array(one, -one)).otherwise(F.array(one)))
        return stood.select("call_key", signs.alias("sign"), "version", F.col("first.model").alias("model"), "day", "time_ms", *self.counters, "copies")


def merged_call_stream(calls: DataFrame, counters: list[str]) -> MergedCalls:
    """Changes to the calls of a stream(call_key, at, model, day, time_ms, counters): of each call the largest counters, whatever comes when.

    A call is merged over the whole run, however late a repeat comes, so a row
    that was given out may turn out too small.  It is then taken back: rows have
    a sign, -1 for what no longer holds and 1 for what does, and a version.  Sums
    over sign times value are those of the batch rule after every micro-batch.
    A recognised model counts before the fallback, then the earliest one.

    The state is a log: each micro-batch appends a row for each of its calls, so
    no call is kept in memory, and a repeated micro-batch replaces itself.
    """
    return MergedCalls(calls.select("call_key", "at", "model", "day", "time_ms", *counters), counters)


def signed_totals(changes: DataFrame, by: list[str], counters: list[str]) -> DataFrame:
    """Calls and counters by key from changes: what was taken back cancels out; keys that nothing is left of are dropped."""
    out = changes.groupBy(*by).agg(F.sum("sign").alias("calls"), *(F.sum(F.col("sign") * F.col(c)).alias(c) for c in counters))
    return out.where("calls > 0")


ROLLOUT_STEP = "file string, line_no long, status string, model string, reset boolean, " + ", ".join(f"{f} long" for f in USAGE_FIELDS)
ROLLOUT_STATE = f"model string, session string, conflict boolean, uncertain boolean, {', '.join(f'{f} long' for f in USAGE_FIELDS)}"


def rollout_stream(lines: DataFrame) -> DataFrame:
    """Usage of a stream of rollout lines(file, line_no, line): what rollout_records gives, whatever lines come together.

    Each file's lines come in order.  Its state is all that a later line can
    depend on: the model set last, the session named and whether another was,
    whether a line couldn't be read, and the last total of each counter.
    """
    flat = lambda c: F.array(*(F.col(f"{c}.{f}") for f in USAGE_FIELDS))
    each = lambda c: F.when(F.col(c).isNotNull(), flat(c)).alias(c)
    events = rollout_events(lines).select("file", "line_no", "malformed", "oversized", "counts", "meta", "session_id", "setter", "uncertain", each("total"), each("last"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        model, session, conflict, uncertain, *before = state.get if state.exists else (FALLBACK_MODEL, None, False, False, *[None] * len(USAGE_FIELDS))
        before, rows = None if before[0] is None else before, []
        for e in pd.concat(list(batches)).sort_values("line_no").itertuples(index=False):
            model, uncertain = e.setter if isinstance(e.setter, str) else model, uncertain or bool(e.uncertain)
            if e.meta:
                conflict = conflict or not isinstance(e.session_id, str) or session not in (None, e.session_id)
                session = session or (e.session_id if isinstance(e.session_id, str) else None)
            total, last = (None if x is None else [int(v) for v in x] for x in (e.total, e.last))
            reset, used, status = False, last, "other"
            if e.counts and total is not None:
                delta = [a - b for a, b in zip(total, before or [0] * len(total), strict=True)]
                reset, again = before is not None and min(delta) < 0, total == before
                used, status = (last if reset else delta), "duplicate" if again else None
                before = total
            if e.counts and status != "duplicate":
                status = ("reset" if reset else "unread") if used is None else "usage" if used[0] + used[2] else "empty"
            status = "malformed" if e.malformed else "oversized" if e.oversized else "meta" if e.meta else status
            rows.append((key[0], int(e.line_no), status, model, reset, *(used if e.counts and used else [None] * len(USAGE_FIELDS))))
        state.update((model, session, conflict, uncertain, *(before or [None] * len(USAGE_FIELDS))))
        frame = pd.DataFrame(rows, columns=["file", "line_no", "status", "model", "reset", *USAGE_FIELDS])
        yield frame.astype(dict.fromkeys(USAGE_FIELDS, "Int64"))

    return events.groupBy("file").applyInPandasWithState(step, ROLLOUT_STEP, ROLLOUT_STATE, "append", "NoTimeout")
