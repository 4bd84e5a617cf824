"""Session logs: JSON lines of assistant calls, and rollouts with cumulative counters.

Files are read by lines, in as many tasks as their size needs; a folder that
isn't there gives an empty table.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tallyloom.functions.columns import FALLBACK_MODEL, MAX_COUNT, is_count, sanitize_model_label
from tallyloom.operators.ranks import numbered
from tallyloom.operators.usage import dedup_calls
from tallyloom.plans.shared import written

_ESCAPE = re.compile(rb"\\.", re.DOTALL)
#: Longer lines are counted and not parsed; of rollouts, only what can be told from a few places.
LONGEST_LINE = 2 * 1024 * 1024
CALL_COUNTERS = {"input_tokens": "input_tokens", "cache_write_input_tokens": "cache_creation_input_tokens", "cache_read_input_tokens": "cache_read_input_tokens", "output_tokens": "output_tokens"}
TOTALS = "input_tokens bigint, cached_input_tokens bigint, output_tokens bigint, reasoning_output_tokens bigint, total_tokens bigint"
ROLLOUT = f"timestamp string, type string, payload struct<id: string, model: string, type: string, to_model: string, info: struct<total_token_usage: struct<{TOTALS.replace(' bigint', ': bigint')}>, last_token_usage: struct<{TOTALS.replace(' bigint', ': bigint')}>>>"


def jsonl_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(file, line_no, line) of all .jsonl files below a folder, in any case; a trailing CR is taken off.

    Files are split between tasks. line_no is (start of the split, number within
    the task), which orders the lines of a file.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.[jJ][sS][oO][nN][lL]").option("lineSep", "\n")
    try:
        lines = reader.text(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "file string, line_no struct<start: long, row: long>, line string")
    place = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    return lines.select(F.col("_metadata.file_path").alias("file"), place.alias("line_no"), F.when(F.col("value").contains("\r"), F.regexp_replace("value", "\r$", "")).otherwise(F.col("value")).alias("line")).where(F.trim("line") != "")


def _coerced_count(v: Column, path: str) -> Column:
    """A counter as numbers coerce: text with digits counts, null is 0; missing or anything else is null."""
    value = F.try_variant_get(v, path, "variant")
    text = F.trim(F.try_variant_get(v, path, "string"))
    kind = F.schema_of_variant(value)
    number = F.when(kind == "VOID", 0.0).when(text == "", 0.0).otherwise(text.try_cast("double"))
    whole = (number >= 0) & (number <= MAX_COUNT) & (number == F.floor(number))
    return F.when(value.isNotNull() & whole, number.cast("long"))


def assistant_calls(lines: DataFrame) -> DataFrame:
    """A row for each line: status (call, ignored, malformed, oversized) and, for calls, identity, model and counters.

    What lines say is written once: a condition on the status would be moved below
    the parsing and parse a line again for each value it looks at.
    """
    v = F.try_parse_json(F.when(F.length("line") <= LONGEST_LINE, F.col("line")))
    rows = lines.withColumn("v", v)
    text = lambda path: F.try_variant_get("v", path, "string")
    rows = rows.select(
        "file", "line_no", F.length("line").alias("size"), F.col("v").isNotNull().alias("parsed"), text("$.type").alias("type"), F.try_variant_get("v", "$.message.usage", "variant").isNotNull().alias("has_usage"),
        text("$.sessionId").alias("session_id"), text("$.timestamp").alias("timestamp"), text("$.message.id").alias("message_id"), text("$.requestId").alias("request_id"), text("$.message.model").alias("label"),
        *(_coerced_count(F.col("v"), f"$.message.usage.{source}").alias(name) for name, source in CALL_COUNTERS.items()),
    )
    rows = written(rows, "log-lines")
    counted = F.lit(True)
    for name in CALL_COUNTERS:
        counted = counted & F.col(name).isNotNull()
    total = sum((F.col(c) for c in list(CALL_COUNTERS)[1:]), F.col(next(iter(CALL_COUNTERS))))
    status = (
        F.when(F.col("size") > LONGEST_LINE, "oversized").when(~F.col("parsed"), "malformed").when(~F.coalesce(F.col("type") == "assistant", F.lit(False)) | ~F.col("has_usage"), "ignored")
        .when(~counted, "malformed").when(total == 0, "ignored").otherwise("call")
    )
    day = F.when(F.col("timestamp").rlike(r"^\d{4}-\d{2}-\d{2}(T|$)"), F.substring("timestamp", 1, 10))
    return rows.withColumns({"status": status, "model": F.coalesce(sanitize_model_label(F.col("label")), F.lit(FALLBACK_MODEL)), "day": day, "time_ms": F.unix_millis(F.col("timestamp").try_cast("timestamp"))})


def unique_calls(calls: DataFrame, within_session: bool = False) -> DataFrame:
    """One row for each (message, request) pair; lines without either are calls of their own."""
    named = F.col("message_id").isNotNull() | F.col("request_id").isNotNull()
    identity = F.when(named, F.to_json(F.array("message_id", "request_id"))).otherwise(F.to_json(F.array("file", F.col("line_no").cast("string"))))
    keys = ["call_key", "session_id"] if within_session else ["call_key"]
    return dedup_calls(calls.where("status = 'call'").withColumn("call_key", identity), keys, list(CALL_COUNTERS), ["file", "line_no"])


def coverage(rows: DataFrame) -> DataFrame:
    """One row of counters: what was found, parsed and left out."""
    count = lambda s: F.count_if(F.col("status") == s)
    files = rows.groupBy("file").agg(count("call").alias("calls"), count("malformed").alias("malformed"), count("oversized").alias("oversized"))
    out = files.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("calls") > 0).alias("files_with_usage"), F.sum("calls").alias("calls"), F.sum("malformed").alias("malformed"), F.sum("oversized").alias("oversized"))
    return out.withColumn("complete", (F.col("malformed") == 0) & (F.col("oversized") == 0))


USAGE_FIELDS = ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")
#: Limits of an oversized record that is still read: nested so deep, texts at wanted places so long.
DEEPEST, LONGEST_TEXT = 128, 1024


@F.pandas_udf(IntegerType())
def json_depth(lines: pd.Series) -> pd.Series:
    """How deep brackets of a JSON text are nested outside of strings, a megabyte at a time; null stays null."""

    def depth(text: str) -> int:
        inside, level, most = 0, 0, 0
        data = np.frombuffer(_ESCAPE.sub(b"", text.encode()), dtype=np.uint8)
        for i in range(0, len(data), 1 << 20):
            part = data[i : i + (1 << 20)]
            quotes = (np.cumsum(part == 34) + inside) % 2  # 1: within a string
            step = np.where(quotes == 0, ((part == 123) | (part == 91)).astype(np.int32) - ((part == 125) | (part == 93)), 0)
            levels = level + np.cumsum(step)
            inside, level, most = int(quotes[-1]), int(levels[-1]), max(most, int(levels.max()))
        return most

    return lines.map(depth, na_action="ignore").astype("Int32")


def _strict_usage(u: Column) -> Column:
    """A counter record whose numbers are all there, exact, and fit each other; else null."""
    whole = F.lit(True)
    for f in USAGE_FIELDS:
        whole = whole & F.coalesce(is_count(u[f]), F.lit(False))
    return F.when(whole & (u["cached_input_tokens"] <= u["input_tokens"]) & (u["reasoning_output_tokens"] <= u["output_tokens"]), u)


def _projected(e: Column, keys: Column, line: Column) -> Column:
    """What an oversized line is: a record, ignored, unresolved because it can't be told from its wanted places, or failed, no JSON or nested too deep."""
    kind, p = e["type"], e["payload"]
    texts = (e["timestamp"], kind, p["type"], p["id"], p["model"], p["to_model"])
    too_long = F.lit(False)
    for t in texts:
        too_long = too_long | F.coalesce(F.length(t) > LONGEST_TEXT, F.lit(False))
    given = [sum((u[f].isNotNull().cast("int") for f in USAGE_FIELDS[1:]), u[USAGE_FIELDS[0]].isNotNull().cast("int")) for u in (p["info"]["total_token_usage"], p["info"]["last_token_usage"])]
    given = [F.coalesce(n, F.lit(0)) for n in given]
    counted = given[0].isin(0, 5) & given[1].isin(0, 5) & (given[0] + given[1] > 0)
    event = F.when(p["type"] == "model_reroute", "record").when(p["type"] == "token_count", F.when(counted, "record").otherwise("unresolved")).when(p["type"].isNotNull(), "ignored").otherwise("unresolved")
    known = F.when(kind.isin("session_meta", "turn_context"), "record").when(kind == "event_msg", event).when(kind.isNotNull(), "ignored").otherwise("unresolved")
    return F.when(keys.isNull() | (json_depth(line) > DEEPEST), "failed").when(too_long, "unresolved").otherwise(known)


def rollout_events(lines: DataFrame) -> DataFrame:
    """What each line of a rollout says by itself: the model it sets, the session it names, the counters it gives, or that it can't be read."""
    big = F.length("line") > LONGEST_LINE
    e = F.from_json("line", ROLLOUT)
    rows = lines.select("file", "line_no", F.xxhash64("line").alias("digest"), big.alias("big"), e.alias("e"), F.json_object_keys("line").alias("keys"), F.when(big, F.col("line")).alias("big_line"), F.when(~big & ~F.ltrim("line").startswith("{"), F.col("line")).alias("scalar"))
    projection = F.when(F.col("big"), _projected(F.col("e"), F.col("keys"), F.col("big_line")))
    parsed = F.col("keys").isNotNull() | F.try_parse_json("scalar").isNotNull()
    rows = rows.select("file", "line_no", "digest", "e", projection.alias("projection"), parsed.alias("parsed"))
    kind, p = F.col("e.type"), F.col("e.payload")
    oversized, read = F.coalesce(F.col("projection").isin("unresolved", "failed"), F.lit(False)), F.coalesce(F.col("projection"), F.lit("record")) == "record"
    malformed = F.col("projection").isNull() & ~F.col("parsed")
    setter = (
        F.when(malformed | oversized, F.lit(FALLBACK_MODEL)).when(read & (kind == "turn_context"), F.coalesce(sanitize_model_label(p["model"]), F.lit(FALLBACK_MODEL)))
        .when(read & (kind == "event_msg") & (p["type"] == "model_reroute"), F.coalesce(sanitize_model_label(p["to_model"]), F.lit(FALLBACK_MODEL)))
    )
    counts = F.coalesce(read & (kind == "event_msg") & (p["type"] == "token_count"), F.lit(False))
    meta = F.coalesce(read & (kind == "session_meta"), F.lit(False))
    return rows.select(
        "file", "line_no", "digest", malformed.alias("malformed"), oversized.alias("oversized"), counts.alias("counts"), meta.alias("meta"), F.when(meta, p["id"]).alias("session_id"), setter.alias("setter"),
        (malformed | (oversized & ((F.col("projection") == "failed") | F.coalesce(kind == "session_meta", F.lit(False))))).alias("uncertain"), F.col("e.timestamp").alias("timestamp"),
        F.when(counts, _strict_usage(p["info"]["total_token_usage"])).alias("total"), F.when(counts, _strict_usage(p["info"]["last_token_usage"])).alias("last"),
    )


def rollout_records(lines: DataFrame) -> DataFrame:
    """What each line of a rollout is and adds: status, the model set last, usage since the line before, session id and whether it leaves the file incomplete.

    status: malformed, oversized (longer than LONGEST_LINE and not to be told
    from its wanted places), meta, usage, duplicate (the same total again), reset
    (a smaller total without usage of its own), unread (no usable counters),
    empty (nothing was used), other.  reset also marks usage that follows one.  A
    line that can't be read sets the model back to unknown.
    """
    order = W.partitionBy("file").orderBy("line_no")
    rows = rollout_events(lines)
    rows = rows.withColumns({"model": F.coalesce(F.last("setter", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)), F.lit(FALLBACK_MODEL)), "before": F.last("total", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))})
    total, last, before = F.col("total"), F.col("last"), F.col("before")
    falls = F.lit(False)
    for f in USAGE_FIELDS:
        falls = falls | F.coalesce(total[f] < before[f], F.lit(False))
    duplicate, reset = F.coalesce(total == before, F.lit(False)), total.isNotNull() & falls
    used = {f: F.when(total.isNull() | reset, last[f]).otherwise(total[f] - F.coalesce(before[f], F.lit(0))) for f in USAGE_FIELDS}
    rows = rows.withColumns({"duplicate": duplicate, "reset": reset, **{f"used_{f}": c for f, c in used.items()}})
    nothing = F.col("used_input_tokens") + F.col("used_output_tokens") == 0  # cached and reasoning tokens are parts of these
    status = (
        F.when(F.col("malformed"), "malformed").when(F.col("oversized"), "oversized").when(F.col("meta"), "meta").when(~F.col("counts"), "other").when(F.col("duplicate"), "duplicate")
        .when(F.col("used_input_tokens").isNull(), F.when(F.col("reset"), "reset").otherwise("unread")).when(nothing, "empty").otherwise("usage")
    )
    only_last = total.isNull() & last.isNotNull()
    uneven = F.col("used_total_tokens") != F.col("used_input_tokens") + F.col("used_output_tokens")
    incomplete = F.col("status").isin("malformed", "oversized", "reset", "unread") | (F.col("status").isin("usage", "empty") & (F.col("reset") | only_last | uneven))
    return rows.withColumn("status", status).select(
        "file", "line_no", "digest", "status", "model", "session_id", "uncertain", "reset", incomplete.alias("incomplete"), F.when(F.col("timestamp").rlike(r"^\d{4}-\d{2}-\d{2}(T|$)"), F.substring("timestamp", 1, 10)).alias("day"),
        (F.col("used_input_tokens") - F.col("used_cached_input_tokens")).alias("input_tokens"), F.lit(0).cast("long").alias("cache_write_input_tokens"), F.col("used_cached_input_tokens").alias("cache_read_input_tokens"),
        F.col("used_output_tokens").alias("output_tokens"), F.col("used_reasoning_output_tokens").alias("reasoning_output_tokens"), F.lit(1).cast("long").alias("usage_records"),
    )


def rollout_usage(lines: DataFrame) -> DataFrame:
    """Usage by file and line of rollouts: differences of cumulative totals under the model that was set last; a total that comes again is repeated and adds nothing."""
    rows = rollout_records(lines).where("status in ('usage', 'duplicate')").withColumn("repeated", F.col("status") == "duplicate")
    return rows.drop("digest", "status", "session_id", "uncertain", "incomplete", "day")


def rollout_files(records: DataFrame) -> DataFrame:
    """A verdict on each file: what its lines count, and whether its usage is taken.

    verdict: skipped (a line that can't be read may have named its session),
    without_usage, accepted, repeated (the lines of an accepted file again),
    no_single_session, session_taken (an accepted file of other contents has its
    session).  Files come in order of their names.
    """
    is_ = lambda *s: F.count_if(F.col("status").isin(*s))
    lanes = [F.sum(F.xxhash64("digest", F.lit(salt)).cast("decimal(20,0)")) for salt in (1, 2)]  # of lines in any order
    files = records.groupBy("file").agg(
        F.bool_or("uncertain").alias("uncertain"), is_("usage").alias("usage_records"), is_("malformed").alias("malformed"), is_("oversized").alias("oversized"), F.count_if("reset").alias("resets"), is_("duplicate").alias("duplicates"),
        F.bool_or("incomplete").alias("incomplete"), F.min("session_id").alias("session_id"), F.max("session_id").alias("_other"), F.count_if((F.col("status") == "meta") & F.col("session_id").isNull()).alias("_nameless"),
        F.concat_ws(":", F.count(F.lit(1)), *lanes).alias("content"),
    )
    candidate = ~F.col("uncertain") & (F.col("usage_records") > 0)
    files = files.withColumns({"candidate": candidate, "single": F.col("session_id").isNotNull() & (F.col("session_id") == F.col("_other")) & (F.col("_nameless") == 0)})
    place = lambda *by: F.row_number().over(W.partitionBy("candidate", *by).orderBy("file"))
    files = files.withColumn("again", F.col("candidate") & (place("content") > 1))
    first = F.row_number().over(W.partitionBy("candidate", "again", "single", "session_id").orderBy("file"))
    verdict = (
        F.when(F.col("uncertain"), "skipped").when(~F.col("candidate"), "without_usage").when(F.col("again"), "repeated").when(~F.col("single"), "no_single_session")
        .when(F.col("place") > 1, "session_taken").otherwise("accepted")
    )
    return files.withColumn("place", first).withColumn("verdict", verdict).select("file", "session_id", "verdict", "usage_records", "malformed", "oversized", "resets", "duplicates", "incomplete")


def accepted_rollout_usage(records: DataFrame, files: DataFrame, strict: bool = True) -> DataFrame:
    """Usage of accepted files alone; with strict, a file without one session of its own ends it all, as totals may count twice."""
    refused = F.col("verdict").isin("no_single_session", "session_taken")
    taken = files.where((F.col("verdict") == "accepted") | (refused if strict else F.lit(False)))
    message = F.concat(F.lit("no total is safe to give: "), "verdict")
    checked = F.when(refused, F.raise_error(message).cast("boolean")).otherwise(True)
    return records.where("status = 'usage'").join(taken.select("file", checked.alias("_ok")), "file").where("_ok").drop("_ok")


def rollout_coverage(files: DataFrame) -> DataFrame:
    """One row of counters over all files, refused ones too: what was found, read, repeated and left out."""
    is_ = lambda *v: F.count_if(F.col("verdict").isin(*v))
    again = F.sum(F.when(F.col("verdict") == "repeated", F.col("usage_records")).otherwise(0))
    out = files.agg(
        F.count(F.lit(1)).alias("files_discovered"), (F.count(F.lit(1)) - is_("skipped")).alias("files_parsed"), is_("accepted", "repeated").alias("files_with_usage"), is_("skipped").alias("files_skipped"), F.sum("malformed").alias("malformed"),
        F.sum("oversized").alias("oversized"), F.sum("resets").alias("resets"), (F.sum("duplicates") + again).alias("duplicates"), (~F.bool_or("incomplete") & (is_("skipped") == 0)).alias("complete"),
    )
    return out


def cleaned_rows(calls: DataFrame) -> DataFrame:
    """Calls without ids or text: session_number (sessions in the order of their first line), day, model and counters; repeats within a session are one."""
    rows = unique_calls(calls, within_session=True)
    named = calls.where("status = 'call'").groupBy("session_id").agg(F.min(F.struct("file", "line_no")).alias("first"))
    named = numbered(named.select("session_id", F.col("first.file").alias("file"), F.col("first.line_no").alias("line_no")), ["file", "line_no"], "session_number")
    return rows.join(named.select("session_id", "session_number"), rows["session_id"].eqNullSafe(named["session_id"])).select("session_number", "day", "model", *CALL_COUNTERS)


def default_roots(home: str, source: str) -> list[str]:
    """Where a source keeps its logs below a home folder."""
    folders = {"claude_code": [".claude/projects"], "codex": [".codex/sessions", ".codex/archived_sessions"]}  # fixed values
    return [f"{home.rstrip('/')}/{x}" for x in folders[source]]
