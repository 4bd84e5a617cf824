"""Sources: tables are written out in the formats of other tools and read back; SQL over the same tables says what must come out.

Every file is a key of its own, so files are written and read in many tasks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tallyloom.functions.columns import FALLBACK_MODEL, token_estimate
from tallyloom.operators.conversations import visible_branch
from tallyloom.plans.registry import Tables, query
from tallyloom.plans.shared import shared_folder, written
from tallyloom.plans.usage_queries import CALLS, calls
from tallyloom.sources.exports import billing_items, classify_files, console_usage, editor_usage, file_manifest, flat_conversations, read_csv, report_numbers, tree_conversations
from tallyloom.sources.session_logs import USAGE_FIELDS, accepted_rollout_usage, assistant_calls, cleaned_rows, coverage, jsonl_lines, rollout_coverage, rollout_files, rollout_records, unique_calls
from tallyloom.streaming.usage import drained, merged_call_stream, rollout_stream, signed_totals


def text_files(rows: DataFrame, order: list[str], suffix: str) -> str:
    """A folder below the shared one with a file for each `part` of rows(part, value, ...), its values in order as lines."""
    spark, folder = rows.sparkSession, f"{shared_folder(rows.sparkSession)}/files-{uuid.uuid4().hex}"
    rows.repartition("part").sortWithinPartitions("part", *order).select("part", "value").write.partitionBy("part").text(folder)
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*/part-*")):  # names only: the text writer has one ending
        path = status.getPath()
        fs.rename(path, spark._jvm.org.apache.hadoop.fs.Path(path.getParent(), f"{path.getName().removesuffix('.txt')}.{suffix}"))
    return folder


def csv_file(rows: DataFrame) -> str:
    folder = f"{shared_folder(rows.sparkSession)}/files-{uuid.uuid4().hex}"
    rows.write.option("header", True).option("escape", '"').csv(folder)
    return folder


def array_lines(elements: DataFrame) -> DataFrame:
    """part, at and value: elements(part, id, json) as lines of one JSON array for each part."""
    of = W.partitionBy("part").orderBy("id")
    lines = elements.select("part", F.row_number().over(of).alias("at"), "json")
    lines = lines.select("part", "at", F.concat(F.when(F.col("at") == 1, "[").otherwise(","), "json").alias("value"))
    return lines.unionByName(elements.select("part").distinct().select("part", F.lit(1 << 30).alias("at"), F.lit("]").alias("value")))


# Session logs: each event is a line, each day a file; three events are one call.
LOG = f"""e AS (SELECT event_id AS id, user_id, strftime(ts, '%Y-%m-%d') AS day, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    CASE event_type WHEN 'view' THEN 'claude-opus-4-8' WHEN 'click' THEN 'claude-4-5-haiku' WHEN 'purchase' THEN '{FALLBACK_MODEL}' ELSE 'gpt-5-mini' END AS model FROM events),
  k AS (SELECT *, CASE WHEN id % 5000 = 7 THEN 'oversized' WHEN id % 97 = 0 THEN 'broken' WHEN id % 101 = 0 THEN 'ignored' WHEN id % 83 = 0 THEN 'ignored' WHEN id % 89 = 0 THEN 'uncounted' ELSE 'call' END AS kind,
    k AS input_tokens, id % 7 AS output_tokens, id % 5 AS cache_write_input_tokens, CASE WHEN id % 2 = 0 THEN 0 ELSE id % 3 END AS cache_read_input_tokens, CASE WHEN id % 13 = 0 THEN 'own' || id ELSE 'pair' || id // 3 END AS call FROM e),
  c AS (SELECT * FROM k WHERE kind = 'call' AND input_tokens + output_tokens + cache_write_input_tokens + cache_read_input_tokens > 0)"""
COUNTED = ", ".join(f"max({c}) AS {c}" for c in ("input_tokens", "cache_write_input_tokens", "cache_read_input_tokens", "output_tokens"))
FIRST_MODEL = f"arg_min(model, (model = '{FALLBACK_MODEL}', day, id)) AS model"


def session_log_lines(t: Tables) -> DataFrame:
    """Counters as numbers, texts and null, repeats across sessions, calls without ids, lines that aren't JSON, other records, no counts and too long."""
    i, e = F.col("event_id"), F.col("event_type")
    k = F.get_json_object("props", "$.k").try_cast("long")
    label = F.when(e == "view", "claude-opus-4-8").when(e == "click", "Claude-4-5-haiku-20251001").when(e == "purchase", "<script>").otherwise("gpt-5-mini")
    cell = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    zero = lambda c: F.when(i % 83 == 0, F.lit("0")).otherwise(c)
    count = F.when(i % 89 == 0, '"many"').when(i % 11 == 0, F.concat(F.lit('" '), cell(k), F.lit('"'))).otherwise(cell(k))
    named = lambda letter: F.when(i % 13 == 0, "null").otherwise(F.concat(F.lit(f'"{letter}'), F.expr("event_id div 3").cast("string"), F.lit('"')))
    line = F.concat(
        F.lit('{"type":"'), F.when(i % 101 == 0, "user").otherwise("assistant"), F.lit('","sessionId":"u'), F.col("user_id").cast("string"), F.lit('","timestamp":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('","requestId":'), named("r"),
        F.lit(',"message":{"id":'), named("m"), F.lit(',"model":"'), label, F.lit('","usage":{"input_tokens":'), zero(count), F.lit(',"output_tokens":'), zero(cell(i % 7)), F.lit(',"cache_creation_input_tokens":'), zero(cell(i % 5)),
        F.lit(',"cache_read_input_tokens":'), zero(F.when(i % 2 == 0, "null").otherwise(cell(i % 3))), F.lit('},"content":"'), F.when(i % 5000 == 7, F.repeat(F.lit("x"), 2_100_000)).otherwise("private"), F.lit('"}}'), F.when(i % 3 == 0, "\r").otherwise(""),
    )
    value = F.when((i % 97 == 0) & (i % 5000 != 7), "{not json").otherwise(line)
    rows = t.events.select(F.date_format("ts", "yyyy-MM-dd").alias("part"), i.alias("at"), value.alias("value"))
    return jsonl_lines(t.spark, text_files(rows, ["at"], "jsonl"))


@query(f"WITH {LOG} SELECT {FIRST_MODEL}, {COUNTED}, count(*) AS copies FROM c GROUP BY call")
def session_log_calls(t: Tables) -> DataFrame:
    """Each call once, with the largest of each counter, whatever session repeats it."""
    return unique_calls(assistant_calls(session_log_lines(t))).select("model", "input_tokens", "cache_write_input_tokens", "cache_read_input_tokens", "output_tokens", "copies")


@query(f"""WITH {LOG} SELECT count(DISTINCT day) AS files, count(DISTINCT CASE WHEN c.id IS NOT NULL THEN day END) AS files_with_usage, count(c.id) AS calls, count(*) FILTER (WHERE kind IN ('broken', 'uncounted')) AS malformed,
  count(*) FILTER (WHERE kind = 'oversized') AS oversized, count(*) FILTER (WHERE kind IN ('broken', 'uncounted', 'oversized')) = 0 AS complete FROM k LEFT JOIN (SELECT id FROM c) c USING (id)""")
def session_log_coverage(t: Tables) -> DataFrame:
    return coverage(assistant_calls(session_log_lines(t)))


@query(f"""WITH {LOG}, s AS (SELECT user_id, row_number() OVER (ORDER BY min((day, id))) AS session_number FROM c GROUP BY user_id)
  SELECT session_number, day, model, input_tokens, cache_write_input_tokens, cache_read_input_tokens, output_tokens FROM (SELECT user_id, min(day) AS day, {FIRST_MODEL}, {COUNTED} FROM c GROUP BY user_id, call) JOIN s USING (user_id)""")
def cleaned_log_rows(t: Tables) -> DataFrame:
    """Rows to hand on: session numbers in order of appearance instead of ids, repeats within a session merged."""
    return cleaned_rows(assistant_calls(session_log_lines(t))).withColumn("session_number", F.col("session_number").cast("long"))


# Rollouts: the events of a twelfth of the users are a session; some files come again, and some claim another's session.
ROLLOUTS = f"""o AS (SELECT user_id % 12 AS g, event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, row_number() OVER (PARTITION BY user_id % 12 ORDER BY event_id) AS n FROM events),
  r AS (SELECT *, CASE WHEN n = 2 OR (n = 3 AND g % 6 = 5) THEN 'meta' WHEN n % 37 = 0 AND g % 4 = 0 THEN 'broken' WHEN n % 50 = 0 THEN 'reset' WHEN n % 29 = 0 THEN 'invalid' WHEN n % 23 = 0 THEN 'last' WHEN n % 10 = 1 THEN 'model' WHEN n % 10 = 5 THEN 'again' ELSE 'usage' END AS kind FROM o),
  u AS (SELECT *, CASE kind WHEN 'reset' THEN 1 ELSE k + 1 END AS i, CASE kind WHEN 'usage' THEN k // 2 ELSE 0 END AS c, CASE kind WHEN 'usage' THEN id % 7 ELSE 1 END AS t, CASE kind WHEN 'usage' THEN id % 7 // 2 ELSE 0 END AS s,
    last_value(CASE kind WHEN 'model' THEN CASE n // 10 % 3 WHEN 0 THEN 'gpt-5-sol' WHEN 1 THEN 'gpt-5-terra' ELSE '{FALLBACK_MODEL}' END WHEN 'broken' THEN '{FALLBACK_MODEL}' END IGNORE NULLS) OVER (PARTITION BY g ORDER BY n) AS model FROM r),
  x AS (SELECT g, g AS part, count(*) FILTER (WHERE kind IN ('usage', 'reset', 'last')) AS usage_records, count(*) FILTER (WHERE kind = 'broken') AS malformed, count(*) FILTER (WHERE kind = 'reset') AS resets, count(*) FILTER (WHERE kind = 'again') AS duplicates,
    CASE WHEN count(*) FILTER (WHERE kind = 'broken') > 0 THEN 'skipped' WHEN g % 6 = 5 THEN 'no_single_session' ELSE 'accepted' END AS verdict FROM u GROUP BY g),
  f AS (SELECT * FROM x UNION ALL SELECT g, part + 20, usage_records, malformed, resets, duplicates, CASE verdict WHEN 'accepted' THEN 'repeated' ELSE verdict END FROM x WHERE g % 3 = 1
    UNION ALL SELECT g, part + 40, usage_records + 1, malformed, resets, duplicates, CASE verdict WHEN 'accepted' THEN 'session_taken' ELSE verdict END FROM x WHERE g % 3 = 2)"""


def rollout_texts(t: Tables) -> DataFrame:
    """g, n, value: cumulative totals, repeated ones, resets, records with a last usage only or counters that don't fit, changes of model, lines that can't be read."""
    g, of = F.col("g"), W.partitionBy("g").orderBy("event_id")
    rows = t.events.select((F.col("user_id") % 12).alias("g"), "event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k")).withColumn("n", F.row_number().over(of))
    n = F.col("n")
    kind = (
        F.when((n == 2) | ((n == 3) & (g % 6 == 5)), "meta").when((n % 37 == 0) & (g % 4 == 0), "broken").when(n % 50 == 0, "reset").when(n % 29 == 0, "invalid").when(n % 23 == 0, "last")
        .when(n % 10 == 1, "model").when(n % 10 == 5, "again").otherwise("usage")
    )
    rows = rows.withColumn("kind", kind).withColumn("run", F.sum(F.when(F.col("kind") == "reset", 1).otherwise(0)).over(of))
    adds, resets = F.col("kind") == "usage", F.col("kind") == "reset"
    seventh = F.col("event_id") % 7
    part = {"input_tokens": (F.col("k") + 1, 1), "cached_input_tokens": (F.floor(F.col("k") / 2), 0), "output_tokens": (seventh, 1), "reasoning_output_tokens": (F.floor(seventh / 2), 0)}
    run = W.partitionBy("g", "run").orderBy("n")
    rows = rows.withColumns({f: F.sum(F.when(adds, c).when(resets, first).otherwise(0)).over(run).cast("long") for f, (c, first) in part.items()})
    rows = rows.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))
    fields = lambda **c: F.struct(*(x.cast("long").alias(name) for name, x in c.items()))
    total = fields(**{f: F.col(f) for f in (*part, "total_tokens")})
    unfit = fields(**{f: F.col(f) for f in part} | {"cached_input_tokens": F.col("input_tokens") + 1, "total_tokens": F.col("total_tokens")})
    only = lambda first: fields(input_tokens=first, cached_input_tokens=F.lit(0), output_tokens=F.lit(1), reasoning_output_tokens=F.lit(0), total_tokens=first + 1)
    info = lambda whole, last: F.to_json(F.struct(F.lit("event_msg").alias("type"), F.struct(F.lit("token_count").alias("type"), F.struct(whole.alias("total_token_usage"), last.alias("last_token_usage")).alias("info")).alias("payload")))
    none = F.lit(None).cast("int")
    label = F.when(F.floor(n / 10) % 3 == 0, "gpt-5-sol").when(F.floor(n / 10) % 3 == 1, "GPT-5-terra").otherwise("somebody's own")
    model = F.to_json(F.struct(F.lit("turn_context").alias("type"), F.struct(label.alias("model")).alias("payload")))
    meta = F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(F.concat(F.lit("s"), g.cast("string"), F.when(n == 3, "-other").otherwise("")).alias("id")).alias("payload")))
    value = (
        F.when(F.col("kind") == "meta", meta).when(F.col("kind") == "broken", '{"type": "turn_context", "payl').when(resets, info(total, only(F.lit(1)))).when(F.col("kind") == "invalid", info(unfit, none))
        .when(F.col("kind") == "last", info(none, only(F.col("k") + 1))).when(F.col("kind") == "model", model).otherwise(info(total, none))
    )
    return rows.select("g", "n", value.alias("value"))


def rollout_lines(t: Tables) -> DataFrame:
    """Files of them: each session's own, some copied, and some with a line more under the same session."""
    g, rows = F.col("g"), written(rollout_texts(t), "rollouts")
    last = F.struct(*(F.lit(x).cast("long").alias(f) for f, x in zip(USAGE_FIELDS, (5, 0, 1, 0, 6), strict=True))).alias("last_token_usage")
    extra = F.to_json(F.struct(F.lit("event_msg").alias("type"), F.struct(F.lit("token_count").alias("type"), F.struct(last).alias("info")).alias("payload")))
    more = rows.where("g % 3 = 2").groupBy("g").agg(F.max("n").alias("n")).select("g", (F.col("n") + 1).alias("n"), extra.alias("value"))
    name = lambda extra: F.lpad((g + extra).cast("string"), 2, "0").alias("part")
    files = rows.select(name(0), "n", "value").unionByName(rows.where("g % 3 = 1").select(name(20), "n", "value")).unionByName(rows.where("g % 3 = 2").unionByName(more).select(name(40), "n", "value"))
    return rollout_records(jsonl_lines(t.spark, text_files(files, ["n"], "jsonl")))


@query(f"WITH {ROLLOUTS} SELECT CAST(part AS BIGINT) AS part, verdict, usage_records, malformed, resets, duplicates FROM f")
def rollout_file_verdicts(t: Tables) -> DataFrame:
    """Which files' usage is taken: not those with a line that can't be read, of no single session, or whose session another file has; all keep their counters."""
    found = rollout_files(rollout_lines(t))
    return found.select(F.regexp_extract("file", r"part=(\d+)", 1).cast("long").alias("part"), "verdict", "usage_records", "malformed", "resets", "duplicates")


@query(f"""WITH {ROLLOUTS} SELECT model, CAST(sum(i - c) AS BIGINT) AS input_tokens, CAST(sum(c) AS BIGINT) AS cache_read_input_tokens, CAST(sum(t) AS BIGINT) AS output_tokens, CAST(sum(s) AS BIGINT) AS reasoning_output_tokens,
  count(*) AS updates, count(*) FILTER (WHERE kind = 'reset') AS resets FROM u JOIN (SELECT g FROM x WHERE verdict = 'accepted') USING (g) WHERE kind IN ('usage', 'reset', 'last') GROUP BY model""")
def rollout_usage_by_model(t: Tables) -> DataFrame:
    """Usage of accepted files by the model set last."""
    records = written(rollout_lines(t), "rollout-records")
    used = accepted_rollout_usage(records, rollout_files(records), strict=False)
    return used.groupBy("model").agg(*(F.sum(c).alias(c) for c in ("input_tokens", "cache_read_input_tokens", "output_tokens", "reasoning_output_tokens")), F.sum("usage_records").alias("updates"), F.count_if("reset").alias("resets"))


@query(f"""WITH {ROLLOUTS} SELECT count(*) AS files_discovered, count(*) FILTER (WHERE verdict <> 'skipped') AS files_parsed, count(*) FILTER (WHERE verdict IN ('accepted', 'repeated')) AS files_with_usage, count(*) FILTER (WHERE verdict = 'skipped') AS files_skipped,
  CAST(sum(malformed) AS BIGINT) AS malformed, 0::BIGINT AS oversized, CAST(sum(resets) AS BIGINT) AS resets, CAST(sum(duplicates + CASE verdict WHEN 'repeated' THEN usage_records ELSE 0 END) AS BIGINT) AS duplicates, false AS complete FROM f""")
def rollout_coverage_counters(t: Tables) -> DataFrame:
    return rollout_coverage(rollout_files(rollout_lines(t)))


@query(f"""WITH {ROLLOUTS} SELECT model, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(c) AS BIGINT) AS cached_input_tokens, CAST(sum(t) AS BIGINT) AS output_tokens, CAST(sum(s) AS BIGINT) AS reasoning_output_tokens, count(*) AS updates,
  count(*) FILTER (WHERE kind = 'reset') AS resets FROM u WHERE kind IN ('usage', 'reset', 'last') GROUP BY model""")
def rollout_usage_stream(t: Tables) -> DataFrame:
    """All sessions' lines as a stream that cuts them anywhere: model, last totals and resets live on between micro-batches."""
    lines = written(rollout_texts(t).select(F.col("g").cast("string").alias("file"), F.col("n").cast("long").alias("line_no"), F.col("value").alias("line")), "stream-lines")
    folder = f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    for piece in stream_pieces(lines):  # one after the other: as a log grows
        piece.coalesce(1).write.mode("append").parquet(folder)
    stream = t.spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = drained(rollout_stream(stream), t.spark).where("status = 'usage'")
    return out.groupBy("model").agg(*(F.sum(c).alias(c) for c in USAGE_FIELDS[:4]), F.count(F.lit(1)).alias("updates"), F.count_if("reset").alias("resets"))


#: Lines of a file that come in one micro-batch, so that what Python holds of a file doesn't grow with it.
STREAM_LINES = 200_000


def stream_pieces(lines: DataFrame, size: int = STREAM_LINES) -> list[DataFrame]:
    """Lines up to the 17th, the 61st and then every `size` of each file; a folder a piece, so that each reads its own."""
    n, folder = F.col("line_no"), f"{shared_folder(lines.sparkSession)}/pieces-{uuid.uuid4().hex}"
    piece = F.when(n < 17, 0).when(n < 61, 1).otherwise(F.floor((n - 61) / size) + 2)
    lines.withColumn("piece", piece.cast("long")).write.partitionBy("piece").parquet(folder)
    last = lines.agg(F.max(piece)).first()[0]
    schema = StructType([*lines.schema.fields, StructField("piece", LongType())])
    each = lines.sparkSession.read.schema(schema).parquet(folder)
    return [each.where(F.col("piece") == k).select(*lines.columns) for k in range((-1 if last is None else last) + 1)]


STREAM_COUNTERS = ["input_tokens", "cache_write_input_tokens", "cache_read_input_tokens", "output_tokens"]


@query(f"""WITH {CALLS}, c AS (SELECT CASE WHEN l_linenumber % 3 = 0 THEN '{FALLBACK_MODEL}' ELSE model END AS model, * EXCLUDE (model) FROM calls),
  d AS (SELECT l_partkey, l_suppkey, arg_min(model, (model = '{FALLBACK_MODEL}', l_orderkey * 8 + l_linenumber)) AS model, {', '.join(f'max({x}) AS {x}' for x in STREAM_COUNTERS)} FROM c GROUP BY ALL)
  SELECT model, count(*) AS calls, {', '.join(f'CAST(sum({x}) AS BIGINT) AS {x}' for x in STREAM_COUNTERS)} FROM d GROUP BY model""")
def call_stream_totals(t: Tables) -> DataFrame:
    """Calls merged over a whole stream whose micro-batches hold their repeats in any order: totals by model from signed changes."""
    rows = calls(t).select(
        F.concat_ws("-", "l_partkey", "l_suppkey").alias("call_key"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("at"), F.when(F.col("l_linenumber") % 3 == 0, FALLBACK_MODEL).otherwise(F.col("model")).alias("model"), "day", "time_ms", *STREAM_COUNTERS)
    folder = f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    rows.repartition(24, F.xxhash64("at")).write.parquet(folder)
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 8).parquet(folder)
    return signed_totals(drained(merged_call_stream(stream, STREAM_COUNTERS), t.spark), ["model"], STREAM_COUNTERS)


# An editor's CSV: a row for each line item.
EDITOR = """i AS (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(l_quantity AS BIGINT) AS qty, CAST(round(l_discount * 100) AS BIGINT) AS wr FROM lineitem),
  r AS (SELECT *, CASE l_linestatus WHEN 'O' THEN 'composer-1' ELSE 'claude-sonnet-4-5' END AS model, CASE WHEN l_returnflag = 'A' OR l_linenumber = 3 THEN 'included' WHEN (l_returnflag = 'R' AND l_linenumber % 2 = 1) OR l_linenumber IN (2, 5) THEN 'not_charged' WHEN l_linenumber = 4 THEN 'unreadable' ELSE 'charged' END AS charge FROM i)"""


@query(f"""WITH {EDITOR} SELECT model, charge, count(*) AS n, CAST(sum(qty) AS BIGINT) AS input_tokens, CAST(sum(wr) AS BIGINT) AS cache_write_input_tokens, CAST(sum(l_linenumber) AS BIGINT) AS output_tokens, count(DISTINCT strftime(l_shipdate, '%Y-%m-%d')) AS days,
  CAST(sum(CASE WHEN charge = 'not_charged' THEN 0 WHEN charge = 'unreadable' OR l_linenumber IN (2, 3, 4, 5) THEN NULL ELSE cents END) AS BIGINT) AS cents, count(*) FILTER (WHERE charge <> 'not_charged' AND (charge = 'unreadable' OR l_linenumber IN (2, 3, 4, 5))) AS missing FROM r GROUP BY ALL""")
def editor_csv_rows(t: Tables) -> DataFrame:
    """Included rows keep an amount that they have; unread ones are missing, not zero."""
    line, flag = F.col("l_linenumber"), F.col("l_returnflag")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    price = F.concat(F.expr("cents div 100").cast("string"), F.lit("."), F.lpad((F.col("cents") % 100).cast("string"), 2, "0"))
    kind = F.when(flag == "A", "Included in plan").when((flag == "R") & (line % 2 == 1), "Errored, No Charge").otherwise("On-Demand")
    cell = F.when(line == 2, "-").when(line == 3, "Included").when(line == 4, F.concat(F.lit("about "), price)).when(line == 5, "Free").when(line == 6, price).otherwise(F.concat(F.lit("$"), price))
    quantity, write = F.col("l_quantity").cast("long"), F.round(F.col("l_discount") * 100).cast("long")
    rows = t.lineitem.withColumn("cents", cents).select(
        F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("﻿Date"), F.lit("private, person").alias("User"), kind.alias("Kind"), F.when(F.col("l_linestatus") == "O", "composer-1").otherwise("claude-sonnet-4-5").alias("Model"), F.lit("No").alias("Max Mode"),
        F.format_number(quantity + write, 0).alias("Input (w/ Cache Write)"), quantity.alias("Input (w/o Cache Write)"), F.lit(0).alias("Cache Read"), line.alias("Output Tokens"), (quantity + write + line).alias("Total Tokens"), cell.alias("Cost"),
    )
    out = editor_usage(read_csv(t.spark, csv_file(rows)))
    total = lambda c: F.sum(c).alias(c)
    return out.groupBy("model", "charge").agg(
        F.count(F.lit(1)).alias("n"), total("input_tokens"), total("cache_write_input_tokens"), total("output_tokens"), F.count_distinct("day").alias("days"), F.sum(F.round(F.col("cost") * 100).cast("long")).alias("cents"), F.count_if(F.col("cost").isNull()).alias("missing"))


CONSOLE = """r AS (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_custkey END AS given, CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_orderkey % 100 END AS made FROM orders)"""


@query(f"""WITH {CONSOLE} SELECT o_orderpriority || ', ' || o_orderstatus AS model, count(*) AS n, CAST(sum(given) AS BIGINT) AS input_tokens, CAST(sum(made) AS BIGINT) AS output_tokens, CAST(sum(CASE WHEN o_orderkey % 4 < 2 THEN cents END) AS BIGINT) AS cents,
  count(*) FILTER (WHERE o_orderkey % 4 >= 2) AS missing FROM r WHERE given + made > 0 OR o_orderkey % 4 < 2 GROUP BY 1""")
def console_csv_rows(t: Tables) -> DataFrame:
    """Negative amounts are missing, rows without anything are left out; a label may hold a comma."""
    order = F.col("o_orderkey") % 4
    price = F.concat(F.expr("cents div 100").cast("string"), F.lit("."), F.lpad((F.col("cents") % 100).cast("string"), 2, "0"))
    idle = F.col("o_custkey") % 3 == 0
    rows = t.orders.withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long")).select(
        F.concat_ws(", ", "o_orderpriority", "o_orderstatus").alias("model"), F.when(idle, 0).otherwise(F.col("o_custkey")).alias("input_tokens"), F.when(idle, 0).otherwise(F.col("o_orderkey") % 100).alias("output_tokens"),
        F.when(order == 0, F.concat(F.lit("$"), price)).when(order == 1, price).when(order == 2, F.concat(F.lit("-"), price)).otherwise("").alias("cost_usd"))
    out = console_usage(read_csv(t.spark, csv_file(rows)))
    return out.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum(F.round(F.col("cost") * 100).cast("long")).alias("cents"), F.count_if(F.col("cost").isNull()).alias("missing"))


BILLING = """r AS (SELECT strftime(o_orderdate, '%Y-%m-01') AS day, ['Copilot AI Credits', 'Copilot Premium Request', 'Copilot Odd Thing'][o_orderkey % 3 + 1] AS sku, [CAST('credits' AS VARCHAR), 'requests', NULL][o_orderkey % 3 + 1] AS unit,
  CASE WHEN o_orderkey % 5 = 0 THEN o_custkey % 100 ELSE o_custkey % 100 / 2 END AS quantity, CASE WHEN o_orderkey % 7 > 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) END AS cents FROM orders)"""


@query(f"WITH {BILLING} SELECT day, sku, unit, unit IS NOT NULL AS counted, count(*) AS n, CAST(sum(quantity) AS DOUBLE) AS quantity, CAST(sum(cents) AS BIGINT) AS cents FROM r GROUP BY ALL")
def saved_billing_items(t: Tables) -> DataFrame:
    """The billing service's JSON, a document a month: net quantities before gross ones, unknown SKUs not counted, negative amounts missing."""
    order, cents = F.col("o_orderkey"), F.round(F.col("o_totalprice") * 100)
    sku = F.when(order % 3 == 0, "Copilot AI Credits").when(order % 3 == 1, "Copilot Premium Request").otherwise("Copilot Odd Thing")
    gross = (F.col("o_custkey") % 100).cast("double")
    item = F.struct(sku.alias("sku"), F.col("o_orderpriority").alias("model"), gross.alias("grossQuantity"), F.when(order % 5 != 0, gross / 2).alias("netQuantity"), (cents / 100 * F.when(order % 7 == 0, -1).otherwise(1)).alias("netAmount"))
    month = F.date_format("o_orderdate", "yyyy-MM")
    period = F.struct(F.year(F.min("o_orderdate")).alias("year"), F.month(F.min("o_orderdate")).alias("month"), F.lit(1).alias("day"))
    documents = t.orders.groupBy(month.alias("part")).agg(F.to_json(F.struct(period.alias("timePeriod"), F.lit("private").alias("user"), F.collect_list(item).alias("usageItems"))).alias("value"))
    out = billing_items(t.spark, text_files(documents, [], "json") + "/*")
    return out.groupBy("day", "sku", "unit", "counted").agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"), F.sum(F.round(F.col("cost") * 100).cast("long")).alias("cents"))


@query("""WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
  SELECT conv_id, role, CAST(count(*) AS BIGINT) AS messages, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS tokens FROM m WHERE place <> 3 AND role IN ('user', 'assistant') GROUP BY ALL""")
def tree_export_branch(t: Tables) -> DataFrame:
    """The visible branch of the fuller of two snapshots: third turns are left behind on another branch, other roles than people's and answers aren't counted."""
    of = W.partitionBy("conv_id").orderBy("turn")
    rows = t.conversations.withColumns({"place": F.row_number().over(of), "n": F.count(F.lit(1)).over(W.partitionBy("conv_id"))})
    name = lambda place: F.concat_ws("-", "conv_id", place)
    place = F.col("place")
    parent = F.when(place > 1, name(F.when(place == 4, 2).otherwise(place - 1)))
    message = F.struct(F.struct("role").alias("author"), F.struct(F.lit("text").alias("content_type"), F.array("text").alias("parts")).alias("content"))
    node = F.struct(name(place).alias("id"), parent.alias("parent"), message.alias("message"))
    last = lambda most: F.when(most == 3, 2).otherwise(most)

    def snapshot(part: DataFrame, extra: int) -> DataFrame:
        each = part.groupBy("conv_id").agg(F.max("place").alias("most"), F.map_from_entries(F.collect_list(F.struct(name(place).alias("key"), node.alias("value")))).alias("mapping"))
        whole = F.struct(F.col("conv_id").cast("string").alias("id"), name(last(F.col("most"))).alias("current_node"), "mapping")
        return each.select((F.col("conv_id") % 5 + extra).alias("part"), F.col("conv_id").alias("id"), F.to_json(whole).alias("json"))

    both = snapshot(rows, 0).unionByName(snapshot(rows.where(place <= 2), 10))
    nodes, current = tree_conversations(t.spark, text_files(array_lines(both), ["at"], "json"))
    branch = visible_branch(nodes, current).where(F.col("role").isin("user", "assistant"))
    return branch.groupBy(F.col("conv_id").cast("long").alias("conv_id"), "role").agg(F.count(F.lit(1)).alias("messages"), F.sum(token_estimate(F.col("text"))).alias("tokens"))


@query("""WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations WHERE text <> '')
  SELECT conv_id, CAST(count(*) FILTER (WHERE place <> 4 AND role = 'user') AS BIGINT) AS asked, CAST(count(*) FILTER (WHERE place <> 4 AND role = 'assistant') AS BIGINT) AS answered, CAST(count(*) FILTER (WHERE place = 4 OR role NOT IN ('user', 'assistant')) AS BIGINT) AS ignored,
    CAST(sum(CASE WHEN place <> 4 AND role IN ('user', 'assistant') THEN length(text) ELSE 0 END) AS BIGINT) AS characters FROM m GROUP BY conv_id""")
def flat_export_turns(t: Tables) -> DataFrame:
    """Messages of a flat export; texts stand in one of two places, senders that aren't known are ignored and counted."""
    of = W.partitionBy("conv_id").orderBy("turn")
    rows = t.conversations.where("text <> ''").withColumn("place", F.row_number().over(of))
    sender = F.when(F.col("place") == 4, "robot").when(F.col("role") == "user", "human").otherwise(F.col("role"))
    second = F.col("place") % 2 == 0
    message = F.struct(sender.alias("sender"), F.when(second, "").otherwise(F.col("text")).alias("text"), F.struct(F.when(second, F.col("text")).alias("text")).alias("content"))
    each = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", message.alias("m")))), lambda x: x["m"]).alias("chat_messages"))
    json = F.to_json(F.struct(F.col("conv_id").cast("string").alias("uuid"), "chat_messages"))
    lines = array_lines(each.select((F.col("conv_id") % 3).alias("part"), F.col("conv_id").alias("id"), json.alias("json")))
    found = flat_conversations(t.spark, text_files(lines, ["at"], "json"))
    role = F.col("role")
    return found.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.count_if(role == "user").alias("asked"), F.count_if(role == "assistant").alias("answered"), F.count_if(role.isNull()).alias("ignored"), F.sum(F.when(role.isNotNull(), F.length("text")).otherwise(0)).alias("characters"))


NAMES = ("'x/rollout-' || doc_id || '.jsonl'", "'Log-' || doc_id || '.JSONL'", "'a/conversations-' || doc_id || '.json'", "'rollout-' || doc_id || '.json'", "'b/' || doc_id || '.CSV'", "'note ' || doc_id || '.md'", "doc_id || '.jsonl.gz'")
KINDS = ("rollout", "session_log", "conversations", "json", "csv", "note", "other")


@query(f"SELECT list_extract([{', '.join(repr(k) for k in KINDS)}], CAST(doc_id % 7 AS INT) + 1) AS kind, lang, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY ALL")
def manifest_kinds(t: Tables) -> DataFrame:
    """What files are, by their names alone, and how many bytes of each kind there are; contents are never read."""
    path = F.expr(f"CASE doc_id % 7 {' '.join(f'WHEN {i} THEN {name}' for i, name in enumerate(NAMES))} END")
    rows = t.documents.select(path.alias("path"), F.col("n_chars").alias("length"), "lang")
    return classify_files(rows).groupBy("kind", "lang").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


@query("SELECT 'session_log' AS kind, strftime(ts, '%Y-%m-%d') AS day, CAST(sum(strlen(props) + 1) AS BIGINT) AS bytes FROM events GROUP BY ALL")
def manifest_of_a_folder(t: Tables) -> DataFrame:
    """The manifest of a folder as it lies in the file system: kinds and lengths of its files."""
    folder = text_files(t.events.select(F.date_format("ts", "yyyy-MM-dd").alias("part"), F.col("event_id").alias("at"), F.col("props").alias("value")), ["at"], "jsonl")
    return classify_files(file_manifest(t.spark, folder)).select("kind", F.regexp_extract("path", r"part=([0-9-]+)", 1).alias("day"), F.col("length").alias("bytes"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN CAST(floor(o_totalprice) AS DOUBLE) END AS cost, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey::DOUBLE END AS tokens, CASE WHEN o_orderkey % 4 > 0 THEN (o_orderkey % 90)::DOUBLE END AS turns, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS source FROM orders""")
def free_text_numbers(t: Tables) -> DataFrame:
    """Cost, tokens, turns and source that a report names in its text."""
    key = F.col("o_orderkey")
    text = F.concat_ws(
        "\n", F.lit("# Report"), F.when(key % 5 > 0, F.concat(F.lit("Total_cost_usd: ~$"), F.floor("o_totalprice").cast("string"))), F.when(key % 3 > 0, F.concat(F.lit("total_tokens:  "), F.col("o_custkey").cast("string"))),
        F.when(key % 4 > 0, F.concat(F.lit("TURNS: "), (key % 90).cast("string"), F.lit(" in all"))), F.when(key % 2 == 0, F.concat(F.lit("source: "), "o_orderpriority")), F.lit("cost: unknown, tokens: some"))
    return t.orders.select("o_orderkey", text.alias("text")).select("o_orderkey", *report_numbers(F.col("text")))

