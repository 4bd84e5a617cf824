"""Usage roll-ups, call identities and counter series over the test tables.

Line items stand for calls (model: return flag and line status, counters from
quantity, discount and tax), events for session records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.columns import ELAPSED_MINUTES, RECORD_BUCKETS, TOKEN_BUCKETS, WORKFLOW_SHAPES, bucket_of, in_bucket, month_of, total_tokens
from tallyloom.operators.components import alias_calls, shared_identities
from tallyloom.operators.ranks import numbered
from tallyloom.operators.usage import counter_deltas, dedup_calls, forward_fill, session_rollup, session_starts, usage_by
from tallyloom.plans.registry import Tables, query
from tallyloom.plans.shared import shared_folder

CALLS = """calls AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag || '-' || l_linestatus AS model,
  CAST(l_quantity AS BIGINT) AS input_tokens, CAST(round(l_discount * 100) AS BIGINT) AS cache_write_input_tokens, CAST(round(l_tax * 100) AS BIGINT) AS cache_read_input_tokens,
  CAST(l_linenumber AS BIGINT) AS output_tokens, CAST(l_linenumber // 2 AS BIGINT) AS reasoning_output_tokens, CAST(1 AS BIGINT) AS usage_records,
  strftime(l_shipdate, '%Y-%m-%d') AS day, epoch_us(l_shipdate) // 1000 AS time_ms FROM lineitem)"""
SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("input_tokens", "cache_write_input_tokens", "cache_read_input_tokens", "output_tokens", "reasoning_output_tokens", "usage_records"))
TOTAL = "CAST(sum(input_tokens + cache_write_input_tokens + cache_read_input_tokens + output_tokens) AS BIGINT) AS total_tokens"
MAXES = "max(input_tokens) AS input_tokens, max(output_tokens) AS output_tokens, min(day) AS day, min(time_ms) AS time_ms, min(model) AS model, count(*) AS copies"


def calls(t: Tables) -> DataFrame:
    integer = lambda c: F.round(F.col(c) * 100).cast("long")
    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.concat("l_returnflag", F.lit("-"), "l_linestatus").alias("model"),
        F.col("l_quantity").cast("long").alias("input_tokens"), integer("l_discount").alias("cache_write_input_tokens"), integer("l_tax").alias("cache_read_input_tokens"),
        F.col("l_linenumber").cast("long").alias("output_tokens"), F.expr("l_linenumber div 2").cast("long").alias("reasoning_output_tokens"), F.lit(1).cast("long").alias("usage_records"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("time_ms"),
    )


@query(f"WITH {CALLS} SELECT model, {SUMS}, {TOTAL} FROM calls GROUP BY model")
def usage_by_model(t: Tables) -> DataFrame:
    return usage_by(calls(t), "model")


@query(f"WITH {CALLS} SELECT {SUMS}, {TOTAL} FROM calls")
def usage_totals(t: Tables) -> DataFrame:
    return usage_by(calls(t))


@query(f"WITH {CALLS} SELECT l_partkey, l_suppkey, {MAXES} FROM calls GROUP BY ALL")
def call_dedup_max_merge(t: Tables) -> DataFrame:
    return dedup_calls(calls(t), ["l_partkey", "l_suppkey"], ["input_tokens", "output_tokens"], ["model"])


@query(f"WITH {CALLS} SELECT l_orderkey, l_partkey, l_suppkey, {MAXES} FROM calls GROUP BY ALL")
def call_dedup_session_scoped(t: Tables) -> DataFrame:
    return dedup_calls(calls(t), ["l_orderkey", "l_partkey", "l_suppkey"], ["input_tokens", "output_tokens"], ["model"])


@query("SELECT count(*) AS records, count(DISTINCT (l_partkey, l_suppkey)) AS calls, count(*) - count(DISTINCT (l_partkey, l_suppkey)) AS duplicates FROM lineitem")
def duplicate_count(t: Tables) -> DataFrame:
    each = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return each.agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("calls"), (F.sum("n") - F.count(F.lit(1))).alias("duplicates"))


@query("""WITH RECURSIVE ids AS (SELECT s_suppkey AS row, 'm' || (s_suppkey // 3) AS identity FROM supplier UNION SELECT s_suppkey, 'r' || (s_suppkey * 7 % 60 + 60 * (s_suppkey // 50)) FROM supplier),
  edges AS (SELECT DISTINCT a.row AS a, b.row AS b FROM ids a JOIN ids b USING (identity)),
  reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
  SELECT a AS row, min(b) AS component FROM reach GROUP BY a""")
def call_alias_components(t: Tables) -> DataFrame:
    """Suppliers that share a message or a request identity, directly or through others."""
    message = F.expr("concat('m', cast(s_suppkey div 3 as string))")
    request = F.expr("concat('r', cast(s_suppkey * 7 % 60 + 60 * (s_suppkey div 50) as string))")
    ids = t.supplier.select(F.col("s_suppkey").alias("row"), F.explode(F.array(message, request)).alias("identity"))
    return shared_identities(ids, "row", "identity", shared_folder(t.spark))


ALIASES = """l AS (SELECT l_orderkey * 8 + l_linenumber AS pos, l_orderkey AS o, l_linenumber AS n, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
  records AS (SELECT pos, CASE WHEN pos % 7 > 0 THEN 'm:' || o END AS m, CASE WHEN pos % 5 = 0 THEN NULL WHEN pos % 97 < 3 THEN 'r:' || (o - 1) * 10 ELSE 'r:' || (o * 10 + n % 2) END AS r, CASE WHEN pos % 89 = 0 THEN 'other' ELSE 'model-' || o % 3 END AS model,
    CASE WHEN pos % 101 = 0 THEN 0 ELSE q END AS input_tokens, CASE WHEN pos % 101 = 0 THEN 0 ELSE n END AS output_tokens FROM l),
  live AS (SELECT * FROM records WHERE input_tokens + output_tokens > 0), ids AS (SELECT pos, m AS id FROM live WHERE m IS NOT NULL UNION ALL SELECT pos, r FROM live WHERE r IS NOT NULL), firsts AS (SELECT id, min(pos) AS first FROM ids GROUP BY id),
  f AS (SELECT live.*, a.first AS m_first, b.first AS r_first FROM live LEFT JOIN firsts a ON a.id = m LEFT JOIN firsts b ON b.id = r WHERE m IS NOT NULL OR r IS NOT NULL),
  links AS (SELECT DISTINCT m AS x, r AS y FROM f WHERE m IS NOT NULL AND r IS NOT NULL AND (m_first = pos OR r_first = pos)), edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
  reach(id, other) AS (SELECT id, id FROM firsts UNION SELECT reach.id, edges.y FROM reach JOIN edges ON edges.x = reach.other), named AS (SELECT reach.id, min(first) AS call FROM reach JOIN firsts ON firsts.id = reach.other GROUP BY reach.id),
  g AS (SELECT f.*, coalesce(a.call, b.call) AS call, coalesce(a.call <> b.call, false) AS bridge FROM f LEFT JOIN named a ON a.id = m LEFT JOIN named b ON b.id = r),
  merged AS (SELECT call, arg_min(model, pos) AS model, max(input_tokens) AS input_tokens, CAST(max(output_tokens) AS BIGINT) AS output_tokens, count(*) AS copies FROM g WHERE NOT bridge GROUP BY call)"""


def alias_records(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Line items as records of an order's call: ids left out, two requests of one message, an id of the order before, other models, no usage."""
    o, n, at = F.col("l_orderkey"), F.col("l_linenumber"), F.col("at")
    request = F.when(at % 5 == 0, None).when(at % 97 < 3, ((o - 1) * 10).cast("string")).otherwise((o * 10 + n % 2).cast("string"))
    counter = lambda c: F.when(at % 101 == 0, 0).otherwise(c).cast("long")
    rows = t.lineitem.withColumn("at", o * 8 + n).select(
        "at", F.when(at % 7 > 0, o.cast("string")).alias("message_id"), request.alias("request_id"), F.when(at % 89 == 0, "other").otherwise(F.concat(F.lit("model-"), (o % 3).cast("string"))).alias("model"),
        counter(F.col("l_quantity")).alias("input_tokens"), counter(n).alias("output_tokens"))
    return alias_calls(rows, ["input_tokens", "output_tokens"], shared_folder(t.spark))


@query(f"WITH RECURSIVE {ALIASES} SELECT * FROM merged")
def alias_merged_calls(t: Tables) -> DataFrame:
    """Calls that later records name by either id, with the largest of each counter."""
    return alias_records(t)[0]


@query(f"""WITH RECURSIVE {ALIASES} SELECT pos AS "at", 'no_identity' AS code FROM live WHERE m IS NULL AND r IS NULL UNION ALL SELECT pos, 'bridge' FROM g WHERE bridge
  UNION ALL SELECT g.pos, 'model_conflict' FROM g JOIN merged USING (call) WHERE NOT bridge AND g.model IS DISTINCT FROM merged.model""")
def alias_violations(t: Tables) -> DataFrame:
    """Records that would join two calls, change a call's model, or belong to none."""
    return alias_records(t)[1]


def session_records(t: Tables) -> DataFrame:
    return t.events.select(F.col("user_id").alias("session_key"), (F.col("value") * 10).cast("long").alias("tokens"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.unix_millis(F.col("ts").cast("timestamp")).alias("time_ms"))


SESSIONS = """sessions AS (SELECT user_id AS session_key, CAST(sum(CAST(trunc(value * 10) AS BIGINT)) AS BIGINT) AS tokens, count(*) AS records, min(strftime(ts, '%Y-%m-%d')) AS first_day,
  min(epoch_us(ts) // 1000) AS first_ms, max(epoch_us(ts) // 1000) AS last_ms FROM events GROUP BY user_id)"""


@query(f"WITH {SESSIONS} SELECT *, true AS days_known, true AS times_known FROM sessions")
def session_rollups(t: Tables) -> DataFrame:
    return session_rollup(session_records(t))


@query(f"""WITH {SESSIONS}, m AS (SELECT records, tokens, (last_ms - first_ms) / 60000.0::DOUBLE AS minutes FROM sessions)
  SELECT 'records' AS histogram, CASE WHEN records = 1 THEN 'one' WHEN records <= 4 THEN 'two_to_four' WHEN records <= 19 THEN 'five_to_nineteen' ELSE 'twenty_plus' END AS bucket, count(*) AS sessions FROM m GROUP BY ALL
  UNION ALL SELECT 'tokens', CASE WHEN tokens < 10000 THEN 'under_10k' WHEN tokens < 50000 THEN 'ten_to_49k' WHEN tokens < 200000 THEN 'fifty_to_199k' WHEN tokens < 1000000 THEN 'two_hundred_to_999k' ELSE 'one_million_plus' END, count(*) FROM m GROUP BY ALL
  UNION ALL SELECT 'elapsed', CASE WHEN minutes < 10 THEN 'under_10m' WHEN minutes < 60 THEN 'ten_to_59m' WHEN minutes < 240 THEN 'one_to_3h' WHEN minutes < 720 THEN 'four_to_11h' ELSE 'twelve_h_plus' END, count(*) FROM m GROUP BY ALL""")
def session_histograms(t: Tables) -> DataFrame:
    """The three histograms of sessions in one pass over the roll-up."""
    minutes = (F.col("last_ms") - F.col("first_ms")) / 60000
    rows = session_rollup(session_records(t)).select(F.explode(F.array(
        F.struct(F.lit("records").alias("histogram"), bucket_of(F.col("records"), RECORD_BUCKETS).alias("bucket")),
        F.struct(F.lit("tokens").alias("histogram"), bucket_of(F.col("tokens"), TOKEN_BUCKETS).alias("bucket")),
        F.struct(F.lit("elapsed").alias("histogram"), bucket_of(minutes, ELAPSED_MINUTES, half_open=True, missing="unknown").alias("bucket")),
    )).alias("x")).select("x.*")
    return rows.groupBy("histogram", "bucket").agg(F.count(F.lit(1)).alias("sessions"))


@query(f"""WITH {SESSIONS} SELECT count(*) FILTER (WHERE records = 1) AS single_exchange, count(*) FILTER (WHERE records BETWEEN 2 AND 4) AS short_multi_exchange,
  count(*) FILTER (WHERE records BETWEEN 5 AND 19) AS sustained, count(*) FILTER (WHERE records >= 20) AS high_iteration FROM sessions""")
def workflow_shape(t: Tables) -> DataFrame:
    """Zero-filled counts of one-shot to long sessions."""
    sessions = session_rollup(session_records(t))
    return sessions.agg(*(F.count_if(in_bucket(F.col("records"), low, high)).alias(name) for name, low, high in WORKFLOW_SHAPES))


@query(f"WITH {CALLS} SELECT coalesce(substr(day, 1, 7), 'undated') AS period, {SUMS}, count(DISTINCT day) AS active_days, {TOTAL} FROM calls GROUP BY ALL")
def monthly_timeline(t: Tables) -> DataFrame:
    """By day first: the second exchange then carries a row a day, not a row a call."""
    days = usage_by(calls(t), "day").drop("total_tokens")
    months = days.groupBy(month_of(F.col("day")).alias("period"))
    counters = [c for c in days.columns if c != "day"]
    return months.agg(*(F.sum(c).alias(c) for c in counters), F.count("day").alias("active_days")).withColumn("total_tokens", total_tokens())


@query("SELECT strftime(ts, '%Y-%m-%d %H') AS hour, strftime(ts, '%Y-%m-%d') AS day, count(*) AS records, CAST(sum(CAST(trunc(value * 10) AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY ALL")
def hour_day_buckets(t: Tables) -> DataFrame:
    hours = t.events.groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("hour"))
    return hours.agg(F.count(F.lit(1)).alias("records"), F.sum((F.col("value") * 10).cast("long")).alias("tokens")).withColumn("day", F.substring("hour", 1, 10))


@query(f"WITH {SESSIONS} SELECT substr(first_day, 1, 7) AS period, count(*) AS session_starts FROM sessions GROUP BY ALL")
def session_starts_by_month(t: Tables) -> DataFrame:
    return session_starts(session_rollup(session_records(t)))


SERIES = "series AS (SELECT user_id, event_id, ts, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS total FROM events)"
DELTAS = f"""{SERIES}, d AS (SELECT *, lag(total) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM series)"""


def series(t: Tables) -> DataFrame:
    return t.events.select("user_id", "event_id", "ts", "event_type", F.get_json_object("props", "$.k").try_cast("long").alias("total"))


@query(f"""WITH {DELTAS} SELECT user_id, count(*) AS snapshots, CAST(count(*) FILTER (WHERE total < previous) AS BIGINT) AS resets, CAST(count(*) FILTER (WHERE total = previous) AS BIGINT) AS repeats,
  CAST(sum(CASE WHEN previous IS NULL OR total < previous THEN total ELSE total - previous END) AS BIGINT) AS used FROM d GROUP BY user_id""")
def counter_delta_with_resets(t: Tables) -> DataFrame:
    """A reset counts its new total as use, as a record that brings its own last usage does."""
    rows = counter_deltas(series(t), ["user_id"], ["ts", "event_id"], "total", last=F.col("total"))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("snapshots"), F.count_if("reset").alias("resets"), F.count_if("repeated").alias("repeats"), F.sum(F.coalesce("usage", F.lit(0))).alias("used"))


@query(f"WITH {DELTAS} SELECT event_id, total FROM d WHERE previous IS NULL OR total <> previous")
def consecutive_duplicate_suppression(t: Tables) -> DataFrame:
    return counter_deltas(series(t), ["user_id"], ["ts", "event_id"], "total").where("not repeated").select("event_id", "total")


@query(f"""WITH {SERIES} SELECT event_id, coalesce(last_value(CASE WHEN event_type IN ('click', 'purchase') THEN event_type || '-' || total WHEN event_type = 'error' THEN 'Unrecognized AI version' END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 'Unrecognized AI version') AS model FROM series""")
def model_forward_fill(t: Tables) -> DataFrame:
    setter = F.when(F.col("event_type").isin("click", "purchase"), F.concat_ws("-", "event_type", F.col("total").cast("string"))).when(F.col("event_type") == "error", F.lit("Unrecognized AI version"))
    return forward_fill(series(t), ["user_id"], ["ts", "event_id"], setter, "model").select("event_id", "model")


@query("""SELECT sha256(text) AS digest, min(doc_id) AS kept, count(*) AS files, CAST(count(DISTINCT source) AS BIGINT) AS sessions, count(DISTINCT source) > 1 AS conflict FROM documents GROUP BY ALL HAVING count(*) > 1""")
def file_session_trust(t: Tables) -> DataFrame:
    """Files with equal bytes: one counts; the same bytes under several sessions are a conflict."""
    each = t.documents.groupBy(F.sha2("text", 256).alias("digest"), "source").agg(F.min("doc_id").alias("kept"), F.count(F.lit(1)).alias("files"))
    both = each.groupBy("digest").agg(F.min("kept").alias("kept"), F.sum("files").alias("files"), F.count(F.lit(1)).alias("sessions"))
    return both.where("files > 1").withColumn("conflict", F.col("sessions") > 1)


@query("SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def anti_failed_files(t: Tables) -> DataFrame:
    """Records of files that failed anywhere are taken out afterwards."""
    failed = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.select("o_orderkey").distinct().join(failed, "o_orderkey", "left_anti")


@query("SELECT p_partkey, p_brand FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_discount > 0.09)")
def semi_rate_models(t: Tables) -> DataFrame:
    used = t.lineitem.where("l_discount > 0.09").select(F.col("l_partkey").alias("p_partkey"))
    return t.part.select("p_partkey", "p_brand").join(used, "p_partkey", "left_semi")


@query("""WITH f AS (SELECT user_id, min(epoch_us(ts) // 1000) AS first_ms, min_by(event_id, (ts, event_id)) AS first_id FROM events GROUP BY user_id)
  SELECT user_id, 'project_' || lpad(CAST(n AS VARCHAR), CAST(greatest(length(CAST(n AS VARCHAR)), 3) AS INTEGER), '0') AS label FROM (SELECT user_id, row_number() OVER (ORDER BY first_ms, first_id) AS n FROM f)""")
def first_seen_labels(t: Tables) -> DataFrame:
    """Projects are named in the order they are first seen, numbered range by range."""
    first = t.events.groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    first = numbered(first.select("user_id", F.col("first.ts").alias("ts"), F.col("first.event_id").alias("event_id")), ["ts", "event_id"], "n")
    return first.select("user_id", F.concat(F.lit("project_"), F.expr("lpad(cast(n as string), greatest(length(cast(n as string)), 3), '0')")).alias("label"))


@query("""WITH g AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
  s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM g)
  SELECT user_id, epoch_us(min(ts)) // 1000 AS start_ms, count(*) AS records FROM s GROUP BY user_id, n""")
def session_gap_windows(t: Tables) -> DataFrame:
    """Gap-based sessions, beside those by identity."""
    windows = t.events.groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("records"))
    return windows.select("user_id", F.unix_millis("w.start").alias("start_ms"), "records")
