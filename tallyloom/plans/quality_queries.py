"""Text features, conversations, reconciliation rules, retention and streams over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.archetypes import archetype
from tallyloom.functions.columns import TOKEN_BUCKETS, bucket_of, fnv1a, month_of, token_estimate, words_of
from tallyloom.operators.conversations import best_snapshots, visible_branch
from tallyloom.operators.ranks import numbered
from tallyloom.operators.rules import closed_keys, histogram_feasible, violations
from tallyloom.operators.usage import session_rollup, session_starts, usage_by
from tallyloom.functions.prompt_features import BUCKETS, prompt_features
from tallyloom.plans.registry import Tables, query
from tallyloom.plans.usage_queries import SESSIONS, calls, session_records
from tallyloom.streaming.usage import hourly_totals


@query()
def archetype_classifier(t: Tables) -> DataFrame:
    """Votes over verbs, keywords and file names: too long for SQL, tested on probes."""
    return t.conversations.select("conv_id", "turn", archetype(F.col("text")).alias("archetype"))


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents)
  SELECT doc_id, len(w) AS words, len(list_distinct(w)) AS distinct_words, len(list_distinct(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS shingles FROM w""")
def shingle_features(t: Tables) -> DataFrame:
    w = t.documents.select("doc_id", words_of(F.col("text")).alias("w"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1))), lambda i: F.concat_ws(" ", F.slice("w", i, 3)))
    n = F.when(F.size("w") >= 3, F.size(F.array_distinct(grams))).otherwise(0)
    return w.select("doc_id", F.size("w").cast("long").alias("words"), F.size(F.array_distinct("w")).cast("long").alias("distinct_words"), n.cast("long").alias("shingles"))


@query("""SELECT event_type, CAST(list_reduce(list_concat([2166136261::BIGINT], list_transform(string_split(event_type, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: ((xor(h, c)::HUGEINT * 16777619) % 4294967296)::BIGINT) AS BIGINT) AS hash, count(*) AS n FROM events GROUP BY event_type""")
def fnv1a_hash(t: Tables) -> DataFrame:
    each = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return each.select("event_type", fnv1a(F.col("event_type")).alias("hash"), "n")


_FNV = "list_reduce(list_concat([2166136261::BIGINT], list_transform(string_split({0}, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: CAST((xor(h, c)::HUGEINT * 16777619) % 4294967296 AS BIGINT))"


@query(rf"""WITH n AS (SELECT conv_id, turn, trim(regexp_replace(lower(nfc_normalize(coalesce(text, ''))), '\s+', ' ', 'g')) AS t FROM conversations), w AS (SELECT *, regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+') AS w FROM n),
  u AS (SELECT x, {_FNV.format('x')} AS h FROM (SELECT DISTINCT unnest(w) AS x FROM w)), b AS (SELECT conv_id, turn, h % 48 AS bucket, sum(CASE WHEN h >= 2147483648 THEN -1 ELSE 1 END) AS v FROM (SELECT conv_id, turn, unnest(w) AS x FROM w) JOIN u USING (x) GROUP BY ALL),
  v AS (SELECT conv_id, turn, sum((bucket + 1) * v) / sqrt(sum(v * v)) AS checksum, sum(abs(v)) / sqrt(sum(v * v)) AS absolute FROM b GROUP BY ALL HAVING sum(v * v) > 0),
  g AS (SELECT conv_id, turn, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, chr(1))] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2]) END) AS g FROM w),
  t3 AS (SELECT conv_id, turn, count(DISTINCT h) AS trigrams, CAST(sum(DISTINCT h) AS BIGINT) AS trigram_sum FROM (SELECT conv_id, turn, {_FNV.format('x')} AS h FROM (SELECT conv_id, turn, unnest(g) AS x FROM g)) GROUP BY ALL)
  SELECT w.conv_id, w.turn, len(w) AS words, length(t) AS chars, round(CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w) ELSE 0 END, 9) AS uniq, round(CASE WHEN length(t) > 0 THEN length(regexp_replace(t, '[^0-9]', '', 'g')) / length(t) ELSE 0 END, 9) AS digits,
    round(coalesce(checksum, 0), 6) AS checksum, round(coalesce(absolute, 0), 6) AS absolute, coalesce(trigrams, 0) AS trigrams, coalesce(trigram_sum, 0) AS trigram_sum FROM w LEFT JOIN v USING (conv_id, turn) LEFT JOIN t3 USING (conv_id, turn)""")
def prompt_feature_vectors(t: Tables) -> DataFrame:
    """Normalised texts, the signed 48-bucket vector (two sums over it) and hashed trigrams."""
    rows = t.conversations.select("conv_id", "turn", prompt_features(F.col("text")).alias("f"))
    buckets = F.slice("f.vector", 1, BUCKETS)
    add = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return rows.select(
        "conv_id", "turn", F.col("f.words").alias("words"), F.col("f.chars").alias("chars"), F.round("f.uniq", 9).alias("uniq"), F.round("f.digits", 9).alias("digits"), F.round(add(F.transform(buckets, lambda x, i: x * (i + 1))), 6).alias("checksum"),
        F.round(add(F.transform(buckets, F.abs)), 6).alias("absolute"), F.size("f.trigrams").cast("long").alias("trigrams"), F.aggregate("f.trigrams", F.lit(0).cast("long"), lambda a, x: a + x).alias("trigram_sum"))


@query("SELECT role, CAST(sum(CAST(ceil(length(text) / 4.0::DOUBLE) AS BIGINT)) AS BIGINT) AS tokens, count(*) AS turns FROM conversations GROUP BY role")
def token_estimate_by_role(t: Tables) -> DataFrame:
    return t.conversations.groupBy("role").agg(F.sum(token_estimate(F.col("text"))).alias("tokens"), F.count(F.lit(1)).alias("turns"))


NODES = "nodes AS (SELECT conv_id, turn AS id, CASE WHEN turn = 0 THEN NULL WHEN turn >= 3 AND turn % 3 = 0 THEN turn - 2 ELSE turn - 1 END AS parent, role FROM (SELECT DISTINCT conv_id, turn, min(role) AS role FROM conversations GROUP BY conv_id, turn))"


@query(f"""WITH RECURSIVE {NODES}, last AS (SELECT conv_id, max(id) AS id FROM nodes GROUP BY conv_id),
  walk AS (SELECT n.conv_id, n.id, n.parent, n.role FROM nodes n JOIN last USING (conv_id, id) UNION ALL SELECT n.conv_id, n.id, n.parent, n.role FROM walk w JOIN nodes n ON n.conv_id = w.conv_id AND n.id = w.parent)
  SELECT conv_id, count(*) AS turns, max(id) AS current_node, string_agg(CAST(id AS VARCHAR), '>' ORDER BY id) AS path FROM walk GROUP BY conv_id""")
def conversation_branch_walk(t: Tables) -> DataFrame:
    """The visible branch of each conversation's tree, from its current node to the root."""
    turn = F.col("id")
    nodes = t.conversations.groupBy("conv_id", F.col("turn").alias("id")).agg(F.min("role").alias("role"))
    nodes = nodes.withColumn("parent", F.when(turn == 0, None).when((turn >= 3) & (turn % 3 == 0), turn - 2).otherwise(turn - 1))
    current = nodes.groupBy("conv_id").agg(F.max("id").alias("current_node"))
    branch = visible_branch(nodes, current)
    path = F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ">")
    return branch.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.max("id").alias("current_node"), path.alias("path"))


@query("""WITH s AS (SELECT conv_id // 2 AS id, conv_id AS file, count(*) AS messages FROM conversations GROUP BY ALL)
  SELECT id, file, messages FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY messages DESC, file) AS r FROM s) WHERE r = 1""")
def conversation_best_snapshot(t: Tables) -> DataFrame:
    rows = t.conversations.groupBy(F.expr("conv_id div 2").alias("id"), F.col("conv_id").alias("file")).agg(F.count(F.lit(1)).alias("messages"))
    return best_snapshots(rows, "id", "messages", "file")


@query("""WITH m AS (SELECT l_returnflag || '-' || l_linestatus AS model, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n, count(*) AS records FROM lineitem GROUP BY ALL)
  SELECT CAST(sum(n) AS BIGINT) AS of_models, CAST(sum(records) AS BIGINT) AS records, (SELECT CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) FROM lineitem) AS total, sum(n) = (SELECT sum(CAST(l_quantity AS BIGINT)) FROM lineitem) AS agrees FROM m""")
def reconcile_by_model(t: Tables) -> DataFrame:
    """The sum over models against a total that was taken on its own."""
    usage = usage_by(calls(t), "model").agg(F.sum("input_tokens").alias("of_models"), F.sum("usage_records").alias("records"))
    total = t.lineitem.agg(F.sum(F.col("l_quantity").cast("long")).alias("total"))
    return usage.crossJoin(total).withColumn("agrees", F.col("of_models") == F.col("total"))  # one row each


@query(f"""WITH {SESSIONS} SELECT (SELECT count(*) FROM sessions) AS sessions, (SELECT count(*) FROM sessions WHERE first_day IS NOT NULL) AS starts, CAST((SELECT sum(tokens) FROM sessions) AS BIGINT) AS tokens,
  CAST((SELECT sum(CAST(trunc(value * 10) AS BIGINT)) FROM events) AS BIGINT) AS monthly_tokens, (SELECT sum(tokens) FROM sessions) = (SELECT sum(CAST(trunc(value * 10) AS BIGINT)) FROM events)
  AND (SELECT count(*) FROM sessions) = (SELECT count(*) FROM sessions WHERE first_day IS NOT NULL) AS agrees""")
def reconcile_timeline(t: Tables) -> DataFrame:
    sessions = session_rollup(session_records(t))
    months = session_records(t).groupBy(month_of(F.col("day")).alias("period")).agg(F.sum("tokens").alias("tokens"))
    one = sessions.agg(F.count(F.lit(1)).alias("sessions"), F.sum("tokens").alias("tokens")).crossJoin(session_starts(sessions).agg(F.sum("session_starts").alias("starts"))).crossJoin(months.agg(F.sum("tokens").alias("monthly_tokens")))  # one row each
    return one.withColumn("agrees", (F.col("tokens") == F.col("monthly_tokens")) & (F.col("starts") == F.col("sessions")))


@query(f"""WITH {SESSIONS}, b AS (SELECT CASE WHEN tokens < 10000 THEN 0 WHEN tokens < 50000 THEN 10000 WHEN tokens < 200000 THEN 50000 WHEN tokens < 1000000 THEN 200000 ELSE 1000000 END AS lo, tokens FROM sessions)
  SELECT count(*) AS sessions, CAST(sum(lo) AS BIGINT) AS least, CAST(sum(tokens) AS BIGINT) AS total, sum(lo) <= sum(tokens) AS feasible FROM b""")
def histogram_range_feasibility(t: Tables) -> DataFrame:
    """A histogram's buckets bound the total that its sessions can have."""
    sessions = session_rollup(session_records(t))
    counts = sessions.groupBy(bucket_of(F.col("tokens"), TOKEN_BUCKETS).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))
    return histogram_feasible(counts, TOKEN_BUCKETS).select("sessions", "least", "total", "feasible")


@query("""WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS period, count(*) AS records, count(DISTINCT strftime(o_orderdate, '%Y-%m-%d')) AS active_days, count(DISTINCT o_custkey) AS session_starts FROM orders GROUP BY ALL)
  SELECT period, 'records_within_starts' AS code FROM m WHERE NOT records <= session_starts UNION ALL SELECT period, 'days_within_records' FROM m WHERE NOT active_days <= records UNION ALL SELECT period, 'days_within_month' FROM m WHERE NOT active_days <= 31""")
def cardinality_checks(t: Tables) -> DataFrame:
    """Violated bounds by month; the first rule is meant to be broken here."""
    m = t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("period")).agg(F.count(F.lit(1)).alias("records"), F.count_distinct(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("active_days"), F.count_distinct("o_custkey").alias("session_starts"))
    rules = {"records_within_starts": F.col("records") <= F.col("session_starts"), "days_within_records": F.col("active_days") <= F.col("records"), "days_within_month": F.col("active_days") <= 31}
    return violations(m, ["period"], rules)


@query("SELECT event_type, count(*) FILTER (WHERE json_keys(props) = ['k']) AS closed, count(*) AS n FROM events GROUP BY event_type")
def schema_closed_check(t: Tables) -> DataFrame:
    """Objects with exactly the keys of their schema."""
    return t.events.groupBy("event_type").agg(F.count_if(closed_keys(F.col("props"), ["k"])).alias("closed"), F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT o_custkey, list(o_orderpriority) AS p FROM orders GROUP BY o_custkey)
  SELECT o_custkey, len(p) = len(list_distinct(p)) AS no_repeats, len(list_filter(p, lambda x: NOT list_contains(['1-URGENT', '2-HIGH', '3-MEDIUM'], x))) = 0 AS allowed FROM a""")
def enum_array_check(t: Tables) -> DataFrame:
    a = t.orders.groupBy("o_custkey").agg(F.collect_list("o_orderpriority").alias("p"))
    return a.select("o_custkey", (F.size("p") == F.size(F.array_distinct("p"))).alias("no_repeats"), F.forall("p", lambda x: x.isin("1-URGENT", "2-HIGH", "3-MEDIUM")).alias("allowed"))


@query("SELECT o_orderkey, strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') AS deletion_due_date FROM orders")
def retention_due_dates(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.date_format(F.date_add(F.to_date("o_orderdate"), 30), "yyyy-MM-dd").alias("deletion_due_date"))


@query("""WITH e AS (SELECT user_id, event_id, ts, event_type FROM events), d AS (SELECT user_id, min((ts, event_id)) FILTER (WHERE event_type = 'purchase') AS done, min((ts, event_id)) FILTER (WHERE event_type = 'click') AS asked, count(*) AS n FROM e GROUP BY user_id)
  SELECT user_id, n, CASE WHEN done IS NOT NULL THEN 'completed' WHEN asked IS NOT NULL THEN 'requested' ELSE 'pending' END AS state, CASE WHEN done IS NOT NULL AND (asked IS NULL OR asked > done) THEN false ELSE asked IS NOT NULL END AS asked_first FROM d""")
def retention_state_fold(t: Tables) -> DataFrame:
    """The lifecycle's state from its events: completion ends it, whatever follows."""
    at = lambda kind: F.min(F.when(F.col("event_type") == kind, F.struct("ts", "event_id")))
    d = t.events.groupBy("user_id").agg(at("purchase").alias("done"), at("click").alias("asked"), F.count(F.lit(1)).alias("n"))
    state = F.when(F.col("done").isNotNull(), "completed").when(F.col("asked").isNotNull(), "requested").otherwise("pending")
    first = F.col("asked").isNotNull() & (F.col("done").isNull() | (F.col("asked") <= F.col("done")))
    return d.select("user_id", "n", state.alias("state"), first.alias("asked_first"))


@query("""WITH f AS (SELECT user_id, min((ts, event_id)) AS first FROM events WHERE value > 0 GROUP BY user_id), p AS (SELECT user_id, 'project_' || lpad(CAST(n AS VARCHAR), CAST(greatest(length(CAST(n AS VARCHAR)), 3) AS INTEGER), '0') AS project FROM (SELECT user_id, row_number() OVER (ORDER BY first) AS n FROM f))
  SELECT event_id, project, event_type AS archetype, value AS cost_usd, row_number() OVER (PARTITION BY project ORDER BY ts, event_id) AS position FROM events JOIN p USING (user_id) WHERE value > 0""")
def sanitised_corpus(t: Tables) -> DataFrame:
    """Priced tasks without content: projects by first appearance, positions within them."""
    rows = t.events.where("value > 0")
    first = rows.groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    first = numbered(first.select("user_id", F.col("first.ts").alias("ts"), F.col("first.event_id").alias("event_id")), ["ts", "event_id"], "n")
    names = first.select("user_id", F.concat(F.lit("project_"), F.expr("lpad(cast(n as string), greatest(length(cast(n as string)), 3), '0')")).alias("project"))
    position = F.row_number().over(W.partitionBy("project").orderBy("ts", "event_id"))
    return rows.join(names, "user_id").select("event_id", "project", F.col("event_type").alias("archetype"), F.col("value").alias("cost_usd"), position.alias("position"))


@query("SELECT strftime(ts, '%Y-%m-%d %H') AS hour, event_type, count(*) AS records, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def tumbling_stream(t: Tables) -> DataFrame:
    """Hourly totals by Structured Streaming; the same rows as in batch."""
    return hourly_totals(t.spark, f"{t.folder}/events.parquet", t.events.schema)
