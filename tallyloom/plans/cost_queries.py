"""Prices, amounts and their status over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.columns import strict_money
from tallyloom.operators.pricing import cost_status, derived_rates, equivalent_range, snapshot_delta, with_cost
from tallyloom.plans.registry import Tables, query
from tallyloom.plans.usage_queries import CALLS, calls
from tallyloom.sources.exports import billing_usage, excluded_skus

# Dollars for a million tokens: (model, input, output). N-F has no rate on purpose.
RATES = (("N-O", 3.0, 15.0), ("A-F", 5.0, 25.0), ("R-F", 1.0, 5.0), ("A-O", 0.25, 1.25))
RATE_SQL = "rates AS (SELECT model, i AS input, o AS output, i * 1.25::DOUBLE AS cache_write, i * 0.1::DOUBLE AS cache_read FROM (VALUES " + ", ".join(f"('{m}', {i}::DOUBLE, {o}::DOUBLE)" for m, i, o in RATES) + ") r(model, i, o))"
COST = "(input_tokens * input + output_tokens * output + cache_write_input_tokens * cache_write + cache_read_input_tokens * cache_read) / 1e6::DOUBLE"


def rates(t: Tables) -> DataFrame:
    return derived_rates(t.spark.createDataFrame(RATES, "model string, input double, output double"))


def priced_usage(t: Tables) -> DataFrame:
    usage = calls(t).groupBy("model").agg(*(F.sum(f"{c}_tokens").alias(f"{n}_tokens") for n, c in (("input", "input"), ("output", "output"), ("cache_write", "cache_write_input"), ("cache_read", "cache_read_input"))))
    return with_cost(usage, rates(t))


USAGE = "usage AS (SELECT model, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cache_write_input_tokens) AS BIGINT) AS cache_write_input_tokens, CAST(sum(cache_read_input_tokens) AS BIGINT) AS cache_read_input_tokens FROM calls GROUP BY model)"


@query(f"WITH {CALLS}, {USAGE}, {RATE_SQL} SELECT model, input_tokens, output_tokens, round({COST}, 6) AS cost FROM usage LEFT JOIN rates USING (model)")
def rate_lookup_cost(t: Tables) -> DataFrame:
    return priced_usage(t).select("model", "input_tokens", "output_tokens", F.round("cost", 6).alias("cost"))


@query(f"WITH {CALLS}, {USAGE}, {RATE_SQL} SELECT u.model, round(min({COST}), 6) AS least, round(max({COST}), 6) AS most FROM usage u CROSS JOIN rates r GROUP BY u.model")
def api_equivalent_range(t: Tables) -> DataFrame:
    usage = calls(t).groupBy(F.col("model").alias("used")).agg(*(F.sum(f"{c}_tokens").alias(c) for c in ("input", "output", "cache_write_input", "cache_read_input"))).withColumnsRenamed({"input": "a", "output": "b", "cache_write_input": "c", "cache_read_input": "d"})
    found = equivalent_range({"input": F.col("a"), "output": F.col("b"), "cache_write": F.col("c"), "cache_read": F.col("d")}, rates(t), usage)
    return found.select(F.col("used").alias("model"), F.round("least", 6).alias("least"), F.round("most", 6).alias("most"))


@query(f"""WITH {CALLS}, {USAGE}, {RATE_SQL} SELECT round(sum({COST}), 6) AS cost, CAST(sum(CASE WHEN input IS NOT NULL THEN input_tokens + output_tokens END) AS BIGINT) AS priced_tokens,
  CAST(sum(CASE WHEN input IS NULL THEN input_tokens + output_tokens END) AS BIGINT) AS unpriced_tokens, count(*) FILTER (WHERE input IS NULL) = 0 AS complete FROM usage LEFT JOIN rates USING (model)""")
def partial_price_coverage(t: Tables) -> DataFrame:
    tokens, priced = F.col("input_tokens") + F.col("output_tokens"), F.col("cost").isNotNull()
    return priced_usage(t).agg(F.round(F.sum("cost"), 6).alias("cost"), F.sum(F.when(priced, tokens)).alias("priced_tokens"), F.sum(F.when(~priced, tokens)).alias("unpriced_tokens"), F.bool_and(priced).alias("complete"))


@query("""WITH b AS (SELECT o_orderpriority AS model, count(*) AS n, CAST(sum(CAST(trunc(o_totalprice) AS BIGINT)) AS BIGINT) AS v FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY ALL),
  a AS (SELECT o_orderpriority AS model, count(*) AS n, CAST(sum(CAST(trunc(o_totalprice) AS BIGINT)) AS BIGINT) AS v FROM orders GROUP BY ALL)
  SELECT model, coalesce(a.n, 0) - coalesce(b.n, 0) AS calls, coalesce(a.v, 0) - coalesce(b.v, 0) AS tokens, round((coalesce(a.v, 0) - coalesce(b.v, 0)) * 3 / 1e6::DOUBLE, 6) AS cost FROM b FULL OUTER JOIN a USING (model)""")
def snapshot_delta_priced(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderpriority").alias("model"), F.col("o_totalprice").cast("long").alias("v"), "o_orderdate")
    snapshot = lambda df: df.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.sum("v").alias("tokens"))
    delta = snapshot_delta(snapshot(rows.where("o_orderdate < timestamp_ntz'1998-01-01'")), snapshot(rows), "model", ["calls", "tokens"])
    return delta.withColumn("cost", F.round(F.col("tokens") * 3 / 1e6, 6))


MONEY_TEXT = "CASE CAST(c_custkey % 6 AS INT) WHEN 0 THEN '$' || printf('%.2f', c_acctbal) WHEN 1 THEN printf('%.2f', c_acctbal) || ' USD' WHEN 2 THEN 'US$ ' || printf('%.2f', c_acctbal) WHEN 3 THEN '$1,' || CAST(100 + c_custkey % 900 AS VARCHAR) || '.5' WHEN 4 THEN 'about ' || printf('%.2f', c_acctbal) ELSE '-' END"


@query(rf"""WITH m AS (SELECT c_custkey, {MONEY_TEXT} AS cell FROM customer), d AS (SELECT c_custkey, cell, regexp_extract(trim(cell), '(?i)^(?:(?:US\$|USD|\$) ?)?(-?(?:[0-9]+|[0-9]{{1,3}}(?:,[0-9]{{3}})+)?(?:\.[0-9]+)?)(?: ?(?:USD|\$))?$', 1) AS digits FROM m)
  SELECT c_custkey, cell, round(CASE WHEN regexp_matches(digits, '[0-9]') THEN TRY_CAST(replace(digits, ',', '') AS DOUBLE) END, 2) AS amount FROM d""")
def strict_money_parse(t: Tables) -> DataFrame:
    plain = F.format_string("%.2f", F.col("c_acctbal"))
    kind = F.col("c_custkey") % 6
    cell = F.when(kind == 0, F.concat(F.lit("$"), plain)).when(kind == 1, F.concat(plain, F.lit(" USD"))).when(kind == 2, F.concat(F.lit("US$ "), plain)).when(kind == 3, F.concat(F.lit("$1,"), (100 + F.col("c_custkey") % 900).cast("string"), F.lit(".5"))).when(kind == 4, F.concat(F.lit("about "), plain)).otherwise("-")
    return t.customer.select("c_custkey", cell.alias("cell")).withColumn("amount", F.round(strict_money(F.col("cell")), 2))


STATUS = "count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS known, count(*) FILTER (WHERE event_type IN ('click', 'view')) AS estimated, count(*) FILTER (WHERE value < 5) AS covered"


@query(f"""WITH s AS (SELECT user_id, {STATUS} FROM events GROUP BY user_id) SELECT user_id, CASE WHEN covered = n THEN 'subscription_covered' WHEN known = n THEN 'recorded' WHEN estimated = n THEN 'estimated'
  WHEN known + estimated = n THEN 'mixed' WHEN known + estimated > 0 THEN 'partial' ELSE 'unavailable' END AS status FROM s""")
def cost_status_resolution(t: Tables) -> DataFrame:
    s = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "purchase").alias("known"), F.count_if(F.col("event_type").isin("click", "view")).alias("estimated"), F.count_if(F.col("value") < 5).alias("covered"))
    return s.select("user_id", cost_status(F.col("n"), F.col("known"), F.col("estimated"), F.col("covered")).alias("status"))


@query("SELECT o_custkey, bool_and(o_orderstatus IN ('F', 'O')) AND count(*) FILTER (WHERE o_orderstatus = 'F') > 0 AND sum(o_totalprice) > 0 AS covered, bool_and(o_orderpriority LIKE '%URGENT%') AS models_undisclosed FROM orders GROUP BY o_custkey")
def subscription_covered_flag(t: Tables) -> DataFrame:
    """Every charge known, one included at least, and usage at all."""
    known, included = F.bool_and(F.col("o_orderstatus").isin("F", "O")), F.count_if(F.col("o_orderstatus") == "F") > 0
    return t.orders.groupBy("o_custkey").agg((known & included & (F.sum("o_totalprice") > 0)).alias("covered"), F.bool_and(F.col("o_orderpriority").contains("URGENT")).alias("models_undisclosed"))


def billing_rows(t: Tables) -> list[DataFrame]:
    """Line items, orders and events as billing exports of three generations, all text as in a file."""
    text = lambda c: F.col(c).cast("string")
    sku = F.element_at(F.array(*map(F.lit, ("copilot_premium_request", "copilot_ai_credit", "coding_agent_ai_credit", "copilot_mystery_thing", "<b>odd</b>", "Copilot_AI_Credit ", "seat"))), F.col("l_linenumber"))
    modern = t.lineitem.select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), sku.alias("sku"), text("l_quantity").alias("quantity"), F.when(F.col("l_returnflag") != "N", F.format_string("$%.2f", F.col("l_tax"))).alias("net_amount"), F.concat(F.lit("Model "), "l_linestatus").alias("model"))
    legacy = t.orders.select(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.lit("private").alias("user"), F.when(F.col("o_orderstatus") == "P", "<img>").otherwise(F.col("o_orderstatus")).alias("model"), F.lit("0.25").alias("requests used"))
    daily = t.events.select(F.date_format("ts", "yyyy-MM-dd").alias("date"), F.lit("private").alias("username"), F.col("event_type").alias("model"), text("value").alias("quantity"))
    return [modern, legacy, daily]


@query("""WITH b AS (SELECT 'Model ' || l_linestatus AS model, CASE WHEN l_linenumber = 1 THEN 'requests' WHEN l_linenumber IN (2, 3, 6) THEN 'credits' END AS unit, l_quantity AS quantity, CASE WHEN l_returnflag <> 'N' THEN CAST(printf('%.2f', l_tax) AS DOUBLE) END AS cost FROM lineitem
  UNION ALL SELECT CASE WHEN o_orderstatus = 'P' THEN 'Unrecognized AI version' ELSE o_orderstatus END, 'requests', 0.25::DOUBLE, NULL FROM orders UNION ALL SELECT event_type, 'requests', value, NULL FROM events)
  SELECT model, unit, count(*) AS records, round(sum(quantity), 4) AS quantity, round(sum(cost), 4) AS cost, count(*) FILTER (WHERE cost IS NULL) AS missing_cost_rows FROM b WHERE unit IS NOT NULL GROUP BY ALL""")
def copilot_generations_union(t: Tables) -> DataFrame:
    """Billing exports of three generations under one schema; older ones have no amounts."""
    rows = billing_usage(billing_rows(t)).where("counted")
    return rows.groupBy("model", "unit").agg(F.count(F.lit(1)).alias("records"), F.round(F.sum("quantity"), 4).alias("quantity"), F.round(F.sum("cost"), 4).alias("cost"), F.count_if(F.col("cost").isNull()).alias("missing_cost_rows"))


@query("SELECT CASE l_linenumber WHEN 4 THEN 'copilot_mystery_thing' WHEN 5 THEN 'b odd b' ELSE 'seat' END AS sku, count(*) AS rows FROM lineitem WHERE l_linenumber IN (4, 5, 7) GROUP BY ALL")
def sku_exclusion_counts(t: Tables) -> DataFrame:
    """Rows of unknown SKUs are left out of totals and counted by a name that is safe to show."""
    return excluded_skus(billing_usage(billing_rows(t)))
