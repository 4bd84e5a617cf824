"""Reports made from line items, some of them spoilt, and the rules that they break."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.reconciliation import MEASUREMENTS, SOURCES, reconcile
from tallyloom.plans.registry import Tables, query
from tallyloom.plans.shared import written

# A supplier's line numbers are reports, parts make their models; which rows have a cost follows from the model.
_SURFACES = ("cursor_ide", "copilot", "codex", "console")
_BASIS = {
    "cursor_ide": ("cursor", "usage_csv_export", "recorded_where_present_then_checked_rates_for_recognized_missing_rows", "recorded_and_or_estimated_where_possible"),
    "copilot": ("github", "billing_usage_export", "recorded_where_present_never_estimated", "recorded_where_present_never_estimated"),
    "codex": ("openai", "local_session_usage_records", "not_available_in_local_codex_history", "not_available_in_local_codex_history"),
    "console": ("anthropic", "console_csv_export", "recorded_in_export", "recorded_in_export"),
}
_SAID = {s: (t, c, r) for s, t, c, r, _ in MEASUREMENTS}


def _case(key: str, of: dict[str, str]) -> str:
    return f"CASE {key} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in of.items())} END"


_COLUMN = {name: {s: _BASIS[s][i] for s in _SURFACES} for i, name in enumerate(("provider", "input_form", "measured", "basis"))} | {
    name: {s: _SAID[s][i] for s in _SURFACES} for i, name in enumerate(("token_basis", "cache_basis", "reasoning_basis"))}
REPORTS = f"""i AS (SELECT l_suppkey * 8 + l_linenumber AS id, CAST(l_partkey % 5 AS BIGINT) AS m, l_orderkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_discount * 100) AS BIGINT) AS w, CAST(round(l_tax * 100) AS BIGINT) AS r FROM lineitem),
  j AS (SELECT *, ['cursor_ide', 'copilot', 'codex', 'console'][id % 4 + 1] AS surface, id % 4 = 0 AND id % 5 = 0 AS covered, m IN (0, 3) OR (m = 2 AND l_orderkey % 2 = 0) AS has FROM i),
  g AS (SELECT id, m, surface, covered, count(*) AS events, count(*) FILTER (WHERE has) AS recorded, CAST(sum(q) AS BIGINT) AS input_tokens, CAST(sum(w) AS BIGINT) AS cache_write_tokens, CAST(sum(r) AS BIGINT) AS cache_read_tokens, CAST(count(*) AS BIGINT) AS output_tokens,
    sum(cents) FILTER (WHERE has) / 100.0::DOUBLE AS usd FROM j GROUP BY ALL),
  h AS (SELECT *, CASE WHEN covered THEN 'subscription_covered' WHEN surface = 'codex' AND NOT (id % 23 = 0 AND m = 0) THEN 'unavailable' WHEN surface = 'cursor_ide' AND m = 1 THEN 'estimated' WHEN recorded = events THEN 'recorded' WHEN recorded = 0 THEN 'unavailable' ELSE 'partial' END AS status,
    round((input_tokens * 3.0::DOUBLE + output_tokens * 15.0::DOUBLE + cache_write_tokens * 3.75::DOUBLE + cache_read_tokens * 0.3::DOUBLE) / 1e6::DOUBLE, 6) AS estimate FROM g),
  models AS (SELECT *, CASE status WHEN 'subscription_covered' THEN CASE WHEN id % 3 = 0 AND m = 0 THEN 0.5::DOUBLE ELSE 0 END WHEN 'estimated' THEN estimate + CASE WHEN id % 28 = 0 THEN 0.001::DOUBLE ELSE 0 END WHEN 'unavailable' THEN NULL ELSE usd END AS cost FROM h),
  rates AS (SELECT id, CASE WHEN id % 16 = 0 THEN 'm9' ELSE 'm1' END AS model, id % 16 <> 0 AS fits FROM models WHERE surface = 'cursor_ide' AND NOT covered AND m = 1),
  a AS (SELECT id, any_value(surface) AS surface, any_value(covered) AS covered, CAST(sum(events) AS BIGINT) AS usage_events, CAST(sum(recorded) AS BIGINT) AS recorded, sum(cost) AS usd, count(cost) AS priced, count(*) AS n, min(events) AS few,
    count(*) FILTER (WHERE status = 'unavailable') AS unavailable, count(*) FILTER (WHERE status = 'partial') AS part, count(*) FILTER (WHERE status = 'estimated') AS estimated, count(*) FILTER (WHERE status = 'recorded') AS kept, count(*) FILTER (WHERE status = 'subscription_covered') AS free, count(*) FILTER (WHERE cost <> 0) AS charged,
    CAST(sum(CASE status WHEN 'recorded' THEN events WHEN 'partial' THEN 1 ELSE 0 END) AS BIGINT) AS low_rec, CAST(sum(CASE status WHEN 'recorded' THEN events WHEN 'partial' THEN events - 1 ELSE 0 END) AS BIGINT) AS high_rec,
    CAST(sum(CASE status WHEN 'recorded' THEN 0 WHEN 'partial' THEN 1 ELSE events END) AS BIGINT) AS low_mis, CAST(sum(CASE status WHEN 'recorded' THEN 0 WHEN 'partial' THEN events - 1 ELSE events END) AS BIGINT) AS high_mis FROM models GROUP BY id),
  b AS (SELECT *, CASE WHEN covered THEN 0 ELSE recorded + CASE id % 6 WHEN 0 THEN 1 WHEN 1 THEN usage_events ELSE 0 END END AS recorded_rows, usage_events - CASE WHEN covered THEN 0 ELSE recorded + CASE id % 6 WHEN 1 THEN usage_events ELSE 0 END END AS missing_rows,
    CASE WHEN surface = 'codex' AND id % 23 > 0 THEN NULL ELSE usd + CASE WHEN id % 9 = 0 THEN 0.01::DOUBLE ELSE 0 END END AS cost, unavailable + CASE WHEN id % 14 = 0 THEN 1 ELSE 0 END AS unpriced,
    CASE WHEN covered THEN 'subscription_covered' WHEN surface = 'codex' THEN 'unavailable' ELSE 'partial' END AS status, CASE WHEN covered THEN 'marked_included_by_cursor_no_charge' WHEN id % 19 = 0 THEN 'recorded_in_export' ELSE {_case('surface', _COLUMN['measured'])} END AS measured,
    CASE WHEN id % 21 = 0 THEN 'lost' ELSE {_case('surface', _COLUMN['provider'])} END AS provider, id % 10 <> 0 AS adds_up FROM a)"""


def reports(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    key, m = F.col("report_id"), F.col("m")
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    rows = t.lineitem.select((F.col("l_suppkey") * 8 + F.col("l_linenumber")).alias("report_id"), (F.col("l_partkey") % 5).alias("m"), "l_orderkey", cents("l_extendedprice").alias("cents"), F.col("l_quantity").cast("long").alias("q"), cents("l_discount").alias("w"), cents("l_tax").alias("r"))
    has = m.isin(0, 3) | ((m == 2) & (F.col("l_orderkey") % 2 == 0))
    models = rows.groupBy("report_id", "m").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(has).alias("recorded"), F.sum("q").alias("input_tokens"), F.sum("w").alias("cache_write_tokens"), F.sum("r").alias("cache_read_tokens"), F.count(F.lit(1)).alias("output_tokens"), (F.sum(F.when(has, F.col("cents"))) / 100).alias("usd"))
    surface = F.element_at(F.array(*map(F.lit, _SURFACES)), (key % 4 + 1).cast("int"))
    models = models.withColumns({"surface": surface, "covered": (key % 4 == 0) & (key % 5 == 0)})
    s = F.col("surface")
    status = (
        F.when(F.col("covered"), "subscription_covered").when((s == "codex") & ~((key % 23 == 0) & (m == 0)), "unavailable").when((s == "cursor_ide") & (m == 1), "estimated")
        .when(F.col("recorded") == F.col("events"), "recorded").when(F.col("recorded") == 0, "unavailable").otherwise("partial")
    )
    dollars = {"input": 3.0, "output": 15.0, "cache_write": 3.75, "cache_read": 0.3}
    tokens = F.col("input_tokens") * 3.0 + F.col("output_tokens") * 15.0 + F.col("cache_write_tokens") * 3.75 + F.col("cache_read_tokens") * 0.3
    cost = (
        F.when(F.col("covered"), F.when((key % 3 == 0) & (m == 0), 0.5).otherwise(0.0)).when(F.col("cost_status") == "estimated", F.round(tokens / 1e6, 6) + F.when(key % 28 == 0, 0.001).otherwise(0.0))
        .when(F.col("cost_status") != "unavailable", F.col("usd"))
    )
    models = written(models.withColumn("cost_status", status).withColumns({"cost_usd": cost, "model": F.concat(F.lit("m"), m.cast("string"))}), "report-models")
    rates = models.where((s == "cursor_ide") & ~F.col("covered") & (m == 1)).select("report_id", F.when(key % 16 == 0, "m9").otherwise("m1").alias("model"), *(F.lit(v).alias(f"{k}_usd") for k, v in dollars.items()))

    whole = models.groupBy("report_id", "surface", "covered").agg(F.sum("events").alias("usage_events"), F.sum("recorded").alias("recorded"), F.sum("cost_usd").alias("usd"), F.count_if(F.col("cost_status") == "unavailable").alias("unavailable"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"))
    named = lambda name: F.create_map(*(F.lit(x) for pair in _COLUMN[name].items() for x in pair))[s]
    codex, covered = s == "codex", F.col("covered")
    double = F.when(key % 6 == 1, F.col("usage_events")).otherwise(0)
    pricing = F.when(codex, "not_applied_source_has_no_billed_cost").otherwise("not_applied_no_recognized_rate")
    form = named("input_form")
    whole = whole.select(
        "report_id", "surface", F.when(key % 21 == 0, "lost").otherwise(named("provider")).alias("provider"), form.alias("input_form"), *(named(c).alias(c) for c in ("token_basis", "cache_basis", "reasoning_basis")),
        F.when(covered, "marked_included_by_cursor_no_charge").when(key % 19 == 0, "recorded_in_export").otherwise(named("measured")).alias("measured_cost"), F.when(covered, "subscription_covered_by_plan").otherwise(named("basis")).alias("cost_basis"),
        F.when(covered, "subscription_covered").when(codex, "unavailable").otherwise("partial").alias("cost_status"), F.when(~(codex & (key % 23 > 0)), F.col("usd") + F.when(key % 9 == 0, 0.01).otherwise(0.0)).alias("cost_usd"), pricing.alias("pricing_status"),
        (F.col("unavailable") + F.when(key % 14 == 0, 1).otherwise(0)).alias("unpriced_model_groups"), "usage_events", "total_tokens",
        F.when(covered, 0).otherwise(F.col("recorded") + double + F.when(key % 6 == 0, 1).otherwise(0)).alias("recorded_rows"), (F.col("usage_events") - F.when(covered, 0).otherwise(F.col("recorded") + double)).alias("missing_rows"),
        F.when(codex, "available").otherwise("limited_to_current_parser_checks").alias("coverage_status"), F.lit(3).alias("files_parsed"), F.lit(1).alias("files_skipped"), F.when(key % 10 == 0, 5).otherwise(4).alias("files_discovered"), F.lit(2).alias("files_with_usage"),
    )
    return whole, models, rates


_FITS = {s: costs for s, _, _, _, costs in MEASUREMENTS if s in _SURFACES}
_KNOWN = {s: p for p, s, f in SOURCES if s in _SURFACES and f == _BASIS[s][1]}
_RULES = {
    "source_known": f"provider = {_case('surface', _KNOWN)}",
    "measurement_fits_source": " OR ".join(f"(surface = '{s}' AND measured IN ({', '.join(repr(c) for c in costs)}))" for s, costs in _FITS.items()),
    "file_counts_add_up": "surface <> 'codex' OR adds_up",
    "model_costs_sum_up": "CASE WHEN cost IS NULL THEN priced = 0 ELSE priced > 0 AND abs(usd - cost) <= 0.00001::DOUBLE END",
    "unpriced_models_counted": "unpriced = unavailable",
    "events_sum_up": "true",
    "rows_cover_events": "NOT tool OR recorded_rows + missing_rows = usage_events",
    "rows_can_be_allotted": "NOT tool OR covered OR (recorded_rows BETWEEN low_rec AND high_rec AND missing_rows BETWEEN low_mis AND high_mis)",
    "covered_cost_is_zero": "NOT covered OR (charged = 0 AND free = n AND cost = 0 AND recorded_rows = 0 AND missing_rows = usage_events)",
    "covered_nowhere_else": "covered OR free = 0",
    "incomplete_cost_says_so": "NOT tool OR covered OR missing_rows > 0",
    "missing_rows_show_in_models": "NOT tool OR covered OR CASE WHEN surface = 'copilot' THEN CASE WHEN recorded_rows = 0 THEN cost IS NULL AND unavailable = n AND status = 'unavailable' ELSE part + unavailable > 0 AND cost IS NOT NULL AND priced > 0 END ELSE part + unavailable + estimated > 0 END",
    "copilot_has_no_rates": "surface <> 'copilot' OR estimated = 0",
    "codex_has_no_dollars": "surface <> 'codex' OR (measured = 'not_available_in_local_codex_history' AND cost IS NULL AND unavailable = n AND priced = 0)",
    "no_dollars_is_codex": "surface = 'codex' OR measured <> 'not_available_in_local_codex_history'",
}
_LISTED = ", ".join(f"CASE WHEN NOT coalesce({rule}, false) THEN '{code}' END" for code, rule in _RULES.items())


@query(f"""WITH {REPORTS}, w AS (SELECT *, surface IN ('cursor_ide', 'copilot') AS tool FROM b),
  l AS (SELECT m.*, w.measured, r.fits FROM models m JOIN w ON w.id = m.id LEFT JOIN rates r ON r.id = m.id AND r.model = 'm' || m.m)
  SELECT id AS report_id, NULL AS model, unnest(list_filter([{_LISTED}], lambda c: c IS NOT NULL)) AS code FROM w
  UNION ALL SELECT id, model, 'rate_of_a_reported_model' FROM rates WHERE NOT fits
  UNION ALL SELECT id, 'm' || m, 'partial_has_both_kinds' FROM l WHERE status = 'partial' AND events < 2
  UNION ALL SELECT id, 'm' || m, 'estimate_has_a_rate' FROM l WHERE surface = 'cursor_ide' AND NOT covered AND (status = 'estimated') <> (fits IS NOT NULL)
  UNION ALL SELECT id, 'm' || m, 'estimate_is_tokens_by_rate' FROM l WHERE status = 'estimated' AND fits IS NOT NULL AND abs(cost - estimate) > 1e-9::DOUBLE""")
def report_reconciliation(t: Tables) -> DataFrame:
    """Every rule that each report breaks: sources, sums, rows that can't be allotted to models, covered and dollarless costs, estimates."""
    return reconcile(*reports(t))
