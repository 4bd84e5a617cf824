"""Reconciliation of usage reports: what source, measurement, coverage, models, rates and cost say must agree.

Reports are rows (one a report), their models and applied rates are tables
beside them.  Every broken rule is a row (report_id, model, code); rules of a
whole report have a null model.  Models are summed by report in one exchange
with partial sums, so a report with many models is no single task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.rules import violations

# Sources as (provider, surface, input form), and what each surface may say of tokens, cache, reasoning and cost.
SOURCES = (
    ("anthropic", "claude_code", "locally_cleaned_usage_export"), ("anthropic", "claude_code", "validated_top_safe_usage_export"), ("anthropic", "claude_code", "local_session_usage_records"),
    ("openai", "codex", "validated_top_safe_usage_export"), ("openai", "codex", "local_session_usage_records"), ("openai", "chatgpt", "conversation_export"), ("anthropic", "claude_chat", "conversation_export"),
    ("anthropic", "console", "console_csv_export"), ("cursor", "cursor_ide", "usage_csv_export"), ("github", "copilot", "billing_usage_export"),
)
_COUNTERS, _COLUMNS, _TEXT = "recorded_usage_counters", "exported_columns_where_present", "estimated_from_visible_message_text"
_FILLED = "recorded_where_present_then_checked_rates_for_recognized_missing_rows"
COVERED = "marked_included_by_cursor_no_charge"
NO_DOLLARS = "not_available_in_local_codex_history"
MEASUREMENTS = (
    ("claude_code", _COUNTERS, _COUNTERS, "not_separately_available", ("checked_pay_as_you_go_rate_comparison",)),
    ("codex", _COUNTERS, _COUNTERS, "recorded_subset_of_output", (NO_DOLLARS,)),
    ("claude_chat", _TEXT, "not_available", "not_available", ("not_available",)),
    ("chatgpt", _TEXT, "not_available", "not_available", ("not_available",)),
    ("console", _COLUMNS, _COLUMNS, "not_available", ("recorded_in_export", _FILLED)),
    ("cursor_ide", _COLUMNS, _COLUMNS, "not_available", ("recorded_in_export_as_billed_by_cursor", _FILLED, COVERED)),
    ("copilot", "not_available_copilot_meters_prompts_and_credits", "not_available", "not_available", ("recorded_in_export_as_billed_by_github", "recorded_where_present_never_estimated")),
)
#: Dollars by which a sum of models may miss the report's cost, and an estimate its tokens times rates.
SUM_TOLERANCE, ESTIMATE_TOLERANCE = 1e-5, 1e-9


def _one_of(parts: tuple[str, ...], allowed: list[tuple[str, ...]]) -> Column:
    return F.concat_ws("|", *parts).isin(["|".join(a) for a in allowed])


def source_rules() -> dict[str, Column]:
    """Source, measurement and coverage of a report by fixed tables; counts of files add up where a source counts files."""
    said = [(surface, t, c, r, cost) for surface, t, c, r, costs in MEASUREMENTS for cost in costs]
    local = (F.col("input_form") == "validated_top_safe_usage_export") & F.col("surface").isin("claude_code", "codex")
    counted = F.col("coverage_status").isin("available_from_local_collector", "available")
    wanted = F.when(local, "available_from_local_collector").when(F.col("surface") == "codex", "available").otherwise("limited_to_current_parser_checks")
    cleaned = (F.col("input_form") == "locally_cleaned_usage_export") & counted  # may keep the counts of the export it was made from
    return {
        "source_known": _one_of(("provider", "surface", "input_form"), list(SOURCES)),
        "measurement_fits_source": _one_of(("surface", "token_basis", "cache_basis", "reasoning_basis", "measured_cost"), said),
        "coverage_fits_source": (F.col("coverage_status") == wanted) | (cleaned & (F.col("coverage_status") == "available_from_local_collector")),
        "file_counts_add_up": ~counted | ((F.col("files_parsed") + F.col("files_skipped") == F.col("files_discovered")) & (F.col("files_with_usage") <= F.col("files_parsed"))),
    }


def model_facts(models: DataFrame, rates: DataFrame) -> DataFrame:
    """One row a report: sums over its models, and bounds on the recorded and missing rows that their cost states allow.

    A recorded model's events are all recorded rows, an estimated, unavailable or
    covered one's all missing; a partial one has one of each at least.
    """
    status, events = F.col("cost_status"), F.col("events")
    is_ = lambda *s: F.coalesce(status.isin(*s), F.lit(False))
    partial = is_("partial")
    least = lambda *s: F.sum(F.when(is_(*s), events).when(partial, 1).otherwise(0))
    most = lambda *s: F.sum(F.when(is_(*s), events).when(partial, events - 1).otherwise(0))
    missing = ("estimated", "unavailable", "subscription_covered")
    facts = models.groupBy("report_id").agg(
        F.count(F.lit(1)).alias("n_models"), F.sum("events").alias("sum_events"), F.min("events").alias("min_events"), F.sum("cost_usd").alias("sum_usd"), F.count("cost_usd").alias("priced"), F.count_if(F.col("cost_usd") != 0).alias("charged"),
        *(F.count_if(is_(s)).alias(f"n_{s}") for s in ("recorded", "partial", "estimated", "unavailable", "subscription_covered")),
        least("recorded").alias("least_recorded"), most("recorded").alias("most_recorded"), least(*missing).alias("least_missing"), most(*missing).alias("most_missing"),
    )
    applied = rates.groupBy("report_id").agg(F.count(F.lit(1)).alias("n_rates"), F.count_distinct("model").alias("n_rate_models"))
    return facts.join(applied, "report_id", "left").fillna(0, ["n_rates", "n_rate_models"])


def cost_rules() -> dict[str, Column]:
    """Rules between a report's cost, its models' costs and its rates, over a report's row with its model_facts."""
    c = F.col
    n = {s: c(f"n_{s}") for s in ("recorded", "partial", "estimated", "unavailable", "subscription_covered")}
    usd, tools, multi = c("cost_usd"), c("surface").isin("cursor_ide", "copilot"), c("surface").isin("cursor_ide", "copilot")
    between = lambda x, low, high: (x >= c(low)) & (x <= c(high))
    complete = c("measured_cost").isin("recorded_in_export_as_billed_by_cursor", "recorded_in_export_as_billed_by_github")
    covered, codex = c("measured_cost") == COVERED, c("surface") == "codex"
    free = (n["subscription_covered"] == c("n_models")) & (c("charged") == 0) & (c("priced") == c("n_models"))
    whole = (c("missing_rows") == 0) & (c("recorded_rows") == c("usage_events")) & (c("cost_basis") == "recorded_in_export") & (c("cost_status") == "recorded") & (n["recorded"] == c("n_models")) & (c("n_rates") == 0) & (c("pricing_status") == "not_needed_recorded_cost")
    open_ = multi & ~complete & ~covered
    copilot = c("surface") == "copilot"
    part = (c("missing_rows") > 0) & (c("cost_basis") == F.when(copilot, "recorded_where_present_never_estimated").otherwise("recorded_and_or_estimated_where_possible"))
    shown = n["partial"] + n["unavailable"] + F.when(copilot, F.lit(0)).otherwise(n["estimated"]) > 0
    none = (c("cost_status") == "unavailable") & usd.isNull() & (n["unavailable"] == c("n_models"))
    some = shown & (c("cost_status") == "partial") & usd.isNotNull() & (c("priced") > 0)
    return {
        "model_costs_sum_up": F.when(usd.isNull(), c("priced") == 0).otherwise((c("priced") > 0) & (F.abs(c("sum_usd") - usd) <= SUM_TOLERANCE)),
        "unpriced_models_counted": c("unpriced_model_groups") == n["unavailable"],
        "rates_unique": c("n_rates") == c("n_rate_models"),
        "events_sum_up": ~multi | ((c("sum_events") == c("usage_events")) & (c("min_events") >= 1)),
        "rows_cover_events": ~multi | (c("recorded_rows") + c("missing_rows") == c("usage_events")),
        "rows_can_be_allotted": ~open_ | (between(c("recorded_rows"), "least_recorded", "most_recorded") & between(c("missing_rows"), "least_missing", "most_missing")),
        "complete_cost_is_recorded": ~(tools & complete) | whole,
        "covered_cost_is_zero": ~covered | (free & (c("cost_basis") == "subscription_covered_by_plan") & (c("cost_status") == "subscription_covered") & (usd == 0) & (c("recorded_rows") == 0) & (c("missing_rows") == c("usage_events")) & (c("n_rates") == 0) & (c("total_tokens") >= 1)),
        "covered_nowhere_else": covered | (n["subscription_covered"] == 0),
        "incomplete_cost_says_so": ~open_ | part,
        "missing_rows_show_in_models": ~open_ | F.when(copilot, F.when(c("recorded_rows") == 0, none).otherwise(some)).otherwise(shown),
        "copilot_has_no_rates": ~copilot | ((c("n_rates") == 0) & (n["estimated"] == 0)),
        "codex_has_no_dollars": ~codex | ((c("measured_cost") == NO_DOLLARS) & (c("cost_basis") == NO_DOLLARS) & (c("cost_status") == "unavailable") & usd.isNull() & (c("pricing_status") == "not_applied_source_has_no_billed_cost") & (c("n_rates") == 0) & (n["unavailable"] == c("n_models")) & (c("priced") == 0)),
        "no_dollars_is_codex": codex | ~(F.coalesce(c("measured_cost") == NO_DOLLARS, F.lit(False)) | F.coalesce(c("cost_basis") == NO_DOLLARS, F.lit(False)) | F.coalesce(c("pricing_status") == "not_applied_source_has_no_billed_cost", F.lit(False))),
    }


def model_rules() -> dict[str, Column]:
    """Rules of one model of a report, over its row with the report's surface and its rate, if it has one."""
    c = F.col
    cursor = c("surface") == "cursor_ide"
    tokens = c("input_tokens") * c("input_usd") + c("output_tokens") * c("output_usd") + c("cache_write_tokens") * c("cache_write_usd") + c("cache_read_tokens") * c("cache_read_usd")
    again = F.abs(c("cost_usd") - F.round(tokens / 1e6, 6)) <= ESTIMATE_TOLERANCE
    estimated = c("cost_status") == "estimated"
    return {
        "partial_has_both_kinds": (c("cost_status") != "partial") | (c("events") >= 2),
        "estimate_has_a_rate": ~cursor | c("open_cost").eqNullSafe(F.lit(False)) | (estimated == c("has_rate")),
        "estimate_is_tokens_by_rate": ~cursor | ~estimated | ~c("has_rate") | again,
    }


def reconcile(reports: DataFrame, models: DataFrame, rates: DataFrame) -> DataFrame:
    """report_id, model and code of every broken rule.

    reports have what source_rules and cost_rules name, models (report_id, model,
    tokens, events, cost_status, cost_usd), rates (report_id, model, dollars for a
    million tokens of each kind).  A report without any model breaks has_models
    alone of the cost rules; a condition that isn't known counts as broken.
    """
    none = F.lit(None).cast("string").alias("model")
    models = models.select("report_id", "model", *(f"{p}_tokens" for p in ("input", "output", "cache_write", "cache_read")), "events", "cost_status", "cost_usd")
    whole = reports.join(model_facts(models, rates), "report_id", "left")
    parts = [violations(reports, ["report_id"], source_rules()), violations(whole.where("n_models is not null"), ["report_id"], cost_rules()), violations(whole, ["report_id"], {"has_models": F.col("n_models") > 0})]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.select("report_id", none, "code")
    open_cost = ~F.col("measured_cost").isin("recorded_in_export_as_billed_by_cursor", COVERED)
    priced = rates.groupBy("report_id", "model").agg(*(F.max(f"{p}_usd").alias(f"{p}_usd") for p in ("input", "output", "cache_write", "cache_read")), F.lit(True).alias("has_rate"))
    rows = models.join(reports.select("report_id", "surface", open_cost.alias("open_cost")), "report_id").join(priced, ["report_id", "model"], "left").fillna(False, ["has_rate"])
    foreign = rates.join(models.select("report_id", "model"), ["report_id", "model"], "left_anti").select("report_id", "model", F.lit("rate_of_a_reported_model").alias("code"))
    return out.unionByName(violations(rows, ["report_id", "model"], model_rules())).unionByName(foreign)
