import pytest

from tallyloom.operators.reconciliation import reconcile

REPORT = (
    "report_id long, provider string, surface string, input_form string, token_basis string, cache_basis string, reasoning_basis string, measured_cost string, cost_basis string, cost_status string, cost_usd double,"
    " pricing_status string, unpriced_model_groups long, usage_events long, total_tokens long, recorded_rows long, missing_rows long, coverage_status string, files_parsed long, files_skipped long, files_discovered long, files_with_usage long"
)
MODEL = "report_id long, model string, input_tokens long, output_tokens long, cache_write_tokens long, cache_read_tokens long, events long, cost_status string, cost_usd double"
RATE = "report_id long, model string, input_usd double, output_usd double, cache_write_usd double, cache_read_usd double"
COLUMNS, NONE, LIMITED = "exported_columns_where_present", "not_available", "limited_to_current_parser_checks"
FILES = (4, 1, 5, 2)
CURSOR = ("cursor", "cursor_ide", "usage_csv_export", COLUMNS, COLUMNS, NONE)
FILLED = "recorded_where_present_then_checked_rates_for_recognized_missing_rows"
NO_DOLLARS = "not_available_in_local_codex_history"
COUNTERS = "recorded_usage_counters"
#: A report of each kind that breaks nothing: the report, its models, its rates.
GOOD = {
    "filled": ((*CURSOR, FILLED, "recorded_and_or_estimated_where_possible", "partial", 1.5033, "applied", 1, 10, 99, 4, 6, LIMITED, *FILES),
               [("a", 1, 1, 1, 1, 3, "recorded", 1.0), ("b", 1000, 20, 0, 0, 2, "estimated", 0.0033), ("c", 1, 1, 1, 1, 3, "partial", 0.5), ("d", 1, 1, 1, 1, 2, "unavailable", None)], [("b", 3.0, 15.0, 3.75, 0.3)]),
    "billed": ((*CURSOR, "recorded_in_export_as_billed_by_cursor", "recorded_in_export", "recorded", 2.0, "not_needed_recorded_cost", 0, 3, 9, 3, 0, LIMITED, *FILES), [("a", 1, 1, 1, 1, 3, "recorded", 2.0)], []),
    "covered": ((*CURSOR, "marked_included_by_cursor_no_charge", "subscription_covered_by_plan", "subscription_covered", 0.0, "not_applied_no_recognized_rate", 0, 5, 9, 0, 5, LIMITED, *FILES),
                [("a", 1, 1, 1, 1, 2, "subscription_covered", 0.0), ("b", 1, 1, 1, 1, 3, "subscription_covered", 0.0)], []),
    "copilot": (("github", "copilot", "billing_usage_export", "not_available_copilot_meters_prompts_and_credits", NONE, NONE, "recorded_where_present_never_estimated", "recorded_where_present_never_estimated", "partial", 0.5,
                 "not_applied_no_recognized_rate", 1, 5, 0, 1, 4, LIMITED, *FILES), [("a", 0, 0, 0, 0, 3, "partial", 0.5), ("b", 0, 0, 0, 0, 2, "unavailable", None)], []),
    "codex": (("openai", "codex", "local_session_usage_records", COUNTERS, COUNTERS, "recorded_subset_of_output", NO_DOLLARS, NO_DOLLARS, "unavailable", None, "not_applied_source_has_no_billed_cost", 1, 5, 9, 0, 0, "available", *FILES),
              [("a", 1, 1, 0, 1, 5, "unavailable", None)], []),
}
NAMES = [c.split()[0] for c in REPORT.split(",")][1:]


def broken(spark, cases):
    reports, models, rates = [], [], []
    for i, (kind, change, of_model, of_rate) in enumerate(cases):
        report, ms, rs = GOOD[kind]
        reports.append((i, *(change.get(n, v) for n, v in zip(NAMES, report, strict=True))))
        models += [(i, *(of_model.get(m[0], m))) for m in ms if of_model.get(m[0], m)]
        rates += [(i, *r) for r in (of_rate if of_rate is not None else rs)]
    found = reconcile(*(spark.createDataFrame(rows, schema) for rows, schema in ((reports, REPORT), (models, MODEL), (rates, RATE)))).collect()
    return [sorted((r.code, r.model) for r in found if r.report_id == i) for i in range(len(cases))]


def test_each_rule_is_broken_by_its_own_fault(spark):
    rate = ("b", 3.0, 15.0, 3.75, 0.3)
    cases = {
        "good": [(k, {}, {}, None, []) for k in GOOD],
        "bad": [
            ("filled", {"provider": "x"}, {}, None, ["source_known"]), ("filled", {"cache_basis": NONE}, {}, None, ["measurement_fits_source"]), ("filled", {"coverage_status": "available"}, {}, None, ["coverage_fits_source"]),
            ("codex", {"files_discovered": 6}, {}, None, ["file_counts_add_up"]), ("codex", {"files_with_usage": 5}, {}, None, ["file_counts_add_up"]), ("filled", {"cost_usd": 1.5034}, {}, None, ["model_costs_sum_up"]),
            ("filled", {"cost_usd": 1.503305}, {}, None, []), ("filled", {"unpriced_model_groups": 2}, {}, None, ["unpriced_models_counted"]), ("filled", {}, {}, [rate, rate], ["rates_unique"]),
            ("filled", {}, {}, [rate, ("z", *rate[1:])], [("rate_of_a_reported_model", "z")]), ("filled", {"usage_events": 11}, {}, None, ["events_sum_up", "rows_cover_events"]),
            ("filled", {"recorded_rows": 3, "missing_rows": 7}, {}, None, ["rows_can_be_allotted"]), ("filled", {"recorded_rows": 5, "missing_rows": 5}, {}, None, []), ("filled", {"recorded_rows": 6, "missing_rows": 4}, {}, None, ["rows_can_be_allotted"]),
            ("filled", {}, {"b": ("b", 1000, 20, 0, 0, 2, "estimated", 0.0034)}, None, [("estimate_is_tokens_by_rate", "b"), "model_costs_sum_up"]), ("filled", {}, {}, [], [("estimate_has_a_rate", "b")]),
            ("filled", {}, {"c": ("c", 1, 1, 1, 1, 1, "partial", 0.5)}, None, ["events_sum_up", ("partial_has_both_kinds", "c"), "rows_can_be_allotted"]), ("filled", {"cost_basis": "recorded_in_export"}, {}, None, ["incomplete_cost_says_so"]),
            ("billed", {"recorded_rows": 2, "missing_rows": 1}, {}, None, ["complete_cost_is_recorded"]), ("billed", {"pricing_status": "applied"}, {}, None, ["complete_cost_is_recorded"]),
            ("covered", {"total_tokens": 0}, {}, None, ["covered_cost_is_zero"]), ("covered", {}, {"a": ("a", 1, 1, 1, 1, 2, "subscription_covered", None)}, None, ["covered_cost_is_zero"]),
            ("covered", {"cost_usd": 0.1}, {"a": ("a", 1, 1, 1, 1, 2, "subscription_covered", 0.1)}, None, ["covered_cost_is_zero"]), ("filled", {}, {"d": ("d", 1, 1, 1, 1, 2, "subscription_covered", 0.0)}, None, ["covered_nowhere_else", "unpriced_models_counted"]),
            ("copilot", {"cost_status": "recorded"}, {}, None, ["missing_rows_show_in_models"]), ("copilot", {}, {}, [("a", 1.0, 1.0, 1.0, 1.0)], ["copilot_has_no_rates"]),
            ("codex", {"cost_usd": 1.0}, {"a": ("a", 1, 1, 0, 1, 5, "recorded", 1.0)}, None, ["codex_has_no_dollars", "unpriced_models_counted"]), ("filled", {"pricing_status": "not_applied_source_has_no_billed_cost"}, {}, None, ["no_dollars_is_codex"]),
            ("codex", {}, {"a": None}, None, ["has_models"]),
        ],
    }
    listed = cases["good"] + cases["bad"]
    found = broken(spark, [c[:4] for c in listed])
    for case, got in zip(listed, found, strict=True):
        assert got == sorted((w if isinstance(w, tuple) else (w, None)) for w in case[4]), case


@pytest.mark.parametrize("kind", ["filled", "codex"])
def test_unknown_values_break_rules_and_empty_tables_dont_fail(spark, kind):
    assert broken(spark, [(kind, {"coverage_status": None}, {}, None)])[0][0] == ("coverage_fits_source", None)
    assert reconcile(*(spark.createDataFrame([], s) for s in (REPORT, MODEL, RATE))).count() == 0
