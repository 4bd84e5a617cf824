import json

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.archetypes import archetype
from tallyloom.functions.columns import COUNTERS, sanitize_model_label, strict_money, valid_calendar_day, wilson
from tallyloom.operators.conversations import visible_branch
from tallyloom.sources.exports import billing_items, billing_usage, console_usage, csv_kind, editor_usage, excluded_skus, flat_conversations, one_kind, read_csv, tree_conversations
from tallyloom.sources.sinks import cost_cell, report_document, write_new_json
from tallyloom.streaming.usage import drained, counter_delta_stream


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_scalar_functions(spark):
    assert column(spark, ["$1,234.50", "USD 3", " 2.5 usd", "US$ 7", "-4", ".5", "1,23", "abc", "", "$", "$1 000", "1e5", None, "\t$5\n"], strict_money) == [1234.5, 3, 2.5, 7, -4, 0.5, None, None, None, None, None, None, None, 5]
    assert column(spark, ["Claude-4-5-Haiku-20251001", "evil<script>", "GPT-5  mini", "GPT-5-mini", "claude alice smith payroll", "deepseek-v3-chat", "a" * 200], sanitize_model_label) == ["claude-4-5-haiku", "Unrecognized AI version", "Unrecognized AI version", "gpt-5-mini", "Unrecognized AI version", "deepseek-v3-chat", "Unrecognized AI version"]
    assert column(spark, ["2024-02-29", "2023-02-29", "0000-02-29", "2024-13-01", "x", None], valid_calendar_day) == [True, False, True, False, False, False]
    probes = ["Fix the crash in login", "what is this?", "build a new app from scratch", "", "hello there", "Refactor a.py b.py c.py", "practice exam answer key", "the login page works, right?\n"]
    assert column(spark, probes, archetype) == ["debug_fix", "qa_short", "build_new", "misc", "misc", "multi_file_refactor", "exam_solver", "qa_short"]
    low, high = wilson(F.lit(5), F.lit(10))
    r = spark.range(1).select(low.alias("a"), high.alias("b")).first()
    assert (round(r.a, 8), round(r.b, 8)) == (0.23659309, 0.76340691)


def test_editor_billing_and_console_csv(spark, tmp_path):
    (tmp_path / "e.csv").write_text('﻿Date,Kind,Model,Max Mode,Input (w/ Cache Write),Input (w/o Cache Write),Cache Read,Output Tokens,Total Tokens,Cost\n2026-04-11T21:15:00Z,Included,auto,Yes,"3,071",2048,77,19,2144,Included\n2026-04-12,Usage,claude-4.6-opus,No,640,640,0,32,672,$0.83\n2026-04-12,Errored No Charge,gpt-6,No,55,55,0,0,55,-\n2026-04-13,Usage,gpt-6,No,9,9,0,0,9,roughly 7\n')
    rows = read_csv(spark, str(tmp_path / "e.csv"))
    assert csv_kind(rows.columns) == "editor"
    got = [(r.model, r.input_tokens, r.cache_write_input_tokens, r.charge, r.cost, r.hour) for r in editor_usage(rows).collect()]
    assert got == [("auto", 2048, 1023, "included", None, "2026-04-11T21"), ("claude-4.6-opus", 640, 0, "charged", 0.83, None), ("gpt-6", 55, 0, "not_charged", 0.0, None), ("gpt-6", 9, 0, "unreadable", None, None)]
    (tmp_path / "b.csv").write_text("date,product,sku,quantity,unit_type,net_amount,model\n2025-11-20,copilot,copilot_premium_request,31,requests,1.24,GPT-4.1\n2025-11-20,copilot,copilot_ai_credit,18.75,ai-credits,0.1875,Gemini 3\n2025-11-21,copilot,coding_agent_ai_credit,7,ai-credits,0.07,Grok 4\n2025-11-22,copilot,copilot_odd_item,3,ai-credits,0.03,Gemini 3\n2025-11-23,copilot,copilot_ai_credit,2,ai-credits,0.02,<b>bold</b>\n")
    (tmp_path / "l.csv").write_text('"Timestamp","User","Model","Requests Used"\n2024-08-09T10:00:00Z,u,gpt-3.9,0.5\n')
    both = [read_csv(spark, str(tmp_path / f)) for f in ("b.csv", "l.csv")]
    assert [csv_kind(b.columns) for b in both] == ["modern", "legacy"]
    usage = billing_usage(both)
    want = [("credits", "Gemini 3", 18.75, 0.1875), ("credits", "Grok 4", 7.0, 0.07), ("credits", "Unrecognized AI version", 2.0, None), ("requests", "GPT-4.1", 31.0, 1.24), ("requests", "gpt-3.9", 0.5, None)]
    assert sorted((r.unit, r.model, r.quantity, r.cost) for r in usage.where("counted").collect()) == want
    assert [tuple(r) for r in excluded_skus(usage).collect()] == [("copilot_odd_item", 1)]
    items = [{"sku": "Copilot AI Credits", "model": "Auto: Gemini 3", "grossQuantity": 64, "netQuantity": 48, "netAmount": 0.48}, {"sku": "Copilot Odd Credits", "model": "Grok 4", "grossQuantity": 9, "netQuantity": 9, "netAmount": 0.09}]
    (tmp_path / "api.json").write_text(json.dumps({"timePeriod": {"year": 2025, "month": 12, "day": 24}, "user": "private", "usageItems": items}))
    api = billing_items(spark, str(tmp_path / "api.json"))
    assert [tuple(r) for r in api.where("counted").select("day", "model", "unit", "quantity", "cost").collect()] == [("2025-12-24", "Auto: Gemini 3", "credits", 48.0, 0.48)]
    assert [tuple(r) for r in excluded_skus(api).collect()] == [("Copilot Odd Credits", 1)]
    (tmp_path / "c.csv").write_text("model,input_tokens,output_tokens,cost_usd\nclaude-x,1,2,-3\nclaude-y,0,0,\n")
    assert [tuple(r) for r in console_usage(read_csv(spark, str(tmp_path / "c.csv"))).collect()] == [("claude-x", 1, 2, None)]
    with pytest.raises(ValueError):
        one_kind({"editor", "modern", ""})


def test_conversation_exports(spark, tmp_path):
    node = lambda i, parent, role, text: {"id": i, "parent": parent, "message": {"author": {"role": role}, "content": {"content_type": "text", "parts": [text]}}}
    small = {"id": "c", "current_node": "a", "mapping": {"a": node("a", None, "user", "hi")}}
    large = {"id": "c", "current_node": "d", "mapping": {"a": node("a", None, "user", "hi"), "b": node("b", "a", "assistant", "abandoned"), "d": node("d", "a", "assistant", "kept")}}
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "1.json").write_text(json.dumps([large]))
    (tmp_path / "t" / "2.json").write_text(json.dumps([small]))
    assert sorted(r.text for r in visible_branch(*tree_conversations(spark, str(tmp_path / "t"))).collect()) == ["hi", "kept"]
    (tmp_path / "f.json").write_text(json.dumps([{"uuid": "u", "chat_messages": [{"sender": "human", "text": "q"}, {"sender": "assistant", "text": "", "content": {"text": "a"}}, {"sender": "robot", "text": "x"}]}]))
    assert [(r.role, r.text) for r in flat_conversations(spark, str(tmp_path / "f.json")).orderBy("turn").collect()] == [("user", "q"), ("assistant", "a"), (None, "x")]


def test_report_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("Unrecognized AI version", *[1] * 7), ("claude-x", *[2] * 7)], f"model string, {', '.join(f'{c} long' for c in (*COUNTERS, 'total_tokens'))}")
    document = report_document(rows, "2026-01-01")
    report = json.loads(document.first().report)
    assert report["totals"]["total_tokens"] == 3 and [m["model"] for m in report["by_model"]] == ["claude-x", "Unrecognized AI version"]
    write_new_json(document, str(tmp_path / "report"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        write_new_json(document, str(tmp_path / "report"))
    cells = spark.createDataFrame([(None, True), (0.0, True), (2.5, True), (2.5, False)], "c double, k boolean").select(cost_cell(F.col("c"), F.col("k")).alias("x"))
    assert [r.x for r in cells.collect()] == ["Unpriced", "No charge recorded", "$2.50", "Partial $2.50"]


def test_counter_stream_equals_the_batch_rule(spark, tmp_path):
    rows = [("a", 1, 5), ("a", 2, 5), ("a", 3, 9), ("b", 1, 4), ("a", 4, 2), ("b", 2, 7)]
    spark.createDataFrame(rows, "series string, at long, total long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("series string, at long, total long").parquet(str(tmp_path / "in"))
    got = sorted(tuple(r) for r in drained(counter_delta_stream(stream), spark).collect())
    assert got == [("a", 1, 5, False), ("a", 3, 4, False), ("a", 4, None, True), ("b", 1, 4, False), ("b", 2, 3, False)]
