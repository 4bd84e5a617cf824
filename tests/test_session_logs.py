import json

from pyspark.sql import functions as F

from tallyloom.sources.session_logs import assistant_calls, coverage, jsonl_lines, rollout_usage, unique_calls


def call(message, request, model, counters, session="s", at="2026-01-02T03:04:05Z"):
    names = ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")
    return json.dumps({"type": "assistant", "sessionId": session, "timestamp": at, "requestId": request, "message": {"id": message, "model": model, "usage": dict(zip(names, counters, strict=True)), "content": [{"type": "text", "text": "private"}]}})


def test_calls_are_read_coerced_and_merged(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    opus = "claude-opus-4-8"
    (tmp_path / "a.jsonl").write_text("\r\n".join([call("m1", "r1", opus, (2, 30, 8, 20)), call("m1", "r1", opus, ("100", 2, 8, None)), "{not json", call("m2", "r1", "claude-4-5-haiku-20251001", (11, 5, 2, 4)), call("m3", "r3", opus, ("many", 1, 1, 1)), call("m4", "r4", opus, (0, 0, 0, 0)), '{"type": "user"}']))
    (tmp_path / "deep" / "b.JSONL").write_text(call("m1", "r1", opus, (1, 1, 1, 1), session="t") + "\n" + call(None, None, "<script>", (7, 3, 0, 0)))
    rows = assistant_calls(jsonl_lines(spark, str(tmp_path)))
    calls = {r.model: r for r in unique_calls(rows).collect()}
    assert {m: (r.input_tokens, r.output_tokens, r.cache_write_input_tokens, r.cache_read_input_tokens, r.copies) for m, r in calls.items()} == {
        opus: (100, 30, 8, 20, 3), "claude-4-5-haiku": (11, 5, 2, 4, 1), "Unrecognized AI version": (7, 3, 0, 0, 1),
    }
    assert unique_calls(rows, within_session=True).count() == 4
    assert tuple(coverage(rows).first()) == (2, 2, 5, 2, 0, False)
    assert jsonl_lines(spark, str(tmp_path / "nowhere")).count() == 0


def test_rollout_deltas_resets_and_models(spark, tmp_path):
    def snapshot(total=None, last=None):
        use = lambda u: u and dict(zip(("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens"), u, strict=True), total_tokens=u[0] + u[2])
        return {"type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": use(total), "last_token_usage": use(last)}}}

    model = lambda m: {"type": "turn_context", "payload": {"model": m}}
    events = [{"type": "session_meta", "payload": {"id": "s"}}, model("gpt-5-sol"), snapshot((100, 40, 20, 5)), snapshot((100, 40, 20, 5)), snapshot((150, 50, 30, 8)), model("gpt-5-terra"), snapshot((170, 60, 40, 10)), snapshot((10, 2, 4, 1), (10, 2, 4, 1))]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, events)))
    rows = rollout_usage(jsonl_lines(spark, str(tmp_path)))
    used = rows.where("not repeated").groupBy("model").agg(*(F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_input_tokens", "reasoning_output_tokens", "usage_records")))
    assert sorted(tuple(r) for r in used.collect()) == [("gpt-5-sol", 100, 30, 50, 8, 2), ("gpt-5-terra", 18, 14, 12, 3, 2)]
    assert (rows.where("reset").count(), rows.where("repeated").count()) == (1, 1)


def test_lines_are_parsed_once(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(call("m1", "r1", "claude-opus-4-8", (2, 30, 8, 20)))
    calls = unique_calls(assistant_calls(jsonl_lines(spark, str(tmp_path))))
    assert calls.count() == 1 and "parseJson" not in calls._jdf.queryExecution().optimizedPlan().toString()
