import json

import pytest

from tallyloom.sources.session_logs import LONGEST_LINE, accepted_rollout_usage, jsonl_lines, rollout_coverage, rollout_files, rollout_records

FIELDS = ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")


def use(u):
    return u and dict(zip(FIELDS, u, strict=True))


def snapshot(total=None, last=None, **more):
    return {"type": "event_msg", "payload": {"type": "token_count", **more, "info": {"total_token_usage": use(total), "last_token_usage": use(last)}}}


def meta(name):
    return {"type": "session_meta", "payload": {"id": name}}


def model(name, **more):
    return {"type": "turn_context", "payload": {"model": name, **more}}


PAD = "x" * LONGEST_LINE


def records(spark, folder, files):
    for name, lines in files.items():
        (folder / f"{name}.jsonl").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    return rollout_records(jsonl_lines(spark, str(folder)))


def shown(rows):
    return [(r.status, r.model, r.input_tokens, r.cache_read_input_tokens, r.output_tokens, r.reset, r.incomplete) for r in sorted(rows.collect(), key=lambda r: (r.file, r.line_no))]


def test_counters_are_strict_and_zero_usage_is_dropped(spark, tmp_path):
    lines = [
        snapshot((100, 40, 20, 5, 120)), snapshot((100, 40, 20, 5, 120)), snapshot((110, 111, 20, 5, 130)), snapshot((110, 41, 20, 21, 130)), snapshot(("120", 40, 20, 5, 140)), snapshot((2**53, 0, 1, 0, 1)),
        snapshot((130, 50, 20, 5, 150)), snapshot((130, 50, 20, 5, 151)), snapshot((10, 2, 4, 1, 14)), snapshot((5, 1, 1, 0, 6), (3, 1, 1, 0, 4)), snapshot(None, (7, 2, 1, 0, 9)), snapshot((6, 1, 2, 0, 8)), {"type": "event_msg", "payload": {"type": "token_count", "info": None}}, "5", '{"a": 1}']
    usage = lambda *x, reset=False, incomplete=False: ("usage", "Unrecognized AI version", *x, reset, incomplete)
    bare = lambda status, incomplete=False, reset=False, counters=(None, None, None): (status, "Unrecognized AI version", *counters, reset, incomplete)
    unread = bare("unread", True)
    assert shown(records(spark, tmp_path, {"a": lines})) == [
        usage(60, 40, 20), bare("duplicate", counters=(0, 0, 0)), unread, unread, unread, unread, usage(20, 10, 0), bare("empty", True, counters=(0, 0, 0)), bare("reset", True, True),
        usage(2, 1, 1, reset=True, incomplete=True), usage(5, 2, 1, incomplete=True), usage(1, 0, 1), unread, bare("other"), bare("other")]


def test_oversized_records_are_read_by_their_wanted_places(spark, tmp_path):
    """What is told by a few places counts as ever; what can't be told sets the model back and, if it may have named the session, spoils the file."""
    deep = json.dumps(model("gpt-5-terra"))[:-1] + ', "d": ' + "[" * 130 + "]" * 130 + f', "pad": "{PAD}"}}'
    shallow = json.dumps(model("gpt-5-terra"))[:-1] + ', "d": "' + "[{" * 200 + '\\"' + f'", "pad": "{PAD}"}}'
    later = json.dumps(model("gpt-5-sol"))[:-1] + f', "pad": "{PAD}", "payload": {{"model": "gpt-5-terra"}}}}'  # later keys win
    files = {
        "a": [meta("a"), shallow, snapshot((10, 0, 1, 0, 11), pad=PAD), {"type": "response_item", "pad": PAD}, snapshot((20, 0, 2, 0, 22)), later, snapshot((30, 0, 2, 0, 32))],
        "b": [meta("b"), model("gpt-5-sol"), {"type": "event_msg", "payload": {"type": "token_count", "pad": PAD, "info": {"total_token_usage": {"input_tokens": 1}}}}, snapshot((20, 0, 2, 0, 22))],
        "c": [meta("c"), model("gpt-5-sol"), deep, snapshot((20, 0, 2, 0, 22))],
        "d": [meta("d"), json.dumps({"type": "session_meta", "payload": {"id": "y" * 1025}, "pad": PAD}), snapshot((20, 0, 2, 0, 22))],
        "e": [meta("e"), f'{{"type": "turn_context", "pad": "{PAD}', snapshot((20, 0, 2, 0, 22))],
    }
    rows = records(spark, tmp_path, files)
    by_file = {}
    for r in sorted(rows.collect(), key=lambda r: (r.file, r.line_no)):
        by_file.setdefault(r.file.rsplit("/", 1)[1][0], []).append((r.status, r.model))
    none = "Unrecognized AI version"
    assert by_file["a"] == [("meta", none), ("other", "gpt-5-terra"), ("usage", "gpt-5-terra"), ("other", "gpt-5-terra"), ("usage", "gpt-5-terra"), ("other", "gpt-5-terra"), ("usage", "gpt-5-terra")]
    assert by_file["b"][2:] == [("oversized", none), ("usage", none)]
    verdicts = {r.file.rsplit("/", 1)[1][0]: (r.verdict, r.oversized) for r in rollout_files(rows).collect()}
    assert verdicts["a"] == ("accepted", 0) and verdicts["b"] == ("accepted", 1) and verdicts["d"] == ("skipped", 1)
    assert verdicts["c"][0] == verdicts["e"][0] == "skipped"


def test_files_are_taken_once_and_conflicts_end_it(spark, tmp_path):
    plain = lambda name, n=1: [meta(name), model("gpt-5-sol"), *(snapshot((10 * k, 0, k, 0, 11 * k)) for k in range(1, n + 1))]
    files = {"a": plain("s"), "b": plain("s"), "c": [*plain("t"), "{broken"], "d": [meta("u")], "e": plain("v", 3)}
    rows = records(spark, tmp_path, files)
    found = rollout_files(rows)
    assert sorted((r.file[-7], r.verdict) for r in found.collect()) == [("a", "accepted"), ("b", "repeated"), ("c", "skipped"), ("d", "without_usage"), ("e", "accepted")]
    used = accepted_rollout_usage(rows, found)
    assert sorted((r.file[-7], r.input_tokens) for r in used.collect()) == [("a", 10), ("e", 10), ("e", 10), ("e", 10)]
    cover = rollout_coverage(found).first()
    assert (cover.files_discovered, cover.files_parsed, cover.files_with_usage, cover.files_skipped, cover.malformed, cover.duplicates, cover.complete) == (5, 4, 3, 1, 1, 1, False)
    for name, lines in (("f", plain("v", 2)), ("g", plain("x")[1:]), ("h", [meta("x"), *plain("y")])):
        folder = tmp_path / name
        folder.mkdir()
        rows = records(spark, folder, {"e": plain("v", 3), name: lines})
        found = rollout_files(rows)
        assert [r.verdict for r in found.where(f"file like '%/{name}.jsonl'").collect()] == ["session_taken" if name == "f" else "no_single_session"]
        assert accepted_rollout_usage(rows, found, strict=False).count() == 3
        with pytest.raises(Exception, match="no total is safe"):
            accepted_rollout_usage(rows, found).collect()
