"""An experiment's files, written by hand, come back as outcome, cycles, flags, latency, tokens and cost."""

import json

from sievework.operators import rollup
from sievework.sources.experiments import collect_experiment


def put(path, *records, text=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text if text is not None else "\n".join(json.dumps(r) for r in records))


def tables(spark):
    prices = spark.createDataFrame([("big", "15", "75", "18.75", "1.5"), ("small", "3", "15", "3.75", "0.3")], "model string, input string, output string, cache_write string, cache_read string")
    return prices, spark.createDataFrame([("planner", "deep"), ("coder", "exec")], "agent string, tier string"), spark.createDataFrame([("deep", "big"), ("exec", "small")], "tier string, model string"), "small"


def cells_at(root):
    """Three cells of a task: A passes, B has failed twice, C has a session; D is an empty folder, E has files that are cut short."""
    times = {"started_at": "2026-06-04T10:00:00Z", "ended_at": "2026-06-04T10:05:00Z"}
    for mode in "ABC":
        put(root / f"cells/T1__{mode}/run-meta.json", {"task": "T1", "mode": mode, **times})
    results = {"unit_test": {"status": "PASS", "race_detected": True}, "security": "FAIL", "lint": {"none": 1}}
    states = {"TICKET_INTAKE": {"sensitive_check": {"result": "REDACTED"}}, "EVALUATION": {"results": results}}
    put(root / "cells/T1__A/state.json", {"ticket_id": "T1", "current_state": "EVALUATION_PASS", "states": states})
    failed = [{"state": "EVALUATION", "actual_outcome": {"summary": "unit test"}}, {"state": "DESIGN", "actual_outcome": {"summary": "panic"}}, {"state": "EVALUATION", "actual_outcome": {"summary": "Regression in pool"}}, "odd"]
    put(root / "cells/T1__B/state.json", {"current_state": "BLOCKED", "failure_log": failed})
    put(root / "cells/T1__C/state.json", {"current_state": "DESIGN"})
    log = [{"subagent_type": "planner", "prompt_chars": 401, "response_chars": 40}, {"subagent_type": "nobody", "prompt_chars": 8, "response_chars": None}]
    for mode in "ABC":
        put(root / f"cells/T1__{mode}/logs/agent-transcript.jsonl", text="\n".join(map(json.dumps, log)) + '\n\n{"subagent_type": "pla')
    put(root / "session-c.jsonl", {"message": {"model": "big", "usage": {"input_tokens": 10, "output_tokens": 2, "cache_read_input_tokens": 4}}}, {"type": "note"}, {"message": {"usage": {"input_tokens": 1}}})
    put(root / "session-a.jsonl", {"message": "no usage"})
    (root / "cells/T1__D").mkdir()
    put(root / "cells/T1__E/run-meta.json", text='{"task": "T1"')
    put(root / "cells/T1__E/state.json", text="[1]")


def test_all_cells_without_a_list(spark, tmp_path):
    cells_at(tmp_path)
    sessions = spark.createDataFrame([("T1__C", str(tmp_path / "session-c.jsonl")), ("T1__A", str(tmp_path / "session-a.jsonl"))], "cell string, path string")
    got = {r.cell: r for r in collect_experiment(spark, str(tmp_path), *tables(spark), sessions=sessions).collect()}
    assert sorted(got) == [f"T1__{m}" for m in "ABCDE"]
    a, b, c, d, e = (got[f"T1__{m}"] for m in "ABCDE")
    assert (a.task, a.mode, a.status, a.correct, a.latency_s) == ("T1", "A", "done", True, 300.0)
    assert a.detail == {"unit_test": "PASS", "security": "FAIL"} and a.safety_flags == ["sensitive_redacted", "security_fail", "race_detected"]
    # a session without usage counts for nothing: 401 and 40 characters of the planner, 8 of an unknown agent
    assert (a.usage_source, a.input, a.output, a.models, a.cost_status) == ("char_estimate", 103, 10, ["big", "small"], "estimated")
    assert float(a.cost) == (101 * 15 + 10 * 75 + 2 * 3) / 1e6
    assert (b.correct, b.bug_cycles, b.side_effects, b.safety_flags) == (False, 2, 1, [])
    assert (c.correct, c.usage_source, c.input, c.output, c.cache_read, c.tokens, c.cost_status) == (None, "session_jsonl", 11, 2, 4, 17, "actual")
    for x in (d, e):
        assert (x.task, x.mode, x.status, x.correct, x.tokens, x.latency_s, x.cost_status) == (x.cell, "unknown", "incomplete", None, 0, None, "unknown")


def test_the_list_drives_and_overrides(spark, tmp_path):
    cells_at(tmp_path)
    listed = [{"workspace": "cells/T1__B", "status": "failed"}, {"task": "T1", "mode": "A", "status": ""}, {"task": "T9", "mode": "Z", "status": "done"}]
    put(tmp_path / "state.json", {"experiment": "x", "cells": listed})
    got = [(r.cell, r.task, r.mode, r.status, r.correct) for r in collect_experiment(spark, str(tmp_path), *tables(spark)).orderBy("pos").collect()]
    assert got == [("T1__B", "T1", "B", "failed", False), ("T1__A", "T1", "A", "done", True), ("T9__Z", "T9", "Z", "done", None)]


def test_modes_of_collected_cells(spark, tmp_path):
    from pyspark.sql import functions as F

    cells_at(tmp_path)
    runs = collect_experiment(spark, str(tmp_path), *tables(spark))
    cells = runs.select("mode", "correct", "tokens", "cost", F.col("latency_s").alias("latency"), "cost_status", F.size("safety_flags").alias("flags"), "bug_cycles", "side_effects")
    got = {r["mode"]: (r.cells, r.evaluated, r.correct, r.safety_flags, r.bug_cycles, r.side_effects) for r in rollup.mode_rollup(cells).collect()}
    assert got == {"A": (1, 1, 1, 3, 0, 0), "B": (1, 1, 0, 0, 2, 1), "C": (1, 0, 0, 0, 0, 0), "unknown": (2, 0, 0, 0, 0, 0)}


def test_no_experiment(spark, tmp_path):
    assert collect_experiment(spark, str(tmp_path / "none"), *tables(spark)).collect() == []
