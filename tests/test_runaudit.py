"""Every check of the execution audit, each broken alone; nested frames pruned and cleaned."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from teleproof.operators import nested as N
from teleproof.operators import runaudit as A

LIMITS = A.Limits(model="m", url="u", max_requests=4, max_calls=5, context_window=100, reserved_reports=1)


@pytest.fixture(scope="module")
def frames(spark):
    both = [A.QUERY, A.REPORT]
    make = spark.createDataFrame
    return {
        "runs": make([("r", 1, "submitted", True, 4, 5, True, False, 0, 0, 0, both, ["system"])],
                     "run_id string, job_id int, status string, answered boolean, api_requests int, tool_attempts int, same_session boolean, private_exposed boolean, "
                     "n_context_files int, n_skills int, n_extensions int, active_tools array<string>, first_roles array<string>"),
        "requests": make([("r", i, "u", "m", True, 40, 10 + i, "reporting" if i == 4 else "open", i, 4, 5 - i, [A.REPORT] if i == 4 else both) for i in range(1, 5)],
                         "run_id string, index int, url string, model string, thinking_off boolean, max_tokens int, prompt_tokens int, phase string, notice_request int, "
                         "notice_maximum int, notice_left int, tool_names array<string>"),
        "responses": make([("r", i, 200, ["m"], False, 10 + i, 7) for i in range(1, 5)],
                          "run_id string, index int, http_status int, models array<string>, reasoning_seen boolean, prompt_tokens int, completion_tokens int"),
        "emitted": make([("r", "c1"), ("r", "c2")], "run_id string, call_id string"),
        "results": make([("r", "c1", False), ("r", "c2", True)], "run_id string, call_id string, is_error boolean"),
        "calls": make([("r", "c1", None), ("r", "c2", "no such channel")], "run_id string, call_id string, error string"),
    }


def audit(frames, **changed):
    f = {**frames, **changed}
    return A.execution_audit(f["runs"], f["requests"], f["responses"], f["emitted"], f["results"], f["calls"], LIMITS)


def test_a_clean_run_passes_nineteen_kinds(frames):
    found = audit(frames)
    assert A.failed_checks(found).collect() == []
    assert found.select("check").distinct().count() == 19 and found.count() == 11 + 4 * 7 + 2


def second(column, value):
    return lambda df: df.withColumn(column, F.when(F.col("index") == 2, value()).otherwise(F.col(column)))


BROKEN = {
    "request_budget": ("runs", lambda d: d.withColumn("api_requests", F.lit(3))),
    "no_private_context": ("runs", lambda d: d.withColumn("n_skills", F.lit(1))),
    "only_allowed_tools": ("runs", lambda d: d.withColumn("active_tools", F.array(F.lit("bash")))),
    "empty_prior_conversation": ("runs", lambda d: d.withColumn("first_roles", F.array(F.lit("user")))),
    "submission_state_matches": ("runs", lambda d: d.withColumn("answered", F.lit(False))),
    "query_budget": ("runs", lambda d: d.withColumn("tool_attempts", F.lit(6))),
    "same_session_reporting": ("runs", lambda d: d.withColumn("same_session", F.lit(False))),
    "provider_no_thinking": ("requests", second("thinking_off", lambda: F.lit(False))),
    "real_model": ("responses", second("models", lambda: F.array(F.lit("other")))),
    "budget_notice": ("requests", second("notice_left", lambda: F.lit(0))),
    "context": ("requests", second("max_tokens", lambda: F.lit(99))),
    "context_count_consistency": ("responses", second("prompt_tokens", lambda: F.lit(1))),
    "all_tool_events_logged": ("emitted", lambda d: d.limit(1)),
    "tool_error_flag": ("results", lambda d: d.withColumn("is_error", F.lit(True))),
}


@pytest.mark.parametrize("name", sorted(BROKEN))
def test_each_check_alone(frames, name):
    frame, change = BROKEN[name]
    assert {r["check"] for r in A.failed_checks(audit(frames, **{frame: change(frames[frame])})).collect()} == {name}


def test_checks_that_come_together(frames):
    late = frames["requests"].withColumn("phase", F.when(F.col("index") == 2, "reporting").otherwise("open"))
    assert rows_of(A.failed_checks(audit(frames, requests=late)), "check", "item") == [
        ("report_phase_tools", "2"), ("report_phase_tools", "3"), ("report_phase_tools", "4"), ("reserved_tail", "4"),
    ]
    gap = audit(frames, requests=frames["requests"].filter("index <> 2"))
    assert {r["check"] for r in A.failed_checks(gap).collect()} == {"request_budget", "request_sequence", "all_responses_logged"}
    denied = frames["calls"].withColumn("error", F.lit(A.DENIAL + ": report now"))
    assert {r["check"] for r in A.failed_checks(audit(frames, calls=denied)).collect()} == {"no_premature_query_denial", "tool_error_flag"}
    assert audit(frames, requests=frames["requests"].limit(0), responses=frames["responses"].limit(0)).filter("check = 'request_sequence'").first()["passed"]


def test_reports(spark, frames):
    seen = spark.createDataFrame([("r", "o1"), ("r", "o1"), ("r", "o2")], "run_id string, observation_id string")
    none = spark.createDataFrame([], "run_id string, decision string")
    rep = A.run_report(frames["runs"], frames["requests"], frames["responses"], frames["calls"], frames["results"], seen, none)
    r = rep.first()
    assert (r["requests"], r["max_prompt_tokens"], r["input_tokens"], r["output_tokens"]) == (4, 14, 50, 28)
    assert (r["backend_errors"], r["tool_errors"], r["observations"], r["distinct_observations"], r["decision"]) == (1, 1, 3, 2, "pending")
    assert rows_of(A.job_report(rep), "runs", "attempted", "submitted", "queries") == [(1, 1, 1, 5)]
    assert rows_of(A.decision_histogram(rep)) == [(1, "pending", 1)]


def test_nested(spark):
    kind = "id int, s struct<a: double, secret: string, b: array<struct<secret: int, c: array<float>>>>, m map<string, struct<secret: int, d: double>>, secret int"
    df = spark.createDataFrame([
        (1, (math.nan, "x", [(1, [1.0, math.inf]), None]), {"secret": (1, 1.0), "k": (2, -math.inf)}, 5), (2, None, None, None), (3, (1.0, None, None), {"k": None}, 1),
    ], kind)
    gone = N.pruned(df, ["secret"])
    assert "secret" not in N.field_names(gone.schema) and {"a", "b", "c", "d"} <= N.field_names(gone.schema)
    rows = {r["id"]: r.asDict(recursive=True) for r in gone.collect()}
    assert rows[2] == {"id": 2, "s": None, "m": None} and rows[3]["s"] == {"a": 1.0, "b": None} and rows[3]["m"] == {"k": None}
    assert list(rows[1]["m"]) == ["k"] and rows[1]["s"]["b"][1] is None
    clean = {r["id"]: r.asDict(recursive=True) for r in N.cleaned(df).collect()}
    assert clean[1]["s"]["a"] is None and clean[1]["s"]["b"][0] == {"secret": 1, "c": [1.0, None]} and clean[1]["m"]["k"] == {"secret": 2, "d": None}
    assert clean[3]["s"]["a"] == 1.0 and clean[2]["s"] is None
