"""Reviews by parts, finalisation, publication, bundles, declared sources, set digests, bound recomputation and scoped tools on hand-made frames."""

from __future__ import annotations

import pytest

from conftest import rows_of
from teleproof.operators import catalog as C
from teleproof.operators import packages as P
from teleproof.operators import release as R
from teleproof.operators import scoped as S

PARTS = ["proposal", "public", "material", "rubric"]


def test_a_review_binds_by_all_its_parts(spark):
    now = [("a", "1", "1", "1", "1"), ("b", "1", "1", "1", "1"), ("c", "1", "1", "1", "1"), ("d", "1", None, "1", "1"), ("e", "1", "1", "1", "1"), ("f", "1", "1", "1", "1")]
    items = spark.createDataFrame(now, "id string, proposal string, public string, material string, rubric string")
    reviews = spark.createDataFrame([
        ("a", "accept", 0, "read", "1", "1", "1", "1"), ("b", "accept", 0, "read", "0", "1", "1", "2"), ("c", "accept", 1, "read", "1", "1", "1", "1"),
        ("d", "accept", None, "read", "1", None, "1", "1"), ("f", "accept", 0, " ", "1", "1", "1", "1"), ("e", "accept", 0, "x", "1", "1", "1", "1"), ("e", "reject", 0, "x", "1", "1", "1", "1"),
    ], "id string, decision string, blocking_issues int, rationale string, proposal string, public string, material string, rubric string")
    bound = R.bound_parts(items, reviews, "id", PARTS)
    assert rows_of(bound, "id", "status", "stale") == [
        ("a", "bound", ""), ("b", "stale", "proposal,rubric"), ("c", "not_accepted", ""), ("d", "bound", ""), ("e", "repeated", ""), ("f", "not_accepted", ""),
    ]
    missing = R.bound_parts(items, reviews.limit(0), "id", PARTS)
    assert {r["status"] for r in missing.collect()} == {"missing"}
    checked = spark.createDataFrame([("a", True, "1", "1", False), ("d", True, "0", "1", False)], "id string, all_passed boolean, material string, rubric string, sources_changed boolean")
    found = R.finalised(bound, checked, items, "id", ["material", "rubric"])
    assert dict(rows_of(found, "id", "outcome")) == {
        "a": "final", "b": "review_stale", "c": "review_not_accepted", "d": "verification_stale", "e": "review_repeated", "f": "review_not_accepted",
    }


@pytest.mark.parametrize("broken, rule", [
    ({}, None), ({"position": [1, 3]}, "out_of_order"), ({"fields": ["title", "answer"]}, "unexpected_fields"), ({"content": "z"}, "differs_from_approved"),
    ({"origins": ["T01", "T02", "T02"]}, "provenance_count_differs"), ({"origins": ["T01", "T02", "T09"]}, "provenance_without_task"),
])
def test_publication(spark, broken, rule):
    position, fields, content = broken.get("position", [1, 2]), broken.get("fields", ["task_id", "title"]), broken.get("content", "b")
    tasks = spark.createDataFrame([("T01", position[0], "a", ["title", "task_id"]), ("T02", position[1], content, fields)], "task_id string, position bigint, content string, fields array<string>")
    origins = spark.createDataFrame([(t,) for t in broken.get("origins", ["T01", "T02"])], "task_id string")
    approved = spark.createDataFrame([("T01", "a"), ("T02", "b")], "task_id string, content string")
    assert {r["rule"] for r in R.publication_gates(tasks, origins, ["title", "task_id"], approved).collect()} == ({rule} if rule else set())


def bundle(spark, **changed):
    frames = {
        "tasks": ([("t1", "b", "k", True, 1), ("t2", "b", "k", False, 0)], "task_id string, bundle_id string, task_type string, guided boolean, n_decisions int"),
        "cited": ([("t1", "f1"), ("t2", "f2")], "task_id string, fact_id string"), "facts": ([("b", "f1"), ("b", "f2")], "bundle_id string, fact_id string"),
        "checks": ([("t1", "x", "f1"), ("t2", "x", "f2")], "task_id string, answer_key string, fact_id string"),
        "reviews": ([("b", "t1", "accept", 0), ("b", "t2", "revise", 2)], "bundle_id string, task_id string, decision string, n_blocking int"),
    }
    made = {k: spark.createDataFrame(changed.get(k, rows), kind) for k, (rows, kind) in frames.items()}
    return {r["rule"] for r in C.bundle_gates(**made).collect()}


def test_bundles(spark):
    assert bundle(spark) == set()
    assert bundle(spark, tasks=[("t1", "b", "k", True, 0), ("t2", "b", "k", False, 0)]) == {"investigation_without_decisions"}
    assert bundle(spark, cited=[("t1", "f1"), ("t2", "f1")], checks=[("t1", "x", "f1"), ("t2", "y", "f1")]) == {"repeated_structure"}
    assert bundle(spark, checks=[("t1", "x", "f1"), ("t1", "x", "f1"), ("t2", "x", "f2")]) == {"repeated_answer_key"}
    assert bundle(spark, checks=[("t1", "x", "f9"), ("t2", "x", "f2")]) == {"unknown_fact"}
    assert bundle(spark, cited=[("t1", "f1")], checks=[("t1", "x", "f1")]) == {"no_evidence"}
    assert bundle(spark, reviews=[("b", "t1", "accept", 0)]) == {"not_reviewed"}
    assert bundle(spark, reviews=[("b", "t1", "basic_only", 1), ("b", "t2", "revise", 0), ("b", "t2", "accept", 0), ("b", "t3", "accept", 0)]) == {
        "blocking_issue_overridden", "reviewed_more_than_once", "review_of_unknown_task",
    }


def test_facts_lie_in_declared_sources(spark):
    cases = spark.createDataFrame([("c", "draft", None, "h", None, None)], "case_id string, status string, decision string, content_sha string, reviewed_sha string, merge_into string")
    facts = spark.createDataFrame([("c", "f", "s1", 0, 5)], "case_id string, fact_id string, source_id string, start_row long, stop_row long")
    windows = spark.createDataFrame([("c", "s2", 0, 5)], "case_id string, source_id string, start_row long, stop_row long")
    claims = spark.createDataFrame([], "case_id string, claim_id string, verdict string, fact_id string")
    sources = spark.createDataFrame([("s1", 9), ("s2", 9), ("s3", 9)], "source_id string, n_rows long")
    declared = lambda *s: spark.createDataFrame([("c", x) for x in s], "case_id string, source_id string")
    held = spark.createDataFrame([("c", "s1", "row"), ("c", "s2", "row")], "case_id string, source_id string, alignment string")

    def rules(*s):
        return {r["rule"] for r in C.case_gates(cases, facts, claims, sources, held, windows, declared(*s)).collect()}

    # A declared source that only a window uses is covered; an undeclared one is not, though it is known.
    assert rules("s1", "s2") == set()
    assert rules("s1") == {"undeclared_source", "artifact_coverage"}
    assert rules("s1", "s2", "s3") == {"artifact_coverage"}


def test_set_digest_of_a_million_members(spark):
    members = spark.range(1_000_000).selectExpr("0L AS task", "id AS m").union(spark.range(1_000_000).selectExpr("1L", "999999 - id")).union(spark.range(999_999).selectExpr("2L", "id"))
    digests = dict(rows_of(C.set_digest(members.repartition(7), "task", "m", "d"), "task", "d"))
    assert digests[0] == digests[1] != digests[2]
    plan = C.set_digest(members, "task", "m", "d")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_recomputation_is_bound_to_the_snapshot(spark):
    rows = spark.createDataFrame([(r, i, float(i), float(i)) for r in ("r", "s") for i in range(6)], "record_id string, row bigint, time_s double, P_SA double")
    kind = "package_id string, record_id string, group_start bigint, group_stop bigint, context_start bigint, context_stop bigint, has_before boolean, has_after boolean, channels array<string>, n_events bigint"
    packs = spark.createDataFrame([(f"p{r}", r, 2, 4, 0, 6, True, True, ["P_SA"], 1) for r in "rst"], kind)
    facts = spark.createDataFrame([(f"p{r}", r, "P_SA", "max", 5.0, "ok") for r in "rst"], "package_id string, record_id string, channel string, fact string, value double, status string")
    late = rows.selectExpr("record_id", "row", "time_s", "if(record_id = 's' and row = 0, 0.5, P_SA) AS P_SA")
    got = P.recompute_bound(late.repartition(3), packs, facts, ["P_SA"], P.content_snapshots(rows))
    assert rows_of(got, "record_id", "snapshot", "recomputed", "agrees") == [("r", "ok", 5.0, True), ("s", "source_snapshot_changed", None, False), ("t", "unknown_source", None, False)]


def test_scoped_tools_refuse_in_order(spark):
    rows = spark.createDataFrame([("r", i, float(i if i != 7 else 6), float(i)) for i in range(20)], "record_id string, row bigint, time_s double, P double").selectExpr("*", "P + 1 AS Q")
    tasks = spark.createDataFrame([("t", "r", 5, 15, ["P"], ["read_window", "check_time_axis", "compare_windows", "submit_report"])],
                                  "task_id string, record_id string, first_row bigint, end_row bigint, channels array<string>, tools array<string>")
    names = ["request_id", "task_id", "seq", "tool", *[c for r in S.RANGES for c in r], "channels", "channel", "stat", "threshold", "direction"]
    kind = "request_id string, task_id string, seq int, tool string, start_row long, stop_row long, before_start long, before_stop long, after_start long, after_stop long, channels array<string>, channel string, stat string, threshold double, direction string"
    asked = [
        dict(tool="read_window", start_row=5, stop_row=8, channels=["P"]), dict(tool="check_time_axis", start_row=5, stop_row=10),
        dict(tool="compare_windows", before_start=5, before_stop=7, after_start=8, after_stop=10, channel="P"), dict(tool="read_window", start_row=5, stop_row=8, channels=["Q"]),
        dict(tool="read_window", start_row=4, stop_row=8, channels=["P"]), dict(tool="read_window", start_row=8, stop_row=8, channels=["P"]), dict(tool="read_window", start_row=5, stop_row=8, channels=[]),
        dict(tool="summarize_window", start_row=5, stop_row=8, channel="P", stat="mean"), dict(tool="submit_report"), dict(tool="check_time_axis", start_row=5, stop_row=10),
    ]
    made = [tuple({"request_id": f"q{i}", "task_id": "t", "seq": i, **a}.get(n) for n in names) for i, a in enumerate(asked)]
    answers, read, pairs = S.answer_tools(rows, spark.createDataFrame(made, kind), tasks, ["P", "Q"])
    found = {r["request_id"]: (r["status"], r["value"]) for r in answers.collect()}
    assert found == {
        "q0": ("ok", 3.0), "q1": ("ok", 1.0), "q2": ("ok", 3.0), "q3": ("channel_outside_scope", None), "q4": ("window_outside_scope", None), "q5": ("invalid_window", None),
        "q6": ("channel_outside_scope", None), "q7": ("tool_not_allowed", None), "q8": ("ok", None), "q9": ("task_submitted", None),
    }
    assert rows_of(read, "request_id", "row", "time_offset", "channel", "reading") == [("q0", 5, 0.0, "P", 5.0), ("q0", 6, 1.0, "P", 6.0), ("q0", 7, 1.0, "P", 7.0)]
    assert rows_of(pairs) == [("q1", 6, 7)]
