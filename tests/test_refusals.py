"""Inputs that must be refused, kept or found: odd numbers, folded letters, hostile windows, one-sided keys, broken request lines."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from teleproof.functions import scalar as S
from teleproof.operators import catalog as C
from teleproof.operators import packages as P
from teleproof.operators import release as R
from teleproof.operators import windows as W
from teleproof.streaming.requests import answer_lines
from conftest import rows_of


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("token, want", [
    ("5d", "not_a_number"), ("1.5f", "not_a_number"), ("0x1p3", "not_a_number"), ("1_0", "not_a_number"), ("inf", "non_finite"),
    ("1e999", "non_finite"), (" 1.5e-3 ", "ok"), (".5", "ok"), ("5.", "ok"), ("NaN", "missing"),
])
def test_numbers(spark, token, want):
    assert one(spark, S.number_status(F.lit(token))) == want


def test_time_patterns(spark):
    assert one(spark, S.parse_time(F.lit("1970-01-01T00:01:05Z"), pattern="%Y-%m-%dT%H:%M:%SZ")) == 65.0
    assert one(spark, S.parse_time(F.lit("day 1970-01-02"), pattern="day %Y-%m-%d")) == 86_400.0
    assert one(spark, S.parse_time(F.lit("5d"), kind="seconds")) is None
    with pytest.raises(ValueError):
        S.spark_pattern("%Q")


@pytest.mark.parametrize("a, b", [("ΟΔΟΣ", "οδοσα"), ("Straße", "STRASSE"), ("ﬁle", "FILE")])
def test_folding(spark, a, b):
    a, b = (one(spark, S.fold_case(F.lit(x))) for x in (a, b))
    assert b.startswith(a)


def test_leak_under_folding(spark):
    docs = spark.createDataFrame([(1, "a ΟΔΟΣ b"), (2, "so ΟΔΟΣΑ here"), (3, "none")], "doc_id long, text string")
    tokens = spark.createDataFrame([(1, "ΟΔΟΣ")], "token_id long, token string")
    assert {r["doc_id"] for r in R.leak_hits(docs, tokens).collect()} == {1, 2}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([("r", i, float(i), None if i == 7 else float(i % 3)) for i in range(10)], "record_id string, row bigint, time_s double, P_SA double")


def test_hostile_window(spark, rows):
    asked = spark.createDataFrame([("q", "r", 0, 10**15, "P_SA", "mean")], "query_id string, record_id string, start_row bigint, stop_row bigint, channel string, stat string")
    assert [r["status"] for r in W.stat_queries(rows, asked, ["P_SA"]).collect()] != ["ok"]


def test_missing_readings_are_refused(spark, rows):
    asked = spark.createDataFrame([("q", "r", 0, 10), ("p", "r", 0, 5)], "query_id string, record_id string, start_row bigint, stop_row bigint")
    runs = W.longest_zero_run(rows, asked.withColumn("channels", F.array(F.lit("P_SA"))), ["P_SA"])
    assert rows_of(runs, "query_id", "status", "value") == [("p", "ok", 1), ("q", "missing_values", None)]
    first = asked.withColumns({"channel": F.lit("P_SA"), "threshold": F.lit(0.5), "min_records": F.lit(2), "direction": F.lit("above")})
    assert rows_of(W.first_sustained(rows, first, ["P_SA"]), "query_id", "status", "onset_row") == [("p", "ok", 1), ("q", "missing_values", None)]


def test_duplicates_without_members(spark):
    tasks = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "a")], "task long, kind string")
    members = spark.createDataFrame([(3, "m"), (4, "m")], "task long, member string")
    got = C.structural_duplicates(tasks, members, "task", ["kind"], "member")
    assert rows_of(got, "first", "n") == [(1, 2), (3, 2)]
    checks = spark.createDataFrame([(3, "c")], "task long, what string")
    assert rows_of(C.structural_duplicates(tasks, members, "task", ["kind"], "member", checks, "what"), "first", "n") == [(1, 2)]


def test_one_sided_keys_are_changes(spark):
    before = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x")], "id string, v long, unit string")
    after = spark.createDataFrame([("a", 1, "y"), ("c", 1, "x")], "id string, v long, unit string")
    assert rows_of(R.changed_only_in(before, after, "id", "unit"), "id", "allowed") == [("a", True), ("b", False), ("c", False)]


def test_recompute_covers_every_fact(spark):
    rows = spark.createDataFrame([("r", i, float(i // 2), float(i)) for i in range(6)], "record_id string, row bigint, time_s double, P_SA double")
    packs = spark.createDataFrame(
        [("p", "r", 2, 4, 0, 6, True, True, ["P_SA"], 1)],
        "package_id string, record_id string, group_start bigint, group_stop bigint, context_start bigint, context_stop bigint, "
        "has_before boolean, has_after boolean, channels array<string>, n_events bigint",
    )
    facts = P.package_measures(rows, packs, ["P_SA"])
    got = P.recompute(rows, packs, facts, ["P_SA"]).collect()
    assert len(got) == 7 and all(r["agrees"] for r in got)
    assert {r["fact"]: r["recomputed"] for r in got}["duplicate_count"] == 3.0 and {r["fact"]: r["recomputed"] for r in got}["delta"] == 4.0
    gone = facts.withColumn("package_id", F.lit("other"))
    assert not any(r["agrees"] for r in P.recompute(rows, packs, gone, ["P_SA"]).collect())


def test_request_lines(spark, rows):
    base = {"query_id": "q", "record_id": "r", "op": "read", "start_row": 0, "stop_row": 3, "channels": ["P_SA"]}
    lines = [json.dumps(base), json.dumps({**base, "query_id": "x", "secret": 1}), "{broken", json.dumps([1])]
    got = answer_lines(rows, spark.createDataFrame([(x,) for x in lines], "value string"), ["P_SA"], T.StringType()).collect()
    found = {r["query_id"]: r["status"] for r in got}
    assert len(found) == 4 and found["q"] == "ok" and found["x"] == "unknown_fields"
    assert sorted(s for k, s in found.items() if k.startswith("line_")) == ["malformed_line", "malformed_line"]
