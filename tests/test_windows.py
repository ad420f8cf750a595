"""Irregular-time record, free windows and paging."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from teleproof.operators import windows as W
from teleproof.operators.quality import conflict_examples, quality_profile
from teleproof.operators.queries import query_schema, run_queries

TIMES = [0.0, 1.0, 3.0, 4.0, 5.0, 7.0]
P = [0.0, 5.0, 6.0, 7.0, 8.0, 0.0]
I = [0.0, 2.0, 2.0, 2.0, 2.0, 0.0]
NAMES = ["P_SA", "I_Load1"]


def frame(spark, times=TIMES, p=P, i=I):
    data = [("r", 10 + n, t, a, b) for n, (t, a, b) in enumerate(zip(times, p, i))]
    return spark.createDataFrame(data, "record_id string, row bigint, time_s double, P_SA double, I_Load1 double")


def sustained(spark, threshold, k=3, direction="above"):
    return spark.createDataFrame(
        [("q", "r", 10, 16, "P_SA", float(threshold), k, direction)],
        "query_id string, record_id string, start_row bigint, stop_row bigint, channel string, threshold double, min_records int, direction string",
    )


def window(spark, a=10, b=16):
    return spark.createDataFrame([("r", a, b)], "record_id string, start_row bigint, stop_row bigint")


def test_sustained(spark):
    rows = frame(spark)
    pick = ("status", "value", "onset_row")
    assert rows_of(W.first_sustained(rows, sustained(spark, 5), NAMES), *pick) == [("ok", 3.0, 12)]
    assert rows_of(W.first_sustained(rows, sustained(spark, 20), NAMES), *pick) == [("ok", None, None)]
    assert rows_of(W.first_sustained(rows, sustained(spark, 8, 1, "below"), NAMES), *pick) == [("ok", 0.0, 10)]
    assert rows_of(W.first_sustained(rows, sustained(spark, 6, 3, "below"), NAMES), *pick) == [("ok", None, None)]


def test_repeated_time(spark):
    rows = frame(spark, times=[0.0, 1.0, 1.0, 4.0, 5.0, 7.0])
    refused = W.first_sustained(rows, sustained(spark, 5), NAMES).first()
    assert (refused["status"], refused["value"]) == ("time_not_strictly_increasing", None)
    assert W.first_sustained(rows, sustained(spark, 5), NAMES, strict_time=False).first()["onset_row"] == 12
    q = quality_profile(rows, window(spark), NAMES).first()
    assert (q["duplicate_extra_rows"], q["conflicting_timestamp_groups"], q["conflict_channels"]) == (1, 1, ["P_SA"])
    assert rows_of(conflict_examples(rows, NAMES), "time_s", "first_row", "n_rows") == [(1.0, 11, 2)]


def test_quality(spark):
    q = quality_profile(frame(spark), window(spark), NAMES).first()
    assert (q["rows"], q["gaps_gt_1s"], q["max_gap_s"], q["elapsed_span_s"], q["time_reversals"]) == (6, 2, 2.0, 7.0, 0)
    back = quality_profile(frame(spark, times=[5.0, 4.0, 3.0, 2.0, 1.0, 0.0]), window(spark), NAMES).first()
    assert (back["time_reversals"], back["max_gap_s"], back["elapsed_span_s"]) == (5, -1.0, -5.0)
    one = quality_profile(frame(spark), window(spark, 12, 13), NAMES).first()
    assert (one["rows"], one["max_gap_s"]) == (1, 0.0)


def test_zero_run_earliest_wins(spark):
    v = [0.0, 0.0, 9.0, 0.0, 0.0, 9.0]
    rows = frame(spark, p=v, i=v)
    asked = window(spark).withColumns({"query_id": F.lit("q"), "channels": F.array(*[F.lit(c) for c in NAMES])})
    got = W.longest_zero_run(rows, asked, NAMES).first()
    assert (got["value"], got["run_start"], got["run_stop"], got["run_start_offset_s"]) == (2, 10, 12, 0.0)


def test_slices(spark):
    rows = frame(spark, times=[0.0, 10.0, 40.0, 41.0, 90.0, 100.0])
    assert rows_of(W.slice_last_seconds(rows, 60), "status", "slice_start", "slice_stop") == [("ok", 13, 16)]
    falling = frame(spark, times=[0.0, 10.0, 5.0, 41.0, 90.0, 100.0])
    assert rows_of(W.slice_last_seconds(falling, 60), "status", "slice_start") == [("time_decreases", None)]
    onset = W.first_sustained(frame(spark), sustained(spark, 5), NAMES)
    assert rows_of(W.slice_around_onset(onset, 2, 4), "side", "status") == [("after", "ok"), ("before", "ok")]
    assert rows_of(W.slice_around_onset(onset, 3, 5), "side", "status") == [("after", "exceeds_window"), ("before", "exceeds_window")]
    none = W.first_sustained(frame(spark), sustained(spark, 20), NAMES)
    assert rows_of(W.slice_around_onset(none, 2, 2), "side", "status") == [("after", "no_onset"), ("before", "no_onset")]


def test_profile_edges(spark):
    asked = window(spark).withColumns({"query_id": F.lit("q"), "bins": F.lit(4)})
    assert rows_of(W.profile_bins(frame(spark), asked, ["P_SA"]), "bin_start", "bin_stop") == [(10, 11), (11, 13), (13, 14), (14, 16)]
    many = window(spark).withColumns({"query_id": F.lit("q"), "bins": F.lit(64)})
    assert W.profile_bins(frame(spark), many, ["P_SA"]).count() == 6


def test_paging(spark):
    rows = spark.range(600).selectExpr("'r' AS record_id", "id + 10 AS row", "double(id) AS time_s", "double(id) AS v")
    page = W.paged_read(rows, window(spark, 10, 610), ["v"])
    assert page.count() == 512 and page.select("next_start_row", "requested_stop_row").distinct().collect() == [(522, 610)]


def ask(**fields):
    base = dict.fromkeys(query_schema().fieldNames())
    return tuple({**base, "record_id": "r", "start_row": 10, "stop_row": 16, **fields}.values())


def test_query_gates_and_answers(spark):
    from pyspark.sql import types as T

    asked = [
        ask(query_id="mean", op="stat", start_row=11, stop_row=13, channel="P_SA", stat="mean"),
        ask(query_id="max", op="stat", channel="P_SA", stat="max"),
        ask(query_id="onset", op="first_sustained", channel="P_SA", threshold=5.0, min_records=3, direction="above"),
        ask(query_id="gaps", op="quality", metric="gaps_gt_1s"),
        ask(query_id="zeros", op="longest_zero_run", channels=["P_SA"]),
        ask(query_id="bins", op="profile", channels=["P_SA"], bins=64),
        ask(query_id="read", op="read", channels=["P_SA"]),
        ask(query_id="x_record", op="stat", record_id="z", channel="P_SA", stat="max"),
        ask(query_id="x_low", op="stat", start_row=9, channel="P_SA", stat="max"),
        ask(query_id="x_high", op="stat", stop_row=17, channel="P_SA", stat="max"),
        ask(query_id="x_empty", op="stat", stop_row=10, channel="P_SA", stat="max"),
        ask(query_id="x_channel", op="stat", channel="p_sa", stat="max"),
        ask(query_id="x_extra", op="stat", channel="P_SA", stat="max", bins=3),
        ask(query_id="x_missing", op="quality"),
        ask(query_id="x_op", op="eval"),
        ask(query_id="x_stat", op="stat", channel="P_SA", stat="mode"),
        ask(query_id="x_twice", op="read", channels=["P_SA", "P_SA"]),
    ]
    queries = spark.createDataFrame(asked, query_schema(T.StringType()))
    got = {r["query_id"]: r for r in run_queries(frame(spark), queries, NAMES).collect()}
    assert len(got) == len(asked)
    values = {k: r["value"] for k, r in got.items() if r["status"] == "ok"}
    assert values == {"mean": 5.5, "max": 8.0, "onset": 3.0, "gaps": 2.0, "zeros": 1.0, "bins": 6.0, "read": 6.0}
    refused = {k: r["status"] for k, r in got.items() if r["status"] != "ok"}
    assert refused == {
        "x_record": "unknown_record", "x_low": "window_outside_record", "x_high": "window_outside_record", "x_empty": "window_outside_record",
        "x_channel": "undeclared_or_repeated_channel", "x_extra": "unexpected_or_missing_fields", "x_missing": "unexpected_or_missing_fields",
        "x_op": "unknown_operation", "x_stat": "value_out_of_range", "x_twice": "undeclared_or_repeated_channel",
    }


def test_requests_from_a_stream(spark, tmp_path):
    from pyspark.sql import types as T

    from teleproof.streaming.requests import answer_requests

    inbox, outbox = tmp_path / "in", tmp_path / "out"
    inbox.mkdir()
    (inbox / "a.json").write_text(
        '{"query_id":"q1","record_id":"r","op":"stat","start_row":11,"stop_row":13,"channel":"P_SA","stat":"mean"}\n'
        '{"query_id":"q2","record_id":"r","op":"sort","start_row":11,"stop_row":13}\n'
    )
    query = answer_requests(spark, frame(spark), NAMES, str(inbox), str(outbox), str(tmp_path / "ckpt"), T.StringType())
    assert query.awaitTermination(120) is not False
    got = rows_of(spark.read.parquet(str(outbox)), "query_id", "status", "value")
    assert got == [("q1", "ok", 5.5), ("q2", "unknown_operation", None)]


def test_null_guard_and_bounded_read(spark):
    rows = frame(spark).withColumn("P_SA", F.when(F.col("row") == 12, None).otherwise(F.col("P_SA")))
    asked = window(spark).withColumns({"channel": F.lit("P_SA"), "stat": F.lit("mean")})
    assert rows_of(W.stat_queries(rows, asked, NAMES), "status", "value") == [("missing_values", None)]
    read = window(spark, 11, 14).withColumns({"query_id": F.lit("q"), "origin_row": F.lit(10).cast("bigint")})
    assert rows_of(W.bounded_read(rows, read, NAMES), "status", "row", "time_offset") == [("ok", 11, 1.0), ("ok", 12, 3.0), ("ok", 13, 4.0)]
    assert rows_of(W.bounded_read(rows, read, NAMES, cap=2), "status", "row") == [("size_cap", None)]


def test_phases(spark):
    rows = frame(spark)
    assert rows_of(W.single_phase(rows, F.col("P_SA") == 0), "status", "n_rows") == [("not_contiguous", 2)]
    assert rows_of(W.single_phase(rows, F.col("P_SA") > 5), "status", "start_row", "stop_row") == [("one_phase", 12, 15)]
    assert rows_of(W.single_phase(rows, F.col("P_SA") > 50), "status", "n_rows") == [("absent", 0)]
