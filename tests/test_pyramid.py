"""Windows from block summaries against plain loops: statistics, medians by counted pivots, runs."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from teleproof.operators import pyramid as P
from teleproof.operators import windows as W

SPANS = "query_id string, record_id string, start_row bigint, stop_row bigint"


@pytest.fixture
def fan(monkeypatch):
    monkeypatch.setattr(P, "FAN", 4)


def values(seed, n):
    r = random.Random(seed)
    return [None if r.random() < 0.02 else float(r.choice([0, 0, 0, 1, 2, 50])) for _ in range(n)]


def spans(seed, n, k=60):
    r = random.Random(seed)
    out = [(0, n), (0, 1), (n - 1, n), (4, 8), (3, 9), (1, 4**4), (0, 4**5), (n - 3, n + 10**15), (5, 5), (n, n + 1), (17, 18)]
    for _ in range(k):
        a = r.randrange(n)
        out.append((a, a + r.randrange(1, n - a + 2)))
    return [(f"q{i}", "a", a, b) for i, (a, b) in enumerate(out)]


def frame(spark, data):
    return spark.createDataFrame([("a", i, float(i), v) for i, v in enumerate(data)] + [("b", 0, 0.0, 7.0)], "record_id string, row bigint, time_s double, v double")


def test_pieces_tile_every_window(spark, fan):
    asked = [(q, r, a, b) for q, r, a, b in spans(1, 3000) if a < b]
    ends = spark.createDataFrame([("a", 0, 3000)], "record_id string, first_row bigint, end_row bigint")
    cut = P.pieces(spark.createDataFrame(asked, SPANS), ends).collect()
    for q, _, a, b in asked:
        mine = [r for r in cut if r["query_id"] == q]
        rows = []
        for r in mine:
            lo, hi = max(r["_lo"], r["_parent"] * 4), min(r["_hi"], (r["_parent"] + 1) * 4)
            rows += range(lo * 4 ** r["_level"], hi * 4 ** r["_level"])
        assert sorted(rows) == list(range(a, min(b, 3000)))
        assert all(r["_hi"] - r["_lo"] <= 4 or r["_level"] == P.LEVELS for r in mine)


def test_statistics(spark, fan):
    data = values(2, 700)
    rows = frame(spark, data).repartition(3)
    asked = spans(3, 700)
    got = {(r["start_row"], r["stop_row"]): r for r in W.window_stats(rows, spark.createDataFrame(asked, SPANS), ["v"], P.summaries(rows, ["v"])).collect()}
    wanted = {(a, b) for _, _, a, b in asked if a < b and a < 700}
    assert set(got) == wanted
    for a, b in wanted:
        part = [v for v in data[a:b] if v is not None]
        r = got[a, b]
        assert (r["n_rows"], r["n_values"]) == (len(data[a:b]), len(part))
        if part:
            assert (r["min"], r["max"], r["median"]) == (min(part), max(part), statistics.median(part)) and abs(r["mean"] - statistics.mean(part)) < 1e-9
        else:
            assert r["min"] is r["median"] is r["mean"] is None


def test_only_what_is_asked(spark, fan):
    rows = frame(spark, values(4, 50)).withColumn("w", F.col("v") + 1)
    asked = spark.createDataFrame([("a", 0, 50, ["w"], [])], "record_id string, start_row bigint, stop_row bigint, _asked array<string>, _middle array<string>")
    assert [(r["channel"], r["median"]) for r in W.asked_stats(rows, asked, ["v", "w"]).collect()] == [("w", None)]


@pytest.mark.parametrize("make", [lambda r, i: r.random(), lambda r, i: float(r.choice([0, 1, 1, 1, 2])), lambda r, i: 5.0, lambda r, i: float(i)])
def test_medians_by_counted_pivots(spark, make):
    r = random.Random(6)
    data = [make(r, i) for i in range(5001)]
    rows = frame(spark, data).repartition(4)
    asked = [("a", 0, 5001), ("a", 0, 5000), ("a", 17, 3713), ("a", 4096, 4196), ("a", 5, 6)]
    frames = spark.createDataFrame([(*x, ["v"]) for x in asked], "record_id string, start_row bigint, stop_row bigint, _middle array<string>")
    got = {(x["start_row"], x["stop_row"]): x["median"] for x in W.medians(rows, frames, ["v"], batch=50).collect()}
    assert got == {(a, b): statistics.median(data[a:b]) for _, a, b in asked}


def test_any_rank(spark):
    r = random.Random(7)
    data = sorted(float(r.randrange(300)) for _ in range(4000))
    held = spark.createDataFrame([("k", v) for v in data], "k string, v double").repartition(4)
    ranks = [0, 1, 57, 2000, 3998, 3999]
    got = P.ranked_values(held, spark.createDataFrame([("k", i) for i in ranks], "k string, _rank bigint"), ["k"], batch=20)
    assert rows_of(got, "_rank", "value") == sorted(((i, data[i]) for i in ranks), key=repr)


def loop_runs(data, a, b, hit):
    out, start = [], None
    for i in range(a, min(b, len(data)) + 1):
        inside = i < min(b, len(data)) and data[i] is not None and hit(data[i])
        if inside and start is None:
            start = i
        if not inside and start is not None:
            out.append((start, i))
            start = None
    return out


@pytest.mark.parametrize("seed", [8, 9])
def test_runs(spark, fan, seed):
    data = [0.0 if v is None else v for v in values(seed, 700)]
    data[100:380] = [0.0] * 280
    rows, asked = frame(spark, data).repartition(3), [x for x in spans(seed, 700)]
    queries = spark.createDataFrame(asked, SPANS)
    zero = {r["query_id"]: r for r in W.longest_zero_run(rows, queries.withColumn("channels", F.array(F.lit("v"))), ["v"]).collect()}
    more = queries.withColumns({"channel": F.lit("v"), "threshold": F.lit(0.5), "direction": F.lit("below")})
    sustained = {r["query_id"]: r for r in W.first_sustained(rows, more.withColumn("min_records", F.lit(6)), ["v"]).collect()}
    crossing = {r["query_id"]: r for r in W.first_crossing(rows, more.withColumns({"threshold": F.lit(50.0), "direction": F.lit("above")}), ["v"]).collect()}
    for q, _, a, b in asked:
        if a >= b:
            assert {zero[q]["status"], sustained[q]["status"], crossing[q]["status"]} == {"invalid_window"}
            continue
        if b > 700:
            assert {zero[q]["status"], sustained[q]["status"], crossing[q]["status"]} == {"outside_record"}
            continue
        runs = loop_runs(data, a, b, lambda v: v == 0)
        best = max(runs, key=lambda x: (x[1] - x[0], -x[0]), default=(None, None))
        assert (zero[q]["run_start"], zero[q]["run_stop"]) == best and zero[q]["value"] == (best[1] - best[0] if runs else 0)
        assert zero[q]["run_start_offset_s"] == (None if not runs else float(best[0] - a))
        onset = next((x for x, y in runs if y - x >= 6), None)
        assert sustained[q]["onset_row"] == onset and sustained[q]["value"] == (None if onset is None else float(onset - a))
        first = next((i for i in range(a, b) if data[i] >= 50), None)
        assert (crossing[q]["status"], crossing[q]["value"]) == (("not_reached", None) if first is None else ("ok", float(first - a)))


def test_time_and_missing_readings_refuse(spark, fan):
    data = [1.0] * 100
    data[40] = None
    rows = frame(spark, data).withColumn("time_s", F.when(F.col("row") == 70, 69.0).otherwise(F.col("time_s")))
    asked = [("q0", "a", 0, 40), ("q1", "a", 0, 41), ("q2", "a", 41, 70), ("q3", "a", 41, 71), ("q4", "a", 70, 100), ("q5", "c", 0, 5)]
    queries = spark.createDataFrame(asked, SPANS).withColumns({"channel": F.lit("v"), "threshold": F.lit(0.5), "direction": F.lit("above"), "min_records": F.lit(3)})
    found = dict(rows_of(W.first_sustained(rows, queries, ["v"]), "query_id", "status"))
    assert found == {"q0": "ok", "q1": "missing_values", "q2": "ok", "q3": "time_not_strictly_increasing", "q4": "ok", "q5": "outside_record"}
