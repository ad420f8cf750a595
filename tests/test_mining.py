"""The 60-row experiment: candidates, groups, packages and facts known by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from teleproof.operators import cycles as C
from teleproof.operators import quality as Q
from teleproof.operators import windows as W
from teleproof.operators.detect import ChannelRule, MiningConfig, candidates
from teleproof.plans.jobs import build_material, mine

CHANNELS = ["P_Load1", "I_Load1", "U_Load1", "U_Bus", "T_Load1"]


def config(block=None):
    return MiningConfig(
        channels={"P_Load1": ChannelRule(5, 30, 0.1), "T_Load1": ChannelRule(25, 80, 0.1)}, context=["Load_Signal"],
        zero_channels=CHANNELS, window_rows=4, noise_multiplier=8, min_zero_rows=3, group_gap_rows=2, max_group_span_rows=12,
        context_rows=6, context_channels=CHANNELS, max_channels=6, block_rows=block,
    )


@pytest.fixture(scope="module")
def rows(spark):
    data = []
    for i in range(60):
        dead = 45 <= i <= 50
        data.append((
            "exp", i, float(39 if i == 40 else i), 15.0 if i < 20 else 0.0, 1.25 if i < 20 else 0.0, 0.0 if dead else 12.0,
            0.0 if dead else 28.0, 210.0 if i == 35 else 0.0 if dead else 42.0, "1" if i < 20 else "0",
        ))
    names = ", ".join(f"{c} double" for c in CHANNELS)
    return spark.createDataFrame(data, f"record_id string, row bigint, time_s double, {names}, Load_Signal string").cache()


@pytest.mark.parametrize("block", [None, 6, 9])
def test_candidates(rows, block):
    got = rows_of(candidates(rows, config(block)), "start_row", "stop_row", "detector", "channel", order=lambda t: t[:3])
    assert got == [
        (18, 19, "median_step", "P_Load1"), (20, 21, "context_transition", None), (35, 36, "isolated_spike", "T_Load1"),
        (39, 41, "repeated_time", None), (44, 45, "median_step", "T_Load1"),
        (45, 51, "all_selected_channels_zero", ",".join(CHANNELS)), (50, 51, "median_step", "T_Load1"),
    ]


@pytest.mark.parametrize("block", [None, 7])
def test_groups_packages_and_facts(rows, block):
    mined = mine(rows, config(block))
    assert rows_of(mined.groups, "start_row", "stop_row", "n_events") == [(18, 21, 2), (35, 36, 1), (39, 41, 1), (44, 51, 3)]
    spans = rows_of(mined.packages, "group_start", "context_start", "context_stop", "has_before", "has_after")
    assert spans == [(18, 12, 27, True, True), (35, 29, 42, True, True), (39, 33, 47, True, True), (44, 38, 57, True, True)]
    assert [r["count"] for r in mined.facts.groupBy("package_id").count().collect()] == [31] * 4
    first = {r["fact"]: r["value"] for r in mined.facts.filter("group_start = 18 AND channel = 'P_Load1'").collect()}
    assert first == {"mean_context": 8.0, "mean_before": 15.0, "mean_after": 0.0, "delta": -15.0, "min": 0.0, "max": 15.0}
    repeats = rows_of(mined.facts.filter("fact = 'duplicate_count'"), "group_start", "value")
    assert repeats == [(18, 0.0), (35, 1.0), (39, 1.0), (44, 1.0)]
    assert mined.unavailable.count() == 0
    assert mined.facts.select("fact_id").distinct().count() == 4 * 31


def test_budget_leaves_the_rest_visible(rows):
    mined = mine(rows, config(), max_cases=3)
    assert rows_of(mined.groups, "start_row", "processed") == [(18, True), (35, True), (39, True), (44, False)]
    assert mined.packages.count() == 3


def test_a_missing_reading_makes_facts_unavailable(rows):
    holed = rows.withColumn("P_Load1", F.when(F.col("row") == 24, None).otherwise(F.col("P_Load1")))
    mined = mine(holed, config())
    gone = rows_of(mined.unavailable.filter("channel = 'P_Load1'"), "group_start", "fact", "status")
    assert gone == [(18, f, "missing_values") for f in ("delta", "max", "mean_after", "mean_context", "min")]


def test_scalars(spark, rows):
    asked = spark.createDataFrame(
        [("exp", 0, 10, "P_Load1", s) for s in W.STATS], "record_id string, start_row bigint, stop_row bigint, channel string, stat string"
    )
    got = {r["stat"]: r["value"] for r in W.stat_queries(rows, asked, CHANNELS).collect()}
    assert got == {"mean": 15.0, "median": 15.0, "min": 15.0, "max": 15.0, "count": 10.0}
    pair = spark.createDataFrame(
        [("p", "exp", "P_Load1", 0, 10, 25, 30)],
        "pair_id string, record_id string, channel string, before_start bigint, before_stop bigint, after_start bigint, after_stop bigint",
    )
    assert W.window_deltas(rows, pair, CHANNELS).first()["value"] == -15.0
    whole = spark.createDataFrame([("exp", 0, 60)], "record_id string, start_row bigint, stop_row bigint")
    assert Q.duplicate_times(rows, whole).first()["value"] == 1
    cross = spark.createDataFrame(
        [("a", "exp", 0, 30, "P_Load1", 1.0, "below"), ("b", "exp", 0, 60, "P_Load1", 1.0, "below"), ("c", "exp", 0, 30, "P_Load1", 99.0, "above")],
        "query_id string, record_id string, start_row bigint, stop_row bigint, channel string, threshold double, direction string",
    )
    assert rows_of(W.first_crossing(rows, cross, CHANNELS), "query_id", "status", "value") == [
        ("a", "ok", 20.0), ("b", "time_not_strictly_increasing", None), ("c", "not_reached", None)
    ]


def test_material_job(rows):
    material = build_material(rows, [("on", 0, 20), ("off", 20, 40)], ["P_Load1"], ["mean", "max"])
    assert material.catalog.first()["rows"] == 60
    assert rows_of(material.facts, "region", "stat", "value") == [
        ("off", "max", 0.0), ("off", "mean", 0.0), ("on", "max", 15.0), ("on", "mean", 15.0)
    ]


@pytest.mark.parametrize("block", [2, 5, 1000])
def test_cycles(spark, block):
    irradiation = [5, 5, 0, 0, 5, 0, 5, 5, 0]
    df = spark.createDataFrame([("s", i, float(i), v) for i, v in enumerate(irradiation)], "record_id string, row bigint, time_s double, g int")
    cycled = C.with_cycles(df, F.col("g") > 0, block)
    assert rows_of(C.cycle_segments(cycled), "cycle", "start_row", "stop_row") == [(1, 0, 4), (2, 4, 6), (3, 6, 9)]
    assert rows_of(C.phase_intervals(cycled, F.col("g") == 0, 1), "cycle", "start_row", "stop_row") == [(1, 2, 4), (2, 5, 6), (3, 8, 9)]
    runs = C.active_runs(cycled, [("b", F.col("g") > 0, 1.0)], 2)
    assert rows_of(runs, "cycle", "start_row", "stop_row", "start_minus_nominal_s", "span_s") == [(1, 0, 2, -1.0, 1.0), (3, 6, 8, -1.0, 1.0)]
