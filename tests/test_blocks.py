"""Block-wise operators against plain loops, with blocks far smaller than the records."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from teleproof.operators import blocks as B
from teleproof.operators import windows as W
from teleproof.operators.greedy import pack, thin
from teleproof.operators.numbering import in_order, number_rows


def record(spark, values, name="a", column="v"):
    return spark.createDataFrame([(name, i, v) for i, v in enumerate(values)], f"record_id string, row bigint, {column} double")


def test_number_rows(spark):
    rng = random.Random(1)
    data = [(rng.choice(["a", "a", "b", None]), rng.choice([0.0, 1.0, 2.5, 7.0, 1e12, None]), i) for i in range(900)]
    df = spark.createDataFrame(data, "record_id string, time_s double, n bigint").repartition(5)
    got = rows_of(number_rows(df, ["time_s", "n"]), "record_id", "row", "n")
    want = []
    for key in ("a", "b", None):
        ordered = sorted((t is not None, t or 0.0, n) for k, t, n in data if k == key)
        want += [(key, i, n) for i, (_, _, n) in enumerate(ordered)]
    assert got == sorted(want, key=repr)
    assert number_rows(df.limit(0), ["n"]).collect() == []


@pytest.mark.parametrize("times", [lambda i: 1.0, lambda i: 1e15 if i == 0 else float(i % 3)])
def test_one_time_or_an_outlier_spreads_over_tasks(spark, times):
    """A long record, all of it at one time, or all but one row crowded at the start of its span."""
    df = spark.createDataFrame([("a", times(i), i) for i in range(4000)], "record_id string, time_s double, n bigint").repartition(4)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        shares = in_order(df, ["time_s", "n"]).groupBy(F.shiftrightunsigned("_place", 33)).count().collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(shares) == 8 and max(r["count"] for r in shares) < 1000
    got = number_rows(df, ["time_s", "n"]).orderBy("time_s", "n").collect()
    assert [r["row"] for r in got] == list(range(4000))


@pytest.mark.parametrize("block", [1, 3, 4, 1000])
def test_runs_and_running(spark, block):
    rng = random.Random(block)
    values = [float(rng.random() < 0.7) for _ in range(60)] + [1.0] * 20 + [0.0]
    df = record(spark, values)
    want, start = [], None
    for i, v in enumerate([*values, 0.0]):
        if v and start is None:
            start = i
        if not v and start is not None:
            want.append((start, i))
            start = None
    runs = B.mask_runs(df.filter("v = 1"), carry=["v"], block_rows=block)
    assert sorted((r["start_row"], r["stop_row"]) for r in runs.collect()) == want
    total = B.running(df, ["record_id"], F.col("v").cast("int"), "s", "sum", block_rows=block).orderBy("row").collect()
    best = B.running(df, ["record_id"], F.when(F.col("v") == 1, F.col("row")), "m", "max", block_rows=block).orderBy("row").collect()
    for i in range(len(values)):
        assert total[i]["s"] == sum(values[: i + 1])
        assert best[i]["m"] == max((j for j in range(i + 1) if values[j]), default=None)


def test_reference_run_lengths(spark):
    assert rows_of(B.mask_runs(record(spark, [0, 1, 1, 0, 1] and [0.0, 1.0, 1.0, 0.0, 1.0]).filter("v = 1")), "start_row", "stop_row") == [(1, 3), (4, 5)]


@pytest.mark.parametrize("block", [2, 3, 1000])
def test_neighbours(spark, block):
    df = record(spark, [float(i * i) for i in range(11)])
    got = B.neighbours(df, {"p": ("v", -2), "n": ("v", 1)}, block_rows=block).orderBy("row").collect()
    for i, r in enumerate(got):
        assert r["p"] == (float((i - 2) ** 2) if i >= 2 else None)
        assert r["n"] == (float((i + 1) ** 2) if i < 10 else None)
    assert len(got) == 11


def thin_loop(rows, width):
    kept, last = [], None
    for r in rows:
        if last is None or r - last >= width:
            kept.append(r)
            last = r
    return kept


@pytest.mark.parametrize("block,chain", [(1000, 1000), (5, 1000), (5, 2), (3, 1), (8, 0)])
def test_thin_against_loop(spark, block, chain):
    rng = random.Random(block * 31 + chain)
    data, want = [], []
    for key in ("a", "b", "c"):
        rows = [i for i in range(80) if rng.random() < {"a": 0.9, "b": 0.4, "c": 0.1}[key]]
        data += [(key, r) for r in rows]
        want += [(key, r) for r in thin_loop(rows, 4)]
    hits = spark.createDataFrame(data, "record_id string, row bigint")
    assert rows_of(thin(hits, ["record_id"], 4, (), block, chain), "record_id", "row") == sorted(want, key=repr)


def pack_loop(events, gap, span):
    groups = []
    for a, b in sorted(events):
        if groups:
            lo, hi, n = groups[-1]
            if a <= hi + gap and max(hi, b) - lo <= span:
                groups[-1] = (lo, max(hi, b), n + 1)
                continue
        groups.append((a, b, 1))
    return groups


def packed(df, gap, span, **sizes):
    return (
        pack(df, gap, span, **sizes).groupBy("record_id", "chain_row", "group_event")
        .agg(F.min("start_row").alias("a"), F.max("stop_row").alias("b"), F.count("*").alias("n")).select("record_id", "a", "b", "n")
    )


@pytest.mark.parametrize("block,chain", [(1000, 1000), (6, 1000), (6, 3), (4, 0), (40, 2)])
def test_pack_against_loop(spark, block, chain):
    rng = random.Random(block * 17 + chain)
    data, want = [], []
    for key in ("a", "b"):
        events = []
        for _ in range(60):
            a = rng.randrange(120)
            events.append((a, a + rng.choice([1, 1, 2, 3, 20])))
        data += [(key, a, b, f"{i:03d}") for i, (a, b) in enumerate(events)]
        want += [(key, *g) for g in pack_loop(events, 2, 12)]
    df = spark.createDataFrame(data, "record_id string, start_row bigint, stop_row bigint, event_id string")
    assert rows_of(packed(df, 2, 12, block_rows=block, chain_events=chain)) == sorted(want, key=repr)


def test_fifty_events_stay_under_the_span(spark):
    df = spark.createDataFrame(
        [("a", i, i + 1, str(i)) for i in range(0, 100, 2)], "record_id string, start_row bigint, stop_row bigint, event_id string"
    )
    for chain in (4096, 5):
        got = packed(df, 2, 12, chain_events=chain).collect()
        assert sorted(r["n"] for r in got) == [2] + [6] * 8
        assert all(r["b"] - r["a"] <= 12 for r in got)


def test_first_k_with_one_hot_key(spark):
    df = spark.range(1000).selectExpr("if(id < 900, 'hot', 'cold') AS k", "id AS n")
    got = rows_of(B.first_k(df, ["k"], ["n"], 3, F.col("n")), "k", "n")
    assert got == [("cold", 900), ("cold", 901), ("cold", 902), ("hot", 0), ("hot", 1), ("hot", 2)]
