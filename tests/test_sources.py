"""Delimited files, hashes, logs and sinks."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from conftest import rows_of
from teleproof import schemas
from teleproof.functions import scalar as S
from teleproof.sources import files, sinks
from teleproof.sources import telemetry as T


def put(folder, name, text, encoding="utf-8"):
    path = folder / name
    path.write_bytes(text.encode(encoding))
    return str(path)


def entry(path, **more):
    return T.Experiment("exp", path, "Time", ["P_SA", "I_Load1"], **more)


def test_two_row_source_with_context(spark, tmp_path):
    tele = put(tmp_path, "s.csv", "Time,P_SA,I_Load1,Extra\n2024-01-01 00:00:00,2,1,x\n2024-01-01 00:00:02,4,1,y\n", "utf-8-sig")
    ctx = put(tmp_path, "s_Work_Condition.csv", "Time,Irradiation\n2024-01-01 00:00:00,300\n2024-01-01 00:00:02,300\n")
    lab = put(tmp_path, "s_AnomalyLabel.csv", "Time,AnomalyLabel\nnot read,1\n")
    assert T.source_files(tele) == (tele, ctx, lab)
    side = [T.Auxiliary(ctx, "Time", ["Irradiation"], "context"), T.Auxiliary(lab, "Time", ["AnomalyLabel"], "private_label")]
    rows, violations = T.load_experiment(spark, entry(tele, time_kind="datetime", auxiliary=side))
    assert "AnomalyLabel" not in rows.columns and violations.count() == 0
    got = rows_of(rows, "row", "time_s", "P_SA", "Irradiation")
    assert [g[0] for g in got] == [0, 1] and got[1][1] - got[0][1] == 2.0 and [g[2] for g in got] == [2.0, 4.0]
    before = T.experiment_hashes(spark, entry(tele, auxiliary=side))
    assert before.count() == 3
    stored = spark.createDataFrame(before.collect(), before.schema)
    put(tmp_path, "s_Work_Condition.csv", "Time,Irradiation\n2024-01-01 00:00:00,300\n2024-01-01 00:00:03,300\n")
    changed = T.changed_during_read(stored, T.experiment_hashes(spark, entry(tele, auxiliary=side)))
    assert [r["path"].rsplit("/", 1)[1] for r in changed.collect()] == ["s_Work_Condition.csv"]
    _, violations = T.load_experiment(spark, entry(tele, time_kind="datetime", auxiliary=side))
    assert rows_of(violations, "row", "issue") == [(1, "time_differs")]


def test_tokens_and_malformed_rows(spark, tmp_path):
    tele = put(tmp_path, "t.csv", "Time,P_SA,I_Load1\n0, 1.5 ,NA\n1,nan,\n1,inf,2\n2,abc,3\n3,4\n4,5,6,7\nx,1,1\n")
    rows, violations = T.load_experiment(spark, entry(tele))
    got = rows_of(violations, "row", "issue")
    assert got == [(2, "non_finite"), (3, "not_a_number"), (4, "malformed_row"), (5, "malformed_row"), (6, "bad_time")]
    values = rows_of(rows.filter("row < 3"), "row", "time_s", "P_SA", "I_Load1")
    assert values == [(0, 0.0, 1.5, None), (1, 1.0, None, None), (2, 1.0, None, 2.0)]
    _, strict = T.load_experiment(spark, entry(tele), reject_missing=True)
    assert (1, "missing") in rows_of(strict, "row", "issue")


def test_header_gate(spark, tmp_path):
    with pytest.raises(T.HeaderError, match="missing"):
        T.load_experiment(spark, entry(put(tmp_path, "a.csv", "Time,P_SA\n0,1\n")))
    with pytest.raises(T.HeaderError, match="duplicate"):
        T.load_experiment(spark, entry(put(tmp_path, "b.csv", "Time,P_SA,I_Load1,P_SA\n0,1,1,1\n")))


def test_row_order_survives_file_splits(spark, tmp_path):
    body = "".join(f"{i},{i % 7},{i % 3}\n" for i in range(5000))
    tele = put(tmp_path, "long.csv", "Time,P_SA,I_Load1\n" + body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        rows, violations = T.load_experiment(spark, entry(tele))
        assert violations.count() == 0
        assert rows.filter(F.col("row") != F.col("time_s")).count() == 0 and rows.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_an_empty_file_is_a_violation(spark, tmp_path):
    for name, text in (("n.csv", ""), ("h.csv", "Time,P_SA,I_Load1\n")):
        rows, violations = T.load_experiment(spark, entry(put(tmp_path, name, text)))
        assert rows.count() == 0 and "empty_experiment" in {r["issue"] for r in violations.collect()}


def test_empty_context_and_short_context(spark, tmp_path):
    tele = put(tmp_path, "e.csv", "Time,P_SA,I_Load1\n0,1,1\n1,1,1\n")
    ctx = put(tmp_path, "c.csv", "Time,G\n0,a\n")
    _, violations = T.load_experiment(spark, entry(tele, auxiliary=[T.Auxiliary(ctx, "Time", ["G"], "context")]))
    assert rows_of(violations, "row", "issue") == [(1, "missing_context")]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_times(spark, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([("2024-07-01T12:00:00.25", "01.07.2024 12:00", "1.5")], "iso string, de string, s string")
        got = df.select(
            S.parse_time(F.col("iso")), S.parse_time(F.concat("iso", F.lit("Z"))), S.parse_time(F.concat("iso", F.lit("+02:00"))),
            S.parse_time(F.col("de"), pattern="%d.%m.%Y %H:%M"), S.parse_time(F.col("s"), "seconds"), S.parse_time(F.col("de")),
        ).first()
        base = 1719835200.0
        assert tuple(got) == (base + 0.25, base + 0.25, base - 7200 + 0.25, base, 1.5, None)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_inventory(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    put(tmp_path, "a.CSV", "x")
    put(tmp_path / "deep", "b", "x")
    found = files.inventory(spark, str(tmp_path)).withColumn("name", F.substring_index("path", "/", -1))
    sha = hashlib.sha256(b"x").hexdigest()
    assert rows_of(found, "name", "bytes", "sha256") == [("a.CSV", 1, sha), ("b", 1, sha)]
    assert rows_of(found.select(S.extension_of(F.col("path")).alias("e"))) == [("(none)",), (".csv",)]


def test_logs_and_documents(spark, tmp_path):
    assert files.read_log(spark, str(tmp_path / "none.jsonl"), schemas.RESPONSE).count() == 0
    log = put(tmp_path, "r.jsonl", '{"index":1,"http_status":200,"usage":{"prompt_tokens":7}}\n{"index":2}\n')
    got = files.read_log(spark, log, schemas.RESPONSE)
    assert rows_of(got, "index", "usage.prompt_tokens") == [(1, 7), (2, None)]
    doc = put(tmp_path, "m.json", '{\n "experiment_id": "e1",\n "channels": {"P": {"unit": null, "component": "x"}}\n}')
    first = files.read_documents(spark, doc, schemas.MANIFEST).first()
    assert first["experiment_id"] == "e1" and first["channels"]["P"]["unit"] is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, "s"), ("b", 2.0, "t")], "k string, v double, secret string")
    sinks.write_split(df, str(tmp_path / "pub"), str(tmp_path / "priv"), "k", ["k", "v"])
    assert spark.read.json(str(tmp_path / "pub")).columns == ["k", "v"]
    assert spark.read.json(str(tmp_path / "priv")).columns == ["k", "secret"]
    with pytest.raises(AnalysisException):
        sinks.write_json(df, str(tmp_path / "pub"))
    sinks.write_json(df, str(tmp_path / "pub"), append=True)
    assert spark.read.json(str(tmp_path / "pub")).count() == 4
    with pytest.raises(ValueError):
        sinks.write_json(df.withColumn("v", F.lit(float("nan"))), str(tmp_path / "bad"))
    sinks.write_per_record(df, str(tmp_path / "per"), "k")
    assert (tmp_path / "per" / "k=a").is_dir()
    T.write_working_copy(df.selectExpr("k AS record_id", "bigint(v) AS row", "v"), str(tmp_path / "copy"))
    assert spark.read.parquet(str(tmp_path / "copy")).count() == 2


def test_numbers_and_tolerance(spark):
    df = spark.createDataFrame([(1.0, 1.0 + 1e-9), (1.0, 1.1), (None, None), (1.0, None)], "a double, b double")
    got = [r[0] for r in df.select(S.close_to(F.col("a"), F.col("b"), 0.0, 1e-6)).collect()]
    assert got == [True, False, True, False]
    texts = spark.createDataFrame([("P_SA",), ("X_1",), ("T_BAT2",)], "c string")
    assert [r[0] for r in texts.select(S.unit_of(F.col("c"))).collect()] == ["W", None, "degC"]
