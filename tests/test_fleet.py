"""Many files in one load: headers, side files, snapshots, recipes."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from teleproof.sources import fleet as L


def put(folder, name, text, encoding="utf-8"):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return str(path)


def listed(spark, *entries):
    keys = ["source_id", "role", "path", "time_column", "time_kind", "time_format", "fields", "sha256"]
    rows = [{"time_column": "Time", "time_kind": "seconds", **e} for e in entries]
    return spark.createDataFrame([tuple(r.get(k) for k in keys) for r in rows], L.MANIFEST)


def tele(source, path, fields=("P", "I"), **more):
    return dict(source_id=source, role="telemetry", path=path, fields=list(fields), **more)


def side(source, path, fields=("G",), role="context", **more):
    return dict(source_id=source, role=role, path=path, fields=list(fields), **more)


def test_files_of_different_layout(spark, tmp_path):
    a = put(tmp_path, "a b/one.csv", "Time,P,I,Extra\n0,1,2,x\n1, NA ,4,\"y,z\"\n", "utf-8-sig")
    b = put(tmp_path, "two.csv", "I,Time,P\r\n7,2024-01-01 00:00:05,\"8\"\r\n\r\n9,2024-01-01 00:00:06,10\r\n")
    c = put(tmp_path, "three.csv", "Time,P\n5,1\n")
    ca, cb = put(tmp_path, "one_c.csv", "Note,G,Time\n\"a \"\"q\"\", b\",300,0\n,301,1\n"), put(tmp_path, "two_c.csv", "Time,G\n2024-01-01 00:00:05,1\n2024-01-01 00:00:06,2\n")
    label = put(tmp_path, "label.csv", "not,a,table\n")
    plan = listed(
        spark, tele("a", a), tele("b", b, time_kind="datetime"), tele("c", c, ["P"]), side("a", ca, ["G", "Note"]), side("b", cb, time_kind="datetime"),
        side("a", label, ["L"], "private_label"),
    )
    got = L.load_fleet(spark, plan, ["P", "I"], ["G", "Note"])
    assert got.violations.collect() == []
    at = 1704067205.0
    assert rows_of(got.rows, "record_id", "row", "time_s", "P", "I", "G", "Note") == sorted([
        ("a", 0, 0.0, 1.0, 2.0, "300", 'a "q", b'), ("a", 1, 1.0, None, 4.0, "301", ""), ("b", 0, at, 8.0, 7.0, "1", None), ("b", 1, at + 1, 10.0, 9.0, "2", None),
        ("c", 0, 5.0, 1.0, None, None, None),
    ], key=repr)
    assert rows_of(got.files, "path", "sha256") == sorted((p, hashlib.sha256(open(p, "rb").read()).hexdigest()) for p in (a, b, c, ca, cb, label))


def test_tokens_and_malformed_rows(spark, tmp_path):
    path = put(tmp_path, "t.csv", "Time,P,I\n0, 1.5 ,NA\n1,nan,\n1,inf,2\n2,abc,3\n3,4\n4,5,6,7\nx,1,1\n")
    got = L.load_fleet(spark, listed(spark, tele("exp", path)), ["P", "I"])
    assert rows_of(got.violations, "row", "issue") == [(2, "non_finite"), (3, "not_a_number"), (4, "malformed_row"), (5, "malformed_row"), (6, "bad_time")]
    # Cells of a malformed row belong to no column.
    assert rows_of(got.rows, "row", "time_s", "P", "I") == [
        (0, 0.0, 1.5, None), (1, 1.0, None, None), (2, 1.0, None, 2.0), (3, 2.0, None, 3.0), (4, None, None, None), (5, None, None, None), (6, None, 1.0, 1.0),
    ]
    strict = L.load_fleet(spark, listed(spark, tele("exp", path)), ["P", "I"], reject_missing=True)
    assert (1, "missing") in rows_of(strict.violations, "row", "issue")


def test_every_gate_over_files(spark, tmp_path):
    good = "Time,P,I\n0,1,1\n1,2,2\n"
    names = ["ok", "none", "header_only", "duplicate", "missing", "pinned", "clash", "long", "two", "two_b"]
    text = {"none": "", "header_only": "Time,P,I\n", "duplicate": "Time,P,I,P\n0,1,1,1\n", "missing": "Time,P\n0,1\n", "long": good + "2,3,3\n"}
    paths = {n: put(tmp_path, f"{n}.csv", text.get(n, good)) for n in names}
    clash = put(tmp_path, "clash_c.csv", "Time,P\n0,1\n1,1\n")
    entries = [tele(n.removesuffix("_b"), p, sha256="0" * 64 if n == "pinned" else None) for n, p in paths.items()]
    entries += [side("clash", clash, ["P"]), tele("gone", str(tmp_path / "gone.csv")), side("alone", clash, ["G2", "P2"])]
    got = L.load_fleet(spark, listed(spark, *entries), ["P", "I"], ["G"], max_rows=2)
    found = {(r["record_id"], r["issue"]) for r in got.violations.collect()}
    assert found == {
        ("none", "empty_file"), ("none", "empty_experiment"), ("header_only", "empty_experiment"), ("duplicate", "duplicate_columns"),
        ("duplicate", "empty_experiment"), ("missing", "missing_columns"), ("missing", "empty_experiment"), ("pinned", "hash_differs_from_manifest"),
        ("clash", "colliding_fields"), ("long", "too_many_rows"), ("two", "not_one_telemetry_file"), ("gone", "missing_file"), ("gone", "empty_experiment"),
        ("alone", "not_one_telemetry_file"), ("alone", "missing_columns"), ("alone", "empty_experiment"), ("two", "colliding_fields"),
    }
    assert {r["record_id"] for r in got.rows.collect()} == {"ok"}


def test_side_rows_must_align(spark, tmp_path):
    body = "Time,P,I\n" + "".join(f"{i},1,1\n" for i in range(3))
    sides = {"short": "0,a\n1,a\n", "shifted": "0,a\n1.5,a\n2,a\n", "surplus": "0,a\n1,a\n2,a\n3,a\n", "broken": "0,a\n1\n2,a\n"}
    entries = []
    for name, lines in sides.items():
        entries += [tele(name, put(tmp_path, f"{name}.csv", body)), side(name, put(tmp_path, f"{name}_c.csv", "Time,G\n" + lines))]
    got = L.load_fleet(spark, listed(spark, *entries), ["P", "I"], ["G"])
    assert rows_of(got.violations, "record_id", "row", "issue") == [
        ("broken", 1, "malformed_context"), ("shifted", 1, "time_differs"), ("short", 2, "missing_context"), ("surplus", 3, "missing_telemetry"),
    ]
    assert got.rows.count() == 9


def test_a_file_that_changes_between_the_snapshots(spark, tmp_path, monkeypatch):
    paths = [put(tmp_path, f"{n}.csv", "Time,P,I\n0,1,1\n") for n in "ab"]
    read, calls = L.streamed_hashes, []

    def late(files, *args):
        if calls:
            put(tmp_path, "b.csv", "Time,P,I\n0,1,2\n")
        calls.append(1)
        return read(files, *args)

    monkeypatch.setattr(L, "streamed_hashes", late)
    got = L.load_fleet(spark, listed(spark, *(tele(p[-5], p) for p in paths)), ["P", "I"])
    assert rows_of(got.violations, "record_id", "issue") == [("b", "changed_during_read")]
    assert [r["record_id"] for r in got.rows.collect()] == ["a"]


def test_hashes_of_files_larger_than_a_block(spark, tmp_path):
    """A sparse file over 2 GB cannot be one value; blocks of a few bytes take the same path."""
    small = put(tmp_path, "s.bin", "0123456789" * 100)
    big = tmp_path / "big.bin"
    with open(big, "wb") as f:
        f.truncate((2 << 30) + 10)
    asked = spark.createDataFrame([(small,), (str(tmp_path / "none"),)], "path string")
    found = {r["path"]: (r["bytes"], r["sha256"]) for r in L.streamed_hashes(asked, 7).collect()}
    assert found == {small: (1000, hashlib.sha256(b"0123456789" * 100).hexdigest()), str(tmp_path / "none"): (None, None)}
    found = L.streamed_hashes(spark.createDataFrame([(str(big),)], "path string")).collect()
    zeros = hashlib.sha256()
    for _ in range(512):
        zeros.update(bytes(4 << 20))
    zeros.update(bytes(10))
    assert [r["sha256"] for r in found] == [zeros.hexdigest()]


def test_plan_does_not_grow_with_files(spark, tmp_path):
    sizes = []
    for n in (2, 40):
        entries = [tele(f"s{k}", put(tmp_path / str(n), f"{k}.csv", "Time,P,I\n0,1,1\n")) for k in range(n)]
        got = L.load_fleet(spark, listed(spark, *entries), ["P", "I"])
        assert got.rows.count() == n
        sizes.append(got.rows._jdf.queryExecution().optimizedPlan().toString().count("\n"))
    assert sizes[0] == sizes[1]


def test_slices_by_recipe(spark, tmp_path):
    path = put(tmp_path, "a.csv", "Time,P,I\n" + "".join(f"{i + 10},{i},1\n" for i in range(6)))
    ctx = put(tmp_path, "a_c.csv", "Time,G\n" + "".join(f"{i + 10},g{i}\n" for i in range(6)))
    got = L.load_fleet(spark, listed(spark, tele("a", path), side("a", ctx)), ["P"], ["G"])
    now = {r["role"]: r["sha256"] for r in got.files.collect()}
    recipes = [
        ("whole", "a", 1, 4, now), ("short", "a", 4, 8, now), ("stale", "a", 1, 4, {**now, "context": "0"}), ("partial", "a", 1, 4, {"telemetry": now["telemetry"]}),
        ("nowhere", "b", 0, 1, now), ("empty", "a", 3, 3, now), ("twice", "a", 0, 1, now), ("twice", "a", 1, 2, now),
    ]
    asked = spark.createDataFrame(recipes, "slice_id string, record_id string, start_row long, stop_row long, hashes map<string, string>")
    slices, status = L.extract_slices(got, asked)
    assert rows_of(slices, "slice_id", "row", "time_s", "P", "G") == [("whole", i, float(i), float(i + 1), f"g{i + 1}") for i in range(3)]
    assert rows_of(status, "slice_id", "status") == [
        ("empty", "invalid_window"), ("nowhere", "unknown_source"), ("partial", "hash_differs_from_recipe"), ("short", "incomplete_selection"),
        ("stale", "hash_differs_from_recipe"), ("twice", "repeated_slice"), ("twice", "repeated_slice"), ("whole", "ok"),
    ]
    digest = {r["record_id"]: r["snapshot"] for r in L.snapshot_digest(got.files).collect()}
    want = "\n".join(sorted("\x1f".join([role, p, now[role]]) for role, p in (("telemetry", path), ("context", ctx))))
    assert digest == {"a": hashlib.sha256(want.encode()).hexdigest()}
