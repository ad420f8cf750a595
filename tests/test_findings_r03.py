"""What the reviewer of round 3 found, on small inputs."""

from __future__ import annotations

from conftest import rows_of
from teleproof import settings
from teleproof.operators import catalog as C
from teleproof.operators import pyramid
from teleproof.operators.numbering import number_rows
from teleproof.sources import fleet as L
from teleproof.operators.quality import quality_profile
from teleproof.operators.windows import extents
from teleproof.sources import workspace
from teleproof.sources.tables import LINE_CHANNELS, line_blocks, line_rows

SF = "/root/testdata/sf0.001"


def test_repeated_structures_show_their_sets(spark):
    tasks = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b")], "task long, kind string")
    members = spark.createDataFrame([(1, "n"), (1, "m"), (2, "m"), (2, "n"), (2, "n"), (2, None), (4, "m")], "task long, member string")
    checks = spark.createDataFrame([(1, 10), (1, 9), (2, 9), (2, 10)], "task long, what long")
    got = C.structural_duplicates(tasks, members, "task", ["kind"], "member", checks, "what")
    assert rows_of(got, "kind", "members", "checks", "n", "first") == [("a", "m,n", "10,9", 2, 1)]
    alone = C.structural_duplicates(tasks, members, "task", ["kind"], "member")
    assert alone.columns == ["signature", "kind", "members", "n", "first"]
    assert alone.selectExpr("signature = sha2('a|m,n', 256)").collect() == [(True,)]


def test_blocks_of_another_size_are_not_reused(spark, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(pyramid, "FAN", 4)
        assert line_blocks(spark, SF).filter("_level = 1").select("_n").distinct().collect() == [(4,)]
    assert line_blocks(spark, SF).filter("_level = 1").select("_n").distinct().collect() == [(64,)]


def test_long_and_short_records_are_numbered(spark, monkeypatch):
    data = [(k, i) for k, n in (("a", 40), ("b", 10), (None, 25), ("c", 11)) for i in range(n)]
    df = spark.createDataFrame(data[::-1], "record_id string, t long").repartition(3)
    monkeypatch.setattr(settings, "BLOCK_ROWS", 10)
    assert rows_of(number_rows(df, ["t"]), "record_id", "t", "row") == sorted(((k, i, i) for k, i in data), key=repr)


def test_short_records_are_numbered_by_one_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 7 AS record_id", "id AS t")
    plan = number_rows(df, ["t"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "FileScan" not in plan


def test_slices_of_a_source_with_two_side_files(spark):
    """A role of two files was a repeated map key, which ended the whole query."""
    files = spark.createDataFrame(
        [("a", "telemetry", "t"), ("a", "context", "x"), ("a", "context", "y"), ("b", "telemetry", "u")], "source_id string, role string, sha256 string"
    )
    rows = spark.createDataFrame([(s, i, float(i)) for s in "ab" for i in range(4)], "record_id string, row long, time_s double")
    asked = L.role_hashes(files).selectExpr("source_id AS slice_id", "source_id AS record_id", "1L AS start_row", "3L AS stop_row", "hashes")
    slices, judged = L.extract_slices(L.Fleet(rows, rows, files), asked)
    assert rows_of(judged, "slice_id", "status") == [("a", "ok"), ("b", "ok")]
    assert rows_of(slices, "slice_id", "row", "time_s") == [("a", 0, 0.0), ("a", 1, 1.0), ("b", 0, 0.0), ("b", 1, 1.0)]
    late = files.replace("y", "z", "sha256")
    assert rows_of(L.extract_slices(L.Fleet(rows, rows, late), asked)[1], "slice_id", "status") == [("a", "hash_differs_from_recipe"), ("b", "ok")]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_records_are_dealt_into_tasks_once(spark, monkeypatch):
    """F9 to F14, F19, F20: every query shuffled the rows again, into a number of tasks that did not follow the input."""
    monkeypatch.setattr(workspace, "_working_copies", {})
    monkeypatch.setattr(settings, "TASK_ROWS", 400)
    rows = line_rows(spark, SF)
    windows = extents(rows).selectExpr("record_id", "first_row AS start_row", "end_row AS stop_row")
    found = quality_profile(rows, windows, LINE_CHANNELS).hint("merge")
    assert "hashpartitioning" not in plan_of(found) and rows.groupBy("record_id").count().rdd.getNumPartitions() == -(-rows.count() // 400) > 10
    assert rows.count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()


def test_copies_of_long_records_are_not_dealt(spark, monkeypatch):
    monkeypatch.setattr(workspace, "_working_copies", {})
    want = rows_of(line_rows(spark, SF))
    monkeypatch.setattr(workspace, "_working_copies", {})
    monkeypatch.setattr(settings, "BLOCK_ROWS", 50)
    rows = line_rows(spark, SF)
    assert "hashpartitioning" in plan_of(rows.groupBy("record_id").count()) and rows_of(rows) == want


def test_copy_is_made_again_where_its_files_are_gone(spark, monkeypatch):
    monkeypatch.setattr(workspace, "_working_copies", {})
    n = line_rows(spark, SF).count()
    (path, *_), = workspace._working_copies.values()
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    assert line_rows(spark, SF).count() == n > 0
