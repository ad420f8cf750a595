"""What the reviewer of round 4 found, on small inputs."""

from __future__ import annotations

import os

import numpy as np

from compare import compare, connection
from conftest import rows_of
from teleproof import settings
from teleproof.llm.common import Scratch
from teleproof.llm.near_copies import differing, one_per_copy, parities
from teleproof.sources import fleet as L

SF = "/root/testdata/sf0.001"


def with_lines(spark, folder, condition):
    """The small tables with only the rows of ``lineitem`` that meet a condition."""
    for name in os.listdir(SF):
        if name != "lineitem.parquet":
            os.symlink(f"{SF}/{name}", folder / name)
    spark.read.parquet(f"{SF}/lineitem.parquet").filter(condition).toPandas().to_parquet(folder / "lineitem.parquet", coerce_timestamps="us")
    return str(folder)


def test_batch_on_records_shorter_than_its_windows(spark, tmp_path):
    """runs in the first 500 rows were refused where a record has fewer; its SQL answers them."""
    import __spark_entry__ as entry

    sf = with_lines(spark, tmp_path, "NOT (l_suppkey = 1 AND l_orderkey % 4 = 0) AND NOT (l_suppkey = 2 AND l_orderkey % 5 < 3)")
    con = connection(sf)
    sizes = dict(con.execute("SELECT l_suppkey, count(*) FROM lineitem GROUP BY 1").fetchall())
    assert 300 < sizes[1] < 500 and 200 < sizes[2] < 300
    assert compare(spark, con, "query_batch", entry.queries()["query_batch"], entry.oracle_sql()["query_batch"], sf) == ""


def test_lines_of_a_file_read_in_blocks(tmp_path):
    """F2, F4 to F6: a line belongs to the block it begins in, whatever ends it and however small the blocks and pieces are."""
    path = tmp_path / "t.csv"
    for text in (b"\xef\xbb\xbfab\r\n\r\nc\rd\n\ne\r\r\nfgh", b"\n\na\r\nb\r\n", b"one line", b"", b"\r\n", b"x\r"):
        path.write_bytes(text)
        want = [x for x in text.removeprefix(b"\xef\xbb\xbf").splitlines() if x]
        for size in range(1, len(text) + 2):
            for piece in (1, 2, 3, 100):
                ends = [*range(size, len(text), size), None]
                got = [x for start, stop in zip([0, *ends], ends) for part in L.block_lines(str(path), start, stop, piece) for x in part]
                assert got == want, (text, size, piece)


def test_large_files_are_read_in_blocks_and_meet_in_bands(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "FILE_BLOCK", 50)
    monkeypatch.setattr(settings, "BLOCK_ROWS", 7)
    n, entries = 60, []
    for name in "ab":
        (tmp_path / f"{name}.csv").write_text("Time,P\n" + "".join(f"{i},{i * 2}\n" for i in range(n)))
        (tmp_path / f"{name}_c.csv").write_text("Note, Time \n" + "".join(f"{'z' * (i % 40)},{i}\n" for i in range(n)))
        entries += [(name, "telemetry", ["P"], f"{name}.csv"), (name, "context", ["Note"], f"{name}_c.csv")]
    plan = spark.createDataFrame([(s, r, str(tmp_path / p), "Time", "seconds", None, f, None) for s, r, f, p in entries], L.MANIFEST)
    got = L.load_fleet(spark, plan, ["P"], ["Note"])
    assert got.violations.collect() == []
    assert rows_of(got.rows, "record_id", "row", "time_s", "P", "Note") == sorted(((s, i, float(i), i * 2.0, "z" * (i % 40)) for s in "ab" for i in range(n)), key=repr)


def test_no_path_reaches_the_driver(spark, monkeypatch):
    """F2, F4 to F6: the paths of all files were collected, and every file was listed and held by the driver."""
    from pyspark.sql import DataFrame, readwriter

    from teleproof.checks import fleet

    read, collect, seen = readwriter.DataFrameReader.load, DataFrame.collect, []
    monkeypatch.setattr(readwriter.DataFrameReader, "load", lambda *a, **k: seen.append("load") or read(*a, **k))
    monkeypatch.setattr(readwriter.DataFrameReader, "text", lambda *a, **k: seen.append("text"))
    monkeypatch.setattr(DataFrame, "collect", lambda df: seen.append("path") if "path" in df.columns else collect(df))
    found = fleet.line_fleet(spark, SF)
    monkeypatch.undo()
    assert seen == [] and found.rows.count() > 0
    assert found.files.filter("bytes > 0").count() == 2 * spark.read.parquet(f"{SF}/lineitem.parquet").select("l_suppkey").distinct().count()


def test_source_of_one_row_without_side_row(spark, tmp_path):
    """The last side row of such a source was its only one; it got no side file, and its violation was not told."""
    import __spark_entry__ as entry

    sf = with_lines(spark, tmp_path, "l_suppkey <> 1 OR l_orderkey = (SELECT min(l_orderkey) FROM parquet.`/root/testdata/sf0.001/lineitem.parquet` WHERE l_suppkey = 1)")
    for name in ("fleet_violations", "fleet_rows"):
        assert compare(spark, connection(sf), name, entry.queries()[name], entry.oracle_sql()[name], sf) == ""


def test_parities_tell_most_pairs_apart_and_lose_none():
    """both whole sets travelled with every pair that shared enough of its first shingles."""
    rng = np.random.default_rng(4)
    for n, m, common in ((0, 0, 0), (1, 1, 1), (64, 80, 64), (300, 320, 290), (300, 320, 150), (5000, 70, 60), (1000, 1000, 400)):
        pool = np.unique(rng.integers(0, 2**64, 20_000, np.uint64))
        rng.shuffle(pool)
        x, y = np.sort(pool[:n]), np.sort(pool[n - common : n - common + m])
        apart = differing(parities(x), parities(y))
        assert apart <= len(np.setxor1d(x, y))
        if (n, common) in ((300, 150), (1000, 400)):
            assert 9 * apart > n + m


def test_few_sets_are_compared_whole(spark, monkeypatch):
    word = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    base = " ".join(f"c{i}" for i in range(110))
    texts = [f"{base} {word(k)}" for k in range(40)] + [f"{word(99)} end", f"{word(99)} other"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    seen, keep = {}, Scratch.keep

    def counted(scratch, df, name):
        held = keep(scratch, df, name)
        seen[name] = seen.get(name, 0) + held.count()
        return held

    monkeypatch.setattr(Scratch, "keep", counted)
    assert {r["doc_id"] for r in one_per_copy(docs).select("doc_id").collect()} == set(range(41))
    assert seen["pairs"] > 100 and seen["sets"] == 2
