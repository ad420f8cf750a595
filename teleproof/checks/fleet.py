"""Queries: many delimited files in one load, slices by recipe, facts bound to the snapshot they were taken from."""

from __future__ import annotations

import re
import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from teleproof.checks.mining import PACKAGES, events, packages
from teleproof.checks.registry import LI, check, q6, r6
from teleproof.operators import packages as P
from teleproof.operators.blocks import RECORD
from teleproof.operators.windows import extents
from teleproof.settings import TASK_ROWS
from teleproof.sources import fleet as L
from teleproof.sources.tables import line_rows
from teleproof.sources.workspace import shared_folder, written

CHANNELS, FIELDS = ["l_quantity", "l_discount", "l_tax"], ["l_returnflag", "l_linestatus"]


def line_files(spark: SparkSession, sf: str) -> DataFrame:
    """``lineitem`` as two CSV files for each supplier, and their manifest.

    Side files order their columns in another way. By the last digit of the supplier: 1 lacks its last side row, 2 shifts the time of side row 7, 3 has a text for
    a number in row 5, 4 has another hash in the manifest. A tax of zero is written as an empty cell.
    """
    folder = f"{shared_folder(spark)}/teleproof/files-{uuid.uuid4().hex}"
    lines = line_rows(spark, sf)
    rows = lines.join(extents(lines).select(RECORD, "end_row"), RECORD)
    digit, time = F.pmod(RECORD, F.lit(10)), F.col("time_s").cast("decimal(20, 3)")
    discount = F.when((digit == 3) & (F.col("row") == 5), "n/a").otherwise(F.col("l_discount").cast("string"))
    tax = F.when(F.col("l_tax") != 0, F.col("l_tax").cast("string")).otherwise("")
    main = F.struct(tax.alias("l_tax"), time.alias("Time"), "l_quantity", discount.alias("l_discount"), F.lit("-").alias("Extra"))
    late = (time + F.when((digit == 2) & (F.col("row") == 7), 60).otherwise(0)).alias("Time")
    side = F.when(~((digit == 1) & (F.col("row") == F.col("end_row") - 1)), F.to_csv(F.struct("l_linestatus", late, "l_returnflag"), {"emptyValue": ""}))
    texts = rows.select(F.col(RECORD).cast("string").alias("source_id"), "row", F.to_csv(main, {"emptyValue": ""}).alias("telemetry"), side.alias("context"))
    ways = max(L.all_tasks(spark), -(-lines.count() // TASK_ROWS))
    texts = texts.filter(F.col("source_id").isNotNull()).repartition(ways, "source_id").sortWithinPartitions("source_id", "row").drop("row")
    headers = {"telemetry": "l_tax,Time,l_quantity,l_discount,Extra", "context": "l_linestatus,Time,l_returnflag"}
    found = written(texts.mapInArrow(file_writer(plain_folder(folder), headers), "source_id string, role string, path string"), "manifest")
    role, source = F.col("role"), F.col("source_id")
    fields = F.when(role == "telemetry", F.array(*[F.lit(c) for c in CHANNELS])).otherwise(F.array(*[F.lit(c) for c in FIELDS]))
    pinned = F.when((role == "context") & (F.pmod(source.cast("bigint"), F.lit(10)) == 4), F.repeat(F.lit("0"), 64))
    return found.select(
        source, role, "path", F.lit("Time").alias("time_column"), F.lit("seconds").alias("time_kind"),
        F.lit(None).cast("string").alias("time_format"), fields.alias("fields"), pinned.alias("sha256"),
    )


def plain_folder(folder: str) -> str:
    """Local folders without their scheme, others as they are."""
    return re.sub("^file:/+", "/", folder)


def file_writer(folder: str, headers: dict[str, str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows ``source_id`` and a line for each role, sorted by source, to one file for each source and role; gives ``source_id, role, path``.

    A task holds the files of one source open; a line that is null is left out. Neither files nor folders are listed or renamed afterwards.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, made = TaskContext.get().partitionId(), None, []
        streams: dict[str, pa.NativeFile] = {}
        paths = {role: f"{folder}/{role}/{part}" for role in headers}
        for path in paths.values():
            system, inner = L.opened_at(path)
            system.create_dir(inner, recursive=True)

        def listed() -> pa.RecordBatch:
            columns = [pa.array(c, pa.string()) for c in zip(*made)]
            made.clear()
            return pa.RecordBatch.from_arrays(columns, ["source_id", "role", "path"])

        for batch in batches:
            sources = batch.column("source_id").to_pylist()
            texts = {role: batch.column(role).to_pylist() for role in headers}
            begin = 0
            while begin < len(sources):
                source, end = sources[begin], bisect_right(sources, sources[begin], begin)
                if source != now:
                    for stream in streams.values():
                        stream.close()
                    now = source
                    for role, header in headers.items():
                        path = f"{paths[role]}/{source}.csv"
                        system, inner = L.opened_at(path)
                        streams[role] = system.open_output_stream(inner)
                        streams[role].write(f"{header}\n".encode())
                        made.append((source, role, path))
                for role, stream in streams.items():
                    stream.write("".join(f"{x}\n" for x in texts[role][begin:end] if x is not None).encode())
                begin = end
            if made:
                yield listed()
        for stream in streams.values():
            stream.close()

    return write


def line_fleet(spark: SparkSession, sf: str) -> L.Fleet:
    return L.load_fleet(spark, line_files(spark, sf), CHANNELS, FIELDS)


LOADED = f"""{LI}, m AS (SELECT record_id, max(r) AS m FROM li GROUP BY 1),
  lo AS (SELECT record_id, r, t, l_quantity, CASE WHEN record_id % 10 = 3 AND r = 5 THEN NULL ELSE l_discount END AS l_discount, nullif(l_tax, 0) AS l_tax, l_returnflag,
    l_linestatus FROM li JOIN m USING (record_id) WHERE record_id % 10 <> 4 AND NOT (record_id % 10 = 1 AND r = m) AND NOT (record_id % 10 = 2 AND r = 7))"""


@check("fleet_rows", f'WITH {LOADED} SELECT record_id, r AS "row", t AS time_s, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus FROM lo')
def fleet_rows(spark: SparkSession, sf: str) -> DataFrame:
    return line_fleet(spark, sf).rows.withColumn(RECORD, F.col(RECORD).cast("bigint"))


@check("fleet_violations", f"""
WITH {LOADED}
SELECT record_id, m AS "row", 'missing_context' AS issue FROM m WHERE record_id % 10 = 1
UNION ALL SELECT record_id, r, 'time_differs' FROM li WHERE record_id % 10 = 2 AND r = 7
UNION ALL SELECT record_id, r, 'not_a_number' FROM li WHERE record_id % 10 = 3 AND r = 5
UNION ALL SELECT record_id, NULL, 'hash_differs_from_manifest' FROM m WHERE record_id % 10 = 4""")
def fleet_violations(spark: SparkSession, sf: str) -> DataFrame:
    return line_fleet(spark, sf).violations.select(F.col(RECORD).cast("bigint").alias(RECORD), "row", "issue")


def recipes(files: DataFrame) -> DataFrame:
    """A slice [100, 160) of every source; every fifth is asked for by an old hash, every seventh beyond the end of its source."""
    number = F.col("source_id").cast("bigint")
    sha = F.when((F.pmod(number, F.lit(5)) == 0) & (F.col("role") == "context"), F.repeat(F.lit("0"), 64)).otherwise(F.col("sha256"))
    hashes = L.role_hashes(files.withColumn("sha256", sha))
    stop = F.when(F.pmod(F.col("source_id").cast("bigint"), F.lit(7)) == 0, 10_000_000).otherwise(160).cast("bigint")
    return hashes.select(
        F.concat(F.lit("slice-"), "source_id").alias("slice_id"), F.col("source_id").alias(RECORD), F.lit(100).cast("bigint").alias("start_row"), stop.alias("stop_row"), "hashes"
    )


# Sources refused by the load have no rows to cut from, so their slices are never whole.
SLICED = f"""{LOADED}, w AS (SELECT record_id, CASE WHEN record_id % 5 = 0 THEN 'hash_differs_from_recipe' WHEN record_id % 7 = 0 OR record_id % 10 = 4
    OR (SELECT count(*) FROM lo WHERE lo.record_id = m.record_id AND r >= 100 AND r < 160) < 60 THEN 'incomplete_selection' ELSE 'ok' END AS status FROM m)"""


@check("recipe_status", f"WITH {SLICED} SELECT record_id, status FROM w")
def recipe_status(spark: SparkSession, sf: str) -> DataFrame:
    fleet = line_fleet(spark, sf)
    return L.extract_slices(fleet, recipes(fleet.files))[1].select(F.col(RECORD).cast("bigint").alias(RECORD), "status")


@check("recipe_slices", f"""WITH {SLICED}
SELECT record_id, r - 100 AS "row", t - first(t) OVER (PARTITION BY record_id ORDER BY r) AS time_s, l_quantity, l_returnflag FROM lo JOIN w USING (record_id)
WHERE status = 'ok' AND r >= 100 AND r < 160""")
def recipe_slices(spark: SparkSession, sf: str) -> DataFrame:
    fleet = line_fleet(spark, sf)
    return L.extract_slices(fleet, recipes(fleet.files))[0].select(F.col(RECORD).cast("bigint").alias(RECORD), "row", "time_s", "l_quantity", "l_returnflag")


@check("recompute_bound", f"""WITH RECURSIVE {PACKAGES}
SELECT record_id, a AS group_start, b AS group_stop, channel, fact, CASE WHEN record_id % 5 = 0 THEN NULL ELSE {q6('v')} END AS recomputed, record_id % 5 <> 0 AS agrees,
  CASE WHEN record_id % 5 = 0 THEN 'source_snapshot_changed' ELSE 'ok' END AS snapshot FROM facts WHERE ok""")
def recompute_bound(spark: SparkSession, sf: str) -> DataFrame:
    """Stored facts recomputed from rows of which every fifth record has changed since."""
    rows, packs = events(spark, sf), packages(spark, sf)
    stored = written(P.package_measures(rows, packs, ["value", "k"]), "facts")
    changed = (F.pmod(RECORD, F.lit(5)) == 0) & (F.col("row") == 0)
    late = rows.withColumn("value", F.when(changed, F.coalesce("value", F.lit(0.0)) + 1).otherwise(F.col("value")))
    found = P.recompute_bound(late, packs, stored, ["value", "k"], P.content_snapshots(rows))
    return found.select(RECORD, "group_start", "group_stop", "channel", "fact", r6("recomputed").alias("recomputed"), "agrees", "snapshot")
