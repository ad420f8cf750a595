"""Many telemetry files with their side files in one load, bound to a snapshot of the files.

A manifest row names one file: ``source_id, role, path, time_column, time_kind, time_format, fields, sha256``. Roles are ``telemetry``, ``context`` and
``private_label``; labels are hashed and never opened. All other files are opened by the tasks that hold their manifest rows, large ones in blocks, and their
lines numbered there; neither the driver nor the plan knows a path, so both are the same for one file and for a million. Files may order their columns as
they like. Lines travel in chunks, by source and band of rows, and telemetry and side files meet there row by row. Files are hashed before and after;
everything that breaks a rule is a row of ``violations``, and a source whose files break one has no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from teleproof import settings
from teleproof.functions.scalar import number_of, parse_time, status_of, written_number
from teleproof.operators.blocks import RECORD
from teleproof.sources.workspace import written

MANIFEST = T.StructType([
    T.StructField("source_id", T.StringType()),
    T.StructField("role", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("time_column", T.StringType()),
    T.StructField("time_kind", T.StringType()),
    T.StructField("time_format", T.StringType()),
    T.StructField("fields", T.ArrayType(T.StringType())),
    T.StructField("sha256", T.StringType()),
])
HASH_BLOCK = 4 << 20
# Bytes of a file that one task reads at once, and those it holds at a time.
FILE_BLOCK, PIECE = 64 << 20, 1 << 18
# Bytes of text that meet in one task.
TASK_BYTES = 16 << 20
# Such files can only be read from their beginning.
PACKED = r"\.(gz|bz2|zst|lz4)$"
LINE_END = re.compile(rb"\r?\n|\r")
BOM = b"\xef\xbb\xbf"


@dataclass(frozen=True)
class Fleet:
    """``rows``: telemetry with context; ``violations``: ``record_id, path, row, issue``; ``files``: the snapshot taken before the read."""

    rows: DataFrame
    violations: DataFrame
    files: DataFrame


def plain_path(path: Column) -> Column:
    """Local paths without their scheme, others as they are."""
    return F.regexp_replace(path, "^file:/+", "/")


def opened_at(path: str) -> tuple[pafs.FileSystem, str]:
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


def hash_of(path: str, block: int) -> tuple[int | None, str | None]:
    """Size and SHA-256 of a file, read in blocks; nothing for a path without a file."""
    system, inner = opened_at(path)
    info = system.get_file_info(inner)
    if info.type != pafs.FileType.File:
        return None, None
    digest = hashlib.sha256()
    with system.open_input_stream(inner) as stream:
        # A read reserves what it asks for.
        while piece := stream.read(min(block, info.size + 1)):
            digest.update(piece)
    return info.size, digest.hexdigest()


def streamed_hashes(files: DataFrame, block: int = HASH_BLOCK) -> DataFrame:
    """``files`` with ``bytes`` and ``sha256``, each file streamed through one task in blocks, whatever its size; null where there is none."""
    spark = files.sparkSession

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, hashes = zip(*(hash_of(path, block) for path in batch.column("path").to_pylist())) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sizes, pa.int64()), pa.array(hashes, pa.string())], [*batch.schema.names, "bytes", "sha256"]
            )

    schema = T.StructType([*files.schema.fields, T.StructField("bytes", T.LongType()), T.StructField("sha256", T.StringType())])
    return dealt(files).mapInArrow(digests, schema)


def dealt(files: DataFrame) -> DataFrame:
    """``files`` spread over all tasks; many files in one task would wait for each other.

    Dealt by a hash of their own, since a shuffle by the path itself can be replaced by an earlier one, whose tasks are merged where their rows are few.
    """
    return files.repartition(all_tasks(files.sparkSession), F.xxhash64("path"))


def all_tasks(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def block_lines(path: str, start: int, stop: int | None, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The lines of a file that begin in its bytes ``[start, stop)`` and are not empty, some at a time.

    Lines end in a line feed, a carriage return or both. Without ``stop`` the file is read to its end. A file that is gone has no lines; the second
    snapshot tells.
    """
    system, inner = opened_at(path)
    if system.get_file_info(inner).type != pafs.FileType.File:
        return
    rest, at, cut_off = b"", max(start - 1, 0), start > 0
    with system.open_input_file(inner) if start else system.open_input_stream(inner) as stream:
        if at:
            stream.seek(at)
        going = True
        while going:
            more = stream.read(piece)
            rest += more
            # What follows a carriage return decides where its line ends.
            known = len(rest) - (1 if more and rest.endswith(b"\r") else 0)
            last = LINE_END.search(rest, stop - 1 - at, known) if stop is not None and at + known >= stop else None
            if last:
                cut = last.end()
            else:
                cut = max(rest.rfind(b"\n", 0, known), rest.rfind(b"\r", 0, known)) + 1 if more else len(rest)
            going = bool(more) and not last
            lines = rest[:cut].splitlines()
            if at == 0 and start == 0 and lines:
                lines[0] = lines[0].removeprefix(BOM)
            if cut_off and lines:
                # The end of a line that began earlier.
                lines, cut_off = lines[1:], False
            at, rest = at + cut, rest[cut:]
            if lines := [x for x in lines if x]:
                yield lines


def first_lines(files: DataFrame) -> DataFrame:
    """``files`` with their first line, ``head``; null without one."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [next((x[0] for x in block_lines(path, 0, None, 1 << 12)), None) for path in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, "head"])

    held = dealt(files).mapInArrow(heads, T.StructType([*files.schema.fields, T.StructField("head", T.BinaryType())]))
    return held.withColumn("head", F.col("head").cast("string"))


def file_blocks(files: DataFrame) -> DataFrame:
    """A row for each block of ``FILE_BLOCK`` bytes: ``_from``, ``_to`` (null for the last) and ``_line``, the number of its first line."""
    last = F.when(F.col("path").rlike(PACKED), 0).otherwise(F.expr(f"greatest(bytes - 1, 0) div {FILE_BLOCK}"))
    blocks = files.withColumn("_last", last.cast("bigint")).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), "_last")))
    blocks = blocks.withColumns({"_from": F.col("_block") * FILE_BLOCK, "_to": F.when(F.col("_block") < F.col("_last"), (F.col("_block") + 1) * FILE_BLOCK)})
    long = blocks.filter(F.col("_last") > 0).select("path", "_block", "_from", "_to").distinct()
    blocks = blocks.drop("_last")
    if long.isEmpty():
        return blocks.withColumn("_line", F.lit(0).cast("bigint")).drop("_block")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sum(map(len, block_lines(r["path"], r["_from"], r["_to"]))) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], [*batch.schema.names, "_n"])

    spread = long.repartition(all_tasks(files.sparkSession), F.xxhash64("path", "_block"))
    counted = written(spread.mapInArrow(counts, T.StructType([*long.schema.fields, T.StructField("_n", T.LongType())])), "counts")
    earlier = F.sum("_n").over(Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    lines = counted.select("path", "_block", F.coalesce(earlier, F.lit(0)).alias("_line"))
    return blocks.join(lines, ["path", "_block"], "left").withColumn("_line", F.coalesce("_line", F.lit(0))).drop("_block")


def chunk_reader(band: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of files to chunks of their lines, each within one band of ``band`` rows: ``_band``, the number ``_at`` of the first line, ``_lines``."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []

            def packed() -> pa.RecordBatch:
                index, ats, lines = zip(*held)
                held.clear()
                arrays = [*batch.take(pa.array(index)).columns, pa.array([x // band for x in ats], pa.int64()), pa.array(ats, pa.int64()), pa.array(lines, pa.list_(pa.binary()))]
                return pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "_band", "_at", "_lines"])

            size = 0
            for i, (path, start, stop, at) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("path", "_from", "_to", "_line")))):
                for lines in block_lines(path, start, stop):
                    size += sum(map(len, lines))
                    while lines:
                        n = min(len(lines), band - at % band)
                        held.append((i, at, lines[:n]))
                        at, lines = at + n, lines[n:]
                    if size >= 4 * PIECE:
                        size = 0
                        yield packed()
            if held:
                yield packed()

    return chunks


def numbered_lines(files: DataFrame) -> DataFrame:
    """``files`` with a row for each line, header included: ``_band, row, value``. All lines of one ``source_id`` and ``_band`` are in one task."""
    blocks = file_blocks(files)
    schema = T.StructType([*blocks.schema.fields, *(T.StructField(c, T.LongType()) for c in ("_band", "_at")), T.StructField("_lines", T.ArrayType(T.BinaryType()))])
    size = files.agg(F.sum("bytes")).first()[0] or 0
    few = all_tasks(files.sparkSession)
    ways = max(few, -(-size // TASK_BYTES))
    chunks = blocks.repartition(few, F.xxhash64("path", "_from")).mapInArrow(chunk_reader(settings.BLOCK_ROWS), schema)
    chunks = chunks.select(*files.columns, "_band", "_at", "_lines").repartition(ways, "source_id", "_band")
    lines = chunks.select(*files.columns, "_band", "_at", F.posexplode("_lines").alias("_i", "value"))
    return lines.select(*files.columns, "_band", (F.col("_at") + F.col("_i")).alias("row"), F.col("value").cast("string").alias("value"))


def snapshot_digest(files: DataFrame) -> DataFrame:
    """One digest per source over role, path and hash of its files: ``record_id, snapshot``."""
    part = F.concat_ws("\u001f", "role", "path", "sha256")
    return files.groupBy(F.col("source_id").alias(RECORD)).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(part)), "\n"), 256).alias("snapshot"))


def cells(line: Column) -> Column:
    """The cells of one line; quotes may hold commas and doubled quotes."""
    quoted = F.transform(
        F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("(?:[^"]|"")*"|[^,]*)'), 1),
        lambda x: F.when(x.startswith('"'), F.replace(x.substr(F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x),
    )
    return F.when(F.contains(line, F.lit('"')), quoted).otherwise(F.split(line, ",", -1))


def _seconds(entries: DataFrame) -> Column:
    """Text to seconds by the time rule of its file; a manifest has few different rules, however many files."""
    rules = entries.select("time_kind", "time_format").distinct().collect()
    out = F.lit(None).cast("double")
    for kind, pattern in rules:
        mine = F.col("time_kind").eqNullSafe(F.lit(kind)) & F.col("time_format").eqNullSafe(F.lit(pattern))
        out = F.when(mine, parse_time(F.col("_time"), kind or "datetime", pattern)).otherwise(out)
    return out


def load_fleet(
    spark: SparkSession, manifest: DataFrame, channels: Sequence[str], context: Sequence[str] = (),
    reject_missing: bool = False, max_rows: int | None = None,
) -> Fleet:
    """Load the files of ``manifest``: ``record_id, row, time_s``, ``channels`` (DOUBLE) and ``context`` (STRING).

    A channel or field that a source does not declare is null there. A row whose side rows are missing or carry another time is a violation
    and left out; an unreadable number is a violation and null.
    """
    entries = manifest.withColumn("path", plain_path(F.col("path"))).select(*MANIFEST.fieldNames())
    entries = written(streamed_hashes(entries.withColumnRenamed("sha256", "pinned")), "snapshot")
    before = entries.filter(F.col("bytes").isNotNull())
    opened = before.filter(F.col("role") != "private_label")
    names = F.transform(cells(F.regexp_replace("head", "^\\ufeff", "")), lambda x: F.trim(x))
    heads = first_lines(opened).withColumn("names", names)
    declared = F.concat(F.array("time_column"), "fields")
    issue = (
        F.when(F.col("names").isNull(), "empty_file")
        .when(F.size(F.array_distinct("names")) < F.size("names"), "duplicate_columns")
        .when(F.size(F.array_except(declared, F.col("names"))) > 0, "missing_columns")
    )
    at = F.transform(declared, lambda d: F.array_position("names", d).cast("int"))
    heads = written(heads.withColumn("issue", issue).withColumn("at", at), "headers")

    line = F.col("cells")
    value = lambda p: F.get(line, p - 1)
    sound = heads.filter(F.col("issue").isNull()).select("source_id", "role", "path", "bytes", "time_kind", "time_format", "fields", "at", F.size("names").alias("_width"))
    read = numbered_lines(sound).filter(F.col("row") > 0).withColumn("cells", cells(F.col("value")))
    read = read.withColumn("_whole", F.size("cells") == F.col("_width")).withColumn("_time", F.when(F.col("_whole"), value(F.get("at", F.lit(0)))))
    read = read.withColumn("time_s", _seconds(entries)).withColumn("row", F.col("row") - 1)
    taken = F.when(F.col("_whole"), F.transform(F.slice("at", 2, F.greatest(F.size("fields"), F.lit(1))), value))
    read = read.withColumn("_values", taken)
    main, side = F.col("role") == "telemetry", F.col("role") == "context"
    bad = ["not_a_number", "non_finite", *(["missing"] if reject_missing else [])]
    # Each token is parsed once, and a row is as narrow as it will be before rows are sorted to meet.
    read = read.withColumn("_clean", F.when(main, F.transform("_values", lambda x: F.trim(x))))
    read = read.withColumn("_numbers", F.transform("_clean", written_number))
    at = lambda held, c: F.get(held, (F.array_position("fields", c) - 1).cast("int"))
    read = read.select(
        F.col("source_id").alias(RECORD), "_band", "row", main.alias("_main"), side.alias("_side"), "_whole", "time_s",
        F.array_distinct(F.array_compact(F.zip_with("_clean", "_numbers", status_of))).alias("_status"),
        *[F.when(main, number_of(at("_clean", c), at("_numbers", c))).alias(f"_c{i}") for i, c in enumerate(channels)],
        *[F.when(side, at("_values", c)).alias(f"_f{i}") for i, c in enumerate(context)],
    )
    main_row, side_row = F.col("_main"), F.col("_side")
    met = written(read.groupBy(RECORD, "_band", "row").agg(
        F.count_if(main_row).alias("_main"), F.count_if(side_row).alias("_sides"), F.bool_and(F.when(main_row, F.col("_whole"))).alias("_whole"),
        F.count_if(side_row & ~F.col("_whole")).alias("_broken"), F.max(F.when(main_row, F.col("time_s"))).alias("time_s"),
        F.count_if(side_row & F.col("time_s").isNotNull()).alias("_timed"),
        F.min(F.when(side_row, F.col("time_s"))).alias("_least"), F.max(F.when(side_row, F.col("time_s"))).alias("_most"),
        F.any_value(F.when(main_row, F.col("_status")), True).alias("_status"),
        *[F.any_value(f"_c{i}", True).alias(c) for i, c in enumerate(channels)],
        *[F.any_value(f"_f{i}", True).alias(c) for i, c in enumerate(context)],
    ).drop("_band"), "met")

    # Gates over files and sources.
    def found(df: DataFrame, issue: str | Column, path: Column | None = None) -> DataFrame:
        return df.select(
            F.col("source_id").alias(RECORD), (F.lit(None).cast("string") if path is None else path).alias("path"), F.lit(None).cast("bigint").alias("row"),
            (F.lit(issue) if isinstance(issue, str) else issue).alias("issue"),
        )

    path = F.col("path")
    sources = entries.groupBy("source_id").agg(
        F.count_if(main).alias("n_main"), F.count_if(side).alias("n_sides"), F.flatten(F.collect_list(F.when(~F.col("role").isin("private_label"), F.col("fields")))).alias("all"),
    )
    counts = met.groupBy(F.col(RECORD).alias("source_id")).agg(F.count_if(F.col("_main") > 0).alias("n_rows"))
    sized = written(sources.join(counts, "source_id", "left"), "sizes")
    after = streamed_hashes(before.select("source_id", "path", F.col("sha256").alias("_before")))
    gates = [
        found(entries.filter(F.col("bytes").isNull()), "missing_file", path),
        found(before.filter(F.col("pinned").isNotNull() & (F.col("pinned") != F.col("sha256"))), "hash_differs_from_manifest", path),
        found(after.filter(~F.col("sha256").eqNullSafe(F.col("_before"))), "changed_during_read", path),
        found(heads.filter(F.col("issue").isNotNull()), F.col("issue"), path),
        found(sized.filter(F.col("n_main") != 1), "not_one_telemetry_file"),
        found(sized.filter(F.size(F.array_distinct("all")) < F.size("all")), "colliding_fields"),
        found(sized.filter(F.coalesce("n_rows", F.lit(0)) == 0), "empty_experiment"),
    ]
    if max_rows is not None:
        gates.append(found(sized.filter(F.col("n_rows") > max_rows), "too_many_rows"))
    refused = written(reduce(DataFrame.unionByName, gates), "refused")

    judged = met.join(sources.select(F.col("source_id").alias(RECORD), "n_sides"), RECORD)
    aligned = (
        F.when(F.col("_main") == 0, "missing_telemetry").when(F.col("_sides") < F.col("n_sides"), "missing_context").when(F.col("_broken") > 0, "malformed_context")
        .when((F.col("n_sides") > 0) & ~(
            (F.col("_timed") == F.col("_sides")) & F.col("_least").eqNullSafe(F.col("time_s")) & F.col("_most").eqNullSafe(F.col("time_s"))
        ), "time_differs")
    )
    judged = judged.withColumn("issue", aligned).join(refused.select(RECORD).distinct(), RECORD, "left_anti")
    own = F.array_compact(F.array(
        F.col("issue"), F.when(~F.col("_whole"), F.lit("malformed_row")), F.when(F.col("_whole") & F.col("time_s").isNull(), F.lit("bad_time")),
        *[F.when(F.col("_whole") & F.array_contains("_status", s), F.lit(s)) for s in bad],
    ))
    per_row = judged.select(RECORD, F.lit(None).cast("string").alias("path"), "row", F.explode(own).alias("issue"))
    rows = judged.filter(F.col("issue").isNull()).select(RECORD, "row", "time_s", *channels, *context)
    files = before.select("source_id", "role", "path", "bytes", "sha256")
    return Fleet(rows, refused.unionByName(per_row), files)


def role_hashes(files: DataFrame) -> DataFrame:
    """``source_id`` and a map from role to SHA-256; a role of several files has the SHA-256 of their sorted hashes, one to a line."""
    held = files.groupBy("source_id", "role").agg(F.count(F.lit(1)).alias("_n"), F.array_join(F.array_sort(F.collect_list("sha256")), "\n").alias("_all"), F.max("sha256").alias("_one"))
    digest = F.when(F.col("_n") > 1, F.sha2("_all", 256)).otherwise(F.col("_one"))
    return held.groupBy("source_id").agg(F.map_from_entries(F.collect_list(F.struct("role", digest.alias("sha256")))).alias("hashes"))


def extract_slices(fleet: Fleet, recipes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Slices of source rows by recipe, renumbered from 0: ``slice_id, record_id, row`` and the columns of the rows.

    ``recipes`` has ``slice_id, record_id, start_row, stop_row, hashes`` (a map from role to the audited SHA-256, as ``role_hashes`` gives it). The second table gives every
    recipe a ``status``: hashes are judged before rows are read, and a slice is all there or refused. ``time_s`` counts from the slice's first row.
    """
    roles = role_hashes(fleet.files.filter(F.col("role") != "private_label")).select(F.col("source_id").alias(RECORD), F.col("hashes").alias("_now"))
    asked = recipes.withColumn("_copies", F.count(F.lit(1)).over(Window.partitionBy("slice_id"))).join(roles, RECORD, "left")
    stale = F.exists(F.map_entries("hashes"), lambda e: ~F.element_at("_now", e["key"]).eqNullSafe(e["value"]))
    status = (
        F.when(F.col("_copies") > 1, "repeated_slice").when(F.col("_now").isNull(), "unknown_source")
        .when(~F.coalesce((F.col("start_row") >= 0) & (F.col("start_row") < F.col("stop_row")), F.lit(False)), "invalid_window")
        .when(stale | (F.size("hashes") < F.size("_now")), "hash_differs_from_recipe")
    )
    gated = written(asked.withColumn("status", status).drop("_copies", "_now", "hashes"), "recipes")
    spans = gated.filter(F.col("status").isNull())
    held = fleet.rows.join(spans.select("slice_id", RECORD, "start_row", "stop_row"), RECORD).filter((F.col("row") >= F.col("start_row")) & (F.col("row") < F.col("stop_row")))
    held = written(held, "slices")
    sizes = held.groupBy("slice_id").agg(F.count(F.lit(1)).alias("_n"), F.min_by("time_s", "row").alias("_t0"))
    judged = gated.join(sizes, "slice_id", "left").withColumn("status", F.coalesce(
        "status", F.when(F.coalesce("_n", F.lit(0)) < F.col("stop_row") - F.col("start_row"), "incomplete_selection"), F.lit("ok")
    ))
    whole = judged.filter(F.col("status") == "ok").select("slice_id", "_t0")
    others = [c for c in fleet.rows.columns if c not in (RECORD, "row", "time_s")]
    slices = held.join(whole, "slice_id").select(
        "slice_id", RECORD, (F.col("row") - F.col("start_row")).alias("row"), (F.col("time_s") - F.col("_t0")).alias("time_s"), *others
    )
    return slices, judged.drop("_n", "_t0")
