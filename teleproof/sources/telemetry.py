"""One telemetry experiment with declared columns, its side files and their hashes.

Reading never guesses a type, never drops a row and never truncates: everything that breaks a rule comes back as a row
of the violations table. The work is that of ``fleet``, which loads any number of files.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from teleproof.operators.blocks import RECORD
from teleproof.sources.fleet import MANIFEST, load_fleet, plain_path, streamed_hashes


@dataclass(frozen=True)
class Auxiliary:
    path: str
    time_column: str
    fields: Sequence[str]
    role: str


@dataclass(frozen=True)
class Experiment:
    """One manifest entry: a telemetry file, its columns and its side tables."""

    experiment_id: str
    telemetry_path: str
    time_column: str
    channels: Sequence[str]
    time_kind: str = "seconds"
    time_format: str | None = None
    auxiliary: Sequence[Auxiliary] = field(default_factory=tuple)


class HeaderError(ValueError):
    """The header of a file does not carry the declared columns, or two files declare the same one."""


HEADER_ISSUES = ["missing_columns", "duplicate_columns", "colliding_fields"]


def manifest_of(spark: SparkSession, entry: Experiment) -> DataFrame:
    """The files of an experiment as manifest rows of ``load_fleet``."""
    times = (entry.time_kind, entry.time_format)
    rows = [(entry.experiment_id, "telemetry", entry.telemetry_path, entry.time_column, *times, list(entry.channels), None)]
    rows += [(entry.experiment_id, a.role, a.path, a.time_column, *times, list(a.fields), None) for a in entry.auxiliary]
    return spark.createDataFrame(rows, MANIFEST)


def load_experiment(spark: SparkSession, entry: Experiment, reject_missing: bool = False) -> tuple[DataFrame, DataFrame]:
    """Telemetry and context of one experiment, joined by position, and the violations found on the way.

    Private labels are hashed and never opened. With ``reject_missing`` a missing reading is a violation, otherwise only later queries over it are
    refused. A file without rows, or one that changes while it is read, is a violation too; a header without the declared columns is an error.
    """
    context = [f for a in entry.auxiliary if a.role == "context" for f in a.fields]
    fleet = load_fleet(spark, manifest_of(spark, entry), entry.channels, list(dict.fromkeys(context)), reject_missing)
    wrong = fleet.violations.filter(F.col("issue").isin(HEADER_ISSUES)).select("issue", "path").first()
    if wrong is not None:
        raise HeaderError(f"{wrong['issue']}: {wrong['path'] or entry.experiment_id}")
    return fleet.rows, fleet.violations.select(RECORD, "row", "issue")


def experiment_hashes(spark: SparkSession, entry: Experiment) -> DataFrame:
    """Content hash of every file of an experiment, labels included."""
    files = manifest_of(spark, entry).select(plain_path(F.col("path")).alias("path"), F.col("source_id").alias(RECORD))
    return streamed_hashes(files)


def changed_during_read(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files whose hash differs between two snapshots."""
    late = after.select("path", F.col("sha256").alias("_after"))
    return before.join(late, "path", "left").filter(~F.col("sha256").eqNullSafe(F.col("_after"))).select("path")


# Name endings of the side files of a source.
CONDITION_SUFFIX = "_Work_Condition.csv"
LABEL_SUFFIX = "_AnomalyLabel.csv"


def source_files(telemetry_path: str) -> tuple[str, str, str]:
    """Telemetry, work-condition and label files of a source, by the naming convention of its folder."""
    stem = telemetry_path.removesuffix(".csv")
    return telemetry_path, stem + CONDITION_SUFFIX, stem + LABEL_SUFFIX


def write_working_copy(rows: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    """Parquet ordered by record and row: window filters then skip row groups by their statistics."""
    (
        rows.repartitionByRange(RECORD, "row").sortWithinPartitions(RECORD, "row")
        .write.mode("errorifexists").option("maxRecordsPerFile", rows_per_file).parquet(path)
    )
