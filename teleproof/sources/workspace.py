"""Written intermediate tables in the shared folder of the cluster.

A table used more than once downstream is written once and read back as Parquet: the lineage ends there, lost
executors re-read files instead of recomputing, and readers get column pruning and pushed filters.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from teleproof.operators.blocks import RECORD, with_length

_working_copies: dict[tuple, tuple[str, str | None, int | None]] = {}
_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only for a local session without one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _own_folders[app]


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and continue from the files."""
    path = f"{shared_folder(df.sparkSession)}/teleproof/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def opened(spark: SparkSession, path: str, name: str | None) -> DataFrame:
    # A table in the catalog reads as empty where its files are gone; their folder does not.
    held = spark.read.parquet(path)
    return held if name is None else spark.table(name)


def working_copy(source: DataFrame, label: str, build: Callable[[], tuple[DataFrame, int | None]]) -> DataFrame:
    """The ingested form of ``source``, reused while its input files keep their names, sizes and times of change.

    ``build`` gives the rows and, if these are dealt into tasks by record, the number of tasks: the copy is then a table bucketed by record, so that what goes
    by record after it needs no shuffle. The longest record is measured once; operators use it to skip block handling where records are short.
    """
    spark = source.sparkSession
    files = source.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    known = files.agg(F.count("*"), F.sum(F.xxhash64(*files.columns).cast("decimal(20,0)"))).first()
    key = (spark.sparkContext.applicationId, label, *known)
    if key in _working_copies:
        path, name, longest = _working_copies[key]
        try:
            return with_length(opened(spark, path, name), longest)
        except AnalysisException:
            del _working_copies[key]
    made = f"{label}-{uuid.uuid4().hex}"
    path, name = f"{shared_folder(spark)}/teleproof/{made}", None
    rows, ways = build()
    if ways is None:
        rows.write.mode("errorifexists").parquet(path)
    else:
        name = f"teleproof_{made.replace('-', '_')}"
        rows.write.bucketBy(ways, RECORD).sortBy(RECORD, "row").option("path", path).format("parquet").saveAsTable(name)
    held = opened(spark, path, name)
    last = held.agg(F.max("row")).first()[0] if "row" in held.columns else None
    longest = None if last is None else last + 1
    _working_copies[key] = path, name, longest
    return with_length(held, longest)
