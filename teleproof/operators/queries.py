"""A table of typed queries answered in one plan; failures are rows with a status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from teleproof.functions.scalar import QUALITY_METRICS
from teleproof.operators.blocks import RECORD
from teleproof.operators.quality import metric_long, quality_profile
from teleproof.operators.windows import (
    PAGE_ROWS,
    STATS,
    WINDOW,
    extents,
    first_sustained,
    longest_zero_run,
    page_bounds,
    paged_read,
    profile_bins,
    stat_queries,
)
from teleproof.sources.workspace import written

# The fields each operation takes besides record, operation and window.
OPERATION_FIELDS = {
    "read": ["channels"],
    "profile": ["channels", "bins"],
    "stat": ["channel", "stat"],
    "quality": ["metric"],
    "first_sustained": ["channel", "threshold", "min_records", "direction"],
    "longest_zero_run": ["channels"],
}
OPTIONAL_FIELDS = ["channels", "channel", "stat", "metric", "bins", "threshold", "min_records", "direction"]
# Accepted ranges.
MAX_BINS = 64
MAX_RECORDS = 100
MAX_CHANNELS = 40


def query_schema(record: T.DataType | None = None) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", T.StringType()),
        T.StructField(RECORD, record or T.LongType()),
        T.StructField("op", T.StringType()),
        T.StructField("start_row", T.LongType()),
        T.StructField("stop_row", T.LongType()),
        T.StructField("channels", T.ArrayType(T.StringType())),
        T.StructField("channel", T.StringType()),
        T.StructField("stat", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("bins", T.IntegerType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("min_records", T.IntegerType()),
        T.StructField("direction", T.StringType()),
    ])


def shape_status() -> Column:
    """Are exactly the fields of the operation present, with values in range?"""
    exact = F.lit(False)
    for op, fields in OPERATION_FIELDS.items():
        present = F.lit(True)
        for f in OPTIONAL_FIELDS:
            present = present & (F.col(f).isNotNull() if f in fields else F.col(f).isNull())
        exact = F.when(F.col("op") == op, present).otherwise(exact)
    in_range = (
        F.coalesce(F.col("bins").between(1, MAX_BINS), F.lit(True))
        & F.coalesce(F.col("min_records").between(1, MAX_RECORDS), F.lit(True))
        & F.coalesce(F.size("channels").between(1, MAX_CHANNELS) | F.col("channels").isNull(), F.lit(True))
        & F.coalesce(F.col("stat").isin(STATS), F.lit(True))
        & F.coalesce(F.col("metric").isin(QUALITY_METRICS), F.lit(True))
        & F.coalesce(F.col("direction").isin("above", "below"), F.lit(True))
    )
    return (
        F.when(F.col("op").isNull() | ~F.col("op").isin(list(OPERATION_FIELDS)), "unknown_operation")
        .when(~exact, "unexpected_or_missing_fields")
        .when(~in_range, "value_out_of_range")
        .otherwise("ok")
    )


def gate(queries: DataFrame, rows: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Status of each query before it runs: shape, record, window, channels."""
    declared = F.array(*[F.lit(c) for c in channels])
    asked = F.coalesce("channels", F.when(F.col("channel").isNotNull(), F.array("channel")), F.array().cast("array<string>"))
    repeated = F.size(F.array_distinct(asked)) < F.size(asked)
    undeclared = F.size(F.array_except(asked, declared)) > 0
    status = (
        F.when(F.col("_shape") != "ok", F.col("_shape"))
        .when(F.col("end_row").isNull(), "unknown_record")
        .when(
            ~((F.col("start_row") >= F.col("first_row")) & (F.col("start_row") < F.col("stop_row")) & (F.col("stop_row") <= F.col("end_row"))),
            "window_outside_record",
        )
        .when(repeated | undeclared, "undeclared_or_repeated_channel")
        .otherwise("ok")
    )
    return (
        queries.withColumn("_shape", shape_status()).join(extents(rows), RECORD, "left").withColumn("status", status)
        .select(*queries.columns, "status")
    )


def accepted(rows: DataFrame, queries: DataFrame, channels: Sequence[str], op: str) -> DataFrame:
    """The queries of one operation that pass the gate."""
    return gate(queries.filter(F.col("op") == op), rows, channels).filter(F.col("status") == "ok").drop("status", "channel")


def query_rows(rows: DataFrame, queries: DataFrame, channels: Sequence[str]) -> DataFrame:
    """The rows that accepted ``read`` queries ask for, page by page: ``query_id, record_id, row, time_s, channel, reading``.

    A query yields its first page; ``next_start_row`` of ``run_queries`` is where the next query goes on.
    """
    held = paged_read(rows, accepted(rows, queries, channels, "read"), channels)
    long = held.unpivot(["query_id", RECORD, "row", "time_s", "channels"], list(channels), "channel", "reading")
    return long.filter(F.array_contains("channels", F.col("channel"))).drop("channels")


def query_bins(rows: DataFrame, queries: DataFrame, channels: Sequence[str]) -> DataFrame:
    """The bins that accepted ``profile`` queries ask for, as ``profile_bins`` gives them, for the channels of each query."""
    asked = accepted(rows, queries, channels, "profile")
    found = profile_bins(rows, asked, channels).join(asked.select("query_id", "channels"), "query_id")
    return found.filter(F.array_contains("channels", F.col("channel"))).drop("channels")


def run_queries(rows: DataFrame, queries: DataFrame, channels: Sequence[str], blocks: DataFrame | None = None) -> DataFrame:
    """Answer every query: ``query_id, record_id, op, status, value, detail_start, detail_stop, next_start_row``.

    ``value`` is the statistic, metric, onset seconds or run length; for ``read`` and ``profile`` it counts
    the rows and bins, whose contents come from ``query_rows`` and ``query_bins``. The details are the source
    row range, or the onset row and run range. Statistics and metrics are computed once per distinct window.
    """
    gated = written(gate(queries, rows, channels), "queries")
    shown = ["query_id", RECORD, "op", "status"]

    def of(op: str) -> DataFrame:
        return gated.filter((F.col("op") == op) & (F.col("status") == "ok"))

    def answer(df: DataFrame, value: Column, start="start_row", stop="stop_row", following: Column | None = None) -> DataFrame:
        none = F.lit(None).cast("bigint")
        return df.select(
            *shown, value.cast("double").alias("value"), F.col(start).alias("detail_start"), F.col(stop).alias("detail_stop"),
            (none if following is None else following).alias("next_start_row"),
        )

    refused = gated.filter(F.col("status") != "ok").select(
        *shown, F.lit(None).cast("double").alias("value"),
        *[F.lit(None).cast("bigint").alias(c) for c in ("detail_start", "detail_stop", "next_start_row")],
    )
    def read() -> DataFrame:
        pages = page_bounds(of("read"), PAGE_ROWS)
        return answer(pages, F.col("page_stop") - F.col("start_row"), stop="page_stop", following=F.col("next_start_row"))

    def profile() -> DataFrame:
        return answer(of("profile"), F.least(F.col("bins").cast("bigint"), F.col("stop_row") - F.col("start_row")))

    def stat() -> DataFrame:
        return answer(stat_queries(rows, of("stat").drop("status"), channels, blocks), F.col("value"))

    def quality() -> DataFrame:
        metrics = metric_long(quality_profile(rows, of("quality"), channels))
        return answer(of("quality").join(metrics, [*WINDOW, "metric"]), F.col("value"))

    def sustained() -> DataFrame:
        onset = first_sustained(rows, of("first_sustained").drop("status"), channels)
        onset = onset.withColumn("onset_stop", F.col("onset_row") + F.col("min_records"))
        return answer(onset, F.col("value"), "onset_row", "onset_stop")

    def zero_run() -> DataFrame:
        runs = longest_zero_run(rows, of("longest_zero_run").drop("status"), channels)
        return answer(runs, F.col("value"), "run_start", "run_stop")

    parts = {
        "read": read, "profile": profile, "stat": stat, "quality": quality, "first_sustained": sustained,
        "longest_zero_run": zero_run,
    }
    # Only operations that occur are planned; their branches then run side by side.
    asked = {r["op"] for r in gated.filter(F.col("status") == "ok").select("op").distinct().collect()}
    out = refused
    for op, part in parts.items():
        if op in asked:
            out = out.unionByName(part())
    return out
