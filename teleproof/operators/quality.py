"""Time-axis quality of windows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from teleproof.functions.scalar import QUALITY_METRICS
from teleproof.operators.blocks import RECORD, first_k
from teleproof.operators.windows import WINDOW, inner_pair, rows_in_windows, valid_window, with_previous_time


def quality_profile(rows: DataFrame, windows: DataFrame, channels: Sequence[str]) -> DataFrame:
    """The quality metrics of every distinct window.

    Rows are first combined per (window, time): a group with more than one value of a channel is a conflict. Order
    metrics (reversals, gaps, span) ride along, so one pass serves both.
    """
    distinct = windows.select(*WINDOW).filter(valid_window()).distinct()
    held = rows_in_windows(with_previous_time(rows.select(RECORD, "row", "time_s", *channels)), distinct)
    step = F.when(inner_pair(), F.col("time_s") - F.col("prev_time"))
    groups = held.withColumn("_step", step).groupBy(*WINDOW, "time_s").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("_step") < 0).alias("_back"),
        F.count_if(F.col("_step") > 1).alias("_gap"),
        F.max("_step").alias("_max"),
        F.min("row").alias("_first"),
        F.max("row").alias("_last"),
        *[(F.min(c) != F.max(c)).alias(f"_x{i}") for i, c in enumerate(channels)],
    )
    any_conflict = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"_x{i}"), F.lit(False)) for i in range(len(channels))])
    names = sorted(range(len(channels)), key=lambda i: channels[i])
    changed = F.array_compact(F.array(*[F.when(F.max(f"_x{i}"), F.lit(channels[i])) for i in names]))
    return (
        groups.groupBy(*WINDOW)
        .agg(
            F.sum("_n").alias("rows"),
            (F.sum("_n") - F.count(F.lit(1))).alias("duplicate_extra_rows"),
            F.count_if(any_conflict).alias("conflicting_timestamp_groups"),
            changed.alias("conflict_channels"),
            F.sum("_back").alias("time_reversals"),
            F.sum("_gap").alias("gaps_gt_1s"),
            F.coalesce(F.max("_max"), F.lit(0.0)).alias("max_gap_s"),
            (F.max_by("time_s", "_last") - F.min_by("time_s", "_first")).alias("elapsed_span_s"),
        )
        .withColumn("conflict_channel_count", F.size("conflict_channels").cast("bigint"))
        .select(*WINDOW, *QUALITY_METRICS, "conflict_channels")
    )


def metric_long(profile: DataFrame) -> DataFrame:
    """One row per window and metric."""
    numbers = profile.select(*WINDOW, *[F.col(m).cast("double").alias(m) for m in QUALITY_METRICS])
    return numbers.unpivot(WINDOW, QUALITY_METRICS, "metric", "value")


def conflict_groups(rows: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Times of a record with more than one row and differing readings, and the channels that differ."""
    changed = F.array_compact(F.array(*[F.when(F.min(c) != F.max(c), F.lit(c)) for c in sorted(channels)]))
    return (
        rows.groupBy(RECORD, "time_s")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.min("row").alias("first_row"), changed.alias("changed_channels"))
        .filter(F.size("changed_channels") > 0)
    )


def conflict_examples(rows: DataFrame, channels: Sequence[str], k: int = 3) -> DataFrame:
    """The first ``k`` conflicts of each record, in order of their first row."""
    return first_k(conflict_groups(rows, channels), [RECORD], ["first_row"], k, F.col("time_s"))


def duplicate_times(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows minus distinct times, per window."""
    held = rows_in_windows(rows.select(RECORD, "row", "time_s"), windows.select(*WINDOW).filter(valid_window()).distinct())
    per_time = held.groupBy(*WINDOW, "time_s").agg(F.count(F.lit(1)).alias("_n"))
    return per_time.groupBy(*WINDOW).agg((F.sum("_n") - F.count(F.lit(1))).alias("value"))


def non_increasing_pairs(rows: DataFrame) -> DataFrame:
    """Neighbouring rows whose time does not increase."""
    return (
        with_previous_time(rows.select(RECORD, "row", "time_s"))
        .filter(F.col("time_s") <= F.col("prev_time"))
        .select(RECORD, (F.col("row") - 1).alias("row_a"), F.col("row").alias("row_b"))
    )


def missing_counts(rows: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Missing readings per record and channel."""
    packed = rows.groupBy(RECORD).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in channels])
    return packed.unpivot([RECORD], list(channels), "channel", "missing")
