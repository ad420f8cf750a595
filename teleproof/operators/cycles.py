"""Operating cycles inside a record and the capacity of a corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from teleproof.operators.blocks import RECORD, mask_runs, neighbours, running
from teleproof.operators.detect import zero_runs
from teleproof.operators.windows import first_sustained, window_stats
from teleproof.sources.workspace import written

CYCLE = [RECORD, "cycle"]


def with_cycles(rows: DataFrame, active: Column, block_rows: int | None = None) -> DataFrame:
    """Number the cycles of each record from 1; a cycle starts where ``active`` turns on, and at the first row."""
    flagged = neighbours(rows.withColumn("_on", active), {"_was": ("_on", -1)}, block_rows=block_rows)
    edge = F.when(F.col("_on") & ~F.col("_was"), 1).otherwise(0)
    counted = running(flagged, [RECORD], edge, "_edges", "sum", block_rows=block_rows)
    return counted.withColumn("cycle", F.col("_edges") + 1).drop("_on", "_was", "_edges")


def cycle_segments(cycled: DataFrame) -> DataFrame:
    return cycled.groupBy(*CYCLE).agg(
        F.min("row").alias("start_row"), (F.max("row") + 1).alias("stop_row"), F.min_by("time_s", "row").alias("start_time_s")
    )


def phase_intervals(cycled: DataFrame, phase: Column, min_rows: int) -> DataFrame:
    """Stretches of a phase inside a cycle, at least ``min_rows`` long."""
    runs = mask_runs(cycled.filter(phase), CYCLE)
    return runs.filter(F.col("stop_row") - F.col("start_row") >= min_rows)


def active_runs(cycled: DataFrame, branches: Sequence[tuple[str, Column, float]], min_rows: int) -> DataFrame:
    """Active stretches per branch ``(name, condition, nominal start)``.

    ``start_minus_nominal_s`` counts from the cycle start; ``span_s`` runs from the first to the last row.
    """
    tags = F.array_compact(F.array(*[
        F.when(on, F.struct(F.lit(name).alias("branch"), F.lit(float(nominal)).alias("nominal_s"))) for name, on, nominal in branches
    ]))
    hits = cycled.select(*CYCLE, "row", "time_s", F.inline(tags))
    runs = mask_runs(hits, [*CYCLE, "branch", "nominal_s"], carry=["time_s"]).filter(
        F.col("stop_row") - F.col("start_row") >= min_rows
    )
    starts = cycle_segments(cycled).select(*CYCLE, "start_time_s")
    return runs.join(starts, CYCLE).select(
        *CYCLE, "branch", "start_row", "stop_row",
        (F.col("first_time_s") - F.col("start_time_s") - F.col("nominal_s")).alias("start_minus_nominal_s"),
        (F.col("last_time_s") - F.col("first_time_s")).alias("span_s"),
    )


def interval_features(
    rows: DataFrame, intervals: DataFrame, channel: str, thresholds: Sequence[float], min_records: int, tail: int = 60
) -> DataFrame:
    """Median, closing median and the sustained onset over each threshold, for each interval and threshold."""
    intervals = intervals.select(*CYCLE, "start_row", "stop_row")
    tails = intervals.withColumn("tail_start", F.greatest("start_row", F.col("stop_row") - tail))
    tail_windows = tails.select(RECORD, F.col("tail_start").alias("start_row"), "stop_row")
    stats = window_stats(rows, intervals.select(RECORD, "start_row", "stop_row").unionByName(tail_windows), [channel])
    stats = stats.select(RECORD, "start_row", "stop_row", "median")
    closing = stats.withColumnsRenamed({"start_row": "tail_start", "median": "tail_median"})
    asked = intervals.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))).select(
        F.concat_ws("|", *[F.col(c).cast("string") for c in (RECORD, "start_row", "threshold")]).alias("query_id"),
        *CYCLE, "start_row", "stop_row", F.lit(channel).alias("channel"), "threshold",
        F.lit(min_records).alias("min_records"), F.lit("above").alias("direction"),
    )
    onsets = first_sustained(rows, asked, [channel], strict_time=False)
    return (
        tails.join(stats, [RECORD, "start_row", "stop_row"])
        .join(closing, [RECORD, "tail_start", "stop_row"])
        .join(
            onsets.select(*CYCLE, "start_row", "threshold", "onset_row", F.col("value").alias("offset_s")),
            [*CYCLE, "start_row"],
        )
        .select(*CYCLE, "start_row", "stop_row", "median", "tail_median", "threshold", "onset_row", "offset_s")
    )


def source_ranges(features: DataFrame, runs: DataFrame, segments: DataFrame, threshold: float, low_median: float) -> DataFrame:
    """Per record: recovery range at one threshold, low medians, and the start timing of its active runs."""
    at = features.filter(F.col("threshold") == threshold).groupBy(RECORD).agg(
        F.count("offset_s").alias("recovery_count"), F.min("offset_s").alias("recovery_min_s"),
        F.max("offset_s").alias("recovery_max_s"), F.count_if(F.col("median") <= low_median).alias("low_median_count"),
    )
    timing = runs.groupBy(RECORD).agg(
        F.count(F.lit(1)).alias("observed_runs"), F.min("start_minus_nominal_s").alias("start_min_s"),
        F.max("start_minus_nominal_s").alias("start_max_s"),
    )
    cycles = segments.groupBy(RECORD).agg(F.count(F.lit(1)).alias("cycles"), F.max("stop_row").alias("n_rows"))
    filled = cycles.join(at, RECORD, "left").join(timing, RECORD, "left")
    return filled.fillna(0, ["recovery_count", "low_median_count", "observed_runs"])


def label_transitions(rows: DataFrame, label: str) -> DataFrame:
    """Rows whose label differs from the row before."""
    stepped = neighbours(rows.select(RECORD, "row", label), {"previous": (label, -1)})
    return stepped.filter((F.col("row") > 0) & ~F.col(label).eqNullSafe(F.col("previous"))).select(
        RECORD, "row", F.col("previous").alias("label_from"), F.col(label).alias("label_to")
    )


def load_timing(runs: DataFrame) -> DataFrame:
    """Per record and branch: its active runs and the range of their starts against the nominal ones."""
    start = "start_minus_nominal_s"
    return runs.groupBy(RECORD, "branch").agg(F.count(F.lit(1)).alias("observed_runs"), F.min(start).alias("start_min_s"), F.max(start).alias("start_max_s"))


def capacity_audit(
    rows: DataFrame, active: Column, phase: Column, channel: str, normal: DataFrame, min_phase_rows: int,
    threshold: float, min_records: int, low_median: float, branches: Sequence[tuple[str, Column, float]], min_run_rows: int, zero_channels: Sequence[str],
) -> DataFrame:
    """One row of corpus totals; ``normal`` is ``record_id, is_normal``.

    ``branches`` are those of ``active_runs``; a zero row has all ``zero_channels`` at zero.
    """
    cycled = written(with_cycles(rows, active), "cycles")
    intervals = written(phase_intervals(cycled, phase, min_phase_rows), "intervals")
    features = interval_features(rows, intervals, channel, [threshold], min_records)
    runs = active_runs(cycled, branches, min_run_rows)
    per_record = source_ranges(features, runs, cycle_segments(cycled), threshold, low_median)
    lows = intervals.groupBy(RECORD).agg(F.count(F.lit(1)).alias("lows"))
    zero = zero_runs(rows, zero_channels).groupBy(RECORD).agg(
        F.count(F.lit(1)).alias("zero_ranges"), F.sum(F.col("stop_row") - F.col("start_row")).alias("zero_rows")
    )
    flagged = per_record.join(normal, RECORD).join(lows, RECORD, "left").join(zero, RECORD, "left")
    n, yes = F.col("is_normal"), F.lit(0).cast("bigint")

    def total(column: str, condition: Column | None = None) -> Column:
        value = F.col(column) if condition is None else F.when(condition, F.col(column)).otherwise(yes)
        return F.coalesce(F.sum(value), yes)

    return flagged.agg(
        F.count(F.lit(1)).alias("sources"), F.count_if(n).alias("normal_sources"), F.count_if(~n).alias("fault_sources"),
        total("n_rows").alias("raw_rows"), total("cycles").alias("cycles"), total("cycles", n).alias("normal_cycles"),
        total("cycles", ~n).alias("fault_cycles"), total("lows", n).alias("normal_low_intervals"),
        total("low_median_count", n).alias("normal_low_median_count"), total("recovery_count", n).alias("normal_recovery_count"),
        total("observed_runs").alias("load_runs"), total("zero_rows").alias("zero_rows"), total("zero_ranges").alias("zero_ranges"),
    )
