"""Many window queries answered from one scan.

A window is ``record_id, [start_row, stop_row)``. Windows meet rows in buckets of ``JOIN_BLOCK_ROWS`` rows, so a
long record spreads over many tasks. Aggregates combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from teleproof import settings
from teleproof.operators.blocks import RECORD, block_of, fits, neighbours
from teleproof.operators.pyramid import BATCH, block_stats, ranked_values, run_summaries, summaries

WINDOW = [RECORD, "start_row", "stop_row"]
STATS = ["mean", "median", "min", "max", "count"]
PAGE_ROWS = 512
READ_CAP_ROWS = 200


def valid_window() -> Column:
    return (F.col("start_row") >= 0) & (F.col("start_row") < F.col("stop_row"))


def extents(rows: DataFrame) -> DataFrame:
    """Bounds of each record: ``first_row``, ``end_row``."""
    return rows.groupBy(RECORD).agg(F.min("row").alias("first_row"), (F.max("row") + 1).alias("end_row"))


def rows_in_windows(rows: DataFrame, windows: DataFrame, size: int | None = None) -> DataFrame:
    """Rows joined to the windows that hold them; window columns stay attached. Windows must be valid."""
    size = size or settings.JOIN_BLOCK_ROWS
    inside = (F.col("row") >= F.col("start_row")) & (F.col("row") < F.col("stop_row"))
    if fits(rows, size):
        return rows.join(windows, [RECORD]).filter(inside)
    # A window reaches no farther than its record, however large a stop it asks for.
    clipped = windows.join(extents(rows), RECORD).withColumns({
        "_lo": F.greatest("start_row", "first_row"), "_hi": F.least("stop_row", "end_row") - 1,
    }).filter(F.col("_lo") <= F.col("_hi"))
    spread = clipped.withColumn("_bucket", F.explode(F.sequence(block_of("_lo", size), block_of("_hi", size)))).select(*windows.columns, "_bucket")
    return rows.withColumn("_bucket", block_of("row", size)).join(spread, [RECORD, "_bucket"]).filter(inside).drop("_bucket")


def slice_rows(rows: DataFrame, start: Column, stop: Column) -> DataFrame:
    return rows.filter((F.col("row") >= start) & (F.col("row") < stop))


def window_stats(rows: DataFrame, windows: DataFrame, channels: Sequence[str], blocks: DataFrame | None = None) -> DataFrame:
    """All statistics of every distinct window and channel.

    Columns: window, ``channel, n_rows, n_values, mean, median, min, max``. A window with a missing reading has
    ``n_values < n_rows``; callers refuse it instead of imputing. ``blocks`` are the ``summaries`` of ``rows``, if an ingest wrote them.
    """
    every = F.array(*[F.lit(c) for c in channels])
    distinct = windows.select(*WINDOW).filter(valid_window()).distinct()
    return asked_stats(rows, distinct.select(*WINDOW, every.alias("_asked"), every.alias("_middle")), channels, blocks)


def asked_stats(rows: DataFrame, asked: DataFrame, channels: Sequence[str], blocks: DataFrame | None = None) -> DataFrame:
    """``window_stats`` of distinct windows for the channels each lists in ``_asked``, medians for those in ``_middle`` only."""
    used = summaries(rows, channels) if blocks is None else blocks
    stats = block_stats(rows, asked.select(*WINDOW, "_asked"), channels, used, WINDOW)
    return stats.join(medians(rows, asked.select(*WINDOW, "_middle"), channels), [*WINDOW, "channel"], "left").select(
        *WINDOW, "channel", "n_rows", "n_values", "mean", "median", "min", "max"
    )


def medians(rows: DataFrame, asked: DataFrame, channels: Sequence[str], batch: int = BATCH) -> DataFrame:
    """Exact medians of the channels in ``_middle``: ``window, channel, median``.

    A window of at most ``batch`` rows is one group; a longer one is searched by counted pivots.
    """
    wanted, length = asked.filter(F.size("_middle") > 0), F.col("stop_row") - F.col("start_row")
    base = rows.select(RECORD, "row", *channels)
    packed = rows_in_windows(base, wanted.filter(length <= batch)).groupBy(*WINDOW).agg(*[
        F.struct(F.lit(c).alias("channel"), F.median(F.when(F.array_contains("_middle", c), F.col(c))).alias("median")).alias(f"_s{i}")
        for i, c in enumerate(channels)
    ])
    short = packed.select(*WINDOW, F.inline(F.array(*[f"_s{i}" for i in range(len(channels))])))
    long = wanted.filter(length > batch)
    if long.isEmpty():
        return short
    keys = [*WINDOW, "channel"]
    held = rows_in_windows(base, long).unpivot([*WINDOW, "_middle"], list(channels), "channel", "v")
    held = held.filter(F.col("v").isNotNull() & F.array_contains("_middle", F.col("channel"))).drop("_middle")
    middle = F.array_distinct(F.array(F.expr("(_n - 1) div 2"), F.expr("_n div 2")))
    ranks = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(*keys, F.explode(middle).alias("_rank"))
    found = ranked_values(held, ranks, keys, batch)
    return short.unionByName(found.groupBy(*keys).agg(((F.min("value") + F.max("value")) / 2).alias("median")))


def stat_value(stat: Column) -> Column:
    """Pick the asked statistic from a ``window_stats`` row."""
    return F.coalesce(
        *[F.when(stat == s, F.col(s)) for s in STATS if s != "count"],
        F.when(stat == "count", F.col("n_rows").cast("double")),
    )


def stat_queries(rows: DataFrame, queries: DataFrame, channels: Sequence[str], blocks: DataFrame | None = None) -> DataFrame:
    """``queries`` (id columns, window, ``channel``, ``stat``) with ``status`` and ``value``; only what is asked is computed, once per window and channel."""
    asked = queries.filter(valid_window()).groupBy(*WINDOW).agg(
        F.collect_set("channel").alias("_asked"), F.collect_set(F.when(F.col("stat") == "median", F.col("channel"))).alias("_middle")
    )
    answered = queries.join(asked_stats(rows, asked, channels, blocks), [*WINDOW, "channel"], "left")
    status = (
        F.when(~valid_window(), "invalid_window")
        .when(F.col("n_rows").isNull() | (F.col("n_rows") < F.col("stop_row") - F.col("start_row")), "outside_record_or_channel")
        .when(F.col("n_values") < F.col("n_rows"), "missing_values")
        .when(~F.col("stat").isin(STATS), "unknown_statistic")
        .otherwise("ok")
    )
    return answered.withColumn("status", status).select(
        *queries.columns, "status", F.when(F.col("status") == "ok", stat_value(F.col("stat"))).alias("value")
    )


def window_deltas(rows: DataFrame, pairs: DataFrame, channels: Sequence[str], blocks: DataFrame | None = None) -> DataFrame:
    """Mean of the after window minus mean of the before window.

    ``pairs`` has ``pair_id, record_id, channel, before_start, before_stop, after_start, after_stop``.
    """
    sides = pairs.select(
        "pair_id", RECORD, "channel",
        F.inline(F.array(*[
            F.struct(F.lit(s).alias("side"), F.col(f"{s}_start").alias("start_row"), F.col(f"{s}_stop").alias("stop_row"))
            for s in ("before", "after")
        ])),
    ).withColumn("stat", F.lit("mean"))
    means = stat_queries(rows, sides, channels, blocks)

    def pick(side: str, column: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(column)))

    return means.groupBy("pair_id", RECORD, "channel").agg(
        pick("before", "value").alias("before_mean"),
        pick("after", "value").alias("after_mean"),
        (pick("after", "value") - pick("before", "value")).alias("value"),
        F.coalesce(F.max(F.when(F.col("status") != "ok", F.col("status"))), F.lit("ok")).alias("status"),
    )


def with_previous_time(rows: DataFrame, block_rows: int | None = None) -> DataFrame:
    return neighbours(rows, {"prev_time": ("time_s", -1)}, block_rows=block_rows)


def inner_pair() -> Column:
    """The row and its predecessor both lie in the window."""
    return F.col("row") > F.col("start_row")


def monotonic_status(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """Per window: does time increase strictly, and does it never decrease?"""
    held = rows_in_windows(with_previous_time(rows.select(RECORD, "row", "time_s")), windows.select(*WINDOW).distinct())
    step = F.when(inner_pair(), F.col("time_s") - F.col("prev_time"))
    return held.groupBy(*WINDOW).agg(
        F.coalesce(F.min(step) > 0, F.lit(True)).alias("strictly_increasing"),
        F.coalesce(F.min(step) >= 0, F.lit(True)).alias("non_decreasing"),
    )


def reading_of(channel: Column, channels: Sequence[str]) -> Column:
    """The reading of the channel a query names, from wide rows."""
    return F.coalesce(*[F.when(channel == c, F.col(c)) for c in channels])


def _answered(queries: DataFrame, runs: DataFrame, gates: Sequence[tuple[Column, str]]) -> DataFrame:
    """Queries with their run summary and a status: the window, its bounds, then ``gates`` in order."""
    status = F.when(~valid_window(), "invalid_window").when(
        F.col("_run").isNull() | (F.col("_run.n") < F.col("stop_row") - F.col("start_row")), "outside_record"
    )
    for condition, name in gates:
        status = status.when(condition, name)
    return queries.join(runs, "query_id", "left").withColumn("status", status.otherwise("ok"))


def _missing() -> tuple[Column, str]:
    return F.col("_run.ok") < F.col("_run.n"), "missing_values"


def first_crossing(rows: DataFrame, queries: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Seconds from the window's first row to the first row at or beyond the threshold (inclusive).

    ``queries`` has ``query_id``, window, ``channel, threshold, direction``. Never reached is a status, not a value.
    """
    value = lambda: reading_of(F.col("channel"), channels)
    hit = lambda: F.when(F.col("direction") == "above", value() >= F.col("threshold")).otherwise(value() <= F.col("threshold"))
    runs = run_summaries(
        rows.select(RECORD, "row", "time_s", *channels), queries.filter(valid_window()), ["channel", "threshold", "direction"], hit, lambda: value().isNotNull()
    )
    found = _answered(queries, runs, [
        (F.col("_run.step") <= 0, "time_not_strictly_increasing"), _missing(), (F.col("_run.first").isNull(), "not_reached"),
    ])
    return found.select(*queries.columns, "status", F.when(F.col("status") == "ok", F.col("_run.first_t") - F.col("_run.t")).alias("value"))


def first_sustained(rows: DataFrame, queries: DataFrame, channels: Sequence[str], strict_time: bool = True) -> DataFrame:
    """First run of at least ``min_records`` rows strictly beyond the threshold; null if there is none.

    ``queries`` has ``query_id``, window, ``channel, threshold, min_records, direction``. The value is in seconds
    from the first row of the window. With ``strict_time`` a window whose time stands still is refused.
    """
    value = lambda: reading_of(F.col("channel"), channels)
    hit = lambda: F.when(F.col("direction") == "below", value() < F.col("threshold")).otherwise(value() > F.col("threshold"))
    runs = run_summaries(
        rows.select(RECORD, "row", "time_s", *channels), queries.filter(valid_window()), ["channel", "threshold", "direction", "min_records"], hit,
        lambda: value().isNotNull(), "min_records",
    )
    found = _answered(queries, runs, [(F.lit(strict_time) & (F.col("_run.step") <= 0), "time_not_strictly_increasing"), _missing()])
    ok = F.col("status") == "ok"
    return found.select(
        *queries.columns, "status", F.when(ok, F.col("_run.first_t") - F.col("_run.t")).alias("value"), F.when(ok, F.col("_run.first")).alias("onset_row")
    )


def longest_zero_run(rows: DataFrame, queries: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Longest run with every chosen channel exactly zero; the earliest wins ties.

    ``queries`` has ``query_id``, window, ``channels``. The offset counts from the window's first row.
    """
    chosen = lambda c: F.array_contains("channels", c)
    hit = lambda: reduce(lambda a, b: a & b, [~chosen(c) | F.coalesce(F.col(c) == 0, F.lit(False)) for c in channels])
    present = lambda: reduce(lambda a, b: a & b, [~chosen(c) | F.col(c).isNotNull() for c in channels])
    runs = run_summaries(rows.select(RECORD, "row", "time_s", *channels), queries.filter(valid_window()), ["channels"], hit, present)
    found = _answered(queries, runs, [_missing()])
    ok = F.col("status") == "ok"
    start = F.when(ok, F.col("_run.at"))
    return found.select(
        *queries.columns, "status", F.when(ok, F.col("_run.best")).alias("value"), start.alias("run_start"), (start + F.col("_run.best")).alias("run_stop"),
        F.when(ok, F.col("_run.at_t") - F.col("_run.t")).alias("run_start_offset_s"),
    )


def profile_bins(rows: DataFrame, queries: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Contiguous acquisition-row bins of a window: ``query_id, bin, channel`` with ranges and statistics.

    ``queries`` has ``query_id``, window, ``bins``; at most one bin per row. A bin with missing readings has ``n_values < n_rows`` and no statistics.
    """
    held = rows_in_windows(rows.select(RECORD, "row", "time_s", *channels), queries.filter(valid_window()))
    n = F.col("stop_row") - F.col("start_row")
    count = F.least(F.col("bins").cast("bigint"), n)
    bin_no = F.floor(((F.col("row") - F.col("start_row") + 1) * count - 1) / n)
    whole = lambda c, value: F.when(F.count(c) == F.count(F.lit(1)), value(c))
    stats = [
        F.struct(
            F.lit(c).alias("channel"), F.count(c).alias("n_values"),
            whole(c, F.min).alias("min"), whole(c, F.max).alias("max"), whole(c, F.avg).alias("mean"),
        ).alias(f"_s{i}")
        for i, c in enumerate(channels)
    ]
    packed = held.groupBy("query_id", RECORD, bin_no.alias("bin")).agg(
        F.min("row").alias("bin_start"), (F.max("row") + 1).alias("bin_stop"), F.count(F.lit(1)).alias("n_rows"),
        F.min_by("time_s", "row").alias("first_time_s"), F.max_by("time_s", "row").alias("last_time_s"), *stats,
    )
    fixed = ["query_id", RECORD, "bin", "bin_start", "bin_stop", "n_rows", "first_time_s", "last_time_s"]
    return packed.select(*fixed, F.inline(F.array(*[f"_s{i}" for i in range(len(channels))])))


def page_bounds(queries: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """First page of each raw read: ``page_stop`` and the row to continue from."""
    stop = F.least(F.col("stop_row"), F.col("start_row") + page_rows)
    return queries.withColumn("requested_stop_row", F.col("stop_row")).withColumn("page_stop", stop).withColumn(
        "next_start_row", F.when(F.col("page_stop") < F.col("stop_row"), F.col("page_stop"))
    )


def paged_read(rows: DataFrame, queries: DataFrame, channels: Sequence[str], page_rows: int = PAGE_ROWS) -> DataFrame:
    """Rows of the first page of each query."""
    pages = page_bounds(queries, page_rows).drop("stop_row").withColumnRenamed("page_stop", "stop_row")
    return rows_in_windows(rows.select(RECORD, "row", "time_s", *channels), pages.filter(valid_window()))


def bounded_read(rows: DataFrame, queries: DataFrame, channels: Sequence[str], cap: int = READ_CAP_ROWS) -> DataFrame:
    """Rows of windows up to ``cap`` rows with the time since ``origin_row``; larger windows answer ``size_cap``.

    ``queries`` has ``query_id``, window and ``origin_row``, the first row of the permitted scope.
    """
    small = F.col("stop_row") - F.col("start_row") <= cap
    held = rows_in_windows(rows.select(RECORD, "row", "time_s", *channels), queries.filter(valid_window() & small))
    starts = rows.select(RECORD, F.col("row").alias("origin_row"), F.col("time_s").alias("_t0"))
    origin = queries.select(RECORD, "origin_row").distinct().join(starts, [RECORD, "origin_row"])
    read = held.join(origin, [RECORD, "origin_row"]).select(
        "query_id", RECORD, F.lit("ok").alias("status"), "row", (F.col("time_s") - F.col("_t0")).alias("time_offset"), *channels
    )
    refused = queries.filter(~(valid_window() & small)).select(
        "query_id", RECORD, F.when(valid_window(), "size_cap").otherwise("invalid_window").alias("status"),
        F.lit(None).cast("bigint").alias("row"), F.lit(None).cast("double").alias("time_offset"),
        *[F.lit(None).cast("double").alias(c) for c in channels],
    )
    return read.unionByName(refused)


def scope_check(queries: DataFrame, scope: DataFrame) -> DataFrame:
    """Status of each window against the permitted ``record_id, first_row, end_row``."""
    inside = (F.col("start_row") >= F.col("first_row")) & (F.col("stop_row") <= F.col("end_row"))
    status = (
        F.when(F.col("end_row").isNull(), "unknown_record")
        .when(~valid_window(), "invalid_window")
        .when(~inside, "outside_scope")
        .otherwise("ok")
    )
    return queries.join(scope, RECORD, "left").withColumn("status", status).select(*queries.columns, "status")


def slice_last_seconds(rows: DataFrame, seconds: float, windows: DataFrame | None = None) -> DataFrame:
    """Rows of the closing ``seconds`` of a window (inclusive): time at or after the last time minus ``seconds - 1``.

    Keeps whole-window order: a window whose time ever decreases answers with status and no rows. Returns the
    window, ``status`` and the row range ``slice_start, slice_stop``.
    """
    if windows is None:
        windows = extents(rows).select(RECORD, F.col("first_row").alias("start_row"), F.col("end_row").alias("stop_row"))
    held = rows_in_windows(with_previous_time(rows.select(RECORD, "row", "time_s")), windows.select(*WINDOW).distinct())
    ends = held.groupBy(*WINDOW).agg(
        F.max_by("time_s", "row").alias("_end"),
        F.min(F.when(inner_pair(), F.col("time_s") - F.col("prev_time"))).alias("_step"),
    )
    # Time never decreases in an accepted window, so the slice is the closing stretch from the first late row.
    late = (
        rows_in_windows(rows.select(RECORD, "row", "time_s"), ends.filter(F.coalesce(F.col("_step"), F.lit(0)) >= 0))
        .filter(F.col("time_s") >= F.col("_end") - (seconds - 1))
        .groupBy(*WINDOW)
        .agg(F.min("row").alias("slice_start"))
    )
    status = F.when(F.col("_step") < 0, "time_decreases").otherwise("ok")
    return ends.join(late, WINDOW, "left").select(
        *WINDOW, status.alias("status"), "slice_start", F.when(F.col("slice_start").isNotNull(), F.col("stop_row")).alias("slice_stop")
    )


def slice_around_onset(onsets: DataFrame, before: int, after: int) -> DataFrame:
    """Row ranges on both sides of an onset (result of ``first_sustained``); each must lie inside the window."""
    sides = F.array(
        F.struct(F.lit("before").alias("side"), (F.col("onset_row") - before).alias("slice_start"), F.col("onset_row").alias("slice_stop")),
        F.struct(F.lit("after").alias("side"), F.col("onset_row").alias("slice_start"), (F.col("onset_row") + after).alias("slice_stop")),
    )
    inside = (F.col("slice_start") >= F.col("start_row")) & (F.col("slice_stop") <= F.col("stop_row"))
    answer = (
        F.when(F.col("_was") != "ok", F.col("_was"))
        .when(F.col("onset_row").isNull(), "no_onset")
        .when(~inside, "exceeds_window")
        .otherwise("ok")
    )
    return (
        onsets.withColumnRenamed("status", "_was")
        .select("query_id", *WINDOW, "_was", "onset_row", F.inline(sides))
        .withColumn("status", answer)
        .drop("_was")
    )


def tail_rows(rows: DataFrame, k: int) -> DataFrame:
    """The last ``k`` records, counted in rows."""
    ends = rows.groupBy(RECORD).agg(F.max("row").alias("_last"))
    return rows.join(ends, RECORD).filter(F.col("row") >= F.col("_last") - k + 1).drop("_last")


def elapsed(rows: DataFrame) -> DataFrame:
    """Seconds since the first row of the record."""
    starts = rows.filter(F.col("row") == 0).select(RECORD, F.col("time_s").alias("_t0"))
    return rows.join(starts, RECORD).withColumn("elapsed_s", F.col("time_s") - F.col("_t0")).drop("_t0")


def clock_regions(rows: DataFrame, regions: Sequence[tuple[str, float, float]]) -> DataFrame:
    """Row range of ``(name, from_s, to_s)`` after the record start, ``to_s`` excluded; it must be one stretch of rows."""
    at = F.col("elapsed_s")
    named = F.array_compact(F.array(*[F.when((at >= lo) & (at < hi), F.lit(name)) for name, lo, hi in regions]))
    inside = elapsed(rows.select(RECORD, "row", "time_s")).select(RECORD, "row", F.explode(named).alias("region"))
    found = inside.groupBy(RECORD, "region").agg(
        F.min("row").alias("start_row"), (F.max("row") + 1).alias("stop_row"), F.count(F.lit(1)).alias("n_rows")
    )
    one = F.col("stop_row") - F.col("start_row") == F.col("n_rows")
    return found.withColumn("status", F.when(one, "ok").otherwise("not_contiguous"))


def single_phase(rows: DataFrame, is_phase: Column) -> DataFrame:
    """Row range of the rows in a phase; they must form exactly one stretch."""
    found = rows.groupBy(RECORD).agg(
        F.min(F.when(is_phase, F.col("row"))).alias("start_row"),
        (F.max(F.when(is_phase, F.col("row"))) + 1).alias("stop_row"),
        F.count_if(is_phase).alias("n_rows"),
    )
    status = (
        F.when(F.col("n_rows") == 0, "absent")
        .when(F.col("stop_row") - F.col("start_row") == F.col("n_rows"), "one_phase")
        .otherwise("not_contiguous")
    )
    return found.withColumn("status", status)
