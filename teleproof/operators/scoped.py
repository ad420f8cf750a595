"""Tool requests of many tasks, each inside the scope of its task, answered in one plan.

``tasks``: task_id, record_id, first_row, end_row (the permitted rows), channels, tools. ``requests``: request_id, task_id, seq, tool, start_row, stop_row,
before_start, before_stop, after_start, after_stop, channels, channel, stat, threshold, direction; what a tool does not take is null.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from teleproof.operators.blocks import RECORD
from teleproof.operators.quality import duplicate_times, non_increasing_pairs
from teleproof.operators.windows import READ_CAP_ROWS, STATS, WINDOW, bounded_read, first_crossing, rows_in_windows, stat_queries, window_deltas
from teleproof.sources.workspace import written

# The tools and the arguments each takes, all of them and no others.
SUBMIT = "submit_report"
ARGUMENTS = {
    "inspect_channels": [], "read_window": ["start_row", "stop_row", "channels"], "summarize_window": ["start_row", "stop_row", "channel", "stat"],
    "compare_windows": ["before_start", "before_stop", "after_start", "after_stop", "channel"],
    "first_crossing": ["start_row", "stop_row", "channel", "threshold", "direction"], "check_time_axis": ["start_row", "stop_row"], SUBMIT: [],
}
OPTIONAL = sorted({a for names in ARGUMENTS.values() for a in names})
RANGES = [("start_row", "stop_row"), ("before_start", "before_stop"), ("after_start", "after_stop")]


def scope_gate(requests: DataFrame, tasks: DataFrame) -> DataFrame:
    """Requests with the record of their task and a ``status``, ``ok`` if the tool may run. A submitted task takes no more requests."""
    submitted = requests.filter(F.col("tool") == SUBMIT).groupBy("task_id").agg(F.min("seq").alias("_submitted"))
    scope = tasks.select("task_id", RECORD, "first_row", "end_row", F.col("channels").alias("_channels"), F.col("tools").alias("_tools"))
    exact = F.lit(False)
    for tool, taken in ARGUMENTS.items():
        fits = reduce(lambda a, b: a & b, [F.col(a).isNotNull() if a in taken else F.col(a).isNull() for a in OPTIONAL])
        exact = F.when(F.col("tool") == tool, fits).otherwise(exact)
    asked = F.coalesce("channels", F.when(F.col("channel").isNotNull(), F.array("channel")), F.array().cast("array<string>"))
    foreign = (F.size(F.array_except(asked, F.col("_channels"))) > 0) | (F.col("channels").isNotNull() & (F.size("channels") == 0))
    inverted = reduce(lambda a, b: a | b, [F.col(lo).isNotNull() & ~((F.col(lo) >= 0) & (F.col(lo) < F.col(hi))) for lo, hi in RANGES])
    outside = reduce(lambda a, b: a | b, [F.col(lo).isNotNull() & ((F.col(lo) < F.col("first_row")) | (F.col(hi) > F.col("end_row"))) for lo, hi in RANGES])
    known = F.coalesce(F.col("stat").isin(STATS) | F.col("stat").isNull(), F.lit(True)) & F.coalesce(F.col("direction").isin("above", "below"), F.lit(True))
    status = (
        F.when(F.col("_tools").isNull(), "unknown_task").when(F.col("seq") > F.col("_submitted"), "task_submitted")
        .when(~F.array_contains("_tools", F.col("tool")), "tool_not_allowed").when(~exact, "unexpected_or_missing_arguments")
        .when(foreign, "channel_outside_scope").when(inverted, "invalid_window").when(outside, "window_outside_scope").when(~known, "value_out_of_range")
        .when((F.col("tool") == "read_window") & (F.col("stop_row") - F.col("start_row") > READ_CAP_ROWS), "size_cap").otherwise("ok")
    )
    gated = requests.join(scope, "task_id", "left").join(submitted, "task_id", "left").withColumn("status", status)
    return gated.drop("_channels", "_tools", "_submitted", "end_row")


def answer_tools(
    rows: DataFrame, requests: DataFrame, tasks: DataFrame, channels: Sequence[str], blocks: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Answers ``request_id, task_id, tool, status, value``, then the rows of reads and the pairs of the time axis that do not increase.

    The value counts channels or rows, or is the statistic, the difference of means, the seconds to the crossing or the extra rows of repeated
    times. Rows are ``request_id, row, time_offset`` with the time since the first permitted row, ``channel, reading``; pairs ``request_id, row_a, row_b``.
    """
    gated = written(scope_gate(requests, tasks), "tool_requests")
    shown = ["request_id", "task_id", "tool", "status"]

    def of(tool: str) -> DataFrame:
        return gated.filter((F.col("tool") == tool) & (F.col("status") == "ok"))

    def answer(df: DataFrame, value: Column) -> DataFrame:
        return df.select(*shown, value.cast("double").alias("value"))

    plain = gated.filter(~F.col("tool").isin("summarize_window", "compare_windows", "first_crossing", "check_time_axis") | (F.col("status") != "ok"))
    sizes = tasks.select("task_id", F.size("channels").alias("_n"))
    counted = F.when(F.col("tool") == "inspect_channels", F.col("_n")).when(F.col("tool") == "read_window", F.col("stop_row") - F.col("start_row"))
    out = answer(plain.join(sizes, "task_id", "left"), F.when(F.col("status") == "ok", counted))
    kept = ["request_id", "task_id", "tool", *WINDOW, "channel"]
    stats = stat_queries(rows, of("summarize_window").select(*kept, "stat"), channels, blocks)
    crossings = first_crossing(rows, of("first_crossing").select(*kept, "threshold", "direction").withColumn("query_id", F.col("request_id")), channels)
    pairs = of("compare_windows").select(F.col("request_id").alias("pair_id"), "request_id", "task_id", "tool", RECORD, "channel", *[c for r in RANGES[1:] for c in r])
    deltas = pairs.select("pair_id", "request_id", "task_id", "tool").join(window_deltas(rows, pairs, channels, blocks).drop(RECORD, "channel"), "pair_id")
    axis = of("check_time_axis")
    repeats = axis.join(duplicate_times(rows, axis), WINDOW, "left").withColumn("value", F.coalesce("value", F.lit(0)))
    for part in (stats, crossings, deltas, repeats):
        out = out.unionByName(answer(part, F.col("value")))

    reads = of("read_window").select(F.col("request_id").alias("query_id"), *WINDOW, F.col("first_row").alias("origin_row"), F.col("channels").alias("_asked"))
    held = bounded_read(rows, reads, channels).join(reads.select("query_id", "_asked"), "query_id")
    long = held.unpivot(["query_id", "row", "time_offset", "_asked"], list(channels), "channel", "reading").filter(F.array_contains("_asked", F.col("channel")))
    found = rows_in_windows(non_increasing_pairs(rows).withColumn("row", F.col("row_b")), axis.select("request_id", *WINDOW)).filter(F.col("row_a") >= F.col("start_row"))
    return out, long.select(F.col("query_id").alias("request_id"), "row", "time_offset", "channel", "reading"), found.select("request_id", "row_a", "row_b")
