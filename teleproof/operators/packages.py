"""Groups of candidates and the facts measured around them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from teleproof.functions.scalar import close_to, digest_id, unit_of
from teleproof.operators.blocks import RECORD, neighbours
from teleproof.operators.detect import MiningConfig
from teleproof.operators.greedy import pack
from teleproof.operators.quality import duplicate_times
from teleproof.operators.windows import WINDOW, extents, rows_in_windows, window_stats
from teleproof.sources.workspace import written

GROUP = [RECORD, "chain_row", "group_event"]
FACTS = ["mean_context", "mean_before", "mean_after", "min", "max", "delta"]


def channel_priority(detected: Column, configured: Sequence[str], limit: int) -> Column:
    """Detector channels in name order, then the configured ones, without repeats, at most ``limit``."""
    listed = F.array(*[F.lit(c) for c in configured]).cast("array<string>")
    return F.slice(F.array_distinct(F.concat(F.array_sort(detected), listed)), 1, limit)


def event_groups(candidates: DataFrame, config: MiningConfig) -> DataFrame:
    """Bounded groups: ``package_id, record_id, start_row, stop_row, n_events, detected``."""
    events = candidates.select(
        RECORD, "start_row", "stop_row", F.col("candidate_id").alias("event_id"), "channel"
    )
    named = pack(
        events, config.group_gap_rows, config.max_group_span_rows, carry=["channel"], block_rows=config.block_rows
    )
    # Zero runs name several channels in one text; the set of names is bounded by the configuration.
    return (
        named.groupBy(*GROUP)
        .agg(
            F.min("start_row").alias("start_row"),
            F.max("stop_row").alias("stop_row"),
            F.count(F.lit(1)).alias("n_events"),
            F.array_distinct(F.flatten(F.collect_set(F.split("channel", ",")))).alias("detected"),
        )
        .withColumn("package_id", digest_id("P_", F.col(RECORD), F.col("chain_row"), F.col("group_event"), F.col("start_row"), F.col("stop_row")))
        .select("package_id", RECORD, "start_row", "stop_row", "n_events", "detected")
    )


def package_windows(groups: DataFrame, rows: DataFrame, config: MiningConfig) -> DataFrame:
    """Context, before and after bounds of each group, clipped to the record; a side without rows is null."""
    reach = config.context_rows
    lo = F.greatest(F.lit(0).cast("bigint"), F.col("start_row") - reach)
    hi = F.least(F.col("end_row"), F.col("stop_row") + reach)
    return (
        groups.join(extents(rows).select(RECORD, "end_row"), RECORD)
        .withColumns({
            "group_start": F.col("start_row"),
            "group_stop": F.col("stop_row"),
            "channels": channel_priority(F.col("detected"), config.context_channels, config.max_channels),
            "context_start": lo,
            "context_stop": hi,
            "has_before": F.col("start_row") > 0,
            "has_after": F.col("stop_row") < F.col("end_row"),
        })
        .drop("start_row", "stop_row", "end_row", "detected")
    )


def _context_rows(rows: DataFrame, packages: DataFrame, columns: Sequence[str]) -> DataFrame:
    spans = packages.withColumnsRenamed({"context_start": "start_row", "context_stop": "stop_row"})
    return rows_in_windows(rows.select(RECORD, "row", *columns), spans)


def package_measures(rows: DataFrame, packages: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Every fact of every package with its status, from one pass over the context rows.

    A window holding a missing reading yields ``missing_values`` instead of a value.
    """
    held = _context_rows(rows, packages.drop("n_events"), channels)
    before, after = F.col("row") < F.col("group_start"), F.col("row") >= F.col("group_stop")
    parts = {"context": F.lit(True), "before": before, "after": after}
    aggregates = []
    for i, c in enumerate(channels):
        fields = [F.min(c).alias("min"), F.max(c).alias("max")]
        for name, inside in parts.items():
            fields += [
                F.avg(F.when(inside, F.col(c))).alias(f"mean_{name}"),
                (F.count_if(inside & F.col(c).isNull()) == 0).alias(f"full_{name}"),
            ]
        aggregates.append(F.struct(F.lit(c).alias("channel"), *fields).alias(f"_m{i}"))
    keys = ["package_id", RECORD, "group_start", "group_stop", "has_before", "has_after", "channels"]
    packed = held.groupBy(*keys).agg(*aggregates)
    per_channel = packed.select(*keys, F.inline(F.array(*[f"_m{i}" for i in range(len(channels))]))).filter(
        F.array_contains("channels", F.col("channel"))
    )
    both, full = F.col("has_before") & F.col("has_after"), F.col("full_before") & F.col("full_after")
    rules = [
        ("mean_context", F.lit(True), F.col("full_context"), F.col("mean_context")),
        ("mean_before", F.col("has_before"), F.col("full_before"), F.col("mean_before")),
        ("mean_after", F.col("has_after"), F.col("full_after"), F.col("mean_after")),
        ("min", F.lit(True), F.col("full_context"), F.col("min")),
        ("max", F.lit(True), F.col("full_context"), F.col("max")),
        ("delta", both, full, F.col("mean_after") - F.col("mean_before")),
    ]
    facts = F.filter(
        F.array(*[
            F.struct(
                F.lit(name).alias("fact"), exists.alias("exists"),
                F.when(complete, "ok").otherwise("missing_values").alias("status"),
                F.when(complete, value).alias("value"),
            )
            for name, exists, complete, value in rules
        ]),
        lambda f: f["exists"],
    )
    measured = per_channel.select(
        "package_id", RECORD, "group_start", "group_stop", "channel", unit_of(F.col("channel")).alias("unit"), F.inline(facts)
    ).drop("exists")
    spans = packages.withColumnsRenamed({"context_start": "start_row", "context_stop": "stop_row"})
    repeats = spans.join(duplicate_times(rows, spans), WINDOW).select(
        "package_id", RECORD, "group_start", "group_stop", F.lit(None).cast("string").alias("channel"),
        F.lit("records").alias("unit"), F.lit("duplicate_count").alias("fact"), F.lit("ok").alias("status"),
        F.col("value").cast("double").alias("value"),
    )
    return measured.unionByName(repeats).withColumn(
        "fact_id", digest_id("F_", F.col("package_id"), F.col("channel"), F.col("fact"))
    )


def context_changes(rows: DataFrame, packages: DataFrame, field: str) -> DataFrame:
    """Context value at the first row of each package window and wherever it changes inside."""
    stepped = neighbours(rows.select(RECORD, "row", field), {"previous": (field, -1)})
    held = _context_rows(stepped, packages, [field, "previous"])
    kept = (F.col("row") == F.col("start_row")) | ~F.col(field).eqNullSafe(F.col("previous"))
    return held.filter(kept).select("package_id", RECORD, "group_start", "row", F.col(field).alias("context"))


def case_budget(groups: DataFrame, limit: int) -> DataFrame:
    """Mark the first ``limit`` groups in record and row order as processed, the rest as left over."""
    order = [RECORD, "start_row", "stop_row", "package_id"]
    first = groups.orderBy(*order).limit(limit).select("package_id", F.lit(True).alias("processed"))
    return groups.join(first, "package_id", "left").withColumn("processed", F.coalesce("processed", F.lit(False)))


def recompute(rows: DataFrame, packages: DataFrame, facts: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Every stored fact against a second reading of the rows; a fact that the second reading does not yield disagrees.

    Means and extremes come from window statistics, the delta from the two means, the count of repeated times from the distinct times.
    """
    side = F.explode(F.array(
        F.struct(F.lit("mean_context").alias("fact"), F.col("context_start").alias("start_row"), F.col("context_stop").alias("stop_row")),
        F.struct(F.lit("min").alias("fact"), F.col("context_start").alias("start_row"), F.col("context_stop").alias("stop_row")),
        F.struct(F.lit("max").alias("fact"), F.col("context_start").alias("start_row"), F.col("context_stop").alias("stop_row")),
        F.struct(F.lit("mean_before").alias("fact"), F.col("context_start").alias("start_row"), F.col("group_start").alias("stop_row")),
        F.struct(F.lit("mean_after").alias("fact"), F.col("group_stop").alias("start_row"), F.col("context_stop").alias("stop_row")),
    ))
    bounds = packages.select("package_id", RECORD, side.alias("_q")).select("package_id", RECORD, "_q.*")
    stats = window_stats(rows, bounds, channels)
    value = F.when(F.col("fact") == "min", F.col("min")).when(F.col("fact") == "max", F.col("max")).otherwise(F.col("mean"))
    keys = ["package_id", RECORD, "channel"]
    fresh = bounds.join(stats, WINDOW).filter(F.col("n_values") == F.col("n_rows")).select(*keys, "fact", value.alias("recomputed"))
    side_of = lambda name: F.max(F.when(F.col("fact") == name, F.col("recomputed")))
    delta = fresh.groupBy(*keys).agg((side_of("mean_after") - side_of("mean_before")).alias("recomputed"))
    spans = packages.withColumnsRenamed({"context_start": "start_row", "context_stop": "stop_row"})
    times = rows_in_windows(rows.select(RECORD, "row", "time_s"), spans.select("package_id", *WINDOW))
    per_time = times.groupBy("package_id", RECORD, "time_s").agg((F.count(F.lit(1)) - 1).alias("_extra"))
    repeats = per_time.groupBy("package_id", RECORD).agg(F.sum("_extra").cast("double").alias("recomputed"))
    fresh = fresh.unionByName(delta.select(*keys, F.lit("delta").alias("fact"), "recomputed")).unionByName(
        repeats.select("package_id", RECORD, F.lit(None).cast("string").alias("channel"), F.lit("duplicate_count").alias("fact"), "recomputed")
    )
    fresh = fresh.withColumn("_channel", F.coalesce("channel", F.lit(""))).drop("channel")
    stored = facts.filter(F.col("status") == "ok").withColumn("_channel", F.coalesce("channel", F.lit("")))
    return (
        stored.join(fresh, ["package_id", RECORD, "_channel", "fact"], "left").drop("_channel")
        .withColumn("agrees", F.col("recomputed").isNotNull() & close_to(F.col("value"), F.col("recomputed"), 1e-8, 1e-8))
    )


def content_snapshots(rows: DataFrame) -> DataFrame:
    """One digest per record over all its rows and columns, whatever their order: ``record_id, snapshot``.

    Sums of two hashes of each row combine before the shuffle, so no task gathers a record.
    """
    columns = sorted(c for c in rows.columns if c != RECORD)
    part = lambda seed: F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(20, 0)"))
    return rows.groupBy(RECORD).agg(F.concat_ws(":", F.count(F.lit(1)), part(1), part(2)).alias("snapshot"))


def recompute_bound(rows: DataFrame, packages: DataFrame, facts: DataFrame, channels: Sequence[str], expected: DataFrame) -> DataFrame:
    """``recompute`` of the facts whose record still has the ``expected`` snapshot (``record_id, snapshot``); the others are refused, not recomputed.

    Adds ``snapshot``: ``ok``, ``source_snapshot_changed`` or ``unknown_source``.
    """
    now = content_snapshots(rows).withColumnRenamed("snapshot", "_now")
    status = (
        F.when(F.col("snapshot").isNull() | F.col("_now").isNull(), "unknown_source").when(F.col("snapshot") != F.col("_now"), "source_snapshot_changed").otherwise("ok")
    )
    judged = written(expected.join(now, RECORD, "full_outer").select(RECORD, status.alias("_state")), "snapshots")
    bound = facts.join(judged, RECORD, "left").withColumn("snapshot", F.coalesce("_state", F.lit("unknown_source"))).drop("_state")
    same = judged.filter(F.col("_state") == "ok").select(RECORD)
    fresh = recompute(rows.join(same, RECORD, "left_semi"), packages.join(same, RECORD, "left_semi"), bound.filter(F.col("snapshot") == "ok"), channels)
    refused = bound.filter((F.col("status") == "ok") & (F.col("snapshot") != "ok"))
    return fresh.unionByName(refused.withColumns({"recomputed": F.lit(None).cast("double"), "agrees": F.lit(False)}))
