"""Candidate detectors over ordered rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from teleproof.functions.scalar import digest_id, small_median
from teleproof.operators.blocks import RECORD, at_home, known_length, mask_runs, ordered, with_halo, with_length
from teleproof.operators.greedy import thin
from teleproof.sources.workspace import written


@dataclass(frozen=True)
class ChannelRule:
    min_step: float
    min_spike: float
    neighbor_tolerance: float


@dataclass(frozen=True)
class MiningConfig:
    channels: dict[str, ChannelRule]
    context: Sequence[str] = ()
    zero_channels: Sequence[str] = ()
    window_rows: int = 4
    noise_multiplier: float = 8.0
    zero_epsilon: float = 0.0
    min_zero_rows: int = 3
    group_gap_rows: int = 2
    max_group_span_rows: int = 12
    context_rows: int = 6
    context_channels: Sequence[str] = ()
    max_channels: int = 6
    block_rows: int | None = field(default=None)


CANDIDATE = ["record_id", "detector", "start_row", "stop_row", "channel", "rule"]


def _candidate(detector: str | Column, start: Column, stop: Column, channel: Column, **rule: Column) -> Column:
    pairs = [x for name, value in rule.items() for x in (F.lit(name), value.cast("string"))]
    rules = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    name = F.lit(detector) if isinstance(detector, str) else detector
    return F.struct(
        name.alias("detector"), start.alias("start_row"), stop.alias("stop_row"), channel.alias("channel"),
        rules.alias("rule"),
    )



def _none() -> Column:
    return F.lit(None).cast("string")


def context_transitions(rows: DataFrame, fields: Sequence[str], block_rows: int | None = None) -> DataFrame:
    """Rows whose context value differs from the row before, one candidate per field."""
    return _pointwise(rows, [*fields], 1, 0, lambda: [
        F.when(
            ~F.col(f).eqNullSafe(F.lag(f).over(ordered())) & (F.col("row") > 0),
            _candidate("context_transition", F.col("row"), F.col("row") + 1, _none(), field=F.lit(f)),
        )
        for f in fields
    ], block_rows)


def time_faults(rows: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Neighbouring rows whose time repeats or runs backwards."""
    return _pointwise(rows, ["time_s"], 1, 0, lambda: [_time_fault()], block_rows)


def _time_fault() -> Column:
    before = F.lag("time_s").over(ordered())
    kind = F.when(F.col("time_s") == before, "repeated_time").otherwise("time_reversal")
    return F.when(
        F.col("time_s") <= before, _candidate(kind, F.col("row") - 1, F.col("row") + 1, _none())
    )


def isolated_spikes(rows: DataFrame, rules: dict[str, ChannelRule], block_rows: int | None = None) -> DataFrame:
    """One row far from two neighbours that agree with each other."""
    return _pointwise(rows, [*rules], 1, 1, lambda: [_spike(c, r) for c, r in rules.items()], block_rows)


def _spike(channel: str, rule: ChannelRule) -> Column:
    here, before, after = F.col(channel), F.lag(channel).over(ordered()), F.lead(channel).over(ordered())
    hit = (F.abs(before - after) <= rule.neighbor_tolerance) & (F.abs(here - (before + after) / 2) > rule.min_spike)
    return F.when(
        hit,
        _candidate("isolated_spike", F.col("row"), F.col("row") + 1, F.lit(channel), threshold=F.lit(rule.min_spike)),
    )


def _pointwise(rows, columns, before, after, hits, block_rows, prepare=None) -> DataFrame:
    """Candidates decided by a row and its neighbours, all from one pass over the blocks."""
    near = with_halo(rows.select(RECORD, "row", *columns), before, after, block_rows=block_rows)
    if prepare is not None:
        near = prepare(near)
    return (
        near.withColumn("_hits", F.array_compact(F.array(*hits())))
        .filter(at_home(block_rows=block_rows) & (F.size("_hits") > 0))
        .select(RECORD, F.inline("_hits"))
    )


def _distances(values: str, level: str) -> Column:
    return F.transform(values, lambda v: F.abs(v - F.col(level)))


def _with_levels(near: DataFrame, rules: dict[str, ChannelRule], width: int, noise: float) -> DataFrame:
    """Per channel: the frames on both sides of the row, the level before it and the threshold for a change."""
    w = ordered()
    frames, levels, thresholds = {}, {}, {}
    for i, (c, r) in enumerate(rules.items()):
        frames[f"_before{i}"] = F.collect_list(c).over(w.rowsBetween(-width, -1))
        frames[f"_after{i}"] = F.collect_list(c).over(w.rowsBetween(0, width - 1))
        levels[f"_level{i}"] = small_median(F.col(f"_before{i}"), width)
        deviation = small_median(_distances(f"_before{i}", f"_level{i}"), width)
        thresholds[f"_threshold{i}"] = F.greatest(F.lit(float(r.min_step)), F.lit(float(noise)) * deviation)
    return near.withColumns(frames).withColumns(levels).withColumns(thresholds)


def _step_hit(i: int, channel: str, width: int) -> Column:
    full = (F.size(f"_before{i}") == width) & (F.size(f"_after{i}") == width)
    change = F.abs(small_median(F.col(f"_after{i}"), width) - F.col(f"_level{i}"))
    return F.when(
        full & (change > F.col(f"_threshold{i}")),
        _candidate(
            "median_step", F.col("row"), F.col("row") + 1, F.lit(channel),
            threshold=F.col(f"_threshold{i}"), window_rows=F.lit(width),
        ),
    )


def step_hits(
    rows: DataFrame, rules: dict[str, ChannelRule], width: int, noise: float, block_rows: int | None = None
) -> DataFrame:
    """Rows where the median of the next ``width`` rows leaves the median of the previous ones.

    The threshold is the larger of the channel minimum and ``noise`` times the unscaled median absolute
    deviation before the row. A null in either window rules the row out.
    """
    found = _pointwise(
        rows, [*rules], width, width, lambda: [_step_hit(i, c, width) for i, c in enumerate(rules)], block_rows,
        lambda near: _with_levels(near, rules, width, noise),
    )
    return with_length(found, known_length(rows), "start_row")


def thin_steps(hits: DataFrame, width: int, block_rows: int | None = None) -> DataFrame:
    """Of the step hits of a channel, keep one per ``width`` rows."""
    placed = hits.select(
        RECORD, "channel", F.col("start_row").alias("row"), F.col("rule")["threshold"].cast("double").alias("threshold")
    )
    kept = thin(placed, [RECORD, "channel"], width, ["threshold"], block_rows)
    found = _candidate(
        "median_step", F.col("row"), F.col("row") + 1, F.col("channel"),
        threshold=F.col("threshold"), window_rows=F.lit(width),
    )
    return kept.select(RECORD, F.inline(F.array(found)))


def median_steps(
    rows: DataFrame, rules: dict[str, ChannelRule], width: int, noise: float, block_rows: int | None = None
) -> DataFrame:
    """Step hits, keeping one per ``width`` rows and channel."""
    return thin_steps(step_hits(rows, rules, width, noise, block_rows), width, block_rows)


def zero_runs(
    rows: DataFrame, channels: Sequence[str], epsilon: float = 0.0, min_rows: int = 1, block_rows: int | None = None
) -> DataFrame:
    """Maximal runs where every selected channel is present and within ``epsilon`` of zero."""
    zero = reduce(lambda a, b: a & b, [F.abs(F.col(c)) <= epsilon for c in channels])
    runs = mask_runs(rows.filter(zero), block_rows=block_rows)
    return runs.filter(F.col("stop_row") - F.col("start_row") >= min_rows)


def zero_run_candidates(rows: DataFrame, config: MiningConfig) -> DataFrame:
    runs = zero_runs(rows, config.zero_channels, config.zero_epsilon, config.min_zero_rows, config.block_rows)
    found = _candidate(
        "all_selected_channels_zero", F.col("start_row"), F.col("stop_row"),
        F.lit(",".join(config.zero_channels)), epsilon=F.lit(config.zero_epsilon), scope=F.lit("selected_channels_only"),
    )
    return runs.select(RECORD, F.inline(F.array(found)))


def candidates(rows: DataFrame, config: MiningConfig) -> DataFrame:
    """All detectors, with content ids. The neighbour-only detectors share one pass."""
    size = config.block_rows
    fields = list(config.context)

    def near() -> list[Column]:
        moves = [
            F.when(
                ~F.col(f).eqNullSafe(F.lag(f).over(ordered())) & (F.col("row") > 0),
                _candidate("context_transition", F.col("row"), F.col("row") + 1, _none(), field=F.lit(f)),
            )
            for f in fields
        ]
        steps = [_step_hit(i, c, width) for i, c in enumerate(config.channels)]
        return [*moves, _time_fault(), *[_spike(c, r) for c, r in config.channels.items()], *steps]

    # One pass reads and shuffles the rows for all these detectors; its sparse hits are written and steps thinned from there.
    width = config.window_rows
    reach = width if config.channels else 1
    hits = _pointwise(
        rows, list(dict.fromkeys([*fields, "time_s", *config.channels])), reach, reach, near, size,
        lambda rows_near: _with_levels(rows_near, config.channels, width, config.noise_multiplier),
    )
    hits = written(with_length(hits, known_length(rows), "start_row"), "hits")
    found = hits.filter(F.col("detector") != "median_step").unionByName(
        thin_steps(hits.filter(F.col("detector") == "median_step"), width, size)
    )
    if config.zero_channels:
        found = found.unionByName(zero_run_candidates(rows, config))
    rule_text = F.to_json("rule")
    found = found.withColumn(
        "candidate_id",
        digest_id("E_", F.col(RECORD), F.col("detector"), F.col("start_row"), F.col("stop_row"), F.col("channel"), rule_text),
    ).select(*CANDIDATE, "candidate_id")
    return with_length(found, known_length(rows), "start_row")
