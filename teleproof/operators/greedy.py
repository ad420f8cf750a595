"""Order-dependent greedy rules over sparse events, without walking a whole record in one task.

Both rules restart at points that do not depend on the past, so a record splits into independent *chains*.
A chain of up to ``CHAIN_EVENTS`` events is folded as one array. A longer chain is cut into blocks: every event
points at the event that would follow it as a restart, each block resolves its own pointers, and the walk over block entry
points is found by doubling pointers in joins. No group is larger than a block.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from teleproof import settings
from teleproof.operators.blocks import at_home, block_of, fits, ordered, running, with_halo
from teleproof.sources.workspace import written


def thin(
    hits: DataFrame, keys: Sequence[str], width: int, carry: Sequence[str] = (), block_rows: int | None = None,
    chain_events: int | None = None,
) -> DataFrame:
    """Keep a hit only if it lies at least ``width`` rows after the last kept one (``keys``, ``row``, ``carry``)."""
    limit = chain_events if chain_events is not None else settings.CHAIN_EVENTS
    keys, columns = list(keys), [*keys, "row", *carry]
    recent = F.max("row").over(ordered(keys).rangeBetween(-(width - 1), -1)) if width > 1 else F.lit(None)
    flagged = (
        with_halo(hits.select(*columns), width, 0, block_rows=block_rows)
        .withColumn("_starts", recent.isNull())
        .filter(at_home(block_rows=block_rows))
        .select(*columns, "_starts")
    )
    started = F.when(F.col("_starts"), F.col("row"))
    chained = running(flagged, keys, started, "_chain", "max", block_rows=block_rows).drop("_starts")
    chained, long = _split_chains(chained, [*keys, "_chain"], limit, "row")
    short = chained if long is None else chained.join(long, [*keys, "_chain"], "left_anti")
    short = short.groupBy(*keys, "_chain").agg(F.array_sort(F.collect_list(F.struct("row", *carry))).alias("_rows"))
    kept = F.aggregate(
        "_rows",
        F.slice("_rows", 1, 1),
        lambda acc, hit: F.when(hit["row"] - F.element_at(acc, -1)["row"] >= width, F.concat(acc, F.array(hit))).otherwise(acc),
    )
    folded = short.select(*keys, F.inline(kept))
    if long is None:
        return folded

    # The next kept hit after h is the first one at h + width or later; inside a chain it lies before h + 2 * width.
    far = chained.join(long, [*keys, "_chain"])
    ahead = F.min("row").over(ordered([*keys, "_chain"]).rangeBetween(width, 2 * width))
    pointed = (
        with_halo(far, 0, 2 * width, block_rows=block_rows).withColumn("_next", ahead).filter(at_home(block_rows=block_rows))
    )
    walked = follow(pointed, [*keys, "_chain"], "row", "_next", F.col("row") == F.col("_chain"), block_rows)
    return folded.unionByName(far.join(walked, [*keys, "_chain", "row"]).select(*columns))


def _split_chains(chained: DataFrame, keys: list[str], limit: int, position: str) -> tuple[DataFrame, DataFrame | None]:
    """The chains, written once if their sizes must be measured, and the keys of those too long for one array."""
    if fits(chained, limit, position):
        return chained, None
    chained = written(chained, "chains")
    long = chained.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).drop("_n")
    return chained, None if long.isEmpty() else long


def follow(
    pointers: DataFrame, keys: Sequence[str], position: str, target: str, seed, block_rows: int | None = None
) -> DataFrame:
    """Rows reached from the seed row of each key by following ``target`` (always ahead of ``position``)."""
    size = block_rows or settings.BLOCK_ROWS
    keys = list(keys)
    nodes = pointers.select(
        *keys,
        F.col(position).cast("bigint").alias("_p"),
        F.col(target).cast("bigint").alias("_t"),
        seed.alias("_seed"),
        block_of(position, size).alias("_b"),
    )
    crossing = (
        nodes.filter(F.expr(f"_t div {size}") > F.col("_b"))
        .select(*keys, F.col("_t").alias("_p"))
        .distinct()
    )
    # Where does a walk entering a block at _p leave it? Only entry points are kept.
    exits = (
        nodes.groupBy(*keys, "_b")
        .applyInPandas(_resolve(keys), _schema(nodes, keys, "_p bigint, _exit bigint, _seed boolean"))
        .join(crossing.withColumn("_in", F.lit(True)), [*keys, "_p"], "left")
        .filter(F.col("_seed") | F.col("_in"))
    )
    marked = nodes.join(_entered(written(exits, "exits"), keys).withColumn("_entry", F.lit(True)), [*keys, "_p"], "left")
    reached = marked.groupBy(*keys, "_b").applyInPandas(_mark(keys), _schema(nodes, keys, "_p bigint"))
    return reached.withColumnRenamed("_p", position)


def _schema(df: DataFrame, keys: list[str], rest: str) -> T.StructType:
    fields = [df.schema[k] for k in keys]
    return T.StructType(fields + list(T.StructType.fromDDL(rest).fields))


def _resolve(keys: list[str]):
    def leave(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("_p", ignore_index=True)
        place = {p: i for i, p in enumerate(block["_p"])}
        targets = block["_t"].tolist()
        out: list = [None] * len(targets)
        for i in range(len(targets) - 1, -1, -1):
            inner = place.get(targets[i])
            out[i] = targets[i] if inner is None else out[inner]
        block["_exit"] = pd.array([None if x is None or np.isnan(x) else int(x) for x in out], dtype="Int64")
        return block[[*keys, "_p", "_exit", "_seed"]]

    return leave


def _entered(exits: DataFrame, keys: list[str]) -> DataFrame:
    """Entry points on the walk from the first seed of each key, by doubling: after k rounds the first 2^k of them are known.

    A round joins the known points with the pointers and the pointers with themselves, so a walk over n blocks takes log2(n) rounds of joins.
    """
    points = [*keys, "_p"]
    known = written(exits.filter("_seed").groupBy(*keys).agg(F.min("_p").alias("_p")), "entered")
    jump = written(exits.filter("_exit IS NOT NULL").select(*points, "_exit"), "jumps")
    while not jump.isEmpty():
        further = known.join(jump, points).select(*keys, F.col("_exit").alias("_p"))
        known = written(known.union(further).distinct(), "entered")
        onward = jump.select(*keys, F.col("_p").alias("_exit"), F.col("_exit").alias("_beyond"))
        jump = written(jump.join(onward, [*keys, "_exit"]).select(*points, F.col("_beyond").alias("_exit")), "jumps")
    return known


def _mark(keys: list[str]):
    def reached(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("_p", ignore_index=True)
        place = {p: i for i, p in enumerate(block["_p"])}
        targets = block["_t"].tolist()
        entered = block.index[block["_entry"].notna()]
        keep = []
        at = entered[0] if len(entered) else None
        while at is not None:
            keep.append(at)
            at = place.get(targets[at])
        return block.loc[keep, [*keys, "_p"]]

    return reached


def pack(
    events: DataFrame, gap: int, span: int, key: str = "record_id", carry: Sequence[str] = (), block_rows: int | None = None,
    chain_events: int | None = None,
) -> DataFrame:
    """Group events (``start_row``, ``stop_row``, ``event_id``) under a gap and a span bound.

    An event joins the last group iff it starts at most ``gap`` rows after that group's end and the widened group
    spans at most ``span`` rows; a single longer event forms its own group. Returns the events with ``group_event``, the
    number of the group's first event inside ``chain_row``; the three identify a group.
    """
    limit = chain_events if chain_events is not None else settings.CHAIN_EVENTS
    size = block_rows or settings.BLOCK_ROWS
    order = ["start_row", "stop_row", "event_id"]
    columns = [*order, *carry]
    single = fits(events, size, "start_row")
    tagged = events.select(key, *columns).withColumn(
        "_blk", F.lit(0).cast("bigint") if single else block_of("start_row", size)
    )
    # The furthest end among all earlier events decides whether the chain can go on.
    inside = Window.partitionBy(key, "_blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(key).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    reached = tagged.withColumn("_prev", F.max("stop_row").over(inside))
    earlier = F.col("_prev")
    if not single:
        tagged = written(tagged, "events")
        reached = tagged.withColumn("_prev", F.max("stop_row").over(inside))
        carried = (
            tagged.groupBy(key, "_blk")
            .agg(F.max("stop_row").alias("_end"))
            .select(key, "_blk", F.max("_end").over(across).alias("_carry"))
            .filter(F.col("_carry").isNotNull())
        )
        reached, earlier = reached.join(carried, [key, "_blk"], "left"), F.greatest("_prev", "_carry")
    opens = F.when(earlier.isNull() | (F.col("start_row") > earlier + gap), F.col("start_row"))
    flagged = reached.withColumn("_start", opens).select(key, *columns, "_start")
    chained = running(flagged, [key], F.col("_start"), "chain_row", "max", "start_row", order[1:], size).drop("_start")
    # A record may hold more events than rows, so the length of the record bounds no chain: sizes are measured.
    chained, long = _split_chains(chained, [key, "chain_row"], limit, "")
    short = chained if long is None else chained.join(long, [key, "chain_row"], "left_anti")
    short = short.groupBy(key, "chain_row").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("_events"))
    zero = F.lit(0).cast("bigint")
    state = F.struct(
        F.lit(None).cast("bigint").alias("lo"),
        F.lit(None).cast("bigint").alias("hi"),
        zero.alias("n"),
        zero.alias("first"),
        F.array().cast("array<bigint>").alias("out"),
    )

    def step(acc, e):
        widened = F.greatest(acc["hi"], e["stop_row"])
        joins = F.coalesce((e["start_row"] <= acc["hi"] + gap) & (widened - acc["lo"] <= span), F.lit(False))
        first = F.when(joins, acc["first"]).otherwise(acc["n"])
        return F.struct(
            F.when(joins, acc["lo"]).otherwise(e["start_row"]).alias("lo"),
            F.when(joins, widened).otherwise(e["stop_row"]).alias("hi"),
            (acc["n"] + 1).alias("n"),
            first.alias("first"),
            F.concat(acc["out"], F.array(first)).alias("out"),
        )

    folded = (
        short.withColumn("_groups", F.aggregate("_events", state, step, lambda acc: acc["out"]))
        .select(key, "chain_row", F.explode(F.arrays_zip("_events", "_groups")).alias("_z"))
        .select(key, "chain_row", *[F.col(f"_z._events.{c}") for c in columns], F.col("_z._groups").alias("group_event"))
    )
    if long is None:
        return folded
    numbered = number_events(chained.join(long, [key, "chain_row"]).select(key, "chain_row", *columns), key, order, size)
    pointed = _next_group(numbered, key, gap, span, size)
    heads = follow(pointed, [key, "chain_row"], "_i", "_next", F.col("_i") == 0, size).withColumn("_head", F.lit(True))
    marked = numbered.join(heads, [key, "chain_row", "_i"], "left")
    walked = running(
        marked, [key, "chain_row"], F.when(F.col("_head"), F.col("_i")), "group_event", "max", "_i", (), size
    ).select(key, "chain_row", *columns, "group_event")
    return folded.unionByName(walked)


def number_events(events: DataFrame, key: str, order: Sequence[str], size: int) -> DataFrame:
    """Dense index ``_i`` of the events of a chain, counted per block of start rows."""
    tagged = events.withColumn("_blk", block_of("start_row", size))
    counts = tagged.groupBy(key, "chain_row", "_blk").agg(F.count(F.lit(1)).alias("_m"))
    earlier = Window.partitionBy(key, "chain_row").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, "chain_row", "_blk", F.coalesce(F.sum("_m").over(earlier), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(key, "chain_row", "_blk").orderBy(*order)
    return (
        tagged.withColumn("_i", F.row_number().over(inside).cast("bigint") - 1)
        .join(offsets, [key, "chain_row", "_blk"])
        .withColumn("_i", F.col("_i") + F.col("_off"))
        .drop("_blk", "_off")
    )


def _next_group(numbered: DataFrame, key: str, gap: int, span: int, size: int) -> DataFrame:
    """For every event, the index of the event that would open the next group if this one opened a group.

    An event starting more than ``span`` rows later always opens a new group, so a halo of that many rows (plus
    the first event beyond it, found by index) is enough.
    """
    keys = [key, "chain_row"]
    haloed = with_halo(numbered, 0, span + 1, "start_row", size)
    types = _schema(numbered, keys, "_i bigint, _next bigint")

    def scan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_i", ignore_index=True)
        lo, hi, idx = group["start_row"].to_numpy(), group["stop_row"].to_numpy(), group["_i"].to_numpy()
        mine = np.flatnonzero(lo // size == group["block"].iloc[0])
        out = np.empty(len(mine), dtype="int64")
        for n, i in enumerate(mine):
            end, j = hi[i], i + 1
            while j < len(lo) and lo[j] <= end + gap and max(end, hi[j]) - lo[i] <= span:
                end, j = max(end, hi[j]), j + 1
            out[n] = idx[j - 1] + 1
        res = group.loc[mine, keys].assign(_i=idx[mine], _next=out)
        return res[[*keys, "_i", "_next"]]

    return haloed.groupBy(*keys, "block").applyInPandas(scan, types)
