"""Windows answered from summaries of row blocks.

Blocks of 64, 64^2, 64^3 and 64^4 rows are summarised once; a window of any length is then some whole blocks of each size and the rows at its two cut
ends: at most 126 units of a size, so a window over a million rows costs about as much as one over a thousand. Sums, extremes and counts
come from summaries of readings. Runs come from summaries of a condition: length, run at either end, longest run, first long run. Such summaries merge
in row order, so no task ever holds the rows of a long window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from teleproof.operators.blocks import RECORD
from teleproof.sources.workspace import written

FAN, LEVELS = 64, 4
WHOLE_RECORD = -1


def pieces(windows: DataFrame, ends: DataFrame) -> DataFrame:
    """Windows cut into ranges ``[_lo, _hi)`` of units of one ``_level`` under one ``_parent`` unit; level 0 are rows.

    ``ends`` has the bounds of each record; a window reaches no farther, however large a stop it asks for.
    """
    cut = windows.join(ends, RECORD).withColumns({"_l0": F.greatest("start_row", "first_row"), "_h0": F.least("stop_row", "end_row")})
    parts = []
    for k in range(LEVELS):
        cut = cut.withColumn(f"_l{k + 1}", F.expr(f"(_l{k} + {FAN - 1}) div {FAN}"))
        cut = cut.withColumn(f"_h{k + 1}", F.greatest(F.col(f"_l{k + 1}"), F.expr(f"_h{k} div {FAN}")))
        stop = F.least(F.col(f"_h{k}"), F.col(f"_l{k + 1}") * FAN)
        parts += [(k, F.col(f"_l{k}"), stop), (k, F.greatest(F.col(f"_h{k + 1}") * FAN, stop), F.col(f"_h{k}"))]
    parts.append((LEVELS, F.col(f"_l{LEVELS}"), F.col(f"_h{LEVELS}")))
    ranges = F.array(*[F.struct(F.lit(k).alias("_level"), lo.alias("_lo"), hi.alias("_hi")) for k, lo, hi in parts])
    ranges = cut.select(*windows.columns, F.inline(F.filter(ranges, lambda x: x["_lo"] < x["_hi"])))
    # Only the largest blocks can lie under more than one parent.
    return ranges.withColumn("_parent", F.explode(F.sequence(F.expr(f"_lo div {FAN}"), F.expr(f"(_hi - 1) div {FAN}"))))


def _raise(df: DataFrame, keys: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """Summaries of the next larger blocks."""
    up = df.withColumns({"_unit": F.expr(f"_unit div {FAN}"), "_level": F.col("_level") + 1})
    return up.groupBy(*keys, "_level", "_unit").agg(*aggregates)


def _all_levels(first: DataFrame, keys: Sequence[str], aggregates: Sequence[Column], top: int = LEVELS) -> DataFrame:
    """Whole blocks of the levels up to ``top`` from written blocks of the first; a block that its record does not fill is never used."""
    out = level = first
    for _ in range(top - 1):
        level = _raise(level, keys, aggregates)
        out = out.unionByName(level)
    return out.filter(F.col("_n") == F.pow(F.lit(FAN), F.col("_level")).cast("bigint"))


# ---------------------------------------------------------------- readings

def _measures(channels: Sequence[str]) -> list[str]:
    return [f"{part}_{c}" for c in channels for part in ("n", "s", "lo", "hi")]


def _combined(channels: Sequence[str]) -> list[Column]:
    kind = {"n": F.sum, "s": F.sum, "lo": F.min, "hi": F.max}
    return [kind[part](f"{part}_{c}").alias(f"{part}_{c}") for c in channels for part in ("n", "s", "lo", "hi")]


def _of_rows(channels: Sequence[str]) -> list[Column]:
    each = lambda c: [F.col(c).isNotNull().cast("bigint").alias(f"n_{c}"), *(F.col(c).alias(f"{p}_{c}") for p in ("s", "lo", "hi"))]
    return [x for c in channels for x in each(c)]


def summaries(rows: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Count, sum, least and greatest reading of each channel in every whole block, and the bounds of each record (level -1)."""
    aggregates = [F.sum("_n").alias("_n"), F.min("_first").alias("_first"), F.max("_end").alias("_end"), *_combined(channels)]
    leaf = rows.select(
        RECORD, F.lit(0).alias("_level"), F.col("row").alias("_unit"), F.lit(1).cast("bigint").alias("_n"), F.col("row").alias("_first"),
        (F.col("row") + 1).alias("_end"), *_of_rows(channels),
    )
    first = written(_raise(leaf, [RECORD], aggregates), "blocks")
    bounds = first.groupBy(RECORD).agg(F.lit(WHOLE_RECORD).alias("_level"), F.lit(0).cast("bigint").alias("_unit"), *aggregates)
    return _all_levels(first, [RECORD], aggregates).unionByName(bounds.select(*first.columns))


def record_ends(blocks: DataFrame) -> DataFrame:
    bounds = blocks.filter(F.col("_level") == WHOLE_RECORD)
    return bounds.select(RECORD, F.col("_first").alias("first_row"), F.col("_end").alias("end_row"))


def block_stats(rows: DataFrame, windows: DataFrame, channels: Sequence[str], blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, channel, n_rows, n_values, mean, min, max`` of distinct ``windows``, which list the channels they ask for in ``_asked``."""
    cut = written(pieces(windows, record_ends(blocks)), "pieces")
    leaf = rows.select(RECORD, "row", F.expr(f"row div {FAN}").alias("_parent"), F.lit(1).cast("bigint").alias("_n"), *_of_rows(channels))
    ends = leaf.join(cut.filter(F.col("_level") == 0).drop("_level"), [RECORD, "_parent"]).filter((F.col("row") >= F.col("_lo")) & (F.col("row") < F.col("_hi")))
    tall = blocks.filter(F.col("_level") > 0).withColumn("_parent", F.expr(f"_unit div {FAN}"))
    whole = tall.join(cut.filter(F.col("_level") > 0), [RECORD, "_level", "_parent"]).filter((F.col("_unit") >= F.col("_lo")) & (F.col("_unit") < F.col("_hi")))
    used = [*keys, "_asked", "_n", *_measures(channels)]
    total = ends.select(*used).unionByName(whole.select(*used)).groupBy(*keys).agg(
        F.any_value("_asked").alias("_asked"), F.sum("_n").alias("_n"), *_combined(channels)
    )
    stats = F.array(*[
        F.struct(
            F.lit(c).alias("channel"), F.col("_n").alias("n_rows"), F.col(f"n_{c}").alias("n_values"),
            (F.col(f"s_{c}") / F.nullif(F.col(f"n_{c}"), F.lit(0))).alias("mean"), F.col(f"lo_{c}").alias("min"), F.col(f"hi_{c}").alias("max"),
        )
        for c in channels
    ])
    return total.select(*keys, F.inline(F.filter(stats, lambda s: F.array_contains("_asked", s["channel"]))))


# ---------------------------------------------------------------- exact order statistics

PIVOTS, BATCH = 15, 4_096


def ranked_values(held: DataFrame, ranks: DataFrame, keys: Sequence[str], batch: int = BATCH) -> DataFrame:
    """``keys, _rank, value``: the value of each asked zero-based rank among ``held`` (``keys, v``, no nulls).

    Rounds of counted pivots: a sketch proposes pivots between the bounds of a search, exact counts say which part holds the rank, and the search goes on
    inside it, until a pivot is the answer or at most ``batch`` values are left, which are sorted. Sketches decide the number of rounds, never the value.
    """
    same = [*keys, "_rank"]
    state = written(ranks.select(*same, F.lit(None).cast("double").alias("_above"), F.lit(None).cast("double").alias("_below"), F.lit(0).cast("bigint").alias("_base")), "search")
    answers = []
    while True:
        inside = held.join(state, list(keys)).filter(
            (F.col("_above").isNull() | (F.col("v") > F.col("_above"))) & (F.col("_below").isNull() | (F.col("v") < F.col("_below")))
        )
        steps = F.array(*[F.lit((i + 1) / (PIVOTS + 1)) for i in range(PIVOTS)])
        cuts = inside.groupBy(*same).agg(F.count(F.lit(1)).alias("_n"), F.array_distinct(F.percentile_approx("v", steps, 1_000)).alias("_cuts"))
        cuts = written(cuts, "pivots")
        few = cuts.filter(F.col("_n") <= batch).select(*same)
        last = inside.join(few, same).groupBy(*same, "_base").agg(F.sort_array(F.collect_list("v")).alias("_v"))
        answers.append(last.select(*same, F.get("_v", (F.col("_rank") - F.col("_base")).cast("int")).alias("value")))
        many = cuts.filter(F.col("_n") > batch).drop("_n")
        if many.isEmpty():
            break
        # Parts in order: below the first pivot, the pivot itself, between it and the next, and so on.
        pivot = lambda i: F.get("_cuts", F.lit(i))
        part = sum((F.when(F.col("v") > pivot(i), 2).when(F.col("v") == pivot(i), 1).otherwise(0) for i in range(PIVOTS)), F.lit(0))
        counts = inside.join(many, same).groupBy(*same, "_above", "_below", "_base", "_cuts", part.alias("_part")).agg(F.count(F.lit(1)).alias("_m"))
        packed = counts.groupBy(*same, "_above", "_below", "_base", "_cuts").agg(F.sort_array(F.collect_list(F.struct("_part", "_m"))).alias("_parts"))
        start = F.struct(F.col("_base").alias("base"), F.lit(-1).alias("part"))

        def step(s: Column, x: Column) -> Column:
            passed = (s["part"] < 0) & (s["base"] + x["_m"] <= F.col("_rank"))
            return F.struct(F.when(passed, s["base"] + x["_m"]).otherwise(s["base"]).alias("base"), F.when((s["part"] >= 0) | passed, s["part"]).otherwise(x["_part"]).alias("part"))

        found = written(packed.withColumn("_at", F.aggregate("_parts", start, step)).drop("_parts"), "found")
        number = F.col("_at.part")
        exact = number % 2 == 1
        answers.append(found.filter(exact).select(*same, F.get("_cuts", F.expr("_at.part div 2").cast("int")).alias("value")))
        left = F.get("_cuts", (F.expr("_at.part div 2") - 1).cast("int"))
        state = written(found.filter(~exact).select(
            *same, F.when(number > 0, left).otherwise(F.col("_above")).alias("_above"),
            F.coalesce(F.get("_cuts", F.expr("_at.part div 2").cast("int")), F.col("_below")).alias("_below"), F.col("_at.base").alias("_base"),
        ), "search")
    out = answers[0]
    for more in answers[1:]:
        out = out.unionByName(more)
    return out


# ---------------------------------------------------------------- runs of a condition

def _element(hit: Column, present: Column, least: Column) -> Column:
    """The summary of one row."""
    one, row, time = hit.cast("bigint"), F.col("row"), F.col("time_s")
    first = F.when(hit & (least <= 1), row)
    return F.struct(
        row.alias("p"), F.lit(1).cast("bigint").alias("n"), present.cast("bigint").alias("ok"), time.alias("t"), time.alias("e"), F.lit(None).cast("double").alias("step"),
        one.alias("pre"), one.alias("suf"), time.alias("suf_t"), one.alias("best"), F.when(hit, row).alias("at"), F.when(hit, time).alias("at_t"),
        first.alias("first"), F.when(first.isNotNull(), time).alias("first_t"),
    )


def _empty() -> Column:
    zero, none, never = F.lit(0).cast("bigint"), F.lit(None).cast("bigint"), F.lit(None).cast("double")
    names = {"p": none, "n": zero, "ok": zero, "t": never, "e": never, "step": never, "pre": zero, "suf": zero, "suf_t": never, "best": zero, "at": none, "at_t": never,
             "first": none, "first_t": never}
    return F.struct(*[c.alias(k) for k, c in names.items()])


def _merged(x: Column, y: Column, least: Column) -> Column:
    """The summary of two neighbouring stretches of rows."""
    joint = x["suf"] + y["pre"]
    joint_at = F.when(joint > 0, y["p"] - x["suf"])
    joint_t = F.when(x["suf"] > 0, x["suf_t"]).otherwise(y["t"])
    by_joint, by_y = joint > x["best"], y["best"] > F.greatest(x["best"], joint)
    spans = joint >= least
    pick = lambda a, b, c: F.when(by_y, a).when(by_joint, b).otherwise(c)
    return F.struct(
        F.coalesce(x["p"], y["p"]).alias("p"), (x["n"] + y["n"]).alias("n"), (x["ok"] + y["ok"]).alias("ok"), F.when(x["n"] > 0, x["t"]).otherwise(y["t"]).alias("t"),
        y["e"].alias("e"), F.least(x["step"], y["step"], F.when(x["n"] > 0, y["t"] - x["e"])).alias("step"),
        F.when(x["pre"] == x["n"], x["n"] + y["pre"]).otherwise(x["pre"]).alias("pre"), F.when(y["suf"] == y["n"], y["n"] + x["suf"]).otherwise(y["suf"]).alias("suf"),
        F.when(y["suf"] < y["n"], y["suf_t"]).otherwise(joint_t).alias("suf_t"),
        pick(y["best"], joint, x["best"]).alias("best"), pick(y["at"], joint_at, x["at"]).alias("at"), pick(y["at_t"], joint_t, x["at_t"]).alias("at_t"),
        F.when(x["first"].isNotNull(), x["first"]).when(spans, joint_at).otherwise(y["first"]).alias("first"),
        F.when(x["first"].isNotNull(), x["first_t"]).when(spans, joint_t).otherwise(y["first_t"]).alias("first_t"),
    )


def _folded(parts: str, least: Column) -> Column:
    return F.aggregate(F.sort_array(F.collect_list(parts)), _empty(), lambda x, y: _merged(x, y, least))


def run_summaries(
    rows: DataFrame, queries: DataFrame, condition: Sequence[str], hit: Callable[[], Column], present: Callable[[], Column], least: str | None = None
) -> DataFrame:
    """What each query's window holds: ``query_id, _run``, a struct of rows ``n``, rows with readings ``ok``, first time ``t``, smallest time ``step``, longest run
    ``best`` from row ``at`` (the earliest such) and ``first``, the start of the first run of ``least`` rows; ``at_t`` and ``first_t`` are their times.

    ``queries`` has ``query_id``, a valid window and the ``condition`` columns, which with the row decide ``hit`` and ``present``. Blocks are summarised
    once for each different condition of a record, however many windows ask for it.
    """
    rows = rows.withColumn("_parent", F.expr(f"row div {FAN}"))
    wanted = F.lit(1) if least is None else F.col(least)
    ends = rows.groupBy(RECORD).agg(F.min("row").alias("first_row"), (F.max("row") + 1).alias("end_row"))
    asked = queries.select("query_id", RECORD, "start_row", "stop_row", *condition)
    cut = written(pieces(asked, ends), "pieces")
    keys = [RECORD, *condition]
    element = _element(F.coalesce(hit(), F.lit(False)), present(), wanted).alias("_part")
    near = rows.join(cut.filter(F.col("_level") == 0), [RECORD, "_parent"]).filter((F.col("row") >= F.col("_lo")) & (F.col("row") < F.col("_hi")))
    used = ["query_id", *([least] if least else []), "_part"]
    parts = near.withColumn("_part", element).select(*used)
    # Blocks larger than those some window holds whole are not made.
    top = cut.agg(F.max("_level")).first()[0] or 0
    if top:
        tall = cut.filter(F.col("_level") > 0)
        leaf = rows.join(tall.select(*keys).distinct(), RECORD).select(*keys, F.lit(0).alias("_level"), F.col("row").alias("_unit"), F.lit(1).cast("bigint").alias("_n"), element)
        folded = [_folded("_part", wanted).alias("_part"), F.sum("_n").alias("_n")]
        first = written(_raise(leaf, keys, folded), "runs")
        blocks = _all_levels(first, keys, folded, top).withColumn("_parent", F.expr(f"_unit div {FAN}"))
        whole = blocks.join(tall, [*keys, "_level", "_parent"]).filter((F.col("_unit") >= F.col("_lo")) & (F.col("_unit") < F.col("_hi")))
        parts = parts.unionByName(whole.select(*used))
    return parts.groupBy(*used[:-1]).agg(_folded("_part", wanted).alias("_run")).select("query_id", "_run")
