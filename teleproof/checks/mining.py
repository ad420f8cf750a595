"""Queries: detectors, groups, packages and cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from teleproof.checks.registry import EV, LI, check, q6, r6
from teleproof.operators import cycles as C
from teleproof.operators import detect as D
from teleproof.operators import packages as P
from teleproof.operators.blocks import RECORD
from teleproof.sources.tables import LINE_CHANNELS, event_rows, line_rows, table
from teleproof.sources.workspace import written

RULE = D.ChannelRule(min_step=20.0, min_spike=60.0, neighbor_tolerance=10.0)
EVENTS = D.MiningConfig(
    channels={"value": RULE}, context=["event_type"], noise_multiplier=1.5, context_channels=["value", "k"], max_channels=6
)

STEP_HITS = f"""{EV}, m AS (SELECT record_id, r, median(value) OVER p AS mb, mad(value) OVER p AS dev, count(value) OVER p AS cb,
    median(value) OVER f AS ma, count(value) OVER f AS ca FROM ev
    WINDOW p AS (PARTITION BY record_id ORDER BY r ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING),
           f AS (PARTITION BY record_id ORDER BY r ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
  hits AS (SELECT record_id, r, greatest(20.0, 1.5 * dev) AS threshold FROM m
    WHERE cb = 4 AND ca = 4 AND abs(ma - mb) > greatest(20.0, 1.5 * dev)),
  nx AS (SELECT record_id, r, min(r) OVER (PARTITION BY record_id ORDER BY r RANGE BETWEEN 4 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM hits),
  kept AS (SELECT record_id, min(r) AS r FROM hits GROUP BY 1
    UNION ALL SELECT kept.record_id, nx.n FROM kept JOIN nx ON nx.record_id = kept.record_id AND nx.r = kept.r WHERE nx.n IS NOT NULL),
  steps AS (SELECT kept.record_id, kept.r, threshold FROM kept JOIN hits ON hits.record_id = kept.record_id AND hits.r = kept.r)"""
SPIKES = """spikes AS (SELECT record_id, r FROM (SELECT record_id, r, value AS b, lag(value) OVER o AS a, lead(value) OVER o AS c
    FROM ev WINDOW o AS (PARTITION BY record_id ORDER BY r)) WHERE abs(a - c) <= 10 AND abs(b - (a + c) / 2) > 60)"""
MOVES = """moves AS (SELECT record_id, r FROM (SELECT record_id, r, event_type, lag(event_type) OVER (PARTITION BY record_id ORDER BY r) AS p
    FROM ev) WHERE event_type <> p)"""
CANDIDATES = f"""{STEP_HITS}, {SPIKES}, {MOVES},
  cand AS (SELECT record_id, 'median_step' AS detector, r AS a, r + 1 AS b, 'value' AS channel FROM steps
    UNION ALL SELECT record_id, 'isolated_spike', r, r + 1, 'value' FROM spikes
    UNION ALL SELECT record_id, 'context_transition', r, r + 1, NULL FROM moves)"""
GROUPS = f"""{CANDIDATES}, e AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY a, b) AS i FROM cand),
  walk AS (SELECT record_id, i, a AS lo, b AS hi, CAST(1 AS BIGINT) AS g FROM e WHERE i = 1
    UNION ALL SELECT e.record_id, e.i, CASE WHEN e.a <= hi + 2 AND greatest(hi, e.b) - lo <= 12 THEN lo ELSE e.a END,
      CASE WHEN e.a <= hi + 2 AND greatest(hi, e.b) - lo <= 12 THEN greatest(hi, e.b) ELSE e.b END,
      CASE WHEN e.a <= hi + 2 AND greatest(hi, e.b) - lo <= 12 THEN g ELSE g + 1 END
    FROM walk JOIN e ON e.record_id = walk.record_id AND e.i = walk.i + 1),
  grp AS (SELECT record_id, g, min(lo) AS a, max(hi) AS b, CAST(count(*) AS BIGINT) AS n_events FROM walk GROUP BY 1, 2)"""
PACKAGES = f"""{GROUPS}, n AS (SELECT record_id, max(r) + 1 AS n FROM ev GROUP BY 1),
  pk AS (SELECT record_id, grp.a, grp.b, greatest(0, grp.a - 6) AS lo, least(n, grp.b + 6) AS hi, grp.a > 0 AS has_b, grp.b < n AS has_a
    FROM grp JOIN n USING (record_id)),
  lv AS (SELECT record_id, r, t, 'value' AS channel, value AS v FROM ev UNION ALL SELECT record_id, r, t, 'k', nullif(k, 0) FROM ev),
  ag AS (SELECT pk.record_id, pk.a, pk.b, has_b, has_a, channel, avg(v) AS mc, avg(v) FILTER (r < pk.a) AS mb, avg(v) FILTER (r >= pk.b) AS ma,
      min(v) AS mn, max(v) AS mx, count(v) = count(*) AS fc, count(v) FILTER (r < pk.a) = count(*) FILTER (r < pk.a) AS fb,
      count(v) FILTER (r >= pk.b) = count(*) FILTER (r >= pk.b) AS fa
    FROM pk JOIN lv ON lv.record_id = pk.record_id AND r >= lo AND r < hi GROUP BY ALL),
  facts AS (SELECT record_id, a, b, channel, 'mean_context' AS fact, fc AS ok, mc AS v FROM ag
    UNION ALL SELECT record_id, a, b, channel, 'min', fc, mn FROM ag UNION ALL SELECT record_id, a, b, channel, 'max', fc, mx FROM ag
    UNION ALL SELECT record_id, a, b, channel, 'mean_before', fb, mb FROM ag WHERE has_b
    UNION ALL SELECT record_id, a, b, channel, 'mean_after', fa, ma FROM ag WHERE has_a
    UNION ALL SELECT record_id, a, b, channel, 'delta', fa AND fb, ma - mb FROM ag WHERE has_a AND has_b
    UNION ALL SELECT pk.record_id, pk.a, pk.b, NULL, 'duplicate_count', true, CAST(count(*) - count(DISTINCT t) AS DOUBLE)
      FROM pk JOIN ev ON ev.record_id = pk.record_id AND r >= lo AND r < hi GROUP BY ALL)"""


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Event rows; a zero ``k`` counts as a missing reading."""
    return event_rows(spark, sf).withColumn("k", F.nullif("k", F.lit(0)))


def found(spark: SparkSession, sf: str) -> DataFrame:
    return D.candidates(events(spark, sf), EVENTS)


def groups(spark: SparkSession, sf: str) -> DataFrame:
    return P.event_groups(found(spark, sf), EVENTS)


def packages(spark: SparkSession, sf: str) -> DataFrame:
    return written(P.package_windows(groups(spark, sf), events(spark, sf), EVENTS), "packages")


@check("det_median_step", f"WITH RECURSIVE {STEP_HITS} SELECT record_id, r AS start_row, r + 1 AS stop_row, {q6('threshold')} AS threshold FROM steps")
def det_median_step(spark: SparkSession, sf: str) -> DataFrame:
    steps = D.median_steps(event_rows(spark, sf), EVENTS.channels, EVENTS.window_rows, EVENTS.noise_multiplier)
    return steps.select(RECORD, "start_row", "stop_row", r6(F.col("rule")["threshold"].cast("double")).alias("threshold"))


@check("det_isolated_spike", f"WITH {EV}, {SPIKES} SELECT record_id, r AS start_row, r + 1 AS stop_row FROM spikes")
def det_isolated_spike(spark: SparkSession, sf: str) -> DataFrame:
    return D.isolated_spikes(event_rows(spark, sf), EVENTS.channels).select(RECORD, "start_row", "stop_row")


@check("det_context_transition", f"WITH {EV}, {MOVES} SELECT record_id, r AS start_row, r + 1 AS stop_row, 'event_type' AS field FROM moves")
def det_context_transition(spark: SparkSession, sf: str) -> DataFrame:
    moves = D.context_transitions(event_rows(spark, sf), ["event_type"])
    return moves.select(RECORD, "start_row", "stop_row", F.col("rule")["field"].alias("field"))


@check("det_time_faults", f"""
WITH {LI}, p AS (SELECT record_id, r, t, lag(t) OVER (PARTITION BY record_id ORDER BY r) AS pt FROM li)
SELECT record_id, CASE WHEN t = pt THEN 'repeated_time' ELSE 'time_reversal' END AS detector, r - 1 AS start_row, r + 1 AS stop_row
FROM p WHERE t <= pt""")
def det_time_faults(spark: SparkSession, sf: str) -> DataFrame:
    return D.time_faults(line_rows(spark, sf)).select(RECORD, "detector", "start_row", "stop_row")


def _zero_sql(condition: str, least: int) -> str:
    return f"""WITH {LI}, z AS (SELECT record_id, r, r - row_number() OVER (PARTITION BY record_id ORDER BY r) AS g FROM li WHERE {condition})
SELECT record_id, min(r) AS start_row, max(r) + 1 AS stop_row FROM z GROUP BY record_id, g HAVING count(*) >= {least}"""


@check("det_zero_runs", _zero_sql("abs(l_tax) <= 0.02 AND abs(l_discount) <= 0.02", 2))
def det_zero_runs(spark: SparkSession, sf: str) -> DataFrame:
    return D.zero_runs(line_rows(spark, sf), ["l_tax", "l_discount"], 0.02, 2)


@check("all_zero_ranges", _zero_sql("l_tax = 0", 1))
def all_zero_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return D.zero_runs(line_rows(spark, sf), ["l_tax"])


@check("candidates_all", f"WITH RECURSIVE {CANDIDATES} SELECT record_id, detector, a AS start_row, b AS stop_row, channel FROM cand")
def candidates_all(spark: SparkSession, sf: str) -> DataFrame:
    return D.candidates(events(spark, sf), EVENTS).select(RECORD, "detector", "start_row", "stop_row", "channel")


@check("detector_counts", f"WITH RECURSIVE {CANDIDATES} SELECT detector, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT record_id) AS BIGINT) AS records FROM cand GROUP BY 1")
def detector_counts(spark: SparkSession, sf: str) -> DataFrame:
    return found(spark, sf).groupBy("detector").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(RECORD).alias("records")
    )


@check("event_groups", f"WITH RECURSIVE {GROUPS} SELECT record_id, a AS start_row, b AS stop_row, n_events FROM grp")
def event_groups(spark: SparkSession, sf: str) -> DataFrame:
    return P.event_groups(found(spark, sf), EVENTS).select(RECORD, "start_row", "stop_row", "n_events")


@check("case_budget", f"""WITH RECURSIVE {GROUPS}
SELECT record_id, a AS start_row, b AS stop_row, row_number() OVER (ORDER BY record_id, a, b) <= 100 AS processed FROM grp""")
def case_budget(spark: SparkSession, sf: str) -> DataFrame:
    return P.case_budget(written(groups(spark, sf), "groups"), 100).select(RECORD, "start_row", "stop_row", "processed")


@check("package_facts", f"""WITH RECURSIVE {PACKAGES}
SELECT record_id, a AS group_start, b AS group_stop, channel, fact, {q6('v')} AS value FROM facts WHERE ok""")
def package_facts(spark: SparkSession, sf: str) -> DataFrame:
    facts = P.package_measures(events(spark, sf), packages(spark, sf), ["value", "k"])
    return facts.filter(F.col("status") == "ok").select(
        RECORD, "group_start", "group_stop", "channel", "fact", r6("value").alias("value")
    )


@check("package_unavailable", f"""WITH RECURSIVE {PACKAGES}
SELECT record_id, a AS group_start, b AS group_stop, channel, fact, 'missing_values' AS reason FROM facts WHERE NOT ok""")
def package_unavailable(spark: SparkSession, sf: str) -> DataFrame:
    facts = P.package_measures(events(spark, sf), packages(spark, sf), ["value", "k"])
    return facts.filter(F.col("status") != "ok").select(
        RECORD, "group_start", "group_stop", "channel", "fact", F.col("status").alias("reason")
    )


@check("recompute_facts", f"""WITH RECURSIVE {PACKAGES}
SELECT record_id, a AS group_start, b AS group_stop, channel, fact, {q6('v')} AS recomputed, true AS agrees
FROM facts WHERE ok""")
def recompute_facts(spark: SparkSession, sf: str) -> DataFrame:
    rows, packs = events(spark, sf), packages(spark, sf)
    stored = written(P.package_measures(rows, packs, ["value", "k"]), "facts")
    return P.recompute(rows, packs, stored, ["value", "k"]).select(
        RECORD, "group_start", "group_stop", "channel", "fact", r6("recomputed").alias("recomputed"), "agrees"
    )


@check("context_change_points", f"""WITH RECURSIVE {PACKAGES}, s AS (SELECT record_id, r, event_type, lag(event_type) OVER (PARTITION BY record_id ORDER BY r) AS p FROM ev)
SELECT pk.record_id, pk.a AS group_start, r AS "row", event_type AS context FROM pk JOIN s ON s.record_id = pk.record_id AND r >= lo AND r < hi
WHERE r = lo OR event_type <> p""")
def context_change_points(spark: SparkSession, sf: str) -> DataFrame:
    return P.context_changes(event_rows(spark, sf), packages(spark, sf), "event_type").drop("package_id")


@check("channel_priority", f"""
WITH {LI}, z AS (SELECT record_id, bool_or(l_discount = 0) AS d, bool_or(l_tax = 0) AS x, bool_or(l_quantity = 1) AS q FROM li GROUP BY 1)
SELECT record_id, array_to_string(list_slice(list_filter(['', CASE WHEN d THEN 'l_discount' END, CASE WHEN q THEN 'l_quantity' END,
    CASE WHEN x THEN 'l_tax' END, 'l_extendedprice', CASE WHEN NOT q THEN 'l_quantity' END], lambda c: c <> ''), 1, 3), ',') AS channels FROM z""")
def channel_priority(spark: SparkSession, sf: str) -> DataFrame:
    zero = F.array_compact(F.array(
        F.when(F.max(F.col("l_discount") == 0), F.lit("l_discount")), F.when(F.max(F.col("l_tax") == 0), F.lit("l_tax")),
        F.when(F.max(F.col("l_quantity") == 1), F.lit("l_quantity")),
    ))
    detected = line_rows(spark, sf).groupBy(RECORD).agg(zero.alias("detected"))
    chosen = P.channel_priority(F.col("detected"), ["l_extendedprice", "l_quantity"], 3)
    return detected.select(RECORD, F.array_join(chosen, ",").alias("channels"))


CYCLES = f"""{EV}, x AS (SELECT *, CASE WHEN event_type = 'purchase' AND lag(event_type) OVER (PARTITION BY record_id ORDER BY r) <> 'purchase'
    THEN 1 ELSE 0 END AS edge FROM ev),
  cy AS (SELECT *, CAST(sum(edge) OVER (PARTITION BY record_id ORDER BY r) + 1 AS BIGINT) AS cycle FROM x),
  seg AS (SELECT record_id, cycle, min(r) AS a, max(r) + 1 AS b, arg_min(t, r) AS t0 FROM cy GROUP BY 1, 2)"""
INTERVALS = f"""{CYCLES}, lo AS (SELECT record_id, cycle, r, r - row_number() OVER (PARTITION BY record_id, cycle ORDER BY r) AS g FROM cy WHERE k < 50),
  iv AS (SELECT record_id, cycle, min(r) AS a, max(r) + 1 AS b FROM lo GROUP BY record_id, cycle, g HAVING count(*) >= 2)"""
RUNS = """br(branch, limit_, nominal) AS (VALUES ('b1', 10.0::DOUBLE, 3600.0::DOUBLE), ('b2', 20.0, 7200.0), ('b3', 40.0, 10800.0)),
  hh AS (SELECT record_id, cycle, branch, nominal, r, t, r - row_number() OVER (PARTITION BY record_id, cycle, branch ORDER BY r) AS g
    FROM cy JOIN br ON value > limit_),
  ru AS (SELECT record_id, cycle, branch, min(r) AS a, max(r) + 1 AS b, min(t) - t0 - nominal AS start_minus, max(t) - min(t) AS span
    FROM hh JOIN seg USING (record_id, cycle) GROUP BY record_id, cycle, branch, nominal, t0, g HAVING count(*) >= 2)"""
FEATURES = f"""{INTERVALS}, th(threshold) AS (VALUES (20.0::DOUBLE), (40.0), (80.0)),
  st AS (SELECT iv.record_id, iv.cycle, iv.a, iv.b, median(value) AS median, median(value) FILTER (r >= iv.b - 60) AS tail_median, arg_min(t, r) AS t0
    FROM iv JOIN ev ON ev.record_id = iv.record_id AND r >= iv.a AND r < iv.b GROUP BY 1, 2, 3, 4),
  hv AS (SELECT iv.record_id, iv.cycle, iv.a, threshold, r, t, r - row_number() OVER (PARTITION BY iv.record_id, iv.a, threshold ORDER BY r) AS g
    FROM iv JOIN ev ON ev.record_id = iv.record_id AND r >= iv.a AND r < iv.b JOIN th ON value > threshold),
  rr AS (SELECT record_id, cycle, a, threshold, min(r) AS s, min(t) AS t FROM hv GROUP BY record_id, cycle, a, threshold, g HAVING count(*) >= 2),
  os AS (SELECT record_id, cycle, a, threshold, min(s) AS onset_row, arg_min(t, s) AS t FROM rr GROUP BY 1, 2, 3, 4),
  ft AS (SELECT st.record_id, st.cycle, st.a, st.b, median, tail_median, th.threshold, onset_row, os.t - t0 AS offset_s
    FROM st CROSS JOIN th LEFT JOIN os ON os.record_id = st.record_id AND os.a = st.a AND os.threshold = th.threshold)"""


def purchase():
    return F.col("event_type") == "purchase"


def cycled(spark: SparkSession, sf: str) -> DataFrame:
    return written(C.with_cycles(event_rows(spark, sf), purchase()), "cycles")


def low_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return written(C.phase_intervals(cycled(spark, sf), F.col("k") < 50, 2), "intervals")


def branches() -> list[tuple]:
    return [(f"b{i}", F.col("value") > limit, 3600.0 * i) for i, limit in enumerate((10, 20, 40), 1)]


def branch_runs(rows: DataFrame) -> DataFrame:
    return C.active_runs(rows, branches(), 2)


@check("cycle_segments", f"WITH {CYCLES} SELECT record_id, cycle, a AS start_row, b AS stop_row FROM seg")
def cycle_segments(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.with_cycles(event_rows(spark, sf), purchase())
    return C.cycle_segments(rows).drop("start_time_s")


@check("phase_intervals", f"WITH {INTERVALS} SELECT record_id, cycle, a AS start_row, b AS stop_row FROM iv")
def phase_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return low_intervals(spark, sf)


@check("active_runs", f"""WITH {CYCLES}, {RUNS} SELECT record_id, cycle, branch, a AS start_row, b AS stop_row,
  {q6('start_minus')} AS start_minus_nominal_s, {q6('span')} AS span_s FROM ru""")
def active_runs(spark: SparkSession, sf: str) -> DataFrame:
    return branch_runs(cycled(spark, sf)).withColumns(
        {"start_minus_nominal_s": r6("start_minus_nominal_s"), "span_s": r6("span_s")}
    )


@check("interval_features", f"""WITH {FEATURES} SELECT record_id, cycle, a AS start_row, b AS stop_row, {q6('median')} AS median,
  {q6('tail_median')} AS tail_median, threshold, onset_row, {q6('offset_s')} AS offset_s FROM ft""")
def interval_features(spark: SparkSession, sf: str) -> DataFrame:
    features = C.interval_features(event_rows(spark, sf), low_intervals(spark, sf), "value", [20.0, 40.0, 80.0], 2)
    return features.withColumns({c: r6(c) for c in ("median", "tail_median", "offset_s")})


@check("source_ranges", f"""WITH {FEATURES}, {RUNS},
  f1 AS (SELECT record_id, CAST(count(offset_s) AS BIGINT) AS rc, min(offset_s) AS rmin, max(offset_s) AS rmax,
    CAST(count(*) FILTER (median <= 10) AS BIGINT) AS lc FROM ft WHERE threshold = 20 GROUP BY 1),
  t1 AS (SELECT record_id, CAST(count(*) AS BIGINT) AS n, min(start_minus) AS smin, max(start_minus) AS smax FROM ru GROUP BY 1),
  c1 AS (SELECT record_id, CAST(count(*) AS BIGINT) AS cycles, max(b) AS n_rows FROM seg GROUP BY 1)
SELECT record_id, cycles, n_rows, coalesce(rc, 0) AS recovery_count, {q6('rmin')} AS recovery_min_s, {q6('rmax')} AS recovery_max_s,
  coalesce(lc, 0) AS low_median_count, coalesce(n, 0) AS observed_runs, {q6('smin')} AS start_min_s, {q6('smax')} AS start_max_s
FROM c1 LEFT JOIN f1 USING (record_id) LEFT JOIN t1 USING (record_id)""")
def source_ranges(spark: SparkSession, sf: str) -> DataFrame:
    rows = cycled(spark, sf)
    intervals = written(C.phase_intervals(rows, F.col("k") < 50, 2), "intervals")
    features = C.interval_features(event_rows(spark, sf), intervals, "value", [20.0], 2)
    ranges = C.source_ranges(features, branch_runs(rows), C.cycle_segments(rows), 20.0, 10.0)
    return ranges.withColumns({c: r6(c) for c in ("recovery_min_s", "recovery_max_s", "start_min_s", "start_max_s")})


@check("capacity_audit", f"""WITH {FEATURES}, nn AS (SELECT record_id, event_type <> 'error' AS is_normal FROM ev WHERE r = 0),
  sg AS (SELECT record_id, count(*) AS c, max(b) AS n FROM seg GROUP BY 1), i1 AS (SELECT record_id, count(*) AS i FROM iv GROUP BY 1),
  f1 AS (SELECT record_id, count(offset_s) AS rc, count(*) FILTER (median <= 10) AS lc FROM ft WHERE threshold = 20 GROUP BY 1),
  {RUNS}, t1 AS (SELECT record_id, count(*) AS ru FROM ru GROUP BY 1), z AS (SELECT record_id, r, r - row_number() OVER (PARTITION BY record_id ORDER BY r) AS g FROM ev WHERE k = 0),
  z1 AS (SELECT record_id, count(*) AS zr, count(DISTINCT g) AS zg FROM z GROUP BY 1)
SELECT CAST(count(*) AS BIGINT) AS sources, CAST(coalesce(sum(ru), 0) AS BIGINT) AS load_runs, CAST(coalesce(sum(zr), 0) AS BIGINT) AS zero_rows,
  CAST(coalesce(sum(zg), 0) AS BIGINT) AS zero_ranges, CAST(count(*) FILTER (is_normal) AS BIGINT) AS normal_sources,
  CAST(count(*) FILTER (NOT is_normal) AS BIGINT) AS fault_sources, CAST(sum(n) AS BIGINT) AS raw_rows, CAST(sum(c) AS BIGINT) AS cycles,
  CAST(coalesce(sum(c) FILTER (is_normal), 0) AS BIGINT) AS normal_cycles, CAST(coalesce(sum(c) FILTER (NOT is_normal), 0) AS BIGINT) AS fault_cycles,
  CAST(coalesce(sum(i) FILTER (is_normal), 0) AS BIGINT) AS normal_low_intervals,
  CAST(coalesce(sum(lc) FILTER (is_normal), 0) AS BIGINT) AS normal_low_median_count,
  CAST(coalesce(sum(rc) FILTER (is_normal), 0) AS BIGINT) AS normal_recovery_count
FROM sg JOIN nn USING (record_id) LEFT JOIN i1 USING (record_id) LEFT JOIN f1 USING (record_id) LEFT JOIN t1 USING (record_id) LEFT JOIN z1 USING (record_id)""")
def capacity_audit(spark: SparkSession, sf: str) -> DataFrame:
    rows = event_rows(spark, sf)
    normal = rows.filter(F.col("row") == 0).select(RECORD, (F.col("event_type") != "error").alias("is_normal"))
    return C.capacity_audit(rows, purchase(), F.col("k") < 50, "value", normal, 2, 20.0, 2, 10.0, branches(), 2, ["k"])


@check("load_timing", f"""WITH {CYCLES}, {RUNS} SELECT record_id, branch, CAST(count(*) AS BIGINT) AS observed_runs, {q6('min(start_minus)')} AS start_min_s,
  {q6('max(start_minus)')} AS start_max_s FROM ru GROUP BY 1, 2""")
def load_timing(spark: SparkSession, sf: str) -> DataFrame:
    return C.load_timing(branch_runs(cycled(spark, sf))).withColumns({c: r6(c) for c in ("start_min_s", "start_max_s")})


@check("corpus_totals", f"""
WITH {LI}, g AS (SELECT record_id, count(*) AS n, count(*) FILTER (l_tax = 0) AS z FROM li GROUP BY 1)
SELECT CAST(count(*) AS BIGINT) AS records, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(z) AS BIGINT) AS zero_rows,
  CAST(max(n) AS BIGINT) AS longest, CAST(min(n) AS BIGINT) AS shortest FROM g""")
def corpus_totals(spark: SparkSession, sf: str) -> DataFrame:
    per_record = line_rows(spark, sf).groupBy(RECORD).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_tax") == 0).alias("z")
    )
    return per_record.agg(
        F.count(F.lit(1)).alias("records"), F.sum("n").alias("n_rows"), F.sum("z").alias("zero_rows"),
        F.max("n").alias("longest"), F.min("n").alias("shortest"),
    )


@check("label_transitions", f"""
WITH {LI}, p AS (SELECT record_id, r, l_returnflag AS f, lag(l_returnflag) OVER (PARTITION BY record_id ORDER BY r) AS g FROM li)
SELECT record_id, r AS "row", g AS label_from, f AS label_to FROM p WHERE f <> g""")
def label_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return C.label_transitions(line_rows(spark, sf), "l_returnflag")


@check("label_counts", """
SELECT quality, toxic, CAST(count(*) AS BIGINT) AS n FROM labels GROUP BY 1, 2""")
def label_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@check("context_values", f"""
WITH {EV} SELECT record_id, event_type AS context, CAST(count(*) AS BIGINT) AS n FROM ev GROUP BY 1, 2""")
def context_values(spark: SparkSession, sf: str) -> DataFrame:
    """Different context values of each record as rows, however many there are."""
    return event_rows(spark, sf).groupBy(RECORD, F.col("event_type").alias("context")).agg(F.count(F.lit(1)).alias("n"))
