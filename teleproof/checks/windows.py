"""Queries: rows, windows and the time axis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from teleproof.checks.registry import EM, EV, LI, LI_LONG, LI_WINDOWS, check, q6, r6
from teleproof.functions import scalar as S
from teleproof.operators import quality as Q
from teleproof.operators import windows as W
from teleproof.operators.blocks import RECORD, at_home, mask_runs, ordered, with_halo
from teleproof.sources.tables import (
    LINE_CHANNELS,
    embedding_rows,
    event_rows,
    line_blocks,
    line_rows,
    long_layout,
    table,
)

WHOLE = ["record_id", "start_row", "stop_row"]


def whole_windows(rows: DataFrame) -> DataFrame:
    return W.extents(rows).select(RECORD, F.col("first_row").alias("start_row"), F.col("end_row").alias("stop_row"))


def fixed_windows(rows: DataFrame, *bounds: tuple[int, int]) -> DataFrame:
    pairs = F.array(*[
        F.struct(F.lit(a).cast("bigint").alias("start_row"), F.lit(b).cast("bigint").alias("stop_row")) for a, b in bounds
    ])
    return W.extents(rows).select(RECORD, F.inline(pairs))


def line_windows(rows: DataFrame) -> DataFrame:
    """Whole record, [0,200) and [200,400)."""
    fixed = F.array(
        F.struct(F.col("first_row").alias("start_row"), F.col("end_row").alias("stop_row")),
        F.struct(F.lit(0).cast("bigint").alias("start_row"), F.lit(200).cast("bigint").alias("stop_row")),
        F.struct(F.lit(200).cast("bigint").alias("start_row"), F.lit(400).cast("bigint").alias("stop_row")),
    )
    return W.extents(rows).select(RECORD, F.inline(fixed))


@check("scan_records", f"WITH {EV} SELECT record_id, r AS \"row\", {q6('t')} AS time_s, value, k, event_type FROM ev")
def scan_records(spark: SparkSession, sf: str) -> DataFrame:
    return event_rows(spark, sf).withColumn("time_s", r6("time_s"))


@check(
    "row_numbering",
    f"WITH {LI} SELECT record_id, r AS \"row\", t AS time_s, l_quantity, l_extendedprice, l_discount, l_tax FROM li",
)
def row_numbering(spark: SparkSession, sf: str) -> DataFrame:
    return line_rows(spark, sf).select(RECORD, "row", "time_s", *LINE_CHANNELS)


@check("parse_null_tokens", """
WITH tok AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'NA' WHEN 'signup' THEN ''
    WHEN 'view' THEN concat(' ', json_extract_string(props, '$.k'), ' ')
    WHEN 'purchase' THEN concat(json_extract_string(props, '$.k'), CASE WHEN value > 50 THEN 'd' WHEN value > 25 THEN 'f' ELSE 'x' END) ELSE json_extract_string(props, '$.k') END AS raw
  FROM events), c AS (SELECT event_id, trim(raw) AS x FROM tok)
SELECT event_id, CASE WHEN x IN ('', 'NA', 'NaN', 'nan', 'null') THEN NULL ELSE TRY_CAST(x AS DOUBLE) END AS reading,
  CASE WHEN x IN ('', 'NA', 'NaN', 'nan', 'null') THEN 'missing' WHEN TRY_CAST(x AS DOUBLE) IS NULL THEN 'not_a_number'
    ELSE 'ok' END AS status FROM c""")
def parse_null_tokens(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    raw = (
        F.when(F.col("event_type") == "error", "NA")
        .when(F.col("event_type") == "signup", "")
        .when(F.col("event_type") == "view", F.concat(F.lit(" "), k, F.lit(" ")))
        .when(F.col("event_type") == "purchase", F.concat(k, F.when(F.col("value") > 50, "d").when(F.col("value") > 25, "f").otherwise("x")))
        .otherwise(k)
    )
    return table(spark, sf, "events").select(
        "event_id", S.parse_number(raw).alias("reading"), S.number_status(raw).alias("status")
    )


@check("record_row_counts", """
SELECT s_suppkey AS record_id, CAST(count(l_orderkey) AS BIGINT) AS n_rows, count(l_orderkey) = 0 AS is_empty
FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1""")
def record_row_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias(RECORD)).agg(F.count(F.lit(1)).alias("n"))
    declared = table(spark, sf, "supplier").select(F.col("s_suppkey").alias(RECORD))
    n = F.coalesce("n", F.lit(0).cast("bigint"))
    return declared.join(counts, RECORD, "left").select(RECORD, n.alias("n_rows"), (n == 0).alias("is_empty"))


@check("extract_records", f"""
WITH {LI}, s AS (SELECT * FROM li WHERE r >= 100 AND r < 400)
SELECT record_id, r AS "row", t - first_value(t) OVER (PARTITION BY record_id ORDER BY r) AS time_s, l_quantity, l_tax
FROM s""")
def extract_records(spark: SparkSession, sf: str) -> DataFrame:
    rows = line_rows(spark, sf).select(RECORD, "row", "time_s", "l_quantity", "l_tax")
    start, stop = F.lit(100), F.lit(400)
    first = rows.filter(F.col("row") == start).select(RECORD, F.col("time_s").alias("t0"))
    return (
        W.slice_rows(rows, start, stop).join(first, RECORD)
        .select(RECORD, "row", (F.col("time_s") - F.col("t0")).alias("time_s"), "l_quantity", "l_tax")
    )


@check("window_filter", f"""
WITH {LI} SELECT record_id, r AS "row", l_quantity FROM li WHERE r >= 50 AND r < 150""")
def window_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = line_rows(spark, sf).select(RECORD, "row", "l_quantity")
    return W.slice_rows(rows, F.lit(50), F.lit(150))


@check("channel_scope", f"""
WITH q(channel) AS (VALUES ('l_quantity'), ('l_tax'), ('p_size'), ('L_TAX')),
  d(channel) AS (VALUES ('l_quantity'), ('l_extendedprice'), ('l_discount'), ('l_tax')),
  {LI}, n AS (SELECT record_id, count(*) AS n_rows FROM li GROUP BY 1)
SELECT n.record_id, q.channel, CASE WHEN d.channel IS NULL THEN 'undeclared_channel' ELSE 'ok' END AS status,
  CASE WHEN d.channel IS NULL THEN NULL ELSE n.n_rows END AS n_readings
FROM n CROSS JOIN q LEFT JOIN d ON d.channel = q.channel""")
def channel_scope(spark: SparkSession, sf: str) -> DataFrame:
    rows = line_rows(spark, sf).select(RECORD, "row", "time_s", *LINE_CHANNELS)
    readings = long_layout(rows, LINE_CHANNELS).groupBy(RECORD, "channel").agg(F.count("reading").alias("n_readings"))
    asked = F.explode(F.array(*[F.lit(c) for c in ("l_quantity", "l_tax", "p_size", "L_TAX")]))
    queries = W.extents(rows).select(RECORD, asked.alias("channel"))
    status = F.when(F.col("n_readings").isNull(), "undeclared_channel").otherwise("ok")
    return queries.join(readings, [RECORD, "channel"], "left").select(RECORD, "channel", status.alias("status"), "n_readings")


@check("channel_catalog", f"""
WITH {LI}, {LI_LONG}
SELECT channel, CAST(count(*) AS BIGINT) AS n_readings, min(v) AS lowest, max(v) AS highest FROM ll GROUP BY 1""")
def channel_catalog(spark: SparkSession, sf: str) -> DataFrame:
    rows = line_rows(spark, sf).select(RECORD, "row", "time_s", *LINE_CHANNELS)
    return long_layout(rows, LINE_CHANNELS).groupBy("channel").agg(
        F.count("reading").alias("n_readings"), F.min("reading").alias("lowest"), F.max("reading").alias("highest")
    )


@check("wide_to_long", f"WITH {LI}, {LI_LONG} SELECT record_id, r AS \"row\", channel, v AS reading FROM ll")
def wide_to_long(spark: SparkSession, sf: str) -> DataFrame:
    return long_layout(line_rows(spark, sf), LINE_CHANNELS, [RECORD, "row"])


@check("null_guard_stat", f"""
WITH {EV}, g AS (SELECT record_id, avg(nullif(k, 0)) AS m, count(*) AS n, count(nullif(k, 0)) AS c FROM ev GROUP BY 1)
SELECT record_id, CASE WHEN c < n THEN 'missing_values' ELSE 'ok' END AS status,
  CASE WHEN c = n THEN {q6('m')} END AS value FROM g""")
def null_guard_stat(spark: SparkSession, sf: str) -> DataFrame:
    rows = event_rows(spark, sf).select(RECORD, "row", F.nullif("k", F.lit(0)).alias("k"))
    asked = whole_windows(rows).withColumns({"channel": F.lit("k"), "stat": F.lit("mean")})
    return W.stat_queries(rows, asked, ["k"]).select(RECORD, "status", r6("value").alias("value"))


@check("region_filter", f"""
WITH {LI}, g(region, a, b) AS (VALUES ('early', 100, 250), ('late', 250, 400), ('beyond', 100000000, 100000010)),
  n AS (SELECT record_id, max(r) + 1 AS n FROM li GROUP BY 1)
SELECT n.record_id, region, CASE WHEN b <= n THEN 'ok' ELSE 'outside_scope' END AS status,
  CAST(count(li.r) AS BIGINT) AS n_rows, sum(l_quantity) AS quantity
FROM n CROSS JOIN g LEFT JOIN li ON li.record_id = n.record_id AND r >= a AND r < b AND b <= n GROUP BY 1, 2, 3""")
def region_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = line_rows(spark, sf).select(RECORD, "row", "l_quantity")
    regions = F.array(*[
        F.struct(F.lit(n).alias("region"), F.lit(a).cast("bigint").alias("start_row"), F.lit(b).cast("bigint").alias("stop_row"))
        for n, a, b in (("early", 100, 250), ("late", 250, 400), ("beyond", 100_000_000, 100_000_010))
    ])
    scope = W.extents(rows)
    checked = W.scope_check(scope.select(RECORD, F.inline(regions)), scope)
    inside = W.rows_in_windows(rows, checked.filter(F.col("status") == "ok")).groupBy(RECORD, "region").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")
    )
    return checked.join(inside, [RECORD, "region"], "left").select(
        RECORD, "region", "status", F.coalesce("n", F.lit(0).cast("bigint")).alias("n_rows"), "quantity"
    )


@check("single_phase_region", f"""
WITH {EV}, g AS (SELECT record_id, min(r) FILTER (event_type = 'error') AS a, max(r) FILTER (event_type = 'error') + 1 AS b,
    CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS n_rows FROM ev GROUP BY 1)
SELECT record_id, a AS start_row, b AS stop_row, n_rows,
  CASE WHEN n_rows = 0 THEN 'absent' WHEN b - a = n_rows THEN 'one_phase' ELSE 'not_contiguous' END AS status FROM g""")
def single_phase_region(spark: SparkSession, sf: str) -> DataFrame:
    return W.single_phase(event_rows(spark, sf), F.col("event_type") == "error")


@check("slice_last_seconds", f"""
WITH {EV}, e AS (SELECT record_id, max(r) + 1 AS n, arg_max(t, r) AS tl FROM ev GROUP BY 1)
SELECT e.record_id, 'ok' AS status, min(r) AS slice_start, n AS slice_stop
FROM e JOIN ev ON ev.record_id = e.record_id AND t >= tl - 86399 GROUP BY 1, n""")
def slice_last_seconds(spark: SparkSession, sf: str) -> DataFrame:
    return W.slice_last_seconds(event_rows(spark, sf), 86_400).select(RECORD, "status", "slice_start", "slice_stop")


SUSTAINED = f"""{EV}, h AS (SELECT record_id, r, t, r - row_number() OVER (PARTITION BY record_id ORDER BY r) AS g
    FROM ev WHERE value > 40),
  runs AS (SELECT record_id, min(r) AS a, max(r) + 1 AS b, min(t) AS t FROM h GROUP BY record_id, g),
  f AS (SELECT record_id, max(r) + 1 AS n, arg_min(t, r) AS t0 FROM ev GROUP BY 1),
  o AS (SELECT record_id, min(a) AS onset_row, arg_min(t, a) AS t FROM runs WHERE b - a >= 3 GROUP BY 1)"""


def sustained_queries(rows: DataFrame, threshold: float = 40.0, k: int = 3) -> DataFrame:
    return whole_windows(rows).select(
        F.col(RECORD).alias("query_id"), *WHOLE, F.lit("value").alias("channel"), F.lit(threshold).alias("threshold"),
        F.lit(k).alias("min_records"), F.lit("above").alias("direction"),
    )


@check("first_sustained", f"""
WITH {SUSTAINED} SELECT f.record_id, 'ok' AS status, onset_row, {q6('o.t - f.t0')} AS value
FROM f LEFT JOIN o USING (record_id)""")
def first_sustained(spark: SparkSession, sf: str) -> DataFrame:
    rows = event_rows(spark, sf)
    found = W.first_sustained(rows, sustained_queries(rows), ["value"])
    return found.select(RECORD, "status", "onset_row", r6("value").alias("value"))


@check("slice_around_onset", f"""
WITH {SUSTAINED}, s AS (SELECT f.record_id, n, onset_row, side, CASE side WHEN 'before' THEN onset_row - 5 ELSE onset_row END AS a,
    CASE side WHEN 'before' THEN onset_row ELSE onset_row + 5 END AS b
  FROM f LEFT JOIN o USING (record_id) CROSS JOIN (VALUES ('before'), ('after')) x(side))
SELECT record_id, side, onset_row, a AS slice_start, b AS slice_stop,
  CASE WHEN onset_row IS NULL THEN 'no_onset' WHEN a >= 0 AND b <= n THEN 'ok' ELSE 'exceeds_window' END AS status FROM s""")
def slice_around_onset(spark: SparkSession, sf: str) -> DataFrame:
    rows = event_rows(spark, sf)
    found = W.first_sustained(rows, sustained_queries(rows), ["value"])
    return W.slice_around_onset(found, 5, 5).select(RECORD, "side", "onset_row", "slice_start", "slice_stop", "status")


@check("sustained_multi_threshold", f"""
WITH {EV}, th(threshold) AS (VALUES (20.0::DOUBLE), (40.0), (80.0)),
  h AS (SELECT record_id, threshold, r, t, r - row_number() OVER (PARTITION BY record_id, threshold ORDER BY r) AS g
    FROM ev JOIN th ON value > threshold),
  runs AS (SELECT record_id, threshold, min(r) AS a, max(r) + 1 AS b, min(t) AS t FROM h GROUP BY record_id, threshold, g),
  f AS (SELECT record_id, arg_min(t, r) AS t0 FROM ev GROUP BY 1),
  o AS (SELECT record_id, threshold, min(a) AS onset_row, arg_min(t, a) AS t FROM runs WHERE b - a >= 3 GROUP BY 1, 2)
SELECT f.record_id, th.threshold, onset_row, {q6('o.t - f.t0')} AS value
FROM f CROSS JOIN th LEFT JOIN o ON o.record_id = f.record_id AND o.threshold = th.threshold""")
def sustained_multi_threshold(spark: SparkSession, sf: str) -> DataFrame:
    rows = event_rows(spark, sf)
    several = F.explode(F.array(*[F.lit(x) for x in (20.0, 40.0, 80.0)]))
    asked = sustained_queries(rows).withColumn("threshold", several).withColumn(
        "query_id", F.concat_ws("|", F.col(RECORD).cast("string"), F.col("threshold").cast("string"))
    )
    found = W.first_sustained(rows, asked, ["value"], strict_time=False)
    return found.select(RECORD, "threshold", "onset_row", r6("value").alias("value"))


@check("first_crossing", f"""
WITH {EV}, f AS (SELECT record_id, arg_min(t, r) AS t0 FROM ev GROUP BY 1),
  c AS (SELECT record_id, arg_min(t, r) AS t1 FROM ev WHERE value >= 120 GROUP BY 1)
SELECT f.record_id, CASE WHEN t1 IS NULL THEN 'not_reached' ELSE 'ok' END AS status, {q6('t1 - t0')} AS value
FROM f LEFT JOIN c USING (record_id)""")
def first_crossing(spark: SparkSession, sf: str) -> DataFrame:
    rows = event_rows(spark, sf)
    found = W.first_crossing(rows, sustained_queries(rows, 120.0), ["value"])
    return found.select(RECORD, "status", r6("value").alias("value"))


@check("tail_records", f"""
WITH {LI}, n AS (SELECT record_id, max(r) AS m FROM li GROUP BY 1)
SELECT li.record_id, r AS "row", l_quantity FROM li JOIN n USING (record_id) WHERE r >= m - 59""")
def tail_records(spark: SparkSession, sf: str) -> DataFrame:
    return W.tail_rows(line_rows(spark, sf).select(RECORD, "row", "l_quantity"), 60)


@check("paged_read", f"""
WITH {LI}, n AS (SELECT record_id, least(max(r) + 1, 600) AS b FROM li GROUP BY 1)
SELECT li.record_id, r AS "row", t AS time_s, l_quantity, b AS requested_stop_row,
  CASE WHEN b > 512 THEN 512 END AS next_start_row FROM li JOIN n USING (record_id) WHERE r < least(b, 512)""")
def paged_read(spark: SparkSession, sf: str) -> DataFrame:
    rows = line_rows(spark, sf)
    asked = whole_windows(rows).withColumn("stop_row", F.least("stop_row", F.lit(600)))
    return W.paged_read(rows, asked, ["l_quantity"]).select(
        RECORD, "row", "time_s", "l_quantity", "requested_stop_row", "next_start_row"
    )


@check("bounded_read", f"""
WITH {LI}, o AS (SELECT record_id, t AS t0 FROM li WHERE r = 0)
SELECT li.record_id, 'small' AS query, 'ok' AS status, r AS "row", t - t0 AS time_offset, l_quantity
FROM li JOIN o USING (record_id) WHERE r >= 100 AND r < 250
UNION ALL SELECT record_id, 'large', 'size_cap', NULL, NULL, NULL FROM o""")
def bounded_read(spark: SparkSession, sf: str) -> DataFrame:
    rows = line_rows(spark, sf)
    asked = fixed_windows(rows, (100, 250), (0, 600)).select(
        F.when(F.col("start_row") == 100, "small").otherwise("large").alias("query_id"), *WHOLE,
        F.lit(0).cast("bigint").alias("origin_row"),
    )
    return W.bounded_read(rows, asked, ["l_quantity"]).withColumnRenamed("query_id", "query")


@check("query_scope_check", f"""
WITH {LI}, n AS (SELECT record_id, max(r) + 1 AS n FROM li GROUP BY 1), q(a, b) AS (VALUES (0, 100), (50, 50), (500, 100000000), (-1, 5))
SELECT record_id, a AS start_row, b AS stop_row, CASE WHEN a < 0 OR a >= b THEN 'invalid_window' WHEN b > n THEN 'outside_scope'
  ELSE 'ok' END AS status FROM n CROSS JOIN q
UNION ALL SELECT -record_id - 1, 0, 10, 'unknown_record' FROM n""")
def query_scope_check(spark: SparkSession, sf: str) -> DataFrame:
    rows = line_rows(spark, sf)
    asked = fixed_windows(rows, (0, 100), (50, 50), (500, 100_000_000), (-1, 5))
    stray = fixed_windows(rows, (0, 10)).withColumn(RECORD, -F.col(RECORD) - 1)
    return W.scope_check(asked.unionByName(stray), W.extents(rows))


PHASES = [("boundary", 0.0, 86400.0), ("idle", 86400.0, 432000.0), ("load", 432000.0, 864000.0),
          ("rest", 864000.0, 1296000.0), ("recovery", 1296000.0, 2592000.0)]
PHASE_SQL = "ph(region, lo, hi) AS (VALUES " + ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE)" for n, a, b in PHASES) + ")"


@check("clock_region", f"""
WITH {EV}, f AS (SELECT record_id, t AS t0 FROM ev WHERE r = 0)
SELECT ev.record_id, 'window' AS region, min(r) AS start_row, max(r) + 1 AS stop_row, CAST(count(*) AS BIGINT) AS n_rows,
  CASE WHEN max(r) + 1 - min(r) = count(*) THEN 'ok' ELSE 'not_contiguous' END AS status
FROM ev JOIN f USING (record_id) WHERE t - t0 >= 86400 AND t - t0 < 432000 GROUP BY 1""")
def clock_region(spark: SparkSession, sf: str) -> DataFrame:
    return W.clock_regions(event_rows(spark, sf), [("window", 86400.0, 432000.0)])


@check("phase_label", f"""
WITH {EV}, {PHASE_SQL}, f AS (SELECT record_id, t AS t0 FROM ev WHERE r = 0)
SELECT ev.record_id, region, min(r) AS start_row, max(r) + 1 AS stop_row, CAST(count(*) AS BIGINT) AS n_rows, 'ok' AS status
FROM ev JOIN f USING (record_id) JOIN ph ON t - t0 >= lo AND t - t0 < hi GROUP BY 1, 2""")
def phase_label(spark: SparkSession, sf: str) -> DataFrame:
    return W.clock_regions(event_rows(spark, sf), PHASES)


@check("elapsed_seconds", f"""
WITH {EV} SELECT record_id, r AS "row", {q6('t - first_value(t) OVER (PARTITION BY record_id ORDER BY r)')} AS elapsed_s FROM ev""")
def elapsed_seconds(spark: SparkSession, sf: str) -> DataFrame:
    return W.elapsed(event_rows(spark, sf).select(RECORD, "row", "time_s")).select(RECORD, "row", r6("elapsed_s").alias("elapsed_s"))


WINDOW_STATS_SQL = f"""
SELECT w.record_id, w.a AS start_row, w.b AS stop_row, channel, CAST(count(*) AS BIGINT) AS n_rows, {q6('avg(v)')} AS mean,
  {q6('median(v)')} AS median, min(v) AS lowest, max(v) AS highest
FROM w JOIN ll ON ll.record_id = w.record_id AND r >= a AND r < b GROUP BY ALL"""


@check("window_stats", f"WITH {LI}, {LI_LONG}, {LI_WINDOWS} {WINDOW_STATS_SQL}")
def window_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = line_rows(spark, sf)
    found = W.window_stats(rows, line_windows(rows), LINE_CHANNELS, line_blocks(spark, sf))
    return found.select(
        *WHOLE, "channel", "n_rows", r6("mean").alias("mean"), r6("median").alias("median"),
        F.col("min").alias("lowest"), F.col("max").alias("highest"),
    )


@check("batched_window_stats", f"""
WITH {LI}, {LI_LONG}, n AS (SELECT record_id, max(r) + 1 AS n FROM li GROUP BY 1),
  w AS (SELECT record_id, 0 AS a, 100 AS b FROM n UNION ALL SELECT record_id, 50, 150 FROM n UNION ALL SELECT record_id, n - 60, n FROM n),
  g AS (SELECT w.record_id, a, b, channel, avg(v) AS mean, median(v) AS median, min(v) AS lo, max(v) AS hi, count(*) AS c
    FROM w JOIN ll ON ll.record_id = w.record_id AND r >= a AND r < b GROUP BY ALL)
SELECT record_id, a AS start_row, b AS stop_row, channel, s AS stat, 'ok' AS status,
  {q6("CASE s WHEN 'mean' THEN mean WHEN 'median' THEN median WHEN 'min' THEN lo WHEN 'max' THEN hi ELSE c END")} AS value
FROM g CROSS JOIN (VALUES ('mean'), ('median'), ('min'), ('max'), ('count')) x(s)
UNION ALL SELECT record_id, 10, 10, 'l_tax', 'mean', 'invalid_window', NULL FROM n
UNION ALL SELECT record_id, n - 5, n + 5, 'l_tax', 'mean', 'outside_record_or_channel', NULL FROM n
UNION ALL SELECT record_id, 0, 10, 'l_weight', 'mean', 'outside_record_or_channel', NULL FROM n""")
def batched_window_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = line_rows(spark, sf)
    n, zero = F.col("end_row"), F.lit(0).cast("bigint")

    def window(a, b):
        return F.struct((zero + a).alias("start_row"), (zero + b).alias("stop_row"))

    scope = W.extents(rows)
    good = (
        scope.select(RECORD, F.inline(F.array(window(0, 100), window(50, 150), window(n - 60, n))))
        .withColumn("channel", F.explode(F.array(*[F.lit(c) for c in LINE_CHANNELS])))
        .withColumn("stat", F.explode(F.array(*[F.lit(s) for s in W.STATS])))
    )
    bad = scope.select(RECORD, F.inline(F.array(
        F.struct((zero + 10).alias("start_row"), (zero + 10).alias("stop_row"), F.lit("l_tax").alias("channel")),
        F.struct((n - 5).alias("start_row"), (n + 5).alias("stop_row"), F.lit("l_tax").alias("channel")),
        F.struct(zero.alias("start_row"), (zero + 10).alias("stop_row"), F.lit("l_weight").alias("channel")),
    ))).withColumn("stat", F.lit("mean"))
    found = W.stat_queries(rows, good.unionByName(bad), LINE_CHANNELS, line_blocks(spark, sf))
    return found.withColumn("value", r6("value"))


@check("window_delta", f"""
WITH {EV}, b AS (SELECT record_id, avg(value) AS m FROM ev WHERE r < 15 GROUP BY 1 HAVING count(*) = 15),
  a AS (SELECT record_id, avg(value) AS m FROM ev WHERE r >= 15 AND r < 30 GROUP BY 1 HAVING count(*) = 15),
  n AS (SELECT DISTINCT record_id FROM ev)
SELECT n.record_id, CASE WHEN a.m IS NULL OR b.m IS NULL THEN 'outside_record_or_channel' ELSE 'ok' END AS status,
  {q6('b.m')} AS before_mean, {q6('a.m')} AS after_mean, {q6('a.m - b.m')} AS value
FROM n LEFT JOIN a USING (record_id) LEFT JOIN b USING (record_id)""")
def window_delta(spark: SparkSession, sf: str) -> DataFrame:
    rows = event_rows(spark, sf)
    pairs = W.extents(rows).select(
        F.col(RECORD).alias("pair_id"), RECORD, F.lit("value").alias("channel"),
        *[F.lit(v).cast("bigint").alias(n) for n, v in
          (("before_start", 0), ("before_stop", 15), ("after_start", 15), ("after_stop", 30))],
    )
    found = W.window_deltas(rows, pairs, ["value"])
    return found.select(RECORD, "status", *[r6(c).alias(c) for c in ("before_mean", "after_mean", "value")])


@check("duplicate_time_count", f"""
WITH {LI}, {LI_WINDOWS} SELECT w.record_id, a AS start_row, b AS stop_row, CAST(count(*) - count(DISTINCT t) AS BIGINT) AS value
FROM w JOIN li ON li.record_id = w.record_id AND r >= a AND r < b GROUP BY 1, 2, 3""")
def duplicate_time_count(spark: SparkSession, sf: str) -> DataFrame:
    rows = line_rows(spark, sf)
    return Q.duplicate_times(rows, line_windows(rows))


QUALITY_SQL = f"""WITH {LI}, {LI_WINDOWS}, p AS (SELECT *, lag(t) OVER (PARTITION BY record_id ORDER BY r) AS pt FROM li),
  j AS (SELECT w.record_id, a, b, r, t, CASE WHEN r > a THEN t - pt END AS step, l_quantity, l_extendedprice, l_discount, l_tax
    FROM w JOIN p ON p.record_id = w.record_id AND r >= a AND r < b),
  c AS (SELECT record_id, a, b, t, count(DISTINCT l_quantity) > 1 AS q, count(DISTINCT l_extendedprice) > 1 AS e,
    count(DISTINCT l_discount) > 1 AS d, count(DISTINCT l_tax) > 1 AS x FROM j GROUP BY 1, 2, 3, 4),
  cc AS (SELECT record_id, a, b, CAST(count(*) FILTER (q OR e OR d OR x) AS BIGINT) AS conflicting_timestamp_groups,
    concat_ws(',', CASE WHEN bool_or(d) THEN 'l_discount' END, CASE WHEN bool_or(e) THEN 'l_extendedprice' END,
      CASE WHEN bool_or(q) THEN 'l_quantity' END, CASE WHEN bool_or(x) THEN 'l_tax' END) AS conflict_channels,
    CAST(bool_or(q)::INT + bool_or(e)::INT + bool_or(d)::INT + bool_or(x)::INT AS BIGINT) AS conflict_channel_count
    FROM c GROUP BY 1, 2, 3),
  qq AS (SELECT record_id, a, b, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) - count(DISTINCT t) AS BIGINT) AS duplicate_extra_rows,
    CAST(count(*) FILTER (step < 0) AS BIGINT) AS time_reversals, CAST(count(*) FILTER (step > 1) AS BIGINT) AS gaps_gt_1s,
    coalesce(max(step), 0.0) AS max_gap_s, arg_max(t, r) - arg_min(t, r) AS elapsed_span_s FROM j GROUP BY 1, 2, 3)"""


@check("quality_profile", f"""{QUALITY_SQL}
SELECT record_id, a AS start_row, b AS stop_row, n_rows, duplicate_extra_rows, conflicting_timestamp_groups,
  conflict_channel_count, conflict_channels, time_reversals, gaps_gt_1s, max_gap_s, elapsed_span_s
FROM qq JOIN cc USING (record_id, a, b)""")
def quality_profile(spark: SparkSession, sf: str) -> DataFrame:
    rows = line_rows(spark, sf)
    found = Q.quality_profile(rows, line_windows(rows), LINE_CHANNELS).withColumnRenamed("rows", "n_rows")
    return found.withColumn("conflict_channels", F.array_join("conflict_channels", ","))


@check("quality_metric_long", f"""{QUALITY_SQL}, u AS (SELECT record_id, a, b, n_rows, duplicate_extra_rows,
    conflicting_timestamp_groups, conflict_channel_count, time_reversals, gaps_gt_1s, max_gap_s, elapsed_span_s
  FROM qq JOIN cc USING (record_id, a, b))
SELECT record_id, a AS start_row, b AS stop_row, metric, unit, CAST(CASE metric WHEN 'rows' THEN n_rows
    WHEN 'duplicate_extra_rows' THEN duplicate_extra_rows WHEN 'conflicting_timestamp_groups' THEN conflicting_timestamp_groups
    WHEN 'conflict_channel_count' THEN conflict_channel_count WHEN 'time_reversals' THEN time_reversals
    WHEN 'gaps_gt_1s' THEN gaps_gt_1s WHEN 'max_gap_s' THEN max_gap_s ELSE elapsed_span_s END AS DOUBLE) AS value
FROM u CROSS JOIN (VALUES ('rows', 'records'), ('duplicate_extra_rows', 'records'), ('conflicting_timestamp_groups', 'timestamp_groups'),
  ('conflict_channel_count', 'channels'), ('time_reversals', 'intervals'), ('gaps_gt_1s', 'intervals'), ('max_gap_s', 's'),
  ('elapsed_span_s', 's')) m(metric, unit)""")
def quality_metric_long(spark: SparkSession, sf: str) -> DataFrame:
    rows = line_rows(spark, sf)
    units = F.create_map(*[F.lit(x) for pair in S.METRIC_UNITS.items() for x in pair])
    long = Q.metric_long(Q.quality_profile(rows, line_windows(rows), LINE_CHANNELS))
    return long.withColumn("unit", F.element_at(units, F.col("metric")))


@check("conflict_examples", f"""
WITH {LI}, g AS (SELECT record_id, t, CAST(count(*) AS BIGINT) AS n_rows, min(r) AS first_row,
    concat_ws(',', CASE WHEN count(DISTINCT l_discount) > 1 THEN 'l_discount' END,
      CASE WHEN count(DISTINCT l_extendedprice) > 1 THEN 'l_extendedprice' END,
      CASE WHEN count(DISTINCT l_quantity) > 1 THEN 'l_quantity' END, CASE WHEN count(DISTINCT l_tax) > 1 THEN 'l_tax' END) AS changed
  FROM li GROUP BY 1, 2),
  k AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY first_row) AS n FROM g WHERE changed <> '')
SELECT record_id, t AS time_s, n_rows, first_row, changed AS changed_channels FROM k WHERE n <= 3""")
def conflict_examples(spark: SparkSession, sf: str) -> DataFrame:
    found = Q.conflict_examples(line_rows(spark, sf), LINE_CHANNELS)
    return found.withColumn("changed_channels", F.array_join("changed_channels", ","))


@check("non_increasing_pairs", f"""
WITH {LI}, p AS (SELECT record_id, r, t, lag(t) OVER (PARTITION BY record_id ORDER BY r) AS pt FROM li)
SELECT record_id, r - 1 AS row_a, r AS row_b FROM p WHERE t <= pt""")
def non_increasing_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return Q.non_increasing_pairs(line_rows(spark, sf))


@check("monotonic_status", f"""
WITH {LI}, {LI_WINDOWS}, p AS (SELECT record_id, r, t - lag(t) OVER (PARTITION BY record_id ORDER BY r) AS d FROM li)
SELECT w.record_id, a AS start_row, b AS stop_row, coalesce(bool_and(d > 0) FILTER (r > a), true) AS strictly_increasing,
  coalesce(bool_and(d >= 0) FILTER (r > a), true) AS non_decreasing
FROM w JOIN p ON p.record_id = w.record_id AND r >= a AND r < b GROUP BY 1, 2, 3""")
def monotonic_status(spark: SparkSession, sf: str) -> DataFrame:
    rows = line_rows(spark, sf)
    return W.monotonic_status(rows, line_windows(rows))


@check("missing_counts", f"""
WITH {EV} SELECT record_id, 'k' AS channel, CAST(count(*) FILTER (nullif(k, 0) IS NULL) AS BIGINT) AS missing FROM ev GROUP BY 1
UNION ALL SELECT record_id, 'value', CAST(count(*) FILTER (value IS NULL) AS BIGINT) FROM ev GROUP BY 1""")
def missing_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = event_rows(spark, sf).select(RECORD, F.nullif("k", F.lit(0)).alias("k"), "value")
    return Q.missing_counts(rows, ["k", "value"])


def _profile_sql(frame: str, name: str, bins: int, channels: list[str]) -> str:
    long = " UNION ALL ".join(f"SELECT record_id, bin, r, t, '{c}' AS channel, {c} AS v FROM e" for c in channels)
    return f"""WITH {frame}, n AS (SELECT record_id, max(r) + 1 AS n, least({bins}, max(r) + 1) AS c FROM {name} GROUP BY 1),
  edge AS (SELECT record_id, i AS bin, n * i // c AS lo, n * (i + 1) // c AS hi FROM n, generate_series(0, {bins} - 1) s(i) WHERE i < c),
  e AS (SELECT edge.record_id, bin, x.* EXCLUDE (record_id) FROM edge JOIN {name} x ON x.record_id = edge.record_id AND r >= lo AND r < hi),
  l AS ({long})
SELECT record_id, bin, min(r) AS bin_start, max(r) + 1 AS bin_stop, CAST(count(*) AS BIGINT) AS n_rows,
  {q6('arg_min(t, r)')} AS first_time_s, {q6('arg_max(t, r)')} AS last_time_s, channel, min(v) AS lowest, max(v) AS highest,
  {q6('avg(v)')} AS mean FROM l GROUP BY record_id, bin, channel"""


def _profile(rows: DataFrame, bins: int, channels: list[str]) -> DataFrame:
    asked = whole_windows(rows).withColumns({"query_id": F.col(RECORD), "bins": F.lit(bins)})
    found = W.profile_bins(rows, asked, channels)
    return found.select(
        RECORD, "bin", "bin_start", "bin_stop", "n_rows", r6("first_time_s").alias("first_time_s"),
        r6("last_time_s").alias("last_time_s"), "channel", F.col("min").alias("lowest"), F.col("max").alias("highest"),
        r6("mean").alias("mean"),
    )


@check("profile_bins", _profile_sql(LI, "li", 16, LINE_CHANNELS))
def profile_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _profile(line_rows(spark, sf), 16, LINE_CHANNELS)


COMPONENTS = [f"e{k}" for k in range(64)]


@check("profile_bins_embeddings", _profile_sql(EM, "em", 8, COMPONENTS))
def profile_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return _profile(embedding_rows(spark, sf), 8, COMPONENTS)


@check("longest_zero_run", f"""
WITH {LI}, z AS (SELECT record_id, r, t, r - row_number() OVER (PARTITION BY record_id ORDER BY r) AS g FROM li WHERE l_tax = 0),
  runs AS (SELECT record_id, min(r) AS a, max(r) + 1 AS b, arg_min(t, r) AS ta FROM z GROUP BY record_id, g),
  k AS (SELECT record_id, arg_max(struct_pack(a, b, ta), (b - a) * 1000000000 - a) AS x FROM runs GROUP BY 1),
  f AS (SELECT record_id, arg_min(t, r) AS t0 FROM li GROUP BY 1)
SELECT f.record_id, coalesce(x.b - x.a, 0) AS value, x.a AS run_start, x.b AS run_stop, x.ta - t0 AS run_start_offset_s
FROM f LEFT JOIN k USING (record_id)""")
def longest_zero_run(spark: SparkSession, sf: str) -> DataFrame:
    rows = line_rows(spark, sf)
    asked = whole_windows(rows).withColumns({"query_id": F.col(RECORD), "channels": F.array(F.lit("l_tax"))})
    return W.longest_zero_run(rows, asked, LINE_CHANNELS).select(
        RECORD, "value", "run_start", "run_stop", "run_start_offset_s"
    )


@check("mask_runs", f"""
WITH {EV}, h AS (SELECT record_id, r, r - row_number() OVER (PARTITION BY record_id ORDER BY r) AS g FROM ev WHERE value > 40)
SELECT record_id, min(r) AS start_row, max(r) + 1 AS stop_row FROM h GROUP BY record_id, g""")
def runs_of_mask(spark: SparkSession, sf: str) -> DataFrame:
    return mask_runs(event_rows(spark, sf).filter(F.col("value") > 40))


@check("dual_check_sustained", f"""
WITH {SUSTAINED} SELECT f.record_id, onset_row AS by_runs, onset_row AS by_rolling, true AS agree FROM f LEFT JOIN o USING (record_id)""")
def dual_check_sustained(spark: SparkSession, sf: str) -> DataFrame:
    """Two independent routes to the onset: stitched runs, and a rolling count over the next rows."""
    rows = event_rows(spark, sf)
    by_runs = W.first_sustained(rows, sustained_queries(rows), ["value"]).select(RECORD, F.col("onset_row").alias("by_runs"))
    full = F.count_if(F.col("value") > 40).over(ordered().rowsBetween(0, 2)) == 3
    rolling = (
        with_halo(rows.select(RECORD, "row", "value"), 0, 2).withColumn("_full", full).filter(at_home() & F.col("_full"))
        .groupBy(RECORD).agg(F.min("row").alias("by_rolling"))
    )
    return by_runs.join(rolling, RECORD, "left").withColumn("agree", F.col("by_runs").eqNullSafe(F.col("by_rolling")))
