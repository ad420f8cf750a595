"""Queries: tool requests inside the scopes of their tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from teleproof.checks.registry import LI, check, q6, r6
from teleproof.operators import scoped as S
from teleproof.operators.blocks import RECORD
from teleproof.operators.windows import extents
from teleproof.sources.tables import LINE_CHANNELS, line_blocks, line_rows

TYPES = {
    "seq": "int", "tool": "string", **{c: "bigint" for r in S.RANGES for c in r}, "channels": "array<string>", "channel": "string", "stat": "string", "threshold": "double",
    "direction": "string",
}
REQUESTS = [
    dict(seq=1, tool="inspect_channels"), dict(seq=2, tool="read_window", start_row=120, stop_row=130, channels=["l_tax"]),
    dict(seq=3, tool="summarize_window", start_row=100, stop_row=200, channel="l_tax", stat="median"),
    dict(seq=4, tool="compare_windows", before_start=100, before_stop=200, after_start=200, after_stop=300, channel="l_quantity"),
    dict(seq=5, tool="first_crossing", start_row=100, stop_row=102, channel="l_quantity", threshold=25.0, direction="above"),
    dict(seq=6, tool="check_time_axis", start_row=100, stop_row=140), dict(seq=7, tool="read_window", start_row=100, stop_row=320, channels=["l_tax"]),
    dict(seq=8, tool="summarize_window", start_row=90, stop_row=200, channel="l_tax", stat="mean"),
    dict(seq=9, tool="summarize_window", start_row=100, stop_row=200, channel="l_discount", stat="mean"),
    dict(seq=10, tool="summarize_window", start_row=200, stop_row=200, channel="l_tax", stat="mean"), dict(seq=11, tool="check_time_axis", start_row=100, stop_row=140, stat="mean"),
    dict(seq=12, tool="shell"), dict(seq=13, tool="submit_report"), dict(seq=14, tool="inspect_channels"),
]


def scoped(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One task per supplier with at least 400 lines, about rows 100 to 350 and two channels; and one request of a task nobody knows."""
    rows = line_rows(spark, sf)
    both, tools = F.array(F.lit("l_quantity"), F.lit("l_tax")), F.array(*[F.lit(t) for t in S.ARGUMENTS])
    tasks = extents(rows).filter(F.col("end_row") >= 400).select(
        F.concat(F.lit("t"), F.col(RECORD).cast("string")).alias("task_id"), RECORD, F.lit(100).cast("bigint").alias("first_row"), F.lit(350).cast("bigint").alias("end_row"),
        both.alias("channels"), tools.alias("tools"),
    )
    made = []
    for r in REQUESTS:
        values = {c: F.array(*[F.lit(x) for x in r[c]]) if isinstance(r.get(c), list) else F.lit(r.get(c)) for c in TYPES}
        made.append(F.struct(*[values[c].cast(kind).alias(c) for c, kind in TYPES.items()]))
    asked = tasks.select("task_id", F.inline(F.array(*made)))
    asked = asked.unionByName(asked.filter(F.col("seq") == 1).limit(1).withColumn("task_id", F.lit("nobody")))
    asked = asked.withColumn("request_id", F.concat_ws("|", "task_id", F.col("seq").cast("string")))
    return S.answer_tools(rows, asked, tasks, LINE_CHANNELS, line_blocks(spark, sf))


BIG = f"{LI}, n AS (SELECT record_id, 't' || record_id AS task_id FROM li GROUP BY 1 HAVING count(*) >= 400), x AS (SELECT li.*, task_id, lag(t) OVER (PARTITION BY li.record_id ORDER BY r) AS pt FROM li JOIN n USING (record_id))"


@check("scoped_tools", f"""
WITH {BIG}, a AS (SELECT task_id, 1 AS seq, 'inspect_channels' AS tool, 'ok' AS status, 2.0::DOUBLE AS value FROM n
  UNION ALL SELECT task_id, 2, 'read_window', 'ok', 10 FROM n
  UNION ALL SELECT task_id, 3, 'summarize_window', 'ok', median(l_tax) FROM x WHERE r BETWEEN 100 AND 199 GROUP BY 1
  UNION ALL SELECT task_id, 4, 'compare_windows', 'ok', avg(l_quantity) FILTER (r >= 200) - avg(l_quantity) FILTER (r < 200) FROM x WHERE r BETWEEN 100 AND 299 GROUP BY 1
  UNION ALL SELECT task_id, 5, 'first_crossing', CASE WHEN bool_or(r = 101 AND t <= pt) THEN 'time_not_strictly_increasing' WHEN max(l_quantity) < 25 THEN 'not_reached' ELSE 'ok' END,
    CASE WHEN bool_or(r = 101 AND t <= pt) THEN NULL ELSE min(t) FILTER (l_quantity >= 25) - min(t) FILTER (r = 100) END FROM x WHERE r IN (100, 101) GROUP BY 1
  UNION ALL SELECT task_id, 6, 'check_time_axis', 'ok', count(*) - count(DISTINCT t) FROM x WHERE r BETWEEN 100 AND 139 GROUP BY 1
  UNION ALL SELECT task_id, 7, 'read_window', 'size_cap', NULL FROM n UNION ALL SELECT task_id, 8, 'summarize_window', 'window_outside_scope', NULL FROM n
  UNION ALL SELECT task_id, 9, 'summarize_window', 'channel_outside_scope', NULL FROM n UNION ALL SELECT task_id, 10, 'summarize_window', 'invalid_window', NULL FROM n
  UNION ALL SELECT task_id, 11, 'check_time_axis', 'unexpected_or_missing_arguments', NULL FROM n UNION ALL SELECT task_id, 12, 'shell', 'tool_not_allowed', NULL FROM n
  UNION ALL SELECT task_id, 13, 'submit_report', 'ok', NULL FROM n UNION ALL SELECT task_id, 14, 'inspect_channels', 'task_submitted', NULL FROM n
  UNION ALL (SELECT 'nobody', 1, 'inspect_channels', 'unknown_task', NULL FROM n LIMIT 1))
SELECT task_id || '|' || seq AS request_id, task_id, tool, status, {q6('value')} AS value FROM a""")
def scoped_tools(spark: SparkSession, sf: str) -> DataFrame:
    return scoped(spark, sf)[0].withColumn("value", r6("value"))


@check("scoped_rows", f"""WITH {BIG} SELECT task_id || '|2' AS request_id, r AS "row", t - (SELECT y.t FROM x y WHERE y.record_id = x.record_id AND y.r = 100) AS time_offset, 'l_tax' AS channel,
  l_tax AS reading FROM x WHERE r BETWEEN 120 AND 129""")
def scoped_rows(spark: SparkSession, sf: str) -> DataFrame:
    return scoped(spark, sf)[1]


@check("scoped_time_axis", f"WITH {BIG} SELECT task_id || '|6' AS request_id, r - 1 AS row_a, r AS row_b FROM x WHERE r BETWEEN 101 AND 139 AND t <= pt")
def scoped_time_axis(spark: SparkSession, sf: str) -> DataFrame:
    return scoped(spark, sf)[2]
