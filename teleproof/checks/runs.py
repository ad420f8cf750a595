"""Queries: the execution audit of agent runs and its reports, over conversations read as run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from teleproof.checks.registry import check
from teleproof.operators import runaudit as A
from teleproof.sources.tables import table

LIMITS = A.Limits(model="m", url="u", max_requests=4, max_calls=6, context_window=2_600, reserved_reports=1, exact_tokens=False)


def frames(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """User turns as requests, assistant turns as responses that each call a tool; text lengths and ids decide what is wrong with them."""
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("run_id"), "turn", "role", F.length("text").alias("n"))
    run, n, turn = F.col("run_id"), F.col("n"), F.col("turn")
    asked = turns.filter(F.col("role") == "user").withColumn("index", F.expr("turn div 2 + 1"))
    told = turns.filter(F.col("role") == "assistant").withColumn("index", F.expr("(turn - 1) div 2 + 1"))
    both = F.array(F.lit(A.REPORT), F.lit(A.QUERY))
    requests = asked.select(
        "run_id", "index", F.lit("u").alias("url"), F.when(n % 19 == 0, "x").otherwise("m").alias("model"), (run % 8 != 0).alias("thinking_off"), F.lit(2_000).alias("max_tokens"),
        n.alias("prompt_tokens"), F.when(turn >= 4, "reporting").otherwise("investigation").alias("phase"),
        (F.col("index") + F.when(run % 6 == 0, 1).otherwise(0)).alias("notice_request"), F.lit(4).alias("notice_maximum"), (5 - F.col("index")).alias("notice_left"),
        F.when((turn >= 4) & (run % 2 == 0), F.array(F.lit(A.REPORT))).otherwise(both).alias("tool_names"),
    )
    responses = told.select(
        "run_id", "index", F.when(n % 23 == 0, 500).otherwise(200).alias("http_status"), F.array(F.lit("m")).alias("models"), (n % 29 == 0).alias("reasoning_seen"),
        F.expr("n div 2").alias("prompt_tokens"), n.alias("completion_tokens"),
    )
    call = F.concat(F.lit("c"), turn.cast("string")).alias("call_id")
    error = F.when(n % 31 == 0, A.DENIAL + ".").when(n % 3 == 0, "failed")
    last = turns.groupBy("run_id").agg(
        F.max_by("role", "turn").alias("last"), F.min_by("role", "turn").alias("first"), F.count_if(F.col("role") == "user").alias("asked"), F.count(F.lit(1)).alias("n")
    )
    done = F.col("last") == "assistant"
    runs = last.select(
        "run_id", (run % 3).alias("job_id"), F.when(done, "submitted").otherwise("stopped").alias("status"), (done & (run % 10 != 0)).alias("answered"),
        (F.col("asked") + F.when(run % 7 == 0, 1).otherwise(0)).alias("api_requests"), n.alias("tool_attempts"), (run % 9 != 0).alias("same_session"),
        (run % 11 == 0).alias("private_exposed"), F.lit(0).alias("n_context_files"), F.when(run % 12 == 0, 1).otherwise(0).alias("n_skills"), F.lit(0).alias("n_extensions"),
        F.when(run % 13 == 0, F.array(F.lit(A.QUERY))).otherwise(both).alias("active_tools"), F.array("first").alias("first_roles"),
    )
    return {
        "runs": runs, "requests": requests, "responses": responses, "emitted": told.select("run_id", call),
        "results": told.filter(n % 5 != 0).select("run_id", call, (n % 3 == 0).alias("is_error")), "calls": told.select("run_id", call, error.alias("error")),
        "observations": told.select("run_id", (n % 50).alias("observation_id")),
        "decisions": last.filter(run % 4 < 2).select("run_id", F.when(run % 4 == 0, "accept").otherwise("revise").alias("decision")),
    }


LOGS = """tn AS (SELECT conv_id AS run_id, turn, role, length(text) AS n FROM conversations),
  rq AS (SELECT *, turn // 2 + 1 AS i, CASE WHEN turn >= 4 THEN 'reporting' ELSE 'investigation' END AS phase FROM tn WHERE role = 'user'),
  rs AS (SELECT *, (turn - 1) // 2 + 1 AS i FROM tn WHERE role = 'assistant'),
  ru AS (SELECT run_id, run_id % 3 AS job_id, arg_max(role, turn) = 'assistant' AS done, arg_min(role, turn) AS first, count(*) FILTER (role = 'user') AS asked, count(*) AS n FROM tn GROUP BY 1)"""
AUDIT = f"""{LOGS}, ix AS (SELECT run_id, count(*) AS n, count(DISTINCT i) AS d, min(i) AS lo, max(i) AS hi FROM rq GROUP BY 1),
  un AS (SELECT DISTINCT run_id FROM (SELECT run_id, i FROM rq EXCEPT SELECT run_id, i FROM rs UNION ALL (SELECT run_id, i FROM rs EXCEPT SELECT run_id, i FROM rq))),
  lost AS (SELECT DISTINCT run_id FROM rs WHERE n % 5 = 0), den AS (SELECT DISTINCT run_id FROM rs WHERE n % 31 = 0),
  rp AS (SELECT rq.*, max(CASE WHEN phase = 'reporting' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY i RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rep FROM rq),
  rr AS (SELECT rp.*, rs.n AS got FROM rp LEFT JOIN rs ON rs.run_id = rp.run_id AND rs.i = rp.i),
  ck AS (SELECT run_id, 'request_budget' AS c, NULL AS item, coalesce(ix.n, 0) = asked + CASE WHEN run_id % 7 = 0 THEN 1 ELSE 0 END AND coalesce(ix.n, 0) <= 4 AS ok FROM ru LEFT JOIN ix USING (run_id)
  UNION ALL SELECT run_id, 'request_sequence', NULL, ix.n IS NULL OR (lo = 1 AND hi = ix.n AND d = ix.n) FROM ru LEFT JOIN ix USING (run_id)
  UNION ALL SELECT run_id, 'all_responses_logged', NULL, run_id NOT IN (SELECT run_id FROM un) FROM ru
  UNION ALL SELECT run_id, 'no_private_context', NULL, run_id % 11 <> 0 AND run_id % 12 <> 0 FROM ru
  UNION ALL SELECT run_id, 'only_allowed_tools', NULL, run_id % 13 <> 0 FROM ru
  UNION ALL SELECT run_id, 'empty_prior_conversation', NULL, first = 'system' FROM ru
  UNION ALL SELECT run_id, 'submission_state_matches', NULL, NOT done OR run_id % 10 <> 0 FROM ru
  UNION ALL SELECT run_id, 'query_budget', NULL, n <= 6 FROM ru UNION ALL SELECT run_id, 'same_session_reporting', NULL, run_id % 9 <> 0 FROM ru
  UNION ALL SELECT run_id, 'all_tool_events_logged', NULL, run_id NOT IN (SELECT run_id FROM lost) FROM ru
  UNION ALL SELECT run_id, 'no_premature_query_denial', NULL, run_id NOT IN (SELECT run_id FROM den) FROM ru
  UNION ALL SELECT run_id, 'provider_no_thinking', CAST(i AS VARCHAR), n % 19 <> 0 AND run_id % 8 <> 0 FROM rr
  UNION ALL SELECT run_id, 'real_model', CAST(i AS VARCHAR), coalesce(got % 23 <> 0 AND got % 29 <> 0, false) FROM rr
  UNION ALL SELECT run_id, 'budget_notice', CAST(i AS VARCHAR), run_id % 6 <> 0 AND i <= 4 FROM rr UNION ALL SELECT run_id, 'context', CAST(i AS VARCHAR), n + 2000 <= 2600 FROM rr
  UNION ALL SELECT run_id, 'context_count_consistency', CAST(i AS VARCHAR), coalesce(n >= got // 2, false) FROM rr
  UNION ALL SELECT run_id, 'report_phase_tools', CAST(i AS VARCHAR), rep = 0 OR (phase = 'reporting' AND run_id % 2 = 0) FROM rr
  UNION ALL SELECT run_id, 'reserved_tail', CAST(i AS VARCHAR), i <= 3 OR phase = 'reporting' FROM rr
  UNION ALL SELECT run_id, 'tool_error_flag', 'c' || turn, n % 5 <> 0 AND (n % 31 = 0 OR n % 3 = 0) = (n % 3 = 0) FROM rs)"""


@check("execution_audit", f'WITH {AUDIT} SELECT run_id, c AS "check", item, ok AS passed FROM ck')
def execution_audit(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf)
    return A.execution_audit(f["runs"], f["requests"], f["responses"], f["emitted"], f["results"], f["calls"], LIMITS)


@check("execution_failures", f'WITH {AUDIT} SELECT run_id, c AS "check", item FROM ck WHERE NOT ok')
def execution_failures(spark: SparkSession, sf: str) -> DataFrame:
    return A.failed_checks(execution_audit(spark, sf))


REPORT = f"""{LOGS}, rep AS (SELECT run_id, job_id, CASE WHEN done THEN 'submitted' ELSE 'stopped' END AS status, CAST(n AS BIGINT) AS queries,
    CAST(coalesce((SELECT count(*) FROM rq WHERE rq.run_id = ru.run_id), 0) AS BIGINT) AS requests, CAST(coalesce((SELECT max(n) FROM rq WHERE rq.run_id = ru.run_id), 0) AS BIGINT) AS max_prompt_tokens,
    CAST(coalesce((SELECT sum(n // 2) FROM rs WHERE rs.run_id = ru.run_id), 0) AS BIGINT) AS input_tokens, CAST(coalesce((SELECT sum(n) FROM rs WHERE rs.run_id = ru.run_id), 0) AS BIGINT) AS output_tokens,
    CAST((SELECT count(*) FROM rs WHERE rs.run_id = ru.run_id AND (n % 31 = 0 OR n % 3 = 0)) AS BIGINT) AS backend_errors,
    CAST((SELECT count(*) FROM rs WHERE rs.run_id = ru.run_id AND n % 5 <> 0) AS BIGINT) AS tool_events,
    CAST((SELECT count(*) FROM rs WHERE rs.run_id = ru.run_id AND n % 5 <> 0 AND n % 3 = 0) AS BIGINT) AS tool_errors,
    CAST((SELECT count(*) FROM rs WHERE rs.run_id = ru.run_id) AS BIGINT) AS observations,
    CAST((SELECT count(DISTINCT n % 50) FROM rs WHERE rs.run_id = ru.run_id) AS BIGINT) AS distinct_observations,
    CASE run_id % 4 WHEN 0 THEN 'accept' WHEN 1 THEN 'revise' ELSE 'pending' END AS decision FROM ru)"""


def report(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf)
    return A.run_report(f["runs"], f["requests"], f["responses"], f["calls"], f["results"], f["observations"], f["decisions"])


@check("run_report", f"WITH {REPORT} SELECT * FROM rep")
def run_report(spark: SparkSession, sf: str) -> DataFrame:
    return report(spark, sf)


@check("job_report", f"""WITH {REPORT} SELECT job_id, CAST(count(*) AS BIGINT) AS runs, CAST(count(*) FILTER (requests > 0) AS BIGINT) AS attempted,
  CAST(count(*) FILTER (status = 'submitted') AS BIGINT) AS submitted, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(queries) AS BIGINT) AS queries,
  CAST(sum(observations) AS BIGINT) AS observations, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  max(max_prompt_tokens) AS max_prompt_tokens FROM rep GROUP BY 1""")
def job_report(spark: SparkSession, sf: str) -> DataFrame:
    return A.job_report(report(spark, sf))


@check("decision_histogram", f"WITH {REPORT} SELECT job_id, decision, CAST(count(*) AS BIGINT) AS runs FROM rep GROUP BY 1, 2")
def decision_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return A.decision_histogram(report(spark, sf))
