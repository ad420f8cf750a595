"""Execution audit of agent runs: what was asked, answered and called, against the limits a run was given.

Frames, one row each: ``runs`` (run_id, status, answered, api_requests, tool_attempts, same_session, private_exposed, n_context_files, n_skills,
n_extensions, active_tools, first_roles), ``requests`` (run_id, index, url, model, thinking_off, max_tokens, prompt_tokens, phase, notice_request,
notice_maximum, notice_left, tool_names), ``responses`` (run_id, index, http_status, models, reasoning_seen, prompt_tokens), ``emitted`` (run_id,
call_id), ``results`` (run_id, call_id, is_error) and ``calls`` (run_id, call_id, error). It judges the course of a run, not its conclusions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from teleproof.operators.blocks import running

REPORT, QUERY = "submit_report", "telemetry_query"
# Fixed value: how the answer to a query after the end of an investigation begins.
DENIAL = "Investigation budget ended"


@dataclass(frozen=True)
class Limits:
    """What a batch of runs was allowed."""

    model: str
    url: str
    max_requests: int
    max_calls: int
    context_window: int
    reserved_reports: int
    exact_tokens: bool = True
    tools: Sequence[str] = field(default_factory=lambda: [REPORT, QUERY])


def _is(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _named(df: DataFrame, checks: dict[str, Column], index: Column | None = None) -> DataFrame:
    at = F.lit(None).cast("string") if index is None else index.cast("string")
    parts = F.array(*[F.struct(F.lit(name).alias("check"), at.alias("item"), _is(passed).alias("passed")) for name, passed in checks.items()])
    return df.select("run_id", F.inline(parts))


def run_level(runs: DataFrame, requests: DataFrame, responses: DataFrame, emitted: DataFrame, results: DataFrame, calls: DataFrame, limits: Limits) -> DataFrame:
    """The checks a run passes as a whole."""
    asked = requests.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count_distinct("index").alias("_distinct"), F.min("index").alias("_low"), F.max("index").alias("_high")
    )

    def one_sided(left: DataFrame, right: DataFrame, key: str, name: str) -> DataFrame:
        a = left.select("run_id", key).distinct().withColumn("_a", F.lit(True))
        b = right.select("run_id", key).distinct().withColumn("_b", F.lit(True))
        lost = a.join(b, ["run_id", key], "full_outer").filter(F.col("_a").isNull() | F.col("_b").isNull())
        return lost.select("run_id").distinct().withColumn(name, F.lit(True))

    denied = calls.filter(F.col("error").startswith(DENIAL)).select("run_id").distinct().withColumn("_denied", F.lit(True))
    whole = (
        runs.join(asked, "run_id", "left").join(one_sided(requests, responses, "index", "_unlogged"), "run_id", "left")
        .join(one_sided(emitted, results, "call_id", "_unresolved"), "run_id", "left").join(denied, "run_id", "left")
    )
    n = F.coalesce("_n", F.lit(0))
    return _named(whole, {
        "request_budget": (n == F.col("api_requests")) & (n <= limits.max_requests),
        "request_sequence": (n == 0) | ((F.col("_low") == 1) & (F.col("_high") == n) & (F.col("_distinct") == n)),
        "all_responses_logged": F.col("_unlogged").isNull(),
        "no_private_context": ~F.col("private_exposed") & (F.col("n_context_files") + F.col("n_skills") + F.col("n_extensions") == 0),
        "only_allowed_tools": F.array_sort("active_tools") == F.array(*[F.lit(t) for t in sorted(limits.tools)]),
        "empty_prior_conversation": ~F.exists("first_roles", lambda r: r != "system"),
        "submission_state_matches": (F.col("status") == "submitted") == F.col("answered"),
        "query_budget": F.col("tool_attempts") <= limits.max_calls,
        "same_session_reporting": F.col("same_session"),
        "all_tool_events_logged": F.col("_unresolved").isNull(),
        "no_premature_query_denial": F.col("_denied").isNull(),
    })


def request_level(requests: DataFrame, responses: DataFrame, limits: Limits) -> DataFrame:
    """The checks of every request with its response; once a run reports, it stays at reporting."""
    answers = responses.select(
        "run_id", "index", "http_status", "models", "reasoning_seen", F.col("prompt_tokens").alias("_used")
    )
    phased = running(requests.withColumn("row", F.col("index")), ["run_id"], F.when(F.col("phase") == "reporting", 1).otherwise(0), "_reporting", "max").drop("row")
    both = phased.join(answers, ["run_id", "index"], "left")
    reporting = F.col("phase") == "reporting"
    preflight, used = F.col("prompt_tokens"), F.col("_used")
    return _named(both, {
        "provider_no_thinking": (F.col("url") == limits.url) & F.col("thinking_off") & (F.col("model") == limits.model),
        "real_model": (F.col("http_status") == 200) & (F.col("models") == F.array(F.lit(limits.model))) & ~F.coalesce("reasoning_seen", F.lit(False)),
        "budget_notice": (F.col("notice_request") == F.col("index")) & (F.col("notice_maximum") == limits.max_requests) & (F.col("notice_left") >= 1),
        "context": preflight + F.col("max_tokens") <= limits.context_window,
        "context_count_consistency": (preflight == used) if limits.exact_tokens else (preflight >= used),
        "report_phase_tools": (F.col("_reporting") == 0) | (reporting & (F.col("tool_names") == F.array(F.lit(REPORT)))),
        "reserved_tail": (F.col("index") <= limits.max_requests - limits.reserved_reports) | reporting,
    }, F.col("index"))


def call_level(calls: DataFrame, results: DataFrame) -> DataFrame:
    """A call that failed must be marked so in its result, and no other."""
    marked = results.select("run_id", "call_id", "is_error")
    both = calls.join(marked, ["run_id", "call_id"], "left")
    failed = F.coalesce(F.length("error") > 0, F.lit(False))
    return _named(both, {"tool_error_flag": failed == F.col("is_error")}, F.col("call_id"))


def execution_audit(runs: DataFrame, requests: DataFrame, responses: DataFrame, emitted: DataFrame, results: DataFrame, calls: DataFrame, limits: Limits) -> DataFrame:
    """All checks as ``run_id, check, item, passed``; ``item`` is the request index or the call."""
    out = run_level(runs, requests, responses, emitted, results, calls, limits)
    return out.unionByName(request_level(requests, responses, limits)).unionByName(call_level(calls, results))


def failed_checks(checks: DataFrame) -> DataFrame:
    return checks.filter(~F.col("passed")).drop("passed")


def run_report(runs: DataFrame, requests: DataFrame, responses: DataFrame, calls: DataFrame, results: DataFrame, observations: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row per run: counts, token sums, errors on either side, the largest prompt and the review's decision.

    ``observations`` has run_id, observation_id, ``decisions`` run_id, decision; a run without a decision is pending.
    """
    count = lambda df, name, what=F.count(F.lit(1)): df.groupBy("run_id").agg(what.alias(name))
    asked = requests.groupBy("run_id").agg(F.count(F.lit(1)).alias("requests"), F.max("prompt_tokens").alias("max_prompt_tokens"))
    used = responses.groupBy("run_id").agg(F.sum("prompt_tokens").alias("input_tokens"), F.sum("completion_tokens").alias("output_tokens"))
    parts = [
        asked, used, count(calls, "backend_errors", F.count_if(F.length("error") > 0)), count(results, "tool_events"),
        count(results, "tool_errors", F.count_if("is_error")), count(observations, "observations"), count(observations, "distinct_observations", F.count_distinct("observation_id")),
    ]
    out = runs.select("run_id", "job_id", "status", F.col("tool_attempts").alias("queries"))
    for part in parts:
        out = out.join(part, "run_id", "left")
    numbers = [c for c in out.columns if c not in ("run_id", "job_id", "status", "queries")]
    zero = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in numbers}
    return out.withColumns(zero).join(decisions, "run_id", "left").withColumn("decision", F.coalesce("decision", F.lit("pending")))


def job_report(report: DataFrame) -> DataFrame:
    """Totals of each job: runs, attempts (runs with a request), submissions and sums."""
    sums = ["requests", "queries", "observations", "input_tokens", "output_tokens"]
    return report.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("requests") > 0).alias("attempted"), F.count_if(F.col("status") == "submitted").alias("submitted"),
        *[F.sum(c).alias(c) for c in sums], F.max("max_prompt_tokens").alias("max_prompt_tokens"),
    )


def decision_histogram(report: DataFrame) -> DataFrame:
    return report.groupBy("job_id", "decision").agg(F.count(F.lit(1)).alias("runs"))
