"""Audits of agent run logs: ``run_id, seq`` ordered turns with a ``role`` and a text or token count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from teleproof.operators.blocks import RECORD, neighbours, running


def turn_neighbours(turns: DataFrame) -> DataFrame:
    """Turns (``record_id, row, role``) with the role of the next turn."""
    return neighbours(turns, {"next_role": ("role", 1)})


def unanswered(turns: DataFrame, asking: str = "user", answering: str = "assistant") -> DataFrame:
    """Asking turns that no answering turn follows at once."""
    step = turn_neighbours(turns.select(RECORD, "row", "role"))
    missing = F.coalesce(F.col("next_role"), F.lit("")) != answering
    return step.filter((F.col("role") == asking) & missing).select(RECORD, "row", "next_role")


def unanswered_calls(emitted: DataFrame, executed: DataFrame, key: str) -> DataFrame:
    """Calls without a logged execution, and executions nobody asked for."""
    a = emitted.select(key, F.lit(True).alias("_a")).distinct()
    b = executed.select(key, F.lit(True).alias("_b")).distinct()
    issue = F.when(F.col("_b").isNull(), "not_executed").when(F.col("_a").isNull(), "not_emitted")
    return a.join(b, key, "full_outer").withColumn("issue", issue).filter(F.col("issue").isNotNull()).select(key, "issue")


def request_response(requests: DataFrame, responses: DataFrame, limit: int) -> DataFrame:
    """Requests (``run_id, seq, tokens``) with their responses and one boolean per check."""
    r = responses.select("run_id", "seq", F.col("tokens").alias("answer_tokens"))
    return requests.join(r, ["run_id", "seq"], "left").withColumns({
        "answered": F.col("answer_tokens").isNotNull(),
        "within_context": F.coalesce(F.col("tokens") + F.coalesce("answer_tokens", F.lit(0)) <= limit, F.lit(False)),
    })


def contiguity(turns: DataFrame) -> DataFrame:
    """Sequence numbers of a run must be 0..n-1, each once."""
    per_seq = turns.groupBy("run_id", "seq").agg(F.count(F.lit(1)).alias("_n"))
    return per_seq.groupBy("run_id").agg(
        F.sum("_n").alias("turns"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"),
        ((F.sum("_n") == F.max("seq") + 1) & (F.min("seq") == 0) & (F.count(F.lit(1)) == F.sum("_n"))).alias("contiguous"),
    )


def phase_latch(turns: DataFrame, latch_role: str, banned_role: str) -> DataFrame:
    """Once a ``latch_role`` turn was seen the phase stays; ``banned_role`` turns inside it are violations."""
    seen = running(turns.select(RECORD, "row", "role"), [RECORD], F.when(F.col("role") == latch_role, 1).otherwise(0), "_seen", "max")
    latched = F.col("_seen") == 1
    return seen.select(RECORD, "row", "role", latched.alias("latched"), (~latched | (F.col("role") != banned_role)).alias("allowed"))


def run_checks(turns: DataFrame, responses_due: DataFrame, latch: DataFrame, budget: int) -> DataFrame:
    """All execution checks as ``run_id, check, passed``."""
    per_run = contiguity(turns)
    checks = per_run.select("run_id", F.inline(F.array(
        F.struct(F.lit("sequence").alias("check"), F.col("contiguous").alias("passed")),
        F.struct(F.lit("turn_budget").alias("check"), (F.col("turns") <= budget).alias("passed")),
    )))
    answered = responses_due.select("run_id", F.lit("answered").alias("check"), F.col("answered").alias("passed"))
    context = responses_due.select("run_id", F.lit("context").alias("check"), F.col("within_context").alias("passed"))
    phase = latch.select(F.col(RECORD).alias("run_id"), F.lit("phase").alias("check"), F.col("allowed").alias("passed"))
    return checks.unionByName(answered).unionByName(context).unionByName(phase)


def audit_totals(checks: DataFrame) -> DataFrame:
    return checks.groupBy("check").agg(
        F.count(F.lit(1)).alias("checks"), F.count_if(~F.col("passed")).alias("failed"), F.bool_and("passed").alias("all_passed")
    )


def run_summary(turns: DataFrame) -> DataFrame:
    """Requests, answers and token sums per run; a run is submitted if its last turn answers."""
    return turns.groupBy("run_id").agg(
        F.count_if(F.col("role") == "user").alias("requests"), F.count_if(F.col("role") == "assistant").alias("responses"),
        F.coalesce(F.sum(F.when(F.col("role") == "user", F.col("tokens"))), F.lit(0).cast("bigint")).alias("input_tokens"),
        F.coalesce(F.sum(F.when(F.col("role") == "assistant", F.col("tokens"))), F.lit(0).cast("bigint")).alias("output_tokens"),
        (F.max_by("role", "seq") == "assistant").alias("submitted"),
    )


def unfinished(summary: DataFrame) -> DataFrame:
    """Runs without an answer; they feed the follow-up stage."""
    return summary.filter(~F.col("submitted"))


def job_summary(summary: DataFrame) -> DataFrame:
    """Totals over the runs by outcome."""
    return summary.groupBy("submitted").agg(
        F.count(F.lit(1)).alias("runs"), *[F.sum(c).alias(c) for c in ("requests", "responses", "input_tokens", "output_tokens")]
    )
