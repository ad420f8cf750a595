"""Gates over catalogs: alignment, lineage, coverage, references, manifests and record rules.

Every gate reports all violations as rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from teleproof.functions.scalar import IDENTIFIER, extension_of
from teleproof.operators.blocks import RECORD
from teleproof.sources.workspace import written


def positional_join(telemetry: DataFrame, context: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Join two tables row by row on ``(record_id, row)``; the times must agree too.

    Time alone is never a key: repeated times would fan out. Returns the aligned rows and the violations.
    """
    both = telemetry.withColumn("_t", F.lit(True)).join(
        context.withColumnRenamed("time_s", "_time").withColumn("_c", F.lit(True)), [RECORD, "row"], "full_outer"
    )
    issue = (
        F.when(F.col("_c").isNull(), "missing_context").when(F.col("_t").isNull(), "missing_telemetry")
        .when(~F.col("time_s").eqNullSafe(F.col("_time")), "time_differs")
    )
    judged = both.withColumn("issue", issue)
    aligned = judged.filter(F.col("issue").isNull()).drop("issue", "_t", "_c", "_time")
    return aligned, judged.filter(F.col("issue").isNotNull()).select(RECORD, "row", "issue")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def lineage_conflicts(sources: DataFrame) -> DataFrame:
    """Violations among ``source_id, lineage_group, split, sha256``.

    A group may lie in one split only, equal bytes must share group and split, ids are unique.
    """
    # Distinct combinations first, so a group of copies shrinks to its few combinations before it meets.
    combos = written(sources.select("lineage_group", "split", "sha256").distinct(), "lineage")
    groups = combos.select("lineage_group", "split").distinct().groupBy(F.col("lineage_group").alias("key")).agg(
        F.count(F.lit(1)).alias("n")
    )
    bytes_ = combos.groupBy(F.col("sha256").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    ids = sources.groupBy(F.col("source_id").cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    parts = [(groups, "group_in_several_splits"), (bytes_, "same_bytes_different_lineage"), (ids, "duplicate_id")]
    out = None
    for part, name in parts:
        found = part.filter(F.col("n") > 1).select(F.lit(name).alias("violation"), "key", "n")
        out = found if out is None else out.unionByName(found)
    return out


def coverage(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both sides must hold every key exactly once: counts per key and a status."""
    a = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_left"))
    b = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_right"))
    zero = F.lit(0).cast("bigint")
    status = (
        F.when(F.col("n_left") == 0, "extra").when(F.col("n_right") == 0, "missing")
        .when((F.col("n_left") > 1) | (F.col("n_right") > 1), "repeated").otherwise("ok")
    )
    return (
        a.join(b, list(keys), "full_outer")
        .withColumns({"n_left": F.coalesce("n_left", zero), "n_right": F.coalesce("n_right", zero)})
        .withColumn("status", status)
    )


def dangling(references: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    return references.join(known.select(*keys).distinct(), list(keys), "left_anti")


def unique_match(wanted: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """How many candidates answer each key; exactly one is required."""
    counts = candidates.groupBy(key).agg(F.count(F.lit(1)).alias("matches"))
    n = F.coalesce("matches", F.lit(0).cast("bigint"))
    status = F.when(n == 0, "none").when(n == 1, "unique").otherwise("ambiguous")
    return wanted.join(counts, key, "left").select(*wanted.columns, n.alias("matches"), status.alias("status"))


def manifest_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``path, bytes, sha256`` of a manifest against the files found."""
    e = expected.select("path", F.col("bytes").alias("expected_bytes"), F.col("sha256").alias("_sha"))
    a = actual.select("path", F.col("bytes").alias("actual_bytes"), F.col("sha256").alias("_found"))
    status = (
        F.when(F.col("_found").isNull(), "missing").when(F.col("_sha").isNull(), "extra")
        .when((F.col("_sha") != F.col("_found")) | (F.col("expected_bytes") != F.col("actual_bytes")), "changed").otherwise("same")
    )
    return e.join(a, "path", "full_outer").withColumn("status", status).drop("_sha", "_found")


def inventory_rollup(files: DataFrame) -> DataFrame:
    """Files, bytes and distinct contents per extension."""
    per_content = files.groupBy(extension_of(F.col("path")).alias("extension"), "sha256").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("bytes").alias("_b")
    )
    return per_content.groupBy("extension").agg(
        F.sum("_n").alias("files"), F.sum("_b").alias("bytes"), F.count(F.lit(1)).alias("unique_contents")
    )


def rule_violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """One row per broken rule; a rule is a condition that must hold (null counts as broken)."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return df.select(key, F.explode(broken).alias("rule"))


def is_identifier(value: Column) -> Column:
    return value.rlike(IDENTIFIER)


def set_digest(frame: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """A digest of the different values of each key, whatever their order: ``key, name``.

    Two hashes of every value are summed, so partial sums combine before the shuffle and no task gathers a set.
    """
    text = F.col(value).cast("string")
    part = lambda seed: F.sum(F.xxhash64(F.lit(seed), text).cast("decimal(20, 0)"))
    return frame.select(key, value).distinct().groupBy(key).agg(F.concat_ws(":", F.count(F.lit(1)), part(1), part(2)).alias(name))


def structural_duplicates(
    tasks: DataFrame, members: DataFrame, task: str, kind: Sequence[str], member: str, checks: DataFrame | None = None, check: str | None = None
) -> DataFrame:
    """Tasks of one kind over the same sets of members and of checks; wording does not make a task new, nor does having none of them.

    Returns ``signature``, ``kind``, the sorted ``members`` (and ``checks``) as text, ``n``, the number of tasks that share them, and ``first``, the least of
    those tasks. Null members count for nothing. Tasks meet by digests; lists are made for the first task of each group alone.
    """
    sets = [(members, member, "members"), *([(checks, check, "checks")] if checks is not None else [])]
    signed = tasks
    for frame, value, name in sets:
        signed = signed.join(set_digest(frame.filter(F.col(value).isNotNull()), task, value, f"_{name}"), task, "left").withColumn(f"_{name}", F.coalesce(f"_{name}", F.lit("")))
    grouped = signed.groupBy(*kind, *[f"_{name}" for _, _, name in sets]).agg(F.count(F.lit(1)).alias("n"), F.min(task).alias("first")).filter(F.col("n") > 1)
    out = written(grouped.select(*kind, "n", "first"), "repeated")
    for frame, value, name in sets:
        listed = frame.select(F.col(task).alias("first"), F.col(value).cast("string").alias("_v")).join(out.select("first"), "first", "left_semi")
        text = F.array_join(F.array_sort(F.collect_set("_v")), ",").alias(name)
        out = out.join(listed.groupBy("first").agg(text), "first", "left").withColumn(name, F.coalesce(name, F.lit("")))
    names = [name for _, _, name in sets]
    return out.select(F.sha2(F.concat_ws("|", *kind, *names), 256).alias("signature"), *kind, *names, "n", "first")


def filled(column: str) -> Column:
    return F.coalesce(F.length(F.trim(F.col(column).cast("string"))) > 0, F.lit(False))


# The review decision each final status needs, and what an accepted case must show.
DECISIONS = {"accepted": "accept", "merged": "merge", "rejected": "reject"}
DISPOSITIONS = ["core", "variant"]


def acceptance_rules(columns: Sequence[str]) -> dict[str, Column]:
    """Rules on what a reviewed or accepted case states about itself; each holds for cases that carry its columns.

    ``reviewer, rationale, independence``: who reviewed, why and how; ``blocking_issues``: how many are open; ``disposition``; ``leakage_review``;
    ``record_selection``; ``verification, report_sha, report_found_sha, facts_sha, checked_facts_sha``: the raw verification, its report as
    named and as found, and the facts as they are and as they were checked.
    """
    accepted, reviewed = F.col("status") == "accepted", F.col("status").isin(list(DECISIONS))
    needs = {
        "review_provenance_missing": (["reviewer", "rationale", "independence"], reviewed, lambda c: filled(c[0]) & filled(c[1]) & filled(c[2])),
        "blocking_issues_open": (["blocking_issues"], accepted, lambda c: F.col(c[0]) == 0),
        "disposition_not_released": (["disposition"], accepted, lambda c: F.col(c[0]).isin(DISPOSITIONS)),
        "leakage_review_not_passed": (["leakage_review"], accepted, lambda c: F.col(c[0]) == "passed"),
        "record_selection_missing": (["record_selection"], accepted, lambda c: filled(c[0])),
        "verification_not_bound": (["verification", "report_sha"], accepted, lambda c: (F.col(c[0]) == "passed") & filled(c[1])),
        "report_changed": (["report_sha", "report_found_sha"], accepted, lambda c: F.col(c[0]).eqNullSafe(F.col(c[1]))),
        "facts_not_as_checked": (["facts_sha", "checked_facts_sha"], accepted, lambda c: F.col(c[0]) == F.col(c[1])),
    }
    return {
        name: ~where | F.coalesce(holds(used), F.lit(False))
        for name, (used, where, holds) in needs.items() if set(used) <= set(columns)
    }


def case_gates(
    cases: DataFrame, facts: DataFrame, claims: DataFrame, sources: DataFrame, artifacts: DataFrame | None = None, windows: DataFrame | None = None,
    declared: DataFrame | None = None,
) -> DataFrame:
    """Violated rules of case records as ``case_id, rule``.

    ``cases``: case_id, status, decision, content_sha, reviewed_sha, merge_into and the columns of ``acceptance_rules``. ``facts``: case_id,
    fact_id, source_id, start_row, stop_row and perhaps verification_status. ``claims``: case_id, claim_id, verdict, fact_id (null without
    evidence). ``sources``: source_id, n_rows. ``declared``: case_id, source_id, the sources a case is about; all its facts and windows lie in them
    (without it, the sources of the facts). ``artifacts``: case_id, source_id, alignment; they must be the declared sources, each once.
    ``windows``: case_id, source_id, start_row, stop_row.
    """
    scoped = ["case_id", "source_id", "start_row", "stop_row"]
    ranges = facts.select(*scoped) if windows is None else facts.select(*scoped).unionByName(windows.select(*scoped))
    known = ranges.join(sources, "source_id", "left")
    inside = (F.col("start_row") >= 0) & (F.col("start_row") < F.col("stop_row")) & (F.col("stop_row") <= F.col("n_rows"))
    fact_issues = known.select(
        "case_id",
        F.explode(F.array_compact(F.array(
            F.when(F.col("n_rows").isNull(), F.lit("unknown_source")),
            F.when(F.col("n_rows").isNotNull() & ~inside, F.lit("rows_out_of_scope")),
        ))).alias("rule"),
    )
    repeated = duplicate_keys(facts, ["case_id", "fact_id"]).select("case_id", F.lit("duplicate_fact").alias("rule"))
    cited = claims.filter(F.col("fact_id").isNotNull())
    invented = dangling(cited, facts, ["case_id", "fact_id"]).select("case_id", F.lit("unknown_claim_evidence").alias("rule"))
    bare = claims.filter(F.col("fact_id").isNull() & (F.col("verdict") != "untested")).select(
        "case_id", F.lit("assessed_claim_without_evidence").alias("rule")
    )
    counts = facts.groupBy("case_id").agg(F.count(F.lit(1)).alias("_facts"))
    assessed = claims.filter(F.col("verdict") != "untested").groupBy("case_id").agg(F.count(F.lit(1)).alias("_assessed"))
    full = cases.join(counts, "case_id", "left").join(assessed, "case_id", "left")
    wanted = F.create_map(*[F.lit(x) for pair in DECISIONS.items() for x in pair])
    decided = F.element_at(wanted, F.col("status"))
    status_rules = {
        "missing_or_stale_review": decided.isNull()
        | ((F.coalesce("decision", F.lit("")) == decided) & (F.coalesce("reviewed_sha", F.lit("")) == F.col("content_sha"))),
        "merge_needs_other_target": (F.col("status") != "merged")
        | (F.col("merge_into").isNotNull() & (F.col("merge_into") != F.col("case_id"))),
        "accepted_without_facts": (F.col("status") != "accepted") | (F.coalesce("_facts", F.lit(0)) > 0),
        "accepted_without_assessed_claim": (F.col("status") != "accepted") | (F.coalesce("_assessed", F.lit(0)) > 0),
    }
    accepted = cases.filter(F.col("status") == "accepted").select("case_id")
    parts = [fact_issues, repeated, invented, bare]

    def broken(df: DataFrame, rule: str) -> None:
        parts.append(df.select("case_id").distinct().withColumn("rule", F.lit(rule)))

    if "verification_status" in facts.columns:
        broken(facts.filter(~F.col("verification_status").eqNullSafe(F.lit("passed"))).join(accepted, "case_id", "left_semi"), "unverified_fact")
    if declared is not None:
        broken(dangling(ranges, declared, ["case_id", "source_id"]), "undeclared_source")
    if windows is not None:
        broken(accepted.join(windows, "case_id", "left_anti"), "accepted_without_windows")
    if artifacts is not None:
        held = artifacts.groupBy("case_id", "source_id").agg(F.count(F.lit(1)).alias("_n"))
        used = (facts if declared is None else declared).select("case_id", "source_id").distinct().withColumn("_used", F.lit(True))
        uncovered = held.join(used, ["case_id", "source_id"], "full_outer")
        broken(uncovered.filter(F.col("_n").isNull() | F.col("_used").isNull() | (F.col("_n") > 1)), "artifact_coverage")
        broken(artifacts.filter(~F.coalesce(F.col("alignment") != "unverified", F.lit(False))).join(accepted, "case_id", "left_semi"), "unverified_alignment")
    out = rule_violations(full, "case_id", status_rules | acceptance_rules(cases.columns))
    for part in parts:
        out = out.unionByName(part)
    return out.groupBy("case_id", "rule").agg(F.count(F.lit(1)).alias("n"))


def bundle_gates(
    tasks: DataFrame, cited: DataFrame, facts: DataFrame, checks: DataFrame, reviews: DataFrame,
) -> DataFrame:
    """Violated rules of task bundles as ``task_id, rule``.

    ``tasks``: task_id, bundle_id, task_type, guided (does it claim an investigation?), n_decisions. ``cited``: task_id, fact_id. ``facts``: bundle_id,
    fact_id. ``checks``: task_id, answer_key, fact_id. ``reviews``: bundle_id, task_id, decision, n_blocking; every task is reviewed once, and a blocking
    issue cannot be accepted away. Of tasks that repeat a structure, the first stands for all.
    """
    owner = tasks.select("task_id", "bundle_id").distinct()
    used = cited.select("task_id", "fact_id").unionByName(checks.select("task_id", "fact_id")).distinct()
    invented = dangling(used.join(owner, "task_id"), facts, ["bundle_id", "fact_id"])
    known = ["bundle_id", "task_id"]
    judged = reviews.groupBy(*known).agg(F.count(F.lit(1)).alias("_n"))
    covered = tasks.select(*known).distinct().withColumn("_task", F.lit(True)).join(judged, known, "full_outer")
    overridden = reviews.filter(F.col("decision").isin("accept", "basic_only") & (F.col("n_blocking") > 0))
    same = structural_duplicates(tasks, cited, "task_id", ["bundle_id", "task_type"], "fact_id", checks, "fact_id")
    parts = {
        "unknown_task": dangling(used, tasks, ["task_id"]), "no_evidence": dangling(tasks, cited, ["task_id"]), "unknown_fact": invented,
        "repeated_task": duplicate_keys(tasks, known), "repeated_structure": same.withColumnRenamed("first", "task_id"),
        "repeated_answer_key": duplicate_keys(checks, ["task_id", "answer_key"]),
        "investigation_without_decisions": tasks.filter(F.col("guided") & (F.coalesce("n_decisions", F.lit(0)) == 0)),
        "not_reviewed": covered.filter(F.col("_n").isNull()), "reviewed_more_than_once": covered.filter(F.col("_n") > 1),
        "review_of_unknown_task": covered.filter(F.col("_task").isNull()), "blocking_issue_overridden": overridden,
    }
    rows = [part.select("task_id", F.lit(rule).alias("rule")) for rule, part in parts.items()]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out.distinct()
