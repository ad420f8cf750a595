"""Facts, claims, answers and the replay of cited observations.

``facts``: fact_id, record_id, window, channel, stat, value. ``observations``: observation_id, task_id, the same
query columns, value. ``answers``: task_id, fact_id, value, observation_id. ``verdicts``: task_id, claim_id, verdict.
``citations``: task_id, claim_id, observation_id. ``claims``: task_id, claim_id, expected_verdict, with their facts in
``claim_facts``: claim_id, fact_id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from teleproof.functions.scalar import close_to, digest_id
from teleproof.operators.blocks import RECORD
from teleproof.operators.windows import WINDOW, stat_queries
from teleproof.sources.workspace import written

QUERY = [*WINDOW, "channel", "stat"]
TOLERANCE = 1e-6
REPLAY_TOLERANCE = 1e-9
# Defects an answer validator must reject.
DEFECTS = ["wrong_number", "fake_citation", "missing_measurement", "wrong_interpretation"]


def fact_grid(records: DataFrame, regions: Sequence[tuple[str, int, int]], channels: Sequence[str], stats: Sequence[str]) -> DataFrame:
    """Facts to compute: every record with every region, channel and statistic, each definition once."""
    cells = F.array(*[
        F.struct(
            F.lit(r).alias("region"), F.lit(a).cast("bigint").alias("start_row"), F.lit(b).cast("bigint").alias("stop_row"),
            F.lit(c).alias("channel"), F.lit(s).alias("stat"),
        )
        for r, a, b in regions for c in channels for s in stats
    ])
    grid = records.select(RECORD, F.inline(F.array_distinct(cells)))
    fact_id = F.concat_ws("_", F.col(RECORD).cast("string"), "region", "channel", "stat")
    return grid.withColumn("fact_id", fact_id)


def observation_id() -> Column:
    return digest_id("O_", *[F.col(c) for c in QUERY], F.col("value"), length=20)


def observe(rows: DataFrame, queries: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Answer queries and give each result its content id."""
    return stat_queries(rows, queries, channels).withColumn("observation_id", observation_id())


def claim_verdicts(atoms: DataFrame, facts: DataFrame) -> DataFrame:
    """A claim holds if all its atoms hold: ``claim_id, fact_id, relation, value`` or ``other_fact_id``."""
    values = facts.select("fact_id", F.col("value").alias("_left"))
    others = facts.select(F.col("fact_id").alias("other_fact_id"), F.col("value").alias("_right"))
    joined = atoms.join(values, "fact_id", "left").join(others, "other_fact_id", "left")
    right = F.when(F.col("other_fact_id").isNotNull(), F.col("_right")).otherwise(F.col("value"))
    relation = F.col("relation")
    holds = (
        F.when(relation == "gt", F.col("_left") > right).when(relation == "lt", F.col("_left") < right)
        .when(relation == "eq", F.col("_left") == right).when(relation == "ne", F.col("_left") != right)
    )
    return joined.groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("atoms"),
        F.when(F.count_if(holds.isNull()) > 0, "insufficient").when(F.bool_and(holds), "supported").otherwise("refuted").alias("verdict"),
    )


def replay(rows: DataFrame, observations: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Run every observed query again; the value must come back and the id must belong to the stored result.

    A distributed mean may differ in its last bits from run to run, so values agree within ``REPLAY_TOLERANCE``
    while the id is checked against the stored value exactly.
    """
    stored = observations.withColumn("_own", F.col("observation_id") == observation_id())
    stored = stored.withColumnRenamed("value", "stored_value")
    again = stat_queries(rows, stored, channels)
    same = close_to(F.col("stored_value"), F.col("value"), REPLAY_TOLERANCE, REPLAY_TOLERANCE) & F.col("_own")
    return again.withColumn("replayed", (F.col("status") == "ok") & same).drop("_own").withColumnsRenamed(
        {"value": "recomputed", "stored_value": "value"}
    )


def measurement_checks(facts: DataFrame, answers: DataFrame, replayed: DataFrame) -> DataFrame:
    """Per expected fact: answered once, within tolerance, and backed by an observation of the same query."""
    seen = replayed.select(
        "task_id", "observation_id", *[F.col(c).alias(f"_{c}") for c in QUERY], F.col("value").alias("_seen"), "replayed"
    )
    given = answers.select("task_id", "fact_id", F.col("value").alias("actual"), "observation_id")
    repeats = given.groupBy("task_id", "fact_id").agg(F.count(F.lit(1)).alias("n_answers"))
    joined = (
        facts.join(given, ["task_id", "fact_id"], "left").join(repeats, ["task_id", "fact_id"], "left")
        .join(seen, ["task_id", "observation_id"], "left")
    )
    same_query = F.lit(True)
    for c in QUERY:
        same_query = same_query & F.col(c).eqNullSafe(F.col(f"_{c}"))
    passed = (
        (F.coalesce("n_answers", F.lit(0)) == 1)
        & close_to(F.col("actual"), F.col("value"), 0.0, TOLERANCE)
        & same_query & F.col("replayed") & close_to(F.col("_seen"), F.col("value"), REPLAY_TOLERANCE, REPLAY_TOLERANCE)
    )
    return joined.select(
        "task_id", "fact_id", F.col("value").alias("expected"), "actual", F.coalesce(passed, F.lit(False)).alias("passed")
    )


def citation_checks(claim_facts: DataFrame, facts: DataFrame, citations: DataFrame, observations: DataFrame) -> DataFrame:
    """Per claim: queries it needs but does not cite, and citations of observations that do not exist."""
    needed = claim_facts.join(facts.select("fact_id", *QUERY), "fact_id").select("task_id", "claim_id", *QUERY).distinct()
    known = observations.select("task_id", "observation_id", *QUERY, F.lit(True).alias("_known"))
    cited = citations.join(known, ["task_id", "observation_id"], "left")
    covered = cited.filter(F.col("_known")).select("task_id", "claim_id", *QUERY).distinct()
    missing = needed.join(covered, ["task_id", "claim_id", *QUERY], "left_anti").groupBy("task_id", "claim_id").agg(
        F.count(F.lit(1)).alias("missing")
    )
    unknown = cited.filter(F.col("_known").isNull()).groupBy("task_id", "claim_id").agg(F.count(F.lit(1)).alias("unknown"))
    zero = F.lit(0).cast("bigint")
    return (
        claim_facts.select("task_id", "claim_id").distinct()
        .join(missing, ["task_id", "claim_id"], "left").join(unknown, ["task_id", "claim_id"], "left")
        .select("task_id", "claim_id", F.coalesce("missing", zero).alias("missing"), F.coalesce("unknown", zero).alias("unknown"))
        .withColumn("sufficient", (F.col("missing") == 0) & (F.col("unknown") == 0))
    )


def interpretation_checks(claims: DataFrame, verdicts: DataFrame, sufficiency: DataFrame) -> DataFrame:
    given = verdicts.groupBy("task_id", "claim_id").agg(F.count(F.lit(1)).alias("_n"), F.max("verdict").alias("verdict"))
    right = (F.col("_n") == 1) & (F.col("verdict") == F.col("expected_verdict")) & F.col("sufficient")
    return (
        claims.join(given, ["task_id", "claim_id"], "left").join(sufficiency, ["task_id", "claim_id"], "left")
        .select("task_id", "claim_id", "expected_verdict", "verdict", F.coalesce(right, F.lit(False)).alias("passed"))
    )


def validate_answers(
    rows: DataFrame, channels: Sequence[str], facts: DataFrame, claims: DataFrame, claim_facts: DataFrame,
    observations: DataFrame, answers: DataFrame, verdicts: DataFrame, citations: DataFrame,
) -> DataFrame:
    """Per task: number of checks, failures and unexpected answers; ``hard_pass`` needs all of them clean."""
    replayed = written(replay(rows, observations, channels), "replayed")
    parts = (
        measurement_checks(facts, answers, replayed).select("task_id", "passed")
        .unionByName(
            interpretation_checks(claims, verdicts, citation_checks(claim_facts, facts, citations, observations)).select("task_id", "passed")
        )
        .unionByName(replayed.select("task_id", F.col("replayed").alias("passed")).filter(~F.col("passed")))
        .unionByName(answers.join(facts, ["task_id", "fact_id"], "left_anti").select("task_id", F.lit(False).alias("passed")))
        .unionByName(verdicts.join(claims, ["task_id", "claim_id"], "left_anti").select("task_id", F.lit(False).alias("passed")))
    )
    return parts.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("checks"), F.count_if(~F.col("passed")).alias("failed"), F.bool_and("passed").alias("hard_pass")
    )


def with_defects(answers: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every answer once per defect, spoiled in the first fact or claim of its task; task ids become task|defect."""
    first_fact = answers.groupBy("task_id").agg(F.min(F.when(F.col("value").isNotNull(), F.col("fact_id"))).alias("_first"))
    first_claim = verdicts.groupBy("task_id").agg(F.min("claim_id").alias("_first"))
    defect = F.explode(F.array(*[F.lit(d) for d in DEFECTS]))
    hit = F.col("fact_id") == F.col("_first")
    bad = (
        answers.join(first_fact, "task_id").withColumn("defect", defect)
        .filter(~((F.col("defect") == "missing_measurement") & hit))
        .withColumn("value", F.when((F.col("defect") == "wrong_number") & hit, F.col("value") + 1).otherwise(F.col("value")))
        .withColumn("observation_id", F.when((F.col("defect") == "fake_citation") & hit, "O_fabricated").otherwise(F.col("observation_id")))
        .withColumn("task_id", F.concat_ws("|", "task_id", "defect")).drop("_first", "defect")
    )
    flipped = F.when(F.col("verdict") != "refuted", "refuted").otherwise("supported")
    wrong = (
        verdicts.join(first_claim, "task_id").withColumn("defect", defect)
        .withColumn("verdict", F.when((F.col("defect") == "wrong_interpretation") & (F.col("claim_id") == F.col("_first")), flipped).otherwise(F.col("verdict")))
        .withColumn("task_id", F.concat_ws("|", "task_id", "defect")).drop("_first", "defect")
    )
    return bad, wrong


def per_defect(df: DataFrame) -> DataFrame:
    """Copies of a task table under the spoiled task ids."""
    defect = F.explode(F.array(*[F.lit(d) for d in DEFECTS]))
    return df.withColumn("_d", defect).withColumn("task_id", F.concat_ws("|", "task_id", "_d")).drop("_d")


def integrity(rows: DataFrame, channels: Sequence[str], observations: DataFrame, findings: DataFrame) -> DataFrame:
    """Evidence report per trajectory: replay mismatches and citations (``task_id, observation_id``) of unknown ids.

    Passing says the evidence is authentic, not that the answer is right; ``task_pass`` therefore stays empty.
    """
    replayed = replay(rows, observations, channels)
    mismatch = replayed.groupBy("task_id").agg(F.count(F.lit(1)).alias("observations"), F.count_if(~F.col("replayed")).alias("replay_mismatches"))
    unknown = findings.join(observations, ["task_id", "observation_id"], "left_anti").groupBy("task_id").agg(
        F.count(F.lit(1)).alias("unknown_citations")
    )
    zero = F.lit(0).cast("bigint")
    return (
        mismatch.join(unknown, "task_id", "full_outer")
        .select("task_id", *[F.coalesce(c, zero).alias(c) for c in ("observations", "replay_mismatches", "unknown_citations")])
        .withColumn("integrity_pass", (F.col("replay_mismatches") == 0) & (F.col("unknown_citations") == 0))
        .withColumn("task_pass", F.lit(None).cast("boolean"))
    )
