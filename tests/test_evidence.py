"""Answers: the clean bundle passes, each corruption fails; replay finds forgeries."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from teleproof.operators import evidence as E

CH = ["P_SA"]


@pytest.fixture(scope="module")
def bundle(spark):
    rows = spark.createDataFrame([("r", i, float(i), float(v)) for i, v in enumerate([2, 4, 6])], "record_id string, row bigint, time_s double, P_SA double")
    query = spark.createDataFrame(
        [("t", "f1", "r", 0, 3, "P_SA", "median"), ("t", "f2", "r", 0, 2, "P_SA", "max")],
        "task_id string, fact_id string, record_id string, start_row bigint, stop_row bigint, channel string, stat string",
    )
    seen = E.observe(rows, query, CH).drop("status").cache()
    claims = spark.createDataFrame([("t", "c1", "supported")], "task_id string, claim_id string, expected_verdict string")
    needs = spark.createDataFrame([("t", "c1", "f1")], "task_id string, claim_id string, fact_id string")
    answers = seen.select("task_id", "fact_id", "value", "observation_id")
    verdicts = claims.withColumnRenamed("expected_verdict", "verdict")
    citations = seen.filter("fact_id = 'f1'").select("task_id", F.lit("c1").alias("claim_id"), "observation_id")
    return dict(
        rows=rows, channels=CH, facts=seen.drop("observation_id"), claims=claims, claim_facts=needs, observations=seen.drop("fact_id"),
        answers=answers, verdicts=verdicts, citations=citations,
    )


def verdict(bundle, **changed):
    return E.validate_answers(**{**bundle, **changed}).first()["hard_pass"]


def test_clean_bundle_passes(bundle):
    assert verdict(bundle) is True


# Each rule of an answer, and a bundle that breaks it and nothing else.
def number_off_the_fact(b):
    return dict(answers=b["answers"].withColumn("value", F.col("value") * 1.5 + 0.25))


def fact_without_number(b):
    return dict(answers=b["answers"].where("fact_id <> 'f2'"))


def number_for_no_fact(b):
    stray = b["answers"].where("fact_id = 'f2'").withColumn("fact_id", F.lit("not_asked"))
    return dict(answers=b["answers"].unionByName(stray))


def number_given_twice(b):
    return dict(answers=b["answers"].unionByName(b["answers"].where("fact_id = 'f2'")))


def verdict_against_the_claim(b):
    return dict(verdicts=b["verdicts"].withColumn("verdict", F.lit("insufficient")))


def claim_without_source(b):
    return dict(citations=b["citations"].where("claim_id IS NULL"))


def source_never_observed(b):
    return dict(citations=b["citations"].withColumn("observation_id", F.concat("observation_id", F.lit("0"))))


def observation_not_replayed(b):
    return dict(observations=b["observations"].withColumn("value", -F.col("value")))


def fact_not_in_the_rows(b):
    return dict(facts=b["facts"].withColumn("value", F.col("value") - 2))


@pytest.mark.parametrize("broken", [
    number_off_the_fact, fact_without_number, number_for_no_fact, number_given_twice, verdict_against_the_claim, claim_without_source,
    source_never_observed, observation_not_replayed, fact_not_in_the_rows,
])
def test_every_rule_rejects(bundle, broken):
    assert verdict(bundle, **broken(bundle)) is False


def test_all_defects_are_rejected(bundle):
    bad, wrong = E.with_defects(bundle["answers"], bundle["verdicts"])
    spread = {k: E.per_defect(bundle[k]) for k in ("facts", "claims", "claim_facts", "observations", "citations")}
    result = E.validate_answers(bundle["rows"], CH, answers=bad, verdicts=wrong, **spread).collect()
    assert len(result) == len(E.DEFECTS) and not any(r["hard_pass"] for r in result)


def test_integrity(bundle):
    seen = bundle["observations"]
    findings = seen.select("task_id", "observation_id")
    clean = E.integrity(bundle["rows"], CH, seen, findings).first()
    assert clean["integrity_pass"] and clean["task_pass"] is None
    forged = seen.withColumn("observation_id", F.lit("O_forged"))
    assert E.integrity(bundle["rows"], CH, forged, findings).first()["replay_mismatches"] == 2
    assert E.integrity(bundle["rows"], CH, forged, findings).first()["unknown_citations"] == 2


def test_claims(spark):
    facts = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "fact_id string, value double")
    atoms = spark.createDataFrame(
        [("c1", "b", "gt", None, "a"), ("c1", "a", "eq", 1.0, None), ("c2", "a", "lt", 0.0, None), ("c3", "z", "ne", 0.0, None), ("c4", "a", "ne", 0.0, None)],
        "claim_id string, fact_id string, relation string, value double, other_fact_id string",
    )
    got = {r["claim_id"]: r["verdict"] for r in E.claim_verdicts(atoms, facts).collect()}
    assert got == {"c1": "supported", "c2": "refuted", "c3": "insufficient", "c4": "supported"}
