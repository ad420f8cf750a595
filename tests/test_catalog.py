"""Gates, releases and run logs on small tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from teleproof.operators import catalog as C
from teleproof.operators import release as R
from teleproof.operators import runlog as L


def test_leak_hits_against_brute_force(spark):
    rng = random.Random(3)
    alphabet = ["ab", "Straße", "x", "Grüße", "-", "the", "A1", "ß", "\n", ".", ",", "/home/"]
    docs = [(i, " ".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40)))) for i in range(150)] + [(999, "")]
    tokens = ["the A1", "strasse", "ab the x", "ß", "/home/", "x", "- . ,", "GRÜSSE ab", "ab\nthe", "", "zz", "A1 the strasse ab", ". -", "x the ab x ab", "ab the x ab", "the ab A1 x the x"]
    d = spark.createDataFrame(docs, "doc_id int, text string")
    t = spark.createDataFrame(list(enumerate(tokens)), "token_id int, token string")
    fold = str.casefold
    want = sorted(((i, j) for i, text in docs for j, token in enumerate(tokens) if token and fold(token) in fold(text)), key=repr)
    assert want and rows_of(R.leak_hits(d, t), "doc_id", "token_id") == want


def test_private_words(spark):
    d = spark.createDataFrame([("has AnomalyLabel inside",), ("clean",)], "text string")
    assert [r[0] for r in d.select(R.built_in_leaks(F.col("text"))).collect()] == [True, False]


def test_style(spark):
    tasks = spark.createDataFrame(
        [("a", "t", "查明供电变化的原因。"), ("b", "t", "分别说明。"), ("c", "t", "一。二。"), ("d", "t" * 31, "一"), ("e", "t", "看 P_SA 的变化"), ("f", "t", "")],
        "id string, title string, prompt string",
    )
    assert rows_of(R.style_errors(tasks, "id", "title", "prompt"), "id", "rule") == [
        ("b", "scaffolding"), ("c", "not_one_sentence"), ("d", "too_long"), ("e", "scaffolding"), ("f", "not_one_sentence")
    ]


def test_lineage(spark):
    s = spark.createDataFrame(
        [("e1", "g1", "train", "h1"), ("e2", "g1", "test", "h2"), ("e3", "g2", "train", "h3"), ("e3", "g2", "train", "h3"), ("e4", "g3", "train", "h3")],
        "source_id string, lineage_group string, split string, sha256 string",
    )
    assert rows_of(C.lineage_conflicts(s)) == [
        ("duplicate_id", "e3", 2), ("group_in_several_splits", "g1", 2), ("same_bytes_different_lineage", "h3", 2)
    ]


CASE = dict(case_id="c", status="accepted", decision="accept", content_sha="s", reviewed_sha="s", merge_into=None)
FACT = dict(case_id="c", fact_id="f", source_id="src", start_row=0, stop_row=10)
CLAIM = dict(case_id="c", claim_id="k", verdict="supported", fact_id="f")


@pytest.mark.parametrize("case,fact,claim,extra,want", [
    ({}, {}, {}, False, []),
    ({"reviewed_sha": "old"}, {}, {}, False, ["missing_or_stale_review"]),
    ({}, {}, {"fact_id": "invented"}, False, ["unknown_claim_evidence"]),
    ({}, {"start_row": 10, "stop_row": 10}, {}, False, ["rows_out_of_scope"]),
    ({}, {"stop_row": 11}, {}, False, ["rows_out_of_scope"]),
    ({}, {"start_row": 9, "stop_row": 2}, {}, False, ["rows_out_of_scope"]),
    ({}, {"source_id": "other"}, {}, False, ["unknown_source"]),
    ({}, {}, {"verdict": "untested"}, False, ["accepted_without_assessed_claim"]),
    ({}, {}, {"fact_id": None}, False, ["assessed_claim_without_evidence"]),
    ({}, {}, {}, True, ["duplicate_fact"]),
    ({"status": "merged", "decision": "merge", "merge_into": "c"}, {}, {}, False, ["merge_needs_other_target"]),
])
def test_case_gates(spark, case, fact, claim, extra, want):
    cases = spark.createDataFrame([{**CASE, **case}], "case_id string, status string, decision string, content_sha string, reviewed_sha string, merge_into string")
    facts = spark.createDataFrame([{**FACT, **fact}] * (2 if extra else 1), "case_id string, fact_id string, source_id string, start_row long, stop_row long")
    claims = spark.createDataFrame([{**CLAIM, **claim}], "case_id string, claim_id string, verdict string, fact_id string")
    sources = spark.createDataFrame([("src", 10)], "source_id string, n_rows long")
    assert sorted(r["rule"] for r in C.case_gates(cases, facts, claims, sources).collect()) == want


def test_overlay_and_allowed_change(spark):
    base = spark.createDataFrame([("a", 1, "V"), ("b", 2, "A")], "id string, v int, unit string")
    new = spark.createDataFrame([("b", 3, "A"), ("z", 9, "W")], "id string, v int, unit string")
    assert rows_of(R.overlay(base, new, "id", "v")) == [("a", 1, "base"), ("b", 3, "replacement"), ("z", 9, "unknown_key")]
    after = spark.createDataFrame([("a", 1, "W"), ("b", 5, "W")], "id string, v int, unit string")
    assert rows_of(R.changed_only_in(base, after, "id", "unit")) == [("a", True), ("b", False)]


def test_positional_join(spark):
    a = spark.createDataFrame([("r", 0, 1.0), ("r", 1, 1.0), ("r", 2, 2.0)], "record_id string, row bigint, time_s double")
    b = spark.createDataFrame([("r", 0, 1.0, "x"), ("r", 1, 1.5, "y"), ("r", 3, 3.0, "z")], "record_id string, row bigint, time_s double, g string")
    aligned, bad = C.positional_join(a, b)
    assert rows_of(aligned, "row", "g") == [(0, "x")]
    assert rows_of(bad, "row", "issue") == [(1, "time_differs"), (2, "missing_context"), (3, "missing_telemetry")]


def test_run_log(spark):
    turns = spark.createDataFrame(
        [("a", 0, "user", 5), ("a", 1, "assistant", 6), ("a", 2, "system", 1), ("b", 0, "user", 5), ("b", 2, "user", 1)],
        "run_id string, seq bigint, role string, tokens bigint",
    )
    assert rows_of(L.contiguity(turns), "run_id", "contiguous") == [("a", True), ("b", False)]
    placed = turns.withColumnsRenamed({"run_id": "record_id", "seq": "row"})
    assert rows_of(L.phase_latch(placed, "assistant", "system").filter("NOT allowed"), "record_id", "row") == [("a", 2)]
    assert rows_of(L.unanswered(placed), "record_id", "row") == [("b", 0), ("b", 2)]
    assert rows_of(L.unfinished(L.run_summary(turns)), "run_id") == [("a",), ("b",)]


def test_bindings(spark):
    items = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("d", "x")], "id string, text string")
    reviews = spark.createDataFrame([("a", "accept", "x"), ("b", "accept", "y"), ("c", "revise", "x")], "id string, decision string, t string")
    reviews = reviews.select("id", "decision", F.sha2("t", 256).alias("reviewed_sha"))
    assert rows_of(R.review_binding(items, reviews, "id", "text")) == [("a", "bound"), ("b", "stale"), ("c", "not_accepted"), ("d", "missing")]
    log = items.limit(1)
    assert {r["logged"] for r in R.provenance(items, log, "text").collect()} == {True}
