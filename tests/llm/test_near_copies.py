"""Near copies against brute force on sets of five-word shingles; groups with repeated and null ids."""

from __future__ import annotations

import random

import pytest

from llm.test_duplicates import joined
from teleproof.llm import near_copies, simhash


def slow_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b) > 0


def edited(seed=3):
    """Texts of 200 words; some are edited by 2 or 3 words, a chain of edits among them."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(4000)}"
    rows, doc = [], 0
    for _ in range(8):
        words = [word() for _ in range(200)]
        for _ in range(5):
            rows.append((doc, " ".join(words)))
            doc += 1
            for _ in range(r.randrange(1, 5)):
                words[r.randrange(200)] = word()
    rows += [(900, None), (901, ""), (902, " \n"), (903, "two words"), (904, "Two  WORDS"), (905, "two words more")]
    return rows


@pytest.mark.parametrize("at_once", [8, 0])
def test_near_copies_by_hand(frame, at_once):
    rows = edited()
    sets = {d: slow_set(t) for d, t in rows}
    want = sorted(set(joined(sorted(sets), lambda a, b: alike(sets[a], sets[b])).values()))
    kept = near_copies.one_per_copy(frame(rows, bits="clash"), at_once)
    assert kept.columns == ["doc_id", "text", "bits"] and sorted(r.doc_id for r in kept.collect()) == want
    assert len(want) < len(rows) / 2
    assert near_copies.one_per_copy(frame([])).collect() == []


def test_pipeline_stage_finds_copies_beyond_two_bits(spark, sf):
    import corpus_pipeline

    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    a, b = next((a, b) for (_, a), (_, b) in zip(edited(), edited()[1:])
                if alike(slow_set(a), slow_set(b)) and (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() > 2)
    rows = [{"doc_id": 1, "text": a}, {"doc_id": 2, "text": b}]
    docs = spark.createDataFrame([tuple(r.get(c) for c in schema.names) for r in rows], schema)
    assert [r.doc_id for r in corpus_pipeline.simhash(spark, docs, sf).collect()] == [1]


def test_groups_with_repeated_and_null_ids(frame):
    a, alone, other, free = "a b c d e f", "one clean text here", "other words are here too", "nothing like these at all"
    rows = [(5, a), (3, a), (5, alone), (7, alone + " x"), (5, other), (5, free), (None, free), (None, "n n"), (None, "n n"), (3, a)]
    for call in (near_copies.one_per_copy, simhash.one_per_group):
        got = sorted(((r.doc_id or 0), r.text) for r in call(frame(rows)).collect())
        without = [(0, "n n")] if call is near_copies.one_per_copy else [(0, "n n"), (0, "n n"), (0, free)]
        assert got == sorted([(3, a), (5, alone), (7, alone + " x"), (5, other), (5, free), *without])
