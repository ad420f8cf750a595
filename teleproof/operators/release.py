"""What may leave the engine: projections, leak scan, style, provenance, overlays and review binding."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from teleproof.functions.scalar import PRIVATE_TOKENS, fold_case
from teleproof.sources.workspace import written

NOT_WORD = "[^\\p{L}\\p{N}]+"
# Limits and wording the public text must keep to.
PROMPT_CHARS = 90
TITLE_CHARS = 30
SENTENCE_ENDS = "[。！？；;]"
SCAFFOLDING = (
    r"(?i)\b[UIP]_[A-Za-z0-9_]+|load[123]_phase|需|结合|重点|分别|并说明|请说明|避免|而非|不得|电阻|分流器|功率平衡|"
    r"各自.*阶段|相同.*阶段|对应.*阶段"
)


def public_view(df: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Only the listed columns leave; a new private column stays private by default."""
    return df.select(*allowed)


def built_in_leaks(text: Column) -> Column:
    folded = fold_case(text)
    return reduce(lambda a, b: a | b, [folded.contains(t) for t in PRIVATE_TOKENS])


def leak_hits(documents: DataFrame, tokens: DataFrame) -> DataFrame:
    """Pairs ``doc_id, token_id`` where the folded text contains the folded token, exactly and over whole texts.

    A word strictly inside a token is delimited by the token itself, so it must be a whole word of any text holding the token. Texts are folded once and
    their words met once with the inner words of all tokens; each token is then looked up by the one of its inner words that the fewest texts hold. Tokens
    without inner words are looked up by their first characters. The needles met in a text are gathered before they meet it, so a text travels once.
    """
    folded = tokens.select("token_id", fold_case(F.col("token")).alias("needle")).filter(F.length("needle") > 0)
    words = F.split("needle", NOT_WORD)
    inner = F.array_distinct(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))))
    needles = written(folded.select("needle").distinct().withColumn("inner", inner), "needles")
    texts = documents.select("doc_id", F.monotonically_increasing_id().alias("_d"), fold_case(F.col("text")).alias("body"))
    texts = written(texts.filter(F.col("body").isNotNull()), "folded")

    keys = needles.select("needle", F.size("inner").alias("_words"), F.explode("inner").alias("key"))
    held = texts.select("_d", F.explode(F.array_distinct(F.split("body", NOT_WORD))).alias("key"))
    held = written(held.join(keys.select("key").distinct(), "key", "left_semi"), "postings")
    spread = held.groupBy("key").agg(F.count(F.lit(1)).alias("_texts"))
    # A token of which some inner word occurs nowhere is in no text.
    rarest = keys.join(spread, "key").groupBy("needle", "_words").agg(F.min_by("key", "_texts").alias("key"), F.count(F.lit(1)).alias("_met"))
    pairs = held.join(rarest.filter(F.col("_met") == F.col("_words")), "key").select("_d", "needle")

    edges = needles.filter(F.size("inner") == 0)
    for size in sorted(r["n"] for r in edges.select(F.least(F.lit(3), F.length("needle")).alias("n")).distinct().collect()):
        mine = F.least(F.lit(3), F.length("needle")) == size
        wanted = edges.filter(mine).select("needle", F.substring("needle", 1, size).alias("key"))
        starts = F.sequence(F.lit(1), F.length("body") - size + 1)
        seen = texts.filter(F.length("body") >= size).select("_d", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substr("body", i, F.lit(size))))).alias("key"))
        pairs = pairs.unionByName(seen.join(wanted, "key").select("_d", "needle"))
    gathered = pairs.groupBy("_d").agg(F.collect_set("needle").alias("_needles"))
    hits = texts.join(gathered, "_d").select("doc_id", F.explode(F.filter("_needles", lambda n: F.contains(F.col("body"), n))).alias("needle"))
    return hits.join(folded, "needle").select("doc_id", "token_id")


def style_errors(tasks: DataFrame, key: str, title: str, prompt: str) -> DataFrame:
    """Screening rules of public wording as ``key, rule``; passing is no approval."""
    sentences = F.size(F.filter(F.split(prompt, SENTENCE_ENDS), lambda s: s.rlike(r"\S")))
    text = F.concat_ws(" ", title, prompt)
    rules = [
        (F.length(prompt) > PROMPT_CHARS) | (F.length(title) > TITLE_CHARS), text.rlike(SCAFFOLDING), sentences != 1,
    ]
    names = ["too_long", "scaffolding", "not_one_sentence"]
    broken = F.array_compact(F.array(*[F.when(r, F.lit(n)) for r, n in zip(rules, names)]))
    return tasks.select(key, F.explode(broken).alias("rule"))


def provenance(items: DataFrame, log: DataFrame, content: str) -> DataFrame:
    """Does each item's content occur in the log of finished outputs?"""
    logged = log.select(F.sha2(content, 256).alias("_sha")).distinct().withColumn("_hit", F.lit(True))
    return items.withColumn("_sha", F.sha2(content, 256)).join(logged, "_sha", "left").withColumn(
        "logged", F.coalesce("_hit", F.lit(False))
    ).drop("_sha", "_hit")


def overlay(base: DataFrame, replacement: DataFrame, key: str, value: str) -> DataFrame:
    """Base versions updated by replacements; replacements of unknown keys are reported, not added."""
    b = base.select(key, F.col(value).alias("_base"), F.lit(True).alias("_in_base"))
    r = replacement.select(key, F.col(value).alias("_new"), F.lit(True).alias("_in_new"))
    origin = F.when(F.col("_in_base").isNull(), "unknown_key").when(F.col("_in_new"), "replacement").otherwise("base")
    return b.join(r, key, "full_outer").select(
        key, F.when(F.col("_in_new"), F.col("_new")).otherwise(F.col("_base")).alias(value), origin.alias("origin")
    )


def changed_only_in(before: DataFrame, after: DataFrame, key: str, column: str) -> DataFrame:
    """Changed rows, and whether ``column`` alone changed; a key that only one version has is a change that is not allowed."""
    rest = [c for c in before.columns if c not in (key, column)]

    def sign(df: DataFrame, tag: str) -> DataFrame:
        parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in rest]
        return df.select(key, F.lit(True).alias(f"_in_{tag}"), F.col(column).alias(f"_{tag}"), F.sha2(F.concat_ws("\u001f", *parts), 256).alias(f"_{tag}_rest"))

    both = sign(before, "old").join(sign(after, "new"), key, "full_outer")
    same_rest = F.coalesce(F.col("_in_old") & F.col("_in_new") & (F.col("_old_rest") == F.col("_new_rest")), F.lit(False))
    same = F.col("_old").eqNullSafe(F.col("_new"))
    return both.filter(~same | ~same_rest).select(key, same_rest.alias("allowed"))


def review_binding(items: DataFrame, reviews: DataFrame, key: str, content: str) -> DataFrame:
    """Status of the review of each item: it must exist, be an acceptance, and carry the hash of the current content."""
    bound = items.select(key, F.sha2(content, 256).alias("_sha")).join(reviews, key, "left")
    status = (
        F.when(F.col("reviewed_sha").isNull(), "missing").when(F.col("reviewed_sha") != F.col("_sha"), "stale")
        .when(F.col("decision") != "accept", "not_accepted").otherwise("bound")
    )
    return bound.select(key, status.alias("status"))


def bound_parts(items: DataFrame, reviews: DataFrame, key: str, parts: Sequence[str]) -> DataFrame:
    """Status of every item's review and the parts it no longer matches: ``key, status, stale``.

    Items and reviews carry one digest per part; a review also carries ``decision``, ``blocking_issues`` and ``rationale``. A review binds only if
    all its parts are those of now, and there is one of it.
    """
    held = reviews.select(key, "decision", "blocking_issues", "rationale", F.lit(True).alias("_in"), *[F.col(p).alias(f"_{p}") for p in parts])
    copies = reviews.groupBy(key).agg(F.count(F.lit(1)).alias("_copies"))
    both = items.select(key, *parts).join(held, key, "left").join(copies, key, "left")
    stale = F.array_compact(F.array(*[F.when(~F.col(p).eqNullSafe(F.col(f"_{p}")), F.lit(p)) for p in parts]))
    accepted = (F.col("decision") == "accept") & (F.coalesce("blocking_issues", F.lit(0)) == 0) & (F.length(F.trim("rationale")) > 0)
    status = (
        F.when(F.col("_in").isNull(), "missing").when(F.col("_copies") > 1, "repeated").when(F.size(stale) > 0, "stale")
        .when(~F.coalesce(accepted, F.lit(False)), "not_accepted").otherwise("bound")
    )
    found = both.select(key, status.alias("status"), F.when(F.col("_in"), F.array_join(stale, ",")).otherwise("").alias("stale"))
    return found.groupBy(key, "status").agg(F.max("stale").alias("stale"))


def finalised(bound: DataFrame, verification: DataFrame, items: DataFrame, key: str, parts: Sequence[str]) -> DataFrame:
    """Bound items that may be exported: the raw verification must have passed on the material and records of now, and no source may have changed.

    ``verification`` has ``key, all_passed``, the digests ``parts`` it was made on, and ``sources_changed``. Adds ``outcome``.
    """
    held = verification.select(key, "all_passed", "sources_changed", F.lit(True).alias("_in"), *[F.col(p).alias(f"_{p}") for p in parts])
    both = bound.join(items.select(key, *parts), key).join(held, key, "left")
    same = reduce(lambda a, b: a & b, [F.col(p).eqNullSafe(F.col(f"_{p}")) for p in parts])
    outcome = (
        F.when(F.col("status") != "bound", F.concat(F.lit("review_"), "status")).when(F.col("_in").isNull(), "unverified")
        .when(~F.coalesce("all_passed", F.lit(False)), "verification_failed").when(~same, "verification_stale")
        .when(F.coalesce("sources_changed", F.lit(True)), "sources_changed").otherwise("final")
    )
    return both.select(key, "status", "stale", outcome.alias("outcome"))


def publication_gates(tasks: DataFrame, provenance: DataFrame, allowed: Sequence[str], approved: DataFrame) -> DataFrame:
    """Broken rules of a batch as ``task_id, rule``: dense order, one provenance entry each, no other fields, the approved content.

    ``tasks`` has ``task_id, position, content, fields`` (names of its public fields), ``approved`` ``task_id, content``. Tasks are named T and their
    number, two digits at least, in order from 1.
    """
    expected = F.concat(F.lit("T"), F.lpad(F.col("position").cast("string"), 2, "0"))
    expected = F.when(F.col("position") < 10, expected).otherwise(F.concat(F.lit("T"), F.col("position").cast("string")))
    origins = provenance.groupBy("task_id").agg(F.count(F.lit(1)).alias("_origins"))
    copies = tasks.groupBy("task_id").agg(F.count(F.lit(1)).alias("_copies"))
    known = approved.select("task_id", F.col("content").alias("_approved"))
    full = tasks.join(origins, "task_id", "full_outer").join(copies, "task_id", "left").join(known, "task_id", "left")
    public = F.array(*[F.lit(c) for c in sorted(allowed)])
    rules = {
        "provenance_without_task": F.col("position").isNull(),
        "out_of_order": F.col("position").isNotNull() & ~F.coalesce(F.col("task_id") == expected, F.lit(False)),
        "repeated_task": F.col("_copies") > 1,
        "provenance_count_differs": F.col("position").isNotNull() & (F.coalesce("_origins", F.lit(0)) != F.col("_copies")),
        "unexpected_fields": F.array_sort("fields") != public,
        "differs_from_approved": F.col("position").isNotNull() & ~F.col("content").eqNullSafe(F.col("_approved")),
    }
    broken = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return full.select("task_id", F.explode(broken).alias("rule")).distinct()
