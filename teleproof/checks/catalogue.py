"""Queries: catalogs, lineage, releases and run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from teleproof.checks.registry import EV, LI, ORD, check, q6, r6
from teleproof.functions import scalar as S
from teleproof.operators import catalog as C
from teleproof.operators import nested as N
from teleproof.operators import release as R
from teleproof.operators import runlog as L
from teleproof.operators.blocks import RECORD
from teleproof.operators.numbering import number_rows
from teleproof.operators.windows import extents
from teleproof.sources.tables import LINE_CONTEXT, event_rows, line_rows, order_rows, table
from teleproof.sources.workspace import written


def sha(column: str = "text"):
    return F.sha2(column, 256)


# ---------------------------------------------------------------- files


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as files: url as path, html as content."""
    return table(spark, sf, "pages").select(
        "page_id", F.col("url").alias("path"), F.octet_length("html").cast("bigint").alias("bytes"), sha("html").alias("sha256")
    )


PAGES = "pg AS (SELECT page_id, url AS path, CAST(strlen(html) AS BIGINT) AS bytes, sha256(html) AS sha256 FROM pages)"


@check("source_hashes", f"WITH {PAGES} SELECT page_id, sha256 FROM pg")
def source_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).select("page_id", "sha256")


EXTENSION = r"""CASE WHEN regexp_matches(regexp_extract(path, '([^/]*)$', 1), '^.+\.[^./]+$')
  THEN lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.+(\.[^./]+)$', 1)) ELSE '(none)' END"""


@check("file_inventory", f"WITH {PAGES} SELECT path, bytes, sha256, {EXTENSION} AS extension FROM pg")
def file_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).select("path", "bytes", "sha256", S.extension_of(F.col("path")).alias("extension"))


@check("inventory_rollup", f"""WITH {PAGES} SELECT {EXTENSION} AS extension, CAST(count(*) AS BIGINT) AS files, CAST(sum(bytes) AS BIGINT) AS bytes,
  CAST(count(DISTINCT sha256) AS BIGINT) AS unique_contents FROM pg GROUP BY 1""")
def inventory_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return C.inventory_rollup(pages(spark, sf))


@check("manifest_diff", f"""WITH {PAGES}, act AS (SELECT path, max(bytes) AS bytes, max(sha256) AS sha256 FROM pg GROUP BY 1),
  man AS (SELECT path, CASE WHEN path LIKE '%.net/%' THEN bytes + 1 ELSE bytes END AS bytes, sha256 FROM act WHERE path NOT LIKE 'http://%'
    UNION ALL SELECT path || '.old', bytes, sha256 FROM act WHERE path LIKE '%.org/%')
SELECT coalesce(man.path, act.path) AS path, man.bytes AS expected_bytes, act.bytes AS actual_bytes,
  CASE WHEN act.path IS NULL THEN 'missing' WHEN man.path IS NULL THEN 'extra' WHEN man.bytes <> act.bytes THEN 'changed' ELSE 'same' END AS status
FROM man FULL OUTER JOIN act ON act.path = man.path""")
def manifest_diff(spark: SparkSession, sf: str) -> DataFrame:
    """The manifest lacks the plain http pages, has other sizes for .net hosts and lists vanished .org pages."""
    actual = pages(spark, sf).groupBy("path").agg(F.max("bytes").alias("bytes"), F.max("sha256").alias("sha256"))
    size = F.when(F.col("path").contains(".net/"), F.col("bytes") + 1).otherwise(F.col("bytes"))
    listed = actual.filter(~F.col("path").startswith("http://")).withColumn("bytes", size)
    vanished = actual.filter(F.col("path").contains(".org/")).withColumn("path", F.concat("path", F.lit(".old")))
    return C.manifest_diff(listed.unionByName(vanished), actual)


# ---------------------------------------------------------------- alignment, lineage, coverage

@check("positional_join", f"""
WITH {LI}, n AS (SELECT record_id, max(r) AS m, s_nationkey AS k FROM li JOIN supplier ON s_suppkey = record_id GROUP BY 1, 3)
SELECT record_id, m AS "row", 'missing_context' AS issue FROM n WHERE k < 5
UNION ALL SELECT record_id, CAST(7 AS BIGINT), 'time_differs' FROM n WHERE k BETWEEN 5 AND 9
UNION ALL SELECT record_id, m + 1, 'missing_telemetry' FROM n WHERE k BETWEEN 10 AND 14""")
def positional_join(spark: SparkSession, sf: str) -> DataFrame:
    """Context tables with a lost last row, a shifted time or a surplus row, by the nation of the supplier."""
    rows = line_rows(spark, sf)
    nation = table(spark, sf, "supplier").select(F.col("s_suppkey").alias(RECORD), F.col("s_nationkey").alias("k"))
    context = rows.select(RECORD, "row", "time_s", *LINE_CONTEXT).join(extents(rows).select(RECORD, "end_row"), RECORD).join(nation, RECORD)
    k, last = F.col("k"), F.col("row") == F.col("end_row") - 1
    kept = context.filter(~((k < 5) & last)).withColumn(
        "time_s", F.when(k.between(5, 9) & (F.col("row") == 7), F.col("time_s") + 60).otherwise(F.col("time_s"))
    )
    surplus = context.filter(k.between(10, 14) & last).withColumn("row", F.col("row") + 1)
    damaged = kept.unionByName(surplus).drop("end_row", "k")
    _, violations = C.positional_join(rows.select(RECORD, "row", "time_s", "l_quantity"), damaged)
    return violations


@check("lineage_conflicts", """
WITH s AS (SELECT doc_id, source AS g, CASE lang WHEN 'en' THEN 'train' WHEN 'de' THEN 'validation' ELSE 'test' END AS split, sha256(text) AS h FROM documents)
SELECT 'group_in_several_splits' AS violation, g AS key, CAST(count(DISTINCT split) AS BIGINT) AS n FROM s GROUP BY 2 HAVING count(DISTINCT split) > 1
UNION ALL SELECT 'same_bytes_different_lineage', h, CAST(count(DISTINCT g || '|' || split) AS BIGINT) FROM s GROUP BY 2 HAVING count(DISTINCT g || '|' || split) > 1
UNION ALL SELECT 'duplicate_id', CAST(doc_id AS VARCHAR), CAST(count(*) AS BIGINT) FROM s GROUP BY 2 HAVING count(*) > 1""")
def lineage_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    split = F.when(F.col("lang") == "en", "train").when(F.col("lang") == "de", "validation").otherwise("test")
    sources = table(spark, sf, "documents").select(
        F.col("doc_id").alias("source_id"), F.col("source").alias("lineage_group"), split.alias("split"), sha().alias("sha256")
    )
    return C.lineage_conflicts(sources)


@check("coverage_check", """
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, coalesce(d.n, 0) AS n_left, coalesce(l.n, 0) AS n_right,
  CASE WHEN d.n IS NULL THEN 'extra' WHEN l.n IS NULL THEN 'missing' WHEN d.n > 1 OR l.n > 1 THEN 'repeated' ELSE 'ok' END AS status
FROM (SELECT doc_id, count(*) AS n FROM documents GROUP BY 1) d FULL OUTER JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id""")
def coverage_check(spark: SparkSession, sf: str) -> DataFrame:
    return C.coverage(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"])


@check("dangling_references", """
SELECT 'label_without_document' AS issue, doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'document_without_label', doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def dangling_references(spark: SparkSession, sf: str) -> DataFrame:
    documents, labels = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id")
    lost = C.dangling(labels, documents, ["doc_id"]).select(F.lit("label_without_document").alias("issue"), "doc_id")
    return lost.unionByName(C.dangling(documents, labels, ["doc_id"]).select(F.lit("document_without_label").alias("issue"), "doc_id"))


@check("private_label_isolation", """
SELECT d.doc_id, lang, source, n_chars, l.doc_id IS NOT NULL AS has_private_label FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def private_label_isolation(spark: SparkSession, sf: str) -> DataFrame:
    """Public document columns and whether a label exists; label values are never read."""
    public = R.public_view(table(spark, sf, "documents"), ["doc_id", "lang", "source", "n_chars"])
    labelled = table(spark, sf, "labels").select("doc_id", F.lit(True).alias("_l"))
    return public.join(labelled, "doc_id", "left").select(*public.columns, F.coalesce("_l", F.lit(False)).alias("has_private_label"))


@check("content_digest", """
SELECT doc_id, sha256(text) AS sha256, 'F_' || substr(sha256(text), 1, 16) AS fact_id, 'O_' || substr(sha256(concat_ws(chr(31), lang, source)), 1, 20) AS origin_id
FROM documents""")
def content_digest(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", sha().alias("sha256"), S.digest_id("F_", F.col("text")).alias("fact_id"),
        S.digest_id("O_", F.col("lang"), F.col("source"), length=20).alias("origin_id"),
    )


@check("duplicate_keys", "SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    return C.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@check("identical_texts", """
SELECT sha256(text) AS sha256, CAST(count(*) AS BIGINT) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1""")
def identical_texts(spark: SparkSession, sf: str) -> DataFrame:
    groups = table(spark, sf, "documents").groupBy(sha().alias("sha256")).agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")
    )
    return groups.filter(F.col("n") > 1)


@check("source_groups", f"WITH {ORD} SELECT record_id AS series_id, r AS position, o_orderkey AS member FROM od")
def source_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered members of each series, one row per member so that a long series never becomes one value."""
    return order_rows(spark, sf).select(
        F.col(RECORD).alias("series_id"), F.col("row").alias("position"), F.col("o_orderkey").alias("member")
    )


@check("structural_duplicates", """
WITH m AS (SELECT l_orderkey, string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)) AS m,
    string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS c FROM lineitem GROUP BY 1),
  s AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, coalesce(m, '') AS members, coalesce(c, '') AS checks FROM orders LEFT JOIN m ON l_orderkey = o_orderkey)
SELECT sha256(concat_ws('|', o_orderstatus, o_orderpriority, members, checks)) AS signature, o_orderstatus, o_orderpriority, members, checks,
  CAST(count(*) AS BIGINT) AS n, min(o_orderkey) AS "first" FROM s GROUP BY 1, 2, 3, 4, 5 HAVING count(*) > 1""")
def structural_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_returnflag")
    kind = ["o_orderstatus", "o_orderpriority"]
    return C.structural_duplicates(table(spark, sf, "orders"), lines, "o_orderkey", kind, "l_linenumber", lines, "l_returnflag")


@check("unique_match", """
SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS matches, CASE count(o_orderkey) WHEN 0 THEN 'none' WHEN 1 THEN 'unique' ELSE 'ambiguous' END AS status
FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY 1""")
def unique_match(spark: SparkSession, sf: str) -> DataFrame:
    urgent = table(spark, sf, "orders").filter(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("c_custkey"))
    return C.unique_match(table(spark, sf, "customer").select("c_custkey"), urgent, "c_custkey")


@check("scope_intersection", """
SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_custkey IN (SELECT o_custkey FROM orders)""")
def scope_intersection(spark: SparkSession, sf: str) -> DataFrame:
    allowed = table(spark, sf, "customer").filter(F.col("c_acctbal") > 0).select("c_custkey")
    known = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return allowed.join(known, "c_custkey", "left_semi")


@check("disjoint_union", """
SELECT CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS n_old, CAST(count(*) FILTER (o_orderstatus <> 'F') AS BIGINT) AS n_new,
  CAST(count(*) - count(DISTINCT o_orderkey) AS BIGINT) AS repeated, min(o_orderkey) AS first_id, max(o_orderkey) AS last_id,
  count(DISTINCT o_orderkey) = max(o_orderkey) - min(o_orderkey) + 1 AS complete FROM orders""")
def disjoint_union(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    old = orders.filter(F.col("o_orderstatus") == "F").select("o_orderkey", F.lit(True).alias("old"))
    new = orders.filter(F.col("o_orderstatus") != "F").select("o_orderkey", F.lit(False).alias("old"))
    per_id = old.unionByName(new).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if("old").alias("n_old"))
    return per_id.agg(
        F.sum("n_old").alias("n_old"), (F.sum("n") - F.sum("n_old")).alias("n_new"), (F.sum("n") - F.count(F.lit(1))).alias("repeated"),
        F.min("o_orderkey").alias("first_id"), F.max("o_orderkey").alias("last_id"),
        (F.count(F.lit(1)) == F.max("o_orderkey") - F.min("o_orderkey") + 1).alias("complete"),
    )


@check("version_overlay", """
WITH b AS (SELECT o_orderkey, o_totalprice AS v FROM orders WHERE o_orderpriority <> '5-LOW'),
  r AS (SELECT o_orderkey, o_totalprice * 2 AS v FROM orders WHERE o_orderstatus = 'P')
SELECT coalesce(b.o_orderkey, r.o_orderkey) AS o_orderkey, coalesce(r.v, b.v) AS price,
  CASE WHEN b.o_orderkey IS NULL THEN 'unknown_key' WHEN r.o_orderkey IS NOT NULL THEN 'replacement' ELSE 'base' END AS origin
FROM b FULL OUTER JOIN r ON r.o_orderkey = b.o_orderkey""")
def version_overlay(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").withColumn("price", F.col("o_totalprice"))
    replacement = orders.filter(F.col("o_orderstatus") == "P").withColumn("price", F.col("o_totalprice") * 2)
    return R.overlay(orders.filter(F.col("o_orderpriority") != "5-LOW"), replacement, "o_orderkey", "price")


@check("changed_only_in", """
SELECT o_orderkey, o_orderstatus <> 'P' AND o_totalprice <= 200000 AS allowed FROM orders
WHERE o_orderstatus = 'P' OR o_orderpriority = '4-NOT SPECIFIED' OR o_totalprice > 200000""")
def changed_only_in(spark: SparkSession, sf: str) -> DataFrame:
    """A later version renames one priority everywhere (allowed), changes the customer of pending orders and lacks dear ones (not allowed)."""
    before = table(spark, sf, "orders")
    renamed = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "4-NONE").otherwise(F.col("o_orderpriority"))
    moved = F.when(F.col("o_orderstatus") == "P", F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))
    after = before.withColumns({"o_orderpriority": renamed, "o_custkey": moved}).filter(F.col("o_totalprice") <= 200_000)
    return R.changed_only_in(before, after, "o_orderkey", "o_orderpriority")


@check("contract_violations", """
WITH v AS (SELECT o_orderkey, 'status_enum' AS rule, o_orderstatus IN ('O', 'F') AS ok FROM orders
  UNION ALL SELECT o_orderkey, 'price_range', o_totalprice BETWEEN 1000 AND 400000 FROM orders
  UNION ALL SELECT o_orderkey, 'identifier', regexp_matches(o_orderpriority, '^[A-Za-z][A-Za-z0-9_-]{0,79}$') FROM orders
  UNION ALL SELECT o_orderkey, 'prefixed_identifier', regexp_matches('O_' || o_orderkey, '^[A-Za-z][A-Za-z0-9_-]{0,79}$') FROM orders)
SELECT o_orderkey, rule FROM v WHERE NOT ok""")
def contract_violations(spark: SparkSession, sf: str) -> DataFrame:
    return C.rule_violations(table(spark, sf, "orders"), "o_orderkey", {
        "status_enum": F.col("o_orderstatus").isin("O", "F"),
        "price_range": F.col("o_totalprice").between(1000, 400_000),
        "identifier": C.is_identifier(F.col("o_orderpriority")),
        "prefixed_identifier": C.is_identifier(F.concat(F.lit("O_"), F.col("o_orderkey").cast("string"))),
    })


@check("task_category", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' OR o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN 'basic' ELSE 'investigation' END AS category FROM orders""")
def task_category(spark: SparkSession, sf: str) -> DataFrame:
    basic = (F.col("o_orderstatus") == "F") | F.col("o_orderpriority").isin("4-NOT SPECIFIED", "5-LOW")
    return table(spark, sf, "orders").select("o_orderkey", F.when(basic, "basic").otherwise("investigation").alias("category"))


CASES = """src AS (SELECT l_suppkey AS source_id, count(*) AS n_rows FROM lineitem GROUP BY 1),
  ca AS (SELECT o_orderkey AS case_id, CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'P' THEN 'merged' ELSE 'draft' END AS status,
    CASE WHEN o_orderpriority = '5-LOW' THEN 'stale' ELSE 'fresh' END AS rev, CASE WHEN o_orderpriority = '3-MEDIUM' THEN o_orderkey ELSE o_custkey END AS target,
    o_orderpriority, o_totalprice AS price, o_custkey AS owner FROM orders),
  fa AS (SELECT l_orderkey AS case_id, l_linenumber AS fact_id, l_suppkey AS source_id, CAST(l_quantity AS BIGINT) * 10 AS a,
    CAST(l_quantity AS BIGINT) * 10 + l_linenumber * 20 AS b FROM lineitem)"""


def statements(price) -> dict:
    """What a case states about itself, each statement wrong in one range of prices."""
    unless = lambda low, high, good, bad: F.when(price.between(low, high), F.lit(bad)).otherwise(F.lit(good))
    return {
        "reviewer": F.when(price > 300_000, F.lit(" ")).otherwise(F.lit("someone")), "rationale": F.lit("rows read"), "independence": F.lit("other team"),
        "blocking_issues": F.when(price < 20_000, 1).otherwise(0), "disposition": unless(20_000, 30_000, "core", "shelved"),
        "leakage_review": unless(30_000, 40_000, "passed", "open"), "record_selection": unless(40_000, 50_000, "first rows", ""),
        "verification": unless(50_000, 60_000, "passed", "failed"), "report_sha": F.lit("r1"), "report_found_sha": unless(60_000, 70_000, "r1", "r2"),
        "facts_sha": F.lit("f1"), "checked_facts_sha": unless(70_000, 80_000, "f1", "f0"),
    }


@check("case_record_gates", f"""
WITH {CASES}, v AS (SELECT case_id, 'rows_out_of_scope' AS rule FROM fa JOIN src USING (source_id) WHERE NOT (a >= 0 AND a < b AND b <= n_rows)
  UNION ALL SELECT case_id, 'duplicate_fact' FROM fa GROUP BY case_id, fact_id HAVING count(*) > 1
  UNION ALL SELECT case_id, 'unknown_claim_evidence' FROM ca WHERE NOT EXISTS (SELECT 1 FROM fa WHERE fa.case_id = ca.case_id AND fact_id = 1) AND o_orderpriority <> '2-HIGH'
  UNION ALL SELECT case_id, 'assessed_claim_without_evidence' FROM ca WHERE o_orderpriority = '2-HIGH'
  UNION ALL SELECT case_id, 'missing_or_stale_review' FROM ca WHERE status IN ('accepted', 'merged') AND rev = 'stale'
  UNION ALL SELECT case_id, 'merge_needs_other_target' FROM ca WHERE status = 'merged' AND target = case_id
  UNION ALL SELECT case_id, 'accepted_without_facts' FROM ca WHERE status = 'accepted' AND case_id NOT IN (SELECT case_id FROM fa)
  UNION ALL SELECT case_id, 'accepted_without_windows' FROM ca WHERE status = 'accepted' AND case_id NOT IN (SELECT case_id FROM fa)
  UNION ALL SELECT case_id, 'review_provenance_missing' FROM ca WHERE status IN ('accepted', 'merged') AND price > 300000
  UNION ALL SELECT case_id, 'blocking_issues_open' FROM ca WHERE status = 'accepted' AND price < 20000
  UNION ALL SELECT case_id, 'disposition_not_released' FROM ca WHERE status = 'accepted' AND price BETWEEN 20000 AND 30000
  UNION ALL SELECT case_id, 'leakage_review_not_passed' FROM ca WHERE status = 'accepted' AND price BETWEEN 30000 AND 40000
  UNION ALL SELECT case_id, 'record_selection_missing' FROM ca WHERE status = 'accepted' AND price BETWEEN 40000 AND 50000
  UNION ALL SELECT case_id, 'verification_not_bound' FROM ca WHERE status = 'accepted' AND price BETWEEN 50000 AND 60000
  UNION ALL SELECT case_id, 'report_changed' FROM ca WHERE status = 'accepted' AND price BETWEEN 60000 AND 70000
  UNION ALL SELECT case_id, 'facts_not_as_checked' FROM ca WHERE status = 'accepted' AND price BETWEEN 70000 AND 80000
  UNION ALL SELECT DISTINCT case_id, 'unverified_fact' FROM fa JOIN ca USING (case_id) WHERE status = 'accepted' AND a = 10
  UNION ALL SELECT DISTINCT case_id, 'unverified_alignment' FROM fa JOIN ca USING (case_id) WHERE status = 'accepted' AND source_id = owner AND o_orderpriority <> '4-NOT SPECIFIED'
  UNION ALL SELECT DISTINCT case_id, 'undeclared_source' FROM fa WHERE NOT EXISTS (SELECT 1 FROM fa g WHERE g.case_id = fa.case_id AND g.source_id = fa.source_id AND fact_id <> 7)
  UNION ALL SELECT DISTINCT case_id, 'artifact_coverage' FROM fa JOIN ca USING (case_id) WHERE CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN fact_id <> 7
    ELSE NOT EXISTS (SELECT 1 FROM fa g WHERE g.case_id = fa.case_id AND g.source_id = fa.source_id AND fact_id <> 7) END
  UNION ALL SELECT case_id, 'rows_out_of_scope' FROM (SELECT case_id, source_id, min(a) AS a, max(b) AS b FROM fa GROUP BY 1, 2) JOIN src USING (source_id) WHERE NOT b <= n_rows)
SELECT case_id, rule, CAST(count(*) AS BIGINT) AS n FROM v GROUP BY 1, 2""")
def case_record_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as cases, order lines as facts over suppliers as sources, one claim per order on its first line."""
    priority = F.col("o_orderpriority")
    content = F.sha2(F.concat_ws("|", "o_orderkey", "o_totalprice"), 256)
    status = F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "P", "merged").otherwise("draft")
    decision = F.when(F.col("o_orderstatus") == "F", "accept").when(F.col("o_orderstatus") == "P", "merge")
    orders = table(spark, sf, "orders")
    cases = orders.select(
        F.col("o_orderkey").alias("case_id"), status.alias("status"), decision.alias("decision"), content.alias("content_sha"),
        F.when(priority == "5-LOW", F.sha2(F.lit("earlier"), 256)).otherwise(content).alias("reviewed_sha"),
        F.when(priority == "3-MEDIUM", F.col("o_orderkey")).otherwise(F.col("o_custkey")).alias("merge_into"),
        *[said.alias(name) for name, said in statements(F.col("o_totalprice")).items()],
    )
    lines = table(spark, sf, "lineitem")
    start = F.col("l_quantity").cast("bigint") * 10
    facts = lines.select(
        F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("fact_id"), F.col("l_suppkey").alias("source_id"),
        start.alias("start_row"), (start + F.col("l_linenumber") * 20).alias("stop_row"),
        F.when(F.col("l_quantity").cast("bigint") == 1, "open").otherwise("passed").alias("verification_status"),
    )
    windows = facts.groupBy("case_id", "source_id").agg(F.min("start_row").alias("start_row"), F.max("stop_row").alias("stop_row"))
    placed = windows.join(orders.select(F.col("o_orderkey").alias("case_id"), "o_custkey", "o_orderpriority"), "case_id").filter(
        F.col("o_orderpriority") != "4-NOT SPECIFIED"
    )
    aligned = F.when(F.col("source_id") == F.col("o_custkey"), "unverified").otherwise("row")
    artifacts = placed.select("case_id", "source_id", aligned.alias("alignment"))
    claims = orders.select(
        F.col("o_orderkey").alias("case_id"), F.lit("first").alias("claim_id"), F.lit("supported").alias("verdict"),
        F.when(priority != "2-HIGH", F.lit(1)).alias("fact_id"),
    )
    sources = lines.groupBy(F.col("l_suppkey").alias("source_id")).agg(F.count(F.lit(1)).alias("n_rows"))
    declared = facts.filter(F.col("fact_id") != 7).select("case_id", "source_id").distinct()
    return C.case_gates(cases, facts, claims, sources, artifacts, windows, declared)


@check("bundle_gates", """
WITH tk AS (SELECT o_orderkey AS task_id, o_custkey AS bundle_id, o_orderstatus AS kind, o_orderpriority = '1-URGENT' AS guided, o_orderkey % 3 AS nd FROM orders),
  ci AS (SELECT l_orderkey AS task_id, l_linenumber AS fact_id, l_returnflag || l_linestatus AS k FROM lineitem),
  rv AS (SELECT bundle_id, task_id, kind = 'F' AS ok, task_id % 5 = 0 AS blocking FROM tk WHERE task_id % 11 <> 0
    UNION ALL SELECT bundle_id, task_id, false, false FROM tk WHERE task_id % 13 = 0 UNION ALL SELECT bundle_id, task_id + 1000000000, false, false FROM tk WHERE task_id % 17 = 0),
  st AS (SELECT bundle_id, kind, task_id, string_agg(DISTINCT CAST(fact_id AS VARCHAR), ',' ORDER BY CAST(fact_id AS VARCHAR)) AS f FROM tk LEFT JOIN ci USING (task_id) GROUP BY 1, 2, 3),
  v AS (SELECT task_id, 'unknown_task' AS rule FROM ci WHERE task_id NOT IN (SELECT task_id FROM tk)
    UNION ALL SELECT task_id, 'no_evidence' FROM tk WHERE task_id NOT IN (SELECT task_id FROM ci)
    UNION ALL SELECT task_id, 'unknown_fact' FROM ci JOIN tk USING (task_id) WHERE fact_id = 7
    UNION ALL SELECT min(task_id), 'repeated_structure' FROM st GROUP BY bundle_id, kind, f HAVING count(*) > 1
    UNION ALL SELECT task_id, 'repeated_answer_key' FROM ci GROUP BY task_id, k HAVING count(*) > 1
    UNION ALL SELECT task_id, 'investigation_without_decisions' FROM tk WHERE guided AND nd = 0
    UNION ALL SELECT task_id, 'not_reviewed' FROM tk WHERE task_id NOT IN (SELECT task_id FROM rv)
    UNION ALL SELECT task_id, 'reviewed_more_than_once' FROM rv GROUP BY bundle_id, task_id HAVING count(*) > 1
    UNION ALL SELECT task_id, 'review_of_unknown_task' FROM rv WHERE task_id NOT IN (SELECT task_id FROM tk)
    UNION ALL SELECT task_id, 'blocking_issue_overridden' FROM rv WHERE ok AND blocking)
SELECT DISTINCT task_id, rule FROM v""")
def bundle_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as tasks of the bundle of their customer, lines as cited and checked facts, of which a bundle has six."""
    key = F.col("task_id")
    tasks = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("bundle_id"), F.col("o_orderstatus").alias("task_type"),
        (F.col("o_orderpriority") == "1-URGENT").alias("guided"), (F.col("o_orderkey") % 3).alias("n_decisions"),
    )
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").cast("int").alias("fact_id"), F.concat("l_returnflag", "l_linestatus").alias("answer_key")
    )
    facts = tasks.select("bundle_id").distinct().withColumn("fact_id", F.explode(F.sequence(F.lit(1), F.lit(6))))
    review = lambda df, decision, n: df.select("bundle_id", "task_id", decision.alias("decision"), n.alias("n_blocking"))
    revise, none = F.lit("revise"), F.lit(0)
    reviews = review(tasks.filter(key % 11 != 0), F.when(F.col("task_type") == "F", "accept").otherwise("revise"), F.when(key % 5 == 0, 1).otherwise(0))
    reviews = reviews.unionByName(review(tasks.filter(key % 13 == 0), revise, none))
    reviews = reviews.unionByName(review(tasks.filter(key % 17 == 0).withColumn("task_id", key + 1_000_000_000), revise, none))
    return C.bundle_gates(tasks, lines.select("task_id", "fact_id"), facts, lines, reviews)


# ---------------------------------------------------------------- release

@check("public_projection", "SELECT doc_id, lang, source, n_chars FROM documents")
def public_projection(spark: SparkSession, sf: str) -> DataFrame:
    return R.public_view(table(spark, sf, "documents"), ["doc_id", "lang", "source", "n_chars"])


@check("redacted_view", """
SELECT source, CAST(count(*) AS BIGINT) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages FROM documents GROUP BY 1""")
def redacted_view(spark: SparkSession, sf: str) -> DataFrame:
    """What an author may see of a source: totals and languages, no text and no ids."""
    return table(spark, sf, "documents").groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"),
        F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("languages"),
    )


# Lower case with the characters that fold to more than one, and both forms of sigma as one.
FOLD = "replace(replace(replace(replace(lower({0}), 'ß', 'ss'), 'ﬁ', 'fi'), 'ﬆ', 'st'), 'ς', 'σ')"
# Tokens as another hand may have typed them: sharp s for ss, ligatures for their letters.
TYPED = "CASE item_id % 3 WHEN 0 THEN replace(text, 'ss', 'ß') WHEN 1 THEN replace(text, 'fi', 'ﬁ') ELSE replace(text, 'st', 'ﬆ') END"


@check("leak_scan", f"""
WITH d AS (SELECT doc_id, {FOLD.format('text')} AS t FROM documents), b AS (SELECT item_id, {FOLD.format(TYPED)} AS t FROM benchmark)
SELECT d.doc_id, b.item_id AS token_id FROM d JOIN b ON contains(d.t, b.t)""")
def leak_scan(spark: SparkSession, sf: str) -> DataFrame:
    tokens = table(spark, sf, "benchmark").select(F.col("item_id").alias("token_id"), F.expr(TYPED).alias("token"))
    return R.leak_hits(table(spark, sf, "documents"), tokens)


@check("private_token_scan", """
SELECT doc_id, contains(lower(text), 'expected_verdict') OR contains(lower(text), 'expected_value') OR contains(lower(text), 'source_hashes')
  OR contains(lower(text), 'telemetry_path') OR contains(lower(text), 'anomalylabel') AS leaks FROM documents""")
def private_token_scan(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", R.built_in_leaks(F.col("text")).alias("leaks"))


@check("style_screen", rf"""
WITH s AS (SELECT doc_id, text, source, len(list_filter(regexp_split_to_array(text, '{R.SENTENCE_ENDS}'), lambda x: regexp_matches(x, '\S'))) AS n FROM documents)
SELECT doc_id, 'too_long' AS rule FROM s WHERE length(text) > {R.PROMPT_CHARS} OR length(source) > {R.TITLE_CHARS}
UNION ALL SELECT doc_id, 'scaffolding' FROM s WHERE regexp_matches(source || ' ' || text,
  '{R.SCAFFOLDING}')
UNION ALL SELECT doc_id, 'not_one_sentence' FROM s WHERE n <> 1""")
def style_screen(spark: SparkSession, sf: str) -> DataFrame:
    return R.style_errors(table(spark, sf, "documents"), "doc_id", "source", "text")


@check("provenance_match", """
SELECT doc_id, sha256(text) IN (SELECT sha256(text) FROM documents WHERE lang = 'en') AS logged FROM documents""")
def provenance_match(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents").select("doc_id", "lang", "text")
    return R.provenance(documents, documents.filter(F.col("lang") == "en"), "text").select("doc_id", "logged")


REVIEWS = """rv AS (SELECT l.doc_id, CASE WHEN toxic = 1 THEN 'reject' ELSE 'accept' END AS decision,
    CASE WHEN quality = 0 THEN sha256(text || ' ') ELSE sha256(text) END AS h FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""


def reviews(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Reviews of the labelled documents; those of low quality were made on an earlier text."""
    documents = table(spark, sf, "documents").select("doc_id", "text")
    judged = table(spark, sf, "labels").join(documents, "doc_id").select(
        "doc_id", F.when(F.col("toxic") == 1, "reject").otherwise("accept").alias("decision"),
        F.when(F.col("quality") == 0, F.sha2(F.concat("text", F.lit(" ")), 256)).otherwise(sha()).alias("reviewed_sha"),
    )
    return documents, judged


@check("stale_reviews", f"""WITH {REVIEWS}
SELECT d.doc_id, CASE WHEN h IS NULL THEN 'missing' WHEN h <> sha256(text) THEN 'stale' WHEN decision <> 'accept' THEN 'not_accepted' ELSE 'bound' END AS status
FROM documents d LEFT JOIN rv ON rv.doc_id = d.doc_id""")
def stale_reviews(spark: SparkSession, sf: str) -> DataFrame:
    documents, judged = reviews(spark, sf)
    return R.review_binding(documents, judged, "doc_id", "text")


PARTS = """pt AS (SELECT doc_id, sha256(text) AS proposal, sha256(concat_ws('|', lang, source)) AS public, sha256(source) AS material, sha256(CAST(n_chars AS VARCHAR)) AS rubric FROM documents),
  rp AS (SELECT l.doc_id, CASE WHEN toxic = 1 THEN 'reject' ELSE 'accept' END AS decision, CASE WHEN l.doc_id % 9 = 0 THEN 1 ELSE 0 END AS nb,
    concat_ws(',', CASE WHEN quality = 0 THEN 'proposal' END, CASE WHEN l.doc_id % 5 = 0 THEN 'public' END, CASE WHEN l.doc_id % 7 = 0 THEN 'rubric' END) AS stale FROM labels l),
  bp AS (SELECT d.doc_id, CASE WHEN rp.doc_id IS NULL THEN 'missing' WHEN stale <> '' THEN 'stale' WHEN decision <> 'accept' OR nb > 0 THEN 'not_accepted' ELSE 'bound' END AS status,
    coalesce(stale, '') AS stale FROM documents d LEFT JOIN rp USING (doc_id))"""
PART_NAMES = ["proposal", "public", "material", "rubric"]


def reviewed_parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Digests of the parts of each document, and reviews made when some of them were different."""
    hashed = lambda c: F.sha2(c, 256)
    items = table(spark, sf, "documents").select(
        "doc_id", hashed(F.col("text")).alias("proposal"), hashed(F.concat_ws("|", "lang", "source")).alias("public"), hashed(F.col("source")).alias("material"),
        hashed(F.col("n_chars").cast("string")).alias("rubric"),
    )
    old, key = F.repeat(F.lit("0"), 64), F.col("doc_id")
    judged = table(spark, sf, "labels").join(items, "doc_id").select(
        "doc_id", F.when(F.col("toxic") == 1, "reject").otherwise("accept").alias("decision"), F.when(key % 9 == 0, 1).otherwise(0).alias("blocking_issues"),
        F.lit("read").alias("rationale"), F.when(F.col("quality") == 0, old).otherwise(F.col("proposal")).alias("proposal"),
        F.when(key % 5 == 0, old).otherwise(F.col("public")).alias("public"), "material", F.when(key % 7 == 0, old).otherwise(F.col("rubric")).alias("rubric"),
    )
    return items, judged


@check("review_parts", f"WITH {PARTS} SELECT doc_id, status, stale FROM bp")
def review_parts(spark: SparkSession, sf: str) -> DataFrame:
    items, judged = reviewed_parts(spark, sf)
    return R.bound_parts(items, judged, "doc_id", PART_NAMES)


@check("review_outcomes", f"""WITH {PARTS} SELECT doc_id, status, stale, CASE WHEN status <> 'bound' THEN 'review_' || status WHEN doc_id % 2 = 0 THEN 'unverified'
  WHEN doc_id % 3 = 0 THEN 'verification_failed' WHEN doc_id % 11 = 1 THEN 'verification_stale' WHEN doc_id % 13 = 1 THEN 'sources_changed' ELSE 'final' END AS outcome FROM bp""")
def review_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Bound reviews joined with raw verifications, of which some are absent, failed, made on other material or on sources that changed."""
    items, judged = reviewed_parts(spark, sf)
    key = F.col("doc_id")
    checked = items.filter(key % 2 != 0).select(
        "doc_id", (key % 3 != 0).alias("all_passed"), (key % 13 == 1).alias("sources_changed"), "rubric",
        F.when(key % 11 == 1, "").otherwise(F.col("material")).alias("material"),
    )
    return R.finalised(R.bound_parts(items, judged, "doc_id", PART_NAMES), checked, items, "doc_id", ["material", "rubric"])


@check("publication_gates", """
WITH t AS (SELECT row_number() OVER (ORDER BY doc_id) AS p, doc_id, sha256(text) AS h FROM documents), n AS (SELECT *, CASE WHEN p < 10 THEN 'T0' ELSE 'T' END || p AS id FROM t)
SELECT CASE WHEN p % 10 = 4 THEN 'T' || (p + 1000000) ELSE id END AS task_id, rule FROM n, (VALUES ('out_of_order'), ('provenance_count_differs'), ('unexpected_fields'), ('differs_from_approved')) v(rule)
WHERE CASE rule WHEN 'out_of_order' THEN p % 10 = 4 WHEN 'provenance_count_differs' THEN p % 10 IN (4, 5, 6) WHEN 'unexpected_fields' THEN p % 10 = 7 ELSE p % 10 IN (4, 8) END
UNION ALL SELECT id, 'provenance_without_task' FROM n WHERE p % 10 = 4""")
def publication_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as numbered tasks; by the last digit of the number: 4 is misnamed, 5 lacks its provenance, 6 has it twice, 7 has a private field, 8 differs."""
    numbered = written(number_rows(table(spark, sf, "documents").select("doc_id", sha().alias("content"), F.lit(0).alias(RECORD)), ["doc_id"]), "numbered")
    position = F.col("row") + 1
    named = numbered.select(F.concat(F.when(position < 10, F.lit("T0")).otherwise(F.lit("T")), position.cast("string")).alias("task_id"), position.alias("position"), "content")
    digit = F.col("position") % 10
    origins = named.filter(digit != 5).select("task_id").unionByName(named.filter(digit == 6).select("task_id"))
    approved = named.withColumn("content", F.when(digit == 8, "").otherwise(F.col("content"))).select("task_id", "content")
    public = ["prompt", "task_id", "title"]
    shown = F.array(*[F.lit(c) for c in public])
    tasks = named.withColumns({
        "task_id": F.when(digit == 4, F.concat(F.lit("T"), (F.col("position") + 1_000_000).cast("string"))).otherwise(F.col("task_id")),
        "fields": F.when(digit == 7, F.array_append(shown, F.lit("source_hashes"))).otherwise(shown),
    })
    return R.publication_gates(tasks, origins, public, approved)


def nested_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their lines inside, private fields at three depths."""
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("int").alias("line"), F.col("l_partkey").alias("part"),
        F.struct(F.col("l_suppkey").alias("supplier"), F.col("l_returnflag").alias("expected_verdict")).alias("origin"),
        F.when(F.col("l_quantity") > 45, F.lit(float("inf"))).when(F.col("l_quantity") < 5, F.lit(float("nan"))).otherwise(F.col("l_quantity")).alias("quantity"),
    )
    held = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("line", "part", "origin", "quantity"))).alias("lines"))
    return table(spark, sf, "orders").select("o_orderkey", F.struct(F.col("o_custkey").alias("customer"), F.col("o_totalprice").alias("expected_value")).alias("head")).join(held, "o_orderkey")


@check("pruned_view", """
SELECT o_orderkey, o_custkey AS customer, 'customer' AS head_fields, 'line,part,origin,quantity' AS line_fields, 'supplier' AS origin_fields,
  CAST(l_linenumber AS INTEGER) AS line, l_partkey AS part, l_suppkey AS supplier FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def pruned_view(spark: SparkSession, sf: str) -> DataFrame:
    """Private fields dropped at every depth by one rule over the schema; what is left, and the names that are left."""
    view = N.pruned(nested_orders(spark, sf), ["expected_value", "expected_verdict"])
    lines = view.schema["lines"].dataType.elementType
    names = lambda kind: F.lit(",".join(kind.fieldNames()))
    return view.select("o_orderkey", "head.customer", names(view.schema["head"].dataType).alias("head_fields"), names(lines).alias("line_fields"),
                       names(lines["origin"].dataType).alias("origin_fields"), F.explode("lines").alias("x")).select(
        "o_orderkey", "customer", "head_fields", "line_fields", "origin_fields", "x.line", "x.part", "x.origin.supplier")


@check("cleaned_view", """
SELECT o_orderkey, o_totalprice AS expected_value, CAST(l_linenumber AS INTEGER) AS line, l_returnflag AS verdict,
  CASE WHEN l_quantity BETWEEN 5 AND 45 THEN l_quantity END AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def cleaned_view(spark: SparkSession, sf: str) -> DataFrame:
    """NaN and infinity become null at every depth; nothing else changes."""
    view = N.cleaned(nested_orders(spark, sf)).select("o_orderkey", "head.expected_value", F.explode("lines").alias("x"))
    return view.select("o_orderkey", "expected_value", "x.line", F.col("x.origin.expected_verdict").alias("verdict"), "x.quantity")


@check("numeric_id_sort", """
SELECT CASE WHEN doc_id < 10 THEN 'T0' ELSE 'T' END || doc_id AS task_id, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents""")
def numeric_id_sort(spark: SparkSession, sf: str) -> DataFrame:
    """Order ids like T07 and T100 by their number; positions come from block counts, not from one sorted task."""
    name = F.when(F.col("doc_id") < 10, F.concat(F.lit("T0"), F.col("doc_id").cast("string"))).otherwise(
        F.concat(F.lit("T"), F.col("doc_id").cast("string"))
    )
    named = table(spark, sf, "documents").select(name.alias("task_id"), F.lit(0).alias(RECORD))
    number = F.substring("task_id", 2, 20).cast("bigint")
    numbered = number_rows(named.withColumn("n", number), ["n"])
    return numbered.select("task_id", F.col("row").alias("position"))


@check("publication_check", f"""WITH {REVIEWS}, s AS (SELECT d.doc_id, coalesce(h = sha256(text) AND decision = 'accept', false) AS reviewed,
    contains({FOLD.format('text')}, 'expected_value') OR contains({FOLD.format('text')}, 'anomalylabel') OR contains({FOLD.format('text')}, 'expected_verdict')
      OR contains({FOLD.format('text')}, 'source_hashes') OR contains({FOLD.format('text')}, 'telemetry_path')
    OR EXISTS (SELECT 1 FROM benchmark b WHERE contains({FOLD.format('d.text')}, {FOLD.format('b.text')})) AS leaks
  FROM documents d LEFT JOIN rv ON rv.doc_id = d.doc_id)
SELECT doc_id, reviewed, leaks, reviewed AND NOT leaks AS publishable FROM s""")
def publication_check(spark: SparkSession, sf: str) -> DataFrame:
    """A document may go out if its review is bound and neither a benchmark text nor a private word occurs in it."""
    documents, judged = reviews(spark, sf)
    tokens = table(spark, sf, "benchmark").select(F.col("item_id").alias("token_id"), F.col("text").alias("token"))
    leaking = R.leak_hits(documents, tokens).select("doc_id").distinct().withColumn("_hit", F.lit(True))
    bound = R.review_binding(documents, judged, "doc_id", "text")
    private = documents.select("doc_id", R.built_in_leaks(F.col("text")).alias("_private"))
    joined = bound.join(private, "doc_id").join(leaking, "doc_id", "left")
    leaks = F.col("_private") | F.coalesce("_hit", F.lit(False))
    reviewed = F.col("status") == "bound"
    return joined.select("doc_id", reviewed.alias("reviewed"), leaks.alias("leaks"), (reviewed & ~leaks).alias("publishable"))


# ---------------------------------------------------------------- scalars on events

@check("nonfinite_to_null", f"""
WITH {EV} SELECT record_id, r AS "row", CASE WHEN k = 0 OR event_type = 'error' AND value = 0 THEN NULL ELSE {q6('value / k')} END AS ratio FROM ev""")
def nonfinite_to_null(spark: SparkSession, sf: str) -> DataFrame:
    """Ratios by a possibly zero divisor; infinities and undefined values become null."""
    ratio = F.when(F.col("k") == 0, F.lit(float("inf"))).otherwise(F.try_divide("value", "k"))
    undefined = (F.col("event_type") == "error") & (F.col("value") == 0)
    cleaned = S.finite_or_null(F.when(undefined, float("nan")).otherwise(ratio))
    return event_rows(spark, sf).select(RECORD, "row", r6(cleaned).alias("ratio"))


@check("props_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.usage') AS usage FROM events")
def props_extract(spark: SparkSession, sf: str) -> DataFrame:
    parsed = F.from_json("props", "k bigint, usage string")
    return table(spark, sf, "events").select("event_id", parsed["k"].alias("k"), parsed["usage"].alias("usage"))


@check("time_to_seconds", """
SELECT event_id, epoch_us(ts) / 1e6 AS from_iso, CAST(floor(epoch_us(ts) / 1e6) AS DOUBLE) AS from_pattern, epoch_us(ts) / 1e6 AS from_zone,
  CAST(event_id AS DOUBLE) AS from_seconds FROM events""")
def time_to_seconds(spark: SparkSession, sf: str) -> DataFrame:
    """The same instants as ISO text, by a pattern, with a zone, and plain numbers as text."""
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    styled = F.date_format("ts", "dd/MM/yyyy HH:mm:ss")
    return table(spark, sf, "events").select(
        "event_id", S.parse_time(iso).alias("from_iso"), S.parse_time(styled, pattern="%d/%m/%Y %H:%M:%S").alias("from_pattern"),
        S.parse_time(F.concat(iso, F.lit("Z"))).alias("from_zone"),
        S.parse_time(F.col("event_id").cast("string"), "seconds").alias("from_seconds"),
    )


# ---------------------------------------------------------------- run logs


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"), "role", F.length("text").cast("bigint").alias("tokens")
    )


def turn_rows(spark: SparkSession, sf: str) -> DataFrame:
    return turns(spark, sf).select(F.col("run_id").alias(RECORD), F.col("seq").alias("row"), "role")


def exchanges(spark: SparkSession, sf: str) -> DataFrame:
    """User turns as requests; the assistant turn right after is the response."""
    log = turns(spark, sf)
    asked = log.filter(F.col("role") == "user").select("run_id", "seq", "tokens")
    answered = log.filter(F.col("role") == "assistant").select("run_id", (F.col("seq") - 1).alias("seq"), "tokens")
    return L.request_response(asked, answered, 4000)


NEXT = "nx AS (SELECT conv_id, turn, role, length(text) AS tokens, lead(role) OVER o AS nr, lead(length(text)) OVER o AS nt FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn))"


@check("turn_log", "SELECT conv_id AS run_id, turn AS seq, role, CAST(length(text) AS BIGINT) AS tokens FROM conversations")
def turn_log(spark: SparkSession, sf: str) -> DataFrame:
    return turns(spark, sf)


@check("unanswered_turns", f"WITH {NEXT} SELECT conv_id AS record_id, turn AS \"row\", nr AS next_role FROM nx WHERE role = 'user' AND coalesce(nr, '') <> 'assistant'")
def unanswered_turns(spark: SparkSession, sf: str) -> DataFrame:
    return L.unanswered(turn_rows(spark, sf))


@check("unanswered_calls", f"""WITH {NEXT} SELECT conv_id AS run_id, turn AS seq, 'not_executed' AS issue FROM nx WHERE role = 'user' AND coalesce(nr, '') <> 'assistant'
UNION ALL SELECT conv_id, turn - 1, 'not_emitted' FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS pr FROM conversations)
  WHERE role = 'assistant' AND coalesce(pr, '') <> 'user'""")
def unanswered_calls(spark: SparkSession, sf: str) -> DataFrame:
    log = turns(spark, sf).withColumn("call", F.struct("run_id", "seq"))
    emitted = log.filter(F.col("role") == "user").select("call")
    executed = log.filter(F.col("role") == "assistant").select(F.struct("run_id", (F.col("seq") - 1).alias("seq")).alias("call"))
    return L.unanswered_calls(emitted, executed, "call").select("call.*", "issue")


@check("request_response", f"""WITH {NEXT}, rr AS (SELECT *, CASE WHEN nr = 'assistant' THEN nt END AS got FROM nx WHERE role = 'user')
SELECT conv_id AS run_id, turn AS seq, CAST(tokens AS BIGINT) AS tokens, CAST(got AS BIGINT) AS answer_tokens, got IS NOT NULL AS answered,
  tokens + coalesce(got, 0) <= 4000 AS within_context FROM rr""")
def request_response(spark: SparkSession, sf: str) -> DataFrame:
    return exchanges(spark, sf)


@check("turn_contiguity", """
SELECT conv_id AS run_id, CAST(count(*) AS BIGINT) AS turns, min(turn) AS first_seq, max(turn) AS last_seq,
  min(turn) = 0 AND max(turn) = count(*) - 1 AND count(DISTINCT turn) = count(*) AS contiguous FROM conversations GROUP BY 1""")
def turn_contiguity(spark: SparkSession, sf: str) -> DataFrame:
    return L.contiguity(turns(spark, sf))


LATCH = """la AS (SELECT conv_id, turn, role, max(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) = 1 AS latched FROM conversations)"""


@check("phase_latch", f"""WITH {LATCH} SELECT conv_id AS record_id, turn AS "row", role, latched, NOT latched OR role <> 'system' AS allowed FROM la""")
def phase_latch(spark: SparkSession, sf: str) -> DataFrame:
    return L.phase_latch(turn_rows(spark, sf), "assistant", "system")


RUN_CHECKS = f"""{NEXT}, {LATCH}, ck AS (
  SELECT conv_id AS run_id, 'sequence' AS check_, min(turn) = 0 AND max(turn) = count(*) - 1 AND count(DISTINCT turn) = count(*) AS ok FROM conversations GROUP BY 1
  UNION ALL SELECT conv_id, 'turn_budget', count(*) <= 6 FROM conversations GROUP BY 1
  UNION ALL SELECT conv_id, 'answered', coalesce(nr, '') = 'assistant' FROM nx WHERE role = 'user'
  UNION ALL SELECT conv_id, 'context', tokens + CASE WHEN nr = 'assistant' THEN nt ELSE 0 END <= 4000 FROM nx WHERE role = 'user'
  UNION ALL SELECT conv_id, 'phase', NOT latched OR role <> 'system' FROM la)"""


def checks_of(spark: SparkSession, sf: str) -> DataFrame:
    latch = L.phase_latch(turn_rows(spark, sf), "assistant", "system")
    return L.run_checks(turns(spark, sf), exchanges(spark, sf), latch, 6)


@check("run_audit", f"WITH {RUN_CHECKS} SELECT run_id, check_ AS \"check\", CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (NOT ok) AS BIGINT) AS failed FROM ck GROUP BY 1, 2")
def run_audit(spark: SparkSession, sf: str) -> DataFrame:
    return checks_of(spark, sf).groupBy("run_id", "check").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("passed")).alias("failed")
    )


@check("audit_totals", f"""WITH {RUN_CHECKS} SELECT check_ AS "check", CAST(count(*) AS BIGINT) AS checks, CAST(count(*) FILTER (NOT ok) AS BIGINT) AS failed,
  bool_and(ok) AS all_passed FROM ck GROUP BY 1""")
def audit_totals(spark: SparkSession, sf: str) -> DataFrame:
    return L.audit_totals(checks_of(spark, sf))


SUMMARY = """sm AS (SELECT conv_id AS run_id, CAST(count(*) FILTER (role = 'user') AS BIGINT) AS requests, CAST(count(*) FILTER (role = 'assistant') AS BIGINT) AS responses,
  CAST(coalesce(sum(length(text)) FILTER (role = 'user'), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS output_tokens,
  arg_max(role, turn) = 'assistant' AS submitted FROM conversations GROUP BY 1)"""


@check("run_summary", f"WITH {SUMMARY} SELECT * FROM sm")
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    return L.run_summary(turns(spark, sf))


@check("unfinished_runs", f"WITH {SUMMARY} SELECT run_id, requests, responses FROM sm WHERE NOT submitted")
def unfinished_runs(spark: SparkSession, sf: str) -> DataFrame:
    return L.unfinished(L.run_summary(turns(spark, sf))).select("run_id", "requests", "responses")


@check("job_summary", f"""WITH {SUMMARY} SELECT submitted, CAST(count(*) AS BIGINT) AS runs, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(responses) AS BIGINT) AS responses,
  CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM sm GROUP BY 1""")
def job_summary(spark: SparkSession, sf: str) -> DataFrame:
    return L.job_summary(L.run_summary(turns(spark, sf)))
