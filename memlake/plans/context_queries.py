"""Queries over context packs built from batch recall."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions.digest import nfc_digest
from memlake.operators import context
from memlake.plans.base_sql import cte, with_ctes
from memlake.plans.recall_queries import batch_hits, recall_index, tip_fragments
from memlake.plans.registry import query
from memlake.plans.rule_queries import rule_sql
from memlake.session import release, written
from memlake.sources import bind

LIMITS = [256, 4096, 1_048_576]

cte("items", ["hits", "rows_"], """
SELECT h.query_id, h.rank - 1 AS ordinal, h.object_kind AS item_type, h.object_id, r.content, sha256(nfc_normalize(r.content)) AS content_digest,
  strlen(r.content) AS rendered_bytes, 'current' AS temporal_role
FROM hits h JOIN rows_ r ON r.object_kind = h.object_kind AND r.object_id = h.object_id""")

cte("cites", ["items", "rec", "frag"], """
SELECT w.query_id, w.ordinal, w.evidence_no, 'cit-' || w.query_id || '-' || CAST(w.ordinal AS VARCHAR) || '-0' AS citation_id,
  f.source_id, f.fragment_id, f.byte_start, f.byte_end, f.content_digest AS fragment_digest, f.deletion_state AS f_state
FROM (SELECT query_id, ordinal, 0 AS evidence_no, object_id AS fragment_id FROM items WHERE item_type = 'source_fragment'
  UNION ALL SELECT i.query_id, i.ordinal, 0, r.fragment_ref FROM items i JOIN rec r ON r.memory_id = i.object_id WHERE i.item_type = 'memory_record') w
JOIN frag f ON f.fragment_id = w.fragment_id""")

ITEM = ["query_id", "ordinal", "item_type", "object_id", "content", "content_digest", "rendered_bytes", "temporal_role"]


def parts(spark, path):
    """Items and citations of all queries; the hits are computed once."""
    hits = written(batch_hits(spark, path))
    r = bind.records(spark, path)
    items = written(context.context_items(hits, recall_index(spark, path).objects))
    release(spark)
    cited = written(context.citations(items, r, bind.fragments(spark, path)))
    release(spark)
    return items, cited


@query("q8_context_items", with_ctes(["items"], f"SELECT {', '.join(ITEM)} FROM items"))
def q8_context_items(spark, path):
    hits = written(batch_hits(spark, path))
    return context.context_items(hits, recall_index(spark, path).objects).select(*ITEM)


@query("q8_citations", with_ctes(["cites"], """
SELECT query_id, ordinal, citation_id, source_id, fragment_id, byte_start, byte_end, fragment_digest FROM cites"""))
def q8_citations(spark, path):
    return parts(spark, path)[1].drop("evidence_no")


@query("q8_context_packs", with_ctes(["items", "cites"], """
SELECT 'ctx-' || i.query_id AS context_pack_id, i.query_id, l.budget_limit, i.used AS budget_used, i.n AS n_items, coalesce(c.n, 0) AS n_citations,
  sha256('{"citations":[' || coalesce(c.ids, '') || '],"context_pack_id":"ctx-' || i.query_id || '","items":[' || i.ids || ']}') AS content_digest,
  CASE WHEN i.used > l.budget_limit THEN 'BudgetExceeded' END AS problem
FROM (SELECT query_id, CAST(sum(rendered_bytes) AS BIGINT) AS used, count(*) AS n,
    string_agg('"item-' || query_id || '-' || CAST(ordinal AS VARCHAR) || '"', ',' ORDER BY ordinal) AS ids FROM items GROUP BY query_id) i
LEFT JOIN (SELECT query_id, count(*) AS n, string_agg('"' || citation_id || '"', ',' ORDER BY ordinal) AS ids FROM cites GROUP BY query_id) c ON c.query_id = i.query_id
CROSS JOIN (SELECT unnest([256, 4096, 1048576]) AS budget_limit) l"""))
def q8_context_packs(spark, path):
    items, cited = parts(spark, path)
    return context.compile_packs(items, cited, LIMITS)


@query("q10_budget_prefix", with_ctes(["items"], """
SELECT query_id, count(*) FILTER (r <= 256) AS allowed, count(*) FILTER (r > 256) AS truncated, CAST(coalesce(max(r) FILTER (r <= 256), 0) AS BIGINT) AS budget_used
FROM (SELECT query_id, sum(rendered_bytes) OVER (PARTITION BY query_id ORDER BY ordinal) AS r FROM items) GROUP BY query_id"""))
def q10_budget_prefix(spark, path):
    hits = written(batch_hits(spark, path))
    return context.fit_budget(context.context_items(hits, recall_index(spark, path).objects), 256)


def faulty(spark, path):
    items, cited = parts(spark, path)
    o = F.col("ordinal")
    bad_items = items.withColumns({
        "content_digest": F.when(F.pmod(o, F.lit(5)) == 3, F.sha2(F.lit("x"), 256)).otherwise(F.col("content_digest")),
        "rendered_bytes": F.col("rendered_bytes") + F.when(F.pmod(o, F.lit(4)) == 2, 1).otherwise(0),
        "ordinal": F.when(o == 6, 7).otherwise(o).cast("long"),
    })
    bad_cited = cited.filter(F.pmod(o, F.lit(7)) != 5).withColumn(
        "byte_end", F.col("byte_end") + F.when(F.pmod(o, F.lit(3)) == 1, 1).otherwise(0)
    )
    return bad_items, bad_cited


_BAD_ITEMS = """
SELECT query_id, CASE WHEN ordinal = 6 THEN 7 ELSE ordinal END AS ordinal, item_type, object_id, content,
  CASE WHEN ordinal % 5 = 3 THEN sha256('x') ELSE content_digest END AS content_digest,
  rendered_bytes + CASE WHEN ordinal % 4 = 2 THEN 1 ELSE 0 END AS rendered_bytes FROM items"""
_BAD_CITES = """
SELECT * EXCLUDE (byte_end), byte_end AS true_end, byte_end + CASE WHEN ordinal % 3 = 1 THEN 1 ELSE 0 END AS byte_end FROM cites WHERE ordinal % 7 <> 5"""


@query("v20_context_items", with_ctes(["items", "cites"], rule_sql("V20", "ContextItem", "query_id || '/' || CAST(ordinal AS VARCHAR)", "x", [
    ("DigestMismatch", "sha256(nfc_normalize(content)) <> content_digest"), ("CountMismatch", "strlen(content) <> rendered_bytes"),
    ("EmptyRequiredCollection", "(query_id, ordinal) NOT IN (SELECT (query_id, ordinal) FROM y)"),
], distinct=False), x=_BAD_ITEMS, y=_BAD_CITES))
def v20_context_items(spark, path):
    return context.item_rows(*faulty(spark, path))


@query("v21_context_packs", with_ctes(["items", "cites", "qs"], """
SELECT DISTINCT 'V21' AS rule_id, 'ContextPack' AS object_type, query_id AS object_id, reason FROM (
  SELECT query_id, 'DuplicateOrdinal' AS reason FROM x GROUP BY query_id
    HAVING count(DISTINCT ordinal) <> count(*) OR min(ordinal) <> 0 OR max(ordinal) <> count(*) - 1
  UNION ALL SELECT query_id, 'CitationMismatch' FROM y WHERE (query_id, ordinal) NOT IN (SELECT (query_id, ordinal) FROM x))""",
    x=_BAD_ITEMS, y=_BAD_CITES))
def v21_context_packs(spark, path):
    items, cited = faulty(spark, path)
    qs = bind.recall_queries(spark, path, tip_fragments(spark, path))
    return context.pack_rows(items, cited, qs.withColumn("task_digest", nfc_digest(F.col("query"))))


@query("v22_pack_resolution", with_ctes(["items", "cites", "rec"], rule_sql("V22", "Citation", "citation_id", "y", [
    ("RecallBlocked", "f_state <> 'active'"), ("CitationMismatch", "byte_end <> true_end")], distinct=False), y=_BAD_CITES))
def v22_pack_resolution(spark, path):
    items, cited = faulty(spark, path)
    return context.pack_resolution(
        items, cited, bind.records(spark, path), bind.fragments(spark, path), bind.sources(spark, path)
    )


def broken_packs(spark, path):
    """Packs, items, uses and citations with one fault per reason; see the SQL beside."""
    items, cited = parts(spark, path)
    o = F.col("ordinal")
    items = items.withColumn("object_id", F.when(F.pmod(o, F.lit(6)) == 1, F.concat(F.lit("gone-"), "object_id")).otherwise(F.col("object_id")))
    lost = items.filter(F.pmod(o, F.lit(5)) == 2).select("query_id", "ordinal", F.concat(F.lit("cit-none-"), o.cast("string")).alias("citation_id"))
    uses = cited.filter(F.pmod(o, F.lit(7)) != 5).select("query_id", "ordinal", "citation_id").unionByName(lost)
    qs = bind.recall_queries(spark, path, tip_fragments(spark, path)).join(items.select("query_id").distinct(), "query_id", "left_semi")
    packs = qs.select(
        "query_id", F.when(F.col("query_id").startswith("doc-"), "ns-none").otherwise(F.col("namespace_id")).alias("namespace_id"),
        F.when(F.col("query_id").startswith("conv-"), "pending").otherwise("active").alias("deletion_state"),
    )
    return packs, items, uses, cited


_X8 = """
SELECT 'X8' AS rule_id, 'Citation' AS object_type, query_id || '/' || citation_id AS object_id, 'CitationMismatch' AS reason FROM cites WHERE ordinal % 7 = 5
UNION ALL SELECT 'X8', 'Citation', query_id || '/cit-none-' || CAST(ordinal AS VARCHAR), 'MissingReference' FROM items WHERE ordinal % 5 = 2"""


@query("x8_citation_closure", with_ctes(["items", "cites"], _X8))
def x8_citation_closure(spark, path):
    _, _, uses, cited = broken_packs(spark, path)
    return context.citation_closure(uses, cited)


@query("v22_pack_closure", with_ctes(["items", "cites", "qs", "rec", "src"], f"""{_X8}
UNION ALL SELECT DISTINCT 'V22', 'ContextPack', query_id, 'RecallBlocked' FROM items WHERE query_id LIKE 'conv-%'
UNION ALL SELECT 'V22', 'ContextItem', query_id || '/' || CAST(ordinal AS VARCHAR), 'MissingReference' FROM items WHERE ordinal % 6 = 1
UNION ALL SELECT 'V22', 'ContextItem', query_id || '/' || CAST(ordinal AS VARCHAR), 'NamespaceMismatch' FROM items WHERE ordinal % 6 <> 1 AND query_id LIKE 'doc-%'
UNION ALL SELECT 'V22', 'ContextItem', query_id || '/' || CAST(ordinal AS VARCHAR), 'CitationMismatch' FROM cites WHERE ordinal % 6 = 1 AND ordinal % 7 <> 5
UNION ALL SELECT 'V22', 'Citation', citation_id, 'NamespaceMismatch' FROM cites WHERE query_id LIKE 'doc-%'"""))
def v22_pack_closure(spark, path):
    return context.pack_closure(*broken_packs(spark, path), bind.records(spark, path), bind.fragments(spark, path), bind.sources(spark, path))
