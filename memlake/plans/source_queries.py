"""Queries over sources and fragments: scans, versions, catalog, segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.operators import versions
from memlake.plans.base_sql import with_ctes
from memlake.plans.registry import query
from memlake.sources import bind


@query("s1_active_sources", with_ctes(["src"], """
SELECT source_id, namespace_id, lineage_id, version, media_type, content_length, content_digest, captured_at
FROM src WHERE namespace_id = 'ns-en' AND deletion_state = 'active'"""))
def s1_active_sources(spark, path):
    rows = versions.active(versions.in_namespace(bind.sources(spark, path), "ns-en"))
    return rows.select(
        "source_id", "namespace_id", "lineage_id", "version", "media_type", "content_length",
        "content_digest", "captured_at",
    )


@query("s2_fragments", with_ctes(["frag"], """
SELECT fragment_id, source_id, ordinal, byte_start, byte_end, content_digest FROM frag WHERE deletion_state = 'active'"""))
def s2_fragments(spark, path):
    return versions.active(bind.fragments(spark, path)).select(
        "fragment_id", "source_id", "ordinal", "byte_start", "byte_end", "content_digest"
    )


@query("j2_tips", with_ctes(["tips"], "SELECT namespace_id, lineage_id, source_id, version FROM tips"))
def j2_tips(spark, path):
    return versions.tips(bind.sources(spark, path))


@query("j4_lineage_state", with_ctes(["src", "tips"], """
SELECT t.namespace_id, t.lineage_id, b.origin_binding_id, t.source_id AS current_source_id, t.version AS current_version
FROM (SELECT DISTINCT namespace_id, origin_ref AS origin_binding_id, lineage_id FROM src) b
JOIN tips t ON t.namespace_id = b.namespace_id AND t.lineage_id = b.lineage_id"""))
def j4_lineage_state(spark, path):
    s = bind.sources(spark, path)
    return versions.lineage_state(bind.origin_bindings(spark, path), versions.tips(s), s)


@query("a1_active_versions", with_ctes(["src"], """
SELECT namespace_id, lineage_id, count(*) AS version_count FROM src WHERE deletion_state = 'active' GROUP BY ALL"""))
def a1_active_versions(spark, path):
    return versions.active_version_counts(bind.sources(spark, path))


_SUMMARY_SQL = """
SELECT s.namespace_id, s.lineage_id, s.source_id AS current_source_id, s.version AS current_version, s.title,
  s.source_kind, s.media_type, s.content_length, s.captured_at, c.version_count,
  CASE WHEN c.version_count <> s.version THEN 'InvalidFieldCombination' END AS problem
FROM src s JOIN tips t ON t.source_id = s.source_id
JOIN (SELECT namespace_id, lineage_id, count(*) AS version_count FROM src WHERE deletion_state = 'active' GROUP BY ALL) c
  ON c.namespace_id = s.namespace_id AND c.lineage_id = s.lineage_id"""
_SUMMARY = [
    "namespace_id", "lineage_id", "current_source_id", "current_version", "title", "source_kind",
    "media_type", "content_length", "captured_at", "version_count", "problem",
]


@query("f10_lineage_summaries", with_ctes(["src", "tips"], _SUMMARY_SQL))
def f10_lineage_summaries(spark, path):
    return versions.lineage_summaries(bind.sources(spark, path)).select(*_SUMMARY)


@query("l3_catalog_page", with_ctes(["src", "tips"], f"""
SELECT namespace_id, lineage_id, current_source_id, captured_at FROM ({_SUMMARY_SQL})
WHERE namespace_id = 'ns-en' ORDER BY captured_at DESC, lineage_id LIMIT 20 OFFSET 5"""))
def l3_catalog_page(spark, path):
    rows = versions.lineage_summaries(bind.sources(spark, path))
    return versions.catalog_page(rows, "ns-en", 5, 20).select(
        "namespace_id", "lineage_id", "current_source_id", "captured_at"
    )


@query("l3_catalog_after", with_ctes(["src", "tips"], f"""
SELECT namespace_id, lineage_id, captured_at FROM ({_SUMMARY_SQL})
WHERE namespace_id = 'ns-en' AND captured_at < TIMESTAMP '2024-01-01 12:00:00'
ORDER BY captured_at DESC, lineage_id LIMIT 20"""))
def l3_catalog_after(spark, path):
    rows = versions.lineage_summaries(bind.sources(spark, path))
    at = bind.ntz("2024-01-01 12:00:00")
    return versions.catalog_after(rows, "ns-en", at, "~", 20).select("namespace_id", "lineage_id", "captured_at")


@query("w8_catalog_rank", with_ctes(["src", "tips"], f"""
SELECT namespace_id, lineage_id, captured_at,
  row_number() OVER (PARTITION BY namespace_id ORDER BY captured_at DESC, lineage_id) AS catalog_rank
FROM ({_SUMMARY_SQL})"""))
def w8_catalog_rank(spark, path):
    return versions.catalog_rank(versions.lineage_summaries(bind.sources(spark, path)))


@query("f11_version_summaries", with_ctes(["src", "tips"], """
SELECT s.namespace_id, s.lineage_id, s.source_id, s.version, s.title, s.captured_at, t.source_id IS NOT NULL AS current
FROM src s LEFT JOIN tips t ON t.source_id = s.source_id WHERE s.deletion_state = 'active'"""))
def f11_version_summaries(spark, path):
    s = bind.sources(spark, path)
    return versions.version_summaries(s, versions.tips(s)).select(
        "namespace_id", "lineage_id", "source_id", "version", "title", "captured_at", "current"
    )


@query("w2_version_gaps", with_ctes(["src", "tips"], """
SELECT s.namespace_id, s.lineage_id, count(*) AS n, max(s.version) AS last_version, 'version_gap' AS reason
FROM src s JOIN tips t ON t.namespace_id = s.namespace_id AND t.lineage_id = s.lineage_id
WHERE s.deletion_state = 'active' GROUP BY ALL HAVING count(*) <> max(s.version)"""))
def w2_version_gaps(spark, path):
    s = bind.sources(spark, path)
    return versions.version_chain_problems(s, versions.tips(s)).select(
        "namespace_id", "lineage_id", "n", "last_version", "reason"
    )


@query("s9_segment_summary", with_ctes(["frag"], """
SELECT source_id, count(*) AS n_fragments, max(byte_end) AS last_byte, CAST(sum(byte_end - byte_start) AS BIGINT) AS n_bytes
FROM frag GROUP BY source_id"""))
def s9_segment_summary(spark, path):
    return bind.fragments(spark, path, with_content=False).groupBy("source_id").agg(
        F.count(F.lit(1)).alias("n_fragments"),
        F.max("byte_end").alias("last_byte"),
        F.sum(F.col("byte_end") - F.col("byte_start")).alias("n_bytes"),
    )
