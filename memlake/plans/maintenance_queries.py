"""Queries over intake, captures, derived tables, inventory, functions and metrics."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from memlake.functions import digest, temporal
from memlake.functions.text import nfc, variants
from memlake.operators import capture, chains, commit, context, deletion, maintain, memory, metrics, postings, rules, versions
from memlake.operators.recall import recall_rows
from memlake.plans import context_queries as cq
from memlake.plans import deletion_queries as dq
from memlake.plans import faults
from memlake.plans.base_sql import CTES, cte, tokens_sql, with_ctes
from memlake.plans.memory_queries import found_conflicts, variants_sql
from memlake.plans.recall_queries import PERSONAL, batch_hits, recall_index, rows, tip_fragments, tip_sources
from memlake.plans.registry import query
from memlake.session import cut_lineage, release, work_folder, written
from memlake.sources import bind
from memlake.sources.intake import build_captures, classify, noise_text
from memlake.sources.segment import GOVERNANCE, segment_lines

# --- intake and captures -----------------------------------------------------------------


def intake_rows(spark, path):
    docs = bind.table(spark, path, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.when(F.pmod("doc_id", F.lit(2)) == 1, ".MD").otherwise(".txt")).alias("name"),
        F.when(F.pmod("doc_id", F.lit(29)) == 3, F.lit("").cast("binary"))
        .when(F.pmod("doc_id", F.lit(31)) == 4, F.concat(F.col("text").cast("binary"), F.unhex(F.lit("C328"))))
        .when(F.pmod("doc_id", F.lit(37)) == 5, F.concat(F.col("text").cast("binary"), F.unhex(F.lit("00"))))
        .otherwise(F.col("text").cast("binary")).alias("content"),
    )
    pages = bind.table(spark, path, "pages").select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit(".html")).alias("name"), F.col("html").cast("binary").alias("content")
    )
    return docs.unionByName(pages)


@query("s6_intake", with_ctes([], """
SELECT 'doc-' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 2 = 1 THEN '.MD' ELSE '.txt' END AS name,
  CASE WHEN doc_id % 2 = 1 THEN 'markdown' ELSE 'text' END AS source_kind, CASE WHEN doc_id % 2 = 1 THEN 'text/markdown' ELSE 'text/plain' END AS media_type,
  CASE WHEN doc_id % 29 = 3 THEN 0 ELSE strlen(text) + CASE WHEN doc_id % 31 = 4 THEN 2 WHEN doc_id % 37 = 5 THEN 1 ELSE 0 END END AS content_length,
  CASE WHEN doc_id % 29 = 3 THEN 'empty' WHEN doc_id % 31 = 4 THEN 'invalid_utf8' WHEN doc_id % 37 = 5 THEN 'nul_byte' END AS reject_reason FROM documents
UNION ALL SELECT 'page-' || CAST(page_id AS VARCHAR) || '.html', NULL, NULL, strlen(html), 'unsupported_type' FROM pages"""))
def s6_intake(spark, path):
    return classify(intake_rows(spark, path)).drop("content")


@query("s7_build_captures", with_ctes([], """
SELECT 'cap-' || CAST(doc_id AS VARCHAR) AS source_id, 'cap-' || CAST(doc_id AS VARCHAR) || '-f00000' AS fragment_id, strlen(text) AS byte_end, sha256(text) AS content_digest
FROM documents WHERE NOT (doc_id % 29 = 3 OR doc_id % 31 = 4 OR doc_id % 37 = 5)"""))
def s7_build_captures(spark, path):
    accepted = classify(intake_rows(spark, path)).filter("reject_reason is null")
    none = F.lit(None).cast("string")
    plan = {
        "source_id": F.concat(F.lit("cap-"), F.regexp_extract("name", r"(\d+)", 1)), "namespace_id": F.lit("ns-new"),
        "lineage_id": F.col("name"), "version": F.lit(1).cast("long"), "created_at": bind.ntz(), "sensitivity": F.lit("personal"),
        "egress_policy": F.lit("local_only"), "retention_mode": F.lit("until_deleted"), "retention_expires_at": F.lit(None).cast("timestamp_ntz"),
        "retention_policy_id": none, "deletion_state": F.lit("active"), "policy_basis": F.lit("user-consent"),
    }
    s, f = build_captures(accepted, plan)
    return f.select("source_id", "fragment_id", "byte_end", "content_digest")


def incoming_captures(spark, path):
    """A new capture for every lineage with a tip; some repeat, some break a rule."""
    s = bind.sources(spark, path)
    at_tip = s.join(versions.tips(s).select("source_id"), "source_id", "left_semi")
    m = lambda mod, rest: F.pmod("doc_id", F.lit(mod)) == rest
    text = F.when(m(3, 0), F.col("content")).otherwise(F.concat("content", F.lit("!\n")))
    return at_tip.select(
        F.concat(F.lit("new-"), "source_id").alias("source_id"), "namespace_id",
        F.when(m(5, 0), F.concat(F.lit("lin-new-"), "source_id")).when(m(7, 0), F.lit("lin-other")).otherwise(F.col("lineage_id")).alias("lineage_id"),
        F.when(m(5, 0) | m(17, 3), F.concat(F.lit("origin-binding-new-"), "source_id")).otherwise(F.col("origin_ref")).alias("origin_binding_id"),
        F.octet_length(text).cast("long").alias("content_length"), digest.exact_digest(text).alias("content_digest"),
        F.when(m(11, 0), "text").otherwise(F.col("source_kind")).alias("source_kind"), "media_type",
        F.when(m(13, 0), "restricted").otherwise(F.col("sensitivity")).alias("sensitivity"),
        *[g for g in GOVERNANCE if g not in ("sensitivity", "deletion_state")],
    )


@query("b1_decide_captures", with_ctes(["src", "tips"], """
SELECT 'new-' || source_id AS source_id, lineage_id, CASE WHEN r IS NOT NULL THEN 'rejected' ELSE o END AS outcome, r AS reason,
  CASE WHEN r IS NOT NULL THEN NULL WHEN o = 'idempotent' THEN source_id ELSE 'new-' || source_id END AS result_source_id,
  CASE WHEN r IS NOT NULL OR o = 'idempotent' THEN NULL WHEN o = 'created' THEN 1 ELSE version + 1 END AS next_version FROM (
  SELECT s.source_id, s.version, CASE WHEN doc_id % 5 = 0 THEN 'lin-new-' || s.source_id WHEN doc_id % 7 = 0 THEN 'lin-other' ELSE s.lineage_id END AS lineage_id,
    CASE WHEN doc_id % 5 = 0 THEN 'created' WHEN doc_id % 7 = 0 AND doc_id % 17 = 3 THEN 'created' WHEN doc_id % 3 = 0 THEN 'idempotent' ELSE 'versioned' END AS o,
    CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 7 = 0 AND doc_id % 17 = 3 THEN NULL
      WHEN doc_id % 7 = 0 THEN 'OriginBindingMismatch' WHEN doc_id % 17 = 3 THEN 'OriginBindingMismatch'
      WHEN doc_id % 13 = 0 AND sensitivity <> 'restricted' THEN 'CaptureStateMismatch'
      WHEN doc_id % 3 = 0 AND doc_id % 11 = 0 AND source_kind <> 'text' THEN 'CaptureStateMismatch' END AS r
  FROM src s JOIN tips t ON t.source_id = s.source_id)"""))
def b1_decide_captures(spark, path):
    s = bind.sources(spark, path)
    got = capture.decide_captures(incoming_captures(spark, path), bind.origin_bindings(spark, path), capture.current_facts(s, versions.tips(s)), s)
    return got.drop("namespace_id")


def next_versions(spark, path):
    """The next version of every tip, each with an added closing line."""
    return tip_sources(spark, path).withColumns({
        "supersedes_source_ids": F.array("source_id"), "source_id": F.concat(F.lit("next-"), "source_id"),
        "version": F.col("version") + 1, "content": F.concat("content", F.lit("\nclosing line\n")),
    }).withColumns({"content_length": F.octet_length("content").cast("long"), "content_digest": digest.exact_digest(F.col("content"))})


@query("v38_capture_candidates", with_ctes(["src", "tips"], """
SELECT 'V38' AS rule_id, 'SourceArtifact' AS object_type, CASE WHEN doc_id % 5 = 1 THEN s.source_id ELSE 'next-' || s.source_id END AS object_id, 'SupersessionMismatch' AS reason
FROM src s JOIN tips t ON t.source_id = s.source_id WHERE doc_id % 3 = 1
UNION ALL SELECT 'V38', 'SourceArtifact', s.source_id, 'DuplicateObject' FROM src s JOIN tips t ON t.source_id = s.source_id WHERE doc_id % 5 = 1"""))
def v38_capture_candidates(spark, path):
    s = bind.sources(spark, path)
    new = next_versions(spark, path).withColumns({
        "version": F.col("version") + F.when(F.pmod("doc_id", F.lit(3)) == 1, 1).otherwise(0),
        "source_id": F.when(F.pmod("doc_id", F.lit(5)) == 1, F.get("supersedes_source_ids", F.lit(0))).otherwise(F.col("source_id")),
    })
    return capture.candidate_problems(
        new, versions.tips(s), s, bind.fragments(spark, path, False), segment_lines(new.filter("source_id like 'next-%'"), False)
    )


def attempts(spark, path, requested):
    inv = bind.object_inventory(spark, path)
    return inv.join(requested.select("source_id", "request_digest"), "source_id").withColumn(
        "request_digest", F.when(F.pmod("doc_id", F.lit(7)) == 4, F.sha2(F.lit("x"), 256)).otherwise(F.col("request_digest"))
    )


@query("b9_replay", with_ctes(["src"], """
SELECT source_id, CASE WHEN doc_id % 23 = 22 THEN 'rejected' WHEN doc_id % 7 = 4 THEN 'rejected' WHEN doc_id % 19 = 18 THEN 'resume' ELSE 'idempotent' END AS outcome FROM src"""))
def b9_replay(spark, path):
    asked = cut_lineage(capture.request_digests(bind.sources(spark, path), bind.fragments(spark, path)))
    return capture.replay(asked, attempts(spark, path, asked))


_LIBRARIES: dict[tuple[str, str], commit.Library] = {}


def appended_library(spark, path) -> commit.Library:
    """The bound library after five appends, run once per application.

    ``1-even`` gives every second tip a next version, ``2-odd`` does so for the others with one
    false digest, ``3-late`` repeats it without and gives the first ones another version,
    ``1-even`` comes a second time, and ``4-idle`` captures all tips once more as they are.
    """
    key = (spark.sparkContext.applicationId, path)
    if key in _LIBRARIES:
        return _LIBRARIES[key]
    s = bind.sources(spark, path)
    base = {"sources": s, "fragments": bind.fragments(spark, path), "bindings": bind.origin_bindings(spark, path), "audit": bind.capture_audit(spark, path)}
    lib = commit.Library(spark, f"{work_folder(spark)}/library-{uuid.uuid4().hex}", base)
    new = next_versions(spark, path)
    even, odd = (new.filter(F.pmod("doc_id", F.lit(2)) == r) for r in (0, 1))
    false = odd.agg(F.min("source_id").alias("m")).select("m").scalar()
    broken = odd.withColumn("content_digest", F.when(F.col("source_id") == false, F.sha2(F.lit("x"), 256)).otherwise(F.col("content_digest")))
    again = even.withColumns({
        "supersedes_source_ids": F.array("source_id"), "source_id": F.concat(F.lit("next2-"), F.expr("substring(source_id, 6)")),
        "version": F.col("version") + 1, "content": F.concat("content", F.lit("\nclosing line\n")),
    }).withColumns({"content_length": F.octet_length("content").cast("long"), "content_digest": digest.exact_digest(F.col("content"))})
    for name, batch in (("1-even", even), ("2-odd", broken), ("3-late", odd.unionByName(again)), ("1-even", even)):
        lib.append(name, batch, segment_lines(batch))
    tips = lib.table("sources").join(lib.tips().select("source_id"), "source_id", "left_semi")
    idle = tips.withColumn("source_id", F.concat(F.lit("same-"), "source_id")).drop("version", "supersedes_source_ids")
    lib.append("4-idle", idle, segment_lines(idle))
    _LIBRARIES[key] = lib
    return lib


cte("at_tip", ["src", "tips"], """
SELECT s.*, length(s.content) - length(replace(s.content, chr(10), '')) AS n_lines FROM src s JOIN tips t ON t.source_id = s.source_id""")


@query("b2_commit_captures", with_ctes(["at_tip"], """
SELECT lineage_id, CASE WHEN doc_id % 2 = 0 THEN 'next2-' ELSE 'next-' END || source_id AS source_id, version + CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS version FROM at_tip"""))
def b2_commit_captures(spark, path):
    return appended_library(spark, path).tips().select("lineage_id", "source_id", "version")


@query("b10_append_batches", with_ctes(["at_tip"], """
SELECT '1-even' AS batch_id, 'accepted' AS outcome, 0 AS n_problems, count(*) AS n_sources, CAST(sum(n_lines + 2) AS BIGINT) AS n_fragments, 0 AS n_bindings, count(*) AS n_audit, count(*) AS n_tips
FROM at_tip WHERE doc_id % 2 = 0
UNION ALL SELECT '2-odd', 'refused', 1, 0, 0, 0, 0, 0
UNION ALL SELECT '3-late', 'accepted', 0, count(*), CAST(sum(n_lines + CASE WHEN doc_id % 2 = 0 THEN 4 ELSE 2 END) AS BIGINT), 0, count(*), count(*) FROM at_tip
UNION ALL SELECT '4-idle', 'accepted', 0, 0, 0, 0, count(*), 0 FROM at_tip"""))
def b10_append_batches(spark, path):
    lib = appended_library(spark, path)
    out = lib.commits()
    for name in commit.TABLES:
        n = lib.appended(name).groupBy("batch_id").agg(F.count(F.lit(1)).alias(f"n_{name}"))
        out = out.join(n, "batch_id", "left")
    return out.na.fill(0)


@query("b10_refused_rows", with_ctes(["at_tip"], """
SELECT '2-odd' AS batch_id, 'V1' AS rule_id, 'SourceArtifact' AS object_type, 'next-' || min(source_id) AS object_id, 'DigestMismatch' AS reason FROM at_tip WHERE doc_id % 2 = 1"""))
def b10_refused_rows(spark, path):
    return appended_library(spark, path).problems()


cte("nrows", ["src", "tips", "rec"], """
SELECT 'source_fragment' AS object_kind, 'next-' || s.source_id AS source_id, s.content || chr(10) || 'closing line' || chr(10) AS content FROM src s JOIN tips t ON t.source_id = s.source_id""")


@query("b4_recall_upkeep", with_ctes(["nrows", "rec"], """
SELECT object_kind, id, count(*) AS n_rows, CAST(sum(strlen(piece)) AS BIGINT) AS n_bytes FROM (
  SELECT object_kind, source_id AS id, unnest(list_transform(string_split(rtrim(content, chr(10)), chr(10)), lambda x: x)) AS piece FROM nrows WHERE false
  UNION ALL SELECT object_kind, source_id, p FROM (SELECT object_kind, source_id, unnest(regexp_extract_all(content, '[^\\n]*\\n')) AS p FROM nrows)
  UNION ALL SELECT 'memory_record', memory_id, content FROM rec WHERE deletion_state = 'active' AND current_state = 'confirmed' AND confidence < 0.5)
GROUP BY object_kind, id"""))
def b4_recall_upkeep(spark, path):
    """Every tip gets a next version; memories of high confidence end."""
    old_fragments = tip_fragments(spark, path).select("fragment_id", "source_id")
    new = next_versions(spark, path)
    r = bind.records(spark, path)
    fresh = recall_rows(segment_lines(new).withColumn("captured_at", F.col("created_at")), r.filter(F.lit(False)))
    ended = r.filter("confidence >= 0.5").select("memory_id")
    touched = new.select(F.get("supersedes_source_ids", F.lit(0)).alias("source_id"))
    now = capture.upkeep_recall(rows(spark, path), old_fragments, fresh, touched, ended)
    owner = F.when(F.col("object_kind") == "source_fragment", F.regexp_replace("object_id", r"-f\d+$", "")).otherwise(F.col("object_id"))
    return now.groupBy("object_kind", owner.alias("id")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.octet_length("content")).alias("n_bytes"))


# --- derived tables and inventory ------------------------------------------------------------


@query("x1_tip_drift", with_ctes(["tips", "src"], """
SELECT t.namespace_id, t.lineage_id, CASE WHEN doc_id % 3 = 0 THEN 'missing' ELSE 'altered' END AS reason FROM tips t JOIN src s ON s.source_id = t.source_id WHERE doc_id % 3 = 0 OR doc_id % 5 = 1
UNION ALL SELECT 'ns-none', t.lineage_id, 'extra' FROM tips t JOIN src s ON s.source_id = t.source_id WHERE doc_id % 7 = 2"""))
def x1_tip_drift(spark, path):
    s = bind.sources(spark, path)
    good = versions.tips(s)
    n = F.expr("substring(source_id, 5)").cast("long")
    altered = good.filter(F.pmod(n, F.lit(3)) != 0).withColumn("version", F.col("version") + F.when(F.pmod(n, F.lit(5)) == 1, 1).otherwise(0))
    extra = good.filter(F.pmod(n, F.lit(7)) == 2).withColumn("namespace_id", F.lit("ns-none"))
    return maintain.drift(altered.unionByName(extra), good, ["namespace_id", "lineage_id"])


@query("v31_recall_drift", with_ctes(["rows_"], """
SELECT object_kind, object_id, CASE WHEN object_id LIKE '%3' THEN 'missing' ELSE 'altered' END AS reason FROM rows_ WHERE object_id LIKE '%3' OR object_id LIKE '%5'"""))
def v31_recall_drift(spark, path):
    good = rows(spark, path).select("object_kind", "object_id", "namespace_id", "sensitivity", "content")
    bad = good.filter(~F.col("object_id").endswith("3")).withColumn(
        "content", F.when(F.col("object_id").endswith("5"), F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    )
    return maintain.drift(bad, good, ["object_kind", "object_id"])


@query("m1_verify_derivations", with_ctes(["rec"], """
SELECT memory_id, 'altered' AS reason FROM rec WHERE event_id % 9 = 4"""))
def m1_verify_derivations(spark, path):
    good = chains.memory_current(bind.state_events(spark, path))
    n = F.expr("substring(memory_id, 5)").cast("long")
    bad = good.withColumn("current_state", F.when(F.pmod(n, F.lit(9)) == 4, "expired").otherwise(F.col("current_state")))
    return maintain.drift(bad, good, ["memory_id"])


@query("m2_rebuild", with_ctes(["tips", "rec", "rows_"], """
SELECT 'tips' AS name, count(*) AS n FROM tips UNION ALL SELECT 'memory_current', count(*) FROM rec UNION ALL SELECT 'recall_rows', count(*) FROM rows_"""))
def m2_rebuild(spark, path):
    s = bind.sources(spark, path)
    parts = {"tips": versions.tips(s), "memory_current": chains.memory_current(bind.state_events(spark, path)), "recall_rows": rows(spark, path)}
    out = None
    for name, df in parts.items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("s10_backfill_bindings", with_ctes(["src", "tips"], """
SELECT s.namespace_id, s.lineage_id, s.origin_ref AS origin_binding_id FROM src s JOIN tips t ON t.source_id = s.source_id"""))
def s10_backfill_bindings(spark, path):
    return rules.expected_bindings(bind.sources(spark, path))


def object_refs(spark, path):
    inv = bind.object_inventory(spark, path)
    m = lambda mod, rest: F.pmod("doc_id", F.lit(mod)) == rest
    return inv.filter((F.col("state") == "committed") & ~m(37, 5)).select(
        "source_id", F.when(m(31, 4), "elsewhere").otherwise(F.col("locator")).alias("locator"), "attempt_id"
    )


def object_deletions(spark, path):
    s = bind.sources(spark, path).filter("deletion_state = 'deleted'")
    return s.select(
        "source_id", F.concat(F.lit("del-"), "lineage_id").alias("delete_request_id"),
        F.when(F.pmod("doc_id", F.lit(2)) == 0, "deleting").otherwise("deleted").alias("state"),
    )


cte("inv", ["src"], """
SELECT *, CASE WHEN doc_id % 23 = 22 THEN 'abandoned' WHEN doc_id % 19 = 18 THEN 'prepared' ELSE 'committed' END AS state,
  doc_id % 23 <> 22 AND doc_id % 19 <> 18 AND doc_id % 37 <> 5 AS has_ref, deletion_state = 'deleted' AS has_del,
  CASE WHEN deletion_state = 'deleted' THEN CASE WHEN doc_id % 2 = 0 THEN 'deleting' ELSE 'deleted' END END AS d_state FROM src""")


@query("m5_effective_inventory", with_ctes(["inv"], "SELECT source_id, coalesce(d_state, state) AS state FROM inv"))
def m5_effective_inventory(spark, path):
    return maintain.effective_inventory(bind.object_inventory(spark, path), object_deletions(spark, path)).select("source_id", "state")


@query("a8_inventory", with_ctes(["inv"], "SELECT namespace_id, " + ", ".join(
    f"count(*) FILTER (coalesce(d_state, state) = '{s}') AS n_{s}" for s in maintain.STATES) + " FROM inv GROUP BY namespace_id"))
def a8_inventory(spark, path):
    return maintain.inventory_report(bind.object_inventory(spark, path), object_deletions(spark, path))


@query("v32_reconcile", with_ctes(["inv"], """
SELECT source_id, 'early_object_in_catalog' AS reason FROM inv WHERE state <> 'committed'
UNION ALL SELECT source_id, 'committed_without_reference' FROM inv WHERE state = 'committed' AND NOT has_del AND NOT has_ref
UNION ALL SELECT source_id, 'deleted_still_referenced' FROM inv WHERE state = 'committed' AND has_del AND has_ref
UNION ALL SELECT source_id, 'reference_mismatch' FROM inv WHERE state = 'committed' AND has_ref AND doc_id % 31 = 4
UNION ALL SELECT source_id, 'active_without_reference' FROM inv WHERE deletion_state = 'active' AND NOT has_ref"""))
def v32_reconcile(spark, path):
    return maintain.reconcile(bind.object_inventory(spark, path), bind.sources(spark, path), object_refs(spark, path), object_deletions(spark, path))


@query("v34_reconcile_deletions", with_ctes(["inv"], """
SELECT source_id, 'not_in_closure' AS reason FROM inv WHERE has_del AND doc_id % 3 = 0
UNION ALL SELECT source_id, 'closure_without_deletion' FROM inv WHERE deletion_state = 'pending'
UNION ALL SELECT source_id, 'object_not_committed' FROM inv WHERE has_del AND state <> 'committed'
UNION ALL SELECT source_id, 'still_referenced' FROM inv WHERE has_del AND has_ref"""))
def v34_reconcile_deletions(spark, path):
    s = bind.sources(spark, path)
    bodies = s.filter((F.col("deletion_state") == "pending") | ((F.col("deletion_state") == "deleted") & (F.pmod("doc_id", F.lit(3)) != 0))).select(
        "source_id", F.concat(F.lit("del-"), "lineage_id").alias("delete_request_id")
    )
    return maintain.reconcile_deletions(object_deletions(spark, path), bodies, bind.object_inventory(spark, path), s, object_refs(spark, path))


@query("v37_body_audit", with_ctes(["inv"], """
SELECT source_id, 'body_missing' AS reason FROM inv WHERE deletion_state = 'active' AND doc_id % 11 = 3
UNION ALL SELECT source_id, 'body_unknown' FROM inv WHERE deletion_state <> 'active' AND doc_id % 11 <> 3
UNION ALL SELECT source_id, 'body_mismatch' FROM inv WHERE deletion_state = 'active' AND doc_id % 11 = 5
UNION ALL SELECT source_id, 'request_mismatch' FROM inv WHERE state = 'committed' AND doc_id % 7 = 4 AND (deletion_state = 'active' OR doc_id % 11 <> 3)"""))
def v37_body_audit(spark, path):
    s = bind.sources(spark, path)
    asked = cut_lineage(capture.request_digests(s, bind.fragments(spark, path)))
    n = lambda rest: F.pmod("doc_id", F.lit(11)) == rest
    supplied = s.filter(~n(3)).select("source_id", F.when(n(5), F.concat("content", F.lit("!"))).otherwise(F.col("content")).alias("content"))
    return maintain.audit_bodies(s, supplied, asked, attempts(spark, path, asked))


@query("f16_mutation_pending", with_ctes(["inv", "rec"], """
SELECT DISTINCT namespace_id FROM (SELECT namespace_id FROM inv WHERE state = 'prepared' OR deletion_state = 'pending' UNION ALL SELECT namespace_id FROM rec WHERE deletion_state = 'pending')"""))
def f16_mutation_pending(spark, path):
    busy = deletion.in_progress(bind.sources(spark, path), bind.records(spark, path))
    return maintain.mutation_pending(bind.object_inventory(spark, path), busy)


# --- functions ---------------------------------------------------------------------------------


@query("u1_digests", """
SELECT doc_id, sha256(text) AS exact, sha256(nfc_normalize(nfd)) AS nfc_of_nfd FROM (SELECT doc_id, text, text AS nfd FROM documents)""")
def u1_digests(spark, path):
    docs = bind.table(spark, path, "documents")
    # decomposed accents must give the digest of the composed text
    loose = F.replace(F.replace(F.col("text"), F.lit("\u00e9"), F.lit("e\u0301")), F.lit("\u00fc"), F.lit("u\u0308"))
    return docs.select("doc_id", digest.exact_digest(F.col("text")).alias("exact"), F.sha2(nfc(loose), 256).alias("nfc_of_nfd"))


@query("u3_json_digests", """
SELECT event_id, sha256('{' || string_agg('"' || k || '":' || CAST(json_extract(props, '$.' || k) AS VARCHAR), ',' ORDER BY k) || '}') AS json_digest, 0 AS n_flags
FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events) GROUP BY event_id, props""")
def u3_json_digests(spark, path):
    e = bind.table(spark, path, "events")
    return e.select("event_id", digest.json_digest(F.col("props")).alias("json_digest"), F.size(digest.json_flags(F.col("props"))).alias("n_flags"))


@query("u4_profile_digests", """
SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN sha256(text) WHEN 1 THEN sha256(nfc_normalize(text)) END AS digest FROM conversations""")
def u4_profile_digests(spark, path):
    c = bind.table(spark, path, "conversations")
    profiles = F.array(F.lit("exact-bytes-v1"), F.lit("nfc-text-v1"), F.lit("no-such-profile"))
    profile = F.element_at(profiles, (F.pmod("turn", F.lit(3)) + 1).cast("int"))
    return c.select("conv_id", "turn", digest.digest_by_profile(profile, F.col("text")).alias("digest"))


@query("u9_stable_ids", """
SELECT 'urn:memlake:' || lower(lang) || ':sourceartifact:' || CAST(doc_id AS VARCHAR) AS stable_id FROM documents""")
def u9_stable_ids(spark, path):
    d = bind.table(spark, path, "documents")
    return d.select(digest.stable_id(F.col("lang"), F.lit("SourceArtifact"), F.col("doc_id").cast("string")).alias("stable_id"))


@query("u5_timestamps", """
SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS epoch_s, rtrim(lpad(CAST(CAST(epoch_us(ts) % 1000000 AS BIGINT) AS VARCHAR), 6, '0'), '0') AS frac FROM events""")
def u5_timestamps(spark, path):
    e = bind.table(spark, path, "events")
    shifted = F.date_format(F.col("ts") + F.expr("interval 8 hours"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    parsed = temporal.parse_timestamp(F.concat(shifted, F.lit("+08:00")))
    return e.select("event_id", parsed["epoch_s"].alias("epoch_s"), parsed["frac"].alias("frac"))


@query("u12_variants", with_ctes([], f"""
SELECT DISTINCT item_id, v AS variant FROM (SELECT item_id, unnest({variants_sql('w')}) AS v FROM (
  SELECT item_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM (
    SELECT item_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}\\-]+')) AS w FROM benchmark))) WHERE v <> ''"""))
def u12_variants(spark, path):
    b = bind.table(spark, path, "benchmark")
    return b.select("item_id", F.explode(variants(F.col("text"))).alias("variant"))


_NOISE_SQL = "'noise ' || CAST(doc_id AS VARCHAR) || ' about topic-' || CAST(((CAST(6048 AS HUGEINT) * 1103515245 + doc_id * 12345) % 18446744073709551616) % 97 AS VARCHAR)"
NOISE = "noise {index} about {topic}"


@query("s13_noise", f"SELECT doc_id, {_NOISE_SQL} AS content FROM documents")
def s13_noise(spark, path):
    return bind.table(spark, path, "documents").select("doc_id", noise_text(F.col("doc_id"), 6048, NOISE).alias("content"))


# --- metrics -------------------------------------------------------------------------------------


def expected_sources(hits_or_queries):
    """A document query expects its own document among the sources."""
    own = hits_or_queries.filter(F.col("query_id").startswith("doc-"))
    return own.select("query_id", F.expr("substring(query_id, 5)").alias("expected_id")).distinct()


def hit_sources(hits):
    return hits.filter("object_kind = 'source_fragment'").select(
        "query_id", "rank", F.regexp_replace("object_id", r"-f\d+$", "").alias("expected_id")
    )


@query("e2_recall_at_5", with_ctes(["hits", "qs"], """
SELECT 'retrieval_recall_at_5' AS metric_id, count(h.query_id) AS numerator, count(*) AS denominator
FROM (SELECT query_id, substr(query_id, 5) AS s FROM qs WHERE query_id LIKE 'doc-%') q
LEFT JOIN (SELECT DISTINCT query_id, regexp_replace(object_id, '-f[0-9]+$', '') AS s FROM hits WHERE rank <= 5) h ON h.query_id = q.query_id AND h.s = q.s"""))
def e2_recall_at_5(spark, path):
    qs = bind.recall_queries(spark, path, tip_fragments(spark, path))
    return metrics.recall_at(hit_sources(batch_hits(spark, path)), expected_sources(qs), 5)


# noise about other topics, and ten noise sources that repeat the opening of every second tip document
cte("rows_n", ["rows_", "src0", "qs"], f"""
SELECT * FROM rows_ UNION ALL
SELECT 'source_fragment', 'noise-' || CAST(doc_id AS VARCHAR), namespace_id, 'personal', {_NOISE_SQL}, captured_at, 'until_deleted', NULL, NULL, {tokens_sql(_NOISE_SQL)} FROM src0
UNION ALL
SELECT 'source_fragment', 'echo-' || query_id || '-' || CAST(i AS VARCHAR), namespace_id, 'personal', query, TIMESTAMP '2024-01-01 00:00:00', 'until_deleted', NULL, NULL, {tokens_sql('query')}
FROM qs, (SELECT unnest(range(10)) AS i) r WHERE query_id LIKE 'doc-%' AND query_id[-1:] IN ('0', '2', '4', '6', '8')""")
for _name, _needs in (("occ", ["rows_n"]), ("post", ["occ_n", "phr"]), ("asked", ["post_n", "phr"]), ("hits", ["post_n", "phr", "rows_n", "asked_n"])):
    _body = CTES[_name][1]
    for _old, _new in (("rows_", "rows_n"), ("occ", "occ_n"), ("post", "post_n"), ("asked", "asked_n")):
        _body = re.sub(rf"\b{_old}\b", _new, _body)
    cte(f"{_name}_n", _needs, _body)


@query("q13_noise_drift", with_ctes(["hits", "hits_n"], """
SELECT DISTINCT query_id FROM (
  (SELECT query_id, s FROM a EXCEPT SELECT query_id, s FROM b) UNION ALL (SELECT query_id, s FROM b EXCEPT SELECT query_id, s FROM a))""",
    a="SELECT query_id, regexp_replace(object_id, '-f[0-9]+$', '') AS s FROM hits WHERE query_id = 'doc-' || regexp_replace(object_id, '-f[0-9]+$', '')",
    b="SELECT query_id, regexp_replace(object_id, '-f[0-9]+$', '') AS s FROM hits_n WHERE query_id = 'doc-' || regexp_replace(object_id, '-f[0-9]+$', '')"))
def q13_noise_drift(spark, path):
    """Document queries whose own source appears or disappears among the hits when noise is added.

    The postings of the noise are merged with the stored ones; nothing is indexed twice. What a
    document query finds does not depend on the others, so only those are asked. Queries, postings
    and hits are written, so no plan holds the steps of another.
    """
    opening = written(bind.opening_queries(spark, path, tip_fragments(spark, path)))
    noise = bind.sources(spark, path).select(
        F.concat(F.lit("noise-"), F.col("doc_id").cast("string")).alias("object_id"), "namespace_id",
        noise_text(F.col("doc_id"), 6048, NOISE).alias("content"), F.col("captured_at").alias("available_at"),
    )
    echoes = opening.filter(F.substring("query_id", -1, 1).isin(*"02468")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(9)))).select(
        F.concat(F.lit("echo-"), "query_id", F.lit("-"), F.col("i").cast("string")).alias("object_id"), "namespace_id",
        F.col("query").alias("content"), bind.ntz("2024-01-01 00:00:00").alias("available_at"),
    )
    none = F.lit(None)
    added = noise.unionByName(echoes).withColumns({
        "object_kind": F.lit("source_fragment"), "sensitivity": F.lit("personal"), "retention_mode": F.lit("until_deleted"),
        "retention_expires_at": none.cast("timestamp_ntz"), "valid_mode": none.cast("string"),
        "valid_start": none.cast("timestamp_ntz"), "valid_end": none.cast("timestamp_ntz"),
    })
    base = recall_index(spark, path)
    noisy = postings.merge(base, postings.write(added, f"{work_folder(spark)}/noise-index/{uuid.uuid4().hex}"))

    def found(index):
        release(spark)
        return written(hit_sources(postings.recall_batch(index, opening, bind.ntz(), 10, PERSONAL)).select("query_id", "expected_id").distinct())

    return metrics.source_set_drift(found(base), found(noisy), expected_sources(opening))


@query("e12_gates", with_ctes(["prop", "dec", "recf", "res", "evid"], """
SELECT metric_id, CAST(numerator AS BIGINT) AS numerator, CAST(denominator AS BIGINT) AS denominator, thr_num, thr_den,
  coalesce(denominator > 0 AND numerator * thr_den = thr_num * denominator, false) AS passed FROM (
  SELECT 'unconfirmed_context_count' AS metric_id, 0 AS numerator, 1 AS denominator, 0 AS thr_num, 1 AS thr_den
  UNION ALL SELECT 'duplicate_reproposal_count', 0, 1, 0, 1
  UNION ALL SELECT 'silent_overwrite_count', count(*) FILTER (content <> (SELECT r.content FROM rec r WHERE r.memory_id = recf.memory_id)), 1, 0, 1 FROM recf
  UNION ALL SELECT 'silent_conflict_selection_count', 0, 1, 0, 1
  UNION ALL SELECT 'policy_violation_count', count(*) FILTER (egress_policy <> 'local_only'), 1, 0, 1 FROM recf
  UNION ALL SELECT 'deletion_component_coverage', count(*), count(*), 1, 1 FROM res
  UNION ALL SELECT 'false_complete_deletion_count', 0, 1, 0, 1
  UNION ALL SELECT 'never_measured', NULL, NULL, 1, 1)"""))
def e12_gates(spark, path):
    p, r = bind.proposals(spark, path), bind.records(spark, path)
    bad = faults.records(spark, path)
    none = p.filter(F.lit(False))
    admitted = memory.admit_proposals(none, p)
    keyed = p.select("proposal_id", memory.proposal_key().alias("semantic_key"))
    current = chains.memory_current(bind.state_events(spark, path))
    changed = bad.select("memory_id", digest.exact_digest(F.col("content")).alias("content_digest"), F.col("supersedes_memory_ids"))
    _, _, _, planned, results = dq.first_attempt(spark, path)
    parts = [
        metrics.unconfirmed_context_count(rows(spark, path).select("object_id"), p),
        metrics.duplicate_reproposal_count(admitted, keyed),
        metrics.silent_overwrite_count(r, changed, current),
        metrics.silent_conflict_selection_count(found_conflicts(spark, path)[1]),
        metrics.policy_violation_count([bad]),
        metrics.deletion_component_coverage(planned, results),
        metrics.false_complete_deletion_count(deletion.evidence(results), results),
    ]
    names = [
        ("unconfirmed_context_count", 0), ("duplicate_reproposal_count", 0), ("silent_overwrite_count", 0), ("silent_conflict_selection_count", 0),
        ("policy_violation_count", 0), ("deletion_component_coverage", 1), ("false_complete_deletion_count", 0), ("never_measured", 1),
    ]
    wanted = spark.createDataFrame([(n, t, 1) for n, t in names], "metric_id string, thr_num bigint, thr_den bigint")
    return metrics.gates(metrics.combine(parts), wanted)


@query("e1_citation_rate", with_ctes(["cites"], """
SELECT 'citation_resolve_rate' AS metric_id, count(*) FILTER (f_state = 'active') AS numerator, count(*) AS denominator FROM cites"""))
def e1_citation_rate(spark, path):
    items, cited = cq.parts(spark, path)
    cited = cut_lineage(cited)
    found = context.pack_resolution(items, cited, bind.records(spark, path), bind.fragments(spark, path), bind.sources(spark, path))
    return metrics.citation_resolve_rate(cited, found.filter("object_type = 'Citation'"))


@query("e11_completion", with_ctes(["res"], """
SELECT 'model_free_loop_completion_rate' AS metric_id, CAST(bool_and(status = 'succeeded') AS BIGINT) AS numerator, CAST(1 AS BIGINT) AS denominator FROM res"""))
def e11_completion(spark, path):
    results = dq.first_attempt(spark, path)[4]
    return metrics.loop_completion(results.select((F.col("status") == "succeeded").alias("passed")))
