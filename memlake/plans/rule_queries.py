"""Integrity rules over the bound tables with faults laid over them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memlake.operators import rules, versions
from memlake.plans import faults
from memlake.plans.base_sql import with_ctes
from memlake.plans.registry import query
from memlake.sources import bind


def rule_sql(rule: str, kind: str, key: str, frm: str, checks: list[tuple[str, str]], distinct: bool = True) -> str:
    parts = [
        f"SELECT '{rule}' AS rule_id, '{kind}' AS object_type, {key} AS object_id, '{reason}' AS reason FROM {frm} WHERE {bad}"
        for reason, bad in checks
    ]
    return (" UNION " if distinct else " UNION ALL ").join(parts)


def rank(col: str) -> str:
    return f"(CASE {col} WHEN 'personal' THEN 0 WHEN 'sensitive' THEN 1 ELSE 2 END)"


def not_weaker(d: str, s: str) -> str:
    return (
        f"({rank(d + 'sensitivity')} >= {rank(s + 'sensitivity')} AND CASE "
        f"WHEN {s}retention_mode = 'until_deleted' THEN {d}retention_mode IN ('until_deleted', 'until_time') "
        f"WHEN {d}retention_mode = 'until_time' THEN {d}retention_expires_at <= {s}retention_expires_at ELSE false END "
        f"AND ({s}deletion_state = 'active' OR {d}deletion_state <> 'active'))"
    )


@query("v1_source_rows", with_ctes(["srcf"], rule_sql("V1", "SourceArtifact", "source_id", "srcf", [
    ("InvalidFieldCombination", "media_type <> CASE source_kind WHEN 'text' THEN 'text/plain' ELSE 'text/markdown' END OR (version = 1) <> (len(supersedes) = 0)"),
    ("ContentLengthMismatch", "strlen(content) <> content_length"),
    ("DigestMismatch", "sha256(content) <> content_digest"),
    ("DuplicateCollectionMember", "len(list_distinct(supersedes)) <> len(supersedes)"),
])))
def v1_source_rows(spark, path):
    return rules.source_rows(faults.sources(spark, path))


@query("v2_fragment_rows", with_ctes(["fragf"], rule_sql("V2", "SourceFragment", "fragment_id", "fragf", [
    ("InvalidByteRange", "byte_start >= byte_end OR byte_end - byte_start <> strlen(content)"),
    ("DigestMismatch", "sha256(content) <> content_digest"),
])))
def v2_fragment_rows(spark, path):
    return rules.fragment_rows(faults.fragments(spark, path))


_V3 = """
SELECT f.*, s.source_id AS s_id, s.deletion_state AS s_state,
  sha256(CAST(encode(s.content)[f.byte_start + 1 : f.byte_end] AS BLOB)) AS slice_digest, sha256(f.content) AS own_digest,
  strlen(s.content) AS s_len, {nw} AS fine
FROM fragf f LEFT JOIN src s ON s.source_id = f.source_id""".format(nw=not_weaker("f.", "s."))


@query("v3_fragment_resolution", with_ctes(["fragf", "src"], rule_sql("V3", "SourceFragment", "fragment_id", "x", [
    ("MissingReference", "s_id IS NULL"),
    ("RecallBlocked", "s_state <> 'active'"),
    ("GovernanceMismatch", "s_id IS NOT NULL AND NOT fine"),
    ("SourceSliceMismatch", "s_id IS NOT NULL AND (byte_end > s_len OR slice_digest <> own_digest)"),
]), x=_V3))
def v3_fragment_resolution(spark, path):
    return rules.fragment_resolution(faults.fragments(spark, path), bind.sources(spark, path))


@query("v4_fragment_cover", with_ctes(["fragf", "src"], rule_sql("V4", "SourceArtifact", "source_id", "y", [
    ("EmptyRequiredCollection", "last_byte IS NULL"),
    ("FragmentSetMismatch", "bad_ordinal OR gap OR last_byte <> content_length"),
    ("GovernanceMismatch", "NOT same_gov"),
]), x="""
SELECT true_source_id AS source_id, byte_end, ordinal <> row_number() OVER w - 1 AS bad_ordinal,
  byte_start <> coalesce(lag(byte_end) OVER w, 0) AS gap, sensitivity FROM fragf WHERE ordinal % 19 <> 12
WINDOW w AS (PARTITION BY true_source_id ORDER BY ordinal)""", y="""
SELECT s.source_id, s.content_length, p.last_byte, p.bad_ordinal, p.gap, p.lo = s.sensitivity AND p.hi = s.sensitivity AS same_gov
FROM src s LEFT JOIN (SELECT source_id, max(byte_end) AS last_byte, bool_or(bad_ordinal) AS bad_ordinal, bool_or(gap) AS gap,
  min(sensitivity) AS lo, max(sensitivity) AS hi FROM x GROUP BY source_id) p ON p.source_id = s.source_id"""))
def v4_fragment_cover(spark, path):
    return rules.fragment_cover(faults.fragments(spark, path), bind.sources(spark, path))


@query("w1_fragment_gaps", with_ctes(["fragf"], """
SELECT fragment_id, byte_start, expected_start FROM (
  SELECT fragment_id, source_id, byte_start, coalesce(lag(byte_end) OVER (PARTITION BY source_id ORDER BY ordinal), 0) AS expected_start
  FROM fragf WHERE source_id <> 'src-missing') WHERE byte_start <> expected_start"""))
def w1_fragment_gaps(spark, path):
    f = faults.fragments(spark, path).filter("source_id <> 'src-missing'")
    # one source, whose size the intake bounds
    w = Window.partitionBy("source_id").orderBy("ordinal")
    return f.select(
        "fragment_id", "byte_start", F.coalesce(F.lag("byte_end").over(w), F.lit(0)).alias("expected_start")
    ).filter("byte_start <> expected_start")


@query("v5_fragment_batches", with_ctes(["frag"], rule_sql("V5", "FragmentBatch", "batch", "x", [
    ("IdentityMismatch", "n_sources <> 1"), ("DuplicateObject", "n_ids <> n"), ("DuplicateOrdinal", "n_ordinals <> n"),
]), x="""
SELECT batch, count(*) AS n, count(DISTINCT source_id) AS n_sources, count(DISTINCT fragment_id) AS n_ids, count(DISTINCT ordinal) AS n_ordinals
FROM (SELECT *, CASE WHEN source_id LIKE '%0' THEN substr(source_id, 1, 10) ELSE source_id END AS batch FROM frag) GROUP BY batch"""))
def v5_fragment_batches(spark, path):
    batch = F.when(F.col("source_id").endswith("0"), F.substring("source_id", 1, 10)).otherwise(F.col("source_id"))
    return rules.fragment_batches(bind.fragments(spark, path, with_content=False).withColumn("batch", batch), "batch")


@query("v6_governance", with_ctes(["propf", "fragf"], rule_sql("V6", "MemoryProposal", "proposal_id", "x", [
    ("MissingReference", "NOT found"), ("GovernanceMismatch", "found AND NOT fine"),
]), x=f"""
SELECT p.proposal_id, f.fragment_id IS NOT NULL AS found, {not_weaker('p.', 'f.')} AS fine
FROM propf p LEFT JOIN frag f ON f.fragment_id = p.fragment_ref"""))
def v6_governance(spark, path):
    return rules.governance_derivation(
        faults.proposals(spark, path), "proposal_id", "source_fragment_refs",
        bind.fragments(spark, path, with_content=False), "fragment_id", "MemoryProposal",
    )


@query("v7_superseded_sources", with_ctes(["srcf"], rule_sql("V7", "SourceArtifact", "source_id", "x", [
    ("MissingReference", "o_ver IS NULL"),
    ("IdentityMismatch", "o_ns <> namespace_id OR o_lin <> lineage_id"),
    ("SupersessionMismatch", "o_ver >= version"),
]), x="""
SELECT s.*, o.version AS o_ver, o.namespace_id AS o_ns, o.lineage_id AS o_lin
FROM (SELECT source_id, namespace_id, lineage_id, version, unnest(supersedes) AS old_id FROM srcf) s LEFT JOIN src o ON o.source_id = s.old_id"""))
def v7_superseded_sources(spark, path):
    return rules.superseded_sources(faults.sources(spark, path))


@query("v8_proposal_rows", with_ctes(["propf"], rule_sql("V8", "MemoryProposal", "proposal_id", "propf", [
    ("InvalidFieldCombination", "(operation = 'create') <> (target_memory_id IS NULL)"),
])))
def v8_proposal_rows(spark, path):
    return rules.proposal_rows(faults.proposals(spark, path))


@query("v9_proposal_sources", with_ctes(["propf", "frag"], rule_sql("V9", "MemoryProposal", "proposal_id", "x", [
    ("MissingReference", "NOT found"), ("NamespaceMismatch", "found AND f_ns <> p_ns"),
    ("RecallBlocked", "p_state <> 'active' OR f_state <> 'active'"), ("GovernanceMismatch", "found AND NOT fine"),
]), x=f"""
SELECT p.proposal_id, p.namespace_id AS p_ns, f.namespace_id AS f_ns, p.deletion_state AS p_state, f.deletion_state AS f_state,
  f.fragment_id IS NOT NULL AS found, {not_weaker('p.', 'f.')} AS fine
FROM propf p LEFT JOIN frag f ON f.fragment_id = p.fragment_ref"""))
def v9_proposal_sources(spark, path):
    return rules.proposal_sources(
        faults.proposals(spark, path), bind.fragments(spark, path, with_content=False), bind.sources(spark, path)
    )


@query("v10_proposal_targets", with_ctes(["prop", "rec"], rule_sql("V10", "MemoryProposal", "proposal_id", "x", [
    ("MissingMemory", "current_state IS NULL OR m_ns <> p_ns"), ("TargetNotConfirmed", "current_state <> 'confirmed'"),
]), x="""
SELECT p.proposal_id, p.namespace_id AS p_ns, r.namespace_id AS m_ns, r.current_state
FROM prop p LEFT JOIN rec r ON r.memory_id = p.target_memory_id WHERE p.target_memory_id IS NOT NULL"""))
def v10_proposal_targets(spark, path):
    return rules.proposal_targets(bind.proposals(spark, path), bind.records(spark, path))


@query("v11_decision_rows", with_ctes(["decf"], rule_sql("V11", "MemoryDecision", "decision_id", "decf", [
    ("InvalidFieldCombination", "(decision = 'accept') <> (result_memory_id IS NOT NULL)"),
])))
def v11_decision_rows(spark, path):
    return rules.decision_rows(faults.decisions(spark, path))


@query("v12_record_rows", with_ctes(["recf"], rule_sql("V12", "MemoryRecord", "memory_id", "recf", [
    ("EmptyRequiredCollection", "fragment_ref IS NULL"), ("DuplicateCollectionMember", "dup_old"),
    ("DigestMismatch", "sha256(nfc_normalize(content)) <> content_digest"),
    ("InvalidFieldCombination", "(version = 1) <> (prev_memory_id IS NULL)"),
])))
def v12_record_rows(spark, path):
    return rules.record_rows(faults.records(spark, path))


@query("v13_event_rows", with_ctes(["evtf"], rule_sql("V13", "MemoryStateEvent", "event_id", "evtf", [
    ("InvalidStateTransition", "CASE WHEN event_type = 'confirmed' THEN NOT (previous_event_id IS NULL AND from_state IS NULL AND effective_at IS NULL AND cause_type = 'memory_decision') ELSE previous_event_id IS NULL OR from_state IS NULL OR from_state <> 'confirmed' OR effective_at IS NULL END"),
])))
def v13_event_rows(spark, path):
    return rules.event_rows(faults.state_events(spark, path))


@query("v14_materialization", with_ctes(["recf", "propf", "decf", "evtf"], rule_sql("V14", "MemoryRecord", "memory_id", "x", [
    ("MissingReference", "NOT complete"),
    ("MaterializationMismatch", "complete AND NOT coalesce(same, false)"),
    ("GovernanceMismatch", "complete AND NOT fine"),
]), x=f"""
SELECT r.memory_id, p.proposal_id IS NOT NULL AND d.decision_id IS NOT NULL AND e.event_id IS NOT NULL AS complete,
  r.content = p.content AND r.fragment_ref IS NOT DISTINCT FROM p.fragment_ref AND r.confidence = p.confidence
  AND r.valid_end IS NULL AND r.prev_memory_id IS NOT DISTINCT FROM p.target_memory_id
  AND d.decision = 'accept' AND d.result_memory_id = r.memory_id AND d.proposal_id = p.proposal_id AND e.cause_id = d.decision_id AS same,
  {not_weaker('r.', 'p.')} AS fine
FROM recf r LEFT JOIN propf p ON p.proposal_id = r.origin_proposal_id LEFT JOIN decf d ON d.decision_id = r.accepted_by_decision_id
LEFT JOIN evtf e ON e.memory_id = r.memory_id AND e.previous_event_id IS NULL"""))
def v14_materialization(spark, path):
    return rules.materialization(
        faults.proposals(spark, path), faults.decisions(spark, path),
        faults.records(spark, path), faults.state_events(spark, path),
    )


@query("v15_event_chain", with_ctes(["recf", "evtf"], rule_sql("V15", "MemoryRecord", "memory_id", "x", [
    ("MissingReference", "n IS NULL"), ("EventChainConflict", "n IS NOT NULL AND NOT ok"),
    ("StateProjectionMismatch", "n IS NOT NULL AND ok AND (tip_state <> current_state OR tip_id <> last_state_event_id)"),
]), x="""
SELECT r.memory_id, r.current_state, r.last_state_event_id, e.*,
  e.roots = 1 AND (e.n = 1 OR (e.n = 2 AND e.child_from = 'confirmed' AND e.child_prev = e.root_id)) IS TRUE AS ok,
  coalesce(e.child_type, 'confirmed') AS tip_state, coalesce(e.child_id, e.root_id) AS tip_id
FROM recf r LEFT JOIN (SELECT memory_id AS m, count(*) AS n, count(*) FILTER (previous_event_id IS NULL) AS roots,
    max(event_id) FILTER (previous_event_id IS NULL) AS root_id, max(event_id) FILTER (previous_event_id IS NOT NULL) AS child_id,
    max(event_type) FILTER (previous_event_id IS NOT NULL) AS child_type, max(previous_event_id) AS child_prev,
    max(from_state) FILTER (previous_event_id IS NOT NULL) AS child_from
  FROM evtf GROUP BY memory_id) e ON e.m = r.memory_id"""))
def v15_event_chain(spark, path):
    return rules.event_chains(faults.records(spark, path), faults.state_events(spark, path))


@query("v16_supersession", with_ctes(["recf", "evtf", "prop"], rule_sql("V16", "MemoryRecord", "memory_id", "x", [
    ("MissingReference", "o_id IS NULL"),
    ("SupersessionMismatch", "(o_id IS NOT NULL AND NOT coalesce(good, false)) OR o_version + 1 <> n_version"),
    ("TimeAlignmentMismatch", "o_id IS NOT NULL AND coalesce(good, false) AND effective_at <> n_start"),
]), x="""
SELECT n.memory_id, n.version AS n_version, o.memory_id AS o_id, o.version AS o_version, n.valid_start AS n_start, e.effective_at,
  o.lineage_id = n.lineage_id AND o.current_state = 'superseded' AND e.memory_id = o.memory_id AND e.event_type = 'superseded'
  AND e.cause_id = n.memory_id AND e.related_memory_id = n.memory_id AS good
FROM prop p JOIN recf n ON n.origin_proposal_id = p.proposal_id
LEFT JOIN recf o ON o.memory_id = p.target_memory_id LEFT JOIN evtf e ON e.event_id = o.last_state_event_id
WHERE p.operation = 'supersede'"""))
def v16_supersession(spark, path):
    return rules.supersession(bind.proposals(spark, path), faults.records(spark, path), faults.state_events(spark, path))


@query("v17_supersession_causes", with_ctes(["rec", "evtf", "propf"], rule_sql("V17", "MemoryStateEvent", "event_id", "x", [
    ("StoredIntegrityMismatch", "NOT coalesce(good, false)"),
]), x="""
SELECT e.event_id, e.cause_type = 'memory_record' AND e.related_memory_id = e.cause_id AND n.lineage_id = o.lineage_id
  AND n.namespace_id = o.namespace_id AND n.version > o.version AND n.valid_start = e.effective_at AND p.operation = 'supersede'
  AND p.target_memory_id = n.prev_memory_id AND n.prev_memory_id = e.memory_id AS good
FROM evtf e JOIN rec o ON o.memory_id = e.memory_id LEFT JOIN rec n ON n.memory_id = e.cause_id
LEFT JOIN propf p ON p.proposal_id = n.origin_proposal_id WHERE e.event_type = 'superseded'"""))
def v17_supersession_causes(spark, path):
    return rules.stored_supersession_causes(
        faults.proposals(spark, path), bind.records(spark, path), faults.state_events(spark, path)
    )


@query("v18_event_references", with_ctes(["evtf", "dec", "rec"], rule_sql("V18", "MemoryStateEvent", "event_id", "evtf", [
    ("MemoryReference", """NOT (CASE cause_type WHEN 'memory_decision' THEN cause_id IN (SELECT decision_id FROM dec)
      ELSE cause_id IN (SELECT memory_id FROM rec) END)"""),
])))
def v18_event_references(spark, path):
    return rules.event_references(
        faults.state_events(spark, path), bind.decisions(spark, path), bind.records(spark, path)
    )


@query("v19_record_references", with_ctes(["recf", "frag"], rule_sql("V19", "MemoryRecord", "memory_id", "recf", [
    ("MissingReference", "fragment_ref NOT IN (SELECT fragment_id FROM frag)"),
])))
def v19_record_references(spark, path):
    return rules.record_references(faults.records(spark, path), bind.fragments(spark, path, with_content=False))


@query("v28_binding_rows", with_ctes(["srcf", "src"], rule_sql("V28", "SourceArtifact", "source_id", "srcf", [
    ("OriginBindingMismatch", r"NOT regexp_full_match(origin_ref, 'origin-binding-[A-Za-z0-9._-]+')"),
])))
def v28_binding_rows(spark, path):
    return rules.binding_rows(faults.sources(spark, path), bind.capture_audit(spark, path))


@query("v29_binding_table", with_ctes(["src", "tips"], """
SELECT 'V29' AS rule_id, 'OriginBinding' AS object_type, lineage_id AS object_id, 'leftover' AS reason
FROM (SELECT DISTINCT namespace_id, lineage_id FROM src) b
WHERE lineage_id NOT IN (SELECT lineage_id FROM tips)
  AND lineage_id NOT IN (SELECT lineage_id FROM src WHERE deletion_state = 'deleted')"""))
def v29_binding_table(spark, path):
    s = bind.sources(spark, path)
    closed = s.filter("deletion_state = 'deleted'").select("namespace_id", "lineage_id")
    return rules.binding_table(bind.origin_bindings(spark, path), s, closed)


@query("v30_active_captures", with_ctes(["srcf", "fragf"], rule_sql("V30", "SourceArtifact", "source_id", "z", [
    ("OriginBindingMismatch", "origin_ref <> 'origin-binding-' || lineage_id"),
    ("CaptureAuditMismatch", "origin_ref <> 'origin-binding-' || lineage_id"),
    ("FragmentSetMismatch", "last_byte IS NULL OR bad_ordinal OR gap OR last_byte <> content_length OR NOT same_gov"),
]), x="""
SELECT true_source_id AS source_id, byte_end, ordinal <> row_number() OVER w - 1 AS bad_ordinal,
  byte_start <> coalesce(lag(byte_end) OVER w, 0) AS gap, sensitivity FROM fragf WHERE ordinal % 19 <> 12
WINDOW w AS (PARTITION BY true_source_id ORDER BY ordinal)""", z="""
SELECT s.source_id, s.lineage_id, s.origin_ref, s.content_length, p.last_byte, p.bad_ordinal, p.gap, p.lo = s.sensitivity AND p.hi = s.sensitivity AS same_gov
FROM srcf s LEFT JOIN (SELECT source_id, max(byte_end) AS last_byte, bool_or(bad_ordinal) AS bad_ordinal, bool_or(gap) AS gap,
  min(sensitivity) AS lo, max(sensitivity) AS hi FROM x GROUP BY source_id) p ON p.source_id = s.source_id
WHERE s.deletion_state = 'active'"""))
def v30_active_captures(spark, path):
    return rules.active_captures(
        faults.sources(spark, path), faults.fragments(spark, path),
        bind.origin_bindings(spark, path), bind.capture_audit(spark, path),
    )


@query("v39_value_rows", with_ctes(["recf"], rule_sql("V39", "MemoryRecord", "memory_id", "recf", [
    ("ZeroVersion", "version < 1"), ("InvalidUnitInterval", "confidence NOT BETWEEN 0 AND 1"),
    ("BoundaryCombination", "valid_end IS NOT NULL"), ("NonLocalGovernance", "egress_policy <> 'local_only'"),
])))
def v39_value_rows(spark, path):
    return rules.value_rows(faults.records(spark, path), "MemoryRecord", "memory_id")


@query("v40_catalog_rows", with_ctes(["src", "tips"], """
SELECT t.namespace_id, t.lineage_id, 'version_gap' AS reason FROM tips t
JOIN (SELECT lineage_id, count(*) AS n, max(version) AS m FROM src WHERE deletion_state = 'active' GROUP BY lineage_id) c
  ON c.lineage_id = t.lineage_id WHERE c.n <> c.m"""))
def v40_catalog_rows(spark, path):
    s = bind.sources(spark, path)
    return versions.version_chain_problems(s, versions.tips(s)).select("namespace_id", "lineage_id", "reason")


_M6 = [
    ("SourceArtifact", "source_id", "src"), ("SourceFragment", "fragment_id", "frag"), ("MemoryProposal", "proposal_id", "prop"), ("MemoryDecision", "decision_id", "dec"),
    ("MemoryRecord", "memory_id", "rec"), ("MemoryStateEvent", "event_id", "evt"), ("CaptureAudit", "source_id", "src"), ("BodyObject", "source_id", "src"),
    ("OriginBinding", "lineage_id", "(SELECT DISTINCT namespace_id, origin_ref, lineage_id FROM src)"),
]


@query("m6_namespaces", with_ctes(["src", "frag", "prop", "dec", "rec", "evt"], "\nUNION ALL ".join(
    f"SELECT 'M6' AS rule_id, '{kind}' AS object_type, {key} AS object_id, 'NamespaceMismatch' AS reason FROM {of} WHERE namespace_id NOT IN ('ns-en', 'ns-fr', 'ns-de')" for kind, key, of in _M6)))
def m6_namespaces(spark, path):
    tables = [bind.sources, lambda s, p: bind.fragments(s, p, False), bind.proposals, bind.decisions, bind.records, bind.state_events, bind.capture_audit, bind.object_inventory, bind.origin_bindings]
    return rules.namespace_rows({kind: (t(spark, path), key) for (kind, key, _), t in zip(_M6, tables, strict=True)}, ["ns-en", "ns-fr", "ns-de"])


@query("u15_required_sensitivity", with_ctes(["prop", "frag"], """
SELECT f.source_id, ['personal', 'sensitive', 'restricted'][max(CASE f.sensitivity WHEN 'personal' THEN 1 WHEN 'sensitive' THEN 2 ELSE 3 END)] AS required_sensitivity
FROM prop p JOIN frag f ON f.fragment_id = p.fragment_ref GROUP BY f.source_id"""))
def u15_required_sensitivity(spark, path):
    refs = bind.proposals(spark, path).select(F.explode("source_fragment_refs").alias("fragment_id"))
    pairs = refs.join(bind.fragments(spark, path, with_content=False).select("fragment_id", "source_id", "sensitivity"), "fragment_id")
    return rules.strictest_sensitivity(pairs, "source_id", "sensitivity")
