"""Integrity rules: each returns offending rows (rule_id, object_type, object_id, reason).

A batch is accepted only when the frame is empty. Rows carry ids and reason codes, never
content.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.digest import exact_digest, is_digest, nfc_digest
from memlake.functions.governance import not_weaker, sensitivity_rank
from memlake.functions.temporal import valid_time_problem
from memlake.sources.segment import GOVERNANCE

Check = tuple[str, Column]

MEDIA_TYPE = {"text": "text/plain", "markdown": "text/markdown"}
BINDING_ID = r"^origin-binding-[A-Za-z0-9._-]+$"


def violations(df: DataFrame, rule: str, kind: str, object_id: str | Column, checks: Sequence[Check]) -> DataFrame:
    """One row per failed check; the checks share one pass over ``df``."""
    failed = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(reason)) for reason, bad in checks])
    reasons = F.array_distinct(F.filter(failed, lambda r: r.isNotNull()))
    key = F.col(object_id) if isinstance(object_id, str) else object_id
    return df.select(
        F.lit(rule).alias("rule_id"),
        F.lit(kind).alias("object_type"),
        key.alias("object_id"),
        F.explode(reasons).alias("reason"),
    )


def has_duplicates(ids: Column) -> Column:
    return F.size(F.array_distinct(ids)) != F.size(ids)


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def prefixed(df: DataFrame, prefix: str, cols: Sequence[str]) -> list[Column]:
    return [F.col(c).alias(f"{prefix}{c}") for c in cols]


# --- rows ---------------------------------------------------------------------------


def source_rows(sources: DataFrame) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for pair in MEDIA_TYPE.items() for x in pair])
    ids = F.col("supersedes_source_ids")
    return violations(sources, "V1", "SourceArtifact", "source_id", [
        ("InvalidFieldCombination", ~F.coalesce(F.col("media_type") == kinds[F.col("source_kind")], F.lit(False))),
        ("ContentLengthMismatch", F.octet_length("content") != F.col("content_length")),
        ("DigestMismatch", exact_digest(F.col("content")) != F.col("content_digest")),
        ("DuplicateCollectionMember", has_duplicates(ids)),
        ("InvalidFieldCombination", (F.col("version") == 1) != (F.size(ids) == 0)),
    ])


def fragment_rows(fragments: DataFrame) -> DataFrame:
    start, end = F.col("byte_start"), F.col("byte_end")
    checks = [
        ("InvalidByteRange", (start >= end) | (end - start != F.octet_length("content"))),
        ("DigestMismatch", exact_digest(F.col("content")) != F.col("content_digest")),
    ]
    if "heading_path" in fragments.columns:
        checks.append(("EmptyRequiredCollection", F.size("heading_path") == 0))
    return violations(fragments, "V2", "SourceFragment", "fragment_id", checks)


def proposal_rows(proposals: DataFrame) -> DataFrame:
    refs, targets = F.col("source_fragment_refs"), F.col("target_memory_ids")
    return violations(proposals, "V8", "MemoryProposal", "proposal_id", [
        ("EmptyRequiredCollection", F.size(refs) == 0),
        ("DuplicateCollectionMember", has_duplicates(refs) | has_duplicates(targets)),
        ("InvalidFieldCombination", (F.col("operation") == "create") != (F.size(targets) == 0)),
    ])


def decision_rows(decisions: DataFrame) -> DataFrame:
    accepted = F.col("decision") == "accept"
    return violations(decisions, "V11", "MemoryDecision", "decision_id", [
        ("InvalidFieldCombination", accepted != F.col("result_memory_id").isNotNull()),
    ])


def record_rows(records: DataFrame) -> DataFrame:
    refs, old, against = (F.col(c) for c in ("source_fragment_refs", "supersedes_memory_ids", "contradicts_memory_ids"))
    return violations(records, "V12", "MemoryRecord", "memory_id", [
        ("EmptyRequiredCollection", F.size(refs) == 0),
        ("DuplicateCollectionMember", has_duplicates(refs) | has_duplicates(old) | has_duplicates(against)),
        ("DigestMismatch", nfc_digest(F.col("content")) != F.col("content_digest")),
        ("InvalidFieldCombination", (F.col("version") == 1) != (F.size(old) == 0)),
    ])


TERMINAL = ["superseded", "contradicted", "retracted", "expired"]
TERMINAL_CAUSES = ["memory_decision", "memory_record", "delete_request", "policy_basis"]


def event_rows(events: DataFrame) -> DataFrame:
    prev, frm, eff = (F.col(c) for c in ("previous_event_id", "from_state", "effective_at"))
    first = prev.isNull() & frm.isNull() & eff.isNull() & (F.col("cause_type") == "memory_decision")
    later = (
        prev.isNotNull() & frm.eqNullSafe("confirmed") & eff.isNotNull()
        & F.col("cause_type").isin(*TERMINAL_CAUSES)
    )
    allowed = F.when(F.col("event_type") == "confirmed", first).when(
        F.col("event_type").isin(*TERMINAL), later
    ).otherwise(F.lit(False))
    return violations(events, "V13", "MemoryStateEvent", "event_id", [
        ("DuplicateCollectionMember", has_duplicates(F.col("related_memory_ids"))),
        ("InvalidStateTransition", ~allowed),
    ])


def value_rows(df: DataFrame, kind: str, object_id: str) -> DataFrame:
    """Value rules of whichever of the known columns the frame has."""
    have = set(df.columns)
    checks: list[Check] = [("EmptyIdentifier", F.length(object_id) == 0)]
    if "content_digest" in have:
        checks.append(("InvalidDigestValue", ~is_digest(F.col("content_digest"))))
    if "version" in have:
        checks.append(("ZeroVersion", F.col("version") < 1))
    for c in ("confidence", "importance"):
        if c in have:
            checks.append(("InvalidUnitInterval", F.isnan(c) | ~F.col(c).between(0, 1)))
    if "valid_mode" in have:
        problem = valid_time_problem(F.col("valid_mode"), F.col("valid_start"), F.col("valid_end"))
        checks += [(r, problem == r) for r in ("BoundaryCombination", "IntervalOrder")]
    if "retention_mode" in have:
        mode, exp, pol = (F.col(c) for c in ("retention_mode", "retention_expires_at", "retention_policy_id"))
        good = (
            F.when(mode == "until_deleted", exp.isNull() & pol.isNull())
            .when(mode == "until_time", exp.isNotNull() & pol.isNull())
            .when(mode == "policy", exp.isNull() & pol.isNotNull())
            .otherwise(F.lit(False))
        )
        checks.append(("InvalidFieldCombination", ~good))
    if "egress_policy" in have:
        checks.append(("NonLocalGovernance", F.col("egress_policy") != "local_only"))
    if {"budget_limit", "budget_used"} <= have:
        checks.append(("BudgetExceeded", F.col("budget_used") > F.col("budget_limit")))
    if {"was_truncated", "original_bytes", "rendered_bytes", "truncation_reason"} <= have:
        cut = F.col("was_truncated")
        fine = F.when(
            cut, (F.col("rendered_bytes") < F.col("original_bytes")) & F.col("truncation_reason").isNotNull()
        ).otherwise((F.col("rendered_bytes") == F.col("original_bytes")) & F.col("truncation_reason").isNull())
        checks.append(("InvalidFieldCombination", ~fine))
    if {"allowed", "rejected", "truncated"} <= have:
        checks.append(("CountMismatch", F.col("allowed") + F.col("rejected") + F.col("truncated") == 0))
    return violations(df, "V39", kind, object_id, checks)


# --- fragments and sources -------------------------------------------------------------


def fragment_resolution(fragments: DataFrame, sources: DataFrame) -> DataFrame:
    """Fragments whose source, namespace, governance or exact byte range does not match.

    Only ids, ranges and digests of fragments are shuffled. Each meets its body in a plain
    join, where the slice is cut and hashed; no fragments are gathered, and a source with
    very many of them can be split.
    """
    gov = [g for g in GOVERNANCE if g in fragments.columns]
    facts = fragments.select(
        "source_id", *[F.col(c).alias(f"f_{c}") for c in ("fragment_id", "namespace_id", "byte_start", "byte_end", *gov)],
        exact_digest(F.col("content")).alias("f_digest"),
    )
    body = sources.select(
        "source_id", F.col("namespace_id").alias("s_namespace_id"),
        F.col("content").cast("binary").alias("_body"), *prefixed(sources, "s_", gov),
    )
    rows = facts.join(body, "source_id", "left")
    start, end = F.col("f_byte_start"), F.col("f_byte_end")
    piece = F.substring(F.col("_body"), start.cast("int") + 1, (end - start).cast("int"))
    in_range = (start >= 0) & (start < end) & (end <= F.octet_length("_body"))
    found = F.col("_body").isNotNull()
    return violations(rows, "V3", "SourceFragment", "f_fragment_id", [
        ("MissingReference", ~found),
        ("NamespaceMismatch", F.col("f_namespace_id") != F.col("s_namespace_id")),
        ("RecallBlocked", F.col("s_deletion_state") != "active"),
        ("GovernanceMismatch", found & ~not_weaker("f_", "s_")),
        ("SourceSliceMismatch", found & ~(in_range & (F.sha2(piece, 256) == F.col("f_digest")))),
    ])


def fragment_cover(fragments: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources whose fragments do not cover the body exactly once and in order.

    The window runs inside one source, whose size the intake bounds.
    """
    by_source = Window.partitionBy("source_id").orderBy("ordinal")
    gov = [g for g in GOVERNANCE if g in fragments.columns]
    placed = fragments.select(
        "source_id", "fragment_id",
        (F.col("ordinal") != F.row_number().over(by_source) - 1).alias("bad_ordinal"),
        (F.col("byte_start") != F.coalesce(F.lag("byte_end").over(by_source), F.lit(0))).alias("gap"),
        "byte_end", F.struct(*gov).alias("gov"),
    )
    per = placed.groupBy("source_id").agg(
        F.bool_or("bad_ordinal").alias("bad_ordinal"),
        F.bool_or("gap").alias("gap"),
        F.max("byte_end").alias("last_byte"),
        (F.countDistinct("fragment_id") != F.count(F.lit(1))).alias("repeated"),
        F.min("gov").alias("g_min"), F.max("gov").alias("g_max"),
    )
    whole = sources.select("source_id", "content_length", F.struct(*gov).alias("s_gov"))
    rows = whole.join(per, "source_id", "left")
    return violations(rows, "V4", "SourceArtifact", "source_id", [
        ("EmptyRequiredCollection", F.col("last_byte").isNull()),
        ("FragmentSetMismatch", F.col("bad_ordinal") | F.col("gap") | F.col("repeated")
            | (F.col("last_byte") != F.col("content_length"))),
        ("GovernanceMismatch", ~(F.col("g_min").eqNullSafe(F.col("s_gov")) & F.col("g_max").eqNullSafe(F.col("s_gov")))
            & F.col("last_byte").isNotNull()),
    ])


def fragment_batches(fragments: DataFrame, batch: str) -> DataFrame:
    """Batches that mix sources or repeat a fragment id or ordinal."""
    per = fragments.groupBy(batch).agg(
        F.countDistinct("source_id").alias("n_sources"),
        F.countDistinct("fragment_id").alias("n_ids"),
        F.countDistinct("ordinal").alias("n_ordinals"),
        F.count(F.lit(1)).alias("n"),
    )
    return violations(per, "V5", "FragmentBatch", batch, [
        ("IdentityMismatch", F.col("n_sources") != 1),
        ("DuplicateObject", F.col("n_ids") != F.col("n")),
        ("DuplicateOrdinal", F.col("n_ordinals") != F.col("n")),
    ])


def governance_derivation(
    derived: DataFrame, object_id: str, refs: str, parents: DataFrame, parent_id: str, kind: str
) -> DataFrame:
    """Derived objects that are less protected than something they derive from."""
    gov = [g for g in GOVERNANCE if g in parents.columns]
    pairs = derived.select(F.col(object_id).alias("object_id"), *prefixed(derived, "d_", gov), F.explode(refs).alias("ref"))
    source = parents.select(F.col(parent_id).alias("ref"), *prefixed(parents, "p_", gov))
    # one fragment may be the evidence of a large share of all objects
    checked = pairs.join(source, "ref", "left").withColumn("found", F.col("p_sensitivity").isNotNull())
    per = checked.groupBy("object_id").agg(
        F.bool_or(~F.col("found")).alias("missing"),
        F.bool_or(F.col("found") & ~not_weaker("d_", "p_")).alias("weaker"),
    )
    return violations(per, "V6", kind, "object_id", [
        ("MissingReference", F.col("missing")),
        ("GovernanceMismatch", F.col("weaker")),
    ])


def strictest_sensitivity(pairs: DataFrame, object_id: str, sensitivity: str) -> DataFrame:
    """Highest sensitivity per object, the floor a derived object must keep."""
    rank = F.max(sensitivity_rank(F.col(sensitivity))).alias("r")
    names = F.array(F.lit("personal"), F.lit("sensitive"), F.lit("restricted"))
    return pairs.groupBy(object_id).agg(rank).select(
        object_id, F.element_at(names, F.col("r") + 1).alias("required_sensitivity")
    )


def superseded_sources(sources: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """Superseded ids that are missing, of another lineage, or not older; looked up ``among`` all sources."""
    wanted = sources.select(
        "source_id", "namespace_id", "lineage_id", "version", F.explode("supersedes_source_ids").alias("old_id")
    )
    old = (sources if among is None else among).select(
        F.col("source_id").alias("old_id"), F.col("namespace_id").alias("o_ns"),
        F.col("lineage_id").alias("o_lin"), F.col("version").alias("o_ver"),
    )
    rows = wanted.join(old, "old_id", "left")
    return violations(rows, "V7", "SourceArtifact", "source_id", [
        ("MissingReference", F.col("o_ver").isNull()),
        ("IdentityMismatch", (F.col("o_ns") != F.col("namespace_id")) | (F.col("o_lin") != F.col("lineage_id"))),
        ("SupersessionMismatch", F.col("o_ver") >= F.col("version")),
    ]).distinct()


def id_reuse(df: DataFrame, object_id: str, kind: str) -> DataFrame:
    """Ids that more than one row carries."""
    per = df.groupBy(object_id).agg(F.count(F.lit(1)).alias("n"))
    return violations(per, "ID", kind, object_id, [("DuplicateObject", F.col("n") > 1)])


# --- memory ------------------------------------------------------------------------------


def proposal_sources(proposals: DataFrame, fragments: DataFrame, sources: DataFrame) -> DataFrame:
    """Proposals whose evidence is missing, foreign, blocked or less strictly governed."""
    gov = [g for g in GOVERNANCE if g in proposals.columns]
    refs = proposals.select(
        "proposal_id", F.col("namespace_id").alias("p_ns"), *prefixed(proposals, "p_", gov),
        F.explode(F.array_distinct("source_fragment_refs")).alias("fragment_id"),
    )
    evidence = fragments.select("fragment_id", "source_id", F.col("namespace_id").alias("f_ns"), *prefixed(fragments, "f_", gov))
    state = sources.select("source_id", F.col("deletion_state").alias("s_state"))
    # the state of the source is joined to fragments first; one fragment may be evidence of
    # a large share of all proposals
    located = evidence.join(state, "source_id", "left")
    rows = refs.join(located, "fragment_id", "left")
    found = F.col("f_ns").isNotNull()
    per = rows.groupBy("proposal_id").agg(
        F.bool_or(~found | F.col("s_state").isNull()).alias("missing"),
        F.bool_or(F.col("p_ns") != F.col("f_ns")).alias("foreign"),
        F.bool_or((F.col("p_deletion_state") != "active") | (F.col("f_deletion_state") != "active")
                  | (F.col("s_state") != "active")).alias("blocked"),
        F.bool_or(found & ~not_weaker("p_", "f_")).alias("weaker"),
    )
    return violations(per, "V9", "MemoryProposal", "proposal_id", [
        ("MissingReference", F.col("missing")),
        ("NamespaceMismatch", F.col("foreign")),
        ("RecallBlocked", F.col("blocked")),
        ("GovernanceMismatch", F.col("weaker")),
    ])


def proposal_targets(proposals: DataFrame, current: DataFrame) -> DataFrame:
    """Targets of open proposals that do not exist or are no longer confirmed."""
    wanted = proposals.select("proposal_id", "namespace_id", F.explode("target_memory_ids").alias("memory_id"))
    state = current.select("memory_id", F.col("namespace_id").alias("m_ns"), "current_state")
    rows = wanted.join(state, "memory_id", "left")
    return violations(rows, "V10", "MemoryProposal", "proposal_id", [
        ("MissingMemory", F.col("current_state").isNull() | (F.col("m_ns") != F.col("namespace_id"))),
        ("TargetNotConfirmed", F.col("current_state") != "confirmed"),
    ]).distinct()


def materialization(proposals: DataFrame, decisions: DataFrame, records: DataFrame, events: DataFrame) -> DataFrame:
    """Records that disagree with their proposal, accepting decision or first event."""
    gov = [g for g in GOVERNANCE if g in proposals.columns]
    p = proposals.select(*prefixed(proposals, "p_", [
        "proposal_id", "namespace_id", "memory_type", "subject_ref", "content", "source_fragment_refs",
        "target_memory_ids", "observed_at", "valid_mode", "valid_start", "valid_end", "confidence", "importance", *gov,
    ]))
    d = decisions.select(*prefixed(decisions, "d_", ["decision_id", "namespace_id", "proposal_id", "decision", "result_memory_id"]))
    e = events.filter("previous_event_id is null").select(*prefixed(events, "e_", [
        "event_id", "namespace_id", "memory_id", "event_type", "cause_type", "cause_id", "from_state", "effective_at",
    ]))
    rows = (
        records.join(p, F.col("origin_proposal_id") == F.col("p_proposal_id"), "left")
        .join(d, F.col("accepted_by_decision_id") == F.col("d_decision_id"), "left")
        .join(e, F.col("memory_id") == F.col("e_memory_id"), "left")
    )
    same = F.lit(True)
    for c in ("memory_type", "subject_ref", "content", "observed_at", "valid_mode", "valid_start", "valid_end", "confidence", "importance"):
        same = same & F.col(c).eqNullSafe(F.col(f"p_{c}"))
    same = same & same_set(F.col("source_fragment_refs"), F.col("p_source_fragment_refs"))
    same = same & same_set(F.col("supersedes_memory_ids"), F.col("p_target_memory_ids"))
    complete = F.col("p_proposal_id").isNotNull() & F.col("d_decision_id").isNotNull() & F.col("e_event_id").isNotNull()
    linked = (
        (F.col("d_proposal_id") == F.col("p_proposal_id"))
        & (F.col("d_decision") == "accept")
        & F.col("d_result_memory_id").eqNullSafe(F.col("memory_id"))
        & (F.col("e_event_type") == "confirmed")
        & (F.col("e_cause_type") == "memory_decision")
        & (F.col("e_cause_id") == F.col("d_decision_id"))
    )
    spaces = F.lit(True)
    for c in ("p_namespace_id", "d_namespace_id", "e_namespace_id"):
        spaces = spaces & (F.col(c) == F.col("namespace_id"))
    return violations(rows, "V14", "MemoryRecord", "memory_id", [
        ("MissingReference", ~complete),
        ("NamespaceMismatch", complete & ~spaces),
        ("MaterializationMismatch", complete & ~(linked & same)),
        ("GovernanceMismatch", complete & ~not_weaker("", "p_")),
        ("StateProjectionMismatch", complete & (F.col("e_from_state").isNotNull() | F.col("e_effective_at").isNotNull())),
    ])


def event_chains(records: DataFrame, events: DataFrame) -> DataFrame:
    """Memories whose events are not one root and at most one child of it.

    Nothing leaves a terminal state, so a valid chain has one or two events and counting
    per memory decides. Each count is an aggregate with partial sums.
    """
    e = events.select("memory_id", "event_id", "previous_event_id", "event_type", "from_state",
                      F.col("namespace_id").alias("e_ns"))
    root = F.col("previous_event_id").isNull()
    per = e.groupBy("memory_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(root).alias("roots"),
        F.count_if(root & (F.col("event_type") == "confirmed")).alias("good_roots"),
        F.max(F.when(root, F.col("event_id"))).alias("root_id"),
        F.max(F.when(~root, F.struct("previous_event_id", "event_id", "event_type", "from_state"))).alias("child"),
        F.min("e_ns").alias("ns_min"), F.max("e_ns").alias("ns_max"),
        (F.countDistinct("event_id") != F.count(F.lit(1))).alias("repeated"),
    )
    rows = records.select("memory_id", "namespace_id", "current_state", "last_state_event_id").join(per, "memory_id", "left")
    child = F.col("child")
    chain_ok = (
        (F.col("roots") == 1) & (F.col("good_roots") == 1) & (F.col("n") <= 2)
        & ((F.col("n") == 1) | ((child["previous_event_id"] == F.col("root_id")) & child["from_state"].eqNullSafe("confirmed")))
    )
    tip_state = F.when(child.isNull(), F.lit("confirmed")).otherwise(child["event_type"])
    tip_id = F.coalesce(child["event_id"], F.col("root_id"))
    exists = F.col("n").isNotNull()
    return violations(rows, "V15", "MemoryRecord", "memory_id", [
        ("MissingReference", ~exists),
        ("NamespaceMismatch", (F.col("ns_min") != F.col("namespace_id")) | (F.col("ns_max") != F.col("namespace_id"))),
        ("DuplicateObject", F.col("repeated")),
        ("EventChainConflict", exists & ~chain_ok),
        ("StateProjectionMismatch", exists & chain_ok
            & ~((tip_state == F.col("current_state")) & (tip_id == F.col("last_state_event_id")))),
    ])


def supersession(proposals: DataFrame, records: DataFrame, events: DataFrame) -> DataFrame:
    """Supersede proposals whose new record and old records do not line up."""
    p = proposals.filter("operation = 'supersede'").select("proposal_id", "target_memory_ids")
    new = records.select(*prefixed(records, "n_", [
        "memory_id", "origin_proposal_id", "lineage_id", "namespace_id", "version", "supersedes_memory_ids", "valid_start",
    ]))
    pairs = p.join(new, F.col("proposal_id") == F.col("n_origin_proposal_id"))
    sets = pairs.select("n_memory_id", (~same_set(F.col("n_supersedes_memory_ids"), F.col("target_memory_ids"))).alias("sets"))
    each = pairs.select("*", F.explode("target_memory_ids").alias("o_memory_id"))
    old = records.select(*prefixed(records, "o_", ["memory_id", "lineage_id", "namespace_id", "version", "current_state", "last_state_event_id"]))
    ev = events.select(*prefixed(events, "e_", ["event_id", "memory_id", "event_type", "cause_type", "cause_id", "related_memory_ids", "effective_at"]))
    rows = each.join(old, "o_memory_id", "left").join(ev, F.col("o_last_state_event_id") == F.col("e_event_id"), "left")
    found = F.col("o_lineage_id").isNotNull()
    good = (
        (F.col("o_lineage_id") == F.col("n_lineage_id"))
        & (F.col("o_current_state") == "superseded")
        & F.col("e_memory_id").eqNullSafe(F.col("o_memory_id"))
        & F.col("e_event_type").eqNullSafe("superseded")
        & F.col("e_cause_type").eqNullSafe("memory_record")
        & F.col("e_cause_id").eqNullSafe(F.col("n_memory_id"))
        & F.coalesce(F.array_contains("e_related_memory_ids", F.col("n_memory_id")), F.lit(False))
    )
    aligned = F.col("n_valid_start").isNull() | F.col("e_effective_at").eqNullSafe(F.col("n_valid_start"))
    per = rows.groupBy("n_memory_id", "n_version").agg(
        F.bool_or(~found).alias("missing"),
        F.bool_or(F.col("o_namespace_id") != F.col("n_namespace_id")).alias("foreign"),
        F.bool_or(found & ~good).alias("bad"),
        F.bool_or(found & good & ~aligned).alias("time"),
        F.max("o_version").alias("max_version"),
    ).join(sets, "n_memory_id")
    return violations(per, "V16", "MemoryRecord", "n_memory_id", [
        ("MissingReference", F.col("missing")),
        ("NamespaceMismatch", F.col("foreign")),
        ("SupersessionMismatch", F.col("bad") | F.col("sets") | (F.col("max_version") + 1 != F.col("n_version"))),
        ("TimeAlignmentMismatch", F.col("time")),
    ])


def stored_supersession_causes(proposals: DataFrame, records: DataFrame, events: DataFrame) -> DataFrame:
    """Superseded events whose causing record does not really supersede the old one."""
    e = events.filter("event_type = 'superseded'").select(
        "event_id", "memory_id", "cause_type", "cause_id", "related_memory_ids", "effective_at"
    )
    old = records.select("memory_id", *prefixed(records, "o_", ["namespace_id", "lineage_id", "version"]))
    new = records.select(F.col("memory_id").alias("cause_id"), *prefixed(records, "n_", [
        "namespace_id", "lineage_id", "version", "origin_proposal_id", "valid_start", "supersedes_memory_ids",
    ]))
    p = proposals.select(F.col("proposal_id").alias("n_origin_proposal_id"), "operation", "target_memory_ids")
    rows = e.join(old, "memory_id").join(new, "cause_id", "left").join(p, "n_origin_proposal_id", "left")
    good = (
        (F.col("cause_type") == "memory_record")
        & F.array_contains("related_memory_ids", F.col("cause_id"))
        & (F.col("n_namespace_id") == F.col("o_namespace_id"))
        & (F.col("n_lineage_id") == F.col("o_lineage_id"))
        & (F.col("n_version") > F.col("o_version"))
        & F.col("n_valid_start").eqNullSafe(F.col("effective_at"))
        & (F.col("operation") == "supersede")
        & same_set(F.col("target_memory_ids"), F.col("n_supersedes_memory_ids"))
        & F.array_contains("n_supersedes_memory_ids", F.col("memory_id"))
    )
    return violations(rows, "V17", "MemoryStateEvent", "event_id", [
        ("StoredIntegrityMismatch", ~F.coalesce(good, F.lit(False))),
    ])


def event_references(events: DataFrame, decisions: DataFrame, records: DataFrame) -> DataFrame:
    """Events whose cause or related memories do not exist in their namespace."""
    d = decisions.select(F.col("decision_id").alias("ref"), F.col("namespace_id").alias("ns"), F.lit("memory_decision").alias("ref_type"))
    r = records.select(F.col("memory_id").alias("ref"), F.col("namespace_id").alias("ns"), F.lit("memory_record").alias("ref_type"))
    refs = events.select(
        "event_id", F.col("namespace_id").alias("ns"),
        F.explode(F.concat(
            F.array(F.struct(F.col("cause_type").alias("t"), F.col("cause_id").alias("i"))),
            F.transform("related_memory_ids", lambda m: F.struct(F.lit("memory_record").alias("t"), m.alias("i"))),
        )).alias("x"),
    ).select("event_id", "ns", F.col("x.t").alias("ref_type"), F.col("x.i").alias("ref"))
    unresolved = refs.filter("ref_type <> 'policy_basis'").join(d.unionByName(r), ["ns", "ref_type", "ref"], "left_anti")
    return violations(unresolved, "V18", "MemoryStateEvent", "event_id", [("MemoryReference", F.lit(True))]).distinct()


def record_references(records: DataFrame, fragments: DataFrame) -> DataFrame:
    """Records that point at fragments or memories which do not exist."""
    def refs(column: str, kind: str) -> DataFrame:
        return records.select("memory_id", F.lit(kind).alias("kind"), F.explode(column).alias("ref"))

    wanted = (
        refs("source_fragment_refs", "fragment")
        .unionByName(refs("supersedes_memory_ids", "memory"))
        .unionByName(refs("contradicts_memory_ids", "memory"))
    )
    known = fragments.select(F.lit("fragment").alias("kind"), F.col("fragment_id").alias("ref")).unionByName(
        records.select(F.lit("memory").alias("kind"), F.col("memory_id").alias("ref"))
    )
    missing = wanted.join(known, ["kind", "ref"], "left_anti")
    return violations(missing, "V19", "MemoryRecord", "memory_id", [("MissingReference", F.lit(True))]).distinct()


# --- bindings and captures -----------------------------------------------------------------


def binding_id_ok(c: Column) -> Column:
    return c.rlike(BINDING_ID) & (F.octet_length(c) <= 128)


def binding_rows(sources: DataFrame, audit: DataFrame) -> DataFrame:
    """Explicit captures whose binding id is malformed or differs from their audit row."""
    a = audit.select("source_id", F.col("origin_binding_id").alias("a_binding"))
    rows = sources.filter("origin_kind = 'explicit_user_input'").select("source_id", "origin_ref").join(a, "source_id", "left")
    return violations(rows, "V28", "SourceArtifact", "source_id", [
        ("OriginBindingMismatch", ~F.coalesce(binding_id_ok(F.col("origin_ref")), F.lit(False))
            | (F.col("a_binding").isNotNull() & (F.col("a_binding") != F.col("origin_ref")))),
    ])


def expected_bindings(sources: DataFrame) -> DataFrame:
    """Binding of each lineage whose newest version is an active explicit capture."""
    newest = F.max(F.struct("version", "deletion_state", "origin_kind", "origin_ref")).alias("n")
    return (
        sources.groupBy("namespace_id", "lineage_id").agg(newest)
        .filter("n.deletion_state = 'active' and n.origin_kind = 'explicit_user_input'")
        .select("namespace_id", "lineage_id", F.col("n.origin_ref").alias("origin_binding_id"))
    )


def binding_table(bindings: DataFrame, sources: DataFrame, closed_lineages: DataFrame) -> DataFrame:
    """Bindings that differ from the expected ones.

    A leftover binding is allowed only for a lineage inside a closed deletion plan.
    """
    key = ["namespace_id", "lineage_id"]
    want = expected_bindings(sources).withColumnRenamed("origin_binding_id", "expected")
    have = bindings.select(*key, F.col("origin_binding_id").alias("actual"))
    closed = closed_lineages.select(*key).distinct().withColumn("closed", F.lit(True))
    rows = want.join(have, key, "full_outer").join(closed, key, "left")
    return violations(rows, "V29", "OriginBinding", "lineage_id", [
        ("missing", F.col("actual").isNull()),
        ("leftover", F.col("expected").isNull() & F.col("closed").isNull()),
        ("OriginBindingMismatch", F.col("actual") != F.col("expected")),
    ])


def active_captures(sources: DataFrame, fragments: DataFrame, bindings: DataFrame, audit: DataFrame) -> DataFrame:
    """Active explicit captures without binding, audit row or complete fragments."""
    live = sources.filter("deletion_state = 'active' and origin_kind = 'explicit_user_input'")
    b = bindings.select("namespace_id", "lineage_id", F.col("origin_binding_id").alias("b_id"))
    a = audit.select("source_id", F.col("origin_binding_id").alias("a_id"), "outcome", "recorded_at")
    incomplete = fragment_cover(fragments, live).select(F.col("object_id").alias("source_id")).distinct().withColumn("cover", F.lit(True))
    rows = (
        live.select("source_id", "namespace_id", "lineage_id", "version", "origin_ref", "captured_at")
        .join(b, ["namespace_id", "lineage_id"], "left")
        .join(a, "source_id", "left")
        .join(incomplete, "source_id", "left")
    )
    outcome = F.when(F.col("version") == 1, F.lit("created")).otherwise(F.lit("versioned"))
    return violations(rows, "V30", "SourceArtifact", "source_id", [
        ("OriginBindingMismatch", ~F.col("b_id").eqNullSafe(F.col("origin_ref"))),
        ("CaptureAuditMismatch", ~(F.col("a_id").eqNullSafe(F.col("origin_ref")) & F.col("outcome").eqNullSafe(outcome)
                                   & F.col("recorded_at").eqNullSafe(F.col("captured_at")))),
        ("FragmentSetMismatch", F.col("cover").isNotNull()),
    ])


def namespace_rows(tables: dict[str, tuple[DataFrame, str]], namespaces: Sequence[str]) -> DataFrame:
    """Rows of any table outside the namespaces the store holds."""
    out = None
    for kind, (df, key) in tables.items():
        part = violations(df, "M6", kind, key, [("NamespaceMismatch", ~F.col("namespace_id").isin(*namespaces))])
        out = part if out is None else out.unionByName(part)
    return out
