"""Planned deletion: targets, plan, execution closure, component results, evidence.

Everything works on many requests at once; a request id is a grouping column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions.digest import row_fingerprint, set_digest
from memlake.functions.ranking import range_rank
from memlake.functions.skew import small_side
from memlake.operators.chains import reachable
from memlake.operators.rules import violations
from memlake.session import release, written

# fixed values: component key, component type, required action, in plan order
PROFILE = [
    ("source-body", "source_body", "delete"),
    ("source-metadata", "source_metadata", "retain_minimal"),
    ("source-fragment", "source_fragment", "delete"),
    ("memory-proposal", "memory_proposal", "redact"),
    ("memory-decision", "memory_decision", "retain_minimal"),
    ("memory-record", "memory_record", "redact"),
    ("memory-state-event", "memory_state_event", "retain_minimal"),
    ("full-text-index", "full_text_index", "delete"),
    ("context-cache", "context_cache", "delete"),
    ("minimal-audit", "minimal_audit", "retain_minimal"),
]
OUTCOME = {"delete": "deleted", "redact": "redacted", "retain_minimal": "retained_minimal"}
MARKER = "[redacted:local-deletion]"
FAILURE_CODE = "deletion-component-failed"
#: One bit per component type, for what one attempt has done of a request.
BIT = {t: 1 << i for i, (_, t, _) in enumerate(PROFILE)}
REQUEST = "delete_request_id"
#: So many digests of closure rows one task holds at once.
TASK_ROWS = 250_000
TYPE_RANK = {"SourceArtifact": 0, "SourceFragment": 1, "MemoryProposal": 2, "MemoryDecision": 3,
             "MemoryRecord": 4, "MemoryStateEvent": 5, "DeleteRequest": 7}


def _mapped(pairs: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])[key]


def type_rank(object_type: Column) -> Column:
    return _mapped(TYPE_RANK, object_type)


def _ref(kind: str, key: str) -> list[Column]:
    return [F.lit(kind).alias("object_type"), F.col(key).alias("object_id")]


def linked_records(requests: DataFrame, sources: DataFrame, fragments: DataFrame, records: DataFrame) -> DataFrame:
    """(request, memory): active records whose evidence lies in active sources of the lineage."""
    hit = (
        sources.filter("deletion_state = 'active'").select("source_id", "namespace_id", "lineage_id")
        .join(requests.select(REQUEST, "namespace_id", "lineage_id"), ["namespace_id", "lineage_id"])
    )
    evidence = fragments.filter("deletion_state = 'active'").select("fragment_id", "source_id").join(hit, "source_id")
    refs = records.filter("deletion_state = 'active'").select("memory_id", "namespace_id", F.explode("source_fragment_refs").alias("fragment_id"))
    # one fragment may be the evidence of a large share of all records: the adaptive skew join splits it
    found = refs.join(evidence.withColumnRenamed("namespace_id", "e_ns"), "fragment_id")
    return found.filter("namespace_id = e_ns").select(REQUEST, "memory_id").distinct()


def targets(requests: DataFrame, sources: DataFrame, fragments: DataFrame, records: DataFrame) -> DataFrame:
    """(request, object): active versions of the lineage, linked records and all that supersede them."""
    live = sources.filter("deletion_state = 'active'").select("source_id", "namespace_id", "lineage_id")
    versions = live.join(requests.select(REQUEST, "namespace_id", "lineage_id"), ["namespace_id", "lineage_id"])
    active = records.filter("deletion_state = 'active'")
    edges = active.select(F.explode("supersedes_memory_ids").alias("src"), F.col("memory_id").alias("dst"))
    linked = linked_records(requests, sources, fragments, records)
    closed = reachable(linked.select(REQUEST, F.col("memory_id").alias("node")), edges, REQUEST)
    return versions.select(REQUEST, *_ref("SourceArtifact", "source_id")).unionByName(
        closed.select(REQUEST, *_ref("MemoryRecord", "node"))
    )


def ordered_targets(found: DataFrame) -> DataFrame:
    """Targets with their ordinal: object type first, then id."""
    ranked = found.withColumn("type_rank", type_rank(F.col("object_type")))
    seq = range_rank(ranked, [REQUEST], ["type_rank", "object_id"], "seq")
    return seq.select(REQUEST, "object_type", "object_id", (F.col("seq") - 1).alias("ordinal"))


def ref_json() -> Column:
    return F.concat(
        F.lit('{"object_id":'), F.to_json(F.array("object_id")).substr(F.lit(2), F.length(F.to_json(F.array("object_id"))) - 2),
        F.lit(',"object_type":"'), F.col("object_type"), F.lit('"}'),
    )


def closure_digests(found: DataFrame) -> DataFrame:
    """Number of targets and digest of the frozen target set per request."""
    return set_digest(found, [REQUEST], ref_json(), name="target_digest").withColumnRenamed("n_members", "target_count")


def profile_array() -> Column:
    return F.array(*[
        F.struct(F.lit(i).alias("ordinal"), F.lit(k).alias("component_key"), F.lit(t).alias("component_type"), F.lit(a).alias("required_action"))
        for i, (k, t, a) in enumerate(PROFILE)
    ])


def plan(found: DataFrame) -> DataFrame:
    """Ten components per request, each bound to the frozen target set."""
    return closure_digests(found).select(REQUEST, "target_count", "target_digest", F.inline(profile_array()))


def execution_closure(
    found: DataFrame, fragments: DataFrame, proposals: DataFrame, decisions: DataFrame, records: DataFrame, events: DataFrame
) -> DataFrame:
    """(request, component_type, object): what each component will touch."""
    src = found.filter("object_type = 'SourceArtifact'").select(REQUEST, F.col("object_id").alias("source_id"))
    mem = found.filter("object_type = 'MemoryRecord'").select(REQUEST, F.col("object_id").alias("memory_id"))
    frag = fragments.filter("deletion_state = 'active'").select("fragment_id", "source_id").join(src, "source_id").select(REQUEST, "fragment_id")
    origin = records.filter("deletion_state = 'active'").select("memory_id", F.col("origin_proposal_id").alias("proposal_id")).join(mem, "memory_id")
    refs = proposals.filter("deletion_state = 'active'").select("proposal_id", F.explode("source_fragment_refs").alias("fragment_id"))
    using = refs.join(frag, "fragment_id")
    # the proposals and their decisions read them: made twice, they were most of the plan
    prop = written(origin.select(REQUEST, "proposal_id").unionByName(using.select(REQUEST, "proposal_id")).distinct())
    dec = decisions.select("decision_id", "proposal_id").join(prop, "proposal_id").select(REQUEST, "decision_id")
    evt = events.select("event_id", "memory_id").join(mem, "memory_id").select(REQUEST, "event_id")
    req = found.select(REQUEST).distinct()

    def part(df: DataFrame, components: list[str], kind: str, key: str) -> DataFrame:
        each = F.explode(F.array(*[F.lit(c) for c in components]))
        return df.select(F.col(REQUEST), each.alias("component_type"), *_ref(kind, key))

    return (
        part(src, ["source_body", "source_metadata", "minimal_audit"], "SourceArtifact", "source_id")
        .unionByName(part(frag, ["source_fragment", "full_text_index"], "SourceFragment", "fragment_id"))
        .unionByName(part(prop, ["memory_proposal"], "MemoryProposal", "proposal_id"))
        .unionByName(part(dec, ["memory_decision"], "MemoryDecision", "decision_id"))
        .unionByName(part(mem, ["memory_record", "full_text_index"], "MemoryRecord", "memory_id"))
        .unionByName(part(evt, ["memory_state_event"], "MemoryStateEvent", "event_id"))
        .unionByName(part(req, ["minimal_audit"], "DeleteRequest", REQUEST))
    )


def _members(closure: DataFrame, component: str, key: str) -> DataFrame:
    return closure.filter(F.col("component_type") == component).select(F.col("object_id").alias(key)).distinct()


def _marked(table: DataFrame, marks: DataFrame, key: str) -> DataFrame:
    return table.join(marks.withColumn("_in", F.lit(True)), key, "left")


def close_to_recall(tables: dict[str, DataFrame], closure: DataFrame) -> dict[str, DataFrame]:
    """Targets, fragments and proposals become pending; derived rows of them disappear."""
    out = dict(tables)
    for name, key, component in (
        ("sources", "source_id", "source_metadata"),
        ("fragments", "fragment_id", "source_fragment"),
        ("proposals", "proposal_id", "memory_proposal"),
        ("records", "memory_id", "memory_record"),
    ):
        state = F.when(F.col("_in") & (F.col("deletion_state") == "active"), "pending").otherwise(F.col("deletion_state"))
        out[name] = _marked(tables[name], _members(closure, component, key), key).withColumn("deletion_state", state).drop("_in")
    index = closure.filter("component_type = 'full_text_index'").select("object_id").distinct()
    if "recall_rows" in tables:
        out["recall_rows"] = tables["recall_rows"].join(index, "object_id", "left_anti")
    if "tips" in tables:
        out["tips"] = tables["tips"].join(_members(closure, "source_metadata", "source_id"), "source_id", "left_anti")
    if "memory_current" in tables:
        out["memory_current"] = tables["memory_current"].join(_members(closure, "memory_record", "memory_id"), "memory_id", "left_anti")
    return out


def affected(tables: dict[str, DataFrame], closure: DataFrame) -> DataFrame:
    """(request, component_type, n): closure rows that still exist for the component.

    Related components are counted and written together, the others after them, so the driver
    never holds the plan of all; the counts are at most one row per request and component.
    """
    body = tables["sources"].filter("content is not null").select("source_id")

    def have(df: DataFrame, component: str, key: str) -> DataFrame:
        return df.select(F.lit(component).alias("component_type"), F.col(key).alias("object_id"))

    existing = [
        {"source_body": (body, "source_id"), "source_metadata": (tables["sources"], "source_id")},
        {"source_fragment": (tables["fragments"], "fragment_id"), "full_text_index": (tables["recall_rows"], "object_id")},
        {"memory_proposal": (tables["proposals"], "proposal_id"), "memory_decision": (tables["decisions"], "decision_id")},
        {"memory_record": (tables["records"], "memory_id"), "memory_state_event": (tables["events"], "event_id")},
    ]
    counts = []
    for group in existing:
        rows = reduce(DataFrame.unionByName, [have(df, component, key) for component, (df, key) in group.items()])
        touched = closure.filter(F.col("component_type").isin(*group)).join(rows, ["component_type", "object_id"])
        counts.append(written(touched.groupBy(REQUEST, "component_type").agg(F.count(F.lit(1)).alias("n"))))
        release(closure.sparkSession)
    return reduce(DataFrame.unionByName, counts)


def rows_left(before: dict[str, DataFrame], after: dict[str, DataFrame], bodies: bool) -> dict[str, DataFrame]:
    """The tables of ``affected`` after a step, whose rows alone count.

    Closing, redacting and retaining leave every row of a table where it is; those tables are
    taken as they were, so no row is joined to a state that is not read. ``bodies``: the step may empty bodies.
    """
    return {**before, "recall_rows": after["recall_rows"], "fragments": after["fragments"] if bodies else before["fragments"],
            "sources": after["sources"] if bodies else before["sources"]}


def component_results(
    planned: DataFrame, touched: DataFrame, failures: DataFrame, checked_at: Column, basis: str, attempt: Column
) -> DataFrame:
    """One result per planned component of an attempt.

    A failed component (request, component_key, error_code, retryable) does not stop the
    others. A component that found nothing reports not_found and still succeeds.
    """
    rows = planned.join(touched, [REQUEST, "component_type"], "left").join(failures, [REQUEST, "component_key"], "left")
    failed = F.col("error_code").isNotNull()
    some = (F.coalesce("n", F.lit(0)) > 0) | (F.col("component_type") == "minimal_audit")
    outcome = F.when(failed, "not_applicable").when(some, _mapped(OUTCOME, F.col("required_action"))).otherwise("not_found")
    retained = outcome == "retained_minimal"
    return rows.select(
        REQUEST, attempt.alias("attempt_ordinal"), "ordinal", "component_key", "component_type", "required_action",
        "target_count", "target_digest",
        F.when(failed, F.lit(0)).otherwise(F.col("target_count")).cast("long").alias("processed_count"),
        F.when(failed, "failed").otherwise("succeeded").alias("status"),
        outcome.alias("outcome"),
        F.when(failed, "component-batch-v1").otherwise(F.concat(F.lit("row-check-"), "required_action")).alias("verification_method"),
        checked_at.alias("checked_at"), "error_code", "retryable",
        F.when(retained, F.lit(basis)).alias("retention_basis"),
    )


def apply_results(tables: dict[str, DataFrame], closure: DataFrame, results: DataFrame) -> dict[str, DataFrame]:
    """Tables after the succeeded components of one attempt.

    Every table is joined once with the marks of its rows. The audit sets the final
    state: failed when any component failed, otherwise deleted; never active again.
    """
    succeeded = F.col("status") == "succeeded"
    audited = F.bool_or((F.col("component_type") == "minimal_audit") & succeeded)
    # one short row per request goes to the closure, if there are not too many: the driver holds them all
    bit = _mapped(BIT, F.col("component_type"))
    per = small_side(results.groupBy(REQUEST).agg(
        F.when(audited, F.when(F.bool_and(succeeded), "deleted").otherwise("failed")).alias("_final"),
        F.bit_or(F.when(succeeded, bit).otherwise(0)).alias("_done"),
    ))
    rows = closure.join(per, REQUEST).withColumn("_done", F.col("_done").bitwiseAND(bit) != 0)
    carried = rows.filter("_done")

    def marks(component: str, key: str) -> DataFrame:
        return rows.filter(F.col("component_type") == component).groupBy(F.col("object_id").alias(key)).agg(
            F.bool_or("_done").alias("_done"), F.max("_final").alias("_final")
        )

    final_state = F.coalesce("_final", "deletion_state")
    out = dict(tables)

    body = carried.filter("component_type = 'source_body'").select(F.col("object_id").alias("source_id"), F.lit(True).alias("_body")).distinct()
    out["sources"] = (
        tables["sources"].join(marks("source_metadata", "source_id"), "source_id", "left").join(body, "source_id", "left")
        .withColumns({
            "content": F.when(F.col("_body"), F.lit(None)).otherwise(F.col("content")),
            "title": F.when(F.col("_done"), F.lit(None)).otherwise(F.col("title")),
            "origin_ref": F.when(F.col("_done"), F.lit(None)).otherwise(F.col("origin_ref")),
            "deletion_state": final_state,
        }).drop("_done", "_final", "_body")
    )

    def redacted(name: str, component: str, key: str) -> DataFrame:
        gone = F.col("_done")
        return tables[name].join(marks(component, key), key, "left").withColumns({
            "content": F.when(gone, MARKER).otherwise(F.col("content")),
            "content_digest": F.when(gone, F.sha2(F.lit(MARKER), 256)).otherwise(F.col("content_digest")),
            "source_fragment_refs": F.when(gone, F.array().cast("array<string>")).otherwise(F.col("source_fragment_refs")),
            "deletion_state": final_state,
        }).drop("_done", "_final")

    out["proposals"] = redacted("proposals", "memory_proposal", "proposal_id")
    out["records"] = redacted("records", "memory_record", "memory_id")
    out["fragments"] = tables["fragments"].join(_members(carried, "source_fragment", "fragment_id"), "fragment_id", "left_anti")
    out["decisions"] = _marked(tables["decisions"], _members(carried, "memory_decision", "decision_id"), "decision_id").withColumn(
        "reason_text", F.when(F.col("_in"), F.lit(None)).otherwise(F.col("reason_text"))
    ).drop("_in")
    out["recall_rows"] = tables["recall_rows"].join(_members(carried, "full_text_index", "object_id"), "object_id", "left_anti")
    named = _members(carried, "minimal_audit", "source_id")
    lineages = tables["sources"].join(named, "source_id", "left_semi").select("namespace_id", "lineage_id").distinct()
    if "audit" in tables:
        whole = tables["sources"].select("source_id", "namespace_id", "lineage_id").join(lineages, ["namespace_id", "lineage_id"], "left_semi")
        out["audit"] = tables["audit"].join(whole.select("source_id"), "source_id", "left_anti")
    if "bindings" in tables:
        out["bindings"] = tables["bindings"].join(lineages, ["namespace_id", "lineage_id"], "left_anti")
    return out


def evidence(results: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Evidence of one attempt per request, chained to the request's latest evidence.

    The digest binds ids, overall status and each component's count and status.
    """
    parts = F.transform(
        F.sort_array(F.collect_list(F.struct("ordinal", "component_key", "processed_count", "status"))),
        lambda r: F.concat(
            F.lit('{"component_key":"'), r["component_key"], F.lit('","processed_count":'),
            r["processed_count"].cast("string"), F.lit(',"status":"'), r["status"], F.lit('"}'),
        ),
    )
    # ten results per request
    per = results.groupBy(REQUEST, "attempt_ordinal").agg(
        F.when(F.bool_and(F.col("status") == "succeeded"), "completed").otherwise("failed").alias("overall_status"),
        F.array_join(parts, ",").alias("_parts"),
        F.count_if(F.col("status") == "succeeded").alias("n_succeeded"),
        F.max("checked_at").alias("finished_at"),
    )
    evidence_id = F.concat(F.lit("evi-"), REQUEST, F.lit("-"), F.col("attempt_ordinal").cast("string"))
    rows = per.withColumn("evidence_id", evidence_id)
    if previous is not None:
        last = latest_evidence(previous).select(REQUEST, F.col("evidence_id").alias("previous_evidence_id"))
        rows = rows.join(last, REQUEST, "left")
    else:
        rows = rows.withColumn("previous_evidence_id", F.lit(None).cast("string"))
    text = F.concat(
        F.lit('{"component_results":['), "_parts", F.lit('],"delete_request_id":"'), F.col(REQUEST),
        F.lit('","deletion_evidence_id":"'), "evidence_id", F.lit('","overall_status":"'), "overall_status", F.lit('"}'),
    )
    return rows.select(
        "evidence_id", REQUEST, "attempt_ordinal", "previous_evidence_id", "overall_status", "n_succeeded",
        "finished_at", F.sha2(text, 256).alias("evidence_digest"),
    )


def latest_evidence(stored: DataFrame) -> DataFrame:
    """Last evidence per request."""
    cols = [c for c in stored.columns if c not in (REQUEST, "attempt_ordinal")]
    return stored.groupBy(REQUEST).agg(F.max_by(F.struct("attempt_ordinal", *cols), "attempt_ordinal").alias("e")).select(REQUEST, "e.*")


def next_attempts(requests: DataFrame, attempts: DataFrame) -> DataFrame:
    """Ordinal of the next attempt per request."""
    last = attempts.groupBy(REQUEST).agg(F.max("attempt_ordinal").alias("last"))
    return requests.select(REQUEST).join(last, REQUEST, "left").select(
        REQUEST, (F.coalesce("last", F.lit(0)) + 1).alias("next_attempt")
    )


def evidence_chain_problems(stored: DataFrame) -> DataFrame:
    """Evidence that does not point at the evidence of the attempt before it."""
    before = stored.select(REQUEST, (F.col("attempt_ordinal") + 1).alias("attempt_ordinal"), F.col("evidence_id").alias("expected"))
    rows = stored.join(before, [REQUEST, "attempt_ordinal"], "left")
    return violations(rows, "W7", "DeletionEvidence", "evidence_id", [
        ("EvidenceChain", ~F.col("previous_evidence_id").eqNullSafe(F.col("expected"))),
    ])


def unfinished(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Requests whose latest evidence is not a completed one, oldest first."""
    completed = latest_evidence(stored).filter("overall_status = 'completed'").select(REQUEST)
    return requests.join(completed, REQUEST, "left_anti").orderBy("requested_at", REQUEST)


def resume_state(requests: DataFrame, stored: DataFrame, frozen: DataFrame, current: DataFrame) -> DataFrame:
    """What executing each prepared request would do now.

    Completed requests return their evidence unchanged; a changed target set is refused;
    the rest run, chained to their last evidence.
    """
    last = latest_evidence(stored).select(REQUEST, "evidence_id", "overall_status")
    was = frozen.select(REQUEST, F.col("target_digest").alias("frozen_digest"))
    now = current.select(REQUEST, F.col("target_digest").alias("current_digest"))
    rows = requests.select(REQUEST).join(last, REQUEST, "left").join(was, REQUEST, "left").join(now, REQUEST, "left")
    action = (
        F.when(F.col("overall_status") == "completed", "return_evidence")
        .when(~F.col("frozen_digest").eqNullSafe(F.col("current_digest")), "reject_changed_plan")
        .when(F.col("evidence_id").isNull(), "execute")
        .otherwise("retry")
    )
    return rows.select(REQUEST, action.alias("action"), F.col("evidence_id").alias("previous_evidence_id"))


def plan_fingerprints(planned: DataFrame, closure: DataFrame) -> DataFrame:
    """Digest over the plan and execution closure rows of each request, in any row order.

    The closure is written and counted first: the tasks are as many as its rows ask for.
    """
    closure, planned = written(closure), written(planned)
    release(closure.sparkSession)
    parts = max(int(closure.sparkSession.conf.get("spark.sql.shuffle.partitions")), closure.count() // TASK_ROWS)
    rows = planned.select(REQUEST, row_fingerprint(F.lit("plan").alias("t"), "component_key", "component_type", "required_action", "target_count", "target_digest").alias("_m"))
    rows = rows.unionByName(closure.select(REQUEST, row_fingerprint(F.lit("closure").alias("t"), "component_type", "object_type", "object_id").alias("_m")))
    return set_digest(rows, [REQUEST], F.col("_m"), "plan_digest", parts).withColumnRenamed("n_members", "n_rows")


def completeness_gate(closure: DataFrame, objects: DataFrame) -> DataFrame:
    """Whether every stored object of a request is marked deleted."""
    bodies = closure.filter("component_type = 'source_body'").select(REQUEST, F.col("object_id").alias("source_id"))
    state = objects.select("source_id", "state")
    return bodies.join(state, "source_id", "left").groupBy(REQUEST).agg(
        F.count(F.lit(1)).alias("n_objects"),
        F.count_if(F.col("state") == "deleted").alias("n_deleted"),
        F.coalesce(F.bool_and(F.coalesce(F.col("state") == "deleted", F.lit(False))), F.lit(False)).alias("may_execute"),
    )


def delete_lineages(
    tables: dict[str, DataFrame], requests: DataFrame, checked_at: Column, basis: str, failures: DataFrame | None = None
) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """Delete whole lineages: plan, close to recall, execute, evidence.

    Returns the tables afterwards, the component results and the evidence. Frames that
    several steps read are written once.
    """
    found = written(targets(requests, tables["sources"], tables["fragments"], tables["records"]))
    closure = written(execution_closure(
        found, tables["fragments"], tables["proposals"], tables["decisions"], tables["records"], tables["events"]
    ))
    closed = close_to_recall(tables, closure)
    planned = written(plan(found))
    if failures is None:
        failures = planned.select(REQUEST, "component_key", F.lit("x").alias("error_code"), F.lit(True).alias("retryable")).filter(F.lit(False))
    results = written(component_results(planned, affected(rows_left(tables, closed, False), closure), failures, checked_at, basis, F.lit(1)))
    return apply_results(closed, closure, results), results, evidence(results)


# --- rules -----------------------------------------------------------------------------


def request_problems(requested: DataFrame, planned: DataFrame) -> DataFrame:
    """Requests with wrong target types, repeated targets or a plan that is not the profile."""
    per = requested.groupBy(REQUEST).agg(
        F.bool_or(~F.col("object_type").isin("SourceArtifact", "MemoryRecord")).alias("kind"),
        (F.countDistinct("object_type", "object_id") != F.count(F.lit(1))).alias("repeated"),
    )
    want = planned.select(REQUEST).distinct().select(REQUEST, F.inline(profile_array())).drop("ordinal").withColumn("w", F.lit(True))
    have = planned.groupBy(REQUEST, "component_key", "component_type", "required_action").agg(F.count(F.lit(1)).alias("h"))
    key = [REQUEST, "component_key", "component_type", "required_action"]
    bad = want.join(have, key, "full_outer").filter("w is null or h is null or h > 1").select(REQUEST).distinct().withColumn("profile", F.lit(True))
    return violations(per.join(bad, REQUEST, "left"), "V23", "DeleteRequest", REQUEST, [
        ("InvalidFieldCombination", F.col("kind")),
        ("DuplicateCollectionMember", F.col("repeated")),
        ("DeletionPlanMismatch", F.col("profile")),
    ])


def plan_completeness(requested: DataFrame, sources: DataFrame, fragments: DataFrame, records: DataFrame) -> DataFrame:
    """Objects that a plan must also name: lineage siblings, linked records, superseders."""
    key = [REQUEST, "object_type", "object_id"]
    src = requested.filter("object_type = 'SourceArtifact'").select(REQUEST, F.col("object_id").alias("source_id"))
    mem = requested.filter("object_type = 'MemoryRecord'").select(REQUEST, F.col("object_id").alias("memory_id"))
    live = sources.filter("deletion_state = 'active'").select("source_id", "namespace_id", "lineage_id")
    active = records.filter("deletion_state = 'active'")
    lineages = src.join(live, "source_id").select(REQUEST, "namespace_id", "lineage_id").distinct()
    siblings = lineages.join(live, ["namespace_id", "lineage_id"]).select(REQUEST, *_ref("SourceArtifact", "source_id"))
    refs = active.select("memory_id", F.explode("source_fragment_refs").alias("fragment_id"))
    linked = fragments.select("fragment_id", "source_id").join(src, "source_id").join(refs, "fragment_id").select(
        REQUEST, *_ref("MemoryRecord", "memory_id")
    )
    newer = active.select(F.explode("supersedes_memory_ids").alias("memory_id"), F.col("memory_id").alias("new_id"))
    dependents = mem.join(newer, "memory_id").select(REQUEST, *_ref("MemoryRecord", "new_id"))
    needed = siblings.unionByName(linked).unionByName(dependents).distinct()
    missing = needed.join(requested, key, "left_anti").withColumn("reason", F.lit("DeletionPlanMismatch"))
    known = live.select(*_ref("SourceArtifact", "source_id")).unionByName(active.select(*_ref("MemoryRecord", "memory_id")))
    unknown = requested.select(*key).join(known, key[1:], "left_anti").withColumn("reason", F.lit("MissingDeleteTarget"))
    return missing.unionByName(unknown)


def recall_block(requested: DataFrame, sources: DataFrame, records: DataFrame) -> DataFrame:
    """Planned targets that are missing or still active."""
    state = sources.select(*_ref("SourceArtifact", "source_id"), "deletion_state").unionByName(
        records.select(*_ref("MemoryRecord", "memory_id"), "deletion_state")
    )
    rows = requested.join(state, ["object_type", "object_id"], "left")
    reason = F.when(F.col("deletion_state").isNull(), "MissingReference").when(F.col("deletion_state") == "active", "DeletionStateMismatch")
    return rows.select(REQUEST, "object_type", "object_id", reason.alias("reason")).filter("reason is not null")


def result_rows(results: DataFrame) -> DataFrame:
    failed, ok = F.col("status") == "failed", F.col("status") == "succeeded"
    expected = _mapped(OUTCOME, F.col("required_action"))
    needs_basis = ok & (F.col("outcome") == "retained_minimal")
    key = F.concat(F.col(REQUEST), F.lit("/"), F.col("component_key"))
    return violations(results, "V26", "ComponentResult", key, [
        ("CountMismatch", (F.col("target_count") == 0) | (F.col("processed_count") > F.col("target_count"))
            | (ok & (F.col("processed_count") != F.col("target_count")))),
        ("InvalidFieldCombination", (failed != F.col("error_code").isNotNull()) | (failed != F.col("retryable").isNotNull())
            | (ok & ~F.col("outcome").isin("not_found") & (F.col("outcome") != expected))
            | (needs_basis != F.col("retention_basis").isNotNull())),
    ])


def evidence_problems(stored: DataFrame, planned: DataFrame, results: DataFrame, requests: DataFrame) -> DataFrame:
    """Evidence that does not match its plan one to one, its status or its times."""
    key = [REQUEST, "component_key"]
    want = planned.select(*key, *[F.col(c).alias(f"p_{c}") for c in ("component_type", "required_action", "target_count", "target_digest")])
    have = results.select(*key, "status", "component_type", "required_action", "target_count", "target_digest")
    both = want.join(have, key, "full_outer")
    same = F.lit(True)
    for c in ("component_type", "required_action", "target_count", "target_digest"):
        same = same & F.col(c).eqNullSafe(F.col(f"p_{c}"))
    per = both.groupBy(REQUEST).agg(
        F.bool_or(~same).alias("differs"),
        F.bool_and(F.coalesce(F.col("status") == "succeeded", F.lit(False))).alias("all_ok"),
        F.bool_or(F.coalesce(F.col("status") == "failed", F.lit(False))).alias("some_failed"),
    )
    rows = stored.join(per, REQUEST, "left").join(requests.select(REQUEST, "requested_at"), REQUEST, "left")
    return violations(rows, "V27", "DeletionEvidence", "evidence_id", [
        ("DeletionPlanMismatch", F.coalesce("differs", F.lit(True)) | ((F.col("overall_status") == "completed") & ~F.col("all_ok"))),
        ("InvalidFieldCombination", ((F.col("overall_status") == "failed") & ~F.col("some_failed"))
            | ((F.col("overall_status") == "pending") != F.col("finished_at").isNull())),
        ("TimeAlignmentMismatch", F.col("finished_at") < F.col("requested_at")),
    ])


def in_progress(sources: DataFrame, records: DataFrame) -> DataFrame:
    """One row per namespace with an unfinished deletion."""
    states = sources.select("namespace_id", "deletion_state").unionByName(records.select("namespace_id", "deletion_state"))
    return states.filter(F.col("deletion_state").isin("pending", "failed")).groupBy("namespace_id").agg(
        F.count(F.lit(1)).alias("n_unfinished")
    )
