"""Memory life cycle: proposals, decisions, materialized records, terminal events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions.digest import row_fingerprint
from memlake.operators.chains import chain_roots, decision_tips
from memlake.session import cut_lineage

# fixed values: states and the event types that end a confirmed state
TERMINAL_EVENTS = ["superseded", "contradicted", "retracted", "expired"]


def proposal_key() -> Column:
    """Semantic identity: namespace, operation, content and the two id sets.

    Subject, memory type, valid time and the earlier decision play no part in it.
    """
    return row_fingerprint(
        "namespace_id", "operation", "content_digest",
        F.array_sort(F.array_distinct("source_fragment_refs")).alias("refs"),
        F.array_sort(F.array_distinct("target_memory_ids")).alias("targets"),
    )


def first_of_each(proposals: DataFrame) -> DataFrame:
    """Earliest proposal per semantic key."""
    keyed = proposals.withColumn("semantic_key", proposal_key())
    return keyed.groupBy("semantic_key").agg(
        F.min(F.struct("proposed_at", "proposal_id")).alias("f"), F.count(F.lit(1)).alias("n_same")
    ).select("semantic_key", F.col("f.proposal_id").alias("first_proposal_id"), "n_same")


def duplicate_proposals(proposals: DataFrame) -> DataFrame:
    """Every repeated proposal with the earliest one it repeats; no pairs are formed.

    One key may hold a large share of all proposals; the join back is a plain one, which is
    split at run time where a key is that large.
    """
    keyed = proposals.select("proposal_id", "namespace_id", proposal_key().alias("semantic_key"))
    firsts = first_of_each(proposals).filter("n_same > 1")
    return keyed.join(firsts, "semantic_key").filter(
        "proposal_id <> first_proposal_id"
    ).select("proposal_id", "namespace_id", F.col("first_proposal_id").alias("duplicate_of"), "n_same")


def admit_proposals(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Outcome of each incoming proposal: accepted, or rejected as a semantic duplicate.

    A repeat of a stored proposal is rejected whatever was decided on it; of repeats
    inside the batch the earliest is accepted.
    """
    keyed = incoming.select("proposal_id", "namespace_id", proposal_key().alias("semantic_key"))
    batch_first = first_of_each(incoming).select("semantic_key", "first_proposal_id")
    old_first = first_of_each(stored).select("semantic_key", F.col("first_proposal_id").alias("stored_id"))
    first = batch_first.join(old_first, "semantic_key", "left")
    rows = keyed.join(first, "semantic_key")
    known = F.coalesce("stored_id", "first_proposal_id")
    accepted = F.col("stored_id").isNull() & (F.col("proposal_id") == F.col("first_proposal_id"))
    return rows.select(
        "proposal_id", "namespace_id",
        F.when(accepted, F.lit("accepted")).otherwise(F.lit("rejected")).alias("outcome"),
        F.when(~accepted, F.lit("DuplicateProposal")).alias("reason"),
        F.when(~accepted, known).alias("duplicate_of"),
    )


def append_decisions(proposals: DataFrame, stored: DataFrame, incoming: DataFrame, records: DataFrame) -> DataFrame:
    """Outcome of each incoming decision against the stored chain of its proposal.

    A batch extends each tip once and uses each result id once. In the order of decided_at, if
    there, and decision_id the first decision that is valid against the stored chain extends the
    tip; later ones meet the moved tip. Among those, the first with a result id keeps it.
    """
    known = proposals.select("proposal_id", F.col("namespace_id").alias("p_ns"))
    tips = decision_tips(stored)
    used = records.select(F.col("memory_id").alias("result_memory_id")).withColumn("id_used", F.lit(True))
    rows = incoming.join(known, "proposal_id", "left").join(tips, "proposal_id", "left").join(
        used, "result_memory_id", "left"
    )
    tip, before = F.col("tip_decision_id"), F.col("previous_decision_id")
    reason = (
        F.when(F.col("p_ns").isNull(), "MissingProposal")
        .when(F.col("p_ns") != F.col("namespace_id"), "NamespaceMismatch")
        .when((F.col("decision") == "accept") != F.col("result_memory_id").isNotNull(), "InvalidFieldCombination")
        .when(F.col("problem").isNotNull(), "DecisionChain")
        .when(tip.isNotNull() & (F.col("tip_decision") != "defer"), "TerminalDecision")
        .when(~tip.eqNullSafe(before), "DecisionChain")
        .when(F.col("id_used"), "DuplicateObject")
    )
    rows = rows.withColumn("reason", reason)
    order = F.struct(*[c for c in ("decided_at", "decision_id") if c in incoming.columns])
    valid = rows.filter("reason IS NULL")
    extended = valid.groupBy("proposal_id").agg(F.min(F.struct(order.alias("o"), "decision_id", "decision")).alias("first"))
    rows = rows.join(extended, "proposal_id", "left")
    late = F.col("reason").isNull() & (F.col("decision_id") != F.col("first.decision_id"))
    rows = rows.withColumn("reason", F.when(late, F.when(F.col("first.decision") == "defer", "DecisionChain").otherwise("TerminalDecision")).otherwise(F.col("reason")))
    taken = rows.filter("reason IS NULL AND result_memory_id IS NOT NULL").groupBy("result_memory_id").agg(F.min(F.struct(order.alias("o"), "decision_id")).alias("holder"))
    rows = rows.join(taken, "result_memory_id", "left")
    again = F.col("reason").isNull() & (F.col("decision_id") != F.col("holder.decision_id"))
    reason = F.when(again, "DuplicateObject").otherwise(F.col("reason"))
    return rows.select(
        "decision_id", "proposal_id",
        F.when(reason.isNull(), F.lit("accepted")).otherwise(F.lit("rejected")).alias("outcome"),
        reason.alias("reason"),
    )


RECORD_FROM_PROPOSAL = [
    "namespace_id", "memory_type", "subject_ref", "content", "content_digest", "source_fragment_refs",
    "observed_at", "valid_mode", "valid_start", "valid_end", "confidence", "importance",
    "sensitivity", "egress_policy", "retention_mode", "retention_expires_at", "retention_policy_id",
    "deletion_state", "policy_basis",
]


def accepted_batch(proposals: DataFrame, accepted: DataFrame) -> DataFrame:
    """One row per accepted decision with its proposal, to be taken in the order of ``nth``."""
    a = accepted.filter("decision = 'accept'").select(
        "proposal_id", "decision_id", F.col("result_memory_id").alias("memory_id"), "decided_at"
    )
    return proposals.join(a, "proposal_id").withColumn("nth", F.struct("decided_at", "decision_id"))


def resolve_batch(rows: DataFrame, records: DataFrame) -> DataFrame:
    """(memory_id, reason) of every row of :func:`accepted_batch`; no reason means it materializes.

    Rows are taken one after another by ``nth``: each needs targets that are confirmed then,
    stored or made earlier in the batch, and ends them, so of several rows with one target the
    first that holds keeps it. What a refused row would have made is missing for later ones.

    Rows that are the first open claim on all their targets wait for their targets' makers only.
    Along single targets they are followed to the end by pointer doubling, so a chain of n rows
    in a batch takes log2(n) steps; a round settles these and what they decide for others.
    """
    used = records.select("memory_id", F.lit(True).alias("used"))
    once = rows.groupBy("memory_id").agg(F.min("nth").alias("own"))
    nodes = rows.select("memory_id", "nth", "decision_id", F.array_distinct("target_memory_ids").alias("targets"))
    nodes = cut_lineage(nodes.join(once, "memory_id").join(used, "memory_id", "left").withColumn("node", F.col("decision_id")))
    duplicate = F.col("used").isNotNull() | (F.col("nth") != F.col("own"))
    state = cut_lineage(nodes.select("node", F.when(duplicate, "DuplicateObject").alias("reason"), (~duplicate & (F.size("targets") == 0)).alias("done")))
    stored = records.select(F.col("memory_id").alias("t"), "current_state")
    makers = nodes.filter(~duplicate).select(F.col("memory_id").alias("t"), F.col("node").alias("maker"), F.col("nth").alias("made"))
    pairs = nodes.filter(~duplicate).select("node", "nth", F.explode("targets").alias("t"), F.size("targets").alias("k"))
    pairs = pairs.join(stored, "t", "left").join(makers, "t", "left")
    missing = F.col("current_state").isNull() & (F.col("made").isNull() | (F.col("made") >= F.col("nth")))
    pairs = cut_lineage(pairs.select("node", "nth", "t", "k", F.when(F.col("current_state").isNull(), F.col("maker")).alias("maker"),
        F.when(missing, "MissingMemory").when(F.col("current_state") != "confirmed", "TargetNotConfirmed").alias("fault")))
    open_ = F.col("reason").isNull() & ~F.col("done")
    while not state.filter(open_).isEmpty():
        maker = state.select(F.col("node").alias("maker"), F.col("reason").alias("m_reason"), F.col("done").alias("m_done"))
        live = pairs.join(state, "node").filter("reason IS NULL")
        claims = live.groupBy("t").agg(F.min("nth").alias("first"), F.min(F.when(F.col("done"), F.col("nth"))).alias("kept"))
        seen = live.filter(~F.col("done")).join(claims, "t").join(maker, "maker", "left")
        waits = F.col("maker").isNotNull() & F.col("m_reason").isNull() & ~F.col("m_done")
        fault = F.coalesce("fault", F.when(F.col("m_reason").isNotNull(), "MissingMemory"), F.when(F.col("kept") < F.col("nth"), "TargetNotConfirmed"))
        per = cut_lineage(seen.groupBy("node").agg(
            F.min(fault).alias("fault"), F.bool_and(F.col("first") == F.col("nth")).alias("leads"),
            F.count_if(waits).alias("waiting"), F.max(F.when(waits, F.col("maker"))).alias("on"),
        ))
        # a leading row that waits for one maker follows it; others stand for themselves
        step = F.when(F.col("fault").isNull() & F.col("leads") & (F.col("waiting") == 1), F.col("on"))
        ends = chain_roots(per.select("node", step.alias("on")), "node", "on")
        end = per.select(F.col("node").alias("root"), F.col("fault").alias("end_fault"), (F.col("leads") & (F.col("waiting") == 0)).alias("holds"))
        now = ends.join(end, "root").join(per.select("node", "fault"), "node").select(
            "node", F.when(F.col("end_fault").isNotNull(), F.coalesce("fault", F.lit("MissingMemory"))).alias("new_reason"), (F.col("end_fault").isNull() & F.col("holds")).alias("new_done")
        )
        state = cut_lineage(state.join(now, "node", "left").select("node", F.coalesce("reason", "new_reason").alias("reason"), (F.col("done") | F.coalesce("new_done", F.lit(False))).alias("done")))
    return nodes.select("node", "memory_id", "decision_id").join(state.select("node", "reason"), "node").drop("node")


def _versions(rows: DataFrame, records: DataFrame) -> DataFrame:
    """(memory_id, lineage_id, version) of the rows that materialize, also along chains inside the batch.

    A row continues the lineage of its targets behind the newest of them. Single targets are
    followed by doubling; rows with several targets wait until all of them are known.
    """
    links = rows.select("memory_id", F.explode(F.array_distinct("target_memory_ids")).alias("t"), F.size(F.array_distinct("target_memory_ids")).alias("k"))
    own = rows.select(F.col("memory_id").alias("t"), F.lit(True).alias("inside"))
    links = cut_lineage(links.join(own, "t", "left"))
    single = rows.select("memory_id").join(links.filter("k = 1 AND inside").select("memory_id", "t"), "memory_id", "left")
    ends = cut_lineage(chain_roots(single, "memory_id", "t"))
    roots = ends.filter("position = 0").select("memory_id")
    known = records.select(F.col("memory_id").alias("t"), F.col("lineage_id").alias("t_lineage"), F.col("version").alias("t_version"))
    fresh = roots.join(links, "memory_id", "left_anti").select("memory_id", F.concat(F.lit("mlin-"), "memory_id").alias("lineage_id"), F.lit(1).cast("long").alias("version"))
    needs = cut_lineage(roots.join(links, "memory_id"))
    found = cut_lineage(fresh)
    while True:
        tail = ends.join(found.select(F.col("memory_id").alias("root"), "lineage_id", "version"), "root")
        all_known = known.unionByName(tail.select(F.col("memory_id").alias("t"), F.col("lineage_id").alias("t_lineage"), (F.col("version") + F.col("position")).alias("t_version")))
        open_ = needs.join(found.select("memory_id"), "memory_id", "left_anti")
        ready = open_.join(all_known, "t").groupBy("memory_id", "k").agg(F.count(F.lit(1)).alias("n"), F.max("t_lineage").alias("lineage_id"), (F.max("t_version") + 1).alias("version"))
        more = cut_lineage(ready.filter("n = k").select("memory_id", "lineage_id", "version"))
        if more.isEmpty():
            return tail.select("memory_id", "lineage_id", (F.col("version") + F.col("position")).cast("long").alias("version"))
        found = cut_lineage(found.unionByName(more))


def materialize(proposals: DataFrame, accepted: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records and events that accepted decisions bring about, and (decision_id, memory_id, reason) of those refused.

    A new record copies its proposal. A superseding one continues the lineage of its targets
    with the next version and closes each target at its own valid start. The decisions of a
    batch are taken in order (see :func:`resolve_batch`), so a batch may continue chains it starts.
    """
    rows = accepted_batch(proposals, accepted)
    resolved = cut_lineage(resolve_batch(rows, records))
    refused = resolved.filter("reason IS NOT NULL").select("decision_id", "memory_id", "reason")
    rows = cut_lineage(rows.join(resolved.filter("reason IS NULL").select("decision_id"), "decision_id").drop("nth"))
    rows = rows.join(_versions(rows, records), "memory_id")
    new_records = rows.select(
        "memory_id", "lineage_id", "version",
        *RECORD_FROM_PROPOSAL,
        F.col("proposal_id").alias("origin_proposal_id"),
        F.col("decision_id").alias("accepted_by_decision_id"),
        F.col("target_memory_ids").alias("supersedes_memory_ids"),
        F.lit("confirmed").alias("current_state"),
        F.concat(F.lit("evt-"), "memory_id", F.lit("-confirmed")).alias("last_state_event_id"),
        F.col("decided_at").alias("created_at"),
    )
    closing = rows.select("namespace_id", F.col("memory_id").alias("new_id"), "valid_start", "decided_at", F.explode(F.array_distinct("target_memory_ids")).alias("t"))
    ended = closing.select(F.col("t").alias("memory_id"), F.lit(True).alias("ended"))
    closed = F.concat(F.lit("evt-"), "memory_id", F.lit("-superseded"))
    new_records = new_records.join(ended, "memory_id", "left").withColumns({
        "current_state": F.when(F.col("ended"), "superseded").otherwise("confirmed"),
        "last_state_event_id": F.when(F.col("ended"), closed).otherwise(F.col("last_state_event_id")),
    }).drop("ended")
    none = F.lit(None).cast("string")
    first = rows.select(
        F.concat(F.lit("evt-"), "memory_id", F.lit("-confirmed")).alias("event_id"),
        "namespace_id", "memory_id", none.alias("previous_event_id"),
        F.lit("confirmed").alias("event_type"), none.alias("from_state"),
        F.lit("memory_decision").alias("cause_type"), F.col("decision_id").alias("cause_id"),
        F.array().cast("array<string>").alias("related_memory_ids"),
        F.lit(None).cast("timestamp_ntz").alias("effective_at"), F.col("decided_at").alias("occurred_at"),
    )
    last = records.select(F.col("memory_id").alias("t"), "last_state_event_id").unionByName(
        rows.select(F.col("memory_id").alias("t"), F.concat(F.lit("evt-"), "memory_id", F.lit("-confirmed")).alias("last_state_event_id"))
    )
    closing = closing.join(last, "t").select(
        F.concat(F.lit("evt-"), "t", F.lit("-superseded")).alias("event_id"),
        "namespace_id", F.col("t").alias("memory_id"), F.col("last_state_event_id").alias("previous_event_id"),
        F.lit("superseded").alias("event_type"), F.lit("confirmed").alias("from_state"),
        F.lit("memory_record").alias("cause_type"), F.col("new_id").alias("cause_id"),
        F.array("new_id").alias("related_memory_ids"),
        F.col("valid_start").alias("effective_at"), F.col("decided_at").alias("occurred_at"),
    )
    return new_records, first.unionByName(closing), refused


def append_terminal_events(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Outcome of contradicted, retracted and expired events against the current state."""
    state = current.select("memory_id", F.col("namespace_id").alias("m_ns"), "current_state", "last_state_event_id")
    # two events of one batch cannot both end the same memory
    lead = incoming.groupBy("memory_id").agg(F.min(F.struct("occurred_at", "event_id")).alias("f")).select(
        "memory_id", F.col("f.event_id").alias("lead_id")
    )
    rows = incoming.join(lead, "memory_id").join(state, "memory_id", "left")
    reason = (
        F.when(F.col("m_ns").isNull() | (F.col("m_ns") != F.col("namespace_id")), "MissingMemory")
        .when(F.col("event_type") == "superseded", "Materialization")
        .when(~F.col("event_type").isin(*TERMINAL_EVENTS), "InvalidStateTransition")
        .when(F.col("current_state") != "confirmed", "EventChain")
        .when(~F.col("previous_event_id").eqNullSafe(F.col("last_state_event_id")), "EventChain")
        .when(F.col("event_id") != F.col("lead_id"), "EventChain")
    )
    return rows.select(
        "event_id", "memory_id",
        F.when(reason.isNull(), F.lit("accepted")).otherwise(F.lit("rejected")).alias("outcome"),
        reason.alias("reason"),
    )
