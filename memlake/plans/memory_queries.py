"""Queries over proposals, decisions, records, events and points in time."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from memlake.functions.text import roots
from memlake.operators import asof, chains, memory, versions
from memlake.operators.postings import recall_batch
from memlake.plans.base_sql import AS_OF, CTES, SET_DIGEST, cte, with_ctes
from memlake.plans.recall_queries import PERSONAL, recall_index, tip_fragments
from memlake.plans.registry import query
from memlake.session import cut_lineage
from memlake.sources import bind


@query("s3_memory_scans", with_ctes(["prop", "dec", "rec", "evt"], """
SELECT 'proposal' AS kind, proposal_id AS id, content_digest AS detail FROM prop WHERE deletion_state = 'active' AND namespace_id = 'ns-en'
UNION ALL SELECT 'decision', decision_id, decision FROM dec WHERE namespace_id = 'ns-en'
UNION ALL SELECT 'record', memory_id, lineage_id FROM rec WHERE deletion_state = 'active' AND namespace_id = 'ns-en'
UNION ALL SELECT 'event', event_id, event_type FROM evt WHERE namespace_id = 'ns-en'"""))
def s3_memory_scans(spark, path):
    def part(df, kind, key, detail):
        found = versions.in_namespace(df, "ns-en")
        found = versions.active(found) if "deletion_state" in df.columns else found
        return found.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(detail).alias("detail"))

    return (
        part(bind.proposals(spark, path), "proposal", "proposal_id", "content_digest")
        .unionByName(part(bind.decisions(spark, path), "decision", "decision_id", "decision"))
        .unionByName(part(bind.records(spark, path), "record", "memory_id", "lineage_id"))
        .unionByName(part(bind.state_events(spark, path), "event", "event_id", "event_type"))
    )


_DUP_KEY = "namespace_id, operation, content_digest, fragment_ref, target_memory_id"
_FIRST = f"""
SELECT *, first_value(proposal_id) OVER (PARTITION BY {_DUP_KEY} ORDER BY proposed_at, proposal_id) AS first_id,
  count(*) OVER (PARTITION BY {_DUP_KEY}) AS n_same FROM prop"""


@query("j12_duplicate_proposals", with_ctes(["prop"], """
SELECT proposal_id, namespace_id, first_id AS duplicate_of, n_same FROM x WHERE proposal_id <> first_id""", x=_FIRST))
def j12_duplicate_proposals(spark, path):
    return memory.duplicate_proposals(bind.proposals(spark, path))


@query("b5_admit_proposals", with_ctes(["prop"], f"""
SELECT i.proposal_id, i.namespace_id, CASE WHEN s.first_id IS NULL AND i.proposal_id = i.first_in THEN 'accepted' ELSE 'rejected' END AS outcome,
  CASE WHEN NOT (s.first_id IS NULL AND i.proposal_id = i.first_in) THEN 'DuplicateProposal' END AS reason,
  CASE WHEN NOT (s.first_id IS NULL AND i.proposal_id = i.first_in) THEN coalesce(s.first_id, i.first_in) END AS duplicate_of
FROM (SELECT *, first_value(proposal_id) OVER (PARTITION BY {_DUP_KEY} ORDER BY proposed_at, proposal_id) AS first_in
      FROM prop WHERE proposed_at >= {AS_OF}) i
LEFT JOIN (SELECT {_DUP_KEY}, min_by(proposal_id, (proposed_at, proposal_id)) AS first_id FROM prop WHERE proposed_at < {AS_OF} GROUP BY ALL) s
  ON s.namespace_id = i.namespace_id AND s.operation = i.operation AND s.content_digest = i.content_digest
  AND s.fragment_ref = i.fragment_ref AND s.target_memory_id IS NOT DISTINCT FROM i.target_memory_id"""))
def b5_admit_proposals(spark, path):
    p = bind.proposals(spark, path)
    return memory.admit_proposals(p.filter(F.col("proposed_at") < bind.ntz()), p.filter(F.col("proposed_at") >= bind.ntz()))


@query("w3_decision_order", with_ctes(["dec"], """
SELECT decision_id, proposal_id, decision, CAST(CASE WHEN previous_decision_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS position FROM dec"""))
def w3_decision_order(spark, path):
    return chains.ordered_decisions(bind.decisions(spark, path)).select("decision_id", "proposal_id", "decision", "position")


@query("w4_decision_tip", with_ctes(["dec"], """
SELECT proposal_id, count(*) AS n_decisions, max_by(decision_id, decided_at) AS tip_decision_id, max_by(decision, decided_at) AS tip_decision,
  CAST(NULL AS VARCHAR) AS problem FROM dec GROUP BY proposal_id"""))
def w4_decision_tip(spark, path):
    return chains.decision_tips(bind.decisions(spark, path))


@query("g2_chain_positions", with_ctes(["rec"], "SELECT memory_id, version - 1 AS position FROM rec"))
def g2_chain_positions(spark, path):
    r = bind.records(spark, path).select("memory_id", F.get("supersedes_memory_ids", F.lit(0)).alias("previous"))
    return chains.chain_positions(r, "memory_id", "previous")


@query("g1_dependents", with_ctes(["rec"], """
SELECT r.namespace_id, r.memory_id AS node FROM rec r
JOIN (SELECT lineage_id, min(version) AS v FROM rec WHERE contradicts_memory_id IS NOT NULL GROUP BY lineage_id) s
  ON s.lineage_id = r.lineage_id AND r.version >= s.v"""))
def g1_dependents(spark, path):
    r = bind.records(spark, path)
    edges = r.select(F.explode("supersedes_memory_ids").alias("src"), F.col("memory_id").alias("dst"))
    seeds = r.filter(F.size("contradicts_memory_ids") > 0).select("namespace_id", F.col("memory_id").alias("node"))
    return chains.reachable(seeds, edges, "namespace_id")


@query("g3_record_closure", with_ctes(["rec"], """
SELECT r.namespace_id, r.memory_id AS node FROM rec r
JOIN (SELECT lineage_id, max(version) AS v FROM rec WHERE current_state = 'confirmed' GROUP BY lineage_id) s
  ON s.lineage_id = r.lineage_id AND r.version <= s.v"""))
def g3_record_closure(spark, path):
    r = bind.records(spark, path)
    edges = r.select(F.col("memory_id").alias("src"), F.explode("supersedes_memory_ids").alias("dst"))
    seeds = r.filter("current_state = 'confirmed'").select("namespace_id", F.col("memory_id").alias("node"))
    return chains.reachable(seeds, edges, "namespace_id")


@query("t1_memory_current", with_ctes(["rec"], "SELECT memory_id, namespace_id, current_state, last_state_event_id FROM rec"))
def t1_memory_current(spark, path):
    return chains.memory_current(bind.state_events(spark, path))


_INCOMING_DEC = """
SELECT event_id, namespace_id, proposal_id, event_type, memory_id,
  'new-' || CAST(event_id AS VARCHAR) AS decision_id,
  CASE WHEN event_id % 7 = 3 THEN NULL ELSE dec_id END AS previous_decision_id,
  CASE WHEN event_id % 2 = 0 THEN 'accept' ELSE 'defer' END AS decision,
  CASE WHEN event_id % 2 = 0 AND event_id % 11 <> 0 THEN CASE WHEN event_id % 13 = 0 THEN 'mem-0000000000' || '' ELSE 'new-' || memory_id END END AS result_memory_id
FROM (SELECT m.*, 'dec-' || lpad(CAST(event_id AS VARCHAR), 10, '0') || '-1' AS dec_id FROM mem0 m)"""


# every fifth proposal gets a second decision for the same tip in the batch
_INCOMING_ALL = """
SELECT proposal_id, decision_id, previous_decision_id, decision, result_memory_id FROM inc
UNION ALL SELECT proposal_id, 'then-' || CAST(event_id AS VARCHAR), previous_decision_id, 'reject', NULL FROM inc WHERE event_id % 5 = 0"""


@query("b6_append_decisions", with_ctes(["mem0", "dec", "rec"], """
SELECT decision_id, proposal_id, CASE WHEN coalesce(r2, CASE WHEN rank > 1 THEN 'x' END) IS NULL THEN 'accepted' ELSE 'rejected' END AS outcome,
  coalesce(r2, CASE WHEN rank > 1 THEN 'DuplicateObject' END) AS reason
FROM (SELECT *, CASE WHEN r2 IS NULL AND result_memory_id IS NOT NULL THEN row_number() OVER (PARTITION BY result_memory_id, r2 ORDER BY decision_id) END AS rank
  FROM (SELECT t.*, CASE WHEN r IS NOT NULL THEN r WHEN turn > 1 AND first_decision = 'defer' THEN 'DecisionChain' WHEN turn > 1 THEN 'TerminalDecision' END AS r2
    FROM (SELECT *, row_number() OVER w AS turn, first_value(decision) OVER w AS first_decision FROM (
      SELECT i.*, CASE WHEN (i.decision = 'accept') <> (i.result_memory_id IS NOT NULL) THEN 'InvalidFieldCombination'
        WHEN d.decision <> 'defer' THEN 'TerminalDecision'
        WHEN i.previous_decision_id IS NULL THEN 'DecisionChain'
        WHEN i.result_memory_id IN (SELECT memory_id FROM rec) THEN 'DuplicateObject' END AS r
      FROM both_ i JOIN dec d ON d.proposal_id = i.proposal_id AND d.previous_decision_id IS NULL) i
      WINDOW w AS (PARTITION BY proposal_id, r IS NULL ORDER BY decision_id)) t) u) v""", inc=_INCOMING_DEC, both_=_INCOMING_ALL))
def b6_append_decisions(spark, path):
    d = bind.decisions(spark, path).filter("previous_decision_id is null")
    n = F.expr("substring(proposal_id, 6)").cast("long")
    memory_id = F.concat(F.lit("new-mem-"), F.expr("substring(proposal_id, 6)"))
    accept = F.pmod(n, F.lit(2)) == 0
    incoming = d.select(
        F.concat(F.lit("new-"), n.cast("string")).alias("decision_id"), "namespace_id", "proposal_id",
        F.when(F.pmod(n, F.lit(7)) != 3, F.col("decision_id")).alias("previous_decision_id"),
        F.when(accept, "accept").otherwise("defer").alias("decision"),
        F.when(accept & (F.pmod(n, F.lit(11)) != 0),
               F.when(F.pmod(n, F.lit(13)) == 0, F.lit("mem-0000000000")).otherwise(memory_id)).alias("result_memory_id"),
    )
    number = F.expr("substring(decision_id, 5)")
    second = incoming.filter(F.pmod(number.cast("long"), F.lit(5)) == 0).withColumns({"decision_id": F.concat(F.lit("then-"), number), "decision": F.lit("reject"), "result_memory_id": F.lit(None).cast("string")})
    incoming = incoming.unionByName(second)
    return memory.append_decisions(bind.proposals(spark, path), d, incoming, bind.records(spark, path))


# accepted decisions from this time on are one batch; what was made before is stored
CUT = "2024-01-15 00:00:00"
_CUT = f"TIMESTAMP '{CUT}'"


def records_then(spark, path):
    """The records made before ``CUT`` in the state they had then."""
    r = bind.records(spark, path)
    old = r.filter(F.col("created_at") < bind.ntz(CUT))
    ended = old.select(F.explode("supersedes_memory_ids").alias("memory_id"), F.lit(True).alias("ended"))
    event = F.concat(F.lit("evt-"), F.expr("substring(memory_id, 5)"), F.when(F.col("ended"), "-2").otherwise("-1"))
    return old.join(ended, "memory_id", "left").withColumns({
        "current_state": F.when(F.col("ended"), "superseded").otherwise("confirmed"), "last_state_event_id": event,
    }).drop("ended")


def accepted_batch(spark, path):
    """Proposals and accepted decisions from ``CUT`` on, and rivals of them.

    ``rival-`` claims a target after the first claim, ``lost-`` a memory that is not there,
    ``after-`` what ``lost-`` would have made, ``again-`` uses the id of a stored memory.
    """
    p = bind.proposals(spark, path)
    d = bind.decisions(spark, path).filter((F.col("decision") == "accept") & (F.col("decided_at") >= bind.ntz(CUT)))
    both = d.join(p.select("proposal_id", "operation", "event_id", "target_memory_ids"), "proposal_id")
    n, number = F.pmod("event_id", F.lit(5)), F.col("event_id").cast("string")
    later = F.col("decided_at") + F.expr("interval 1 day")

    def rival(name, where, targets, result, at):
        return both.filter(where).select(
            F.concat(F.lit(f"{name}-dec-"), number).alias("decision_id"), F.concat(F.lit(f"{name}-"), number).alias("new_id"), "proposal_id",
            targets.alias("targets"), result.alias("result_memory_id"), at.alias("decided_at"),
        )

    made = F.concat(F.lit("lost-mem-"), number)
    rivals = (
        rival("rival", (n == 0) & (F.col("operation") == "supersede"), F.col("target_memory_ids"), F.concat(F.lit("rival-mem-"), number), later)
        .unionByName(rival("lost", n == 1, F.array(F.lit("mem-none")), made, F.col("decided_at")))
        .unionByName(rival("after", n == 1, F.array(made), F.concat(F.lit("after-mem-"), number), later))
    )
    stored = bind.records(spark, path).filter(F.col("created_at") < bind.ntz(CUT)).agg(F.min("memory_id").alias("m")).select("m")
    rivals = rivals.unionByName(rival("again", n == 2, F.array().cast("array<string>"), stored.scalar(), F.col("decided_at")))
    rivals = cut_lineage(rivals)
    proposals = p.unionByName(rivals.join(p, "proposal_id").withColumns({"proposal_id": F.col("new_id"), "target_memory_ids": F.col("targets")}).select(*p.columns))
    decisions = d.select("proposal_id", "decision", "decision_id", "result_memory_id", "decided_at").unionByName(
        rivals.select(F.col("new_id").alias("proposal_id"), F.lit("accept").alias("decision"), "decision_id", "result_memory_id", "decided_at")
    )
    return proposals, decisions


@query("b7_materialize_records", with_ctes(["rec"], f"""
SELECT r.memory_id, CASE WHEN f.created_at < {_CUT} THEN r.lineage_id ELSE 'mlin-' || f.memory_id END AS lineage_id, r.version, r.content,
  r.origin_proposal_id, r.accepted_by_decision_id, r.created_at, r.current_state
FROM rec r JOIN rec f ON f.lineage_id = r.lineage_id AND f.version = 1 WHERE r.created_at >= {_CUT}"""))
def b7_materialize_records(spark, path):
    new, _, _ = memory.materialize(*accepted_batch(spark, path), records_then(spark, path))
    return new.select("memory_id", "lineage_id", "version", "content", "origin_proposal_id", "accepted_by_decision_id", "created_at", "current_state")


@query("b7_materialize_events", with_ctes(["rec"], f"""
SELECT 'evt-' || memory_id || '-confirmed' AS event_id, memory_id, 'confirmed' AS event_type, CAST(NULL AS VARCHAR) AS previous_event_id,
  accepted_by_decision_id AS cause_id, CAST(NULL AS TIMESTAMP) AS effective_at, created_at AS occurred_at FROM rec WHERE created_at >= {_CUT}
UNION ALL SELECT 'evt-' || r.prev_memory_id || '-superseded', r.prev_memory_id, 'superseded',
  CASE WHEN p.created_at < {_CUT} THEN 'evt-' || substr(p.memory_id, 5) || '-1' ELSE 'evt-' || p.memory_id || '-confirmed' END, r.memory_id, r.valid_start, r.created_at
FROM rec r JOIN rec p ON p.memory_id = r.prev_memory_id WHERE r.created_at >= {_CUT}"""))
def b7_materialize_events(spark, path):
    _, events, _ = memory.materialize(*accepted_batch(spark, path), records_then(spark, path))
    return events.select("event_id", "memory_id", "event_type", "previous_event_id", "cause_id", "effective_at", "occurred_at")


@query("b7_refused", with_ctes(["rec"], f"""
SELECT k || '-dec-' || CAST(event_id AS VARCHAR) AS decision_id,
  CASE k WHEN 'again' THEN (SELECT min(memory_id) FROM rec WHERE created_at < {_CUT}) ELSE k || '-mem-' || CAST(event_id AS VARCHAR) END AS memory_id,
  CASE k WHEN 'rival' THEN 'TargetNotConfirmed' WHEN 'again' THEN 'DuplicateObject' ELSE 'MissingMemory' END AS reason
FROM rec, (SELECT unnest(['rival', 'lost', 'after', 'again']) AS k) x
WHERE created_at >= {_CUT} AND CASE k WHEN 'rival' THEN event_id % 5 = 0 AND prev_memory_id IS NOT NULL WHEN 'again' THEN event_id % 5 = 2 ELSE event_id % 5 = 1 END"""))
def b7_refused(spark, path):
    return memory.materialize(*accepted_batch(spark, path), records_then(spark, path))[2]


@query("b8_append_terminal_events", with_ctes(["rec"], """
SELECT 'end-' || memory_id AS event_id, memory_id, CASE WHEN r IS NULL THEN 'accepted' ELSE 'rejected' END AS outcome, r AS reason FROM (
  SELECT memory_id, CASE WHEN event_id % 4 = 0 THEN 'Materialization' WHEN current_state <> 'confirmed' THEN 'EventChain'
    WHEN event_id % 5 = 0 THEN 'EventChain' END AS r FROM rec)"""))
def b8_append_terminal_events(spark, path):
    r = bind.records(spark, path)
    n = F.expr("substring(memory_id, 5)").cast("long")
    kinds = F.array(F.lit("superseded"), F.lit("retracted"), F.lit("contradicted"), F.lit("expired"))
    incoming = r.select(
        F.concat(F.lit("end-"), "memory_id").alias("event_id"), "namespace_id", "memory_id",
        F.element_at(kinds, (F.pmod(n, F.lit(4)) + 1).cast("int")).alias("event_type"),
        F.when(F.pmod(n, F.lit(5)) != 0, F.col("last_state_event_id")).alias("previous_event_id"),
        F.col("created_at").alias("occurred_at"),
    )
    return memory.append_terminal_events(chains.memory_current(bind.state_events(spark, path)), incoming)


cte("closing", ["evt"], """
SELECT memory_id, min(effective_at) AS closed_at FROM evt WHERE previous_event_id IS NOT NULL GROUP BY memory_id""")

GOVERNED = f"""deletion_state = 'active' AND sensitivity = 'personal' AND created_at <= {AS_OF}
  AND NOT (retention_mode = 'until_time' AND (retention_expires_at IS NULL OR retention_expires_at <= {AS_OF}))"""

cte("then_", ["rec", "closing"], f"""
SELECT r.* FROM rec r LEFT JOIN closing c ON c.memory_id = r.memory_id
WHERE {GOVERNED} AND valid_start <= {AS_OF} AND (c.closed_at IS NULL OR c.closed_at > {AS_OF})""")


@query("t3_current_at", with_ctes(["then_"], """
SELECT memory_id, lineage_id, version, 'confirmed' AS current_state, 'evt-' || substr(memory_id, 5) || '-1' AS last_state_event_id FROM then_"""))
def t3_current_at(spark, path):
    found = asof.current_at(bind.records(spark, path), bind.state_events(spark, path), bind.ntz(), PERSONAL)
    return found.select("memory_id", "lineage_id", "version", "current_state", "last_state_event_id")


def roots_sql(text: str) -> str:
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    cases = " ".join(
        f"WHEN strlen(w) > {len(s) + 2} AND ends_with(w, '{s}') THEN left(w, length(w) - {len(s)})"
        for s in ["ations", "ation", "ions", "ion", "ing", "ed", "s"]
    )
    found = f"list_transform(regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}\\-]+'), lambda w: translate(w, '{up}', '{low}'))"
    return f"list_distinct(list_transform({found}, lambda w: CASE {cases} ELSE w END))"


@query("u11_word_roots", with_ctes(["src"], f"""
SELECT source_id, root FROM (SELECT source_id, unnest({roots_sql('content')}) AS root FROM src)"""))
def u11_word_roots(spark, path):
    return bind.sources(spark, path).select("source_id", F.explode(roots(F.col("content"))).alias("root"))


@query("t3_query_at", with_ctes(["mem0", "then_"], """
SELECT q.query_id, t.memory_id FROM q JOIN t ON t.namespace_id = q.namespace_id AND list_has_all(t.roots, q.roots)""",
    q=f"SELECT 'q-' || CAST(event_id AS VARCHAR) AS query_id, namespace_id, {roots_sql('''event_type || 's ' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR)''')} AS roots FROM mem0",
    t=f"SELECT memory_id, namespace_id, {roots_sql('content')} AS roots FROM then_"))
def t3_query_at(spark, path):
    then = asof.current_at(bind.records(spark, path), bind.state_events(spark, path), bind.ntz(), PERSONAL)
    queries = bind.proposals(spark, path).select(
        F.concat(F.lit("q-"), F.col("event_id").cast("string")).alias("query_id"), "namespace_id",
        F.regexp_replace("content", " ", "s ").alias("query"),
    )
    return asof.query_at(then, queries)


@query("t4_applicability", with_ctes(["rec", "closing"], """
SELECT r.memory_id, r.valid_start AS start, c.closed_at AS stop FROM rec r LEFT JOIN closing c ON c.memory_id = r.memory_id"""))
def t4_applicability(spark, path):
    return asof.applicability(bind.records(spark, path), bind.state_events(spark, path)).select("memory_id", "start", "stop")


@query("t5_known_then", with_ctes(["rec", "evt"], f"""
SELECT r.memory_id FROM rec r LEFT JOIN (SELECT memory_id, min(effective_at) AS closed_at FROM evt
  WHERE previous_event_id IS NOT NULL AND occurred_at <= TIMESTAMP '2024-01-10 00:00:00' GROUP BY memory_id) c ON c.memory_id = r.memory_id
WHERE {GOVERNED} AND created_at <= TIMESTAMP '2024-01-10 00:00:00' AND valid_start <= {AS_OF} AND (c.closed_at IS NULL OR c.closed_at > {AS_OF})"""))
def t5_known_then(spark, path):
    return asof.current_at(
        bind.records(spark, path), bind.state_events(spark, path), bind.ntz(), PERSONAL,
        known_at=bind.ntz("2024-01-10 00:00:00"),
    ).select("memory_id")


@query("j19_current_on_grid", with_ctes(["rec", "closing"], """
SELECT g.as_of, r.namespace_id, r.memory_id FROM rec r LEFT JOIN closing c ON c.memory_id = r.memory_id
JOIN (SELECT DISTINCT CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 12 HOUR AS as_of FROM events) g
  ON r.valid_start <= g.as_of AND (c.closed_at IS NULL OR g.as_of < c.closed_at)"""))
def j19_current_on_grid(spark, path):
    days = bind.table(spark, path, "events").select(
        (F.to_date("ts").cast("timestamp_ntz") + F.expr("interval 12 hours")).alias("as_of")
    ).distinct()
    intervals = asof.applicability(bind.records(spark, path), bind.state_events(spark, path))
    return asof.current_on_grid(intervals, days)


_OPEN = """
SELECT p.*, CAST(proposed_at AS DATE) AS period FROM prop p
WHERE p.deletion_state = 'active' AND p.proposal_id NOT IN (SELECT proposal_id FROM dec WHERE decision IN ('accept', 'reject'))"""


@query("j22_open_proposals", with_ctes(["prop", "dec"], "SELECT proposal_id, namespace_id, subject_ref, content FROM o", o=_OPEN))
def j22_open_proposals(spark, path):
    tips = chains.decision_tips(bind.decisions(spark, path))
    return asof.open_proposals(bind.proposals(spark, path), tips).select("proposal_id", "namespace_id", "subject_ref", "content")


def found_conflicts(spark, path):
    tips = chains.decision_tips(bind.decisions(spark, path))
    opened = asof.open_proposals(bind.proposals(spark, path), tips)
    period = F.to_date("proposed_at")
    return opened, asof.conflicts(opened, bind.records(spark, path), period), period


_CONFLICTS = """
SELECT namespace_id, subject_ref, memory_type, period, count(*) AS n_proposals, count(DISTINCT content_digest) AS n_values,
  false AS any_selected, count(DISTINCT fragment_ref) AS n_evidence FROM o GROUP BY ALL HAVING count(DISTINCT content_digest) > 1"""


@query("q6_conflicts", with_ctes(["prop", "dec"], _CONFLICTS, o=_OPEN))
def q6_conflicts(spark, path):
    return found_conflicts(spark, path)[1]


@query("q9_conflict_notices", with_ctes(["prop", "dec"], """
SELECT c.namespace_id, c.subject_ref, c.memory_type, c.period, 'conflict_notice' AS item_type, 'conflict' AS temporal_role,
  count(*) AS n_citations, """ + SET_DIGEST + """ AS evidence_digest
FROM (SELECT DISTINCT c.namespace_id, c.subject_ref, c.memory_type, c.period, sha256(fragment_ref) AS h
  FROM c JOIN o ON o.namespace_id = c.namespace_id AND o.subject_ref = c.subject_ref AND o.memory_type = c.memory_type AND o.period = c.period) c
GROUP BY ALL""", o=_OPEN, c=_CONFLICTS))
def q9_conflict_notices(spark, path):
    opened, found, period = found_conflicts(spark, path)
    return asof.conflict_notices(opened, found, period)


@query("q7_contradictions", with_ctes(["rec"], """
SELECT namespace_id, memory_id, contradicts_memory_id FROM rec WHERE contradicts_memory_id IS NOT NULL"""))
def q7_contradictions(spark, path):
    return asof.contradictions(bind.records(spark, path))


def cloned(suffix: str, replaced: dict[str, tuple[list[str], str]], as_of: str = AS_OF) -> str:
    """Copies of the recall expressions that read another set of queries."""
    chain = ["qs", "phr", "post", "asked", "hits"]
    for name in chain:
        needs, body = replaced.get(name, CTES[name])
        for other in chain:
            body = re.sub(rf"\b{other}\b", f"{other}{suffix}", body) if name not in replaced else body
        body = body.replace(AS_OF, as_of)
        cte(f"{name}{suffix}", [f"{n}{suffix}" if n in chain and name not in replaced else n for n in needs], body)
    return f"hits{suffix}"


def variants_sql(col: str) -> str:
    w = "w"
    return (
        f"list_concat(list_concat([{w}], CASE WHEN ends_with({w}, 'red') THEN [left({w}, length({w}) - 3), left({w}, length({w}) - 3) || 's'] ELSE [] END), "
        f"list_concat(CASE WHEN ends_with({w}, 'ed') THEN [left({w}, length({w}) - 2), left({w}, length({w}) - 2) || 's'] ELSE [] END, "
        f"CASE WHEN ends_with({w}, 's') THEN [regexp_replace({w}, 's+$', '')] ELSE [{w} || 's'] END))"
    )


_UP = "translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TRIES = f"""
SELECT DISTINCT query_id, namespace_id, v AS query FROM (
  SELECT query_id, namespace_id, unnest({variants_sql('w')}) AS v FROM (
    SELECT query_id, namespace_id, {_UP} AS w FROM (
      SELECT query_id, namespace_id, unnest(regexp_extract_all(query, '[\\p{{L}}\\p{{N}}\\-]+')) AS w FROM qs
      WHERE query_id NOT IN (SELECT query_id FROM hits)))) WHERE v <> ''"""
cte("tries", ["qs", "hits"], _TRIES)
cloned("_v", {"qs": (["tries"], "SELECT DISTINCT namespace_id || chr(1) || query AS query_id, namespace_id, query FROM tries")})


@query("q5_recall_with_variants", with_ctes(["hits", "tries", "hits_v"], """
SELECT query_id, object_kind, object_id, CAST(rank AS BIGINT) AS rank, false AS expanded FROM hits
UNION ALL
SELECT query_id, object_kind, object_id, rank, true FROM (
  SELECT query_id, object_kind, object_id, row_number() OVER (PARTITION BY query_id ORDER BY object_id) AS rank FROM (
    SELECT DISTINCT t.query_id, h.object_kind, h.object_id FROM tries t JOIN hits_v h ON h.query_id = t.namespace_id || chr(1) || t.query))
WHERE rank <= 10"""))
def q5_recall_with_variants(spark, path):
    qs = bind.recall_queries(spark, path, tip_fragments(spark, path))
    found = asof.recall_with_variants(recall_index(spark, path), qs, bind.ntz(), 10, PERSONAL)
    return found.withColumn("rank", F.col("rank").cast("long"))


cloned("_c", {"qs": (["prop"], """
SELECT DISTINCT 'cur-' || namespace_id || '-' || event_type AS query_id, namespace_id, event_type AS query FROM prop""")},
       "TIMESTAMP '2024-02-01 00:00:00'")


@query("t2_query_current", with_ctes(["hits_c"], """
SELECT query_id, object_id, CAST(rank AS BIGINT) AS rank FROM hits_c WHERE rank <= 5 AND object_kind = 'memory_record'"""))
def t2_query_current(spark, path):
    """Top-5 current values per namespace for each event type."""
    per = bind.proposals(spark, path).select("namespace_id", F.col("event_type").alias("query")).distinct()
    queries = per.withColumn("query_id", F.concat(F.lit("cur-"), "namespace_id", F.lit("-"), "query"))
    hits = recall_batch(recall_index(spark, path), queries, bind.ntz("2024-02-01 00:00:00"), 5, PERSONAL)
    return hits.filter("object_kind = 'memory_record'").select(
        "query_id", "object_id", F.col("rank").cast("long").alias("rank")
    )
