from pyspark.sql import functions as F

from memlake.operators import deletion, recall
from memlake.plans import deletion_queries as dq
from memlake.session import cut_lineage


def test_second_run_finds_nothing_and_recall_stays_empty(spark, sf):
    found, closure, closed, planned, results = dq.first_attempt(spark, sf)
    after = deletion.apply_results(closed, closure, results)
    after = {k: cut_lineage(after[k]) for k in ("sources", "fragments", "proposals", "decisions", "records", "events", "recall_rows")}
    none = dq.failures(found).filter(F.lit(False))
    again = deletion.component_results(planned, deletion.affected(after, closure), none, F.lit("t"), "p", F.lit(2))
    outcomes = {r["component_key"]: r["o"] for r in again.groupBy("component_key").agg(F.collect_set("outcome").alias("o")).collect()}
    for key in ("source-body", "source-fragment", "full-text-index", "context-cache"):
        assert outcomes[key] == ["not_found"]
    assert again.filter("status <> 'succeeded'").count() == 0
    assert after["sources"].filter("deletion_state = 'active'").count() == 0
    closed_ids = closure.filter("component_type = 'full_text_index'").select("object_id")
    assert closed["recall_rows"].join(closed_ids, "object_id", "left_semi").count() == 0


def test_a_failed_component_never_reopens_targets(spark, sf):
    _, closure, closed, _, results = dq.first_attempt(spark, sf)
    after = deletion.apply_results(closed, closure, results)
    states = {r[0] for r in after["records"].join(closure.select(F.col("object_id").alias("memory_id")), "memory_id", "left_semi").select("deletion_state").distinct().collect()}
    assert states <= {"deleted", "failed"}


def test_targets_follow_supersession_out_of_the_lineage(spark):
    sources = spark.createDataFrame(
        [("s1", "n", "l1", 1, "active"), ("s2", "n", "l1", 2, "active"), ("s3", "n", "l2", 1, "active"), ("s0", "n", "l1", 3, "deleted")],
        "source_id string, namespace_id string, lineage_id string, version int, deletion_state string",
    )
    fragments = spark.createDataFrame([("f1", "s1", "active"), ("f3", "s3", "active")], "fragment_id string, source_id string, deletion_state string")
    records = spark.createDataFrame(
        [("m1", "n", ["f1"], [], "active"), ("m2", "n", ["f3"], ["m1"], "active"), ("m3", "n", ["f3"], ["m2", "m9"], "active"),
         ("m4", "n", ["f3"], ["m2"], "active"), ("m5", "n", ["f3"], [], "active"), ("m6", "n", ["f1"], [], "deleted")],
        "memory_id string, namespace_id string, source_fragment_refs array<string>, supersedes_memory_ids array<string>, deletion_state string",
    )
    req = spark.createDataFrame([("d", "n", "l1")], "delete_request_id string, namespace_id string, lineage_id string")
    found = deletion.targets(req, sources, fragments, records)
    assert {r["object_id"] for r in found.collect()} == {"s1", "s2", "m1", "m2", "m3", "m4"}
    assert deletion.plan_completeness(found, sources, fragments, records).count() == 0
    part = found.filter("object_id not in ('m3', 's2')")
    assert {r["object_id"] for r in deletion.plan_completeness(part, sources, fragments, records).collect()} == {"m3", "s2"}
    order = [r["object_id"] for r in deletion.ordered_targets(found).orderBy("ordinal").collect()]
    assert order == ["s1", "s2", "m1", "m2", "m3", "m4"]


def test_allow_list_is_monotone(spark, sf):
    from memlake.functions.governance import eligible
    from memlake.plans.recall_queries import rows
    from memlake.sources import bind

    r = cut_lineage(rows(spark, sf).select(*recall.ROW))
    few = r.filter(eligible(bind.ntz(), ["personal"]))
    more = r.filter(eligible(bind.ntz(), ["personal", "restricted"]))
    assert few.join(more, "object_id", "left_anti").count() == 0 and more.count() > few.count()


def test_fragments_without_content_are_read_and_tips_are_sent_to_the_bodies(spark, sf):
    from memlake.plans.recall_queries import tip_sources
    from memlake.sources import bind

    read = bind.fragments(spark, sf, False)._jdf.queryExecution().toString()
    assert "Python" not in read and "line_ends" not in read
    joined = tip_sources(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in joined and "SortMergeJoin" not in joined


def test_many_closure_digests_are_dealt_to_tasks_of_bounded_size(spark, monkeypatch):
    closure = spark.range(1000).select(F.lit("r").alias(deletion.REQUEST), F.lit("c").alias("component_type"), F.lit("o").alias("object_type"), F.col("id").cast("string").alias("object_id"))
    found = closure.select(deletion.REQUEST, "object_type", "object_id")
    once = deletion.plan_fingerprints(deletion.plan(found), closure).collect()
    monkeypatch.setattr(deletion, "TASK_ROWS", 10)
    dealt = deletion.plan_fingerprints(deletion.plan(found), closure.unionByName(closure))
    assert "REPARTITION_BY_NUM" in dealt._jdf.queryExecution().toString()
    assert dealt.collect() == once and once[0]["n_rows"] == 1010


def test_counts_of_rows_left_are_those_of_the_whole_tables(spark, sf):
    _, closure, closed, _, results = dq.first_attempt(spark, sf)
    before, after = dq.tables(spark, sf), deletion.apply_results(closed, closure, results)
    count = lambda tables: sorted(map(tuple, deletion.affected(tables, closure).collect()))
    for whole, bodies in ((closed, False), (after, True)):
        left = deletion.rows_left(before, whole, bodies)
        assert left["records"] is before["records"] and left["proposals"] is before["proposals"]
        assert count(left) == count(whole)
    per_request = after["records"]._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in per_request and "collect_set" not in per_request


def test_recall_rows_of_a_deletion_are_ids_from_the_stored_tables(spark, sf):
    from memlake.plans.recall_queries import rows

    ids = dq.tables(spark, sf)["recall_rows"]
    key = ["object_kind", "object_id"]
    assert sorted(map(tuple, ids.select(*key).collect())) == sorted(map(tuple, rows(spark, sf).select(*key).collect()))
    plan = ids._jdf.queryExecution().optimizedPlan().toString()
    assert "ython" not in plan


def test_the_closure_plan_makes_its_proposals_once(spark, sf):
    found = dq.found_targets(spark, sf)
    plan = dq.closure_of(spark, sf, found)._jdf.queryExecution().analyzed().toString()
    # the references of proposals to fragments are exploded where the proposals are made, not in the plan of the closure
    assert "explode(source_fragment_refs" not in plan


def test_one_attempt_is_a_short_row_per_request_in_the_driver(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(deletion, "small_side", lambda df: sent.append(df) or df)
    types = [t for _, t, _ in deletion.PROFILE]
    results = spark.createDataFrame(
        [(r, t, "failed" if (r, t) in {("a", "memory_record"), ("b", "minimal_audit")} else "succeeded") for r in "ab" for t in types],
        "delete_request_id string, component_type string, status string",
    )
    closure = spark.createDataFrame(
        [("a", "memory_record", "m1"), ("a", "memory_proposal", "p1"), ("b", "memory_record", "m2"), ("b", "memory_proposal", "p2"), ("c", "memory_record", "m3")],
        "delete_request_id string, component_type string, object_id string",
    )
    state = "string, content string, content_digest string, source_fragment_refs array<string>, deletion_state string"
    source = "source_id string, namespace_id string, lineage_id string, content string, title string, origin_ref string, deletion_state string"
    tables = {
        "records": spark.createDataFrame([(f"m{i}", "x", "d", ["f"], "pending") for i in (1, 2, 3)], f"memory_id {state}"),
        "proposals": spark.createDataFrame([(f"p{i}", "x", "d", ["f"], "pending") for i in (1, 2)], f"proposal_id {state}"),
        "sources": spark.createDataFrame([], source), "fragments": spark.createDataFrame([], "fragment_id string"),
        "decisions": spark.createDataFrame([], "decision_id string, reason_text string"), "recall_rows": spark.createDataFrame([], "object_id string"),
    }
    after = deletion.apply_results(tables, closure, results)
    got = {r["memory_id"]: (r["content"], r["deletion_state"]) for r in after["records"].collect()}
    assert got == {"m1": ("x", "failed"), "m2": (deletion.MARKER, "pending"), "m3": ("x", "pending")}
    assert {r["proposal_id"]: (r["content"], r["deletion_state"]) for r in after["proposals"].collect()} == {"p1": (deletion.MARKER, "failed"), "p2": (deletion.MARKER, "pending")}
    assert all(kind in ("string", "int", "boolean") for _, kind in sent[0].dtypes)


def test_counts_are_written_group_by_group_without_components_that_have_no_rows(spark, sf):
    _, closure, closed, _, _ = dq.first_attempt(spark, sf)
    counts = deletion.affected(deletion.rows_left(dq.tables(spark, sf), closed, False), closure)
    assert "Join" not in counts._jdf.queryExecution().optimizedPlan().toString()
    assert {r[0] for r in counts.select("component_type").distinct().collect()}.isdisjoint({"minimal_audit", "context_cache"})


def test_fingerprints_are_made_of_written_rows(spark, monkeypatch):
    closure = spark.range(9).select(F.lit("r").alias(deletion.REQUEST), F.lit("c").alias("component_type"), F.lit("o").alias("object_type"), F.col("id").cast("string").alias("object_id"))
    plan = deletion.plan_fingerprints(deletion.plan(closure), closure)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Range" not in plan
