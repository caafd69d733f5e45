import os

import pytest
from pyspark.sql import functions as F

from memlake.operators import capture, chains, rules
from memlake.operators.maintain import drift
from memlake.sources import bind, intake
from memlake.sources.lake import Lake
from memlake.sources.segment import segment_declared, segment_lines
from memlake.streaming import jobs


def test_lake_publishes_whole_batches(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    a = spark.createDataFrame([(1, "x")], "id int, v string")
    assert lake.commit({"a": a, "b": a}) == 1
    with pytest.raises(ValueError):
        lake.commit({"a": a.withColumn("id", F.lit(2))}, check=lambda t: t["a"])
    assert [r["id"] for r in lake.read("a").collect()] == [1]
    assert lake.commit({"a": a.withColumn("id", F.lit(3))}, check=lambda t: t["a"].filter(F.lit(False))) == 2
    assert [r["id"] for r in lake.read("a").collect()] == [3]
    assert [r["id"] for r in lake.read("a", 1).collect()] == [1]
    assert lake.read("b").count() == 1 and lake.verify("a") and lake.verify("b")


def test_intake_rejects_with_reasons(spark, tmp_path):
    files = {
        "a.txt": b"hello", "b.MD": b"# title\n", "empty.txt": b"", "page.html": b"<p>", "bad.txt": b"\xc3\x28", "nul.txt": b"a\x00b",
        "max.txt": b"x" * intake.MAX_BYTES, "big.txt": b"x" * (intake.MAX_BYTES + 1),
    }
    for name, body in files.items():
        (tmp_path / name).write_bytes(body)
    accepted, rejected = intake.read_files(spark, str(tmp_path))
    # the file source gives no row for an empty file, which is found in the listing
    blank = spark.createDataFrame([("e.txt", bytearray())], "name string, content binary")
    assert intake.classify(blank).first()["reject_reason"] == "empty"
    assert {r["name"]: r["source_kind"] for r in accepted.collect()} == {"a.txt": "text", "b.MD": "markdown", "max.txt": "text"}
    assert {r["name"]: r["reject_reason"] for r in rejected.collect()} == {
        "empty.txt": "empty", "page.html": "unsupported_type", "bad.txt": "invalid_utf8", "nul.txt": "nul_byte", "big.txt": "too_large",
    }


def test_export_is_exact_and_never_overwrites(spark, sf, tmp_path):
    s = bind.sources(spark, sf).filter("deletion_state = 'active'")
    out = str(tmp_path / "out")
    receipts = intake.export_sources(s, out)
    assert receipts.join(s, ["source_id", "content_digest", "content_length"]).count() == s.count()
    with pytest.raises(Exception):
        intake.export_sources(s, out)
    with pytest.raises(ValueError):
        intake.export_sources(s.withColumn("content", F.lit("x")), str(tmp_path / "other"))


def test_suite_reader(spark, tmp_path):
    f = tmp_path / "suite.json"
    f.write_text(
        '{"suite_id":"s","namespace_id":"n","metric_gates":[{"metric_id":"m","kind":"ratio","comparator":"eq","threshold":{"numerator":1,"denominator":1}}],'
        '"scenarios":[{"scenario_id":"A","operations":[{"step_id":"1","op":"search","input":{"query":"q","top_k":5,"expected_relevant_keys":["k"]}},{"step_id":"2","op":"capture"}]}]}'
    )
    queries, gates = intake.read_suite(spark, str(f))
    assert [(r["query_id"], r["query"], r["expected_relevant_keys"]) for r in queries.collect()] == [("A/1", "q", ["k"])]
    assert gates.first().asDict() == {"metric_id": "m", "thr_num": 1, "thr_den": 1}


def test_fragments_rebuild_every_body(spark, sf):
    s = bind.sources(spark, sf)
    rebuilt = segment_lines(s).groupBy("source_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "content"))), lambda x: x["content"]), "").alias("again")
    )
    assert s.join(rebuilt, "source_id").filter("content <> again").count() == 0
    assert rules.fragment_cover(segment_lines(s), s).count() == 0
    active = s.filter("deletion_state = 'active'")
    assert rules.fragment_resolution(segment_lines(active), active).count() == 0
    ranges = s.limit(1).select("source_id", F.lit(0).alias("ordinal"), F.lit(0).cast("long").alias("byte_start"), F.lit(4).cast("long").alias("byte_end"))
    declared = segment_declared(s, ranges)
    assert declared.count() == s.count() and declared.filter("byte_end = 4").count() >= 1


def test_clean_tables_break_no_rule(spark, sf):
    p, d, r, e = (f(spark, sf) for f in (bind.proposals, bind.decisions, bind.records, bind.state_events))
    s = bind.sources(spark, sf)
    for found in (
        rules.source_rows(s), rules.proposal_rows(p), rules.decision_rows(d), rules.record_rows(r), rules.event_rows(e),
        rules.event_chains(r, e), rules.materialization(p, d, r, e), rules.supersession(p, r, e),
        rules.stored_supersession_causes(p, r, e), rules.event_references(e, d, r), rules.superseded_sources(s), rules.id_reuse(s, "source_id", "SourceArtifact"),
    ):
        rows = found.filter("reason <> 'RecallBlocked'").take(3)
        assert rows == []


def test_stream_reaches_the_batch_answer(spark, sf, tmp_path):
    events = bind.state_events(spark, sf)
    folder, target = str(tmp_path / "in"), str(tmp_path / "facts")
    # ends arrive before beginnings, everything arrives twice, and the oldest comes again last
    oldest = events.orderBy("occurred_at", "event_id").limit(20)
    for part in (events.exceptAll(oldest).filter("previous_event_id is not null"), events.exceptAll(oldest).filter("previous_event_id is null"), events.exceptAll(oldest), oldest):
        part.coalesce(1).write.mode("append").parquet(folder)
    stream = jobs.read_stream(spark, folder, events, 1)
    job = jobs.stream_memory_current(stream, target, str(tmp_path / "ck")).trigger(availableNow=True).start()
    job.awaitTermination(120)
    assert drift(jobs.read_memory_current(spark, target), chains.memory_current(events), ["memory_id"]).count() == 0


def test_capture_stream_equals_batch(spark, sf, tmp_path):
    from memlake.operators.versions import tips
    from memlake.plans.maintenance_queries import incoming_captures

    s, b = bind.sources(spark, sf), bind.origin_bindings(spark, sf)
    incoming = incoming_captures(spark, sf)
    incoming.write.parquet(str(tmp_path / "in"))
    stream = jobs.read_stream(spark, str(tmp_path / "in"), incoming, 1)
    job = jobs.stream_captures(stream, lambda: (s, b), str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start()
    job.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    want = capture.decide_captures(incoming, b, capture.current_facts(s, tips(s)), s)
    assert drift(got, want, ["source_id"]).count() == 0
    assert os.path.isdir(tmp_path / "out")


def _capture(source, binding, text, sensitivity="personal", kind="text"):
    return {
        "source_id": source, "namespace_id": "n", "lineage_id": f"lin-{binding}", "origin_binding_id": binding, "content_length": len(text), "content_digest": text,
        "source_kind": kind, "media_type": "text/plain", "sensitivity": sensitivity, "egress_policy": "local", "retention_mode": "open_ended",
        "retention_expires_at": None, "retention_policy_id": "p", "policy_basis": "b",
    }


def test_captures_of_one_binding_are_taken_in_order(spark):
    from memlake.operators import capture, versions

    stored = [{**_capture("s1", "old", "one"), "version": 4, "supersedes_source_ids": [], "deletion_state": "active"}]
    schema = "source_id string, namespace_id string, lineage_id string, origin_binding_id string, content_length long, content_digest string, source_kind string, media_type string, sensitivity string, egress_policy string, retention_mode string, retention_expires_at timestamp_ntz, retention_policy_id string, policy_basis string"
    sources = spark.createDataFrame(stored, schema + ", version long, supersedes_source_ids array<string>, deletion_state string")
    incoming = [
        _capture("a1", "old", "two"), _capture("a2", "old", "two"), _capture("a3", "old", "one"), _capture("a4", "old", "x", "restricted"), _capture("a5", "old", "three"),
        _capture("b1", "new", "one"), _capture("b2", "new", "one"), _capture("b3", "new", "two"), _capture("b4", "new", "two", "restricted"),
    ]
    bindings = spark.createDataFrame([("n", "old", "lin-old")], "namespace_id string, origin_binding_id string, lineage_id string")
    out = capture.decide_captures(spark.createDataFrame(incoming, schema), bindings, capture.current_facts(sources, versions.tips(sources)), sources)
    got = {r["source_id"]: (r["outcome"], r["next_version"], r["result_source_id"]) for r in out.collect()}
    assert got == {
        "a1": ("versioned", 5, "a1"), "a2": ("idempotent", None, "a1"), "a3": ("versioned", 6, "a3"), "a4": ("rejected", None, None), "a5": ("versioned", 7, "a5"),
        "b1": ("created", 1, "b1"), "b2": ("idempotent", None, "b1"), "b3": ("versioned", 2, "b3"), "b4": ("rejected", None, None),
    }


def test_a_batch_of_decisions_extends_each_tip_once(spark):
    from memlake.operators import memory

    schema = "decision_id string, proposal_id string, namespace_id string, previous_decision_id string, decision string, result_memory_id string, decided_at timestamp_ntz"
    at = __import__("datetime").datetime(2024, 1, 1)
    stored = spark.createDataFrame([("d0", "p1", "n", None, "defer", None, at)], schema)
    proposals = spark.createDataFrame([("p1", "n"), ("p2", "n"), ("p3", "n")], "proposal_id string, namespace_id string")
    records = spark.createDataFrame([("m0",)], "memory_id string")
    incoming = spark.createDataFrame([
        ("d1", "p1", "n", "d0", "accept", "m1", at), ("d2", "p1", "n", "d0", "reject", None, at), ("d3", "p1", "n", "d0", "accept", "m9", at),
        ("d4", "p2", "n", None, "defer", None, at), ("d5", "p2", "n", None, "reject", None, at), ("d6", "p3", "n", None, "accept", "m1", at),
    ], schema)
    got = {r["decision_id"]: r["reason"] for r in memory.append_decisions(proposals, stored, incoming, records).collect()}
    assert got == {"d1": None, "d2": "TerminalDecision", "d3": "TerminalDecision", "d4": None, "d5": "DecisionChain", "d6": "DuplicateObject"}


def test_empty_files_are_rejected(spark, tmp_path):
    from memlake.sources import intake

    for name, body in (("a b.txt", b"x"), ("empty one.txt", b""), ("c.bin", b""), ("d.md", b"\xff")):
        (tmp_path / name).write_bytes(body)
    accepted, rejected = intake.read_files(spark, str(tmp_path))
    assert [r["name"] for r in accepted.collect()] == ["a b.txt"]
    assert {r["name"]: r["reject_reason"] for r in rejected.collect()} == {"empty one.txt": "empty", "c.bin": "unsupported_type", "d.md": "invalid_utf8"}
