"""Batches: accepted decisions in order, checked appends, and the streams on top of them."""

import random

import pytest
from pyspark.sql import functions as F

from memlake.operators import commit, memory
from memlake.sources import bind
from memlake.sources.segment import segment_lines
from memlake.streaming import jobs

PROPOSAL = "proposal_id string, target_memory_ids array<string>"
DECISION = "proposal_id string, decision string, decision_id string, result_memory_id string, decided_at long"
RECORD = "memory_id string, current_state string, lineage_id string, version long"


def _one_by_one(decisions, targets, records):
    """What each decision comes to when they are taken in order."""
    state = {m: s for m, s, _, _ in records}
    place = {m: (lin, v) for m, _, lin, v in records}
    made, refused = {}, {}
    for p, _, d, m, _ in sorted(decisions, key=lambda r: (r[4], r[2])):
        # an id is spent by its first decision, also if that is refused
        first = min((r[4], r[2]) for r in decisions if r[3] == m)
        t = set(targets[p])
        if m in {r[0] for r in records} or first != next((r[4], r[2]) for r in decisions if r[2] == d):
            refused[d] = "DuplicateObject"
        elif any(x not in state for x in t):
            refused[d] = "MissingMemory"
        elif any(state[x] != "confirmed" for x in t):
            refused[d] = "TargetNotConfirmed"
        else:
            for x in t:
                state[x] = "superseded"
            state[m] = "confirmed"
            lin = max((place[x][0] for x in t), default=f"mlin-{m}")
            place[m] = (lin, max((place[x][1] for x in t), default=0) + 1)
            made[d] = (m, *place[m])
    return made, refused


def _run(spark, decisions, targets, records):
    rows = memory.accepted_batch(spark.createDataFrame(list(targets.items()), PROPOSAL), spark.createDataFrame(decisions, DECISION))
    stored = spark.createDataFrame(records, RECORD)
    out = memory.resolve_batch(rows, stored).collect()
    good = rows.join(spark.createDataFrame([(r["decision_id"],) for r in out if r["reason"] is None] or [("",)], "decision_id string"), "decision_id")
    versions = {r["memory_id"]: (r["lineage_id"], r["version"]) for r in memory._versions(good, stored).collect()}
    made = {r["decision_id"]: (r["memory_id"], *versions[r["memory_id"]]) for r in out if r["reason"] is None}
    return made, {r["decision_id"]: r["reason"] for r in out if r["reason"]}


def _batch(seed, n=24):
    rng = random.Random(seed)
    records = [("old0", "confirmed", "lin0", 3), ("old1", "superseded", "lin1", 1), ("old2", "confirmed", "lin2", 7)]
    decisions, targets = [], {}
    for i in range(n):
        pool = ["old0", "old1", "old2", "nowhere", *[f"m{j}" for j in range(max(0, i - 6), min(n, i + 2))]]
        k = rng.choice([0, 1, 1, 1, 1, 2, 3])
        targets[f"p{i}"] = rng.sample(pool, min(k, len(pool)))
        result = rng.choice([f"m{i}"] * 12 + ["old0", f"m{max(0, i - 1)}"])
        decisions.append((f"p{i}", "accept", f"d{i:02}", result, i // 2))
    rng.shuffle(decisions)
    return decisions, targets, records


@pytest.mark.parametrize("seed", [1, 2])
def test_a_batch_ends_as_if_taken_one_by_one(spark, seed):
    batch = _batch(seed)
    assert _run(spark, *batch) == _one_by_one(*batch)


def test_a_long_chain_in_one_batch_takes_few_rounds(spark, monkeypatch):
    n = 400
    decisions = [(f"p{i}", "accept", f"d{i:03}", f"m{i}", i) for i in range(n)]
    targets = {f"p{i}": [f"m{i - 1}"] if i else ["old"] for i in range(n)}
    cuts, cut = [], memory.cut_lineage
    monkeypatch.setattr(memory, "cut_lineage", lambda df: cuts.append(1) or cut(df))
    made, refused = _run(spark, decisions, targets, [("old", "confirmed", "lin", 1)])
    assert not refused and {m: v for m, _, v in made.values()} == {f"m{i}": i + 2 for i in range(n)}
    assert {lin for _, lin, _ in made.values()} == {"lin"} and len(cuts) < 16


def test_two_supersessions_of_one_target(spark):
    decisions = [("a", "accept", "d1", "m1", 5), ("b", "accept", "d2", "m2", 5), ("c", "accept", "d3", "m3", 6)]
    made, refused = _run(spark, decisions, {"a": ["old"], "b": ["old"], "c": ["m2"]}, [("old", "confirmed", "lin", 1)])
    assert made == {"d1": ("m1", "lin", 2)} and refused == {"d2": "TargetNotConfirmed", "d3": "MissingMemory"}


# appends


def _library(spark, sf, folder):
    s = bind.sources(spark, sf).filter("doc_id < 20")
    ids = s.select("source_id")
    base = {"sources": s, "fragments": bind.fragments(spark, sf).join(ids, "source_id", "left_semi").select(*bind.fragments(spark, sf).columns),
            "bindings": bind.origin_bindings(spark, sf).limit(0), "audit": bind.capture_audit(spark, sf).join(ids, "source_id", "left_semi").select(*bind.capture_audit(spark, sf).columns)}
    return commit.Library(spark, folder, base)


def _capture(lib, source_id, text, binding="origin-binding-new", lineage="lin-new"):
    """A request for a new binding; version and predecessor follow from the decision."""
    row = lib.base["sources"].filter("deletion_state = 'active'").limit(1).withColumns({
        "source_id": F.lit(source_id), "lineage_id": F.lit(lineage), "origin_ref": F.lit(binding), "content": F.lit(text),
        "content_length": F.octet_length(F.lit(text)).cast("long"), "content_digest": F.sha2(F.lit(text), 256),
    })
    return row.drop("version", "supersedes_source_ids")


def test_an_append_is_whole_or_nothing(spark, sf, tmp_path):
    lib = _library(spark, sf, str(tmp_path / "lib"))
    first = _capture(lib, "a1", "one\n")
    false = _capture(lib, "b1", "two\n", "origin-binding-b", "lin-b").withColumn("content_digest", F.lit("0" * 64))
    both = first.unionByName(false)
    before = {name: lib.table(name).count() for name in commit.TABLES}
    assert lib.append("x", both, segment_lines(both.withColumn("version", F.lit(1)))) == "refused"
    assert {name: lib.table(name).count() for name in commit.TABLES} == before
    assert {(r["object_id"], r["reason"]) for r in lib.problems().collect()} == {("b1", "DigestMismatch")}
    assert lib.append("y", first, segment_lines(first)) == "accepted"
    second = _capture(lib, "a2", "one\nmore\n")
    assert lib.append("z", second, segment_lines(second)) == "accepted"
    assert lib.append("z", first, segment_lines(first)) == "accepted"  # an id that has ended changes nothing
    tip = lib.tips().filter("lineage_id = 'lin-new'").first()
    assert (tip["source_id"], tip["version"]) == ("a2", 2)
    rows = {r["source_id"]: r for r in lib.appended("sources").collect()}
    assert {k: (r["version"], r["supersedes_source_ids"], r["batch_id"]) for k, r in rows.items()} == {"a1": (1, [], "y"), "a2": (2, ["a1"], "z")}
    assert lib.appended("bindings").count() == 1 and lib.appended("fragments").count() == 3 and lib.appended("audit").count() == 2
    moved = _capture(lib, "c1", "three\n", "origin-binding-new", "lin-other")
    assert lib.append("w", moved, segment_lines(moved)) == "refused"


def test_a_stream_of_captures_moves_the_library(spark, sf, tmp_path):
    lib = _library(spark, sf, str(tmp_path / "lib"))
    for i, text in enumerate(["one\n", "two\n", "two\n"]):
        _capture(lib, f"s{i}", text).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.read_stream(spark, str(tmp_path / "in"), _capture(lib, "s", "x"), 1)
    for _ in range(2):  # the second run, without its checkpoint, meets batches that have ended
        jobs.stream_commits(stream, lib, "captures", str(tmp_path / f"ck{_}")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["version"], r["outcome"]) for r in lib.appended("audit").join(lib.appended("sources").select("source_id", "version"), "source_id", "left").collect() if r["version"]) == [(1, "created"), (2, "versioned")]
    assert sorted(r["outcome"] for r in lib.appended("audit").collect()) == ["created", "idempotent", "versioned"]
    assert lib.commits().count() == 3


def test_compaction_changes_no_answer(spark, sf, tmp_path):
    target = str(tmp_path / "facts")
    events = bind.state_events(spark, sf)
    for i in range(3):
        jobs._event_facts(events.filter(F.pmod(F.hash("event_id"), F.lit(3)) == i)).write.parquet(f"{target}/batch={i}")
    rows = lambda: sorted(map(tuple, jobs.read_memory_current(spark, target).collect()))
    before = rows()
    assert jobs.compact_memory_current(spark, target) == 3 and rows() == before
    assert jobs.compact_memory_current(spark, target) == 0
