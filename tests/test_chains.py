import random

import pytest
from pyspark.sql import functions as F

from memlake.operators import chains, rules


def test_positions_in_a_long_shuffled_chain(spark):
    n = 300
    rows = [(f"d{i:04d}", f"d{i - 1:04d}" if i else None) for i in range(n)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "id string, prev string")
    got = {r["id"]: r["position"] for r in chains.chain_positions(df, "id", "prev").collect()}
    assert got == {f"d{i:04d}": i for i in range(n)}


def test_cycles_and_dangling_links_have_no_position(spark):
    rows = [("a", None), ("b", "a"), ("x", "z"), ("y", "x"), ("z", "y"), ("s", "s"), ("lost", "nowhere"), ("after", "lost")]
    df = spark.createDataFrame(rows, "id string, prev string")
    got = {r["id"]: r["position"] for r in chains.chain_positions(df, "id", "prev").collect()}
    assert got == {"a": 0, "b": 1, "x": None, "y": None, "z": None, "s": None, "lost": None, "after": None}


def test_decision_tips(spark):
    rows = [
        ("p1", "a1", None, "defer"), ("p1", "a2", "a1", "defer"), ("p1", "a3", "a2", "accept"),
        ("p2", "b1", None, "defer"), ("p2", "b2", None, "defer"),
        ("p3", "c1", None, "defer"), ("p3", "c2", "c1", "accept"), ("p3", "c3", "c1", "reject"),
        ("p4", "d1", None, "accept"), ("p4", "d2", "d1", "reject"),
        ("p5", "e1", None, "defer"), ("p5", "e2", "e3", "defer"), ("p5", "e3", "e2", "defer"),
    ]
    df = spark.createDataFrame(rows, "proposal_id string, decision_id string, previous_decision_id string, decision string")
    got = {r["proposal_id"]: (r["tip_decision_id"], r["problem"]) for r in chains.decision_tips(df).collect()}
    assert got["p1"] == ("a3", None)
    assert all(got[p] == (None, "DecisionChain") for p in ("p2", "p3", "p4", "p5"))


def brute(seeds, edges):
    out = set(seeds)
    todo = list(seeds)
    while todo:
        g, n = todo.pop()
        for a, b in edges:
            if a == n and (g, b) not in out:
                out.add((g, b))
                todo.append((g, b))
    return out


def test_reachable_matches_a_walk(spark):
    long = [(f"n{i}", f"n{i + 1}") for i in range(70)] + [("m0", "n30"), ("c1", "c2"), ("c2", "c1")]
    branching = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "e"), ("x", "y")]
    for edges in (long, branching):
        seeds = [("g1", edges[0][0]), ("g2", edges[len(edges) // 2][0]), ("g1", "c1")]
        e = spark.createDataFrame(edges, "src string, dst string")
        s = spark.createDataFrame(seeds, "g string, node string")
        got = {(r["g"], r["node"]) for r in chains.reachable(s, e, "g").collect()}
        assert got == brute(seeds, edges)


def test_reachable_in_random_graphs(spark):
    rng = random.Random(8)
    for n, m in ((30, 28), (40, 60), (25, 25)):
        edges = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)]
        edges += [(f"p{i}", f"p{i + 1}") for i in range(20)] + [("p20", "n0"), ("n1", "p0")]
        seeds = [(f"g{rng.randrange(3)}", f"n{rng.randrange(n)}") for _ in range(5)] + [("g9", "alone")]
        got = chains.reachable(spark.createDataFrame(seeds, "g string, node string"), spark.createDataFrame(edges, "src string, dst string"), "g")
        assert {(r["g"], r["node"]) for r in got.collect()} == brute(seeds, edges)


def test_a_long_chain_with_a_branch_takes_few_rounds(spark, monkeypatch):
    n = 10_000
    edges = spark.range(n).selectExpr("concat('c', id) AS src", "concat('c', id + 1) AS dst").union(spark.sql("SELECT 'c5000', 'side' UNION ALL SELECT 'side', 'end'"))
    cuts, cut = [], chains.cut_lineage
    monkeypatch.setattr(chains, "cut_lineage", lambda df: cuts.append(1) or cut(df))
    seeds = spark.createDataFrame([("g", "c0"), ("h", "c7000")], "g string, node string")
    got = {r["g"]: r["count"] for r in chains.reachable(seeds, edges, "g").groupBy("g").count().collect()}
    assert got == {"g": n + 3, "h": n - 6999} and len(cuts) < 20



EVENT = "event_id string, namespace_id string, memory_id string, previous_event_id string, event_type string, from_state string"
RECORD = "memory_id string, namespace_id string, current_state string, last_state_event_id string"


def test_event_chain_rules(spark):
    events = [
        ("a1", "n", "ok", None, "confirmed", None), ("a2", "n", "ok", "a1", "retracted", "confirmed"),
        ("b1", "n", "roots", None, "confirmed", None), ("b2", "n", "roots", None, "confirmed", None),
        ("c1", "n", "branch", None, "confirmed", None), ("c2", "n", "branch", "c1", "expired", "confirmed"), ("c3", "n", "branch", "c1", "expired", "confirmed"),
        ("d1", "n", "gap", None, "confirmed", None), ("d2", "n", "gap", "d0", "expired", "confirmed"),
        ("e1", "n", "stale", None, "confirmed", None), ("e2", "n", "stale", "e1", "expired", "confirmed"),
        ("f2", "n", "cycle", "f3", "expired", "confirmed"), ("f3", "n", "cycle", "f2", "expired", "confirmed"),
    ]
    records = [("ok", "n", "retracted", "a2"), ("stale", "n", "confirmed", "e1"), ("none", "n", "confirmed", "q")] + [
        (m, "n", "confirmed", "x") for m in ("roots", "branch", "gap", "cycle")
    ]
    random.Random(5).shuffle(events)
    got = {(r["object_id"], r["reason"]) for r in rules.event_chains(
        spark.createDataFrame(records, RECORD), spark.createDataFrame(events, EVENT)).collect()}
    assert got == {
        ("roots", "EventChainConflict"), ("branch", "EventChainConflict"), ("gap", "EventChainConflict"),
        ("cycle", "EventChainConflict"), ("stale", "StateProjectionMismatch"), ("none", "MissingReference"),
    }
    current = {r["memory_id"]: r["current_state"] for r in chains.memory_current(spark.createDataFrame(events, EVENT)).collect()}
    assert current["ok"] == "retracted" and current["stale"] == "expired"


def test_seeds_that_lead_nowhere_else_need_no_pointer_rounds(spark, monkeypatch):
    path = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(200)]
    edges = spark.createDataFrame(path, "src string, dst string")
    seeds = spark.createDataFrame([("g", f"n{i:03d}") for i in range(201)] + [("h", "n200"), ("h", "away")], "g string, node string")
    monkeypatch.setattr(chains, "cut_lineage", lambda df: pytest.fail("the closed seeds were walked"))
    got = {tuple(r) for r in chains.reachable(seeds, edges, "g").collect()}
    assert got == {tuple(r) for r in seeds.collect()}
