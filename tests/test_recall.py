import pytest
from pyspark.sql import functions as F

from memlake.operators import recall

T0, T1, T2 = "2024-01-01 00:00:00", "2024-01-10 00:00:00", "2024-01-20 00:00:00"
SCHEMA = (
    "object_kind string, object_id string, namespace_id string, sensitivity string, content string, available_at string, "
    "retention_mode string, retention_expires_at string, valid_mode string, valid_start string, valid_end string"
)


def frag(i, content, sensitivity="personal", ns="n", at=T0, mode="until_deleted", expires=None):
    return ("source_fragment", i, ns, sensitivity, content, at, mode, expires, None, None, None)


def mem(i, content, mode="open_ended", start=T0, end=None):
    return ("memory_record", i, "n", "personal", content, T0, "until_deleted", None, mode, start, end)


def frame(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    for c in ("available_at", "retention_expires_at", "valid_start", "valid_end"):
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


def as_of(text=T1):
    return F.lit(text).cast("timestamp_ntz")


def ask(spark, data, query, k=10, **kw):
    hits = recall.recall(frame(spark, data), query, as_of(), k, "n", ["personal"], **kw).collect()
    return [r["object_id"] for r in hits]


FILLER = [frag(f"z{i}", f"other words {i}") for i in range(8)]


def test_ties_come_in_id_order_and_restricted_is_absent(spark):
    data = FILLER + [frag("c", "amber light"), frag("a", "amber light"), frag("b", "amber light", "restricted")]
    assert ask(spark, data, "amber") == ["a", "c"]


def test_eligibility_is_decided_before_the_cut(spark):
    data = FILLER + [frag(f"a{i}", "amber amber amber", "restricted") for i in range(5)] + [frag("z", "amber once in a longer text")]
    assert ask(spark, data, "amber", k=1) == ["z"]


def test_a_term_of_two_tokens_is_a_phrase(spark):
    data = FILLER + [frag("a", "code amber-47 here"), frag("b", "47 amber"), frag("c", "amber and 47")]
    assert ask(spark, data, "amber-47") == ["a"]
    assert sorted(ask(spark, data, "amber 47")) == ["a", "b", "c"]


def test_time_retention_and_validity(spark):
    data = FILLER + [
        frag("late", "amber", at=T2), frag("gone", "amber", mode="until_time", expires=T1), frag("kept", "amber", mode="until_time", expires=T2),
        frag("broken", "amber", mode="until_time"), frag("foreign", "amber", ns="m"),
        mem("m-open", "amber"), mem("m-unknown", "amber", "unknown", None), mem("m-ended", "amber", "interval", T0, T1), mem("m-now", "amber", "instant", T1),
    ]
    assert sorted(ask(spark, data, "amber")) == ["kept", "m-now", "m-open"]


def test_arguments_are_checked(spark):
    rows = frame(spark, FILLER)
    for query, k, allowed in (("  ", 1, ["personal"]), ("x", 0, ["personal"]), ("x", 1, [])):
        with pytest.raises(ValueError):
            recall.recall(rows, query, as_of(), k, "n", allowed)
    assert recall.recall(rows, "--", as_of(), 3, "n", ["personal"]).collect() == []


def test_batch_equals_single(spark):
    words = ["amber light over the hill", "light light amber", "amber-47 amber 47", "hill over", "the amber the light the", "a a b a a"]
    data = [frag(f"f{i}", w) for i, w in enumerate(words * 3)] + FILLER + [mem("m1", "amber hill")]
    rows = frame(spark, data)
    queries = ["amber", "the amber", "amber-47", "light light", "a-a", "hill missing", "over hill light", "--"]
    qs = spark.createDataFrame([(q, "n", q) for q in queries], "query_id string, namespace_id string, query string")
    batch = {}
    for r in recall.recall_batch(rows, qs, as_of(), 5, ["personal"]).collect():
        batch.setdefault(r["query_id"], []).append((r["rank"], r["object_id"], r["score"]))
    for q in queries:
        single = recall.recall(rows, q, as_of(), 5, "n", ["personal"]).collect()
        want = [(r["object_id"], r["score"]) for r in single]
        assert [(i, s) for _, i, s in sorted(batch.get(q, []))] == want, q


def test_cjk_tokenizer_finds_parts_of_a_run(spark):
    data = FILLER + [frag("j", "東京都の天気")]
    assert ask(spark, data, "天気") == []
    assert ask(spark, data, "天気", tokenizer="cjk_bigram") == ["j"]


def test_single_recall_does_not_shuffle_rows(spark):
    hits = recall.recall(frame(spark, FILLER), "other words", as_of(), 3, "n", ["personal"])
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "hashpartitioning" not in plan


def test_ids_of_the_cited_fragments_go_to_the_bodies(spark):
    from memlake.operators import context

    hits = spark.createDataFrame([("q", 1, "source_fragment", "f1"), ("q", 2, "memory_record", "m1"), ("r", 1, "source_fragment", "f1")], "query_id string, rank int, object_kind string, object_id string")
    fragments = spark.createDataFrame([(f"f{i}", "s", 0, 1, "x", "d") for i in range(4)], "fragment_id string, source_id string, byte_start long, byte_end long, content string, content_digest string")
    sources = spark.createDataFrame([("s", "l", 1, "t")], "source_id string, lineage_id string, version int, title string")
    records = spark.createDataFrame([("m1", ["f2", "f3"])], "memory_id string, source_fragment_refs array<string>")
    items = hits.selectExpr("query_id", "rank - 1 AS ordinal", "object_kind AS item_type", "object_id")
    found, cited = recall.source_search(hits, fragments, sources), context.citations(items, records, fragments)
    for df in (found, cited):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert any("BroadcastHashJoin" in x and "fragment_id" in x and "LeftSemi" in x for x in plan.splitlines())
    assert sorted((r["query_id"], r["fragment_id"]) for r in found.collect()) == [("q", "f1"), ("r", "f1")]
    assert sorted((r["query_id"], r["fragment_id"]) for r in cited.collect()) == [("q", "f1"), ("q", "f2"), ("q", "f3"), ("r", "f1")]


def test_variant_words_are_cut_before_their_hits_are_joined(spark, monkeypatch):
    import random

    from memlake.operators import asof

    rng = random.Random(7)
    vocabulary = [f"w{i}x" for i in range(40)]
    # lists of hits overlap and many words share their lowest id
    hits = {w: sorted({f"o{rng.choice([0, 1, 2, 3, rng.randrange(60)]):03d}" for _ in range(rng.randrange(1, 5))}) for w in vocabulary if rng.random() < 0.8}
    asked = {f"q{i}": rng.sample(vocabulary, rng.randrange(1, 25)) for i in range(30)}
    table = spark.createDataFrame([(w, f"kind{int(o[1:]) % 2}", o, k + 1) for w, os in hits.items() for k, o in enumerate(os)], "word string, object_kind string, object_id string, rank int")

    def search(rows, queries, *_):
        return queries.withColumnRenamed("query", "word").join(table, "word").select("query_id", "object_kind", "object_id", "rank")

    monkeypatch.setattr(asof.recall, "recall_batch", search)
    queries = spark.createDataFrame([(q, "n", " ".join(ws)) for q, ws in asked.items()], "query_id string, namespace_id string, query string")
    for k in (1, 3, 10):
        out = asof.recall_with_variants(frame(spark, FILLER), queries, as_of(), k, ["personal"])
        got = {(r["query_id"], r["rank"]): r["object_id"] for r in out.filter("expanded").collect()}
        # a question of one word is found as it stands
        want = {(q, n + 1): o for q, ws in asked.items() if len(ws) > 1 or ws[0] not in hits
                for n, o in enumerate(sorted({o for w in ws for o in hits.get(w, [])})[:k])}
        assert got == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "dense_rank" in plan and "regexp_extract_all" not in plan
