import hashlib
import itertools
import random
import unicodedata

from pyspark.sql import functions as F

from memlake.functions import digest, temporal, text
from memlake.sources.intake import noise_rows


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def column(spark, values, expr, typ="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {typ}").repartition(2)
    return [r["x"] for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def test_timestamp_order_is_exact(spark):
    ordered = [
        "2016-12-31T23:59:59.9999999999Z",
        "2016-12-31T23:59:60.5Z",
        "2017-01-01T00:00:00Z",
        "2026-08-23T02:11:12.3400000001Z",
        "2026-08-23T02:11:12.3400000002Z",
    ]
    keys = column(spark, ordered, lambda v: temporal.sort_key(temporal.parse_timestamp(v)))
    assert keys == sorted(keys) and len(set(keys)) == 5
    same = ["2026-08-23T10:11:12.340+08:00", "2026-08-23T02:11:12.34Z", "2026-08-23T02:11:12.34000Z"]
    assert len(set(column(spark, same, lambda v: temporal.sort_key(temporal.parse_timestamp(v))))) == 1


def test_bad_timestamps_are_null(spark):
    bad = ["2026-02-30T00:00:00Z", "2026-01-01", "2026-01-01T24:00:00Z", "2026-01-01T00:00:60Z", "x", "2026-01-01T00:00:00"]
    assert column(spark, bad, temporal.parse_timestamp) == [None] * len(bad)


def test_valid_time_modes(spark):
    rows = [
        ("unknown", None, None, 5, False), ("instant", 5, None, 5, True), ("instant", 5, None, 6, False),
        ("interval", 3, 7, 3, True), ("interval", 3, 7, 7, False), ("open_ended", 3, None, 9, True), ("open_ended", 3, None, 2, False),
    ]
    df = spark.createDataFrame(rows, "mode string, s int, e int, t int, want boolean")
    got = df.select("want", temporal.valid_at(F.col("mode"), F.col("s"), F.col("e"), F.col("t")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)
    bad = spark.createDataFrame([("interval", 7, 3), ("interval", None, 3), ("instant", 1, 2), ("open_ended", 1, None)], "mode string, s int, e int")
    found = [r[0] for r in bad.select(temporal.valid_time_problem(F.col("mode"), F.col("s"), F.col("e"))).collect()]
    assert found == ["IntervalOrder", "BoundaryCombination", "BoundaryCombination", None]


def test_nfc_digest_ignores_decomposition(spark):
    composed, loose = "café", "café"
    assert len(set(column(spark, [composed, loose], digest.nfc_digest))) == 1
    assert len(set(column(spark, [composed, loose], digest.exact_digest))) == 2
    values = ["plain", "ẛ̣", "각", None, ""]
    want = [None if v is None else unicodedata.normalize("NFC", v) for v in values]
    assert column(spark, values, text.nfc) == want


def test_json_digest(spark):
    same = ['{"b":1,"a":[1,2]}', '{ "a" : [1, 2], "b" : 1 }']
    assert len(set(column(spark, same, digest.json_digest))) == 1
    odd = ['{"a":1,"a":2}', '{"a":null}', '{"a":1e9}', '{"a":"null 1e9"}', '{"a":']
    assert column(spark, odd, digest.json_flags) == [["Syntax"], ["NullForbidden"], ["NumberExpansionLimit"], [], ["Syntax"]]


def test_tokens_fold_case_and_marks(spark):
    got = column(spark, ["École AMBER-47 näive x_y Łódź"], text.tokens)[0]
    assert got == ["ecole", "amber", "47", "naive", "x", "y", "łodz"]
    assert text.tokenize_query("École amber-47 -- !") == [["ecole"], ["amber", "47"]]
    assert column(spark, ['a "b c'], text.match_expression) == ['"a" """b" "c"']


def test_cjk_bigrams(spark):
    assert column(spark, ["東京都 ab"], text.cjk_bigram_tokens)[0] == ["東京", "京都", "ab"]
    assert text.tokenize_query("東京都", "cjk_bigram") == [["東京", "京都"]]


def test_roots_and_variants(spark):
    got = column(spark, ["Observations stations runs red is needing no-sync"], text.roots)[0]
    assert got == ["observ", "stat", "run", "red", "is", "need", "no-sync"]
    assert sorted(column(spark, ["scarred"], text.variants)[0]) == sorted(["scarred", "scar", "scars", "scarr", "scarrs", "scarreds"])
    assert sorted(column(spark, ["glass"], text.variants)[0]) == sorted(["glass", "gla"])


def test_line_ends_match_python(spark):
    rng = random.Random(4)
    samples = ["", "\n", "a", "a\n", "\n\né", None] + ["".join(rng.choice("abé東\n") for _ in range(rng.randint(0, 40))) for _ in range(80)]
    got = column(spark, samples, text.line_ends)
    for sample, ends in zip(samples, got):
        lines = (sample or "").encode().split(b"\n")
        sizes = [len(x) + 1 for x in lines[:-1]] + ([len(lines[-1])] if lines[-1] else [])
        assert ends == list(itertools.accumulate(sizes)), sample


def test_byte_slice_respects_characters(spark):
    assert one(spark, text.byte_slice(F.lit("aéb"), F.lit(1), F.lit(3))) == "é"
    assert one(spark, text.byte_slice(F.lit("aéb"), F.lit(1), F.lit(2))) is None
    assert one(spark, text.byte_slice(F.lit("ab"), F.lit(1), F.lit(3))) is None


def _set_digest(members):
    sums = [0] * 8
    for m in set(members):
        h = hashlib.sha256(m.encode()).hexdigest()
        sums = [s + int(h[8 * i : 8 * i + 8], 16) for i, s in enumerate(sums)]
    return hashlib.sha256(":".join(map(str, [len(set(members)), *sums])).encode()).hexdigest()


def test_set_digest_has_one_definition_for_every_size(spark):
    sizes = {"a": 1, "b": 50, "c": 4096, "d": 4097, "e": 1_000_000}
    df = spark.createDataFrame(list(sizes.items()), "k string, n long").selectExpr("k", "explode(sequence(1, n)) AS i").selectExpr("k", "concat('m', i) AS m")
    got = {r["k"]: (r["n_members"], r["set_digest"]) for r in digest.set_digest(df.union(df.filter("k < 'e'")), ["k"], F.col("m")).collect()}
    assert got == {k: (n, _set_digest([f"m{i}" for i in range(1, n + 1)])) for k, n in sizes.items()}


def test_noise_wraps_at_64_bits(spark):
    seed = 2**63 + 6048
    rows = noise_rows(spark, 20, seed, "n {index} {topic}", ["topic-5x"]).collect()
    for r in rows:
        topic = ((seed * 1103515245 + r["index"] * 12345) % 2**64) % 97
        start = (seed * 1103515245) % 2**64
        assert topic == ((start + r["index"] * 12345) % 2**64) % 97
        assert r["content"] == f"n {r['index']} topic-{topic}" and not r["unsafe"]
