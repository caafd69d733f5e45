import random

from pyspark.sql import functions as F

from memlake.functions.ranking import ordered_sequence, range_rank, top_k_per_key
from memlake.functions.skew import salted_join


def rows(n=400):
    rng = random.Random(1)
    # one key holds most rows
    return [("hot" if rng.random() < 0.7 else f"k{rng.randint(0, 20)}", rng.randint(0, 60), i) for i in range(n)]


def test_ordered_sequence_equals_a_plain_sort(spark):
    data = rows()
    df = spark.createDataFrame(data, "k string, t int, i int")
    got = ordered_sequence(df, ["k"], ["t", "i"], F.floor(F.col("t") / 7), carry=["i"]).collect()
    by_key = {}
    for r in got:
        by_key.setdefault(r["k"], []).append(r)
    for key, found in by_key.items():
        want = sorted((t, i) for k, t, i in data if k == key)
        found.sort(key=lambda r: r["seq"])
        assert [(r["t"], r["i"]) for r in found] == want
        assert [r["seq"] for r in found] == list(range(1, len(want) + 1))
        ids = [i for _, i in want]
        assert [r["prev_i"] for r in found] == [None] + ids[:-1]
        assert [r["next_i"] for r in found] == ids[1:] + [None]


def test_ranks_are_spread_though_all_rows_share_a_day_and_a_prefix(spark):
    data = rows(600) + [(None, 7, i) for i in range(700, 740)]
    df = spark.createDataFrame(data, "k string, t int, i int").select("k", F.lit("2024-01-01").alias("day"), F.concat(F.lit("same-long-prefix-"), F.format_string("%05d", "i")).alias("id")).repartition(5)
    ranked = range_rank(df, ["k"], ["day", "id"])
    got = {}
    for r in ranked.collect():
        got.setdefault(r["k"], []).append((r["rank"], r["id"]))
    for k, found in got.items():
        assert sorted(found) == list(enumerate(sorted(f"same-long-prefix-{i:05d}" for x, _, i in data if x == k), 1))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, "k", "day", "id").filter("k = 'hot'").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(dealt) > 1 and max(r["count"] for r in dealt) < 0.6 * len(data)


def test_top_k_limits_before_the_shuffle(spark):
    df = spark.createDataFrame(rows(), "k string, t int, i int").repartition(4)
    top = top_k_per_key(df, ["k"], [F.desc("t"), F.asc("i")], 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    hot = sorted(((-r["t"], r["i"]) for r in top.collect() if r["k"] == "hot"))
    assert hot == sorted((-t, i) for k, t, i in rows() if k == "hot")[:3]


def test_salted_join_equals_a_join(spark):
    big = spark.createDataFrame(rows(), "k string, t int, i int")
    small = spark.createDataFrame([("hot", "x"), ("k3", "y"), ("none", "z")], "k string, v string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = sorted(map(str, salted_join(big, small, ["k"], ["i"], how).select("i").collect()))
        b = sorted(map(str, big.join(small, "k", how).select("i").collect()))
        assert a == b
