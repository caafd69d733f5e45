"""Order and top-k helpers that never put one hot key into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.session import cut_lineage


def ordered_sequence(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    carry: Sequence[str] = (),
    seq: str = "seq",
) -> DataFrame:
    """Number rows 1..n per key, with the previous and next value of ``carry`` columns.

    ``bucket`` must not decrease along ``order`` (a day of a timestamp, say). Rows are
    sorted per (key, bucket); what crosses buckets comes from a small table of bucket
    edges. A key that holds a large share of all rows is spread over its buckets.
    """
    keys, order, carry = list(keys), list(order), list(carry)
    rows = df.withColumn("_b", bucket)
    by_order = F.struct(*order)
    edges = rows.groupBy(*keys, "_b").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.min_by(c, by_order).alias(f"_first_{c}") for c in carry],
        *[F.max_by(c, by_order).alias(f"_last_{c}") for c in carry],
    )
    across = Window.partitionBy(*keys).orderBy("_b")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(
        *keys, "_b",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        *[F.lag(f"_last_{c}").over(across).alias(f"_in_{c}") for c in carry],
        *[F.lead(f"_first_{c}").over(across).alias(f"_out_{c}") for c in carry],
    )
    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    joined = rows.join(edges, [*keys, "_b"])
    return joined.select(
        *df.columns,
        (F.col("_before") + F.row_number().over(inside)).alias(seq),
        *[F.coalesce(F.lag(c).over(inside), f"_in_{c}").alias(f"prev_{c}") for c in carry],
        *[F.coalesce(F.lead(c).over(inside), f"_out_{c}").alias(f"next_{c}") for c in carry],
    )


def range_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rank") -> DataFrame:
    """1-based rank of every row among the rows of its key, whatever share of all rows a key holds.

    Rows are dealt by sampled ranges of the whole order, so a hot key spans many tasks;
    what a key has in earlier ranges is added from one small row per key and range. The
    checkpoint pins the ranges, so counts and rows read afterwards agree.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys, cols = list(keys), [*keys, *order]
    packed = cut_lineage(
        df.repartitionByRange(n, *cols).sortWithinPartitions(*cols).withColumn("_id", F.monotonically_increasing_id())
    ).withColumn("_p", F.shiftright("_id", 33))
    ranges = packed.groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    earlier = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_p").alias("_q"), "_first",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
    )
    same = F.col("_p") == F.col("_q")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return packed.join(starts, same).select(*df.columns, (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias(name))


def top_k_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """Best ``k`` rows per key.

    Spark cuts every map task's output to ``k`` rows per key before the shuffle
    (WindowGroupLimit), so a hot key costs ``k`` rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """Rows ``offset .. offset+limit`` of the order. Use keyset paging for deep pages."""
    if limit < 1 or offset < 0:
        raise ValueError("limit must be at least 1 and offset not negative")
    return df.orderBy(*order).offset(offset).limit(limit)
