"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.session import cut_lineage, work_folder

#: A word is a maximal run of characters other than space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of one Arrow batch: texts are long, and a batch is held several times at once.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lets no Arrow batch to or from Python hold more than ``BATCH_ROWS`` rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once although ``body`` may name it often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(id, component): smallest id reachable over undirected ``edges`` of two long columns.

    Every round each node takes the smallest label among its own and its neighbours', then
    the label of its label (pointer doubling), so long chains shorten by half per round.
    Labels and edges stay distributed; each round is checkpointed. Ends when a round
    changes nothing. Edges with nulls are ignored; an empty frame gives an empty frame.
    """
    one = edges.select(F.col(left).cast("long").alias("u"), F.col(right).cast("long").alias("v"))
    one = one.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    links = cut_lineage(one.union(one.select("v", "u")).distinct())
    labels = cut_lineage(links.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("label")))
    while True:
        near = (
            links.join(labels.withColumnsRenamed({"id": "v", "label": "got"}), "v")
            .groupBy("u").agg(F.min("got").alias("got"))
        )
        step = (
            labels.join(near, F.col("id") == F.col("u"), "left")
            .select("id", F.col("label").alias("old"), F.least("label", "got").alias("label"))
        )
        up = step.select(F.col("id").alias("at"), F.col("label").alias("next"))
        step = cut_lineage(
            step.join(up, F.col("label") == F.col("at"), "left")
            .select("id", "old", F.coalesce(F.least("label", "next"), "label").alias("label"))
        )
        changed = step.filter("label <> old").limit(1).count()
        labels = step.select("id", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component")


def small_side(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """``df`` (narrow rows) marked for a broadcast if it is counted to hold few rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the folder all executors share, and read again."""
    path = f"{work_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets the driver drop what finished jobs left: shuffle files go when nothing refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
