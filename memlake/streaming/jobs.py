"""The append-only inputs as streams: live memory state and live capture outcomes."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.operators.capture import current_facts, decide_captures
from memlake.operators.commit import Library
from memlake.operators.versions import tips
from memlake.sources.segment import segment_lines


def read_stream(spark: SparkSession, folder: str, like: DataFrame, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def _event_facts(events: DataFrame) -> DataFrame:
    """Mergeable summary per memory: its root and, if seen, the event that follows it."""
    child = F.col("previous_event_id").isNotNull()
    return events.groupBy("namespace_id", "memory_id").agg(
        F.max(F.when(~child, F.struct("event_id", "event_type"))).alias("root"),
        F.max(F.when(child, F.struct("event_id", "event_type", "previous_event_id"))).alias("child"),
    )


def current_from_facts(facts: DataFrame) -> DataFrame:
    """Current state; an end whose parent has not arrived yet waits."""
    ready = F.col("root").isNotNull()
    linked = F.col("child.previous_event_id") == F.col("root.event_id")
    return facts.filter(ready).select(
        "memory_id", "namespace_id",
        F.when(linked, F.col("child.event_type")).otherwise(F.col("root.event_type")).alias("current_state"),
        F.when(linked, F.col("child.event_id")).otherwise(F.col("root.event_id")).alias("last_state_event_id"),
    )


def stream_memory_current(events: DataFrame, target: str, checkpoint: str):
    """Keep a table of event facts up to date; read it with :func:`read_memory_current`.

    Each batch appends one small summary per touched memory. Summaries are maxima, so
    repeated events and a batch that runs twice change nothing, an event may be late by any
    time, and a late parent simply completes its memory. No state is kept in the stream.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        _event_facts(batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def read_memory_current(spark: SparkSession, target: str) -> DataFrame:
    facts = spark.read.parquet(target)
    merged = facts.groupBy("namespace_id", "memory_id").agg(F.max("root").alias("root"), F.max("child").alias("child"))
    return current_from_facts(merged)


def compact_memory_current(spark: SparkSession, target: str) -> int:
    """Merges the facts of all ended batches into one folder; gives how many it replaced.

    Facts are maxima, so a reader that sees both the merged facts and those they were made
    of reads the same; the merged folder is complete before an old one goes. Run it while no
    batch is writing, or later again for what came meanwhile.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    ended = [s.getPath() for s in fs.listStatus(path) if s.isDirectory() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    if len(ended) < 2:
        return 0
    facts = spark.read.parquet(*[p.toString() for p in ended])
    merged = facts.groupBy("namespace_id", "memory_id").agg(F.max("root").alias("root"), F.max("child").alias("child"))
    merged.write.parquet(f"{target}/batch={-uuid.uuid4().int % 2**31 - 2**31}")
    for p in ended:
        fs.delete(p, True)
    return len(ended)


def stream_commits(incoming: DataFrame, library: Library, name: str, checkpoint: str):
    """Appends each batch of captures (source rows) to ``library``, line by line as fragments.

    A batch is published or refused as a whole under the id ``name``-number, so one that runs
    again changes nothing, and the next is decided against the tips this one has moved.
    """
    def commit(batch: DataFrame, batch_id: int) -> None:
        library.append(f"{name}-{batch_id}", batch, segment_lines(batch))

    return incoming.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)


def stream_captures(
    incoming: DataFrame, load: Callable[[], tuple[DataFrame, DataFrame]], target: str, checkpoint: str
):
    """Decide each batch of incoming captures against the library as it is then.

    ``load`` returns (sources, bindings). Outcomes are written per batch id, so a batch
    that runs again replaces its own outcome.
    """
    def decide(batch: DataFrame, batch_id: int) -> None:
        sources, bindings = load()
        outcome = decide_captures(batch, bindings, current_facts(sources, tips(sources)), sources)
        outcome.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return incoming.writeStream.foreachBatch(decide).option("checkpointLocation", checkpoint)
