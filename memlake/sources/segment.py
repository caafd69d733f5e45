"""Segmentation of source bodies into byte-addressed fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.functions.digest import exact_digest
from memlake.functions.text import line_ends

GOVERNANCE = [
    "sensitivity",
    "egress_policy",
    "retention_mode",
    "retention_expires_at",
    "retention_policy_id",
    "deletion_state",
    "policy_basis",
]


def segment_lines(sources: DataFrame, with_content: bool = True) -> DataFrame:
    """One fragment per line (profile m0-lines-v1), newline included, no shuffle.

    An Arrow function returns only the line-end offsets of each body; the JVM cuts the
    slices, so a body crosses to Python once and the text never comes back.
    """
    ends = sources.withColumn("_ends", line_ends("content")).withColumn(
        "_body", F.col("content").cast("binary")
    )
    # the outer form infers no filter on the offsets, which would call the function a second time
    rows = ends.select(
        "namespace_id", "source_id", "_body", "_ends", *GOVERNANCE, "created_at",
        F.posexplode_outer("_ends").alias("ordinal", "byte_end"),
    ).filter("byte_end IS NOT NULL")
    start = F.when(F.col("ordinal") == 0, F.lit(0).cast("long")).otherwise(
        F.element_at("_ends", F.greatest(F.col("ordinal"), F.lit(1)))
    )
    rows = rows.withColumn("byte_start", start)
    content = F.substring(
        F.col("_body"),
        F.col("byte_start").cast("int") + 1,
        (F.col("byte_end") - F.col("byte_start")).cast("int"),
    ).cast("string")
    return _finish(rows, content, with_content)


def segment_whole(sources: DataFrame) -> DataFrame:
    """One fragment that holds the whole body."""
    rows = sources.withColumns(
        {
            "ordinal": F.lit(0),
            "byte_start": F.lit(0).cast("long"),
            "byte_end": F.octet_length("content").cast("long"),
        }
    )
    return _finish(rows, F.col("content"), True)


def segment_declared(sources: DataFrame, declared: DataFrame) -> DataFrame:
    """Fragments at declared ranges (source_id, ordinal, byte_start, byte_end); sources
    without any declared range become one whole fragment."""
    rows = sources.join(declared, "source_id")
    content = F.substring(
        F.col("content").cast("binary"),
        F.col("byte_start").cast("int") + 1,
        (F.col("byte_end") - F.col("byte_start")).cast("int"),
    ).cast("string")
    whole = segment_whole(sources.join(declared.select("source_id").distinct(), "source_id", "left_anti"))
    return _finish(rows, content, True).unionByName(whole)


def fragment_id(source_id="source_id", ordinal="ordinal"):
    number = F.col(ordinal).cast("string")
    return F.concat(
        F.col(source_id), F.lit("-f"), F.lpad(number, F.greatest(F.length(number), F.lit(5)), F.lit("0"))
    )


def _finish(rows: DataFrame, content, with_content: bool) -> DataFrame:
    cols = [
        fragment_id().alias("fragment_id"),
        "namespace_id",
        "source_id",
        F.col("ordinal").cast("long").alias("ordinal"),
        "byte_start",
        "byte_end",
    ]
    if with_content:
        cols += [content.alias("content"), exact_digest(content).alias("content_digest")]
    return rows.select(*cols, *GOVERNANCE, "created_at")
