"""Version chains of sources: tips, lineage state, catalog pages, version lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions.ranking import page, range_rank

LINEAGE = ["namespace_id", "lineage_id"]


def active(df: DataFrame) -> DataFrame:
    return df.filter("deletion_state = 'active'")


def in_namespace(df: DataFrame, namespace_id: str) -> DataFrame:
    return df.filter(F.col("namespace_id") == namespace_id)


def lookup(df: DataFrame, namespace_id: str, id_column: str, object_id: str) -> DataFrame:
    """Active row of one id inside one namespace; empty when it does not exist."""
    found = in_namespace(df, namespace_id).filter(F.col(id_column) == object_id)
    return active(found) if "deletion_state" in df.columns else found


def tips(sources: DataFrame) -> DataFrame:
    """Newest version per lineage, only where that newest version is active.

    One aggregation over narrow columns. Filtering to active rows first would be wrong:
    a lineage whose newest version is gone has no tip.
    """
    newest = F.max(F.struct("version", "source_id", "deletion_state")).alias("n")
    return (
        sources.groupBy(*LINEAGE)
        .agg(newest)
        .filter("n.deletion_state = 'active'")
        .select(*LINEAGE, "n.source_id", "n.version")
    )


def lineage_state(bindings: DataFrame, tips_: DataFrame, sources: DataFrame) -> DataFrame:
    """Binding, tip and active source of each lineage."""
    live = active(sources).select("source_id")
    return bindings.join(tips_, LINEAGE).join(live, "source_id").select(
        *LINEAGE, "origin_binding_id",
        F.col("source_id").alias("current_source_id"),
        F.col("version").alias("current_version"),
    )


def active_version_counts(sources: DataFrame) -> DataFrame:
    return active(sources).groupBy(*LINEAGE).agg(F.count(F.lit(1)).alias("version_count"))


SUMMARY = [
    "title", "source_kind", "media_type", "content_length", "observed_at", "captured_at",
    "sensitivity", "retention_mode",
]


def lineage_summaries(sources: DataFrame) -> DataFrame:
    """Body-free row of the current version of each lineage, with its problem if any.

    One aggregation gives the newest version and the count of active versions together.
    """
    body_free = F.struct("version", "source_id", "deletion_state", "origin_kind", *SUMMARY)
    counted = sources.groupBy(*LINEAGE).agg(
        F.max_by(body_free, "version").alias("n"),
        F.count_if(F.col("deletion_state") == "active").alias("version_count"),
    )
    problem = F.when(
        (F.col("n.origin_kind") != "explicit_user_input") | (F.col("version_count") != F.col("n.version")),
        F.lit("InvalidFieldCombination"),
    )
    return counted.filter("n.deletion_state = 'active'").select(
        *LINEAGE,
        F.col("n.source_id").alias("current_source_id"),
        F.col("n.version").alias("current_version"),
        *[F.col(f"n.{c}").alias(c) for c in SUMMARY],
        "version_count",
        problem.alias("problem"),
    )


def catalog_page(summaries: DataFrame, namespace_id: str, offset: int, limit: int) -> DataFrame:
    """Page of a namespace: newest capture first, lineage id breaks ties."""
    rows = in_namespace(summaries, namespace_id)
    return page(rows, [F.desc("captured_at"), F.asc("lineage_id")], offset, limit)


def catalog_after(
    summaries: DataFrame, namespace_id: str, captured_at: Column, lineage_id: str, limit: int
) -> DataFrame:
    """Page that starts after a known row: the cost does not grow with the depth."""
    rows = in_namespace(summaries, namespace_id).filter(
        (F.col("captured_at") < captured_at)
        | ((F.col("captured_at") == captured_at) & (F.col("lineage_id") > lineage_id))
    )
    return page(rows, [F.desc("captured_at"), F.asc("lineage_id")], 0, limit)


def catalog_rank(summaries: DataFrame) -> DataFrame:
    """1-based rank of every lineage in its namespace's catalog order.

    A namespace, or one import day of it, can hold most lineages; ranks come from ranges.
    """
    rows = summaries.select(
        *LINEAGE, "captured_at", (-F.unix_micros(F.col("captured_at").cast("timestamp"))).alias("_newest")
    )
    return range_rank(rows, ["namespace_id"], ["_newest", "lineage_id"], "catalog_rank").drop("_newest")


def version_summaries(sources: DataFrame, tips_: DataFrame) -> DataFrame:
    """Body-free row per active version with a flag for the current one."""
    current = tips_.select("source_id", F.lit(True).alias("_tip"))
    return active(sources).join(current, "source_id", "left").select(
        *LINEAGE, "source_id", "version", *SUMMARY,
        F.coalesce("_tip", F.lit(False)).alias("current"),
    )


def version_chain_problems(sources: DataFrame, tips_: DataFrame) -> DataFrame:
    """Lineages with a tip whose active versions are not exactly 1..n with one current.

    Counting replaces walking the chain: n distinct versions, first 1, last n.
    """
    rows = version_summaries(sources, tips_)
    per = rows.groupBy(*LINEAGE).agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("version").alias("distinct_versions"),
        F.min("version").alias("first_version"),
        F.max("version").alias("last_version"),
        F.count_if("current").alias("n_current"),
    )
    return (
        per.join(tips_.select(*LINEAGE), LINEAGE)
        .withColumn(
            "reason",
            F.when(F.col("n_current") != 1, F.lit("current_count"))
            .when(
                (F.col("distinct_versions") != F.col("n"))
                | (F.col("first_version") != 1)
                | (F.col("last_version") != F.col("n")),
                F.lit("version_gap"),
            ),
        )
        .filter("reason is not null")
    )
