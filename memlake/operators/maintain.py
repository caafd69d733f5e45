"""Verification and rebuild of derived tables, and inventory reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions.digest import row_fingerprint

STATES = ["prepared", "committed", "abandoning", "abandoned", "deleting", "deleted"]


def drift(actual: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys where two tables differ: missing, extra, altered or repeated rows.

    Rows are compared by fingerprint, so one aggregation over keys and digests replaces
    two set differences over whole rows.
    """
    cols = sorted(expected.columns)

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, row_fingerprint(*cols).alias("fp"), F.lit(name).alias("side"))

    both = side(actual.select(*expected.columns), "a").unionByName(side(expected, "e"))
    per = both.groupBy(*keys).agg(
        F.count_if(F.col("side") == "a").alias("n_actual"), F.count_if(F.col("side") == "e").alias("n_expected"),
        F.min("fp").alias("lo"), F.max("fp").alias("hi"),
    )
    reason = (
        F.when(F.col("n_actual") == 0, "missing")
        .when(F.col("n_expected") == 0, "extra")
        .when((F.col("n_actual") > 1) | (F.col("n_expected") > 1), "repeated")
        .when(F.col("lo") != F.col("hi"), "altered")
    )
    return per.select(*keys, reason.alias("reason")).filter("reason is not null")


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Row count and order-free hash sum of a table, cheap enough for every read."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("hash_sum"))


def effective_inventory(inventory: DataFrame, deletions: DataFrame) -> DataFrame:
    """Inventory rows whose state a deletion record overrides."""
    d = deletions.select("source_id", F.col("state").alias("d_state"))
    return inventory.join(d, "source_id", "left").withColumn("state", F.coalesce("d_state", "state")).drop("d_state")


def inventory_report(inventory: DataFrame, deletions: DataFrame) -> DataFrame:
    """Number of objects per effective state and namespace, one column per state."""
    rows = effective_inventory(inventory, deletions)
    return rows.groupBy("namespace_id").agg(*[F.count_if(F.col("state") == s).alias(f"n_{s}") for s in STATES])


def _reasons(df: DataFrame, key: str, checks: Sequence[tuple[str, Column]]) -> DataFrame:
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in checks]), lambda r: r.isNotNull())
    return df.select(F.col(key).alias("source_id"), F.explode(found).alias("reason"))


def reconcile(inventory: DataFrame, sources: DataFrame, refs: DataFrame, deletions: DataFrame) -> DataFrame:
    """Objects, catalog rows and references that contradict each other, with the reason."""
    m = inventory.select("source_id", *[F.col(c).alias(f"m_{c}") for c in ("namespace_id", "state", "digest", "length", "media_type", "locator", "attempt_id")])
    a = sources.select("source_id", *[F.col(c).alias(f"a_{c}") for c in ("namespace_id", "deletion_state", "content_digest", "content_length", "media_type")])
    r = refs.select("source_id", F.col("locator").alias("r_locator"), F.col("attempt_id").alias("r_attempt_id"))
    d = deletions.select("source_id", F.col("state").alias("d_state"))
    rows = m.join(a, "source_id", "full_outer").join(r, "source_id", "left").join(d, "source_id", "left")
    has_m, has_a = F.col("m_state").isNotNull(), F.col("a_deletion_state").isNotNull()
    has_r, has_d = F.col("r_locator").isNotNull(), F.col("d_state").isNotNull()
    early = F.col("m_state").isin("prepared", "abandoning", "abandoned")
    late = F.col("m_state").isin("committed", "retired")
    return _reasons(rows, "source_id", [
        ("early_object_in_catalog", early & (has_a | has_r)),
        ("committed_without_source", late & ~has_a),
        ("committed_without_reference", late & ~has_d & ~has_r),
        ("deleted_still_referenced", late & has_d & (has_r | (F.col("a_deletion_state") == "active"))),
        ("namespace_mismatch", late & (F.col("m_namespace_id") != F.col("a_namespace_id"))),
        ("digest_mismatch", late & ((F.col("m_digest") != F.col("a_content_digest")) | (F.col("m_length") != F.col("a_content_length")))),
        ("media_type_mismatch", late & (F.col("m_media_type") != F.col("a_media_type"))),
        ("reference_mismatch", late & ((F.col("m_locator") != F.col("r_locator")) | (F.col("m_attempt_id") != F.col("r_attempt_id")))),
        ("active_without_reference", has_a & (F.col("a_deletion_state") == "active") & ~has_r),
    ])


def reconcile_deletions(deletions: DataFrame, bodies: DataFrame, inventory: DataFrame, sources: DataFrame, refs: DataFrame) -> DataFrame:
    """Deletion records against the body closure of their plan and the catalog."""
    d = deletions.select("source_id", "delete_request_id", F.lit(True).alias("has_d"))
    c = bodies.select("source_id", "delete_request_id", F.lit(True).alias("has_c"))
    m = inventory.select("source_id", F.col("state").alias("m_state"))
    a = sources.select("source_id", "deletion_state")
    r = refs.select("source_id", F.lit(True).alias("has_r"))
    rows = d.join(c, ["source_id", "delete_request_id"], "full_outer").join(m, "source_id", "left").join(a, "source_id", "left").join(r, "source_id", "left")
    has_d = F.col("has_d").isNotNull()
    return _reasons(rows, "source_id", [
        ("not_in_closure", has_d & F.col("has_c").isNull()),
        ("closure_without_deletion", F.col("has_c").isNotNull() & ~has_d),
        ("object_not_committed", has_d & ~F.col("m_state").isin("committed", "retired")),
        ("source_missing_or_active", has_d & (F.col("deletion_state").isNull() | (F.col("deletion_state") == "active"))),
        ("still_referenced", has_d & F.col("has_r").isNotNull()),
    ])


def audit_bodies(sources: DataFrame, supplied: DataFrame, expected_digests: DataFrame, attempts: DataFrame) -> DataFrame:
    """Active sources whose supplied body or capture request differs from what is recorded."""
    body = supplied.select("source_id", F.sha2(F.col("content").cast("binary"), 256).alias("b_digest"), F.octet_length("content").alias("b_length"))
    asked = attempts.filter("state = 'committed' and kind = 'capture'").select("source_id", F.col("request_digest").alias("stored_request"))
    rows = (
        sources.filter("deletion_state = 'active'").select("source_id", "content_digest", "content_length")
        .join(body, "source_id", "full_outer")
        .join(expected_digests.select("source_id", "request_digest"), "source_id", "left")
        .join(asked, "source_id", "left")
    )
    return _reasons(rows, "source_id", [
        ("body_missing", F.col("b_digest").isNull()),
        ("body_unknown", F.col("content_digest").isNull()),
        ("body_mismatch", (F.col("b_digest") != F.col("content_digest")) | (F.col("b_length") != F.col("content_length"))),
        ("request_mismatch", F.col("stored_request").isNotNull() & (F.col("stored_request") != F.col("request_digest"))),
    ])


def mutation_pending(inventory: DataFrame, unfinished_deletions: DataFrame) -> DataFrame:
    """Namespaces with an unfinished deletion or an object that is not settled yet."""
    open_objects = inventory.filter(F.col("state").isin("prepared", "abandoning")).select("namespace_id")
    return open_objects.unionByName(unfinished_deletions.select("namespace_id")).distinct()
