"""Quality metrics as exact ratios, and their gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def metric(df: DataFrame, metric_id: str, numerator: Column, denominator: Column | None = None) -> DataFrame:
    """One row (metric_id, numerator, denominator); counts have denominator 1."""
    bottom = F.lit(1) if denominator is None else denominator
    return df.agg(F.coalesce(numerator, F.lit(0)).cast("long").alias("numerator"), F.coalesce(bottom, F.lit(0)).cast("long").alias("denominator")).select(
        F.lit(metric_id).alias("metric_id"), "numerator", "denominator"
    )


def combine(parts: Sequence[DataFrame]) -> DataFrame:
    """Sum of numerators and denominators per metric over scenarios."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("metric_id").agg(F.sum("numerator").alias("numerator"), F.sum("denominator").alias("denominator"))


def gates(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Exact comparison num/den = thr_num/thr_den by cross multiplication.

    A missing metric or a zero denominator fails its gate.
    """
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    rows = thresholds.join(metrics, "metric_id", "left")
    ok = (F.col("denominator") > 0) & (F.col("thr_den") > 0) & (
        wide("numerator") * wide("thr_den") == wide("thr_num") * wide("denominator")
    )
    return rows.select("metric_id", "numerator", "denominator", "thr_num", "thr_den", F.coalesce(ok, F.lit(False)).alias("passed"))


def citation_resolve_rate(cited: DataFrame, unresolved: DataFrame) -> DataFrame:
    bad = unresolved.select(F.col("object_id").alias("citation_id")).distinct().withColumn("bad", F.lit(True))
    rows = cited.select("citation_id").join(bad, "citation_id", "left")
    return metric(rows, "citation_resolve_rate", F.count_if(F.col("bad").isNull()), F.count(F.lit(1)))


def recall_at(hits: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """Expected (query_id, object) pairs among the first k hits, over all expected ones."""
    found = hits.filter(F.col("rank") <= k).select("query_id", "expected_id").distinct().withColumn("hit", F.lit(True))
    rows = expected.select("query_id", "expected_id").distinct().join(found, ["query_id", "expected_id"], "left")
    return metric(rows, f"retrieval_recall_at_{k}", F.count_if(F.col("hit").isNotNull()), F.count(F.lit(1)))


def unconfirmed_context_count(items: DataFrame, proposals: DataFrame) -> DataFrame:
    hit = items.join(proposals.select(F.col("proposal_id").alias("object_id")), "object_id", "left_semi")
    return metric(hit, "unconfirmed_context_count", F.count(F.lit(1)))


def duplicate_reproposal_count(admitted: DataFrame, keyed: DataFrame) -> DataFrame:
    """Accepted proposals beyond one per semantic key."""
    rows = keyed.join(admitted.filter("outcome = 'accepted'").select("proposal_id"), "proposal_id", "left_semi")
    per = rows.groupBy("semantic_key").agg((F.count(F.lit(1)) - 1).alias("extra"))
    return metric(per, "duplicate_reproposal_count", F.sum("extra"))


def silent_overwrite_count(before: DataFrame, after: DataFrame, current: DataFrame) -> DataFrame:
    """Old records that changed, vanished, or were superseded without saying so."""
    a = after.select("memory_id", F.col("content_digest").alias("a_digest"))
    old = after.select(F.explode("supersedes_memory_ids").alias("memory_id")).distinct().withColumn("replaced", F.lit(True))
    state = current.select("memory_id", "current_state")
    rows = before.select("memory_id", "content_digest").join(a, "memory_id", "left").join(old, "memory_id", "left").join(state, "memory_id", "left")
    bad = ~F.col("a_digest").eqNullSafe(F.col("content_digest")) | (F.col("replaced").isNotNull() & ~F.col("current_state").eqNullSafe("superseded"))
    return metric(rows, "silent_overwrite_count", F.count_if(bad))


def silent_conflict_selection_count(found: DataFrame) -> DataFrame:
    return metric(found, "silent_conflict_selection_count", F.count_if("any_selected"))


def policy_violation_count(tables: Sequence[DataFrame]) -> DataFrame:
    rows = tables[0].select("egress_policy")
    for t in tables[1:]:
        rows = rows.unionByName(t.select("egress_policy"))
    return metric(rows, "policy_violation_count", F.count_if(F.col("egress_policy") != "local_only"))


def deletion_component_coverage(planned: DataFrame, results: DataFrame) -> DataFrame:
    key = ["delete_request_id", "component_key"]
    done = results.select(*key).distinct().withColumn("done", F.lit(True))
    rows = planned.select(*key).join(done, key, "left")
    return metric(rows, "deletion_component_coverage", F.count_if(F.col("done").isNotNull()), F.count(F.lit(1)))


def false_complete_deletion_count(evidence: DataFrame, results: DataFrame) -> DataFrame:
    bad = results.filter("status <> 'succeeded'").select("delete_request_id").distinct()
    rows = evidence.filter("overall_status = 'completed'").join(bad, "delete_request_id", "left_semi")
    return metric(rows, "false_complete_deletion_count", F.count(F.lit(1)))


def source_set_drift(baseline: DataFrame, candidate: DataFrame, expected: DataFrame) -> DataFrame:
    """Queries whose expected sources among the hits changed between two runs."""
    key = ["query_id", "expected_id"]
    want = expected.select(*key).distinct()
    a = baseline.select(*key).distinct().join(want, key, "left_semi").withColumn("a", F.lit(1))
    b = candidate.select(*key).distinct().join(want, key, "left_semi").withColumn("b", F.lit(1))
    return a.join(b, key, "full_outer").filter("a is null or b is null").select("query_id").distinct()


def loop_completion(steps: DataFrame) -> DataFrame:
    """1/1 when every step passed."""
    return metric(steps, "model_free_loop_completion_rate", F.bool_and("passed").cast("int"), F.lit(1))
