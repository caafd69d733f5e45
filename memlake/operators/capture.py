"""Capture decisions, replay checks and incremental upkeep of recall rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.digest import row_fingerprint, set_digest
from memlake.operators.rules import violations

LINEAGE = ["namespace_id", "lineage_id"]
GOV = ["sensitivity", "egress_policy", "retention_mode", "retention_expires_at", "retention_policy_id", "policy_basis"]


def current_facts(sources: DataFrame, tips: DataFrame) -> DataFrame:
    """What a new capture is compared with: the facts of each lineage's tip."""
    facts = ["version", "content_length", "content_digest", "source_kind", "media_type", *GOV]
    return tips.select(*LINEAGE, "source_id").join(sources.select("source_id", *facts), "source_id").select(
        *LINEAGE, F.col("source_id").alias("c_source_id"), *[F.col(f).alias(f"c_{f}") for f in facts]
    )


def decide_captures(incoming: DataFrame, bindings: DataFrame, current: DataFrame, sources: DataFrame) -> DataFrame:
    """created, idempotent or versioned per incoming capture, or the reason it is refused.

    An unknown binding starts a lineage. A known one must name its own lineage and keep
    governance; equal bytes change nothing, other bytes make a version. Captures of one
    binding are taken in the order of source_id, each against what the one before left.
    """
    known = bindings.select("namespace_id", "origin_binding_id", F.col("lineage_id").alias("b_lineage"))
    used = sources.select(*LINEAGE).distinct().withColumn("lineage_used", F.lit(True))
    rows = (
        incoming.join(known, ["namespace_id", "origin_binding_id"], "left")
        .join(current, LINEAGE, "left")
        .join(used, LINEAGE, "left")
    )
    same_gov = F.lit(True)
    for g in GOV:
        same_gov = same_gov & F.col(g).eqNullSafe(F.col(f"c_{g}"))
    bound = F.col("b_lineage").isNotNull()
    reason = (
        F.when(~bound & F.col("lineage_used"), "OriginBindingMismatch")
        .when(bound & (F.col("b_lineage") != F.col("lineage_id")), "OriginBindingMismatch")
        .when(bound & F.col("c_source_id").isNull(), "CaptureStateMismatch")
        .when(bound & ~same_gov, "CaptureStateMismatch")
    )
    # the captures of a binding that are not refused, in order: each meets the bytes left before it
    rows = rows.withColumn("reason", reason).withColumn("alone", F.when(reason.isNotNull(), F.col("source_id")))
    turn = Window.partitionBy("namespace_id", "origin_binding_id", "alone").orderBy("source_id")
    started = F.struct(*LINEAGE, *[F.col(g) for g in GOV])
    facts = F.struct("content_length", "content_digest", "source_kind", "media_type")
    earlier = F.struct(F.col("c_content_length").alias("content_length"), F.col("c_content_digest").alias("content_digest"), F.col("c_source_kind").alias("source_kind"), F.col("c_media_type").alias("media_type"))
    rows = rows.withColumns({
        "nth": F.row_number().over(turn),
        "before": F.coalesce(F.lag(facts).over(turn), F.when(bound, earlier)),
        "start": F.first(started).over(turn),
    })
    repeat = F.coalesce((F.col("content_length") == F.col("before.content_length")) & (F.col("content_digest") == F.col("before.content_digest")), F.lit(False))
    other = repeat & ((F.col("source_kind") != F.col("before.source_kind")) | (F.col("media_type") != F.col("before.media_type")))
    moved = ~bound & (F.col("nth") > 1) & ~F.col("start").eqNullSafe(started)
    reason = F.coalesce(F.col("reason"), F.when(moved | other, "CaptureStateMismatch"))
    change = (reason.isNull() & ~repeat).cast("long")
    rows = rows.withColumns({"final": reason, "change": change})
    so_far = F.sum("change").over(turn)
    kept = F.last(F.when(F.col("change") == 1, F.col("source_id")), ignorenulls=True).over(turn)
    outcome = F.when(F.col("final").isNotNull(), "rejected").when(repeat, "idempotent").when(~bound & (F.col("nth") == 1), "created").otherwise("versioned")
    return rows.select(
        "source_id", *LINEAGE, outcome.alias("outcome"), F.col("final").alias("reason"),
        F.when(outcome == "idempotent", F.coalesce(kept, "c_source_id")).when(outcome != "rejected", F.col("source_id")).alias("result_source_id"),
        F.when(outcome.isin("created", "versioned"), F.coalesce("c_version", F.lit(0)) + so_far).cast("long").alias("next_version"),
    )


def candidate_problems(incoming: DataFrame, tips: DataFrame, sources: DataFrame, fragments: DataFrame, new_fragments: DataFrame) -> DataFrame:
    """Candidates whose version or superseded id does not follow the tip, or whose ids exist."""
    tip = tips.select(*LINEAGE, F.col("source_id").alias("t_id"), F.col("version").alias("t_version"))
    ids = sources.select("source_id").distinct().withColumn("id_used", F.lit(True))
    reused = new_fragments.join(fragments.select("fragment_id"), "fragment_id", "left_semi").select("source_id").distinct().withColumn("f_used", F.lit(True))
    rows = incoming.join(tip, LINEAGE, "left").join(ids, "source_id", "left").join(reused, "source_id", "left")
    old = F.col("supersedes_source_ids")
    first = F.col("t_id").isNull() & (F.col("version") == 1) & (F.size(old) == 0)
    follows = (F.col("version") == F.col("t_version") + 1) & (F.size(old) == 1) & (F.get(old, F.lit(0)) == F.col("t_id"))
    return violations(rows, "V38", "SourceArtifact", "source_id", [
        ("SupersessionMismatch", ~(first | F.coalesce(follows, F.lit(False)))),
        ("DuplicateObject", F.col("id_used") | F.coalesce("f_used", F.lit(False))),
        ("DuplicateObject", F.col("f_used")),
    ])


REQUEST_FIELDS = [
    "source_id", "lineage_id", "namespace_id", "version", "source_kind", "media_type", "content_length", "content_digest",
    "title", "origin_kind", "origin_ref", "observed_at", "captured_at", "created_at", "supersedes_source_ids", *GOV,
]


def request_digests(sources: DataFrame, fragments: DataFrame) -> DataFrame:
    """Digest of each capture request: its source facts and its set of fragment ranges.

    The fragments enter by the sums of :func:`set_digest`, so none are gathered.
    """
    one = row_fingerprint("ordinal", "fragment_id", "byte_start", "byte_end", "content_digest")
    per = set_digest(fragments, ["source_id"], one, name="fragments_digest").drop("n_members")
    return sources.join(per, "source_id", "left").select(
        "source_id", "namespace_id", "origin_ref", "content_digest", "content_length", "media_type",
        row_fingerprint(*REQUEST_FIELDS, "fragments_digest").alias("request_digest"),
    )


def replay(incoming: DataFrame, attempts: DataFrame) -> DataFrame:
    """Whether each request is new, an exact replay, or a conflict with an earlier attempt."""
    a = attempts.select("source_id", F.col("request_digest").alias("a_digest"), "state", F.col("origin_binding_id").alias("a_binding"))
    rows = incoming.join(a, "source_id", "left")
    outcome = (
        F.when(F.col("a_digest").isNull(), "new")
        .when(F.col("state").isin("abandoning", "abandoned"), "rejected")
        .when(~F.col("a_binding").eqNullSafe(F.col("origin_ref")) | (F.col("a_digest") != F.col("request_digest")), "rejected")
        .when(F.col("state") == "committed", "idempotent")
        .otherwise("resume")
    )
    return rows.select("source_id", outcome.alias("outcome"))


def upkeep_recall(
    rows: DataFrame, old_fragments: DataFrame, new_rows: DataFrame, touched_sources: DataFrame, ended_memories: DataFrame
) -> DataFrame:
    """Recall rows after some lineages moved to a new tip and some memories ended.

    Only ids of old fragments are read; untouched rows pass through one anti join.
    """
    gone = old_fragments.join(touched_sources, "source_id", "left_semi").select(
        F.lit("source_fragment").alias("object_kind"), F.col("fragment_id").alias("object_id")
    ).unionByName(ended_memories.select(F.lit("memory_record").alias("object_kind"), F.col("memory_id").alias("object_id")))
    return rows.join(gone, ["object_kind", "object_id"], "left_anti").unionByName(new_rows)
