"""Deterministic faults laid over the bound tables, so every rule has rows to find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.plans.base_sql import cte
from memlake.sources import bind

_X = "sha256('x')"


def _hit(n: Column | str, mod: int, rest: int) -> Column:
    return F.pmod(n, F.lit(mod)) == rest


def _number(column: str, start: int) -> Column:
    """The number that starts at a place of an id, of any length."""
    return F.regexp_extract(column, f"^.{{{start - 1}}}([0-9]+)", 1).cast("long")


def sources(spark, path) -> DataFrame:
    s = bind.sources(spark, path)
    x = F.sha2(F.lit("x"), 256)
    return s.withColumns({
        "media_type": F.when(_hit("doc_id", 29, 3), "text/html").otherwise(F.col("media_type")),
        "content_length": F.col("content_length") + F.when(_hit("doc_id", 31, 4), 1).otherwise(0),
        "content_digest": F.when(_hit("doc_id", 37, 5), x).otherwise(F.col("content_digest")),
        "supersedes_source_ids": F.when(
            _hit("doc_id", 41, 6), F.array("source_id", "source_id")
        ).otherwise(F.col("supersedes_source_ids")),
        "origin_ref": F.when(_hit("doc_id", 43, 7), "origin binding").otherwise(F.col("origin_ref")),
    })


cte("srcf", ["src"], f"""
SELECT * EXCLUDE (media_type, content_length, content_digest, origin_ref),
  CASE WHEN doc_id % 29 = 3 THEN 'text/html' ELSE media_type END AS media_type,
  content_length + CASE WHEN doc_id % 31 = 4 THEN 1 ELSE 0 END AS content_length,
  CASE WHEN doc_id % 37 = 5 THEN {_X} ELSE content_digest END AS content_digest,
  CASE WHEN doc_id % 43 = 7 THEN 'origin binding' ELSE origin_ref END AS origin_ref,
  CASE WHEN doc_id % 41 = 6 THEN [source_id, source_id] WHEN prev_source_id IS NULL THEN CAST([] AS VARCHAR[]) ELSE [prev_source_id] END AS supersedes
FROM src""")


def fragments(spark, path) -> DataFrame:
    f = bind.fragments(spark, path)
    x = F.sha2(F.lit("x"), 256)
    shift = F.when(_hit("ordinal", 17, 9), 1).otherwise(0)
    return f.withColumns({
        "byte_start": F.col("byte_start") + shift,
        "byte_end": F.col("byte_end") + shift + F.when(_hit("ordinal", 11, 7), 1).otherwise(0),
        "content_digest": F.when(_hit("ordinal", 13, 5), x).otherwise(F.col("content_digest")),
        "sensitivity": F.when(_hit("ordinal", 5, 2), "personal").otherwise(F.col("sensitivity")),
        "source_id": F.when(_hit("ordinal", 19, 12), "src-missing").otherwise(F.col("source_id")),
    })


cte("fragf", ["frag"], f"""
SELECT * EXCLUDE (byte_start, byte_end, content_digest, sensitivity, source_id),
  byte_start + CASE WHEN ordinal % 17 = 9 THEN 1 ELSE 0 END AS byte_start,
  byte_end + CASE WHEN ordinal % 17 = 9 THEN 1 ELSE 0 END + CASE WHEN ordinal % 11 = 7 THEN 1 ELSE 0 END AS byte_end,
  CASE WHEN ordinal % 13 = 5 THEN {_X} ELSE content_digest END AS content_digest,
  CASE WHEN ordinal % 5 = 2 THEN 'personal' ELSE sensitivity END AS sensitivity,
  CASE WHEN ordinal % 19 = 12 THEN 'src-missing' ELSE source_id END AS source_id,
  source_id AS true_source_id
FROM frag""")


def records(spark, path) -> DataFrame:
    n = _number("memory_id", 5)
    old = F.col("supersedes_memory_ids")
    return bind.records(spark, path).withColumns({
        "content": F.when(_hit(n, 29, 3), F.concat("content", F.lit("!"))).otherwise(F.col("content")),
        "source_fragment_refs": F.when(_hit(n, 31, 4), F.array().cast("array<string>"))
        .when(_hit(n, 23, 2), F.array(F.lit("src-none-f00000"))).otherwise(F.col("source_fragment_refs")),
        "supersedes_memory_ids": F.when(_hit(n, 37, 5), F.concat(old, old)).otherwise(old),
        "version": F.col("version") + F.when(_hit(n, 41, 6), 1).otherwise(0),
        "current_state": F.when(_hit(n, 43, 7), "retracted").otherwise(F.col("current_state")),
        "confidence": F.col("confidence") + F.when(_hit(n, 19, 1), 1).otherwise(0),
        "valid_end": F.when(_hit(n, 17, 1), F.col("valid_start")).otherwise(F.col("valid_end")),
        "egress_policy": F.when(_hit(n, 13, 1), "sync").otherwise(F.col("egress_policy")),
    })


cte("recf", ["rec"], """
SELECT * EXCLUDE (content, fragment_ref, version, current_state, confidence, valid_end, egress_policy),
  CASE WHEN event_id % 29 = 3 THEN content || '!' ELSE content END AS content,
  CASE WHEN event_id % 31 = 4 THEN NULL WHEN event_id % 23 = 2 THEN 'src-none-f00000' ELSE fragment_ref END AS fragment_ref,
  event_id % 37 = 5 AND prev_memory_id IS NOT NULL AS dup_old,
  version + CASE WHEN event_id % 41 = 6 THEN 1 ELSE 0 END AS version,
  CASE WHEN event_id % 43 = 7 THEN 'retracted' ELSE current_state END AS current_state,
  confidence + CASE WHEN event_id % 19 = 1 THEN 1 ELSE 0 END AS confidence,
  CASE WHEN event_id % 17 = 1 THEN valid_start ELSE valid_end END AS valid_end,
  CASE WHEN event_id % 13 = 1 THEN 'sync' ELSE egress_policy END AS egress_policy
FROM rec""")


def state_events(spark, path) -> DataFrame:
    n = _number("event_id", 5)
    first = F.col("previous_event_id").isNull()
    return bind.state_events(spark, path).filter(~(_hit(n, 53, 9) & first)).withColumns({
        "from_state": F.when(_hit(n, 47, 8), F.lit(None)).otherwise(F.col("from_state")),
        "cause_id": F.when(_hit(n, 59, 10), "none").otherwise(F.col("cause_id")),
        "effective_at": F.when(_hit(n, 61, 13) & ~first, F.col("effective_at") + F.expr("interval 1 day")).otherwise(F.col("effective_at")),
    })


cte("evtf", ["evt"], """
SELECT event_id, namespace_id, memory_id, previous_event_id, event_type,
  CASE WHEN n % 47 = 8 THEN NULL ELSE from_state END AS from_state, cause_type,
  CASE WHEN n % 59 = 10 THEN 'none' ELSE cause_id END AS cause_id, related_memory_id,
  CASE WHEN n % 61 = 13 AND previous_event_id IS NOT NULL THEN effective_at + INTERVAL 1 DAY ELSE effective_at END AS effective_at, n
FROM evt WHERE NOT (n % 53 = 9 AND previous_event_id IS NULL)""")


def decisions(spark, path) -> DataFrame:
    n = _number("decision_id", 5)
    return bind.decisions(spark, path).withColumn(
        "result_memory_id", F.when(_hit(n, 61, 11), F.lit(None)).otherwise(F.col("result_memory_id"))
    )


cte("decf", ["dec"], """
SELECT * EXCLUDE (result_memory_id), CASE WHEN event_id % 61 = 11 THEN NULL ELSE result_memory_id END AS result_memory_id FROM dec""")


def proposals(spark, path) -> DataFrame:
    flip = F.when(F.col("operation") == "create", "supersede").otherwise("create")
    return bind.proposals(spark, path).withColumns({
        "operation": F.when(_hit("event_id", 67, 12), flip).otherwise(F.col("operation")),
        "source_fragment_refs": F.when(_hit("event_id", 71, 13), F.array("proposal_id")).otherwise(F.col("source_fragment_refs")),
        "sensitivity": F.when(_hit("event_id", 3, 1), "personal").otherwise(F.col("sensitivity")),
    })


cte("propf", ["prop"], """
SELECT * EXCLUDE (operation, fragment_ref, sensitivity),
  CASE WHEN event_id % 67 = 12 THEN CASE WHEN operation = 'create' THEN 'supersede' ELSE 'create' END ELSE operation END AS operation,
  CASE WHEN event_id % 71 = 13 THEN proposal_id ELSE fragment_ref END AS fragment_ref,
  CASE WHEN event_id % 3 = 1 THEN 'personal' ELSE sensitivity END AS sensitivity
FROM prop""")
