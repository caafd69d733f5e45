"""Queries over recall: rows, eligibility, batch and single search."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from memlake.functions.governance import eligible
from memlake.functions.skew import small_side
from memlake.functions.text import match_expression, tokens
from memlake.operators import postings, recall, versions
from memlake.plans.base_sql import AS_OF, ELIGIBLE, tokens_sql, with_ctes
from memlake.plans.registry import query
from memlake.session import release, work_folder, written
from memlake.sources import bind
from memlake.sources.segment import segment_lines

PERSONAL = ["personal"]


def tip_sources(spark, path):
    """Sources at the tips; the ids are sent to the bodies, if there are not too many."""
    s = bind.sources(spark, path)
    return s.join(small_side(versions.tips(s).select("source_id")), "source_id", "left_semi")


def tip_fragments(spark, path):
    """Fragments at the tips; bodies that are no tip are dropped before segmentation."""
    frags = segment_lines(versions.active(tip_sources(spark, path)))
    # created_at of a fragment is the capture time of its source in this binding
    return frags.withColumn("captured_at", F.col("created_at"))


def rows(spark, path):
    return recall.recall_rows(tip_fragments(spark, path), bind.records(spark, path))


_INDEXES: dict[tuple[str, str], postings.Index] = {}


def recall_index(spark, path) -> postings.Index:
    """The stored postings of the recall rows, written on first use in this application."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _INDEXES:
        folder = f"{work_folder(spark)}/recall-index/{hashlib.sha256(path.encode()).hexdigest()[:16]}"
        _INDEXES[key] = postings.write(rows(spark, path), folder)
    return _INDEXES[key]


@query("j1_recallable_fragments", with_ctes(["frag", "tips"], """
SELECT f.fragment_id, f.source_id, f.lineage_id, f.version, f.byte_start, f.byte_end, f.content_digest
FROM frag f JOIN tips t ON t.source_id = f.source_id AND t.version = f.version WHERE f.deletion_state = 'active'"""))
def j1_recallable_fragments(spark, path):
    s = bind.sources(spark, path)
    return recall.recallable_fragments(bind.fragments(spark, path), s, versions.tips(s)).select(
        "fragment_id", "source_id", "lineage_id", "version", "byte_start", "byte_end", "content_digest"
    )


@query("q12_recall_rows", with_ctes(["rows_"], """
SELECT object_kind, object_id, namespace_id, sensitivity, content FROM rows_"""))
def q12_recall_rows(spark, path):
    return rows(spark, path).select("object_kind", "object_id", "namespace_id", "sensitivity", "content")


@query("f7_eligible_rows", with_ctes(["rows_"], f"SELECT object_kind, object_id, namespace_id FROM rows_ WHERE {ELIGIBLE}"))
def f7_eligible_rows(spark, path):
    return rows(spark, path).filter(eligible(bind.ntz(), PERSONAL)).select("object_kind", "object_id", "namespace_id")


@query("a9_filter_summary", with_ctes(["rows_"], f"""
SELECT namespace_id, object_kind, reason,
  CASE WHEN reason = 'eligible' THEN count(*) ELSE 0 END AS allowed,
  CASE WHEN reason = 'eligible' THEN 0 ELSE count(*) END AS rejected, CAST(0 AS BIGINT) AS truncated
FROM (SELECT namespace_id, object_kind, CASE WHEN sensitivity <> 'personal' THEN 'sensitivity'
    WHEN available_at > {AS_OF} THEN 'not_available'
    WHEN retention_mode = 'until_time' AND (retention_expires_at IS NULL OR retention_expires_at <= {AS_OF}) THEN 'retention'
    WHEN object_kind = 'memory_record' AND NOT (valid_start <= {AS_OF}) THEN 'valid_time' ELSE 'eligible' END AS reason
  FROM rows_) GROUP BY namespace_id, object_kind, reason"""))
def a9_filter_summary(spark, path):
    return recall.filter_summary(rows(spark, path), bind.ntz(), PERSONAL)


@query("q3_token_counts", with_ctes(["rows_"], """
SELECT term, count(*) AS n_occurrences, count(DISTINCT object_kind || object_id) AS n_rows
FROM (SELECT object_kind, object_id, unnest(toks) AS term FROM rows_) GROUP BY term"""))
def q3_token_counts(spark, path):
    occ = recall.occurrences(rows(spark, path))
    per_row = occ.groupBy("object_kind", "object_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    return per_row.groupBy("term").agg(F.sum("tf").alias("n_occurrences"), F.count(F.lit(1)).alias("n_rows"))


@query("a14_recall_statistics", with_ctes(["rows_"], """
SELECT count(*) AS n_rows, round(avg(len(toks)), 6) AS avg_length, CAST(sum(len(toks)) AS BIGINT) AS n_tokens FROM rows_"""))
def a14_recall_statistics(spark, path):
    return rows(spark, path).select(F.size(tokens(F.col("content"))).alias("dl")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("dl"), 6).alias("avg_length"), F.sum("dl").alias("n_tokens")
    )


@query("q2_match_expressions", with_ctes(["qs"], r"""
SELECT query_id, array_to_string(list_transform(list_filter(regexp_split_to_array(query, '[\s\p{Z}]+'), lambda t: t <> ''),
  lambda t: '"' || replace(t, '"', '""') || '"'), ' ') AS expression FROM qs"""))
def q2_match_expressions(spark, path):
    qs = bind.recall_queries(spark, path, tip_fragments(spark, path))
    return qs.select("query_id", match_expression(F.col("query")).alias("expression"))


def batch_hits(spark, path, k=10):
    qs = bind.recall_queries(spark, path, tip_fragments(spark, path))
    return postings.recall_batch(recall_index(spark, path), qs, bind.ntz(), k, PERSONAL)


@query("q1_recall", with_ctes(["hits"], """
SELECT query_id, CAST(rank AS BIGINT) AS rank, object_kind, object_id, score FROM hits"""))
def q1_recall(spark, path):
    return batch_hits(spark, path).select(
        "query_id", F.col("rank").cast("long").alias("rank"), "object_kind", "object_id", "score"
    )


_ONE = f"""
SELECT r.object_kind, r.object_id, round(
    (CASE WHEN ln((c.n - c.d1 + 0.5) / (c.d1 + 0.5)) <= 0 THEN 0.000001 ELSE ln((c.n - c.d1 + 0.5) / (c.d1 + 0.5)) END)
      * (r.t1 * 2.2 / (r.t1 + 1.2 * (0.25 + 0.75 * r.dl / c.avg_dl)))
  + (CASE WHEN ln((c.n - c.d2 + 0.5) / (c.d2 + 0.5)) <= 0 THEN 0.000001 ELSE ln((c.n - c.d2 + 0.5) / (c.d2 + 0.5)) END)
      * (r.t2 * 2.2 / (r.t2 + 1.2 * (0.25 + 0.75 * r.dl / c.avg_dl))), 6) AS score
FROM tf r CROSS JOIN (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avg_dl, count(*) FILTER (t1 > 0) AS d1,
  count(*) FILTER (t2 > 0) AS d2 FROM tf) c
WHERE t1 > 0 AND t2 > 0 AND namespace_id = 'ns-en' AND {ELIGIBLE}
ORDER BY score DESC, object_kind, object_id LIMIT 10"""
_TF = """
SELECT * EXCLUDE (toks), len(toks) AS dl, len(list_filter(toks, lambda t: t = 'the')) AS t1,
  len(list_filter(toks, lambda t: t = 'with')) AS t2 FROM rows_"""


@query("q1_single_recall", with_ctes(["rows_"], _ONE, tf=_TF))
def q1_single_recall(spark, path):
    hits = postings.recall(recall_index(spark, path), "The WITH", bind.ntz(), 10, "ns-en", PERSONAL)
    return hits.select("object_kind", "object_id", "score")


@query("q4_source_search", with_ctes(["hits", "frag"], """
SELECT h.query_id, CAST(h.rank AS BIGINT) AS rank, f.source_id, f.lineage_id, f.version, f.fragment_id, f.byte_start, f.byte_end, f.title, f.content
FROM hits h JOIN frag f ON f.fragment_id = h.object_id WHERE h.object_kind = 'source_fragment'"""))
def q4_source_search(spark, path):
    hits = written(batch_hits(spark, path))
    release(spark)
    found = recall.source_search(hits, tip_fragments(spark, path), bind.sources(spark, path))
    return found.withColumn("rank", F.col("rank").cast("long"))
