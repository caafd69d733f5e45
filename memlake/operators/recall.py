"""Governed full-text recall: recall rows, eligibility, phrase match, BM25, top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions.governance import eligible, reject_reason
from memlake.functions.ranking import top_k_per_key
from memlake.functions.skew import salted_join, small_side
from memlake.functions.text import TOKENIZERS, phrase_frequency, phrases, tokenize_query
from memlake.session import cut_lineage

# fixed values of the ranking function
K1 = 1.2
B = 0.75
MIN_IDF = 1e-6
SCORE_DIGITS = 6

ROW = [
    "object_kind", "object_id", "namespace_id", "sensitivity", "content", "available_at",
    "retention_mode", "retention_expires_at", "valid_mode", "valid_start", "valid_end",
]
KEY = ["object_kind", "object_id"]


def recallable_fragments(fragments: DataFrame, sources: DataFrame, tips: DataFrame) -> DataFrame:
    """Active fragments of active sources that are the tip of their lineage."""
    at_tip = (
        sources.filter("deletion_state = 'active'")
        .join(tips, ["namespace_id", "lineage_id", "source_id", "version"])
        .select("source_id", "captured_at", "lineage_id", "version", "title")
    )
    return fragments.filter("deletion_state = 'active'").join(at_tip, "source_id")


def recall_rows(tip_fragments: DataFrame, records: DataFrame) -> DataFrame:
    """Everything recall may return: fragments at the tip and confirmed active records.

    Proposals are not an input, so they cannot surface.
    """
    none = F.lit(None)
    from_fragments = tip_fragments.select(
        F.lit("source_fragment").alias("object_kind"),
        F.col("fragment_id").alias("object_id"),
        "namespace_id", "sensitivity", "content",
        F.col("captured_at").alias("available_at"),
        "retention_mode", "retention_expires_at",
        none.cast("string").alias("valid_mode"),
        none.cast(dict(records.dtypes)["valid_start"]).alias("valid_start"),
        none.cast(dict(records.dtypes)["valid_end"]).alias("valid_end"),
    )
    confirmed = records.filter("deletion_state = 'active' and current_state = 'confirmed'")
    from_records = confirmed.select(
        F.lit("memory_record").alias("object_kind"),
        F.col("memory_id").alias("object_id"),
        "namespace_id", "sensitivity", "content",
        F.col("created_at").alias("available_at"),
        "retention_mode", "retention_expires_at", "valid_mode", "valid_start", "valid_end",
    )
    return from_fragments.unionByName(from_records)


def recall_ids(tip_fragments: DataFrame, records: DataFrame) -> DataFrame:
    """Kind, id and namespace of the rows of ``recall_rows``, for steps that read nothing else of them."""
    from_fragments = tip_fragments.select(F.lit("source_fragment").alias("object_kind"), F.col("fragment_id").alias("object_id"), "namespace_id")
    confirmed = records.filter("deletion_state = 'active' and current_state = 'confirmed'")
    return from_fragments.unionByName(confirmed.select(F.lit("memory_record").alias("object_kind"), F.col("memory_id").alias("object_id"), "namespace_id"))


def filter_summary(rows: DataFrame, as_of: Column, allowed: Sequence[str]) -> DataFrame:
    """Allowed and rejected counts per reason before ranking."""
    reason = F.coalesce(reject_reason(as_of, allowed), F.lit("eligible"))
    return (
        rows.select("namespace_id", "object_kind", reason.alias("reason"))
        .groupBy("namespace_id", "object_kind", "reason")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "namespace_id", "object_kind", "reason",
            F.when(F.col("reason") == "eligible", F.col("n")).otherwise(0).alias("allowed"),
            F.when(F.col("reason") == "eligible", 0).otherwise(F.col("n")).alias("rejected"),
            F.lit(0).cast("long").alias("truncated"),
        )
    )


def idf(n_rows: Column, n_hits: Column) -> Column:
    raw = F.log((n_rows - n_hits + 0.5) / (n_hits + 0.5))
    return F.when(raw <= 0, F.lit(MIN_IDF)).otherwise(raw)


def term_weight(tf: Column, length: Column, avg_length: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg_length))


def recall(
    rows: DataFrame,
    query: str,
    as_of: Column,
    top_k: int,
    namespace_id: str,
    allowed: Sequence[str],
    tokenizer: str = "unicode",
    stats: str = "all",
) -> DataFrame:
    """Top-k of one query: two scans of the recall rows and no shuffle of them.

    Statistics cover all rows (``stats='eligible'``: only those the caller may see) and
    come back as one row, used as a scalar subquery. Rows are filtered for eligibility
    before they are ranked.
    """
    if top_k < 1:
        raise ValueError("top_k must be at least 1")
    if not query.split():
        raise ValueError("the query has no term")
    wanted = tokenize_query(query, tokenizer)
    allowed_now = eligible(as_of, allowed, F.lit(namespace_id))
    scanned = rows.withColumn("_toks", TOKENIZERS[tokenizer](F.col("content")))
    tfs = [phrase_frequency(F.col("_toks"), p) for p in wanted]
    counted = scanned.filter(allowed_now) if stats == "eligible" else scanned
    facts = counted.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.size("_toks")).alias("avg_length"),
        *[F.count_if(tf > 0).alias(f"d{i}") for i, tf in enumerate(tfs)],
    ).select(F.struct("*"))
    hits = scanned.filter(allowed_now)
    match = F.lit(bool(wanted))
    for tf in tfs:
        match = match & (tf > 0)
    hits = hits.filter(match).withColumn("_s", facts.scalar())
    score = F.lit(0.0)
    for i, tf in enumerate(tfs):
        weight = term_weight(tf.cast("double"), F.size("_toks"), F.col("_s.avg_length"))
        score = score + idf(F.col("_s.n"), F.col(f"_s.d{i}")) * weight
    return (
        hits.select(*ROW, F.round(score, SCORE_DIGITS).alias("score"))
        .orderBy(F.desc("score"), "object_kind", "object_id")
        .limit(top_k)
    )


def occurrences(rows: DataFrame, tokenizer: str = "unicode", carry: Sequence[str] = ()) -> DataFrame:
    """(object_kind, object_id, carry.., length, pos, term): one row per token."""
    toks = rows.select(*KEY, *carry, TOKENIZERS[tokenizer](F.col("content")).alias("_t"))
    return toks.select(
        *KEY, *carry, F.size("_t").alias("length"), F.posexplode("_t").alias("pos", "term")
    )


def query_phrases(queries: DataFrame) -> DataFrame:
    """(query_id, namespace_id, phrase, n_terms): one row per phrase of each query."""
    exploded = queries.select("query_id", "namespace_id", F.explode(phrases(F.col("query"))).alias("_p"))
    return exploded.select(
        "query_id", "namespace_id",
        F.array_join("_p", " ").alias("phrase"),
        F.size("_p").alias("n_terms"),
    )


def phrase_postings(occ: DataFrame, wanted: DataFrame) -> DataFrame:
    """(object, .., length, phrase, tf) of every wanted phrase in every recall row.

    Only tokens some phrase uses are kept; they are written once, because every later
    step reads them. One-token phrases are counted directly. A longer phrase is anchored
    at its rarest token, and only those places are checked for its other tokens.
    """
    row = [c for c in occ.columns if c not in ("pos", "term")]
    distinct = wanted.select("phrase", "n_terms").distinct()
    parts = distinct.select("phrase", "n_terms", F.posexplode(F.split("phrase", " ")).alias("off", "term"))
    vocabulary = parts.groupBy("term").agg(
        F.bool_or(F.col("n_terms") == 1).alias("alone"), F.bool_or(F.col("n_terms") > 1).alias("within")
    )
    seen = cut_lineage(salted_join(occ, vocabulary, ["term"], KEY))
    single = (
        seen.filter("alone")
        .groupBy(*row, F.col("term").alias("phrase"))
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    places = seen.filter("within").select(*row, "pos", "term")
    frequency = places.groupBy("term").agg(F.count(F.lit(1)).alias("cf"))
    anchors = (
        parts.filter("n_terms > 1")
        .join(frequency, "term")
        .groupBy("phrase", "n_terms")
        .agg(
            F.min(F.struct("cf", "off", "term")).alias("a"),
            F.collect_list(F.struct("off", "term")).alias("parts"),
        )
        .filter(F.size("parts") == F.col("n_terms"))
        .select("phrase", "parts", F.col("a.off").alias("a_off"), F.col("a.term").alias("term"))
    )
    starts = salted_join(places, anchors, ["term"], KEY).select(
        *row, "phrase", (F.col("pos") - F.col("a_off")).alias("start"),
        F.filter("parts", lambda p: p["off"] != F.col("a_off")).alias("rest"),
    )
    probes = (
        starts.filter("start >= 0")
        .select(*row, "phrase", "start", F.size("rest").alias("n_rest"), F.explode("rest").alias("r"))
        .select(
            *row, "phrase", "start", "n_rest",
            (F.col("start") + F.col("r.off")).alias("pos"), F.col("r.term").alias("term"),
        )
    )
    found = (
        probes.join(places.select(*KEY, "pos", "term"), [*KEY, "pos", "term"])
        .groupBy(*row, "phrase", "start", "n_rest")
        .agg(F.count(F.lit(1)).alias("m"))
        .filter("m = n_rest")
    )
    multi = found.groupBy(*row, "phrase").agg(F.count(F.lit(1)).alias("tf"))
    return single.unionByName(multi)


def recall_batch(
    rows: DataFrame,
    queries: DataFrame,
    as_of: Column,
    top_k: int,
    allowed: Sequence[str],
    tokenizer: str = "unicode",
) -> DataFrame:
    """Top-k of many queries (query_id, namespace_id, query) over shared postings.

    A query's candidates are the rows of its rarest phrase; its other phrases are then
    looked up per candidate. Rows are filtered for eligibility before the ranking.
    """
    if top_k < 1:
        raise ValueError("top_k must be at least 1")
    flagged = rows.withColumn("may", eligible(as_of, allowed))
    wanted = cut_lineage(query_phrases(queries))
    postings = cut_lineage(phrase_postings(occurrences(flagged, tokenizer, ["namespace_id", "may"]), wanted))
    document_frequency = postings.groupBy("phrase").agg(F.count(F.lit(1)).alias("df"))
    totals = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.size(TOKENIZERS[tokenizer](F.col("content")))).alias("avg_length"),
    ).select(F.struct("*"))
    # a repeated term counts once per occurrence in the query, as in the single query
    terms = wanted.groupBy("query_id", "namespace_id", "phrase").agg(F.count(F.lit(1)).alias("times"))
    weighed = terms.join(document_frequency, "phrase", "left").na.fill(0, ["df"])
    plan = (
        weighed.groupBy("query_id", "namespace_id")
        .agg(
            F.min(F.struct("df", "phrase")).alias("rarest"),
            F.collect_list(F.struct("phrase", "df", "times")).alias("terms"),
        )
        .filter("rarest.df > 0")
        .select("query_id", "namespace_id", F.col("rarest.phrase").alias("phrase"), "terms")
    )
    usable = postings.filter("may").drop("may")
    candidates = salted_join(usable, plan, ["namespace_id", "phrase"], KEY)
    looked_up = (
        candidates.select("query_id", *KEY, F.size("terms").alias("n_terms"), F.explode("terms").alias("t"))
        .select("query_id", *KEY, "n_terms", "t.phrase", "t.df", "t.times")
        .join(usable.drop("namespace_id"), [*KEY, "phrase"])
    )
    matched = looked_up.withColumn("_s", totals.scalar())
    part = F.col("times") * idf(F.col("_s.n"), F.col("df")) * term_weight(
        F.col("tf").cast("double"), F.col("length"), F.col("_s.avg_length")
    )
    scored = (
        matched.groupBy("query_id", *KEY, "n_terms")
        .agg(F.count(F.lit(1)).alias("m"), F.round(F.sum(part), SCORE_DIGITS).alias("score"))
        .filter("m = n_terms")
        .select("query_id", *KEY, "score")
    )
    return top_k_per_key(scored, ["query_id"], [F.desc("score"), F.asc("object_kind"), F.asc("object_id")], top_k)


def source_search(hits: DataFrame, fragments: DataFrame, sources: DataFrame) -> DataFrame:
    """Citation-ready rows of the fragment hits.

    Memory hits are dropped after the cut to top-k, so a caller may see fewer than k.
    """
    only = hits.filter("object_kind = 'source_fragment'").withColumnRenamed("object_id", "fragment_id")
    # the ids of the hits go to the bodies, if they are not too many; other fragments stay where they are
    cited = fragments.join(small_side(only.select("fragment_id").distinct()), "fragment_id", "left_semi").select("fragment_id", "source_id", "byte_start", "byte_end", "content")
    about = sources.select("source_id", "lineage_id", "version", "title")
    extra = [c for c in ("query_id", "rank") if c in hits.columns]
    # hits are at most k per query: the planner broadcasts or shuffles them by size
    return cited.join(only.select("fragment_id", *extra), "fragment_id").join(about, "source_id").select(
        *extra, "source_id", "lineage_id", "version", "fragment_id", "byte_start", "byte_end", "title", "content"
    )
