"""Context packs: items, citations, budget, digests and their rules.

Citations stay in rows, one per item and fragment; a pack row carries counts and digests.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.digest import exact_digest, nfc_digest
from memlake.functions.skew import small_side
from memlake.operators.rules import violations

ITEM_TYPES = ["source_fragment", "memory_record", "conflict_notice", "constraint"]
ROLES = ["current", "historical", "conflict", "not_applicable"]


def context_items(hits: DataFrame, rows: DataFrame, role: str = "current") -> DataFrame:
    """One item per hit in rank order, with its rendered text and size."""
    if role not in ROLES:
        raise ValueError(f"unknown temporal role {role}")
    content = rows.select("object_kind", "object_id", "content")
    return hits.join(content, ["object_kind", "object_id"]).select(
        "query_id", (F.col("rank") - 1).cast("long").alias("ordinal"),
        F.col("object_kind").alias("item_type"), "object_id", "content",
        nfc_digest(F.col("content")).alias("content_digest"),
        F.octet_length("content").cast("long").alias("rendered_bytes"),
        F.lit(role).alias("temporal_role"),
    )


def _only(fragments: DataFrame, wanted: DataFrame) -> DataFrame:
    """The fragments that ``wanted`` names; the ids go to the fragments, if they are not too many."""
    return fragments.join(small_side(wanted.select("fragment_id").distinct()), "fragment_id", "left_semi")


def citations(items: DataFrame, records: DataFrame, fragments: DataFrame) -> DataFrame:
    """One citation per item and evidence fragment: a fragment cites itself, a memory its sources."""
    own = items.filter("item_type = 'source_fragment'").select("query_id", "ordinal", F.lit(0).alias("evidence_no"), F.col("object_id").alias("fragment_id"))
    refs = records.select(F.col("memory_id").alias("object_id"), F.posexplode("source_fragment_refs").alias("evidence_no", "fragment_id"))
    of_memory = items.filter("item_type = 'memory_record'").select("query_id", "ordinal", "object_id").join(refs, "object_id").select(
        "query_id", "ordinal", "evidence_no", "fragment_id"
    )
    wanted = own.unionByName(of_memory)
    cited = _only(fragments, wanted).select("fragment_id", "source_id", "byte_start", "byte_end", F.col("content_digest").alias("fragment_digest"))
    return wanted.join(cited, "fragment_id").select(
        "query_id", "ordinal", "evidence_no",
        F.concat(F.lit("cit-"), "query_id", F.lit("-"), F.col("ordinal").cast("string"), F.lit("-"), F.col("evidence_no").cast("string")).alias("citation_id"),
        "source_id", "fragment_id", "byte_start", "byte_end", "fragment_digest",
    )


def _id_list(column: str, *order: str):
    sorted_ids = F.transform(F.sort_array(F.collect_list(F.struct(*order, column))), lambda x: x[column])
    return F.array_join(F.transform(sorted_ids, lambda i: F.concat(F.lit('"'), i, F.lit('"'))), ",")


def compile_packs(items: DataFrame, cited: DataFrame, limits: Sequence[int]) -> DataFrame:
    """A pack per query and byte limit. Going over the limit is an error, not a cut.

    A pack holds at most the top-k items of its query.
    """
    item_id = F.concat(F.lit("item-"), "query_id", F.lit("-"), F.col("ordinal").cast("string"))
    per_item = items.withColumn("item_id", item_id).groupBy("query_id").agg(
        F.sum("rendered_bytes").alias("used"), F.count(F.lit(1)).alias("n_items"), _id_list("item_id", "ordinal").alias("_items"),
    )
    per_citation = cited.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_citations"), _id_list("citation_id", "ordinal", "evidence_no").alias("_citations")
    )
    rows = per_item.join(per_citation, "query_id", "left").select(
        "*", F.explode(F.array(*[F.lit(x).cast("long") for x in limits])).alias("budget_limit")
    )
    pack_id = F.concat(F.lit("ctx-"), "query_id")
    text = F.concat(
        F.lit('{"citations":['), F.coalesce("_citations", F.lit("")), F.lit('],"context_pack_id":"'), pack_id,
        F.lit('","items":['), "_items", F.lit("]}"),
    )
    return rows.select(
        pack_id.alias("context_pack_id"), "query_id", "budget_limit", F.col("used").alias("budget_used"),
        "n_items", F.coalesce("n_citations", F.lit(0)).alias("n_citations"),
        F.sha2(text, 256).alias("content_digest"),
        F.when(F.col("used") > F.col("budget_limit"), F.lit("BudgetExceeded")).alias("problem"),
    )


def fit_budget(items: DataFrame, limit: int) -> DataFrame:
    """Items of the longest prefix within the limit, and how many were left out.

    The running sum covers the top-k items of one query.
    """
    w = Window.partitionBy("query_id").orderBy("ordinal")
    running = items.withColumn("running_bytes", F.sum("rendered_bytes").over(w))
    kept = F.col("running_bytes") <= limit
    return running.groupBy("query_id").agg(
        F.count_if(kept).alias("allowed"), F.count_if(~kept).alias("truncated"),
        F.coalesce(F.max(F.when(kept, F.col("running_bytes"))), F.lit(0)).alias("budget_used"),
    )


# --- rules -----------------------------------------------------------------------------


def item_rows(items: DataFrame, cited: DataFrame) -> DataFrame:
    """Items with an unknown type, wrong digest or size, or without a citation."""
    n = cited.groupBy("query_id", "ordinal").agg(F.count(F.lit(1)).alias("n"))
    rows = items.join(n, ["query_id", "ordinal"], "left")
    key = F.concat(F.col("query_id"), F.lit("/"), F.col("ordinal").cast("string"))
    return violations(rows, "V20", "ContextItem", key, [
        ("InvalidFieldCombination", ~F.col("item_type").isin(*ITEM_TYPES) | ~F.col("temporal_role").isin(*ROLES)),
        ("DigestMismatch", nfc_digest(F.col("content")) != F.col("content_digest")),
        ("CountMismatch", F.octet_length("content") != F.col("rendered_bytes")),
        ("EmptyRequiredCollection", (F.col("item_type") != "constraint") & F.col("n").isNull()),
    ])


def pack_rows(items: DataFrame, cited: DataFrame, tasks: DataFrame) -> DataFrame:
    """Packs with a wrong task digest, broken ordinals, repeated ids or loose citations."""
    per = items.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("ordinal").alias("d"), F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi")
    )
    ids = cited.groupBy("query_id").agg((F.countDistinct("citation_id") != F.count(F.lit(1))).alias("repeated"))
    loose = cited.join(items.select("query_id", "ordinal"), ["query_id", "ordinal"], "left_anti").select("query_id").distinct().withColumn("loose", F.lit(True))
    rows = tasks.select("query_id", "query", "task_digest").join(per, "query_id", "left").join(ids, "query_id", "left").join(loose, "query_id", "left")
    return violations(rows, "V21", "ContextPack", "query_id", [
        ("DigestMismatch", nfc_digest(F.col("query")) != F.col("task_digest")),
        ("DuplicateOrdinal", (F.col("d") != F.col("n")) | (F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1)),
        ("DuplicateCollectionMember", F.col("repeated")),
        ("CitationMismatch", F.col("loose")),
    ])


def pack_resolution(items: DataFrame, cited: DataFrame, records: DataFrame, fragments: DataFrame, sources: DataFrame) -> DataFrame:
    """Items and citations that do not resolve to active content exactly as cited."""
    f = _only(fragments, cited).select(
        "fragment_id", F.col("source_id").alias("f_source"), F.col("byte_start").alias("f_start"), F.col("byte_end").alias("f_end"),
        exact_digest(F.col("content")).alias("f_digest"), F.col("deletion_state").alias("f_state"),
    )
    s = sources.select(F.col("source_id").alias("f_source"), F.col("deletion_state").alias("s_state"))
    rows = cited.join(f, "fragment_id", "left").join(s, "f_source", "left")
    of_citations = violations(rows, "V22", "Citation", "citation_id", [
        ("MissingReference", F.col("s_state").isNull()),
        ("RecallBlocked", (F.col("f_state") != "active") | (F.col("s_state") != "active")),
        ("CitationMismatch", (F.col("source_id") != F.col("f_source")) | (F.col("byte_start") != F.col("f_start"))
            | (F.col("byte_end") != F.col("f_end")) | (F.col("fragment_digest") != F.col("f_digest"))),
    ])
    r = records.select(F.col("memory_id").alias("object_id"), "current_state", F.col("deletion_state").alias("r_state"))
    memory = items.filter("item_type = 'memory_record'").join(r, "object_id", "left")
    key = F.concat(F.col("query_id"), F.lit("/"), F.col("ordinal").cast("string"))
    of_items = violations(memory, "V22", "ContextItem", key, [
        ("MissingReference", F.col("current_state").isNull()),
        ("RecallBlocked", (F.col("current_state") != "confirmed") | (F.col("r_state") != "active")),
    ])
    return of_citations.unionByName(of_items)


def citation_closure(uses: DataFrame, cited: DataFrame) -> DataFrame:
    """Both sides of a pack's citation map: cited ids that are not mapped, and mapped ids that nothing cites.

    ``uses`` holds (query_id, ordinal, citation_id), what items cite; ``cited`` is the map.
    """
    used = uses.select("query_id", "citation_id").distinct().withColumn("used", F.lit(True))
    mapped = cited.select("query_id", "citation_id").distinct().withColumn("mapped", F.lit(True))
    rows = used.join(mapped, ["query_id", "citation_id"], "full_outer")
    return violations(rows, "X8", "Citation", F.concat_ws("/", "query_id", "citation_id"), [
        ("MissingReference", F.col("mapped").isNull()),
        ("CitationMismatch", F.col("used").isNull()),
    ])


def pack_closure(packs: DataFrame, items: DataFrame, uses: DataFrame, cited: DataFrame, records: DataFrame, fragments: DataFrame, sources: DataFrame) -> DataFrame:
    """Everything in a pack that does not resolve, one row per object and reason.

    ``packs`` holds (query_id, namespace_id, deletion_state). Besides the two sides of the
    citation map: blocked packs; items whose object is missing, in another namespace or not
    recallable; citations an item may not use, as they are no evidence of its object; and
    citations whose fragment or source is in another namespace.
    """
    key = F.concat(F.col("query_id"), F.lit("/"), F.col("ordinal").cast("string"))
    home = packs.select("query_id", F.col("namespace_id").alias("p_ns"))
    state = sources.select("source_id", F.col("deletion_state").alias("s_state"))
    named = items.filter("item_type = 'source_fragment'").select(F.col("object_id").alias("fragment_id"))
    of_fragments = _only(fragments, named).select("fragment_id", "source_id", "namespace_id", "deletion_state").join(state, "source_id", "left").select(
        F.lit("source_fragment").alias("item_type"), F.col("fragment_id").alias("object_id"), F.col("namespace_id").alias("o_ns"),
        (F.col("deletion_state").eqNullSafe("active") & F.col("s_state").eqNullSafe("active")).alias("open"),
    )
    of_records = records.select(
        F.lit("memory_record").alias("item_type"), F.col("memory_id").alias("object_id"), F.col("namespace_id").alias("o_ns"),
        (F.col("deletion_state").eqNullSafe("active") & F.col("current_state").eqNullSafe("confirmed")).alias("open"),
    )
    objects = of_fragments.unionByName(of_records)
    placed = items.filter(F.col("item_type").isin("source_fragment", "memory_record")).join(objects, ["item_type", "object_id"], "left").join(home, "query_id", "left")
    of_items = violations(placed, "V22", "ContextItem", key, [
        ("MissingReference", F.col("o_ns").isNull()),
        ("NamespaceMismatch", F.col("o_ns") != F.col("p_ns")),
        ("RecallBlocked", ~F.col("open")),
    ])
    evidence = records.select(F.col("memory_id").alias("object_id"), F.explode(F.array_distinct("source_fragment_refs")).alias("fragment_id"), F.lit(True).alias("evident"))
    used = uses.select("query_id", "ordinal", "citation_id").join(cited.select("query_id", "citation_id", "fragment_id").distinct(), ["query_id", "citation_id"])
    used = used.join(items.select("query_id", "ordinal", "item_type", "object_id"), ["query_id", "ordinal"]).join(evidence, ["object_id", "fragment_id"], "left")
    own = (F.col("item_type") != "memory_record") & (F.col("object_id") == F.col("fragment_id"))
    accepted = own | ((F.col("item_type") != "source_fragment") & F.col("evident").isNotNull())
    of_uses = violations(used, "V22", "ContextItem", key, [("CitationMismatch", ~F.coalesce(accepted, F.lit(False)))])
    place = _only(fragments, cited).select("fragment_id", F.col("namespace_id").alias("f_ns"))
    there = sources.select("source_id", F.col("namespace_id").alias("s_ns"))
    foreign = cited.join(place, "fragment_id", "left").join(there, "source_id", "left").join(home, "query_id", "left")
    of_citations = violations(foreign, "V22", "Citation", "citation_id", [
        ("MissingReference", F.col("f_ns").isNull() | F.col("s_ns").isNull()),
        ("NamespaceMismatch", (F.col("f_ns") != F.col("p_ns")) | (F.col("s_ns") != F.col("p_ns"))),
    ])
    of_packs = violations(packs, "V22", "ContextPack", "query_id", [("RecallBlocked", F.col("deletion_state") != "active")])
    return of_packs.unionByName(citation_closure(uses, cited)).unionByName(of_items).unionByName(of_uses).unionByName(of_citations)
