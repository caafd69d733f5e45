"""Driver tables read as the canonical tables of the engine.

Every function takes the folder of the Parquet tables and returns one DataFrame. The
tables that carry version numbers or links are written once per application to the
shared work folder, as an import job does, and read from there with the columns and
filters a query needs; the rest is derived on the fly.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.functions.digest import exact_digest
from memlake.functions.ranking import ordered_sequence
from memlake.functions.skew import small_side
from memlake.session import COMPRESSION, release, work_folder
from memlake.sources.segment import segment_lines

AS_OF = "2024-01-15 00:00:00"
RECORD_TYPES = ["click", "purchase", "signup"]


_WRITTEN: dict[tuple[str, str, str], str] = {}


def stored(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Write the table on first use in this application, then read the files."""
    @functools.wraps(build)
    def read(spark: SparkSession, path: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        key = (app, path, build.__name__)
        if key not in _WRITTEN:
            name = build.__name__.lstrip("_")  # a leading underscore hides a path
            folder = hashlib.sha256(path.encode()).hexdigest()[:16]
            where = f"{work_folder(spark)}/canonical/{app}/{folder}/{name}"
            build(spark, path).write.mode("overwrite").option("compression", COMPRESSION).parquet(where)
            _WRITTEN[key] = where
            release(spark)
        return spark.read.parquet(_WRITTEN[key])

    return read


def forget(spark: SparkSession, path: str) -> None:
    """Make the next use of each table of ``path`` write it again."""
    app = spark.sparkContext.applicationId
    for key in [k for k in _WRITTEN if k[:2] == (app, path)]:
        del _WRITTEN[key]


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def ntz(text: str = AS_OF) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def padded(prefix: str, number: Column, width: int) -> Column:
    digits = number.cast("string")
    return F.concat(F.lit(prefix), F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0")))


def source_key(doc_id: Column) -> Column:
    return padded("src-", doc_id, 8)


@stored
def sources(spark: SparkSession, path: str) -> DataFrame:
    docs = table(spark, path, "documents")
    labels = table(spark, path, "labels")
    block = F.floor(F.col("doc_id") / 200)
    # a lineage holds at most 200 documents, whatever the size of the table
    lineage = Window.partitionBy("namespace_id", "lineage_id").orderBy("doc_id")
    # labels go to the bodies, which are shuffled once, for their versions
    rows = docs.join(small_side(labels), "doc_id", "left").withColumns(
        {
            "source_id": source_key(F.col("doc_id")),
            "namespace_id": F.concat(F.lit("ns-"), "lang"),
            "lineage_id": F.concat(F.lit("lin-"), "lang", F.lit("-"), "source", F.lit("-"), block.cast("string")),
            "captured_at": ntz("2024-01-01 00:00:00") + F.expr("interval '1' minute * doc_id"),
        }
    )
    rows = rows.withColumns(
        {"version": F.row_number().over(lineage).cast("long"), "_prev": F.lag("source_id").over(lineage)}
    )
    odd = F.pmod("doc_id", F.lit(2)) == 1
    until_time = F.pmod("doc_id", F.lit(7)) == 6
    return rows.select(
        "source_id",
        "lineage_id",
        "version",
        "namespace_id",
        F.when(odd, "markdown").otherwise("text").alias("source_kind"),
        F.when(odd, "text/markdown").otherwise("text/plain").alias("media_type"),
        F.col("text").alias("content"),
        F.octet_length("text").cast("long").alias("content_length"),
        exact_digest(F.col("text")).alias("content_digest"),
        F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"),
        F.lit("explicit_user_input").alias("origin_kind"),
        F.concat(F.lit("origin-binding-"), "lineage_id").alias("origin_ref"),
        F.col("captured_at").alias("observed_at"),
        "captured_at",
        F.col("captured_at").alias("created_at"),
        F.when(F.col("_prev").isNull(), F.array().cast("array<string>"))
        .otherwise(F.array("_prev"))
        .alias("supersedes_source_ids"),
        F.when(F.col("toxic") == 1, "restricted")
        .when(F.col("quality") == 0, "sensitive")
        .otherwise("personal")
        .alias("sensitivity"),
        F.lit("local_only").alias("egress_policy"),
        F.when(until_time, "until_time").otherwise("until_deleted").alias("retention_mode"),
        F.when(until_time, F.col("captured_at") + F.expr("interval 10 days")).alias("retention_expires_at"),
        F.lit(None).cast("string").alias("retention_policy_id"),
        F.when(F.pmod("doc_id", F.lit(17)) == 16, "deleted")
        .when(F.pmod("doc_id", F.lit(13)) == 12, "pending")
        .otherwise("active")
        .alias("deletion_state"),
        F.lit("user-consent").alias("policy_basis"),
        "doc_id",
    )


@stored
def _fragment_rows(spark: SparkSession, path: str) -> DataFrame:
    return segment_lines(sources(spark, path), False)


def fragments(spark: SparkSession, path: str, with_content: bool = True) -> DataFrame:
    """Fragments of all sources; without content they are read from the table of their ids and ranges."""
    return segment_lines(sources(spark, path)) if with_content else _fragment_rows(spark, path)


def _memory_rows(spark: SparkSession, path: str) -> DataFrame:
    """Events joined to the governance of their document; one proposal each."""
    events = table(spark, path, "events").withColumn("doc_id", F.col("user_id"))
    docs = sources(spark, path).select(
        "doc_id", "namespace_id", "source_id", "sensitivity", "egress_policy", "retention_mode",
        "retention_expires_at", "retention_policy_id", "deletion_state", "policy_basis",
    )
    value = F.col("value").cast("decimal(18,2)").cast("string")
    return events.join(docs, "doc_id").select(
        "event_id", "event_type", "ts", "user_id", "value",
        F.concat("event_type", F.lit(" "), value).alias("content"),
        F.concat(F.col("source_id"), F.lit("-f00000")).alias("fragment_ref"),
        *[c for c in docs.columns if c not in ("doc_id", "source_id")],
    )


@stored
def _record_rows(spark: SparkSession, path: str) -> DataFrame:
    rows = _memory_rows(spark, path).filter(F.col("event_type").isin(*RECORD_TYPES))
    rows = rows.withColumns(
        {
            "memory_id": padded("mem-", F.col("event_id"), 10),
            "lineage_id": F.concat(
                F.lit("mlin-"), F.col("user_id").cast("string"), F.lit("-"), F.col("event_type")
            ),
        }
    )
    # one user may own a large share of the events: number versions day by day
    return ordered_sequence(
        rows, ["lineage_id"], ["ts", "event_id"], F.to_date("ts"),
        carry=["memory_id", "ts"], seq="version",
    )


def _event_key(prefix: str, suffix: str = "") -> Column:
    key = padded(prefix, F.col("event_id"), 10)
    return F.concat(key, F.lit(suffix)) if suffix else key


def _importance() -> dict[str, Column]:
    return {
        "confidence": F.pmod("event_id", F.lit(101)) / F.lit(100.0),
        "importance": F.pmod("event_id", F.lit(11)) / F.lit(10.0),
    }


MEMORY_TYPE = {
    "click": "observation",
    "purchase": "episode",
    "signup": "preference",
    "error": "claim",
    "view": "claim",
}
GOVERNANCE = [
    "sensitivity", "egress_policy", "retention_mode", "retention_expires_at",
    "retention_policy_id", "deletion_state", "policy_basis",
]


def _memory_type() -> Column:
    return F.create_map(*[F.lit(x) for pair in MEMORY_TYPE.items() for x in pair])[F.col("event_type")]


@stored
def proposals(spark: SparkSession, path: str) -> DataFrame:
    """One proposal per event; those of later record versions supersede the one before."""
    plain = _memory_rows(spark, path).filter(~F.col("event_type").isin(*RECORD_TYPES))
    plain = plain.withColumn("prev_memory_id", F.lit(None).cast("string"))
    recorded = _record_rows(spark, path).select(*plain.columns)
    rows = plain.unionByName(recorded).withColumns(_importance())
    create = F.col("prev_memory_id").isNull()
    return rows.select(
        _event_key("prop-").alias("proposal_id"),
        "namespace_id",
        F.when(create, "create").otherwise("supersede").alias("operation"),
        _memory_type().alias("memory_type"),
        F.col("user_id").cast("string").alias("subject_ref"),
        "content",
        exact_digest(F.col("content")).alias("content_digest"),
        F.array("fragment_ref").alias("source_fragment_refs"),
        F.when(create, F.array().cast("array<string>")).otherwise(F.array("prev_memory_id")).alias("target_memory_ids"),
        F.col("ts").alias("observed_at"),
        F.lit("open_ended").alias("valid_mode"),
        F.col("ts").alias("valid_start"),
        F.lit(None).cast("timestamp_ntz").alias("valid_end"),
        "confidence", "importance",
        *GOVERNANCE,
        F.lit("event-import").alias("reason_code"),
        F.col("ts").alias("proposed_at"),
        "event_type", "event_id",
    )


@stored
def decisions(spark: SparkSession, path: str) -> DataFrame:
    """Accept, reject, defer, or defer then accept, by the type of the event."""
    rows = _memory_rows(spark, path)
    first = (
        F.when(F.col("event_type") == "error", "reject")
        .when(F.col("event_type").isin("signup", "view"), "defer")
        .otherwise("accept")
    )
    step = F.explode(
        F.when(F.col("event_type") == "signup", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    )
    rows = rows.select("event_id", "event_type", "namespace_id", "ts", first.alias("_first"), step.alias("step"))
    decision = F.when(F.col("step") == 2, "accept").otherwise(F.col("_first"))
    return rows.select(
        F.concat(_event_key("dec-"), F.lit("-"), F.col("step").cast("string")).alias("decision_id"),
        "namespace_id",
        _event_key("prop-").alias("proposal_id"),
        F.when(F.col("step") == 2, _event_key("dec-", "-1")).alias("previous_decision_id"),
        decision.alias("decision"),
        F.lit("reviewer").alias("decided_by"),
        F.lit("event-review").alias("reason_code"),
        F.concat(F.lit("reviewed "), F.col("event_type")).alias("reason_text"),
        F.when(decision == "accept", _event_key("mem-")).alias("result_memory_id"),
        (F.col("ts") + F.make_dt_interval(mins=F.col("step"))).alias("decided_at"),
    )


@stored
def records(spark: SparkSession, path: str) -> DataFrame:
    rows = _record_rows(spark, path).withColumns(_importance())
    step = F.when(F.col("event_type") == "signup", 2).otherwise(1)
    empty = F.array().cast("array<string>")
    targets = F.when(F.col("prev_memory_id").isNull(), empty).otherwise(F.array("prev_memory_id"))
    contradicts = (F.col("event_type") == "purchase") & (F.pmod("event_id", F.lit(7)) == 0)
    closed = F.col("next_memory_id").isNotNull()
    return rows.select(
        "memory_id",
        "lineage_id",
        F.col("version").cast("long").alias("version"),
        "namespace_id",
        _memory_type().alias("memory_type"),
        F.col("user_id").cast("string").alias("subject_ref"),
        "content",
        exact_digest(F.col("content")).alias("content_digest"),
        F.array("fragment_ref").alias("source_fragment_refs"),
        _event_key("prop-").alias("origin_proposal_id"),
        F.concat(_event_key("dec-"), F.lit("-"), step.cast("string")).alias("accepted_by_decision_id"),
        F.col("ts").alias("observed_at"),
        F.lit("open_ended").alias("valid_mode"),
        F.col("ts").alias("valid_start"),
        F.lit(None).cast("timestamp_ntz").alias("valid_end"),
        "confidence", "importance",
        *GOVERNANCE,
        F.when(closed, "superseded").otherwise("confirmed").alias("current_state"),
        F.when(closed, _event_key("evt-", "-2")).otherwise(_event_key("evt-", "-1")).alias("last_state_event_id"),
        targets.alias("supersedes_memory_ids"),
        F.when(contradicts, targets).otherwise(empty).alias("contradicts_memory_ids"),
        (F.col("ts") + F.make_dt_interval(mins=step)).alias("created_at"),
    )


@stored
def state_events(spark: SparkSession, path: str) -> DataFrame:
    """A confirmed event per record and a superseded one per record with a successor."""
    rows = _record_rows(spark, path)
    step = F.when(F.col("event_type") == "signup", 2).otherwise(1)
    decision = F.concat(_event_key("dec-"), F.lit("-"), step.cast("string"))
    kinds = F.when(F.col("next_memory_id").isNull(), F.array(F.lit("confirmed"))).otherwise(
        F.array(F.lit("confirmed"), F.lit("superseded"))
    )
    rows = rows.withColumn("kind", F.explode(kinds))
    first = F.col("kind") == "confirmed"
    return rows.select(
        F.when(first, _event_key("evt-", "-1")).otherwise(_event_key("evt-", "-2")).alias("event_id"),
        "namespace_id",
        "memory_id",
        F.when(~first, _event_key("evt-", "-1")).alias("previous_event_id"),
        F.col("kind").alias("event_type"),
        F.when(~first, F.lit("confirmed")).alias("from_state"),
        F.when(first, "memory_decision").otherwise("memory_record").alias("cause_type"),
        F.when(first, decision).otherwise(F.col("next_memory_id")).alias("cause_id"),
        F.when(first, F.array().cast("array<string>")).otherwise(F.array("next_memory_id")).alias("related_memory_ids"),
        F.lit("reviewer").alias("actor"),
        F.lit("event-review").alias("reason_code"),
        F.when(~first, F.col("next_ts")).alias("effective_at"),
        F.when(first, F.col("ts") + F.make_dt_interval(mins=step)).otherwise(
            F.col("next_ts") + F.make_dt_interval(mins=step)
        ).alias("occurred_at"),
    )


def origin_bindings(spark: SparkSession, path: str) -> DataFrame:
    return (
        sources(spark, path)
        .select("namespace_id", F.col("origin_ref").alias("origin_binding_id"), "lineage_id")
        .distinct()
    )


def capture_audit(spark: SparkSession, path: str) -> DataFrame:
    return sources(spark, path).select(
        "source_id",
        "namespace_id",
        F.col("origin_ref").alias("origin_binding_id"),
        F.when(F.col("version") == 1, "created").otherwise("versioned").alias("outcome"),
        F.col("captured_at").alias("recorded_at"),
    )


def object_inventory(spark: SparkSession, path: str) -> DataFrame:
    return sources(spark, path).select(
        "source_id",
        "namespace_id",
        F.col("content_digest").alias("digest"),
        F.col("content_length").alias("length"),
        "media_type",
        F.when(F.pmod("doc_id", F.lit(23)) == 22, "abandoned")
        .when(F.pmod("doc_id", F.lit(19)) == 18, "prepared")
        .otherwise("committed")
        .alias("state"),
        F.sha2(F.concat(F.lit("loc:"), "source_id"), 256).alias("locator"),
        F.sha2(F.concat(F.lit("att:"), "source_id"), 256).alias("attempt_id"),
        F.lit("capture").alias("kind"),
        F.col("origin_ref").alias("origin_binding_id"),
        "doc_id",
    )


def _tip_documents(spark: SparkSession, path: str, tip_fragments: DataFrame) -> DataFrame:
    # ids go to the bodies, not bodies to the ids
    return sources(spark, path).join(small_side(tip_fragments.select("source_id").distinct()), "source_id")


def _asked(rows: DataFrame, prefix: str, number: str, query: Column) -> DataFrame:
    return rows.select(F.concat(F.lit(prefix), number).alias("query_id"), "namespace_id", query.alias("query"))


def _openings(docs: DataFrame) -> DataFrame:
    return _asked(docs, "doc-", "source_id", F.array_join(F.slice(F.split("content", r"\s+"), 1, 3), " "))


def opening_queries(spark: SparkSession, path: str, tip_fragments: DataFrame) -> DataFrame:
    """The ``doc-`` questions of ``recall_queries`` alone, for a result that no other question enters."""
    return _openings(_tip_documents(spark, path, tip_fragments))


def recall_queries(spark: SparkSession, path: str, tip_fragments: DataFrame) -> DataFrame:
    """(query_id, namespace_id, query): what is asked of recall.

    Whole texts, as conjunctions of all their words: every turn of every role (``turn-``),
    every tip document (``body-``) and every fragment of one (``line-``). Short questions: the
    first two words of a user turn (``conv-``) and the first three of a tip document (``doc-``).
    """
    spaces = F.array(*[F.lit(f"ns-{lang}") for lang in ("de", "en", "es", "fr")])
    number = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    turns = table(spark, path, "conversations").select("role", number.alias("number"), F.element_at(spaces, (F.pmod("conv_id", F.lit(4)) + 1).cast("int")).alias("namespace_id"), "text")
    docs = _tip_documents(spark, path, tip_fragments)
    return (
        _asked(turns, "turn-", "number", F.col("text"))
        .unionByName(_asked(docs, "body-", "source_id", F.col("content")))
        .unionByName(_asked(tip_fragments, "line-", "fragment_id", F.col("content")))
        .unionByName(_asked(turns.filter("role = 'user'"), "conv-", "number", F.array_join(F.slice(F.split("text", " "), 1, 2), " ")))
        .unionByName(_openings(docs))
    )
