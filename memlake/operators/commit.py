"""Checked append of capture batches: all of a batch is published, or nothing of it.

A batch is staged as Parquet, decided against the library as it is, and checked by the
integrity rules as one union of violations. Only if that is empty do its parts of the five
tables become readable: they lie in a folder of their own, and a row of ``commits``, written
last, makes them part of the library. A batch id that is already there changes nothing, and
what an attempt left that broke off is overwritten by the next.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from memlake.operators import rules, versions
from memlake.operators.capture import LINEAGE, current_facts, decide_captures

TABLES = ("sources", "fragments", "bindings", "audit", "tips")
COMMITS = "batch_id string, outcome string, n_problems long"
NEW = ["created", "versioned"]


def numbered(incoming: DataFrame, decisions: DataFrame, tips: DataFrame) -> DataFrame:
    """Incoming sources with their outcome, and the version and predecessor that follow from it.

    A predecessor is the version before in the batch, else the stored tip of the lineage.
    """
    changes = decisions.filter(F.col("outcome").isin(*NEW)).select("source_id", *LINEAGE, "next_version")
    chain = Window.partitionBy(*LINEAGE).orderBy("next_version")
    changes = changes.withColumn("in_batch", F.lag("source_id").over(chain)).join(
        tips.select(*LINEAGE, F.col("source_id").alias("t_id")), LINEAGE, "left"
    )
    before = changes.select("source_id", F.coalesce("in_batch", "t_id").alias("before"))
    return incoming.join(decisions.select("source_id", "outcome", F.col("reason").alias("refused"), "next_version"), "source_id").join(before, "source_id", "left")


def batch_problems(numbered_: DataFrame, fragments: DataFrame, stored: dict[str, DataFrame]) -> DataFrame:
    """Every violation of a batch: refused captures, rows, fragments, references and its place in the chains."""
    new = numbered_.filter(F.col("outcome").isin(*NEW))
    own = fragments.join(new.select("source_id"), "source_id", "left_semi")
    ids = stored["sources"].select("source_id", F.lit(True).alias("id_used"))
    reused = own.join(stored["fragments"].select("fragment_id"), "fragment_id", "left_semi").select("source_id").distinct().withColumn("f_used", F.lit(True))
    placed = new.join(ids, "source_id", "left").join(reused, "source_id", "left")
    old = F.col("supersedes_source_ids")
    follows = F.when(F.col("before").isNull(), F.size(old) == 0).otherwise((F.size(old) == 1) & (F.get(old, F.lit(0)) == F.col("before")))
    audit = new.select("source_id", F.col("origin_ref").alias("origin_binding_id"))
    everything = stored["sources"].select("source_id", *LINEAGE, "version").unionByName(new.select("source_id", *LINEAGE, "version"))
    parts = [
        numbered_.filter("outcome = 'rejected'").select(F.lit("B1").alias("rule_id"), F.lit("SourceArtifact").alias("object_type"), F.col("source_id").alias("object_id"), F.col("refused").alias("reason")),
        rules.id_reuse(numbered_, "source_id", "SourceArtifact"),
        rules.source_rows(numbered_),
        rules.fragment_rows(own),
        rules.fragment_resolution(own, new),
        rules.fragment_cover(own, new),
        rules.fragment_batches(own.withColumn("batch", F.col("source_id")), "batch"),
        rules.governance_derivation(own.withColumn("refs", F.array("source_id")), "fragment_id", "refs", new, "source_id", "SourceFragment"),
        rules.superseded_sources(new, everything),
        rules.binding_rows(new, audit),
        rules.violations(placed, "V38", "SourceArtifact", "source_id", [
            ("SupersessionMismatch", ~F.coalesce(follows & (F.col("version") == F.col("next_version")), F.lit(False))),
            ("DuplicateObject", F.col("id_used") | F.coalesce("f_used", F.lit(False))),
            ("DuplicateObject", F.col("f_used")),
        ]),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


class Library:
    """Five tables, of a base that is never changed and of the batches appended since.

    ``base`` holds sources, fragments, bindings and audit; ``folder`` must be one that all
    executors share.
    """

    def __init__(self, spark: SparkSession, folder: str, base: dict[str, DataFrame]):
        self.spark, self.folder, self.base = spark, folder, dict(base)
        self.base["tips"] = versions.tips(base["sources"]).select(*LINEAGE, "source_id", "version")

    def commits(self) -> DataFrame:
        """(batch_id, outcome, n_problems): one row a batch that has ended."""
        try:
            return self.spark.read.schema(COMMITS).parquet(f"{self.folder}/commits")
        except AnalysisException:  # nothing was appended yet
            return self.spark.createDataFrame([], COMMITS)

    def _parts(self, name: str) -> list[str]:
        accepted = self.commits().filter("outcome = 'accepted'").select("batch_id").orderBy("batch_id").collect()  # a row a batch
        return [f"{self.folder}/{name}/batch_id={r[0]}" for r in accepted]

    def appended(self, name: str) -> DataFrame:
        """What accepted batches have added to a table, with their batch_id."""
        like, parts = self.base[name], self._parts(name)
        if not parts:
            return like.limit(0).withColumn("batch_id", F.lit(None).cast("string"))
        schema = StructType([*like.schema.fields, StructField("batch_id", StringType())])
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{name}").parquet(*parts)

    def table(self, name: str) -> DataFrame:
        return self.base[name].unionByName(self.appended(name).drop("batch_id"))

    def tips(self) -> DataFrame:
        """Newest version of each lineage: the stored tips and what batches have moved."""
        newest = F.max(F.struct("version", "source_id")).alias("n")
        return self.table("tips").groupBy(*LINEAGE).agg(newest).select(*LINEAGE, F.col("n.source_id").alias("source_id"), F.col("n.version").alias("version"))

    def problems(self) -> DataFrame:
        """(batch_id, rule_id, object_type, object_id, reason) of refused batches."""
        refused = self.commits().filter("outcome = 'refused'").select("batch_id")
        schema = "rule_id string, object_type string, object_id string, reason string, batch_id string"
        try:
            found = self.spark.read.schema(schema).parquet(f"{self.folder}/problems")
        except AnalysisException:
            found = self.spark.createDataFrame([], schema)
        return found.join(refused, "batch_id", "left_semi")

    def _write(self, df: DataFrame, name: str, batch_id: str) -> DataFrame:
        path = f"{self.folder}/{name}/batch_id={batch_id}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def append(self, batch_id: str, sources: DataFrame, fragments: DataFrame) -> str:
        """Publishes a batch or refuses it as a whole; gives the outcome.

        ``sources`` are full source rows; without ``version`` and ``supersedes_source_ids``
        these follow from the decision. Idempotent captures add an audit row only.
        """
        ended = self.commits().filter(F.col("batch_id") == batch_id).first()
        if ended:
            return ended["outcome"]
        stored = {name: self.table(name) for name in ("sources", "fragments", "bindings")}
        tips = self.tips()
        asked = self._write(sources, "staged-sources", batch_id)
        own = self._write(fragments, "staged-fragments", batch_id)
        decided = decide_captures(asked.withColumn("origin_binding_id", F.col("origin_ref")), stored["bindings"], current_facts(stored["sources"], tips), stored["sources"])
        rows = numbered(asked, self._write(decided, "decisions", batch_id), tips)
        if "version" not in asked.columns:
            one = F.when(F.col("before").isNull(), F.array().cast("array<string>")).otherwise(F.array("before"))
            rows = rows.withColumns({"version": F.coalesce("next_version", F.lit(1)).cast("long"), "supersedes_source_ids": F.when(F.col("next_version").isNull(), F.array().cast("array<string>")).otherwise(one)})
        rows = self._write(rows, "numbered", batch_id)
        n = self._write(batch_problems(rows, own, stored), "problems", batch_id).count()
        if not n:
            new = rows.filter(F.col("outcome").isin(*NEW))
            added = {
                "sources": new.select(self.base["sources"].columns),
                "fragments": own.join(new.select("source_id"), "source_id", "left_semi").select(self.base["fragments"].columns),
                "bindings": new.filter("outcome = 'created'").select("namespace_id", F.col("origin_ref").alias("origin_binding_id"), "lineage_id"),
                "audit": rows.select("source_id", "namespace_id", F.col("origin_ref").alias("origin_binding_id"), "outcome", F.col("captured_at").alias("recorded_at")),
                "tips": new.select(*LINEAGE, "source_id", "version"),
            }
            for name in TABLES:
                self._write(added[name], name, batch_id)
        outcome = "refused" if n else "accepted"
        # the last step; one small file appears at once
        self.spark.createDataFrame([(batch_id, outcome, n)], COMMITS).coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")
        return outcome
