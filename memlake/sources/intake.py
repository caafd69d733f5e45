"""Text intake: files or rows in, accepted captures and rejected rows with reasons out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.functions.digest import exact_digest
from memlake.operators.rules import source_rows
from memlake.sources.segment import segment_whole

# fixed values: accepted extensions and the largest accepted body
EXTENSIONS = {"txt": ("text", "text/plain"), "md": ("markdown", "text/markdown")}
MAX_BYTES = 8 * 1024 * 1024


def read_files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) files of a folder. Bodies over the size limit are not read.

    The file source gives no row for a file of zero bytes; such files are found in its
    listing and rejected as empty.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    small = files.filter(F.col("length") <= MAX_BYTES).select(name.alias("name"), "content", "path")
    large = files.filter(F.col("length") > MAX_BYTES).select(name.alias("name"), "path", F.lit("too_large").alias("reject_reason"))
    checked = classify(small)
    accepted = checked.filter("reject_reason is null").drop("reject_reason")
    plain = lambda path: F.regexp_replace(F.url_decode(path), "^file:/+", "file:/")
    listed = spark.createDataFrame([(p,) for p in files.inputFiles()], "path string")
    none = listed.withColumn("_key", plain("path")).join(files.select(plain("path").alias("_key")), "_key", "left_anti")
    none = none.withColumn("path", plain("path")).select(name.alias("name"), "path", F.when(~extension(name).isin(*EXTENSIONS), "unsupported_type").otherwise("empty").alias("reject_reason"))
    rejected = checked.filter("reject_reason is not null").select("name", "path", "reject_reason").unionByName(large).unionByName(none)
    return accepted, rejected


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


def classify(rows: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """Kind and media type by extension, and the first reason to reject the exact bytes."""
    ext = extension(F.col(name))
    raw = F.col(content).cast("binary")
    size = F.octet_length(raw)
    reason = (
        F.when(~ext.isin(*EXTENSIONS), "unsupported_type")
        .when(size == 0, "empty")
        .when(size > MAX_BYTES, "too_large")
        .when(~F.is_valid_utf8(raw.cast("string")), "invalid_utf8")
        .when(F.locate("\u0000", raw.cast("string")) > 0, "nul_byte")
    )

    def looked_up(i: int) -> Column:
        return F.create_map(*[F.lit(x) for e, v in EXTENSIONS.items() for x in (e, v[i])])[ext]

    return rows.withColumns({
        "source_kind": looked_up(0), "media_type": looked_up(1), "content_length": size.cast("long"), "reject_reason": reason,
    })


def build_captures(accepted: DataFrame, plan: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Source and whole-body fragment frames of accepted rows.

    ``plan`` supplies ids, lineage, version, superseded ids, times and governance as
    columns, so the same input always gives the same output.
    """
    text = F.col("content").cast("binary").cast("string")
    sources = accepted.withColumn("content", text).withColumns(plan).withColumns({
        "content_length": F.octet_length("content").cast("long"),
        "content_digest": exact_digest(F.col("content")),
        "origin_kind": F.lit("explicit_user_input"),
    })
    return sources, segment_whole(sources)


def export_sources(sources: DataFrame, folder: str) -> DataFrame:
    """Write the exact bytes of chosen sources to a new folder and return receipts.

    Refuses sources that are not active or fail their own digest, and never overwrites.
    """
    blocked = sources.filter("deletion_state <> 'active'").select("source_id")
    broken = source_rows(sources).select("object_id")
    if not blocked.isEmpty() or not broken.isEmpty():
        raise ValueError("only active sources that match their digest can be exported")
    sources.select("source_id", F.col("content").cast("binary").alias("content")).write.mode("errorifexists").parquet(folder)
    written = sources.sparkSession.read.parquet(folder)
    return written.select("source_id", F.octet_length("content").cast("long").alias("content_length"), F.sha2("content", 256).alias("content_digest"))


SUITE_SCHEMA = """
suite_id string, namespace_id string,
metric_gates array<struct<metric_id:string, kind:string, comparator:string, threshold:struct<numerator:bigint, denominator:bigint>>>,
scenarios array<struct<scenario_id:string, title:string, operations:array<struct<step_id:string, op:string,
  input:struct<query:string, as_of:string, top_k:int, expected_relevant_keys:array<string>, forbidden_source_keys:array<string>>>>>>
"""


def read_suite(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(queries, gates) of an expectation suite in JSON."""
    suite = spark.read.schema(SUITE_SCHEMA).option("multiLine", True).json(path)
    steps = suite.select("namespace_id", F.explode("scenarios").alias("s")).select(
        "namespace_id", "s.scenario_id", F.explode("s.operations").alias("o")
    )
    queries = steps.filter("o.op = 'search'").select(
        F.concat_ws("/", "scenario_id", "o.step_id").alias("query_id"), "namespace_id",
        "o.input.query", "o.input.as_of", "o.input.top_k", "o.input.expected_relevant_keys", "o.input.forbidden_source_keys",
    )
    gates = suite.select(F.explode("metric_gates").alias("g")).select(
        "g.metric_id", F.col("g.threshold.numerator").alias("thr_num"), F.col("g.threshold.denominator").alias("thr_den")
    )
    return queries, gates


# fixed values: multiplier, step and number of topics of the noise generator
NOISE_MULTIPLIER, NOISE_STEP, NOISE_TOPICS = 1_103_515_245, 12_345, 97


def noise_text(index: Column, seed: int, template: str) -> Column:
    """Deterministic noise sentence; the arithmetic wraps at 64 bits, unsigned."""
    wide = index.cast("decimal(38,0)") * F.lit(NOISE_STEP)
    start = (seed * NOISE_MULTIPLIER) % 2**64
    wrapped = F.expr(f"cast({start} as decimal(38,0))") + wide
    topic = ((wrapped % F.expr("cast(18446744073709551616 as decimal(38,0))")) % NOISE_TOPICS).cast("int").cast("string")
    text = F.replace(F.lit(template), F.lit("{index}"), index.cast("string"))
    return F.replace(text, F.lit("{topic}"), F.concat(F.lit("topic-"), topic))


def noise_rows(spark: SparkSession, count: int, seed: int, template: str, forbidden: list[str]) -> DataFrame:
    """``count`` noise texts, each flagged when it holds a forbidden term."""
    rows = spark.range(count).withColumnRenamed("id", "index").withColumn("content", noise_text(F.col("index"), seed, template))
    unsafe = F.lit(False)
    for term in forbidden:
        unsafe = unsafe | F.contains("content", F.lit(term))
    return rows.withColumn("unsafe", unsafe)
