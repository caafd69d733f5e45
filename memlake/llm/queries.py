"""Registered queries of the operators over whole tables, with SQL where it can state them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.common import table
from memlake.llm.hard_negatives import SQL as HARD_NEGATIVES
from memlake.llm.quality_rules import sql as quality_sql
from memlake.session import work_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op7_quality_rules": quality_sql(), "op12_hard_negatives": HARD_NEGATIVES}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op2_packing(spark, sf_dir):
    from memlake.llm.packing import pack

    return pack(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@_query
def op7_quality_rules(spark, sf_dir):
    from memlake.llm.quality_rules import apply_rules

    columns = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
    return apply_rules(table(spark, sf_dir, "documents")).select(*columns)


@_query
def op9_mixing(spark, sf_dir):
    from memlake.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@_query
def op1_quality_model(spark, sf_dir):
    from memlake.llm.quality_model import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op3_ngram_join(spark, sf_dir):
    from memlake.llm.ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=85)


@_query
def op10_pii(spark, sf_dir):
    from memlake.llm.pii import digest, find

    return digest(find(table(spark, sf_dir, "documents")))


@_query
def op4_secrets_scan(spark, sf_dir):
    from memlake.llm.secrets_scan import digest, find

    return digest(find(table(spark, sf_dir, "documents")))


@_query
def op6_html_main(spark, sf_dir):
    from memlake.llm.html_main import extract

    return extract(table(spark, sf_dir, "pages"))


@_query
def op8_vector_search(spark, sf_dir):
    from memlake.llm.vector_search import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


@_query
def op5_repeats(spark, sf_dir):
    from memlake.llm.repeats import without_repeats

    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["stop"] - r["start"])
    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


@_query
def op11_token_files(spark, sf_dir):
    from memlake.llm.token_files import read_ids, write_ids

    folder = f"{work_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_ids(table(spark, sf_dir, "documents"), folder)
    return read_ids(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@_query
def op12_hard_negatives(spark, sf_dir):
    from memlake.llm.hard_negatives import mine

    return mine(table(spark, sf_dir, "embeddings"))


@_query
def op13_periodic_runs(spark, sf_dir):
    from memlake.llm.runs import digest, periodic_runs

    return digest(periodic_runs(table(spark, sf_dir, "documents"), plant=True))
