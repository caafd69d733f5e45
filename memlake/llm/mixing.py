"""Mixing sources to target weights: highest-quotient apportionment of equal word blocks.

Targets are shared by weight with a cap per source. The blocks of all targets are given to
sources by the odd-divisor quotients (votes / 1, votes / 3, votes / 5, ...), then each
source's blocks to its shards by the same rule. Inside a shard documents stand in a seeded
order; the shard takes its quota of blocks from that stream and starts again at its head
when the stream ends, so whole passes come first and one document at most is cut.

Everything is DataFrame operations. Only one row per source and at most ``shards`` rows per
source take part in the apportionment; documents are shuffled once, by (source, shard), and
a hot source is spread over its shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.common import small_side, stored, word_count

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
CAP = 2
BLOCK = 8
SHARDS = 1024
SHARD_BLOCKS = 2048
SEED = 1729


def _seats(votes: DataFrame, group: list[str], key: list[str], vote: str, total: str, seats: str) -> DataFrame:
    """``votes`` with ``quota``: ``seats`` seats of each group by highest quotients vote / (2k - 1).

    A divisor that surely gives too few seats and one that surely gives enough bound each
    quota from both sides; only the quotients between them (about three per row) are ranked.
    Rows without votes get none.
    """
    over = Window.partitionBy(*group)
    n = F.sum((F.col(vote) > 0).cast("long")).over(over)
    bound = lambda sign: F.col(vote) * (F.col(seats) + sign * F.col("_n") / 2) / F.col(total) + 0.5
    ranged = (
        votes.withColumn("_n", n).filter(F.col(vote) > 0)
        .withColumn("_low", F.greatest(F.lit(0), F.floor(bound(-1))).cast("long"))
        .withColumn("_high", F.floor(bound(1)).cast("long") + 1)
        .withColumn("_left", F.col(seats) - F.sum("_low").over(over))
    )
    names = [*group, *key]
    last = (
        ranged.select(*names, "_low", "_left", F.col(vote).alias("_vote"), F.explode(F.expr("sequence(_low + 1, greatest(_high, _low + 1))")).alias("_k"))
        .withColumn("_place", F.row_number().over(over.orderBy(F.desc(F.col("_vote") / (2 * F.col("_k") - 1)), *key)))
        .filter("_place <= _left")
        .groupBy(*names).agg(F.count("*").alias("_more"))
    )
    same = [F.col(f"r.{c}") == F.col(f"l.{c}") for c in names]
    return (
        ranged.alias("r").join(last.alias("l"), same, "left")
        .select(*[F.col(f"r.{c}") for c in votes.columns], (F.col("r._low") + F.coalesce(F.col("l._more"), F.lit(0))).alias("quota"))
    )


def targets(sources: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: int = CAP) -> DataFrame:
    """(src, source_size, target): ``budget`` times all words shared by weight, at most ``cap`` times a source.

    Sorted by cap / weight, the capped sources are a prefix: a source is capped when the
    level left after the caps before it would lift it over its cap. One row per source.
    """
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("src")) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(rank, F.lit(len(weights))))
    s = sources.withColumn("w", weight).withColumn("limit", (cap * F.col("source_size")).cast("double"))
    filling = Window.partitionBy(F.lit(0)).orderBy(F.col("limit") / F.col("w"), "src")
    before = F.coalesce(F.sum("limit").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("w").over(filling.rowsBetween(0, Window.unboundedFollowing))
    everything = F.sum("source_size").over(Window.partitionBy(F.lit(0)))
    s = (
        s.withColumn("all_words", everything)
        .withColumn("level", (budget * F.col("all_words") - before) / onward)
        .withColumn("capped", F.col("limit") <= F.col("level") * F.col("w"))
    )
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("limit") / F.col("w"), "src", "level"))).over(Window.partitionBy(F.lit(0)))["level"]
    return s.select("src", "source_size", "all_words", F.when(F.col("capped"), F.col("limit")).otherwise(level * F.col("w")).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: int = CAP, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED, carry: Column | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken (and ``row``, the column ``carry``).

    ``docs`` needs doc_id, text and source; other columns are ignored, whatever their names.
    A null text has size 0; a null source is a source of its own, ordered last; null and
    repeated doc_ids are rows like any other. ``taken`` is between 0 and ``cap`` times the
    size; repeated rows that agree in doc_id and text may swap their shares. An empty table
    gives an empty result.
    """
    key = F.xxhash64(F.lit(seed), "doc_id", "text")
    sized = docs.select(
        F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"), key.alias("h"),
        F.coalesce(F.concat(F.lit("1"), "source"), F.lit("2")).alias("src"), F.pmod(key, F.lit(shards)).alias("bucket"),
        *([] if carry is None else [carry.alias("row")]),
    )
    parts = stored(sized.groupBy("src", "bucket").agg(F.sum("size").alias("words")), "mix-parts")
    plan = targets(parts.groupBy("src").agg(F.sum("words").alias("source_size")), weights, budget, cap)
    seats = F.round(budget * F.col("all_words") / block).cast("long")
    voted = plan.select("*", F.lit(0).alias("g"), F.sum("target").over(Window.partitionBy(F.lit(0))).alias("votes"), seats.alias("seats"))
    by_source = _seats(voted, ["g"], ["src"], "target", "votes", "seats").select("src", F.col("quota").alias("blocks"))
    # a shard holds many blocks, so that whole blocks come near the shares of small sources too
    count = F.greatest(F.lit(1), F.least(F.lit(shards), F.floor(F.col("source_size") / (block * SHARD_BLOCKS))))
    plan = stored(plan.join(by_source, "src", "left").withColumn("shards", count.cast("long")), "mix-plan")
    shard = F.pmod("bucket", "shards").alias("shard")
    shares = parts.join(plan, "src").groupBy("src", shard, "source_size", "blocks").agg(F.sum("words").alias("words"))
    by_shard = _seats(shares, ["src"], ["shard"], "words", "source_size", "blocks").select("src", "shard", "words", F.least(F.col("quota") * block, cap * F.col("words")).alias("take"))
    sized = sized.join(small_side(plan.select("src", "source_size", "target", "shards")), "src").withColumn("shard", shard)
    stream = Window.partitionBy("src", "shard").orderBy("h", "doc_id", "size")
    before = F.coalesce(F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.col("take") % F.col("words") - before
    taken = F.expr("take div words") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return (
        sized.join(by_shard, ["src", "shard"], "left").withColumn("taken", F.coalesce(taken, F.lit(0)).cast("long"))
        .select("doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", "taken", *([] if carry is None else ["row"]))
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: whole texts once per whole pass, one cut text for the rest.

    Columns stay those of ``docs``. A document with two thirds of its words taken comes once,
    cut after that word with its white space kept; one taken 1.5 times comes whole and once
    more cut. Documents without taken words are left out, so empty texts go.
    ``n_chars``, if there, counts the text that is left.
    """
    out = mix(docs, carry=F.struct(*[F.col(f"`{c}`") for c in docs.columns]), **options)
    size, taken = F.col("size"), F.col("taken")
    whole = F.when(size > 0, F.expr("taken div size")).otherwise(0)
    pieces = F.concat(F.array_repeat(size, whole.cast("int")), F.when(taken % size > 0, F.array(taken % size)).otherwise(F.array().cast("array<bigint>")))
    rows = out.filter(taken > 0).select("row", "size", F.explode(pieces).alias("words"))
    units = F.regexp_extract_all(F.col("row.text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.when(F.col("words") == F.col("size"), F.col("row.text")).otherwise(F.array_join(F.slice(units, F.lit(1), F.col("words").cast("int")), ""))
    rows = rows.select("row", text.alias("cut"))
    put = {"text": F.col("cut"), "n_chars": F.length("cut").cast("long")}
    return rows.select(*[put[c].alias(c) if c in put else F.col("row").getField(c).alias(c) for c in docs.columns])
