"""Secret scans with multipart credential linking, in DataFrame operations only.

Strong patterns (``BASE``) are always reported. Weak parts of credentials - identifiers,
secrets, endpoints - say little alone: an interval join of the parts of a text reports a
weak part only where at most ``reach`` characters lie between it and a complementary part.

Positions come from the text between matches: ``split`` and ``regexp_extract_all`` cut a
text at the same places, and running lengths of the pieces are the offsets. No text is
shuffled; the join is one pass over the parts of a row in order with the largest end so
far of every kind of part, so that many parts in one place make no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.common import let, stored

_VALUE = r"[A-Za-z0-9+/_.=-]+"
_ASSIGN = rf"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?({_VALUE})"""
#: kind -> (pattern, part); a run of letters that is long enough is matched whole, so the
#: least lengths of access and hex stand in the pattern itself
BASE = {
    "assign": (_ASSIGN, "secret"),
    "access": (r"AKIA[A-Z0-9]{16,}", "id"),
    "hex": (r"[0-9a-f]{24,}", "secret"),
}
WEAK = {
    "user": (r"""(?i:client_?id|access_?key_?id|account|user_?name|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{3,}""", "id"),
    "key": (r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/]{0,39}[0-9])(?=[A-Za-z0-9+/]{0,39}[a-z])(?=[A-Za-z0-9+/]{0,39}[A-Z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])", "secret"),
    "pass": (r"""(?i:\bpwd|\bpass|\bpassphrase|\bcredentials?|\bauth)["']?\x20*[:=]\x20*["']?[^\x00-\x20"']{6,}""", "secret"),
    "endpoint": (r"""(?:https?|ftp|ssh|postgres|postgresql|mysql|mongodb|redis|amqp|s3|ldap)://[^\x00-\x20"'<>]{3,}""", "endpoint"),
}
#: part -> parts of which at least one must stand near a weak candidate of that part
NEEDS = {"id": ("secret",), "secret": ("id", "endpoint"), "endpoint": ("secret",)}
KINDS = (*BASE, *WEAK)
#: Matches that one array is grown to before the next is begun.
STEP = 256


def spans(text: Column, kind: str, pattern: str) -> Column:
    """Leftmost non-overlapping matches as an array of (start, kind number, end), in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    span = "struct<start:bigint,kind:int,end:bigint>"
    empty, none = F.array().cast(f"array<{span}>"), F.array().cast(f"array<array<{span}>>")

    def walk(pieces: Column, matches: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            start = state["at"] + F.length(F.get(pieces, i))
            end = start + F.length(F.get(matches, i))
            one = F.struct(start.cast("long").alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.cast("long").alias("end"))
            good = F.length(F.regexp_extract(F.get(matches, i), _ASSIGN, 2)) >= 6 if kind == "assign" else F.lit(True)
            return F.struct(end.cast("long").alias("at"), F.when(good, F.concat(state["out"], F.array(one))).otherwise(state["out"]).alias("out"))

        def block(state: Column, b: Column) -> Column:
            """The next ``STEP`` matches: arrays grow by copying, so short ones are made and joined at the end."""
            last = F.least((b + 1) * STEP, F.size(matches)) - 1
            return let(
                F.aggregate(F.sequence(b * STEP, last), F.struct(state["at"].alias("at"), empty.alias("out")), step),
                lambda s: F.struct(s["at"].alias("at"), F.concat(state["blocks"], F.array(s["out"])).alias("blocks")),
            )

        blocks = F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / STEP).cast("int"))
        return F.flatten(F.aggregate(blocks, F.struct(F.lit(0).cast("long").alias("at"), none.alias("blocks")), block)["blocks"])

    some = let(F.split(text, pattern, -1), lambda p: let(found, lambda m: walk(p, m)))
    return F.when(text.rlike(pattern), some).otherwise(empty)


def _text(items: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(items, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _part(kind: Column) -> Column:
    parts = F.array(*[F.lit(p) for _, p in [*BASE.values(), *WEAK.values()]])
    return F.get(parts, kind)


def find(docs: DataFrame, reach: int = 256) -> DataFrame:
    """doc_id, base and linked (arrays of start, kind number, end), one row per row of ``docs``.

    Only doc_id and text are read. Null and empty texts have no spans; null and repeated
    doc_ids are rows like others. Weak candidates that meet a base span are not reported.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        F.sort_array(F.concat(*[spans(text, k, p) for k, (p, _) in BASE.items()])).alias("base"),
        F.concat(*[spans(text, k, p) for k, (p, _) in WEAK.items()]).alias("weak"),
    )
    rows = stored(rows, "secret-parts")
    apart = F.filter("weak", lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    busy = rows.filter(F.size("weak") > 0)
    part = busy.select("row", F.explode(F.concat("base", apart)).alias("s")).select("row", F.col("s.start").alias("at"), F.col("s.end").alias("end"), _part(F.col("s.kind")).alias("part"))
    weak = busy.select("row", F.explode(apart).alias("s")).withColumn("at", F.col("s.end") + reach)
    # of the parts that start by then, the one that ends last is near if any is
    past = Window.partitionBy("row").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    fits = F.lit(False)
    for own, needed in NEEDS.items():
        fits = fits | ((_part(F.col("s.kind")) == own) & (F.max(F.when(F.col("part").isin(*needed), F.col("end"))).over(past) >= F.col("s.start") - reach))
    linked = part.unionByName(weak, allowMissingColumns=True).withColumn("near", fits).filter("s IS NOT NULL AND near")
    linked = linked.groupBy("row").agg(F.sort_array(F.collect_list("s")).alias("linked"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return rows.join(linked, "row", "left").select("doc_id", "base", F.coalesce("linked", none).alias("linked"))


def digest(found: DataFrame) -> DataFrame:
    """Counts per base kind, digest of the base spans and all spans as one string, from :func:`find`."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(_text(F.col("base")), 256).alias("base_sha256"), _text(F.sort_array(F.concat("base", "linked"))).alias("spans"))
