"""Repeated byte strings over a corpus: maximal repeats from enhanced suffix arrays.

Which windows of ``LENGTH`` bytes can be equal is settled first. Every window is owned by
the smallest of the hashes of its ``GRAM``-byte strings; windows in a row with one owner
are a frame, and equal windows lie in frames with one owner hash.

1. Texts equal as a whole: all but the one with the smallest doc_id are repeats throughout.
2. Frames of the other texts, ranged by (owner, digest of the frame). A frame that is equal
   to an earlier one is a repeat throughout. Frames alone with their owner are done.
3. What is left, frames that share an owner but differ, is read again from the texts. The
   frames of some owners make one text with an enhanced suffix array (order and common
   prefixes). A stack scan over the common prefixes visits the tree of its intervals; an
   interval whose occurrences differ in the byte before them is a maximal repeat, and all
   its occurrences but the first are repeats.
4. Owners with more than ``CROWD`` different frames go by hashes of their single windows,
   with partial minima, so that no group is gathered.

Ranges, bundles and windows are dealt by content, so a string in a third of all texts is
spread over many tasks. Texts are shuffled only if something in them repeats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import release, small_side, stored
from memlake.llm.textbytes import mixed, powers, prefix_sums, slices

LENGTH = 100
GRAM = 32
CROWD = 8192
BUNDLE_BYTES = 1 << 20
_LOW = np.uint64(0xFFFFFFFF)


def _window_minima(key: np.ndarray, width: int) -> np.ndarray:
    """Smallest key of every run of ``width`` keys, by doubling."""
    size = 1
    while 2 * size <= width:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    return np.minimum(key[: len(key) - (width - size)], key[width - size :]) if size < width else key


def frames(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(owner, digest, text number, start in the text, windows) of all frames, as arrays."""
    n = len(data)
    if n < length:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    sums, inverse = prefix_sums(data, 21), powers(n + 1)[1]
    gram_hash = mixed((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])
    key = (gram_hash & ~_LOW) | np.arange(len(gram_hash), dtype=np.uint64)
    owner = (_window_minima(key, length - gram + 1) & _LOW).astype(np.int64)
    inside = np.arange(len(owner)) + length <= np.repeat(offsets[1:], np.diff(offsets))[: len(owner)]
    change = np.ones(len(owner), bool)
    change[1:] = (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])
    lo = np.flatnonzero(change)
    count = np.diff(np.append(lo, len(owner)))
    lo, count = lo[inside[lo]], count[inside[lo]]
    at = owner[lo]
    digest = mixed(((sums[lo + count - 1 + length] - sums[lo]) * inverse[lo]) ^ mixed((at - lo).astype(np.uint64)))
    doc = np.searchsorted(offsets, lo, "right") - 1
    return gram_hash[at], digest, doc, lo - offsets[doc], count


def _first_of(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """For rows in ``order``: whether a row is the first with its keys."""
    first = np.ones(len(order), bool)
    first[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return first


_FRAME = "owner long, digest long, doc_id long, h long, start long, n long, done boolean"


def _framed(length: int):
    def run(batches):
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for row, data, offsets in slices(batch.column(2)):
                owner, digest, doc, start, count = frames(data, offsets, length)
                h = keys[row : row + len(offsets) - 1][doc]
                doc = ids[row : row + len(offsets) - 1][doc]
                order = np.lexsort((start, h, doc, digest, owner))
                done = ~_first_of(order, owner, digest)
                owner, digest, doc, h, start, count = (x[order] for x in (owner, digest, doc, h, start, count))
                # what repeats here is settled; it travels under keys of its own, evenly
                owner = np.where(done, mixed(doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + start.astype(np.uint64)), owner)
                yield pa.RecordBatch.from_arrays([pa.array(owner.view(np.int64)), pa.array(digest.view(np.int64)), pa.array(doc), pa.array(h), pa.array(start), pa.array(count), pa.array(done)], names=[c.split()[0] for c in _FRAME.split(", ")])

    return run


def _settle(batches):
    """Over frames sorted by owner, digest, doc_id, h, start: repeats are marked done, frames that
    share their owner with others are kept, frames alone are dropped. The first and last
    owners of a partition may go on in the next one, so they count as shared."""
    names = ["owner", "doc_id", "h", "start", "n", "done"]
    edge = last = None  # owner at the start of the partition; (owner, digest) before the batch
    held = None  # the latest first frame, if nothing before it shares its owner

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=names)

    for batch in batches:
        owner, digest, doc, h, start, n, done = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        settled = done.copy()
        free = np.flatnonzero(~done)
        o, d = owner[free], digest[free]
        if len(free):
            if edge is None:
                edge = o[0]
            before_o = np.concatenate([[last[0] if last else o[0] + 1], o[:-1]])
            before_d = np.concatenate([[last[1] if last else d[0] + 1], d[:-1]])
            fresh = o != before_o
            if last is None:
                fresh[0] = True
            first = fresh | (d != before_d)
            settled[free[~first]] = True
            lead = np.flatnonzero(first)
            shared = ~fresh[lead] | (o[lead] == edge)
            if len(lead):
                shared[:-1] |= o[lead][1:] == o[lead][:-1]
                if held is not None and o[lead[0]] == held[0][0]:
                    yield out(held)
                held = None
                if not shared[-1]:
                    i = free[lead[-1:]]
                    held = [owner[i], doc[i], h[i], start[i], n[i], np.array([False])]
            last = (o[-1], d[-1])
            keep = np.sort(np.concatenate([np.flatnonzero(settled), free[lead[shared]]]))
        else:
            keep = np.flatnonzero(settled)
        yield out([owner[keep], doc[keep], h[keep], start[keep], n[keep], settled[keep]])
    if held is not None:
        yield out(held)


def suffix_array(text: np.ndarray, ends: np.ndarray):
    """Order of all suffixes, and what neighbours share, of bytes in parts that end at ``ends``.

    Prefix doubling until the longest part is compared whole; suffixes stop at the end of
    their part. Returns (order, common prefix with the suffix before, at most to the ends).
    """
    n = len(text)
    depth = int(np.diff(ends, prepend=0).max())
    part_end = ends[np.searchsorted(ends, np.arange(n), "right")]
    unique = np.uint64(n) + np.arange(n, dtype=np.uint64)  # beyond an end nothing is equal
    levels, size, rank = [], 1, text.astype(np.uint64)
    order = None
    while True:
        levels.append((size, rank))
        if size >= depth:
            break
        at = np.arange(n) + size
        inside = at < part_end
        low = np.where(inside, rank[np.minimum(at, n - 1)], unique)
        key = (rank << np.uint64(32)) | low
        order = np.argsort(key, kind="stable")
        k = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])]).astype(np.uint64)
        size *= 2
    i, j = order[1:].copy(), order[:-1].copy()
    common = np.zeros(n, np.int64)
    i0 = i.copy()
    for _ in range(2):  # the largest step may fit once more
        for size, rank in reversed(levels):
            room = (np.maximum(i, j) < n) & (i + size <= part_end[np.minimum(order[1:], n - 1)]) & (j + size <= part_end[order[:-1]])
            same = room & (rank[np.minimum(i, n - 1)] == rank[np.minimum(j, n - 1)])
            i, j = i + size * same, j + size * same
    common[1:] = i - i0
    return order, common


def maximal_repeats(order: np.ndarray, common: np.ndarray, before: np.ndarray, least: int):
    """(first place, last place, length) in ``order`` of every maximal repeat of ``least`` bytes or more.

    A stack holds the open intervals of the common-prefix tree. An interval is diverse when
    the bytes before its suffixes (``before``; -1 is unlike any) are not all the same.
    """
    high = common >= least
    starts = np.flatnonzero(high & ~np.concatenate([[False], high[:-1]]))
    stops = np.flatnonzero(high & ~np.concatenate([high[1:], [False]])) + 1
    left = before[order].tolist()
    lengths = common.tolist()
    mixed_left = -2
    join = lambda a, b: a if a == b and a >= 0 else mixed_left
    for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
        stack = []  # (length, first place, left byte of all)
        for place in range(a, b + 1):
            now = lengths[place] if place < b else 0
            begin, seen = place - 1, left[place - 1]
            while stack and stack[-1][0] > now:
                length, begin, had = stack.pop()
                seen = join(had, seen)
                if seen == mixed_left:
                    yield begin, place - 1, length
                if stack and stack[-1][0] >= now:
                    stack[-1][2] = join(stack[-1][2], seen)
                    seen = stack[-1][2]
            if now:
                if stack and stack[-1][0] == now:
                    stack[-1][2] = join(stack[-1][2], left[place - 1])
                else:
                    stack.append([now, begin, seen])


_SPAN = "doc_id long, h long, start long, stop long"


def recurring_parts(text: np.ndarray, begins: np.ndarray, ends: np.ndarray, least: int):
    """(part, begin, end) of the runs of windows whose hash occurs more than once in the parts."""
    part = np.repeat(np.arange(len(ends)), ends - begins)
    at = np.flatnonzero(np.arange(len(text)) + least <= ends[part])
    sums = prefix_sums(text, 41)
    _, inverse, counts = np.unique((sums[at + least] - sums[at]) * powers(len(text) + 1)[1][at], return_inverse=True, return_counts=True)
    at = at[counts[inverse] > 1]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (part[at[1:]] != part[at[:-1]])
    first = at[new]
    last = at[np.append(new[1:], True)] if len(at) else at
    return part[first], first, last + least


def _scan_bundle(least: int):
    def run(group: pa.Table) -> pa.Table:
        parts = [x.as_buffer() for x in group["bytes"]]
        whole = np.frombuffer(b"".join(parts), np.uint8)
        ends = np.cumsum([len(p) for p in parts])
        begins = ends - np.array([len(p) for p in parts])
        docs, keys, at = (group[c].to_numpy() for c in ("doc_id", "h", "start"))
        # bytes outside recurring windows are in no repeat and are not sorted
        part, first, last = recurring_parts(whole, begins, ends, least)
        if not len(part):
            return pa.table([pa.array(np.zeros(0, np.int64))] * 4, names=["doc_id", "h", "start", "stop"])
        docs, keys, at = docs[part], keys[part], at[part] + first - begins[part]
        text = np.concatenate([whole[a:b] for a, b in zip(first, last, strict=True)])
        ends = np.cumsum(last - first)
        begins = ends - (last - first)
        order, common = suffix_array(text, ends)
        part = np.searchsorted(ends, order, "right")
        doc, key, place = docs[part], keys[part], at[part] + order - begins[part]
        before = np.concatenate([[-1], text[:-1].astype(np.int64)])
        before[begins] = -1  # the window one byte before does not recur here, or belongs to another frame
        out = []
        for a, b, length in maximal_repeats(order, common, before, least):
            d, k, s = doc[a : b + 1], key[a : b + 1], place[a : b + 1]
            later = np.ones(len(d), bool)
            later[np.lexsort((s, k, d))[0]] = False
            out.append((d[later], k[later], s[later], s[later] + length))
        names = ["doc_id", "h", "start", "stop"]
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
        found = pa.table([pa.array(c) for c in columns], names=names)
        return found.group_by(names[:3]).aggregate([("stop", "max")]).rename_columns(names)

    return run


def _windows(length: int):
    """Hashes of single windows of frames; those seen in the batch before are settled."""

    def run(batches):
        for batch in batches:
            for row, data, offsets in slices(batch.column(3)):
                count = np.maximum(0, np.diff(offsets) - length + 1)
                if not count.sum():
                    continue
                which = np.repeat(np.arange(len(count)), count)
                inner = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
                a = offsets[which] + inner
                hashes = []
                for seed in (31, 32):
                    sums = prefix_sums(data, seed)
                    hashes.append(mixed((sums[a + length] - sums[a]) * powers(len(data) + 1)[1][a]))
                doc = batch.column(0).to_numpy()[row + which]
                h = batch.column(1).to_numpy()[row + which]
                start = batch.column(2).to_numpy()[row + which] + inner
                order = np.lexsort((start, h, doc, hashes[1], hashes[0]))
                done = ~_first_of(order, *hashes)
                w1 = np.where(done, mixed(doc[order].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + start[order].astype(np.uint64)), hashes[0][order])
                yield pa.RecordBatch.from_arrays([pa.array(w1.view(np.int64)), pa.array(hashes[1][order].view(np.int64)), pa.array(doc[order]), pa.array(h[order]), pa.array(start[order]), pa.array(done)], names=["w1", "w2", "doc_id", "h", "start", "done"])

    return run


def keyed_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, text) of all rows, and of each different (doc_id, text) once.

    ``h`` tells texts under one doc_id apart; it is 0 where a doc_id has one row.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    again = stored(texts.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", F.lit(True).alias("again")), "repeated-ids")
    if not again.limit(1).count():
        keyed = texts.select("doc_id", F.lit(0).cast("long").alias("h"), "text")
        return keyed, keyed
    texts = texts.join(small_side(again), "doc_id", "left")
    keyed = texts.select("doc_id", F.when(F.col("again"), F.xxhash64("text")).otherwise(F.lit(0).cast("long")).alias("h"), "text", "again")
    once = keyed.filter("again").dropDuplicates(["doc_id", "h"]).unionByName(keyed.filter("again IS NULL"))
    return keyed.drop("again"), once.drop("again")


def repeated_spans(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, h, start, stop): byte ranges, which may overlap, whose union is all that repeats.

    A byte repeats when a string of ``length`` bytes around it also starts earlier: in a
    smaller (doc_id, h), or before it in the same text. ``texts`` are those of
    :func:`keyed_texts`, each once; rows with a null doc_id or text take no part.
    """
    spark = texts.sparkSession
    row = ["doc_id", "h"]
    texts = texts.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length))
    whole = texts.select(*row, F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("stop"))
    # the classes are stored on their own, so that a join on a digest many texts share can be split
    first = stored(whole.groupBy("sha").agg(F.min(F.struct(*row)).alias("first"), F.max(F.struct(*row)).alias("last")).filter("first < last").select("sha", "first"), "copy-classes")
    copies = stored(whole.join(small_side(first, 200_000), "sha").filter(F.struct(*row) > F.col("first")).select(*row, F.lit(0).cast("long").alias("start"), "stop"), "whole-copies")
    rest = texts.join(small_side(copies.select(*row).distinct()), row, "left_anti")
    framed = rest.select(*row, "text").mapInArrow(_framed(length), _FRAME).repartitionByRange("owner", "digest").sortWithinPartitions("owner", "digest", *row, "start")
    found = stored(framed.mapInArrow(_settle, "owner long, doc_id long, h long, start long, n long, done boolean"), "frames")
    release(spark)
    equal = found.filter("done").select(*row, "start", (F.col("start") + F.col("n") + (length - 1)).alias("stop"))
    open_ = found.filter("NOT done")
    lists = open_.groupBy(*row).agg(F.collect_list(F.struct("owner", "start", "n")).alias("frames"))
    read = rest.join(small_side(open_.select(*row).distinct()), row, "left_semi").join(lists, row).select(*row, F.encode("text", "UTF-8").alias("raw"), "frames")
    piece = lambda f: F.struct(f["owner"].alias("owner"), f["start"].alias("start"), F.substring(F.col("raw"), f["start"].cast("int") + 1, (f["n"] + (length - 1)).cast("int")).alias("bytes"))
    pieces = stored(read.select(*row, F.inline(F.transform("frames", piece))), "frame-bytes")
    release(spark)
    owners = pieces.groupBy("owner").agg(F.count("*").alias("n"), F.sum(F.length("bytes")).alias("size"))
    crowded = stored(owners.filter(F.col("n") > CROWD).select("owner"), "crowded")
    bundles = max(1, -(-(pieces.agg(F.sum(F.length("bytes"))).first()[0] or 0) // BUNDLE_BYTES))
    few = pieces.join(small_side(crowded), "owner", "left_anti").withColumn("bundle", F.pmod(F.xxhash64("owner"), F.lit(bundles)))
    groups = few.select("bundle", *row, "start", "bytes").groupBy("bundle").applyInArrow(_scan_bundle(length), _SPAN)
    many = pieces.join(small_side(crowded), "owner", "left_semi").select(*row, "start", "bytes").mapInArrow(_windows(length), "w1 long, w2 long, doc_id long, h long, start long, done boolean")
    here = many.filter("NOT done")
    earliest = here.groupBy("w1", "w2").agg(F.min(F.struct(*row, "start")).alias("one"))
    later = here.join(earliest, ["w1", "w2"]).filter(F.struct(*row, "start") > F.col("one")).select(*row, "start")
    single = many.filter("done").select(*row, "start").union(later).select(*row, "start", (F.col("start") + length).alias("stop"))
    return copies.union(equal).union(stored(groups, "repeat-groups")).union(single)


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, removed (merged start, stop pairs) and kept_sha256, one row per row of ``docs``.

    Null texts count as empty; null doc_ids keep all. Rows that agree in doc_id and text lose
    the same ranges. Different texts under one doc_id are documents of their own, in the order
    of their hashes. Texts may be very long: a task holds slices of them, and the frames that
    may repeat of one text. An empty table gives an empty one.
    """
    texts, once = keyed_texts(docs)
    spans = repeated_spans(once, length)
    lists = stored(spans.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans")), "spans")
    merged = "array<struct<start:long,stop:long>>"
    item = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def cut(batches):
        for batch in batches:
            removed, kept = [], []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                raw, ranges = text.as_py().encode(), []
                for s in spans.as_py():
                    if ranges and s["start"] <= ranges[-1]["stop"]:
                        ranges[-1]["stop"] = max(ranges[-1]["stop"], s["stop"])
                    else:
                        ranges.append(dict(s))
                at = [0, *[x for r in ranges for x in (r["start"], r["stop"])], len(raw)]
                removed.append(ranges)
                kept.append(b"".join(raw[a:b] for a, b in zip(at[::2], at[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, item), pa.array(kept, pa.binary())], names=["doc_id", "removed", "kept"])

    texts = texts.withColumn("text", F.coalesce("text", F.lit("")))
    ids, row = lists.select("doc_id", "h"), ["doc_id", "h"]
    changed = texts.join(small_side(ids), row, "left_semi").join(lists, row).select("doc_id", "text", "spans").mapInArrow(cut, f"doc_id long, removed {merged}, kept binary")
    kept = F.col("c.kept")
    same = texts.join(small_side(ids), row, "left_anti").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.array().cast(merged).alias("removed"), F.sha2("text", 256).alias("kept_sha256"))
    length_of = F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["stop"] - r["start"])
    done = changed.alias("c").select("doc_id", (F.length(kept) + length_of).cast("long").alias("n_bytes"), "removed", F.sha2(kept, 256).alias("kept_sha256"))
    return same.union(done)
