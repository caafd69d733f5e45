"""Mixture-controlled packing: deficit round-robin over source queues.

Documents are dealt to shards of about ``shard_bytes`` by a hash. In a shard every source
has a queue of documents. Each window of ``window`` tokens adds the source's share of the
window to its deficit; the sources with the largest deficits send tokens until the window
is full, and what a source is owed or has sent too much goes on to the next window. The
first window of a shard starts with the deficits of the shards before it in its train of
``TRAIN`` shards. Every token is packed once; the tokens left at the end of a shard are cut
into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import base64
import json
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRAIN = 256
#: The white space of the vocabulary's own splitting rule, as character ranges.
BLANK = "\t-\r \x85\xa0  -     　"
UNIT = re.compile(f" ?[^{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")
EDGE = re.compile(f"(?<=[^{BLANK}])(?=[{BLANK}])")
SCHEMA = "doc_id bigint, source string, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


class Tokens(dict):
    """Encodings of space-delimited units, little-endian 32-bit ids as bytes.

    The vocabulary splits a text into pieces that never reach over the edge between a
    character and white space after it, so the encoding of a text is that of its units one
    after another. At most ``limit`` units are kept. ``added`` are tokens that stand for their
    own string wherever it occurs in a text; what lies between them is encoded by itself.
    """

    def __init__(self, path: str, pattern: str, added: dict[str, int], limit: int = 300_000):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}
        self.encoder = tiktoken.Encoding("units", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.limit = limit
        self.added = {t: array("I", [i]).tobytes() for t, i in added.items()}
        self.cut = re.compile("|".join(f"({re.escape(t)})" for t in sorted(added, key=len, reverse=True))) if added else None

    def __missing__(self, unit: str) -> bytes:
        value = array("I", self.encoder.encode_ordinary(unit)).tobytes()
        if len(self) >= self.limit:
            self.clear()
        if len(unit) <= 64:
            self[unit] = value
        return value

    def encode(self, text: str) -> bytes:
        """Ids of the text, its added tokens first taken out."""
        if self.cut is None or not any(t in text for t in self.added):
            return self._between(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self._between(text[at : m.start()]), self.added[m[0]]]
            at = m.end()
        return b"".join([*out, self._between(text[at:])])

    def _between(self, text: str) -> bytes:
        """Ids of a text without added tokens; long ones go in slices that end where a unit ends."""
        out, at = [], 0
        while at < len(text):
            end = len(text)
            if end - at > 1 << 20:
                edge = EDGE.search(text, at + (1 << 20))
                end = edge.start() if edge else end
            out.append(b"".join(map(self.__getitem__, UNIT.findall(text, at, end))))
            at = end
        return b"".join(out)


_tokens: dict[str, Tokens] = {}


def tokens(path: str | None, definition: str | None = None) -> Tokens:
    """The encoder of this worker for the rank file ``path`` and the added tokens of ``definition``.

    By default both are files of the public byte BPE; a rank file alone has no added tokens.
    """
    import public_tokenizers

    if path is None:
        path, definition = public_tokenizers.path("byte_bpe_50k.tiktoken"), definition or public_tokenizers.path("byte_bpe_50k.json")
    if path not in _tokens:
        added = {}
        if definition:
            with open(definition, encoding="utf-8") as f:
                added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        _tokens[path] = Tokens(path, public_tokenizers.PATTERN, added)
    return _tokens[path]


def fill_windows(queues: dict, shares: dict, carry: dict, window: int, quantum: int) -> Iterator[tuple]:
    """(source, document, start, length, window number, offset) of every piece, by deficits.

    ``queues``: source -> list of (document, tokens). A source sends what it is owed, but
    at least ``quantum`` tokens, as far as its head document and the window allow.
    """
    names = [s for s in queues if queues[s]]
    owed = {s: carry.get(s, 0.0) for s in names}
    heads = {s: [0, 0] for s in names}
    number = offset = 0
    left = {s: sum(n for _, n in queues[s]) for s in names}
    while names:
        weight = sum(shares.get(s, 0.0) for s in names) or 1.0
        for s in names:
            owed[s] += window * shares.get(s, 0.0) / weight
        offset = 0
        while offset < window and names:
            s = max(names, key=owed.__getitem__)
            head = heads[s]
            doc, n = queues[s][head[0]]
            size = min(window - offset, n - head[1], max(quantum, int(owed[s])))
            yield s, doc, head[1], size, number, offset
            owed[s] -= size
            offset += size
            head[1] += size
            left[s] -= size
            if head[1] == n:
                head[0] += 1
                head[1] = 0
                if not left[s]:
                    names.remove(s)
        number += 1


def binary_parts(total: int) -> list[int]:
    """Powers of two, largest first, that add up to ``total``."""
    return [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]


def _pack_shard(window: int, quantum: int, end_id: int, path: str | None):
    end = array("I", [end_id]).tobytes()

    def pack(docs: pa.Table, carried: pa.Table) -> pa.Table:
        encode = tokens(path).encode
        c = carried.to_pydict()
        shares = dict(zip(c["queue"], c["share"], strict=True))
        carry = dict(zip(c["queue"], c["owed"], strict=True))
        d = docs.sort_by([("src", "ascending"), ("h", "ascending"), ("doc_id", "ascending")])
        coded, queues, n_bytes = [], {}, 0
        for i, (src, text) in enumerate(zip(d["src"], d["text"], strict=True)):
            t = text.as_py() or ""
            n_bytes += len(t)
            coded.append(encode(t) + end)
            queues.setdefault(src.as_py(), []).append((i, len(coded[-1]) // 4))
        total = sum(len(b) for b in coded) // 4
        per_byte = total / max(1, n_bytes)
        carry = {s: v * per_byte for s, v in carry.items()}
        full, tail = divmod(total, window)
        edges = [0]
        for part in binary_parts(tail):
            edges.append(edges[-1] + part)
        base = (c["of"][0] if c["of"] else 0) << 32
        doc_ids, sources = d["doc_id"].to_pylist(), d["source"].to_pylist()
        rows = []
        for _, i, start, size, number, offset in fill_windows(queues, shares, carry, window, quantum):
            cuts = [(number, offset, size)]
            if number == full:  # the tail, cut at powers of two
                cuts = [(full + k, max(offset, a) - a, min(offset + size, b) - max(offset, a)) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if offset < b and a < offset + size]
            for sequence, place, n in cuts:
                rows.append((doc_ids[i], sources[i], start, n, len(coded[i]) // 4, base + sequence, place, coded[i][4 * start : 4 * (start + n)]))
                start += n
        columns = list(zip(*rows, strict=True)) or [()] * 8
        types = [pa.int64(), pa.string(), *[pa.int64()] * 5, pa.binary()]
        return pa.table([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return pack


def _size(text: Column) -> Column:
    return F.coalesce(F.length(text), F.lit(0)) + 1


def pack(docs: DataFrame, weights: dict[str, float] | None = None, window: int = 1024, quantum: int = 256, shard_bytes: int = 2 << 20, path: str | None = None, end_id: int = 0) -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` tokens.

    Columns: doc_id, source, start, length, doc_tokens, sequence_id, offset, ids (the
    piece's ids, little-endian unsigned 32-bit). ``weights`` are the target token
    proportions; by default each source's share of all characters. A source without a
    weight is packed when the others are used up. Only doc_id, text and source are read.
    A null or empty text is its end id alone; null sources are one queue; null doc_ids and
    repeated rows are packed like others. An empty table gives no pieces. Windows differ
    from run to run only if rows agree in doc_id, text and source.
    """
    src = F.coalesce(F.concat(F.lit("1"), "source"), F.lit("2"))
    h = F.xxhash64("doc_id", "text")
    spark = docs.sparkSession
    total = docs.agg(F.sum(_size(F.col("text")))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    keyed = docs.select("doc_id", "source", "text", src.alias("src"), h.alias("h"), F.pmod(h, F.lit(shards)).alias("shard"))
    parts = keyed.groupBy("shard", "src").agg(F.sum(_size(F.col("text"))).cast("double").alias("n"))
    if weights is None:
        share = parts.groupBy("src").agg((F.sum("n") / max(1, total)).alias("share"))
    else:
        share = spark.createDataFrame([("1" + k, float(v)) for k, v in weights.items()], "src string, share double")
    train = parts.join(share, "src", "left").fillna(0.0, ["share"]).withColumn("train", F.expr(f"shard div {TRAIN}"))
    before = Window.orderBy("shard").rangeBetween(Window.unboundedPreceding, -1)
    all_before = train.groupBy("train", "shard").agg(F.sum("n").alias("n")).select("shard", F.coalesce(F.sum("n").over(before.partitionBy("train")), F.lit(0.0)).alias("all_before"))
    own = F.coalesce(F.sum("n").over(before.partitionBy("train", "src")), F.lit(0.0))
    owed = train.withColumn("own", own).join(all_before, "shard").select("shard", "src", "share", (F.col("share") * F.col("all_before") - F.col("own")).alias("owed"))
    owed = owed.select(F.col("shard").alias("of"), F.col("src").alias("queue"), "share", "owed")
    return keyed.groupBy("shard").cogroup(owed.groupBy("of")).applyInArrow(_pack_shard(window, quantum, end_id, path), SCHEMA)
