"""Hard negatives from score windows, over Hilbert-ordered blocks with zone maps.

Vectors become whole numbers and are sorted by label and by their place on a Hilbert curve
through all dimensions. Runs of at most ``BLOCK`` neighbours of one label form a block, one row
of a Parquet table, with the smallest and largest value of every dimension (its zone map).
Anchors are packed the same way. For an anchor and a zone map, interval arithmetic gives the
least and the largest inner product that a vector of the block can have; a block is read for
an anchor only where that interval meets one of the anchor's score windows.

Positives: the block of the anchor's label with the largest bound is read first; its fifth
score is the lower end of the window for the other blocks of the label. Negatives: the windows
follow from the positives' scores, over blocks of the other labels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.common import stored

BLOCK = 1024
#: Anchors of one row, zone maps of one row, and blocks that one task scores for a row of anchors.
CHUNK = 2048
ZONES = 512
TILE = 16
#: Bits of a dimension's place on the curve.
BITS = 4
LOW, HIGH = -(2**62), 2**62
PACKED = "block bigint, n bigint, ids binary, labels binary, q binary, lo binary, hi binary"
CHUNKS = "chunk bigint, n bigint, ids binary, labels binary, q binary, windows binary"
NEED = "block bigint, chunk bigint, wanted binary, bound binary"
FOUND = "chunk bigint, at int, w int, id bigint, score bigint"


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of grid ``cells`` (n x dimensions, below 2**bits) on the Hilbert curve, as rows of bytes in order.

    Skilling's transform, all rows at once: the bits of the cells become the curve's index,
    spread over the dimensions; taken bit by bit they are the key.
    """
    x = cells.T.astype(np.int64).copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            swap = np.where(x[i] & q, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(x[i] & q, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= flip
    spread = np.stack([(x >> b) & 1 for b in range(bits - 1, -1, -1)], 1)  # dimensions x bits x rows
    return np.packbits(spread.transpose(2, 1, 0).reshape(x.shape[1], bits * dims).astype(np.uint8), axis=1)


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, q): rows that take part, components as floor(256 * x), every 7th label moved on by one."""
    v = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), v.cast("array<double>").alias("v"))
    rows = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('inf'))")
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dims = lengths["n"] if lengths else 1
    # a score of dims products must stay below 2**62 to be a long
    most = float(math.isqrt((2**62 - 1) // dims))
    q = F.transform("v", lambda x: F.floor(x * 256))
    rows = rows.filter((F.size("v") == dims) & ~F.exists("v", lambda x: F.abs(x * 256) > most - 1))
    return rows.select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), q.cast("array<long>").alias("q"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.int64).reshape(len(column), -1)


def _keyed(low: list[int], high: list[int]):
    floor = np.array(low, dtype=np.float64)
    width = np.maximum(np.array(high, dtype=np.float64) - floor, 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                cells = ((_matrix(b["q"]) - floor) / width * ((1 << BITS) - 1)).astype(np.int64)
                keys = [k.tobytes() for k in hilbert_keys(cells, BITS)]
                yield pa.RecordBatch.from_arrays([b["vec_id"], b["label"], b["q"], pa.array(keys, pa.binary())], names=["vec_id", "label", "q", "key"])

    return run


def on_curve(rows: DataFrame) -> DataFrame:
    """``rows`` with their key on the Hilbert curve; each dimension's range is taken from all rows."""
    ends = rows.select(F.posexplode("q")).groupBy("pos").agg(F.min("col"), F.max("col")).orderBy("pos").collect()  # a row a dimension
    return rows.mapInArrow(_keyed([r[1] for r in ends], [r[2] for r in ends]), "vec_id bigint, label int, q array<bigint>, key binary")


def _pack(size: int, by_label: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, labels = np.zeros(0, np.int64), None, np.zeros(0, np.int64)
        number = TaskContext.get().partitionId() << 32

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            """Full blocks; the rest stays unless it is the last."""
            nonlocal ids, q, labels, number
            at = 0
            while at < len(ids):
                end = min(at + size, at + int(np.searchsorted(labels[at:], labels[at], "right")) if by_label else len(ids))
                if end == len(ids) and end - at < size and not last:
                    break
                order = np.argsort(ids[at:end], kind="stable") + at
                part = q[order].astype(np.int32)
                row = [number, end - at, *(x.tobytes() for x in (ids[order], labels[order].astype(np.int32), part, part.min(0), part.max(0)))]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.int64()] * 2 + [pa.binary()] * 5, strict=True)], names=[c.split()[0] for c in PACKED.split(", ")])
                number, at = number + 1, end
            ids, q, labels = ids[at:], q[at:], labels[at:]

        for b in batches:
            if len(b):
                ids, labels = np.append(ids, b["vec_id"].to_numpy()), np.append(labels, b["label"].to_numpy())
                q = _matrix(b["q"]) if q is None else np.concatenate([q, _matrix(b["q"])])
                yield from cut(False)
        if len(ids):
            yield from cut(True)

    return run


def packed(rows: DataFrame, size: int, count: int, by_label: bool = True) -> DataFrame:
    """Blocks of at most ``size`` neighbours (of one label), rows by vec_id, with their zone map.

    ``count``: how many ``rows`` there are. They are dealt by ranges of (label, key, vec_id), so a
    label or a vector with very many rows goes to several tasks.
    """
    parts = max(1, min(4096, count // (4 * size)))
    dealt = rows.repartitionByRange(parts, "label", "key", "vec_id").sortWithinPartitions("label", "key", "vec_id")
    return dealt.select("vec_id", "label", "q").mapInArrow(_pack(size, by_label), PACKED)


def product_bounds(anchors: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each anchor with any vector of each zone (lo, hi), by interval arithmetic.

    Sums are rounded, so both bounds are moved outwards by more than the rounding.
    """
    plus, minus = np.maximum(anchors, 0).astype(np.float64), np.minimum(anchors, 0).astype(np.float64)
    lo, hi = lo.astype(np.float64), hi.astype(np.float64)
    least, most = plus @ lo.T + minus @ hi.T, plus @ hi.T + minus @ lo.T
    slack = 1e-12 * (np.abs(anchors).astype(np.float64) @ np.maximum(np.abs(lo), np.abs(hi)).T)
    return least - slack, most + slack


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products as integers; by floating point where no sum can be rounded."""
    if len(a) and len(b) and a.shape[1] * float(np.abs(a).max()) * float(np.abs(b).max()) < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _ids(value: bytes) -> np.ndarray:
    return np.frombuffer(value, dtype=np.int64)


def _numbers(value: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(value, dtype=np.int32).astype(np.int64).reshape(rows, -1)


def _choose(same: bool, best: bool):
    """(block, chunk, wanted, bound): for each chunk of anchors and row of zones, the blocks whose bounds meet a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                n, blocks = r["n"], r["zones"]
                zone_labels = np.array([int.from_bytes(z["labels"][:4], "little", signed=True) for z in blocks])
                fits = (_numbers(r["labels"], n) == zone_labels) == same
                lo, hi = (np.concatenate([_numbers(z[c], 1) for z in blocks]) for c in ("lo", "hi"))
                least, most = product_bounds(_numbers(r["q"], n), lo, hi)
                most = np.where(fits, most, -np.inf)
                if best:
                    wanted = np.zeros(most.shape, bool)
                    wanted[np.arange(n), most.argmax(1)] = True
                    wanted &= fits
                else:
                    windows = _ids(r["windows"]).reshape(n, -1, 2)
                    wanted = np.zeros(most.shape, bool)
                    for w in range(windows.shape[1]):
                        wanted |= (most >= windows[:, w, :1]) & (least <= windows[:, w, 1:]) & (windows[:, w, :1] <= windows[:, w, 1:])
                rows = [(z["block"], r["chunk"], np.packbits(wanted[:, k]).tobytes(), most[:, k].tobytes() if best else b"") for k, z in enumerate(blocks) if wanted[:, k].any()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.binary(), pa.binary()], strict=True)], names=["block", "chunk", "wanted", "bound"])

    return run


def _merge(held: dict, n: int, k: int, w: int, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
    """Adds (anchor, id, score) to what is held for window ``w`` and keeps the first ``k`` of each anchor."""
    if w in held:
        rows, ids, scores = (np.concatenate(x) for x in zip(held[w], (rows, ids, scores), strict=True))
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    first = np.searchsorted(rows, np.arange(n))
    keep = np.arange(len(rows)) - first[rows] < k
    held[w] = (rows[keep], ids[keep], scores[keep])


def _score(same: bool, k: int):
    """The first ``k`` of every window of every anchor of the chunks, over the blocks of a tile."""

    def run(chunks: pa.Table, blocks: pa.Table) -> pa.Table:
        vectors = {r["block"]: r for r in blocks.to_pylist()}
        out = []
        for r in chunks.to_pylist():
            n, own, held = r["n"], _ids(r["ids"]), {}
            anchors, windows = _numbers(r["q"], n), _ids(r["windows"]).reshape(n, -1, 2)
            for one in r["reads"]:
                at = np.flatnonzero(np.unpackbits(np.frombuffer(one["wanted"], np.uint8), count=n))
                block = vectors[one["block"]]
                ids = _ids(block["ids"])
                for part in np.array_split(at, -(-len(at) // 256)):  # a bounded matrix of scores at a time
                    bounds = windows[part]
                    scores = exact_products(anchors[part], _numbers(block["q"], len(ids)))
                    meets = (scores >= bounds[:, :, 0].min(1)[:, None]) & (scores <= bounds[:, :, 1].max(1)[:, None])
                    if same:
                        meets &= ids[None, :] != own[part][:, None]
                    rows, columns = np.nonzero(meets)
                    found = scores[rows, columns]
                    for w in range(windows.shape[1]):
                        inside = (found >= bounds[rows, w, 0]) & (found <= bounds[rows, w, 1])
                        _merge(held, n, k, w, part[rows[inside]], ids[columns[inside]], found[inside])
            out += [(np.full(len(rows), r["chunk"]), rows.astype(np.int32), np.full(len(rows), w, np.int32), ids, scores) for w, (rows, ids, scores) in held.items()]
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()], strict=True)], names=[c.split()[0] for c in FOUND.split(", ")])

    return run


def _first(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("chunk", "at", "w").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


class Blocks:
    """The stored blocks, their zone maps in rows of about ``ZONES``, and searches for windows of scores."""

    def __init__(self, rows: DataFrame, count: int, block: int = BLOCK):
        self.table = stored(packed(rows, block, count), "blocks")
        n = self.table.count()
        self.tiles, self.zone_rows = max(1, n // TILE), max(1, n // ZONES)
        zone = F.pmod(F.xxhash64("block"), F.lit(self.zone_rows))
        self.zones = stored(self.table.groupBy(zone.alias("zone")).agg(F.collect_list(F.struct("block", "labels", "lo", "hi")).alias("zones")), "zones")

    def wanted(self, chunks: DataFrame, same: bool, best: bool = False) -> DataFrame:
        """(block, chunk, wanted): which anchors of a chunk must read a block, as bits."""
        sent = chunks.drop("ids").withColumn("zone", F.explode(F.sequence(F.lit(0), F.lit(self.zone_rows - 1))))
        need = sent.join(self.zones, "zone").select("chunk", "n", "labels", "q", "windows", "zones").mapInArrow(_choose(same, best), NEED)
        return need.groupBy("chunk").applyInArrow(_one_block, NEED) if best else need

    def search(self, chunks: DataFrame, need: DataFrame, same: bool, k: int) -> DataFrame:
        """(chunk, at, w, id, score): the first ``k`` rows, in every tile of blocks, inside each window of each anchor.

        A tile is a chunk of anchors with about ``TILE`` of the blocks it must read.
        """
        need = need.select("chunk", "block", "wanted", F.pmod(F.xxhash64("block"), F.lit(self.tiles)).alias("tile"))
        reads = need.groupBy("chunk", "tile").agg(F.collect_list(F.struct("block", "wanted")).alias("reads"))
        anchors = reads.join(chunks.select("chunk", "n", "ids", "q", "windows"), "chunk")
        blocks = need.select("block", F.col("chunk").alias("of"), F.col("tile").alias("part")).join(self.table.select("block", "ids", "q"), "block")
        return anchors.groupBy("chunk", "tile").cogroup(blocks.groupBy("of", "part")).applyInArrow(_score(same, k), FOUND)


def _one_block(need: pa.Table) -> pa.Table:
    """Of the best blocks of each row of zones, the best of all for each anchor of the chunk."""
    need = need.sort_by("block")
    bounds = np.stack([np.frombuffer(x, np.float64) for x in need["bound"].to_pylist()])
    bits = np.stack([np.unpackbits(np.frombuffer(x, np.uint8), count=bounds.shape[1]) for x in need["wanted"].to_pylist()]).astype(bool)
    chosen = np.zeros_like(bits)
    chosen[np.where(bits, bounds, -np.inf).argmax(0), np.arange(bounds.shape[1])] = True
    chosen &= bits
    rows = np.flatnonzero(chosen.any(1))
    return need.take(rows).set_column(2, "wanted", pa.array([np.packbits(x).tobytes() for x in chosen[rows]], pa.binary())).set_column(3, "bound", pa.array([b""] * len(rows), pa.binary()))


def _with_windows(chunks: DataFrame, found: DataFrame, per_anchor: int, window) -> DataFrame:
    """``chunks`` with ``per_anchor`` windows an anchor, from the scores of each anchor's rows in ``found``."""

    def pack(frame: pa.Table, own: pa.Table) -> pa.Table:
        n = frame["n"][0].as_py()
        scores = [[] for _ in range(n)]
        for at, _, score in sorted(zip(own["at"].to_pylist(), own["rank"].to_pylist(), own["score"].to_pylist(), strict=True)):
            scores[at].append(score)
        rows = [[w for x in window(s, per_anchor) for w in x] for s in scores]
        return frame.append_column("windows", pa.array([np.array(rows, np.int64).tobytes()], pa.binary()))

    return chunks.groupBy("chunk").cogroup(found.select("chunk", "at", "rank", "score").groupBy("chunk")).applyInArrow(pack, CHUNKS)


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100), block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of each anchor and positive.

    Anchors are rows whose vec_id is divisible by ``every``; positives their first
    ``positives`` other rows of the same label by score, then vec_id; negatives the first
    ``negatives`` rows of other labels with share[0] * positive_score <= share[1] *
    negative_score <= share[1] * positive_score. Every result is exact: bounds only spare
    reading blocks that hold nothing of a window.

    Only vec_id, embedding and label are read, so other columns may have any name. Rows with a
    null label, vec_id or vector, with null or non-finite components, of another length than
    the commonest, or with components so large that a score could leave 64 bits (about 10**6 at
    64 dimensions) take no part. Exact repeats of a row count once; different rows under one
    vec_id are candidates each, but no row is its own vec_id's positive. Ties go to the smaller
    vec_id; an anchor without positives gives no rows; an empty table gives an empty one.
    """
    rows = stored(on_curve(stored(whole_numbers(vectors).distinct(), "numbers")), "keyed")
    count = rows.count()
    blocks = Blocks(rows, count, block)
    chosen = packed(rows.filter(F.col("vec_id") % every == 0), chunk, count // every, by_label=False)
    chunks = stored(chosen.withColumnRenamed("block", "chunk").drop("lo", "hi"), "anchors")

    def from_last(scores: list[int], _: int) -> list[tuple[int, int]]:
        return [(scores[-1] if len(scores) == positives else LOW, HIGH)]

    def around(scores: list[int], n: int) -> list[tuple[int, int]]:
        return [(-((-share[0] * p) // share[1]), p) for p in scores] + [(HIGH, LOW)] * (n - len(scores))

    anything = chunks.withColumn("windows", F.unhex(F.repeat(F.lit(np.array([LOW, HIGH], np.int64).tobytes().hex()), F.col("n").cast("int"))))
    seeds = stored(blocks.search(anything, blocks.wanted(anything, True, best=True), True, positives), "seeds")
    # a seed block is read again where its bound meets the window: its rows are the same rows
    open_end = stored(_with_windows(chunks, _first(seeds, positives), 1, from_last), "open_end")
    others = blocks.search(open_end, blocks.wanted(open_end, True), True, positives)
    near = stored(_first(seeds.union(others).distinct(), positives), "positives")
    windows = stored(_with_windows(chunks, near, positives, around), "windows")
    hard = _first(blocks.search(windows, blocks.wanted(windows, False), False, negatives), negatives)
    pairs = near.select("chunk", "at", (F.col("rank") - 1).alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = hard.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(pairs, ["chunk", "at", "w"]).join(anchor_names(chunks), ["chunk", "at"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def anchor_names(chunks: DataFrame) -> DataFrame:
    """(chunk, at, anchor_id) of every anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, ids in zip(b["chunk"].to_pylist(), b["ids"].to_pylist(), strict=True):
                own = _ids(ids)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), chunk)), pa.array(np.arange(len(own), dtype=np.int32)), pa.array(own)], names=["chunk", "at", "anchor_id"])

    return chunks.select("chunk", "ids").mapInArrow(run, "chunk bigint, at int, anchor_id bigint")


#: The contract as SQL: every anchor against every row.
SQL = """
WITH rows AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same,
         CAST(list_sum(list_transform(list_zip(a.q, r.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM rows a JOIN rows r ON a.vec_id <> r.vec_id
  WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
       s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) <= 5
"""
