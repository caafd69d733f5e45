"""Nearest neighbours by inner product: inverted lists scanned in column blocks.

Vectors get one more component so that all have the same length; the nearest by distance
are then the largest inner products. A random rotation spreads what tells vectors apart
over all components, so the distance over the first components estimates the whole one.
Inside a list a block of components is added for all candidates, then a hypothesis test
drops those whose partial distance is too large for the query's current k-th distance; what
is left is compared on the original vectors in double precision.

The index: k-means centres on a bounded sample, and every vector in the list of its nearest
centre. Lists are bundled or cut to groups of about ``GROUP`` vectors, queries to blocks of
``BLOCK``, so no task holds a whole list, whatever its size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.common import stored

SAMPLE = 16_384
LISTS = 1024
PER_LIST = 128
GROUP = 2048
BLOCK = 512
PROBED = 0.7
COLUMNS = 16
EPSILON = 2.1
SEED = 11


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): vectors of the commonest length without null or non-finite parts, not all zero."""
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (lengths["n"] if lengths else 0))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dims)


class Index:
    """Rotation, longest length and centres: a few thousand small vectors at most."""

    def __init__(self, sample: np.ndarray, longest: float, lists: int, rounds: int = 12):
        rng = np.random.default_rng(SEED)
        self.dims, self.longest = sample.shape[1], longest
        self.rotation = np.linalg.qr(rng.normal(size=(self.dims + 1, self.dims + 1)))[0]
        x = self.rotated(sample)
        self.centres = x[rng.permutation(len(x))[:lists]].copy()
        for _ in range(rounds):
            near = self.order(x, 1)[:, 0]
            for k in np.unique(near):
                self.centres[k] = x[near == k].mean(0)

    def rotated(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, self.longest**2 - (x * x).sum(1)))
        return np.column_stack([x, rest]) @ self.rotation

    def order(self, x: np.ndarray, n: int) -> np.ndarray:
        """Numbers of the ``n`` nearest centres of rotated vectors, nearest first."""
        far = (self.centres**2).sum(1) - 2 * x @ self.centres.T
        part = np.argpartition(far, n - 1, axis=1)[:, :n] if n < len(self.centres) else np.tile(np.arange(len(self.centres)), (len(x), 1))
        return np.take_along_axis(part, np.argsort(np.take_along_axis(far, part, 1), axis=1, kind="stable"), 1)


def build(rows: DataFrame, sample: int = SAMPLE, lists: int = LISTS) -> Index | None:
    """Index fitted on at most ``sample`` vectors (hash order); None if there is no vector."""
    facts = rows.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    if not facts[0]:
        return None
    picked = rows.orderBy(F.xxhash64(F.lit(SEED), "vec_id"), "vec_id").limit(sample).collect()
    return Index(np.array([r["v"] for r in picked]), float(facts[1]) ** 0.5, min(lists, max(1, facts[0] // PER_LIST), len(picked)))


def scan(index: Index, q: np.ndarray, q_ids, q_lists, least, x: np.ndarray, x_ids, x_lists, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query number, vec_ids, scores) of the best candidates of every query in one group.

    ``least`` are scores the queries have reached elsewhere (-inf: none); lower ones are
    not looked for.
    """
    a, b = index.rotated(q), index.rotated(x)
    dims = a.shape[1]
    wanted = np.zeros((len(q), len(index.centres)), bool)
    for i, probed in enumerate(q_lists):
        wanted[i, probed] = True
    open_ = wanted[:, x_lists] & (q_ids[:, None] != x_ids[None, :])
    # the first candidates are measured in full and give every query its first k-th distance
    first = np.arange(min(len(x), 8 * k))
    far = ((a**2).sum(1)[:, None] + (b[first] ** 2).sum(1)[None, :]) - 2 * a @ b[first].T
    far[~open_[:, first]] = np.inf
    known = 2 * index.longest**2 - 2 * least
    known = known + 1e-9 * (1 + np.abs(known))
    limit = np.minimum(known, np.partition(far, k - 1, axis=1)[:, k - 1] if len(first) >= k else np.inf)
    partial, columns = np.zeros((len(q), len(x))), np.arange(len(x))
    for at in range(0, dims, COLUMNS):
        part = slice(at, min(dims, at + COLUMNS))
        y = b[columns, part]
        partial = partial[:, :] + (a[:, part] ** 2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * a[:, part] @ y.T
        seen = part.stop
        if seen < dims:
            open_ &= partial <= (limit * seen / dims * (1 + EPSILON / seen**0.5) ** 2)[:, None]
        kept = open_.any(0)
        if not kept.all():
            partial, open_, columns = partial[:, kept], open_[:, kept], columns[kept]
    partial[~open_ | (partial > known[:, None])] = np.inf
    for i in range(len(q)):
        row = partial[i]
        n = int(np.isfinite(row).sum())
        if not n:
            continue
        edge = np.partition(row, k - 1)[k - 1] if n > k else np.inf
        chosen = columns[np.flatnonzero((row <= edge + 1e-9 * (1 + abs(edge))) & np.isfinite(row) if n > k else np.isfinite(row))]
        score = (x[chosen] * q[i]).sum(1)
        best = np.lexsort((x_ids[chosen], -score))[:k]
        yield i, x_ids[chosen][best], score[best]


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, probed: float = PROBED) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every query, nearest first.

    Queries are the vectors whose vec_id is divisible by ``every``; candidates all others.
    Scores are inner products in double precision on the original vectors; ties go to the
    smaller vec_id. Vectors that are null, zero, of another length or with null or
    non-finite parts, and those without vec_id, take no part. Fewer than ``k`` candidates
    are all returned, for a table with so few vectors that there is one list. An empty
    table gives no rows. Of embeddings only vec_id and embedding are read.
    """
    rows = valid(vectors)
    spark = rows.sparkSession
    result = "query_id long, vec_id long, score double"
    index = build(rows)
    if index is None:
        return spark.createDataFrame([], result).select("query_id", F.lit(0).alias("rank"), "vec_id", "score")
    shared = spark.sparkContext.broadcast(index)
    probes = min(len(index.centres), math.ceil(probed * len(index.centres)) + 2)

    def assign(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            order = shared.value.order(shared.value.rotated(_matrix(batch.column(1), shared.value.dims)), probes)
            asked = [o.tolist() if i % every == 0 else None for i, o in zip(ids, order, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(order[:, 0], pa.int32()), pa.array(asked, pa.list_(pa.int32()))], names=["vec_id", "v", "list", "asked"])

    placed = stored(rows.select("vec_id", "v").mapInArrow(assign, "vec_id long, v array<double>, list int, asked array<int>"), "lists")
    # one row per list: small lists share a group, large ones are cut
    groups, bundle, filled = [], 0, 0
    for number, n in sorted(tuple(r) for r in placed.groupBy("list").count().collect()):
        if filled and filled + n > GROUP:
            bundle, filled = bundle + 1, 0
        groups.append((number, bundle, max(1, -(-n // GROUP))))
        filled += n
    bundles, cuts = [0] * len(index.centres), [1] * (bundle + 1)
    for number, own, n in groups:
        bundles[number], cuts[own] = own, max(cuts[own], n)
    numbers = lambda values: F.array(*[F.lit(v) for v in values])
    x = placed.select(F.get(numbers(bundles), F.col("list")).alias("bundle"), "vec_id", "v", "list")
    x = x.withColumn("cut", F.pmod(F.xxhash64("vec_id"), F.get(numbers(cuts), F.col("bundle"))).cast("int"))
    asked = placed.filter(F.col("asked").isNotNull()).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "asked")
    blocks = max(1, -(-asked.count() // BLOCK))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    q = asked.select("*", block.alias("block"), F.explode(F.array_distinct(F.transform("asked", lambda i: F.get(numbers(bundles), i)))).alias("q_bundle"))
    q = q.withColumn("q_cut", F.explode(F.sequence(F.lit(0), F.get(numbers(cuts), F.col("q_bundle")) - 1)))
    x = x.withColumn("in_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, found = [], ([], [])
        if left.num_rows and right.num_rows:
            i, dims = shared.value, shared.value.dims
            q_ids, x_ids = left["query_id"].to_numpy(), right["vec_id"].to_numpy()
            least = np.nan_to_num(left["least"].to_numpy(), nan=-np.inf)
            grid = scan(i, _matrix(left["q"].combine_chunks(), dims), q_ids, left["asked"].to_pylist(), least, _matrix(right["v"].combine_chunks(), dims), x_ids, right["list"].to_numpy(), k)
            for n, vec_ids, scores in grid:
                ids += [q_ids[n]] * len(vec_ids)
                found[0].extend(vec_ids)
                found[1].extend(scores)
        return pa.table({"query_id": pa.array(ids, pa.int64()), "vec_id": pa.array(found[0], pa.int64()), "score": pa.array(found[1], pa.float64())})

    def scanned(queries: DataFrame) -> DataFrame:
        return queries.groupBy("q_bundle", "q_cut", "block").cogroup(x.groupBy("bundle", "cut", "in_block")).applyInArrow(run, result)

    def ranked(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    # the group of the nearest list first: its k-th score is the limit in all other groups
    home = F.col("q_bundle") == F.get(numbers(bundles), F.get("asked", F.lit(0)))
    near = stored(ranked(scanned(q.filter(home).withColumn("least", F.lit(None).cast("double")))), "near")
    reached = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    more = scanned(q.filter(~home).join(reached, "query_id", "left"))
    return ranked(near.select("query_id", "vec_id", "score").union(more))
