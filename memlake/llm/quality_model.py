"""Quality classifier: random-indexing vectors pooled per document, a small network, calibrated.

1. Words, their character shapes and their endings are hashed to ``sum(BUCKETS)`` units.
   Every unit has a sparse random index vector; its own vector is the sum of the index
   vectors beside it over *all* documents. Each task adds up its part of that table, whose
   size is fixed, and Spark sums the parts per unit.
2. A document is the mean of the unit vectors of its words, with its length, the share of
   distinct words and the share of words equal to the one before.
3. A network with one hidden layer learns from at most ``FIT_ROWS`` labelled rows; a
   temperature fitted on a part that was kept back calibrates its probabilities.

The text is read twice and never shuffled; what the driver holds (the table of units, the
bounded sample, the network) has a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.textbytes import codes, mixed, prefix_sums, slices, span_hashes, words
from memlake.session import cut_lineage

BUCKETS = (4096, 1024, 1024)  # words, shapes, endings
DIMS = 32
NONZERO = 4
REACH = 2
FIT_ROWS = 20_000
HIDDEN = 32
SEED = 7
FEATURES = DIMS * len(BUCKETS) + 3

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58], _SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:] = 48, 65, 97, 97


def _units(data, offsets):
    """Unit numbers (one row per kind), word hashes and word counts of texts."""
    starts, ends, bounds = words(data, offsets)
    own = mixed(span_hashes(prefix_sums(data, 1), starts, ends))
    shape = _SHAPE[data]
    new = np.ones(len(data), bool)
    new[1:] = shape[1:] != shape[:-1]
    new[starts] = True
    at = np.concatenate([[0], np.cumsum(new)])
    shapes = mixed(span_hashes(prefix_sums(shape[new], 2), at[starts], at[ends]))
    tail = np.zeros(len(starts), np.uint64)
    for k in range(1, 4):
        tail = tail * np.uint64(31) + np.where(ends - k >= starts, codes(3)[data[np.maximum(ends - k, 0)]], np.uint64(k))
    kinds, base = [], 0
    for h, size in zip((own, shapes, mixed(tail)), BUCKETS, strict=True):
        kinds.append((h % np.uint64(size)).astype(np.int64) + base)
        base += size
    return kinds, own, bounds


def _index_vectors():
    """Places and signs of the non-zero elements of every unit's index vector."""
    rng = np.random.default_rng(SEED)
    n = sum(BUCKETS)
    return rng.integers(0, DIMS, (n, NONZERO)), rng.choice([-1.0, 1.0], (n, NONZERO))


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of neighbouring index vectors per unit, over the texts of one task."""
    place, sign = _index_vectors()
    n = sum(BUCKETS)
    total = np.zeros(n * DIMS)
    for batch in batches:
        for _, data, offsets in slices(batch.column(0)):
            kinds, _, bounds = _units(data, offsets)
            doc = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
            for unit in kinds:
                for step in range(1, REACH + 1):
                    beside = doc[step:] == doc[:-step]
                    a, b = unit[step:][beside], unit[:-step][beside]
                    for me, other in ((a, b), (b, a)):
                        for k in range(NONZERO):
                            total += np.bincount(me * DIMS + place[other, k], sign[other, k], n * DIMS)
    rows = total.reshape(n, DIMS).astype(np.int64)
    used = np.flatnonzero(rows.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(rows[used, j]) for j in range(DIMS)]], names=["unit", *[f"v{j}" for j in range(DIMS)]])


def unit_vectors(docs: DataFrame) -> np.ndarray:
    """Vectors of all units, of length 1 or zero; a table of fixed size."""
    names = [f"v{j}" for j in range(DIMS)]
    parts = docs.select("text").mapInArrow(_gather, "unit bigint, " + ", ".join(f"{c} bigint" for c in names))
    out = np.zeros((sum(BUCKETS), DIMS), np.float32)
    for r in parts.groupBy("unit").agg(*[F.sum(c).alias(c) for c in names]).collect():
        out[r[0]] = r[1:]
    return out / np.maximum(1e-9, np.linalg.norm(out, axis=1, keepdims=True))


def features(data, offsets, table) -> np.ndarray:
    """Pooled features of texts; all zero for a text without words."""
    kinds, own, bounds = _units(data, offsets)
    n = np.diff(bounds)
    out = np.zeros((len(n), FEATURES), np.float32)
    some = n > 0
    if not some.any():
        return out
    at = bounds[:-1][some]
    for k, unit in enumerate(kinds):
        out[some, k * DIMS : (k + 1) * DIMS] = np.add.reduceat(table[unit], at, axis=0) / n[some, None]
    doc = np.repeat(np.arange(len(n)), n)
    again = np.zeros(len(own), bool)
    again[1:] = (own[1:] == own[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((own, doc))
    known = np.zeros(len(own), bool)
    known[1:] = (own[order][1:] == own[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    out[:, -3] = np.log1p(n) / 10
    out[some, -2] = 1 - np.add.reduceat(known.astype(np.float32), at) / n[some]
    out[some, -1] = np.add.reduceat(again.astype(np.float32), at) / n[some]
    return out


def pooled(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """doc_id and its features (float32 bytes), one row per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for batch in batches:
            for row, data, offsets in slices(batch.column(1)):
                f = features(data, offsets, shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(f)), pa.array([x.tobytes() for x in f], pa.binary())], names=["doc_id", "f"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, f binary")


class Network:
    """Two layers in numpy: standardised inputs, ReLU, one output, divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, epochs: int = 40):
        rng = np.random.default_rng(SEED)
        kept = rng.random(len(x)) < 0.2
        self.mean, self.scale = x[~kept].mean(0), x[~kept].std(0) + 1e-3
        w1 = rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN))
        self.p = [w1, np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        a, b = (x[~kept] - self.mean) / self.scale, y[~kept]
        self.temperature = 1.0
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(len(a)), max(1, len(a) // 128)):
                z = a[rows] @ self.p[0] + self.p[1]
                h = np.maximum(z, 0)
                d = (_sigmoid(h @ self.p[2] + self.p[3][0]) - b[rows]) / len(rows)
                back = np.outer(d, self.p[2]) * (z > 0)
                t += 1
                for i, g in enumerate([a[rows].T @ back + 1e-4 * self.p[0], back.sum(0), h.T @ d + 1e-4 * self.p[2], d.sum(keepdims=True)]):
                    m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                    self.p[i] = self.p[i] - 0.003 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        if kept.any():
            z, c = self.logits(x[kept]), y[kept]
            loss = lambda t: -np.mean(np.log(np.clip(np.where(c > 0, _sigmoid(z / t), _sigmoid(-z / t)), 1e-12, 1)))
            self.temperature = float(min(np.geomspace(0.25, 16, 97), key=loss))

    def logits(self, x):
        return np.maximum((x - self.mean) / self.scale @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3][0]

    def __call__(self, x):
        return _sigmoid(self.logits(x) / self.temperature)


class Constant:
    """For labels of one kind, or none: the same probability for all."""

    def __init__(self, value: float):
        self.value = value

    def __call__(self, x):
        return np.full(len(x), self.value)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def sample(labels: DataFrame, label: str, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, y) of at most ``rows`` labels that may be learned from, the same ones on every run (hash order)."""
    return (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
        .orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id", "y").limit(rows)
    )


def fit(pools: DataFrame, known: DataFrame):
    """A model from the pooled features of the documents in the bounded sample ``known``."""
    found = sorted(pools.join(F.broadcast(known), "doc_id").select("doc_id", "y", "f").collect())
    if not found:
        return Constant(0.5)
    x, y = np.stack([np.frombuffer(r["f"], np.float32) for r in found]).astype(float), np.array([r["y"] for r in found])
    return Network(x, y) if 0 < y.mean() < 1 else Constant(float(y.mean()))


def held_out(doc_id) -> F.Column:
    """True for the fifth of documents that are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    ``docs`` needs doc_id and text, ``labels`` doc_id and ``label`` (0 or 1; null is
    unlabelled); other columns are ignored. Null and empty texts have zero features and get
    the score the network gives those. A null doc_id counts as not held out and is never
    learned from. Without labels all scores are 0.5, with one kind of label its value.
    """
    pools = cut_lineage(pooled(docs, unit_vectors(docs)))
    model = fit(pools, sample(labels, label, fit_rows))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, FEATURES).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value(x), pa.float64())], names=["doc_id", "score"])

    return pools.mapInArrow(run, "doc_id long, score double").select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def kept_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """Rows of ``docs`` the model does not reject, with their columns.

    Scores are computed beside the whole row, so repeated and null doc_ids keep their own.
    """
    table = unit_vectors(docs)
    known = sample(labels, label)
    model = fit(pooled(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id", "left_semi"), table), known)
    shared = docs.sparkSession.sparkContext.broadcast((table, model))
    at = docs.columns.index("text")

    def run(batches):
        table, model = shared.value
        for batch in batches:
            for row, data, offsets in slices(batch.column(at)):
                keep = model(features(data, offsets, table).astype(float)) >= threshold
                yield batch.slice(row, len(keep)).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
