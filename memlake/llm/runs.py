"""Periodic runs of words, by multi-scale minimizers and direct lag scans.

A run with smallest period q and at least 4 * q words repeats every window of words at
distance q. Scale k stands for periods from 2**k to 2**(k+1) - 1. Fingerprints of 2**(k+1)
words are taken at every word, and the first of the smallest in each window of 2**k starts is
that window's minimizer. A run of such a period holds two windows at distance q with the same
content, so both have a minimizer at the same place, and no equal fingerprint lies between
them, as that would be a smaller period: the pair of a minimizer and the next equal one is
enough, and there are no more pairs than minimizers. Each pair seeds an extension, word by
word in growing steps; the words themselves are compared, so a fingerprint alone never makes
a run. Periods below ``SHORT`` are too short for a scale and are found by comparing every word
with the one q later.

The documents of a batch are scanned together as one array; a separator of its own ends each.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Periods below this are found by direct lag scans; a power of two.
SHORT = 8
LEAST_WORDS = 6
LEAST_TURNS = 4
#: Words of documents that are scanned together; a longer document is scanned alone.
GROUP_WORDS = 1 << 18
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
SCHEMA = "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, kept string"


def _mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _divisors(period: int) -> Iterator[int]:
    """``period`` divided by each of its prime factors."""
    rest, f = period, 2
    while f * f <= rest:
        if rest % f == 0:
            yield period // f
            while rest % f == 0:
                rest //= f
        f += 1
    if rest > 1:
        yield period // rest


def _is_smallest(words: np.ndarray, start: int, period: int) -> bool:
    """No divisor of ``period`` is a period of the run; others cannot be, as the run is long."""
    return not any(np.array_equal(words[start : start + period - d], words[start + d : start + period]) for d in _divisors(period))


def _stretch(words: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """Largest (first, stop) around ``at`` in which every word equals the one ``lag`` later."""
    stop, step = at, 64
    while stop < len(words) - lag:
        n = min(step, len(words) - lag - stop)
        other = np.flatnonzero(words[stop : stop + n] != words[stop + lag : stop + lag + n])
        if len(other):
            stop += int(other[0])
            break
        stop, step = stop + n, 2 * step
    first, step = at, 64
    while first > 0:
        n = min(step, first)
        other = np.flatnonzero(words[first - n : first] != words[first + lag - n : first + lag])
        if len(other):
            first += int(other[-1]) + 1 - n
            break
        first, step = first - n, 2 * step
    return first, stop


def _short_runs(words: np.ndarray, shortest: int, most_turns: int) -> Iterator[tuple[int, int, int]]:
    """Runs with periods below ``SHORT``: stretches between words that differ from the one ``lag`` later."""
    for lag in range(1, min(SHORT, len(words))):
        other = np.concatenate(([-1], np.flatnonzero(words[:-lag] != words[lag:]), [len(words) - lag]))
        found = np.flatnonzero(np.diff(other) - 1 + lag >= max(shortest, most_turns * lag))
        for i in found.tolist():
            first = int(other[i]) + 1
            if _is_smallest(words, first, lag):
                yield first, int(other[i + 1]) - first + lag, lag


def _minimizers(keys: np.ndarray, width: int) -> np.ndarray:
    """Places that hold the smallest key, the first of equals, of some window of ``width`` places."""
    at, reach = np.arange(len(keys)), 1
    while reach < width:
        step = min(reach, width - reach)
        left, right = at[:-step], at[step:]
        at = np.where(keys[left] <= keys[right], left, right)
        reach += step
    return np.unique(at)


def _long_runs(words: np.ndarray, lengths: np.ndarray, shortest: int, turns: int) -> Iterator[tuple[int, int, int]]:
    """Runs with periods from ``SHORT`` on; ``lengths`` of the documents must descend."""
    ends = np.cumsum(lengths + 1)
    prints, scale = _mix(words.astype(np.uint64)), 1
    while True:
        # fingerprints of 2 * scale words, over the documents that can hold a run of this scale
        long_enough = int(np.searchsorted(-lengths, -turns * scale, "right"))
        if not long_enough:
            return
        prints = prints[: ends[long_enough - 1]]
        if len(prints) <= scale:
            return
        prints = _mix(prints[:-scale] * np.uint64(0x9E3779B97F4A7C15) + prints[scale:])
        if scale >= SHORT and len(prints) >= scale:
            at = _minimizers(prints, scale)
            at = at[np.argsort(prints[at], kind="stable")]
            lag = at[1:] - at[:-1]
            pairs = np.flatnonzero((prints[at[1:]] == prints[at[:-1]]) & (lag >= scale) & (lag < 2 * scale))
            seeds = at[pairs]
            lags = lag[pairs]
            order = np.lexsort((seeds, lags))
            reached, before = -1, 0
            for seed, period in zip(seeds[order].tolist(), lags[order].tolist(), strict=True):
                if period == before and seed < reached:
                    continue
                first, stop = _stretch(words, seed, period)
                before, reached = period, max(stop, seed + 1)
                if stop - first + period >= max(shortest, turns * period) and _is_smallest(words, first, period):
                    yield first, stop - first + period, period
        scale *= 2


def find_runs(texts: list[np.ndarray], shortest: int = LEAST_WORDS, turns: int = LEAST_TURNS) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each text, in order; texts are arrays of word numbers from 0.

    A run is a stretch of at least ``shortest`` words and ``turns`` (4 or more) times its
    smallest period that cannot be made longer. Time is about n log^2 n of the words, space a
    few numbers a word.
    """
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    while order and len(texts[order[-1]]) < shortest:
        order.pop()
    if not order:
        return found
    top = max(int(texts[i].max()) for i in order) + 1
    words = np.concatenate([np.append(texts[i], top + k) for k, i in enumerate(order)])
    lengths = np.array([len(texts[i]) for i in order])
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    for runs in (_short_runs(words, shortest, turns), _long_runs(words, lengths, shortest, turns)):
        for first, n, period in runs:
            k = int(np.searchsorted(starts, first, "right")) - 1
            found[order[k]].append((first - int(starts[k]), n, period))
    for runs in found:
        runs.sort(key=lambda r: (r[0], r[2]))
    return found


def planted(words: list, doc_id: int | None) -> list:
    """The words with the repetition that the contract puts into every tenth document."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def _groups(texts: list[str | None], ids: list[int | None], plant: bool) -> Iterator[tuple[list[list[bytes]], list[np.ndarray]]]:
    """Words of consecutive documents and their numbers, about ``GROUP_WORDS`` words at a time."""
    words, numbers, names, n = [], [], {}, 0
    for text, doc_id in zip(texts, ids, strict=True):
        own = (text or "").encode().split()  # bytes split at space and the controls 9 to 13 only
        own = planted(own, doc_id) if plant else own
        words.append(own)
        numbers.append(np.fromiter((names.setdefault(w, len(names)) for w in own), np.int64, len(own)))
        n += len(own)
        if n >= GROUP_WORDS:
            yield words, numbers
            words, numbers, names, n = [], [], {}, 0
    if words:
        yield words, numbers


def _scan(plant: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for words, numbers in _groups(batch["text"].to_pylist(), batch["doc_id"].to_pylist(), plant):
                runs, kept = find_runs(numbers), []
                for own, spans in zip(words, runs, strict=True):
                    if spans:
                        stays = np.ones(len(own), bool)
                        for start, n, period in spans:
                            stays[start + period : start + n] = False
                        own = [own[i] for i in np.flatnonzero(stays).tolist()]
                    kept.append(b" ".join(own).decode())
                listed = [[{"start": s, "length": n, "period": p} for s, n, p in spans] for spans in runs]
                ids = batch["doc_id"][at : at + len(words)]
                at += len(words)
                yield pa.RecordBatch.from_arrays([ids, pa.array(map(len, words), pa.int64()), pa.array(listed, RUNS), pa.array(kept, pa.string())], names=["doc_id", "n_words", "runs", "kept"])

    return scan


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """(doc_id, n_words, runs, kept): every periodic run of words of each text, and the text without their repeats.

    ``runs`` holds (start, length, period) by start, then period. ``kept`` joins by one space
    the words that lie in no run after that run's first period. ``plant`` first puts the
    contract's repetition into documents, by doc_id. Only doc_id and text are read, so other
    columns may have any name. Null and empty texts have no words, no runs and an empty
    ``kept``; null doc_ids are planted with nothing; repeated rows and doc_ids give a row each;
    an empty table gives an empty one. Texts may be very long: a task holds the words of one
    Arrow batch and some 100 bytes a word of the group it scans. Rows are neither shuffled
    nor compared with each other.
    """
    return docs.select("doc_id", "text").mapInArrow(_scan(plant), SCHEMA)


def digest(runs: DataFrame) -> DataFrame:
    """The contract's columns: the longest run of each document, and digests of all runs and of the kept words."""
    from pyspark.sql import functions as F

    line = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(line, F.lit("\n"))).otherwise("")
    best = F.try_element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(1))
    length, period = -F.col("best.n"), F.col("best.period")
    return runs.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.encode(lines, "UTF-8"), 256).alias("runs_sha256"), F.sha2(F.encode("kept", "UTF-8"), 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), period.alias("period"), F.expr("1000 * -best.n div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
