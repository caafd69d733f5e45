"""N-gram Jaccard join with prefix filters under several global token orders.

A text's tokens are its distinct word shingles. Two texts whose Jaccard similarity reaches
the threshold share a token among the first ``n - ceil(t n) + 1`` tokens of both, whatever
the order of tokens. Orders put tokens that many prefixes hold last, and are otherwise
random and independent of each other.

1. Frequent tokens: counted over the prefixes of all texts, half as long again as needed.
   Those above a share of the count form a table of at most ``HOT_ROWS`` rows.
2. Signatures: size, digest of the word sequence and prefixes of every row, stored with a
   number of the row. Rows with one digest are one class, held by its smallest row number.
3. Every prefix token links the classes that hold it to the smallest of them. Candidates
   must also share prefix tokens under the other orders before the sets are compared.
4. Verified pairs are merged to components. Then the candidates between components that are
   left in each token's group are compared, every one of them, so that no link is lost;
   pairs inside a component need no comparison and are never built. Small groups give
   pairs; groups above ``CROWD`` are compared in place, block against block, and give only
   the links that join components.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import components, release, small_side, stored
from memlake.llm.textbytes import LOWER, mixed, prefix_sums, slices, span_hashes, words
from memlake.session import cut_lineage

HOT_ROWS = 1 << 20
HOT_LEAST = 16
CROWD = 32
BLOCK = 2048
SALTS = (0, 0x5851F42D4C957F2D)
#: Prefix keys by order; those of the first order are whole, as they name the token, the others shortened.
KEYS = {f"keys{i}": "array<long>" if i == 0 else "array<int>" for i in range(len(SALTS))}


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int):
    """Sorted distinct shingle hashes of every text; a text of fewer words has one shingle."""
    low = LOWER[data]
    starts, ends, bounds = words(low, offsets)
    h = mixed(span_hashes(prefix_sums(low, 11), starts, ends))
    weights = [mixed(np.array([k + 77], np.uint64))[0] | np.uint64(1) for k in range(width)]
    grams = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for k, w in enumerate(weights):
        grams += h[k : k + len(grams)] * w
    grams = mixed(grams)
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b - a >= width:
            yield np.unique(grams[a : b - width + 1])
        elif b > a:
            short = h[a:b] * np.array(weights[: b - a], np.uint64)
            yield mixed(np.array([b - a], np.uint64) + short.sum(dtype=np.uint64))
        else:
            yield grams[:0]


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def order_keys(tokens: np.ndarray, hot: np.ndarray, order: int) -> np.ndarray:
    """Places of tokens in a global order: frequent ones last, else by a salted hash."""
    key = (mixed(tokens ^ np.uint64(SALTS[order])) if order else tokens) >> np.uint64(1)
    if len(hot) and len(tokens):
        at = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
        key = key | ((hot[at] == tokens).astype(np.uint64) << np.uint64(63))
    return key


def ordered_prefix(tokens: np.ndarray, size: int, hot: np.ndarray, order: int) -> np.ndarray:
    """The first ``size`` tokens under an order."""
    if size >= len(tokens):
        return tokens
    return tokens[np.argpartition(order_keys(tokens, hot, order), size - 1)[:size]]


def may_reach(n: int, x: np.ndarray, m: int, y: np.ndarray, percent: int) -> bool:
    """Whether sets of ``n`` and ``m`` tokens with these prefix keys can reach the similarity.

    Before the place where the shorter prefix ends both sets are known; what they do not share
    there is lost, and from it on the smaller rest bounds what they can share. Keys may be
    shortened to their first bits: then equal ones only raise the bound.
    """
    end = min(x.max(), y.max())
    x, y = x[x < end], y[y < end]
    both = max(np.isin(x, y).sum(), np.isin(y, x).sum())
    return (100 + percent) * (both + min(n - len(x), m - len(y))) >= percent * (n + m)


def _prefix_counts(docs: DataFrame, width: int, percent: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for _, data, offsets in slices(batch.column(0)):
                out = [ordered_prefix(s, 3 * prefix_size(len(s), percent) // 2, s[:0], 0) for s in shingle_sets(data, offsets, width) if len(s)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64))], names=["token"])

    return docs.select("text").mapInArrow(run, "token long").groupBy("token").agg(F.count("*").alias("n"))


def frequent_tokens(docs: DataFrame, width: int, percent: int) -> np.ndarray:
    """Sorted tokens that stand in so many prefixes that at most ``HOT_ROWS`` tokens can."""
    often = stored(_prefix_counts(docs, width, percent).filter(F.col("n") >= HOT_LEAST), "often")
    total = often.agg(F.sum("n")).first()[0] or 0
    rows = often.filter(F.col("n") > total // HOT_ROWS).select("token").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def _row_key() -> Column:
    """A hash of doc_id and text, by which a stored row number finds its row again."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def _signatures(docs: DataFrame, hot, width: int, percent: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row, data, offsets in slices(batch.column(2)):
                sets = list(shingle_sets(data, offsets, width))
                low = LOWER[data].tobytes()
                digests = [hashlib.blake2b(b" ".join(low[a:b].split()), digest_size=16).digest() for a, b in zip(offsets, offsets[1:], strict=False)]
                prefixes = []
                for order in range(len(SALTS)):
                    parts = [np.sort(order_keys(ordered_prefix(t, prefix_size(len(t), percent), hot.value, order), hot.value, order)).view(np.int64) for t in sets]
                    ends = np.concatenate([[0], np.cumsum([len(t) for t in parts])])
                    keys = np.concatenate(parts) if parts else np.zeros(0, np.int64)
                    prefixes.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys if order == 0 else (keys >> 32).astype(np.int32))))
                yield pa.RecordBatch.from_arrays([*[c.slice(row, len(sets)) for c in batch.columns[:2]], pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), *prefixes], names=["key", "doc_id", "n", "digest", *KEYS])

    rows = docs.select(_row_key().alias("key"), F.col("doc_id").cast("long"), "text").mapInArrow(run, "key long, doc_id long, n long, digest binary, " + ", ".join(f"{c} {t}" for c, t in KEYS.items()))
    return rows.withColumn("id", F.monotonically_increasing_id())


def _sets(docs: DataFrame, ids: DataFrame, signatures: DataFrame, width: int) -> DataFrame:
    """id and tokens of the rows with these numbers, one row each."""
    ids = stored(signatures.select("id", "key").join(small_side(ids), "id", "left_semi"), "ids")
    def run(batches):
        for batch in batches:
            for row, data, offsets in slices(batch.column(1)):
                sets = [s.tobytes() for s in shingle_sets(data, offsets, width)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(sets)), pa.array(sets, pa.binary())], names=["id", "tokens"])

    texts = docs.select(_row_key().alias("key"), "text").join(small_side(ids), "key").select("id", "text")
    repeated = signatures.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").join(ids, "key", "left_semi")
    if repeated.limit(1).count():
        texts = texts.dropDuplicates(["id"])
    return texts.mapInArrow(run, "id long, tokens binary")


def _filtered(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """Pairs that the prefixes under every order allow."""

    def run(batches):
        for batch in batches:
            n, m = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = np.ones(batch.num_rows, bool)
            for order in range(len(SALTS)):
                x, y = batch.column(4 + 2 * order), batch.column(5 + 2 * order)
                for i in np.flatnonzero(keep):
                    keep[i] = may_reach(n[i], x[i].values.to_numpy().view(np.uint32), m[i], y[i].values.to_numpy().view(np.uint32), percent)
            yield batch.select([0, 1]).filter(pa.array(keep))

    short = lambda c: F.transform(c, lambda k: F.shiftright(k, 32).cast("int")) if KEYS[c] == "array<long>" else F.col(c)
    of = lambda side, tag: signatures.select(F.col("id").alias(side), F.col("n").cast("int").alias(tag + "n"), *[short(c).alias(tag + c) for c in KEYS])
    both = pairs.select("a", "b").join(of("a", "x"), "a").join(of("b", "y"), "b")
    return both.select("a", "b", "xn", "yn", *[t + c for c in KEYS for t in "xy"]).mapInArrow(run, "a long, b long")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Exact test of two sorted sets."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _verified(pairs: DataFrame, signatures: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs whose sets are similar; only texts of pairs that pass all filters are read again."""
    pairs = stored(_filtered(pairs, signatures, percent).distinct(), "candidates")
    release(docs.sparkSession)
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    sets = stored(_sets(docs, ids, signatures, width), "sets")

    def run(batches):
        for batch in batches:
            keep = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    of = lambda a, b: sets.select(F.col("id").alias(a), F.col("tokens").alias(b))
    return pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def crowd_pairs(n, place, component, keys, sets, left, right, token, percent: int):
    """Pairs (i, j) of one token's group that are linked and join components, by blocks of rows.

    ``left`` and ``right`` are the row numbers to hold against each other. A pair is met
    here if ``token`` is its first common prefix key; its sets are compared exactly.
    """
    early = np.array([t for k in keys for t in k[k < token]], np.uint64)
    columns, counts = np.unique(early, return_counts=True)
    columns = columns[counts > 1]
    shared = np.zeros((len(n), len(columns)), np.float32)
    for i, k in enumerate(keys):
        shared[i, np.flatnonzero(np.isin(columns, k[k < token]))] = 1
    tokens, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = np.cumsum(counts > 1) - 1
    member, width = None, int((counts > 1).sum())
    if width * len(n) <= 1 << 26:
        member = np.zeros((len(n), width), np.float32)
        rows = np.repeat(np.arange(len(n)), [len(s) for s in sets])
        kept = counts[inverse] > 1
        member[rows[kept], often[inverse[kept]]] = 1
    root = {c: c for c in component.tolist()}

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    for at in range(0, len(left), 512):
        block = left[at : at + 512]
        mine = np.array([find(c) for c in component[block].tolist()])
        theirs = np.array([find(c) for c in component[right].tolist()])
        both = n[block][:, None] + n[right][None, :]
        rest = np.minimum((n - place)[block][:, None], (n - place)[right][None, :])
        open_ = (mine[:, None] != theirs[None, :]) & ((100 + percent) * rest >= percent * both)
        if len(columns):
            open_ &= shared[block] @ shared[right].T == 0
        x, y = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
        if not len(x):
            continue
        if member is not None:
            common = member[block[x]] @ member[right[y]].T
            linked = np.argwhere(open_[np.ix_(x, y)] & ((100 + percent) * common >= percent * both[np.ix_(x, y)]))
            pairs = ((block[x[i]], right[y[j]]) for i, j in linked)
        else:
            pairs = ((block[i], right[j]) for i, j in np.argwhere(open_) if similar(sets[block[i]], sets[right[j]], percent))
        for i, j in pairs:
            a, b = find(int(component[i])), find(int(component[j]))
            if a != b:
                root[max(a, b)] = min(a, b)
                yield i, j


def _crowd_links(held: DataFrame, signatures: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links that join components within large groups: each pair of blocks of a group is one small task."""
    ids = held.select("id").distinct()
    sets = stored(_sets(docs, ids, signatures, width).join(signatures.select("id", F.col("keys0").alias("keys")), "id"), "crowd-sets")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = held.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("token", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "id", "n", "place", "component").join(sets, "id")

    def run(group: pa.Table) -> pa.Table:
        n, place, component, block, ids = (group[c].to_numpy() for c in ("n", "place", "component", "block", "id"))
        keys = [np.array(k.as_py(), np.int64).view(np.uint64) for k in group["keys"]]
        sets = [np.frombuffer(t.as_buffer(), np.uint64) for t in group["tokens"]]
        token = np.array([group["token"][0].as_py()], np.int64).view(np.uint64)[0]
        lo, hi = group["lo"][0].as_py(), group["hi"][0].as_py()
        found = list(crowd_pairs(n, place, component, keys, sets, np.flatnonzero(block == lo), np.flatnonzero(block == hi), token, percent))
        return pa.table({"a": pa.array([int(ids[i]) for i, _ in found], pa.int64()), "b": pa.array([int(ids[j]) for _, j in found], pa.int64())})

    return rows.groupBy("token", "lo", "hi").applyInArrow(run, "a long, b long")


def _linked_rows(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(key, doc_id, n, component), one row per row of ``docs``; a component is the smallest row number in it."""
    spark = docs.sparkSession
    hot = spark.sparkContext.broadcast(frequent_tokens(docs, width, percent))
    release(spark)
    signatures = stored(_signatures(docs, hot, width, percent), "signatures")
    known = signatures.filter("n > 0")
    # the classes are stored on their own, so that a join on a digest many texts share can be split
    classes = known.groupBy("digest").agg(F.min("id").alias("rep"), F.max("id").alias("last"))
    classes = stored(classes.filter("rep < last").select("digest", "rep"), "copy-classes")
    copies = stored(known.select("id", "digest").join(small_side(classes, 200_000), "digest").filter("id > rep").select("id", "rep"), "copies")
    rows = known.join(small_side(copies.select("id")), "id", "left_anti").select("id", F.col("n").cast("int").alias("n"), F.posexplode("keys0").alias("place", "token"))

    def of_token(rows: DataFrame) -> DataFrame:
        """Rows whose token another row holds, with the smallest of these rows."""
        first = rows.groupBy("token").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("token", "first")
        return rows.join(first, "token")

    # the keys of frequent tokens are negative: these are joined so that their groups can be split;
    # groups of the others are small, so their rows are dealt once for the count and the join
    rare = of_token(rows.filter("token >= 0").repartition("token"))
    members = stored(rare.unionByName(of_token(rows.filter("token < 0"))), "members")
    release(spark)
    fits = lambda m, n: (100 * F.least(m, n) >= percent * F.greatest(m, n))
    sizes = members.groupBy("id").agg(F.max("n").alias("n"))
    star = members.filter("id <> first").groupBy(F.col("first").alias("a"), F.col("id").alias("b")).agg(F.max("n").alias("n"))
    star = star.join(sizes.select(F.col("id").alias("a"), F.col("n").alias("m")), "a").filter(fits(F.col("m"), F.col("n"))).select("a", "b")
    linked = cut_lineage(_verified(star, known, docs, width, percent))
    release(spark)
    labels = components(linked)
    # the rest: members of one token's group that are in different components
    held = members.join(labels, "id", "left").select("token", "id", "n", "place", F.coalesce("component", "id").alias("component"))
    each = held.groupBy("token", "component").agg(F.count("*").alias("c"))
    apart = each.groupBy("token").agg(F.max(F.struct("c", "component")).alias("top"), F.count("*").alias("k"), F.sum("c").alias("size")).filter("k > 1")
    held = stored(held.join(apart.select("token", "size", F.col("top.component").alias("top")), "token"), "held")
    release(spark)
    quiet = held.filter(F.col("size") <= CROWD)
    few = quiet.filter("component <> top").select("token", F.col("id").alias("b"), F.col("n").alias("m"), F.col("place").alias("at"), F.col("component").alias("other"))
    # a pair is met at its first common token, after which the smaller rest must be enough
    enough = (100 + percent) * F.least(F.col("n") - F.col("place"), F.col("m") - F.col("at")) >= percent * (F.col("n") + F.col("m"))
    new = (F.col("component") != F.col("other")) & enough & ((F.col("component") == F.col("top")) | (F.col("id") < F.col("b")))
    rest = quiet.join(few, "token").filter(new).groupBy(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).agg(F.lit(1).alias("one"))
    more = cut_lineage(_verified(rest.join(star, ["a", "b"], "left_anti"), known, docs, width, percent).union(_crowd_links(held.filter(F.col("size") > CROWD), known, docs, width, percent)))
    if more.limit(1).count():
        labels = components(linked.union(more))
    node = signatures.select("key", "doc_id", "n", F.col("id").alias("own")).join(copies.withColumnRenamed("id", "own"), "own", "left").withColumn("id", F.coalesce("rep", "own"))
    return stored(node.join(labels, "id", "left").select("key", "doc_id", "n", F.coalesce("component", "id").alias("component")), "linked-rows")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs``.

    ``docs`` needs doc_id and text; other columns are ignored. Every row is a node of its
    own, also where a doc_id repeats or is null; a component is named by its smallest
    doc_id. Null and empty texts have no shingles and are alone. A row with a null doc_id
    links others like any row, but its own component_id is null.
    """
    rows = _linked_rows(docs, width, percent)
    lowest = stored(rows.groupBy("component").agg(F.min("doc_id").alias("lowest"), F.count("*").alias("c")).filter("c > 1").select("component", "lowest"), "lowest")
    name = F.when(F.col("doc_id").isNotNull(), F.coalesce("lowest", "doc_id"))
    return rows.join(small_side(lowest), "component", "left").select("doc_id", F.col("n").alias("n_shingles"), name.alias("component_id"))


def first_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` per component, one with the smallest doc_id.

    A component that has rows with a null doc_id keeps one of them besides. Rows without
    shingles become one where doc_id and text agree.
    """
    rows = _linked_rows(docs, width, percent)
    known = F.col("doc_id").isNotNull()
    kept = rows.groupBy("component").agg(F.min(F.when(known, F.struct("doc_id", "key"))).alias("low"), F.min(F.when(~known, F.col("key"))).alias("free"), F.count("*").alias("c"))
    kept = stored(kept.filter("c > 1").select("component", F.col("low.doc_id").alias("low_id"), F.col("low.key").alias("low_key"), "free"), "kept")
    other = F.when(known, (F.col("doc_id") != F.col("low_id")) | (F.col("key") != F.col("low_key"))).otherwise(F.col("key") != F.col("free"))
    gone = stored(rows.join(small_side(kept), "component").filter(other).select(F.col("key").alias("_key"), F.col("doc_id").alias("_gone")).distinct(), "gone")
    again = stored(rows.groupBy("key", "doc_id").agg(F.count("*").alias("c")).filter("c > 1").select(F.col("key").alias("_key"), F.col("doc_id").alias("_gone")), "again")
    # the row travels as one struct, so its columns may have any name
    keyed = docs.select(F.struct("*").alias("_doc"), _row_key().alias("_row"), F.col("doc_id").cast("long").alias("_id"))
    same = (F.col("_row") == F.col("_key")) & F.col("_id").eqNullSafe(F.col("_gone"))
    keyed = keyed.join(small_side(gone), same, "left_anti")
    if not again.limit(1).count():
        return keyed.select("_doc.*")
    # rows that agree in doc_id and text: the first by their other columns
    order = [F.col("_doc").getField(c) for c, t in docs.dtypes if c not in ("doc_id", "text") and "map<" not in t and "variant" not in t]
    one = keyed.join(small_side(again), same, "left_semi").groupBy("_row", "_id", F.col("_doc.text").alias("_text")).agg(F.min_by("_doc", F.struct(*order) if order else F.lit(0)).alias("_doc"))
    return keyed.join(small_side(again), same, "left_anti").select("_doc.*").unionByName(one.select("_doc.*"))
