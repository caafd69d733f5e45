"""Token files against the tokenizer and a round trip, hard negatives against SQL and pairs, runs against every lag."""

import hashlib
import random
import zlib
from array import array

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from memlake.llm import hard_negatives, queries, runs, token_files
from tests.llm import brute

LONG = " ".join(f"w{i % 977} {i}" for i in range(120_000))
EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


# token files


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def _ids(tokenizer, text):
    return array("I", [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]).tobytes()


def test_words_encode_as_whole_texts(tokenizer):
    rng = random.Random(5)
    signs = "aZé́ßİ \t\n\r\x1c\x85\xa0 'sdl'12.,<|endoftext|>\U0001f600한가ﬁΣς"
    words = token_files.encoder(None)
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["x <|endoftext|> y<|startoftext|>z", "á ́a", "ΟΔΟΣ ΟΔΟΣ.", "x" * 3000, "'S 'll"]
    for text in texts:
        assert words.encode(text) == array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes(), repr(text)


def test_files_hold_every_document_in_order(spark, tmp_path, tokenizer):
    df, rows = brute.awkward(spark, [*brute.texts(), LONG])
    df, rows = df.union(df.filter("doc_id = 3")), [*rows, rows[3]]
    folder = str(tmp_path / "ids")
    token_files.write_ids(df.repartition(5), f"file:{folder}", file_chars=40_000)
    got = [(r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) for r in token_files.read_ids(spark, f"file:{folder}").collect()]
    assert len({f for f in (tmp_path / "ids").glob("*.ids")}) > 3
    got.sort(key=lambda r: r[1])
    at = 0
    for _, start, n, ids in got:
        assert (start, n) == (at, len(ids) // 4)
        at += n
    want = sorted(((r[0] if r[0] is not None else -1), _ids(tokenizer, r[1])) for r in rows)
    assert sorted((i if i is not None else -1, ids) for i, _, _, ids in got) == want
    assert [i if i is not None else -1 for i, *_ in got] == [i for i, _ in want]


def test_one_document_is_read_by_its_index(spark, tmp_path, tokenizer):
    folder = f"file:{tmp_path}/ids"
    df, rows = brute.awkward(spark, brute.texts())
    token_files.write_ids(df, folder, file_chars=4_000)
    reader = token_files._Reader({"path": folder})
    list(reader.pushFilters([token_files.EqualTo(("doc_id",), 7)]))
    assert len(reader.partitions()) == 1
    found = token_files.read_ids(spark, folder).filter("doc_id IN (7, 9, 12345)").collect()
    assert {r["doc_id"]: bytes(r["ids"]) for r in found} == {i: _ids(tokenizer, rows[i][1]) for i in (7, 9)}
    assert token_files.read_ids(spark, folder).filter("doc_id > 40").count() == sum(r[0] is not None and r[0] > 40 for r in rows)


def test_files_of_few_and_no_documents(spark, tmp_path):
    few = spark.createDataFrame([(1, "one"), (2, None)], "doc_id long, text string")
    for name, df, n in (("few", few, 2), ("none", spark.createDataFrame([], EMPTY), 0), ("blank", few.filter("doc_id = 2"), 1)):
        token_files.write_ids(df, f"file:{tmp_path}/{name}")
        assert token_files.read_ids(spark, f"file:{tmp_path}/{name}").count() == n


def test_a_foreign_dictionary_is_refused(spark, tmp_path):
    folder = f"file:{tmp_path}/ids"
    token_files.write_ids(spark.createDataFrame([(i, f"text {i} of some words") for i in range(300)], "doc_id long, text string"), folder)
    (name,) = tmp_path.glob("ids/*.dictionary")
    name.write_bytes(b"other content")
    with pytest.raises(Exception, match="was not written with dictionary"):
        token_files.read_ids(spark, folder).count()


def test_a_shared_dictionary_shortens_short_documents():
    import zstandard

    rng = np.random.default_rng(2)
    docs = [(rng.integers(0, 60, 40) ** 2).astype("<u2").tobytes() for _ in range(2000)]
    content = token_files.train_dictionary(docs[:1000], 8192)
    size = lambda d: sum(len(zstandard.ZstdCompressor(dict_data=d).compress(x)) for x in docs[1000:])
    assert size(token_files._dictionary(content)) < 0.8 * size(None)


# hard negatives


def _sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    return sorted(con.sql(hard_negatives.SQL).fetchall())


@pytest.mark.parametrize(("block", "chunk", "seed"), [(1024, 2048, 1), (8, 3, 2), (16, 64, 3)])
def test_hard_negatives_equal_sql(spark, block, chunk, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 5))
    x = centres[rng.integers(0, 6, 700)] + rng.normal(size=(700, 5)) * rng.choice([0.0, 0.2, 1.0])
    labels = np.where(rng.random(700) < 0.4, 3, rng.integers(0, 10, 700))  # one label holds a third
    rows = [(int(i), [float(np.float32(c)) for c in v], int(c)) for i, v, c in zip(rng.permutation(700), x, labels, strict=True)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = hard_negatives.mine(df.withColumn("block", F.lit("clash")).withColumn("q", F.lit(1)), block=block, chunk=chunk)
    assert sorted(tuple(r) for r in got.collect()) == _sql(rows)


def test_hard_negatives_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    plain = [(i, [1.0, 0.5 * (i % 3)], i % 2) for i in range(0, 230)]
    plain += [(300, [-1.0, 0.25], 5), (301, [0.0, 0.0], 5), (400, [2.0, 0.1], 9)]
    odd = [(500, None, 1), (501, [1.0, None], 1), (502, [nan, 1.0], 1), (503, [inf, 0.0], 1), (504, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (600, [1.0], 1), (601, [], 1), (700, [1e30, 0.0], 1)]
    df = spark.createDataFrame([*plain, *odd, *plain[:9]], "vec_id long, embedding array<float>, label int")
    assert sorted(tuple(r) for r in hard_negatives.mine(df).collect()) == _sql(plain)
    assert hard_negatives.mine(df.limit(0)).count() == 0
    assert hard_negatives.mine(df.filter("vec_id = 100")).count() == 0


def test_bounds_hold_and_spare_blocks():
    rng = np.random.default_rng(4)
    centres = rng.integers(-200, 200, (20, 4))
    x = np.repeat(centres, 50, 0) + rng.integers(-5, 6, (1000, 4))
    cells = ((x - x.min(0)) / (x.max(0) - x.min(0)) * 15).astype(int)
    keys = [k.tobytes() for k in hard_negatives.hilbert_keys(cells, 4)]
    blocks = x[sorted(range(1000), key=lambda i: keys[i])].reshape(20, 50, 4)
    least, most = hard_negatives.product_bounds(x, blocks.min(1), blocks.max(1))
    scores = np.einsum("ad,bnd->abn", x, blocks)
    assert (least <= scores.min(2)).all() and (most >= scores.max(2)).all()
    assert (most - least).mean() < 0.6 * np.ptp(scores, axis=(1, 2)).mean()


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (4, 2)])
def test_neighbours_on_the_curve_are_neighbours(dims, bits):
    cells = np.array(np.meshgrid(*[range(1 << bits)] * dims)).reshape(dims, -1).T
    keys = [k.tobytes() for k in hard_negatives.hilbert_keys(cells, bits)]
    assert len(set(keys)) == len(cells)
    along = cells[sorted(range(len(cells)), key=keys.__getitem__)]
    assert (np.abs(np.diff(along, axis=0)).sum(1) == 1).all()


def test_products_of_large_numbers_are_exact():
    big = np.array([[2**30 + 1, 2**30 + 3]])
    assert hard_negatives.exact_products(big, big)[0, 0] == (2**30 + 1) ** 2 + (2**30 + 3) ** 2


# runs


def _runs(w, shortest=6, turns=4):
    out = []
    for q in range(1, len(w) // turns + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(shortest, turns * q) and not any(w[i + d : i + n] == w[i : i + n - d] for d in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def _digest(doc_id, text):
    w = brute.WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    found = _runs(w)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *first, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def _periodic_texts(seed, n):
    rng, out = random.Random(seed), []
    for _ in range(n):
        w = []
        while len(w) < rng.randint(0, 250):
            root = [f"w{rng.randrange(rng.choice([1, 2, 3, 60]))}" for _ in range(rng.choice([1, 2, 3, 6, 7, 8, 9, 15, 16, 17, 31, 33, 40]))]
            w += (root * 9)[: rng.randint(1, len(root) * 9)] if rng.random() < 0.6 else root
        out.append(rng.choice([" ", "\n", "\t "]).join(w))
    return out


def test_runs_equal_every_lag(spark):
    df, rows = brute.awkward(spark, [*_periodic_texts(1, 250), "a a a a a", "a a a a a a", "x\xa0x " * 6, "  a" * 7])
    got = [tuple(r) for r in runs.digest(runs.periodic_runs(df, plant=True)).collect()]
    key = lambda r: (r[0] is None, r)
    assert sorted(got, key=key) == sorted((_digest(r[0], r[1]) for r in rows), key=key)
    assert runs.periodic_runs(df.limit(0)).count() == 0


def test_runs_of_a_query_on_whole_documents(spark, sf):
    got = {r["doc_id"]: tuple(r) for r in queries.QUERIES["op13_periodic_runs"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    short = [r for r in docs if len(r["text"] or "") < 8000]
    assert len(got) == len(docs) and len(short) > 100
    assert {r["doc_id"]: got[r["doc_id"]] for r in short} == {r["doc_id"]: _digest(r["doc_id"], r["text"]) for r in short}


def test_runs_of_long_texts_take_linear_time():
    rng = np.random.default_rng(6)
    root = rng.integers(0, 9000, 30_000)
    text = np.concatenate([rng.integers(0, 9, 1000) + 10_000, np.tile(root, 5), np.zeros(300_000, int) + 20_000])
    (found,) = runs.find_runs([text])
    assert (1000, 150_000, 30_000) in found and (151_000, 300_000, 1) in found
    a, b = [0], [0, 1]
    while len(b) < 100_000:
        a, b = b, b + a
    assert runs.find_runs([np.array(b)]) == [[]]  # powers below 4 everywhere
