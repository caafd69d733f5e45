import html as entities
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from memlake.llm import html_main, ngram_join, pii, vector_search
from tests.llm import brute


def test_pages_give_the_article(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r for r in html_main.extract(pages).collect()}
    for r in pages.collect():
        inner = re.sub(r"</?(a|b)\b[^>]*>", "", re.search(r"<article>(.*?)</article>", r["html"], re.S)[1])
        want = " ".join(entities.unescape(re.sub(r"<[^>]*>", " ", inner)).split())
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"]) == (want, len(want))


def test_pages_awkward_rows(spark):
    prose = "one two three four five six seven eight nine ten eleven twelve"
    rows = [
        (1, "u", None), (2, None, ""), (None, "u", "plain &lt;text&gt; only words here"), (4, "u", "<p>a < b &amp; c"), (5, "u", "<div" * 2000),
        (6, "u", f"<body><nav><a>m</a></nav><div class='content with-sidebar'><h1>Top</h1><p>{prose}</p><div class=comments><p>{prose}</p></div></div><footer>f</footer>"),
        (7, "u", "<!-- never closed <p>x"), (7, "u", "<script>var a = '<p>no</p>'</script><p>yes &nbsp; it&#39;s</p>"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(1))
    out = html_main.extract(df).collect()
    assert len(out) == len(rows)
    by_id = {r["page_id"]: r["text"] for r in out if r["page_id"] != 7}
    assert by_id[1] == by_id[2] == ""
    assert by_id[None] == "plain <text> only words here"
    assert by_id[4] == "a < b & c"
    assert by_id[6] == f"Top {prose}"
    assert "yes it's" in {r["text"] for r in out}
    assert html_main.extract(df.limit(0)).count() == 0


def test_best_region_is_the_largest_sum():
    rng = np.random.default_rng(1)
    for _ in range(200):
        values = rng.normal(size=12)
        items = [(str(i), 1, "", False) for i in range(12)]
        a, b = html_main.best_region(items, {str(i): v for i, v in enumerate(values)})
        best = max([values[i:j].sum() for i in range(12) for j in range(i + 1, 13)] + [0.0])
        assert values[a:b].sum() == pytest.approx(best)


def _brute(vectors, every, k):
    ids, x = np.array([v for v, _ in vectors]), np.array([e for _, e in vectors], float)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = (x * x[i]).sum(1)
        out[ids[i]] = [(v, t) for t, v in sorted((-t, v) for v, t in zip(ids, s, strict=True) if v != ids[i])][:k]
    return out


def test_vectors_recall_and_exact_scores(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = {}
    for r in sorted(vector_search.nearest(df).collect()):
        got.setdefault(r["query_id"], []).append((r["vec_id"], -r["score"]))
    want = _brute([(r["vec_id"], r["embedding"]) for r in df.collect()], 20, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want]) >= 0.9
    for q, found in got.items():
        exact = dict(_brute([(r["vec_id"], r["embedding"]) for r in df.filter(F.col("vec_id").isin([q, *[v for v, _ in found]])).collect()], 20, 99)[q]) if q == 0 else None
        assert found == sorted(found, key=lambda r: (r[1], r[0])) and (exact is None or all(exact[v] == pytest.approx(s, abs=1e-12) for v, s in found))


def test_vectors_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0]) for i in range(0, 30)] + [(40, [0.5, 0.5]), (41, None), (42, [0.0, 0.0]), (43, [1.0, None]), (44, [nan, 1.0]), (45, [inf, 0.0]), (46, [1.0]), (None, [1.0, 1.0]), (60, [0.0, -3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("list", F.lit("clash")).withColumn("v", F.lit(0))
    got = {}
    for r in sorted(vector_search.nearest(df).collect()):
        got.setdefault(r["query_id"], []).append((r["vec_id"], -r["score"]))
    assert got == {q: [(v, pytest.approx(s)) for v, s in f] for q, f in _brute(rows[:31] + rows[-1:], 20, 20).items()}
    assert vector_search.nearest(df.limit(0)).count() == 0
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in sorted(vector_search.nearest(few).collect())] == [(0, 1, 1), (0, 2, 2), (0, 3, 3)]


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "personal_data", "mix", "pack"]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    one = corpus_pipeline.near_copies(spark, docs, sf)
    assert {r["doc_id"] for r in one.collect()} == {i for i, (_, c) in brute.components(rows, 5, 80).items() if i == c}
    clean = corpus_pipeline.personal_data(spark, docs, sf)
    assert clean.columns == docs.columns and not any(pii.base_spans(r["text"]) for r in clean.collect())
    mixed = corpus_pipeline.mix(spark, docs, sf)
    assert mixed.columns == docs.columns
    assert mixed.select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] == pytest.approx(1.5 * sum(brute.words(t) for _, t in rows), rel=0.01)


def test_pipeline_takes_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_entry_holds_every_query():
    names = entry.queries()
    assert "pipeline" in names
    assert {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} == {f"op{i}" for i in range(1, 14)}


def test_similarity_filters_lose_nothing():
    rng = np.random.default_rng(3)
    for _ in range(300):
        base = rng.integers(1, 1 << 62, rng.integers(5, 60), dtype=np.uint64)
        other = np.concatenate([base[: rng.integers(1, len(base) + 1)], rng.integers(1, 1 << 62, rng.integers(0, 9), dtype=np.uint64)])
        x, y, hot = np.unique(base), np.unique(other), np.sort(base[:3])
        if ngram_join.similar(x, y, 85):
            for order in range(len(ngram_join.SALTS)):
                keys = [ngram_join.order_keys(ngram_join.ordered_prefix(s, ngram_join.prefix_size(len(s), 85), hot, order), hot, order) for s in (x, y)]
                assert ngram_join.may_reach(len(x), keys[0], len(y), keys[1], 85)
