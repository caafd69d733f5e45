"""Repeated doc_ids, clashing columns, long texts, added tokens and pages with cut-out blocks."""

import time
from array import array

import pytest
from pyspark.sql import functions as F

from memlake.llm import html_main, ngram_join, packing, pii, repeats, secrets_scan
from tests.llm import brute

DOC = "doc_id long, text string"
WORDS = "one two three four five six seven eight nine ten eleven twelve"


def _prose(seed, n=60):
    return brute.texts(4, seed)[0] + " " + " ".join(f"{seed}w{i}" for i in range(n))


def test_repeats_keep_text_that_occurs_once_under_a_repeated_id(spark):
    a, b = _prose(1), _prose(2)
    rows = [(1, a), (5, a), (5, b), (9, b), (7, _prose(3)), (7, _prose(3))]
    got = repeats.without_repeats(spark.createDataFrame(rows, DOC)).collect()
    kept = sorted((r["doc_id"], r["n_bytes"], sum(x["stop"] - x["start"] for x in r["removed"])) for r in got)
    n, m, k = (len(t.encode()) for t in (a, b, _prose(3)))
    assert kept == sorted([(1, n, 0), (5, n, n), (5, m, 0), (9, m, m), (7, k, 0), (7, k, 0)])


def test_repeats_between_texts_of_one_id_go_by_the_order_of_their_hashes(spark):
    shared = _prose(4)
    rows = [(3, shared + " " + _prose(5)), (3, _prose(6) + " " + shared)]
    got = repeats.without_repeats(spark.createDataFrame(rows, DOC)).collect()
    removed = sorted(sum(x["stop"] - x["start"] for x in r["removed"]) for r in got)
    assert removed[0] == 0 and removed[1] >= len(shared.encode())


def test_first_of_each_takes_any_column_name(spark):
    rows = [(1, _prose(1)), (2, _prose(1)), (3, _prose(2)), (None, _prose(1)), (3, _prose(2)), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, DOC)
    for c in ("_row", "_key", "_gone", "_doc", "_id", "_text", "component", "low_id"):
        docs = docs.withColumn(c, F.lit(c))
    out = ngram_join.first_of_each(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in got) == [(False, 1), (False, 3), (False, 4), (False, 5), (True, None)]
    assert all(r["_row"] == "_row" and r["_gone"] == "_gone" for r in got)


def test_packing_knows_the_added_tokens():
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>  \n y", "<|endoftext", "  <|endoftext|>  "):
        assert packing.tokens(None).encode(text) == array("I", library.encode(text, add_special_tokens=False).ids).tobytes()


@pytest.mark.parametrize("text", ["0" * 5000 + ".1.1.1", "1.2.3." + "0" * 5000, "0000000000255.1.1.1", "9" * 5000, "a" * 200 + "@" + "b" * 200 + ".c" * 40])
def test_personal_data_in_long_runs(text):
    assert pii.base_spans(text) == brute.personal(text)
    pii.candidates(text)


def test_spelled_out_addresses_have_no_upper_length():
    name, domain = "n" * 300, " dot ".join(["d" * 100] * 20)
    text = f"write to {name} at {domain} now"
    assert ("email", 9, 9 + len(f"{name} at {domain}")) in pii.candidates(text)


def test_secrets_of_a_long_text_are_found_in_linear_time(spark):
    took = []
    for n in (2_000, 40_000):
        docs = spark.createDataFrame([(1, "password=abcdef12 " * n)], DOC)
        start = time.perf_counter()
        base = secrets_scan.find(docs).first()["base"]
        took.append(time.perf_counter() - start)
        assert len(base) == n and (base[-1]["start"], base[-1]["end"]) == (18 * (n - 1), 18 * n - 1)
    assert took[1] < 40 + 20 * took[0]


@pytest.mark.parametrize(("page", "text"), [
    (f"<article><p>Intro words here and there.</p><div class='ad'>buy</div><p>{WORDS}</p></article>", f"Intro words here and there. {WORDS}"),
    (f"<article><p>{WORDS}</p><aside>more</aside><p>the end.</p></article>", f"{WORDS} the end."),
    (f"<article><h1>Top</h1><div class='share'><div class='social'>x</div></div><p>{WORDS}</p></article>", f"Top {WORDS}"),
    (f"<article><p>a b c d e f</p></article><div class='comments'>{'<p>c c c c</p>' * 100}</div>", "a b c d e f"),
    (f"<article><p>a b c d e f</p><div class='comments'>{'<p>c c c c</p>' * 100}</div></article>", "a b c d e f"),
    (f"<p>{WORDS}</p><img src='data:{'x' * 70_000}' alt=\"a > b\"><p>{WORDS}</p>", f"{WORDS} {WORDS}"),
    (f"<div class='page with-sidebar'><h1>Top</h1><p>{WORDS}</p><div class='sidebar'>links</div></div>", f"Top {WORDS}"),
    (f"<div id=wrap><nav><a>home</a></nav><div class=story><p>{WORDS}</p><p>{WORDS}</p></div><footer>all rights</footer></div>", f"{WORDS} {WORDS}"),
])
def test_pages_lose_cut_out_blocks_only(page, text):
    assert html_main.main_text(page, {}) == text


def test_pages_without_marks_give_the_marked_articles_text(spark, sf):
    """Pages whose article element is an unmarked div: nothing in them tells the region but the scores."""
    pages = [r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    scores = html_main.learn(pages[: len(pages) // 2])
    other = pages[len(pages) // 2 :]
    same = [html_main.main_text(p.replace("<article>", "<div>").replace("</article>", "</div>"), scores) == html_main.main_text(p, scores) for p in other]
    assert sum(same) >= 0.95 * len(other)


def test_pages_with_many_names_take_linear_time():
    page = lambda n: "".join(f"<x{i}>w</x{i}>" for i in range(n))
    start = time.perf_counter()
    assert html_main.main_text(page(40_000), {}).count("w") == 40_000
    assert time.perf_counter() - start < 20
