"""Main text of web pages: the maximum-scoring subsequence of words and tags.

A page is a sequence of words and tags. Words score above zero and tags below; the
contiguous run with the largest sum, found in one linear scan, is the content region.
The scores are learned from labelled pages: those that mark one article or main element,
whose inside is the region to find. Parts of the region that are no article text (menus,
forms, adverts, comments and the like, by element name or class) are then left out.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIT_PAGES = 400
FIT_CHARS = 1 << 18
EPOCHS = 6

# Element names with a meaning in HTML.
RAW = frozenset("script style noscript template svg math iframe object canvas textarea select title audio video head".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog button fieldset".split())
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|sidebar|side|widget|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead"
    r"|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|social|share|sharing|related|recommended|toolbar|pagination|pager|login|search)(?:$|[\s_-])",
    re.I,
)
#: What readers wrote is no article text, however much of the page it is.
READERS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|replies|disqus|respond)(?:$|[\s_-])", re.I)
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>")
_LOOSE = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"\S+")

# Scores before learning.
START = {"word": 1.0, "link word": 0.2}
TAG = -0.4
BOILERPLATE_TAG = -8.0


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, value) of a page: ("text", "", text), ("open", name, classes) or ("close", name, "").

    Comments, declarations and the contents of elements that hold no text are left out. A <
    that starts no tag is text; an element or comment that is never closed ends at its tag.
    """
    at, unclosed, n = 0, set(), len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            yield "text", "", page[at:lt]
        if lt == n:
            return
        at = lt
        if page.startswith("<!--", at) and "!" not in unclosed:
            end = page.find("-->", at + 4)
            if end >= 0:
                at = end + 3
                continue
            unclosed.add("!")
        if page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, at) or _LOOSE.match(page, at)
        if not m:
            yield "text", "", "<"
            at += 1
            continue
        at, name = m.end(), m[2].lower()
        if m[1]:
            yield "close", name, ""
            continue
        if name in RAW and name not in unclosed and not m[3].rstrip().endswith("/"):
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if end:
                at = end.end()
                continue
            unclosed.add(name)
        marks = " ".join(a or b or c for _, a, b, c in _ATTRIBUTE.findall(m[3])) if "=" in m[3] else ""
        yield "open", name, marks


def scored(page: str) -> list[tuple[str, int, str, bool]]:
    """(type, count, text, dropped) of every token; type names a score, dropped marks no article text."""
    raw = list(tokens(page))
    drop = [False] * len(raw)
    words, mains = [0], [0]  # before each token
    for kind, name, value in raw:
        words.append(words[-1] + (len(_WORD.findall(value)) if kind == "text" else 0))
        mains.append(mains[-1] + (kind == "open" and name in ("article", "main")))
    # an element to leave out reaches to the close tag that balances it; one that is marked by its
    # class alone is kept if it holds the main element, or most of the page and no readers' text
    open_: dict[str, list[tuple[int, bool, bool]]] = {}
    edges = [0] * (len(raw) + 1)
    for i, (kind, name, marks) in enumerate(raw):
        if kind == "text" or name in VOID:
            continue
        if kind == "open":
            marked = bool(marks) and name not in ("body", "html", "article", "main")
            readers = marked and bool(READERS.search(marks))
            open_.setdefault(name, []).append((i, name in BOILERPLATE or readers or marked and bool(MARKED.search(marks)), readers))
        elif open_.get(name):
            start, out, readers = open_[name].pop()
            whole = mains[i] > mains[start + 1] or not readers and 2 * (words[i] - words[start]) > words[-1]
            if out and (name in BOILERPLATE or not whole):
                edges[start] += 1
                edges[i + 1] -= 1
    depth = 0
    for i in range(len(raw)):
        depth += edges[i]
        drop[i] = depth > 0
    out, link = [], 0
    for i, ((kind, name, value), gone) in enumerate(zip(raw, drop, strict=True)):
        if kind == "text":
            out.append(("link word" if link else "word", words[i + 1] - words[i], value, gone))
        else:
            if name == "a":
                link = int(kind == "open")
            first = value.split()[0].lower() if value.split() else ""
            key = f"{name}.{first}" if first else name
            out.append((f"{'/' if kind == 'close' else ''}{key}", 1, "" if name in INLINE else " ", gone))
    return out


def start_score(kind: str) -> float:
    """Score of a type before learning: far below zero for elements that are no content."""
    if kind in START:
        return START[kind]
    name, _, mark = kind.lstrip("/").partition(".")
    return BOILERPLATE_TAG if name in BOILERPLATE or MARKED.search(mark) or READERS.search(mark) else TAG


def best_region(items, scores: dict[str, float]) -> tuple[int, int]:
    """Start and end of the run with the largest sum; the first and longest of equals.

    What is left out anyway counts nothing, so text on both sides of it stays together.
    """
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for i, (kind, n, _, gone) in enumerate(items):
        if gone:
            continue
        s = scores.get(kind)
        total += n * (start_score(kind) if s is None else s)
        if total < 0:
            total, start = 0.0, i + 1
        elif total > best or total == best and region[0] == start and best:
            best, region = total, (start, i + 1)
    return region


def _marked_region(items) -> tuple[int, int] | None:
    for name in ("article", "main"):
        opens = [i for i, t in enumerate(items) if t[0] == name or t[0].startswith(name + ".")]
        closes = [i for i, t in enumerate(items) if t[0] == "/" + name]
        if len(opens) == 1 and len(closes) == 1 and opens[0] < closes[0]:
            return opens[0] + 1, closes[0]
    return None


def learn(pages: list[str], epochs: int = EPOCHS) -> dict[str, float]:
    """Scores from pages that mark their region, by averaged mistake-driven updates.

    After each page whose best run is not the marked one, the scores of what was missed go
    up and of what was taken wrongly go down; words stay above and tags below zero.
    """
    data = [(items, region) for p in pages if (items := scored(p)) and (region := _marked_region(items))]
    scores, sums, steps = {}, Counter(), 0
    for epoch in range(epochs):
        for items, (a, b) in data:
            x, y = best_region(items, scores)
            change = Counter()
            if (x, y) != (a, b):
                for i, sign in [(i, 1) for i in range(a, b) if not x <= i < y] + [(i, -1) for i in range(x, y) if not a <= i < b]:
                    if not items[i][3]:
                        change[items[i][0]] += sign * items[i][1]
            largest = max((abs(v) for v in change.values()), default=1) or 1
            for kind, v in change.items():
                s = scores.get(kind, start_score(kind)) + 2.0 / (1 + epoch) * v / largest
                scores[kind] = max(0.05, s) if kind in START else min(-0.05, s)
            steps += 1
            for kind, s in scores.items():
                sums[kind] += s - start_score(kind)
    return {kind: start_score(kind) + v / max(1, steps) for kind, v in sums.items()}


def main_text(page: str, scores: dict[str, float]) -> str:
    items = scored(page)
    start, end = best_region(items, scores)
    text = "".join(" " if gone else value for _, _, value, gone in items[start:end])
    return " ".join(entities.unescape(text).split())


def extract(pages: DataFrame, fit_pages: int = FIT_PAGES) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of ``pages``.

    Scores come from at most ``fit_pages`` pages that mark their region (hash order); with
    none, the start scores hold. Pages of more than ``FIT_CHARS`` characters are not learned
    from; all are extracted, whatever their length, one at a time. Null and empty pages give an
    empty text, an empty table an empty one. Only page_id, url and html are read; nulls and
    repeats in page_id and url are kept as they are.
    """
    has = F.col("html").rlike(r"(?i)<(?:article|main)[\s>]") & (F.length("html") <= FIT_CHARS)
    marked = pages.filter(has).select(F.xxhash64("html").alias("h"), "html")
    first = [r[0] for r in marked.select("h").distinct().orderBy("h").limit(fit_pages).collect()]
    # one page per hash, so that copies do not count twice
    known = marked.filter(F.col("h") <= first[-1]).groupBy("h").agg(F.min("html").alias("html")).orderBy("h").collect() if first else []
    shared = pages.sparkSession.sparkContext.broadcast(learn([r[1] for r in known]))

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py() or "", shared.value) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
