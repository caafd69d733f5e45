"""Personal data: generators propose spans, boosted trees score them, thresholds select.

Strict patterns with checks (``base_spans``) are always redacted. Generators with high
recall propose further, overlapping spans: mail addresses with spelled-out signs, dotted
numbers, long digit groups, telephone numbers without a plus. Boosted trees over the form
of a span and the characters around it, learned from the strict matches of the corpus and
from variants and near misses made of them, give a probability; the threshold per kind is
the lowest one that is right often enough on held-back rows. Candidates that the strict
patterns do not match are unlabelled: they may be what is looked for, and teach nothing.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.textbytes import slices

KINDS = ("email", "ip", "card", "phone")
FIT_ROWS = 4000
#: invented matches of each kind, so that no kind depends on what the corpus holds
SEEDS = 100
PRECISION = 0.99

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SOME = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from their @ so that long runs of letters cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Strict spans by kind, then start; code points, end exclusive."""
    if not _SOME.search(text):
        return []
    out = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(n := p.lstrip("0")) <= 3 and int(n or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


# -- candidates ------------------------------------------------------------------------

_SIGN = re.compile(r"@|\x20?[(\[]at[)\]]\x20?|\x20at\x20(?=[A-Za-z0-9-]++\x20dot\x20)", re.I)
_BEFORE = re.compile(r"[A-Za-z0-9._%+-]++")  # on the text read backwards
_AFTER = re.compile(r"[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?|\x20dot\x20)[A-Za-z0-9-]++)++", re.I)
_NUMBER = re.compile(r"[+(]{0,2}[0-9][0-9\x20().-]*[0-9]")
_GROUP = re.compile(r"[0-9]+")
_HINTS = tuple(re.compile(p, re.I) for p in (r"mail|contact|write|schreib|écri|escrib", r"\bip\b|host|server|addr|dns", r"card|visa|karte|carte|tarjeta|pay", r"phone|tel|call|fax|mobil|ruf"))


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Proposed spans of all kinds; they may overlap."""
    out = []
    if "@" in text or "at" in text:
        signs = list(_SIGN.finditer(text))
        back = text[::-1] if signs else ""
        for m in signs:
            a, b = _BEFORE.match(back, len(text) - m.start()), _AFTER.match(text, m.end())
            if a and b:
                out.append(("email", len(text) - a.end(), b.end()))
    for m in _NUMBER.finditer(text):
        out += _parts(text, m.start(), m.end())
    return out


def _parts(text: str, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    """Spans of whole digit groups inside a run: from every group on, as far as each kind allows."""
    groups = [m.span() for m in _GROUP.finditer(text, start, end)]
    between = [text[x[1] : y[0]].count(".") for x, y in zip(groups, groups[1:], strict=False)]
    for i, (a, _) in enumerate(groups):
        if between[i : i + 3] == [1, 1, 1]:
            yield "ip", a, groups[i + 3][1]
        lead = a
        while lead > start and a - lead < 2 and text[lead - 1] in "+(":
            lead -= 1
        d = 0
        for x, b in groups[i:]:
            d += b - x
            if d > 19:
                break
            if d >= 12:
                yield "card", a, b
            if 7 <= d <= 16:
                yield "phone", a if text.count("(", lead, b) > text.count(")", lead, b) else lead, b


def describe(kind: str, text: str, start: int, end: int) -> list[float]:
    """Features of form and context; only 24 characters on either side are looked at."""
    s, before, after = text[start:end], text[max(0, start - 24) : start], text[end : end + 24]
    groups = [len(g) for g in re.findall("[0-9]+", s)] or [0]
    parts = [int(p[:6]) for p in re.findall("[0-9]+", s)] or [0]
    d = _digits(s)
    form = [
        len(s), len(d), len(groups), min(groups), max(groups), max(parts), s.count(" "), s.count("-"), s.count("."), s.count("("),
        float(s[0] == "+"), float(s[0] == "("), float(luhn(d)) if d else 0.0, float(d[:1] or 0), float("@" in s), float(len(s.rpartition(".")[2])),
        float(bool(re.search(r"[.\s\])]dot[\s\[(]|\]|\[", s, re.I))), float(len(set(d))), float(bool(re.fullmatch(r"(?:19|20)\d\d[-. ]?\d\d?[-. ]?\d\d?.*", s))),
        groups[0], groups[-1], len(re.split("[^A-Za-z0-9]+", s)[-1]),
    ]
    context = [float(bool(h.search(before))) for h in _HINTS]
    context += [float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] in "$€£#v/=" and before != ""), float(before[-1:].isspace() or before == "")]
    return [float(kind == k) for k in KINDS] + form + context


_SAMPLE = "h long, kind string, label double, before string, span string, after string"


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _SAMPLE.split(", ")]
    for batch in batches:
        rows = []
        for text in batch.column(0):
            t = text.as_py() or ""
            if _SOME.search(t) or " at " in t:
                known = set(base_spans(t))
                for kind, a, b in known.intersection(candidates(t)):
                    around = (t[max(0, a - 24) : a], t[a:b], t[b : b + 24])
                    h = int.from_bytes(hashlib.blake2b("\0".join((kind, *around)).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)
                    rows.append((h, kind, 1.0, *around))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=names)


def _invented(kind: str, rng: random.Random) -> str:
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == "email":
        return f"ab.{number(2)}@mail.example.{rng.choice(['com', 'org', 'de'])}"
    if kind == "ip":
        return ".".join(str(rng.randint(1, 255)) for _ in range(4))
    if kind == "phone":
        return f"+1 ({rng.randint(200, 999)}) 555-{number(4)}"
    some = rng.sample("0123456789", rng.randint(2, 10))
    d = rng.choice("3456") + "".join(rng.choice(some) for _ in range(14))
    return next(d + c for c in "0123456789" if luhn(d + c))


def _variants(rows: list[tuple]) -> list[tuple]:
    """The sampled strict matches, other spellings of them, and near misses in their contexts.

    The last value of a row is the number of the match it was made from.
    """
    rng = random.Random(5)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    seeds = list(rows)
    for kind in KINDS:
        for _ in range(SEEDS):
            seeds.append((kind, 1.0, "to the ", _invented(kind, rng), " and"))
    out = [(*seed, i) for i, seed in enumerate(seeds)]
    for i, (kind, _, before, s, after) in enumerate(seeds):
        put = lambda span, label, kind=kind, before=before, after=after, i=i: out.append((kind, label, before, span, after, i))
        if kind == "email":
            put(s.replace("@", " (at) "), 1.0)
            put(s.replace("@", " at ").replace(".", " dot "), 1.0)
            put(s.replace("@", "[at]").replace(".", "[dot]"), 1.0)
            put(f"{rng.choice(['look', 'point', 'stop', 'start'])} at {rng.choice(['the', 'one', 'each'])} dot {rng.choice(['product', 'matrix', 'pattern', 'there'])}", 0.0)
        elif kind == "phone":
            national = re.sub(r"^\+[0-9]{1,2}\x20?", "", s)
            if len(_digits(national)) >= 9 and re.search(r"[\x20().-]", national):
                put(national, 1.0)
                groups = _GROUP.findall(national)
                for sign in " -.":
                    put(sign.join(groups), 1.0)
                # parts of a number, and spans that reach into the next one
                for whole in (national, " ".join(groups), "-".join(groups)):
                    first, last = _GROUP.search(whole), whole.rindex(groups[-1])
                    for part in (whole[first.end() :].lstrip(" ).-"), whole[:last].rstrip(" (.-"), f"{whole} {number(3)}", f"{number(4)} {whole}", f"{groups[-1]} {whole[:last].rstrip(' (.-')}"):
                        if 7 <= len(_digits(part)) <= 16:
                            put(part, 0.0)
            for _ in range(3):
                put(" ".join(number(rng.randint(1, 6)) for _ in range(rng.randint(3, 5)))[:18].strip(), 0.0)
            for miss in (f"20{number(2)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"{number(3)}.{number(6)}", number(8), number(10), f"{number(4)} {number(4)}", f"19{number(2)} 20{number(2)}"):
                put(miss, 0.0)
        elif kind == "card":
            put(" ".join(re.findall(".{1,4}", _digits(s))), 1.0)
            put("-".join(re.findall(".{1,4}", _digits(s))), 1.0)
            d = _digits(s)
            put(d[:-1] + str((int(d[-1]) + rng.randint(1, 9)) % 10), 0.0)
            put(" ".join(re.findall(".{1,4}", d[:-1] + str((int(d[-1]) + rng.randint(1, 9)) % 10))), 0.0)
            put(" ".join(re.findall(".{1,4}", d[:12])), 0.0)
            # groups as in tables of numbers, although the check digit fits
            cuts = [0, *sorted(rng.sample(range(1, len(d)), min(len(d) - 1, rng.randint(4, 7)))), len(d)]
            if {y - x for x, y in zip(cuts, cuts[1:], strict=False)} - {4}:
                put(" ".join(d[x:y] for x, y in zip(cuts, cuts[1:], strict=False)), 0.0)
            put(number(12), 0.0)
            put(f"20{number(12)}", 0.0)
        else:
            put(".".join([str(rng.randint(256, 999)), *s.split(".")[1:]]), 0.0)
            put(".".join([number(2), number(2), number(2), f"20{number(2)}"]), 0.0)
            put(f"{number(2)}.{number(2)}.{number(4)}.{number(5)}", 0.0)
    return out


# -- boosted trees ---------------------------------------------------------------------


class Trees:
    """Gradient boosting of the log loss with trees of fixed depth over sorted split points."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, least: int = 8):
        self.depth, self.start = depth, float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 17)[1:-1], method="lower")) for j in range(x.shape[1])]
        level = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], 1)
        f, self.trees = np.full(len(y), self.start), []
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(x, level, y - p, p * (1 - p), least)
            self.trees.append(tree)
            f += rate * self._leaf(tree, x)
        self.rate = rate

    def _grow(self, x, level, g, h, least):
        """Arrays of feature, cut and value, heap order; a node without a useful cut sends all left."""
        n = 2**self.depth - 1
        feature, cut = np.zeros(n, int), np.full(n, np.inf)
        node = np.zeros(len(g), int)
        for i in range(n):
            rows = np.flatnonzero(node == i)
            best = (1e-9, 0, np.inf)
            if len(rows) >= 2 * least:
                total_g, total_h = g[rows].sum(), h[rows].sum()
                for j, cuts in enumerate(self.cuts):
                    bins = len(cuts) + 1
                    a, b, c = (np.cumsum(np.bincount(level[rows, j], w, bins))[:-1] for w in (g[rows], h[rows], None))
                    ok = (c >= least) & (len(rows) - c >= least)
                    gain = np.where(ok, a**2 / (b + 1) + (total_g - a) ** 2 / (total_h - b + 1) - total_g**2 / (total_h + 1), 0)
                    if len(gain) and gain.max() > best[0]:
                        best = (gain.max(), j, cuts[int(gain.argmax())])
            feature[i], cut[i] = best[1:]
            node[rows] = 2 * i + 1 + (x[rows, feature[i]] > cut[i])
        leaves = np.bincount(node - n, g, n + 1) / (np.bincount(node - n, h, n + 1) + 1)
        return feature, cut, leaves

    def _leaf(self, tree, x):
        feature, cut, leaves = tree
        node, rows = np.zeros(len(x), int), np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
        return leaves[node - len(feature)]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.start)
        for tree in self.trees:
            f += self.rate * self._leaf(tree, x)
        return 1 / (1 + np.exp(-f))


def fit(docs: DataFrame, rows: int = FIT_ROWS) -> tuple[Trees, dict[str, float]]:
    """Trees and a threshold per kind, from at most ``rows`` strict matches (hash order, all texts proposed)."""
    found = docs.select("text").mapInArrow(_propose, _SAMPLE).distinct().orderBy("h", "kind", "span").limit(rows).collect()
    data = _variants([tuple(r)[1:] for r in found])
    x = np.array([describe(k, b + s + a, len(b), len(b) + len(s)) for k, _, b, s, a, _ in data])
    y = np.array([r[1] for r in data])
    kinds = np.array([r[0] for r in data])
    seed = np.array([r[5] for r in data])
    back = (np.random.default_rng(3).random(seed.max() + 1) < 0.3)[seed]  # all that was made of one match on one side
    model = Trees(x[~back], y[~back])
    p, limits = model(x[back]), {}
    for k in KINDS:
        q, z = p[kinds[back] == k], y[back][kinds[back] == k]
        order = np.argsort(-q)
        right = np.cumsum(z[order]) / np.arange(1, len(z) + 1)
        good = np.flatnonzero(right >= PRECISION)
        limits[k] = max(0.5, float(q[order][good[-1]])) if len(good) else 1.1
    return model, limits


def select(text: str, model: Trees, limits: dict[str, float]) -> tuple[list, list]:
    """(base spans, all spans) of a text, by kind, then start. Added spans meet no other span."""
    base = base_spans(text)
    if not (base or _SOME.search(text) or " at " in text or "at" in text and ("[" in text or "(" in text)):
        return base, base
    taken = sorted((a, b) for _, a, b in base)
    free = _Free(taken)
    more = [c for c in candidates(text) if free.has(*c[1:])]
    if not more:
        return base, base
    p = model(np.array([describe(k, text, a, b) for k, a, b in more]))
    added = []
    for score, (k, a, b) in sorted(zip(p.tolist(), more, strict=True), key=lambda r: (-r[0], r[1])):
        if score >= limits[k] and free.take(a, b):
            added.append((k, a, b))
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


class _Free:
    """The parts of a text outside spans, kept as sorted disjoint merged intervals."""

    def __init__(self, spans):
        self.spans = []
        for a, b in spans:
            if self.spans and a < self.spans[-1][1]:
                self.spans[-1][1] = max(b, self.spans[-1][1])
            else:
                self.spans.append([a, b])

    def has(self, a: int, b: int) -> bool:
        at = bisect.bisect_left(self.spans, [b, b])
        return not (at and self.spans[at - 1][1] > a)

    def take(self, a: int, b: int) -> bool:
        if not self.has(a, b):
            return False
        bisect.insort(self.spans, [a, b])
        return True


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans) -> str:
    """The text with every maximal union of spans replaced by the name of its first kind."""
    out, at = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


_FOUND = "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>"


def find(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id and its spans (kind, start, end, base), one row per row of ``docs``.

    Only doc_id and text are read. Null and empty texts have no spans; null and repeated
    doc_ids are rows like others. Spans are ordered by kind as in ``KINDS``, then start.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, fit_rows))
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches):
        for batch in batches:
            for row, _, offsets in slices(batch.column(1)):
                n = len(offsets) - 1
                out = []
                for text in batch.column(1).slice(row, n):
                    base, spans = select(text.as_py() or "", *shared.value)
                    known = set(base)
                    out.append([{"kind": s[0], "start": s[1], "end": s[2], "base": s in known} for s in spans])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), pa.array(out, item)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _FOUND)


def digest(found: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and all spans as one string, from :func:`find`."""
    base = F.filter("spans", lambda s: s["base"])
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``docs`` with the selected spans of text replaced; ``n_chars``, if there, follows."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, fit_rows))
    at, schema = docs.columns.index("text"), docs.schema

    def run(batches):
        for batch in batches:
            texts = [None if (t := x.as_py()) is None else redacted(t, select(t, *shared.value)[1]) for x in batch.column(at)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = docs.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
