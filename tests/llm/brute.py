"""Plain versions of the operators for small inputs, and tables with awkward rows."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHES = "size h row src shard n owner digest tokens spans start stop score predicted held_out token component taken target base weak linked removed kept list bundle q asked f v"


def awkward(spark, texts, extra=True):
    """documents with the texts, then null, empty, blank and repeated ones, null ids and clashing columns."""
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(texts)]
    n = len(rows)
    rows += [(n, None, None, None, None), (n + 1, "", "en", "", 0), (n + 2, " \t\n ", "de", "s1", 4), (n + 3, texts[0], "en", "s2", len(texts[0])), (None, texts[0], "en", None, 3), (n + 4, "x" * 5000, "en", "s0", 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        for c in CLASHES.split():
            df = df.selectExpr("*", f"'clash' AS {c}")
    return df, rows


def texts(n=40, seed=3):
    """Invented prose with copies, near copies, shared passages and repeated lines."""
    import random

    rng = random.Random(seed)
    parts = "an be co de en fi ga he in ja ko li mo ne or pa".split()
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    passage = " ".join(word() for _ in range(60))
    out = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(3, 160))]
        if i % 5 == 4:
            words = out[rng.randrange(len(out))].split()
            words[rng.randrange(len(words))] = word()
        if i % 7 == 6:
            words.insert(rng.randrange(len(words) + 1), passage)
        if i % 11 == 10:
            words += ["\n"] + words
        out.append(" ".join(words))
    return out


def shingles(text, width):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = WORD.findall(low)
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def components(rows, width, percent):
    sets = {i: shingles(t, width) for i, t, *_ in rows if i is not None}
    label = {i: i for i in sets}
    for i, x in sets.items():
        for j, y in sets.items():
            if i < j and x and y and 100 * len(x & y) >= percent * len(x | y):
                a, b = label[i], label[j]
                if a != b:
                    label = {k: min(a, b) if v in (a, b) else v for k, v in label.items()}
    return {i: (len(s), label[i]) for i, s in sets.items()}


def repeats(rows, length):
    """doc_id -> (bytes, removed, runs, sha256 of the rest); ids must be unique."""
    seen, out = set(), {}
    for i, t, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        gone = [False] * len(b)
        for at in range(len(b) - length + 1):
            w = b[at : at + length]
            if w in seen:
                gone[at : at + length] = [True] * length
            seen.add(w)
        runs = sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def rule_counts(text):
    t = text or ""
    w = WORD.findall(t)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if often[x] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def personal(text):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        total = 0
        for i, c in enumerate(d[::-1]):
            x = int(c) * (2 if i % 2 else 1)
            total += x // 10 + x % 10
        return total % 10 == 0

    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(len(n := p.lstrip("0")) <= 3 and int(n or 0) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    return [(k, *m.span()) for k, p, ok in kinds for m in re.finditer(p, text or "") if ok(m[0])]


def secrets(text):
    value = r"([A-Za-z0-9+/_.=-]+)"
    kinds = [
        ("assign", rf"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?{value}""", lambda m: len(m[1]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ]
    found = sorted((m.start(), i, m.end()) for i, (_, p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m))
    return [(kinds[i][0], a, b) for a, i, b in found]


def words(text):
    return len(WORD.findall(text or ""))
