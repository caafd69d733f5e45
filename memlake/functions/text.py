"""Text functions: tokens, phrases, roots, spelling variants, NFC and line ranges."""

from __future__ import annotations

import unicodedata

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from memlake.functions.arrow import line_ends, nfc_arrow  # noqa: F401

TOKEN = r"[\p{L}\p{N}\p{Co}]+"
SPACE = r"[\s\p{Z}\x{85}]+"


def _fold_table() -> tuple[str, str]:
    """Letters that are one ASCII letter plus one mark, and the letter without the mark."""
    plain, marked = [], []
    for cp in list(range(0xC0, 0x250)) + list(range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFD", chr(cp))
        if len(parts) == 2 and parts[0].isascii() and parts[0].islower():
            marked.append(chr(cp))
            plain.append(parts[0])
    return "".join(marked), "".join(plain)


FOLD_FROM, FOLD_TO = _fold_table()
MARKS = r"[\x{0300}-\x{0331}]"


def is_ascii(text: Column) -> Column:
    """One byte per character: two counters, no pattern matching."""
    return F.octet_length(text) == F.length(text)


def fold(text: Column) -> Column:
    """Lower case without single diacritics; plain ASCII skips the letter tables."""
    marked = F.regexp_replace(F.translate(F.lower(text), FOLD_FROM, FOLD_TO), MARKS, "")
    return F.when(is_ascii(text), F.lower(text)).otherwise(marked)


def tokens(text: Column) -> Column:
    """Runs of letters and digits of the folded text, in order."""
    return F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0))


def cjk_bigram_tokens(text: Column) -> Column:
    """Tokens where a run with ideographs or kana gives its overlapping pairs instead."""
    cjk = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"

    def pairs(token: Column) -> Column:
        grams = F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(token) - 1, F.lit(1))),
            lambda i: F.substr(token, i, F.lit(2)),
        )
        return F.when(token.rlike(cjk), grams).otherwise(F.array(token))

    return F.flatten(F.transform(tokens(text), pairs))


TOKENIZERS = {"unicode": tokens, "cjk_bigram": cjk_bigram_tokens}


def tokenize_query(query: str, tokenizer: str = "unicode") -> list[list[str]]:
    """Whitespace terms of one query string, each as the phrase of its tokens."""
    def one(term: str) -> list[str]:
        folded = term.lower().translate(str.maketrans(FOLD_FROM, FOLD_TO))
        found = regex.findall(TOKEN, regex.sub("[̀-̱]", "", folded))
        if tokenizer != "cjk_bigram":
            return found
        cjk = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]")
        grams: list[str] = []
        for token in found:
            if cjk.search(token):
                grams += [token[i:i + 2] for i in range(max(len(token) - 1, 1))]
            else:
                grams.append(token)
        return grams

    phrases = [one(term) for term in query.split()]
    return [phrase for phrase in phrases if phrase]


def phrases(query: Column) -> Column:
    """Column form of :func:`tokenize_query`: array of token arrays."""
    terms = F.filter(F.split(query, SPACE), lambda t: t != "")
    return F.filter(F.transform(terms, tokens), lambda p: F.size(p) > 0)


def match_expression(query: Column) -> Column:
    """Quoted full-text expression: each term in double quotes, inner quotes doubled."""
    terms = F.filter(F.split(query, SPACE), lambda t: t != "")
    quoted = F.transform(
        terms, lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))
    )
    return F.array_join(quoted, " ")


def phrase_frequency(toks: Column, phrase: list[str]) -> Column:
    """How often the literal phrase starts in a token array."""
    if len(phrase) == 1:
        return F.size(F.filter(toks, lambda t: t == phrase[0]))
    wanted = F.array(*[F.lit(t) for t in phrase])
    last = F.size(toks) - len(phrase) + 1
    starts = F.filter(
        F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
        lambda i: F.slice(toks, i, len(phrase)) == wanted,
    )
    return F.when(last >= 1, F.size(starts)).otherwise(0)


def signature(terms: Column) -> Column:
    """64 bits, of which each term sets one: what holds all of some terms has all their bits."""
    def bit(term: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(term), F.lit(64)).cast("int"))

    return F.aggregate(terms, F.lit(0).cast("long"), lambda bits, t: bits.bitwiseOR(bit(t)))


# fixed values: suffixes tried in this order
ROOT_SUFFIXES = ["ations", "ation", "ions", "ion", "ing", "ed", "s"]

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """Runs of letters, digits and '-', lower case in ASCII only."""
    found = F.regexp_extract_all(text, F.lit(r"[\p{IsAlphabetic}\p{N}\-]+"), F.lit(0))
    return F.transform(found, lambda t: F.translate(t, _UPPER, _UPPER.lower()))


def _root(token: Column) -> Column:
    out = None
    for suffix in ROOT_SUFFIXES:
        hit = token.endswith(suffix) & (F.octet_length(token) > len(suffix) + 2)
        cut = F.substr(token, F.lit(1), F.length(token) - len(suffix))
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    return out.otherwise(token)


def roots(text: Column) -> Column:
    """Distinct word roots, one suffix removed per word."""
    return F.array_distinct(F.transform(words(text), _root))


def _variants(token: Column) -> Column:
    def without(n: int) -> Column:
        return F.substr(token, F.lit(1), F.length(token) - n)

    none = F.array().cast("array<string>")
    red = F.when(
        token.endswith("red"), F.array(without(3), F.concat(without(3), F.lit("s")))
    ).otherwise(none)
    ed = F.when(
        token.endswith("ed"), F.array(without(2), F.concat(without(2), F.lit("s")))
    ).otherwise(none)
    plural = F.when(
        token.endswith("s"), F.array(F.regexp_replace(token, "s+$", ""))
    ).otherwise(F.array(F.concat(token, F.lit("s"))))
    return F.concat(F.array(token), red, ed, plural)


def variants(text: Column) -> Column:
    """Distinct non-empty spelling variants of every word."""
    flat = F.flatten(F.transform(words(text), _variants))
    return F.array_distinct(F.filter(flat, lambda v: v != ""))


def nfc(text: Column) -> Column:
    """NFC form. ASCII rows, which are NFC already, never leave the JVM."""
    return F.coalesce(nfc_arrow(F.when(~is_ascii(text), text)), text)


def byte_slice(content: Column, start: Column, end: Column) -> Column:
    """Exact UTF-8 byte range as text; null when it cuts a character or leaves the text."""
    raw = F.substring(content.cast("binary"), start.cast("int") + 1, (end - start).cast("int"))
    ok = (start >= 0) & (start < end) & (end <= F.octet_length(content))
    return F.when(ok & F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
