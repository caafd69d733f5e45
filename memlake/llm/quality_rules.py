"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import WORD, let

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
REPEAT_PERCENT = 20

# Common words of the four languages of the corpus.
STOP_WORDS = {
    "en": "the of and to in a is that for it was on are as with be by this not from or an at have".split(),
    "de": "der die das und in zu den von ist mit sich des auf für nicht eine ein als auch es im dem".split(),
    "fr": "de la le et les des en un une est que dans pour qui sur au par pas plus ce il elle avec".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más".split(),
}


@dataclass(frozen=True)
class Rule:
    """A document fails when ``measure`` leaves [low, high] and it has ``from_words`` words."""

    name: str
    measure: str
    low: float = float("-inf")
    high: float = float("inf")
    from_words: int = 0


#: measures: columns of :func:`measures`, or ratios of them
RULES = (
    Rule("symbols", "n_symbols / n_words", high=0.3),
    Rule("word_length", "word_chars / n_words", low=1.5, high=20.0),
    Rule("stop_words", "n_stop_words / n_words", low=0.01, from_words=60),
    Rule("repeated_lines", "n_dup_lines / n_lines", high=0.45),
    # no labelled text of five or more lines (sf0.1) has fewer than four words a line
    Rule("line_words", "n_words / n_lines", low=3.0, from_words=20),
)


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _repeated_words(words: Column, width: int = 5) -> Column:
    """Words inside ``width``-word windows that the text holds more than once.

    Hashes only decide whether a text needs the exact part, which sorts the windows
    themselves; equal neighbours are repeats.
    """
    n = F.size(words)
    starts = F.sequence(F.lit(1), n - (width - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, width)))
    exact = F.sort_array(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(words, i, width), " ").alias("w"), i.alias("i"))))

    def covered(s: Column) -> Column:
        same = lambda x, i: F.when((F.get(s, i - 1)["w"] == x["w"]) | (F.get(s, i + 1)["w"] == x["w"]), x["i"])
        at = F.sort_array(F.filter(F.transform(s, same), F.isnotnull))
        return let(at, lambda p: F.aggregate(F.transform(p, lambda x, i: F.coalesce(F.least(F.lit(width), F.get(p, i + 1) - x), F.lit(width))), F.lit(0).cast("long"), lambda a, b: a + b))

    repeats = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(n <= width, F.lit(0).cast("long")).when(repeats, let(exact, covered)).otherwise(F.lit(0).cast("long"))


def measures(text: Column) -> Column:
    """A struct of counts of a text; null counts as a text without characters."""
    t = F.coalesce(text, F.lit(""))
    stop = sorted({w for v in STOP_WORDS.values() for w in v})
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    return let(
        F.regexp_extract_all(t, F.lit(WORD), F.lit(0)),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(_without(t, BLANKS)).cast("long").alias("word_chars"),
            (F.length(t) - F.length(_without(t, SYMBOLS))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
            _repeated_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: x.isin(stop))).cast("long").alias("n_stop_words"),
        ),
    )


def compile_rules(rules=RULES) -> Column:
    """One boolean expression over the measures: no rule is broken."""
    passed = F.lit(True)
    for r in rules:
        value = F.coalesce(F.try_divide(*[F.col(x.strip()).cast("double") for x in r.measure.split("/")]) if "/" in r.measure else F.col(r.measure).cast("double"), F.lit(0.0))
        passed = passed & ((F.col("n_words") < r.from_words) | value.between(r.low, r.high))
    return passed


def apply_rules(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id with its measures, base_failed and kept; one row per row of ``docs``.

    Null and empty texts have no words and fail. Only doc_id and text are read, so other
    columns never clash. Nothing is shuffled.
    """
    m = docs.select("doc_id", measures(F.col("text")).alias("m")).select(
        "doc_id", "m.n_words", "m.word_chars", "m.n_symbols", F.col("m.lines.dup").alias("n_dup_lines"), "m.n_repeat_words", F.col("m.lines.n").alias("n_lines"), "m.n_stop_words"
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return m.withColumn("base_failed", failed).withColumn("kept", ~failed & compile_rules(rules))


def sql(rules=RULES) -> str:
    """The same counts and rules over ``documents`` as SQL."""
    word = "'[^\\x20\\x09-\\x0D]+'"
    stop = ", ".join(f"'{w}'" for w in sorted({w for v in STOP_WORDS.values() for w in v}))

    def value(measure: str) -> str:
        x, _, y = (part.strip() for part in measure.partition("/"))
        return f"coalesce(CAST({x} AS DOUBLE) / nullif({y}, 0), 0)" if y else f"CAST({x} AS DOUBLE)"

    def limits(r: Rule) -> str:
        low = [f"{value(r.measure)} >= {r.low}"] if r.low > float("-inf") else []
        high = [f"{value(r.measure)} <= {r.high}"] if r.high < float("inf") else []
        return f"(n_words < {r.from_words} OR ({' AND '.join(low + high)}))"

    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, {word}) AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {word})) AS lines FROM d),
windows AS (SELECT r, i, array_to_string(words[i : i + 4], ' ') AS x FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
again AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, x) > 1),
covered AS (SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS place FROM again) GROUP BY r),
m AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines, coalesce(c.n, 0) AS n_repeat_words,
    len(list_filter(words, lambda x: x IN ({stop}))) AS n_stop_words
  FROM w LEFT JOIN covered c USING (r)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {' AND '.join(map(limits, rules))} AS kept FROM f"""
