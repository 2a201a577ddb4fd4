"""Quality rules (operator 10), with DataFrame functions only.

Line-first cleaning: each line of a text is judged by punctuation, navigation and boilerplate
rules; failing lines are removed; a document that loses too large a share of its word characters is
rejected. Beside that stand the base counts of the contract.

Everything is one projection: no shuffle and no Python. Repeated three-word windows are found per
text by sorting packed (40-bit hash, 24-bit position) longs; where two different windows of one text
share the 40 bits, or a text has more words than positions fit, a sort of (64-bit hash, position)
pairs is used instead.

Defined results: a null or empty text has no words and no lines, fails the base rule and is not
kept; a null id stays null; repeated rows give equal rows; other columns pass through ``annotate``.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, settled, text_or_empty

# The contract's white space and symbol characters.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"

#: How a line of prose ends: an end mark, then any number of closing quotes or brackets.
LINE_END = r"[.!?…。！？:;,][\"'”’»)\]]*+\s*+$"
#: A line with this many bars, arrows or bullets is navigation.
NAVIGATION = "[|>»•·]"
MENU_MARKS = 3
#: Phrases that mark boilerplate lines.
BOILERPLATE = (
    "javascript", "cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved",
    "lorem ipsum", "sign up", "log in", "click here", "read more", "subscribe to",
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document is rejected when failing lines hold more than this share of its word characters.
MAX_LOST_SHARE = 0.5
#: A line whose symbols exceed this share of its characters is noise.
MAX_SYMBOL_SHARE = 0.1


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(
        F.split(trimmed, r"[ \t\n\x0B\f\r]+")
    )


def without(text: Column, characters: str) -> Column:
    """The length of ``text`` without the characters of a class."""
    return F.length(F.regexp_replace(text, characters, ""))


def word_chars(text: Column) -> Column:
    """Characters outside white space."""
    return without(text, r"[ \t\n\x0B\f\r]+")


def _covered(starts: str) -> Column:
    """Words covered by three-word windows at these ascending starts."""
    n = F.size(starts)
    after = F.get(F.col(starts), F.lit(1))
    gaps = F.transform(starts, lambda x, i: F.least(F.get(F.col(starts), i + 1) - x, F.lit(3).cast("long")))
    # get() is null behind the last start; least() skips nulls, so the last window counts in full
    return F.when(n == 0, F.lit(0).cast("long")).when(after.isNull(), F.lit(3).cast("long")).otherwise(
        F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, x: acc + x)
    )


def _repeated(ordered: str, key) -> Column:
    """Entries of a sorted array whose key equals that of a neighbour."""
    at = lambda i: key(F.get(F.col(ordered), i))
    return F.filter(ordered, lambda x, i: key(x).eqNullSafe(at(i + 1)) | key(x).eqNullSafe(at(i - 1)))


def with_repeats(df: DataFrame) -> DataFrame:
    """Add ``n_repeat_words`` to rows that hold ``words``.

    Each step is a column of its own, so that no array expression is evaluated twice.
    """
    n, w = F.size("words"), F.col("words")
    df = df.withColumn(
        "hashes",
        F.when(
            n >= 4,
            F.transform(
                F.slice(w, 1, F.greatest(n - 2, F.lit(1))),
                lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    df = df.withColumn("n_distinct", F.size(F.array_distinct("hashes")))
    top = lambda x: F.shiftrightunsigned(x, 24)
    pack = lambda x, i: F.shiftleft(x, 24).bitwiseOR(i.cast("long"))
    repeats = F.col("n_distinct") < F.size("hashes")
    df = df.withColumn("packed", F.when(repeats & (n < (1 << 24)), F.sort_array(F.transform("hashes", pack))))
    p = F.col("packed")
    heads = F.size(F.filter(p, lambda x, i: ~top(x).eqNullSafe(top(F.get(p, i - 1)))))
    df = df.withColumn("exact", F.coalesce(heads == F.col("n_distinct"), F.lit(False)))
    df = df.withColumn(
        "pairs",
        F.when(
            repeats & ~F.col("exact"),
            F.array_sort(F.transform("hashes", lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i")))),
        ),
    )
    low = F.lit((1 << 24) - 1).cast("long")
    df = df.withColumn(
        "starts",
        F.when(~repeats, F.array().cast("array<bigint>"))
        .when(F.col("exact"), F.sort_array(F.transform(_repeated("packed", top), lambda x: x.bitwiseAND(low))))
        .otherwise(F.sort_array(F.transform(_repeated("pairs", lambda x: x["h"]), lambda x: x["i"]))),
    )
    df = df.withColumn("n_repeat_words", _covered("starts"))
    return df.drop("hashes", "n_distinct", "packed", "exact", "pairs", "starts")


def has_words(line: Column) -> Column:
    return line.rlike(r"[^ \t\n\x0B\f\r]")


def passing(lines: str, text: str) -> Column:
    """The lines that read as prose: they end as prose does and are no menu, boilerplate or noise.

    What no line of a text can break is asked of the whole text first.
    """
    lowered = F.lower(F.col(text))
    suspect = functools.reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(x)) for x in BOILERPLATE])
    ends = lambda x: x.rlike(LINE_END)
    menu = lambda x: F.length(x) - without(x, NAVIGATION) >= MENU_MARKS
    noisy = lambda x: F.length(x) - without(x, SYMBOLS) > F.length(x) * F.lit(MAX_SYMBOL_SHARE)
    boiler = lambda x: F.lower(x).rlike("|".join(BOILERPLATE))
    prose = F.filter(lines, ends)
    marked = F.when(F.col(text).rlike(NAVIGATION), F.filter(prose, lambda x: ~menu(x))).otherwise(prose)
    quiet = F.when(F.col("n_symbols") > 0, F.filter(marked, lambda x: ~noisy(x))).otherwise(marked)
    return F.when(suspect, F.filter(quiet, lambda x: ~boiler(x))).otherwise(quiet)


def annotate(
    docs: DataFrame,
    text_col: str = "text",
    max_lost_share: float = MAX_LOST_SHARE,
    keep_input: bool = True,
    out: str = "quality",
) -> DataFrame:
    """The input's columns and a struct ``quality`` with counts, the cleaned text and the verdict.

    Where the input has a column of that name, the struct's name gets an underscore in front.
    """
    out = free_name(docs, out) if keep_input else out
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep_input else []
    rows = docs.select(*row, text_or_empty(text_col).alias("text"))
    rows = rows.withColumns(
        {
            "words": words_of(F.col("text")),
            "lines": F.filter(F.split("text", "\n"), has_words),
            "n_symbols": (F.length("text") - without(F.col("text"), SYMBOLS)).cast("long"),
        }
    )
    rows = with_repeats(rows)
    n_words = F.size("words").cast("long")
    rows = rows.withColumn("kept_lines", passing("lines", "text")).select(
        *(["row"] if keep_input else []),
        n_words.alias("n_words"),
        word_chars(F.col("text")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.array_join("kept_lines", "\n").alias("cleaned"),
    )
    lost = F.col("word_chars") - word_chars(F.col("cleaned"))
    rows = rows.withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    ).withColumn("lost_chars", lost)
    rows = rows.withColumn(
        "kept", ~F.col("base_failed") & (F.col("lost_chars") <= F.col("word_chars") * F.lit(max_lost_share))
    )
    found = F.struct(
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars",
        "cleaned",
    ).alias(out)
    return rows.select(*([F.col("row.*")] if keep_input else []), found)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's columns."""
    return annotate(docs.select(id_col, text_col), text_col).select(
        id_col,
        *[
            F.col(f"quality.{c}").alias(c)
            for c in (
                "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                "lost_chars",
            )
        ],
    )


def keep(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents, unchanged and with all their columns, that the rules keep."""
    out = free_name(docs, "quality")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    judged = settled(annotate(docs, text_col, out=out).select(row, F.col(out).alias("quality")), "quality")
    return judged.where("quality.kept").select("row.*")


#: The contract's columns in DuckDB's SQL.
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
c AS (SELECT r, doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')) AS n_symbols FROM d),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
b AS (SELECT r, line, regexp_matches(line, '[.!?…。！？:;,]["''”’»)\]]*[\x20\x09-\x0D]*$')
                  AND length(line) - length(regexp_replace(line, '{NAVIGATION}', '', 'g')) < {MENU_MARKS}
                  AND length(line) - length(regexp_replace(line, '{SYMBOLS}', '', 'g')) <= length(line) * {MAX_SYMBOL_SHARE}::DOUBLE
                  AND NOT regexp_matches(lower(line), '{"|".join(BOILERPLATE)}') AS prose
      FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
k AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines, coalesce(sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) FILTER (WHERE prose), 0) AS left_chars
      FROM b GROUP BY r),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 3)),
p AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
n AS (SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM p, range(3) t(j) GROUP BY r),
f AS (SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             word_chars - coalesce(left_chars, 0) AS lost_chars FROM c LEFT JOIN k USING (r) LEFT JOIN n USING (r)),
v AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND lost_chars <= word_chars * {MAX_LOST_SHARE}::DOUBLE AS kept, lost_chars::BIGINT AS lost_chars
FROM v
"""
