"""Line-first cleaning with DataFrame functions only.

Every line is judged by itself: navigation bars, symbol runs, shouting, boilerplate phrases and
long lines without closing punctuation fail. Failing lines are removed, and a document that loses too
large a part of its words is rejected. Document counts (repeated lines, words in repeated
three-word windows) are made with array functions inside the row, so nothing is shuffled.

Most texts hold no symbol, no phrase and no repeated window. So a rule is tried on lines only if the
whole text holds what it looks for, and the windows of a text are compared as strings only where
their hashes meet; equal windows have equal hashes, so none is missed.

Nulls and other cases: a null or empty text has no words and is rejected; lines without a word
are neither judged nor kept; null or repeated doc_ids are rows like any other; other columns are
passed over.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm.common import WORD

#: Symbols that prose rarely holds.
SYMBOLS = r"[#*$%&|<>]"
#: Closing punctuation at the end of a word; a line of prose holds some.
CLOSED = r"[.!?:;\"')\]\x{2026}\x{201D}\x{2019}\x{00BB}\x{3002}]([\x20\x09-\x0D]|$)"
#: Lines of fewer words, such as headings, need no closing punctuation.
HEADING_WORDS = 6
#: Phrases of boilerplate lines, in lower case.
BOILERPLATE = r"(cookie policy|privacy policy|terms of (use|service)|all rights reserved|click here|sign up|log in|subscribe to|javascript|skip to content|back to top|read more)"
#: Each match of BOILERPLATE holds one of these.
PHRASES = ("cookie policy", "privacy policy", "terms of ", "all rights reserved", "click here", "sign up", "log in", "subscribe to", "javascript", "skip to content", "back to top", "read more")
#: Percent of a document's words that line removal may cost.
MAX_LOST = 50
#: The low bits of a window's hash make room for its place in the text.
PLACE = (1 << 31) - 1


def line_failed(line, has_symbols=None, has_bangs=None, has_phrases=None):
    """Whether a line of text fails one of the rules. The flags say whether anything around the line holds what a rule looks for; without them all rules are tried."""
    has_symbols, has_bangs, has_phrases = [F.lit(True) if x is None else x for x in (has_symbols, has_bangs, has_phrases)]
    symbols = F.regexp_count(line, F.lit(SYMBOLS))
    words = F.regexp_count(line, F.lit(WORD))
    return (
        (has_symbols & ((F.regexp_count(line, F.lit(r"\|")) >= 3) | (symbols * 8 > F.length(line))))
        | (has_bangs & (F.regexp_count(line, F.lit("!!")) >= 3))
        | (has_phrases & F.regexp_like(F.lower(line), F.lit(BOILERPLATE)))
        | (~F.regexp_like(line, F.lit(CLOSED)) & (words >= HEADING_WORDS))
    )


def let(value, use):
    """use(value), the value being made once a row, also where the planner moves a filter on the result to the rows that it is made of."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(numbers):
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda acc, x: acc + x)


def repeated_words(placed, words):
    """Words in windows that come again, of the sorted hashes of all windows with their places in the low bits."""

    def neighbours(rows, same):
        """Rows of a sorted array that are the same as the one before or after."""
        return F.filter(rows, lambda x, i: F.coalesce(same(x, F.get(rows, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(rows, i + 1)), F.lit(False)))

    def grams(w, p):
        met = neighbours(p, lambda x, y: F.shiftright(x.bitwiseXOR(y), 31) == 0)
        places = F.transform(met, lambda x: x.bitwiseAND(F.lit(PLACE)).cast("int"))
        return F.sort_array(F.transform(places, lambda i: F.struct(F.concat_ws(" ", *[F.get(w, i + k) for k in range(3)]).alias("g"), i.alias("i"))))

    def starts(g):
        return F.sort_array(F.transform(neighbours(g, lambda x, y: x["g"] == y["g"]), lambda x: x["i"]))

    def covered(s):
        return total(F.transform(s, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(s, i + 1) - p, F.lit(3)))))

    return let(words, lambda w: let(placed, lambda p: let(grams(w, p), lambda g: let(starts(g), covered))))


def clean_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, clean_text, clean_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    w = docs.select(
        "doc_id", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"), F.split(text, "\n").alias("every_line"), F.lower(text).alias("lower"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"), F.contains(text, F.lit("!!")).alias("bangs"),
    )
    n = F.size("words")
    windows = F.arrays_zip(*[F.slice("words", k, F.greatest(n - 2, F.lit(0))) for k in (1, 2, 3)])
    w = w.select(
        "doc_id", "words", "n_symbols", F.transform(windows, lambda x: F.xxhash64(x)).alias("hashes"), F.filter("every_line", lambda x: F.regexp_like(x, F.lit(WORD))).alias("lines"),
        F.struct((F.col("n_symbols") > 0).alias("symbols"), "bangs", reduce(lambda a, b: a | b, [F.contains("lower", F.lit(x)) for x in PHRASES]).alias("phrases")).alias("flags"),
    )
    placed = F.sort_array(F.transform("hashes", lambda h, i: h.bitwiseAND(F.lit(~PLACE)).bitwiseOR(i.cast("long"))))
    meet = F.size(F.array_distinct("hashes")) < F.size("hashes")
    w = w.withColumn("placed", F.when(meet, placed).otherwise(F.array().cast("array<long>"))).drop("hashes")
    repeated = F.when(F.size("placed") > 0, repeated_words(F.col("placed"), F.col("words")))
    judged = let(F.col("flags"), lambda f: F.transform("lines", lambda x: F.struct(x.alias("line"), line_failed(x, f["symbols"], f["bangs"], f["phrases"]).alias("failed"))))
    w = w.withColumn("judged", judged)
    clean = F.transform(F.filter("judged", lambda x: ~x["failed"]), lambda x: x["line"])
    lost_words = total(F.transform(F.filter("judged", lambda x: x["failed"]), lambda x: F.regexp_count(x["line"], F.lit(WORD))))
    counted = w.select(
        "doc_id", n.cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.coalesce(repeated, F.lit(0)).alias("n_repeat_words"),
        F.array_join(clean, "\n").alias("clean_text"), (n - lost_words).alias("clean_words"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    lost = 100 * (F.col("n_words") - F.col("clean_words")) > MAX_LOST * F.col("n_words")
    return counted.withColumn("base_failed", failed).withColumn("kept", ~failed & ~lost)
