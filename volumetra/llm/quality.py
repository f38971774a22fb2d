"""Quality rules, line first [native].

Every line is judged by three rules; failing lines are removed; a document that
loses more than `max_lost` of its visible characters is rejected.

* punctuation: symbols and exclamation marks are more than `max_symbols` of the
  line's visible characters;
* navigation: at least three menu separators, and at most four words between
  two of them on average;
* boilerplate: a line of at most `boilerplate_words` words with one of the
  phrases below.

Counts beside the verdict are taken from the whole, uncleaned text. All work is
done inside the row, so no key can be hot and nothing is shuffled. Cost grows
as n log n with the length of a text.

Null and empty texts have no words and fail the base rule. Other columns pass
through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volumetra.llm.common import ascii_words, let, whole_text

BOILERPLATE = ("cookie policy", "accept cookies", "privacy policy", "terms of service", "terms of use", "all rights reserved", "subscribe to our newsletter", "click here", "enable javascript", "share this", "sign up for", "skip to content", "lorem ipsum")
SYMBOLS = r"[#*$%&|<>!{}\[\]~^=\\]"
BASE_SYMBOLS = r"[#*$%&|<>]"
SEPARATORS = "[|>»•·]"
VISIBLE = "[\x20\x09-\x0d]+"
WINDOW = 5


def visible(text: Column) -> Column:
    """Code points outside ASCII white space."""
    for c in " \t\x0b\f\r\n":
        text = F.replace(text, F.lit(c), F.lit(""))
    return F.length(text)


def any_of(text: Column, phrases) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | F.contains(text, F.lit(p))
    return found


def bad_line(line: Column, max_symbols: float, boilerplate_words: int) -> Column:
    symbols = F.length(line) - F.length(F.regexp_replace(line, SYMBOLS, ""))
    words = F.size(ascii_words(line))
    separators = F.length(line) - F.length(F.regexp_replace(line, SEPARATORS, ""))
    punctuation = symbols > max_symbols * visible(line)
    navigation = (separators >= 3) & (words <= 4 * (separators + 1))
    boilerplate = (words <= boilerplate_words) & any_of(F.lower(line), BOILERPLATE)
    return punctuation | navigation | boilerplate


def clean_text(text: Column, max_symbols: float = 0.12, boilerplate_words: int = 25) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: ~bad_line(x, max_symbols, boilerplate_words))
    return F.array_join(lines, "\n")


def repeated_words(words: Column) -> Column:
    """How many words stand in a 5-word window found twice or more."""

    def grams(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(*[F.get(h, i + (j - 1)) for j in range(WINDOW)]))

    def starts(g: Column) -> Column:
        def repeated(s: Column) -> Column:
            found = F.filter(s, lambda x, j: (F.get(s, j - 1)["g"] == x["g"]) | (F.get(s, j + 1)["g"] == x["g"]))
            return F.sort_array(F.transform(found, lambda x: x["i"]))

        return let(F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i")))), repeated)

    def covered(p: Column) -> Column:
        zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), x - acc["last"])).cast("long").alias("n"))
        return F.aggregate(p, zero, step, lambda acc: acc["n"])

    def count(g: Column) -> Column:
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(covered(starts(g)))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(let(hashes, lambda h: let(grams(h), count)))


def quality(docs: DataFrame, text: str = "text", max_symbols: float = 0.12, boilerplate_words: int = 25, max_lost: float = 0.5) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, clean_chars, kept and clean_text."""
    whole = whole_text(text)
    words = ascii_words(whole)
    with_word = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike("[^\x20\x09-\x0d]"))
    out = docs.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": visible(whole).cast("long"),
            "n_symbols": (F.length(whole) - F.length(F.regexp_replace(whole, BASE_SYMBOLS, ""))).cast("long"),
            "n_dup_lines": let(with_word, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": repeated_words(words),
            "clean_text": clean_text(whole, max_symbols, boilerplate_words),
        }
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = out.withColumn("clean_chars", visible(F.col("clean_text")).cast("long"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("clean_chars") >= (1 - max_lost) * F.col("word_chars")))
