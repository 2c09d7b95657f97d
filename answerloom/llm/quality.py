"""Line-first cleaning with document rules, in DataFrame functions only.

Every line that has a word is judged alone: it must end like prose, must not look like a menu, must not be a
boilerplate sentence, must not be mostly symbols or shouting, and must not repeat an earlier line of its text.
Failing lines are removed. A document is rejected if its base rule fails or if the removed lines held more than
`MAX_LOST` of its lines' characters.

Defined cases: a null, empty or blank text has no words, fails the base rule and cleans to an empty text; null or
repeated doc_ids are judged row by row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, words_of

MIN_WORDS = 50
MAX_REPEATED = 50  # percent of the words that lie in repeated 3-word windows
MAX_LOST = 0.5  # share of the lines' characters in removed lines
SYMBOL = "[#*$%&|<>]"

# Phrases of page furniture and licence notes, matched in lower case.
BOILERPLATE = (
    "licensed under", "all rights reserved", "copyright", "terms of use", "terms of service", "privacy policy", "cookie",
    "javascript", "subscribe to", "sign up", "log in to", "click here", "read more", "share this", "powered by",
    "lorem ipsum", "creative commons")
LOUD = "[#*$%&|<>!?]"
MENU = "[|•»][^|•»]*[|•»][^|•»]*[|•»]"  # three separators
PROSE_END = "[.!?:;…。！？][\"'”’»)\\]]*\\s*$"


def line_fails(line: Column) -> Column:
    """Whether a line that has a word breaks a punctuation, navigation or boilerplate rule."""
    lower, boilerplate = F.lower(line), F.lit(False)
    for phrase in BOILERPLATE:
        boilerplate = boilerplate | lower.contains(phrase)
    return (
        ~line.rlike(PROSE_END) | line.rlike(MENU) | (F.regexp_count(line, F.lit(LOUD)) * 10 > F.length(line)) | boilerplate)


def _ranked(hashes: Column) -> Column:
    """Windows as (hash, position), equal hashes side by side."""
    return F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def _covered(ranked: str) -> Column:
    """How many words lie in 3-word windows that occur twice or more; `ranked` names a stored column, read by position."""
    repeats = F.filter(F.col(ranked), lambda x, i: (
        F.coalesce(F.get(ranked, i - 1)["h"] == x["h"], F.lit(False))
        | F.coalesce(F.get(ranked, i + 1)["h"] == x["h"], F.lit(False))))
    return F.aggregate(
        F.sort_array(F.transform(repeats, lambda x: x["i"])),
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("free")),
        lambda a, i: F.struct(
            (a["n"] + 3 - F.greatest(a["free"] - i, F.lit(0))).cast("bigint").alias("n"), (i + 3).alias("free")),
        lambda a: a["n"])


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, lost_share and the cleaned text of every row."""
    read = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    cut = read.withColumns({
        "_words": words_of(F.col("_text")),
        "_lines": F.filter(F.split("_text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))})
    counted = cut.select(
        "doc_id", "_text", "_lines", F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOL)).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.size("_words") >= 4, F.transform(
            F.sequence(F.lit(0), F.size("_words") - 3),
            lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))).alias("_hashes"))
    repeated = F.size("_hashes") > F.size(F.array_distinct("_hashes"))
    rated = counted.withColumn("_ranked", F.when(repeated, _ranked(F.col("_hashes")))).withColumns({
        "n_repeat_words": F.coalesce(_covered("_ranked"), F.lit(0).cast("bigint")),
        # the earlier lines of a text are looked up by its distinct lines, in order
        "_good": F.filter(F.array_distinct("_lines"), lambda x: ~line_fails(x))})
    lost = 1 - F.length(F.array_join("_good", "")) / F.greatest(F.length(F.array_join("_lines", "")), F.lit(1))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return rated.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        (~base & (lost <= MAX_LOST)).alias("kept"), lost.alias("lost_share"), F.array_join("_good", "\n").alias("clean_text"))
