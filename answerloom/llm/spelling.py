"""Spelling variants: words one edit apart, found by asymmetric q-chunks, and the form that each variant stands for.

Of two near words the longer one (or either, if equally long) contributes two disjoint chunks, its first and its last
half; the other contributes its positional grams. One edit leaves a chunk whole, at a place that moves by one at most,
and inside the half that it hits it leaves one of two smaller chunks whole. So a key is a chunk, where it stands, and
one chunk of the other half, and frequent beginnings or endings alone bring no words together. Pairs that share a key
are verified.

Defined cases: a null or empty text has no words; a null doc_id counts as an empty string where runs are misspelt;
repeated rows count as often as they stand there; ties between forms go to the smaller word in code-point order; an
empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .common import lower_az

LEAST_LENGTH, LEAST_COUNT = 6, 5
FORM_TIMES = 5  # a form occurs so many times as often
MISSPELT = 199  # one run in so many loses a code point
LETTERS = "[A-Za-z\\u00C0-\\u00FF]+"


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n: the words of all texts, after the runs that the rule picks have lost a letter."""
    runs = docs.select(F.col("doc_id").cast("string").alias("doc"), F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("raw"))
    runs = runs.select("doc", lower_az(F.col("raw")).alias("run")).filter(F.length("run") >= LEAST_LENGTH)
    drawn = F.crc32(F.concat(F.coalesce("doc", F.lit("")), F.lit(":"), F.col("run")))
    at = (drawn % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(drawn % MISSPELT == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _cut(word: Column, start: Column, size: Column) -> Column:
    return F.substring(word, (start + 1).cast("int"), size.cast("int"))


def _key(size: Column, word: Column, *parts: tuple[str, Column, Column]) -> Column:
    """A hash of the longer word's length and of pieces of `word`, each with the name of the chunk it stands for."""
    return F.xxhash64(size, *[F.concat(F.lit(name), _cut(word, start, n)) for name, start, n in parts])


def _chunks(size: Column) -> list[tuple[tuple[str, Column, Column], tuple[str, Column, Column]]]:
    """For words of `size` code points: (kept half, kept part of the other half), each as (name, start, length)."""
    half, rest = F.floor(size / 2), size - F.floor(size / 2)
    a, b = F.floor(half / 2), F.floor(rest / 2)
    zero = F.lit(0)
    first, last = ("first", zero, half), ("last", half, rest)
    return [
        (first, ("third", half, b)), (first, ("fourth", half + b, rest - b)),
        (last, ("one", zero, a)), (last, ("two", a, half - a))]


def chunk_keys(words: DataFrame) -> DataFrame:
    """key and word, by which a word looks for words that are as long or one shorter."""
    size = F.length("word")
    keys = F.array(*[_key(size, F.col("word"), *pair) for pair in _chunks(size)])
    return words.select("word", "n", F.explode(F.array_distinct(keys)).alias("key"))


def gram_keys(words: DataFrame) -> DataFrame:
    """key and word: the positional grams that may equal a chunk of a word as long, or one longer, within shift one.

    In a word as long every chunk stands where it stood; in a word that lost a letter, the chunks behind the letter have
    moved by one. A lost letter in the half that is kept in part leaves its first part in place and moves its last part.
    """
    word, size = F.col("word"), F.length("word")
    same = [_key(size, word, *pair) for pair in _chunks(size)]
    longer = size + 1
    moved = []
    for (name, start, n), (part, at, m) in _chunks(longer):
        shift = 1 if name == "last" else 0  # the letter is lost in front of it, or behind it
        inner = 1 if part in ("fourth", "two") else 0
        moved.append(_key(longer, word, (name, start - shift, n), (part, at - inner, m)))
    return words.select("word", "n", F.explode(F.array_distinct(F.array(*same, *moved))).alias("key"))


def near_words(words: DataFrame) -> DataFrame:
    """a, b, n_a and n_b: the pairs of different words that one inserted, deleted or replaced code point tells apart, in both directions."""
    by_chunk = chunk_keys(words).select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
    by_gram = gram_keys(words).select("key", F.col("word").alias("b"), F.col("n").alias("n_b"))
    found = by_chunk.join(by_gram, "key").filter(
        (F.length("a") > F.length("b")) | ((F.length("a") == F.length("b")) & (F.col("a") < F.col("b"))))
    near = found.filter(F.levenshtein("a", "b", 1) == 1).select("a", "b", "n_a", "n_b").distinct()
    return near.union(near.select("b", "a", "n_b", "n_a"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root, for every word with a form (word, form), by pointer jumping. A form is more frequent, so paths end."""
    held = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        step = held.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = settle(held.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        held = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return held


def group_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n for every word. Runs jobs while the plan is built."""
    words = settle(word_counts(docs))
    best = F.min(F.when(F.col("n_b") >= FORM_TIMES * F.col("n_a"), F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("word"))))
    near = settle(near_words(words).groupBy("a").agg(F.count("*").alias("n_near"), best.alias("best")).select(
        F.col("a").alias("word"), "n_near", F.col("best.word").alias("form"), (-F.col("best.less")).alias("form_n")))
    found = roots(near.filter("form is not null"))
    return words.join(near, "word", "left").join(found, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")
