"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = "[\\x20\\x09-\\x0D]+"  # what parts words; every other character belongs to a word


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Keep Arrow batches of whole texts small, so that a Python worker holds few long texts at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that begins with `name` and that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words_of(text: Column) -> Column:
    """Words of a text in order; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once, wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), use), 0)


def shingles_of(words: Column, n: int) -> Column:
    """One 64-bit hash for each window of n words, in order; a shorter text is one window, an empty one none."""
    return bound(words, lambda held: _shingles(held, n))


def _shingles(words: Column, n: int) -> Column:
    size = F.size(words)
    windows = F.transform(
        F.sequence(F.lit(1), size - n + 1), lambda i: F.xxhash64(*[F.element_at(words, i + k) for k in range(n)]))
    whole = F.array(F.xxhash64(F.concat_ws("\u0001", words), F.lit(0)))
    return F.when(size >= n, windows).when(size > 0, whole).otherwise(F.array().cast("array<bigint>"))


def lower_az(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
