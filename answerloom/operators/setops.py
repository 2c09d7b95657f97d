"""Joins and set operations on banks and result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .ranking import first_per_key, last_per_key


def match_bank(results: DataFrame, bank: DataFrame, key=("clip", "prompt"), *, order, columns=()) -> DataFrame:
    """F1. Results with bank columns; the bank is reduced to its last row per key first (F2)."""
    index = last_per_key(bank.select(*key, *columns, *order), list(key), order)
    return results.join(index.select(*key, *[F.col(c).alias(f"bank_{c}") for c in columns]).hint("merge"), list(key))


def match_counts(results: DataFrame, bank: DataFrame, key=("clip", "prompt")) -> DataFrame:
    """F1. How many results the bank knows. Keys are counted first, so a hot key is one row."""
    keys = bank.select(*key).distinct().withColumn("_hit", F.lit(True))
    per_key = results.groupBy(*key).agg(F.count("*").alias("n"))
    return per_key.join(keys.hint("merge"), list(key), "left").agg(
        F.sum(F.when(F.col("_hit"), F.col("n")).otherwise(0)).alias("matched"),
        F.sum(F.when(F.col("_hit").isNull(), F.col("n")).otherwise(0)).alias("unmatched"))


def kept_by(df: DataFrame, keep: DataFrame, key) -> DataFrame:
    """F4/B29. Rows whose key is in `keep`."""
    return df.join(keep.select(*key), list(key), "left_semi")


def remaining(df: DataFrame, done: DataFrame, key) -> DataFrame:
    """F5. Rows still to do: those whose key is not in `done`."""
    return df.join(done.select(*key), list(key), "left_anti")


def bank_delta(full: DataFrame, baseline: DataFrame) -> DataFrame:
    """F6. Questions whose (clip, type) the baseline does not have."""
    return remaining(full, baseline, ["clip", "qtype"])


def other_group_counts(questions: DataFrame, train: DataFrame) -> DataFrame:
    """F7. For each question, how many training questions of its type and trick flag come from
    another parent group. Clips without a group count as one group (null-safe comparison).

    Only counts are needed, so bucket totals and own-group totals replace the pairwise join.
    """
    bucket = ["qtype", "is_trick"]
    own = train.groupBy(*bucket, "group_id").agg(F.count("*").alias("own"))
    total = own.groupBy(*bucket).agg(F.sum("own").alias("total"))
    q = questions.select("clip", *bucket, "group_id").alias("q")
    same = (
        (F.col("q.qtype") == F.col("o.qtype")) & (F.col("q.is_trick") == F.col("o.is_trick"))
        & F.col("q.group_id").eqNullSafe(F.col("o.group_id")))
    return (
        q.join(total, bucket).join(own.alias("o"), same, "left")
        .select("q.clip", "q.qtype", "q.is_trick", (F.col("total") - F.coalesce("own", F.lit(0))).alias("candidates")))


def with_chains(examples: DataFrame, chains: DataFrame, order) -> DataFrame:
    """F9. Attach reasoning where a chain was used, the last one in `order`."""
    used = chains.filter(F.col("used_cot") & F.col("reasoning_chain").isNotNull()).select(
        "clip", "question_index", "reasoning_chain", F.struct(*order).alias("_order"))
    last = last_per_key(used, ["clip", "question_index"], ["_order"]).drop("_order")
    return examples.join(last, ["clip", "question_index"], "left")


def all_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """F10. The union of two key sets."""
    return a.select(key).union(b.select(key)).distinct()


def stack_all(parts: list[DataFrame]) -> DataFrame:
    """F11."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def insert_missing(base: DataFrame, new: DataFrame, key, order) -> DataFrame:
    """F12. Base rows plus new rows whose key is absent; the first new row per key counts."""
    return base.unionByName(remaining(first_per_key(new, list(key), list(order)), base, key).select(*base.columns))


def insert_report(base: DataFrame, new: DataFrame, key) -> DataFrame:
    """F12. How many new rows were added and how many skipped."""
    per_key = new.groupBy(*key).agg(F.count("*").alias("n"))
    known = base.select(*key).distinct().withColumn("_known", F.lit(True))
    return per_key.join(known, list(key), "left").agg(
        F.count_if(F.col("_known").isNull()).alias("added"),
        (F.sum("n") - F.count_if(F.col("_known").isNull())).alias("skipped"))


def replace_type(base: DataFrame, new: DataFrame, qtype: str) -> DataFrame:
    """F13. Drop one question type and put its new results in."""
    return base.filter(F.col("qtype") != qtype).unionByName(new.filter(F.col("qtype") == qtype))


def filter_bank(bank: DataFrame, drop_trick: bool = False) -> DataFrame:
    """F15. Without secondary (and trick) questions; clips left empty disappear."""
    kept = bank.filter(~F.col("is_secondary"))
    return kept.filter(~F.col("is_trick")) if drop_trick else kept


def filter_report(bank: DataFrame, drop_trick: bool = False) -> DataFrame:
    second = F.col("is_secondary")
    trick = ~second & F.col("is_trick") & F.lit(drop_trick)
    per = bank.groupBy("clip").agg(
        F.count("*").alias("n"), F.count_if(second).alias("s"), F.count_if(trick).alias("t"))
    left = F.col("n") - F.col("s") - F.col("t")
    return per.agg(
        F.sum("n").alias("before"), F.sum("s").alias("dropped_secondary"), F.sum("t").alias("dropped_trick"),
        F.sum(left).alias("kept"), F.count_if(left == 0).alias("emptied_clips"))


def merge_chains(parts: list[DataFrame], train: DataFrame) -> DataFrame:
    """F16. Chain parts plus the training rows no chain is made for."""
    direct = train.filter(~F.col("qtype").isin(*K.CHAIN_TYPES)).withColumn("used_cot", F.lit(False))
    return stack_all([*parts, direct])


def chain_coverage(merged: DataFrame) -> DataFrame:
    return merged.groupBy("qtype").agg(F.count("*").alias("total"), F.count_if("used_cot").alias("cot"))


def split_overlap(splits: DataFrame, key: str = "clip") -> DataFrame:
    """F17. Keys that sit in more than one split; empty when the splits are disjoint."""
    return splits.select(key, "split").distinct().groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def pools_without(pool: DataFrame, other: DataFrame) -> DataFrame:
    """F18."""
    return pool.select("value").distinct().exceptAll(other.select("value").distinct())
