"""Role confusion and directional bias."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.matching import exact_role, loose_role, selected_role
from .accuracy import share_of


def confusion(df: DataFrame, true: str, pred: str, by=("model",), known=None) -> DataFrame:
    """D13. Counts of (true, predicted) with each true row's share; pairs with an unknown side are skipped."""
    both = df.filter(F.col(true).isNotNull() & F.col(pred).isNotNull())
    if known is not None:
        both = both.filter(F.col(true).isin(*known) & F.col(pred).isin(*known))
    out = both.groupBy(*by, true, pred).agg(F.count("*").alias("n"))
    return out.withColumn("row_share", share_of(out, "n", [*by, true]))


def role_pairs(results: DataFrame, loose: bool = False) -> DataFrame:
    """Label-question answers as true and predicted role; both NULL where the row has to be skipped.

    `loose` matches labels in both directions and lets a negative key through, as the bias
    report does; the confusion matrix wants exact labels and indexes in range.
    """
    role = loose_role if loose else exact_role
    n, key, got = F.size("answers"), F.col("correct_index"), F.col("selected")
    usable = key.isNotNull() & got.isNotNull() & (got >= 0) & (key >= 0) & (key < n) & (got < n)
    rows = results.filter(F.col("qtype") == "role_identification")
    return rows.select(
        "model", F.when(usable, role(F.get("answers", key))).alias("true_role"),
        F.when(usable, role(F.get("answers", got))).alias("pred_role"))


def skipped(pairs: DataFrame) -> DataFrame:
    known = F.col("true_role").isNotNull() & F.col("pred_role").isNotNull()
    return pairs.groupBy("model").agg(F.count("*").alias("total"), F.count_if(~known).alias("skipped"))


def role_confusion(results: DataFrame, clips: DataFrame) -> DataFrame:
    """D14. Whom the model pointed at in the two person questions, by description."""
    asked = F.when(F.col("qtype") == "aggressor_identification", "aggressor").when(
        F.col("qtype") == "victim_recognition", "victim")
    rows = results.filter(F.col("error").isNull()).withColumn("true_role", asked).filter("true_role is not null")
    people = clips.select("clip", "aggressor", "victim", "bystanders", F.lit(True).alias("annotated"))
    joined = rows.join(people, "clip", "left").withColumn("_text", F.get("answers", F.col("selected")))
    pred = (
        F.when(F.col("is_correct"), F.col("true_role"))
        .when(F.col("_text").isNull() | F.col("annotated").isNull(), "unknown/cross-video")
        .otherwise(selected_role(F.col("_text"), F.col("aggressor"), F.col("victim"), F.col("bystanders"))))
    out = joined.select("model", "true_role", pred.alias("pred_role")).groupBy(
        "model", "true_role", "pred_role").agg(F.count("*").alias("n"))
    return out.withColumn("row_share", share_of(out, "n", ["model", "true_role"]))


def directional_bias(confused: DataFrame) -> DataFrame:
    """D15. Swap rates between the roles, how often 'Aggressor' is predicted, and the bias ratio."""
    def cell(true=None, pred=None):
        keep = F.lit(True)
        if true:
            keep = keep & (F.col("true_role") == true)
        if pred:
            keep = keep & (F.col("pred_role") == pred)
        return F.coalesce(F.sum(F.when(keep, F.col("n"))), F.lit(0))

    def rate(true, pred, name):
        return (cell(true, pred) * 100.0 / F.greatest(cell(true), F.lit(1))).alias(name)

    out = confused.groupBy("model").agg(
        rate("Victim", "Aggressor", "vic_to_agg"), rate("Aggressor", "Victim", "agg_to_vic"),
        rate("Bystander", "Aggressor", "byst_to_agg"), rate(None, "Aggressor", "agg_pred_rate"))
    return out.withColumn("bias_ratio", F.col("vic_to_agg") / F.greatest(F.col("agg_to_vic"), F.lit(0.1)))


def bias_overview(bias: DataFrame) -> DataFrame:
    """D15/H6. Medians over the models, how many lean to 'Aggressor', and the worst one."""
    return bias.agg(
        F.median("vic_to_agg").alias("median_vic_to_agg"), F.median("agg_to_vic").alias("median_agg_to_vic"),
        F.median("byst_to_agg").alias("median_byst_to_agg"),
        F.count_if(F.col("vic_to_agg") > F.col("agg_to_vic")).alias("biased_models"), F.count("*").alias("models"),
        F.max("vic_to_agg").alias("worst_vic_to_agg"), F.max_by("model", "vic_to_agg").alias("worst_model"))
