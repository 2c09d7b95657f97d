"""Writers (A12-A14, I8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.accuracy import map_column
from .. import constants as K


def write_bank(bank: DataFrame, path: str, **settings) -> None:
    """A12. The rows as Parquet and one JSON line of metadata: counts by type and category."""
    bank.write.mode("overwrite").parquet(f"{path}/questions")
    stored = bank.sparkSession.read.parquet(f"{path}/questions")
    metadata(stored, **settings).coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def metadata(bank: DataFrame, **settings) -> DataFrame:
    """A12/E19. One row of JSON. Types are a fixed list, so the maps stay small."""
    per = bank.groupBy("qtype").agg(F.count("*").alias("n"))
    category = map_column(K.TYPE_CATEGORY, F.col("qtype"))
    per_category = per.filter(category.isNotNull()).groupBy(category.alias("category")).agg(F.sum("n").alias("n"))
    clips = bank.select("clip").distinct().agg(F.count("*")).scalar()
    by_category = per_category.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n"))))).scalar()
    doc = per.agg(F.struct(
        F.sum("n").alias("num_questions"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("qtype", "n")))).alias("question_counts_by_type"),
        *[F.lit(v).alias(k) for k, v in settings.items()]).alias("d"))
    return doc.select(F.to_json(F.struct("d.*", clips.alias("num_videos"), by_category.alias("category_counts"))).alias("value"))


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """A13."""
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def append_checkpoints(results: DataFrame, path: str, compression: str = "none") -> None:
    """A14. One JSON line per clip, added to what is there. A clip's answers are one line by format."""
    rest = [c for c in results.columns if c not in ("clip", "timestamp")]
    lines = results.groupBy(F.col("clip").alias("video_name")).agg(
        F.max("timestamp").alias("timestamp"), F.count("*").alias("num_questions"),
        F.collect_list(F.struct(F.col("clip").alias("video_name"), *rest)).alias("results"))
    lines.write.mode("append").option("compression", compression).json(path)


def write_shards(df: DataFrame, path: str) -> None:
    """I8. One folder per shard."""
    df.write.mode("overwrite").partitionBy("shard").parquet(path)
