"""Near-equal shards by sampled splitters, in DataFrame functions only.

Records are ordered by (md5 of the text, doc_id), so equal texts lie side by side and a group of copies of any
size can be cut. A size-weighted sample of keys gives quantile boundaries, the records are range-partitioned by
them, and a range that is still overfull is cut again by a denser sample of its own keys. Running sums inside a
range, moved up by the ranges before it, give each record its place in the byte order, and with it shard and slot.

Law `bytes`: shard = floor(shards * bytes before the record / all bytes), so shards differ by about one record.

Defined cases: a null text counts as empty (size 1, crc 0); null doc_ids come first among equal texts; repeated
rows get slots of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

RANGES_PER_SHARD = 32
SAMPLES_PER_RANGE = 12


def _records(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("key"))


def _chance() -> Column:
    """A number from 0 to 1 that depends on the record alone."""
    return F.pmod(F.xxhash64("key", "doc_id"), F.lit(1 << 40)) / float(1 << 40)


def _sample(records: DataFrame, step: float) -> list[tuple[str, int | None, float]]:
    """Keys drawn with probability size / step, at most 1, each with the bytes it stands for."""
    drawn = records.filter(_chance() < F.col("size") / F.lit(float(step)))
    rows = drawn.select("key", "doc_id", "size").collect()  # about total / step rows
    return sorted(((r["key"], r["doc_id"], max(float(r["size"]), step)) for r in rows), key=_order)


def _order(row) -> tuple:
    return row[0], row[1] is not None, row[1] or 0


def _quantiles(sample, ranges: int) -> list[tuple[str, int | None]]:
    """Up to ranges - 1 keys at equal steps of the sample's weight."""
    total, seen, out = sum(w for *_, w in sample), 0.0, []
    for key, doc, weight in sample:
        seen += weight
        if seen * ranges >= total * (len(out) + 1) and seen < total and (not out or out[-1] != (key, doc)):
            out.append((key, doc))
            while seen * ranges >= total * (len(out) + 1) and len(out) < ranges - 1:
                out.append((key, doc))
    return sorted(set(out), key=_order)


def _range_of(splitters) -> Column:
    """How many splitters are at or below the record, by binary search in a constant array."""
    if not splitters:
        return F.lit(0)
    spark_rows = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(d).cast("bigint").alias("doc_id")) for k, d in splitters])
    own = F.struct("key", F.col("doc_id"))
    steps, width = [], 1
    while width <= len(splitters):
        steps.insert(0, width)
        width *= 2
    return F.aggregate(
        F.array(*map(F.lit, steps)), F.lit(0),
        lambda at, step: F.when(F.get(spark_rows, at + step - 1) <= own, at + step).otherwise(at))


def shard_records(docs: DataFrame, shards: int = 16, ranges_per_shard: int = RANGES_PER_SHARD) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of `docs`.

    Runs jobs while the plan is built: the total, the sample, the range sizes, and one stored table of records
    without their texts. The driver holds the sampled keys and the range sizes only, whose number depends on
    `shards` and not on the data.
    """
    records = settle(_records(docs))
    total = records.agg(F.sum("size")).first()[0] or 0
    ranges = shards * ranges_per_shard
    target = max(1.0, total / ranges)
    splitters = _quantiles(_sample(records, target / SAMPLES_PER_RANGE), ranges)
    while True:
        cut = records.withColumn("part", _range_of(splitters))
        sizes = {r["part"]: (r["bytes"], r["most"]) for r in cut.groupBy("part").agg(
            F.sum("size").alias("bytes"), F.max("size").alias("most")).collect()}
        overfull = [p for p, (size, most) in sizes.items() if size > 2 * target + most]
        if not overfull:
            break
        inside = _sample(cut.filter(F.col("part").isin(overfull)), target / (4 * SAMPLES_PER_RANGE))
        more = set(_quantiles(inside, 4 * len(overfull) + 1)) - set(splitters)
        if not more:
            break  # equal records alone fill these ranges
        splitters = sorted({*splitters, *more}, key=_order)
    before, offsets = 0, []
    for part in sorted(sizes):
        offsets.append((part, before))
        before += sizes[part][0]
    spark = docs.sparkSession
    starts = spark.createDataFrame(offsets, "part int, before bigint")
    inside = Window.partitionBy("part").orderBy("key", F.col("doc_id").asc_nulls_first())
    placed = settle(
        cut.join(F.broadcast(starts), "part")  # one row a range
        .withColumn("at", F.col("before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("nth", F.row_number().over(inside).cast("bigint"))
        .withColumn("shard", F.expr(f"cast(at * {shards} div {max(total, 1)} as int)"))
        .select("doc_id", "size", "text_crc32", "part", "nth", "shard"))
    # A record's slot is its number in its range less that of the first one in its shard, plus the shard's rows in earlier ranges.
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"), F.min("nth").alias("first"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    moved = counts.select("shard", "part", (F.sum("n").over(earlier) - F.col("n") - F.col("first")).alias("move"))
    return placed.join(F.broadcast(moved), ["shard", "part"]).select(  # at most ranges + shards rows
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("nth") + F.col("move")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
