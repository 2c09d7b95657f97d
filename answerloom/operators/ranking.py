"""Ranking, top-k and lookups that hold when one group has a third of all rows (H, §4.3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hex_int, order_key
from ..session import settle

HOT_SHARE = 1000  # a key is hot above 1/1000 of all rows, so at most 1000 keys are

REPORT_SIZE = 1000  # up to here Spark trims groups before the shuffle


def _same(a: str, b: str, cols) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def hash_rank(df: DataFrame, keys, by=(), seed: int = 42, op: str = "", rank: str = "rank",
              size: str = "group_size") -> DataFrame:
    """Rank rows from 1 inside each `by` group in seeded md5 order, and add the group's size.

    Groups are split into 4096 even md5 ranges. Only the per-range counts are windowed over
    a whole group; rows are ranked inside a range and moved up by the ranges before it, so no
    task ever sees a whole group.
    """
    by, keys = list(by), list(keys)
    okey = order_key(seed, op, *[F.col(k) for k in keys])
    tagged = df.withColumn("_okey", okey).withColumn("_range", hex_int(F.col("_okey"), 1, 3).cast("int"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    counts = (
        tagged.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
        .select(
            *by, "_range",
            (F.sum("_n").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
            .alias("_before"),
            F.sum("_n").over(group).alias(size)))
    inside = Window.partitionBy(*by, "_range").orderBy("_okey", *keys)
    ranked = tagged.withColumn("_in", F.row_number().over(inside))
    on = _same("r", "c", by) & (F.col("r._range") == F.col("c._range"))
    return (
        ranked.alias("r").join(counts.alias("c"), on)
        .select(*[F.col(f"r.{c}") for c in df.columns],
                (F.col("c._before") + F.col("r._in")).alias(rank), F.col(f"c.{size}")))


def sorted_ordinal(df: DataFrame, order, ordinal: str = "ordinal", by=()) -> DataFrame:
    """Number rows from 0 in natural order, inside each `by` group when given.

    A range sort spreads any group over many partitions; the sorted rows are stored so
    that partition offsets, counted afterwards, stay true.
    """
    by, order = list(by), list(order)
    spread = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    fixed = settle(spread.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = fixed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    running = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    offsets = counts.select("_part", (F.sum("_n").over(running) - F.col("_n")).alias("_before"))
    # one row per shuffle partition
    numbered = (
        fixed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
        .withColumn(ordinal, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1))
        .drop("_part", "_before", "_at"))
    if not by:
        return numbered
    starts = numbered.groupBy(*by).agg(F.min(ordinal).alias("_start"))
    return (
        numbered.alias("r").join(starts.alias("c"), _same("r", "c", by))
        .select(*[F.col(f"r.{c}") for c in df.columns], (F.col(f"r.{ordinal}") - F.col("c._start")).alias(ordinal)))


def running_total(df: DataFrame, order, value: str, out: str = "running") -> DataFrame:
    """Running sum of `value` in natural order over any number of rows, without a single-task window."""
    order = list(order)
    tagged = df.select("*", *[o.alias(f"_o{i}") for i, o in enumerate(order)])
    names = [f"_o{i}" for i in range(len(order))]
    spread = tagged.repartitionByRange(*names).sortWithinPartitions(*names)
    fixed = settle(spread.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sums = fixed.groupBy(part.alias("_part")).agg(F.sum(value).alias("_sum"))
    running = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    offsets = sums.select("_part", (F.sum("_sum").over(running) - F.col("_sum")).alias("_before"))
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    return (
        fixed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_before") + F.sum(value).over(inside)).select(*df.columns, out))


def top_k(df: DataFrame, k: int, order, by=()) -> DataFrame:
    """The first k rows per group in a total order.

    For report-sized k Spark trims to k per group before the shuffle; beyond that a range sort numbers the rows, so
    that no group has to fit in one task (this runs jobs while the plan is built).
    """
    if k > REPORT_SIZE:
        return sorted_ordinal(df, order, "_rn", by).filter(F.col("_rn") < k).drop("_rn")
    window = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= k).drop("_rn")


def last_per_key(df: DataFrame, keys, order) -> DataFrame:
    """F2. One row per key: the last one in `order`. Partial aggregation keeps a repeated key cheap."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def first_per_key(df: DataFrame, keys, order) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def lookup(fact: DataFrame, dim: DataFrame, on: str, values, weight: str, spread: Column) -> DataFrame:
    """Left-join `values` from `dim` (one row per `on`) where a few keys may carry most of the fact.

    `weight` is the key's row count in the fact. Keys above 1/1000 of the rows, of which there
    are fewer than 1000, are broadcast; the rest is a shuffle join, in which hot and missing
    keys are spread by `spread` so that none lands in one task.
    """
    values, dim = list(values), settle(dim)  # read three times below
    total = dim.agg(F.sum(weight)).scalar()
    hot = dim.filter(F.col(weight) * HOT_SHARE > total).select(F.col(on).alias("_hot"), *[F.col(v).alias(f"_h_{v}") for v in values])
    cold = dim.select(F.col(on).alias("_cold"), *[F.col(v).alias(f"_c_{v}") for v in values])
    first = fact.join(F.broadcast(hot), F.col(on) == F.col("_hot"), "left")
    away = F.concat(F.lit("\u0001"), spread.cast("string"))
    first = first.withColumn(
        "_key", F.when(F.col("_hot").isNull() & F.col(on).isNotNull(), F.col(on).cast("string")).otherwise(away))
    return (
        first.join(cold.withColumn("_cold", F.col("_cold").cast("string")), F.col("_key") == F.col("_cold"), "left")
        .select(*fact.columns, *[F.coalesce(f"_h_{v}", f"_c_{v}").alias(v) for v in values]))


def evenly_spaced(n: Column, k: int) -> Column:
    """H9. k evenly spaced positions among n, halves to even; the middle one when k is 1."""
    if k == 1:
        return F.array(F.floor(n / 2).cast("bigint"))
    steps = F.sequence(F.lit(0), F.lit(k - 1))
    spaced = F.transform(steps, lambda i: F.bround(i * ((n - 1) / F.lit(float(k - 1)))).cast("bigint"))
    return F.when(n <= k, F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)).otherwise(spaced)
