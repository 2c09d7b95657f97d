"""Sampling, splitting and sharding.

All draws are seeded md5 orders, so they repeat, and ranks come from `hash_rank`, which
never puts a whole stratum in one task.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import order_key, uniform
from .ranking import hash_rank, sorted_ordinal, top_k


def sample_exact(df: DataFrame, keys, amount: float | int, rounding: str = "ceil", seed: int = 42,
                 op: str = "sample") -> DataFrame:
    """I1/I3. A share (float) or a number (int) of the rows, exactly that many."""
    ranked = hash_rank(df, keys, seed=seed, op=op, rank="_rank", size="_size")
    if isinstance(amount, float):
        whole = F.ceil if rounding == "ceil" else F.floor
        cut = F.greatest(whole(F.col("_size") * amount), F.lit(1))
    else:
        cut = F.lit(amount)
    return ranked.filter(F.col("_rank") <= cut).drop("_rank", "_size")


def sample_per_group(df: DataFrame, by, keys, n: int, seed: int = 42, op: str = "per_group") -> DataFrame:
    """I2. n rows of every group; Spark trims to n per group before it shuffles."""
    return top_k(df, n, [order_key(seed, op, *[F.col(k) for k in keys]), *[F.col(k) for k in keys]], by=by)


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, reserved: str = "none",
                      share: float = 0.15, seed: int = 42) -> DataFrame:
    """I4. A reserved share for one stratum, the rest evenly over the others.

    The remainder goes to the first strata by name, short strata are not refilled, and no
    more than n rows come back, the first ones in a seeded order. Any n and any number of strata: strata are numbered and
    rows are cut by range sorts, no single task sees them all (this runs jobs while the plan is built).
    """
    kept = max(1, int(n * share))
    rest = n - kept
    ranked = hash_rank(df, [key], by=[stratum], seed=seed, op="strata", rank="_rank", size="_size")
    others = df.filter(F.col(stratum) != reserved).select(stratum).distinct()
    strata = others.agg(F.greatest(F.count("*"), F.lit(1))).scalar()
    per = F.greatest(F.floor(F.lit(rest) / strata), F.lit(1))
    extra = F.lit(rest) - per * strata
    # No stratum gives more than this, so what is joined and cut is about n rows, however large a stratum is.
    near = ranked.filter(F.col("_rank") <= F.greatest(F.lit(kept), per + 1))
    numbered = sorted_ordinal(others, [stratum], "_no").select(F.col(stratum).alias("_stratum"), "_no")
    quota = F.when(F.col(stratum) == reserved, F.lit(kept)).otherwise(per + F.when(F.col("_no") < extra, 1).otherwise(0))
    chosen = near.join(numbered, F.col(stratum) == F.col("_stratum"), "left").filter(F.col("_rank") <= quota)
    return top_k(chosen.select(*df.columns), n, [order_key(seed, "strata_cut", F.col(key)), F.col(key)])


def diverse_sample(df: DataFrame, by, stratum: str, keys, n: int, seed: int = 42) -> DataFrame:
    """I5. n rows per group, taken round-robin over the strata in a seeded order."""
    first = top_k(df, n, [order_key(seed, "diverse", *[F.col(k) for k in keys]), *[F.col(k) for k in keys]],
                  by=[*by, stratum])
    inside = Window.partitionBy(*by, stratum).orderBy(
        order_key(seed, "diverse", *[F.col(k) for k in keys]), *keys)
    rounds = first.withColumn("_round", F.row_number().over(inside))
    turn = order_key(seed, "stratum", *[F.col(b) for b in by], F.coalesce(F.col(stratum), F.lit("unknown")))
    return top_k(rounds, n, [F.col("_round"), turn, *[F.col(k) for k in keys]], by=by).drop("_round")


def group_split(clips: DataFrame, group: str | None = "group_id", stratum: str = "action", train: float = 0.2,
                val: float = 0.0, seed: int = 42) -> DataFrame:
    """I6/I7. Split clips so that a parent group stays whole and every stratum is cut alike.

    The unit is the parent group, or the clip where it has none (or `group` is None). The
    stratum of a unit is that of its first clip by name. Units are ranked, not clips.
    """
    solo = F.concat(F.lit("__solo__/"), F.col("clip"))
    unit = F.coalesce(F.col(group), solo) if group else solo
    rows = clips.withColumn("_unit", unit)
    label = F.lower(F.coalesce(F.nullif(F.trim(F.col(stratum)), F.lit("")), F.lit("unknown")))
    units = rows.groupBy("_unit").agg(F.min_by(label, F.col("clip")).alias("_stratum"))
    ranked = hash_rank(units, ["_unit"], by=["_stratum"], seed=seed, op="split", rank="_rank", size="_size")
    n_train, n_val = F.floor(F.col("_size") * train), F.floor(F.col("_size") * val)
    split = F.when(F.col("_rank") <= n_train, "train").when(F.col("_rank") <= n_train + n_val, "val").otherwise("test")
    return rows.join(ranked.select("_unit", split.alias("split")), "_unit").drop("_unit")


def shard_number(ordinal: Column, total: Column, n: int, rule: str) -> Column:
    """I8. Shard of a 0-based ordinal under one of the rules."""
    if rule == "balanced":
        base, extra = F.floor(total / n), total % n
        wide = extra * (base + 1)
        return F.when(ordinal < wide, F.floor(ordinal / (base + 1))).otherwise(
            extra + F.floor(F.try_divide(ordinal - wide, base)))
    if rule == "ceil_chunk":
        return F.floor(ordinal / F.ceil(total / n))
    if rule == "round_robin":
        return ordinal % n
    if rule == "floor_chunk":
        chunk = F.floor(total / n)
        return F.coalesce(F.least(F.floor(F.try_divide(ordinal, chunk)), F.lit(n - 1)), F.lit(n - 1))
    raise ValueError(f"unknown shard rule {rule!r}")


def shard(df: DataFrame, order, n: int, rule: str = "balanced") -> DataFrame:
    """I8. Add a `shard` column, rows taken in the given order; write with partitionBy('shard')."""
    placed = sorted_ordinal(df, order, "_ordinal")
    total = placed.agg(F.count("*")).scalar()
    return placed.withColumn("shard", shard_number(F.col("_ordinal"), total, n, rule).cast("bigint")).drop("_ordinal")


def index_range(df: DataFrame, order, start: int, end: int | None) -> DataFrame:
    """I8. Rows from `start` up to but without `end`."""
    placed = sorted_ordinal(df, order, "_ordinal")
    kept = F.col("_ordinal") >= start
    return placed.filter(kept & (F.col("_ordinal") < end) if end is not None else kept).drop("_ordinal")


def length_balanced(df: DataFrame, by, value: str, target: Column, n: int, tolerance: float = 0.4, seed: int = 42) -> DataFrame:
    """G15. n values per group, those within the tolerance of the target length first."""
    near = F.length(value).between(target * (1 - tolerance), target * (1 + tolerance))
    key = order_key(seed, "length", *[F.col(b) for b in by], F.col(value))
    return top_k(df.withColumn("_near", near), n, [F.desc("_near"), key, F.col(value)], by=by)


def weighted_sample(df: DataFrame, by, value: str, weight: str, n: int, seed: int = 42) -> DataFrame:
    """G16. n values per group without replacement, chances by weight: the smallest -ln(u)/w win."""
    u = uniform(seed, "weighted", *[F.col(b) for b in by], F.col(value))
    return top_k(df.withColumn("_race", -F.log(u) / F.col(weight)), n, [F.col("_race"), F.col(value)], by=by).drop("_race")


