"""Accuracy roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from .ranking import top_k

def right() -> Column:
    return F.coalesce(F.col("is_correct"), F.lit(False))


def counts() -> tuple[Column, Column]:
    return F.count("*").alias("total"), F.count_if(right()).alias("correct")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 when there is nothing."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part * 100.0, whole.cast("double")), F.lit(0.0))


def accuracy(df: DataFrame, by=()) -> DataFrame:
    """D1. total, correct and accuracy per group."""
    return df.groupBy(*by).agg(*counts()).withColumn("accuracy", ratio(F.col("correct"), F.col("total")))


def summary(df: DataFrame, by=("model",)) -> DataFrame:
    """D2. One scan: per type, per primary/secondary and overall, with the clips seen.

    `level` is 'type', 'part' or 'overall'. Clips are counted from a distinct (group, clip)
    pre-aggregation, so no task counts one group's clips alone.
    """
    by = list(by)
    secondary = F.col("qtype").isin(*K.SECONDARY_TYPES)
    rows = df.withColumn("part", F.when(secondary, "secondary").otherwise("primary"))
    per_type = rows.groupBy(*by, "part", "qtype").agg(*counts())
    rolled = per_type.groupingSets(
        [[*by, "part", "qtype"], [*by, "part"], by], *by, "part", "qtype").agg(
        F.sum("total").alias("total"), F.sum("correct").alias("correct"),
        F.grouping_id().alias("gid")).select(
        *by, F.when(F.col("gid") == 0, "type").when(F.col("gid") == 1, "part").otherwise("overall").alias("level"),
        "part", "qtype", "total", "correct", ratio(F.col("correct"), F.col("total")).alias("accuracy"))
    clips = rows.select(*by, "clip").distinct().groupBy(*by).agg(F.count("*").alias("clips"))
    return rolled.join(clips, by)


def map_column(mapping: dict, key: Column) -> Column:
    """A small fixed map as an expression."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.try_element_at(table, key)


def tier_accuracy(df: DataFrame, tiers: str = "basic_compound_detailed", by=("model",)) -> DataFrame:
    """D3. Accuracy per tier of one of the three tier maps; types outside the map are left out."""
    tier = map_column(K.TIER_MAPS[tiers], F.col("qtype"))
    return accuracy(df.withColumn("tier", tier).filter(F.col("tier").isNotNull()), [*by, "tier"])


def trick_split(df: DataFrame, by=("model",)) -> DataFrame:
    """D4. Trick against normal questions: accuracy in percent and the gap normal - trick."""
    def side(flag, name):
        total = F.count_if(F.col("is_trick") == flag)
        hits = F.count_if((F.col("is_trick") == flag) & right())
        return [total.alias(f"{name}_total"), percent(hits, total).alias(f"{name}_accuracy")]

    out = df.groupBy(*by).agg(*side(True, "trick"), *side(False, "normal"))
    return out.withColumn("gap", F.col("normal_accuracy") - F.col("trick_accuracy"))


def accuracy_range(split: DataFrame) -> DataFrame:
    """D4. Lowest and highest accuracy of all models on either side."""
    return split.agg(*[f(c).alias(f"{n}_{c}") for c in ("trick_accuracy", "normal_accuracy")
                       for n, f in (("min", F.min), ("max", F.max))])


def merge_shards(shards: list[DataFrame], kinds: list[str]) -> DataFrame:
    """D5. All shard rows in one table. Shards of different kinds are refused; rates are never averaged."""
    if len(set(kinds)) != 1:
        raise ValueError(f"mixed result kinds: {sorted(set(kinds))}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), shards)


def merge_summaries(parts: DataFrame, by=("model",)) -> DataFrame:
    """D6. Merge already summed shards. Each shard's parsed count is cut to a whole number."""
    parsed = F.floor(F.col("parsed_rate") / 100.0 * F.col("total"))
    out = parts.groupBy(*by).agg(
        F.sum("total").alias("total"), F.sum("correct").alias("correct"), F.sum(parsed).alias("parsed"))
    return out.select(
        *by, "total", "correct", "parsed", percent(F.col("correct"), F.col("total")).alias("accuracy"),
        percent(F.col("parsed"), F.col("total")).alias("parsed_rate"))


def model_ranking(df: DataFrame) -> DataFrame:
    """H1/D7. All right answers over the rows without an error: the two counts differ on purpose."""
    return df.groupBy("model").agg(
        F.count_if(right()).alias("correct"), F.count_if(F.col("error").isNull()).alias("answered")).withColumn(
        "overall", F.col("correct") / F.greatest(F.col("answered"), F.lit(1)) * 100.0)


def top_models(df: DataFrame, n: int) -> DataFrame:
    return model_ranking(df).orderBy(F.desc("overall"), "model").limit(n)


def accuracy_by_attribute(df: DataFrame, clips: DataFrame, attribute: str, missing: str = "none") -> DataFrame:
    """D7. Accuracy per clip attribute and model, with the attribute's clip count."""
    value = F.lower(F.trim(F.coalesce(F.col(attribute), F.lit(missing)))).alias(attribute)
    named = clips.select("clip", value)
    sized = named.groupBy(attribute).agg(F.count("*").alias("clip_count"))
    per = accuracy(df.filter(F.col("error").isNull()).join(named, "clip"), [attribute, "model"])
    return per.join(sized, attribute).withColumn("accuracy", F.col("accuracy") * 100.0)


def accuracy_by_people(df: DataFrame, people: DataFrame, roles) -> DataFrame:
    """D8. Accuracy per count bucket (0, 1, 2, 3+) of each role, primary questions only.

    `people` has one row per clip with a count column per role.
    """
    from ..functions.people import count_bucket

    pairs = ", ".join(f"'{r}', {r}" for r in roles)
    long = people.select("clip", F.expr(f"stack({len(roles)}, {pairs}) as (role, n)"))
    long = long.select("clip", "role", count_bucket(F.col("n")).alias("bucket"))
    primary = df.filter(~F.col("qtype").isin(*K.SECONDARY_TYPES))
    per_clip = primary.groupBy("model", "clip").agg(*counts())
    return (
        per_clip.join(long, "clip").groupBy("model", "role", "bucket")
        .agg(F.sum("total").alias("total"), F.sum("correct").alias("correct"))
        .withColumn("accuracy", percent(F.col("correct"), F.col("total"))))


def people_delta(by_bucket: DataFrame) -> DataFrame:
    """D8. Last present bucket minus the first one, per model and role."""
    return by_bucket.groupBy("model", "role").agg(
        F.min_by("accuracy", "bucket").alias("first_accuracy"), F.max_by("accuracy", "bucket").alias("last_accuracy"),
        F.count("*").alias("buckets")).filter("buckets > 1").select(
        "model", "role", (F.col("last_accuracy") - F.col("first_accuracy")).alias("delta"))


def capability_accuracy(df: DataFrame) -> DataFrame:
    """D9. Accuracy per capability group; a type may count in several groups."""
    groups = {}
    for name, types in K.CAPABILITY_GROUPS.items():
        for t in types:
            groups.setdefault(t, []).append(name)
    table = F.create_map(*[x for t, names in groups.items() for x in (F.lit(t), F.array(*map(F.lit, names)))])
    member = F.explode(F.try_element_at(table, F.col("qtype"))).alias("capability")
    per_type = df.filter(F.col("error").isNull()).groupBy("model", "qtype").agg(*counts())
    return (
        per_type.select("model", "total", "correct", member).groupBy("model", "capability")
        .agg(F.sum("total").alias("total"), F.sum("correct").alias("correct"))
        .withColumn("accuracy", percent(F.col("correct"), F.col("total"))))


def composition_gap(by_capability: DataFrame) -> DataFrame:
    def of(name):
        return F.coalesce(F.max(F.when(F.col("capability") == name, F.col("accuracy"))), F.lit(0.0))
    return by_capability.groupBy("model").agg(
        of("Action Only").alias("action_accuracy"), of("Role Only").alias("role_accuracy"),
        of("Action + Role (compound)").alias("compound_accuracy")).withColumn(
        "gap", F.col("action_accuracy") - F.col("compound_accuracy"))


def tier_drop(by_tier: DataFrame) -> DataFrame:
    """D10. Tiers side by side per model, and Basic - Detailed."""
    wide = by_tier.groupBy("model").pivot("tier", ["Basic", "Compound", "Detailed"]).agg(
        F.first(F.col("accuracy") * 100.0))
    return wide.select(
        "model", F.col("Basic").alias("basic"), F.col("Compound").alias("compound"),
        F.col("Detailed").alias("detailed"), (F.col("Basic") - F.col("Detailed")).alias("drop"))


def tier_envelope(by_tier: DataFrame) -> DataFrame:
    return by_tier.groupBy("tier").agg(
        F.min(F.col("accuracy") * 100.0).alias("lowest"), F.max(F.col("accuracy") * 100.0).alias("highest"))


def scale_comparison(by_tier: DataFrame, size_of: dict) -> DataFrame:
    """D11. Mean and population deviation of tier accuracy per model size group."""
    rows = by_tier.withColumn("size", map_column(size_of, F.col("model"))).filter("size is not null")
    return rows.groupBy("size", "tier").agg(
        F.avg(F.col("accuracy") * 100.0).alias("mean_accuracy"),
        F.stddev_pop(F.col("accuracy") * 100.0).alias("std_accuracy"), F.count("*").alias("models"))


def size_gap(scaled: DataFrame) -> DataFrame:
    pick = lambda s: F.max(F.when(F.col("size") == s, F.col("mean_accuracy")))
    return scaled.groupBy("tier").agg((pick("large") - pick("small")).alias("gap"))


def family_pairs(by_tier: DataFrame, pairs) -> DataFrame:
    """D11. Small against large model of one family, per tier; pairs are (small, large, family)."""
    as_small = map_column({s: f for s, _, f in pairs}, F.col("model"))
    as_large = map_column({l: f for _, l, f in pairs}, F.col("model"))
    acc = F.col("accuracy") * 100.0
    rows = by_tier.withColumn("family", F.coalesce(as_small, as_large)).filter("family is not null")
    return rows.groupBy("family", "tier").agg(
        F.max(F.when(as_small.isNotNull(), acc)).alias("small_accuracy"),
        F.max(F.when(as_large.isNotNull(), acc)).alias("large_accuracy"))


def type_matrix(df: DataFrame, types) -> DataFrame:
    """D12. Model x type accuracy in percent, the models' mean in a last row, and row means."""
    per = accuracy(df, ["model", "qtype"]).withColumn("accuracy", F.col("accuracy") * 100.0)
    wide = per.groupBy("model").pivot("qtype", list(types)).agg(F.first("accuracy"))
    mean = wide.agg(F.lit("AVERAGE").alias("model"), *[F.avg(t).alias(t) for t in types])
    all_rows = wide.unionByName(mean)
    present = F.filter(F.array(*types), lambda x: x.isNotNull())
    total = F.aggregate(present, F.lit(0.0), lambda a, x: a + x)
    return all_rows.withColumn("row_mean", F.try_divide(total, F.size(present).cast("double")))


def paired_delta(a: DataFrame, b: DataFrame, key, order, by: str = "qtype") -> DataFrame:
    """D21. The same questions under two conditions: accuracy of both and the difference in points.

    A key that is answered more than once meets its n-th answer in `order` with the n-th one of the other side.
    """
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order)).alias("_nth")
    both = a.select(*key, by, F.col("is_correct").alias("ok_a"), nth).join(
        b.select(*key, F.col("is_correct").alias("ok_b"), nth), [*key, "_nth"])
    out = both.groupingSets([[by], []], by).agg(
        F.count("*").alias("total"), F.count_if("ok_a").alias("right_a"), F.count_if("ok_b").alias("right_b"))
    pct = lambda n: F.round(n * 100.0 / F.greatest(F.col("total"), F.lit(1)), 2)
    return out.select(
        F.coalesce(F.col(by), F.lit("OVERALL")).alias(by), "total", pct(F.col("right_a")).alias("normal"),
        pct(F.col("right_b")).alias("shuffled"), pct(F.col("right_b") - F.col("right_a")).alias("delta"))


def stage_transitions(df: DataFrame, stage_order: dict, order) -> DataFrame:
    """D22/H8. FIXED or REGRESSED between consecutive stages that both answered the question.

    A question's row per stage is bounded by the number of stages; it is laid out as one
    column per stage by conditional aggregation, with the last row in `order` of a repeated key kept.
    """
    stages = sorted(stage_order, key=stage_order.get)
    wide = df.groupBy("clip", "prompt").agg(*[
        F.max_by(F.when(F.col("stage") == s, F.col("is_correct").cast("int")), F.when(F.col("stage") == s, F.struct(*order))).alias(s)
        for s in stages])
    steps = [
        F.struct(F.lit(f"{a}->{b}").alias("step"),
                 F.when((F.col(a) == 1) & (F.col(b) == 0), "REGRESSED").when((F.col(a) == 0) & (F.col(b) == 1), "FIXED")
                 .alias("change")) for a, b in zip(stages, stages[1:])]
    return wide.select("clip", "prompt", F.explode(F.array(*steps)).alias("s")).select(
        "clip", "prompt", "s.step", "s.change").filter("change is not null")


def ablation_table(df: DataFrame, stages, baseline: str = "sft") -> DataFrame:
    """D23. Per type, overall and trick/normal: accuracy of every stage and the change from the baseline.

    The baseline is the first stage when the named one is missing. Trick and normal lines
    hide a stage that got none right.
    """
    per = df.groupBy("stage", "qtype", "is_trick").agg(*counts())

    def block(line, keep=F.lit(True)):
        return per.groupBy("stage", line.alias("line")).agg(
            F.sum("total").alias("total"), F.sum("correct").alias("correct")).filter(keep)

    sides = F.when(F.col("is_trick"), "Trick questions").otherwise("Normal questions")
    rows = block(F.col("qtype")).unionByName(block(F.lit("OVERALL"))).unionByName(
        block(sides, F.col("correct") > 0))
    rows = rows.withColumn("accuracy", percent(F.col("correct"), F.col("total")))
    base = baseline if baseline in stages else list(stages)[0]
    base_rows = rows.filter(F.col("stage") == base).select("line", F.col("accuracy").alias("base_accuracy"))
    return rows.join(base_rows, "line", "left").select(
        "stage", "line", "total", "correct", "accuracy",
        F.when(F.col("stage") != base, F.col("accuracy") - F.col("base_accuracy")).alias("delta"))


def leaderboard(df: DataFrame) -> DataFrame:
    """D24. One row per model: types, tiers, the mean of the rounded tiers, and the drops."""
    sums = df.groupBy("model", "qtype").agg(*counts())
    tier = K.TIER_MAPS["basic_compound_detailed"]

    def pct(types, name):
        member = F.col("qtype").isin(*types)
        total = F.sum(F.when(member, F.col("total")))
        return F.round(F.try_divide(F.sum(F.when(member, F.col("correct"))) * 100.0, total.cast("double")), 2).alias(name)

    groups = {t: [q for q, x in tier.items() if x == t] for t in ("Basic", "Compound", "Detailed")}
    wide = sums.groupBy("model").agg(
        *[pct([t], t) for t in K.PRIMARY_LEADERBOARD_TYPES],
        *[pct(groups[t], t.lower()) for t in groups],
        pct(K.PRIMARY_LEADERBOARD_TYPES, "primary_accuracy"), pct(K.SECONDARY_TYPES, "secondary_accuracy"),
        pct(K.PRIMARY_LEADERBOARD_TYPES + K.SECONDARY_TYPES, "overall_accuracy"))
    tiers = F.filter(F.array("basic", "compound", "detailed"), lambda x: x.isNotNull())
    mean = F.aggregate(tiers, F.lit(0.0), lambda a, x: a + x) / F.size(tiers)
    return wide.select(
        "*", F.round(mean, 2).alias("average"), F.round(F.col("basic") - F.col("compound"), 2).alias("drop_compound"),
        F.round(F.col("compound") - F.col("detailed"), 2).alias("drop_detailed"))


def error_summary(df: DataFrame, by=("model",)) -> DataFrame:
    """D25."""
    failed = F.col("error").isNotNull()
    silent = ~failed & F.col("selected").isNull()
    return df.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(failed).alias("errors"), F.count_if(silent).alias("no_valid_response"),
        F.count_if(~failed & ~silent).alias("valid"))


def rubric_means(grades: DataFrame, criteria=K.RUBRIC) -> DataFrame:
    """D26. Mean score per criterion and mean total: all, aggressive and other clips."""
    total = sum((F.col(c) for c in criteria), F.lit(0))
    out = grades.groupingSets([["is_aggressive"], []], "is_aggressive").agg(
        *[F.round(F.avg(c), 2).alias(c) for c in criteria], F.round(F.avg(total), 2).alias("mean_total"),
        F.count("*").alias("graded"), F.grouping_id().alias("gid"))
    part = F.when(F.col("gid") == 1, "overall").when(F.col("is_aggressive"), "aggressive").otherwise("non_aggressive")
    return out.select(part.alias("part"), *criteria, "mean_total", "graded")


def judged_accuracy(grades: DataFrame) -> DataFrame:
    """D27. Refusals and judge errors leave the denominator; an empty response stays in as wrong."""
    refused = F.coalesce(F.col("skipped_refusal"), F.lit(False))
    graded = F.col("is_correct").isNotNull() & ~refused
    aggressive = F.col("is_aggressive")

    def acc(where, name):
        total = F.count_if(graded & where)
        hits = F.count_if(graded & where & right())
        return [hits.alias(f"{name}_correct"), total.alias(f"{name}_total"),
                F.round(hits * 100.0 / F.greatest(total, F.lit(1)), 2).alias(f"{name}_accuracy")]

    return grades.agg(
        *acc(F.lit(True), "overall"), *acc(aggressive, "aggressive"), *acc(~aggressive, "non_aggressive"),
        F.count_if(refused).alias("refusals"), F.count_if(F.col("is_correct").isNull()).alias("judge_errors"))


def checkpoint_counts(df: DataFrame) -> DataFrame:
    """D28. Questions and right answers per clip."""
    return df.groupBy("model", "clip").agg(F.count("*").alias("num_questions"), F.count_if(right()).alias("num_correct"))


def retrieval_summary(df: DataFrame) -> DataFrame:
    """D29. Accuracy, parsed rate and how many questions got a reference, overall and by type."""
    out = df.groupingSets([["qtype"], []], "qtype").agg(
        *counts(), F.count_if(F.col("selected").isNotNull()).alias("parsed"),
        F.count_if(F.col("has_reference")).alias("with_reference"))
    return out.select(
        F.coalesce("qtype", F.lit("OVERALL")).alias("qtype"), "total", "correct",
        percent(F.col("correct"), F.col("total")).alias("accuracy"),
        percent(F.col("parsed"), F.col("total")).alias("parsed_rate"), "with_reference")


def enrichment_summary(df: DataFrame, fields, top: int = 10) -> DataFrame:
    """D30. How often each value of each enrichment field occurs, the top ones per field."""
    pairs = ", ".join(f"'{f}', coalesce({f}, '?')" for f in fields)
    long = df.select(F.expr(f"stack({len(fields)}, {pairs}) as (field, value)"))
    counted = long.groupBy("field", "value").agg(F.count("*").alias("n"))
    return top_k(counted, top, [F.desc("n"), F.col("value")], by=["field"])


def parsed_rate(df: DataFrame, by=("model",)) -> DataFrame:
    """C9. Rows with a selected option over all rows."""
    return df.groupBy(*by).agg(
        F.count("*").alias("total"), F.avg(F.col("selected").isNotNull().cast("double")).alias("parsed_rate"))


def share_of(df: DataFrame, value: str, by=()) -> Column:
    """H5. A row's share of its partition's total, for already aggregated rows."""
    window = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return F.col(value) * 100.0 / F.sum(value).over(window)
