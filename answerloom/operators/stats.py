"""Dataset statistics and the shortcut audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.matching import each_option, option_properties
from ..session import settle
from .accuracy import map_column, percent
from .ranking import last_per_key, running_total, top_k


def value_distribution(df: DataFrame, value: Column, name: str = "value") -> DataFrame:
    """E1. Count and share of every value. Sort by count, then value, to list it."""
    counted = df.groupBy(value.alias(name)).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n")).scalar()
    return counted.withColumn("share", F.col("n") * 100.0 / total)


def long_tail(df: DataFrame, value: Column, name: str = "value", excluded: str = "none") -> DataFrame:
    """E2. Shares and cumulative shares from the most frequent value on, without the excluded one."""
    kept = value_distribution(df.filter(value != excluded), value, name)
    ran = running_total(kept, [-F.col("n"), F.col(name)], "n")
    total = kept.agg(F.sum("n")).scalar()
    return ran.select(name, "n", "share", (F.col("running") * 100.0 / total).alias("cumulative_share"))


def concentration(df: DataFrame, value: Column, excluded: str = "none", top: int = 3, rare: int = 15) -> DataFrame:
    """E3. Share of the top values, and how many values are rare."""
    counted = df.filter(value != excluded).groupBy(value.alias("value")).agg(F.count("*").alias("n"))
    head = counted.orderBy(F.desc("n"), "value").limit(top).agg(F.sum("n")).scalar()
    return counted.agg(
        (head * 100.0 / F.sum("n")).alias("top_share"), F.count_if(F.col("n") < rare).alias("rare_values"),
        F.count("*").alias("values"))


def group_structure(groups: DataFrame) -> DataFrame:
    """E4. Groups, clips and clips per group, by category."""
    per_group = groups.groupBy("category", "group_id").agg(F.count("*").alias("clips"))
    return per_group.groupBy("category").agg(
        F.count("*").alias("groups"), F.sum("clips").alias("clips"),
        (F.sum("clips") / F.greatest(F.count("*"), F.lit(1))).alias("clips_per_group"))


def field_coverage(fields: DataFrame) -> DataFrame:
    """E5. Per field: present, missing (normal clips left out) and distinct values.

    `fields` is long: clip, normal, field, value (NULL when empty), one row per value.
    """
    per_value = fields.groupBy("field", "value").agg(
        F.count("*").alias("n"), F.count_if(~F.col("normal")).alias("other"))
    filled = F.col("value").isNotNull()
    return per_value.groupBy("field").agg(
        F.coalesce(F.sum(F.when(filled, F.col("n"))), F.lit(0)).alias("present"),
        F.coalesce(F.sum(F.when(~filled, F.col("other"))), F.lit(0)).alias("missing"),
        F.count_if(filled).alias("unique_values"))


def people_histogram(people: DataFrame, roles) -> DataFrame:
    """E6. How many clips have n people, per role and in all."""
    total = sum((F.col(r) for r in roles), F.lit(0))
    pairs = ", ".join(f"'{r}', {r}" for r in [*roles, "all_people"])
    long = people.withColumn("all_people", total).select(F.expr(f"stack({len(roles) + 1}, {pairs}) as (role, people)"))
    return long.groupBy("role", "people").agg(F.count("*").alias("clips"))


def mean_people(histogram: DataFrame) -> DataFrame:
    return histogram.groupBy("role").agg(
        (F.sum(F.col("people") * F.col("clips")) / F.sum("clips")).alias("mean_people"))


def top_descriptions(people: DataFrame, k: int = 10) -> DataFrame:
    """E7. The most frequent descriptions per role; `people` is long: role, person."""
    counted = people.groupBy("role", "person").agg(F.count("*").alias("n"))
    return top_k(counted, k, [F.desc("n"), F.col("person")], by=["role"])


def name_prefixes(df: DataFrame, name: Column) -> DataFrame:
    """E8. The part before the first underscore, for names that have one."""
    return df.filter(name.contains("_")).groupBy(F.substring_index(name, "_", 1).alias("prefix")).agg(
        F.count("*").alias("n"))


def answer_counts(bank: DataFrame, by=()) -> DataFrame:
    """E10. How many primary questions have how many options."""
    return bank.filter(~F.col("is_secondary")).groupBy(*by, F.size("answers").alias("n_answers")).agg(
        F.count("*").alias("questions"))


def type_profile(bank: DataFrame) -> DataFrame:
    """E10. Questions, share and trick rate per primary type."""
    per = bank.filter(~F.col("is_secondary")).groupBy("qtype").agg(
        F.count("*").alias("questions"), F.count_if("is_trick").alias("tricks"))
    total = per.agg(F.sum("questions")).scalar()
    return per.select("qtype", "questions", "tricks", (F.col("questions") * 100.0 / total).alias("share"),
                      percent(F.col("tricks"), F.col("questions")).alias("trick_rate"))


def answer_diversity(bank: DataFrame) -> DataFrame:
    """E11. Per type: distinct answers, answers per question, the most frequent answer."""
    primary = bank.filter(~F.col("is_secondary"))
    per_answer = each_option(primary, "qtype", option="answer").groupBy("qtype", "answer").agg(
        F.count("*").alias("n"))
    modal = F.min(F.struct((-F.col("n")).alias("n"), "answer"))
    stats = per_answer.groupBy("qtype").agg(
        F.count("*").alias("unique_answers"), F.sum("n").alias("_answers"), modal.alias("_modal"))
    sizes = primary.groupBy("qtype").agg(F.count("*").alias("_questions"))
    return stats.join(sizes, "qtype").select(
        "qtype", "unique_answers", (F.col("_answers") / F.col("_questions")).alias("answers_per_question"),
        F.col("_modal.answer").alias("modal_answer"), (-F.col("_modal.n")).alias("modal_count"))


def question_coverage(bank: DataFrame) -> DataFrame:
    """E12. Questions per clip: min, max and mean, of all and of primary ones (zero counts)."""
    per = bank.groupBy("clip").agg(
        F.count("*").alias("n"), F.count_if(~F.col("qtype").isin(*K.SECONDARY_TYPES)).alias("p"))
    return per.agg(
        F.count("*").alias("clips"), F.min("n").alias("min_all"), F.max("n").alias("max_all"), F.avg("n").alias("mean_all"),
        F.min("p").alias("min_primary"), F.max("p").alias("max_primary"), F.avg("p").alias("mean_primary"))


def duplicate_questions(bank: DataFrame, top: int = 20) -> DataFrame:
    """E13. Primary questions that occur more than once, most frequent first."""
    key = ["clip", "qtype", "prompt"]
    per = bank.filter(~F.col("is_secondary")).groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")
    return per.orderBy(F.desc("n"), *key).limit(top)


def key_positions(bank: DataFrame) -> DataFrame:
    """E14. Where the key sits, in share of primary questions, and the chance level."""
    per = bank.filter(~F.col("is_secondary")).groupBy("correct_index").agg(F.count("*").alias("n"))
    total, spots = per.agg(F.sum("n")).scalar(), per.agg(F.count("*")).scalar()
    return per.select("correct_index", "n", (F.col("n") * 100.0 / total).alias("share"),
                      (F.lit(100.0) / F.greatest(spots, F.lit(1))).alias("chance"))


def property_bias(bank: DataFrame, min_support: int = 10, whole_text: bool = False) -> DataFrame:
    """E15. How often each option property is on the right answer."""
    opts = each_option(bank.filter(~F.col("is_secondary")), "qtype", "correct_index")
    found = F.array(F.lower(F.trim("option"))) if whole_text else option_properties(F.col("qtype"), F.col("option"))
    right = F.col("pos") == F.col("correct_index")
    # not explode, for whose size test the properties would be read once more
    rows = opts.select(F.posexplode_outer(found).alias("nth", "property"), right.alias("right")).filter("nth is not null")
    per = rows.groupBy("property").agg(
        F.count_if("right").alias("as_correct"), F.count_if(~F.col("right")).alias("as_distractor"),
        F.count("*").alias("total"))
    return per.filter(F.col("total") >= min_support).withColumn("correct_rate", F.col("as_correct") / F.col("total"))


def extremes(bias: DataFrame, k: int = 20) -> DataFrame:
    """E15. The k most and the k least often right properties; equal rates by text."""
    top = bias.orderBy(F.desc("correct_rate"), "property").limit(k).withColumn("side", F.lit("top"))
    low = bias.orderBy(F.asc("correct_rate"), F.desc("property")).limit(k).withColumn("side", F.lit("bottom"))
    return top.unionByName(low)


def frequent_answers(bank: DataFrame, k: int = 20) -> DataFrame:
    """E16."""
    per = bank.filter(~F.col("is_secondary")).groupBy(F.lower(F.trim("correct_answer")).alias("answer")).agg(
        F.count("*").alias("n"))
    return per.orderBy(F.desc("n"), "answer").limit(k)


BROADCAST_TEXTS = 100_000  # a text above this share of all repeated options is broadcast, so at most as many are


def frequency_shortcut(results: DataFrame, bank: DataFrame, order) -> DataFrame:
    """E17. How often a model chose an option that is the most (or least) frequent text of its question.

    Of a repeated (clip, prompt) the last row in `order` counts. Text counts come from primary questions. Texts travel as their md5
    digest (16 bytes). A text that stands in one option only counts there, so counts are kept of repeated texts alone: the most
    frequent are broadcast, and of the others a clip is sent one count per text it holds. A clip's counts are a map, in which its options are looked up.
    """
    def digest(text):
        return F.unhex(F.md5(F.lower(F.trim(text))))

    last = last_per_key(bank.select("clip", "prompt", "is_secondary", "answers", *order), ["clip", "prompt"], order)
    last = last.filter(F.size("answers") > 0)
    opts = each_option(last, "clip", "is_secondary").select("clip", "is_secondary", digest(F.col("option")).alias("_text"))
    seen = settle(opts.groupBy("_text").agg(
        F.count_if(~F.col("is_secondary")).alias("freq"), F.count("*").alias("_rows")).filter("_text is not null and _rows > 1"))
    hot = F.col("_rows") * BROADCAST_TEXTS > seen.agg(F.sum("_rows")).scalar()
    counts = lambda rows: F.map_from_entries(F.collect_list(F.struct("_text", rows)))
    held = opts.select("clip", "_text").distinct()
    often = F.broadcast(seen.filter(hot).select("_text", "freq"))
    here = held.join(often, "_text").groupBy("clip").agg(counts("freq").alias("_often"))
    rest = held.join(often, "_text", "left_anti").join(seen.filter(~hot).select("_text", "freq").hint("shuffle_merge"), "_text")
    sent = rest.groupBy("clip").agg(counts("freq").alias("_sent"))

    def freq(text):
        own = F.when(digest(text).isNotNull(), (~F.col("is_secondary")).cast("bigint"))
        return F.get(F.transform(F.array(digest(text)), lambda d: F.coalesce(
            F.try_element_at("_often", d), F.try_element_at("_sent", d), own)), F.lit(0))

    per_question = last.join(here.hint("merge"), "clip", "left").join(sent.hint("merge"), "clip", "left").select(
        "clip", "prompt", F.transform("answers", freq).alias("freqs"))
    answered = results.filter(F.col("error").isNull() & F.col("selected").isNotNull())
    summed = answered.groupBy("model", "clip", "prompt", "selected").agg(F.count("*").alias("n"))
    mine = F.get("freqs", F.col("selected"))
    out = summed.join(per_question.hint("merge"), ["clip", "prompt"]).groupBy("model").agg(
        F.sum("n").alias("answered"), F.sum(F.when(mine == F.array_max("freqs"), F.col("n")).otherwise(0)).alias("most"),
        F.sum(F.when(mine == F.array_min("freqs"), F.col("n")).otherwise(0)).alias("least"))
    return out.select(
        "model", "answered", F.col("most").alias("chose_most_frequent"), F.col("least").alias("chose_least_frequent"),
        percent(F.col("most"), F.col("answered")).alias("most_pct"),
        percent(F.col("least"), F.col("answered")).alias("least_pct"))


def quota_check(bank: DataFrame, n_clips: Column, tolerance: float = 0.05) -> DataFrame:
    """E18. Questions per category against clips x quota."""
    per = bank.groupBy(map_column(K.TYPE_CATEGORY, F.col("qtype")).alias("category")).agg(F.count("*").alias("actual"))
    expected = n_clips * map_column(K.CATEGORY_QUOTA, F.col("category"))
    return per.filter("category is not null").withColumn("expected", expected.cast("bigint")).withColumn(
        "deviation", F.abs(F.col("actual") - F.col("expected")) / F.col("expected")).withColumn(
        "ok", F.col("deviation") < tolerance)


def bank_rollup(bank: DataFrame) -> DataFrame:
    """E19. Questions and clips by type and by category, and in all."""
    rows = bank.withColumn("category", F.coalesce(map_column(K.TYPE_CATEGORY, F.col("qtype")), F.lit("other")))
    per = rows.groupBy("category", "qtype", "clip").agg(F.count("*").alias("n"))
    sums = per.groupingSets([["category", "qtype"], ["category"], []], "category", "qtype").agg(
        F.sum("n").alias("questions"))
    clips = bank.select("clip").distinct().agg(F.count("*")).scalar()
    return sums.select(
        F.coalesce("category", F.lit("ALL")).alias("category"), F.coalesce("qtype", F.lit("ALL")).alias("qtype"),
        "questions", clips.alias("clips"))
