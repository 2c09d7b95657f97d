"""Training and evaluation data preparation."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.freetext import chain_commits, mcq_fault
from ..functions.hashing import digest_mod, order_key
from ..functions.matching import each_option, label_options, with_own_tokens, with_references
from ..functions.render import letter, video_context
from ..session import settle
from .accuracy import map_column
from .ranking import last_per_key, sorted_ordinal


def check_bank(df: DataFrame, answers: str = "answers", strict: bool = False) -> DataFrame:
    """B31. Lenient: an answer text that differs from its option is overwritten and a key out of
    range fails the job. Strict: either fault fails the job."""
    fault = mcq_fault(F.col(answers), F.col("correct_index"), F.col("correct_answer"))
    fails = fault.isNotNull() if strict else fault == "range"
    text = F.coalesce(F.get(F.col(answers), F.col("correct_index")), F.col("correct_answer"))
    stop = F.raise_error(F.concat(F.lit("inconsistent question of clip "), F.col("clip")))
    return df.withColumn("correct_answer", F.when(F.coalesce(fails, F.lit(False)), stop.cast("string")).otherwise(text))


def quarantine(df: DataFrame, answers: str = "answers") -> DataFrame:
    """B31 without failing: the fault of every inconsistent question."""
    fault = mcq_fault(F.col(answers), F.col("correct_index"), F.col("correct_answer"))
    # exploded, as the filter would else go below and derive the options once more
    return df.select("*", F.explode(F.array(fault)).alias("fault")).filter("fault is not null")


def sft_examples(bank: DataFrame, clips: DataFrame) -> DataFrame:
    """J1. Primary questions of annotated clips with the clip's context text."""
    context = clips.select("clip", video_context(
        F.col("aggressor"), F.col("victim"), F.col("action"), F.col("environment"), F.col("bystander")).alias("video_context"))
    rows = bank.filter(~F.col("is_secondary")).join(context, "clip")
    return check_bank(rows).select(
        "clip", "qtype", "question_index", "is_trick", "video_context", "prompt", "correct_answer", "answers", "correct_index")


def normalize_examples(df: DataFrame) -> DataFrame:
    """J3. One shape for raw rows and rows with a nested `chosen`."""
    return df.select(
        "clip", "video_context", "prompt", F.coalesce("chosen.answer", "correct_answer").alias("correct_answer"),
        F.when(F.col("chosen").isNotNull(), F.coalesce("chosen.reasoning", F.lit(""))).otherwise(
            F.coalesce("reasoning", F.lit(""))).alias("reasoning"), "answers", "correct_index")


def _permutation(answers: Column, *key) -> Column:
    """Old option positions in their new order."""
    spots = F.transform(answers, lambda a, i: F.struct(order_key(*key, i).alias("k"), i.alias("i")))
    return F.transform(F.array_sort(spots), lambda s: s["i"])


def permute_options(df: DataFrame, keys, seed: int = 42, epoch: int = 0, answers: str = "answers") -> DataFrame:
    """J4. Options in a seeded order that changes with the epoch; the key index follows."""
    perm = _permutation(F.col(answers), seed, "permute", epoch, *[F.col(k) for k in keys])
    out = df.withColumn("_perm", perm)
    return out.withColumns({
        answers: F.transform("_perm", lambda i: F.get(F.col(answers), i)),
        "correct_index": F.array_position("_perm", F.col("correct_index")).cast("int") - 1}).drop("_perm")


def permute_pairs(pairs: DataFrame, seed: int = 42, epoch: int = 0) -> DataFrame:
    """J4. One permutation for the options, the chosen answer and the first rejected one."""
    perm = _permutation(F.col("answers"), seed, "permute", epoch, F.col("clip"), F.col("prompt"))
    out = pairs.withColumn("_perm", perm)
    place = lambda i: F.array_position("_perm", i).cast("int") - 1
    named = lambda spot, text: F.concat(letter(spot), F.lit(") "), text)
    first = F.get("rejected", F.lit(0))
    return out.select(
        "clip", "qtype", "prompt", F.transform("_perm", lambda i: F.get("answers", i)).alias("answers"),
        named(place(F.col("correct_index")), F.get("answers", F.col("correct_index"))).alias("chosen_answer"),
        named(place(first["index"]), first["text"]).alias("rejected_answer"))


def chain_outcomes(examples: DataFrame) -> DataFrame:
    """J5. What became of each example's chain: kept, failed, filtered, or not eligible."""
    eligible = F.col("qtype").isin(*K.CHAIN_TYPES)
    good = chain_commits(F.col("reasoning_chain"), F.col("correct_index"))
    outcome = F.when(~eligible, "direct").when(F.col("reasoning_chain").isNull(), "failed").when(~good, "filtered").otherwise("kept")
    return examples.withColumn("outcome", outcome).withColumn("used_cot", F.col("outcome") == "kept")


def judged_options(bank: DataFrame, clips: DataFrame) -> DataFrame:
    """One row per option of the bank's questions with what its label is judged by.

    Questions meet their clip before their options are exploded, and by a sort-merge join: a compressed table of clips
    that passes for small may be too large for the driver to broadcast.
    """
    people = with_own_tokens(clips.select("clip", "aggressor", "victim", "action", "bystanders", "environment")).hint("merge")
    cast = ["aggressor", "victim", "action", "bystanders", "environment"]
    return each_option(with_references(bank.join(people, "clip")).drop(*cast), "*")


def label_bank(bank: DataFrame, clips: DataFrame) -> DataFrame:
    """J10. A label for every option of a bank, the key's being 'correct'."""
    asked = ["clip", "qtype", "prompt", "answers", "correct_answer", "correct_index"]
    labelled = label_options(judged_options(bank.select(*asked), clips))
    right = (F.col("pos") == F.col("correct_index")) | (F.col("option") == F.col("correct_answer"))
    return labelled.select("clip", "qtype", "prompt", "pos", "option", F.when(right, "correct").otherwise(F.col("label")).alias("label"))


def unlabelled() -> Column:
    """A question without labels: the array is null or empty."""
    return F.coalesce(F.size("option_hardness"), F.lit(0)) <= 0


def with_labels(bank: DataFrame, clips: DataFrame) -> DataFrame:
    """`bank` with `option_hardness` filled in by J10 for the questions that have none; labelled ones do not enter the joins."""
    columns = bank.columns
    if "option_hardness" not in columns:
        columns = [*columns, "option_hardness"]
        bank = bank.withColumn("option_hardness", F.lit(None).cast("array<string>"))
    bare = bank.filter(unlabelled())
    asked = ["clip", "qtype", "prompt", "answers", "correct_answer", "correct_index"]
    opts = judged_options(bare.select(*asked).distinct(), clips)
    right = (F.col("pos") == F.col("correct_index")) | (F.col("option") == F.col("correct_answer"))
    one = F.struct("pos", F.when(right, "correct").otherwise(F.col("label")).alias("label"))
    made = label_options(opts).groupBy(*asked).agg(F.array_sort(F.collect_list(one)).alias("_made"))
    made = made.select(*[F.col(c).alias(f"_{c}") for c in asked], F.transform("_made", lambda o: o["label"]).alias("_labels"))
    same = reduce(and_, [F.col(c) == F.col(f"_{c}") if c == "clip" else F.col(c).eqNullSafe(F.col(f"_{c}")) for c in asked])
    filled = bare.join(made, same, "left").select(*[F.col("_labels").alias(c) if c == "option_hardness" else F.col(c) for c in columns])
    return bank.filter(~unlabelled()).select(columns).unionByName(filled)


def rank_rejected(options: Column, model_correct: Column, strategy: str, n: int) -> Column:
    """H4. The n options to reject, from an array of (index, text, label).

    fixed: hardest first. hard_mining: easiest first where the model was right. curriculum:
    easiest first where it was wrong. Unknown outcome: hardest first. Equal labels keep
    their option order either way.
    """
    easiest = {"fixed": F.lit(False), "hard_mining": F.coalesce(model_correct, F.lit(False)),
               "curriculum": F.coalesce(~model_correct, F.lit(False))}[strategy]

    def entry(o):
        rank = F.coalesce(map_column(K.HARDNESS_PRIORITY, o["label"]), F.lit(K.UNKNOWN_PRIORITY))
        return F.struct(F.when(easiest, -rank).otherwise(rank).alias("rank"), o["index"].alias("index"),
                        o["text"].alias("text"), o["label"].alias("label"))

    return F.slice(F.array_sort(F.transform(options, entry)), 1, n)


def preference_pairs(bank: DataFrame, clips: DataFrame, train: DataFrame, outcomes: DataFrame | None = None,
                     chains: DataFrame | None = None, strategy: str = "fixed", n: int = 5, outcome_order=(), chain_order=()) -> DataFrame:
    """J6. Chosen answer against the selected distractors, for training clips with an annotation.

    Labels come from the bank; questions without any (no column, a null or an empty array) are labelled first
    (`with_labels`), for which `clips` must name the people. Of repeated outcomes and chains the last one counts: outcomes in `outcome_order`, chains in `chain_order`.
    """
    rows = (
        bank.filter(~F.col("is_secondary") & ~F.col("is_trick"))
        .join(train.select("clip"), "clip", "left_semi").join(clips.select("clip"), "clip", "left_semi"))
    # exploded, as a filter on their number would else go below and derive a view's options once more
    rows = rows.select(*[c for c in bank.columns if c != "answers"], F.posexplode_outer(F.array("answers")).alias("_one", "answers")).filter(
        (F.col("correct_index") >= 0) & (F.col("correct_index") < F.size("answers"))).select(*bank.columns)
    if outcomes is not None:
        if not outcome_order:
            raise ValueError("outcome_order says which of two outcomes of a question is the last one")
        known = outcomes.filter(F.col("is_correct").isNotNull()).groupBy("clip", "prompt").agg(
            F.max_by("is_correct", F.struct(*outcome_order)).alias("_ok"))
        rows = rows.join(known.hint("merge"), ["clip", "prompt"], "left")
    else:
        rows = rows.withColumn("_ok", F.lit(None).cast("boolean"))
    if "option_hardness" not in bank.columns or "aggressor" in clips.columns:
        # read three times: stored, so that options are derived once; after the join, which both sides may be laid out for
        rows = with_labels(settle(rows), clips)
    if chains is not None:
        if not chain_order:
            raise ValueError("chain_order says which of two chains of a question is the last one")
        used = chains.filter("used_cot").select("clip", "question_index", "reasoning_chain", F.struct(*chain_order).alias("_order"))
        last = last_per_key(used, ["clip", "question_index"], ["_order"]).drop("_order")
        rows = rows.join(last, ["clip", "question_index"], "left")
    else:
        rows = rows.withColumn("reasoning_chain", F.lit(None).cast("string"))
    options = F.filter(
        F.transform(F.arrays_zip("answers", "option_hardness"), lambda z, i: F.struct(
            i.alias("index"), z["answers"].alias("text"), z["option_hardness"].alias("label"))),
        lambda o: o["label"] != "correct")
    picked = rows.withColumn("_top", rank_rejected(options, F.col("_ok"), strategy, n))
    rejected = F.transform("_top", lambda o: F.struct(
        F.concat(letter(o["index"]), F.lit(") "), o["text"]).alias("answer"), o["label"].alias("hardness"),
        o["index"].alias("index"), o["text"].alias("text")))
    chosen = F.struct(
        F.concat(letter(F.col("correct_index")), F.lit(") "), F.col("correct_answer")).alias("answer"),
        F.col("reasoning_chain").alias("reasoning"))
    return picked.filter(F.size("_top") > 0).select(
        "clip", "qtype", "prompt", chosen.alias("chosen"), rejected.alias("rejected"), "answers", "correct_index",
        F.col("_ok").alias("model_correct"))


def pair_stats(pairs: DataFrame) -> DataFrame:
    """J6. Labels of the kept rejected options by the model's outcome."""
    outcome = F.when(F.col("model_correct").isNull(), "no_eval_fallback").when(F.col("model_correct"), "model_correct").otherwise("model_wrong")
    return pairs.select(outcome.alias("outcome"), F.explode("rejected.hardness").alias("label")).groupBy(
        "outcome", "label").agg(F.count("*").alias("n"))


def retrieve_one_shot(test: DataFrame, train: DataFrame, carried=("answers", "correct_index")) -> DataFrame:
    """J7. One reference example per test question, or none.

    `carried` are the columns given with a reference, besides its clip and prompt, as ref_<name> (`correct_index` as ref_index). They
    go through the sort and the stored index, so a caller who does not read them leaves them out.

    Candidates share (type, trick), or the opposite trick flag when that bucket does not
    exist, and come from another parent group (no group is one group). The pick is
    sha256(clip|prompt|type) modulo the candidates in (clip, prompt) order.

    No pairs are built. With the bucket in order, the j-th candidate outside my group sits at
    j + #{own positions p_i with p_i - i <= j}. Those shifted positions are counted per value,
    and looked up by a running count over even slices of the bucket, so that a group holding a
    third of all rows is spread over many tasks.
    """
    bucket = ["qtype", "is_trick"]
    given = {c: "ref_index" if c == "correct_index" else f"ref_{c}" for c in carried}
    # both sides are read several times below, so each is stored once
    index = settle(sorted_ordinal(train.select(*bucket, "clip", "prompt", "group_id", *carried),
                                  ["clip", "prompt"], "pos", by=bucket))
    sizes = index.groupBy(*bucket).agg(F.count("*").alias("size"))
    # one row per type and trick flag
    flags = sizes.groupBy("qtype").agg(
        F.max(F.when(F.col("is_trick"), F.col("size"))).alias("_t"), F.max(F.when(~F.col("is_trick"), F.col("size"))).alias("_n"))
    own = index.groupBy(*bucket, "group_id").agg(F.count("*").alias("own"))

    asked = test.select("clip", "prompt", "qtype", "group_id", F.col("is_trick").alias("_wanted")).join(
        F.broadcast(flags), "qtype", "left")
    has = F.when(F.col("_wanted"), F.col("_t")).otherwise(F.col("_n")).isNotNull()
    asked = asked.withColumn("is_trick", F.when(has, F.col("_wanted")).otherwise(~F.col("_wanted"))).withColumn(
        "size", F.when(F.col("is_trick"), F.col("_t")).otherwise(F.col("_n"))).drop("_t", "_n")
    a, o = asked.alias("a"), own.alias("o")
    same = (
        (F.col("a.qtype") == F.col("o.qtype")) & (F.col("a.is_trick") == F.col("o.is_trick"))
        & F.col("a.group_id").eqNullSafe(F.col("o.group_id")))
    asked = a.join(o, same, "left").select("a.*", (F.col("a.size") - F.coalesce("o.own", F.lit(0))).alias("left"))
    seed = F.concat_ws("|", "clip", "prompt", "qtype")
    asked = settle(asked.withColumn("j", F.when(F.col("left") > 0, digest_mod(seed, F.col("left")))))

    # shifted own positions, summed per value
    at = sorted_ordinal(index.select(*bucket, "group_id", "pos"), ["pos"], "i", by=[*bucket, "group_id"])
    steps = at.groupBy(*bucket, "group_id", (F.col("pos") - F.col("i")).alias("v")).agg(F.count("*").alias("c"))
    slices = 4096
    place = lambda v: F.floor(v * slices / F.col("size")).cast("int")
    key = [*bucket, "group_id", "_slice"]
    steps = steps.join(F.broadcast(sizes), bucket).withColumn("_slice", place(F.col("v"))).drop("size")
    before = Window.partitionBy(*bucket, "group_id").orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    wanted = asked.filter("j is not null").withColumn("_slice", place(F.col("j")))
    marks = steps.groupBy(*key).agg(F.sum("c").alias("n")).unionByName(
        wanted.select(*key).distinct().withColumn("n", F.lit(0).cast("bigint")))
    marks = marks.groupBy(*key).agg(F.sum("n").alias("n")).select(
        *key, (F.sum("n").over(before) - F.col("n")).alias("_before"))
    marks = marks.filter("_before > 0")
    rows = steps.select(*key, F.col("v").alias("_v"), "c", F.lit(0).alias("_is_ask"), F.lit(None).cast("string").alias("clip"),
                        F.lit(None).cast("string").alias("prompt"), F.lit(None).cast("boolean").alias("_wanted")).unionByName(
        wanted.select(*key, F.col("j").alias("_v"), F.lit(0).cast("bigint").alias("c"), F.lit(1).alias("_is_ask"),
                      "clip", "prompt", "_wanted"))
    inside = Window.partitionBy(*key).orderBy("_v", "_is_ask").rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.withColumn("_in", F.sum("c").over(inside)).filter("_is_ask = 1").alias("r")
    m = marks.alias("m")
    on = F.lit(True)
    for c in key:
        on = on & F.col(f"r.{c}").eqNullSafe(F.col(f"m.{c}"))
    found = counted.join(m, on, "left").select(
        "r.clip", "r.prompt", "r.qtype", "r.is_trick", "r._wanted",
        (F.col("r._v") + F.col("r._in") + F.coalesce("m._before", F.lit(0))).alias("pos"))
    refs = index.select(*bucket, "pos", F.col("clip").alias("ref_clip"), F.col("prompt").alias("ref_prompt"),
                        *[F.col(c).alias(given[c]) for c in carried])
    hits = found.join(refs, [*bucket, "pos"])
    none = asked.filter("j is null").select("clip", "prompt", "qtype", "_wanted")
    return hits.select(
        "clip", "prompt", "qtype", F.col("_wanted").alias("is_trick"), "ref_clip", "ref_prompt", *given.values()).unionByName(
        none.withColumnRenamed("_wanted", "is_trick"), allowMissingColumns=True)


def referenced_media(parts: list[DataFrame]) -> DataFrame:
    """J8. Every clip named in any of the example tables, once."""
    from .setops import stack_all
    return stack_all([p.select("clip") for p in parts]).distinct()


def with_complete_frames(examples: DataFrame, frames: DataFrame, k: int) -> DataFrame:
    """J9. Examples of clips whose frames 0..k-1 are all there; `frames` has stem and frame_no."""
    full = frames.filter(F.col("frame_no").between(0, k - 1)).select("stem", "frame_no").distinct().groupBy("stem").agg(
        F.count("*").alias("n")).filter(F.col("n") == k)
    stem = F.regexp_replace("clip", r"\.[^.]+$", "")
    return examples.withColumn("_stem", stem).join(full, F.col("_stem") == full["stem"], "left_semi").drop("_stem")


