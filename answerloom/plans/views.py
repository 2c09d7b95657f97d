"""Benchmark tables derived by Spark from the driver's tables.

`clips`      one annotation per order: people, action and place from its line items,
             customer, part and nation; orders without line items are the normal clips.
`questions`  twelve question types per clip with an action, with options and labels.
`results`    answers of four models to every question, in four response styles.
Every per-order value is a min, max or count, so a hot order costs no more than any other.

The clips are written once per application to the shared checkpoint folder, in buckets by clip. Questions (12 per clip) and results (4 per question) are derived from them row by row in every query
that reads them, without a shuffle: written out, they would take a hundred times the room of the clips.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.hashing import hex_int, order_key
from ..functions.people import literals
from ..session import shared_folder

MODELS = (  # name, size group, family, skill by tier (percent), response style
    ("atlas-8b", "small", "atlas", (52, 40, 27, 35), "number"),
    ("atlas-70b", "large", "atlas", (61, 50, 38, 45), "letter"),
    ("borea-7b", "small", "borea", (46, 37, 22, 30), "sentence"),
    ("cirrus-think", "reasoning", "cirrus", (55, 39, 33, 40), "dotted"),
)
VIEW_TYPES = (  # type, options, tier number
    ("primary_action", 8, 0), ("role_identification", 4, 0), ("aggressor_identification", 8, 0),
    ("victim_recognition", 8, 0), ("compound_action_aggressor", 8, 1), ("compound_action_victims", 8, 1),
    ("compound_aggressor_victim", 8, 1), ("compound_aggressor_action_victim", 8, 2),
    ("sequence_verification", 8, 2), ("compound_action_location", 8, 3), ("role_count_aggressor", 4, 3),
    ("compound_aggressor_victim_count", 8, 3),
)
LABELS = tuple(K.HARDNESS_PRIORITY)[:10]
CLIPS_PER_BUCKET = 50_000  # 2.4 million answers in a task
FILE_BYTES = "spark.sql.sources.fileCompressionFactor"
BYTES_PER_FILE_BYTE = "50"  # of rows derived from a file's: packed clips are a tenth of their rows, and each has 12 questions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_stored: dict[tuple, str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, derive, by_clip: bool = True) -> DataFrame:
    """A table of clips, written to the shared folder the first time an application asks for it, in buckets by clip.

    With `by_clip` off its rows are spread evenly instead. What is made of a bucket's rows one by one stays in its clip's bucket, so joins and counts by clip and other columns need no shuffle.
    """
    # both sides of a join in buckets by clip: they stay where they are, though the join asks for more columns
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    app = spark.sparkContext.applicationId
    if (app, sf_dir, name) not in _stored:
        place = f"{zlib.crc32(sf_dir.encode()):08x}"
        path = f"{shared_folder(spark)}/views-{app}/{place}/{name}"
        rows = table(spark, sf_dir, "orders").count()  # the clips
        buckets = max(4 * spark.sparkContext.defaultParallelism, -(-rows // CLIPS_PER_BUCKET))
        known = re.sub(r"\W", "_", f"views_{app}_{place}_{name}")
        spark.conf.set(FILE_BYTES, "1.0")
        made = derive(spark, sf_dir)
        if by_clip:
            made.repartition(buckets, "clip").write.mode("overwrite").format("parquet").option(
                "path", path).bucketBy(buckets, "clip").saveAsTable(known)
        else:
            made.repartition(buckets).write.mode("overwrite").format("parquet").option("path", path).saveAsTable(known)
        _stored[app, sf_dir, name] = known
    # else clips of a few MB of files pass for small, and millions of questions or answers are broadcast; rows spread evenly,
    # and what is derived above, keep the plans by which types of a repeated clip that tie have always gone
    spark.conf.set(FILE_BYTES, BYTES_PER_FILE_BYTE if by_clip else "1.0")
    return spark.table(_stored[app, sf_dir, name])


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "clips", derive_clips)


def spread_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clips spread evenly, for the rotation of types: types of a repeated clip that tie go by the order of its rows."""
    return stored(spark, sf_dir, "clips_spread", derive_clips, by_clip=False)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived from the stored clips wherever it is read, so that only the columns a query asks for are made."""
    return derive_questions(spark, sf_dir)


def derive_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_partkey").alias("pk"), F.min("l_suppkey").alias("s1"), F.max("l_suppkey").alias("s2"),
        F.min(F.when(F.col("l_returnflag") == "A", F.col("l_suppkey"))).alias("s3"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name")
    joined = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .join(part, F.col("pk") == F.col("p_partkey"), "left"))
    some = F.col("l_orderkey").isNotNull()
    bag = lambda s: F.concat(F.lit("student with bag "), F.col(s).cast("string"))
    near = F.filter(
        F.array(F.when(F.col("s2") != F.col("s1"), bag("s2")),
                F.when((F.col("s3") != F.col("s1")) & (F.col("s3") != F.col("s2")), bag("s3"))),
        lambda x: x.isNotNull())
    return joined.select(
        F.concat(F.lit("clip_"), F.col("o_orderkey").cast("string")).alias("clip"),
        F.col("p_brand").alias("action"),
        F.when(some, F.concat(
            F.lit("person in "), F.lower("c_mktsegment"), F.lit(" coat "),
            (F.col("o_custkey") % 97).cast("string"))).alias("aggressor"),
        F.when(some, F.concat(
            F.lit("person with "), F.col("p_name"), F.lit(" "), F.col("s1").cast("string"))).alias("victim"),
        F.when(some & (F.col("o_orderpriority") == "5-LOW"), F.array(F.lit("group of people")))
        .when(some & (F.size(near) > 0), near).alias("bystanders"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.lower("n_name")).alias("environment"),
        F.concat(F.lit("g_"), F.col("o_custkey").cast("string")).alias("group_id"),
        F.lower("o_orderstatus").alias("category"),
    )


def person_arrays(df: DataFrame) -> DataFrame:
    """The clips in the shape `normalize_clips` gives: aggressor, victim, bystander as arrays."""
    def one(name):
        return F.when(F.col(name).isNotNull(), F.array(name))
    return df.select(
        "clip", "action", one("aggressor").alias("aggressor"), one("victim").alias("victim"),
        F.col("bystanders").alias("bystander"), "environment", "group_id", "category")


def raw_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clips as raw records: person fields as text of every kind, none-words, synonyms, capitals."""
    c = clips(spark, sf_dir)
    turn = hex_int(order_key(42, "raw", F.col("clip")), 1, 8) % 10
    listed = lambda name: F.to_json(F.array(F.col(name), F.lit(""), F.lit("none")))
    return c.select(
        F.concat(F.when(F.col("action").isNull(), "normal_").otherwise(""), F.col("clip"), F.lit(".mp4"))
        .alias("file_name"),
        F.when(F.col("action").isNull(), "none").when(turn == 0, " Talking aggressively ")
        .when(turn == 1, "grab clothing").otherwise(F.col("action")).alias("action"),
        F.when(turn == 2, listed("aggressor")).when(turn == 3, "N/A").when(turn == 4, "3")
        .when(turn == 5, F.regexp_replace("aggressor", "^person", "Person")).otherwise(F.col("aggressor"))
        .alias("aggressor"),
        F.when(turn == 6, "  ").when(turn == 7, "unknown").otherwise(F.col("victim")).alias("victim"),
        F.coalesce(F.to_json("bystanders"), F.when(turn == 8, "none")).alias("bystanders"),
        F.when(turn == 9, "None").otherwise(F.col("environment")).alias("environment"),
        F.when(turn < 5, F.lower(F.col("category"))).when(turn == 5, "none").alias("outcome"),
    )


def derive_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = F.array(*[
        F.struct(F.lit(t).alias("qtype"), F.lit(n).alias("n"), F.lit(tier == 3).alias("is_secondary"))
        for t, n, tier in VIEW_TYPES])
    base = (
        clips(spark, sf_dir).filter(F.col("action").isNotNull())
        .select("*", F.explode(types).alias("t")).select("*", "t.qtype", "t.n", "t.is_secondary").drop("t")
        .withColumn("m", order_key(42, "q", F.col("clip"), F.col("qtype")))
        .withColumn("correct_index", (hex_int(F.col("m"), 1, 8) % F.col("n")).cast("int"))
        .withColumn("turn", (hex_int(F.col("m"), 9, 8) % 100).cast("int"))
        .withColumn("is_trick", hex_int(F.col("m"), 17, 8) % 10 == 0))
    # the raw labels of a question's positions: LABELS[(turn + i) % 10]
    dealt = F.slice(literals(LABELS * 2), F.col("turn") % 10 + 1, F.col("n"))
    roles = literals(K.ROLE_ORDER)
    marked = lambda other: F.transform(dealt, lambda x, i: F.when(i == F.col("correct_index"), "correct").otherwise(other(x, i)))
    labels = F.when(
        F.col("qtype") == "role_identification",
        marked(lambda x, i: F.get(literals(("role_reversal", "role_reversal", "bystander_substitution", "none_claim")), (F.col("turn") + i) % 4))
    ).when(F.col("n") == 4, marked(lambda x, i: F.lit("cross_video"))).otherwise(marked(lambda x, i: x))

    def option(q, label, i):
        """The text of position i, of raw label `label`, in a question of type q."""
        right = F.lit(True) if label is None else i == F.col("correct_index")
        spin = (F.col("turn") + i).cast("int")
        if q == "role_identification":
            return F.get(roles, spin % 4)
        if q == "role_count_aggressor":
            return F.get(literals(K.COUNT_OPTIONS), spin % 4)
        if label is None:  # the right answer
            agg, vic, act, env = (F.col(x) for x in ("aggressor", "victim", "action", "environment"))
        else:
            red = F.concat(F.lit("person in red coat "), (spin % 100).cast("string"))
            tin = F.concat(F.lit("person with tin cup "), (spin % 100).cast("string"))
            near = F.coalesce(F.get("bystanders", F.lit(0)), F.lit("student with bag 0"))
            agg = F.when(right, F.col("aggressor")).when(label == "role_reversal", F.col("victim")).when(
                label == "bystander_substitution", near)
            agg = agg.otherwise(red) if q == "aggressor_identification" else agg.when(
                label.isin("wrong_aggressor", "cross_video"), red).otherwise(F.col("aggressor"))
            vic = F.when(right, F.col("victim")).when(label == "role_reversal", F.col("aggressor"))
            vic = vic.otherwise(tin) if q == "victim_recognition" else vic.when(
                label.isin("wrong_victim", "cross_video"), tin).otherwise(F.col("victim"))
            act = F.when(right, F.col("action")).otherwise(F.concat(F.lit("Brand#"), (spin % 25 + 1).cast("string")))
            env = F.when(right, F.col("environment")).otherwise(F.concat(F.lit("nation_"), (spin % 25).cast("string")))
        text = {
            "primary_action": lambda: act, "aggressor_identification": lambda: agg, "victim_recognition": lambda: vic,
            "compound_action_aggressor": lambda: F.concat(act, F.lit("; Aggressor: "), agg),
            "compound_action_victims": lambda: F.concat(act, F.lit("; Victim: "), vic),
            "compound_aggressor_victim": lambda: F.concat(F.lit("Aggressor: "), agg, F.lit("; Victim: "), vic),
            "compound_aggressor_action_victim": lambda: F.concat(agg, F.lit(" performed "), act, F.lit(" on "), vic),
            "sequence_verification": lambda: F.concat(
                agg, F.lit(", who is the aggressor, performed the action of "), act, F.lit(" against "), vic),
            "compound_action_location": lambda: F.concat(act, F.lit(" in "), F.coalesce(env, F.lit("unclear location"))),
            "compound_aggressor_victim_count": lambda: F.concat((spin % 9).cast("string"), F.lit(" aggressors and 1 victim")),
        }[q]()
        return text if label is None else F.when(~right & (label == "none_claim"), F.lit("none of the above")).otherwise(text)

    # the type is looked at once per question, so that a lambda over the positions holds its own type's text only
    all_of = lambda q: F.transform(dealt, lambda x, i: option(q, x, i))
    answers, correct_answer = F, F
    for t, _, _ in VIEW_TYPES:
        answers = answers.when(F.col("qtype") == t, all_of(t))
        correct_answer = correct_answer.when(F.col("qtype") == t, option(t, None, F.col("correct_index")))
    named = F.when(
        F.col("qtype") == "role_identification",
        F.concat(F.lit("Concerning the "), F.col("victim"), F.lit(", their role would best be described as:")))
    prompts = F.create_map(*[F.lit(x) for t, _, _ in VIEW_TYPES for x in (t, K.PROMPTS[t])])
    return base.select(
        "clip", "group_id", "qtype", "is_secondary", "is_trick",
        F.coalesce(named, F.try_element_at(prompts, F.col("qtype"))).alias("prompt"),
        answers.alias("answers"), correct_answer.alias("correct_answer"), "correct_index",
        labels.alias("option_hardness"), F.col("n").alias("n_options"))


def results(spark: SparkSession, sf_dir: str, with_text: bool = False) -> DataFrame:
    """Model answers; `with_text` adds the options for the dialects that read them."""
    rows = derive_results(spark, sf_dir)
    return rows if with_text else rows.drop("answers")


def derive_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = F.array(*[
        F.struct(F.lit(m).alias("model"), F.lit(style).alias("style"), literals(skill).alias("skill"))
        for m, _, _, skill, style in MODELS])
    tier_of = F.create_map(*[F.lit(x) for t, _, tier in VIEW_TYPES for x in (t, tier)])
    q = questions(spark, sf_dir)
    base = (
        q.select("clip", "qtype", "prompt", "is_secondary", "is_trick", "correct_index", "n_options", "answers",
                 F.try_element_at(tier_of, F.col("qtype")).alias("tier"), F.explode(models).alias("m"))
        .select("*", "m.model", "m.style", "m.skill").drop("m")
        .withColumn("d", order_key(42, "r", F.col("model"), F.col("clip"), F.col("qtype"))))
    fate = hex_int(F.col("d"), 17, 8) % 100
    pick = F.when(hex_int(F.col("d"), 1, 8) % 100 < F.get("skill", "tier"), F.col("correct_index")).otherwise(
        (hex_int(F.col("d"), 9, 8) % F.col("n_options")).cast("int"))
    # exploded, as a filter on what an answer says does not go below that: there Spark would draw once more for every mention
    draw = F.explode(F.array(F.struct(fate.alias("fate"), pick.alias("pick"))))
    base = base.select("*", draw.alias("draw")).select("*", "draw.fate", "draw.pick").drop("draw")
    number, letter = (F.col("pick") + 1).cast("string"), F.char(F.col("pick") + 65)
    said = (
        F.when(F.col("style") == "number", number).when(F.col("style") == "letter", F.concat(letter, F.lit(") chosen")))
        .when(F.col("style") == "sentence", F.concat(F.lit("The answer is "), number, F.lit(".")))
        .otherwise(F.concat(number, F.lit(". because of the scene"))))
    return base.select(
        "model", "clip", "qtype", "prompt", "is_secondary", "is_trick", "correct_index", "n_options", "answers",
        F.when(F.col("fate") < 2, F.lit(None)).when(F.col("fate") < 5, "unable to tell").otherwise(said).alias("response"),
        F.when(F.col("fate") >= 5, F.col("pick")).alias("selected"),
        ((F.col("fate") >= 5) & (F.col("pick") == F.col("correct_index"))).alias("is_correct"),
        F.when(F.col("fate") < 2, "timeout").alias("error"))
