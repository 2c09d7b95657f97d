"""The derived tables: what they store, and that options are derived once and judged with their clip."""

import zlib
from pathlib import Path

from pyspark.sql import functions as F

import __spark_entry__ as entry
from answerloom.functions import matching as mt
from answerloom.operators import attribution as att
from answerloom.operators import bank as bk
from answerloom.operators import prep
from answerloom.operators import setops as so
from answerloom.plans import preparation, views
from answerloom.session import shared_folder
from answerloom.sources import readers as rdr
from answerloom.sources import sinks

ORDERS = [(1, 1, "O", "1-URGENT"), (2, 2, "F", "5-LOW"), (3, 1, "P", None), (4, 2, None, "4-NOT SPECIFIED")]
LINES = [(1, 1, 1, "A"), (1, 1, 2, "N"), (2, 2, 2, None), (3, 2, 3, "R"), (3, 1, 4, "A")]


def tables(spark, folder):
    """Four orders, the last one without line items."""
    made = {
        "orders": spark.createDataFrame(ORDERS, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string"),
        "customer": spark.createDataFrame([(1, 1, "BUILDING"), (2, 1, "AUTO")], "c_custkey long, c_nationkey long, c_mktsegment string"),
        "nation": spark.createDataFrame([(1, "PERU")], "n_nationkey long, n_name string"),
        "part": spark.createDataFrame([(1, "Brand#11", "red tin"), (2, "Brand#12", "blue cup")], "p_partkey long, p_brand string, p_name string"),
        "lineitem": spark.createDataFrame(LINES, "l_orderkey long, l_partkey long, l_suppkey long, l_returnflag string")}
    for name, df in made.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_only_clips_are_stored(spark, tmp_path):
    sf = tables(spark, tmp_path)
    q, r = views.questions(spark, sf), views.results(spark, sf, True)
    assert q.count() == 3 * 12 and r.count() == 4 * q.count()
    assert {name for _, folder, name in views._stored if folder == sf} == {"clips"}
    plan = q.select("clip", "qtype")._jdf.queryExecution().executedPlan().toString()
    assert "bystanders" not in plan and "Brand#" not in plan


def test_options_agree_with_key_and_labels(spark, tmp_path):
    for row in views.questions(spark, tables(spark, tmp_path)).collect():
        assert len(row.answers) == len(row.option_hardness) == row.n_options
        assert row.answers[row.correct_index] == row.correct_answer
        assert [i for i, label in enumerate(row.option_hardness) if label == "correct"] == [row.correct_index]


def test_each_option_derives_options_once(spark):
    df = spark.createDataFrame([("a", ["x", "y"]), ("b", []), ("c", None)], "clip string, given array<string>")
    made = df.withColumn("answers", F.transform("given", lambda x: F.concat(x, F.lit("!"))))
    rows = mt.each_option(made, "clip")
    assert sorted(map(tuple, rows.collect())) == [("a", 0, "x!"), ("a", 1, "y!")]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("transform(") == 1


def test_labels_do_not_broadcast_clips(spark):
    clips = spark.createDataFrame(
        [("v1", "man in shirt", "woman in coat", "kick", ["boy in cap"], "yard")],
        "clip string, aggressor string, victim string, action string, bystanders array<string>, environment string")
    bank = spark.createDataFrame(
        [("v1", "aggressor_identification", "Who?", ["woman in coat", "man in shirt", "boy in cap", "no one"], "man in shirt", 1)] * 2,
        "clip string, qtype string, prompt string, answers array<string>, correct_answer string, correct_index int")
    labelled = prep.label_bank(bank, clips)
    want = ["role_reversal", "correct", "bystander_substitution", "none_claim"]
    assert sorted((r.pos, r.label) for r in labelled.collect()) == sorted([*enumerate(want)] * 2)
    cast = clips.select("clip", "action", "environment", *[F.array(x).alias(x) for x in ("aggressor", "victim")], F.col("bystanders").alias("bystander"))
    asked = bank.select("clip", "qtype").distinct()
    for df in (labelled, bk.correct_answers(asked, cast)):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    assert [r.correct_answer for r in bk.correct_answers(asked, cast).collect()] == ["man in shirt"]


def test_joins_by_clip_need_no_shuffle(spark, tmp_path):
    """Questions and answers of a clip lie in one bucket (label_shift shuffled 357 MB at sf0.1 for this join)."""
    sf = tables(spark, tmp_path)
    bank, answers = views.questions(spark, sf), views.results(spark, sf)
    found = att.attribute_errors(answers, bank, order=["qtype"])
    joined = so.match_bank(answers, bank, order=["qtype"], columns=["correct_index"])
    for df, rows in ((found, None), (joined, 3 * 12 * 4)):
        with_size_joins(spark, df, rows)


def with_size_joins(spark, df, rows):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert rows is None or df.count() == rows
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_pairs_read_their_questions_once(spark, tmp_path):
    """The rows that with_labels reads three times are stored: every option list is derived in one place only."""
    sf = tables(spark, tmp_path)
    bank = views.questions(spark, sf)
    pairs = prep.preference_pairs(bank, views.clips(spark, sf), views.clips(spark, sf), n=3)
    assert "md5" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    kept = bank.filter("not is_secondary and not is_trick").select("clip", "qtype").distinct()
    assert pairs.select("clip", "qtype").exceptAll(kept).count() == 0 and pairs.count() == kept.count()


def test_checkpoints_may_be_packed(spark, tmp_path):
    """Unpacked, the lines of one model's answers took 438 MB at sf0.1."""
    rows = spark.createDataFrame([("a", "t", "p", True), ("a", "t", "q", False), ("b", "t", "p", None)],
                                 "clip string, timestamp string, prompt string, is_correct boolean")
    sinks.append_checkpoints(rows, str(tmp_path / "packed"), "gzip")
    sinks.append_checkpoints(rows.filter("clip = 'b'"), str(tmp_path / "packed"))
    names = {p.suffix for p in (tmp_path / "packed").iterdir() if p.name.startswith("part")}
    assert names == {".gz", ".json"}
    back = rdr.read_checkpoints(spark, str(tmp_path / "packed")).select("clip", "prompt", "is_correct")
    assert sorted(map(str, map(tuple, back.collect()))) == sorted(map(str, [("a", "p", True), ("a", "q", False), ("b", "p", None), ("b", "p", None)]))


def test_reloaded_bank_stays_in_its_buckets(spark, tmp_path):
    """Issued again by a union, the bank was shuffled for the join (1,232 MB at six times sf0.1)."""
    sf = tables(spark, tmp_path)
    bank = preparation.reloaded_bank(spark, sf)
    assert sorted((r.load, r["count"]) for r in bank.groupBy("load").count().collect()) == [(1, 36), (2, 12)]
    joined = so.match_bank(views.results(spark, sf), bank, order=["load"], columns=["correct_index"])
    with_size_joins(spark, joined, 3 * 12 * 4)


def test_a_filter_on_answers_draws_once(spark, tmp_path):
    """A filter on `response` went below the draw and made Spark take an answer's md5 again for every mention."""
    answers = views.results(spark, tables(spark, tmp_path))
    said = answers.filter("response is not null").select("model", "response")
    assert said._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 2  # question's and answer's
    one = answers.filter("model = 'borea-7b'")._jdf.queryExecution().optimizedPlan()
    assert "Filter (m" in one.toString().split("md5(")[1] and one.toString().count("md5(") == 2  # still before its draw
    assert said.count() == answers.count() - answers.filter("error = 'timeout'").count()


def test_packed_clips_do_not_pass_for_small(spark, tmp_path):
    """Spark took questions and answers for as large as the files of their clips, and broadcast them (F1: 900,000 clips in 22 MB)."""
    sf = tables(spark, tmp_path)
    views.clips(spark, sf).count()
    stored = sum(f.stat().st_size for f in Path(shared_folder(spark).removeprefix("file:")).rglob(f"*/{zlib.crc32(sf.encode()):08x}/clips/*.parquet"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(stored))
    try:
        for name in ("accuracy_by_action", "bank_delta", "examples_with_chains", "judge_prompts", "paired_condition_delta",
                     "selected_label_counts", "trick_from_bank_range"):
            plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan, name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def derived(spark):
    """A question whose options, marked by 'mark!', are derived wherever a plan names them."""
    df = spark.createDataFrame(
        [("v1", "aggressor_identification", "Who?", ["x", "y"], "xmark!", 0), ("v2", "aggressor_identification", "Who?", ["x", "y"], "xmark!", 1),
         ("v3", "aggressor_identification", "Who?", ["x", "y"], "ymark!", 2), ("v4", "aggressor_identification", "Who?", None, "ymark!", 0)],
        "clip string, qtype string, prompt string, given array<string>, correct_answer string, correct_index int")
    made = df.withColumn("answers", F.transform("given", lambda x: F.concat(x, F.lit("mark!")))).drop("given")
    return made.withColumns({"is_secondary": F.lit(False), "is_trick": F.lit(False), "question_index": F.lit(0),
                             "option_hardness": F.array(F.lit("correct"), F.lit("role_reversal"))})


def test_faults_and_pairs_derive_options_once(spark):
    bank = derived(spark)
    faults = prep.quarantine(bank).select("clip", "fault")
    assert sorted(map(tuple, faults.collect())) == [("v2", "text"), ("v3", "range")]
    clips = bank.select("clip")
    pairs = prep.preference_pairs(bank, clips, clips, n=1)
    assert sorted((r.clip, len(r.rejected)) for r in pairs.collect()) == [("v1", 1), ("v2", 1)]
    for df in (faults, pairs):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("mark!") == 1


def test_people_are_cut_into_words_once_a_clip(spark):
    clips = spark.createDataFrame(
        [("v1", "man in shirt", None, "kick", ["boy in cap"], "yard")],
        "clip string, aggressor string, victim string, action string, bystanders array<string>, environment string")
    judged = prep.judged_options(derived(spark).drop("option_hardness"), clips)
    above = judged._jdf.queryExecution().optimizedPlan().toString().split("Join ")[0]
    assert "_t_own_agg" in above and "regexp_extract_all(lower(coalesce(aggressor" not in above
    row = judged.first()
    assert {"man", "shirt"} <= set(row._t_own_agg) and row._t_own_vic == row._t_ref_vic == [] and row._t_ref_act == ["kick"]
