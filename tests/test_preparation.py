"""Rejected-option selection, preference pairs, retrieval and set operations."""

import hashlib
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from answerloom import constants as K
from answerloom.operators import accuracy, attribution, prep, setops, stats

SPREAD = [(i, f"text {i}", label) for i, label in enumerate(list(K.HARDNESS_PRIORITY)[:10])]
HARD = ["role_reversal", "wrong_action", "wrong_victim"]
EASY = ["cross_video", "other_in_cast", "none_claim"]


@pytest.mark.parametrize("strategy,correct,want", [
    ("hard_mining", False, HARD), ("hard_mining", None, HARD), ("hard_mining", True, EASY), ("fixed", True, HARD),
    ("fixed", False, HARD), ("fixed", None, HARD), ("curriculum", False, EASY), ("curriculum", True, HARD), ("curriculum", None, HARD)])
def test_rank_rejected(spark, strategy, correct, want):
    df = spark.createDataFrame([(SPREAD, correct)], "o array<struct<index:int,text:string,label:string>>, ok boolean")
    row = df.select(prep.rank_rejected(F.col("o"), F.col("ok"), strategy, 3).alias("r")).first()
    assert [x.label for x in row.r] == want


def test_rank_rejected_is_stable_and_bounded(spark):
    same = [(i, "t", "cross_video") for i in range(4)] + [(4, "t", "new label")]
    df = spark.createDataFrame([(same, True), ([], True)], "o array<struct<index:int,text:string,label:string>>, ok boolean")
    rows = [r.r for r in df.select(prep.rank_rejected(F.col("o"), F.col("ok"), "hard_mining", 9).alias("r")).collect()]
    assert [x["index"] for x in rows[0]] == [4, 0, 1, 2, 3] and rows[1] == []


BANK = ("clip string, qtype string, question_index int, prompt string, answers array<string>, correct_answer string, correct_index int, "
        "option_hardness array<string>, is_secondary boolean, is_trick boolean")


def pair_bank(spark):
    return spark.createDataFrame([
        ("v1", "primary_action", 0, "p", ["a", "b", "c"], "a", 0, ["correct", "role_reversal", "bystander_substitution"], False, False),
        ("v1", "primary_action", 1, "p2", ["a"], "a", 0, ["correct"], False, False),
        ("v1", "role_count_victim", 2, "p3", ["0", "1"], "0", 0, ["correct", "cross_video"], True, False),
        ("v1", "primary_action", 3, "p4", ["a", "b"], "a", 5, ["correct", "cross_video"], False, False),
        ("v2", "primary_action", 0, "p", ["a", "b"], "a", 0, ["correct", "cross_video"], False, False)], BANK)


def test_preference_pairs(spark):
    clips = spark.createDataFrame([("v1",), ("v2",)], "clip string")
    train = spark.createDataFrame([("v1",)], "clip string")
    chains = spark.createDataFrame([("v1", 0, "because", True)], "clip string, question_index int, reasoning_chain string, used_cot boolean")
    pairs = prep.preference_pairs(pair_bank(spark), clips, train, chains=chains, n=2, chain_order=["question_index"]).collect()
    assert len(pairs) == 1
    p = pairs[0]
    assert p.chosen.answer == "A) a" and p.chosen.reasoning == "because"
    assert [r.answer for r in p.rejected] == ["B) b", "C) c"] and p.rejected[0].hardness == "role_reversal"


def test_permuted_pair_keeps_texts(spark):
    clips = spark.createDataFrame([("v1",), ("v2",)], "clip string")
    pairs = prep.preference_pairs(pair_bank(spark), clips, clips, n=2)
    for epoch in range(4):
        for r in prep.permute_pairs(pairs, epoch=epoch).collect():
            for shown in (r.chosen_answer, r.rejected_answer):
                assert r.answers[ord(shown[0]) - 65] == shown[3:]
            assert r.chosen_answer[3:] == "a"


def test_check_bank(spark):
    df = spark.createDataFrame([("v", ["a", "b"], 1, "zzz")], "clip string, answers array<string>, correct_index int, correct_answer string")
    assert prep.check_bank(df).first().correct_answer == "b"
    with pytest.raises(PySparkException):
        prep.check_bank(df, strict=True).collect()
    with pytest.raises(PySparkException):
        prep.check_bank(df.withColumn("correct_index", F.lit(7))).collect()


def brute_retrieve(test, train):
    index = {}
    for ex in train:
        index.setdefault((ex["qtype"], ex["is_trick"]), []).append(ex)
    found = index.get((test["qtype"], test["is_trick"])) or index.get((test["qtype"], not test["is_trick"]))
    left = sorted((e for e in found or [] if e["group_id"] != test["group_id"]), key=lambda e: (e["clip"], e["prompt"]))
    if not left:
        return None
    seed = f"{test['clip']}|{test['prompt']}|{test['qtype']}"
    return left[int(hashlib.sha256(seed.encode()).hexdigest(), 16) % len(left)]["clip"]


def test_retrieval_equals_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        group = "hot" if i % 3 == 0 else None if i % 11 == 0 else f"g{rng.randrange(40)}"
        q = rng.choice(["t1", "t2", "t3"])
        trick = rng.random() < 0.3 if q != "t3" else True
        rows.append((f"c{i:04d}", f"prompt {i % 7}", q, trick, group, ["a", "b"], 0))
    rows.append(("solo", "p", "t4", False, "g1", ["a"], 0))
    schema = "clip string, prompt string, qtype string, is_trick boolean, group_id string, answers array<string>, correct_index int"
    train_rows, test_rows = rows[:300] + rows[-1:], rows[250:600] + [
        ("x1", "p", "t3", False, "hot", [], 0), ("x2", "p", "t4", True, "g1", [], 0), ("x3", "p", "t9", True, "g1", [], 0)]
    out = prep.retrieve_one_shot(spark.createDataFrame(test_rows, schema), spark.createDataFrame(train_rows, schema)).collect()
    names = schema.replace(",", "").split()[::2]
    as_dicts = lambda rs: [dict(zip(names, r)) for r in rs]
    want = {(t["clip"], t["prompt"], t["qtype"]): brute_retrieve(t, as_dicts(train_rows)) for t in as_dicts(test_rows)}
    assert {(r.clip, r.prompt, r.qtype): r.ref_clip for r in out} == want and len(out) == len(test_rows)


def test_references_carry_the_columns_asked_for(spark):
    schema = "clip string, prompt string, qtype string, is_trick boolean, group_id string, answers array<string>, correct_index int"
    train = spark.createDataFrame([(f"c{i}", "p", "t", False, f"g{i % 3}", ["a", str(i)], i) for i in range(9)], schema)
    test = spark.createDataFrame([(f"d{i}", "p", "t", False, f"g{i % 4}", [], 0) for i in range(8)] + [("e", "p", "other", True, "g", [], 0)], schema)
    keys = ["clip", "prompt", "qtype", "is_trick", "ref_clip", "ref_prompt"]
    full = prep.retrieve_one_shot(test, train)
    bare = prep.retrieve_one_shot(test, train.drop("answers", "correct_index"), carried=())
    assert full.columns == [*keys, "ref_answers", "ref_index"] and bare.columns == keys
    rows = full.collect()
    assert sorted(map(str, bare.collect())) == sorted(map(str, full.select(*keys).collect())) and len(rows) == 9
    assert all(r.ref_answers == ["a", r.ref_clip[1:]] and r.ref_index == int(r.ref_clip[1:]) for r in rows if r.ref_clip)


def test_shortcut_counts_texts_by_digest(spark):
    """Repeated texts, texts of one option, of secondary questions, null texts and questions without options."""
    bank = [("a", "p", False, ["X ", "x", "only"], 1), ("a", "q", True, ["x", "sec", None], 1), ("b", "p", False, ["only b", "x", "sec"], 1),
            ("c", "p", False, [], 1), ("d", "p", True, ["alone", "x"], 1), ("a", "p", False, ["gone", "gone", "gone"], 0)]
    bank = spark.createDataFrame(bank, "clip string, prompt string, is_secondary boolean, answers array<string>, load int")
    # counts: x 3, only 1, sec 1, only b 1, alone 0
    said = [("m", "a", "p", 0), ("m", "a", "p", 2), ("m", "a", "q", 0), ("m", "a", "q", 1), ("m", "a", "q", 2), ("m", "b", "p", 0),
            ("m", "b", "p", 1), ("m", "c", "p", 0), ("m", "d", "p", 0), ("m", "d", "p", 1), ("m", "z", "p", 0)]
    answers = spark.createDataFrame(said, "model string, clip string, prompt string, selected int").withColumn("error", F.lit(None).cast("string"))
    got = stats.frequency_shortcut(answers, bank, ["load"])
    assert tuple(got.first())[:4] == ("m", 9, 4, 4) and got.count() == 1
    plan = got._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(_text" in line]
    assert moved and "hashpartitioning(text" not in plan and "_cold" not in plan


def test_insert_missing(spark):
    base = spark.createDataFrame([("a", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 9, 1), ("b", 2, 2), ("b", 3, 1)], "k string, v int, o int")
    assert sorted(tuple(r) for r in setops.insert_missing(base, new, ["k"], ["o"]).collect()) == [("a", 1), ("b", 3)]
    assert tuple(setops.insert_report(base, new, ["k"]).first()) == (1, 2)


def test_complete_frames(spark):
    ex = spark.createDataFrame([("a.mp4",), ("b.mp4",)], "clip string")
    frames = spark.createDataFrame([("a", 0), ("a", 1), ("a", 1), ("b", 0), ("b", 5)], "stem string, frame_no int")
    assert [r.clip for r in prep.with_complete_frames(ex, frames, 2).collect()] == ["a.mp4"]


def test_last_row_of_a_repeated_key_counts(spark):
    labels = [["correct", "wrong_action"], ["correct", "cross_video"]]  # the last one is the smaller one
    bank = spark.createDataFrame(
        [("v", "p", "primary_action", 0, x, False, list("ab"), i) for i, x in enumerate(reversed(labels))] + [("v", "p", "primary_action", 0, labels[1], False, list("bb"), 9)],
        "clip string, prompt string, qtype string, correct_index int, option_hardness array<string>, is_secondary boolean, answers array<string>, load int")
    answers = spark.createDataFrame([("m", "v", "p", "primary_action", 1, False, None)], "model string, clip string, prompt string, qtype string, selected int, is_correct boolean, error string")
    found = attribution.attribute_errors(answers, bank, order=["load"])
    assert [r.label for r in found.collect()] == ["cross_video"]
    assert [r.label for r in attribution.accuracy_given_label(answers, bank, ["load"]).collect()] == ["cross_video"]
    shortcut = stats.frequency_shortcut(answers, bank, ["load"]).first()
    assert (shortcut.answered, shortcut.chose_most_frequent) == (1, 1)


def test_stages_and_conditions_with_repeated_answers(spark):
    rows = spark.createDataFrame([("v", "p", "sft", True, 1), ("v", "p", "sft", False, 2), ("v", "p", "dpo", True, 1)], "clip string, prompt string, stage string, is_correct boolean, load int")
    assert [(r.step, r.change) for r in accuracy.stage_transitions(rows, {"sft": 1, "dpo": 2}, ["load"]).collect()] == [("sft->dpo", "FIXED")]
    twice = spark.createDataFrame([("v", "t", True, 1), ("v", "t", False, 2)], "clip string, qtype string, is_correct boolean, load int")
    overall = {r.qtype: r for r in accuracy.paired_delta(twice, twice.withColumn("is_correct", F.lit(True)), ["clip"], ["load"]).collect()}["OVERALL"]
    assert (overall.total, overall.normal, overall.shuffled) == (2, 50.0, 100.0)


def test_pairs_of_an_unlabelled_bank(spark):
    clips = spark.createDataFrame([("v1", "man in red", "woman in blue", "punch", ["student in cap"], None)],
                                  "clip string, aggressor string, victim string, action string, bystanders array<string>, environment string")
    one = ["man in red", "woman in blue", "student in cap", "nobody in sight at sea"]
    bank = spark.createDataFrame([("v1", "aggressor_identification", 0, "p", one, one[0], 0, False, False)], BANK.replace("option_hardness array<string>, ", ""))
    outcomes = spark.createDataFrame([("v1", "p", False, 1), ("v1", "p", True, 2)], "clip string, prompt string, is_correct boolean, load int")
    pair = prep.preference_pairs(bank, clips, clips, outcomes, n=3, outcome_order=["load"]).first()
    assert [r.hardness for r in pair.rejected] == ["role_reversal", "bystander_substitution", "cross_video"] and pair.model_correct
    assert prep.with_labels(bank.limit(0), clips).count() == 0


def test_pairs_of_a_half_labelled_bank(spark):
    clips = spark.createDataFrame([("v1", "man in red", "woman in blue", "punch", ["student in cap"], None)],
                                  "clip string, aggressor string, victim string, action string, bystanders array<string>, environment string")
    one = ["man in red", "woman in blue", "student in cap", "nobody in sight at sea"]
    own = ["correct", "wrong_action", "wrong_action", "wrong_action"]
    rows = [("v1", "aggressor_identification", i, f"p{i}", one, one[0], 0, labels, False, False) for i, labels in enumerate((own, None, []))]
    pairs = {r.prompt: [x.hardness for x in r.rejected] for r in prep.preference_pairs(spark.createDataFrame(rows, BANK), clips, clips, n=3).collect()}
    made = ["role_reversal", "bystander_substitution", "cross_video"]
    assert pairs == {"p0": own[1:], "p1": made, "p2": made}
