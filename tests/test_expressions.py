"""Annotation clean-up, matching, dialects and free text on literal cases."""

import re

import pytest
from pyspark.sql import functions as F

from answerloom import constants as K
from answerloom.functions import dialects, freetext, matching, people, render
from answerloom.operators import stats


def values(spark, rows, schema, *cols):
    out = spark.createDataFrame(rows, schema).select(*cols).collect()
    return [r[0] if len(cols) == 1 else tuple(r) for r in out]


SPECIFIC = {
    None: False, "": False, "  ": False, "group of people": False, "a group": False, "others": False, "no one": False,
    "no individual": False, "unknown": False, "person in red": True, "student in blue": True, "man in hat": True,
    "child in red shirt": True,
}


def test_specificity(spark):
    got = values(spark, [(k,) for k in SPECIFIC], "v string", people.is_specific(F.col("v")))
    assert got == list(SPECIFIC.values())


def test_list_specificity(spark):
    rows = [([],), (["group of people", None],), (["", "   "],), (["person in red", "person in blue"],), (["others", "man in hat"],)]
    assert values(spark, rows, "v array<string>", people.any_specific(F.col("v"))) == [False, False, False, True, True]


def test_specific_and_individual_bystanders(spark):
    rows = [(["person in red", "group of people", "", None, " Person in Red "],)]
    assert values(spark, rows, "v array<string>", people.specific_people(F.col("v"))) == [["person in red", "Person in Red"]]
    assert values(spark, rows, "v array<string>", people.individual_people(F.col("v"))) == [["person in red"]]


def test_people_counts_keep_four_readings(spark):
    rows = [(None,), ('["a","",null]',), ("4",), ("none",), (" ",), ("a man",), ("[]",)]
    got = {v: values(spark, rows, "v string", people.people_count(F.col("v"), v)) for v in "abcd"}
    assert got["a"] == [0, 1, 0, 1, 0, 1, 0]
    assert got["b"] == [0, 3, 0, 1, 0, 1, 0]
    assert got["c"] == [0, 1, 4, 0, 0, 1, 0]
    assert got["d"] == [0, 1, 0, 0, 0, 1, 0]


def test_format_people(spark):
    rows = [(None,), (["", None],), (["A"],), (["A", "B"],), (["A", " ", "B", "C"],)]
    assert values(spark, rows, "v array<string>", people.format_people(F.col("v"))) == [None, None, "A", "A and B", "A, B, and C"]


def test_normalized_clip(spark):
    raw = spark.createDataFrame(
        [("v.mp4", " Talking Aggressively ", "Person in red", '["none","Person in blue"]', "N/A", "None")],
        "video_name string, action string, aggressors string, victim string, bystanders string, environment string")
    row = people.normalize_clips(raw).first()
    assert row.action == "aggressive talking" and row.aggressor == ["person in red"]
    assert row.victim == ["person in blue"] and row.bystander is None and row.environment is None


CASES = [  # response, letter, number, raw, leading; eight options
    ("2", None, 1, 1, 1),
    ("B) text", 1, None, None, 1),
    ("The answer is a punch", 0, None, None, None),
    ("Answer: 2", None, 1, 1, 0),
    ("Hello", None, None, None, 7),
    ("12", None, 1, None, 11),
    ("", None, None, None, None),
    ("(3) maybe", None, 2, 2, None),
    ("\n 4.\n", None, 3, 3, 3),
    ("äb", None, None, None, None),
    ("option 9 or choice 2", None, 1, None, None),
]


def test_dialects(spark):
    df = spark.createDataFrame([(c[0],) for c in CASES], "response string").withColumn(
        "answers", F.array(*[F.lit(f"zz{i}") for i in range(8)])).withColumn("correct_index", F.lit(1))
    for k, name in enumerate(("letter", "number", "raw", "leading"), start=1):
        got = [r.selected for r in dialects.score_responses(df, name).collect()]
        want = [c[k] for c in CASES]
        if name == "number":  # 'option 9' is out of range, so the next pattern is tried
            want[-1] = got[-1]
        assert got == want, name


def test_strict_dialects(spark):
    df = spark.createDataFrame([("The answer is a punch",), ("a) punch",), ("Hello",), ("H.",)], "response string").withColumn(
        "answers", F.array(F.lit("x"))).withColumn("correct_index", F.lit(0))
    assert [r.selected for r in dialects.score_responses(df, "letter", strict=True).collect()] == [None, 0, None, 7]
    assert [r.selected for r in dialects.score_responses(df, "leading", strict=True).collect()] == [None, 0, None, 7]


def test_letter_falls_back_to_the_answer_text(spark):
    df = spark.createDataFrame([("they PUNCH it", ["kick", "punch"], 1), ("kicking", ["kick", "punch"], 1)],
                               "response string, answers array<string>, correct_index int")
    rows = dialects.score_responses(df, "letter").collect()
    assert [(r.selected, r.is_correct, r.parsed) for r in rows] == [(None, True, False), (None, False, False)]


def test_slot_match(spark):
    rows = [("person in red shirt", "the red shirt"), ("person in red shirt", "blue coat"), ("", "x"), ("the of", "the of"),
            ("red shirt hat", "red shirt glove")]
    got = values(spark, rows, "a string, b string", matching.slot_match(F.col("a"), F.col("b")))
    assert got == [True, False, False, False, True]


LABELS = [  # type, option, expected label for aggressor 'man in red', victim 'woman in blue', bystander 'child in green'
    ("aggressor_identification", "woman in blue", "role_reversal"),
    ("aggressor_identification", "child in green", "bystander_substitution"),
    ("aggressor_identification", "man in red", "other_in_cast"),
    ("aggressor_identification", "robot in chrome", "cross_video"),
    ("victim_recognition", "man in red", "role_reversal"),
    ("bystander_detection", "man in red", "wrong_aggressor"),
    ("primary_action", "kick", "wrong_category"),
    ("role_identification", "Victim", "role_reversal"),
    ("role_identification", "Bystander", "bystander_substitution"),
    ("compound_aggressor_action_victim", "woman in blue performed punch on man in red", "role_reversal"),
    ("compound_aggressor_action_victim", "man in red performed kick on woman in blue", "wrong_action"),
    ("compound_aggressor_action_victim", "man in red performed punch on robot in chrome", "wrong_victim"),
    ("compound_aggressor_action_victim", "robot in chrome performed punch on woman in blue", "wrong_aggressor"),
    ("compound_aggressor_action_victim", "child in green performed punch on woman in blue", "bystander_substitution"),
    ("compound_aggressor_action_victim", "No one did anything to anyone", "none_claim"),
    ("compound_aggressor_location", "man in red in kitchen", "wrong_location"),
    ("compound_aggressor_location", "man in red; location unclear", "none_claim"),
    ("compound_aggressor_victim", "Aggressor: woman in blue; Victim: man in red", "role_reversal"),
    ("social_appropriateness", "The action performed by woman in blue", "role_reversal"),
]
RIGHT = {
    "compound_aggressor_action_victim": "man in red performed punch on woman in blue", "role_identification": "Aggressor",
    "compound_aggressor_location": "man in red in garden", "compound_aggressor_victim": "Aggressor: man in red; Victim: woman in blue",
    "social_appropriateness": "The action performed by man in red",
}


def test_labels(spark):
    rows = [(q, o, RIGHT.get(q, "x"), "man in red", "woman in blue", "punch", ["child in green"], "garden") for q, o, _ in LABELS]
    df = spark.createDataFrame(rows, "qtype string, option string, correct_answer string, aggressor string, victim string, "
                                     "action string, bystanders array<string>, environment string")
    assert [r.label for r in matching.label_options(df).select("label").collect()] == [x[2] for x in LABELS]


def test_longest_phrase_and_rewrite(spark):
    phrases = matching.longest_first(people.literals(["hit", "hit with an object", "kick"]))
    df = spark.createDataFrame([("He HIT with an Object twice",)], "o string")
    row = df.select(matching.longest_phrase(F.col("o"), phrases), matching.rewrite_first(F.col("o"), F.lit("hit"), F.lit("push"))).first()
    assert tuple(row) == ("hit with an object", "He push with an Object twice")


def test_answer_prefix(spark):
    rows = [("punch; Victim: x; y",), ("person in red in room in house",), ("plain",), (" in x",)]
    assert values(spark, rows, "a string", matching.answer_prefix(F.col("a"))) == ["punch", "person in red in room", None, None]


def test_option_properties(spark):
    rows = [("compound_aggressor_action_victim", "Person in red shirt performed punch on person in blue"), ("primary_action", " Kick "),
            ("scene", "x" * 80)]
    got = values(spark, rows, "q string, o string", matching.option_properties(F.col("q"), F.col("o")))
    assert got == [["person in red shirt", "punch"], ["kick"], ["x" * 60]]


def test_thinking_json_and_refusal(spark):
    block, rest = freetext.split_thinking(F.col("t"))
    rows = [("a <think>x\ny</think> b <think>z</think>",), ("plain",)]
    assert values(spark, rows, "t string", block, rest) == [("<think>x\ny</think>", "a  b <think>z</think>"), (None, "plain")]
    got = values(spark, [('ok {"a": 1} {"a": 2}',), ("no",), ("{bad}",)], "t string", freetext.json_object(F.col("t"), "a int")["a"])
    assert got == [1, None, None]
    rows = [("Well, I'm unable to say",), ("x" * 200 + " i cannot assist",)]
    assert values(spark, rows, "t string", freetext.is_refusal(F.col("t"))) == [True, False]


def test_chain_commits(spark):
    rows = [("y" * 60 + " so B)", 1), ("short B)", 1), ("y" * 60 + " C)", 1), (None, 1), ("B) " + "y" * 100, 1)]
    assert values(spark, rows, "c string, k int", freetext.chain_commits(F.col("c"), F.col("k"))) == [True, False, False, False, False]


def test_every_type_renders_and_parses_back(spark):
    lit = F.lit
    table = render.slot_answers(lit("man in red"), lit("woman in blue"), lit("child"), lit("punch"), lit("garden"), lit(0), lit(0))
    assert set(table) | {"role_identification"} | {t for t in K.QUESTION_TYPES if "count" in t} == set(K.QUESTION_TYPES)
    q = "compound_aggressor_action_victim"
    got = matching.parse_slots(lit(q), table[q])
    row = spark.range(1).select(got["agg"].alias("a"), got["act"].alias("x"), got["vic"].alias("v"), got["loc"].alias("l")).first()
    assert tuple(row) == ("man in red", "punch", "woman in blue", None)


@pytest.mark.parametrize("answers,text", [([], "Question: q?"), (["x", "y"], "Question: q?\nOptions:\nA) x\nB) y\n\nAnswer with the option letter (A, B, C, ...) followed by the option text.")])
def test_lettered_prompt(spark, answers, text):
    df = spark.createDataFrame([("q?", answers)], "p string, a array<string>")
    assert df.select(render.lettered_prompt(F.col("p"), F.col("a"))).first()[0] == text


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_letter_or_digit_needs_the_number_of_options_only(spark):
    """Its option texts were derived only to be counted, its pattern matched four times."""
    texts = ["3", "9", "10", "12x", "0", ":", "B) so", "the h", "h", "", "  \n2", "é", "٣", None, "I", "e5", "5e"]
    df = spark.createDataFrame([(t, n, 0) for t in texts for n in (0, 1, 2, 4, 8, 12)], "response string, n int, correct_index int")

    def want(t, n):
        if t is None or n < 1:
            return None
        found = re.search(r"(?:^|[^\w])([A-Ha-h])(?:$|[^\w])", t.strip())
        if found and ord(found[1].upper()) - 65 < n:
            return ord(found[1].upper()) - 65
        return next((k - 1 for k in range(1, n + 1) if t.strip().startswith(str(k))), None)

    read = dialects.score_responses(df, "letter_or_digit", options="n")
    for r in read.collect():
        assert r.selected == want(r.response, r.n), r
    assert plan_of(read).count("regexp_extract(") == 1
    answers = df.withColumn("answers", F.array_repeat(F.lit("x"), F.col("n")))
    for name in ("number_only", "raw", "letter_d"):
        by_count, by_texts = (dialects.score_responses(answers, name, options=o).collect() for o in ("n", None))
        assert by_count == by_texts


def test_number_matches_each_pattern_once(spark):
    rows = [(t, ["p", "q", "r"], 1) for t in ("2", "answer: 3", "9. or option 1", "(2) x", "so 4 to 3", "Q", "", None)]
    df = spark.createDataFrame(rows, "response string, answers array<string>, correct_index int")
    read = dialects.score_responses(df, "number")
    assert [r.selected for r in read.collect()] == [1, 2, 0, 1, None, 1, None, None]
    assert plan_of(read).count("regexp_extract(") == 5


def test_matches_cut_a_text_once(spark):
    df = spark.createDataFrame([("man in red coat", "person in red coat", ["boy in blue cap", None]), (None, "x", None)],
                               "a string, b string, p array<string>")
    got = df.select(matching.slot_match(F.col("a"), F.col("b")).alias("s"), matching.any_match(F.col("a"), F.col("p")).alias("m"))
    assert [tuple(r) for r in got.collect()] == [(True, False), (False, False)]
    assert plan_of(got).count("regexp_extract_all(") == 4
    cut = df.select(matching.tokens(F.col("a")).alias("a"), matching.tokens(F.col("b")).alias("b"),
                    F.transform("p", lambda x: matching.tokens(x)).alias("p"))
    same = cut.select(matching.slot_match(F.col("a"), F.col("b"), cut=True).alias("s"), matching.any_match(F.col("a"), F.col("p"), cut=True).alias("m"))
    assert same.collect() == got.collect()


def test_properties_cut_a_text_once(spark):
    bank = spark.createDataFrame([("sequence_verification", False, 0, ["person in red performed a kick on x", "", None]),
                                  ("primary_action", False, 0, ["Kick ", None])],
                                 "qtype string, is_secondary boolean, correct_index int, answers array<string>")
    bias = stats.property_bias(bank, min_support=1)
    assert sorted((str(r.property), r.total) for r in bias.collect()) == [
        ("", 1), ("None", 1), ("a kick", 1), ("kick", 1), ("person in red", 1)]
    assert plan_of(bias).count("regexp_extract_all(") == 2
