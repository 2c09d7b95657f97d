"""Rendering: answers of every question type, prompts, context and target texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .people import count_answer, format_people

lit = F.lit


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def filled_count(items: Column) -> Column:
    return F.when(items.isNull(), 0).otherwise(F.size(F.filter(items, lambda x: x.isNotNull() & (x != ""))))


def listed_count(items: Column) -> Column:
    return F.when(items.isNull(), 0).otherwise(F.size(items))


def pair_text(aggressor: Column, victim: Column, style: Column) -> Column:
    return (
        F.when(style == 0, F.concat(lit("Aggressor: "), aggressor, lit("; Victim: "), victim))
        .when(style == 1, F.concat(aggressor, lit(" is the aggressor and "), victim, lit(" is the victim")))
        .otherwise(F.concat(aggressor, lit(" attacked "), victim)))


def triple_text(aggressor: Column, action: Column, victim: Column, style: Column) -> Column:
    return (
        F.when(style == 0, F.concat(aggressor, lit(" performed "), action, lit(" on "), victim))
        .when(style == 1, F.concat(aggressor, lit(" committed "), action, lit(" against "), victim))
        .otherwise(F.concat(lit("The action of "), action, lit(" was carried out by "), aggressor, lit(" on "), victim)))


def sequence_text(aggressor: Column, action: Column, victim: Column, style: Column) -> Column:
    return (
        F.when(style == 0, F.concat(
            aggressor, lit(", who is the aggressor, performed the action of "), action,
            lit(" against "), victim, lit(" who is the victim")))
        .when(style == 1, F.concat(
            lit("The aggressor, "), aggressor, lit(", carried out "), action, lit(" against the victim, "), victim))
        .otherwise(F.concat(aggressor, lit(" (aggressor) did "), action, lit(" to "), victim, lit(" (victim)"))))


def two_part(left: Column, right: Column, both, only_left, only_right, neither) -> Column:
    """Pick one of four wordings by which of two parts is there."""
    return (
        F.when(left.isNotNull() & right.isNotNull(), both).when(left.isNotNull(), only_left)
        .when(right.isNotNull(), only_right).otherwise(neither))


def person_answer(person: Column, none_text: str) -> Column:
    return F.coalesce(person, lit(none_text))


def slot_answers(agg: Column, vic: Column, by: Column, act: Column, env: Column,
                 style: Column, coin: Column, types=None) -> dict[str, Column]:
    """B22. Answer text by question type from formatted slots, for all or some types.

    `style` (0-2) picks one of three sentence styles, `coin` (0-1) one of two null wordings.
    Used for correct answers and, with changed slots, for distractors.
    """
    def pick(a, b):
        return F.when(coin == 0, a).otherwise(b)

    table = {
        "primary_action": lambda: F.coalesce(act, lit("unknown action")),
        "aggressor_identification": lambda: person_answer(agg, "No one displays aggressive behavior"),
        "perspective_aggressor": lambda: person_answer(agg, "No one displays aggressive behavior"),
        "victim_recognition": lambda: person_answer(vic, "No one appears to be victimized"),
        "bystander_detection": lambda: person_answer(by, "No bystanders are present"),
        "scene_location": lambda: F.coalesce(env, lit("Location unclear / not shown")),
        "interaction_summary": lambda: F.when(agg.isNull() & vic.isNull(), "No action takes place").otherwise(F.concat(
            F.coalesce(agg, lit("Unknown person")), lit(" performs action of "),
            F.coalesce(act, lit("unknown action")), lit(" on "), F.coalesce(vic, lit("unknown target")))),
        "social_appropriateness": lambda: F.coalesce(
            F.concat(lit("The action performed by "), agg), lit("No actions performed are socially inappropriate")),
        "compound_aggressor_location": lambda: two_part(
            agg, env, F.concat(agg, lit(" in "), env), F.concat(agg, lit("; location unclear")),
            F.concat(lit("No aggressor present; location is "), env),
            lit("No aggressor present and location unclear")),
        "compound_action_victims": lambda: F.concat(
            F.coalesce(act, lit("No action")), lit("; Victim: "),
            F.coalesce(vic, lit("No one appears to be victimized"))),
        "compound_action_aggressor": lambda: F.concat(
            F.coalesce(act, lit("No action")), lit("; Aggressor: "), F.coalesce(agg, lit("No aggressor present"))),
        "compound_action_location": lambda: two_part(
            act, env, F.concat(act, lit(" in "), env), F.concat(act, lit(" in unclear location")),
            F.concat(lit("No action in "), env), lit("No action and location unclear")),
        "compound_aggressor_victim": lambda: two_part(
            agg, vic, pair_text(agg, vic, style),
            pick(F.concat(lit("Aggressor: "), agg, lit("; No victim")),
                 F.concat(agg, lit(" is the aggressor; no victim identified"))),
            pick(F.concat(lit("No aggressor; Victim: "), vic),
                 F.concat(lit("No aggressor identified; "), vic, lit(" is the victim"))),
            pick(lit("No aggressor described and no victim described"),
                 lit("Neither an aggressor nor a victim can be identified"))),
        "compound_bystander_location": lambda: two_part(
            by, env, F.concat(by, lit(" in "), env), F.concat(by, lit(" in unclear location")),
            F.concat(lit("No bystanders in "), env), lit("No bystanders and location unclear")),
        "compound_aggressor_action_victim": lambda: F.when(
            agg.isNull() & act.isNull() & vic.isNull(),
            pick(lit("No one did anything to anyone"), lit("No aggressive interaction occurred"))).otherwise(
            triple_text(F.coalesce(agg, lit("Unknown person")), F.coalesce(act, lit("unknown action")),
                        F.coalesce(vic, lit("unknown target")), style)),
        "sequence_verification": lambda: F.when(
            agg.isNotNull() & act.isNotNull() & vic.isNotNull(), sequence_text(agg, act, vic, style)),
    }
    return {t: make() for t, make in table.items() if types is None or t in types}


def count_answers(aggressor: Column, victim: Column, bystander: Column) -> dict[str, Column]:
    """B22. The five count answers, from the people arrays."""
    return {
        "role_count_aggressor": count_answer(listed_count(aggressor)),
        "role_count_victim": count_answer(listed_count(victim)),
        "role_count_bystander": count_answer(listed_count(bystander)),
        "compound_aggressor_victim_count": F.concat(
            plural(filled_count(aggressor), "aggressor"), lit(" and "), plural(filled_count(victim), "victim")),
        "compound_victim_bystander_count": F.concat(
            plural(filled_count(victim), "victim"), lit(" and "), plural(filled_count(bystander), "bystander")),
    }


def by_type(qtype: Column, table: dict[str, Column]) -> Column:
    """One column that reads the entry of `table` named by `qtype`."""
    branch = F
    for name, value in table.items():
        branch = branch.when(qtype == name, value)
    return branch


# --- prompts --------------------------------------------------------------------

def letter(index: Column) -> Column:
    return F.char(index + 65)


def option_lines(answers: Column, style: str) -> Column:
    """Options, one per line: 'number' gives '1. x', 'letter' 'A) x', 'indented' '  A) x'."""
    marks = {
        "number": lambda x, i: F.concat((i + 1).cast("string"), lit(". "), x),
        "letter": lambda x, i: F.concat(letter(i), lit(") "), x),
        "indented": lambda x, i: F.concat(lit("  "), letter(i), lit(") "), x),
    }
    return F.array_join(F.transform(answers, marks[style]), "\n")


def numbered_prompt(prompt: Column, answers: Column, preamble: Column | None = None) -> Column:
    """B23. Numbered options; with a preamble it goes above a rule, else a short instruction does."""
    head = F.concat(preamble, lit("\n\n---\n\n")) if preamble is not None else lit(
        "Watch this video carefully and answer the following multiple-choice question.\n"
        "Select ONLY the number (1, 2, 3, etc.) of the correct answer.\n\n")
    return F.concat(
        head, lit("Question: "), prompt, lit("\n\nOptions:\n"), option_lines(answers, "number"),
        lit("\n\nAnswer with ONLY the option number (e.g., '1' or '2')."))


def lettered_prompt(prompt: Column, answers: Column) -> Column:
    """B23. Lettered options; a question without options is its own line only."""
    tail = F.concat(
        lit("\nOptions:\n"), option_lines(answers, "letter"),
        lit("\n\nAnswer with the option letter (A, B, C, ...) followed by the option text."))
    return F.concat(lit("Question: "), prompt, F.when(F.size(answers) > 0, tail).otherwise(""))


def short_prompt(prompt: Column, answers: Column) -> Column:
    """B23. The four-option form."""
    return F.concat(
        prompt, lit("\n\nOptions:\n"), option_lines(answers, "indented"),
        lit("\n\nAnswer with ONLY the letter (A, B, C, or D)."))


def one_shot_prompt(prompt: Column, answers: Column, n_frames: int, ref_prompt: Column,
                    ref_answers: Column, ref_index: Column) -> Column:
    """B23. Frame lines, a solved example when there is one, then the question."""
    frames = "\n".join(f"Frame {i}: <image>" for i in range(1, n_frames + 1))
    reference = F.concat(
        lit("Reference Example:\nQuestion: "), ref_prompt, lit("\n"), option_lines(ref_answers, "letter"),
        lit("\nCorrect Answer: "), letter(ref_index))
    question = F.concat(lit("Question: "), prompt, lit("\n"), option_lines(answers, "letter"))
    return F.concat_ws("\n\n", lit(frames), reference, question)


def fill(template: str, values: dict[str, Column]) -> Column:
    """B23. A text template with {name} holes, for judge and enrichment prompts."""
    parts, rest = [], template
    while "{" in rest:
        before, _, after = rest.partition("{")
        name, _, rest = after.partition("}")
        parts += [lit(before), values[name]]
    return F.concat(*parts, lit(rest))


def video_context(aggressor: Column, victim: Column, action: Column, environment: Column,
                  bystanders: Column) -> Column:
    """B20. Labelled lines; people lists joined by ' and '."""
    def joined(items):
        return F.array_join(F.transform(F.filter(items, lambda x: x.isNotNull() & (x != "")), lambda x: F.trim(x)), " and ")

    def line(label, text, keep=lit(True)):
        return F.when((text != "") & keep, F.concat(lit(f"{label}: "), text))

    act, env, by = F.trim(action), F.trim(environment), joined(bystanders)
    text = F.concat_ws(
        "\n", line("Aggressor", joined(aggressor)), line("Victim", joined(victim)),
        line("Action", act, F.lower(act) != "none"), line("Environment", env),
        line("Bystanders", by, ~F.lower(by).contains("group of people")))
    return F.when(text == "", "Video context not available").otherwise(text)


def target_text(correct_answer: Column, correct_index: Column, answers: Column, reasoning: Column) -> Column:
    """J2. 'L) text', below the reasoning when there is some."""
    answer = F.when(F.size(answers) > 0, F.concat(letter(correct_index), lit(") "), correct_answer)).otherwise(
        correct_answer)
    shown = F.concat(lit("Reasoning:\n"), reasoning, lit("\n\nAnswer: "), answer)
    return F.when(F.coalesce(reasoning, lit("")) != "", shown).otherwise(answer)


def clip_texts(aggressor: Column, victim: Column, bystander: Column) -> tuple[Column, Column, Column]:
    return format_people(aggressor), format_people(victim), format_people(bystander)
