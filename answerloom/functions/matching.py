"""Slot matching, reading options back, and the distractor label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .people import any_of, literals


def bound(value: Column, use) -> Column:
    """`use(value)`, with the value made once a row however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(text: Column, stop=K.STOP_WORDS) -> Column:
    """B7. Distinct lower-case word tokens without stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9']+)"), 1)
    return F.array_except(words, literals(stop))


def space_tokens(text: Column, stop=K.ROLE_STOP_WORDS) -> Column:
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")
    return F.array_except(words, literals(stop))


def jaccard_at_least(a: Column, b: Column, thresh: float) -> Column:
    """Jaccard of two token sets, neither with repeats, reaches `thresh`; an empty side never matches."""
    shared = F.size(F.array_intersect(a, b))
    if thresh == 0.5:  # shared >= (|a| + |b| - shared) / 2 in whole numbers, without the union
        enough = shared * 3 >= F.size(a) + F.size(b)
    else:
        enough = shared >= F.lit(thresh) * F.greatest(F.size(F.array_union(a, b)), F.lit(1))
    return F.coalesce((F.size(a) > 0) & (F.size(b) > 0) & enough, F.lit(False))


def slot_match(a: Column, b: Column, thresh: float = 0.5, stop=K.STOP_WORDS, cut: bool = False) -> Column:
    """B8. `cut`: both are token sets already."""
    return jaccard_at_least(a, b, thresh) if cut else token_match(tokens(a, stop), tokens(b, stop), thresh)


def token_match(a: Column, b: Column, thresh: float) -> Column:
    """`jaccard_at_least` of token sets that are made where they are named."""
    return bound(F.struct(a.alias("a"), b.alias("b")), lambda s: jaccard_at_least(s["a"], s["b"], thresh))


def role_match(a: Column, b: Column, thresh: float = 0.4) -> Column:
    """B9. The looser match used by the role confusion matrix."""
    both = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    return both & token_match(space_tokens(a), space_tokens(b), thresh)


def any_match(slot: Column, people: Column, cut: bool = False) -> Column:
    """B10. `cut`: the slot and every one of the people are token sets already."""
    if cut:
        return F.coalesce(F.exists(people, lambda p: jaccard_at_least(slot, p, 0.5)), F.lit(False))
    return bound(tokens(slot), lambda t: any_match(t, F.transform(people, lambda p: tokens(p)), cut=True))


def none_claim(option: Column) -> Column:
    """B11. The option claims that nobody or nothing is there."""
    low = F.lower(option)
    return any_of(low.contains(m) for m in K.NONE_MARKERS)


def similar_answers(a: Column, b: Column) -> Column:
    """B11. Same text, both none-like, or one contains the other (both over 10 characters)."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    both_none = any_of(x.contains(k) for k in K.NONE_KEYWORDS) & any_of(y.contains(k) for k in K.NONE_KEYWORDS)
    long = (F.length(x) > 10) & (F.length(y) > 10)
    return F.coalesce((x == y) | both_none | (long & (x.contains(y) | y.contains(x))), F.lit(False))


def _extract(text: Column, pattern: str, group: int) -> Column:
    # not nullif, which would match the pattern twice inside a CASE
    return F.get(F.array_remove(F.array(F.trim(F.regexp_extract(text, pattern, group))), ""), F.lit(0))


def parse_slots(qtype: Column, text: Column) -> dict[str, Column]:
    """B12. The slots a rendered option fills: agg, act, vic, loc (NULL where it has none)."""
    t = F.trim(text)
    out = {}
    for slot in ("agg", "act", "vic", "loc"):
        branch = None
        for name, (pattern, groups) in K.SLOT_PATTERNS.items():
            if slot not in groups:
                continue
            value = _extract(t, pattern, groups.index(slot) + 1)
            if name == "compound_aggressor_location":
                unclear = t.rlike(K.LOCATION_UNCLEAR_PATTERN)
                other = F.lit("unclear") if slot == "loc" else _extract(t, K.LOCATION_UNCLEAR_PATTERN, 1)
                value = F.when(unclear, other).otherwise(value)
            branch = (F if branch is None else branch).when(qtype == name, value)
        out[slot] = branch
    return out


SLOTS = ("agg", "act", "vic", "loc")


def with_references(df: DataFrame, qtype: str = "qtype", correct: str = "correct_answer", aggressor: str = "aggressor",
                    victim: str = "victim", action: str = "action", bystanders: str = "bystanders",
                    environment: str = "environment") -> DataFrame:
    """What `label_options` compares options with: the same for all options of a question, so best added before they are exploded."""
    c = F.col
    key = parse_slots(c(qtype), c(correct))
    own = {"agg": c(aggressor), "vic": c(victim), "act": c(action), "loc": c(environment)}
    if "_t_by" not in df.columns:
        df = with_own_tokens(df, aggressor, victim, action, bystanders, environment)
    keep = [x for x in df.columns if x not in OWN_TOKENS]
    step = df.select("*", *[key[s].alias(f"_key_{s}") for s in SLOTS])
    return step.select(
        *keep, *[(F.coalesce(f"_key_{s}", own[s], F.lit("")) != "").alias(f"_has_{s}") for s in ("act", "loc")],
        "_t_own_agg", "_t_own_vic",
        *[F.when(c(f"_key_{s}").isNull(), c(f"_t_own_{s}")).otherwise(tokens(c(f"_key_{s}"))).alias(f"_t_ref_{s}") for s in SLOTS], "_t_by")


OWN_TOKENS = (*[f"_t_own_{s}" for s in SLOTS], "_t_by")


def with_own_tokens(df: DataFrame, aggressor: str = "aggressor", victim: str = "victim", action: str = "action",
                    bystanders: str = "bystanders", environment: str = "environment") -> DataFrame:
    """The token sets of a clip's own values: the same for all its questions, so best added to the clips before they meet the bank."""
    own = {"agg": aggressor, "vic": victim, "act": action, "loc": environment}
    return df.select("*", *[tokens(F.col(own[s])).alias(f"_t_own_{s}") for s in SLOTS],
                     F.transform(F.col(bystanders), lambda b: tokens(b)).alias("_t_by"))


REFERENCES = ("_has_act", "_has_loc", "_t_own_agg", "_t_own_vic", *[f"_t_ref_{s}" for s in SLOTS], "_t_by")
#: Types whose label compares the whole option with people.
WHOLE_OPTION_TYPES = ("aggressor_identification", "perspective_aggressor", "victim_recognition", "bystander_detection")


def label_options(df: DataFrame, out: str = "label", qtype: str = "qtype", option: str = "option",
                  correct: str = "correct_answer", aggressor: str = "aggressor", victim: str = "victim",
                  action: str = "action", bystanders: str = "bystanders", environment: str = "environment") -> DataFrame:
    """B13. Add the distractor label of every option, judged against the clip's annotation.

    Built in steps (slots, tokens, matches, label) so that each regular expression and
    token set is evaluated once per row. The columns of `with_references` are added here
    where `df` has none, and leave with the result.
    """
    c = F.col
    if "_has_act" not in df.columns:
        df = with_references(df, qtype, correct, aggressor, victim, action, bystanders, environment)
    keep = [x for x in df.columns if x not in REFERENCES]
    got = parse_slots(c(qtype), c(option))
    step = df.select("*", *[got[s].alias(f"_got_{s}") for s in SLOTS])
    step = step.select(
        *df.columns, *[f"_got_{s}" for s in SLOTS],
        F.when(c(qtype).isin(*WHOLE_OPTION_TYPES), tokens(c(option))).alias("_t_option"),
        *[F.when(c(f"_got_{s}").isNotNull(), tokens(c(f"_got_{s}"))).alias(f"_t_got_{s}") for s in SLOTS])

    def match(a, b):
        return jaccard_at_least(c(a), c(b), 0.5)

    def among(a):
        return F.coalesce(F.exists(c("_t_by"), lambda t: jaccard_at_least(c(a), t, 0.5)), F.lit(False))

    tests = {
        "o_agg": match("_t_option", "_t_own_agg"), "o_vic": match("_t_option", "_t_own_vic"),
        "o_by": among("_t_option"), "a_by": among("_t_got_agg"), "v_by": among("_t_got_vic"),
        "aa": match("_t_got_agg", "_t_ref_agg"), "av": match("_t_got_agg", "_t_ref_vic"),
        "va": match("_t_got_vic", "_t_ref_agg"), "vv": match("_t_got_vic", "_t_ref_vic"),
        "far": c("_got_loc").isNotNull() & c("_has_loc") & ~match("_t_got_loc", "_t_ref_loc"),
        "acted": c("_got_act").isNotNull() & c("_has_act") & ~match("_t_got_act", "_t_ref_act"),
        "none": none_claim(c(option)),
    }
    step = step.select(*keep, F.struct(*[v.alias(k) for k, v in tests.items()]).alias("_m"))
    m = lambda name: c("_m")[name]

    def one_person(right, swapped, onlooker):
        return (
            F.when(m(swapped), "role_reversal").when(m(onlooker), "bystander_substitution")
            .when(m(right), "other_in_cast").otherwise("cross_video"))

    low, right = F.lower(F.trim(c(option))), F.lower(F.trim(c(correct)))
    swapped_label = ((low == "victim") & (right == "aggressor")) | ((low == "aggressor") & (right == "victim"))
    place = F.when(m("far"), "wrong_location").otherwise("other_in_cast")
    pair = (
        F.when(m("av") & m("va"), "role_reversal")
        .when(m("aa") & m("vv"), F.when(m("acted"), "wrong_action").otherwise("other_in_cast"))
        .when(m("aa"), F.when(m("v_by"), "bystander_substitution").otherwise("wrong_victim"))
        .when(m("vv"), F.when(m("a_by"), "bystander_substitution").otherwise("wrong_aggressor"))
        .when(m("a_by") | m("v_by"), "bystander_substitution")
        .when(m("av") | m("va"), "other_in_cast")
        .otherwise("cross_video"))
    q = c(qtype)
    label = (
        F.when(m("none"), "none_claim")
        .when(q == "role_identification",
              F.when(swapped_label, "role_reversal").when(low == "bystander", "bystander_substitution")
              .otherwise("other_in_cast"))
        .when(q.isin("primary_action", "scene_location"), "wrong_category")
        .when(q.isin("aggressor_identification", "perspective_aggressor"), one_person("o_agg", "o_vic", "o_by"))
        .when(q == "victim_recognition", one_person("o_vic", "o_agg", "o_by"))
        .when(q == "bystander_detection",
              F.when(m("o_agg") | m("o_vic"), "wrong_aggressor").when(m("o_by"), "other_in_cast")
              .otherwise("cross_video"))
        .when(q == "compound_bystander_location", place)
        .when(q == "compound_aggressor_location",
              F.when(m("aa"), place).when(m("a_by"), "bystander_substitution")
              .when(m("av"), "role_reversal").otherwise("cross_video"))
        .when(q == "social_appropriateness", one_person("aa", "av", "a_by"))
        .otherwise(pair))
    return step.select(*keep, label.alias(out))


def selected_role(text: Column, aggressor: Column, victim: Column, bystanders: Column) -> Column:
    """B14. Whom the selected text describes; the first match wins."""
    return (
        F.when(role_match(text, aggressor), "aggressor")
        .when(role_match(text, victim), "victim")
        .when(F.coalesce(F.exists(bystanders, lambda b: role_match(text, b)), F.lit(False)), "bystander")
        .otherwise("unknown/cross-video"))


def answer_prefix(answer: Column) -> Column:
    """B15. The part before the first '; ', else before the last ' in '."""
    return F.when(answer.contains("; "), F.trim(F.substring_index(answer, "; ", 1))).when(
        answer.rlike(r"(?s)^.+ in "), F.trim(F.regexp_extract(answer, r"(?s)^(.+) in ", 1)))


def each_option(df: DataFrame, *columns, option: str = "option") -> DataFrame:
    """One row per option of a question: the named columns, pos and the option.

    For a plain posexplode Spark first tests the array's size, and would derive a view's options once for the test
    and once more for the rows.
    """
    return df.select(*columns, F.posexplode_outer("answers").alias("pos", option)).filter("pos is not null")


def phrase_hits(option: Column, phrases: Column) -> Column:
    """B16. The phrases found in the option, in the given (longest first) order."""
    # bound in a lambda, the option is lower-cased once and not once a phrase
    return F.get(F.transform(F.array(F.lower(option)), lambda low: F.filter(phrases, lambda p: low.contains(F.lower(p)))), F.lit(0))


def longest_phrase(option: Column, phrases: Column) -> Column:
    return F.get(phrase_hits(option, phrases), F.lit(0))


def longest_first(phrases: Column) -> Column:
    """Order phrases by length, longest first, equal lengths by text."""
    tagged = F.transform(phrases, lambda p: F.struct((-F.length(p)).alias("n"), p.alias("p")))
    return F.transform(F.array_sort(tagged), lambda s: s["p"])


def rewrite_first(option: Column, old: Column, new: Column) -> Column:
    """B17. Replace the first occurrence of `old`, whatever its case."""
    at = F.position(F.lower(old), F.lower(option))
    return F.when(at > 0, F.overlay(option, new, at, F.length(old))).otherwise(option)


def option_properties(qtype: Column, option: Column) -> Column:
    """B18. Person and action properties of an option; the whole text for single-slot types."""
    def named(text):
        found = F.concat(
            F.regexp_extract_all(text, F.lit(K.PERSON_PROPERTY), 0),
            F.regexp_extract_all(text, F.lit(K.ACTION_PROPERTY), 1))
        return bound(found, lambda f: F.when(F.size(f) == 0, F.array(F.left(text, F.lit(60)))).otherwise(
            F.filter(F.transform(f, lambda x: F.trim(x)), lambda p: p != "")))

    whole = qtype.isin("primary_action", "scene_location", "role_identification")
    return bound(F.lower(F.trim(option)), lambda text: F.when(whole, F.array(text)).otherwise(named(text)))


def clean_role(label: Column) -> Column:
    """B19. Strip a leading 'A) '."""
    return F.trim(F.regexp_replace(F.trim(label), r"^\p{L}\) ", ""))


def exact_role(label: Column) -> Column:
    role = clean_role(label)
    return F.when(role.isin(*K.ROLE_ORDER), role)


def loose_role(label: Column) -> Column:
    """B19. The first known role that contains the label or is contained in it."""
    low = F.lower(clean_role(label))
    branch = F
    for role in K.ROLE_ORDER:
        branch = branch.when(low.contains(role.lower()) | F.lit(role.lower()).contains(low), F.lit(role))
    return branch
