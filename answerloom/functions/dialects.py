"""Response dialects (C1-C10): one column expression per way of reading a model's answer.

The dialects disagree on the same text, and each keeps its own reading: in `letter` the
article 'a' is option A, in `leading` the word 'Hello' is option H. `strict=True` drops
those two readings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .people import literals

# Fixed patterns. A letter or number stands alone when no letter, digit or underscore
# (in any script) touches it.
EDGE_LEFT = r"(?:^|[^\p{L}\p{N}_])"
EDGE_RIGHT = r"(?:$|[^\p{L}\p{N}_])"


def strip(text: Column) -> Column:
    """Trim all white space, line breaks too."""
    return F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))


def _group(text: Column, pattern: str, group: int = 1) -> Column:
    """The group's text, or NULL where the pattern is not found."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _letter_index(text: Column, pattern: str) -> Column:
    """The letter's place in the alphabet; NULL where the pattern is not found. The pattern is matched once."""
    return F.get(literals(range(26)), F.ascii(F.upper(F.regexp_extract(text, pattern, 1))) - 65)


def _in_range(index: Column, n: Column) -> Column:
    return F.when((index >= 0) & (index < n), index)


def _places(n: Column) -> Column:
    """The options that one digit or a letter up to I can name. Looking an index up here tests its range and derives it once."""
    return F.slice(literals(range(9)), F.lit(1), n)


def _digit_index(digit: Column, n: Column) -> Column:
    """The option that the first character, a digit from 1 on, names; NULL where it names none."""
    return F.get(_places(n), F.ascii(digit) - 49)


def standalone_letter(text: Column, last: str = "H") -> Column:
    return _letter_index(text, rf"(?i){EDGE_LEFT}([A-{last}]){EDGE_RIGHT}")


def first_contained(answers: Column, text: Column) -> Column:
    """Index of the first option whose text occurs in the response."""
    hits = F.transform(answers, lambda a: text.contains(F.lower(a)))
    return F.nullif(F.array_position(hits, True).cast("int"), F.lit(0)) - 1


def letter_index(text: Column, strict: bool = False) -> Column:
    """C1. First standalone A-H in either case. Strict: an upper-case letter, or one followed by ) . or :"""
    if strict:
        return _letter_index(text, rf"{EDGE_LEFT}([A-H]|[a-h](?=[).:])){EDGE_RIGHT}")
    return standalone_letter(text)


def number_index(text: Column, answers: Column, n: Column, substring: bool = True) -> Column:
    """C2. One digit alone; then worded, dotted, bracketed and trailing digits; then option text."""
    patterns = (
        r"^(\d)$", r"(?i)(?:answer|option|choice)[\s:]*(\d)", r"^(\d)\.", r"^\((\d)\)", r"(\d)(?:\s|$)")
    reads = [_digit_index(F.regexp_extract(text, p, 1), n) for p in patterns]
    if substring:
        reads.append(first_contained(answers, F.lower(text)))
    return F.coalesce(*reads)


def raw_index(response: Column, n: Column) -> Column:
    """C3. First standalone number, when it is an option."""
    found = _group(response, rf"{EDGE_LEFT}(\d+){EDGE_RIGHT}").try_cast("int")
    return _in_range(found - 1, n)


def leading_index(text: Column, strict: bool = False) -> Column:
    """C4. Leading digits, else a leading letter; no bounds. Strict: the letter has to stand alone."""
    tail = EDGE_RIGHT if strict else ""
    return F.coalesce(_group(text, r"^(\d+)").try_cast("int") - 1, _letter_index(text, rf"^([A-Ha-h]){tail}"))


def role_graph_index(response: Column) -> Column:
    """C5. The first digits anywhere."""
    return _group(response, r"(\d+)").try_cast("int") - 1


def letter_d_index(response: Column, n: Column) -> Column:
    """C6. A-D on the upper-cased text, when it is an option."""
    return F.get(_places(n), standalone_letter(F.upper(response), "D"))


def letter_or_digit_index(text: Column, n: Column) -> Column:
    """C7. C1 within the options, else the least option number the response starts with, which has one digit."""
    return F.coalesce(F.get(_places(n), standalone_letter(text)), _digit_index(text, n))


def key_from_text(answers: Column, correct_answer: Column) -> Column:
    """C8. The key index found by looking the answer text up in the options; -1 if it is not there."""
    tidy = F.transform(answers, lambda a: F.trim(F.lower(a)))
    return F.array_position(tidy, F.trim(F.lower(correct_answer))).cast("int") - 1


#: By response, response stripped, options and their number.
INDEX = {
    "letter": lambda r, s, a, n, strict: letter_index(s, strict),
    "number": lambda r, s, a, n, strict: number_index(s, a, n),
    "number_only": lambda r, s, a, n, strict: number_index(s, a, n, substring=False),
    "raw": lambda r, s, a, n, strict: raw_index(r, n),
    "leading": lambda r, s, a, n, strict: leading_index(s, strict),
    "role_graph": lambda r, s, a, n, strict: role_graph_index(r),
    "letter_d": lambda r, s, a, n, strict: letter_d_index(r, n),
    "letter_or_digit": lambda r, s, a, n, strict: letter_or_digit_index(s, n),
}
#: The dialects that compare a response with the options' texts.
READ_TEXTS = ("letter", "number")


def score_responses(df: DataFrame, dialect: str, strict: bool = False, response: str = "response",
                    answers: str = "answers", key: str = "correct_index", options: str | None = None) -> DataFrame:
    """Read every response in one dialect: adds `selected`, `is_correct` and `parsed`.

    In `letter`, a response without a letter is right when it contains the answer text.
    `options` names a column with the number of options; then only the dialects in `READ_TEXTS` need their texts.
    """
    keep = [c for c in df.columns if c not in ("selected", "is_correct", "parsed")]
    n = F.col(options) if options else F.size(F.col(answers))
    index = INDEX[dialect](F.col(response), F.col("_said"), F.col(answers), n, strict)
    # a step of its own, so that a response is stripped once however many patterns read it
    read = df.select(*keep, strip(F.col(response)).alias("_said")).select(*keep, "_said", index.alias("selected"))
    hit = F.col("selected") == F.col(key)
    if dialect == "letter":
        text = F.trim(F.lower(F.get(F.col(answers), F.col(key))))
        named = (F.coalesce(text, F.lit("")) != "") & F.lower("_said").contains(text)
        hit = F.when(F.col("selected").isNotNull(), hit).otherwise(named)
    return read.select(
        *keep, "selected", F.coalesce(hit, F.lit(False)).alias("is_correct"), F.col("selected").isNotNull().alias("parsed"))


def selected_label(is_correct: Column, selected: Column, option_hardness: Column) -> Column:
    """C10. The label of a wrong, parsed choice."""
    return F.when(~is_correct & (selected >= 0), F.get(option_hardness, selected))
