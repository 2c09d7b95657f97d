"""Free-text readers (B24-B26, B32) and the consistency checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .dialects import standalone_letter
from .matching import bound
from .people import any_of


def json_object(text: Column, schema: str) -> Column:
    """B24. The first flat {...} in the text as a struct; NULL when there is none or it does not parse."""
    block = F.regexp_extract(text, r"(?s)\{[^{}]*\}", 0)
    return F.when(block != "", F.from_json(block, schema, {"mode": "PERMISSIVE"}))


def is_refusal(text: Column) -> Column:
    """B25. A refusal phrase within the first characters."""
    head = F.lower(F.left(text, F.lit(K.REFUSAL_WINDOW)))
    return any_of(head.contains(p) for p in K.REFUSAL_PHRASES)


def split_thinking(text: Column) -> tuple[Column, Column]:
    """B26. The first <think>...</think> block and the rest; text without one is left as it is."""
    pattern = r"(?s)^(.*?)(<think>.*?</think>)(.*)$"
    has = text.rlike(r"(?s)<think>.*?</think>")
    block = F.when(has, F.regexp_extract(text, pattern, 2))
    rest = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 3)
    return block, F.when(has, F.trim(F.concat(*rest))).otherwise(text)


def chain_commits(chain: Column, key: Column) -> Column:
    """B32. The chain is long enough and its tail names the key's letter first."""
    long = F.length(chain) >= K.CHAIN_MIN_LENGTH
    named = standalone_letter(F.right(chain, F.lit(K.CHAIN_TAIL))) == key
    return F.coalesce(long & (key >= 0) & named, F.lit(False))


def mcq_fault(answers: Column, key: Column, correct_answer: Column) -> Column:
    """B31. 'range', 'text' or NULL; a question without options has no fault."""
    def fault(q):
        some = F.size(q["answers"]) > 0
        return F.when(some & ((q["key"] < 0) | (q["key"] >= F.size(q["answers"]))), "range").when(
            some & ~F.get(q["answers"], q["key"]).eqNullSafe(q["right"]), "text")

    return bound(F.struct(answers.alias("answers"), key.alias("key"), correct_answer.alias("right")), fault)
