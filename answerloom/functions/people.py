"""Annotation clean-up and people columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K

STRINGS = T.ArrayType(T.StringType())
PERSON_FIELDS = ("aggressor", "victim", "bystander")


def literals(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def is_blank(value: Column) -> Column:
    return value.isNull() | (F.trim(value) == "")


def none_like(value: Column, words=K.NONE_VALUES) -> Column:
    return F.lower(F.trim(value)).isin(*words)


# --- raw person fields -------------------------------------------------------
# A person field arrives as text: a bare string, or the JSON text of a list or number.

def raw_kind(raw: Column) -> Column:
    """null, list, int or str."""
    return (
        F.when(raw.isNull(), "null")
        .when(F.trim(raw).startswith("["), "list")
        .when(raw.rlike(r"^\d+$"), "int")
        .otherwise("str")
    )


def raw_list(raw: Column) -> Column:
    return F.when(raw_kind(raw) == "list", F.from_json(raw, STRINGS))


def people_count(raw: Column, variant: str = "c") -> Column:
    """People in a raw field. a: non-empty items; b: items as they come, blanks too;
    c: items that are not none-like, numbers taken as they are; d: items after a trim."""
    kind, items = raw_kind(raw), raw_list(raw)
    filled = F.when(F.trim(raw) != "", 1).otherwise(0)
    if variant == "a":
        text, number, listed = filled, F.lit(0), F.size(F.filter(items, lambda x: x.isNotNull() & (x != "")))
    elif variant == "b":
        text, number, listed = filled, F.lit(0), F.size(items)
    elif variant == "c":
        keep = lambda x: x.isNotNull() & ~none_like(x, K.PEOPLE_NONE_VALUES)
        text = F.when(none_like(raw, K.PEOPLE_NONE_VALUES), 0).otherwise(1)
        number, listed = raw.try_cast("int"), F.size(F.filter(items, keep))
    elif variant == "d":
        text = F.when(none_like(raw), 0).otherwise(1)
        number = F.lit(0)
        listed = F.size(F.filter(items, lambda x: x.isNotNull() & (F.trim(x) != "")))
    else:
        raise ValueError(f"unknown people-count variant {variant!r}")
    return (
        F.when(kind == "null", 0).when(kind == "list", listed)
        .when(kind == "int", number).otherwise(text).cast("int")
    )


def count_bucket(n: Column) -> Column:
    return F.when(n >= 3, "3+").otherwise(n.cast("string"))


def count_answer(n: Column) -> Column:
    return F.when(n >= 3, K.COUNT_OPTIONS[3]).otherwise(n.cast("string"))


# --- normalised clips ---------------------------------------------------------

def _soften(person: Column) -> Column:
    """Lower the first letter of 'Person ...'."""
    capital = F.substring(person, 1, 1).rlike(r"^\p{Lu}") & F.lower(person).startswith("person")
    return F.when(capital, F.concat(F.lit("p"), person.substr(F.lit(2), F.length(person)))).otherwise(person)


def normalize_people(items: Column) -> Column:
    """none-like entries out, 'Person' softened; NULL when nothing is left."""
    kept = F.transform(F.filter(items, lambda x: ~F.coalesce(none_like(x), F.lit(False))), _soften)
    return F.when(F.size(kept) > 0, kept)


def normalize_clips(raw: DataFrame) -> DataFrame:
    """B1. Clean clips from raw annotation rows.

    Any of `video_name`/`file_name` and the singular or plural person columns may be
    present; people become arrays, none-like values NULL, action synonyms one form.
    """
    def first(*names):
        present = [F.col(n) for n in names if n in raw.columns]
        return F.coalesce(*present) if present else F.lit(None).cast("string")

    def people(*names):
        value = first(*names)
        items = F.when(raw_kind(value) == "list", raw_list(value)).when(raw_kind(value) == "str", F.array(value))
        return normalize_people(items)

    action = first("action")
    synonym = F.create_map(*[F.lit(x) for pair in K.ACTION_SYNONYMS.items() for x in pair])
    action = F.when(~none_like(action), F.coalesce(F.try_element_at(synonym, F.lower(F.trim(action))), action))
    environment = first("environment")
    return raw.select(
        first("video_name", "file_name").alias("clip"),
        action.alias("action"),
        people("aggressor", "aggressors").alias("aggressor"),
        people("victim", "victims").alias("victim"),
        people("bystander", "bystanders").alias("bystander"),
        F.when(~none_like(environment), environment).alias("environment"),
    )


def format_people(items: Column) -> Column:
    """B2. 'A', 'A and B', 'A, B, and C'; NULL when nobody is left."""
    named = F.filter(items, lambda x: ~is_blank(x))
    n = F.size(named)
    return (
        F.when(items.isNull() | (n <= 0), None)
        .when(n == 1, F.get(named, F.lit(0)))
        .when(n == 2, F.array_join(named, " and "))
        .otherwise(F.concat(
            F.array_join(F.slice(named, F.lit(1), n - 1), ", "), F.lit(", and "), F.get(named, n - 1)))
    )


def is_specific(value: Column) -> Column:
    """B5. The text names one identifiable person."""
    low = F.lower(F.trim(value))
    generic = low.isin(*K.GENERIC_TOKENS) | any_of(low.contains(p) for p in K.GENERIC_PHRASES)
    return F.coalesce((low != "") & ~generic, F.lit(False))


def any_specific(items: Column) -> Column:
    """B5 on a list: one specific member is enough."""
    return F.coalesce(F.exists(items, is_specific), F.lit(False))


def specific_people(items: Column) -> Column:
    return F.transform(F.filter(items, is_specific), lambda x: F.trim(x))


def individual_people(items: Column) -> Column:
    """B6. Members that are not groups, without case-insensitive repeats (first one kept)."""
    named = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: (x != "") & ~F.lower(x).contains("group of"))
    lowered = F.transform(named, F.lower)
    return F.filter(named, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)


def split_people(text: Column) -> Column:
    """B6. A joined description back into its parts."""
    parts = F.transform(F.split(text, r"\s+and\s+|,\s*"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


# --- presence tests -----------------------------------------------------------

def normal_by_name(clip: Column) -> Column:
    return F.lower(clip).contains("normal")


def normal_by_slots(*slots: Column) -> Column:
    """B21. Every slot is none-like."""
    tests = [s.isNull() | none_like(s, K.NORMAL_NONE_VALUES) for s in slots]
    return reduce(lambda a, b: a & b, tests)


def is_missing(value: Column) -> Column:
    return value.isNull() | none_like(value)


def all_missing(items: Column) -> Column:
    return items.isNull() | F.forall(items, lambda x: x.isNull() | none_like(x))


def presence(value: Column, label: str, none_words=K.NONE_VALUES) -> Column:
    """B27. The cleaned value, or `label` when it is not filled in."""
    low = F.lower(F.trim(value))
    return F.when(value.isNull() | low.isin(*none_words), F.lit(label)).otherwise(low)


def has_fields(kinds: dict, values: dict, fields) -> Column:
    """B28. Each field's key must exist; NULL is fine, a blank text or list is not.

    `kinds` maps a field to a column that is 'absent' where the key is missing."""
    def usable(field):
        value = values[field]
        if field in PERSON_FIELDS:
            blank = value.isNotNull() & F.forall(value, lambda x: F.coalesce(F.trim(x) == "", F.lit(True)))
        else:
            blank = value.isNotNull() & (F.trim(value) == "")
        return (kinds[field] != "absent") & ~blank

    return reduce(lambda a, b: a & b, [usable(f) for f in fields], F.lit(True))
