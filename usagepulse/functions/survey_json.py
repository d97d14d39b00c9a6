"""Counting answered questions in a survey submission stored as JSON text.

A submission looks like ``{"plan": [{"question": .., "answer": ..}, ..]}``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# JSON texts that count as "not answered".
EMPTY_ANSWERS = ("null", '""', "[]", "{}")

# The lenient reading takes NaN and Infinity; everything else is JSON as ever.
_LENIENT = {"allowNonNumericNumbers": "true", "allowSingleQuotes": "false"}


def answered_count(metadata: Column) -> Column:
    """Number of questions whose last answer is not null, "", [] or {}.

    Items of ``plan`` that are not objects are skipped. Text that is not JSON, a
    missing or non-array ``plan``, an object lacking either key, or a list or
    object used as a question leaves the submission with no answers.

    NaN and infinities are answers, and of a repeated key the last value stands.
    """
    entries = F.coalesce(_strict_entries(metadata), _lenient_entries(metadata))
    # One-element array: binds the sorted entries to a name, so they are built once.
    counted = F.transform(F.array(F.array_sort(entries)), _count_last_answers)
    return F.coalesce(F.element_at(counted, 1), F.lit(0))


def _strict_entries(metadata: Column) -> Column:
    """The objects of ``plan`` as ``question, place, answer`` in JSON; NULL without a plan."""
    plan = F.try_variant_get(F.try_parse_json(metadata), "$.plan", "array<variant>")
    objects = F.filter(plan, lambda item: F.schema_of_variant(item).startswith("OBJECT"))
    return F.transform(
        objects,
        lambda item, place: F.struct(
            F.to_json(F.try_variant_get(item, "$.question", "variant")).alias("question"),
            place.alias("place"),
            F.to_json(F.try_variant_get(item, "$.answer", "variant")).alias("answer"),
        ),
    )


def _lenient_entries(metadata: Column) -> Column:
    """The same for text with NaN, infinities or repeated keys, which variants refuse.

    Only evaluated where the strict reading finds no plan. The text is put into an object
    whose second field is only found if the text is whole and nothing follows it. Items
    are read as texts, so a text that spells an object counts as one here.
    """
    whole = F.from_json(
        F.concat(F.lit('{"document":'), metadata, F.lit(',"end":1}')),
        "document struct<plan: array<string>>, end int",
        _LENIENT,
    )
    objects = F.filter(whole["document"]["plan"], lambda item: item.startswith("{"))
    entries = F.transform(
        objects,
        lambda item, place: F.struct(
            _last_value(item, "question").alias("question"),
            place.alias("place"),
            _last_value(item, "answer").alias("answer"),
        ),
    )
    return F.when(whole["end"] == 1, entries)


def _last_value(item: Column, key: str) -> Column:
    """JSON of the last value of ``key``; NULL if the object lacks it.

    An object with a value that itself repeats a key is read as texts, which leaves
    strings without their quotes.
    """

    def last(values: str) -> tuple[Column, Column]:
        entries = F.map_entries(F.from_json(item, f"map<string, {values}>", _LENIENT))
        named = F.filter(entries, lambda entry: entry["key"] == key)
        return F.get(named, F.size(named) - 1)["value"], F.size(named) > 0

    exact, _ = last("variant")
    text, present = last("string")
    plain = F.when(text.isNull(), "null").when(text == "", '""').otherwise(text)
    return F.coalesce(F.to_json(exact), F.when(present, plain))


def _count_last_answers(entries: Column) -> Column:
    unusable = F.exists(
        entries,
        lambda e: e["question"].isNull()
        | e["answer"].isNull()
        | e["question"].startswith("[")
        | e["question"].startswith("{"),
    )
    # Sorted by question, then place: an entry is the last of its question when
    # its right neighbour asks something else.
    answered = F.filter(
        entries,
        lambda e, i: (
            (i == F.size(entries) - 1)
            | (F.get(entries, i + 1)["question"] != e["question"])
        )
        & ~e["answer"].isin(*EMPTY_ANSWERS),
    )
    return F.when(~unusable, F.size(answered))
