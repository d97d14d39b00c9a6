"""Ratios and one-decimal rounding with IEEE double semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double; NULL when ``whole`` is zero or NULL."""
    return F.when(whole > 0, part / whole)


def percent(part: Column, whole: Column) -> Column:
    """Guarded percentage: 0 when ``whole`` is not positive.

    Divides before multiplying, so values close to a threshold land on the same
    side of it as in any other IEEE engine that uses this order.
    """
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def sql_percent(part: str, whole: str) -> str:
    """`percent` as SQL text over column names."""
    return f"CASE WHEN {whole} > 0 THEN {part} / {whole} * 100 ELSE 0D END"


def round1_half_even(x: Column) -> Column:
    """Scale, round half to even, scale back: what pandas' ``round(1)`` does."""
    return F.rint(x * 10) / 10


def one_decimal_text(x: Column) -> Column:
    """Text with one decimal, rounded from the exact binary value of ``x``.

    Java's formatter rounds the shortest decimal text half up, which prints 6.25
    as 6.3; C-style formatting prints 6.2. The remainder against the tie is exact
    here because ``20 * a`` is split into two power-of-two products.
    """
    a = F.abs(x)
    tenths = F.floor(a * 10)
    high, low = a * 16, a * 4
    total = high + low
    carried = total - high
    lost = (high - (total - carried)) + (low - carried)
    above_tie = (total - (tenths * 2 + 1)) + lost
    rounded = tenths + F.when(
        (above_tie > 0) | ((above_tie == 0) & (tenths % 2 == 1)), F.lit(1)
    ).otherwise(F.lit(0))
    return F.concat(
        F.when(x < 0, F.lit("-")).otherwise(F.lit("")),
        F.floor(rounded / 10).cast("string"),
        F.lit("."),
        (rounded % 10).cast("string"),
    )


def capitalize(text: Column) -> Column:
    """First character upper case, everything after it lower case."""
    tail = text.substr(F.lit(2), F.length(text))
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(tail))
