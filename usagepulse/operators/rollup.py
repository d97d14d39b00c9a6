"""The per-user rollup shared by the engagement, dormancy and KPI operators.

One hash aggregate turns activity into a row per user (or user and period) with
calendar and feature bitmaps. All of its aggregates ignore repeats and
combine on the map side, so a user holding a large share of the rows leaves each
map task as one row, and activity need not be distinct.

Aggregates are given as SQL text: there are many of them per report, and each
costs the driver one call this way instead of ten.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagepulse.functions import calendar
from usagepulse.functions.sql_text import quoted

def one_row(*frames: DataFrame) -> DataFrame:
    """Columns of several one-row frames side by side, without a cross join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*(F.max(c).alias(c) for c in stacked.columns))


def calendar_marks(inside: str, positions: dict[str, str], longest_days: int) -> list[Column]:
    """Bitmap aggregates of the days and months of activity inside a period."""
    return [
        word
        for unit, bits in calendar.bitmap_lengths(longest_days).items()
        for word in calendar.mark_bits(positions[unit], inside, unit, bits)
    ]


def numbered_features(activity: DataFrame, features: Sequence[str]) -> DataFrame:
    """Activity with ``feature_pos``, the place of its feature, instead of the name.

    A feature that is not listed gets NULL: activity of no feature in particular.
    """
    for f in features:
        if not f.isidentifier():
            raise ValueError(f"feature name {f!r} is not an identifier")
    places = " ".join(f"WHEN {quoted(f)} THEN {i}" for i, f in enumerate(features))
    return activity.selectExpr(
        "user_id", "activity_date", f"CASE feature {places} END AS feature_pos"
    )


def with_first_day(
    activity: DataFrame, features: Sequence[str], first: DataFrame | None, opening: date, end: date
) -> DataFrame:
    """Numbered activity up to ``end`` with ``first_ever``, whose minimum per user is its first day.

    Without ``first`` that takes all activity up to ``end``. ``first`` is a `first_seen`
    frame: the state per user as of any day. Its rows join the activity from ``opening`` on as
    rows without a date, and the minimum merges both, so nothing before ``opening`` is read.
    The state has to cover every day before ``opening``; what it knows later does no harm.
    """
    day = F.col("activity_date")
    if first is None:
        return numbered_features(activity.filter(day <= F.lit(end)), features).withColumn("first_ever", day)
    recent = numbered_features(activity.filter(day.between(F.lit(opening), F.lit(end))), features)
    known = first.filter(F.col("first_ever") <= F.lit(end)).select(
        "user_id", F.lit(None).cast("date").alias("activity_date"),
        F.lit(None).cast("int").alias("feature_pos"), "first_ever",
    )
    return recent.withColumn("first_ever", day).unionByName(known)


def with_known_first(users: DataFrame, first: DataFrame | None) -> DataFrame:
    """``users`` with ``known_first``, their day in a `first_seen` frame of the time before.

    A left join keeps the users where they lie, so tables bucketed by user meet without an
    exchange, which a union would need.
    """
    if first is None:
        return users.withColumn("known_first", F.lit(None).cast("date"))
    return users.join(first.select("user_id", F.col("first_ever").alias("known_first")), "user_id", "left")


def day_matrix(activity: DataFrame, features: Sequence[str], opening: date, end: date) -> DataFrame:
    """A row per user: ``first_ever`` and array bitmaps of its days from the Monday of ``opening``.

    ``days`` has the days of any activity, ``days_<n>`` those of the n-th feature. Activity
    shrinks to this row on the map side, and every period within the range can be cut out of
    it (`calendar.cut_words`), so one shuffle of users serves any number of periods.
    """
    bits = calendar.days_from_monday(opening, end)
    origin = calendar.monday(opening)
    place = f"CASE WHEN activity_date >= DATE'{opening}' THEN date_diff(activity_date, DATE'{origin}') END AS place"
    return (
        numbered_features(activity.filter(F.col("activity_date") <= F.lit(end)), features)
        .selectExpr("user_id", "activity_date", "feature_pos", place)
        .selectExpr("user_id", "activity_date", "feature_pos", *calendar.placed("place"))
        .groupBy("user_id")
        .agg(
            F.min("activity_date").alias("first_ever"),
            calendar.mark_placed("days", bits),
            *(calendar.mark_placed(f"days_{n}", bits, f"feature_pos = {n}") for n in range(len(features))),
        )
    )


def feature_marks(inside: str, prefix: str, features: Sequence[str]) -> list[Column]:
    """Bitmap aggregates of the features used inside a window."""
    return calendar.mark_bits("feature_pos", inside, prefix, len(features))


def feature_flags(prefix: str, features: Sequence[str]) -> dict[str, str]:
    """SQL per feature for whether a finished feature bitmap holds it."""
    return {f: calendar.has_bit(prefix, i) for i, f in enumerate(features)}


def count_of_features(prefix: str, features: Sequence[str]) -> str:
    return calendar.count_bits(prefix, len(features))


def any_mark(inside: str, name: str) -> Column:
    return F.expr(f"coalesce(bool_or({inside}), false) AS {name}")


def active_units(longest_days: int) -> dict[str, str]:
    """SQL for the days, weeks and months set in finished bitmaps."""
    bits = calendar.bitmap_lengths(longest_days)
    return {
        "day": calendar.count_bits("day", bits["day"]),
        "week": calendar.count_weeks("day", bits["day"]),
        "month": calendar.count_bits("month", bits["month"]),
    }


def count_where(conditions: dict[str, str]) -> list[Column]:
    """``count_if`` per named SQL condition."""
    return [F.expr(f"count_if({met}) AS {name}") for name, met in conditions.items()]


def average_active_users(longest_days: int) -> tuple[list[Column], dict[str, Column]]:
    """Average daily, weekly and monthly active users over periods with activity.

    The mean of per-day user counts equals (user, day) pairs over distinct days.
    Rows without a user key make a day exist but add no user to it. Returns the
    aggregates to compute over user rows, and the averages over their result.
    """
    aggregates = [
        word
        for unit, bits in calendar.bitmap_lengths(longest_days).items()
        for word in calendar.merge_bits(unit, bits)
    ]
    averages: dict[str, Column] = {}
    for unit, size in active_units(longest_days).items():
        pairs = f"sum(CASE WHEN user_id IS NULL THEN 0 ELSE {size} END)"
        aggregates.append(F.expr(f"{pairs} AS {unit}_pairs"))
        averages[f"avg_{unit[0]}au"] = F.expr(f"{unit}_pairs / nullif({size}, 0)")
    return aggregates, averages
