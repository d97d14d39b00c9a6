"""Signup-cohort retention.

The three flags need only one date per user, the first return after signup:
day 1 is that date being signup + 1, week 1 and month 1 are it being within 7 or
30 days. Activity is seen up to the end of the period only, so late signups are
right-censored, as in the source reports.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagepulse.functions import calendar
from usagepulse.functions.calendar import Period
from usagepulse.functions.numeric import ratio
from usagepulse.operators.engagement import positions_in, unrestricted
from usagepulse.sources.registry import FEATURES, of_feature

# Days after signup that still count, per horizon; day 1 has to be exact.
HORIZONS = {"day1": 1, "week1": 7, "month1": 30}
# Next activity is looked for in a word of day bits and the one after it.
assert max(HORIZONS.values()) <= calendar.WORD_BITS


def first_returns(
    signups: DataFrame, activity: DataFrame, period: Period, how: str, by: Sequence[str] = ()
) -> DataFrame:
    """Adds ``first_return`` to each signup: its first activity on a later date.

    Activity of the period shrinks to one row of day bits per user (and ``by``) on
    the map side, meets the signups on the same key, and the return is the next set
    bit after the signup. So activity is shuffled once, one row per user. A return
    too late for every horizon may be left NULL.
    """
    bits = calendar.bitmap_lengths(period.days)["day"]
    position = positions_in(period)["day"]
    per_user = (
        activity.filter(period.holds(F.col("activity_date")))
        .groupBy("user_id", *by)
        .agg(calendar.mark_bit_array(position, "true", "active_days", bits))
    )
    monday = f"trunc(DATE'{period.start}', 'week')"
    joined = signups.join(per_user, "user_id", how)
    found = calendar.with_next_bit(joined, "active_days", f"date_diff(signup_date, {monday})")
    return found.selectExpr(
        *signups.columns, *by, f"date_add({monday}, CAST(next_pos AS int)) AS first_return"
    )


def retained_counts(seen_until: Column) -> list[Column]:
    """Returned users per horizon, over rows of ``first_returns``."""
    seen = F.col("first_return") <= seen_until
    return [
        F.count_if(
            seen & (F.date_diff("first_return", "signup_date") <= days)
        ).alias(f"{name}_users")
        for name, days in HORIZONS.items()
    ]


def retention_ratios() -> dict[str, Column]:
    """Ratio per horizon (NULL without signups) and the same as a percentage (then 0)."""
    columns: dict[str, Column] = {}
    for name in HORIZONS:
        columns[f"{name}_retention"] = ratio(F.col(f"{name}_users"), F.col("total_signups"))
    for name in HORIZONS:
        percent = ratio(F.col(f"{name}_users"), F.col("total_signups")) * 100
        columns[f"{name}_percent"] = F.coalesce(percent, F.lit(0.0))
    return columns


def signups_within(users: DataFrame, period: Period, *extra: str) -> DataFrame:
    return (
        unrestricted(users)
        .filter(period.holds(F.col("signup_date")) & F.col("user_id").isNotNull())
        .select("user_id", "signup_date", *extra)
    )


def retention(
    activity: DataFrame,
    users: DataFrame,
    start: date | str,
    end: date | str,
    feature: str | None = None,
    features: Sequence[str] = FEATURES,
) -> DataFrame:
    """Signups of ``[start, end]`` and their day-1, week-1 and month-1 retention."""
    period = Period.of(start, end)
    chosen = of_feature(activity, feature, features)
    totals = first_returns(signups_within(users, period), chosen, period, "left").agg(
        F.count("*").alias("total_signups"), *retained_counts(F.lit(period.end))
    )
    ratios = retention_ratios()
    return totals.select("total_signups", *(c.alias(n) for n, c in ratios.items()))


def retention_by_feature(
    activity: DataFrame,
    users: DataFrame,
    start: date | str,
    end: date | str,
    features: Sequence[str] = FEATURES,
) -> DataFrame:
    """`retention` of every feature, one row each, from a single pass over activity."""
    period = Period.of(start, end)
    signups = signups_within(users, period)
    listed = F.explode(F.array(*map(F.lit, features))).alias("feature")
    # One row of totals, repeated per feature: every feature has the same cohort.
    cohort = signups.agg(F.count("*").alias("total_signups")).select(listed, "total_signups")
    kept = (
        first_returns(
            signups, activity.filter(F.col("feature").isin(*features)), period, "inner", ["feature"]
        )
        .groupBy("feature")
        .agg(*retained_counts(F.lit(period.end)))
    )
    counts = ["total_signups", *(f"{name}_users" for name in HORIZONS)]
    totals = (
        cohort.unionByName(kept, allowMissingColumns=True)
        .groupBy("feature")
        .agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts))
    )
    ratios = retention_ratios()
    return totals.select("feature", "total_signups", *(c.alias(n) for n, c in ratios.items()))
