"""Users of a past window who stay away during the analysis period.

The history of a period is ``[start - N, start]``, both ends included. A user
counts as dormant for a feature when they used it in the history and not in the
period, whatever else they used; per-feature counts may therefore exceed the
overall one. The nameless user is dormant whenever it is historical.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagepulse.functions import calendar
from usagepulse.functions.calendar import Period
from usagepulse.functions.numeric import percent, round1_half_even
from usagepulse.operators import rollup
from usagepulse.sources.registry import FEATURES, FEATURE_LABELS, label_of


def presence_marks(past: str, now: str, features: Sequence[str]) -> list[Column]:
    """Activity and features in use, in the history and in the period."""
    return [
        rollup.any_mark(past, "was_active"),
        rollup.any_mark(now, "is_active"),
        *rollup.feature_marks(past, "used", features),
        *rollup.feature_marks(now, "uses", features),
    ]


def dormancy_counts(features: Sequence[str]) -> list[Column]:
    """Counts over user rows carrying ``presence_marks``."""
    used, uses = rollup.feature_flags("used", features), rollup.feature_flags("uses", features)

    def dormant(past: str, now: str) -> str:
        return f"{past} AND (NOT ({now}) OR user_id IS NULL)"

    return rollup.count_where(
        {
            "overall_dormant_users": dormant("was_active", "is_active"),
            **{f"{f}_dormant_users": dormant(used[f], uses[f]) for f in features},
            "total_historical_users": "was_active",
            "total_current_users": "is_active",
        }
    )


def dormant_analysis(
    activity: DataFrame,
    start: date | str,
    end: date | str,
    dormant_days: int,
    features: Sequence[str] = FEATURES,
) -> DataFrame:
    """One row of dormant counts, overall and per feature, and both population sizes."""
    period = Period.of(start, end, dormant_days)
    day = F.col("activity_date")
    seen = activity.filter(day.between(F.lit(period.history_start), F.lit(period.end)))
    per_user = (
        rollup.numbered_features(seen, features)
        .groupBy("user_id")
        .agg(
            *presence_marks(
                period.sql_history_holds("activity_date"),
                period.sql_holds("activity_date"),
                features,
            )
        )
    )
    return per_user.agg(*dormancy_counts(features))


def dormant_trend(
    activity: DataFrame, start: date | str, end: date | str, dormant_days: int
) -> DataFrame:
    """Per date with activity in the period: historical users not active on it.

    Counts the historical users seen on each date and subtracts, so no user is
    paired with a date they were absent. A date on which everyone came has no row. The
    nameless user adds to no count, but as it is never found present it gives every date
    a row, with 0 where all others came.
    Activity is shuffled once, as one row of day bits per user, and unfolds into
    dates only to be counted per date on the spot.
    """
    period = Period.of(start, end, dormant_days)
    day = F.col("activity_date")
    bits = dormant_days + period.days
    opening = f"DATE'{period.history_start}'"
    user_days = (
        activity.filter(day.between(F.lit(period.history_start), F.lit(period.end)))
        .groupBy("user_id")
        .agg(
            F.min("activity_date").alias("first_day"),
            *calendar.mark_bits(f"date_diff(activity_date, {opening})", "true", "day", bits),
        )
        .selectExpr("user_id", "first_day", f"explode({calendar.set_positions('day', bits)}) AS pos")
        .withColumn("activity_date", F.expr(f"date_add({opening}, pos)"))
    )
    # The range opens with the history, so a first day up to the start of the
    # period means historical; each such user is counted once, on that day.
    historical = (F.col("first_day") <= period.start) & F.col("user_id").isNotNull()
    nameless = (F.col("first_day") <= period.start) & F.col("user_id").isNull()
    per_date = user_days.groupBy("activity_date").agg(
        F.count_if(historical).alias("seen"),
        F.count_if(historical & (day == F.col("first_day"))).alias("joined"),
        F.bool_or(nameless).alias("nameless"),
    )
    # One row per date of the range: the unpartitioned window is as small as it.
    whole = Window.partitionBy()
    return (
        per_date.withColumn("dormant_count", F.sum("joined").over(whole) - F.col("seen"))
        .withColumn("nameless", F.bool_or("nameless").over(whole))
        .filter(period.holds(day) & ((F.col("dormant_count") > 0) | F.col("nameless")))
        .select("activity_date", "dormant_count")
        .orderBy("activity_date")
    )


def dormant_trend_change(trend: DataFrame) -> DataFrame:
    """Last minus first value of the trend and its direction; no row below two dates."""
    change = F.max_by("dormant_count", "activity_date") - F.min_by("dormant_count", "activity_date")
    return (
        trend.agg(F.count("*").alias("dates"), change.alias("trend_change"))
        .filter(F.col("dates") > 1)
        .select(
            "trend_change",
            F.abs("trend_change").alias("change_size"),
            F.when(F.col("trend_change") > 0, "increasing")
            .when(F.col("trend_change") < 0, "decreasing")
            .otherwise("stable")
            .alias("trend_direction"),
        )
    )


def dormant_breakdown(
    analysis: DataFrame,
    features: Sequence[str] = FEATURES,
    labels: dict[str, str] = FEATURE_LABELS,
) -> DataFrame:
    """The analysis row as a table: overall, then one row per feature.

    ``band`` is ``max`` on rows equal to the largest count, ``above_mean`` on others
    above the mean of the counts; ``top_feature`` is the first label with the
    largest count.
    """
    names = ["Overall", *(label_of(f, labels) for f in features)]
    counts = [F.col("overall_dormant_users"), *(F.col(f"{f}_dormant_users") for f in features)]
    overall = counts[0]
    shares = [F.lit(100.0), *(round1_half_even(percent(c, overall)) for c in counts[1:])]
    largest = F.greatest(*counts)
    mean = reduce(lambda a, b: a + b, counts) / len(counts)
    top = F.coalesce(*(F.when(c == largest, F.lit(n)) for n, c in zip(names, counts)))
    rows = F.array(
        *(
            F.struct(
                F.lit(place).alias("position"),
                F.lit(name).alias("feature"),
                count.alias("dormant_users"),
                share.alias("percentage_of_dormant"),
                F.when(count == largest, "max").when(count > mean, "above_mean").otherwise("").alias("band"),
                top.alias("top_feature"),
            )
            for place, (name, count, share) in enumerate(zip(names, counts, shares))
        )
    )
    return analysis.select(F.inline(rows))
