"""Active-user series, the overview trend with running totals, and smoothing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from usagepulse.functions import calendar
from usagepulse.functions.calendar import GRANULARITIES, Period, Steps, spine, truncate
from usagepulse.operators import rollup
from usagepulse.operators.engagement import unrestricted
from usagepulse.sources.registry import FEATURES, of_feature

# Column names of an active-user series per granularity.
SERIES_COLUMNS = {"day": ("activity_date", "dau"), "week": ("week", "wau"), "month": ("month", "mau")}

# Rows in a smoothing window; monthly series are not smoothed.
SMOOTHING_ROWS = {"day": 7, "week": 4}

CUMULATIVE_FILLS = ("carry", "zero")


def active_user_trend(
    activity: DataFrame,
    start: date | str,
    end: date | str,
    granularity: str,
    feature: str | None = None,
    features: Sequence[str] = FEATURES,
) -> DataFrame:
    """Distinct users per day, week or month with activity, in period order.

    The first and last week or month cover only the days inside ``[start, end]``.
    """
    period = Period.of(start, end)
    bucket = truncate(F.col("activity_date"), granularity)
    name, count = SERIES_COLUMNS[granularity]
    return (
        of_feature(activity, feature, features)
        .filter(period.holds(F.col("activity_date")))
        .groupBy(bucket.alias(name))
        .agg(F.count_distinct("user_id").alias(count))
        .orderBy(name)
    )


def active_user_series(
    activity: DataFrame,
    start: date | str,
    end: date | str,
    feature: str | None = None,
    features: Sequence[str] = FEATURES,
) -> DataFrame:
    """The daily, weekly and monthly series as ``(granularity, period_start, users)``.

    Activity shrinks to a row of day bits per user on the map side and is shuffled once. The
    row unfolds into the user's own days, weeks and months, which are only counted then.
    """
    period = Period.of(start, end)
    bits = calendar.days_from_monday(period.start, period.end)
    opening = f"DATE'{calendar.monday(period.start)}'"
    per_user = (
        of_feature(activity, feature, features)
        .filter(period.holds(F.col("activity_date")))
        .groupBy("user_id")
        .agg(calendar.mark_bit_array(f"date_diff(activity_date, {opening})", "true", "days", bits))
        .selectExpr(
            "user_id",
            f"transform({calendar.array_positions('days', bits)}, pos -> date_add({opening}, pos)) AS dates",
        )
    )
    starts = {"day": "d", "week": "trunc(d, 'week')", "month": "trunc(d, 'month')"}
    unfolded = ", ".join(
        f"transform(array_distinct(transform(dates, d -> {starts[g]})), "
        f"d -> named_struct('granularity', '{g}', 'period_start', d))"
        for g in GRANULARITIES
    )
    return (
        per_user.selectExpr("user_id", f"inline(concat({unfolded}))")
        .groupBy("granularity", "period_start")
        .agg(F.count("user_id").alias("users"))
    )


def overview_columns(features: Sequence[str]) -> list[str]:
    return [
        "signups", "active_users", *(f"{f}_users" for f in features),
        "absolute_signups", "absolute_active_users",
    ]


def overview_trend(
    activity: DataFrame,
    users: DataFrame,
    start: date | str,
    end: date | str,
    granularity: str = "day",
    fill: str = "carry",
    features: Sequence[str] = FEATURES,
    first: DataFrame | None = None,
) -> DataFrame:
    """Per period: signups, active users, users per feature and running totals.

    The spine starts at the period holding ``start``. Running totals count from
    inception; ``fill="carry"`` keeps the last value through quiet periods,
    ``fill="zero"`` shows 0 in a period without signups (or without activity).

    Activity shrinks to a row per user, with its first day and a bitmap of the periods it
    was active in, and is shuffled once. The row unfolds into the user's own periods; the
    running total of distinct users is a running sum of those whose first day is in a
    period, so nothing is compared across periods. With ``first``, a `first_seen` frame of
    the time before, no activity before the spine is read.
    """
    if fill not in CUMULATIVE_FILLS:
        raise ValueError(f"unknown fill {fill!r}, expected one of {CUMULATIVE_FILLS}")
    period = Period.of(start, end)
    steps = Steps(period, granularity)
    opening = f"DATE'{steps.opening}'"
    place = f"CASE WHEN activity_date >= {opening} THEN {steps.number('activity_date')} END AS place"
    # The first period may open before the range: its earlier days are not counted,
    # but they are activity as far as the running totals go.
    inside = period.sql_holds("activity_date")
    marks = {"seen": "true", "active_users": "inside"}
    marks |= {f"{f}_users": f"inside AND feature_pos = {n}" for n, f in enumerate(features)}
    per_user = (
        rollup.with_first_day(activity, features, first, steps.opening, period.end)
        .selectExpr("user_id", "first_ever", "feature_pos", f"{inside} AS inside", place)
        .selectExpr("user_id", "first_ever", "feature_pos", "inside", *calendar.placed("place"))
        .groupBy("user_id")
        .agg(
            F.min("first_ever").alias("first_ever"),
            *(calendar.mark_placed(name, steps.count, met) for name, met in marks.items()),
        )
        # NULL stands for everything before the spine.
        .withColumn("first_no", F.expr(f"CASE WHEN first_ever >= {opening} THEN {steps.number('first_ever')} END"))
    )
    periods = f"array_union({calendar.array_positions('seen', steps.count)}, array(first_no))"
    usage = per_user.selectExpr("*", f"explode({periods}) AS no").selectExpr(
        f"{steps.start('no')} AS dt",
        "true AS any_activity",
        *(
            f"CAST({calendar.array_has(name, 'no')} AND user_id IS NOT NULL AS bigint) AS {name}"
            for name in marks
            if name != "seen"
        ),
        "CAST(no <=> first_no AND user_id IS NOT NULL AS bigint) AS new_users",
    )
    signed_up = F.col("signup_date")
    signups = unrestricted(users).filter(signed_up <= period.end).select(
        F.when(signed_up >= F.lit(steps.opening), truncate(signed_up, granularity)).alias("dt"),
        (signed_up >= period.start).cast("bigint").alias("signups"),
        F.lit(1).cast("bigint").alias("signups_to_date"),
    )
    grid = spine(activity.sparkSession, period.start, period.end, granularity).select(
        "dt", F.lit(True).alias("on_spine")
    )
    series = grid.unionByName(usage, allowMissingColumns=True).unionByName(
        signups, allowMissingColumns=True
    )
    summed = ["signups", "active_users", *(f"{f}_users" for f in features), "signups_to_date", "new_users"]
    merged = series.groupBy("dt").agg(
        F.bool_or("on_spine").alias("on_spine"),
        F.bool_or("any_activity").alias("any_activity"),
        *(F.expr(f"coalesce(sum({c}), 0) AS {c}") for c in summed),
    )
    # One row per period of the spine and one for the time before it.
    so_far = Window.orderBy("dt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    absolute_signups = F.sum("signups_to_date").over(so_far)
    absolute_active = F.sum("new_users").over(so_far)
    if fill == "zero":
        absolute_signups = F.when(F.col("signups_to_date") > 0, absolute_signups).otherwise(0)
        absolute_active = F.when(F.col("any_activity"), absolute_active).otherwise(0)
    return (
        merged.withColumn("absolute_signups", absolute_signups)
        .withColumn("absolute_active_users", absolute_active)
        .filter("on_spine")
        .select(F.col("dt").alias("activity_date"), *overview_columns(features))
        .orderBy("activity_date")
    )


def melt_trend(
    trend: DataFrame,
    metrics: Sequence[str],
    granularity: str,
    smooth: bool = False,
    labels: Mapping[str, str] | None = None,
) -> DataFrame:
    """Selected columns of an overview trend as ``(activity_date, metric, count)``.

    ``labels`` gives the metric names to show instead of the column names.

    ``smooth`` replaces daily and weekly counts by a trailing mean of up to 7 days
    or 4 weeks, shorter at the start of the series; monthly counts stay as they are.
    """
    unknown = sorted(set(metrics) - set(trend.columns))
    if unknown:
        raise ValueError(f"unknown trend metrics {unknown}")
    names = {m: (labels or {}).get(m, m) for m in metrics}
    melted = trend.select(
        "activity_date", *(F.col(m).cast("double").alias(name) for m, name in names.items())
    ).unpivot("activity_date", [F.col(f"`{name}`") for name in names.values()], "metric", "count")
    rows = SMOOTHING_ROWS.get(granularity)
    if not smooth or rows is None:
        return melted
    trailing = (
        Window.partitionBy("metric").orderBy("activity_date").rowsBetween(1 - rows, Window.currentRow)
    )
    return melted.withColumn("count", F.avg("count").over(trailing))
