"""Signups, active users, feature use, churn and totals since inception.

Populations: active, one-time, recurring and first-time users are unrestricted
registered users only. Averages, users per feature, single / multiple / only
counts and churn cover everyone with activity, restricted and unregistered
included. Rows without a user key form one nameless user in the counts that group
by user, and none in the counts of distinct users.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagepulse.functions.calendar import Period, bit_positions
from usagepulse.functions.numeric import ratio
from usagepulse.operators import rollup
from usagepulse.sources.registry import FEATURES, of_feature


def positions_in(period: Period) -> dict[str, str]:
    return bit_positions("activity_date", f"DATE'{period.start}'")


def unrestricted(users: DataFrame) -> DataFrame:
    """Users whose ``restricted`` is false; an unknown value drops out."""
    return users.filter(~F.col("restricted"))


def period_counts(features: Sequence[str], first_time: str) -> list[Column]:
    """Counts over user rows with ``member``, ``active_days`` and the features in use.

    ``first_time`` is the SQL condition for the first activity ever to be in period.
    """
    used, flags = rollup.count_of_features("uses", features), rollup.feature_flags("uses", features)
    return rollup.count_where(
        {
            "total_active_users": "member AND active_days > 0",
            "one_time_usage_users": "member AND active_days = 1",
            "recurring_users": "member AND active_days >= 2",
            "first_time_users": f"member AND active_days > 0 AND {first_time}",
            **{f"{f}_users": f"{flag} AND user_id IS NOT NULL" for f, flag in flags.items()},
            "single_feature_users": f"{used} = 1",
            "multiple_feature_users": f"{used} > 1",
            **{f"only_{f}_users": f"{used} = 1 AND {flag}" for f, flag in flags.items()},
        }
    )


def comprehensive_columns(features: Sequence[str]) -> list[str]:
    return [
        "total_signups", "total_active_users", "one_time_usage_users", "recurring_users",
        "first_time_users", "avg_dau", "avg_wau", "avg_mau",
        *(f"{f}_users" for f in features),
        "single_feature_users", "multiple_feature_users",
        *(f"only_{f}_users" for f in features),
    ]


def comprehensive_metrics(
    activity: DataFrame,
    users: DataFrame,
    start: date | str,
    end: date | str,
    features: Sequence[str] = FEATURES,
    first: DataFrame | None = None,
) -> DataFrame:
    """One row with every engagement metric of ``[start, end]``.

    Reads activity once: a rollup per user, a full join with the unrestricted
    users on the same key, and one global aggregate over user rows. With ``first``, a
    `first_seen` frame of the time before, no activity before ``start`` is read.
    """
    period = Period.of(start, end)
    inside = period.sql_holds("activity_date")
    seen = activity.filter(F.col("activity_date") <= period.end)
    if first is not None:
        seen = seen.filter(F.col("activity_date") >= period.start)
    per_user = (
        rollup.numbered_features(seen, features)
        .groupBy("user_id")
        .agg(
            F.min("activity_date").alias("first_ever"),
            *rollup.calendar_marks(inside, positions_in(period), period.days),
            *rollup.feature_marks(inside, "uses", features),
        )
        .withColumn("active_days", F.expr(rollup.active_units(period.days)["day"]))
    )
    members = unrestricted(users).select("user_id", "signup_date", F.lit(True).alias("member"))
    joined = per_user.join(rollup.with_known_first(members, first), "user_id", "full_outer").withColumn(
        "first_ever", F.least("first_ever", "known_first")
    )

    sums, averages = rollup.average_active_users(period.days)
    totals = joined.agg(
        F.count_if(period.holds(F.col("signup_date"))).alias("total_signups"),
        *period_counts(features, period.sql_holds("first_ever")),
        *sums,
    )
    return totals.withColumns(averages).select(*comprehensive_columns(features))


FEATURE_METRICS = [
    "total_active_users", "first_time_users", "recurring_users",
    "avg_dau", "avg_wau", "avg_mau", "stickiness",
]


def _feature_users(
    activity: DataFrame, users: DataFrame, period: Period, keys: Sequence[str]
) -> DataFrame:
    """A row per user (and other keys) of the period, with the signup if within it."""
    per_user = (
        activity.filter(period.holds(F.col("activity_date")))
        .groupBy("user_id", *keys)
        .agg(
            F.min("activity_date").alias("first_in_period"),
            *rollup.calendar_marks("true", positions_in(period), period.days),
        )
        .withColumn("active_days", F.expr(rollup.active_units(period.days)["day"]))
    )
    signups = (
        unrestricted(users)
        .filter(period.holds(F.col("signup_date")))
        .select("user_id", "signup_date")
    )
    return per_user.join(signups, "user_id", "left")


def _feature_counts(period: Period) -> tuple[list[Column], dict[str, Column]]:
    """Aggregates over ``_feature_users``, and the columns derived from them."""
    sums, derived = rollup.average_active_users(period.days)
    counts = [
        F.count("user_id").alias("total_active_users"),
        F.count_if(F.col("first_in_period") >= F.col("signup_date")).alias("first_time_users"),
        F.count_if(F.col("active_days") > 1).alias("recurring_users"),
    ]
    return [*counts, *sums], derived


def _with_stickiness(metrics: DataFrame) -> DataFrame:
    """Average DAU over average MAU, 0 if undefined."""
    return metrics.withColumn(
        "stickiness", F.coalesce(ratio(F.col("avg_dau"), F.col("avg_mau")), F.lit(0.0))
    )


def feature_metrics(
    activity: DataFrame,
    users: DataFrame,
    start: date | str,
    end: date | str,
    feature: str,
    features: Sequence[str] = FEATURES,
) -> DataFrame:
    """One row of metrics for a single feature over ``[start, end]``.

    A first-time user here signed up within the period and first used the feature
    within it on or after the signup date; `comprehensive_metrics` instead asks for
    the first activity ever. ``stickiness`` is average DAU over average MAU.
    """
    period = Period.of(start, end)
    chosen = of_feature(activity, feature, features)
    counts, derived = _feature_counts(period)
    totals = _feature_users(chosen, users, period, []).agg(*counts)
    return _with_stickiness(totals.withColumns(derived)).select(*FEATURE_METRICS)


def metrics_by_feature(
    activity: DataFrame,
    users: DataFrame,
    start: date | str,
    end: date | str,
    features: Sequence[str] = FEATURES,
) -> DataFrame:
    """`feature_metrics` of every feature, one row each, from a single pass."""
    period = Period.of(start, end)
    listed = activity.filter(F.col("feature").isin(*features))
    counts, derived = _feature_counts(period)
    found = _feature_users(listed, users, period, ["feature"]).groupBy("feature").agg(*counts)
    found = found.withColumns(derived).select("feature", *FEATURE_METRICS[:-1])
    # A feature nobody used still has its row of zeros.
    everything = activity.sparkSession.range(1).select(
        F.explode(F.array(*map(F.lit, features))).alias("feature")
    )
    merged = everything.unionByName(found, allowMissingColumns=True).groupBy("feature").agg(
        *(
            F.expr(f"max({m}) AS {m}" if m.startswith("avg") else f"coalesce(max({m}), 0) AS {m}")
            for m in FEATURE_METRICS[:-1]
        )
    )
    return _with_stickiness(merged).select("feature", *FEATURE_METRICS)


def first_seen(activity: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """``(user_id, first_ever)``: each user's first active day.

    Kept in a table, it spares reports that look back to the beginning all activity before
    their period. ``before`` is such a table of earlier days, which ``activity`` then brings up
    to date: the minimum of both, whatever days they share.
    """
    days = activity.select("user_id", F.col("activity_date").alias("first_ever"))
    known = days if before is None else days.unionByName(before.select("user_id", "first_ever"))
    return known.groupBy("user_id").agg(F.min("first_ever").alias("first_ever"))


def churn_count(
    activity: DataFrame, start: date | str, end: date | str, first: DataFrame | None = None
) -> DataFrame:
    """Users active at any time up to ``end`` but not within ``[start, end]``.

    One flag per user replaces the anti join. The nameless user always counts, as
    it never matches itself in an anti join. With ``first``, a `first_seen` frame,
    only the period's activity is read.
    """
    period = Period.of(start, end)
    day = F.col("activity_date")
    seen = activity.filter(day <= period.end)
    if first is not None:
        known = first.filter(F.col("first_ever") <= period.end)
        seen = (
            activity.filter(period.holds(day))
            .select("user_id", "activity_date")
            .unionByName(known.select("user_id", F.lit(None).cast("date").alias("activity_date")))
        )
    per_user = seen.groupBy("user_id").agg(
        rollup.any_mark(period.sql_holds("activity_date"), "came_back")
    )
    return per_user.agg(*rollup.count_where({"churn_count": "NOT came_back OR user_id IS NULL"}))


def absolute_metrics(
    activity: DataFrame, users: DataFrame, end: date | str, first: DataFrame | None = None
) -> DataFrame:
    """Unrestricted signups and distinct active users from inception to ``end``.

    With ``first``, a `first_seen` frame, no activity is read.
    """
    last = F.lit(Period.of(end, end).end)
    signups = (
        unrestricted(users)
        .filter(F.col("signup_date") <= last)
        .agg(F.count("*").alias("absolute_total_signups"))
    )
    if first is None:
        active = activity.filter(F.col("activity_date") <= last).agg(
            F.count_distinct("user_id").alias("absolute_total_active_users")
        )
    else:
        active = first.filter(F.col("first_ever") <= last).agg(
            F.count("user_id").alias("absolute_total_active_users")
        )
    return rollup.one_row(signups, active)
