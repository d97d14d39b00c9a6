"""Registered queries: operators applied to the profiles over fixed windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagepulse.functions.calendar import Period, monthly_periods
from usagepulse.operators import (
    combinations,
    dormancy,
    engagement,
    kpis,
    retention,
    survey,
    trends,
)
from usagepulse.plans import profiles
from usagepulse.sources.registry import FEATURES, build_activity, build_events
from usagepulse.sources.tables import TableReader, parquet_reader

Query = Callable[[SparkSession, str], DataFrame]

MARCH = ("1998-03-01", "1998-03-31")
SPRING = ("1995-03-01", "1995-05-31")
LAUNCH = ("1995-01-01", "1995-12-31")
YEAR = ("1998-01-01", "1998-12-31")
EVENT_WEEKS = ("2024-01-08", "2024-01-21")
EVENT_START = ("2024-01-01", "2024-01-14")
# Opens on a Wednesday, so the weekly spine has to move back to Monday.
MIDWEEK = ("1998-02-18", "1998-05-20")
DORMANT_DAYS = 30

LABELS = {"signups": "Signups", "active_users": "Active Users"}

# Users active on day ``activity_date``, as parameterised SQL over a view.
DAILY_USERS_SQL = """
    SELECT activity_date, count(DISTINCT user_id) AS dau
    FROM {activity}
    WHERE activity_date BETWEEN :start AND :end
    GROUP BY activity_date
"""


class Profile:
    """Activity and users of one profile, read from a directory of tables."""

    def __init__(self, sources, users, view=lambda read: read) -> None:
        self._sources, self._users, self._view = sources, users, view

    def activity(self, read: TableReader, feature: str | None = None) -> DataFrame:
        return build_events(self._view(read), self._sources, feature)

    def fact(self, read: TableReader) -> DataFrame:
        return build_activity(self._view(read), self._sources)

    def users(self, read: TableReader) -> DataFrame:
        return self._users(self._view(read))


COMMERCE = Profile(profiles.COMMERCE_SOURCES, profiles.commerce_users)
EVENTS = Profile(profiles.EVENT_SOURCES, profiles.event_users)
GAPS = Profile(profiles.COMMERCE_SOURCES, profiles.commerce_users, profiles.with_gaps)
FIVE = Profile(profiles.FIVE_SOURCES, profiles.commerce_users)


def _on_activity(profile: Profile, op, *args, **kwargs) -> Query:
    def run(spark: SparkSession, root: str) -> DataFrame:
        activity = profile.activity(parquet_reader(spark, root), kwargs.get("feature"))
        return op(activity, *args, **kwargs)

    return run


def _on_both(profile: Profile, op, *args, **kwargs) -> Query:
    def run(spark: SparkSession, root: str) -> DataFrame:
        read = parquet_reader(spark, root)
        activity = profile.activity(read, kwargs.get("feature"))
        return op(activity, profile.users(read), *args, **kwargs)

    return run


def _on_table(source, op, *args) -> Query:
    return lambda spark, root: op(source(parquet_reader(spark, root)), *args)


def _then(query: Query, op, *args, **kwargs) -> Query:
    return lambda spark, root: op(query(spark, root), *args, **kwargs)


def _daily_users_sql(spark: SparkSession, root: str) -> DataFrame:
    activity = COMMERCE.activity(parquet_reader(spark, root))
    window = {"start": Period.of(*MARCH).start, "end": Period.of(*MARCH).end}
    return spark.sql(DAILY_USERS_SQL, args=window, activity=activity)


def _reserved_fact(spark: SparkSession, root: str) -> DataFrame:
    orders = profiles.reserved_words(parquet_reader(spark, root))
    return build_activity({"order": orders}.__getitem__, profiles.RESERVED_SOURCES)


def _with_first_seen(op, *args) -> Query:
    """Activity reports from a first-seen frame, derived here and kept in a table elsewhere."""

    def run(spark: SparkSession, root: str) -> DataFrame:
        read = parquet_reader(spark, root)
        activity = COMMERCE.activity(read)
        return op(activity, read, engagement.first_seen(activity), *args)

    return run


def _since(op, opening: str, *args, **kwargs) -> Query:
    """A report from the first-seen state as of the day before ``opening`` and what came later."""

    def run(spark: SparkSession, root: str) -> DataFrame:
        read = parquet_reader(spark, root)
        activity = COMMERCE.activity(read)
        state = engagement.first_seen(activity.filter(F.col("activity_date") < F.lit(opening)))
        return op(activity, COMMERCE.users(read), *args, first=state, **kwargs)

    return run


def _churn_since(activity: DataFrame, read: TableReader, first: DataFrame) -> DataFrame:
    return engagement.churn_count(activity, *MARCH, first=first)


def _absolute_since(activity: DataFrame, read: TableReader, first: DataFrame) -> DataFrame:
    return engagement.absolute_metrics(activity, COMMERCE.users(read), MARCH[1], first=first)


def all_queries() -> dict[str, Query]:
    months = monthly_periods(*YEAR, history_days=DORMANT_DAYS)
    march = [Period.of(*MARCH, DORMANT_DAYS)]
    monthly = _on_both(COMMERCE, kpis.usage_by_period, months)
    by_segment = _on_both(COMMERCE, kpis.usage_by_period, march, by="segment")
    combos = _on_activity(COMMERCE, combinations.feature_combinations, *MARCH)
    analysis = _on_activity(COMMERCE, dormancy.dormant_analysis, *MARCH, DORMANT_DAYS)
    dormant = _on_activity(COMMERCE, dormancy.dormant_trend, *MARCH, DORMANT_DAYS)
    overview = _on_both(EVENTS, trends.overview_trend, *EVENT_WEEKS, "day")
    by_week = _on_both(COMMERCE, trends.overview_trend, *MIDWEEK, "week")
    metrics = trends.overview_columns(FEATURES)

    queries: dict[str, Query] = {
        "activity_fact": lambda spark, root: COMMERCE.fact(parquet_reader(spark, root)),
        "activity_fact_events": lambda spark, root: EVENTS.fact(parquet_reader(spark, root)),
        "comprehensive_metrics": _on_both(COMMERCE, engagement.comprehensive_metrics, *MARCH),
        "comprehensive_metrics_year": _on_both(COMMERCE, engagement.comprehensive_metrics, *LAUNCH),
        "comprehensive_metrics_events": _on_both(
            EVENTS, engagement.comprehensive_metrics, *EVENT_WEEKS
        ),
        "feature_combinations": combos,
        "feature_combinations_events": _on_activity(
            EVENTS, combinations.feature_combinations, *EVENT_WEEKS
        ),
        "combination_highlights": _then(combos, combinations.combination_highlights),
        "retention_overall": _on_both(COMMERCE, retention.retention, *SPRING),
        "retention_events": _on_both(EVENTS, retention.retention, *EVENT_START),
        "feature_metrics_all": _on_both(COMMERCE, engagement.metrics_by_feature, *SPRING),
        "retention_by_feature": _on_both(EVENTS, retention.retention_by_feature, *EVENT_START),
        "feature_insights": _then(
            _on_both(EVENTS, retention.retention_by_feature, *EVENT_START), kpis.feature_insights
        ),
        "churn_count": _on_activity(COMMERCE, engagement.churn_count, *MARCH),
        "churn_count_first_seen": _with_first_seen(_churn_since),
        "absolute_metrics_first_seen": _with_first_seen(_absolute_since),
        "absolute_metrics": _on_both(COMMERCE, engagement.absolute_metrics, MARCH[1]),
        "comprehensive_metrics_first_seen": _since(engagement.comprehensive_metrics, MARCH[0], *MARCH),
        "overview_trend_week_first_seen": _since(
            trends.overview_trend, "1998-02-16", *MIDWEEK, "week", fill="zero"
        ),
        "kpi_monthly_first_seen": _then(
            _since(kpis.usage_by_period, str(months[0].history_start), months), kpis.kpi_long
        ),
        "insights_by_segment": _on_both(COMMERCE, kpis.insights, months, by="segment"),
        "trend_dau_sql": _daily_users_sql,
        "trend_series": _on_activity(EVENTS, trends.active_user_series, *EVENT_WEEKS),
        "overview_trend_day": overview,
        "overview_trend_week": by_week,
        "overview_trend_month": _on_both(COMMERCE, trends.overview_trend, *YEAR, "month"),
        "overview_trend_week_zero": _on_both(
            COMMERCE, trends.overview_trend, *MIDWEEK, "week", fill="zero"
        ),
        "overview_trend_melted": _then(
            overview, trends.melt_trend, ["signups", "active_users"], "day", labels=LABELS
        ),
        "overview_trend_smoothed": _then(overview, trends.melt_trend, metrics, "day", smooth=True),
        "overview_trend_smoothed_week": _then(
            by_week, trends.melt_trend, metrics, "week", smooth=True
        ),
        "dormant_analysis": analysis,
        "dormant_breakdown": _then(analysis, dormancy.dormant_breakdown),
        "dormant_trend": dormant,
        "dormant_trend_change": _then(dormant, dormancy.dormant_trend_change),
        "kpi_monthly": _then(monthly, kpis.kpi_long),
        "kpi_by_segment": _then(by_segment, kpis.kpi_long, by="segment"),
        "feature_ranking": _then(monthly, kpis.feature_ranking),
        "kpi_alerts": _then(monthly, kpis.kpi_alerts),
        "kpi_alerts_by_segment": _then(by_segment, kpis.kpi_alerts, by="segment"),
        "retention_monthly": _on_both(COMMERCE, kpis.retention_by_period, months),
        "insights": _on_both(COMMERCE, kpis.insights, months),
        "recommendations": _then(monthly, kpis.recommendations),
        "survey_completion": _on_table(
            profiles.conversation_submissions, survey.survey_completion, *EVENT_WEEKS
        ),
        "survey_odd_documents": _on_table(
            profiles.odd_submissions, survey.answer_counts, *EVENT_WEEKS
        ),
        "activity_fact_gaps": lambda spark, root: GAPS.fact(parquet_reader(spark, root)),
        "comprehensive_metrics_gaps": _on_both(GAPS, engagement.comprehensive_metrics, *LAUNCH),
        "comprehensive_metrics_five": _on_both(
            FIVE, engagement.comprehensive_metrics, *LAUNCH, features=profiles.FIVE_FEATURES
        ),
        "feature_combinations_five": _on_activity(
            FIVE, combinations.feature_combinations, *LAUNCH, features=profiles.FIVE_FEATURES
        ),
        "activity_fact_reserved": _reserved_fact,
        "survey_daily": _on_table(
            profiles.conversation_submissions, survey.daily_submissions, *EVENT_WEEKS
        ),
        "reaction_counts": _on_table(profiles.event_feedback, survey.reaction_counts, *EVENT_WEEKS),
        "feedback_list": _on_table(profiles.event_feedback, survey.feedback_list, *EVENT_WEEKS),
    }
    for feature in FEATURES:
        queries[f"feature_metrics_{feature}"] = _on_both(
            COMMERCE, engagement.feature_metrics, *SPRING, feature=feature
        )
        queries[f"retention_{feature}"] = _on_both(
            COMMERCE, retention.retention, *SPRING, feature=feature
        )
        queries[f"trend_dau_events_{feature}"] = _on_activity(
            EVENTS, trends.active_user_trend, *EVENT_WEEKS, "day", feature=feature
        )
    for granularity, (_, name) in trends.SERIES_COLUMNS.items():
        queries[f"trend_{name}"] = _on_activity(
            COMMERCE, trends.active_user_trend, *YEAR, granularity
        )
        queries[f"trend_{name}_spending"] = _on_activity(
            COMMERCE, trends.active_user_trend, *YEAR, granularity, feature="spending"
        )
    return queries
