"""Edge rows of the fact and the population rules, on hand-made tables."""

from datetime import date

import pytest

from usagepulse.functions.calendar import Period, monthly_periods, spine
from usagepulse.operators import (
    combinations,
    dormancy,
    engagement,
    kpis,
    retention,
    trends,
)
from usagepulse.plans.profiles import CONSUMER_FINANCE_USERS, consumer_finance_sources
from usagepulse.sources.registry import (
    FEATURES,
    FeatureSource,
    build_activity,
    build_events,
    build_users,
    of_feature,
)

START, END = "2024-03-01", "2024-03-31"


def rows(df):
    return [tuple(r) for r in df.collect()]


def only(df):
    found = df.collect()
    assert len(found) == 1
    return found[0].asDict()


@pytest.fixture
def finance(spark):
    """Tables of a consumer-finance product with every awkward kind of row."""
    ts = "to_timestamp(at) AS"
    budgets = spark.createDataFrame(
        [(1, "2024-03-05 08:00:00"), (1, "2024-03-05 21:00:00"), (2, "2024-03-06 00:00:00")],
        "user_id int, at string",
    ).selectExpr("user_id", f"{ts} created_at")
    manual = spark.createDataFrame(
        [("1", "2024-03-05 10:00:00"), ("3", "2024-03-07 23:59:59")], "user_id string, at string"
    ).selectExpr("user_id", f"{ts} created_at")
    transactions = spark.createDataFrame(
        [
            (10, None, "2024-03-08 01:00:00", "success", "bank"),
            (10, None, "2024-03-09 01:00:00", "success", None),
            (10, None, "2024-03-10 01:00:00", "success", "internal"),
            (10, None, "2024-03-11 01:00:00", "failed", "bank"),
            (10, 20, "2024-03-12 01:00:00", "success", "bank"),
            (None, 20, "2024-03-13 01:00:00", "success", "bank"),
            (None, 99, "2024-03-14 01:00:00", "success", "bank"),
            (None, None, "2024-03-15 01:00:00", "success", "bank"),
        ],
        "investment_plan_id int, plan_id int, at string, status string, provider_number string",
    ).selectExpr("*", f"{ts} updated_at")
    tables = {
        "budgets": budgets,
        "manual_and_external_transactions": manual,
        "transactions": transactions,
        "investment_plans": spark.createDataFrame([(10, 4)], "id int, user_id int"),
        "plans": spark.createDataFrame([(20, "5")], "id int, user_id string"),
        "slack_message_dump": spark.createDataFrame(
            [("6", "2024-03-16 12:00:00"), (None, "2024-03-17 12:00:00")], "user string, at string"
        ).selectExpr("user", f"{ts} created_at"),
        "users": spark.createDataFrame(
            [(1, "2024-03-01 05:00:00", False), (2, "2024-02-01 05:00:00", True), (3, "2024-03-02 00:00:00", None)],
            "id int, at string, restricted boolean",
        ).selectExpr("id", f"{ts} created_at", "restricted"),
    }
    return tables.__getitem__


FACT = [
    (None, date(2024, 3, 17), "assistant"),
    ("1", date(2024, 3, 5), "spending"),
    ("2", date(2024, 3, 6), "spending"),
    ("3", date(2024, 3, 7), "spending"),
    ("4", date(2024, 3, 8), "investment"),
    ("4", date(2024, 3, 12), "investment"),
    ("5", date(2024, 3, 12), "savings"),
    ("5", date(2024, 3, 13), "savings"),
    ("6", date(2024, 3, 16), "assistant"),
]


def test_fact_from_product_tables(finance):
    fact = build_activity(finance, consumer_finance_sources("internal"))
    assert sorted(rows(fact), key=repr) == sorted(FACT, key=repr)
    events = build_events(finance, consumer_finance_sources("internal"))
    assert events.count() > len(FACT)
    assert set(rows(events)) == set(FACT)


def test_one_feature_reads_only_its_tables(finance):
    asked = []

    def read(name):
        asked.append(name)
        return finance(name)

    savings = build_events(read, consumer_finance_sources("internal"), "savings")
    assert {r[2] for r in rows(savings)} == {"savings"}
    assert sorted(asked) == ["plans", "transactions"]
    with pytest.raises(ValueError):
        build_events(read, consumer_finance_sources("internal"), "loans")


def test_row_meeting_several_features_counts_for_each(spark):
    table = spark.createDataFrame([("a", 3)], "who string, n int").selectExpr(
        "who", "n", "timestamp'2024-03-01 10:00:00' AS at"
    )
    sources = [
        FeatureSource("spending", "t", "who", "at", "n > 1"),
        FeatureSource("savings", "t", "who", "at", "n > 2"),
        FeatureSource("investment", "t", "who", "at", "n > 3"),
        FeatureSource("spending", "t", "who", "at", "n < 0"),
    ]
    fact = build_activity({"t": table}.__getitem__, sources)
    assert sorted(r[2] for r in rows(fact)) == ["savings", "spending"]


def test_sources_reject_bad_declarations(finance):
    with pytest.raises(ValueError):
        FeatureSource("lo'ans", "t", "u", "ts")
    with pytest.raises(ValueError, match="lacks columns"):
        build_events(finance, [FeatureSource("spending", "budgets", "user_id", "missing")])


def test_populations(finance):
    """Restricted, unknown and unregistered users count for use, not as active."""
    activity = build_events(finance, consumer_finance_sources("internal"))
    users = build_users(finance, CONSUMER_FINANCE_USERS)
    row = only(engagement.comprehensive_metrics(activity, users, START, END))
    assert row["total_signups"] == 1
    assert row["total_active_users"] == row["one_time_usage_users"] == row["first_time_users"] == 1
    assert row["recurring_users"] == 0
    # Nine distinct rows: eight (user, day) pairs, and a day with the nameless user only.
    assert row["avg_dau"] == 8 / 8
    assert (row["spending_users"], row["assistant_users"]) == (3, 1)
    # Grouping by user gives the nameless user a group of its own.
    assert row["single_feature_users"] == 7
    assert row["only_assistant_users"] == 2


def test_empty_period(activity_of, users_of):
    activity = activity_of([("a", "2024-03-05", "spending")])
    users = users_of([("a", "2024-03-05", False)])
    row = only(engagement.comprehensive_metrics(activity, users, "2020-01-01", "2020-01-31"))
    assert row.pop("avg_dau") is None and row.pop("avg_wau") is None and row.pop("avg_mau") is None
    assert set(row.values()) == {0}
    metrics = only(engagement.feature_metrics(activity, users, "2020-01-01", "2020-01-31", "spending"))
    assert metrics["avg_dau"] is None and metrics["stickiness"] == 0.0
    kept = only(retention.retention(activity, users, "2020-01-01", "2020-01-31"))
    assert kept["total_signups"] == 0 and kept["day1_retention"] is None and kept["day1_percent"] == 0.0
    combos = combinations.feature_combinations(activity, START, END)
    assert rows(combos) == rows(combinations.combination_highlights(combos)) == []
    trend = dormancy.dormant_trend(activity, "2020-01-01", "2020-01-31", 7)
    assert rows(trend) == rows(dormancy.dormant_trend_change(trend)) == []


def test_nameless_user_in_churn_and_dormancy(activity_of):
    activity = activity_of(
        [(None, "2024-02-20", "spending"), (None, "2024-03-02", "spending"), ("a", "2024-02-20", "savings")]
    )
    assert only(engagement.churn_count(activity, START, END)) == {"churn_count": 2}
    row = only(dormancy.dormant_analysis(activity, START, END, 30))
    assert row["overall_dormant_users"] == 2
    assert row["spending_dormant_users"] == 1
    assert (row["total_historical_users"], row["total_current_users"]) == (2, 1)
    # The trend counts distinct users, so the nameless one only makes the date exist.
    assert rows(dormancy.dormant_trend(activity, START, END, 30)) == [(date(2024, 3, 2), 1)]


def test_dormancy_window_ends(activity_of):
    activity = activity_of(
        [
            ("opening", "2024-03-01", "spending"),
            ("oldest", "2024-01-31", "spending"),
            ("too_old", "2024-01-30", "spending"),
            ("switched", "2024-02-10", "savings"),
            ("switched", "2024-03-10", "spending"),
        ]
    )
    row = only(dormancy.dormant_analysis(activity, START, END, 30))
    assert row["total_historical_users"] == 3
    assert row["total_current_users"] == 2
    assert row["overall_dormant_users"] == 1
    assert row["savings_dormant_users"] == 1
    trend = rows(dormancy.dormant_trend(activity, START, END, 30))
    assert trend == [(date(2024, 3, 1), 2), (date(2024, 3, 10), 2)]


def test_no_trend_row_when_everyone_came(activity_of):
    activity = activity_of([("a", "2024-02-20", "spending"), ("a", "2024-03-02", "spending")])
    assert rows(dormancy.dormant_trend(activity, START, END, 30)) == []


def test_first_time_means_two_things(activity_of, users_of):
    activity = activity_of(
        [
            ("before", "2024-02-01", "spending"), ("before", "2024-03-10", "spending"),
            ("early", "2024-03-02", "spending"), ("early", "2024-03-20", "spending"),
        ]
    )
    users = users_of([("before", "2024-03-05", False), ("early", "2024-03-10", False)])
    overall = only(engagement.comprehensive_metrics(activity, users, START, END))
    assert overall["first_time_users"] == 1
    single = only(engagement.feature_metrics(activity, users, START, END, "spending"))
    assert single["first_time_users"] == 1
    assert single["recurring_users"] == 1


def test_retention_horizons(activity_of, users_of):
    signups = [(f"u{n}", "2024-03-01", False) for n in (0, 1, 2, 7, 8, 30, 31)]
    activity = activity_of(
        [(f"u{n}", str(date(2024, 3, 1 + n) if n < 31 else date(2024, 4, 1)), "spending") for n in (0, 1, 2, 7, 8, 30, 31)]
    )
    row = only(retention.retention(activity, users_of(signups), "2024-03-01", "2024-04-30"))
    assert row["total_signups"] == 7
    assert row["day1_retention"] == 1 / 7
    assert row["week1_retention"] == 3 / 7
    assert row["month1_retention"] == 5 / 7
    # Censored: nothing is seen after the end of the period.
    row = only(retention.retention(activity, users_of(signups), "2024-03-01", "2024-03-05"))
    assert row["month1_retention"] == 2 / 7


def test_combination_ties_and_bands(activity_of):
    pairs = {"savings": 3, "investment": 3, "assistant": 1}
    activity = activity_of(
        (f"{f}{n}", "2024-03-04", g) for f, size in pairs.items() for n in range(size) for g in ("spending", f)
    )
    found = rows(combinations.feature_combinations(activity, START, END))
    assert sorted(found) == [
        ("assistant + spending", 1, 14.29, ""),
        ("investment + spending", 3, 42.86, "top"),
        ("savings + spending", 3, 42.86, "high"),
    ]
    single = combinations.feature_combinations(activity.filter("user_id LIKE 'sav%'"), START, END)
    assert only(combinations.combination_highlights(single))["top2_percentage"] is None


def test_spine_starts_on_a_period(spark):
    weeks = [r[0] for r in spine(spark, "2024-02-14", "2024-03-05", "week").collect()]
    assert weeks == [date(2024, 2, 12), date(2024, 2, 19), date(2024, 2, 26), date(2024, 3, 4)]
    months = [r[0] for r in spine(spark, "2024-01-31", "2024-03-30", "month").collect()]
    assert months == [date(2024, 1, 1), date(2024, 2, 1), date(2024, 3, 1)]
    with pytest.raises(ValueError):
        spine(spark, "2024-01-01", "2024-01-02", "quarter")


def test_running_totals_through_quiet_periods(activity_of, users_of):
    activity = activity_of(
        [("a", "2024-01-01", "spending"), ("b", "2024-03-02", "savings"), (None, "2024-03-03", "savings")]
    )
    users = users_of([("a", "2024-01-01", False), ("b", "2024-03-02", False), ("c", "2024-03-02", True)])

    def totals(fill):
        trend = trends.overview_trend(activity, users, "2024-03-01", "2024-03-04", "day", fill)
        return [(r["absolute_signups"], r["absolute_active_users"]) for r in trend.collect()]

    assert totals("carry") == [(1, 1), (2, 2), (2, 2), (2, 2)]
    assert totals("zero") == [(0, 0), (2, 2), (0, 2), (0, 0)]
    with pytest.raises(ValueError):
        totals("linear")


def test_monthly_series_is_not_smoothed(activity_of, users_of):
    activity = activity_of([("a", "2024-01-05", "spending"), ("b", "2024-02-05", "spending"), ("a", "2024-02-06", "spending")])
    trend = trends.overview_trend(activity, users_of([]), "2024-01-01", "2024-02-29", "month")
    smooth = trends.melt_trend(trend, ["active_users"], "month", smooth=True)
    assert sorted(r["count"] for r in smooth.collect()) == [1.0, 2.0]
    with pytest.raises(ValueError):
        trends.melt_trend(trend, ["nothing"], "month")


def test_ranking_ties_follow_declared_order(activity_of, users_of):
    activity = activity_of(
        [("a", "2024-03-04", f) for f in ("assistant", "investment", "savings", "spending")]
    )
    usage = kpis.usage_by_period(activity, users_of([("a", "2024-03-01", False)]), [Period.of(START, END)])
    row = only(kpis.feature_ranking(usage))
    assert (row["most_used_feature"], row["least_used_feature"]) == ("Spending", "Spending")


def test_quiet_month_still_has_kpis_and_good_news(activity_of, users_of):
    activity = activity_of([("a", "2024-03-04", "spending")])
    months = monthly_periods("2020-01-01", "2020-01-31")
    usage = kpis.usage_by_period(activity, users_of([]), months)
    alerts = {r["metric"]: r for r in kpis.kpi_alerts(usage).collect()}
    assert alerts["conversion_rate"]["alert"] == "high"
    assert "most_used_share" not in alerts
    assert [r["rule_id"] for r in kpis.recommendations(usage).collect()] == ["good_retention"]
    advice = kpis.insights(activity, users_of([]), months).collect()
    assert [(r["rule_id"], r["insight"]) for r in advice] == [
        ("low_day1_retention", "Only 0.0% of users return the next day.")
    ]


def test_one_period_equals_single_reports(activity_of, users_of):
    activity = activity_of(
        [("a", "2024-02-20", "spending"), ("a", "2024-03-04", "savings"), ("b", "2024-03-04", "savings"),
         ("c", "2024-02-25", "assistant"), (None, "2024-03-09", "spending"), ("d", "2024-03-31", "investment")]
    )
    users = users_of([("a", "2024-02-01", False), ("b", "2024-03-03", False), ("d", "2024-03-30", True)])
    expected = only(engagement.comprehensive_metrics(activity, users, START, END))
    expected |= only(dormancy.dormant_analysis(activity, START, END, 30))
    usage = only(kpis.usage_by_period(activity, users, [Period.of(START, END, 30)]))
    assert {k: usage[k] for k in expected} == expected


def test_overlapping_periods(activity_of, users_of):
    activity = activity_of([("a", "2024-03-04", "spending"), ("b", "2024-03-20", "savings")])
    periods = [Period.of(START, END, 5), Period.of("2024-03-15", "2024-04-15", 20)]
    usage = kpis.usage_by_period(activity, users_of([]), periods)
    found = sorted((r["period_start"], r["total_current_users"], r["total_historical_users"]) for r in usage.collect())
    assert found == [(date(2024, 3, 1), 2, 0), (date(2024, 3, 15), 1, 1)]


def test_many_daily_periods_equal_single_reports(activity_of, users_of):
    activity = activity_of(
        [(u, f"2024-03-{d:02d}", f) for u, d, f in [("a", 1, "spending"), ("a", 9, "savings"), ("b", 9, "spending"), ("c", 30, "assistant")]]
    )
    users = users_of([("a", "2024-03-01", False), ("c", "2024-03-09", False)])
    periods = [Period.of(f"2024-03-{d:02d}", f"2024-03-{d:02d}", 4) for d in range(1, 32)]
    usage = {r["period_start"].day: r.asDict() for r in kpis.usage_by_period(activity, users, periods).collect()}
    assert len(usage) == 31
    for d in (1, 5, 9, 10, 30):
        expected = only(dormancy.dormant_analysis(activity, periods[d - 1].start, periods[d - 1].end, 4))
        expected |= only(engagement.comprehensive_metrics(activity, users, periods[d - 1].start, periods[d - 1].end))
        assert {k: usage[d][k] for k in expected} == expected


def test_features_beyond_the_declared_ones(activity_of, users_of):
    """Five features, one of them unknown to labels and rules."""
    features = (*FEATURES, "gift_cards")
    activity = activity_of(
        [("a", "2024-03-04", "gift_cards"), ("b", "2024-03-04", "spending"), ("c", "2024-02-20", "gift_cards")]
    )
    users = users_of([("a", "2024-03-01", False), ("b", "2024-03-01", False)])
    usage = kpis.usage_by_period(activity, users, [Period.of(START, END, 30)], features=features)
    assert only(kpis.feature_ranking(usage, features=features))["most_used_feature"] in {"Spending", "Gift Cards"}
    alerts = {r["metric"]: r for r in kpis.kpi_alerts(usage, features=features).collect()}
    assert alerts["gift_cards_dormant_share"]["alert"] is None
    assert alerts["gift_cards_dormant_share"]["value"] == 100.0
    assert any("Gift Cards" in r["title"] + r["insight"] + r["recommendation"] for r in kpis.recommendations(usage, features=features).collect())
    rows = dormancy.dormant_breakdown(dormancy.dormant_analysis(activity, START, END, 30, features), features)
    assert "Gift Cards" in {r["feature"] for r in rows.collect()}


def test_nameless_user_gives_dormant_trend_rows_of_zero(activity_of):
    days = [(None, "2024-02-20"), ("a", "2024-03-01"), ("a", "2024-03-05")]
    rows = [(u, d, "spending") for u, d in days]
    found = dormancy.dormant_trend(activity_of(rows), START, END, 30).collect()
    assert [tuple(r) for r in found] == [(date(2024, 3, 1), 0), (date(2024, 3, 5), 0)]
    assert dormancy.dormant_trend(activity_of(rows[1:]), START, END, 30).collect() == []


def test_unknown_feature_is_an_error(activity_of):
    with pytest.raises(ValueError):
        of_feature(activity_of([]), "loans")
    with pytest.raises(ValueError):
        Period.of("2024-02-01", "2024-01-01")
