"""The shape of the plans: what is scanned, shuffled and joined, and how."""

import re
from collections import Counter
from datetime import date

import pytest

from conftest import TESTDATA
from usagepulse.functions.calendar import Period
from usagepulse.operators import engagement, kpis, trends
from usagepulse.operators.combinations import combination_highlights, feature_combinations
from usagepulse.plans.queries import all_queries
from usagepulse.sources.registry import DimensionJoin, FeatureSource, build_events
from usagepulse.sources.tables import read_activity, save_by_user, write_activity

ROOT = f"{TESTDATA}/sf0.001"
QUERIES = all_queries()


@pytest.fixture
def no_broadcast(spark):
    """Plans as they are when no side is small."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.maxMetadataStringLength": "2000",
    }
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.set(key, value)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def records_shuffled(df):
    """Records written by each shuffle of an executed frame."""
    found = []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        if name == "ShuffleExchangeExec":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_python_in_any_plan(no_broadcast, name):
    plan = plan_of(QUERIES[name](no_broadcast, ROOT))
    for operator in ("NestedLoop", "Cartesian", "Python", "Pandas", "ArrowEval"):
        assert operator not in plan


def test_nothing_is_broadcast_by_hint(no_broadcast):
    for name, query in QUERIES.items():
        assert "BroadcastExchange" not in plan_of(query(no_broadcast, ROOT)), name


def test_periods_are_placed_without_a_join(no_broadcast):
    """Activity meets no calendar: rows are placed in their periods where they are read,
    merged on the map side, and shuffled as one row per user and period."""
    plan = plan_of(QUERIES["kpi_monthly"](no_broadcast, ROOT))
    keys = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert not any("activity_date" in k or "signup_date" in k for k in keys)
    joins = re.findall(r"(?:SortMergeJoin|ShuffledHashJoin) \[(\w+?)#", plan)
    assert set(joins) == {"key", "user_id"}


def test_a_hot_key_is_split_where_repeats_are_not_merged(spark):
    """An order with most of the lines: adaptive execution splits its join partition."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        lines = spark.range(0, 200_000, 1, 16).selectExpr(
            "IF(id % 10 < 8, 0, id) AS order", "DATE'2024-03-01' + CAST(id % 50000 AS int) AS at"
        )
        orders = spark.range(0, 200_000, 1, 4).selectExpr("id", "CAST(id % 100 AS string) AS user")
        join = DimensionJoin("orders", "order", "id", merge_repeats=False)
        source = FeatureSource("spending", "lines", "user", "at", join=join)
        events = build_events({"lines": lines, "orders": orders}.__getitem__, [source])
        counted = events.groupBy("user_id").count()
        assert sum(r["count"] for r in counted.collect()) == 200_000
        assert "skew=true" in counted._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.mark.parametrize("merge_repeats", [False, True])
def test_a_declared_hot_key_is_dealt_over_join_keys(no_broadcast, merge_repeats):
    """Nearly all lines of one order: no join key holds more than a share of them."""
    lines = no_broadcast.range(0, 40_000, 1, 8).selectExpr(
        "IF(id % 10 < 8, 0, IF(id % 10 = 9, NULL, id)) AS order",
        "DATE'2024-03-01' + CAST(id % 500 AS int) AS at",
        "id % 3 = 0 AS salt",
    )
    orders = no_broadcast.range(0, 40_000, 1, 4).selectExpr("id", "CAST(id % 100 AS string) AS user")
    tables = {"lines": lines, "orders": orders}

    def events(**declared):
        join = DimensionJoin("orders", "order", "id", merge_repeats=merge_repeats, **declared)
        both = [
            FeatureSource("spending", "lines", "user", "at", join=join),
            FeatureSource("savings", "lines", "user", "at", "salt", join=join),
        ]
        return build_events(tables.__getitem__, both)

    salted = events(hot_keys=(0, 7), spread=16)
    by_row = ["user_id", "activity_date", "feature"]
    found, expected = (
        {tuple(r) for r in df.groupBy(*by_row).count().collect()} for df in (salted, events())
    )
    assert found == expected
    plan = plan_of(salted)
    assert re.search(r"Join \[key#\w+, salt#\w+\], \[key#\w+, salt#\w+\], Inner", plan)
    plain = plan_of(events())
    assert "salt#" not in plain.split("Inner")[0]


def test_combinations_are_never_gathered_in_one_task(no_broadcast):
    """Twenty features, all in use: many combinations, none numbered or sorted in one task."""
    names = [f"f{i:02d}" for i in range(20)]
    activity = no_broadcast.range(4000).selectExpr(
        "CAST(id AS string) AS user_id", "DATE'2024-03-01' AS activity_date",
        "explode(filter(transform(sequence(0, 19), i -> "
        "IF(shiftright(1 + id * 7919, i) % 2 = 1, format_string('f%02d', i), NULL)), "
        "f -> f IS NOT NULL)) AS feature",
    )
    combos = feature_combinations(activity, "2024-03-01", "2024-03-01", names)
    users = {}
    for user, _, feature in activity.collect():
        users.setdefault(user, []).append(feature)
    expected = Counter(" + ".join(sorted(f)) for f in users.values() if len(f) > 1)
    rows = combos.collect()
    assert {r["feature_combination"]: r["user_count"] for r in rows} == expected
    best = sorted(expected, key=lambda c: (-expected[c], c))
    assert [r["feature_combination"] for r in rows if r["band"] == "top"] == best[:1]
    row = combination_highlights(combos).first()
    assert (row["top_combination"], row["total_combinations"]) == (best[0], len(expected))
    share = {r["feature_combination"]: r["percentage"] for r in rows}
    assert row["top2_percentage"] == share[best[0]] + share[best[1]]
    for plan in (plan_of(combos), plan_of(combination_highlights(combos))):
        assert "Window" not in plan
        assert not re.search(r"Sort [^\n]*\n[^\n]*Exchange SinglePartition", plan)


def test_filters_and_columns_reach_the_scans(no_broadcast):
    plan = plan_of(QUERIES["trend_dau"](no_broadcast, ROOT))
    scans = re.findall(r"FileScan parquet \[(.*?)\].*?PushedFilters: \[(.*?)\]", plan)
    assert len(scans) == 3
    for columns, filters in scans:
        assert 3 <= len(columns.split(",")) <= 4
        assert "EqualTo" in filters
    dated = [f for c, f in scans if "date" in c]
    assert len(dated) == 2 and all("GreaterThanOrEqual" in f for f in dated)


def test_sources_of_one_table_share_a_scan(no_broadcast):
    plan = plan_of(QUERIES["churn_count"](no_broadcast, ROOT))
    # Three order sources in one scan, two line sources in one scan and one join.
    assert plan.count("FileScan") == 3
    assert plan.count("SortMergeJoin") == 1


def test_comprehensive_metrics_shuffles_activity_once(spark, activity_of, users_of):
    activity = activity_of([("a", "2024-03-04", "spending")])
    users = users_of([("a", "2024-03-04", False)])
    plan = plan_of(engagement.comprehensive_metrics(activity, users, "2024-03-01", "2024-03-31"))
    # Activity by user, users by user, and the one-row total.
    assert plan.count("Exchange hashpartitioning") == 2
    assert plan.count("Exchange SinglePartition") == 1
    assert "Expand" not in plan


def test_hot_user_is_combined_before_the_shuffle(spark):
    """A user with a third of all rows leaves each map task as a single row."""
    activity = spark.range(0, 300_000, 1, 8).selectExpr(
        "IF(id % 3 = 0, 'hot', CAST(id % 50 AS string)) AS user_id",
        "date_add(DATE'2024-03-01', CAST(id % 28 AS int)) AS activity_date",
        "IF(id % 2 = 0, 'spending', 'savings') AS feature",
    )
    users = spark.createDataFrame([("hot", False)], "user_id string, restricted boolean").selectExpr(
        "*", "DATE'2024-03-01' AS signup_date"
    )
    result = engagement.comprehensive_metrics(activity, users, "2024-03-01", "2024-03-31")
    assert result.collect()[0]["recurring_users"] == 1
    per_exchange = records_shuffled(result)
    # Eight map tasks hold at most 51 users each.
    assert per_exchange and max(per_exchange) <= 8 * 51


def test_hot_join_key_is_merged_before_the_join(no_broadcast):
    """A plan with most of the transactions reaches its join as one row per date."""
    spark = no_broadcast
    transactions = spark.range(0, 80_000, 1, 8).selectExpr(
        "IF(id % 4 = 0, id, 7) AS plan_id",
        "CAST(date_add(DATE'2024-03-01', CAST(id % 5 AS int)) AS timestamp) AS updated_at",
    )
    plans = spark.range(0, 80_000, 1, 4).selectExpr("id", "CAST(id AS string) AS user_id")
    tables = {"transactions": transactions, "plans": plans}

    def shuffled(merge_repeats):
        join = DimensionJoin("plans", "plan_id", "id", merge_repeats=merge_repeats)
        source = FeatureSource("savings", "transactions", "user_id", "updated_at", join=join)
        events = build_events(tables.__getitem__, [source])
        result = (events.distinct().count(), events.select("user_id").distinct().count())
        events.collect()
        return result, records_shuffled(events)

    merged, written = shuffled(True)
    plain, unmerged = shuffled(False)
    # One date for each cold plan, five for the hot one.
    assert merged == plain == (20_000 + 5, 20_000 + 1)
    # The fact's own rows: 20,000 cold ones, and five dates of the hot key per map task.
    assert 80_000 in unmerged
    assert max(w for w in written if w != 80_000) <= 20_000 + 8 * 5


def counts_in(plan, pattern):
    return len(re.findall(pattern, plan))


@pytest.mark.parametrize("name", ["insights", "kpi_monthly", "kpi_alerts", "recommendations"])
def test_periods_and_retention_come_from_one_row_per_user(no_broadcast, name):
    plan = plan_of(QUERIES[name](no_broadcast, ROOT))
    # Lines, orders as events and as owners, and the two tables of the users.
    assert plan.count("FileScan") == 5
    assert plan.count("lineitem.parquet") == 1
    assert plan.count("Exchange hashpartitioning") <= 7
    assert "Window" not in plan
    # Read from the bottom, users merge before their row unfolds into periods.
    assert plan.index("Generate explode(") < plan.index("keys=[user_id#")


MARCH = ("2024-03-01", "2024-03-31")


@pytest.fixture
def stored(spark, tmp_path):
    """Activity by date, and its first-seen state as of the end of February."""
    activity = spark.range(0, 20_000, 1, 4).selectExpr(
        "CAST(id % 500 AS string) AS user_id",
        "date_add(DATE'2024-01-01', CAST(id % 97 AS int)) AS activity_date",
        "IF(id % 3 = 0, 'spending', 'savings') AS feature",
    )
    write_activity(activity.distinct(), str(tmp_path / "activity"))
    users = spark.range(400).selectExpr(
        "CAST(id AS string) AS user_id", "date_add(DATE'2024-02-20', CAST(id % 40 AS int)) AS signup_date",
        "id % 7 = 0 AS restricted",
    )
    return read_activity(spark, str(tmp_path / "activity")), users


@pytest.mark.parametrize("granularity", ["day", "week", "month"])
def test_overview_shuffles_users_once(stored, granularity):
    plan = plan_of(trends.overview_trend(*stored, *MARCH, granularity))
    # By user, by period, and the running totals over the few periods.
    assert counts_in(plan, r"Exchange hashpartitioning\(user_id#") == 1
    assert counts_in(plan, r"Exchange hashpartitioning\(dt#") == plan.count("Exchange SinglePartition") == 1
    assert plan.count("Exchange hashpartitioning") == 2


def test_series_shuffles_users_once(stored):
    plan = plan_of(trends.active_user_series(stored[0], *MARCH))
    assert counts_in(plan, r"Exchange hashpartitioning\(user_id#") == 1
    assert plan.count("Exchange hashpartitioning") == 2


REPORTS = {
    "comprehensive": (lambda a, u, **k: engagement.comprehensive_metrics(a, u, *MARCH, **k), "2024-03-01"),
    "overview": (lambda a, u, **k: trends.overview_trend(a, u, *MARCH, "week", **k), "2024-02-26"),
    "usage": (lambda a, u, **k: kpis.usage_by_period(a, u, [Period.of(*MARCH, 10)], **k), "2024-02-20"),
    "insights": (lambda a, u, **k: kpis.insights(a, u, [Period.of(*MARCH)], **k), "2024-03-01"),
}


@pytest.mark.parametrize("name", REPORTS)
def test_a_first_seen_state_spares_earlier_dates(no_broadcast, stored, name):
    activity, users = stored
    report, opening = REPORTS[name]
    for known_until in (opening, "2024-04-01"):
        state = engagement.first_seen(activity.filter(f"activity_date < '{known_until}'"))
        state = state.sparkSession.createDataFrame(state.toPandas(), state.schema)
        result = report(activity, users, first=state)
        scans = re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters", plan_of(result))
        days = str((date.fromisoformat(opening) - date(1970, 1, 1)).days)
        assert scans and all(f">= {days})" in f or f">= {opening})" in f for f in scans)
        assert sorted(map(str, result.collect())) == sorted(map(str, report(activity, users).collect()))


@pytest.mark.parametrize("name", ["comprehensive", "usage", "insights"])
def test_tables_bucketed_by_user_meet_without_an_exchange(no_broadcast, stored, name):
    activity, users = stored
    report, opening = REPORTS[name]
    state = engagement.first_seen(activity.filter(f"activity_date < '{opening}'"))
    frames = {"activity": activity, "users": users, "state": state}
    tables = {n: f"bucketed_{name}_{n}" for n in frames}
    try:
        for n, frame in frames.items():
            save_by_user(frame, tables[n], 4)
        a, u, s = (no_broadcast.table(t) for t in tables.values())
        for result in (report(a, u), report(a, u, first=s)):
            assert "hashpartitioning(user_id" not in plan_of(result)
            assert sorted(map(str, result.collect())) == sorted(map(str, report(activity, users).collect()))
    finally:
        for t in tables.values():
            no_broadcast.sql(f"DROP TABLE IF EXISTS {t}")
