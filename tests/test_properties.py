"""Random activity against brute force over Python sets."""

import random
from collections import defaultdict
from datetime import date, timedelta

import pytest

from usagepulse.functions.calendar import Period
from usagepulse.operators import combinations, dormancy, engagement, kpis, retention, trends
from usagepulse.sources.registry import FEATURES

START, END, HISTORY = date(2024, 1, 31), date(2024, 4, 10), 25
LAST = date(2024, 4, 20)


def monday(d):
    return d - timedelta(days=d.weekday())


class World:
    """Random facts, with repeats, restricted, unregistered and nameless users."""

    def __init__(self, seed):
        rng = random.Random(seed)
        first = date(2023, 12, 20)
        span = (LAST - first).days
        names = [f"u{i}" for i in range(14)] + [None]
        self.facts = {
            (rng.choice(names), first + timedelta(days=rng.randrange(span)), rng.choice(FEATURES))
            for _ in range(rng.choice([5, 60, 200]))
        }
        # One user holds a large share of the rows, as repeats of the same facts.
        hot = ("u0", START + timedelta(days=3), "spending")
        self.facts.add(hot)
        self.rows = list(self.facts) + [hot] * 100
        rng.shuffle(self.rows)
        self.users = {
            n: (first + timedelta(days=rng.randrange(span)), rng.choice([False, False, True, None]))
            for n in names[:11]
        }

    def frames(self, activity_of, users_of):
        activity = activity_of((u, str(d), f) for u, d, f in self.rows)
        users = users_of((u, str(d), r) for u, (d, r) in self.users.items())
        return activity, users

    def open_users(self):
        return {u: d for u, (d, r) in self.users.items() if r is False}


@pytest.fixture(params=range(4))
def world(request):
    return World(request.param)


def one(df):
    (row,) = df.collect()
    return row.asDict()


def mean(counts):
    return sum(counts) / len(counts) if counts else None


def average_users(facts, unit):
    seen = defaultdict(set)
    for u, d, _ in facts:
        seen[unit(d)].add(u)
    return mean([len(users - {None}) for users in seen.values()])


def test_comprehensive_metrics(world, activity_of, users_of):
    activity, users = world.frames(activity_of, users_of)
    row = one(engagement.comprehensive_metrics(activity, users, START, END))
    recent = [f for f in world.facts if START <= f[1] <= END]
    days, kinds = defaultdict(set), defaultdict(set)
    for u, d, f in recent:
        days[u].add(d)
        kinds[u].add(f)
    first = {u: min(d for v, d, _ in world.facts if v == u) for u, _, _ in world.facts}
    members = [u for u in days if u in world.open_users()]
    expected = {
        "total_signups": sum(START <= d <= END for d in world.open_users().values()),
        "total_active_users": len(members),
        "one_time_usage_users": sum(len(days[u]) == 1 for u in members),
        "recurring_users": sum(len(days[u]) > 1 for u in members),
        "first_time_users": sum(START <= first[u] <= END for u in members),
        "avg_dau": average_users(recent, lambda d: d),
        "avg_wau": average_users(recent, monday),
        "avg_mau": average_users(recent, lambda d: (d.year, d.month)),
        "single_feature_users": sum(len(k) == 1 for k in kinds.values()),
        "multiple_feature_users": sum(len(k) > 1 for k in kinds.values()),
    }
    for f in FEATURES:
        expected[f"{f}_users"] = len({u for u, _, g in recent if g == f} - {None})
        expected[f"only_{f}_users"] = sum(k == {f} for k in kinds.values())
    assert row == pytest.approx(expected)
    assert row["single_feature_users"] + row["multiple_feature_users"] == len(kinds)
    assert row["one_time_usage_users"] + row["recurring_users"] == row["total_active_users"]

    usage = one(kpis.usage_by_period(activity, users, [Period.of(START, END)]))
    assert {k: usage[k] for k in expected} == row


def test_churn_and_absolute(world, activity_of, users_of):
    activity, users = world.frames(activity_of, users_of)
    ever = {u for u, d, _ in world.facts if d <= END}
    recent = {u for u, d, _ in world.facts if START <= d <= END} - {None}
    assert one(engagement.churn_count(activity, START, END)) == {"churn_count": len(ever - recent)}
    assert one(engagement.absolute_metrics(activity, users, END)) == {
        "absolute_total_signups": sum(d <= END for d in world.open_users().values()),
        "absolute_total_active_users": len(ever - {None}),
    }


def test_retention(world, activity_of, users_of):
    activity, users = world.frames(activity_of, users_of)
    cohort = {u: d for u, d in world.open_users().items() if START <= d <= END}
    seen = defaultdict(set)
    for u, d, _ in world.facts:
        if START <= d <= END:
            seen[u].add(d)
    row = one(retention.retention(activity, users, START, END))
    shares = []
    for name, days in retention.HORIZONS.items():
        kept = sum(any(1 <= (d - s).days <= days for d in seen[u]) for u, s in cohort.items())
        expected = kept / len(cohort) if cohort else None
        assert row[f"{name}_retention"] == expected
        shares.append(kept)
    assert shares == sorted(shares)
    by_period = kpis.retention_by_period(activity, users, [Period.of(START, END)]).collect()
    assert len(by_period) == (1 if cohort else 0)
    for found in by_period:
        assert found["week1_percent"] == row["week1_percent"]


def test_dormancy(world, activity_of):
    activity = activity_of((u, str(d), f) for u, d, f in world.rows)
    opening = START - timedelta(days=HISTORY)
    past = {(u, f) for u, d, f in world.facts if opening <= d <= START}
    now = {(u, f) for u, d, f in world.facts if START <= d <= END}
    row = one(dormancy.dormant_analysis(activity, START, END, HISTORY))
    historical, current = {u for u, _ in past}, {u for u, _ in now}
    assert row["overall_dormant_users"] == len(historical - (current - {None}))
    assert (row["total_historical_users"], row["total_current_users"]) == (len(historical), len(current))
    for f in FEATURES:
        gone = {u for u, g in past if g == f} - ({u for u, g in now if g == f} - {None})
        assert row[f"{f}_dormant_users"] == len(gone)

    expected = {}
    for day in {d for _, d, _ in world.facts if START <= d <= END}:
        away = historical - {None} - {u for u, d, _ in world.facts if d == day}
        if away:
            expected[day] = len(away)
    trend = dormancy.dormant_trend(activity, START, END, HISTORY)
    assert {r[0]: r[1] for r in trend.collect()} == expected


@pytest.mark.parametrize("granularity", ["day", "week", "month"])
def test_overview_trend(world, activity_of, users_of, granularity):
    activity, users = world.frames(activity_of, users_of)
    unit = {"day": lambda d: d, "week": monday, "month": lambda d: d.replace(day=1)}[granularity]
    shown = trends.overview_trend(activity, users, START, END, granularity).collect()
    assert [r["activity_date"] for r in shown] == sorted(
        {unit(START + timedelta(days=n)) for n in range((END - START).days + 1)}
    )
    signups = world.open_users().values()
    past = [f for f in world.facts if f[1] <= END]
    for r in shown:
        dt = r["activity_date"]
        recent = [f for f in past if f[1] >= START and unit(f[1]) == dt]
        assert r["signups"] == sum(START <= d <= END and unit(d) == dt for d in signups)
        assert r["active_users"] == len({u for u, _, _ in recent} - {None})
        assert r["savings_users"] == len({u for u, _, f in recent if f == "savings"} - {None})
        assert r["absolute_signups"] == sum(d <= END and unit(d) <= dt for d in signups)
        assert r["absolute_active_users"] == len({u for u, d, _ in past if unit(d) <= dt} - {None})
    series = trends.active_user_trend(activity, START, END, granularity).collect()
    assert {r[0]: r[1] for r in series if r[1]} == {
        r["activity_date"]: r["active_users"] for r in shown if r["active_users"]
    }


def test_combinations(world, activity_of):
    activity = activity_of((u, str(d), f) for u, d, f in world.rows)
    kinds = defaultdict(set)
    for u, d, f in world.facts:
        if START <= d <= END:
            kinds[u].add(f)
    expected = defaultdict(int)
    for k in kinds.values():
        if len(k) > 1:
            expected[" + ".join(sorted(k))] += 1
    found = combinations.feature_combinations(activity, START, END).collect()
    assert {r["feature_combination"]: r["user_count"] for r in found} == dict(expected)
    if found:
        assert sum(r["percentage"] for r in found) == pytest.approx(100, abs=0.01 * len(found))


def test_distinct_activity_changes_nothing(world, activity_of, users_of):
    activity, users = world.frames(activity_of, users_of)
    for op in (engagement.comprehensive_metrics, trends.overview_trend, retention.retention):
        assert op(activity, users, START, END).collect() == op(activity.distinct(), users, START, END).collect()


def test_tables_over_features_equal_single_reports(world, activity_of, users_of):
    activity, users = world.frames(activity_of, users_of)
    metrics = engagement.metrics_by_feature(activity, users, START, END).collect()
    kept = retention.retention_by_feature(activity, users, START, END).collect()
    assert {r["feature"] for r in metrics} == {r["feature"] for r in kept} == set(FEATURES)
    feature = FEATURES[len(world.facts) % len(FEATURES)]
    for table, op in ((metrics, engagement.feature_metrics), (kept, retention.retention)):
        (row,) = (r.asDict() for r in table if r["feature"] == feature)
        row.pop("feature")
        assert one(op(activity, users, START, END, feature)) == row


def test_series_equals_the_three_trends(world, activity_of):
    activity = activity_of((u, str(d), f) for u, d, f in world.rows)
    series = trends.active_user_series(activity, START, END).collect()
    for granularity in trends.SERIES_COLUMNS:
        trend = trends.active_user_trend(activity, START, END, granularity).collect()
        picked = sorted((r["period_start"], r["users"]) for r in series if r["granularity"] == granularity)
        assert picked == [tuple(r) for r in trend]
