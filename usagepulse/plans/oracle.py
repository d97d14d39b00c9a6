"""Independent ANSI SQL for the registered queries.

Written straight from the definitions of the metrics, in shapes the operators do
not use (distinct counts, set differences, per-date comparisons), so the two agree
only if both are right.
"""

from __future__ import annotations

from usagepulse.plans.profiles import FIVE_FEATURES
from usagepulse.plans.queries import (
    DORMANT_DAYS,
    EVENT_START,
    EVENT_WEEKS,
    LAUNCH,
    MARCH,
    MIDWEEK,
    SPRING,
    YEAR,
)
from usagepulse.sources.registry import FEATURE_LABELS, FEATURES

COMMERCE = """
person AS (
    SELECT CAST(c_custkey AS VARCHAR) AS user_id,
           CAST(min(o_orderdate) AS DATE) AS signup_date,
           bool_or(c_acctbal < 0) AS restricted,
           any_value(c_mktsegment) AS segment
    FROM customer JOIN orders ON o_custkey = c_custkey
    GROUP BY c_custkey
),
usage AS (
    SELECT CAST(o_custkey AS VARCHAR) AS user_id, CAST(o_orderdate AS DATE) AS d, 'spending' AS feature
    FROM orders WHERE o_orderstatus IN ('O', 'P')
    UNION
    SELECT CAST(o_custkey AS VARCHAR), CAST(l_shipdate AS DATE),
           CASE l_returnflag WHEN 'A' THEN 'investment' ELSE 'savings' END
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey
    WHERE l_linestatus = 'F' AND l_returnflag IN ('A', 'N') AND o_orderpriority <> '4-NOT SPECIFIED'
    UNION
    SELECT CAST(o_custkey AS VARCHAR), CAST(o_orderdate AS DATE), 'assistant'
    FROM orders WHERE o_orderpriority = '1-URGENT'
)"""

# The same over tables with gaps.
GAPS = """
gap_orders AS (
    SELECT o_orderkey, o_orderdate,
           CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey END AS o_custkey,
           CASE WHEN o_orderkey % 7 <> 3 THEN o_orderstatus END AS o_orderstatus,
           CASE WHEN o_orderkey % 13 <> 5 THEN o_orderpriority END AS o_orderpriority
    FROM orders
),
gap_customer AS (
    SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS c_acctbal
    FROM customer
),""" + COMMERCE.replace(" orders", " gap_orders").replace(" customer", " gap_customer")

FIVE = COMMERCE.removesuffix(")") + """    UNION
    SELECT CAST(o_custkey AS VARCHAR), CAST(l_shipdate AS DATE), 'returns'
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'
)"""

EVENTS = """
person AS (
    SELECT CAST(c_custkey AS VARCHAR) AS user_id,
           CAST(min(ts) AS DATE) AS signup_date,
           bool_or(c_acctbal < 0) AS restricted,
           any_value(c_mktsegment) AS segment
    FROM customer JOIN events ON user_id = c_custkey
    WHERE event_type = 'signup'
    GROUP BY c_custkey
),
usage AS (
    SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(ts AS DATE) AS d, 'spending' AS feature
    FROM events WHERE event_type IN ('view', 'click')
    UNION
    SELECT CAST(c_custkey AS VARCHAR), CAST(ts AS DATE),
           CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'investment' ELSE 'savings' END
    FROM events JOIN customer ON c_custkey = user_id
    WHERE event_type = 'purchase' AND value >= 5
    UNION
    SELECT CAST(user_id AS VARCHAR), CAST(ts AS DATE), 'assistant'
    FROM events WHERE event_type = 'error'
)"""

SUBMISSIONS = """
sentence AS (
    SELECT conv_id, turn, place, s,
           split_part(s, ' ', 1) AS question
    FROM (
        SELECT conv_id, turn,
               unnest(string_split("text", '. ')) AS s,
               generate_subscripts(string_split("text", '. '), 1) AS place
        FROM conversations
    )
),
answered AS (
    SELECT conv_id, turn, count(*) FILTER (WHERE length(s) > length(question) + 1) AS answers
    FROM sentence AS a
    WHERE NOT EXISTS (
        SELECT 1 FROM sentence AS b
        WHERE b.conv_id = a.conv_id AND b.turn = a.turn
          AND b.question = a.question AND b.place > a.place
    )
    GROUP BY conv_id, turn
),
submission AS (
    SELECT DATE '2024-01-01' + CAST(conv_id % 30 AS INTEGER) AS created, coalesce(answers, 0) AS answers
    FROM conversations LEFT JOIN answered USING (conv_id, turn)
)"""


def _between(column: str, window: tuple[str, str]) -> str:
    return f"{column} BETWEEN DATE '{window[0]}' AND DATE '{window[1]}'"


def _as_date(unit: str, column: str) -> str:
    return column if unit == "day" else f"CAST(date_trunc('{unit}', {column}) AS DATE)"


def _average_actives(unit: str, source: str) -> str:
    return (
        f"(SELECT avg(n) FROM (SELECT count(DISTINCT user_id) AS n FROM {source} "
        f"GROUP BY {_as_date(unit, 'd')}))"
    )


def _comprehensive(profile: str, window: tuple[str, str], features=FEATURES) -> str:
    per_feature = ",\n".join(
        f"(SELECT count(DISTINCT user_id) FROM recent WHERE feature = '{f}') AS {f}_users"
        for f in features
    )
    only = ",\n".join(
        f"(SELECT count(*) FROM per_user WHERE kinds = 1 AND some_kind = '{f}') AS only_{f}_users"
        for f in features
    )
    return f"""
WITH {profile},
recent AS (SELECT * FROM usage WHERE {_between('d', window)}),
per_user AS (
    SELECT user_id, count(DISTINCT d) AS days, count(DISTINCT feature) AS kinds,
           any_value(feature) AS some_kind
    FROM recent GROUP BY user_id
),
member AS (
    SELECT per_user.*, (SELECT min(d) FROM usage u WHERE u.user_id = per_user.user_id) AS since
    FROM per_user WHERE user_id IN (SELECT user_id FROM person WHERE NOT restricted)
)
SELECT
(SELECT count(*) FROM person WHERE NOT restricted AND {_between('signup_date', window)}) AS total_signups,
(SELECT count(*) FROM member) AS total_active_users,
(SELECT count(*) FROM member WHERE days = 1) AS one_time_usage_users,
(SELECT count(*) FROM member WHERE days > 1) AS recurring_users,
(SELECT count(*) FROM member WHERE {_between('since', window)}) AS first_time_users,
{_average_actives('day', 'recent')} AS avg_dau,
{_average_actives('week', 'recent')} AS avg_wau,
{_average_actives('month', 'recent')} AS avg_mau,
{per_feature},
(SELECT count(*) FROM per_user WHERE kinds = 1) AS single_feature_users,
(SELECT count(*) FROM per_user WHERE kinds > 1) AS multiple_feature_users,
{only}
"""


def _feature_metrics(feature: str, window: tuple[str, str]) -> str:
    return f"""
WITH {COMMERCE},
recent AS (SELECT * FROM usage WHERE feature = '{feature}' AND {_between('d', window)}),
averages AS (
    SELECT {_average_actives('day', 'recent')} AS dau, {_average_actives('week', 'recent')} AS wau,
           {_average_actives('month', 'recent')} AS mau
)
SELECT
(SELECT count(DISTINCT user_id) FROM recent) AS total_active_users,
(SELECT count(*) FROM person WHERE NOT restricted AND {_between('signup_date', window)}
    AND signup_date <= (SELECT min(d) FROM recent r WHERE r.user_id = person.user_id)) AS first_time_users,
(SELECT count(*) FROM (SELECT user_id FROM recent GROUP BY user_id HAVING count(DISTINCT d) > 1)) AS recurring_users,
dau AS avg_dau, wau AS avg_wau, mau AS avg_mau,
CASE WHEN mau > 0 THEN coalesce(dau, 0) / mau ELSE 0.0 END AS stickiness
FROM averages
"""


def _combinations(profile: str, window: tuple[str, str]) -> str:
    return f"""
{profile},
combined AS (
    SELECT user_id, string_agg(DISTINCT feature, ' + ' ORDER BY feature) AS feature_combination
    FROM usage WHERE {_between('d', window)}
    GROUP BY user_id HAVING count(DISTINCT feature) > 1
),
combos AS (
    SELECT feature_combination, count(*) AS user_count,
           round(count(*) * 100.0 / (SELECT count(*) FROM combined), 2) AS percentage
    FROM combined GROUP BY feature_combination
),
banded AS (
    SELECT *, CASE
        WHEN NOT EXISTS (
            SELECT 1 FROM combos o WHERE o.user_count > c.user_count
            OR (o.user_count = c.user_count AND o.feature_combination < c.feature_combination)
        ) THEN 'top'
        WHEN percentage > 15 THEN 'high' ELSE '' END AS band
    FROM combos c
)"""


def _retention(profile: str, window: tuple[str, str], feature: str | None = None) -> str:
    wanted = f"AND feature = '{feature}'" if feature else ""

    def returned(low: int, high: int) -> str:
        return (
            "(SELECT count(*) FROM cohort WHERE EXISTS (SELECT 1 FROM recent "
            "WHERE recent.user_id = cohort.user_id "
            f"AND d - signup_date BETWEEN {low} AND {high}))"
        )

    horizons = {"day1": returned(1, 1), "week1": returned(1, 7), "month1": returned(1, 30)}
    ratios = ",\n".join(f"{n} / nullif(signups, 0) AS {n}_retention" for n in horizons)
    percents = ",\n".join(f"coalesce({n} / nullif(signups, 0) * 100, 0) AS {n}_percent" for n in horizons)
    counted = ",\n".join(f"CAST({sql} AS DOUBLE) AS {n}" for n, sql in horizons.items())
    return f"""
WITH {profile},
recent AS (SELECT * FROM usage WHERE {_between('d', window)} {wanted}),
cohort AS (SELECT * FROM person WHERE NOT restricted AND {_between('signup_date', window)}),
counted AS (SELECT (SELECT count(*) FROM cohort) AS signups, {counted})
SELECT signups AS total_signups, {ratios}, {percents} FROM counted
"""


def _by_feature(single) -> str:
    """One oracle per feature, stacked."""
    return " UNION ALL ".join(f"SELECT '{f}' AS feature, * FROM ({single(f)})" for f in FEATURES)


def _trend(
    profile: str, window: tuple[str, str], unit: str, names: tuple[str, str], feature: str | None = None
) -> str:
    wanted = f"AND feature = '{feature}'" if feature else ""
    return f"""
WITH {profile}
SELECT {_as_date(unit, 'd')} AS {names[0]}, count(DISTINCT user_id) AS {names[1]}
FROM usage WHERE {_between('d', window)} {wanted} GROUP BY 1
"""


def _overview(profile: str, window: tuple[str, str], unit: str, fill: str = "carry") -> str:
    bucket, signup_bucket = _as_date(unit, "d"), _as_date(unit, "signup_date")
    per_feature = ",\n".join(
        f"(SELECT count(DISTINCT user_id) FROM recent WHERE feature = '{f}' AND dt = p.dt) AS {f}_users"
        for f in FEATURES
    )
    signups = "(SELECT count(*) FROM joined WHERE dt <= p.dt)"
    actives = "(SELECT count(DISTINCT user_id) FROM ever WHERE dt <= p.dt)"
    if fill == "zero":
        signups = f"CASE WHEN p.dt IN (SELECT dt FROM joined) THEN {signups} ELSE 0 END"
        actives = f"CASE WHEN p.dt IN (SELECT dt FROM ever) THEN {actives} ELSE 0 END"
    return f"""
{profile},
period AS (
    SELECT CAST(generate_series AS DATE) AS dt
    FROM generate_series(CAST({_as_date(unit, f"DATE '{window[0]}'")} AS TIMESTAMP),
                         TIMESTAMP '{window[1]}', INTERVAL 1 {unit.upper()})
),
joined AS (
    SELECT {signup_bucket} AS dt, signup_date FROM person
    WHERE NOT restricted AND signup_date <= DATE '{window[1]}'
),
ever AS (SELECT *, {bucket} AS dt FROM usage WHERE d <= DATE '{window[1]}'),
recent AS (SELECT * FROM ever WHERE d >= DATE '{window[0]}'),
overview AS (
    SELECT dt AS activity_date,
    (SELECT count(*) FROM joined WHERE dt = p.dt AND signup_date >= DATE '{window[0]}') AS signups,
    (SELECT count(DISTINCT user_id) FROM recent WHERE dt = p.dt) AS active_users,
    {per_feature},
    {signups} AS absolute_signups,
    {actives} AS absolute_active_users
    FROM period p
)"""


def _melted(overview: str, metrics: list[str], rows: int) -> str:
    stacked = " UNION ALL ".join(
        f"SELECT activity_date, '{m}' AS metric, CAST({m} AS DOUBLE) AS n FROM overview" for m in metrics
    )
    return f"""
WITH {overview},
long AS ({stacked}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY activity_date) AS k FROM long)
SELECT a.activity_date, a.metric, avg(b.n) AS "count"
FROM numbered a JOIN numbered b ON b.metric = a.metric AND b.k BETWEEN a.k - {rows - 1} AND a.k
GROUP BY a.activity_date, a.metric
"""


def _dormant(window: tuple[str, str]) -> str:
    """``past`` and ``recent`` activity around the window."""
    start = f"DATE '{window[0]}'"
    return f"""
past AS (SELECT * FROM usage WHERE d BETWEEN {start} - {DORMANT_DAYS} AND {start}),
recent AS (SELECT * FROM usage WHERE {_between('d', window)})"""


def _away(feature: str | None) -> str:
    only = f"WHERE feature = '{feature}'" if feature else ""
    # A nameless user is never found again: NULL equals nothing.
    also = f"AND r.feature = '{feature}'" if feature else ""
    return (
        f"(SELECT count(*) FROM (SELECT DISTINCT user_id FROM past {only}) p "
        f"WHERE NOT EXISTS (SELECT 1 FROM recent r WHERE r.user_id = p.user_id {also}))"
    )


def _dormant_row() -> str:
    counts = ",\n".join(f"{_away(f)} AS {f}_dormant_users" for f in FEATURES)
    return f"""
SELECT {_away(None)} AS overall_dormant_users, {counts},
(SELECT count(DISTINCT user_id) FROM past) AS total_historical_users,
(SELECT count(DISTINCT user_id) FROM recent) AS total_current_users
"""


def _breakdown() -> str:
    branches = ["SELECT 0 AS position, 'Overall' AS feature, overall_dormant_users AS n FROM a"]
    branches += [
        f"SELECT {i}, '{FEATURE_LABELS[f]}', {f}_dormant_users FROM a" for i, f in enumerate(FEATURES, 1)
    ]
    return f"""
WITH {COMMERCE}, {_dormant(MARCH)},
a AS ({_dormant_row()}),
t AS ({' UNION ALL '.join(branches)})
SELECT position, feature, n AS dormant_users,
    CASE WHEN position = 0 THEN 100.0 WHEN overall_dormant_users > 0
         THEN round_even(n / overall_dormant_users * 100, 1) ELSE 0.0 END AS percentage_of_dormant,
    CASE WHEN n = (SELECT max(n) FROM t) THEN 'max'
         WHEN n > (SELECT avg(n) FROM t) THEN 'above_mean' ELSE '' END AS band,
    (SELECT feature FROM t ORDER BY n DESC, position LIMIT 1) AS top_feature
FROM t, a
"""


def _dormant_trend() -> str:
    return f"""
{COMMERCE}, {_dormant(MARCH)},
away AS (
    SELECT dates.d AS activity_date, count(h.user_id) AS dormant_count
    FROM (SELECT DISTINCT d FROM recent) dates, (SELECT DISTINCT user_id FROM past) h
    WHERE NOT EXISTS (SELECT 1 FROM recent r WHERE r.user_id = h.user_id AND r.d = dates.d)
    GROUP BY dates.d
)"""


MONTHS = f"""
period AS (
    SELECT CAST(generate_series AS DATE) AS period_start, last_day(CAST(generate_series AS DATE)) AS period_end
    FROM generate_series(TIMESTAMP '{YEAR[0]}', TIMESTAMP '{YEAR[1]}', INTERVAL 1 MONTH)
)"""

ONE_MONTH = f"period AS (SELECT DATE '{MARCH[0]}' AS period_start, DATE '{MARCH[1]}' AS period_end)"


def _usage_by_period(periods: str, segment: bool = False) -> str:
    """CTE ``kpi``: one row per period (and segment) with every count."""
    seg = "segment" if segment else "NULL"
    group = "period_start, period_end, seg"

    def averaged(unit: str, name: str) -> str:
        return f"""{name} AS (
    SELECT {group}, avg(n) AS v FROM (
        SELECT {group}, count(DISTINCT user_id) AS n FROM seen WHERE now
        GROUP BY {group}, {_as_date(unit, 'd')}
    ) GROUP BY {group}
)"""

    uses = ", ".join(f"bool_or(now AND feature = '{f}') AS uses_{f}" for f in FEATURES)
    used = ", ".join(f"bool_or(before AND feature = '{f}') AS used_{f}" for f in FEATURES)
    counts = [f"count(*) FILTER (WHERE uses_{f}) AS {f}_users" for f in FEATURES]
    counts += [f"count(*) FILTER (WHERE kinds = 1 AND uses_{f}) AS only_{f}_users" for f in FEATURES]
    counts += [f"count(*) FILTER (WHERE used_{f} AND NOT uses_{f}) AS {f}_dormant_users" for f in FEATURES]
    names = [f"{f}_users" for f in FEATURES] + [f"only_{f}_users" for f in FEATURES]
    names += [f"{f}_dormant_users" for f in FEATURES]
    names += [
        "total_active_users", "one_time_usage_users", "recurring_users", "first_time_users",
        "single_feature_users", "multiple_feature_users", "overall_dormant_users",
        "total_historical_users", "total_current_users",
    ]
    merged = ", ".join(f"coalesce(c.{n}, 0) AS {n}" for n in names)
    same = "x.period_start = k.period_start AND x.seg IS NOT DISTINCT FROM k.seg"
    frame = f"SELECT DISTINCT {group} FROM counted UNION SELECT {group} FROM signed"
    if not segment:
        frame = f"SELECT period_start, period_end, NULL AS seg FROM period UNION {frame}"
    return f"""
{COMMERCE}, {periods},
since AS (SELECT user_id, min(d) AS first_day FROM usage GROUP BY user_id),
seen AS (
    SELECT period_start, period_end, {seg} AS seg, u.user_id, u.d, u.feature, p.restricted,
           u.d BETWEEN period_start AND period_end AS now,
           u.d BETWEEN period_start - {DORMANT_DAYS} AND period_start AS before
    FROM period JOIN usage u ON u.d BETWEEN period_start - {DORMANT_DAYS} AND period_end
    LEFT JOIN person p ON p.user_id = u.user_id
),
per_user AS (
    SELECT {group}, user_id, bool_and(NOT restricted) AS member,
           count(DISTINCT d) FILTER (WHERE now) AS days,
           count(DISTINCT feature) FILTER (WHERE now) AS kinds,
           bool_or(now) AS present, bool_or(before) AS earlier, {uses}, {used},
           (SELECT first_day FROM since WHERE since.user_id = seen.user_id)
               BETWEEN period_start AND period_end AS fresh
    FROM seen GROUP BY {group}, user_id
),
counted AS (
    SELECT {group},
           count(*) FILTER (WHERE member AND present) AS total_active_users,
           count(*) FILTER (WHERE member AND days = 1) AS one_time_usage_users,
           count(*) FILTER (WHERE member AND days > 1) AS recurring_users,
           count(*) FILTER (WHERE member AND fresh) AS first_time_users,
           count(*) FILTER (WHERE kinds = 1) AS single_feature_users,
           count(*) FILTER (WHERE kinds > 1) AS multiple_feature_users,
           count(*) FILTER (WHERE earlier AND NOT present) AS overall_dormant_users,
           count(*) FILTER (WHERE earlier) AS total_historical_users,
           count(*) FILTER (WHERE present) AS total_current_users,
           {', '.join(counts)}
    FROM per_user GROUP BY {group}
),
signed AS (
    SELECT period_start, period_end, {seg} AS seg, count(*) AS n
    FROM period JOIN person ON signup_date BETWEEN period_start AND period_end
    WHERE NOT restricted GROUP BY ALL
),
{averaged('day', 'daily')}, {averaged('week', 'weekly')}, {averaged('month', 'monthly')},
kpi AS (
    SELECT k.*, {merged},
        coalesce((SELECT n FROM signed x WHERE {same}), 0) AS total_signups,
        (SELECT v FROM daily x WHERE {same}) AS avg_dau,
        (SELECT v FROM weekly x WHERE {same}) AS avg_wau,
        (SELECT v FROM monthly x WHERE {same}) AS avg_mau
    FROM ({frame}) k
    LEFT JOIN counted c ON c.period_start = k.period_start AND c.seg IS NOT DISTINCT FROM k.seg
)"""


MEASURES = [
    "total_signups", "total_active_users", "one_time_usage_users", "recurring_users",
    "first_time_users", "avg_dau", "avg_wau", "avg_mau", *(f"{f}_users" for f in FEATURES),
    "single_feature_users", "multiple_feature_users", *(f"only_{f}_users" for f in FEATURES),
    "overall_dormant_users", *(f"{f}_dormant_users" for f in FEATURES),
    "total_historical_users", "total_current_users",
]


def _long(measures: dict[str, str], segment: bool) -> str:
    keys = "period_start, period_end" + (", seg AS segment" if segment else "")
    return " UNION ALL ".join(
        f"SELECT {keys}, '{name}' AS metric, CAST({sql} AS DOUBLE) AS value FROM kpi"
        for name, sql in measures.items()
    )


RANKED = f"""
popular AS ({' UNION ALL '.join(
    f"SELECT period_start, period_end, seg, total_active_users, {i} AS place, "
    f"'{FEATURE_LABELS[f]}' AS label, {f}_users AS n FROM kpi WHERE total_active_users > 0"
    for i, f in enumerate(FEATURES))}),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY period_start, seg ORDER BY n DESC, place) AS down,
              row_number() OVER (PARTITION BY period_start, seg ORDER BY n, place) AS up
    FROM popular
)"""


def _ranking() -> str:
    return f"""
WITH {_usage_by_period(MONTHS)}, {RANKED},
pair AS (
    SELECT m.period_start, m.period_end, m.label AS most_used_feature, m.n AS most_used_count,
           m.n / m.total_active_users * 100 AS most_used_pct,
           l.label AS least_used_feature, l.n AS least_used_count,
           l.n / l.total_active_users * 100 AS least_used_pct
    FROM ranked m JOIN ranked l USING (period_start) WHERE m.down = 1 AND l.up = 1
)
SELECT *, CASE WHEN most_used_pct > 60 THEN 'low' ELSE 'info' END AS most_used_alert,
    CASE WHEN least_used_pct < 15 THEN 'high' WHEN least_used_pct < 25 THEN 'medium' ELSE 'info' END
        AS least_used_alert
FROM pair
"""


def _share(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN ({part}) / {whole} * 100 ELSE 0 END"


def _alerts(periods: str, segment: bool) -> str:
    active = "total_active_users"
    rates = {
        "conversion_rate": _share("first_time_users", "total_signups"),
        "adoption_rate": f"least({_share('first_time_users', active)}, 100)",
        **{f"{f}_share": _share(f"{f}_users", active) for f in FEATURES},
        "single_feature_share": _share("single_feature_users", active),
        "multiple_feature_share": _share("multiple_feature_users", active),
        **{f"only_{f}_share": _share(f"only_{f}_users", active) for f in FEATURES},
        "dormant_share": _share("overall_dormant_users", "total_historical_users"),
        "reactivation_rate_ref": _share(
            "total_current_users - overall_dormant_users", "total_historical_users"
        ),
        **{f"{f}_dormant_share": _share(f"{f}_dormant_users", "overall_dormant_users") for f in FEATURES},
    }
    seg = ", segment" if segment else ""
    ranks = " UNION ALL ".join(
        f"SELECT period_start, period_end{', seg' if segment else ''}, '{metric}', "
        f"n / total_active_users * 100 FROM ranked WHERE {side} = 1"
        for metric, side in (("most_used_share", "down"), ("least_used_share", "up"))
    )
    least = (
        "(SELECT lower(label) FROM ranked r WHERE r.up = 1 AND r.period_start = rate.period_start "
        f"AND r.seg IS NOT DISTINCT FROM {'rate.segment' if segment else 'NULL'})"
    )
    return f"""
WITH {_usage_by_period(periods, segment)}, {RANKED},
rate AS ({_long(rates, segment)} UNION ALL {ranks})
SELECT period_start, period_end{seg}, metric, value,
CASE
    WHEN metric = 'conversion_rate' THEN CASE WHEN value < 20 THEN 'high' WHEN value < 40 THEN 'medium' ELSE 'low' END
    WHEN metric = 'adoption_rate' THEN CASE WHEN value > 80 THEN 'high' WHEN value > 50 THEN 'medium' ELSE 'low' END
    WHEN metric = 'spending_share' THEN CASE WHEN value > 40 THEN 'low' WHEN value < 20 THEN 'medium' ELSE 'info' END
    WHEN metric = 'assistant_share' THEN CASE WHEN value > 30 THEN 'low' WHEN value < 10 THEN 'medium' ELSE 'info' END
    WHEN metric = 'savings_share' THEN CASE WHEN value > 25 THEN 'low' WHEN value < 15 THEN 'medium' ELSE 'info' END
    WHEN metric = 'investment_share' THEN CASE WHEN value > 20 THEN 'low' WHEN value < 8 THEN 'medium' ELSE 'info' END
    WHEN metric = 'single_feature_share' THEN CASE WHEN value > 60 THEN 'medium' WHEN value < 40 THEN 'low' ELSE 'info' END
    WHEN metric = 'multiple_feature_share' THEN CASE WHEN value > 40 THEN 'low' WHEN value < 20 THEN 'medium' ELSE 'info' END
    WHEN metric = 'most_used_share' THEN CASE WHEN value > 60 THEN 'low' ELSE 'info' END
    WHEN metric = 'least_used_share' THEN CASE WHEN value < 15 THEN 'high' WHEN value < 25 THEN 'medium' ELSE 'info' END
    WHEN metric = 'only_spending_share' THEN CASE WHEN value > 10 THEN 'info' ELSE 'medium' END
    WHEN metric = 'only_assistant_share' THEN CASE WHEN value > 5 THEN 'info' ELSE 'medium' END
    WHEN metric = 'only_savings_share' THEN CASE WHEN value > 8 THEN 'info' ELSE 'medium' END
    WHEN metric = 'only_investment_share' THEN CASE WHEN value > 3 THEN 'info' ELSE 'medium' END
    WHEN metric = 'dormant_share' THEN CASE WHEN value > 40 THEN 'high' WHEN value > 20 THEN 'medium' ELSE 'low' END
    WHEN metric = 'reactivation_rate_ref' THEN CASE WHEN value > 60 THEN 'low' WHEN value > 40 THEN 'medium' ELSE 'high' END
    ELSE CASE WHEN value > 30 THEN 'high' WHEN value > 15 THEN 'medium' ELSE 'low' END
END AS alert,
CASE
    WHEN metric = 'conversion_rate' THEN CASE WHEN value < 20 THEN 'Critical: Improve onboarding flow'
        WHEN value < 40 THEN 'Good: Focus on activation campaigns' ELSE 'Excellent: Maintain current strategy' END
    WHEN metric = 'adoption_rate' THEN CASE WHEN value > 80 THEN 'High new user acquisition'
        WHEN value > 50 THEN 'Balanced user growth' ELSE 'Focus on user retention' END
    WHEN metric = 'spending_share' THEN CASE WHEN value > 40 THEN 'Strong spending engagement'
        WHEN value < 20 THEN 'Consider spending feature promotion' ELSE 'Normal spending usage' END
    WHEN metric = 'assistant_share' THEN CASE WHEN value > 30 THEN 'High AI engagement'
        WHEN value < 10 THEN 'Boost assistant adoption' ELSE 'Steady AI usage' END
    WHEN metric = 'savings_share' THEN CASE WHEN value > 25 THEN 'Strong savings culture'
        WHEN value < 15 THEN 'Promote savings features' ELSE 'Healthy savings usage' END
    WHEN metric = 'investment_share' THEN CASE WHEN value > 20 THEN 'High investment engagement'
        WHEN value < 8 THEN 'Focus on investment adoption' ELSE 'Growing investment usage' END
    WHEN metric = 'single_feature_share' THEN CASE WHEN value > 50
        THEN 'Opportunity to cross-sell other features' ELSE 'Good feature adoption balance' END
    WHEN metric = 'multiple_feature_share' THEN CASE WHEN value > 40
        THEN 'High engagement users - focus on retention' ELSE 'Potential to increase feature adoption' END
    WHEN metric = 'most_used_share' THEN 'Leading feature - leverage for marketing campaigns'
    WHEN metric = 'least_used_share' THEN CASE WHEN value < 20
        THEN concat('Focus on improving ', {least}, ' adoption') ELSE 'Consider feature enhancement' END
    WHEN metric = 'only_spending_share' THEN CASE WHEN value > 15
        THEN 'Cross-sell savings/investment features' ELSE 'Normal spending-only user segment' END
    WHEN metric = 'only_assistant_share' THEN CASE WHEN value > 10
        THEN 'Engage with financial planning features' ELSE 'AI-only users segment' END
    WHEN metric = 'only_savings_share' THEN CASE WHEN value > 12
        THEN 'Introduce spending tracking' ELSE 'Savings-focused user segment' END
    WHEN metric = 'only_investment_share' THEN CASE WHEN value > 5
        THEN 'High-value users - premium features' ELSE 'Investment-focused segment' END
    WHEN metric = 'dormant_share' THEN CASE
        WHEN value > 40 THEN format('Critical: {{:.1f}}% of historical users are dormant', value)
        WHEN value > 20 THEN format('Moderate: {{:.1f}}% dormant users', value)
        ELSE format('Good: Only {{:.1f}}% dormant users', value) END
    WHEN metric = 'reactivation_rate_ref' THEN CASE WHEN value > 60 THEN 'Strong user retention'
        WHEN value > 40 THEN 'Moderate retention' ELSE 'Focus on re-engagement' END
    ELSE concat(CASE WHEN value > 30 THEN 'High ' WHEN value > 15 THEN 'Moderate ' ELSE 'Low ' END,
                split_part(metric, '_', 1), ' churn')
END AS insight
FROM rate
"""


def _retention_monthly(segment: bool = False) -> str:
    seg = "segment" if segment else "NULL"
    return f"""
cohort AS (
    SELECT period_start, period_end, {seg} AS seg, user_id, signup_date
    FROM period JOIN person ON signup_date BETWEEN period_start AND period_end
    WHERE NOT restricted
),
returned AS (
    SELECT cohort.*, day1, week1, month1
    FROM cohort LEFT JOIN (
        SELECT c.user_id AS who, c.period_start AS p0,
               max(CAST(d - signup_date = 1 AS INTEGER)) AS day1,
               max(CAST(d - signup_date BETWEEN 1 AND 7 AS INTEGER)) AS week1,
               max(CAST(d - signup_date BETWEEN 1 AND 30 AS INTEGER)) AS month1
        FROM cohort c JOIN usage u ON u.user_id = c.user_id
        WHERE u.d BETWEEN period_start AND period_end
        GROUP BY ALL
    ) ON who = user_id AND p0 = period_start
),
retained AS (
    SELECT period_start, period_end, seg,
           coalesce(sum(day1), 0) / count(*) * 100 AS day1_percent,
           coalesce(sum(week1), 0) / count(*) * 100 AS week1_percent,
           coalesce(sum(month1), 0) / count(*) * 100 AS month1_percent
    FROM returned GROUP BY ALL
)"""


def _insights(segment: bool = False) -> str:
    seg = ", segment" if segment else ""
    return f"""
WITH {_usage_by_period(MONTHS, segment)}, {_retention_monthly(segment)},
m AS (
    SELECT k.period_start, k.period_end, k.seg AS segment, total_signups,
           CASE WHEN total_signups > 0 THEN total_active_users / total_signups * 100 END AS activation,
           coalesce(day1_percent, 0) AS day1, coalesce(week1_percent, 0) AS week1
    FROM kpi k LEFT JOIN retained r
        ON r.period_start = k.period_start AND r.seg IS NOT DISTINCT FROM k.seg
)
SELECT period_start, period_end{seg}, 'low_activation' AS rule_id, 'Low Activation Rate Alert' AS title,
       format('Only {{:.1f}}% of signups become active users.', activation) AS insight,
       'Improve onboarding flow and feature discovery.' AS recommendation
FROM m WHERE activation < 30
UNION ALL
SELECT period_start, period_end{seg}, 'high_activation', 'Excellent Activation Rate',
       format('{{:.1f}}% activation rate shows strong product-market fit.', activation),
       'Scale marketing efforts and maintain current onboarding quality.'
FROM m WHERE activation > 70
UNION ALL
SELECT period_start, period_end{seg}, 'low_day1_retention', 'Day 1 Retention Needs Attention',
       format('Only {{:.1f}}% of users return the next day.', day1),
       'Implement push notifications and email sequences for new users.'
FROM m WHERE day1 < 20
UNION ALL
SELECT period_start, period_end{seg}, 'high_week1_retention', 'Strong Week 1 Retention',
       format('{{:.1f}}% of users return within a week.', week1),
       'Focus on converting these engaged users to power users.'
FROM m WHERE week1 > 50
"""


def _recommendations() -> str:
    shares = " UNION ALL ".join(
        f"SELECT period_start, period_end, '{FEATURE_LABELS[f]}' AS label, "
        f"{_share(f'{f}_dormant_users', 'overall_dormant_users')} AS v FROM kpi"
        for f in FEATURES
    )
    return f"""
WITH {_usage_by_period(MONTHS)},
overall AS (
    SELECT period_start, period_end, {_share('overall_dormant_users', 'total_historical_users')} AS v FROM kpi
),
shares AS ({shares}),
advice AS (
    SELECT period_start, period_end, 'high_dormancy' AS rule_id, 'High Dormant User Rate' AS title,
        format('{{:.1f}}% of historical users are dormant', v) AS insight,
        'Implement aggressive re-engagement campaigns including email sequences, push notifications, and personalized offers' AS recommendation
    FROM overall WHERE v > 30
    UNION ALL
    SELECT period_start, period_end, 'feature_churn', concat('High ', label, ' Churn'),
        format('{{:.1f}}% of dormant users were {{}} users', v, label),
        concat('Focus on ', label, ' feature improvements and targeted re-engagement for ', label, ' users')
    FROM shares WHERE v > 25
)
SELECT * FROM advice
UNION ALL
SELECT period_start, period_end, 'good_retention', 'Good User Retention',
    'Dormant user rates are within acceptable ranges',
    'Continue current retention strategies and monitor for any changes'
FROM kpi WHERE period_start NOT IN (SELECT period_start FROM advice)
"""


def all_oracles() -> dict[str, str]:
    overview_day = _overview(EVENTS, EVENT_WEEKS, "day")
    overview_week = _overview(COMMERCE, MIDWEEK, "week")
    metrics = [
        "signups", "active_users", *(f"{f}_users" for f in FEATURES),
        "absolute_signups", "absolute_active_users",
    ]
    measured = {m: m for m in MEASURES}
    combos = _combinations(COMMERCE, MARCH)
    in_event_weeks = _between("CAST(ts AS DATE)", EVENT_WEEKS)
    oracles = {
        "activity_fact": f"WITH {COMMERCE} SELECT user_id, d AS activity_date, feature FROM usage",
        "activity_fact_events": f"WITH {EVENTS} SELECT user_id, d AS activity_date, feature FROM usage",
        "comprehensive_metrics": _comprehensive(COMMERCE, MARCH),
        "comprehensive_metrics_year": _comprehensive(COMMERCE, LAUNCH),
        "comprehensive_metrics_events": _comprehensive(EVENTS, EVENT_WEEKS),
        "feature_combinations": f"WITH {combos} SELECT * FROM banded",
        "feature_combinations_events": (
            f"WITH {_combinations(EVENTS, EVENT_WEEKS)} SELECT * FROM banded"
        ),
        "combination_highlights": f"""
WITH {combos},
placed AS (SELECT *, row_number() OVER (ORDER BY user_count DESC, feature_combination) AS k FROM combos)
SELECT a.feature_combination AS top_combination, a.user_count AS top_user_count,
       a.percentage AS top_percentage, (SELECT count(*) FROM combos) AS total_combinations,
       a.percentage + b.percentage AS top2_percentage
FROM placed a LEFT JOIN placed b ON b.k = 2 WHERE a.k = 1
""",
        "retention_overall": _retention(COMMERCE, SPRING),
        "retention_events": _retention(EVENTS, EVENT_START),
        "feature_metrics_all": _by_feature(lambda f: _feature_metrics(f, SPRING)),
        "retention_by_feature": _by_feature(lambda f: _retention(EVENTS, EVENT_START, f)),
        "feature_insights": f"""
WITH retained AS ({_by_feature(lambda f: _retention(EVENTS, EVENT_START, f))})
SELECT feature, 'low_day1_retention' AS rule_id, 'Day 1 Retention Needs Attention' AS title,
       format('Only {{:.1f}}% of users return the next day.', day1_percent) AS insight,
       'Implement push notifications and email sequences for new users.' AS recommendation
FROM retained WHERE day1_percent < 20
UNION ALL
SELECT feature, 'high_week1_retention', 'Strong Week 1 Retention',
       format('{{:.1f}}% of users return within a week.', week1_percent),
       'Focus on converting these engaged users to power users.'
FROM retained WHERE week1_percent > 50
""",
        "trend_series": " UNION ALL ".join(
            f"SELECT '{unit}' AS granularity, {unit}_start AS period_start, n AS users "
            f"FROM ({_trend(EVENTS, EVENT_WEEKS, unit, (f'{unit}_start', 'n'))})"
            for unit in ("day", "week", "month")
        ),
        "churn_count": f"""
WITH {COMMERCE}
SELECT count(*) AS churn_count
FROM (SELECT DISTINCT user_id FROM usage WHERE d <= DATE '{MARCH[1]}') u
WHERE NOT EXISTS (
    SELECT 1 FROM usage r WHERE r.user_id = u.user_id AND {_between('r.d', MARCH)}
)
""",
        "absolute_metrics": f"""
WITH {COMMERCE}
SELECT (SELECT count(*) FROM person WHERE NOT restricted AND signup_date <= DATE '{MARCH[1]}')
           AS absolute_total_signups,
       (SELECT count(DISTINCT user_id) FROM usage WHERE d <= DATE '{MARCH[1]}')
           AS absolute_total_active_users
""",
        "trend_dau_sql": _trend(COMMERCE, MARCH, "day", ("activity_date", "dau")),
        "overview_trend_day": f"WITH {overview_day} SELECT * FROM overview",
        "overview_trend_week": f"WITH {overview_week} SELECT * FROM overview",
        "overview_trend_month": f"WITH {_overview(COMMERCE, YEAR, 'month')} SELECT * FROM overview",
        "overview_trend_week_zero": (
            f"WITH {_overview(COMMERCE, MIDWEEK, 'week', 'zero')} SELECT * FROM overview"
        ),
        "overview_trend_melted": f"""
WITH {overview_day}
SELECT activity_date, 'Signups' AS metric, CAST(signups AS DOUBLE) AS "count" FROM overview
UNION ALL SELECT activity_date, 'Active Users', CAST(active_users AS DOUBLE) FROM overview
""",
        "overview_trend_smoothed": _melted(overview_day, metrics, 7),
        "overview_trend_smoothed_week": _melted(overview_week, metrics, 4),
        "dormant_analysis": f"WITH {COMMERCE}, {_dormant(MARCH)} {_dormant_row()}",
        "dormant_breakdown": _breakdown(),
        "dormant_trend": f"WITH {_dormant_trend()} SELECT * FROM away",
        "dormant_trend_change": f"""
WITH {_dormant_trend()},
change AS (
    SELECT (SELECT dormant_count FROM away ORDER BY activity_date DESC LIMIT 1)
         - (SELECT dormant_count FROM away ORDER BY activity_date LIMIT 1) AS c
    WHERE (SELECT count(*) FROM away) > 1
)
SELECT c AS trend_change, abs(c) AS change_size,
       CASE sign(c) WHEN 1 THEN 'increasing' WHEN -1 THEN 'decreasing' ELSE 'stable' END AS trend_direction
FROM change
""",
        "kpi_monthly": f"WITH {_usage_by_period(MONTHS)} {_long(measured, False)}",
        "kpi_by_segment": f"WITH {_usage_by_period(ONE_MONTH, True)} {_long(measured, True)}",
        "feature_ranking": _ranking(),
        "kpi_alerts": _alerts(MONTHS, False),
        "kpi_alerts_by_segment": _alerts(ONE_MONTH, True),
        "retention_monthly": (
            f"WITH {COMMERCE}, {MONTHS}, {_retention_monthly()} SELECT * EXCLUDE (seg) FROM retained"
        ),
        "insights": _insights(),
        "insights_by_segment": _insights(segment=True),
        "recommendations": _recommendations(),
        "survey_completion": f"""
WITH {SUBMISSIONS},
recent AS (SELECT * FROM submission WHERE {_between('created', EVENT_WEEKS)})
SELECT count(*) AS submissions,
       count(*) FILTER (WHERE answers = (SELECT max(answers) FROM recent)) AS completed
FROM recent
""",
        "survey_odd_documents": f"""
WITH submission AS (
    SELECT CASE turn % 6 WHEN 4 THEN 0 ELSE
               CASE turn % 6 WHEN 1 THEN 0 ELSE 1 END + CASE WHEN "text" <> '' THEN 1 ELSE 0 END
           END AS answers
    FROM conversations
    WHERE {_between("DATE '2024-01-01' + CAST(conv_id % 30 AS INTEGER)", EVENT_WEEKS)}
)
SELECT answers, count(*) AS submissions FROM submission GROUP BY answers
""",
        "activity_fact_gaps": f"WITH {GAPS} SELECT user_id, d AS activity_date, feature FROM usage",
        "comprehensive_metrics_gaps": _comprehensive(GAPS, LAUNCH),
        "comprehensive_metrics_five": _comprehensive(FIVE, LAUNCH, FIVE_FEATURES),
        "feature_combinations_five": f"WITH {_combinations(FIVE, LAUNCH)} SELECT * FROM banded",
        "activity_fact_reserved": """
SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS user_id, CAST(o_orderdate AS DATE) AS activity_date,
       'spending' AS feature
FROM orders WHERE o_orderstatus = 'F'
""",
        "survey_daily": f"""
WITH {SUBMISSIONS}
SELECT created AS submission_date, count(*) AS submissions
FROM submission WHERE {_between('created', EVENT_WEEKS)} GROUP BY created
""",
        "reaction_counts": f"""
SELECT event_type AS reaction, count(*) AS reactions FROM events
WHERE {in_event_weeks} AND event_type IS NOT NULL GROUP BY event_type
""",
        "feedback_list": f"""
SELECT concat(upper(left(event_type, 1)), lower(substr(event_type, 2))) AS reaction,
       props AS comment, CAST(ts AS DATE) AS feedback_date
FROM events WHERE {in_event_weeks}
""",
    }
    for name in ("churn_count", "absolute_metrics", "comprehensive_metrics", "kpi_monthly"):
        oracles[f"{name}_first_seen"] = oracles[name]
    oracles["overview_trend_week_first_seen"] = oracles["overview_trend_week_zero"]
    series = {"day": ("activity_date", "dau"), "week": ("week", "wau"), "month": ("month", "mau")}
    for f in FEATURES:
        oracles[f"feature_metrics_{f}"] = _feature_metrics(f, SPRING)
        oracles[f"retention_{f}"] = _retention(COMMERCE, SPRING, f)
        oracles[f"trend_dau_events_{f}"] = _trend(EVENTS, EVENT_WEEKS, "day", series["day"], f)
    for unit, names in series.items():
        oracles[f"trend_{names[1]}"] = _trend(COMMERCE, YEAR, unit, names)
        oracles[f"trend_{names[1]}_spending"] = _trend(COMMERCE, YEAR, unit, names, "spending")
    return oracles
