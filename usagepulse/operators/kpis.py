"""KPIs over many periods and segments at once, with alerts and advice.

`usage_by_period` computes the engagement and dormancy counts for every period of
a list, optionally per user segment; the rest are row-local columns over it. With
one period and no segment it equals `comprehensive_metrics` next to
`dormant_analysis`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagepulse.functions import calendar
from usagepulse.functions.calendar import Period, period_frame, periods_holding
from usagepulse.functions.numeric import one_decimal_text, percent, sql_percent
from usagepulse.functions.sql_text import quoted
from usagepulse.operators import dormancy, rollup
from usagepulse.operators.engagement import comprehensive_columns, period_counts, unrestricted
from usagepulse.operators.retention import (
    HORIZONS,
    first_returns,
    retained_counts,
    retention_ratios,
    signups_within,
)
from usagepulse.sources.registry import FEATURE_LABELS, FEATURES, label_of


def dormancy_columns(features: Sequence[str]) -> list[str]:
    return [
        "overall_dormant_users", *(f"{f}_dormant_users" for f in features),
        "total_historical_users", "total_current_users",
    ]


def _keys(by: str | None) -> list[str]:
    return ["period_start", "period_end", *([by] if by else [])]


def _holding_signup(periods: Sequence[Period]) -> Column:
    """The periods, without their histories, that hold a signup."""
    return periods_holding([Period(p.start, p.end) for p in periods], "signup_date")


def _user_periods(
    activity: DataFrame,
    users: DataFrame,
    periods: Sequence[Period],
    by: str | None,
    features: Sequence[str],
    first: DataFrame | None,
) -> DataFrame:
    """A row per user and period in which, or in whose history, the user did something.

    Activity shrinks to one row of day bits per user and feature and meets the users on the
    same key; only that row unfolds into periods, each cut out of the bits by its masks.
    Carries the calendar and feature bitmaps that the counts are taken from, the user's
    ``member``, ``signup_date`` and ``by``, and ``first_return``, the first activity after
    the signup where that is within the range of the periods.
    """
    opening = min(p.history_start for p in periods)
    starts, last_day = min(p.start for p in periods), max(p.end for p in periods)
    if first is not None:
        activity = activity.filter(F.col("activity_date") >= F.lit(opening))
    per_user = rollup.day_matrix(activity, features, opening, last_day)
    attributes = users.select(
        "user_id", "signup_date", (~F.col("restricted")).alias("member"), *([by] if by else [])
    )
    joined = per_user.join(rollup.with_known_first(attributes, first), "user_id", "full_outer").withColumn(
        "first_ever", F.least("first_ever", "known_first")
    )
    monday = f"DATE'{calendar.monday(opening)}'"
    signup = f"CASE WHEN signup_date BETWEEN DATE'{starts}' AND DATE'{last_day}' THEN date_diff(signup_date, {monday}) END"
    found = calendar.with_next_bit(joined, "days", signup).withColumn(
        "first_return", F.expr(f"date_add({monday}, CAST(next_pos AS int))")
    )
    longest = max(p.days for p in periods)
    now_words = calendar.words_of(longest)
    past_words = calendar.words_of(max(p.history_days for p in periods) + 1)

    def now(words: str) -> list[str]:
        return calendar.cut_words(words, "p.now", now_words)

    def past(words: str) -> list[str]:
        return calendar.cut_words(words, "p.past", past_words)

    def marks(cut, prefix: str) -> list[str]:
        """Bitmaps of the features with a day in a range."""
        names = calendar.word_names(prefix, len(features))
        bits = [f"CASE WHEN {calendar.any_set(cut(f'days_{n}'))} THEN 1L ELSE 0L END" for n in range(len(features))]
        words = [bits[k : k + calendar.WORD_BITS] for k in range(0, len(bits), calendar.WORD_BITS)]
        return [
            " | ".join(f"shiftleft({bit}, {n})" for n, bit in enumerate(word)) + f" AS {name}"
            for word, name in zip(words, names)
        ]

    carried = ["user_id", "first_ever", "member", "signup_date", "first_return", *([by] if by else [])]
    cut = (
        found.select("*", F.explode(calendar.period_cuts(periods, opening)).alias("p"))
        .selectExpr(
            *carried,
            "p.period_start",
            "p.period_end",
            "p.months",
            *(f"{word} AS {name}" for word, name in zip(now("days"), _day_names(longest))),
            f"{calendar.any_set(past('days'))} AS was_active",
            *marks(now, "uses"),
            *marks(past, "used"),
        )
        .withColumn("is_active", F.expr(calendar.any_set(_day_names(longest))))
        .filter("is_active OR was_active OR member AND signup_date BETWEEN period_start AND period_end")
    )
    month_bits = calendar.bitmap_lengths(longest)["month"]
    months = []
    for low in range(0, month_bits, calendar.WORD_BITS):
        held = [
            calendar.any_set([f"{d} & coalesce(get(get(months, {n}), {k}), 0L)" for k, d in enumerate(_day_names(longest))])
            for n in range(low, min(month_bits, low + calendar.WORD_BITS))
        ]
        months.append(" | ".join(f"CASE WHEN {h} THEN {1 << n}L ELSE 0L END" for n, h in enumerate(held)))
    with_months = cut.selectExpr(
        "*", *(f"{word} AS {name}" for word, name in zip(months, calendar.word_names("month", month_bits)))
    ).drop("months")
    return with_months.withColumn("active_days", F.expr(rollup.active_units(longest)["day"]))


def _day_names(longest: int) -> list[str]:
    return calendar.word_names("day", calendar.bitmap_lengths(longest)["day"])


def _usage_and_retention(
    activity: DataFrame,
    users: DataFrame,
    periods: Sequence[Period],
    by: str | None,
    features: Sequence[str],
    first: DataFrame | None,
) -> DataFrame:
    """All counts per period and segment, retention among them, from one row per user."""
    keys = _keys(by)
    sums, averages = rollup.average_active_users(max(p.days for p in periods))
    signed = "member AND signup_date BETWEEN period_start AND period_end"
    counts = {"total_signups": signed, "signups": f"{signed} AND user_id IS NOT NULL"}
    for name, days in HORIZONS.items():
        counts[f"{name}_users"] = (
            f"{signed} AND user_id IS NOT NULL AND first_return <= period_end "
            f"AND date_diff(first_return, signup_date) <= {days}"
        )
    counted = (
        _user_periods(activity, users, periods, by, features, first)
        .groupBy(*keys)
        .agg(
            *period_counts(features, "first_ever BETWEEN period_start AND period_end"),
            *sums,
            *dormancy.dormancy_counts(features),
            *rollup.count_where(counts),
        )
        .withColumns(averages)
    )
    measures = [*comprehensive_columns(features), *dormancy_columns(features), "signups", *(f"{n}_users" for n in HORIZONS)]
    found = counted.select(*keys, *measures)
    if by:
        return found
    # Every period has a row; averages stay NULL without activity.
    listed = found.unionByName(period_frame(activity.sparkSession, periods), allowMissingColumns=True)
    return listed.groupBy(*keys).agg(
        *(
            F.expr(f"max({m}) AS {m}" if m in averages else f"coalesce(max({m}), 0) AS {m}")
            for m in measures
        )
    )


def usage_by_period(
    activity: DataFrame,
    users: DataFrame,
    periods: Sequence[Period],
    by: str | None = None,
    features: Sequence[str] = FEATURES,
    first: DataFrame | None = None,
) -> DataFrame:
    """Engagement and dormancy counts per period, and per value of user column ``by``.

    Every period has a row when ``by`` is None; otherwise the pairs that occur do.
    Activity without a registered user falls into the NULL segment. With ``first``, a
    `first_seen` frame of the time before, no activity before the first history is read.
    """
    counted = _usage_and_retention(activity, users, periods, by, features, first)
    return counted.select(*_keys(by), *comprehensive_columns(features), *dormancy_columns(features))


def retention_by_period(
    activity: DataFrame,
    users: DataFrame,
    periods: Sequence[Period],
    by: str | None = None,
) -> DataFrame:
    """Signups per period with retention percentages, seen up to the period's end."""
    keys = _keys(by)
    reach = Period(min(p.start for p in periods), max(p.end for p in periods))
    signups = signups_within(users, reach, *([by] if by else []))
    counted = (
        first_returns(signups, activity, reach, "left")
        .select("*", F.inline(_holding_signup(periods)))
        .groupBy(*keys)
        .agg(F.count("*").alias("total_signups"), *retained_counts(F.col("period_end")))
    )
    percents = {n: c for n, c in retention_ratios().items() if n.endswith("_percent")}
    return counted.select(*keys, *(c.alias(n) for n, c in percents.items()))


def kpi_long(
    usage: DataFrame, by: str | None = None, features: Sequence[str] = FEATURES
) -> DataFrame:
    """``usage_by_period`` as ``(period_start, period_end[, by], metric, value)``."""
    measures = [*comprehensive_columns(features), *dormancy_columns(features)]
    keys = _keys(by)
    doubles = usage.selectExpr(*keys, *(f"CAST({m} AS double) AS {m}" for m in measures))
    return doubles.unpivot(keys, measures, "metric", "value")


@dataclass(frozen=True)
class Rule:
    """``outcome`` holds when ``value <op> bound``; the first rule that holds wins.

    A rule without an operator always holds.
    """

    op: str | None
    bound: float
    outcome: str


def otherwise(outcome: str) -> Rule:
    return Rule(None, 0.0, outcome)


def first_match(value: str, rules: Sequence[Rule]) -> str:
    """SQL for the outcome of the first rule that holds."""
    if rules[-1].op is not None:
        raise ValueError("the last rule must always hold")
    last = quoted(rules[-1].outcome)
    if len(rules) == 1:
        return last
    branches = (f"WHEN {value} {r.op} {r.bound} THEN {quoted(r.outcome)}" for r in rules[:-1])
    return f"CASE {' '.join(branches)} ELSE {last} END"


# Alert level per metric, from percentages. First match wins.
ALERT_RULES: dict[str, list[Rule]] = {
    "conversion_rate": [Rule("<", 20, "high"), Rule("<", 40, "medium"), otherwise("low")],
    "adoption_rate": [Rule(">", 80, "high"), Rule(">", 50, "medium"), otherwise("low")],
    "spending_share": [Rule(">", 40, "low"), Rule("<", 20, "medium"), otherwise("info")],
    "assistant_share": [Rule(">", 30, "low"), Rule("<", 10, "medium"), otherwise("info")],
    "savings_share": [Rule(">", 25, "low"), Rule("<", 15, "medium"), otherwise("info")],
    "investment_share": [Rule(">", 20, "low"), Rule("<", 8, "medium"), otherwise("info")],
    "single_feature_share": [Rule(">", 60, "medium"), Rule("<", 40, "low"), otherwise("info")],
    "multiple_feature_share": [Rule(">", 40, "low"), Rule("<", 20, "medium"), otherwise("info")],
    "most_used_share": [Rule(">", 60, "low"), otherwise("info")],
    "least_used_share": [Rule("<", 15, "high"), Rule("<", 25, "medium"), otherwise("info")],
    "only_spending_share": [Rule(">", 10, "info"), otherwise("medium")],
    "only_assistant_share": [Rule(">", 5, "info"), otherwise("medium")],
    "only_savings_share": [Rule(">", 8, "info"), otherwise("medium")],
    "only_investment_share": [Rule(">", 3, "info"), otherwise("medium")],
    "dormant_share": [Rule(">", 40, "high"), Rule(">", 20, "medium"), otherwise("low")],
    "reactivation_rate_ref": [Rule(">", 60, "low"), Rule(">", 40, "medium"), otherwise("high")],
    "spending_dormant_share": [Rule(">", 30, "high"), Rule(">", 15, "medium"), otherwise("low")],
    "savings_dormant_share": [Rule(">", 30, "high"), Rule(">", 15, "medium"), otherwise("low")],
    "investment_dormant_share": [Rule(">", 30, "high"), Rule(">", 15, "medium"), otherwise("low")],
    "assistant_dormant_share": [Rule(">", 30, "high"), Rule(">", 15, "medium"), otherwise("low")],
}

# The sentence next to each alert, with its own cut-offs. ``{value}``
# is the percentage with one decimal, ``{least}`` the least used feature.
INSIGHT_RULES: dict[str, list[Rule]] = {
    "conversion_rate": [
        Rule("<", 20, "Critical: Improve onboarding flow"),
        Rule("<", 40, "Good: Focus on activation campaigns"),
        otherwise("Excellent: Maintain current strategy"),
    ],
    "adoption_rate": [
        Rule(">", 80, "High new user acquisition"),
        Rule(">", 50, "Balanced user growth"),
        otherwise("Focus on user retention"),
    ],
    "spending_share": [
        Rule(">", 40, "Strong spending engagement"),
        Rule("<", 20, "Consider spending feature promotion"),
        otherwise("Normal spending usage"),
    ],
    "assistant_share": [
        Rule(">", 30, "High AI engagement"),
        Rule("<", 10, "Boost assistant adoption"),
        otherwise("Steady AI usage"),
    ],
    "savings_share": [
        Rule(">", 25, "Strong savings culture"),
        Rule("<", 15, "Promote savings features"),
        otherwise("Healthy savings usage"),
    ],
    "investment_share": [
        Rule(">", 20, "High investment engagement"),
        Rule("<", 8, "Focus on investment adoption"),
        otherwise("Growing investment usage"),
    ],
    "single_feature_share": [
        Rule(">", 50, "Opportunity to cross-sell other features"),
        otherwise("Good feature adoption balance"),
    ],
    "multiple_feature_share": [
        Rule(">", 40, "High engagement users - focus on retention"),
        otherwise("Potential to increase feature adoption"),
    ],
    "most_used_share": [otherwise("Leading feature - leverage for marketing campaigns")],
    "least_used_share": [
        Rule("<", 20, "Focus on improving {least} adoption"),
        otherwise("Consider feature enhancement"),
    ],
    "only_spending_share": [
        Rule(">", 15, "Cross-sell savings/investment features"),
        otherwise("Normal spending-only user segment"),
    ],
    "only_assistant_share": [
        Rule(">", 10, "Engage with financial planning features"),
        otherwise("AI-only users segment"),
    ],
    "only_savings_share": [
        Rule(">", 12, "Introduce spending tracking"),
        otherwise("Savings-focused user segment"),
    ],
    "only_investment_share": [
        Rule(">", 5, "High-value users - premium features"),
        otherwise("Investment-focused segment"),
    ],
    "dormant_share": [
        Rule(">", 40, "Critical: {value}% of historical users are dormant"),
        Rule(">", 20, "Moderate: {value}% dormant users"),
        otherwise("Good: Only {value}% dormant users"),
    ],
    "reactivation_rate_ref": [
        Rule(">", 60, "Strong user retention"),
        Rule(">", 40, "Moderate retention"),
        otherwise("Focus on re-engagement"),
    ],
    "spending_dormant_share": [
        Rule(">", 30, "High spending churn"),
        Rule(">", 15, "Moderate spending churn"),
        otherwise("Low spending churn"),
    ],
    "savings_dormant_share": [
        Rule(">", 30, "High savings churn"),
        Rule(">", 15, "Moderate savings churn"),
        otherwise("Low savings churn"),
    ],
    "investment_dormant_share": [
        Rule(">", 30, "High investment churn"),
        Rule(">", 15, "Moderate investment churn"),
        otherwise("Low investment churn"),
    ],
    "assistant_dormant_share": [
        Rule(">", 30, "High assistant churn"),
        Rule(">", 15, "Moderate assistant churn"),
        otherwise("Low assistant churn"),
    ],
}


def _features_by_users(features: Sequence[str], labels: dict[str, str], sign: int) -> Column:
    return F.array(
        *(
            F.struct(
                F.col(f"{f}_users").alias("users"),
                F.lit(sign * place).alias("place"),
                F.lit(label_of(f, labels)).alias("name"),
            )
            for place, f in enumerate(features)
        )
    )


def most_used(features: Sequence[str], labels: dict[str, str]) -> Column:
    """``(users, place, name)`` of the feature with most users, first declared on ties."""
    return F.array_max(_features_by_users(features, labels, -1))


def least_used(features: Sequence[str], labels: dict[str, str]) -> Column:
    """``(users, place, name)`` of the feature with fewest users, first declared on ties."""
    return F.array_min(_features_by_users(features, labels, 1))


def feature_ranking(
    usage: DataFrame,
    by: str | None = None,
    features: Sequence[str] = FEATURES,
    labels: dict[str, str] = FEATURE_LABELS,
) -> DataFrame:
    """Most and least used feature with users and share of active users, and alerts.

    Equal counts go to the feature declared first. No row without active users.
    """
    active = F.col("total_active_users")
    most, least = most_used(features, labels), least_used(features, labels)
    columns = {
        "most_used_feature": most["name"],
        "most_used_count": most["users"],
        "most_used_pct": percent(most["users"], active),
        "least_used_feature": least["name"],
        "least_used_count": least["users"],
        "least_used_pct": percent(least["users"], active),
    }
    return (
        usage.filter(active > 0)
        .select(*_keys(by), *(c.alias(n) for n, c in columns.items()))
        .selectExpr(
            "*",
            f"{first_match('most_used_pct', ALERT_RULES['most_used_share'])} AS most_used_alert",
            f"{first_match('least_used_pct', ALERT_RULES['least_used_share'])} AS least_used_alert",
        )
    )


def derived_rates(features: Sequence[str] = FEATURES) -> dict[str, str]:
    """SQL of the percentages the alert rules judge; NULL where a metric does not exist."""
    users = ", ".join(f"{f}_users" for f in features)
    exists = "WHEN total_active_users > 0 THEN"
    return {
        "conversion_rate": sql_percent("first_time_users", "total_signups"),
        "adoption_rate": f"least({sql_percent('first_time_users', 'total_active_users')}, 100D)",
        **{f"{f}_share": sql_percent(f"{f}_users", "total_active_users") for f in features},
        "single_feature_share": sql_percent("single_feature_users", "total_active_users"),
        "multiple_feature_share": sql_percent("multiple_feature_users", "total_active_users"),
        "most_used_share": f"CASE {exists} greatest({users}) / total_active_users * 100 END",
        "least_used_share": f"CASE {exists} least({users}) / total_active_users * 100 END",
        **{f"only_{f}_share": sql_percent(f"only_{f}_users", "total_active_users") for f in features},
        "dormant_share": sql_percent("overall_dormant_users", "total_historical_users"),
        # As the source reports define it: period actives include newcomers, so this
        # may turn negative or pass 100.
        "reactivation_rate_ref": sql_percent(
            "(total_current_users - overall_dormant_users)", "total_historical_users"
        ),
        **{
            f"{f}_dormant_share": sql_percent(f"{f}_dormant_users", "overall_dormant_users")
            for f in features
        },
    }


def kpi_alerts(
    usage: DataFrame,
    by: str | None = None,
    features: Sequence[str] = FEATURES,
    labels: dict[str, str] = FEATURE_LABELS,
    alert_rules: Mapping[str, Sequence[Rule]] | None = None,
    insight_rules: Mapping[str, Sequence[Rule]] | None = None,
) -> DataFrame:
    """Each derived percentage with its alert level and sentence, one row per metric.

    Rules default to ``ALERT_RULES`` and ``INSIGHT_RULES``. A metric without rules, such as
    the share of a feature they do not know, has a NULL alert or insight.
    """
    alert_rules = ALERT_RULES if alert_rules is None else alert_rules
    insight_rules = INSIGHT_RULES if insight_rules is None else insight_rules
    keys = _keys(by)
    rates = derived_rates(features)
    least = F.lower(least_used(features, labels)["name"]).alias("least")
    judged = (
        usage.select(*keys, least, *(F.expr(sql).alias(metric) for metric, sql in rates.items()))
        .unpivot([*keys, "least"], list(rates), "metric", "value")
        .filter(F.col("value").isNotNull())
    )

    def by_metric(rules: Mapping[str, Sequence[Rule]]) -> Column:
        branches = [f"WHEN '{m}' THEN {first_match('value', rules[m])}" for m in rates if m in rules]
        return F.expr(f"CASE metric {' '.join(branches)} END" if branches else "CAST(NULL AS string)")

    insight = F.replace(by_metric(insight_rules), F.lit("{least}"), F.col("least"))
    insight = F.replace(insight, F.lit("{value}"), one_decimal_text(F.col("value")))
    return judged.select(
        *keys, "metric", "value", by_metric(alert_rules).alias("alert"), insight.alias("insight")
    )


@dataclass(frozen=True)
class Advice:
    """Texts of one insight or recommendation; ``{value}`` as in the rules."""

    rule_id: str
    title: str
    insight: str
    recommendation: str


# Insight texts.
LOW_ACTIVATION = Advice(
    "low_activation", "Low Activation Rate Alert",
    "Only {value}% of signups become active users.",
    "Improve onboarding flow and feature discovery.",
)
HIGH_ACTIVATION = Advice(
    "high_activation", "Excellent Activation Rate",
    "{value}% activation rate shows strong product-market fit.",
    "Scale marketing efforts and maintain current onboarding quality.",
)
LOW_DAY1 = Advice(
    "low_day1_retention", "Day 1 Retention Needs Attention",
    "Only {value}% of users return the next day.",
    "Implement push notifications and email sequences for new users.",
)
HIGH_WEEK1 = Advice(
    "high_week1_retention", "Strong Week 1 Retention",
    "{value}% of users return within a week.",
    "Focus on converting these engaged users to power users.",
)

# Recommendation texts; ``{label}`` is the feature's label.
HIGH_DORMANCY = Advice(
    "high_dormancy", "High Dormant User Rate",
    "{value}% of historical users are dormant",
    "Implement aggressive re-engagement campaigns including email sequences, "
    "push notifications, and personalized offers",
)
FEATURE_CHURN = Advice(
    "feature_churn", "High {label} Churn",
    "{value}% of dormant users were {label} users",
    "Focus on {label} feature improvements and targeted re-engagement for {label} users",
)
GOOD_RETENTION = Advice(
    "good_retention", "Good User Retention",
    "Dormant user rates are within acceptable ranges",
    "Continue current retention strategies and monitor for any changes",
)

# Percentages.
ACTIVATION_LOW, ACTIVATION_HIGH = 30, 70
DAY1_LOW, WEEK1_HIGH = 20, 50
DORMANCY_HIGH, FEATURE_CHURN_HIGH = 30, 25


def _advice_if(condition: str, advice: Advice, value: str, label: str = "") -> str:
    """SQL for a row of advice, NULL unless the condition holds."""
    texts = {
        "rule_id": advice.rule_id,
        "title": advice.title,
        "insight": advice.insight,
        "recommendation": advice.recommendation,
    }
    fields = ", ".join(
        f"'{name}', {quoted(text.replace('{label}', label))}" for name, text in texts.items()
    )
    return f"CASE WHEN {condition} THEN named_struct({fields}, 'value', {value}) END"


def _advice_rows(frame: DataFrame, keys: list[str], advice: Column) -> DataFrame:
    text = F.replace("insight", F.lit("{value}"), one_decimal_text(F.col("value")))
    return frame.select(*keys, F.inline(advice)).select(
        *keys, "rule_id", "title", text.alias("insight"), "recommendation"
    )


def insights(
    activity: DataFrame,
    users: DataFrame,
    periods: Sequence[Period],
    by: str | None = None,
    features: Sequence[str] = FEATURES,
    first: DataFrame | None = None,
) -> DataFrame:
    """Activation and retention insights per period, from one pass over activity and users.

    Activation is judged only with signups. Missing or zero retention counts as 0,
    so the day-1 rule then applies. ``first`` as in `usage_by_period`.
    """
    counted = _usage_and_retention(activity, users, periods, by, features, first)
    percents = (F.expr(f"{sql_percent(f'{n}_users', 'signups')} AS {n}_percent") for n in HORIZONS)
    measured = counted.select(*_keys(by), "total_signups", "total_active_users", *percents)
    return _advice_rows(measured, _keys(by), F.expr(_usage_advice()))


def _usage_advice() -> str:
    """SQL for the array of insights that hold for a row of usage and retention."""
    activation = sql_percent("total_active_users", "total_signups")
    day1, week1 = "coalesce(day1_percent, 0D)", "coalesce(week1_percent, 0D)"
    fired = [
        _advice_if(
            f"total_signups > 0 AND {activation} < {ACTIVATION_LOW}", LOW_ACTIVATION, activation
        ),
        _advice_if(
            f"total_signups > 0 AND {activation} > {ACTIVATION_HIGH}", HIGH_ACTIVATION, activation
        ),
        _advice_if(f"{day1} < {DAY1_LOW}", LOW_DAY1, day1),
        _advice_if(f"{week1} > {WEEK1_HIGH}", HIGH_WEEK1, week1),
    ]
    return f"array_compact(array({', '.join(fired)}))"


def usage_insights(usage: DataFrame, retained: DataFrame, by: str | None = None) -> DataFrame:
    """Insights from finished `usage_by_period` and `retention_by_period` frames."""
    keys = _keys(by)
    # One row per period and segment on either side; stacking them keeps NULL
    # segments together, which an equi-join would not.
    measured = usage.select(*keys, "total_signups", "total_active_users").unionByName(
        retained.select(*keys, *(f"{h}_percent" for h in HORIZONS)), allowMissingColumns=True
    )
    columns = [c for c in measured.columns if c not in keys]
    merged = measured.groupBy(*keys).agg(*(F.max(c).alias(c) for c in columns))
    return _advice_rows(merged, keys, F.expr(_usage_advice()))


def feature_insights(retained: DataFrame) -> DataFrame:
    """Retention insights per feature, from `retention_by_feature`.

    Features have no signups of their own, so activation is never judged for them.
    """
    fired = [
        _advice_if(f"day1_percent < {DAY1_LOW}", LOW_DAY1, "day1_percent"),
        _advice_if(f"week1_percent > {WEEK1_HIGH}", HIGH_WEEK1, "week1_percent"),
    ]
    advice = F.expr(f"array_compact(array({', '.join(fired)}))")
    return _advice_rows(retained, ["feature"], advice)


def recommendations(
    usage: DataFrame,
    by: str | None = None,
    features: Sequence[str] = FEATURES,
    labels: dict[str, str] = FEATURE_LABELS,
) -> DataFrame:
    """Re-engagement recommendations per period; a single good-news row if none fires."""
    rates = derived_rates(features)
    overall = rates["dormant_share"]
    fired = [_advice_if(f"{overall} > {DORMANCY_HIGH}", HIGH_DORMANCY, overall)]
    for f in features:
        share = rates[f"{f}_dormant_share"]
        fired.append(
            _advice_if(f"{share} > {FEATURE_CHURN_HIGH}", FEATURE_CHURN, share, label_of(f, labels))
        )
    found = F.expr(f"array_compact(array({', '.join(fired)}))")
    default = F.expr(f"array({_advice_if('true', GOOD_RETENTION, '0D')})")
    advice = F.when(F.size(found) > 0, found).otherwise(default)
    return _advice_rows(usage, _keys(by), advice)
