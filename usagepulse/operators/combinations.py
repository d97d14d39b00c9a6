"""Which features are used together."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagepulse.functions.calendar import Period
from usagepulse.operators import rollup
from usagepulse.sources.registry import FEATURES

HIGH_USAGE_PERCENT = 15


def feature_combinations(
    activity: DataFrame,
    start: date | str,
    end: date | str,
    features: Sequence[str] = FEATURES,
) -> DataFrame:
    """Users per combination of two or more features, with their share in percent.

    ``band`` marks the most used combination (``top``; equal counts go to the first
    name) and others above 15 % (``high``).
    """
    period = Period.of(start, end)
    recent = activity.filter(period.holds(F.col("activity_date")))
    per_user = (
        rollup.numbered_features(recent, features)
        .groupBy("user_id")
        .agg(*rollup.feature_marks("true", "uses", features))
        .filter(f"{rollup.count_of_features('uses', features)} > 1")
    )
    flags = rollup.feature_flags("uses", features)
    names = [F.when(F.expr(flags[f]), F.lit(f)) for f in sorted(features)]
    counted = (
        per_user.groupBy(F.concat_ws(" + ", *names).alias("feature_combination"))
        .agg(F.count("*").alias("user_count"))
    )
    # There may be 2^features combinations, so none is numbered or sorted: the total and
    # the leader are one mergeable aggregate over the same counts, read as a scalar.
    whole = counted.agg(
        F.struct(F.sum("user_count").alias("users"), F.min(_place()).alias("leader"))
    ).scalar()
    share = F.round(
        F.col("user_count") * F.lit(100).cast("decimal(20,1)") / whole["users"], 2
    )
    leads = F.col("feature_combination") == whole["leader"]["feature_combination"]
    return counted.select("*", share.cast("double").alias("percentage")).withColumn(
        "band",
        F.when(leads, "top")
        .when(F.col("percentage") > HIGH_USAGE_PERCENT, "high")
        .otherwise(""),
    )


def _place() -> Column:
    """Orders combinations by users, most first, then by name."""
    return F.struct((-F.col("user_count")).alias("order"), "feature_combination")


def combination_highlights(combinations: DataFrame) -> DataFrame:
    """The leading combination, how many there are, and the share of the first two.

    No row without combinations; ``top2_percentage`` is NULL when there is one.
    """
    # Each partition keeps its best two, and the best two of those remain.
    best = combinations.orderBy(F.desc("user_count"), "feature_combination").limit(2)
    total = combinations.agg(F.count("*")).scalar()
    return (
        best.agg(
            F.min_by(F.struct("feature_combination", "user_count", "percentage"), _place()).alias("top"),
            F.when(F.count("*") == 2, F.sum("percentage")).alias("top2_percentage"),
        )
        .filter("top IS NOT NULL")
        .select(
            F.col("top.feature_combination").alias("top_combination"),
            F.col("top.user_count").alias("top_user_count"),
            F.col("top.percentage").alias("top_percentage"),
            total.alias("total_combinations"),
            "top2_percentage",
        )
    )
