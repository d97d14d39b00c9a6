"""Survey submissions and feedback.

Submissions are ``(created_at, metadata)``, feedback ``(created_at, reaction,
comment)``; ``metadata`` is JSON text, see ``functions.survey_json``. Points in time have
their day in ``zone``, whatever the session's.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagepulse.functions.calendar import Period
from usagepulse.functions.numeric import capitalize
from usagepulse.functions.survey_json import answered_count
from usagepulse.functions.zones import ZONE, day_of


def _within(frame: DataFrame, start: date | str, end: date | str, zone: str) -> DataFrame:
    return frame.filter(Period.of(start, end).holds(day_of(frame, "created_at", zone)))


def answer_counts(
    submissions: DataFrame, start: date | str, end: date | str, zone: str = ZONE
) -> DataFrame:
    """Submissions of the period per number of answered questions."""
    return (
        _within(submissions, start, end, zone)
        .groupBy(answered_count(F.col("metadata")).alias("answers"))
        .agg(F.count("*").alias("submissions"))
    )


def survey_completion(
    submissions: DataFrame, start: date | str, end: date | str, zone: str = ZONE
) -> DataFrame:
    """Submissions of the period, and how many answered as many questions as any did.

    If nobody answers anything, every submission counts as completed. Aggregates by
    number of answers first, so the maximum and its frequency need one pass.
    """
    return answer_counts(submissions, start, end, zone).agg(
        F.coalesce(F.sum("submissions"), F.lit(0)).alias("submissions"),
        F.coalesce(F.max_by("submissions", "answers"), F.lit(0)).alias("completed"),
    )


def daily_submissions(
    submissions: DataFrame, start: date | str, end: date | str, zone: str = ZONE
) -> DataFrame:
    return (
        _within(submissions, start, end, zone)
        .groupBy(day_of(submissions, "created_at", zone).alias("submission_date"))
        .agg(F.count("*").alias("submissions"))
        .orderBy("submission_date")
    )


def reaction_counts(
    feedback: DataFrame, start: date | str, end: date | str, zone: str = ZONE
) -> DataFrame:
    """Feedback per reaction, most frequent first; a missing reaction is not counted."""
    return (
        _within(feedback, start, end, zone)
        .filter(F.col("reaction").isNotNull())
        .groupBy("reaction")
        .agg(F.count("*").alias("reactions"))
        .orderBy(F.desc("reactions"), "reaction")
    )


def feedback_list(
    feedback: DataFrame, start: date | str, end: date | str, zone: str = ZONE
) -> DataFrame:
    """Capitalised reaction, comment and date of the period's feedback."""
    return _within(feedback, start, end, zone).select(
        capitalize(F.col("reaction")).alias("reaction"),
        "comment",
        day_of(feedback, "created_at", zone).alias("feedback_date"),
    )
