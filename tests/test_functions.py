"""Rounding, text and JSON helpers against plain Python."""

import json
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from usagepulse.functions import calendar
from usagepulse.functions.numeric import capitalize, one_decimal_text, round1_half_even
from usagepulse.functions.survey_json import answered_count
from usagepulse.operators import rollup, survey
from usagepulse.operators.engagement import positions_in


def test_one_decimal_rounding(spark):
    rng = random.Random(5)
    values = [a / b * 100 for a in range(0, 80) for b in (7, 16, 80, 400, 2000)]
    values += [rng.uniform(0, 200) for _ in range(500)] + [k / 20 for k in range(400)]
    values += [0.0, 0.05, 0.15, 0.25, 0.35, 6.25, 99.95, 99.949999999999, 1e6 + 0.05, -0.04, -12.25]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    found = frame.select("v", one_decimal_text(F.col("v")), round1_half_even(F.col("v"))).collect()
    for v, text, rounded in found:
        assert text == f"{v:.1f}"
        assert rounded == np.round(v, 1)


@pytest.mark.parametrize("text", ["GREAT stuff", "x", "", "éa B", "many Words here"])
def test_capitalize(spark, text):
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(capitalize(F.col("t"))).first()[0] == text.capitalize()


# Submissions and the answers each one counts, worked out by hand.
SUBMISSIONS = {
    "bad": 0, None: 0, "": 0, "[1]": 0, "7": 0, '"plan"': 0, "{}": 0,
    '{"plan":{"a":1}}': 0, '{"plan":null}': 0, '{"plan":[]}': 0, '{"plan":"text"}': 0,
    '{"other":[{"question":"q","answer":1}]}': 0,
    # An entry without question or answer voids the whole record.
    '{"plan":[{"answer":1},{"question":"q","answer":2}]}': 0,
    '{"plan":[{"question":"q"},{"question":"r","answer":2}]}': 0,
    '{"plan":[{"question":"q","answer":[]},{"question":"r","answer":0},3]}': 1,
    # The last answer to a question stands.
    '{"plan":[{"question":"q","answer":null},{"question":"q","answer":"z"}]}': 1,
    '{"plan":[{"question":"q","answer":"z"},{"question":"q","answer":null}]}': 0,
    # So does a question that is a list or an object.
    '{"plan":[{"question":["q"],"answer":"z"},{"question":"r","answer":"z"}]}': 0,
    '{"plan":[{"question":{"a":1},"answer":"z"}]}': 0,
    '{"plan":[{"question":null,"answer":"z"},{"question":null,"answer":""}]}': 0,
    '{"plan":[{"question":"[q","answer":"z"},{"question":"{r","answer":false}]}': 2,
    '{"plan":[{"question":"q","answer":{}},{"question":"r","answer":{"a":null}},{"question":"s","answer":[null]}]}': 2,
    # NaN and infinities are answers; the last value of a repeated key stands.
    '{"plan":[{"question":"q","answer":NaN},{"question":"r","answer":-Infinity},{"question":"s","answer":""}]}': 2,
    '{"plan":[{"question":"q","answer":1,"answer":""},{"question":"r","answer":null,"answer":0}]}': 1,
    '{"plan":[{"question":"q","answer":1}],"plan":[]}': 0,
    '{"plan":[],"plan":[5,"x",null,[1],{"question":"q","answer":{"a":1,"a":2}},{"question":"r","answer":[]}]}': 1,
    '{"plan":[{"question":"q","question":"r","answer":1},{"question":"r","answer":null}]}': 0,
    '{"plan":[{"question":["q"],"answer":NaN}]}': 0,
    '{"plan":[{"question":"q","answer":NaN},{"question":"r"}]}': 0,
    '{"plan":[{"question":"q","answer":"null","answer":"[]"}]}': 1,
    '{"plan":[{"question":"q","answer":1}],"note":NaN,"note":{"a":1,"a":2}}': 1,
    # Still no JSON: something after the document, a comma too many, single quotes, nan.
    '{"plan":[{"question":"q","answer":NaN}]} x': 0,
    '{"plan":[{"question":"q","answer":NaN}]}{}': 0,
    '{"plan":[{"question":"q","answer":NaN}],}': 0,
    '{"plan":[{"question":"q","answer":NaN}]': 0,
    "{'plan':[{'question':'q','answer':1}]}": 0,
    '{"plan":[{"question":"q","answer":nan}]}': 0,
    '{"plan":[{"question":"q","answer":" "},"x",null,[1],{"question":"é\\n","answer":"null"}]}': 2,
}


def test_answered_count_on_odd_documents(spark):
    frame = spark.createDataFrame([(s,) for s in SUBMISSIONS], "metadata string")
    found = frame.select("metadata", answered_count(F.col("metadata"))).collect()
    assert {r[0]: r[1] for r in found} == SUBMISSIONS


def test_answered_count_on_random_documents(spark):
    """The generator knows what it builds: each question's last answer, and whether a void
    entry went in."""
    rng = random.Random(11)
    full, empty = [0, False, "a", [0], {"k": 1}, 2.5, "null", "[]"], [None, "", [], {}]
    cases = []
    for _ in range(300):
        plan, stands, void = [], [False] * 4, False
        for _ in range(rng.randrange(9)):
            kind = rng.random()
            if kind < 0.02:
                plan.append({"question": "q0"})
                void = True
            elif kind < 0.05:
                plan.append(rng.choice([3, "s", None]))
            else:
                place, counts = rng.randrange(4), rng.random() < 0.6
                plan.append({"question": f"q{place}", "answer": rng.choice(full if counts else empty)})
                stands[place] = counts
        cases.append((json.dumps({"plan": plan}), 0 if void else stands.count(True)))
    frame = spark.createDataFrame(cases, "metadata string, expected int")
    found = frame.select("metadata", "expected", answered_count(F.col("metadata"))).collect()
    assert [r[2] for r in found] == [r.expected for r in found]


def test_long_document_is_counted_whole(spark):
    document = json.dumps({"plan": [{"question": f"q{i % 15000}", "answer": i} for i in range(20000)]})
    frame = spark.createDataFrame([(document,)], "metadata string")
    assert frame.select(answered_count(F.col("metadata"))).first()[0] == 15000


def test_survey_reports(spark):
    plan = '{"plan":[{"question":"q","answer":"a"}]}'
    submissions = spark.createDataFrame(
        [("2024-03-01 00:00:00", plan), ("2024-03-02 23:59:59", "{}"), ("2024-03-03 00:00:00", plan)],
        "at string, metadata string",
    ).selectExpr("to_timestamp(at) AS created_at", "metadata")
    assert survey.survey_completion(submissions, "2024-03-01", "2024-03-02").first() == (2, 1)
    # Nobody answered: the largest count is 0 and everyone reached it.
    assert survey.survey_completion(submissions, "2024-03-02", "2024-03-02").first() == (1, 1)
    assert survey.survey_completion(submissions, "2020-03-02", "2020-03-02").first() == (0, 0)
    feedback = submissions.selectExpr("created_at", "IF(metadata = '{}', NULL, 'LIKED it') AS reaction", "metadata AS comment")
    assert [tuple(r) for r in survey.reaction_counts(feedback, "2024-03-01", "2024-03-03").collect()] == [("LIKED it", 2)]
    listed = survey.feedback_list(feedback, "2024-03-01", "2024-03-02").collect()
    assert sorted(str(r["reaction"]) for r in listed) == ["Liked it", "None"]


def test_bitmaps_count_days_weeks_and_months(spark):
    rng = random.Random(3)
    for days in (1, 2, 9, 31, 58, 64, 200):
        start = date(2024, 1, 1) + timedelta(days=rng.randrange(400))
        period = calendar.Period(start, start + timedelta(days=days - 1))
        dates = {start + timedelta(days=rng.randrange(days)) for _ in range(days // 2 + 1)}
        dates |= {period.start, period.end}
        frame = spark.createDataFrame([(str(d),) for d in dates], "d string").selectExpr(
            "to_date(d) AS activity_date"
        )
        marked = frame.agg(*rollup.calendar_marks("true", positions_in(period), period.days))
        units = rollup.active_units(period.days)
        found = marked.selectExpr(*(f"{sql} AS {unit}" for unit, sql in units.items())).first()
        assert found["day"] == len(dates)
        assert found["week"] == len({d - timedelta(days=d.weekday()) for d in dates})
        assert found["month"] == len({(d.year, d.month) for d in dates})


def test_month_bits_fit_every_alignment():
    for days in (1, 2, 28, 29, 30, 31, 59, 62, 366):
        for shift in range(0, 800, 3):
            start = date(2023, 1, 1) + timedelta(days=shift)
            end = start + timedelta(days=days - 1)
            months = (end.year - start.year) * 12 + end.month - start.month + 1
            assert months <= calendar.bitmap_lengths(days)["month"]
