import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from usagepulse.session import local_session  # noqa: E402

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def activity_of(spark):
    """Activity frame from ``(user, ISO date, feature)`` tuples."""

    def build(rows):
        return spark.createDataFrame(
            list(rows), "user_id string, day string, feature string"
        ).selectExpr("user_id", "to_date(day) AS activity_date", "feature")

    return build


@pytest.fixture
def users_of(spark):
    """Users frame from ``(user, ISO date, restricted)`` tuples."""

    def build(rows):
        return spark.createDataFrame(
            list(rows), "user_id string, day string, restricted boolean"
        ).selectExpr("user_id", "to_date(day) AS signup_date", "restricted")

    return build
