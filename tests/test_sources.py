"""Readers and the stored fact."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from usagepulse.operators import engagement
from usagepulse.plans.profiles import consumer_finance_sources
from usagepulse.sources.registry import FeatureSource, build_events
from usagepulse.sources.tables import (
    catalog_reader,
    jdbc_reader,
    parquet_reader,
    read_activity,
    write_activity,
)


def test_stored_fact_round_trip_prunes_dates(spark, activity_of, tmp_path):
    rows = [("a", "2024-03-04", "spending"), ("b", "2024-02-04", "savings"), (None, "2024-03-05", "spending")]
    path = str(tmp_path / "activity")
    write_activity(activity_of(rows), path)
    stored = read_activity(spark, path)
    assert sorted(map(repr, (r[0] for r in stored.select("user_id").collect()))) == ["'a'", "'b'", "None"]
    churned = engagement.churn_count(stored, "2024-03-01", "2024-03-31")
    assert churned.first()[0] == 2
    pruned = stored.filter("activity_date >= DATE'2024-03-01'")
    assert "PartitionFilters: [isnotnull(activity_date" in pruned._jdf.queryExecution().toString()
    assert pruned.count() == 2


def test_parquet_reader_opens_a_table_once(spark):
    read = parquet_reader(spark, "/root/testdata/sf0.001")
    assert read("nation") is read("nation")


def test_catalog_reader(spark):
    spark.range(3).createOrReplaceTempView("three_rows")
    assert catalog_reader(spark)("three_rows").count() == 3


def test_jdbc_reader_splits_declared_tables():
    class Recorder:
        """Stands in for the session and its reader."""

        def __init__(self):
            self.calls = []

        @property
        def read(self):
            return self

        def format(self, name):
            self.calls.append(name)
            return self

        def options(self, **options):
            self.calls.append(options)
            return self

        def load(self):
            return self.calls[-1]

    split = {"partitionColumn": "id", "lowerBound": "0", "upperBound": "9", "numPartitions": "3"}
    read = jdbc_reader(Recorder(), {"url": "jdbc:x"}, {"transactions": split}, small=["users"])
    assert read("users") == {"url": "jdbc:x", "dbtable": "users"}
    assert read("transactions") == {"url": "jdbc:x", "dbtable": "transactions", **split}
    with pytest.raises(ValueError):
        read("messages")


def test_the_day_of_a_point_in_time_ignores_the_session_zone(spark):
    """Half past eleven at night in UTC, and the hour that clocks in Berlin repeat."""
    points = [1709335800, 1729985400, 1729989000]
    table = spark.createDataFrame([(p,) for p in points], "p long").select(
        F.lit("u").alias("user"), F.timestamp_seconds("p").alias("at")
    )

    def days(zone):
        source = FeatureSource("spending", "t", "user", "at", zone=zone)
        return [str(r[0]) for r in build_events(lambda _: table, [source]).select("activity_date").collect()]

    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for session in ("UTC", "Asia/Tokyo", "Europe/Berlin"):
            spark.conf.set("spark.sql.session.timeZone", session)
            assert days("UTC") == ["2024-03-01", "2024-10-26", "2024-10-27"]
            assert days("Europe/Berlin") == ["2024-03-02", "2024-10-27", "2024-10-27"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_text_with_quotes_stays_text(spark):
    sources = consumer_finance_sources(excluded_provider="O'Neil \\ sons")
    kept = next(s.where for s in sources if s.where)
    frame = spark.createDataFrame(
        [("success", "O'Neil \\ sons"), ("success", "other")], "status string, provider_number string"
    )
    assert [r[1] for r in frame.filter(kept).collect()] == ["other"]


def test_a_day_is_replaced_and_first_seen_gives_the_same_reports(spark, activity_of, users_of, tmp_path):
    path = str(tmp_path / "activity")
    write_activity(activity_of([("a", "2024-03-04", "spending"), (None, "2024-02-01", "savings"), ("c", "2024-01-05", "savings")]), path)
    later = activity_of([("b", "2024-03-04", "savings"), ("a", "2024-03-01", "spending"), ("z", "2024-02-01", "savings")])
    write_activity(later, path, date(2024, 3, 1), date(2024, 3, 4))
    stored = read_activity(spark, path)
    assert sorted(str(r[0]) for r in stored.select("user_id").collect()) == ["None", "a", "b", "c"]
    first, users = engagement.first_seen(stored), users_of([("a", "2024-03-01", False)])
    month = ("2024-03-02", "2024-03-31")
    quick = engagement.churn_count(stored.filter("activity_date >= DATE'2024-03-02'"), *month, first=first)
    assert quick.first() == engagement.churn_count(stored, *month).first() == (3,)
    assert (
        engagement.absolute_metrics(stored, users, month[1], first=first).first()
        == engagement.absolute_metrics(stored, users, month[1]).first()
        == (1, 3)
    )


def test_a_date_without_activity_any_more_goes(spark, activity_of, tmp_path):
    path = str(tmp_path / "activity")
    rows = [("a", f"2024-03-0{d}", "spending") for d in range(1, 7)] + [(None, "2024-02-29", "savings")]
    write_activity(activity_of(rows), path)
    days = lambda: sorted((r.user_id, r.activity_date.day, r.feature) for r in read_activity(spark, path).collect() if r.user_id)

    # The third and fourth vanish, the second is replaced, the rest is out of the range.
    write_activity(activity_of([("b", "2024-03-02", "savings"), ("z", "2024-03-05", "savings")]), path, date(2024, 3, 2), date(2024, 3, 4))
    assert days() == [("a", 1, "spending"), ("a", 5, "spending"), ("a", 6, "spending"), ("b", 2, "savings")]

    # Nothing is left of an open range; a second write of the same day replaces the first.
    write_activity(activity_of([]), path, start=date(2024, 3, 5))
    write_activity(activity_of([("b", "2024-03-02", "savings")]), path, end=date(2024, 3, 2))
    assert days() == [("b", 2, "savings")]

    new = str(tmp_path / "new")
    write_activity(activity_of([("a", "2024-03-01", "spending")]), new, start=date(2024, 3, 1))
    assert read_activity(spark, new).count() == 1


def test_first_seen_is_brought_up_to_date(activity_of):
    rows = [("a", "2024-03-04", "spending"), ("a", "2024-03-02", "savings"), ("b", "2024-03-03", "spending"), (None, "2024-03-01", "savings")]
    whole = sorted(map(str, engagement.first_seen(activity_of(rows)).collect()))
    for cut in range(len(rows) + 1):
        state = engagement.first_seen(activity_of(rows[cut:]), engagement.first_seen(activity_of(rows[:cut])))
        assert sorted(map(str, state.collect())) == whole
