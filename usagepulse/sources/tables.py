"""Reading source tables and keeping the activity fact."""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping
from datetime import date
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TableReader = Callable[[str], DataFrame]


def parquet_reader(spark: SparkSession, root: str) -> TableReader:
    """Tables stored as ``<root>/<name>.parquet``, each opened once per reader."""
    return cache(lambda name: spark.read.parquet(f"{root}/{name}.parquet"))


def jdbc_reader(
    spark: SparkSession,
    options: Mapping[str, str],
    splits: Mapping[str, Mapping[str, str]] | None = None,
    small: Collection[str] = (),
) -> TableReader:
    """Tables of a relational database.

    ``splits`` gives, per table, the ``partitionColumn``, ``lowerBound``,
    ``upperBound`` and ``numPartitions`` that let executors read it in parallel.
    Only tables named in ``small`` are read by one task; any other is an error.
    """

    def read(name: str) -> DataFrame:
        if name not in (splits or {}) and name not in small:
            raise ValueError(f"table {name!r} has no splits and is not declared small")
        table_options = {**options, **(splits or {}).get(name, {}), "dbtable": name}
        return spark.read.format("jdbc").options(**table_options).load()

    return read


def catalog_reader(spark: SparkSession, schema: str | None = None) -> TableReader:
    """Tables of the session catalog."""
    return lambda name: spark.table(f"{schema}.{name}" if schema else name)


def require_columns(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"table {table!r} lacks columns {missing}")
    return df


def write_activity(
    activity: DataFrame, path: str, start: date | None = None, end: date | None = None
) -> None:
    """Store the fact once, partitioned by date, for every later report to prune.

    With ``start`` or ``end`` only those dates are replaced, the others stay. A date of the
    range that has no activity any more goes: new dates are written first, then every stored
    date of the range that the write has left untouched is removed.

    The rebalance hint lets adaptive execution split a date that holds a large
    share of the rows and pack small ones, instead of one writer task per date.
    """
    day = F.col("activity_date")
    if start is not None:
        activity = activity.filter(day >= F.lit(start))
    if end is not None:
        activity = activity.filter(day <= F.lit(end))
    part = start is not None or end is not None
    spark = activity.sparkSession
    before = _stored_files(spark, path, start, end) if part else {}
    (
        activity.hint("rebalance", "activity_date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic" if part else "static")
        .partitionBy("activity_date")
        .parquet(path)
    )
    # A date that was written has files of this write's own names.
    after = _stored_files(spark, path, start, end) if before else {}
    for folder in before:
        if before[folder] == after.get(folder):
            _store(spark, folder).delete(_path(spark, folder), True)


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _store(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _stored_files(
    spark: SparkSession, path: str, start: date | None, end: date | None
) -> dict[str, set[str]]:
    """File names by folder of the stored dates of a range: one listing per date."""
    store, found = _store(spark, path), {}
    if not store.exists(_path(spark, path)):
        return found
    for folder in store.listStatus(_path(spark, path)):
        name, _, value = folder.getPath().getName().partition("=")
        if name == "activity_date" and value[:1].isdigit() and folder.isDirectory():
            day = date.fromisoformat(value)
            if (start is None or day >= start) and (end is None or day <= end):
                files = store.listStatus(folder.getPath())
                found[folder.getPath().toString()] = {f.getPath().getName() for f in files}
    return found


def read_activity(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("user_id string, feature string, activity_date date").parquet(path)


def save_by_user(frame: DataFrame, table: str, buckets: int) -> None:
    """Store a frame with ``user_id`` as a table bucketed by user.

    Grouping by user, and joining tables of as many buckets, then needs no exchange: the
    fact, its first-seen state and the users meet where they lie. Take buckets so that one
    fits a task; a user's rows share a bucket, so store the fact distinct.
    """
    (
        # One writer task per bucket, so that each bucket is one file.
        frame.repartition(buckets, "user_id")
        .write.mode("overwrite")
        .bucketBy(buckets, "user_id")
        .sortBy("user_id")
        .saveAsTable(table)
    )
