"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import usagepulse

# A word is a run of code points other than space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where a session on one machine names none, as in tests, a local one is made and
    set. On a cluster that is an error, as its executors would not share the folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or (
        spark.sparkContext._conf.get("spark.checkpoint.dir", None)
    )
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="usagepulse-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage: what is read later survives the loss of any executor and is
    not computed again.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_position(docs: DataFrame) -> Column:
    """Where a row stands in what a sorted write left: by number of its file, then row.

    ``docs`` reads Parquet files that Spark wrote; names that Spark does not give count as
    the first file.
    """
    file = docs.metadataColumn("_metadata")
    number = F.regexp_extract(file["file_name"], r"^part-(\d+)", 1).try_cast("long")
    return F.shiftleft(F.coalesce(number, F.lit(0).cast("long")), 40) + file["row_index"]


def prepare(spark: SparkSession) -> None:
    """Let the Python workers of this session import the package from where it lies."""
    place = str(Path(usagepulse.__file__).parent.parent)
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if place not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [place, known]))


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{root}/{name}.parquet")


def digest_spans(spans: Column) -> Column:
    """``kind:start:end`` of an array of span structs, comma-joined."""
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        ),
        ",",
    )


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True where crc32 of the id as text leaves no remainder; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def at_most(df: DataFrame, key: str, rows: int) -> DataFrame:
    """``df`` if it has no more than ``rows`` rows, else its bounded sample.

    A join with a bounded sample has more rows than it where ids repeat.
    """
    return bounded_sample(df, key, rows) if df.count() > rows else df


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows: those with the smallest hash of ``key``, all if there are fewer.

    A bound on the hash leaves few more than that before the exact cut, so the cut's one
    task never reads more than about one and a half times ``rows``.
    """
    total = df.count()
    place = F.shiftrightunsigned(F.xxhash64(key), 11) / float(1 << 53)
    share = 1.2 * (rows + 1000) / max(total, 1)
    few = df.withColumn("_place", place).where(F.col("_place") < F.lit(share))
    return few.orderBy("_place", *df.columns).limit(rows).drop("_place")
