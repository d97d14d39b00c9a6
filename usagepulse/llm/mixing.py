"""Mixing sources to target weights along a time-varying curriculum.

Each source has a target of words. Its documents stand in a fixed pseudo-random order and
are taken in passes over that order until the target is met. The words taken so far, as a
share of the target, are the source's cumulative demand; the source's weight over training
time is integrated and inverted at that demand, which gives each copy its time between 0
and 1. Sorting the copies by time interleaves the sources as their weights ask. The mix is
written in that order, and what each document has in it is read back from there.

Built-in functions only. Prefix sums are taken in two steps, over buckets of the order and
within each, so a source of any share is spread over ``16 ** HEX`` tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagepulse.llm.common import WORD, file_position, materialise

WEIGHTS = (3.0, 1.0, 2.0)
# Slope of each source's weight over time: it runs from 1 - slope to 1 + slope times its mean.
SLOPES = (-0.5, 0.0, 0.5)
BUDGET = 1.5
LIMIT = 2.0
HEX = 3


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _repeating(values: Sequence[float], place: Column) -> Column:
    return F.element_at(
        F.array(*[F.lit(float(v)) for v in values]), (F.pmod(place - 1, F.lit(len(values))) + 1).cast("int")
    )


def source_targets(
    sizes: DataFrame, weights: Sequence[float], budget: float, limit: float
) -> DataFrame:
    """Targets from one row ``(_none, _source, source_size)`` per source.

    Sources share ``budget`` times all words by weight; a share stops at ``limit`` times
    its source and the excess goes to the others by weight. In order of limit per weight
    the shares that stop come first, so one pass of running sums finds the level at which
    the rest share. Windows are unpartitioned: the table has one row per source.
    """
    limited = F.lit(float(limit)) * F.col("source_size")
    ranked = sizes.withColumn(
        "place", F.row_number().over(Window.orderBy("_none", "_source"))
    ).withColumn("weight", _repeating(weights, F.col("place")))
    by_level = Window.orderBy(limited / F.col("weight"), "place")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        F.lit(float(budget)) * F.sum("source_size").over(whole)
        - F.coalesce(F.sum(limited).over(before), F.lit(0.0))
    ) / F.sum("weight").over(onward)
    return (
        ranked.withColumn("level", level)
        .withColumn(
            "level", F.max(F.when(F.col("level") <= limited / F.col("weight"), F.col("level"))).over(whole)
        )
        .select(
            "_none",
            "_source",
            "place",
            "source_size",
            F.least(limited, F.coalesce(F.col("level") * F.col("weight"), limited)).alias("target"),
        )
    )


def time_of(demand: Column, slope: Column) -> Column:
    """Inverse of the integral of a weight that runs from 1 - slope to 1 + slope."""
    rest = 1 - slope
    return 2 * demand / (rest + F.sqrt(rest * rest + 4 * slope * demand))


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    size: str | Column = "size",
    weights: Sequence[float] = WEIGHTS,
    slopes: Sequence[float] = SLOPES,
    budget: float = BUDGET,
    limit: float = LIMIT,
) -> DataFrame:
    """``docs`` with a struct column ``_mix``: source_size, target, copies, taken, times.

    ``size`` is a column of word counts, by name or as an expression (null: 0). ``copies`` is how many times the mix
    takes the whole document, ``times`` the training time of each copy. A source's words
    miss its target by half a document at most. Sources rank by code point, null last;
    the null source is a source like any other. Documents of one source stand in order of
    the md5 of their id (null: empty), then size; rows equal in both are interchangeable,
    and repeated rows count as documents of their own. A source without words has target 0
    and is not taken. Other columns pass through; ``_mix`` is replaced. An empty table
    gives an empty result.
    """
    order = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    keys = ["_none", "_source", "_bucket"]
    words = F.col(size) if isinstance(size, str) else size
    docs = docs.drop("_mix")
    # The row travels as one column, so its names meet none of those in use here.
    placed = docs.select(
        F.struct(*docs.columns).alias("_row"),
        F.col(source).isNull().alias("_none"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_source"),
        order.alias("_order"),
        F.coalesce(words.cast("long"), F.lit(0)).alias("_words"),
    ).withColumn("_bucket", F.substring("_order", 1, HEX))
    buckets = placed.groupBy(*keys).agg(F.sum("_words").alias("_words"))
    sizes = buckets.groupBy("_none", "_source").agg(F.sum("_words").alias("source_size"))
    earlier = (
        Window.partitionBy("_none", "_source")
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = (
        buckets.withColumn("_base", F.coalesce(F.sum("_words").over(earlier), F.lit(0)))
        .drop("_words")
        .join(source_targets(sizes, weights, budget, limit), ["_none", "_source"])
        .select(*keys, F.struct("_base", "place", "source_size", "target").alias("_at"))
    )
    within = (
        Window.partitionBy(*keys)
        .orderBy("_order", "_words")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    at = F.col("_at._base") + F.coalesce(F.sum("_words").over(within), F.lit(0))
    total, target = F.col("_at.source_size"), F.col("_at.target")
    passes = F.when(total > 0, F.floor(target / total)).otherwise(0).cast("long")
    middle = F.col("_first") + F.col("_words") / 2
    copies = F.col("_passes") + (middle < target - F.col("_passes") * total).cast("long")
    times = F.transform(
        F.when(F.col("_copies") > 0, F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)).otherwise(
            F.array().cast("array<long>")
        ),
        lambda n: time_of(
            F.least(F.lit(1.0), (n * total + F.col("_middle")) / target), F.col("_slope")
        ),
    )
    return (
        placed.join(starts, keys)
        .withColumn("_first", at)
        .withColumn("_passes", passes)
        .withColumn("_copies", copies)
        .withColumn("_middle", middle)
        .withColumn("_slope", _repeating(slopes, F.col("_at.place")))
        .select(
            "_row",
            F.struct(
                total.alias("source_size"),
                target.alias("target"),
                F.col("_copies").alias("copies"),
                (F.col("_copies") * F.col("_words")).alias("taken"),
                times.alias("times"),
            ).alias("_mix"),
        )
        .select("_row.*", "_mix")
    )


def training_order(
    mixed: DataFrame, time: str | None = None, ties: Sequence[str] = ()
) -> DataFrame:
    """One row per copy, range-sorted by training time; ``_mix`` is dropped.

    Rows the mix does not take, and those of a source without words, have no copy; nulls and
    other columns pass through. ``time`` names a column for the time of each copy, which
    replaces one of that name. Copies of equal time stand in the order of the columns
    ``ties``, else in any order.
    """
    columns = [c for c in mixed.columns if c not in ("_mix", time)]
    copies = mixed.select(F.struct(*columns).alias("row"), F.explode("_mix.times").alias("time"))
    ordered = copies.orderBy("time", *[F.col("row")[c] for c in ties])
    return ordered.select("row.*", *([F.col("time").alias(time)] if time else []))


def read_back(mixed: DataFrame, size: str | Column = "size") -> DataFrame:
    """``mixed`` with copies, taken and times of ``_mix`` read back from the mix as written.

    The mix is written in training order, one row per copy with its document, and read again:
    ``copies`` counts a document's rows there, ``taken`` adds up their ``size`` (as for
    ``mix``; null: 0), ``times`` has their times as they stand. Rows are numbered, so repeated
    rows and null ids stay apart. Rows not in the mix have 0 copies, 0 words and no times;
    other columns pass through, and an empty table gives an empty result.
    """
    words = F.col(size) if isinstance(size, str) else size
    numbered = materialise(
        mixed.select(
            F.struct(*[c for c in mixed.columns if c != "_mix"]).alias("row"),
            F.coalesce(words.cast("long"), F.lit(0)).alias("words"),
            "_mix",
            F.monotonically_increasing_id().alias("number"),
        ),
        "mixed",
    )
    written = materialise(training_order(numbered, time="time", ties=["number"]), "ordered")
    # A document has ``limit`` copies at most, so its list is short.
    found = (
        written.select("number", "words", F.struct(file_position(written).alias("place"), "time").alias("copy"))
        .groupBy("number")
        .agg(
            F.count("*").alias("copies"),
            F.sum("words").alias("taken"),
            F.transform(F.array_sort(F.collect_list("copy")), lambda c: c["time"]).alias("times"),
        )
    )
    nothing = F.lit(0).cast("long")
    return (
        numbered.join(found, "number", "left")
        .select(
            "row",
            F.struct(
                "_mix.source_size",
                "_mix.target",
                F.coalesce("copies", nothing).alias("copies"),
                F.coalesce("taken", nothing).alias("taken"),
                F.coalesce("times", F.array().cast("array<double>")).alias("times"),
            ).alias("_mix"),
        )
        .select("row.*", "_mix")
    )
