"""Feature sources as data, and the activity fact built from them.

Activity is ``(user_id string, activity_date date, feature string)``. Any number
of source tables feed it, each through a ``FeatureSource``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagepulse.functions.zones import ZONE, day_of
from usagepulse.sources.tables import TableReader, require_columns

# Declared order; it also breaks ties between equally used features.
FEATURES = ("spending", "savings", "investment", "assistant")

FEATURE_LABELS = {
    "spending": "Spending",
    "savings": "Savings",
    "investment": "Investment",
    "assistant": "Assistant",
}


def label_of(feature: str, labels: Mapping[str, str] = FEATURE_LABELS) -> str:
    """A feature's label, by default its name in title case."""
    return labels.get(feature, feature.replace("_", " ").title())


@dataclass(frozen=True)
class DimensionJoin:
    """Dimension carrying the user key of a fact that only has a foreign key.

    The dimension key must be unique. ``where`` filters dimension rows.

    With ``merge_repeats``, rows of the same key, date and outcome, which are one
    event to every report, merge on the map side before the join shuffles them: a
    key holding a large share of the fact reaches the join as one row per date.
    That costs a shuffle, so leave it off where keys repeat little within a date;
    adaptive execution then splits whatever key is hot.

    Keys known to be hot can be declared in ``hot_keys``. Their facts are dealt over
    ``spread`` join keys by their point in time (with ``merge_repeats`` by its date, so
    that repeats still merge), and the dimension row of each is repeated as often: at most ``spread`` rows for each declared key, whatever the tables' size.
    """

    table: str
    fact_key: str
    dim_key: str
    where: str | None = None
    merge_repeats: bool = True
    hot_keys: tuple = ()
    spread: int = 64


@dataclass(frozen=True)
class FeatureSource:
    """One table whose rows count as use of ``feature``.

    ``user_col`` is a column of the dimension when there is a ``join``, otherwise
    of ``table``. ``where`` is a SQL predicate over ``table``; a NULL outcome
    drops the row, as in any SQL filter.
    """

    feature: str
    table: str
    user_col: str
    ts_col: str
    where: str | None = None
    join: DimensionJoin | None = None
    zone: str = ZONE  # in which a point in time has its day

    def __post_init__(self) -> None:
        # Report columns are named after features.
        if not self.feature.isidentifier():
            raise ValueError(f"feature name {self.feature!r} is not an identifier")


@dataclass(frozen=True)
class UserSource:
    """Table of users: one row per id."""

    table: str
    id_col: str
    ts_col: str
    restricted_col: str
    segment_col: str | None = None
    zone: str = ZONE


def _shares_scan(source: FeatureSource) -> tuple:
    join = source.join
    keys = replace(join, where=None) if join else None
    return source.table, source.user_col, source.ts_col, source.zone, keys


def _predicate(sql: str | None) -> Column:
    return F.expr(sql) if sql else F.lit(True)


def _tag(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """``rows`` with ``feature``, once per condition a row meets.

    Explodes a fixed array and filters, which stays inside generated code.
    """
    rows = rows.filter(reduce(or_, conditions.values()))
    kept = ["user_id", "activity_date"]
    if len(conditions) == 1:
        return rows.select(*kept, F.lit(next(iter(conditions))).alias("feature"))
    names = [F.when(met, F.lit(feature)) for feature, met in conditions.items()]
    tagged = rows.select(*kept, F.explode(F.array(*names)).alias("feature"))
    return tagged.filter(F.col("feature").isNotNull())


def _any_of(known: dict[str, Column], feature: str, met: Column) -> None:
    known[feature] = known[feature] | met if feature in known else met


def _tag_single(fact: DataFrame, group: list[FeatureSource]) -> DataFrame:
    head = group[0]
    conditions: dict[str, Column] = {}
    for source in group:
        _any_of(conditions, source.feature, _predicate(source.where))
    rows = fact.withColumns(
        {
            "activity_date": day_of(fact, head.ts_col, head.zone),
            "user_id": F.col(head.user_col).cast("string"),
        }
    )
    return _tag(rows, conditions)


def _tag_joined(fact: DataFrame, dim: DataFrame, group: list[FeatureSource]) -> DataFrame:
    head, join = group[0], group[0].join
    fact_met = [_predicate(s.where) for s in group]
    dim_met = [_predicate(s.join.where) for s in group]
    salted = ["salt"] if join.hot_keys else []
    day = day_of(fact, head.ts_col, head.zone)
    dealt = F.pmod(
        F.xxhash64(day if join.merge_repeats else head.ts_col), F.lit(join.spread)
    ).cast("int")
    salt = F.when(F.col(join.fact_key).isin(*join.hot_keys), dealt).otherwise(F.lit(0))
    events = fact.filter(reduce(or_, fact_met) & F.col(join.fact_key).isNotNull()).select(
        F.col(join.fact_key).alias("key"),
        *(salt.alias(name) for name in salted),
        day.alias("activity_date"),
        *(met.alias(f"fact_met{i}") for i, met in enumerate(fact_met)),
    )
    if join.merge_repeats:
        events = events.distinct()
    owners = dim.filter(reduce(or_, dim_met)).select(
        F.col(join.dim_key).alias("key"),
        F.col(head.user_col).cast("string").alias("user_id"),
        *(met.alias(f"dim_met{i}") for i, met in enumerate(dim_met)),
    )
    if salted:
        last = F.when(F.col("key").isin(*join.hot_keys), F.lit(join.spread - 1)).otherwise(F.lit(0))
        owners = owners.select("*", F.explode(F.sequence(F.lit(0), last)).alias("salt"))
    conditions: dict[str, Column] = {}
    for i, source in enumerate(group):
        _any_of(conditions, source.feature, F.col(f"fact_met{i}") & F.col(f"dim_met{i}"))
    return _tag(events.join(owners, ["key", *salted]), conditions)


def build_events(
    read: TableReader, sources: Sequence[FeatureSource], feature: str | None = None
) -> DataFrame:
    """All activity rows, or those of one feature, repeats included.

    Sources over the same table and keys share one scan and one join; naming the
    feature leaves out the tables of all others. Every operator of this package
    gives the same result with or without repeats, so a one-off report starts from
    here and saves the shuffle of ``distinct``.
    """
    wanted = [s for s in sources if feature in (None, s.feature)]
    if not wanted:
        raise ValueError(f"no source for feature {feature!r}")
    groups: dict[tuple, list[FeatureSource]] = {}
    for source in wanted:
        groups.setdefault(_shares_scan(source), []).append(source)
    branches = []
    for group in groups.values():
        head = group[0]
        fact = read(head.table)
        if head.join is None:
            require_columns(fact, head.table, [head.user_col, head.ts_col])
            branches.append(_tag_single(fact, group))
        else:
            dim = read(head.join.table)
            require_columns(fact, head.table, [head.join.fact_key, head.ts_col])
            require_columns(dim, head.join.table, [head.join.dim_key, head.user_col])
            branches.append(_tag_joined(fact, dim, group))
    return reduce(DataFrame.unionByName, branches)


def build_activity(read: TableReader, sources: Sequence[FeatureSource]) -> DataFrame:
    """The distinct activity fact. Write it once when several reports follow."""
    return build_events(read, sources).distinct()


def build_users(read: TableReader, source: UserSource) -> DataFrame:
    """``(user_id, signup_date, restricted[, segment])``."""
    table = read(source.table)
    columns = [
        F.col(source.id_col).cast("string").alias("user_id"),
        day_of(table, source.ts_col, source.zone).alias("signup_date"),
        F.col(source.restricted_col).alias("restricted"),
    ]
    if source.segment_col:
        columns.append(F.col(source.segment_col).alias("segment"))
    return table.select(*columns)


def of_feature(
    activity: DataFrame, feature: str | None, features: Sequence[str] = FEATURES
) -> DataFrame:
    """Activity of one feature, or all of it for None; an unknown name is an error."""
    if feature is None:
        return activity
    if feature not in features:
        raise ValueError(f"unknown feature {feature!r}, expected one of {tuple(features)}")
    return activity.filter(F.col("feature") == feature)
