"""Mappings from concrete tables to activity, users and survey submissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagepulse.functions.sql_text import quoted
from usagepulse.sources.registry import DimensionJoin, FeatureSource, UserSource
from usagepulse.sources.tables import TableReader


def consumer_finance_sources(excluded_provider: str) -> list[FeatureSource]:
    """Budgeting, plan transactions and chat messages of a consumer-finance product."""
    settled = f"status = 'success' AND provider_number <> {quoted(excluded_provider)}"
    return [
        FeatureSource("spending", "budgets", "user_id", "created_at"),
        FeatureSource("spending", "manual_and_external_transactions", "user_id", "created_at"),
        FeatureSource(
            "investment", "transactions", "user_id", "updated_at", settled,
            DimensionJoin("investment_plans", "investment_plan_id", "id"),
        ),
        FeatureSource(
            "savings", "transactions", "user_id", "updated_at", settled,
            DimensionJoin("plans", "plan_id", "id"),
        ),
        FeatureSource("assistant", "slack_message_dump", "user", "created_at"),
    ]


CONSUMER_FINANCE_USERS = UserSource("users", "id", "created_at", "restricted")


# An order has a handful of lines, shipped on different days: nothing to merge.
_ORDER_OF_LINE = {
    "table": "orders", "fact_key": "l_orderkey", "dim_key": "o_orderkey", "merge_repeats": False,
}
_PRIORITY_SET = "o_orderpriority <> '4-NOT SPECIFIED'"

COMMERCE_SOURCES = [
    FeatureSource("spending", "orders", "o_custkey", "o_orderdate", "o_orderstatus = 'O'"),
    FeatureSource("spending", "orders", "o_custkey", "o_orderdate", "o_orderstatus = 'P'"),
    FeatureSource(
        "investment", "lineitem", "o_custkey", "l_shipdate",
        "l_linestatus = 'F' AND l_returnflag = 'A'",
        DimensionJoin(**_ORDER_OF_LINE, where=_PRIORITY_SET),
    ),
    FeatureSource(
        "savings", "lineitem", "o_custkey", "l_shipdate",
        "l_linestatus = 'F' AND l_returnflag = 'N'",
        DimensionJoin(**_ORDER_OF_LINE, where=_PRIORITY_SET),
    ),
    FeatureSource("assistant", "orders", "o_custkey", "o_orderdate", "o_orderpriority = '1-URGENT'"),
]

_CUSTOMER_OF_EVENT = {"table": "customer", "fact_key": "user_id", "dim_key": "c_custkey"}
_LARGE_PURCHASE = "event_type = 'purchase' AND value >= 5"

EVENT_SOURCES = [
    FeatureSource("spending", "events", "user_id", "ts", "event_type = 'view'"),
    FeatureSource("spending", "events", "user_id", "ts", "event_type = 'click'"),
    FeatureSource(
        "investment", "events", "c_custkey", "ts", _LARGE_PURCHASE,
        DimensionJoin(**_CUSTOMER_OF_EVENT, where="c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    ),
    FeatureSource(
        "savings", "events", "c_custkey", "ts", _LARGE_PURCHASE,
        DimensionJoin(**_CUSTOMER_OF_EVENT, where="c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"),
    ),
    FeatureSource("assistant", "events", "user_id", "ts", "event_type = 'error'"),
]


def _users_with_signup(signups: DataFrame, customer: DataFrame) -> DataFrame:
    """First signup per user, joined to the customer row that restricts it."""
    first = signups.groupBy("user_id").agg(F.min("signup_date").alias("signup_date"))
    known = customer.select(
        F.col("c_custkey").cast("string").alias("user_id"),
        (F.col("c_acctbal") < 0).alias("restricted"),
        F.col("c_mktsegment").alias("segment"),
    )
    return first.join(known, "user_id")


def commerce_users(read: TableReader) -> DataFrame:
    signups = read("orders").select(
        F.col("o_custkey").cast("string").alias("user_id"),
        F.to_date("o_orderdate").alias("signup_date"),
    )
    return _users_with_signup(signups, read("customer"))


def event_users(read: TableReader) -> DataFrame:
    signups = (
        read("events")
        .filter("event_type = 'signup'")
        .select(
            F.col("user_id").cast("string").alias("user_id"),
            F.to_date("ts").alias("signup_date"),
        )
    )
    return _users_with_signup(signups, read("customer"))


def conversation_submissions(read: TableReader) -> DataFrame:
    """Each conversation turn as a survey submission.

    Every sentence is one entry: its first word asks, the rest of it answers. The
    document is built inside the row, so no conversation is ever gathered.
    """

    def entry(sentence: Column) -> Column:
        word = F.substring_index(sentence, " ", 1)
        rest = sentence.substr(F.length(word) + 2, F.length(sentence))
        return F.struct(word.alias("question"), rest.alias("answer"))

    entries = F.transform(F.split("text", r"\. "), entry)
    return read("conversations").select(
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 30).cast("int")).alias(
            "created_at"
        ),
        F.to_json(F.struct(entries.alias("plan"))).alias("metadata"),
    )


def _entry(question: str, answer: Column | str) -> Column:
    return F.concat(F.lit(f'{{"question":"{question}","answer":'), F.lit(answer), F.lit("}"))


def _plan(*items: Column | str) -> Column:
    return F.concat(F.lit('"plan":['), F.concat_ws(",", *map(F.lit, items)), F.lit("]"))


def odd_submissions(read: TableReader) -> DataFrame:
    """Each conversation turn as the answer of a document of one of six shapes.

    By turn: NaN, a repeated key of an item, a repeated plan with an infinity and items
    that are no objects, an answer that repeats a key, text that is no JSON, plain JSON.
    """
    turns = read("conversations").select("conv_id", "turn", "text")
    listed = F.to_json(F.array("text"), {"ignoreNullFields": "false"})
    said = _entry("said", F.expr("substring(j, 2, length(j) - 2)"))
    good = _entry("good", "1")
    shapes = [
        F.concat(F.lit("{"), _plan(_entry("odd", "NaN"), said), F.lit("}")),
        F.concat(F.lit("{"), _plan('{"question":"odd","answer":1,"answer":""}', said), F.lit("}")),
        F.concat(
            F.lit("{"), _plan(good, _entry("more", "2")), F.lit(","),
            _plan(_entry("odd", "-Infinity"), "7", '"x"', said), F.lit("}"),
        ),
        F.concat(F.lit("{"), _plan(_entry("odd", '{"a":1,"a":[]}'), said), F.lit("}")),
        F.concat(F.lit("{"), _plan(_entry("odd", "NaN"), said), F.lit(",}")),
        F.concat(F.lit("{"), _plan(good, said), F.lit("}")),
    ]
    shape = (F.col("turn") % len(shapes) + 1).cast("int")
    return turns.withColumn("j", listed).select(
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 30).cast("int")).alias(
            "created_at"
        ),
        F.element_at(F.array(*shapes), shape).alias("metadata"),
    )


def with_gaps(read: TableReader) -> TableReader:
    """The tables with NULL for some user keys, filter values and balances.

    A balance of NULL leaves open whether its customer is restricted.
    """
    gaps = {
        "orders": {
            "o_custkey": "CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey END",
            "o_orderstatus": "CASE WHEN o_orderkey % 7 <> 3 THEN o_orderstatus END",
            "o_orderpriority": "CASE WHEN o_orderkey % 13 <> 5 THEN o_orderpriority END",
        },
        "customer": {"c_acctbal": "CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END"},
    }

    def gapped(name: str) -> DataFrame:
        columns = gaps.get(name, {})
        return read(name).withColumns({c: F.expr(sql) for c, sql in columns.items()})

    return gapped


# Besides the four: lines sent back, by the customer of their order.
FIVE_FEATURES = ("spending", "savings", "investment", "assistant", "returns")
FIVE_SOURCES = [
    *COMMERCE_SOURCES,
    FeatureSource(
        "returns", "lineitem", "o_custkey", "l_shipdate", "l_returnflag = 'R'",
        DimensionJoin(**_ORDER_OF_LINE),
    ),
]


def reserved_words(read: TableReader) -> DataFrame:
    """Orders with columns named as SQL's own words."""
    return read("orders").select(
        F.col("o_custkey").alias("user"), F.col("o_orderdate").alias("timestamp"),
        F.col("o_orderstatus").alias("select"),
    )


RESERVED_SOURCES = [FeatureSource("spending", "order", "user", "timestamp", "`select` = 'F'")]


def event_feedback(read: TableReader) -> DataFrame:
    return read("events").select(
        F.col("ts").alias("created_at"),
        F.col("event_type").alias("reaction"),
        F.col("props").alias("comment"),
    )
