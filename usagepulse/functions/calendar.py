"""Report periods, period truncation, date spines and calendar bitmaps.

A calendar bitmap holds one bit per day of a report period, another one a bit per
month. Their length follows from the period, which is known when the plan is built,
so a user's active days reduce with ``bit_or`` in an ordinary hash aggregate:
repeats cost nothing, the map side combines them, and counting distinct days, weeks
and months needs neither ``Expand`` nor a second shuffle. Day bits start on a Monday
and a word holds nine whole weeks, so the weeks can be read off the days.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRANULARITIES = ("day", "week", "month")
WORD_BITS = 63
WEEK_STARTS = sum(1 << bit for bit in range(0, WORD_BITS, 7))


def as_date(value: date | str) -> date:
    return value if isinstance(value, date) else date.fromisoformat(value)


@dataclass(frozen=True)
class Period:
    """An inclusive date range plus the length of the history before it."""

    start: date
    end: date
    history_days: int = 0

    @classmethod
    def of(cls, start: date | str, end: date | str, history_days: int = 0) -> "Period":
        period = cls(as_date(start), as_date(end), history_days)
        if period.end < period.start:
            raise ValueError(f"period ends before it starts: {start}..{end}")
        if history_days < 0:
            raise ValueError("history_days must not be negative")
        return period

    @property
    def days(self) -> int:
        return (self.end - self.start).days + 1

    @property
    def history_start(self) -> date:
        return self.start - timedelta(days=self.history_days)

    def holds(self, day: Column) -> Column:
        return day.between(F.lit(self.start), F.lit(self.end))

    def sql_holds(self, day: str) -> str:
        return f"{day} BETWEEN DATE'{self.start}' AND DATE'{self.end}'"

    def sql_history_holds(self, day: str) -> str:
        """``[start - N, start]``: both ends count, so it shares a day with the period."""
        return f"{day} BETWEEN DATE'{self.history_start}' AND DATE'{self.start}'"


def monthly_periods(start: date | str, end: date | str, history_days: int = 0) -> list[Period]:
    """Calendar months touching ``[start, end]``, clipped to it."""
    first, last = as_date(start), as_date(end)
    periods = []
    while first <= last:
        following = (first.replace(day=1) + timedelta(days=32)).replace(day=1)
        periods.append(Period(first, min(last, following - timedelta(days=1)), history_days))
        first = following
    return periods


def truncate(day: Column, granularity: str) -> Column:
    """Start of the day, ISO week (Monday) or month holding ``day``, as a date."""
    if granularity not in GRANULARITIES:
        raise ValueError(f"unknown granularity {granularity!r}, expected one of {GRANULARITIES}")
    return day if granularity == "day" else F.trunc(day, granularity)


def spine(spark: SparkSession, start: date | str, end: date | str, granularity: str) -> DataFrame:
    """One row per period start from the period holding ``start`` through ``end``.

    Stepping begins at the truncated start, so week and month rows fall on the
    same dates as truncated activity whatever day the range opens on.
    """
    first = truncate(F.lit(as_date(start)), granularity)
    step = F.expr(f"INTERVAL 1 {granularity.upper()}")
    return spark.range(1).select(
        F.explode(F.sequence(first, F.lit(as_date(end)), step)).alias("dt")
    )


@dataclass(frozen=True)
class Steps:
    """The periods of a spine, numbered from 0: the one holding the start of a range first."""

    period: Period
    granularity: str

    def __post_init__(self) -> None:
        truncate(F.lit(None), self.granularity)

    @property
    def opening(self) -> date:
        start = self.period.start
        if self.granularity == "week":
            return start - timedelta(days=start.weekday())
        return start.replace(day=1) if self.granularity == "month" else start

    @property
    def count(self) -> int:
        first, last = self.opening, self.period.end
        if self.granularity == "month":
            return (last.year - first.year) * 12 + last.month - first.month + 1
        return (last - first).days // (7 if self.granularity == "week" else 1) + 1

    def number(self, day: str) -> str:
        """SQL for the number of the period holding ``day``."""
        if self.granularity == "month":
            return bit_positions(day, f"DATE'{self.opening}'")["month"]
        days = f"date_diff({day}, DATE'{self.opening}')"
        return f"CAST({days} DIV 7 AS int)" if self.granularity == "week" else days

    def start(self, number: str) -> str:
        """SQL for the first date of a period, NULL for a NULL number."""
        if self.granularity == "month":
            return f"add_months(DATE'{self.opening}', {number})"
        return f"date_add(DATE'{self.opening}', {number}{' * 7' if self.granularity == 'week' else ''})"


def bit_positions(day: str, start: str) -> dict[str, str]:
    """SQL for the bit of ``day`` in the day and month bitmaps of a period."""
    months = f"(year({day}) - year({start})) * 12 + month({day}) - month({start})"
    return {"day": f"date_diff({day}, trunc({start}, 'week'))", "month": months}


def bitmap_lengths(longest_days: int) -> dict[str, int]:
    """Bits needed for periods of up to ``longest_days`` days starting on any day."""
    return {"day": longest_days + 6, "month": (longest_days + 26) // 28 + 1}


def word_names(prefix: str, bits: int) -> list[str]:
    return [f"{prefix}_bits{k}" for k in range(-(-bits // WORD_BITS))]


def _words(position: str, inside: str, bits: int) -> list[str]:
    # Two comparisons instead of BETWEEN, which would bind ``position`` to a column of
    # its own for every word.
    count = -(-bits // WORD_BITS)
    words = []
    for low in range(0, count * WORD_BITS, WORD_BITS):
        here, bit = inside, position
        if count > 1:
            here = f"{inside} AND {position} >= {low} AND {position} < {low + WORD_BITS}"
            bit = f"{position} - {low}"
        words.append(f"coalesce(bit_or(CASE WHEN {here} THEN shiftleft(1L, {bit}) END), 0L)")
    return words


def mark_bits(position: str, inside: str, prefix: str, bits: int) -> list[Column]:
    """Aggregates setting bit ``position`` for every row that is ``inside``."""
    words = zip(_words(position, inside, bits), word_names(prefix, bits))
    return [F.expr(f"{word} AS {name}") for word, name in words]


def mark_bit_array(position: str, inside: str, name: str, bits: int) -> Column:
    """The same bitmap as one array column, which spares the optimizer a long one."""
    return F.expr(f"array({', '.join(_words(position, inside, bits))}) AS {name}")


def placed(position: str) -> list[str]:
    """SQL for the word and the bit of a position, worked out once per row; NULL for none."""
    return [
        f"CAST({position} DIV {WORD_BITS} AS int) AS word_no",
        f"shiftleft(1L, CAST({position} % {WORD_BITS} AS int)) AS place_bit",
    ]


def mark_placed(name: str, bits: int, met: str = "true") -> Column:
    """`mark_bit_array` over rows that are ``placed``."""
    words = (
        f"coalesce(bit_or(CASE WHEN word_no = {k} AND {met} THEN place_bit END), 0L)"
        for k in range(-(-bits // WORD_BITS))
    )
    return F.expr(f"array({', '.join(words)}) AS {name}")


def merge_bits(prefix: str, bits: int) -> list[Column]:
    """Aggregates uniting finished bitmaps."""
    return [F.expr(f"bit_or({name}) AS {name}") for name in word_names(prefix, bits)]


def has_bit(prefix: str, position: int) -> str:
    """SQL for whether a bit of a finished bitmap is set."""
    word, bit = divmod(position, WORD_BITS)
    return f"({prefix}_bits{word} & {1 << bit}L) <> 0"


def count_bits(prefix: str, bits: int) -> str:
    """SQL for the number of set bits, 0 for a missing bitmap."""
    words = (f"coalesce(bit_count({name}), 0)" for name in word_names(prefix, bits))
    return f"CAST({' + '.join(words)} AS bigint)"


def count_weeks(prefix: str, bits: int) -> str:
    """SQL for the number of weeks with a set day; a week's days fold onto its first bit."""

    def weeks(word: str) -> str:
        folded = " | ".join([word, *(f"shiftright({word}, {n})" for n in range(1, 7))])
        return f"coalesce(bit_count(({folded}) & {WEEK_STARTS}L), 0)"

    return f"CAST({' + '.join(map(weeks, word_names(prefix, bits)))} AS bigint)"


def set_positions(prefix: str, bits: int) -> str:
    """SQL for the array of set positions, which unfolds a bitmap inside its row."""
    words = (
        f"transform(filter(sequence(0, {WORD_BITS - 1}), i -> getbit({name}, i) = 1), "
        f"i -> i + {k * WORD_BITS})"
        for k, name in enumerate(word_names(prefix, bits))
    )
    return f"flatten(array({', '.join(words)}))"


def array_positions(words: str, bits: int) -> str:
    """`set_positions` of a bitmap held as one array column."""
    return (
        f"flatten(transform(sequence(0, {-(-bits // WORD_BITS) - 1}), w -> transform("
        f"filter(sequence(0, {WORD_BITS - 1}), i -> getbit(get({words}, w), i) = 1), "
        f"i -> w * {WORD_BITS} + i)))"
    )


def array_has(words: str, position: str) -> str:
    """SQL for whether an array bitmap holds a position; false for a NULL one."""
    word = f"get({words}, CAST({position} DIV {WORD_BITS} AS int))"
    return f"coalesce(getbit({word}, CAST({position} % {WORD_BITS} AS int)) = 1, false)"


def with_next_bit(frame: DataFrame, words: str, after: str) -> DataFrame:
    """Adds ``next_pos``, the first set bit beyond ``after`` in its word or the one following.

    So it looks at least ``WORD_BITS`` positions ahead and is NULL if all are clear.
    Picking two words keeps the expression the same for any length of bitmap.
    """

    def lowest(word: str, number: str) -> str:
        # x & -x keeps the lowest set bit, and the ones below it count its place.
        return f"{number} * {WORD_BITS} + bit_count(({word} & -{word}) - 1)"

    kept = frame.columns
    located = frame.selectExpr(
        *kept,
        f"CAST({after} + 1 AS int) AS from_pos",
        f"CAST(({after} + 1) DIV {WORD_BITS} AS int) AS word_no",
    )
    picked = located.selectExpr(
        *kept,
        "word_no",
        f"get({words}, word_no) & shiftleft(-1L, from_pos - word_no * {WORD_BITS}) AS this_word",
        f"get({words}, word_no + 1) AS following_word",
    )
    return picked.selectExpr(
        *kept,
        f"CASE WHEN this_word <> 0 THEN {lowest('this_word', 'word_no')} "
        f"WHEN following_word <> 0 THEN {lowest('following_word', '(word_no + 1)')} END AS next_pos",
    )


def monday(day: date) -> date:
    return day - timedelta(days=day.weekday())


def days_from_monday(opening: date, end: date) -> int:
    return (end - monday(opening)).days + 1


def _masks(first: date, last: date, origin: date, words: int) -> list[int]:
    """Words with a bit for each day of a range, counted from ``origin``."""
    whole = (1 << (last - origin).days + 1) - (1 << (first - origin).days)
    return [whole >> WORD_BITS * k & (1 << WORD_BITS) - 1 for k in range(words)]


def _cut(first: date, last: date, origin: date, words: int) -> dict:
    """Where the words of a range begin in bitmaps from ``origin``, and which bits it holds."""
    word, shift = divmod((monday(first) - origin).days, WORD_BITS)
    return {"w": word, "s": shift, "m": _masks(first, last, monday(first), words)}


def period_cuts(periods: Sequence[Period], opening: date) -> Column:
    """Array of the periods as what cuts them out of bitmaps that start on the Monday of ``opening``.

    Per period: period_start, period_end; ``now`` and ``past`` for `cut_words`, of the period
    and of its history; and ``months``, the masks of its calendar months within the words of
    ``now``. A constant of the plan, one entry per period.
    """
    if not periods:
        raise ValueError("at least one period is needed")
    if len(set(periods)) != len(periods):
        raise ValueError("periods repeat")
    origin = monday(opening)
    now_words = words_of(max(p.days for p in periods))
    past_words = words_of(max(p.history_days for p in periods) + 1)
    cuts = []
    for p in periods:
        months = [
            _masks(m.start, m.end, monday(p.start), now_words) for m in monthly_periods(p.start, p.end)
        ]
        cuts.append(
            {
                "period_start": str(p.start),
                "period_end": str(p.end),
                "now": _cut(p.start, p.end, origin, now_words),
                "past": _cut(p.history_start, p.start, origin, past_words),
                "months": months,
            }
        )
    cut = "struct<w:int,s:int,m:array<bigint>>"
    kind = f"array<struct<period_start:date,period_end:date,now:{cut},past:{cut},months:array<array<bigint>>>>"
    return F.expr(f"from_json('{json.dumps(cuts)}', '{kind}')")


def words_of(days: int) -> int:
    """Words that hold any range of so many days, counted from its Monday."""
    return -(-bitmap_lengths(days)["day"] // WORD_BITS)


def cut_words(words: str, cut: str, count: int) -> list[str]:
    """SQL for the words of a range out of an array bitmap; both start on a Monday.

    Two neighbouring words are shifted into one. The expressions are the same for every
    period, whose word, shift and masks are data.
    """
    full = (1 << WORD_BITS) - 1

    def at(k: int) -> str:
        return f"coalesce(get({words}, {cut}.w + {k}), 0L)"

    return [
        f"((shiftrightunsigned({at(k)}, {cut}.s) | shiftleft({at(k + 1)}, {WORD_BITS} - {cut}.s)) "
        f"& {full}L & get({cut}.m, {k}))"
        for k in range(count)
    ]


def any_set(words: list[str]) -> str:
    return f"(({' | '.join(words)}) <> 0)"


def period_frame(spark: SparkSession, periods: Sequence[Period]) -> DataFrame:
    """``(period_start, period_end)``, one row per period."""
    rows = [
        F.struct(F.lit(p.start).alias("period_start"), F.lit(p.end).alias("period_end"))
        for p in periods
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def periods_holding(periods: Sequence[Period], day: str) -> Column:
    """Array of ``(period_start, period_end)`` of the periods whose range or history holds ``day``.

    The periods of every day are worked out here and looked up by the day's number, so
    placing a row needs no join and costs the same however many periods there are. Both
    tables are constants of the plan: one entry per calendar day and per period.
    """
    if not periods:
        raise ValueError("at least one period is needed")
    if len(set(periods)) != len(periods):
        raise ValueError("periods repeat")
    first = min(p.history_start for p in periods)
    length = (max(p.end for p in periods) - first).days + 1
    holding: list[list[int]] = [[] for _ in range(length)]
    for number, p in enumerate(periods):
        for place in range((p.history_start - first).days, (p.end - first).days + 1):
            holding[place].append(number)
    ranges = json.dumps([{"s": str(p.start), "e": str(p.end)} for p in periods])
    return F.expr(
        f"transform(get(from_json('{json.dumps(holding)}', 'array<array<int>>'), "
        f"date_diff({day}, DATE'{first}')), number -> named_struct("
        f"'period_start', get(from_json('{ranges}', 'array<struct<s:date,e:date>>'), number).s, "
        f"'period_end', get(from_json('{ranges}', 'array<struct<s:date,e:date>>'), number).e))"
    )
