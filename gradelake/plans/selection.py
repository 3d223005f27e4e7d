"""A page of an order without sorting the table: exact selection by narrowing value ranges.

Rows are counted per value range of the first order column. The counts say in which ranges the
page lies; those ranges are split further, and ranges of one value by the next order column,
until so few rows are left that they can be sorted. Counting reads only the order's columns and
shuffles a few thousand counts; nothing is written.
"""

from __future__ import annotations

import math
import os.path
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradelake.plans.ordering import RANKING, fresh, page_count_of, sort_columns, with_position

# Rows that are sorted at last, besides those of the page itself.
MOST_SORTED = 1 << 16
# Ranges that a range is split into.
SPLITS = 1 << 12
# High bits of a whole number, and steps of the logarithm of a fraction, in the first split.
HIGH_BITS, LOG_STEPS = 48, 32
NOT_A_NUMBER = 1 << 40

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


@dataclass(frozen=True)
class Span:
    """Rows whose values lie between two values that occur; both are None for nulls."""

    rows: int
    low: object
    high: object

    @property
    def single(self) -> bool:
        both = isinstance(self.low, float) and isinstance(self.high, float)
        return self.low == self.high or (both and math.isnan(self.low) and math.isnan(self.high))


class _Axis:
    """A column as something that can be cut into ranges in its sort order."""

    def __init__(self, name: str, kind: T.DataType):
        self.column, self.kind = F.col(name), kind
        self.bytes = isinstance(kind, (T.StringType, T.BinaryType))
        self.fraction = isinstance(kind, (T.FloatType, T.DoubleType))
        if not self.bytes and not self.fraction:
            self.number = self._whole_number()

    def _whole_number(self) -> Column:
        column, kind = self.column, self.kind
        if isinstance(kind, _WHOLE):
            return column.cast("bigint")
        if isinstance(kind, T.BooleanType):
            return column.cast("int").cast("bigint")
        if isinstance(kind, T.DateType):
            return F.unix_date(column).cast("bigint")
        if isinstance(kind, T.TimestampType):
            return F.unix_micros(column)
        if isinstance(kind, T.TimestampNTZType):  # without a detour through the session zone
            minutes = (F.unix_date(column.cast("date")).cast("bigint") * 24 + F.hour(column)) * 60
            seconds = F.date_part(F.lit("SECOND"), column)
            return (minutes + F.minute(column)) * 60_000_000 + (seconds * 1_000_000).cast("bigint")
        if isinstance(kind, T.DecimalType) and kind.precision <= 18:
            return (column * F.lit(10**kind.scale)).cast("bigint")
        raise ValueError(f"cannot page by a column of type {kind.simpleString()}")

    def first_split(self) -> Column:
        """Bucket of a value, before anything is known about the values; null for null."""
        if self.bytes:
            return F.substring(self.column.cast("binary"), 1, 2)
        if self.fraction:
            value = self.column.cast("double")
            size = F.least(F.log1p(F.abs(value)), F.lit(1000.0))  # infinity gets a bucket of its own
            return F.when(F.isnan(value), F.lit(NOT_A_NUMBER)).otherwise(
                F.floor(F.signum(value) * size * LOG_STEPS).cast("bigint")
            )
        return F.shiftright(self.number, HIGH_BITS)

    def split(self, span: Span) -> Column:
        """Bucket of a value inside a span; its lowest and highest value never share one."""
        if self.bytes:
            known = len(os.path.commonprefix([self._raw(span.low), self._raw(span.high)]))
            return F.substring(self.column.cast("binary"), known + 1, 2)
        if self.fraction:
            share = (self.column.cast("double") - span.low) / (span.high - span.low)
            return F.floor(share * SPLITS).cast("bigint")
        (_, low), (_, high) = span.low, span.high
        return F.floor((self.number - low) / F.lit((high - low) // SPLITS + 1)).cast("bigint")

    @staticmethod
    def _raw(value: object) -> bytes:
        return value.encode("utf-8") if isinstance(value, str) else bytes(value)

    def ends(self) -> list[Column]:
        """Aggregates for the lowest and highest value."""
        if self.bytes:
            return [F.min(self.column), F.max(self.column)]
        if self.fraction:
            return [F.min(self.column.cast("double")), F.max(self.column.cast("double"))]
        # The value as text, and the number it is cut by.
        found = []
        for pick in (F.min, F.max):
            text = pick(self.column)
            if isinstance(self.kind, T.TimestampType):
                text = F.unix_micros(text)
            found.append(F.struct(text.cast("string"), pick(self.number)))
        return found

    def literal(self, value: object) -> Column:
        if self.bytes or self.fraction:
            return F.lit(bytes(value) if isinstance(value, bytearray) else value)
        if isinstance(self.kind, T.TimestampType):
            return F.timestamp_micros(F.lit(int(value[0])))
        return F.lit(value[0]).cast(self.kind)

    def within(self, span: Span) -> Column:
        """The rows of a span, as a condition that reaches the scan."""
        if span.low is None:
            return self.column.isNull()
        if self.fraction and math.isnan(span.low):  # column statistics do not know of it
            return F.isnan(self.column)
        if span.single:
            return self.column == self.literal(span.low)
        return (self.column >= self.literal(span.low)) & (self.column <= self.literal(span.high))

    def spans(self, rows: DataFrame, bucket: Column) -> list[Span]:
        """Rows counted by bucket, in rising order, nulls first."""
        low, high = self.ends()
        found = rows.groupBy(bucket.alias("bucket")).agg(
            F.count(F.lit(1)).alias("rows"), low.alias("low"), high.alias("high")
        )
        counted = found.collect()
        value = (lambda v: bytes(v)) if self.bytes else (lambda v: v)
        nulls = [Span(r["rows"], None, None) for r in counted if r["bucket"] is None]
        rest = [r for r in counted if r["bucket"] is not None]
        ends = (lambda v: v) if self.bytes or self.fraction else tuple
        return nulls + [
            Span(r["rows"], ends(r["low"]), ends(r["high"]))
            for r in sorted(rest, key=lambda r: value(r["bucket"]))
        ]


def _spans(rows: DataFrame, order: Sequence[str]) -> tuple[_Axis, list[Span]]:
    name = order[0].removeprefix("-")
    axis = _Axis(name, rows.schema[name].dataType)
    return axis, _directed(axis.spans(rows, axis.first_split()), order)


def _directed(spans: list[Span], order: Sequence[str]) -> list[Span]:
    return spans[::-1] if order[0].startswith("-") else spans


def _cover(
    rows: DataFrame,
    order: Sequence[str],
    axis: _Axis,
    spans: list[Span],
    skip: int,
    take: int,
    most: int,
) -> tuple[list[Column], int]:
    """Conditions for neighbouring rows of an order that hold the rows from ``skip`` to
    ``skip + take``, and how many rows come before them."""
    met, start = [], 0
    for span in spans:
        if start < skip + take and start + span.rows > skip:
            met.append((start, span))
        start += span.rows
    if sum(span.rows for _, span in met) <= most:
        return [axis.within(span) for _, span in met], met[0][0]
    conditions, before = [], 0
    for k, (start, span) in enumerate(met):
        inside = axis.within(span)
        inner_skip = max(0, skip - start)
        inner_take = min(skip + take, start + span.rows) - max(skip, start)
        inner, passed = [F.lit(True)], 0
        if inner_take < span.rows:
            part = rows.where(inside)
            if not span.single:
                narrower = _directed(axis.spans(part, axis.split(span)), order)
                inner, passed = _cover(part, order, axis, narrower, inner_skip, inner_take, most)
            elif len(order) > 1:
                finer, narrower = _spans(part, order[1:])
                inner, passed = _cover(
                    part, order[1:], finer, narrower, inner_skip, inner_take, most
                )
        conditions += [inside & condition for condition in inner]
        if k == 0:
            before = start + passed
    return conditions, before


def select_rows(
    df: DataFrame,
    order: Sequence[str],
    take: int,
    skip: Callable[[int], int],
    most: int = MOST_SORTED,
) -> tuple[DataFrame, int]:
    """``take`` rows of an order after the first ``skip(number of rows)``, in order, and how many
    come before them.

    Descending columns put nulls last, ascending ones first. Rows that agree in the whole order
    come in no fixed order, so an order ends in a unique column. ``df`` is counted several times
    and has to give the same rows each time. At most ``most`` rows besides the page's are sorted,
    unless more than that agree in the whole order.
    """
    axis, spans = _spans(df, order)
    total = sum(span.rows for span in spans)
    after = skip(total)
    if take <= 0 or after >= total:
        return df.limit(0), after
    conditions, before = _cover(df, order, axis, spans, after, min(take, total - after), most)
    near = df.where(reduce(lambda a, b: a | b, conditions))
    # One range of the order, so its top rows are found without a sort of all of them.
    return near.orderBy(*sort_columns(order)).offset(after - before).limit(take), after


def paginate(
    df: DataFrame, order: Sequence[str], page: int, size: int = 10, most: int = MOST_SORTED
) -> DataFrame:
    """Rows of one page; a page number past the end gives the last page, one below 1 the first.

    An empty listing has one empty page.
    """

    def skip(total: int) -> int:
        return (min(max(page, 1), page_count_of(total, size)) - 1) * size

    return select_rows(df, order, size, skip, most)[0]


def limit_offset(
    df: DataFrame, order: Sequence[str], limit: int, offset: int, most: int = MOST_SORTED
) -> DataFrame:
    """Rows ``offset`` .. ``offset + limit`` of an order, without page clamping."""
    return select_rows(df, order, limit, lambda _: max(0, offset), most)[0]


def rank_range(
    df: DataFrame,
    order: Sequence[str],
    first: int,
    last: int | None = None,
    name: str = "position",
    most: int = MOST_SORTED,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Rows on the 1-based positions ``first`` to ``last`` of an order, with their position.

    With ``keys`` these are the positions in every group; without ``last`` they go on to the end.
    A closed range of one order is found by exact selection: only so many rows are numbered, so
    one window task holds no more than the range asked for. Otherwise the rows are numbered in
    value ranges side by side (``with_position``), however many there are.
    """
    first = max(first, 1)
    if keys or last is None:
        placed = with_position(df, order, keys, name)
        upto = F.lit(True) if last is None else F.col(name) <= last
        return placed.where((F.col(name) >= first) & upto)
    rows, after = select_rows(df, order, last - first + 1, lambda _: first - 1, most)
    place = fresh(df, "serial")
    # The rows come out sorted; their serial number follows that order.
    numbered = rows.withColumn(place, F.monotonically_increasing_id())
    return numbered.select(*df.columns, (F.col(place) + F.lit(after + 1)).alias(name))


def page_limit_offset(df: DataFrame, profile: str, limit: int, offset: int) -> DataFrame:
    """Rows ``offset`` .. ``offset + limit`` of a profile's ranking, without page clamping."""
    return limit_offset(df.where(F.col("profile_name") == profile), RANKING, limit, offset)
