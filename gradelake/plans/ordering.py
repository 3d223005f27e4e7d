"""Total orders, row positions and pages that hold up when one group is huge.

An order is a list of column names; a leading ``-`` means descending. Every order ends in a
unique column (normally ``id``), so positions are the same in every run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradelake.session import materialize

NEWEST = ["-ts", "-grade", "id"]
RANKING = ["-grade", "-ts", "id"]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet, compared the way Spark does."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def sort_columns(order: Sequence[str], reverse: bool = False) -> list[Column]:
    """Column expressions of an order, or of its exact reverse."""
    columns = []
    for item in order:
        descending = item.startswith("-")
        column = F.col(item.removeprefix("-"))
        if descending != reverse:
            columns.append(column.desc_nulls_last())
        else:
            columns.append(column.asc_nulls_first())
    return columns


def instant_key(ts: str = "ts", row_id: str = "id") -> Column:
    """(instant, id) packed into one decimal that sorts the same way.

    ``max`` and ``max_by`` over it keep fixed-width buffers, so Spark aggregates by hash with
    map-side combine; over ``struct(ts, id)`` it would sort all rows first.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp")).cast("decimal(20,0)")
    span = F.lit("9223372036854775808").cast("decimal(19,0)")
    floor = F.lit("-9223372036854775808").cast("decimal(20,0)")
    return F.coalesce(micros, floor) * span + F.col(row_id).cast("decimal(19,0)")


def place_in_small_groups(
    df: DataFrame, order: Sequence[str], keys: Sequence[str], name: str = "position"
) -> DataFrame:
    """Add the 1-based position of each row within a group that is small by its nature.

    Every group is one window task: use it where a group is one document or one attempt, never
    for subjects, units or a whole table.
    """
    window = Window.partitionBy(*keys).orderBy(*sort_columns(order))
    return df.withColumn(name, F.row_number().over(window).cast("bigint"))


def with_position(
    df: DataFrame, order: Sequence[str], keys: Sequence[str] = (), name: str = "position"
) -> DataFrame:
    """Add the 1-based position of each row within its group, whatever the groups' sizes.

    The keys and the order's columns, which together tell rows apart, are range-partitioned,
    written once, numbered inside each range and shifted by the rows of earlier ranges, so a
    group with most of the rows is split over tasks. Other columns are neither sorted nor
    written: positions are joined to them. The written rows stay in the shared scratch folder.
    """
    narrow = list(dict.fromkeys([*keys, *(item.removeprefix("-") for item in order)]))
    if len(narrow) == len(df.columns):
        return _numbered(df, order, keys, name)
    placed = _numbered(df.select(*narrow), order, keys, name)
    aliases = {c: fresh(df, f"placed_{c}") for c in narrow}
    placed = placed.select(*[F.col(c).alias(a) for c, a in aliases.items()], F.col(name))
    same = [F.col(c).eqNullSafe(F.col(a)) for c, a in aliases.items()]
    return df.join(placed, same).select(*df.columns, name)


def _numbered(
    df: DataFrame, order: Sequence[str], keys: Sequence[str], name: str
) -> DataFrame:
    serial, piece, row = (fresh(df, c) for c in ("_serial", "_range", "_row"))
    # Range bounds come from a sample and may differ between two runs of the plan: fix them
    # by writing the rows once. monotonically_increasing_id is (range << 33) + row in range.
    sorted_rows = df.orderBy(*[F.col(k) for k in keys], *sort_columns(order))
    written = materialize(
        sorted_rows.withColumn(serial, F.monotonically_increasing_id()), "positions"
    )
    located = written.withColumn(piece, F.shiftright(serial, 33)).withColumn(
        row, F.col(serial) - F.shiftleft(F.col(piece), 33)
    )

    # One row per (group, range) that holds some of it: at most ranges + groups.
    aliases = {k: fresh(df, f"key_{k}") for k in keys}
    pieces = located.groupBy(*[F.col(k).alias(a) for k, a in aliases.items()], piece).agg(
        F.count(F.lit(1)).alias("_rows"), F.min(row).alias("_first")
    )
    earlier = (
        Window.partitionBy(*(aliases.values() or [F.lit(0)]))
        .orderBy(piece)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.coalesce(F.sum("_rows").over(earlier), F.lit(0))
    own, shift = fresh(df, "_piece"), fresh(df, "_shift")
    shifts = pieces.select(
        *aliases.values(), F.col(piece).alias(own), (before - F.col("_first") + 1).alias(shift)
    )
    same = [F.col(piece) == F.col(own)]
    same += [F.col(k).eqNullSafe(F.col(a)) for k, a in aliases.items()]
    return located.join(shifts, same).select(
        *df.columns, (F.col(row) + F.col(shift)).alias(name)
    )


def page_count(rows: Column, size: int) -> Column:
    """Pages needed for a number of rows; an empty listing still has one."""
    return F.greatest(F.lit(1), F.ceil(rows / F.lit(size))).cast("bigint")


def page_count_of(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def page_counts(df: DataFrame, keys: Sequence[str], size: int = 10) -> DataFrame:
    """Pages per group."""
    rows = fresh(df, "rows")
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(rows))
    return counts.select(*keys, page_count(F.col(rows), size).alias("pages"))


def paginate_all(
    df: DataFrame, order: Sequence[str], keys: Sequence[str], size: int = 10
) -> DataFrame:
    """Every row with its page number inside its group."""
    placed = with_position(df, order, keys)
    return placed.withColumn("page", F.floor((F.col("position") - 1) / F.lit(size)) + 1)
