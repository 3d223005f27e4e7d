"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradelake.session import materialize

# White space that separates words: space and the control characters 9 to 13.
BLANKS = " \t\n\x0b\f\r"
WORD = "[^\\x20\\x09-\\x0D]+"
GAP = "[\\x20\\x09-\\x0D]+"

# Rows and bytes that a Python function works on at once. Texts can be long, so this is far
# below what Spark puts into one Arrow batch.
BATCH_ROWS = 256
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet, compared the way Spark does."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    """A column name as ``F.col`` takes it, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often ``body`` names it.

    A plain column would be copied into every lambda that names it when Spark merges
    projections or pushes a filter down.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Words of a text in order; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    none = F.array().cast("array<string>")
    return F.when(trimmed == "", none).otherwise(F.split(trimmed, GAP))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def id_crc(doc_id: Column) -> Column:
    """CRC-32 of the id written as text; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def settled(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back."""
    return materialize(df, f"llm-{label}")


def positions(df: DataFrame, order: Sequence[str], keys: Sequence[str], name: str) -> DataFrame:
    """``df`` with the 1-based place of each row in its group, by ``order``, as column ``name``.

    Rows are range-partitioned on keys and order and written once; ranges are numbered side by
    side and shifted by the rows of earlier ranges, so a large group is split over tasks.
    """
    ids = df.orderBy(*keys, *order).withColumn("serial", F.monotonically_increasing_id())
    # The id is the range in the high bits and the row of that range in the low 33.
    rows = settled(ids, "positions").select(
        *df.columns,
        F.shiftright("serial", 33).alias("range"),
        F.col("serial").bitwiseAND(F.lit((1 << 33) - 1)).alias("row"),
    )
    # One row per group and range that holds some of it.
    parts = rows.groupBy(*keys, "range").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("at"))
    earlier = Window.partitionBy(*keys).orderBy("range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("at") + 1
    shifts = parts.select(*keys, "range", before.alias("shift"))
    return rows.join(shifts, [*keys, "range"]).select(
        *df.columns, (F.col("row") + F.col("shift")).alias(name)
    )


def map_arrow(
    df: DataFrame,
    function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]],
    schema: str,
    rows: int = BATCH_ROWS,
) -> DataFrame:
    """``mapInArrow`` slice by slice, in slices of at most ``rows`` rows.

    Spark's own batches are cut up here, so steps of one plan can ask for different numbers and
    no session setting is touched.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, rows):
                yield from function(part)

    return df.mapInArrow(run, schema)


def slices(
    batch: pa.RecordBatch, rows: int = BATCH_ROWS, size: int = BATCH_BYTES
) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``rows`` rows and ``size`` bytes, one row at least."""
    for at in range(0, len(batch), rows):
        part = batch.slice(at, rows)
        if len(part) > 1 and part.nbytes > size:
            yield from slices(part, len(part) // 2, size)
        else:
            yield part


def raw_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without a detour through Python strings."""
    return column.cast(pa.binary()).to_pylist()
