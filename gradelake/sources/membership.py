"""Which ids of a batch are stored already, without reading the stored ids."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.operators.maintenance import append_attempts
from gradelake.session import materialize
from gradelake.sources.partitioned import PART, PartitionedTable

# Bits per stored key and hashes per key: about one new key in 10,000 looks stored.
BITS_PER_KEY, HASHES = 20, 10
# Bits of one stored bitmap; fixed by Spark's bitmap functions.
BITMAP_BITS = 32768


class KeyFilter:
    """A Bloom filter over the keys of every part of a ``PartitionedTable``.

    A key can only be in the part its hash names, so it is looked up in that part's filter alone.
    A filter is a set of bitmaps in a Parquet table beside the data; filters of two batches of
    keys merge by OR, so an append adds the bitmaps of its own keys and reads nothing. A key that
    the filter does not know is not stored; one that it knows may be, and is looked up exactly.

    ``expected`` is the number of keys a part is meant for. More keys make more look stored,
    which costs reading, never a wrong result; ``build`` anew with a larger number then.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        table: PartitionedTable,
        expected: int,
        bits_per_key: int = BITS_PER_KEY,
        hashes: int = HASHES,
    ):
        self.spark, self.path, self.table = spark, path, table
        self.hashes = hashes
        # The number of bitmaps, and with it every position, depends on these parameters alone.
        self.bits = max(1, -(-expected * bits_per_key // BITMAP_BITS)) * BITMAP_BITS

    def _positions(self) -> Column:
        """The bits of a key, counted from 1."""
        keys = [F.col(k) for k in self.table.keys]
        return F.array(
            *[
                F.pmod(F.xxhash64(F.lit(i), *keys), F.lit(self.bits)) + 1
                for i in range(self.hashes)
            ]
        )

    def _bits_of(self, rows: DataFrame, *keep: str) -> DataFrame:
        spread = rows.select(
            *keep, self.table.part_of().alias(PART), F.explode(self._positions()).alias("position")
        )
        return spread.select(
            *keep,
            PART,
            F.bitmap_bucket_number("position").alias("bitmap_number"),
            F.bitmap_bit_position("position").alias("bit"),
        )

    def add(self, keys: DataFrame) -> None:
        """Add keys. One bitmap per part and stretch of bits is made before the shuffle."""
        made = self._bits_of(keys.select(*self.table.keys)).groupBy(PART, "bitmap_number").agg(
            F.bitmap_construct_agg("bit").alias("bitmap")
        )
        made.write.mode("append").parquet(self.path)

    def merge(self, path: str) -> None:
        """Write the filter to ``path`` with one bitmap per stretch, however many were added."""
        self._bitmaps().write.parquet(path)
        self.path = path

    def _bitmaps(self) -> DataFrame:
        stored = self.spark.read.parquet(self.path)
        return stored.groupBy(PART, "bitmap_number").agg(
            F.bitmap_or_agg("bitmap").alias("bitmap")
        )

    def maybe_stored(self, rows: DataFrame) -> DataFrame:
        """The distinct keys of ``rows`` that the filter knows; all stored ones are among them."""
        keys = self.table.keys
        wanted = self._bits_of(rows.select(*keys).distinct(), *keys)
        byte = F.conv(
            F.hex(F.substring(F.col("bitmap"), (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10
        ).cast("int")
        mask = reduce(
            lambda found, k: found.when(F.col("bit") % 8 == k, F.lit(1 << k)),
            range(1, 8),
            F.when(F.col("bit") % 8 == 0, F.lit(1)),
        )
        met = wanted.join(self._bitmaps(), [PART, "bitmap_number"])
        known = met.where(byte.bitwiseAND(mask) != 0)
        counts = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("known_bits"))
        return counts.where(F.col("known_bits") == self.hashes).select(*keys)


def append_filtered(
    table: PartitionedTable, known: KeyFilter, batch: DataFrame, order: str = "ts"
) -> list[int]:
    """Append the rows of ``batch`` that are not stored yet, each key once; the parts read.

    The result is that of ``append_attempts``. Only the parts of keys the filter knows are read,
    and of those the key columns alone. New rows are added as files; no stored file changes.
    """
    keys = table.keys
    suspects = known.maybe_stored(batch)
    parts = table.parts_with(suspects, keys)
    if parts:
        stored = table.stored_parts(parts).select(*keys)
    else:
        stored = batch.select(*keys).limit(0)
    # Written once: the same rows go to the table and into the filter.
    fresh = materialize(append_attempts(stored, batch, keys, order), "append")
    table.append(fresh)
    known.add(fresh)
    return parts
