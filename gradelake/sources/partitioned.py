"""Stored tables of which a change rewrites only the parts it touches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.operators.maintenance import (
    activate_new_version, set_activation, upsert_latest,
)
from gradelake.sources.files import Files
from gradelake.sources.sequences import IdSequence

# Column that names the part of a row; it is a folder, not a stored column.
PART = "key_part"
PARTS = 64


class PartitionedTable:
    """A Parquet table whose folders are parts by the hash of its ``keys``.

    All rows of a key lie in one part, so a change to some keys reads and writes their parts
    alone. ``parts`` is fixed when the table is created; aim at parts of some hundred megabytes.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], parts: int = PARTS):
        self.spark, self.path = spark, path.rstrip("/")
        self.keys, self.parts = list(keys), parts
        self.files = Files(spark, self.path)

    def part_of(self, keys: Sequence[str] | None = None) -> Column:
        hashed = F.xxhash64(*[F.col(k) for k in keys or self.keys])
        return F.pmod(hashed, F.lit(self.parts)).cast("int")

    def create(self, df: DataFrame) -> None:
        """Write the table. Rows are dealt by part; a part with most of the rows is split."""
        self._write(df.withColumn(PART, self.part_of()), "errorifexists")

    def _write(self, placed: DataFrame, mode: str) -> None:
        dealt = placed.hint("rebalance", F.col(PART))
        # Dynamic: an overwrite replaces the parts that get rows and no others.
        dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(
            PART
        ).parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().drop(PART)

    def _stored(self) -> DataFrame:
        # Listed anew each time: parts come and go.
        return self.spark.read.option("basePath", self.path).parquet(self.path)

    def stored_parts(self, parts: Sequence[int]) -> DataFrame:
        """The rows of some parts; the folders of others are not looked into."""
        return self._stored().where(F.col(PART).isin(list(parts))).drop(PART)

    def append(self, rows: DataFrame) -> None:
        """Add rows as new files; no stored file changes."""
        self._write(rows.withColumn(PART, self.part_of()), "append")

    def parts_with(self, rows: DataFrame, on: Sequence[str]) -> list[int]:
        """Parts that hold stored rows equal to ``rows`` in the columns ``on``; only those
        columns are read. For keys of the table the hash says it, without reading."""
        if list(on) == self.keys:
            found = rows.select(self.part_of().alias(PART)).distinct()
        else:
            wanted = rows.select(*on).distinct()
            found = self._stored().select(PART, *on).join(wanted, list(on), "left_semi")
            found = found.select(PART).distinct()
        # As many numbers as the table has parts, at most.
        return sorted(r[0] for r in found.collect())

    def rewrite(
        self,
        touched: DataFrame,
        change: Callable[[DataFrame], DataFrame],
        on: Sequence[str] | None = None,
    ) -> list[int]:
        """Replace the parts that hold ``touched`` by ``change`` of their rows; those parts.

        ``change`` may add, change and drop rows; rows it adds must have keys in ``touched``, and
        one with another key is an error before anything is replaced. Files of other parts are
        neither read nor written. A part left without rows is removed. Parts are replaced when
        all of them have been written, one after the other.
        """
        parts = self.parts_with(touched, on or self.keys)
        if not parts:
            return []
        stored = self._stored()
        columns = [c for c in stored.columns if c != PART]
        changed = change(self.stored_parts(parts)).select(*columns)
        part = self.part_of()
        stray = F.raise_error(F.lit("a row outside the rewritten parts")).cast("int")
        placed = changed.withColumn(PART, F.when(part.isin(parts), part).otherwise(stray))
        before = {p: self.files.stamps(f"{PART}={p}") for p in parts}
        self._write(placed, "overwrite")
        for p, stamps in before.items():
            # Nothing was written in its place.
            if stamps and self.files.stamps(f"{PART}={p}") == stamps:
                self.files.drop(f"{PART}={p}")
        return parts


def upsert_stored(
    table: PartitionedTable,
    updates: DataFrame,
    order: str,
    id_column: str | None = None,
    sequence: IdSequence | None = None,
) -> list[int]:
    """``upsert_latest`` by the table's keys on the parts the updates fall into."""
    return table.rewrite(
        updates.select(*table.keys),
        lambda rows: upsert_latest(rows, updates, table.keys, order, id_column, sequence),
    )


def delete_stored(table: PartitionedTable, gone: DataFrame, on: Sequence[str]) -> list[int]:
    """Delete the rows equal to ``gone`` in the columns ``on``."""
    wanted = gone.select(*on).distinct()
    return table.rewrite(gone, lambda rows: rows.join(wanted, list(on), "left_anti"), on)


def set_activation_stored(
    table: PartitionedTable, requests: DataFrame, order: str | None = None
) -> list[int]:
    """``set_activation`` on a table of versions kept by ``config_id``."""
    return table.rewrite(
        requests.select("config_id"), lambda rows: set_activation(rows, requests, order)
    )


def activate_stored(table: PartitionedTable, new: DataFrame) -> list[int]:
    """``activate_new_version`` on a table of versions kept by ``config_id``."""
    return table.rewrite(new.select("config_id"), lambda rows: activate_new_version(rows, new))
