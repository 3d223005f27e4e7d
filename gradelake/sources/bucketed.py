"""Tables stored by the hash of a join key, so that joins and groups on it need no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def store_bucketed(
    df: DataFrame, name: str, path: str, keys: Sequence[str], buckets: int
) -> DataFrame:
    """Write ``df`` to ``path`` as the table ``name`` in buckets by ``keys``, and read it.

    Rows are dealt by the keys once, when they are written: one sorted file per bucket. Two
    tables with the same number of buckets by the same keys then join without an exchange, and
    groups by those keys need none either. Aim at buckets of some hundred megabytes. The number
    is best a multiple of the smaller table's, when sizes differ.
    """
    dealt = df.repartition(buckets, *[F.col(k) for k in keys])
    dealt.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option(
        "path", path
    ).saveAsTable(_quoted(name))
    return df.sparkSession.table(_quoted(name))


def attach_bucketed(
    spark: SparkSession,
    name: str,
    path: str,
    schema: T.StructType,
    keys: Sequence[str],
    buckets: int,
) -> DataFrame:
    """The table that ``store_bucketed`` left at ``path``, in a session that does not know it."""
    columns = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
    by = ", ".join(_quoted(k) for k in keys)
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"create table {_quoted(name)} ({columns}) using parquet "
        f"clustered by ({by}) sorted by ({by}) into {buckets} buckets location '{place}'"
    )
    return spark.table(_quoted(name))
