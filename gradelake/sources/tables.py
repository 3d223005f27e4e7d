"""Reading and writing the stored tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.functions.text import fmt_cell, parse_topics
from gradelake.operators.maintenance import clear_results
from gradelake.plans.ordering import NEWEST, sort_columns
from gradelake.schemas import LOCAL_ZONE, TABLES
from gradelake.sources.sequences import IdSequence

# Stored times with an offset; all others are local wall-clock times.
_OFFSET = r"([+-]\d\d:?\d\d|Z)$"


def read_table(
    spark: SparkSession, name: str, path: str, fmt: str = "parquet", **options
) -> DataFrame:
    """A stored table with its declared columns (no schema inference)."""
    return spark.read.format(fmt).options(**options).schema(TABLES[name]).load(path)


def read_database_table(
    spark: SparkSession,
    name: str,
    url: str,
    split: str | None = None,
    last: int = 0,
    partitions: int = 64,
    **options,
) -> DataFrame:
    """A table of an existing database through JDBC, with its declared columns.

    ``split`` names a numeric column, such as ``id``, whose ranges up to ``last`` are read in
    parallel; a table without one is read in one go. Not run here: there is no driver.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if split:
        reader = reader.options(
            partitionColumn=split,
            lowerBound="1",
            upperBound=str(max(last, 2)),
            numPartitions=str(partitions),
        )
    rows = reader.load()
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in TABLES[name].fields])


def scan_results(df: DataFrame, profile: str | None = None) -> DataFrame:
    """Results of a profile (or all), newest first; without a profile all rows are sorted."""
    rows = df if profile is None else df.where(F.col("profile_name") == profile)
    return rows.orderBy(*sort_columns(NEWEST))


def scan_configs_pruned(configs: DataFrame, profile: str) -> DataFrame:
    """The two columns the evaluative filter needs."""
    return configs.where(F.col("profile_name") == profile).select(
        "variant_name", "show_feedback"
    )


def decode_configs(configs: DataFrame) -> DataFrame:
    """Configurations with ``temas`` as an array."""
    return configs.withColumn("temas", parse_topics(F.col("temas")))


def instant(text: Column, naive_tz: str = LOCAL_ZONE) -> Column:
    """Either stored time format to an instant; null when it is neither."""
    wall = F.convert_timezone(
        F.lit(naive_tz), F.current_timezone(), text.try_cast("timestamp_ntz")
    ).cast("timestamp")
    return F.when(text.rlike(_OFFSET), text.try_cast("timestamp")).otherwise(wall)


def normalize_attempt_ts(
    df: DataFrame, naive_tz: str = LOCAL_ZONE, source: str = "timestamp_text", name: str = "ts"
) -> DataFrame:
    return df.withColumn(name, instant(F.col(source), naive_tz))


def append_rows(df: DataFrame, path: str, cluster_by: Sequence[str] = ()) -> None:
    """Add rows to a Parquet table.

    ``cluster_by``, such as ``["profile_name", "timestamp"]``, keeps equal values together, so
    a filter on them skips most files by their statistics. Ranges split a hot value as long as
    a later column varies.
    """
    if cluster_by:
        df = df.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)
    df.write.mode("append").parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Replace a table by rows that may have been read from it.

    The rows are written beside the table first. The old folder is then set aside, the new one
    takes its name, and only after that the old one is deleted: at every point one of the two is
    whole under a name that begins with the table's.
    """
    spark = df.sparkSession
    mark = uuid.uuid4().hex
    fresh, old = f"{path.rstrip('/')}.new-{mark}", f"{path.rstrip('/')}.old-{mark}"
    df.write.parquet(fresh)
    place = spark._jvm.org.apache.hadoop.fs.Path
    files = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    stored = files.exists(place(path))
    if stored and not files.rename(place(path), place(old)):
        raise OSError(f"cannot set {path} aside; the new rows are in {fresh}")
    if not files.rename(place(fresh), place(path)):
        raise OSError(f"cannot put {fresh} in place; the old rows are in {old}")
    if stored:
        files.delete(place(old), True)


def clear_table(spark: SparkSession, path: str, sequence: IdSequence | None = None) -> None:
    """Delete every row of a stored table, keep its columns, and let its ids begin at 1 again."""
    replace_table(clear_results(spark.read.parquet(path)), path)
    if sequence is not None:
        sequence.reset()


def _named(column: str) -> Column:
    """A column whose name may hold dots or backticks, as unit names do."""
    return F.col("`" + column.replace("`", "``") + "`")


def gradebook_folder(base: str, profile: str) -> str:
    """Where a profile's gradebook goes; spaces in its name become underscores.

    Characters that would open a folder of their own, or that paths give a meaning, are escaped.
    """
    name = re.sub(r"[^\w.\-]", lambda m: quote(m[0], safe=""), profile.replace(" ", "_"))
    return f"{base.rstrip('/')}/calificaciones_evaluativas_{name}.csv"


def export_gradebook_csv(book: DataFrame, base: str, profile: str) -> str:
    """Write a gradebook as CSV files with a header, students and units sorted, no grade empty."""
    units = sorted(c for c in book.columns if c not in ("profile_name", "student_name"))
    path = gradebook_folder(base, profile)
    rows = book.where(F.col("profile_name") == profile) if "profile_name" in book.columns else book
    rows.select("student_name", *map(_named, units)).orderBy("student_name").write.mode("overwrite").csv(
        path, header=True, nullValue="", emptyValue="", escape='"'
    )
    return path


def gradebook_display(book: DataFrame) -> DataFrame:
    """Grades as two-decimal text, a dash where there is none."""
    keys = [c for c in ("profile_name", "student_name") if c in book.columns]
    units = [c for c in book.columns if c not in keys]
    return book.select(*keys, *[fmt_cell(_named(u)).alias(u) for u in units])
