"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# The run folder that the current caller opened, if any.
_RUN: ContextVar[str | None] = ContextVar("run_folder", default=None)

# Shuffle partition size aimed at: fits an executor's share of memory without spilling much.
PARTITION_BYTES = 128 * 1024 * 1024


def shuffle_partitions(data_bytes: int, partition_bytes: int = PARTITION_BYTES) -> int:
    """Shuffle partitions for that much shuffled data; AQE merges the ones that stay small."""
    return max(200, -(-data_bytes // partition_bytes))


def build_session(
    app: str, master: str | None = None, data_bytes: int | None = None, **conf
) -> SparkSession:
    """A session with the settings the operators are written for; ``conf`` adds or overrides.

    ``data_bytes`` is the size of the largest table that will be shuffled. AQE can merge shuffle
    partitions but does not split them in an aggregate, so the number has to fit the data.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    if data_bytes is not None:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions(data_bytes))
    settings.update(conf)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_folder(spark: SparkSession) -> str:
    """The run folder that is open, else the shared folder named in spark.checkpoint.dir.

    What is written outside a run stays until the shared folder's owner clears it.
    """
    return _RUN.get() or _shared_folder(spark)


def _shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return folder.rstrip("/")


@contextmanager
def scratch_run(spark: SparkSession) -> Iterator[str]:
    """A folder of its own for everything written in the ``with`` block, deleted at its end.

        with scratch_run(spark):
            paginate_all(results, NEWEST, ["profile_name"]).write.parquet(target)

    Results that still read from it have to be written or collected inside the block. Runs may
    be nested; threads have runs of their own.
    """
    folder = f"{_shared_folder(spark)}/run-{uuid.uuid4().hex}"
    token = _RUN.set(folder)
    try:
        yield folder
    finally:
        _RUN.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back, so later jobs see one fixed result."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
