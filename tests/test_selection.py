"""Pages found by narrowing value ranges, against a full sort of the same rows."""

from __future__ import annotations

import datetime as dt
import math
import os
import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from __spark_entry__ import SMOKE_FOLDER, queries
from gradelake.plans import selection
from gradelake.plans.ordering import NEWEST, sort_columns

SCHEMA = (
    "id long, ts timestamp_ntz, grade double, whole int, tiny byte, flag boolean, day date, "
    "at timestamp, price decimal(10,2), name string, raw binary, share float, serial long, "
    "bucket int, rows string"
)


def rows(n, seed=1):
    rng = random.Random(seed)
    start = dt.datetime(1992, 1, 1)
    made = []
    for i in range(n):
        maybe = lambda value: None if rng.random() < 0.05 else value
        made.append(
            (
                i,
                maybe(start + dt.timedelta(seconds=rng.randrange(10**9), microseconds=i % 3)),
                maybe(rng.choice([0.0, -0.0, 7.5, math.nan, math.inf, -math.inf, rng.gauss(0, 9),
                                  1e300, -1e-300])),
                maybe(rng.randrange(-(2**31), 2**31)),
                maybe(rng.randrange(-128, 128)),
                maybe(rng.random() < 0.3),
                maybe(dt.date(1900, 1, 1) + dt.timedelta(days=rng.randrange(80_000))),
                maybe(start + dt.timedelta(microseconds=rng.randrange(10**15))),
                maybe(Decimal(rng.randrange(-(10**6), 10**6)) / 100),
                maybe(rng.choice(["", "student_", "student_" + str(rng.randrange(10**6)), "é\U0001f600"])),
                maybe(bytes(rng.randrange(256) for _ in range(rng.randrange(4)))),
                maybe(rng.uniform(-1, 1)),
                i % 7, i % 3, "x",
            )
        )
    return made


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(3000), SCHEMA).repartition(6).cache()


def ids(frame):
    return [r["id"] for r in frame.collect()]


@pytest.mark.parametrize(
    "column",
    ["ts", "grade", "whole", "tiny", "flag", "day", "at", "price", "name", "raw", "share", "id"],
)
@pytest.mark.parametrize("sign", ["", "-"])
def test_every_type(table, column, sign):
    order = [f"{sign}{column}"] + ([] if column == "id" else ["id"])
    expected = ids(table.select("id", column).orderBy(*sort_columns(order)))
    for skip, take in ((0, 7), (1490, 25), (2995, 50), (2999, 1)):
        found = selection.limit_offset(table, order, take, skip, most=20)
        assert ids(found) == expected[skip : skip + take]


def test_many_columns(table):
    order = ["-flag", "tiny", "-grade", "name", "id"]
    expected = ids(table.orderBy(*sort_columns(order)))
    for skip in (0, 140, 149, 600, 2100, 2990):
        found = selection.limit_offset(table, order, 10, skip, most=5)
        assert ids(found) == expected[skip : skip + 10]


def test_page_across_two_hot_values(spark):
    """The page begins in one value that fills half the table and ends in the other."""
    df = spark.range(20_000).select(
        "id", (F.col("id") % 2).cast("double").alias("grade"), F.lit(None).cast("date").alias("ts")
    )
    expected = ids(df.orderBy(*sort_columns(NEWEST)))
    found = selection.limit_offset(df, NEWEST, 50, 9_980, most=64)
    assert ids(found) == expected[9_980:10_030]


def test_pages(table):
    expected = ids(table.orderBy(*sort_columns(NEWEST)))
    pages = [ids(selection.paginate(table, NEWEST, p, 700)) for p in range(1, 6)]
    assert sum(pages, []) == expected
    assert ids(selection.paginate(table, NEWEST, 99, 700)) == pages[-1]
    assert ids(selection.paginate(table, NEWEST, -4, 700)) == pages[0]
    none = table.where("id < 0")
    assert selection.paginate(none, NEWEST, 3).count() == 0
    assert selection.paginate(none, NEWEST, 3).columns == table.columns
    assert selection.limit_offset(table, NEWEST, 10, 3000).count() == 0
    assert selection.limit_offset(table, NEWEST, 0, 0).count() == 0


def test_rank_range(table):
    expected = ids(table.orderBy(*sort_columns(NEWEST)))
    found = selection.rank_range(table, NEWEST, 1201, 1260, most=100).collect()
    assert [(r["id"], r["position"]) for r in found] == [
        (i, 1201 + k) for k, i in enumerate(expected[1200:1260])
    ]
    assert selection.rank_range(table, NEWEST, 2990, 4000).count() == 11
    assert selection.rank_range(table, NEWEST, -5, 2).count() == 2
    assert selection.rank_range(table, NEWEST, 9, 8).count() == 0


def test_rank_range_of_every_group(table):
    """Open ranges and groups, null groups too, give the positions of a full sort."""
    order = sort_columns(NEWEST)
    placed = table.withColumn(
        "position", F.row_number().over(Window.partitionBy("flag").orderBy(*order))
    )
    pairs = lambda df: {(r["id"], r["position"]) for r in df.select("id", "position").collect()}
    narrow = table.select("id", "ts", "grade", "flag")
    assert pairs(selection.rank_range(narrow, NEWEST, 1, keys=["flag"])) == pairs(placed)
    assert pairs(selection.rank_range(table, NEWEST, 11, 90, keys=["flag"])) == pairs(
        placed.where("position between 11 and 90")
    )
    expected = ids(table.orderBy(*order))
    assert pairs(selection.rank_range(table, NEWEST, 2991)) == {
        (i, 2991 + k) for k, i in enumerate(expected[2990:])
    }


def test_ranged_query_places_every_attempt(spark):
    """The query ranks all rows of all subjects, not a stretch of one."""
    run = lambda name: {tuple(r) for r in queries()[name](spark, SMOKE_FOLDER).collect()}
    found = run("rank_position_ranged")
    assert len({profile for _, profile, _ in found}) > 1
    assert found == run("rank_position")


def test_type_without_an_order(spark):
    df = spark.createDataFrame([(1, [2])], "id long, xs array<int>")
    with pytest.raises(ValueError, match="cannot page"):
        selection.paginate(df, ["xs", "id"], 1)


def test_nothing_is_sorted_or_written(spark, tmp_path):
    """Only the page's range reaches the sort, and it reaches it through the scan's filters."""
    path = str(tmp_path / "results")
    spark.range(100_000).select(
        "id",
        F.timestamp_micros(F.col("id") * 60_000_000).cast("timestamp_ntz").alias("ts"),
        (F.col("id") % 21).cast("double").alias("grade"),
        F.repeat(F.lit("x"), 20).alias("quiz_snapshot_json"),
    ).write.parquet(path)
    stored = spark.read.parquet(path)
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared))
    page = selection.paginate(stored, NEWEST, 2501, 10, most=500)
    assert ids(page) == [74_999 - k for k in range(10)]
    assert set(os.listdir(shared)) == before
    plan = page._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "TakeOrderedAndProject" in plan
    assert "Exchange" not in plan
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(ts," in plan


def test_counting_reads_the_order_column_only(spark, tmp_path):
    path = str(tmp_path / "results")
    spark.range(1000).select("id", F.lit("wide").alias("quiz_snapshot_json")).write.parquet(path)
    stored = spark.read.parquet(path)
    axis = selection._Axis("id", stored.schema["id"].dataType)
    counted = stored.groupBy(axis.first_split().alias("bucket")).agg(F.count(F.lit(1)), *axis.ends())
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in plan
