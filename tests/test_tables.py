"""Stored tables: reading, appending, replacing, exporting."""

from __future__ import annotations

import csv
import glob

import pytest
from pyspark.sql import functions as F

from gradelake import schemas
from gradelake.operators import maintenance, quality
from gradelake.session import shuffle_partitions
from gradelake.sources import tables


def results_of(spark, ids):
    return spark.createDataFrame(
        [(i, "ana", "p", "u", 1, 2, 10.0, None, None, None) for i in ids], schemas.QUIZ_RESULTS
    )


@pytest.mark.parametrize("fmt", ["parquet", "json", "orc"])
def test_declared_columns_are_read(spark, tmp_path, fmt):
    path = str(tmp_path / fmt)
    results_of(spark, [1, 2]).write.format(fmt).save(path)
    table = tables.read_table(spark, "quiz_results", path, fmt)
    assert table.columns == schemas.QUIZ_RESULTS.names
    assert table.count() == 2


def test_append_replace_clear(spark, tmp_path):
    path = str(tmp_path / "results")
    tables.append_rows(results_of(spark, [1, 2]), path)
    stored = tables.read_table(spark, "quiz_results", path)
    batch = results_of(spark, [2, 3]).withColumnRenamed("timestamp", "ts")
    fresh = maintenance.append_attempts(stored.withColumnRenamed("timestamp", "ts"), batch)
    tables.append_rows(fresh.withColumnRenamed("ts", "timestamp"), path)
    stored = tables.read_table(spark, "quiz_results", path)
    assert sorted(r["id"] for r in stored.collect()) == [1, 2, 3]

    tables.replace_table(stored.where("id <> 2"), path)
    stored = tables.read_table(spark, "quiz_results", path)
    assert sorted(r["id"] for r in stored.collect()) == [1, 3]

    tables.replace_table(maintenance.clear_results(stored), path)
    emptied = spark.read.parquet(path)
    assert emptied.count() == 0 and emptied.columns == schemas.QUIZ_RESULTS.names


def test_clustered_append_keeps_values_together(spark, tmp_path):
    path = str(tmp_path / "clustered")
    rows = spark.range(4000).select(
        F.concat(F.lit("p"), (F.col("id") % 40).cast("string")).alias("profile_name"), "id"
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables.append_rows(rows, path, ["profile_name", "id"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    stored = spark.read.parquet(path).withColumn("file", F.input_file_name())
    assert stored.count() == 4000
    files = stored.groupBy("profile_name").agg(F.countDistinct("file").alias("n")).collect()
    assert max(r["n"] for r in files) <= 2
    assert stored.select("file").distinct().count() > 4


def test_partitions_follow_the_data():
    assert shuffle_partitions(0) == 200
    assert shuffle_partitions(10**12) == 7451
    assert shuffle_partitions(100 * 10**12) == 745_059
    assert shuffle_partitions(10**12, 10**9) == 1000


def test_older_tables_get_the_current_columns(spark):
    older = spark.createDataFrame([(1, "p", "u")], "id long, profile_name string, variant_name "
                                  "string")
    current = spark.createDataFrame(
        [(2, "p", "v", None, None, 5, None, None), (3, "p", "w", None, None, 5, None, 0)],
        "id long, profile_name string, variant_name string, asignatura string, temas string, "
        "num_preguntas int, dificultad string, show_feedback int",
    )
    whole = maintenance.evolve_schema(
        [older, current], schemas.QUIZ_CONFIGS, schemas.COLUMN_DEFAULTS["quiz_configs"]
    )
    assert whole.columns == schemas.QUIZ_CONFIGS.names
    assert {r["id"]: r["show_feedback"] for r in whole.collect()} == {1: 1, 2: None, 3: 0}


def test_declared_constraints_can_be_checked(spark):
    required = schemas.required_columns(schemas.QUIZ_RESULTS)
    nulls = quality.check_not_null(results_of(spark, [1, 1]), required).collect()
    assert {r["column_name"]: r["nulls"] for r in nulls} == dict.fromkeys(required, 0)
    (keys,) = schemas.UNIQUE_KEYS["quiz_results"]
    copies = quality.check_unique(results_of(spark, [1, 1, 2]), keys).collect()
    assert [tuple(r) for r in copies] == [(1, 2)]


def test_gradebook_csv(spark, tmp_path):
    book = spark.createDataFrame(
        [("Cálculo I", 'Pérez, "Ana"', 20.0, None), ("Cálculo I", "Álvarez", None, 40 / 3),
         ("otra", "x", 1.0, 1.0)],
        "profile_name string, student_name string, u2 double, u1 double",
    )
    path = tables.export_gradebook_csv(book, str(tmp_path), "Cálculo I")
    assert path.endswith("/calificaciones_evaluativas_Cálculo_I.csv")
    rows = []
    for part in sorted(glob.glob(f"{path}/*.csv")):
        with open(part, encoding="utf-8", newline="") as file:
            header, *body = csv.reader(file)
            assert header == ["student_name", "u1", "u2"]
            rows += body
    assert rows == [['Pérez, "Ana"', "", "20.0"], ["Álvarez", str(40 / 3), ""]]


def test_gradebook_cells(spark, tmp_path):
    book = spark.createDataFrame(
        [("x", 7.125, None)], "student_name string, `1.1 a``b` double, u2 double"
    )
    shown = tables.gradebook_display(book)
    assert shown.columns == ["student_name", "1.1 a`b", "u2"]
    assert tuple(shown.first()) == ("x", "7.12", "-")
    path = tables.export_gradebook_csv(book, str(tmp_path), "p")
    assert spark.read.csv(path, header=True).columns == shown.columns


def test_csv_options(spark, tmp_path):
    path = str(tmp_path / "csv")
    settings = spark.createDataFrame([("k", "v")], schemas.GLOBAL_SETTINGS)
    settings.write.csv(path, header=True)
    assert tables.read_table(spark, "global_settings", path, "csv", header=True).count() == 1


def test_scan_orders_newest_first(spark):
    rows = spark.range(4).select(
        "id", F.lit("p").alias("profile_name"), (F.col("id") % 2).cast("double").alias("grade"),
        F.timestamp_seconds(F.floor(F.col("id") / 2)).alias("ts"),
    )
    assert [r["id"] for r in tables.scan_results(rows, "p").collect()] == [3, 2, 1, 0]
    assert tables.scan_results(rows, "q").count() == 0
