"""Stored tables: ids that never return, and changes that rewrite only what they touch."""

from __future__ import annotations

import glob
import os

import pytest
from pyspark.sql import functions as F

from gradelake.operators.maintenance import insert_ids, upsert_latest
from gradelake.sources import tables
from gradelake.sources.partitioned import (
    PART, PartitionedTable, activate_stored, delete_stored, set_activation_stored, upsert_stored,
)
from gradelake.sources.sequences import ConcurrentInsert, IdSequence


@pytest.fixture
def sequence(spark, tmp_path):
    return IdSequence(spark, str(tmp_path / "sequence"))


def test_sequence(spark, sequence, tmp_path):
    assert sequence.last() == 0
    assert sequence.reserve(3) == 0 and sequence.last() == 3
    assert sequence.reserve(2, at_least=10) == 10 and sequence.last() == 12
    assert sequence.reserve(0) == 12 and sequence.last() == 12
    assert sequence.reserve(1, at_least=5) == 12
    # Another session of the same table goes on from the stored mark.
    assert IdSequence(spark, str(tmp_path / "sequence")).reserve(1) == 13
    sequence.reset()
    assert sequence.last() == 0 and sequence.reserve(1) == 0
    assert len(glob.glob(f"{tmp_path}/sequence/mark-*")) == 1
    with pytest.raises(ValueError):
        sequence.reserve(-1)


def test_two_inserts_at_once(sequence, monkeypatch):
    sequence.reserve(5)
    make = sequence._files.make

    def met(name):
        make(name)
        make(name[:13 + 4] + "-" + "9".zfill(20) + "-other")

    monkeypatch.setattr(sequence._files, "make", met)
    with pytest.raises(ConcurrentInsert):
        sequence.reserve(1)


def test_deleted_id_does_not_return(spark, sequence):
    keys = ["profile_name", "variant_name"]
    target = spark.createDataFrame(
        [(1, "p", "a"), (2, "p", "b")], "id int, profile_name string, variant_name string"
    )
    sequence.reserve(0, 2)
    again = spark.createDataFrame(
        [("p", "b", 1), ("p", "c", 2)], "profile_name string, variant_name string, seq long"
    )
    kept = target.where("id < 2")
    rows = upsert_latest(kept, again, keys, "seq", "id", sequence).collect()
    assert sorted((r["id"], r["variant_name"]) for r in rows) == [(1, "a"), (3, "b"), (4, "c")]
    # Without a sequence the highest id left is followed.
    rows = upsert_latest(kept, again, keys, "seq", "id").collect()
    assert sorted(r["id"] for r in rows) == [1, 2, 3]


def test_nothing_to_insert(spark, sequence):
    none = spark.createDataFrame([], "name string")
    assert insert_ids(none, 4, ["name"], sequence=sequence).count() == 0
    assert sequence.last() == 4


def test_helper_names_may_be_taken(spark):
    """Columns that carry the names helpers would use."""
    schema = "id int, k string, rank int, new_k int, updated int, first_seen int, serial int"
    target = spark.createDataFrame([(1, "a", 1, 2, 3, 4, 5)], schema)
    updates = spark.createDataFrame([("a", 9, 9, 1), ("b", 7, 7, 2)],
                                    "k string, rank int, updated int, seq int")
    rows = upsert_latest(target, updates, ["k"], "seq", "id").collect()
    assert sorted((r["id"], r["k"], r["rank"], r["updated"], r["serial"]) for r in rows) == sorted(
        [(1, "a", 9, 9, 5), (2, "b", 7, 7, None)], key=str
    )


def test_clear_resets_ids(spark, sequence, tmp_path):
    path = str(tmp_path / "results")
    spark.createDataFrame([(7, "x")], "id long, name string").write.parquet(path)
    sequence.reserve(0, 7)
    tables.clear_table(spark, path, sequence)
    assert spark.read.parquet(path).columns == ["id", "name"]
    assert spark.read.parquet(path).count() == 0 and sequence.reserve(1) == 0


def files(table):
    found = glob.glob(f"{table.path}/{PART}=*/*.parquet")
    return {os.path.relpath(f, table.path): os.stat(f).st_mtime_ns for f in found}


@pytest.fixture
def table(spark, tmp_path):
    made = PartitionedTable(spark, str(tmp_path / "configs"), ["profile_name", "variant_name"], 8)
    rows = spark.range(1, 201).select(
        F.col("id").cast("int").alias("id"),
        F.concat(F.lit("p"), F.col("id") % 5).alias("profile_name"),
        F.concat(F.lit("unit_"), F.col("id").cast("string")).alias("variant_name"),
        F.lit(3).alias("num_preguntas"),
    )
    made.create(rows)
    return made


def updates_of(spark, rows):
    return spark.createDataFrame(
        rows, "profile_name string, variant_name string, num_preguntas int, seq int"
    )


def test_upsert_touches_its_parts_alone(spark, table, sequence):
    before = files(table)
    assert len({os.path.dirname(f) for f in before}) == 8
    sequence.reserve(0, 200)
    updates = updates_of(spark, [("p1", "unit_1", 9, 1), ("p0", "unit_900", 5, 2)])
    expected = upsert_latest(table.read(), updates, table.keys, "seq", "id").collect()
    parts = upsert_stored(table, updates, "seq", "id", sequence)
    assert 1 <= len(parts) <= 2
    assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, expected))
    after, touched = files(table), {f"{PART}={p}" for p in parts}
    untouched = {f: t for f, t in before.items() if os.path.dirname(f) not in touched}
    assert len({os.path.dirname(f) for f in untouched}) == 8 - len(parts)
    assert untouched.items() <= after.items()
    assert not any(os.path.dirname(f) in touched for f in before.keys() & after.keys())


def test_delete_and_emptied_parts(spark, table):
    gone = table.read().where("id <= 3")
    before = files(table)
    parts = delete_stored(table, gone, ["id"])
    assert len(parts) <= 3
    assert sorted(r["id"] for r in table.read().collect()) == list(range(4, 201))
    kept = {f: t for f, t in before.items() if os.path.dirname(f)[len(PART) + 1:] not in map(str, parts)}
    assert kept.items() <= files(table).items()
    # All rows of some parts: their folders go.
    whole = table.read().where(table.part_of().isin(1, 2))
    assert delete_stored(table, whole, ["id"]) == [1, 2]
    assert not any(f.startswith((f"{PART}=1/", f"{PART}=2/")) for f in files(table))
    left = table.read()
    assert left.where(table.part_of().isin(1, 2)).count() == 0 and left.count() > 0
    assert delete_stored(table, whole.limit(0), ["id"]) == []


def test_rows_outside_the_parts_are_an_error(spark, table):
    before = files(table)
    touched = updates_of(spark, [("p1", "unit_1", 9, 1)])
    with pytest.raises(Exception, match="outside the rewritten parts"):
        table.rewrite(touched, lambda rows: rows.withColumn("variant_name", F.lit("elsewhere"))
                      .withColumn("profile_name", F.col("id").cast("string")))
    assert files(table) == before


def test_activation_in_parts(spark, tmp_path):
    table = PartitionedTable(spark, str(tmp_path / "versions"), ["config_id"], 4)
    rows = [(i, i % 10, 1 if i >= 20 else 0, i) for i in range(30)]
    schema = "id long, config_id int, is_active int, created_at int"
    table.create(spark.createDataFrame(rows, schema).withColumn(
        "created_at", F.timestamp_seconds("created_at")))
    before = files(table)
    requests = spark.createDataFrame([(3, 0, 1), (3, 1, 2), (4, 0, 1)],
                                     "config_id int, is_active int, n int")
    parts = set_activation_stored(table, requests, "n")
    active = {r["id"] for r in table.read().where("is_active = 1").collect()}
    assert active == set(range(20, 30)) - {24}
    assert len(set(before) - set(files(table))) <= sum(1 for f in before if any(
        f.startswith(f"{PART}={p}/") for p in parts))
    new = spark.createDataFrame([(30, 4, 0, 99)], schema).withColumn(
        "created_at", F.timestamp_seconds("created_at"))
    activate_stored(table, new)
    assert {r["id"] for r in table.read().where("is_active = 1").collect()} == (active | {30})


def test_a_part_with_most_of_the_rows(spark, tmp_path):
    """A hot key is one part, and its rows still reach it from several tasks."""
    table = PartitionedTable(spark, str(tmp_path / "versions"), ["config_id"], 4)
    held = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16k")
    try:
        table.create(spark.range(40_000, numPartitions=8).select(
            "id", F.lit(1).alias("config_id"), F.md5(F.col("id").cast("string")).alias("doc")))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", held)
    assert len(files(table)) > 1
    assert table.read().count() == 40_000
