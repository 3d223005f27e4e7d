"""Bucketed tables, key filters, checks on the write, and maintained grades."""

from __future__ import annotations

import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from gradelake.operators import grading, quality, statistics
from gradelake.operators.maintenance import append_attempts
from gradelake.plans.ordering import paginate_all
from gradelake.session import scratch_folder, scratch_run
from gradelake.sources.bucketed import attach_bucketed, store_bucketed
from gradelake.sources.membership import BITMAP_BITS, KeyFilter, append_filtered
from gradelake.sources.partitioned import PART, PartitionedTable


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_score_and_join_without_exchange(spark, tmp_path, no_broadcast):
    mark = uuid.uuid4().hex
    answers = spark.range(5000).select(
        (F.col("id") % 700).alias("attempt_id"),
        F.lit("A").alias("respuesta_correcta"),
        F.when(F.col("id") % 3 == 0, "A").otherwise("B").alias("answer"),
    )
    sheets = spark.range(700).select("id", F.lit("p").alias("profile_name"))
    a = store_bucketed(answers, f"a{mark}", str(tmp_path / "a"), ["attempt_id"], 4)
    s = store_bucketed(sheets, f"s{mark}", str(tmp_path / "s"), ["id"], 4)

    def joined(answers, sheets):
        scores = grading.score_attempts(answers).withColumnRenamed("attempt_id", "id")
        return sheets.join(scores, "id", "left")

    plan = plan_of(joined(a, s))
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    expected = sorted(map(tuple, joined(answers, sheets).collect()))
    assert sorted(map(tuple, joined(a, s).collect())) == expected
    assert "Exchange" in plan_of(joined(answers, sheets))
    # The same files under a new name, as another session would see them.
    again = attach_bucketed(
        spark, f"b{mark}", str(tmp_path / "a"), answers.schema, ["attempt_id"], 4
    )
    assert "Exchange" not in plan_of(joined(again, s))
    assert sorted(map(tuple, joined(again, s).collect())) == expected


@pytest.fixture
def stored(spark, tmp_path):
    table = PartitionedTable(spark, str(tmp_path / "attempts"), ["id"], 8)
    rows = spark.range(0, 40_000, 2).select(
        "id", F.lit(1).alias("score"), F.timestamp_seconds("id").alias("ts")
    )
    table.create(rows)
    known = KeyFilter(spark, str(tmp_path / "keys"), table, expected=4000)
    known.add(table.read())
    return table, known


def test_filter_knows_every_stored_key(stored):
    table, known = stored
    assert known.maybe_stored(table.read()).count() == 20_000
    absent = table.read().withColumn("id", F.col("id") + 1)
    assert known.maybe_stored(absent).count() < 200


def test_new_ids_read_little(spark, stored, monkeypatch):
    table, known = stored
    batch = spark.range(1_000_001, 1_000_301).select(
        "id", F.lit(5).alias("score"), F.timestamp_seconds("id").alias("ts")
    )
    read = []
    stored_parts = table.stored_parts
    monkeypatch.setattr(
        table, "stored_parts", lambda parts: read.append(list(parts)) or stored_parts(parts)
    )
    expected = append_attempts(table.read(), batch).count()
    parts = append_filtered(table, known, batch)
    assert expected == 300 and table.read().count() == 20_300
    # 300 keys at one in 10,000: almost always no part at all.
    assert len(parts) <= 2 and read == ([parts] if parts else [])
    # The batch again: all its keys are known now, nothing is added.
    again = append_filtered(table, known, batch)
    assert len(again) == 8 and table.read().count() == 20_300


def test_mixed_batch_is_appended_like_the_plain_way(spark, stored):
    table, known = stored
    rng = random.Random(7)
    rows = [(rng.randrange(60_000), k, None if k % 5 == 0 else k) for k in range(500)]
    batch = spark.createDataFrame(rows, "id long, score int, s long").select(
        "id", "score", F.timestamp_seconds("s").alias("ts")
    )
    expected = sorted(map(tuple, append_attempts(table.read(), batch).collect()))
    before = {tuple(r) for r in table.read().collect()}
    append_filtered(table, known, batch)
    assert sorted(tuple(r) for r in table.read().collect() if tuple(r) not in before) == expected


def test_parts_read_are_pruned(spark, stored):
    table, _ = stored
    plan = plan_of(table.stored_parts([2]).select("id"))
    assert f"PartitionFilters: [isnotnull({PART}" in plan or f"({PART}" in plan
    assert "ReadSchema: struct<id:bigint>" in plan


def test_filters_merge(spark, stored, tmp_path):
    table, known = stored
    extra = spark.range(1, 2001, 2)
    known.add(extra)
    pieces = spark.read.parquet(known.path).count()
    known.merge(str(tmp_path / "merged"))
    merged = spark.read.parquet(known.path)
    assert merged.count() < pieces
    assert known.bits % BITMAP_BITS == 0
    assert merged.groupBy(PART, "bitmap_number").count().where("count > 1").count() == 0
    assert known.maybe_stored(extra).count() == 1000
    assert known.maybe_stored(table.read()).count() == 20_000


def test_null_and_composite_keys(spark, tmp_path):
    table = PartitionedTable(spark, str(tmp_path / "t"), ["a", "b"], 4)
    rows = spark.createDataFrame([("x", 1), ("x", None), (None, 2)], "a string, b int")
    table.create(rows)
    known = KeyFilter(spark, str(tmp_path / "k"), table, expected=10)
    known.add(rows)
    assert known.maybe_stored(rows).count() == 3
    assert known.maybe_stored(rows.limit(0)).count() == 0


def test_checks_ride_along(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, "a", True), (2, None, False), (None, None, None)], "id int, name string, ok boolean"
    )
    checks = quality.WriteChecks(["id", "name"], ["ok"])
    checks.watch(rows).write.parquet(str(tmp_path / "t"))
    assert (checks.rows, checks.nulls, checks.failures) == (3, {"id": 1, "name": 2}, {"ok": 2})
    plain = {r["column_name"]: r["nulls"] for r in
             quality.check_not_null(rows, ["id", "name"]).collect()}
    assert checks.nulls == plain
    none = quality.WriteChecks(["id"])
    none.watch(rows.limit(0)).write.parquet(str(tmp_path / "none"))
    assert (none.rows, none.nulls) == (0, {"id": 0})


def test_checks_need_no_scan_of_their_own(spark, tmp_path):
    """The rows are computed once for the write and the figures."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(1000).mapInArrow(counted, "id long")
    checks = quality.WriteChecks(["id"])
    checks.watch(rows).write.parquet(str(tmp_path / "t"))
    assert checks.nulls == {"id": 0} and checks.rows == 1000 and seen.value == 1000


def test_maintained_equals_a_full_run(spark, tmp_path):
    rng = random.Random(3)
    rows = [
        (i, f"s{rng.randrange(9)}", f"p{rng.randrange(2)}", f"u{rng.randrange(3)}",
         rng.choice([None, float(rng.randrange(21))]), None if i % 11 == 0 else rng.randrange(50))
        for i in range(400)
    ]
    attempts = spark.createDataFrame(
        rows, "id long, student_name string, profile_name string, variant_name string, "
        "grade double, s long"
    ).withColumn("ts", F.timestamp_seconds("s")).drop("s")
    kept = statistics.MaintainedGrades(spark, str(tmp_path / "states"), parts=4)
    kept.rebuild(attempts.where("id < 100"))
    kept.add(attempts.where("id between 100 and 250"))
    # One student: only that student's part is rewritten.
    one = attempts.where("id > 250 and student_name = 's1' and profile_name = 'p0'")
    assert len(kept.add(one)) == 1
    kept.add(attempts.where("id > 250 and not (student_name = 's1' and profile_name = 'p0')"))
    assert kept.add(attempts.limit(0)) == []
    for policy in ("highest", "latest", "mean"):
        full = {tuple(r)[:3]: r["grade"] for r in grading.grade_policy(attempts, policy).collect()}
        mine = {tuple(r)[:3]: r["grade"]
                for r in statistics.state_grades(kept.states(), policy).collect()}
        assert mine.keys() == full.keys()
        if policy != "mean":
            assert mine == full
    with pytest.raises(ValueError):
        statistics.state_grades(kept.states(), "median")


def test_mean_without_grades(spark, tmp_path):
    """Grades that are null count neither here nor in a full run's mean."""
    rows = [(1, "a", "p", "u", None), (2, "a", "p", "u", 10.0), (3, "b", "p", "u", None)]
    attempts = spark.createDataFrame(
        rows, "id long, student_name string, profile_name string, variant_name string, grade double"
    ).withColumn("ts", F.timestamp_seconds("id"))
    states = statistics.grade_states(attempts)
    mine = {r["student_name"]: r["grade"] for r in
            statistics.state_grades(states, "mean").collect()}
    full = {r["student_name"]: r["grade"] for r in grading.grade_mean(attempts).collect()}
    assert mine == full == {"a": 10.0, "b": None}
    stats = statistics.state_stats(states)
    plain = grading.participation_stats(attempts)
    assert sorted(map(tuple, stats.collect()), key=str) == sorted(
        map(tuple, plain.collect()), key=str
    )


def test_run_folder_is_released(spark):
    shared = scratch_folder(spark)
    before = set(os.listdir(shared))
    rows = spark.range(100)
    with scratch_run(spark) as outer:
        assert scratch_folder(spark) == outer
        pages = paginate_all(rows, ["id"], [])
        assert pages.count() == 100 and len(os.listdir(outer)) == 1
        with scratch_run(spark) as inner:
            assert paginate_all(rows, ["-id"], []).count() == 100 and os.path.isdir(inner)
        assert not os.path.exists(inner) and scratch_folder(spark) == outer
    assert set(os.listdir(shared)) == before and scratch_folder(spark) == shared
    with pytest.raises(RuntimeError), scratch_run(spark) as failed:
        rows.write.parquet(f"{failed}/x")
        raise RuntimeError
    assert set(os.listdir(shared)) == before
