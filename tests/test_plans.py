"""What the physical plans must and must not contain."""

from __future__ import annotations

import re

import pytest

from __spark_entry__ import SMOKE_FOLDER, queries
from gradelake.operators import maintenance
from gradelake.plans.catalog import QUERIES
from gradelake.plans.views import Views

def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_cross_join_no_python_no_global_window(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(queries()[name](spark, SMOKE_FOLDER))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search(r"Cartesian|NestedLoop|EvalPython|InPandas|BroadcastExchange", plan)
    # But over the sizes of ranges, of which there are as many as tasks.
    window = r"Window \[(?!sum\(_rows)[^\n]*\n[^\n]*\n[^\n]*Exchange SinglePartition"
    assert not re.search(window, plan)


@pytest.mark.parametrize(
    "name", ["grade_highest", "grade_latest", "grade_mean", "gradebook_latest", "last_non_null",
             "score_attempts", "latest_version", "participation_stats", "replay_activation",
             "active_version", "first_valid_generation", "append_attempts"]
)
def test_grades_are_aggregated_by_hash_before_the_shuffle(spark, name):
    plan = plan_of(queries()[name](spark, SMOKE_FOLDER))
    assert "SortAggregate" not in plan and "partial_" in plan


def test_profile_filter_reaches_the_scan(spark):
    plan = plan_of(queries()["filter_profile"](spark, SMOKE_FOLDER))
    assert "EqualTo(o_orderpriority,1-URGENT)" in plan


def test_only_needed_columns_are_read(spark):
    plan = plan_of(queries()["page_counts"](spark, SMOKE_FOLDER))
    assert re.findall(r"ReadSchema: (\S+)", plan) == [
        "struct<o_orderkey:bigint,o_orderpriority:string>"
    ]
    scores = plan_of(queries()["score_attempts"](spark, SMOKE_FOLDER))
    assert "Window" not in scores


def test_documents_are_built_and_parsed_in_one_shuffle(spark):
    plan = plan_of(queries()["attempt_review"](spark, SMOKE_FOLDER))
    assert len(re.findall(r"Exchange hash", plan)) == 1
    # Once in the common form, once in the branch for the rare one.
    assert len(re.findall(r"from_json\(StructField\(v,", plan)) == 1


def test_first_tries_are_found_without_their_text(spark):
    plan = plan_of(queries()["first_valid_generation"](spark, SMOKE_FOLDER))
    assert re.search(r"HashAggregate\(keys=\[config_id#\d+\], functions=\[partial_min\(", plan)


def test_small_updates_are_broadcast(spark):
    """The target of an update is not shuffled for it."""
    spark.range(5000).selectExpr("cast(id as string) as key", "id as value", "id").write.parquet(
        path := f"{spark.conf.get('spark.checkpoint.dir')}/upsert-target"
    )
    target = spark.read.parquet(path)
    updates = spark.createDataFrame([("7", 1, 1)], "key string, value long, at long")
    plan = plan_of(maintenance.upsert_latest(target, updates, ["key"], "at"))
    assert "FullOuter" not in plan and "SortAggregate" not in plan
    assert not re.search(r"Exchange hashpartitioning\(key[^\n]*\n[^\n]*\n[^\n]*upsert-target", plan)


def test_answers_window_is_shared(spark):
    plan = plan_of(Views(spark, SMOKE_FOLDER).snapshots())
    assert len(re.findall(r"Exchange hash", plan)) == 1
