"""One subject, unit, student or attempt that holds a third of the rows or more."""

from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gradelake.operators import grading, maintenance, relations, versions
from gradelake.plans import ordering, selection
from gradelake.plans.views import Views

ROWS = 60_000


@pytest.fixture(scope="module")
def attempts(spark, tmp_path_factory):
    """Half of all rows are one student's attempts at one unit of one subject."""
    i = F.col("id")
    hot = i % 2 == 0
    path = str(tmp_path_factory.mktemp("skew") / "attempts")
    spark.range(0, ROWS, 1, 8).select(
        "id",
        F.when(hot, "hot").otherwise(F.concat(F.lit("p"), (i % 11).cast("string"))).alias(
            "profile_name"
        ),
        F.when(hot, "same").otherwise(F.concat(F.lit("s"), (i % 501).cast("string"))).alias(
            "student_name"
        ),
        F.when(hot, "u1").otherwise(F.concat(F.lit("u"), (i % 3).cast("string"))).alias(
            "variant_name"
        ),
        (F.abs(F.hash("id")) % 5).cast("double").alias("grade"),
        F.timestamp_seconds(F.abs(F.hash(i + 1)) % 50).alias("ts"),
    ).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def rows(attempts):
    return attempts.collect()


def newest(row):
    return (-row["ts"].timestamp(), -row["grade"], row["id"])


def ranked(row):
    return (-row["grade"], -row["ts"].timestamp(), row["id"])


@pytest.mark.parametrize(
    "number", [ordering.with_position, ordering.place_in_small_groups]
)
def test_positions(attempts, rows, number):
    placed = number(attempts, ordering.RANKING, ["profile_name"])
    groups = defaultdict(list)
    for row in rows:
        groups[row["profile_name"]].append(row)
    expected = {
        row["id"]: n
        for group in groups.values()
        for n, row in enumerate(sorted(group, key=ranked), 1)
    }
    assert {r["id"]: r["position"] for r in placed.collect()} == expected


def test_hot_group_is_split_over_tasks(spark, attempts, monkeypatch):
    written = []
    keep = ordering.materialize
    monkeypatch.setattr(ordering, "materialize", lambda df, label: written.append(keep(df, label))
                        or written[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ordering.with_position(attempts, ordering.RANKING, ["profile_name"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    hot = written[0].where("profile_name = 'hot'")
    per_task = hot.groupBy(F.shiftright("_serial", 33)).count().collect()
    assert len(per_task) >= 4
    assert max(r["count"] for r in per_task) < ROWS / 4


def test_null_groups_keep_their_rows(spark, attempts):
    with_nulls = attempts.withColumn("profile_name", F.nullif("profile_name", F.lit("hot")))
    placed = ordering.with_position(
        with_nulls, ordering.RANKING, ["profile_name"]
    )
    stats = placed.where("profile_name is null").agg(
        F.count("*"), F.min("position"), F.max("position"), F.countDistinct("position")
    ).first()
    assert tuple(stats) == (ROWS // 2, 1, ROWS // 2, ROWS // 2)


def test_pages_of_a_hot_subject(attempts, rows):
    paged = ordering.paginate_all(
        attempts, ordering.NEWEST, ["profile_name"], 10
    )
    hot = sorted((r for r in rows if r["profile_name"] == "hot"), key=newest)
    expected = {r["id"]: n // 10 + 1 for n, r in enumerate(hot)}
    found = {r["id"]: r["page"] for r in paged.where("profile_name = 'hot'").collect()}
    assert found == expected


def test_deep_page(attempts, rows):
    page = selection.paginate(attempts, ordering.NEWEST, 3001, 10)
    expected = sorted(rows, key=newest)[30_000:30_010]
    assert [r["id"] for r in page.collect()] == [r["id"] for r in expected]


def test_ids_are_dense(attempts, rows):
    numbered = maintenance.assign_ids(attempts, 5, ["ts", "id"], "new_id")
    expected = {
        r["id"]: 5 + n for n, r in enumerate(sorted(rows, key=lambda r: (r["ts"], r["id"])), 1)
    }
    assert {r["id"]: r["new_id"] for r in numbered.collect()} == expected


@pytest.mark.parametrize("policy", ["highest", "latest", "mean"])
def test_policies(attempts, rows, policy):
    cells = defaultdict(list)
    for row in rows:
        cells[tuple(row[c] for c in grading.ATTEMPT_CELL)].append(row)
    pick = {
        "highest": lambda group: max(r["grade"] for r in group),
        "latest": lambda group: max(group, key=lambda r: (r["ts"], r["id"]))["grade"],
        "mean": lambda group: sum(r["grade"] for r in group) / len(group),
    }[policy]
    found = {
        tuple(r[c] for c in grading.ATTEMPT_CELL): r["grade"]
        for r in grading.grade_policy(attempts, policy).collect()
    }
    assert found == pytest.approx({cell: pick(group) for cell, group in cells.items()})


def test_semi_join_with_a_hot_unit(spark, attempts, rows):
    configs = attempts.select("profile_name", "variant_name").distinct().withColumn(
        "show_feedback", (F.col("variant_name") == "u0").cast("int")
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = relations.filter_evaluative(attempts, configs).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == sum(r["variant_name"] != "u0" for r in rows)


def test_one_unit_with_most_versions_and_copies(spark, attempts, rows):
    quizzes = attempts.select(
        "id", F.when(F.col("profile_name") == "hot", 1).otherwise(F.col("id") % 9 + 2).alias(
            "config_id"
        ), F.col("ts").alias("created_at"),
    )
    latest = {r["config_id"]: r["id"] for r in versions.latest_version(quizzes).collect()}
    hot = max((r for r in rows if r["profile_name"] == "hot"), key=lambda r: (r["ts"], r["id"]))
    assert latest[1] == hot["id"] and len(latest) == 10

    copies = attempts.withColumn("id", F.when(F.col("profile_name") == "hot", 0).otherwise(
        F.col("id")
    ))
    fresh = maintenance.append_attempts(attempts.where("id < 0"), copies)
    assert fresh.count() == ROWS // 2 + 1


def test_answers_of_a_hot_attempt(spark, tmp_path):
    """Most answer lines belong to one attempt; every one gets a place of its own."""
    spark.range(0, 9000, 1, 4).select(
        F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("l_orderkey"),
        (F.col("id") % 50).alias("l_partkey"),
        F.col("id").alias("l_suppkey"),
        (F.col("id") % 7).cast("int").alias("l_linenumber"),
        (F.col("id") % 60).cast("double").alias("l_quantity"),
        F.lit(1.0).alias("l_extendedprice"),
        F.when(F.col("id") % 4 == 0, "R").otherwise("N").alias("l_returnflag"),
        F.timestamp_seconds("id").cast("timestamp_ntz").alias("l_shipdate"),
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    views = Views(spark, str(tmp_path))
    placed = views.numbered_answers().collect()
    assert len(placed) == 9000
    places = [r["idx"] for r in placed if r["attempt_id"] == 1]
    assert sorted(places) == list(range(6000))


def test_same_plan_at_every_size(spark, attempts):
    """Positions and pages take one path, whatever the number of rows."""
    def shape(df):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        return [line.split()[0] for line in plan.replace("+- ", "").replace(":- ", "").splitlines()]

    # Both inputs are one filter, so that the plans differ in nothing but the rows.
    few, all_rows = attempts.where("id < 7"), attempts.where("id < 1000000000")
    for build in (
        lambda df: ordering.with_position(df, ordering.RANKING, ["profile_name"]),
        lambda df: selection.paginate(df, ordering.NEWEST, 2, 3),
    ):
        assert shape(build(few)) == shape(build(all_rows))
        assert selection.paginate(few, ordering.NEWEST, 2, 3).count() == 3
