"""Statistics and grades that are brought forward by a batch instead of computed anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.operators.grading import ATTEMPT_CELL
from gradelake.plans.ordering import instant_key
from gradelake.schemas import POLICY_LABELS
from gradelake.sources.partitioned import PARTS, PartitionedTable

# What is kept per student and unit. Every one of them merges with its like.
_MERGED = {
    "attempts": lambda: F.sum("attempts").cast("bigint"),
    "graded": lambda: F.sum("graded").cast("bigint"),
    "total": lambda: F.sum("total"),
    "best": lambda: F.max("best"),
    "last": lambda: F.max("last"),
    "last_grade": lambda: F.max_by("last_grade", "last"),
}


def grade_states(attempts: DataFrame) -> DataFrame:
    """One state per student and unit: attempts, those with a grade, total and best grade, and
    the latest attempt as (time, id) packed into one number, with its grade."""
    return _merged(
        attempts.select(
            *ATTEMPT_CELL,
            F.lit(1).cast("bigint").alias("attempts"),
            F.col("grade").isNotNull().cast("bigint").alias("graded"),
            F.col("grade").alias("total"),
            F.col("grade").alias("best"),
            instant_key().alias("last"),
            F.col("grade").alias("last_grade"),
        )
    )


def _merged(states: DataFrame) -> DataFrame:
    return states.groupBy(*ATTEMPT_CELL).agg(*[f().alias(n) for n, f in _MERGED.items()])


def merge_states(states: DataFrame, others: DataFrame) -> DataFrame:
    """States of the attempts behind both; the two must not share an attempt."""
    return _merged(states.unionByName(others))


def state_grades(states: DataFrame, policy: str = "highest") -> DataFrame:
    """``grade_policy`` from states."""
    policy = POLICY_LABELS.get(policy, policy)
    grades: dict[str, Column] = {
        "highest": F.col("best"),
        "latest": F.col("last_grade"),
        "mean": F.try_divide("total", "graded"),
    }
    if policy not in grades:
        raise ValueError(f"unknown grading policy: {policy}")
    return states.select(*ATTEMPT_CELL, grades[policy].alias("grade"))


def state_stats(states: DataFrame) -> DataFrame:
    """``participation_stats`` from states; ``variant_name`` null = all units."""
    profile, unit = F.col("profile_name"), F.col("variant_name")
    return states.groupingSets([[profile], [profile, unit]], profile, unit).agg(
        F.sum("attempts").cast("bigint").alias("participations"),
        F.coalesce(F.sum("total") / F.sum("attempts"), F.lit(0.0)).alias("mean_grade"),
        F.coalesce(F.max("best"), F.lit(0.0)).alias("best_grade"),
    )


class MaintainedGrades:
    """States kept in a stored table that every batch of new attempts brings forward.

    The table is parted by student and subject, so a batch reads and writes the parts of its
    students alone, and statistics are read from one row per student and unit instead of all
    attempts. A batch holds attempts that were not counted before: what ``append_attempts``
    found to be new. Deleting or changing an attempt needs ``rebuild``.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int = PARTS):
        self.table = PartitionedTable(spark, path, ["profile_name", "student_name"], parts)

    def rebuild(self, attempts: DataFrame) -> None:
        """Start from all attempts; the table must not be there yet."""
        self.table.create(grade_states(attempts))

    def add(self, batch: DataFrame) -> list[int]:
        """Bring the states forward by new attempts; the parts that were rewritten."""
        new = grade_states(batch)
        return self.table.rewrite(
            batch.select(*self.table.keys), lambda states: merge_states(states, new)
        )

    def states(self) -> DataFrame:
        return self.table.read()
