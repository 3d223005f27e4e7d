"""Scores, grades, repeated-attempt policies, gradebooks and participation statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.functions.quizjson import answer_status
from gradelake.operators.relations import filter_evaluative
from gradelake.plans.ordering import instant_key
from gradelake.schemas import POLICY_LABELS

ATTEMPT_CELL = ["profile_name", "student_name", "variant_name"]

def score_attempts(answers: DataFrame) -> DataFrame:
    """Correct answers and questions per attempt; an unanswered question never counts."""
    correct = answer_status(F.col("answer"), F.col("respuesta_correcta")) == "correct"
    return answers.groupBy("attempt_id").agg(
        F.count_if(correct).cast("int").alias("score"),
        F.count(F.lit(1)).cast("int").alias("total_questions"),
    )


def grade_of(score: Column, total: Column, scale: float = 20.0) -> Column:
    """``score / total`` on a scale; 0 when there are no questions."""
    return F.when(total > 0, score / total * F.lit(float(scale))).otherwise(F.lit(0.0))


def grade_attempts(scores: DataFrame, scale: float = 20.0, total: str = "total_questions"):
    """Add ``grade``. ``total`` may name the configured question count instead."""
    return scores.withColumn("grade", grade_of(F.col("score"), F.col(total), scale))


def _consolidate(policy: str) -> Column:
    """Aggregate that turns a group's grades into one."""
    policy = POLICY_LABELS.get(policy, policy)
    if policy == "highest":
        return F.max("grade")
    if policy == "latest":
        return F.max_by("grade", instant_key())
    if policy == "mean":
        return F.avg("grade")
    raise ValueError(f"unknown grading policy: {policy}")


def grade_policy(attempts: DataFrame, policy: str = "highest") -> DataFrame:
    """One grade per student and unit: ``highest``, ``latest`` or ``mean`` of the attempts."""
    return attempts.groupBy(*ATTEMPT_CELL).agg(_consolidate(policy).alias("grade"))


def grade_highest(attempts: DataFrame) -> DataFrame:
    return grade_policy(attempts, "highest")


def grade_latest(attempts: DataFrame) -> DataFrame:
    return grade_policy(attempts, "latest")


def grade_mean(attempts: DataFrame) -> DataFrame:
    return grade_policy(attempts, "mean")


def gradebook_units(attempts: DataFrame, configs: DataFrame, profile: str) -> list[str]:
    """Names of a subject's evaluative units that have attempts, sorted: its gradebook's columns."""
    rows = filter_evaluative(attempts.where(F.col("profile_name") == profile), configs)
    return sorted(row[0] for row in rows.select("variant_name").distinct().collect())


def gradebook(
    attempts: DataFrame,
    configs: DataFrame,
    policy: str = "highest",
    profile: str | None = None,
    units: Sequence[str] | None = None,
) -> DataFrame:
    """One row per student of a subject, one column per evaluative unit, null without attempts.

    The columns are ``units``, or else the subject's units with attempts. Grades are brought to
    one per student and unit first, then spread over the columns. Without a ``profile`` the
    units have to be given. ``gradebook_rows`` holds the same grades for all subjects.
    """
    if profile is not None:
        attempts = attempts.where(F.col("profile_name") == profile)
    if units is None:
        if profile is None:
            raise ValueError("name the subject, or the units to make columns of")
        units = gradebook_units(attempts, configs, profile)
    cells = gradebook_rows(attempts.where(F.col("variant_name").isin(list(units))), configs, policy)
    by_student = cells.groupBy("profile_name", "student_name")
    if not units:
        return by_student.agg(F.count(F.lit(1)).alias("_")).drop("_")
    return by_student.agg(
        *[
            F.max(F.when(F.col("variant_name") == unit, F.col("grade"))).alias(unit)
            for unit in units
        ]
    )


def gradebook_rows(attempts: DataFrame, configs: DataFrame, policy: str = "highest") -> DataFrame:
    """The gradebook of all subjects as rows: subject, student, evaluative unit, grade."""
    return grade_policy(filter_evaluative(attempts, configs), policy)


def last_non_null(df: DataFrame, keys: Sequence[str], order: Column | None = None) -> DataFrame:
    """Per group and column, the last value that is not null (not the last row)."""
    order = instant_key() if order is None else order
    values = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in values]
    )


def participation_stats(attempts: DataFrame) -> DataFrame:
    """Attempts, mean and best grade per profile and per unit; ``variant_name`` null = all units.

    Units are aggregated first, so the grouping sets run over one row per unit.
    """
    per_unit = attempts.groupBy("profile_name", "variant_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("grade").alias("total"), F.max("grade").alias("best")
    )
    profile, unit = F.col("profile_name"), F.col("variant_name")
    return per_unit.groupingSets([[profile], [profile, unit]], profile, unit).agg(
        F.sum("n").alias("participations"),
        F.coalesce(F.sum("total") / F.sum("n"), F.lit(0.0)).alias("mean_grade"),
        F.coalesce(F.max("best"), F.lit(0.0)).alias("best_grade"),
    )


def selection_stats(attempts: DataFrame) -> DataFrame:
    """The three figures over whatever rows are selected; all 0 when there are none."""
    return attempts.agg(
        F.count(F.lit(1)).alias("participations"),
        F.coalesce(F.avg("grade"), F.lit(0.0)).alias("mean_grade"),
        F.coalesce(F.max("grade"), F.lit(0.0)).alias("best_grade"),
    )


def distinct_profiles(df: DataFrame) -> DataFrame:
    return df.select("profile_name").distinct().orderBy("profile_name")


def distinct_units(df: DataFrame) -> DataFrame:
    return df.select("profile_name", "variant_name").distinct().orderBy(
        "profile_name", "variant_name"
    )
