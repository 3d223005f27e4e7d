"""Filters, projections and joins over configurations, quizzes and attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.functions import text
from gradelake.functions.quizjson import answer_status, parse_answers
from gradelake.operators.documents import explode_items, with_questions
from gradelake.plans.ordering import RANKING, with_position
from gradelake.schemas import PASS_GRADE, LOCAL_ZONE

OPTION_NOT_FOUND = "Opción no encontrada"


def filter_profile(df: DataFrame, profile: str) -> DataFrame:
    return df.where(F.col("profile_name") == profile)


def filter_unit(df: DataFrame, unit: str | None = None) -> DataFrame:
    """Rows of one unit; ``None`` keeps all units."""
    return df if unit is None else df.where(F.col("variant_name") == unit)


def filter_evaluative(attempts: DataFrame, configs: DataFrame) -> DataFrame:
    """Attempts whose unit gives no immediate feedback."""
    evaluative = configs.where(F.col("show_feedback") == 0)
    return attempts.join(evaluative, ["profile_name", "variant_name"], "left_semi")


def filter_active(quizzes: DataFrame) -> DataFrame:
    return quizzes.where(F.col("is_active") == 1)


def list_units(configs: DataFrame, profile: str | None = None) -> DataFrame:
    """Id and name of the units of a profile (or of all), by name."""
    rows = configs if profile is None else filter_profile(configs, profile)
    return rows.select("profile_name", "id", "variant_name").orderBy(
        "profile_name", "variant_name"
    )


def pass_flag(df: DataFrame, threshold: float = PASS_GRADE) -> DataFrame:
    return df.withColumn("passed", F.col("grade") >= threshold)


def participation_table(
    attempts: DataFrame,
    tz: str = LOCAL_ZONE,
    grade_label: str = "Nota",
    position: bool = False,
) -> DataFrame:
    """The five display columns as text; ``position`` adds the rank within the profile."""
    lead = []
    if position:
        shown = ["id", "profile_name", "student_name", "variant_name"]
        shown += ["score", "total_questions", "grade", "ts"]
        attempts = with_position(attempts.select(*shown), RANKING, ["profile_name"])
        lead = [F.col("position").alias("Posición")]
    return attempts.select(
        *lead,
        F.col("student_name").alias("Estudiante"),
        F.col("variant_name").alias("Unidad"),
        text.fmt_score(F.col("score"), F.col("total_questions")).alias("Puntaje"),
        text.fmt_grade(F.col("grade")).alias(grade_label),
        text.fmt_ts_table(F.col("ts"), tz).alias("Fecha"),
    )


def variant_status(configs: DataFrame, quizzes: DataFrame) -> DataFrame:
    """Each unit with 1 if it has an active quiz. Several active versions repeat the unit."""
    active = filter_active(quizzes).select(
        F.col("config_id").alias("_config_id"), F.col("id").alias("_quiz_id")
    )
    return configs.join(active, F.col("id") == F.col("_config_id"), "left").select(
        "id",
        "profile_name",
        "variant_name",
        F.col("_quiz_id").isNotNull().cast("int").alias("is_active"),
    )


def order_units_active_first(status: DataFrame) -> DataFrame:
    return status.orderBy(F.desc("is_active"), "variant_name", "id")


def has_any_quiz(configs: DataFrame, quizzes: DataFrame) -> DataFrame:
    """Each unit with a flag: was any version ever generated for it?"""
    known = quizzes.select(F.col("config_id").alias("_config_id")).distinct()
    return configs.join(known, F.col("id") == F.col("_config_id"), "left").select(
        "id",
        "profile_name",
        "variant_name",
        F.col("_config_id").isNotNull().alias("has_quiz"),
    )


def activity_overview(configs: DataFrame, quizzes: DataFrame) -> DataFrame:
    """Teacher panel: per unit, is it active and how many versions exist."""
    per_config = quizzes.groupBy(F.col("config_id").alias("_config_id")).agg(
        F.max("is_active").alias("_active"), F.count(F.lit(1)).alias("_versions")
    )
    return configs.join(per_config, F.col("id") == F.col("_config_id"), "left").select(
        "id",
        "profile_name",
        "variant_name",
        F.coalesce(F.col("_active"), F.lit(0)).alias("is_active"),
        F.col("_versions").isNotNull().alias("has_quiz"),
        F.coalesce(F.col("_versions"), F.lit(0)).cast("bigint").alias("versions"),
    )


def attempt_review(
    attempts: DataFrame,
    snapshot: str = "quiz_snapshot_json",
    answers: str = "student_answers_json",
) -> DataFrame:
    """Each question of an attempt beside the student's answer and the correction.

    Works inside each row, without a shuffle. Attempts without a snapshot give no rows.
    """
    keep = [c for c in attempts.columns if c not in (snapshot, answers)]
    parsed = with_questions(attempts, snapshot, "_questions").withColumn(
        "_answers", parse_answers(F.col(answers))
    )
    rows = explode_items(parsed, [*keep, "_answers"], "_questions", "idx", "_question")
    question = F.col("_question")
    answer = F.try_element_at("_answers", F.col("idx").cast("string"))

    def option_text(key: Column) -> Column:
        found = F.when(key.isNotNull(), F.try_element_at(question["opciones"], key))
        return F.coalesce(found, F.lit(OPTION_NOT_FOUND))

    correct = question["respuesta_correcta"]
    return rows.withColumn("answer", answer).select(
        *keep,
        "idx",
        question["pregunta"].alias("pregunta"),
        "answer",
        F.when(F.col("answer").isNotNull(), option_text(F.col("answer"))).alias("answer_text"),
        correct.alias("respuesta_correcta"),
        option_text(correct).alias("correct_text"),
        question["explicacion"].alias("explicacion"),
        answer_status(F.col("answer"), correct).alias("status"),
    )
