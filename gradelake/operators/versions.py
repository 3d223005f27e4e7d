"""Which stored quiz version counts: the newest, the active, the first valid reply."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.functions.quizjson import extract_json_list, repair_backslashes
from gradelake.operators.documents import validate_quiz
from gradelake.plans.ordering import instant_key
from gradelake.schemas import MAX_TRIES


def latest_ids(quizzes: DataFrame) -> DataFrame:
    """Id of the newest version per unit; among equal times the higher id.

    Only three narrow columns are aggregated: the quiz text never enters a shuffle.
    """
    return quizzes.groupBy("config_id").agg(
        F.max_by("id", instant_key("created_at", "id")).alias("id")
    )


def latest_version(quizzes: DataFrame) -> DataFrame:
    """The newest version of each unit, whole rows."""
    return quizzes.join(latest_ids(quizzes).select("id"), "id", "left_semi")


def active_version(quizzes: DataFrame) -> DataFrame:
    """The active version of each unit, whole rows; the lowest id if several are active.

    Ids are chosen first, so the quiz text never enters a shuffle.
    """
    active = quizzes.where(F.col("is_active") == 1)
    chosen = active.groupBy("config_id").agg(F.min("id").alias("id"))
    return active.join(chosen, ["config_id", "id"], "left_semi").select(*quizzes.columns)


def first_valid_generation(
    replies: DataFrame,
    expected: DataFrame,
    max_tries: int = MAX_TRIES,
    mode: str = "lenient",
    extraction: str = "list",
) -> DataFrame:
    """Per unit, the first of its first ``max_tries`` replies that is a valid quiz.

    ``replies`` has (config_id, attempt, raw_text), ``expected`` (config_id, num_preguntas).
    Units whose tries all fail come out with a null ``attempt`` and ``quiz_data_json``.
    """
    tried = replies.where(F.col("attempt") <= max_tries).join(expected, "config_id")
    cleaned = tried.withColumn(
        "_doc", repair_backslashes(extract_json_list(F.col("raw_text"), extraction))
    )
    judged = validate_quiz(cleaned, "_doc", "num_preguntas", mode, "_valid")
    # The first valid try is found on two narrow columns; its document is fetched afterwards.
    valid = F.when(F.col("_valid"), F.col("attempt"))
    first = judged.select("config_id", valid.alias("_attempt")).groupBy("config_id")
    first = first.agg(F.min("_attempt").alias("attempt"))
    documents = cleaned.select("config_id", "attempt", F.col("_doc").alias("quiz_data_json"))
    return first.join(documents, ["config_id", "attempt"], "left")


def failed_generations(generations: DataFrame) -> DataFrame:
    return generations.where(F.col("attempt").isNull()).select("config_id")
