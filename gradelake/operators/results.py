"""From an answered quiz to a stored result, and from generated replies to an active version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.functions.quizjson import answer_status
from gradelake.operators.documents import answers_document, question_json, quiz_document
from gradelake.operators.grading import grade_of
from gradelake.operators.maintenance import Sequencer, activate_new_version, insert_ids
from gradelake.operators.versions import first_valid_generation
from gradelake.schemas import MAX_TRIES, QUIZ_RESULTS


def stored_results(sheets: DataFrame, questions: DataFrame, scale: float = 20.0) -> DataFrame:
    """One ``quiz_results`` row, with its declared columns but the id, for every attempt.

    ``sheets`` has attempt_id, student_name, profile_name, variant_name and timestamp;
    ``questions`` a row per question shown: attempt_id, idx, pregunta, opciones,
    respuesta_correcta, explicacion and answer. Questions meet once, on their attempt, and are
    gathered into one cell there, which is bounded by the length of a quiz. An attempt without
    questions has score and grade 0 and no documents.
    """
    correct = answer_status(F.col("answer"), F.col("respuesta_correcta")) == "correct"
    answered = questions.withColumn("_question_json", question_json()).groupBy("attempt_id").agg(
        F.count_if(correct).cast("int").alias("score"),
        F.count(F.lit(1)).cast("int").alias("total_questions"),
        quiz_document().alias("quiz_snapshot_json"),
        answers_document().alias("student_answers_json"),
    )
    joined = sheets.join(answered, "attempt_id", "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("score", "total_questions")}
    )
    graded = joined.withColumn("grade", grade_of(F.col("score"), F.col("total_questions"), scale))
    names = [f.name for f in QUIZ_RESULTS.fields if f.name != "id"]
    return graded.select("attempt_id", *names)


def generate_and_activate(
    quizzes: DataFrame,
    replies: DataFrame,
    expected: DataFrame,
    max_tries: int = MAX_TRIES,
    mode: str = "lenient",
    sequence: Sequencer | None = None,
) -> DataFrame:
    """Stored versions after generated replies are cleaned, judged, stored and activated.

    The first valid of a unit's first ``max_tries`` replies becomes its next version, with the
    next ids in the order of units, and its only active one; a unit without a valid reply keeps
    what it has. ``quizzes`` has id, config_id, quiz_data_json and is_active.
    """
    made = first_valid_generation(replies, expected, max_tries, mode)
    valid = made.where(F.col("attempt").isNotNull()).select("config_id", "quiz_data_json")
    highest = quizzes.agg(F.max("id")).first()[0] or 0
    new = insert_ids(valid, highest, ["config_id"], sequence=sequence)
    new = new.withColumn("is_active", F.lit(1))
    return activate_new_version(quizzes, new.select(*quizzes.columns))
