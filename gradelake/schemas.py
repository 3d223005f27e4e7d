"""Declared tables: columns, defaults and keys."""

from __future__ import annotations

from pyspark.sql import types as T

QUIZ_CONFIGS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("profile_name", T.StringType(), False),
        T.StructField("variant_name", T.StringType(), False),
        T.StructField("asignatura", T.StringType()),
        T.StructField("temas", T.StringType()),
        T.StructField("num_preguntas", T.IntegerType()),
        T.StructField("dificultad", T.StringType()),
        T.StructField("show_feedback", T.IntegerType()),
    ]
)

GENERATED_QUIZZES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("config_id", T.LongType(), False),
        T.StructField("quiz_data_json", T.StringType(), False),
        T.StructField("is_active", T.IntegerType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

QUIZ_RESULTS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("student_name", T.StringType(), False),
        T.StructField("profile_name", T.StringType(), False),
        T.StructField("variant_name", T.StringType(), False),
        T.StructField("score", T.IntegerType(), False),
        T.StructField("total_questions", T.IntegerType(), False),
        T.StructField("grade", T.DoubleType(), False),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("quiz_snapshot_json", T.StringType()),
        T.StructField("student_answers_json", T.StringType()),
    ]
)

GLOBAL_SETTINGS = T.StructType(
    [
        T.StructField("key", T.StringType(), False),
        T.StructField("value", T.StringType()),
    ]
)

TABLES = {
    "quiz_configs": QUIZ_CONFIGS,
    "generated_quizzes": GENERATED_QUIZZES,
    "quiz_results": QUIZ_RESULTS,
    "global_settings": GLOBAL_SETTINGS,
}

# Values a column takes in rows written before the column existed.
COLUMN_DEFAULTS = {
    "quiz_configs": {"show_feedback": 1},
    "generated_quizzes": {"is_active": 0},
    "quiz_results": {},
    "global_settings": {},
}

UNIQUE_KEYS = {
    "quiz_configs": [["id"], ["profile_name", "variant_name"]],
    "generated_quizzes": [["id"]],
    "quiz_results": [["id"]],
    "global_settings": [["key"]],
}

# (child, foreign key, parent, parent key)
FOREIGN_KEYS = [("generated_quizzes", "config_id", "quiz_configs", "id")]

OPTIONS_MAP = T.MapType(T.StringType(), T.StringType())

QUESTION = T.StructType(
    [
        T.StructField("pregunta", T.StringType()),
        T.StructField("opciones", OPTIONS_MAP),
        T.StructField("respuesta_correcta", T.StringType()),
        T.StructField("explicacion", T.StringType()),
    ]
)

# Fixed values of the configuration form.
DIFFICULTIES = ["fácil/intermedio", "intermedio/avanzado", "avanzado/difícil"]
DIFFICULTIES_EARLY = ["fácil", "intermedio", "intermedio/avanzado", "avanzado"]

# Fixed names of the grading policies as the gradebook offers them.
POLICY_LABELS = {
    "Calificación más alta": "highest",
    "Calificación más reciente": "latest",
    "Promedio de calificaciones": "mean",
}

MIN_QUESTIONS = 3
MAX_QUESTIONS = 12
PASS_GRADE = 9.5
PAGE_SIZE = 10
MAX_TRIES = 3


def required_columns(schema: T.StructType) -> list[str]:
    """Names of the columns declared NOT NULL."""
    return [f.name for f in schema.fields if not f.nullable]

# Zone of stored wall-clock times and of times shown.
LOCAL_ZONE = "America/Caracas"
