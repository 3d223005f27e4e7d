"""Quiz documents to rows and back, clean-up of generated text, seeded shuffles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.functions import quizjson


# Keys of a reviewed question's options.
OPTION_KEYS = ("A", "B", "C", "D")


def clean_replies(replies: DataFrame, column: str = "raw_text", mode: str = "list") -> DataFrame:
    """Add ``quiz_data_json``: the quiz part of each reply with its backslashes repaired."""
    part = quizjson.extract_json_list(F.col(column), mode)
    return replies.withColumn("quiz_data_json", quizjson.repair_backslashes(part))


def validate_quiz(
    df: DataFrame,
    json_column: str = "quiz_data_json",
    expected: str = "num_preguntas",
    mode: str = "lenient",
    name: str = "is_valid",
) -> DataFrame:
    """Add whether the text is one JSON list of ``expected`` questions with the needed keys."""
    text = F.col(json_column)
    checked = df.withColumn("_checked", quizjson.checked_list(text))
    valid = quizjson.list_is_valid(F.col("_checked"), text, F.col(expected), mode)
    return checked.withColumn(name, valid).drop("_checked")


def with_questions(df: DataFrame, json_column: str, name: str = "questions") -> DataFrame:
    """Add the parsed questions of a quiz document.

    Most documents have their options as maps and are parsed in one go; the others are parsed
    again question by question.
    """
    text = F.col(json_column)
    regular = df.withColumn("_regular", quizjson.parse_regular(text))
    questions = F.when(F.col("_regular.broken").isNull(), F.col("_regular.v")).otherwise(
        quizjson.parse_quiz(text)
    )
    return regular.withColumn(name, questions).drop("_regular")


def explode_items(
    df: DataFrame, keep: Sequence[str], items: str, idx: str, item: str
) -> DataFrame:
    """One row per array item with its position; empty and null arrays give none.

    Through the outer form: for the inner one Spark adds a size filter that computes the array
    a second time.
    """
    rows = df.select(*keep, F.posexplode_outer(items).alias(idx, item))
    return rows.where(F.col(idx).isNotNull())


def explode_questions(df: DataFrame, json_column: str = "quiz_data_json") -> DataFrame:
    """One row per question: the other columns, ``idx`` and the question's fields."""
    keep = [c for c in df.columns if c != json_column]
    parsed = with_questions(df, json_column, "_questions")
    rows = explode_items(parsed, keep, "_questions", "idx", "_question")
    return rows.select(*keep, "idx", "_question.*")


def question_json() -> Column:
    """The question fields of a row as JSON."""
    fields = F.struct("pregunta", "opciones", "respuesta_correcta", "explicacion")
    return quizjson.quiz_json(fields)


def quiz_document(question: str = "_question_json") -> Column:
    """Aggregate: the question texts of a group as one quiz document, in ``idx`` order."""
    ordered = F.sort_array(F.collect_list(F.struct("idx", question)))
    return F.concat(F.lit("["), F.array_join(ordered[question], ","), F.lit("]"))


def answers_document(order: str | None = None) -> Column:
    """Aggregate: the answers of a group as one JSON map, question position as string key.

    Of several answers to a question the last by ``order`` stays. The list is bounded by the
    length of a quiz.
    """
    last = F.col(order) if order else F.lit(0)
    given = F.sort_array(F.collect_list(F.struct("idx", last.alias("o"), "answer")))

    def document(answers: Column) -> Column:
        kept = F.filter(
            answers, lambda x, k: F.coalesce(F.get(answers, k + 1)["idx"] != x["idx"], F.lit(True))
        )
        return F.map_from_entries(
            F.transform(kept, lambda x: F.struct(x["idx"].cast("string"), x["answer"]))
        )

    # A one-element transform: the sorted list is made once and named in the lambda.
    return quizjson.quiz_json(F.get(F.transform(F.array(given), document), F.lit(0)))


def assemble_quiz(
    rows: DataFrame, keys: Sequence[str], name: str = "quiz_data_json"
) -> DataFrame:
    """Question rows back to one document per key. A document is one cell of its table."""
    texts = rows.select(*keys, "idx", question_json().alias("_question_json"))
    return texts.groupBy(*keys).agg(quiz_document().alias(name))


def answers_map(
    answers: DataFrame,
    keys: Sequence[str],
    name: str = "student_answers_json",
    order: str | None = None,
) -> DataFrame:
    """Answer rows to one JSON map per attempt; a repeated answer overwrites the one before."""
    return answers.groupBy(*keys).agg(answers_document(order).alias(name))


def normalize_options(df: DataFrame, column: str = "opciones") -> DataFrame:
    """Options given as JSON text, map or list, to a map with letter keys."""
    return df.withColumn(column, quizjson.options_map(F.col(column)))


def shuffle_questions(
    df: DataFrame,
    seed: str,
    key: str,
    json_column: str = "quiz_data_json",
    evaluative: str | None = None,
    limit: str | int | None = None,
) -> DataFrame:
    """Add ``questions``: each quiz's questions redrawn and cut to ``limit``.

    Inside each row, without a shuffle. ``evaluative`` names a boolean column; where it is false
    the order is kept. ``limit`` is a number or a column name.
    """
    keep = F.col(evaluative) if evaluative else None
    cut = F.col(limit) if isinstance(limit, str) else None if limit is None else F.lit(limit)
    drawn = quizjson.shuffled_questions(F.col("questions"), seed, F.col(key), keep, cut)
    return with_questions(df, json_column).withColumn("questions", drawn)


def shuffle_options(df: DataFrame, seed: str, key: Sequence[str]) -> DataFrame:
    """Redraw the options of question rows onto A-D, moving the correct key along.

    The correct key is found by text, as the last option with the correct text. More than four
    options, or a correct key that is not among them, gives ``options_ok`` false and leaves the
    question as it was.
    """
    options, correct = F.col("opciones"), F.col("respuesta_correcta")
    usable = (F.size(options) <= len(quizjson.ANSWER_KEYS)) & F.map_contains_key(options, correct)
    row_key = F.concat_ws(":", *[F.col(k).cast("string") for k in key])
    drawn = df.withColumns(
        {
            "options_ok": F.coalesce(usable, F.lit(False)),
            "_drawn": quizjson.drawn_options(options, correct, seed, row_key),
        }
    )
    letters = F.array(*[F.lit(letter) for letter in quizjson.ANSWER_KEYS])
    count = F.size("_drawn")
    last_correct = count + 1 - F.array_position(F.reverse(F.col("_drawn.is_correct")), F.lit(True))
    renamed = F.map_from_arrays(F.slice(letters, 1, count), F.col("_drawn.text"))
    return drawn.withColumns(
        {
            "opciones": F.when(F.col("options_ok"), renamed).otherwise(options),
            "respuesta_correcta": F.when(
                F.col("options_ok"), F.get(letters, last_correct.cast("int") - 1)
            ).otherwise(correct),
        }
    ).select(*df.columns, "options_ok")


def reviewed_question(df: DataFrame) -> DataFrame:
    """Question rows as a reviewer's form stores them.

    The options are exactly A to D, a missing or null one as empty text; a correct key that is
    none of them becomes A.
    """
    keys = [F.lit(k) for k in OPTION_KEYS]
    values = [F.coalesce(F.try_element_at("opciones", k), F.lit("")) for k in keys]
    correct = F.col("respuesta_correcta")
    return df.withColumns(
        {
            "opciones": F.map_from_arrays(F.array(*keys), F.array(*values)),
            "respuesta_correcta": F.when(correct.isin(*OPTION_KEYS), correct).otherwise(
                F.lit(OPTION_KEYS[0])
            ),
        }
    )
