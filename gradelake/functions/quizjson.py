"""Column functions over quiz text and quiz documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradelake.functions.text import strip
from gradelake.schemas import OPTIONS_MAP

# Fixed patterns of the reply clean-up.
_LIST_SPAN = r"(?s)\[.*\]"
_FENCES = r"```json|```"
_LONE_BACKSLASH = r'(?<!\\)\\(?!["\\/bfnrt])'
# A replacement string reads two backslashes as one: this writes two.
_TWO_BACKSLASHES = r"\\\\"
_OPTION_PREFIX = r"^[A-Z][\).]\s*"

_STRICT_JSON = {"allowSingleQuotes": "false"}

_RAW_QUIZ = (
    "array<struct<pregunta:string,opciones:string,respuesta_correcta:string,explicacion:string>>"
)

_REGULAR_QUIZ = _RAW_QUIZ.replace("opciones:string", "opciones:map<string,string>")

ANSWER_KEYS = ["A", "B", "C", "D"]


def extract_json_list(text: Column, mode: str = "list") -> Column:
    """The quiz part of a reply: first ``[`` to last ``]``, else the text without fences.

    ``mode="fences"`` only removes the fences.
    """
    unfenced = strip(F.regexp_replace(strip(text), _FENCES, ""))
    if mode == "fences":
        return unfenced
    if mode != "list":
        raise ValueError(f"unknown extraction mode: {mode}")
    span = F.regexp_extract(text, _LIST_SPAN, 0)
    return F.when(span != "", span).otherwise(unfenced)


def repair_backslashes(text: Column) -> Column:
    """Double each backslash that does not start a JSON escape.

    ``\\frac`` and ``\\beta`` look like escapes and stay as they are.
    """
    return F.regexp_replace(text, _LONE_BACKSLASH, _TWO_BACKSLASHES)


def checked_list(text: Column) -> Column:
    """The text as a list of objects, with ``broken`` set when it is not exactly that.

    Keep it in a column of its own before reading its fields, or Spark parses once per field.
    """
    return F.from_json(
        F.concat(F.lit('{"v":'), text, F.lit("}")),
        "v array<map<string,string>>, broken string",
        {**_STRICT_JSON, "columnNameOfCorruptRecord": "broken"},
    )


def list_is_valid(checked: Column, text: Column, expected: Column, mode: str) -> Column:
    """Whether a ``checked_list`` is a quiz of ``expected`` questions with the needed keys.

    ``lenient`` asks for ``pregunta``; ``strict`` for ``opciones`` and ``respuesta_correcta``
    as well. A key may be present with a null value.
    """
    if mode not in ("lenient", "strict"):
        raise ValueError(f"unknown validation mode: {mode}")
    keys = ["pregunta"] if mode == "lenient" else ["pregunta", "opciones", "respuesta_correcta"]

    # from_json stops after the first value. Text after it breaks one of the two wrappers:
    # only "}" or "," can follow inside the object, only "]" or "," inside the array.
    single = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", _STRICT_JSON)

    def has_keys(question: Column) -> Column:
        present = question.isNotNull()
        for key in keys:
            present = present & F.map_contains_key(question, key)
        return present

    passes = (
        checked["broken"].isNull()
        & (F.size(checked["v"]) == expected)
        & F.forall(checked["v"], has_keys)
        & (F.size(single) == 1)
    )
    return F.coalesce(passes, F.lit(False))


def options_map(raw: Column) -> Column:
    """Options as a map; a list becomes ``{"A": ..., "B": ...}`` without ``A)`` prefixes."""
    listed = F.from_json(raw, "array<string>")
    entries = F.transform(
        listed,
        lambda text, i: F.struct(
            F.char(F.lit(65) + i).alias("key"),
            strip(F.regexp_replace(text, _OPTION_PREFIX, "")).alias("value"),
        ),
    )
    return F.when(F.ltrim(raw).startswith("["), F.map_from_entries(entries)).otherwise(
        F.from_json(raw, OPTIONS_MAP)
    )


def parse_quiz(text: Column) -> Column:
    """Quiz JSON to an array of questions with normalised options, whatever form they take."""
    raw = F.from_json(text, _RAW_QUIZ)
    return F.transform(
        raw,
        lambda q: F.struct(
            q["pregunta"].alias("pregunta"),
            options_map(q["opciones"]).alias("opciones"),
            q["respuesta_correcta"].alias("respuesta_correcta"),
            q["explicacion"].alias("explicacion"),
        ),
    )


def parse_regular(text: Column) -> Column:
    """Quiz JSON whose options are all maps; ``broken`` is set when some are not."""
    return F.from_json(
        F.concat(F.lit('{"v":'), text, F.lit("}")),
        f"v {_REGULAR_QUIZ}, broken string",
        {"columnNameOfCorruptRecord": "broken"},
    )


def quiz_json(questions: Column) -> Column:
    """Questions to quiz JSON, null fields kept."""
    return F.to_json(questions, {"ignoreNullFields": "false"})


def parse_answers(text: Column) -> Column:
    return F.from_json(text, OPTIONS_MAP)


def answer_status(answer: Column, correct: Column) -> Column:
    """``unanswered``, ``correct`` or ``incorrect``."""
    return (
        F.when(answer.isNull(), "unanswered")
        .when(answer.eqNullSafe(correct), "correct")
        .otherwise("incorrect")
    )


def seeded_draw(seed: str, *parts: Column) -> Column:
    """Sort key of a repeatable random draw: it depends only on the seed and the parts."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[part.cast("string") for part in parts]))


def shuffled_questions(
    questions: Column, seed: str, key: Column, evaluative: Column | None, limit: Column | None
) -> Column:
    """Questions in a seeded random order, cut to ``limit``; formative quizzes keep theirs."""
    # Only (draw, position) pairs are sorted; the questions are looked up afterwards.
    pairs = F.transform(
        questions,
        lambda q, i: F.struct(seeded_draw(seed, key, i).alias("draw"), i.alias("idx")),
    )
    drawn = F.sort_array(pairs)
    if evaluative is not None:
        drawn = F.when(evaluative, drawn).otherwise(pairs)
    order = drawn["idx"]
    if limit is not None:
        order = F.slice(order, 1, limit)
    return F.transform(
        order, lambda i: F.struct(i.alias("original_idx"), F.get(questions, i).alias("question"))
    )


def drawn_options(options: Column, correct_key: Column, seed: str, key: Column) -> Column:
    """Options in a seeded random order, each with whether its text is the correct one."""
    correct_text = F.try_element_at(options, correct_key)
    return F.sort_array(
        F.transform(
            F.map_entries(options),
            lambda e: F.struct(
                seeded_draw(seed, key, e["key"]).alias("draw"),
                e["key"].alias("key"),
                e["value"].alias("text"),
                e["value"].eqNullSafe(correct_text).alias("is_correct"),
            ),
        )
    )
