"""Column functions for display text, topics and prompts."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradelake.schemas import LOCAL_ZONE

# Every character a text strip removes.
_SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Trim every kind of whitespace; ``trim`` alone removes only spaces."""
    return F.btrim(text, F.lit(_SPACES))


def fmt_grade(grade: Column) -> Column:
    """Two decimals, ties to even: 7.125 gives 7.12, where ``%.2f`` would give 7.13."""
    return F.call_function("format_number", grade, F.lit("0.00"))


def fmt_cell(grade: Column) -> Column:
    """Gradebook cell; a dash where there is no grade."""
    return F.coalesce(fmt_grade(grade), F.lit("-"))


def fmt_score(score: Column, total: Column) -> Column:
    return F.concat(score.cast("string"), F.lit("/"), total.cast("string"))


def local_time(ts: Column, tz: str) -> Column:
    """Wall-clock time of an instant in a time zone, whatever the session's zone is."""
    return F.convert_timezone(F.current_timezone(), F.lit(tz), ts.cast("timestamp_ntz"))


def fmt_ts_table(ts: Column, tz: str = LOCAL_ZONE) -> Column:
    """``2025-09-01 10:00``"""
    return F.date_format(local_time(ts, tz), "yyyy-MM-dd HH:mm")


def fmt_ts_card(ts: Column, tz: str = LOCAL_ZONE) -> Column:
    """``01 de Sep, 2025 - 10:00``"""
    return F.date_format(local_time(ts, tz), "dd 'de' MMM, yyyy - HH:mm")


def split_topics(text: Column) -> Column:
    """Comma-separated topics as an array, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), strip), lambda topic: topic != "")


def topics_json(topics: Column) -> Column:
    return F.to_json(topics)


def parse_topics(text: Column) -> Column:
    return F.from_json(text, "array<string>")


def join_topics(topics: Column) -> Column:
    return F.array_join(topics, ", ")


def question_summary(question: Column) -> Column:
    """Second paragraph of a question, or all of it when there is only one."""
    parts = F.split(question, "\n\n")
    return strip(F.when(F.size(parts) > 1, F.get(parts, F.lit(1))).otherwise(question))


def exam_question_text(question: Column, show_feedback: Column) -> Column:
    """What the student sees: only the last paragraph when the unit is evaluative."""
    last = F.element_at(F.split(question, "\n\n"), -1)
    return F.when(show_feedback == 1, question).otherwise(last)


def label_variant(name: Column, is_active: Column, style: str = "gray") -> Column:
    """Unit label; inactive units are marked. ``style`` is ``gray`` or ``suffix``."""
    if style == "gray":
        active, inactive = name, F.concat(F.lit(":gray[*"), name, F.lit("*]"))
    elif style == "suffix":
        active, inactive = F.concat(name, F.lit("  ")), F.concat(name, F.lit(" (_inactiva_)"))
    else:
        raise ValueError(f"unknown label style: {style}")
    return F.when(is_active == 1, active).otherwise(inactive)


def slug_profile(profile: Column) -> Column:
    return F.translate(profile, " ", "_")


def gradebook_file_name(profile: Column) -> Column:
    return F.concat(F.lit("calificaciones_evaluativas_"), slug_profile(profile), F.lit(".csv"))


def render_prompt(template: str, fields: dict[str, Column]) -> Column:
    """Fill ``{name}`` placeholders from columns; ``{{`` and ``}}`` are literal braces.

    The template is split once, so braces inside the values are left alone.
    """
    pieces = []
    for literal, name, spec, conversion in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if name is None:
            continue
        if spec or conversion:
            raise ValueError(f"placeholder {{{name}}} must not carry a format")
        if name not in fields:
            raise KeyError(name)
        pieces.append(F.coalesce(fields[name].cast("string"), F.lit("None")))
    return F.concat(*pieces) if pieces else F.lit("")


def prompt_fields() -> dict[str, Column]:
    """Placeholder columns of a configuration row whose ``temas`` is a JSON array."""
    return {
        "asignatura": F.col("asignatura"),
        "num_preguntas": F.col("num_preguntas"),
        "dificultad": F.col("dificultad"),
        "temas_str": join_topics(parse_topics(F.col("temas"))),
    }
