"""Quiz validation against Python's own JSON reader on awkward texts."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from gradelake.operators import documents

GOOD = '{"pregunta":"x","opciones":{"A":"1"},"respuesta_correcta":"A"}'
TEXTS = [
    f"[{GOOD}]",
    f"  [{GOOD}] \n",
    f"[{GOOD},{GOOD}]",
    GOOD,
    "[]",
    "",
    "null",
    "3",
    "[null]",
    "[1]",
    '["pregunta"]',
    f"[[{GOOD}]]",
    '[{"pregunta":null}]',
    '[{"Pregunta":"x"}]',
    '[{"pregunta":"a","pregunta":"b"}]',
    f"[{GOOD},]",
    f"[{GOOD}",
    f"[{GOOD}] extra",
    f"[{GOOD}] [1]",
    f"[{GOOD}],[1]",
    f'[{GOOD}],"w":[1]',
    f"[{GOOD}]][1]",
    f"[{GOOD}]}} x",
    f"[{GOOD}]// note",
    '[{"pregunta":"a\nb"}]',
    '[{"pregunta":"a\tb"}]',
    '[{"pregunta":"\\q"}]',
    '[{"pregunta":"\\u00e9 \\n"}]',
    "[{'pregunta':'x'}]",
    "[{pregunta:1}]",
    '[{"pregunta":01}]',
    '[{"pregunta":1.5e3,"z":{"y":[1,{"k":null}]}}]',
    '[{"pregunta":NaN}]',
    '[{"pregunta":true}]',
    '[{"pregunta":"x"} {"pregunta":"y"}]',
]


def by_reader(text: str, expected: int, keys: list[str]) -> bool:
    try:
        found = json.loads(text)
    except json.JSONDecodeError:
        return False
    if not isinstance(found, list) or len(found) != expected:
        return False
    return all(isinstance(q, dict) and set(keys) <= set(q) for q in found)


def check(spark, texts):
    df = spark.createDataFrame(
        [(i, t, n) for i, t in enumerate(texts) for n in (1, 2)], "i int, t string, n int"
    ).repartition(8)
    judged = documents.validate_quiz(df, "t", "n", "lenient", "lenient")
    judged = documents.validate_quiz(judged, "t", "n", "strict", "strict")
    for row in judged.collect():
        needed = ["pregunta", "opciones", "respuesta_correcta"]
        assert row["lenient"] == by_reader(row["t"], row["n"], needed[:1]), row["t"]
        assert row["strict"] == by_reader(row["t"], row["n"], needed), row["t"]


def test_awkward_texts(spark):
    check(spark, TEXTS)


def test_damaged_texts(spark):
    """Documents with one character dropped, doubled or replaced."""
    rng = random.Random(7)
    whole = f"[{GOOD}, {GOOD}]"
    texts = []
    for _ in range(600):
        at = rng.randrange(len(whole))
        new = rng.choice(["", whole[at] * 2, rng.choice('[]{}",: x1\n')])
        texts.append(whole[:at] + new + whole[at + 1 :])
    check(spark, texts)


def test_null_text_is_invalid(spark):
    df = spark.range(1).select(F.lit(None).cast("string").alias("t"), F.lit(1).alias("n"))
    assert documents.validate_quiz(df, "t", "n").first()["is_valid"] is False
