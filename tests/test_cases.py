"""Small hand-made cases for the edges of each operator."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradelake.functions import quizjson, text
from gradelake.operators import documents, grading, maintenance, quality, relations, versions
from gradelake.plans import ordering, selection
from gradelake.schemas import DIFFICULTIES_EARLY
from gradelake.sources import tables


def values(df, column="x"):
    return [row[column] for row in df.collect()]


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def attempts_of(spark, rows):
    """(id, student, unit, score, total, grade, second) rows of one profile."""
    start = dt.datetime(2025, 9, 1, 10, 0, 0)
    full = [
        (i, student, "Cálculo I", unit, score, total, float(grade), start + dt.timedelta(0, sec))
        for i, student, unit, score, total, grade, sec in rows
    ]
    return spark.createDataFrame(
        full,
        "id long, student_name string, profile_name string, variant_name string, score int, "
        "total_questions int, grade double, ts timestamp",
    )


# --- Grades ----------------------------------------------------------------------------------


def test_no_questions_gives_zero(spark):
    scores = spark.createDataFrame([(0, 0), (3, 8)], "score int, total_questions int")
    assert values(grading.grade_attempts(scores), "grade") == [0.0, 7.5]
    assert values(grading.grade_attempts(scores, 19.0), "grade") == [0.0, 7.125]


def test_grade_divides_before_it_scales(spark):
    scores = spark.createDataFrame([(1, 3), (2, 7)], "score int, total_questions int")
    assert values(grading.grade_attempts(scores), "grade") == [1 / 3 * 20, 2 / 7 * 20]


def test_grade_against_configured_total(spark):
    scores = spark.createDataFrame([(3, 5, 10)], "score int, total_questions int, planned int")
    assert values(grading.grade_attempts(scores, total="planned"), "grade") == [6.0]


def test_grade_text_rounds_ties_to_even(spark):
    grades = spark.createDataFrame([(7.125,), (7.375,), (20.0,), (0.0,), (2.675,)], "g double")
    shown = values(grades.select(text.fmt_grade(F.col("g")).alias("x")))
    assert shown == [f"{g:.2f}" for g in (7.125, 7.375, 20.0, 0.0, 2.675)]


def test_unanswered_never_counts(spark):
    answers = spark.createDataFrame(
        [(1, None, "A"), (1, "A", "A"), (1, "B", "A"), (2, None, None)],
        "attempt_id long, answer string, respuesta_correcta string",
    )
    rows = {r[0]: (r[1], r[2]) for r in grading.score_attempts(answers).collect()}
    assert rows == {1: (1, 3), 2: (0, 1)}


def test_policies_and_time_ties(spark):
    attempts = attempts_of(
        spark,
        [
            (1, "ana", "u1", 5, 10, 10, 0),
            (2, "ana", "u1", 9, 10, 18, 0),
            (3, "ana", "u1", 8, 10, 16, 0),
            (4, "ana", "u2", 2, 10, 4, 5),
        ],
    )
    by_policy = {
        p: {r["variant_name"]: r["grade"] for r in grading.grade_policy(attempts, p).collect()}
        for p in ("highest", "latest", "mean")
    }
    assert by_policy["highest"] == {"u1": 18.0, "u2": 4.0}
    assert by_policy["latest"] == {"u1": 16.0, "u2": 4.0}
    assert by_policy["mean"] == {"u1": pytest.approx(44 / 3), "u2": 4.0}
    labelled = grading.grade_policy(attempts, "Calificación más alta").collect()
    assert {r["variant_name"]: r["grade"] for r in labelled} == by_policy["highest"]
    with pytest.raises(ValueError):
        grading.grade_policy(attempts, "median")


@pytest.mark.parametrize("policy", ["highest", "latest", "mean"])
def test_gradebook_as_columns_and_as_rows(spark, policy):
    attempts = attempts_of(
        spark,
        [
            (1, "ana", "u1", 5, 10, 10, 0),
            (2, "ana", "u1", 9, 10, 18, 9),
            (3, "ana", "u2", 9, 10, 18, 0),
            (4, "leo", "u2", 1, 10, 2, 1),
            (5, "eva", "u3", 1, 10, 2, 1),
        ],
    )
    configs = spark.createDataFrame(
        [("Cálculo I", "u1", 0), ("Cálculo I", "u2", 0), ("Cálculo I", "u3", 1),
         ("Cálculo I", "u4", 0)],
        "profile_name string, variant_name string, show_feedback int",
    )
    wide = grading.gradebook(attempts, configs, policy, "Cálculo I")
    assert wide.columns == ["profile_name", "student_name", "u1", "u2"]
    cells = {(r["student_name"], u): r[u] for r in wide.collect() for u in ("u1", "u2")}
    long = {
        (r["student_name"], r["variant_name"]): r["grade"]
        for r in grading.gradebook_rows(attempts, configs, policy).collect()
    }
    assert long == {cell: grade for cell, grade in cells.items() if grade is not None}
    assert cells["leo", "u1"] is None and len(long) == 3
    given = grading.gradebook(attempts, configs, policy, units=["u2", "u9"])
    assert given.columns == ["profile_name", "student_name", "u2", "u9"]
    with pytest.raises(ValueError):
        grading.gradebook(attempts, configs, policy)


def test_statistics_of_nothing_are_zero(spark):
    nobody = attempts_of(spark, [(1, "ana", "u1", 1, 1, 20, 0)]).where("id < 0")
    assert tuple(grading.selection_stats(nobody).first()) == (0, 0.0, 0.0)


def test_last_non_null_is_per_column(spark):
    rows = spark.createDataFrame(
        [("k", 1, 1, 1, None), ("k", 2, 2, None, "b"), ("k", 3, 3, None, None)],
        "k string, id long, second int, a int, b string",
    ).withColumn("ts", F.timestamp_seconds("second"))
    last = grading.last_non_null(rows.drop("second"), ["k"]).first()
    assert (last["a"], last["b"], last["id"]) == (1, "b", 3)


# --- Text ------------------------------------------------------------------------------------


def test_strip_removes_what_a_text_strip_removes(spark):
    near_space = [chr(c) for c in (*range(0x21), 0x7F, 0x85, 0xA0, 0x1680, 0x180E,
                                   *range(0x2000, 0x2030), 0x205F, 0x2060, 0x3000, 0xFEFF)]
    cases = [f"{c}{c}a {c} b{c}" for c in near_space] + ["", " ", "\u3000\n", "é"]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string").orderBy("i")
    found = values(df.select(text.strip(F.col("t")).alias("x")))
    assert found == [case.strip() for case in cases]


def test_topics(spark):
    assert one(spark, text.split_topics(F.lit(" a, b,,\t c\n "))) == ["a", "b", "c"]
    assert one(spark, text.split_topics(F.lit(" , "))) == []
    assert one(spark, text.parse_topics(text.topics_json(F.array(F.lit("á"), F.lit('"'))))) == [
        "á",
        '"',
    ]


def test_question_paragraphs(spark):
    assert one(spark, text.question_summary(F.lit("a\n\n b \n\nc"))) == "b"
    assert one(spark, text.question_summary(F.lit(" only "))) == "only"
    last = text.exam_question_text(F.lit("a\n\nb\n\nc"), F.lit(0))
    assert one(spark, last) == "c"
    assert one(spark, text.exam_question_text(F.lit("a\n\nb"), F.lit(1))) == "a\n\nb"
    assert one(spark, text.exam_question_text(F.lit("a\n\n"), F.lit(0))) == ""


def test_prompt_keeps_braces_of_values(spark):
    fields = {"a": F.lit("{b}"), "b": F.lit(3), "c": F.lit(None)}
    assert one(spark, text.render_prompt("{{x}} {a} {b} {c}", fields)) == "{x} {b} 3 None"
    with pytest.raises(KeyError):
        text.render_prompt("{missing}", fields)


def test_times_are_shown_in_the_given_zone(spark):
    stored = spark.createDataFrame(
        [("2025-09-01T10:00:00-04:00",), ("2025-09-01 10:00:00",),
         ("2025-09-01T10:00:00.250000-04:00",), ("nonsense",)], "timestamp_text string"
    )
    rows = tables.normalize_attempt_ts(stored)
    micros = values(rows.select(F.unix_micros("ts").alias("x")))
    assert micros[0] == micros[1] == micros[2] - 250_000 == 1756735200 * 10**6
    assert micros[3] is None
    shown = rows.select(
        text.fmt_ts_table(F.col("ts"), "America/Caracas").alias("x"),
        text.fmt_ts_card(F.col("ts"), "America/Caracas").alias("y"),
    ).first()
    assert tuple(shown) == ("2025-09-01 10:00", "01 de Sep, 2025 - 10:00")


def test_times_do_not_depend_on_the_session_zone(spark):
    stored = spark.createDataFrame([("2025-09-01 10:00:00",)], "timestamp_text string")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        row = tables.normalize_attempt_ts(stored).select(
            F.unix_micros("ts"), text.fmt_ts_table(F.col("ts"), "America/Caracas")
        ).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert tuple(row) == (1756735200 * 10**6, "2025-09-01 10:00")


# --- Quiz documents --------------------------------------------------------------------------


def test_lone_backslashes(spark):
    cases = {
        r"\alpha": r"\\alpha",
        r"\frac": r"\frac",
        "\\u00e9": "\\\\u00e9",
        r"a\\b": r"a\\b",
        "end\\": "end\\\\",
        r"\"q\"": r"\"q\"",
        r"\alpha\beta\gamma": r"\\alpha\beta\\gamma",
    }
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    repaired = values(df.select(quizjson.repair_backslashes(F.col("t")).alias("x")))
    assert repaired == list(cases.values())


def test_list_extraction(spark):
    cases = {
        "Sure:\n```json\n[1,\n[2]]\n``` bye": "[1,\n[2]]",
        "```json\n{}\n```": "{}",
        "\u00a0 none \x1c": "none",
        "a [x] b [y] c": "[x] b [y]",
    }
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert values(df.select(quizjson.extract_json_list(F.col("t")).alias("x"))) == list(
        cases.values()
    )
    fenced = F.lit("```json\n[1]\n``` bye")
    assert one(spark, quizjson.extract_json_list(fenced, "fences")) == "[1]\n bye"


def test_options_in_both_forms(spark):
    assert one(spark, quizjson.options_map(F.lit('["A) x","B. y"," z "]'))) == {
        "A": "x",
        "B": "y",
        "C": "z",
    }
    assert one(spark, quizjson.options_map(F.lit('{"A":"A) x"}'))) == {"A": "A) x"}


def test_mixed_document(spark):
    doc = '[{"pregunta":"p","opciones":{"A":"1"}},{"pregunta":"q","opciones":["A) 1","B) 2"]}]'
    df = spark.createDataFrame([(1, doc), (2, None), (3, "[]"), (4, "broken")], "id int, d string")
    rows = documents.explode_questions(df, "d").orderBy("idx").collect()
    assert [(r["id"], r["idx"], r["opciones"]) for r in rows] == [
        (1, 0, {"A": "1"}),
        (1, 1, {"A": "1", "B": "2"}),
    ]


def test_five_options_are_flagged(spark):
    five = F.create_map(*[F.lit(x) for pair in zip("ABCDE", "vwxyz") for x in pair])
    row = spark.range(1).select(
        "id", F.lit("p").alias("pregunta"), five.alias("opciones"),
        F.lit("E").alias("respuesta_correcta"), F.lit("e").alias("explicacion"),
    )
    drawn = documents.shuffle_options(row, "s", ["id"]).first()
    assert drawn["options_ok"] is False
    assert drawn["opciones"]["E"] == "z" and drawn["respuesta_correcta"] == "E"


def test_missing_correct_key_is_flagged(spark):
    two = F.create_map(F.lit("A"), F.lit("x"), F.lit("B"), F.lit("y"))
    row = spark.range(1).select(
        "id", F.lit("p").alias("pregunta"), two.alias("opciones"),
        F.lit("C").alias("respuesta_correcta"), F.lit("e").alias("explicacion"),
    )
    assert documents.shuffle_options(row, "s", ["id"]).first()["options_ok"] is False


def test_equal_option_texts_take_the_later_key(spark):
    rows = spark.range(40).select(
        "id",
        F.lit("p").alias("pregunta"),
        F.create_map(*[F.lit(x) for x in ("A", "s", "B", "t", "C", "s", "D", "u")]).alias(
            "opciones"
        ),
        F.lit("A").alias("respuesta_correcta"),
        F.lit("e").alias("explicacion"),
    )
    seen = set()
    for row in documents.shuffle_options(rows, "s", ["id"]).collect():
        same = [k for k, v in row["opciones"].items() if v == "s"]
        assert row["respuesta_correcta"] == max(same)
        assert sorted(row["opciones"].values()) == ["s", "s", "t", "u"]
        seen.add(tuple(row["opciones"].values()))
    assert len(seen) > 3


def test_question_shuffle_only_when_evaluative(spark):
    doc = "[" + ",".join(f'{{"pregunta":"q{i}"}}' for i in range(6)) + "]"
    df = spark.createDataFrame(
        [(i, doc, i % 2 == 0, 4) for i in range(20)], "id int, d string, evaluative boolean, n int"
    )
    drawn = documents.shuffle_questions(df, "s", "id", "d", "evaluative", "n").collect()
    orders = {r["id"]: [q["original_idx"] for q in r["questions"]] for r in drawn}
    assert all(orders[i] == [0, 1, 2, 3] for i in range(1, 20, 2))
    assert all(len(set(orders[i])) == 4 for i in orders)
    assert any(orders[i] != [0, 1, 2, 3] for i in range(0, 20, 2))
    assert all(
        q["question"]["pregunta"] == f"q{q['original_idx']}" for r in drawn for q in r["questions"]
    )


def test_review_edges(spark):
    doc = '[{"pregunta":"p","opciones":{"A":"1","B":"2"},"respuesta_correcta":"A"}]'
    df = spark.createDataFrame(
        [(1, doc, '{"0":null}'), (2, doc, "{}"), (3, doc, '{"0":"Z"}'), (4, doc, '{"0":"A"}'),
         (5, None, None), (6, doc, None)],
        "id int, quiz_snapshot_json string, student_answers_json string",
    )
    rows = {r["id"]: r for r in relations.attempt_review(df).collect()}
    assert {i: r["status"] for i, r in rows.items()} == {
        1: "unanswered", 2: "unanswered", 3: "incorrect", 4: "correct", 6: "unanswered",
    }
    assert rows[3]["answer_text"] == relations.OPTION_NOT_FOUND
    assert rows[4]["correct_text"] == "1" and rows[1]["answer_text"] is None


def test_document_round_trip(spark):
    rows = spark.createDataFrame(
        [(1, i, f'q"{i}\n', {"A": "x", "B": None}, None, "é") for i in range(12)],
        "id int, idx int, pregunta string, opciones map<string,string>, "
        "respuesta_correcta string, explicacion string",
    )
    back = documents.explode_questions(documents.assemble_quiz(rows.repartition(4), ["id"]))
    assert back.orderBy("idx").collect() == rows.orderBy("idx").collect()


def test_first_valid_reply(spark):
    good, bad = '[{"pregunta":"x"}]', '{"pregunta":"x"}'
    replies = spark.createDataFrame(
        [(1, 1, bad), (1, 2, good), (1, 3, '[{"pregunta":"later"}]'), (2, 1, bad), (2, 4, good),
         (3, 1, good)],
        "config_id int, attempt int, raw_text string",
    )
    expected = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "config_id int, num_preguntas int")
    found = versions.first_valid_generation(replies, expected)
    rows = {r["config_id"]: (r["attempt"], r["quiz_data_json"]) for r in found.collect()}
    assert rows == {1: (2, good), 2: (None, None), 3: (None, None)}
    failed = versions.failed_generations(found).collect()
    assert sorted(r["config_id"] for r in failed) == [2, 3]


# --- Table changes ---------------------------------------------------------------------------


def test_upsert_keeps_ids_and_is_idempotent(spark):
    target = spark.createDataFrame(
        [(7, "p", "u1", 5, "x"), (9, "p", "u2", 5, "y")],
        "id long, profile_name string, variant_name string, n int, untouched string",
    )
    updates = spark.createDataFrame(
        [(1, "p", "new", 1), (2, "p", "u1", 3), (3, "p", "u1", None), (4, "p", "other", 2)],
        "seq long, profile_name string, variant_name string, n int",
    )
    keys = ["profile_name", "variant_name"]
    once = maintenance.upsert_latest(target, updates, keys, "seq", "id")
    expected = {
        (7, "p", "u1", None, "x"), (9, "p", "u2", 5, "y"), (10, "p", "new", 1, None),
        (11, "p", "other", 2, None),
    }
    assert {tuple(r) for r in once.collect()} == expected
    twice = maintenance.upsert_latest(once, updates, keys, "seq", "id")
    assert {tuple(r) for r in twice.collect()} == expected


def test_upsert_into_empty_table(spark):
    target = spark.createDataFrame([], "id long, k string, v string")
    updates = spark.createDataFrame([(1, "a", "1"), (2, "b", "2")], "seq int, k string, v string")
    rows = maintenance.upsert_latest(target, updates, ["k"], "seq", "id").collect()
    assert sorted(map(tuple, rows)) == [(1, "a", "1"), (2, "b", "2")]


def test_stored_null_setting_is_not_a_missing_one(spark):
    stored = spark.createDataFrame([("a", None), ("b", "1")], "key string, value string")
    defaults = spark.createDataFrame([("a", "d"), ("b", "d"), ("c", "d")], stored.schema)
    resolved = maintenance.resolve_settings(stored, defaults).collect()
    assert {r["key"]: r["value"] for r in resolved} == {"a": None, "b": "1", "c": "d"}


def test_append_is_idempotent_and_keeps_the_first_save(spark):
    batch = attempts_of(
        spark, [(1, "ana", "u", 1, 2, 10, 60), (1, "ana", "u", 2, 2, 20, 30), (2, "leo", "u", 0, 2,
                                                                         0, 0)]
    )
    stored = batch.where("id < 0")
    first = maintenance.append_attempts(stored, batch)
    assert sorted((r["id"], r["score"]) for r in first.collect()) == [(1, 2), (2, 0)]
    assert maintenance.append_attempts(first, batch).count() == 0
    assert first.columns == batch.columns


def test_append_by_natural_key(spark):
    batch = attempts_of(
        spark, [(0, "ana", "u", 1, 2, 10, 60), (0, "ana", "u", 1, 2, 10, 60),
                (0, "ana", "u", 2, 2, 20, 90)]
    ).drop("id")
    keys = ["student_name", "profile_name", "variant_name", "ts"]
    stored = batch.where("score = 2")
    fresh = maintenance.append_attempts(stored, batch, keys)
    assert [r["score"] for r in fresh.collect()] == [1]
    only_keys = maintenance.append_attempts(stored.select(*keys), batch.select(*keys), keys)
    assert only_keys.count() == 1


def quizzes_of(spark, rows):
    df = spark.createDataFrame(rows, "id long, config_id int, is_active int, second int")
    return df.withColumn("created_at", F.timestamp_seconds("second")).drop("second")


def flags(df):
    return {r["id"]: r["is_active"] for r in df.collect()}


def test_activation(spark):
    quizzes = quizzes_of(
        spark, [(1, 1, 1, 0), (2, 1, 0, 5), (3, 1, 0, 5), (4, 2, 1, 0), (5, 3, 1, 0)]
    )
    asked = spark.createDataFrame([(1, 1), (2, 0), (9, 1)], "config_id int, is_active int")
    changed = maintenance.set_activation(quizzes, asked)
    assert flags(changed) == {1: 0, 2: 0, 3: 1, 4: 0, 5: 1}
    assert changed.columns == quizzes.columns

    new = quizzes_of(spark, [(6, 3, 0, 9), (7, 4, 0, 9), (8, 4, 0, 8)]).drop("is_active")
    assert flags(maintenance.activate_new_version(quizzes, new)) == {
        1: 1, 2: 0, 3: 0, 4: 1, 5: 0, 6: 1, 7: 0, 8: 1,
    }


def test_repeated_requests_do_not_repeat_versions(spark):
    quizzes = quizzes_of(spark, [(1, 1, 1, 0), (2, 1, 0, 5)])
    asked = spark.createDataFrame(
        [(1, 1, 10), (1, 0, 20)], "config_id int, is_active int, seq int"
    )
    assert flags(maintenance.set_activation(quizzes, asked, "seq")) == {1: 0, 2: 0}
    assert maintenance.set_activation(quizzes, asked, "seq").count() == 2
    assert flags(maintenance.set_activation(quizzes, asked)) == {1: 0, 2: 1}


def test_active_version_takes_the_lowest_id(spark):
    quizzes = quizzes_of(spark, [(3, 1, 1, 0), (2, 1, 1, 9), (1, 1, 0, 0)])
    assert [tuple(r)[:2] for r in versions.active_version(quizzes).collect()] == [(2, 1)]
    assert [r["id"] for r in versions.latest_version(quizzes).collect()] == [2]


def test_status_repeats_units_with_several_active_versions(spark):
    quizzes = quizzes_of(spark, [(1, 1, 1, 0), (2, 1, 1, 0)])
    configs = spark.createDataFrame(
        [(1, "p", "u1"), (2, "p", "u2")], "id int, profile_name string, variant_name string"
    )
    status = relations.variant_status(configs, quizzes)
    assert sorted((r["id"], r["is_active"]) for r in status.collect()) == [(1, 1), (1, 1), (2, 0)]


def test_config_checks(spark):
    configs = spark.createDataFrame(
        [(1, "p", "u", 3, "fácil/intermedio"), (2, "", "u", 13, "otra"), (3, "p", None, None, None)],
        "id int, profile_name string, variant_name string, num_preguntas int, dificultad string",
    )
    rows = {r["id"]: r for r in quality.validate_configs(configs).collect()}
    assert [rows[i]["names_ok"] for i in (1, 2, 3)] == [True, False, False]
    assert [rows[i]["questions_ok"] for i in (1, 2, 3)] == [True, False, False]
    assert [rows[i]["dificultad"] for i in (1, 2, 3)] == [
        "fácil/intermedio", "intermedio/avanzado", "intermedio/avanzado",
    ]
    early = quality.validate_configs(configs, 3, 10, DIFFICULTIES_EARLY).collect()
    assert {r["dificultad"] for r in early} == {"intermedio"}


# --- Pages -----------------------------------------------------------------------------------


def listing(spark, rows):
    return spark.range(rows).select(
        "id", (F.col("id") % 7).cast("double").alias("grade"),
        F.timestamp_seconds(F.col("id") % 5).alias("ts"),
    )


def test_pages_add_up_to_the_table(spark):
    df = listing(spark, 43)
    expected = [r["id"] for r in df.collect()]
    expected.sort(key=lambda i: (-(i % 5), -(i % 7), i))
    pages = [
        [r["id"] for r in selection.paginate(df, ordering.NEWEST, p, 10).collect()]
        for p in range(1, 6)
    ]
    assert [i for page in pages for i in page] == expected
    assert [len(page) for page in pages] == [10, 10, 10, 10, 3]
    past_end = selection.paginate(df, ordering.NEWEST, 99, 10).collect()
    assert [r["id"] for r in past_end] == pages[-1]


def test_empty_listing_has_one_page(spark):
    df = listing(spark, 0)
    assert selection.paginate(df, ordering.NEWEST, 3).count() == 0
    pages = df.agg(F.count(F.lit(1)).alias("n")).select(
        ordering.page_count(F.col("n"), 10).alias("x")
    )
    assert values(pages) == [1]


# --- Saves and updates with declared columns, null orders and repeats ------------------------


def test_earliest_save_by_a_named_column(spark):
    saves = spark.createDataFrame(
        [(1, 9, "2024-01-01 10:00:00"), (1, 3, "2024-01-01 11:00:00"), (2, 5, None),
         (2, 7, "2024-01-01 12:00:00"), (3, 1, None), (3, 1, None)],
        "id long, score int, timestamp string",
    )
    kept = maintenance.append_attempts(saves.where("id < 0"), saves, order="timestamp")
    assert sorted((r["id"], r["score"]) for r in kept.collect()) == [(1, 9), (2, 7), (3, 1)]
    with pytest.raises(ValueError):
        maintenance.append_attempts(saves, saves)


def test_update_without_an_order_counts(spark):
    target = spark.createDataFrame([(1, "k1", "old")], "id long, key string, value string")
    updates = spark.createDataFrame(
        [("k1", "new", None), ("k2", "first", None), ("k2", "last", 3)],
        "key string, value string, at long",
    )
    merged = maintenance.upsert_latest(target, updates, ["key"], "at", "id")
    assert sorted(tuple(r) for r in merged.collect()) == [(1, "k1", "new"), (2, "k2", "last")]


def test_repeated_answer_overwrites(spark):
    answers = spark.createDataFrame(
        [(1, 0, "A", 1), (1, 0, "B", 2), (1, 1, None, 1)],
        "attempt_id long, idx int, answer string, saved int",
    )
    found = documents.answers_map(answers, ["attempt_id"], order="saved").first()
    assert found["student_answers_json"] == '{"0":"B","1":null}'


def test_undeclared_columns_are_not_lost_silently(spark):
    declared = T.StructType([T.StructField("id", T.LongType())])
    part = spark.range(1).withColumn("extra", F.lit(1))
    with pytest.raises(ValueError):
        maintenance.evolve_schema([part], declared)
    kept = maintenance.evolve_schema([part], declared, drop_undeclared=True)
    assert kept.columns == ["id"]
