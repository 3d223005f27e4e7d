"""Assessment tables derived from the TPC-H-like test tables.

``Views`` gives each derived table lazily as a DataFrame. An attempt is an order, an answer is
a line of it, a subject is an order priority; quiz versions and teacher actions come from
events, raw generated replies from parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradelake.functions.text import topics_json
from gradelake.operators.documents import answers_document, question_json, quiz_document
from gradelake.operators.grading import grade_attempts, score_attempts
from gradelake.operators.maintenance import mark_active, replay_activation
from gradelake.plans.ordering import place_in_small_groups

CONFIGS_PER_PROFILE = 4
N_ATTEMPTED = 20
# Order of the questions in an attempt; (order, line number) alone is not unique.
LINE_ORDER = [
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"
]


def _letter(number):
    return F.substring(F.lit("ABCD"), (number % 4).cast("int") + 1, F.lit(1))


class Views:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def answers(self) -> DataFrame:
        """One row per question answered; a null answer was left open."""
        return self._lines().drop(*LINE_ORDER)

    def numbered_answers(self) -> DataFrame:
        """``answers`` with the question's place ``idx`` in its attempt, from 0."""
        placed = place_in_small_groups(self._lines(), LINE_ORDER, ["attempt_id"])
        return placed.select(
            "attempt_id",
            (F.col("position") - 1).cast("int").alias("idx"),
            "question_id",
            "respuesta_correcta",
            "answer",
        )

    def _lines(self) -> DataFrame:
        part = F.col("l_partkey")
        given = (
            F.when(F.col("l_quantity") > 47, F.lit(None))
            .when(F.col("l_returnflag") != "R", _letter(part))
            .otherwise(_letter(part + 1))
        )
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("attempt_id"),
            part.alias("question_id"),
            _letter(part).alias("respuesta_correcta"),
            given.alias("answer"),
            *LINE_ORDER,
        )

    def scores(self) -> DataFrame:
        return score_attempts(self.answers())

    def sheets(self) -> DataFrame:
        """Who took which unit of which subject, and when."""
        return self.table("orders").select(
            F.col("o_orderkey").alias("id"),
            F.concat(F.lit("student_"), F.col("o_custkey").cast("string")).alias("student_name"),
            F.col("o_orderpriority").alias("profile_name"),
            F.concat(F.lit("unit_"), (F.col("o_orderkey") % 3 + 1).cast("string")).alias(
                "variant_name"
            ),
            F.col("o_orderdate").alias("ts"),
        )

    def attempts(self) -> DataFrame:
        orders = self.sheets()
        scores = self.scores().withColumnRenamed("attempt_id", "id")
        joined = orders.join(scores, "id", "left").select(
            "id",
            "student_name",
            "profile_name",
            "variant_name",
            F.coalesce("score", F.lit(0)).alias("score"),
            F.coalesce("total_questions", F.lit(0)).alias("total_questions"),
            "ts",
        )
        return grade_attempts(joined)

    def configs(self) -> DataFrame:
        """Units of subjects: four of each order priority, and one of each part under its brand.

        Of the four the first is formative and the fourth is never attempted.
        """
        unit = F.col("unit")
        attempted = (
            self.table("orders")
            .select(F.col("o_orderpriority").alias("profile_name"))
            .distinct()
            .withColumn("unit", F.explode(F.sequence(F.lit(1), F.lit(CONFIGS_PER_PROFILE))))
            .select(
                (
                    (F.substring("profile_name", 1, 1).cast("int") - 1) * CONFIGS_PER_PROFILE + unit
                ).alias("id"),
                "profile_name",
                F.concat(F.lit("unit_"), unit.cast("string")).alias("variant_name"),
                (unit == 1).cast("int").alias("show_feedback"),
                (unit * 2 + 3).alias("num_preguntas"),
                topics_json(F.array(F.lit("algebra"), F.lit("limits"))).alias("temas"),
            )
        )
        part = F.col("p_partkey")
        topics = F.array_append(F.split("p_name", " "), F.col("p_type"))
        others = self.table("part").select(
            (part + N_ATTEMPTED + 1).cast("int").alias("id"),
            F.col("p_brand").alias("profile_name"),
            F.concat(F.lit("unit_"), part.cast("string")).alias("variant_name"),
            (part % 2).cast("int").alias("show_feedback"),
            (F.col("p_size") % 10 + 3).cast("int").alias("num_preguntas"),
            topics_json(topics).alias("temas"),
        )
        return attempted.unionByName(others)

    def _config_id(self):
        """Some of the attempted units, and a unit of its own for most users."""
        user = F.col("user_id")
        return (
            F.when(user % 4 == 0, user % N_ATTEMPTED + 1)
            .otherwise(user + N_ATTEMPTED + 1)
            .cast("int")
        )

    def quizzes(self) -> DataFrame:
        """Quiz versions without their text; times cut to the minute, so some tie."""
        return self.table("events").where(F.col("event_type") == "signup").select(
            F.col("event_id").alias("id"),
            self._config_id().alias("config_id"),
            F.date_trunc("minute", F.col("ts")).alias("created_at"),
        )

    def actions(self) -> DataFrame:
        act = (
            F.when(F.col("event_type") == "signup", "generate")
            .when(F.col("event_type") == "click", "on")
            .otherwise("off")
        )
        return self.table("events").where(
            F.col("event_type").isin("signup", "click", "error")
        ).select(
            F.col("event_id").alias("action_id"), self._config_id().alias("config_id"),
            act.alias("act"),
        )

    def stored_quizzes(self) -> DataFrame:
        """Quiz versions with the ``is_active`` flags the action log leaves."""
        quizzes = self.quizzes()
        return mark_active(quizzes, replay_activation(self.actions(), quizzes))

    def config_updates(self) -> DataFrame:
        profiles = self.table("orders").select(F.col("o_orderpriority").alias("profile_name"))
        profiles = profiles.distinct().withColumn(
            "_index", F.substring("profile_name", 1, 1).cast("int") - 1
        )
        user = F.col("user_id")
        events = self.table("events").where((F.col("event_type") == "view") & (user % 25 != 7))
        updates = events.select(
            F.col("event_id").alias("seq"),
            F.expr("cast((user_id % 25 - user_id % 5) div 5 as int)").alias("_index"),
            F.concat(F.lit("unit_"), (user % 5 + 1).cast("string")).alias("variant_name"),
            (F.col("event_id") % 10 + 3).cast("int").alias("num_preguntas"),
            (F.col("event_id") % 2).cast("int").alias("show_feedback"),
        )
        return updates.join(profiles, "_index").drop("_index")

    def ts_text(self) -> DataFrame:
        """Times as stored: local wall-clock text, or ISO text with an offset."""
        plain = F.col("ts").cast("timestamp_ntz").cast("string")
        iso = F.concat(F.replace(plain, F.lit(" "), F.lit("T")), F.lit("-04:00"))
        return self.table("events").select(
            F.col("event_id").alias("id"),
            F.when(F.col("event_id") % 2 == 0, plain).otherwise(iso).alias("timestamp_text"),
        )

    def raw_items(self) -> DataFrame:
        """Generated replies, three per configuration, each with one to three questions.

        Some are no list, some are a question short, some lack a question's text or options in
        the middle or at the end. ``num_preguntas`` is what the configuration asks for.
        """
        size, part = F.col("p_size"), F.col("p_partkey")
        config = F.expr("cast(p_partkey div 3 as int) + 1")
        asked = config % 3 + 1
        given = F.greatest(F.lit(1), asked - (size % 11 == 0).cast("int"))
        no_list, no_options = size % 7 == 0, size % 5 == 0
        options = F.lit('"opciones":{"A":"1","B":"2","C":"3","D":"4"},')

        def question(k: Column) -> Column:
            untitled = (size % 13 == 0) & (k == 2)
            return F.concat(
                F.lit("{"),
                F.when(untitled, '"titulo":"').otherwise('"pregunta":"'),
                F.lit("Concept "),
                k.cast("string"),
                F.lit(" "),
                F.col("p_name"),
                F.lit(" $\\"),
                F.when(size % 2 == 0, "alpha").otherwise("frac"),
                F.lit('$",'),
                F.when(no_options & (k == given), "").otherwise(options),
                F.lit('"respuesta_correcta":"'),
                _letter(part + k),
                F.lit('","explicacion":"'),
                F.col("p_brand"),
                F.lit('"}'),
            )

        questions = F.array_join(F.transform(F.sequence(F.lit(1), given), question), ",")
        return self.table("part").select(
            part.alias("gen_id"),
            config.alias("config_id"),
            asked.alias("num_preguntas"),
            F.concat(
                F.lit("Here you go: "),
                F.when(no_list, "").otherwise("["),
                questions,
                F.when(no_list, "").otherwise("]"),
                F.lit(" Done."),
            ).alias("raw_text"),
        )

    def reply_tries(self) -> DataFrame:
        """``raw_items`` numbered per unit as tries 1, 2, 3, ..."""
        in_config = Window.partitionBy("config_id").orderBy("gen_id")
        return self.raw_items().withColumn("attempt", F.row_number().over(in_config))

    def question_rows(self) -> DataFrame:
        """The questions of every attempt as shown, with four options each."""
        options = F.create_map(
            *[F.lit(x) for x in ("A", "a", "B", "b", "C", "c", "D", "d")]
        )
        return self.numbered_answers().select(
            "attempt_id",
            "idx",
            F.concat(F.lit("q"), F.col("question_id").cast("string")).alias("pregunta"),
            options.alias("opciones"),
            "respuesta_correcta",
            F.lit("e").alias("explicacion"),
            "answer",
        )

    def snapshots(self) -> DataFrame:
        """Per attempt the quiz document and the answers, as the results table stores them."""
        rows = self.question_rows().withColumn("_question_json", question_json())
        return rows.groupBy("attempt_id").agg(
            quiz_document().alias("quiz_snapshot_json"),
            answers_document().alias("student_answers_json"),
        )
