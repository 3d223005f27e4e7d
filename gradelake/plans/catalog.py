"""Every registered query over the derived tables, beside the SQL that checks it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradelake.functions import quizjson, text
from gradelake.operators import (
    documents, grading, maintenance, quality, relations, results, statistics, versions,
)
from gradelake.plans import ordering, selection
from gradelake.plans.oracle import with_ctes
from gradelake.plans.views import Views
from gradelake.schemas import DIFFICULTIES, QUIZ_CONFIGS
from gradelake.session import scratch_folder
from gradelake.sources import tables
from gradelake.sources.bucketed import store_bucketed
from gradelake.sources.membership import KeyFilter, append_filtered
from gradelake.sources.partitioned import (
    PartitionedTable, delete_stored, set_activation_stored, upsert_stored,
)
from gradelake.sources.sequences import IdSequence

QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    """Register a query under ``name`` with its oracle."""

    def register(build: Callable[[Views], DataFrame]):
        QUERIES[name] = build
        ORACLES[name] = with_ctes(sql)
        return build

    return register


def _time_text(column: str = "ts") -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def _grade(column: str = "grade") -> Column:
    return F.round(F.col(column), 6).alias(column)


def _scratch(v: Views, label: str) -> str:
    return f"{scratch_folder(v.spark)}/{label}-{uuid.uuid4().hex}"


# --- Scans -----------------------------------------------------------------------------------


@query(
    "scan_results",
    """select id, student_name, profile_name, variant_name, score, total_questions,
              round(grade, 6) as grade, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts
       from attempts""",
)
def _(v: Views) -> DataFrame:
    return tables.scan_results(v.attempts()).select(
        "id",
        "student_name",
        "profile_name",
        "variant_name",
        "score",
        "total_questions",
        _grade(),
        _time_text().alias("ts"),
    )


@query(
    "scan_configs_pruned",
    "select variant_name, show_feedback from configs where profile_name = 'Brand#7'",
)
def _(v: Views) -> DataFrame:
    return tables.scan_configs_pruned(v.configs(), "Brand#7")


@query(
    "decode_configs",
    """select id, cast(json_array_length(temas) as int) as topics,
              array_to_string(json_extract_string(temas, '$[*]'), ', ') as topic_text
       from configs""",
)
def _(v: Views) -> DataFrame:
    return tables.decode_configs(v.configs()).select(
        "id", F.size("temas").alias("topics"), text.join_topics(F.col("temas")).alias("topic_text")
    )


@query(
    "normalize_attempt_ts",
    """select id, epoch_us(cast(replace(replace(timestamp_text, '-04:00', ''), 'T', ' ')
              as timestamp) + interval 4 hour) as micros
       from ts_text""",
)
def _(v: Views) -> DataFrame:
    instants = tables.normalize_attempt_ts(v.ts_text())
    return instants.select("id", F.unix_micros("ts").alias("micros"))


@query(
    "evolve_schema",
    """select cast(id as bigint) as id, profile_name, variant_name, num_preguntas,
              case when variant_name in ('unit_1', 'unit_2') then 1 else show_feedback end
                as show_feedback, cast(null as varchar) as asignatura
       from configs""",
)
def _(v: Views) -> DataFrame:
    configs = v.configs()
    early = F.col("variant_name").isin("unit_1", "unit_2")
    older = configs.where(early).drop("show_feedback")
    whole = maintenance.evolve_schema(
        [older, configs.where(~early)], QUIZ_CONFIGS, {"show_feedback": 1}
    )
    return whole.select(
        "id", "profile_name", "variant_name", "num_preguntas", "show_feedback", "asignatura"
    )


@query(
    "evolve_results",
    """select id, round(grade, 6) as grade,
              ts >= '1998-01-01' and total_questions > 0 as has_snapshot
       from attempts""",
)
def _(v: Views) -> DataFrame:
    attempts = v.attempts()
    recent = F.col("ts") >= F.lit("1998-01-01").cast("timestamp_ntz")
    snapshots = v.snapshots().select(F.col("attempt_id").alias("id"), "quiz_snapshot_json")
    current = attempts.where(recent).select("id", "grade").join(snapshots, "id", "left")
    target = T.StructType().add("id", "long").add("grade", "double")
    target = target.add("quiz_snapshot_json", "string")
    whole = maintenance.evolve_schema([attempts.where(~recent).select("id", "grade"), current], target)
    return whole.select(
        "id", _grade(), F.col("quiz_snapshot_json").isNotNull().alias("has_snapshot")
    )


# --- Table changes ---------------------------------------------------------------------------


@query(
    "append_attempts",
    """select id, score, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts
       from attempts where ts >= '1999-01-01'""",
)
def _(v: Views) -> DataFrame:
    attempts = v.attempts().select("id", "student_name", "score", "ts")
    day = lambda text: F.lit(text).cast("timestamp_ntz")
    stored = attempts.where(F.col("ts") < day("1999-01-01"))
    batch = attempts.where(F.col("ts") >= day("1998-01-01"))
    # The same attempt handed in again an hour later.
    again = batch.withColumn("ts", F.col("ts") + F.expr("interval 1 hour"))
    fresh = maintenance.append_attempts(stored, batch.union(again))
    return fresh.select("id", "score", _time_text().alias("ts"))


@query(
    "append_filtered",
    """select id, score, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts from attempts""",
)
def _(v: Views) -> DataFrame:
    """Batches appended to a stored table; a key filter says which stored ids to look at."""
    attempts = v.attempts().select("id", "score", "ts")
    cut = F.lit("1997-01-01").cast("timestamp_ntz")
    older, later = attempts.where(F.col("ts") < cut), attempts.where(F.col("ts") >= cut)
    table = PartitionedTable(v.spark, _scratch(v, "attempts"), ["id"], parts=16)
    table.create(older)
    known = KeyFilter(v.spark, _scratch(v, "keys"), table, expected=20_000)
    known.add(older)
    # New ones, and some that are stored, handed in again an hour later.
    again = older.where(F.col("id") % 1000 == 0).union(later)
    again = again.withColumn("ts", F.col("ts") + F.expr("interval 1 hour"))
    append_filtered(table, known, later.union(again))
    return table.read().select("id", "score", _time_text().alias("ts"))


@query("upsert_latest", "select * from upserted")
def _(v: Views) -> DataFrame:
    return _upserted(v)


def _upserted(v: Views) -> DataFrame:
    return maintenance.upsert_latest(
        v.configs().drop("temas"),
        v.config_updates(),
        ["profile_name", "variant_name"],
        "seq",
        id_column="id",
    ).select("id", "profile_name", "variant_name", "num_preguntas", "show_feedback")


@query(
    "upsert_settings",
    """with updates as (
         select case when c_acctbal < 0 then concat(c_mktsegment, '_debt') else c_mktsegment end
                as key, arg_max(c_name, c_custkey) as value from customer group by 1),
       target as (select distinct concat(c_mktsegment, t.s) as key, 'old' as value
                  from customer, unnest(['', '_closed']) t(s))
       select coalesce(u.key, t.key) as key, coalesce(u.value, t.value) as value
       from target t full join updates u on u.key = t.key""",
)
def _(v: Views) -> DataFrame:
    customers = v.table("customer")
    suffix = F.explode(F.array(F.lit(""), F.lit("_closed")))
    target = customers.select("c_mktsegment").distinct().select("c_mktsegment", suffix.alias("s"))
    target = target.select(F.concat("c_mktsegment", "s").alias("key"), F.lit("old").alias("value"))
    in_debt = F.concat("c_mktsegment", F.lit("_debt"))
    updates = customers.select(
        F.col("c_custkey").alias("seq"),
        F.when(F.col("c_acctbal") < 0, in_debt).otherwise(F.col("c_mktsegment")).alias("key"),
        F.col("c_name").alias("value"),
    )
    return maintenance.upsert_latest(target, updates, ["key"], "seq")


@query(
    "resolve_settings",
    """with settings as (
         select concat('user_', cast(user_id as varchar)) as key,
                case when count(*) > 5 then null else cast(count(*) as varchar) end as value
         from events where event_type = 'signup' and value > 20 group by user_id),
       defaults as (select distinct concat('user_', cast(user_id as varchar)) as key from events)
       select d.key, case when s.key is null then 'default' else s.value end as value
       from defaults d left join settings s on s.key = d.key""",
)
def _(v: Views) -> DataFrame:
    events = v.table("events")
    key = F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("key")
    chosen = events.where((F.col("event_type") == "signup") & (F.col("value") > 20))
    counted = chosen.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    # A setting may be stored as null, which is not the same as not being stored.
    settings = counted.select(
        key, F.when(F.col("n") <= 5, F.col("n").cast("string")).alias("value")
    )
    defaults = events.select(key).distinct().withColumn("value", F.lit("default"))
    return maintenance.resolve_settings(settings, defaults)


def _formative_ids(v: Views) -> DataFrame:
    return v.configs().where("show_feedback = 1").select("id")


@query(
    "delete_configs",
    "select id, profile_name, variant_name from configs where show_feedback <> 1",
)
def _(v: Views) -> DataFrame:
    kept = maintenance.delete_configs(v.configs(), _formative_ids(v))
    return kept.select("id", "profile_name", "variant_name")


@query(
    "cascade_delete",
    """select q.id, q.config_id from quizzes q
       where q.config_id not in (select id from configs where show_feedback = 1)""",
)
def _(v: Views) -> DataFrame:
    return maintenance.cascade_delete(v.quizzes(), _formative_ids(v)).select("id", "config_id")


@query(
    "activate_new_version",
    """with older as (select *, row_number() over (partition by config_id
                        order by created_at desc, id desc) as rn
                      from quizzes where created_at < '2024-01-16'),
       fresh as (select q.*, row_number() over (partition by config_id
                        order by q.id desc) as rn
                 from quizzes q where created_at >= '2024-01-16')
       select id, config_id, cast(case when rn = 1 and config_id not in
              (select config_id from fresh) then 1 else 0 end as int) as is_active
       from older
       union all
       select id, config_id, cast(case when rn = 1 then 1 else 0 end as int) from fresh""",
)
def _(v: Views) -> DataFrame:
    quizzes = v.quizzes()
    cut = F.lit("2024-01-16").cast("timestamp")
    older = quizzes.where(F.col("created_at") < cut)
    newest = versions.latest_ids(older).select(F.col("id").alias("active_id"))
    stored = maintenance.mark_active(older, newest)
    recent = quizzes.where(F.col("created_at") >= cut)
    changed = maintenance.activate_new_version(stored, recent)
    return changed.select("id", "config_id", "is_active")


@query(
    "set_activation",
    """with asked as (select config_id, arg_max(act, action_id) as act from actions
                      where act in ('on', 'off') group by 1)
       select q.id, q.config_id, cast(case when a.act is null then q.is_active
              when a.act = 'on' and q.id = n.id then 1 else 0 end as int) as is_active
       from stored_quizzes q left join asked a on a.config_id = q.config_id
       left join newest n on n.config_id = q.config_id""",
)
def _(v: Views) -> DataFrame:
    switches = v.actions().where(F.col("act").isin("on", "off"))
    requests = switches.withColumn("is_active", (F.col("act") == "on").cast("int"))
    newest = versions.latest_ids(v.quizzes())
    changed = maintenance.set_activation(v.stored_quizzes(), requests, "action_id", newest)
    return changed.select("id", "config_id", "is_active")


@query("replay_activation", "select config_id, active_id from replayed")
def _(v: Views) -> DataFrame:
    return maintenance.replay_activation(v.actions(), v.quizzes())


@query(
    "assign_ids",
    "select id, 1000 + row_number() over (order by ts, id) as new_id from attempts",
)
def _(v: Views) -> DataFrame:
    attempts = v.attempts().select("id", "ts")
    return maintenance.assign_ids(attempts, 1000, ["ts", "id"], "new_id").select("id", "new_id")


@query(
    "assign_ids_ranged",
    "select id, 1000 + row_number() over (order by ts, id) as new_id from attempts",
)
def _(v: Views) -> DataFrame:
    """Ids of two inserts, one after the other, from a stored sequence that stands at 1000."""
    sequence = IdSequence(v.spark, _scratch(v, "sequence"))
    sequence.reserve(0, 1000)
    attempts, cut = v.attempts().select("id", "ts"), F.lit("1995-01-01").cast("timestamp_ntz")
    batches = [attempts.where(F.col("ts") < cut), attempts.where(F.col("ts") >= cut)]
    first, second = (
        maintenance.insert_ids(batch, 0, ["ts", "id"], "new_id", sequence) for batch in batches
    )
    return first.union(second).select("id", "new_id")


_GONE_SQL = """gone as (
         select * from configs where id % 10 = 3 or id = (select max(id) from configs))"""


@query(
    "insert_after_delete",
    f"""with {_GONE_SQL}
       select id, profile_name, variant_name, num_preguntas from configs
       where id not in (select id from gone)
       union all
       select cast((select max(id) from configs) + row_number() over (order by id) as int),
              profile_name, variant_name, num_preguntas from gone""",
)
def _(v: Views) -> DataFrame:
    """Units deleted, the one with the highest id among them, and made anew: all ids are fresh."""
    configs = v.configs().drop("temas")
    highest = configs.agg(F.max("id")).first()[0] or 0
    sequence = IdSequence(v.spark, _scratch(v, "sequence"))
    sequence.reserve(0, highest)
    gone = configs.where((F.col("id") % 10 == 3) | (F.col("id") == highest))
    again = gone.withColumnRenamed("id", "seq")
    kept = maintenance.delete_configs(configs, gone)
    return maintenance.upsert_latest(
        kept, again, ["profile_name", "variant_name"], "seq", "id", sequence
    ).select("id", "profile_name", "variant_name", "num_preguntas")


@query(
    "insert_after_clear",
    """select row_number() over (order by ts, id) as id, student_name, profile_name
       from attempts where profile_name = '5-LOW'""",
)
def _(v: Views) -> DataFrame:
    """A table that is cleared begins its ids at 1 again."""
    path, sequence = _scratch(v, "results"), IdSequence(v.spark, _scratch(v, "sequence"))
    sheets = v.sheets().select("id", "ts", "student_name", "profile_name")
    sheets.write.parquet(path)
    sequence.reserve(0, sheets.agg(F.max("id")).first()[0] or 0)
    tables.clear_table(v.spark, path, sequence)
    later = sheets.where(F.col("profile_name") == "5-LOW").withColumnRenamed("id", "sheet")
    highest = v.spark.read.schema(sheets.schema).parquet(path).agg(F.max("id")).first()[0] or 0
    numbered = maintenance.insert_ids(later, highest, ["ts", "sheet"], "id", sequence)
    return numbered.select("id", "student_name", "profile_name")


@query("upsert_partitioned", "select * from upserted")
def _(v: Views) -> DataFrame:
    """``upsert_latest`` on a stored table, of which only the parts with updates are rewritten."""
    configs = v.configs().drop("temas")
    keys = ["profile_name", "variant_name"]
    table = PartitionedTable(v.spark, _scratch(v, "configs"), keys, parts=16)
    table.create(configs)
    sequence = IdSequence(v.spark, _scratch(v, "sequence"))
    sequence.reserve(0, configs.agg(F.max("id")).first()[0] or 0)
    upsert_stored(table, v.config_updates(), "seq", "id", sequence)
    return table.read().select("id", "profile_name", "variant_name", "num_preguntas",
                               "show_feedback")


@query(
    "delete_partitioned",
    f"with {_GONE_SQL} select id, profile_name, variant_name from configs "
    "where id not in (select id from gone)",
)
def _(v: Views) -> DataFrame:
    configs = v.configs().drop("temas")
    table = PartitionedTable(
        v.spark, _scratch(v, "configs"), ["profile_name", "variant_name"], parts=16
    )
    table.create(configs)
    highest = configs.agg(F.max("id")).first()[0] or 0
    gone = configs.where((F.col("id") % 10 == 3) | (F.col("id") == highest))
    delete_stored(table, gone, ["id"])
    return table.read().select("id", "profile_name", "variant_name")


@query(
    "activate_partitioned",
    """with kept as (
         select q.*, coalesce(r.on_request, true) as stays from stored_quizzes q left join (
           select config_id, arg_max(act, action_id) = 'on' as on_request from actions
           where act in ('on', 'off') and config_id % 5 = 0 group by 1
         ) r on r.config_id = q.config_id)
       select q.id, q.config_id, cast(case when q.config_id % 5 <> 0 then q.is_active
              when q.config_id not in (select config_id from actions
                where act in ('on', 'off')) then q.is_active
              when q.stays and q.id = n.id then 1 else 0 end as int) as is_active
       from kept q left join newest n on n.config_id = q.config_id""",
)
def _(v: Views) -> DataFrame:
    """On and off requests for some units, on the parts of the stored versions they are in."""
    table = PartitionedTable(v.spark, _scratch(v, "versions"), ["config_id"], parts=16)
    table.create(v.stored_quizzes())
    switches = v.actions().where(F.col("act").isin("on", "off") & (F.col("config_id") % 5 == 0))
    requests = switches.withColumn("is_active", (F.col("act") == "on").cast("int"))
    set_activation_stored(table, requests, "action_id")
    return table.read().select("id", "config_id", "is_active")


@query(
    "stored_results",
    """with papers as (
         select attempt_id,
                concat('[', string_agg(concat('{"pregunta":"q', cast(question_id as varchar),
                  '","opciones":{"A":"a","B":"b","C":"c","D":"d"},"respuesta_correcta":"',
                  respuesta_correcta, '","explicacion":"e"}'), ',' order by idx), ']') as snapshot,
                concat('{', string_agg(concat('"', cast(idx as varchar), '":',
                  coalesce('"' || answer || '"', 'null')), ',' order by idx), '}') as given
         from answers group by 1)
       select a.id, a.student_name, a.profile_name, a.variant_name, a.score, a.total_questions,
              round(a.grade, 6) as grade, strftime(a.ts, '%Y-%m-%d %H:%M:%S') as ts,
              p.snapshot as quiz_snapshot_json, p.given as student_answers_json
       from attempts a left join papers p on p.attempt_id = a.id""",
)
def _(v: Views) -> DataFrame:
    sheets = v.sheets().withColumnRenamed("id", "attempt_id").withColumnRenamed("ts", "timestamp")
    rows = results.stored_results(sheets, v.question_rows())
    return rows.select(
        F.col("attempt_id").alias("id"),
        "student_name",
        "profile_name",
        "variant_name",
        "score",
        "total_questions",
        _grade(),
        _time_text("timestamp").alias("ts"),
        "quiz_snapshot_json",
        "student_answers_json",
    )


@query(
    "append_stored_results",
    """select id, score, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts
       from attempts where id % 4 <> 0""",
)
def _(v: Views) -> DataFrame:
    """Declared columns, saves in any order, some of them without a time."""
    sheets = v.sheets().withColumnRenamed("id", "attempt_id").withColumnRenamed("ts", "timestamp")
    rows = results.stored_results(sheets, v.question_rows()).withColumnRenamed("attempt_id", "id")
    later = F.col("timestamp") + F.expr("interval 1 hour")
    again = rows.withColumns({"timestamp": later, "score": F.col("score") - 100})
    untimed = again.withColumn(
        "timestamp", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("timestamp"))
    )
    stored = rows.where(F.col("id") % 4 == 0)
    fresh = maintenance.append_attempts(stored, untimed.union(rows), order="timestamp")
    return fresh.select("id", "score", _time_text("timestamp").alias("ts"))


@query(
    "generate_and_activate",
    """with made as (
         select config_id, arg_min(doc, attempt) filter (where lenient) as doc
         from tries where attempt <= 3 group by 1 having count(*) filter (where lenient) > 0)
       select id, config_id, cast(null as varchar) as quiz_data_json,
              cast(case when config_id in (select config_id from made) then 0
                   else is_active end as int) as is_active
       from stored_quizzes
       union all
       select (select max(id) from stored_quizzes) + row_number() over (order by config_id),
              config_id, doc, cast(1 as int) from made""",
)
def _(v: Views) -> DataFrame:
    stored = v.stored_quizzes().select(
        "id", "config_id", F.lit(None).cast("string").alias("quiz_data_json"), "is_active"
    )
    tries = v.reply_tries()
    replies, expected = tries.drop("num_preguntas"), _expected(tries)
    return results.generate_and_activate(stored, replies, expected)


@query(
    "clear_results",
    """select id, student_name, profile_name, cast(null as double) as grade
       from attempts where id < 0""",
)
def _(v: Views) -> DataFrame:
    path = f"{scratch_folder(v.spark)}/results-{uuid.uuid4().hex}"
    v.attempts().select("id", "student_name", "profile_name", "grade").write.parquet(path)
    stored = v.spark.read.parquet(path)
    tables.replace_table(maintenance.clear_results(stored), path)
    return v.spark.read.schema(stored.schema).parquet(path)


@query(
    "export_gradebook_csv",
    """select student_name, max(case when variant_name = 'unit_2' then grade end) as unit_2,
              max(case when variant_name = 'unit_3' then grade end) as unit_3
       from (select student_name, variant_name, round(max(grade), 6) as grade from attempts
             where profile_name = '3-MEDIUM' and variant_name in ('unit_2', 'unit_3')
             group by 1, 2) g
       group by 1""",
)
def _(v: Views) -> DataFrame:
    book = grading.gradebook(v.attempts(), v.configs(), profile="3-MEDIUM")
    folder = f"{scratch_folder(v.spark)}/exports-{uuid.uuid4().hex}"
    path = tables.export_gradebook_csv(book, folder, "3-MEDIUM")
    shown = v.spark.read.csv(
        path, header=True, schema="student_name string, unit_2 double, unit_3 double"
    )
    return shown.select("student_name", _grade("unit_2"), _grade("unit_3"))


# --- Checks ----------------------------------------------------------------------------------


@query(
    "check_not_null",
    """select 'attempt_id' as column_name, count(*) - count(attempt_id) as nulls from answers
       union all select 'question_id', count(*) - count(question_id) from answers
       union all select 'answer', count(*) - count(answer) from answers""",
)
def _(v: Views) -> DataFrame:
    return quality.check_not_null(v.answers(), ["attempt_id", "question_id", "answer"])


@query(
    "check_while_writing",
    """select 'attempt_id' as column_name, count(*) - count(attempt_id) as found from answers
       union all select 'question_id', count(*) - count(question_id) from answers
       union all select 'answer', count(*) - count(answer) from answers
       union all select 'is_open', count(answer) from answers
       union all select 'rows', count(*) from answers""",
)
def _(v: Views) -> DataFrame:
    """Nulls and broken conditions counted by the write itself."""
    checks = quality.WriteChecks(["attempt_id", "question_id", "answer"], ["is_open"])
    answers = v.answers().withColumn("is_open", F.col("answer").isNull())
    checks.watch(answers).write.parquet(_scratch(v, "answers"))
    figures = {**checks.nulls, **checks.failures, "rows": checks.rows}
    return v.spark.createDataFrame(list(figures.items()), "column_name string, found long")


@query(
    "check_unique",
    """select l_orderkey, l_linenumber, count(*) as copies from lineitem
       group by 1, 2 having count(*) > 1""",
)
def _(v: Views) -> DataFrame:
    return quality.check_unique(v.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "check_orphans",
    """select id, config_id from quizzes
       where config_id not in (select id from configs where show_feedback <> 1)""",
)
def _(v: Views) -> DataFrame:
    kept = maintenance.delete_configs(v.configs(), _formative_ids(v))
    return quality.check_orphans(v.quizzes(), kept, "config_id").select("id", "config_id")


@query(
    "validate_configs",
    """select p_partkey as id, p_size <= 45 as names_ok, p_size between 3 and 12 as questions_ok,
              case when p_type = 'ECONOMY' then 'fácil/intermedio'
                   when p_type = 'SMALL' then 'avanzado/difícil'
                   else 'intermedio/avanzado' end as dificultad
       from part""",
)
def _(v: Views) -> DataFrame:
    level = (
        F.when(F.col("p_type") == "ECONOMY", DIFFICULTIES[0])
        .when(F.col("p_type") == "SMALL", DIFFICULTIES[2])
        .otherwise(F.col("p_type"))
    )
    configs = v.table("part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_brand").alias("profile_name"),
        F.when(F.col("p_size") <= 45, F.col("p_name")).otherwise("").alias("variant_name"),
        F.col("p_size").alias("num_preguntas"),
        level.alias("dificultad"),
    )
    return quality.validate_configs(configs).select(
        "id", "names_ok", "questions_ok", "dificultad"
    )


# --- Filters, projections, joins -------------------------------------------------------------


@query(
    "filter_profile",
    """select id, student_name, round(grade, 6) as grade from attempts
       where profile_name = '1-URGENT'""",
)
def _(v: Views) -> DataFrame:
    rows = relations.filter_profile(v.attempts(), "1-URGENT")
    return rows.select("id", "student_name", _grade())


@query("filter_unit", "select id, profile_name, score from attempts where variant_name = 'unit_2'")
def _(v: Views) -> DataFrame:
    rows = relations.filter_unit(v.attempts(), "unit_2")
    return rows.select("id", "profile_name", "score")


@query(
    "filter_evaluative",
    """select a.id, a.profile_name, a.variant_name, a.score from attempts a
       join configs c on c.profile_name = a.profile_name and c.variant_name = a.variant_name
       where c.show_feedback = 0""",
)
def _(v: Views) -> DataFrame:
    rows = relations.filter_evaluative(v.attempts(), v.configs())
    return rows.select("id", "profile_name", "variant_name", "score")


@query("list_units", "select profile_name, id, variant_name from configs")
def _(v: Views) -> DataFrame:
    return relations.list_units(v.configs())


@query("pass_flag", "select id, round(grade, 6) as grade, grade >= 9.5 as passed from attempts")
def _(v: Views) -> DataFrame:
    return relations.pass_flag(v.attempts()).select("id", _grade(), "passed")


@query(
    "answer_status",
    """select attempt_id, idx, case when answer is null then 'unanswered'
              when answer = respuesta_correcta then 'correct' else 'incorrect' end as status
       from answers""",
)
def _(v: Views) -> DataFrame:
    status = quizjson.answer_status(F.col("answer"), F.col("respuesta_correcta"))
    return v.numbered_answers().select("attempt_id", "idx", status.alias("status"))


_DISPLAY_SQL = """student_name as "Estudiante", variant_name as "Unidad",
              concat(cast(score as varchar), '/', cast(total_questions as varchar)) as "Puntaje",
              printf('%.2f', grade) as "Nota", strftime(ts, '%Y-%m-%d %H:%M') as "Fecha"
       from attempts"""


@query("participation_table", f"select {_DISPLAY_SQL}")
def _(v: Views) -> DataFrame:
    return relations.participation_table(v.attempts(), "UTC")


@query(
    "participation_ranked",
    f"""select row_number() over (partition by profile_name order by grade desc, ts desc, id)
              as "Posición", {_DISPLAY_SQL}""",
)
def _(v: Views) -> DataFrame:
    return relations.participation_table(v.attempts(), "UTC", position=True)


_STATUS_SQL = """select c.id, c.profile_name, c.variant_name,
              cast(case when q.id is not null then 1 else 0 end as int) as is_active
       from configs c left join stored_quizzes q on q.config_id = c.id and q.is_active = 1"""


@query("variant_status", _STATUS_SQL)
def _(v: Views) -> DataFrame:
    return relations.variant_status(v.configs(), v.stored_quizzes())


@query("order_units_active_first", _STATUS_SQL)
def _(v: Views) -> DataFrame:
    status = relations.variant_status(v.configs(), v.stored_quizzes())
    return relations.order_units_active_first(status)


@query(
    "label_variant",
    f"""select id, case when is_active = 1 then variant_name
                   else concat(':gray[*', variant_name, '*]') end as label,
              case when is_active = 1 then concat(variant_name, '  ')
                   else concat(variant_name, ' (_inactiva_)') end as plain_label
       from ({_STATUS_SQL}) s""",
)
def _(v: Views) -> DataFrame:
    status = relations.variant_status(v.configs(), v.stored_quizzes())
    name, active = F.col("variant_name"), F.col("is_active")
    return status.select(
        "id",
        text.label_variant(name, active).alias("label"),
        text.label_variant(name, active, "suffix").alias("plain_label"),
    )


@query(
    "has_any_quiz",
    """select u.id, u.profile_name, u.variant_name,
              exists (select 1 from quizzes q where q.config_id = u.id) as has_quiz
       from upserted u""",
)
def _(v: Views) -> DataFrame:
    return relations.has_any_quiz(_upserted(v), v.quizzes())


@query(
    "activity_overview",
    """select u.id, u.profile_name, u.variant_name, coalesce(q.active, 0) as is_active,
              q.config_id is not null as has_quiz, coalesce(q.n, 0) as versions
       from upserted u left join (
         select config_id, max(is_active) as active, count(*) as n from stored_quizzes group by 1
       ) q on q.config_id = u.id""",
)
def _(v: Views) -> DataFrame:
    return relations.activity_overview(_upserted(v), v.stored_quizzes())


@query(
    "attempt_review",
    """select attempt_id, idx, concat('q', cast(question_id as varchar)) as pregunta, answer,
              lower(answer) as answer_text, respuesta_correcta,
              lower(respuesta_correcta) as correct_text, 'e' as explicacion,
              case when answer is null then 'unanswered'
                   when answer = respuesta_correcta then 'correct' else 'incorrect' end as status
       from answers""",
)
def _(v: Views) -> DataFrame:
    return relations.attempt_review(v.snapshots())


# --- Aggregates ------------------------------------------------------------------------------


@query("score_attempts", "select attempt_id, score, total_questions from scores")
def _(v: Views) -> DataFrame:
    return v.scores()


@query(
    "grade_attempts",
    """select id, score, total_questions, round(grade, 6) as grade,
              round(case when total_questions > 0 then score * 19.0e0 / total_questions
                    else 0.0e0 end, 6) as grade_19
       from attempts""",
)
def _(v: Views) -> DataFrame:
    on_19 = grading.grade_of(F.col("score"), F.col("total_questions"), 19.0)
    return v.attempts().select(
        "id", "score", "total_questions", _grade(), F.round(on_19, 6).alias("grade_19")
    )


@query("score_attempts_bucketed", "select id, profile_name, score, total_questions from attempts")
def _(v: Views) -> DataFrame:
    """Scores beside their attempts, from tables stored by attempt id: no exchange."""
    mark = uuid.uuid4().hex
    answers = store_bucketed(
        v.answers(), f"answers_{mark}", _scratch(v, "answers"), ["attempt_id"], 8
    )
    sheets = store_bucketed(v.sheets(), f"sheets_{mark}", _scratch(v, "sheets"), ["id"], 8)
    scores = grading.score_attempts(answers).withColumnRenamed("attempt_id", "id")
    return sheets.join(scores, "id", "left").select(
        "id", "profile_name", *[F.coalesce(c, F.lit(0)).alias(c)
                                for c in ("score", "total_questions")]
    )


def _maintained(v: Views) -> DataFrame:
    """States of the attempts of the first years, brought forward by two batches."""
    attempts = v.attempts()
    kept = statistics.MaintainedGrades(v.spark, _scratch(v, "states"), parts=16)
    cuts = [F.lit(f"{year}-01-01").cast("timestamp_ntz") for year in (1996, 1997)]
    kept.rebuild(attempts.where(F.col("ts") < cuts[0]))
    kept.add(attempts.where((F.col("ts") >= cuts[0]) & (F.col("ts") < cuts[1])))
    kept.add(attempts.where(F.col("ts") >= cuts[1]))
    return kept.states()


@query(
    "maintained_stats",
    """select profile_name, variant_name, count(*) as participations,
              round(avg(grade), 6) as mean_grade, round(max(grade), 6) as best_grade
       from attempts group by grouping sets ((profile_name), (profile_name, variant_name))""",
)
def _(v: Views) -> DataFrame:
    return statistics.state_stats(_maintained(v)).select(
        "profile_name", "variant_name", "participations", _grade("mean_grade"),
        _grade("best_grade"),
    )


@query(
    "maintained_grades",
    """select profile_name, student_name, variant_name, round(max(grade), 6) as highest,
              round(arg_max(grade, row(ts, id)), 6) as latest, round(avg(grade), 6) as mean
       from attempts group by 1, 2, 3""",
)
def _(v: Views) -> DataFrame:
    states = _maintained(v)
    cells = states.select(*grading.ATTEMPT_CELL)
    for policy in ("highest", "latest", "mean"):
        grades = statistics.state_grades(states, policy).withColumnRenamed("grade", policy)
        cells = cells.join(grades, grading.ATTEMPT_CELL)
    return cells.select(*grading.ATTEMPT_CELL, *map(_grade, ("highest", "latest", "mean")))


@query("distinct_profiles", "select distinct profile_name from attempts")
def _(v: Views) -> DataFrame:
    return grading.distinct_profiles(v.attempts())


@query("distinct_units", "select distinct profile_name, variant_name from attempts")
def _(v: Views) -> DataFrame:
    return grading.distinct_units(v.attempts())


@query(
    "participation_stats",
    """select profile_name, variant_name, count(*) as participations,
              round(avg(grade), 6) as mean_grade, round(max(grade), 6) as best_grade
       from attempts group by grouping sets ((profile_name), (profile_name, variant_name))""",
)
def _(v: Views) -> DataFrame:
    return grading.participation_stats(v.attempts()).select(
        "profile_name", "variant_name", "participations", _grade("mean_grade"),
        _grade("best_grade"),
    )


@query(
    "selection_stats",
    """select count(*) as participations, round(avg(grade), 6) as mean_grade,
              round(max(grade), 6) as best_grade from attempts""",
)
def _(v: Views) -> DataFrame:
    return grading.selection_stats(v.attempts()).select(
        "participations", _grade("mean_grade"), _grade("best_grade")
    )


_POLICY_SQL = {
    "highest": "max(grade)",
    "latest": "arg_max(grade, row(ts, id))",
    "mean": "avg(grade)",
}


def _register_policy(policy: str) -> None:
    aggregate = _POLICY_SQL[policy]
    by_cell = f"""select profile_name, student_name, variant_name,
              round({aggregate}, 6) as grade
       from attempts group by 1, 2, 3"""

    @query(f"grade_{policy}", by_cell)
    def _(v: Views) -> DataFrame:
        cells = grading.grade_policy(v.attempts(), policy)
        return cells.withColumn("grade", F.round("grade", 6))

    book = f"""select profile_name, student_name,
              max(case when variant_name = 'unit_2' then grade end) as unit_2,
              max(case when variant_name = 'unit_3' then grade end) as unit_3
       from ({by_cell}) g where variant_name in (
         select variant_name from configs c
         where c.profile_name = g.profile_name and c.show_feedback = 0)
       group by 1, 2"""

    @query(f"gradebook_{policy}", book)
    def _(v: Views) -> DataFrame:
        units = ["unit_2", "unit_3"]
        sheet = grading.gradebook(v.attempts(), v.configs(), policy, units=units)
        return sheet.select("profile_name", "student_name", *[_grade(unit) for unit in units])

    rows = f"""select g.* from ({by_cell}) g where exists (
         select 1 from configs c where c.profile_name = g.profile_name
         and c.variant_name = g.variant_name and c.show_feedback = 0)"""

    @query(f"gradebook_rows_{policy}", rows)
    def _(v: Views) -> DataFrame:
        cells = grading.gradebook_rows(v.attempts(), v.configs(), policy)
        return cells.withColumn("grade", F.round("grade", 6))


for _policy in _POLICY_SQL:
    _register_policy(_policy)


@query(
    "gradebook_display",
    """select student_name,
              coalesce(printf('%.2f', max(case when variant_name = 'unit_2' then grade end)), '-')
                as unit_2,
              coalesce(printf('%.2f', max(case when variant_name = 'unit_3' then grade end)), '-')
                as unit_3
       from attempts where profile_name = '3-MEDIUM' and variant_name in ('unit_2', 'unit_3')
       group by 1""",
)
def _(v: Views) -> DataFrame:
    sheet = grading.gradebook(v.attempts(), v.configs(), profile="3-MEDIUM")
    return tables.gradebook_display(sheet.drop("profile_name"))


@query(
    "last_non_null",
    """select profile_name, student_name,
              arg_max(score, row(ts, id)) filter (where score is not null) as score,
              arg_max(half, row(ts, id)) filter (where half is not null) as half
       from (select profile_name, student_name, ts, id, nullif(score, 0) as score,
                    case when total_questions > 3 then score / 2.0e0 end as half
             from attempts) a group by 1, 2""",
)
def _(v: Views) -> DataFrame:
    rows = v.attempts().select(
        "profile_name",
        "student_name",
        "ts",
        "id",
        F.nullif("score", F.lit(0)).alias("score"),
        F.when(F.col("total_questions") > 3, F.col("score") / 2.0).alias("half"),
    )
    last = grading.last_non_null(rows, ["profile_name", "student_name"])
    return last.select("profile_name", "student_name", "score", "half")


# --- Versions, ranks, pages ------------------------------------------------------------------


@query(
    "latest_version",
    """select q.id, q.config_id, strftime(q.created_at, '%Y-%m-%d %H:%M:%S') as created_at
       from quizzes q join newest n on n.id = q.id""",
)
def _(v: Views) -> DataFrame:
    return versions.latest_version(v.quizzes()).select(
        "id", "config_id", _time_text("created_at").alias("created_at")
    )


@query(
    "active_version",
    "select min(id) as id, config_id from stored_quizzes where is_active = 1 group by config_id",
)
def _(v: Views) -> DataFrame:
    return versions.active_version(v.stored_quizzes()).select("id", "config_id")


@query(
    "filter_active",
    "select id, config_id from stored_quizzes where is_active = 1",
)
def _(v: Views) -> DataFrame:
    return relations.filter_active(v.stored_quizzes()).select("id", "config_id")


def _expected(tries: DataFrame) -> DataFrame:
    return tries.select("config_id", "num_preguntas").distinct()


def _generations(v: Views, mode: str) -> DataFrame:
    tries = v.reply_tries()
    replies, expected = tries.drop("num_preguntas"), _expected(tries)
    return versions.first_valid_generation(replies, expected, mode=mode)


def _register_generation(name: str, mode: str) -> None:
    @query(
        name,
        f"""select config_id, cast(min(attempt) filter (where {mode}) as int) as attempt,
                   arg_min(doc, attempt) filter (where {mode}) as quiz_data_json
            from tries where attempt <= 3 group by config_id""",
    )
    def _(v: Views) -> DataFrame:
        return _generations(v, mode)


_register_generation("first_valid_generation", "lenient")
_register_generation("first_valid_strict", "strict")


@query(
    "failed_generations",
    """select config_id from tries where attempt <= 3
       group by config_id having not bool_or(strict)""",
)
def _(v: Views) -> DataFrame:
    return versions.failed_generations(_generations(v, "strict"))


_RANK_SQL = """select id, profile_name, row_number() over (
              partition by profile_name order by grade desc, ts desc, id) as position
       from attempts"""


@query("rank_position", _RANK_SQL)
def _(v: Views) -> DataFrame:
    ranked = v.attempts().select("id", "profile_name", "grade", "ts")
    placed = ordering.with_position(ranked, ordering.RANKING, ["profile_name"])
    return placed.select("id", "profile_name", "position")


@query("rank_position_ranged", _RANK_SQL)
def _(v: Views) -> DataFrame:
    """Positions of every ranking from its first row to its last, numbered range by range."""
    ranked = v.attempts().select("id", "profile_name", "grade", "ts")
    placed = selection.rank_range(ranked, ordering.RANKING, 1, keys=["profile_name"])
    return placed.select("id", "profile_name", "position")


@query(
    "paginate",
    """select id, student_name, round(grade, 6) as grade from attempts
       order by ts desc, grade desc, id limit 10 offset 20""",
)
def _(v: Views) -> DataFrame:
    page = selection.paginate(v.attempts(), ordering.NEWEST, page=3)
    return page.select("id", "student_name", _grade())


@query(
    "paginate_deep",
    """select id, student_name, round(grade, 6) as grade from attempts
       order by grade desc, ts desc, id limit 10
       offset (select (count(*) // 20) * 10 from orders)""",
)
def _(v: Views) -> DataFrame:
    attempts = v.attempts()
    middle = attempts.count() // 20 + 1
    page = selection.paginate(attempts, ordering.RANKING, middle)
    return page.select("id", "student_name", _grade())


@query(
    "paginate_past_end",
    """select id, student_name, round(grade, 6) as grade from attempts
       order by ts desc, grade desc, id limit 7
       offset (select (greatest(1, cast(ceil(count(*) / 7.0) as bigint)) - 1) * 7 from orders)""",
)
def _(v: Views) -> DataFrame:
    page = selection.paginate(v.attempts(), ordering.NEWEST, page=1 << 40, size=7)
    return page.select("id", "student_name", _grade())


@query(
    "paginate_all",
    """select id, profile_name, cast((row_number() over (partition by profile_name
              order by ts desc, grade desc, id) - 1) // 10 + 1 as bigint) as page
       from attempts""",
)
def _(v: Views) -> DataFrame:
    listed = v.attempts().select("id", "profile_name", "ts", "grade")
    pages = ordering.paginate_all(listed, ordering.NEWEST, ["profile_name"])
    return pages.select("id", "profile_name", "page")


@query(
    "page_limit_offset",
    """select id, round(grade, 6) as grade from attempts where profile_name = '5-LOW'
       order by grade desc, ts desc, id limit 10 offset 30""",
)
def _(v: Views) -> DataFrame:
    rows = selection.page_limit_offset(v.attempts(), "5-LOW", 10, 30)
    return rows.select("id", _grade())


@query(
    "page_counts",
    """select profile_name, variant_name,
              greatest(1, cast(ceil(count(*) / 10.0) as bigint)) as pages
       from attempts group by 1, 2""",
)
def _(v: Views) -> DataFrame:
    return ordering.page_counts(v.attempts(), ["profile_name", "variant_name"])


# --- Text ------------------------------------------------------------------------------------


@query(
    "format_columns",
    """select id, printf('%.2f', case when total_questions > 0
                then score * 19.0e0 / total_questions else 0.0e0 end) as grade_text,
              concat(cast(score as varchar), '/', cast(total_questions as varchar)) as score_text,
              strftime(ts - interval 4 hour, '%Y-%m-%d %H:%M') as table_time,
              strftime(ts - interval 4 hour, '%d de %b, %Y - %H:%M') as card_time
       from attempts""",
)
def _(v: Views) -> DataFrame:
    # A zone without clock changes, four hours behind UTC all year.
    zone = "-04:00"
    on_19 = grading.grade_of(F.col("score"), F.col("total_questions"), 19.0)
    return v.attempts().select(
        "id",
        text.fmt_grade(on_19).alias("grade_text"),
        text.fmt_score(F.col("score"), F.col("total_questions")).alias("score_text"),
        text.fmt_ts_table(F.col("ts"), zone).alias("table_time"),
        text.fmt_ts_card(F.col("ts"), zone).alias("card_time"),
    )


@query(
    "split_topics",
    """select p_partkey as id, cast(len(topics) as int) as topics,
              array_to_string(topics, ', ') as topic_text
       from (select p_partkey, [trim(x, concat(' ', chr(9), chr(10))) for x in string_split(
               concat(replace(p_name, ' ', ' , '), ',, ', chr(9), p_type, chr(10)), ',')
               if trim(x, concat(' ', chr(9), chr(10))) <> ''] as topics
             from part) t""",
)
def _(v: Views) -> DataFrame:
    typed = F.concat(
        F.replace("p_name", F.lit(" "), F.lit(" , ")), F.lit(",, \t"), F.col("p_type"), F.lit("\n")
    )
    topics = text.split_topics(typed)
    # Through the stored form and back.
    stored = v.table("part").select(
        F.col("p_partkey").alias("id"), text.topics_json(topics).alias("temas")
    )
    decoded = tables.decode_configs(stored)
    return decoded.select(
        "id", F.size("temas").alias("topics"), text.join_topics(F.col("temas")).alias("topic_text")
    )


@query(
    "question_texts",
    r"""select doc_id, regexp_replace(case when parts[2] is null then full_text
                 else parts[2] end, '^\s+|\s+$', '', 'g') as summary,
              parts[len(parts)] as exam_text, full_text = shown as formative_is_whole
       from (select doc_id, full_text, full_text as shown,
                    string_split(full_text, concat(chr(10), chr(10))) as parts
             from (select doc_id, replace(text, chr(10), concat(chr(10), chr(10))) as full_text
                   from documents) d) p""",
)
def _(v: Views) -> DataFrame:
    question = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    whole = text.exam_question_text(question, F.lit(1))
    return v.table("documents").select(
        "doc_id",
        text.question_summary(question).alias("summary"),
        text.exam_question_text(question, F.lit(0)).alias("exam_text"),
        (whole == question).alias("formative_is_whole"),
    )


@query(
    "slug_profile",
    """select distinct profile_name, concat('calificaciones_evaluativas_',
              replace(profile_name, ' ', '_'), '.csv') as file_name from attempts""",
)
def _(v: Views) -> DataFrame:
    profiles = grading.distinct_profiles(v.attempts())
    return profiles.select(
        "profile_name", text.gradebook_file_name(F.col("profile_name")).alias("file_name")
    )


@query(
    "render_prompt",
    """select p_partkey as id, concat('{"n": ', cast(p_size as varchar), '} ', p_type, ': {',
              replace(p_name, ' ', ', '), '} (', p_brand, ')') as prompt
       from part""",
)
def _(v: Views) -> DataFrame:
    configs = v.table("part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_type").alias("asignatura"),
        F.col("p_size").alias("num_preguntas"),
        F.col("p_brand").alias("dificultad"),
        text.topics_json(F.split("p_name", " ")).alias("temas"),
    )
    template = '{{"n": {num_preguntas}}} {asignatura}: {{{temas_str}}} ({dificultad})'
    return configs.select(
        "id", text.render_prompt(template, text.prompt_fields()).alias("prompt")
    )


# --- Quiz documents --------------------------------------------------------------------------


@query("extract_json_list", "select gen_id, doc from extracted")
def _(v: Views) -> DataFrame:
    return v.raw_items().select(
        "gen_id", quizjson.extract_json_list(F.col("raw_text")).alias("doc")
    )


@query("repair_backslashes", "select gen_id, doc from repaired")
def _(v: Views) -> DataFrame:
    return documents.clean_replies(v.raw_items()).select(
        "gen_id", F.col("quiz_data_json").alias("doc")
    )


@query("validate_quiz", "select gen_id, lenient, strict from validated")
def _(v: Views) -> DataFrame:
    cleaned = documents.clean_replies(v.raw_items())
    judged = documents.validate_quiz(cleaned, name="lenient")
    judged = documents.validate_quiz(judged, mode="strict", name="strict")
    return judged.select("gen_id", "lenient", "strict")


@query(
    "explode_questions",
    """select gen_id, cast(i as int) as idx,
              doc ->> concat('$[', cast(i as varchar), '].pregunta') as pregunta,
              doc ->> concat('$[', cast(i as varchar), '].opciones.C') as option_c,
              doc ->> concat('$[', cast(i as varchar), '].respuesta_correcta')
                as respuesta_correcta,
              doc ->> concat('$[', cast(i as varchar), '].explicacion') as explicacion
       from (select *, unnest(range(0, num_preguntas)) as i from validated where lenient) v""",
)
def _(v: Views) -> DataFrame:
    cleaned = documents.clean_replies(v.raw_items())
    valid = documents.validate_quiz(cleaned).where("is_valid").select("gen_id", "quiz_data_json")
    return documents.explode_questions(valid).select(
        "gen_id",
        "idx",
        "pregunta",
        F.try_element_at("opciones", F.lit("C")).alias("option_c"),
        "respuesta_correcta",
        "explicacion",
    )


@query(
    "assemble_quiz",
    """select attempt_id, string_agg(concat(cast(idx as varchar), ':q',
              cast(question_id as varchar), ':', respuesta_correcta), ' ' order by idx) as outline
       from answers group by 1""",
)
def _(v: Views) -> DataFrame:
    built = documents.assemble_quiz(v.question_rows(), ["attempt_id"])
    line = lambda q, i: F.concat_ws(":", i.cast("string"), q["pregunta"], q["respuesta_correcta"])
    decoded = documents.with_questions(built, "quiz_data_json")
    outline = F.transform("questions", line)
    return decoded.select("attempt_id", F.array_join(outline, " ").alias("outline"))


@query(
    "answers_map",
    """select attempt_id, string_agg(concat(cast(idx as varchar), '=', coalesce(answer, '-')), ' '
              order by cast(idx as varchar)) as outline
       from answers group by 1""",
)
def _(v: Views) -> DataFrame:
    stored = documents.answers_map(v.numbered_answers(), ["attempt_id"])
    decoded = F.map_entries(quizjson.parse_answers(F.col("student_answers_json")))
    line = lambda e: F.concat_ws("=", e["key"], F.coalesce(e["value"], F.lit("-")))
    outline = F.transform(F.array_sort(decoded), line)
    return stored.select("attempt_id", F.array_join(outline, " ").alias("outline"))


@query(
    "normalize_options",
    """select p_partkey as id, p_name as option_a, p_type as option_b,
              case when p_size < 25 then p_brand end as option_c
       from part""",
)
def _(v: Views) -> DataFrame:
    as_list = F.to_json(
        F.array(
            F.concat(F.lit("A) "), "p_name"), F.concat(F.lit("B. "), "p_type"), F.col("p_brand")
        )
    )
    as_map = F.to_json(F.struct(F.col("p_name").alias("A"), F.col("p_type").alias("B")))
    parts = v.table("part").select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_size") < 25, as_list).otherwise(as_map).alias("opciones"),
    )
    options = documents.normalize_options(parts)
    letters = {"option_a": "A", "option_b": "B", "option_c": "C"}
    return options.select(
        "id",
        *[F.try_element_at("opciones", F.lit(key)).alias(name) for name, key in letters.items()],
    )


_DRAWN_SQL = """select attempt_id, idx as original_idx, cast(place as int) as place, pregunta
       from (select a.attempt_id, a.idx, concat('q', cast(a.question_id as varchar)) as pregunta,
                    c.num_preguntas, c.show_feedback,
                    row_number() over (partition by a.attempt_id order by md5(concat('seed:',
                      cast(a.attempt_id as varchar), ':', cast(a.idx as varchar)))) as drawn
             from answers a join attempts t on t.id = a.attempt_id
             join configs c on c.profile_name = t.profile_name
               and c.variant_name = t.variant_name) d"""


def _drawn(drawn: DataFrame) -> DataFrame:
    rows = documents.explode_items(drawn, ["attempt_id"], "questions", "_pos", "_q")
    return rows.select(
        "attempt_id",
        F.col("_q.original_idx").alias("original_idx"),
        (F.col("_pos") + 1).alias("place"),
        F.col("_q.question.pregunta").alias("pregunta"),
    )


def _configured(v: Views) -> DataFrame:
    """Quiz documents with what the unit's configuration says about showing them."""
    units = v.configs().select(
        "profile_name",
        "variant_name",
        "num_preguntas",
        (F.col("show_feedback") == 0).alias("evaluative"),
    )
    attempts = v.sheets().select(F.col("id").alias("attempt_id"), "profile_name", "variant_name")
    shown = attempts.join(units, ["profile_name", "variant_name"])
    return v.snapshots().join(shown, "attempt_id")


@query(
    "shuffle_questions",
    _DRAWN_SQL.replace(
        "cast(place as int) as place",
        "cast(case when show_feedback = 0 then drawn else idx + 1 end as int) as place",
    )
    + " where case when show_feedback = 0 then drawn else idx + 1 end <= num_preguntas",
)
def _(v: Views) -> DataFrame:
    return _drawn(
        documents.shuffle_questions(
            _configured(v), "seed", "attempt_id", "quiz_snapshot_json", "evaluative",
            "num_preguntas",
        )
    )


@query("shuffle_all_questions", _DRAWN_SQL.replace("cast(place", "cast(drawn"))
def _(v: Views) -> DataFrame:
    return _drawn(
        documents.shuffle_questions(v.snapshots(), "seed", "attempt_id", "quiz_snapshot_json")
    )


@query(
    "reviewed_question",
    """select attempt_id, idx, case when question_id % 5 = 0 then 'A' else respuesta_correcta end
                as respuesta_correcta,
              concat('a|', case when question_id % 3 = 0 then '' else 'b' end, '|c|d') as options
       from answers""",
)
def _(v: Views) -> DataFrame:
    given = F.map_filter(
        F.map_concat("opciones", F.create_map(F.lit("E"), F.lit("e"))),
        lambda k, _: (k != "B") | (F.col("question_id") % 3 != 0),
    )
    rows = v.question_rows().withColumn(
        "question_id", F.substring("pregunta", 2, 20).cast("bigint")
    )
    edited = rows.withColumns(
        {
            "opciones": given,
            "respuesta_correcta": F.when(F.col("question_id") % 5 == 0, "E").otherwise(
                F.col("respuesta_correcta")
            ),
        }
    )
    return documents.reviewed_question(edited).select(
        "attempt_id",
        "idx",
        "respuesta_correcta",
        F.array_join(F.map_values("opciones"), "|").alias("options"),
    )


@query(
    "shuffle_options",
    """with options as (
         select attempt_id, idx, respuesta_correcta, t.k as old_key,
                case when t.k = 'C' and question_id % 5 = 0 then 'a' else lower(t.k) end as label
         from answers, unnest(['A', 'B', 'C', 'D']) t(k)),
       drawn as (
         select *, substr('ABCD', cast(row_number() over (partition by attempt_id, idx order by
                  md5(concat('seed:', cast(attempt_id as varchar), ':', cast(idx as varchar), ':',
                  old_key))) as int), 1) as new_key,
                max(case when old_key = respuesta_correcta then label end)
                  over (partition by attempt_id, idx) as correct_label
         from options)
       select attempt_id, idx, string_agg(label, '' order by new_key) as labels,
              max(case when label = correct_label then new_key end) as respuesta_correcta,
              true as options_ok
       from drawn group by 1, 2""",
)
def _(v: Views) -> DataFrame:
    third = F.when(F.col("question_id") % 5 == 0, "a").otherwise("c")
    options = F.create_map(
        F.lit("A"), F.lit("a"), F.lit("B"), F.lit("b"), F.lit("C"), third, F.lit("D"), F.lit("d")
    )
    rows = v.numbered_answers().select(
        "attempt_id",
        "idx",
        F.lit("q").alias("pregunta"),
        options.alias("opciones"),
        "respuesta_correcta",
        F.lit("e").alias("explicacion"),
    )
    drawn = documents.shuffle_options(rows, "seed", ["attempt_id", "idx"])
    labels = [F.col("opciones")[key] for key in "ABCD"]
    return drawn.select(
        "attempt_id",
        "idx",
        F.concat(*labels).alias("labels"),
        "respuesta_correcta",
        "options_ok",
    )
