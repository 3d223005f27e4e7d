"""Table changes as table-to-table transforms: append, upsert, delete, activation, new ids."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradelake.operators.versions import latest_ids
from gradelake.plans.ordering import fresh, with_position


class Sequencer(Protocol):
    """What gives out blocks of ids, such as ``sources.sequences.IdSequence``."""

    def reserve(self, count: int, at_least: int = 0) -> int: ...


def _whole_number(df: DataFrame, order: str) -> Column:
    """An order column as a whole number; times as microseconds."""
    if order not in df.columns:
        raise ValueError(f"no column {order} to order by")
    kind = df.schema[order].dataType
    if isinstance(kind, T.StringType):
        return F.unix_micros(F.col(order).try_cast("timestamp"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(F.col(order).cast("timestamp"))
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.col(order).cast("bigint")
    raise ValueError(f"{order} is neither a time nor a whole number")


def _winners(df: DataFrame, keys: Sequence[str], order: str, latest: bool) -> DataFrame:
    """One row per key: the last, or the first, by ``order``; a null order loses to any other.

    Equal orders are told apart by a hash of the row. The winner is found on the key and one
    fixed-width number, so wide columns stay out of the aggregate, and then fetched.
    """
    span = F.lit("9223372036854775808").cast("decimal(19,0)")
    missing = F.lit("-9223372036854775808" if latest else "9223372036854775807")
    number = F.coalesce(_whole_number(df, order).cast("decimal(19,0)"),
                        missing.cast("decimal(19,0)"))
    spread = F.shiftrightunsigned(F.xxhash64(*df.columns), 1).cast("decimal(19,0)")
    rank = fresh(df, "rank")
    ranked = df.withColumn(rank, number * span + spread)
    best = F.max(rank) if latest else F.min(rank)
    chosen = ranked.groupBy(*keys).agg(best.alias(rank))
    # Rows that share key and rank are copies of each other.
    return ranked.join(chosen, [*keys, rank], "left_semi").drop(rank).distinct()


def append_attempts(
    existing: DataFrame, batch: DataFrame, key: str | Sequence[str] = "id", order: str = "ts"
) -> DataFrame:
    """Rows of ``batch`` not stored yet, each attempt once; its earliest save by ``order`` counts.

    Saves without a time come last. Attempts that have no id yet can be told apart by several
    ``key`` columns. The stored table is cut down to the keys of the batch first, so a small
    batch reaches it as a broadcast filter and only the key columns are read.
    """
    keys = [key] if isinstance(key, str) else list(key)
    stored = existing.select(*keys).join(batch.select(*keys), keys, "left_semi")
    unique = _winners(batch, keys, order, latest=False)
    return unique.join(stored, keys, "left_anti").select(*batch.columns)


def upsert_latest(
    target: DataFrame,
    updates: DataFrame,
    keys: Sequence[str],
    order: str,
    id_column: str | None = None,
    sequence: Sequencer | None = None,
) -> DataFrame:
    """Insert or update by key; of several updates to a key the last by ``order`` wins.

    An update without an order is the earliest. An updated row keeps its id and the columns the
    updates do not carry; a new row gets the next ids, in the order the keys first appeared.
    With a ``sequence`` these follow the highest id ever given out, and it is advanced at once;
    without one they follow the highest id in ``target``, so the id of a deleted last row would
    return. Updates are joined to the target, not the other way round, so a small batch is
    broadcast.
    """
    carried = [c for c in updates.columns if c not in (*keys, order)]
    new = {c: fresh(target, f"new_{c}") for c in carried}
    updated, first_seen = fresh(target, "updated"), fresh(target, "first_seen")
    newest = _winners(updates, keys, order, latest=True).select(
        *keys, *[F.col(c).alias(new[c]) for c in carried], F.lit(True).alias(updated)
    )

    def merged_value(column: str) -> Column:
        if column in carried:
            return F.when(F.col(updated), F.col(new[column])).otherwise(F.col(column))
        return F.col(column)

    kept = target.join(newest, list(keys), "left").select(
        *[merged_value(c).alias(c) for c in target.columns]
    )
    added = newest.join(target.select(*keys), list(keys), "left_anti").select(
        *keys, *[F.col(new[c]).alias(c) for c in carried]
    )
    for field in target.schema:
        if field.name not in added.columns:
            added = added.withColumn(field.name, F.lit(None).cast(field.dataType))
    if id_column is None:
        return kept.unionByName(added.select(*target.columns))
    seen = updates.groupBy(*keys).agg(F.min(_whole_number(updates, order)).alias(first_seen))
    numbered = insert_ids(
        added.drop(id_column).join(seen, list(keys)),
        target.agg(F.max(id_column)).first()[0] or 0,
        [first_seen, *keys],
        id_column,
        sequence,
    ).withColumn(id_column, F.col(id_column).cast(target.schema[id_column].dataType))
    return kept.unionByName(numbered.select(*target.columns))


def assign_ids(df: DataFrame, start: int, order: Sequence[str], name: str = "id") -> DataFrame:
    """Consecutive ids after ``start``, following ``order``."""
    placed = with_position(df, order, name=name)
    return placed.withColumn(name, F.col(name) + F.lit(start))


def insert_ids(
    df: DataFrame,
    highest: int,
    order: Sequence[str],
    name: str = "id",
    sequence: Sequencer | None = None,
) -> DataFrame:
    """Ids for rows to be inserted, following ``order`` after ``highest``, the last id stored.

    With a ``sequence`` as many ids as there are rows are reserved from it now, above every id
    it gave out before.
    """
    if sequence is None:
        return assign_ids(df, highest, order, name)
    placed = with_position(df, order, name=name)
    count = placed.agg(F.max(name)).first()[0] or 0
    return placed.withColumn(name, F.col(name) + F.lit(sequence.reserve(count, highest)))


def resolve_settings(settings: DataFrame, defaults: DataFrame) -> DataFrame:
    """Value of each key in ``defaults``: the stored one, else the default.

    A stored null is a value; only a missing row takes the default.
    """
    stored = settings.select("key", F.col("value").alias("_value"), F.lit(True).alias("_stored"))
    return defaults.join(stored, "key", "left").select(
        "key", F.when(F.col("_stored"), F.col("_value")).otherwise(F.col("value")).alias("value")
    )


def delete_configs(configs: DataFrame, ids: DataFrame) -> DataFrame:
    """Configurations without the listed ``id`` values."""
    return configs.join(ids.select("id"), "id", "left_anti")


def cascade_delete(quizzes: DataFrame, deleted: DataFrame) -> DataFrame:
    """Quizzes whose configuration is not among the deleted ``id`` values."""
    gone = deleted.select(F.col("id").alias("config_id"))
    return quizzes.join(gone, "config_id", "left_anti").select(*quizzes.columns)


def clear_results(results: DataFrame) -> DataFrame:
    """The table without rows, its columns kept."""
    return results.limit(0)


def activate_new_version(quizzes: DataFrame, new: DataFrame) -> DataFrame:
    """Add new versions; the last one of each unit (highest id) is its only active version."""
    columns = quizzes.columns
    newest = new.groupBy("config_id").agg(F.max("id").alias("_newest"))
    older = quizzes.join(newest, "config_id", "left").withColumn(
        "is_active", F.when(F.col("_newest").isNull(), F.col("is_active")).otherwise(F.lit(0))
    )
    added = new.join(newest, "config_id").withColumn(
        "is_active", (F.col("id") == F.col("_newest")).cast("int")
    )
    return older.select(*columns).unionByName(added.select(*columns))


def set_activation(
    quizzes: DataFrame,
    requests: DataFrame,
    order: str | None = None,
    newest: DataFrame | None = None,
) -> DataFrame:
    """Apply on/off requests (``config_id``, ``is_active``) per unit.

    Off clears every version of the unit; on leaves only the newest version active. Of several
    requests for a unit the last by ``order`` counts; without an order, any "on" does. ``newest``
    is ``latest_ids`` of the versions where it is at hand, so it need not be worked out from
    ``quizzes``.
    """
    on = F.col("is_active") == 1
    wanted = requests.groupBy("config_id").agg(
        (F.max_by(on, order) if order else F.max(on)).alias("_on")
    )
    newest = latest_ids(quizzes) if newest is None else newest
    newest = newest.select("config_id", F.col("id").alias("_newest"))
    plan = wanted.join(newest, "config_id", "left")
    return quizzes.join(plan, "config_id", "left").select(
        *[c for c in quizzes.columns if c != "is_active"],
        F.when(F.col("_on").isNull(), F.col("is_active"))
        .otherwise((F.col("_on") & (F.col("id") == F.col("_newest"))).cast("int"))
        .alias("is_active"),
    ).select(*quizzes.columns)


def replay_activation(
    actions: DataFrame, quizzes: DataFrame, newest: DataFrame | None = None
) -> DataFrame:
    """Active version per unit after a log of ``generate``, ``on`` and ``off`` actions.

    Every insert of a version is itself an action, so the last action decides whether the unit
    is active, and then it is the newest version that is. ``active_id`` is null when off.
    ``newest`` is ``latest_ids`` of the versions where it is at hand.
    """
    is_off = (F.col("act") == "off").cast("int")
    last = actions.groupBy("config_id").agg(F.max_by(is_off, "action_id").alias("_off"))
    newest = latest_ids(quizzes) if newest is None else newest
    newest = newest.select("config_id", F.col("id").alias("_newest"))
    return last.join(newest, "config_id", "left").select(
        "config_id", F.when(F.col("_off") == 0, F.col("_newest")).alias("active_id")
    )


def mark_active(quizzes: DataFrame, active: DataFrame) -> DataFrame:
    """Set ``is_active`` on the versions named by a ``replay_activation`` result."""
    chosen = active.where(F.col("active_id").isNotNull()).select(F.col("active_id").alias("_id"))
    columns = [c for c in quizzes.columns if c != "is_active"]
    return quizzes.join(chosen, F.col("id") == F.col("_id"), "left").select(
        *columns, F.col("_id").isNotNull().cast("int").alias("is_active")
    )


def evolve_schema(
    parts: Sequence[DataFrame],
    target: T.StructType,
    defaults: dict[str, object] | None = None,
    drop_undeclared: bool = False,
) -> DataFrame:
    """Bring tables written by older versions to the current columns and join them up.

    A table that lacks a column gets its default there; nulls already stored stay null. A column
    that is not declared is an error unless ``drop_undeclared`` says to leave it out.
    """
    defaults = defaults or {}
    aligned = []
    for part in parts:
        undeclared = [c for c in part.columns if c not in target.fieldNames()]
        if undeclared and not drop_undeclared:
            raise ValueError(f"undeclared columns: {', '.join(undeclared)}")
        columns = [
            (F.col(f.name) if f.name in part.columns else F.lit(defaults.get(f.name)))
            .cast(f.dataType)
            .alias(f.name)
            for f in target.fields
        ]
        aligned.append(part.select(*columns))
    whole = aligned[0]
    for part in aligned[1:]:
        whole = whole.unionByName(part)
    return whole
