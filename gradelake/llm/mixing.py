"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradelake.llm.common import fresh, quoted, settled, table, word_count

MAX_REPEATS = 3
CYCLE = (1, 2, 3)
SEED = 20
# Ranks are first summed in this many equal steps of the ranking variable; only the step in
# which a source's sample ends is then ordered row by row.
STEPS = 1 << 12
# Copies of one row that a task numbers.
LOT = 1 << 16
# Documents added at most to bring a sample of a source nearer to its target.
COMPLETIONS = 3


def shares(
    sizes: Sequence[float], weights: Sequence[float], cap: float = MAX_REPEATS
) -> list[float]:
    """Targets in proportion to weights, none above ``cap`` times its size.

    They share the sum of the sizes; what is above a cap is shared again by weight among the
    others until none is above.
    """
    targets = [0.0] * len(sizes)
    left, weight = float(sum(sizes)), sum(w for w, s in zip(weights, sizes, strict=True) if s > 0)
    # The lower its cap lies for its weight, the sooner a source is full.
    filling = sorted((cap * s / weights[i], i) for i, s in enumerate(sizes) if s > 0)
    for k, (_, i) in enumerate(filling):
        if weights[i] * left <= cap * sizes[i] * weight:
            for _, j in filling[k:]:
                targets[j] = weights[j] * (left / weight)
            break
        targets[i] = float(cap * sizes[i])
        left, weight = left - targets[i], weight - weights[i]
    return targets


def uniform(mark: Column, copy: Column, seed: int = SEED) -> Column:
    """A fixed random number in (0, 1) for each copy of a row."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), mark, copy), 11)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 53))


def row_mark(docs: DataFrame) -> Column:
    """A hash of all columns but maps, which cannot be hashed; equal rows share it."""
    hashed = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    return F.xxhash64(*[F.col(quoted(c)) for c in hashed])


def measured(docs: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Every row of ``docs`` with doc_id, source, size in words, mark and random number ``u``;
    and the marks of rows that come more than once, with their ``copies``. Both are written.

    Equal rows are counted and numbered, and each has a random number of its own. They are
    alike, so the numbers are dealt out anew instead of being tied to rows: one row per mark is
    unfolded in two steps, so that the most frequent one is unfolded by many tasks.
    """
    rows = settled(
        docs.select(
            F.col("doc_id"),
            F.col("source").cast("string").alias("source"),
            word_count(F.col("text")).alias("size"),
            row_mark(docs).alias("mark"),
        ),
        "sizes",
    )
    often = rows.groupBy("mark").agg(
        F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in rows.columns[:3]]
    )
    often = settled(often.where(F.col("copies") > 1), "often")
    once = rows.join(often.select("mark"), "mark", "left_anti").withColumn("copy", F.lit(0))
    lots = often.select(
        "*", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / LOT))).alias("lot")
    )
    first = F.col("lot") * LOT
    upto = F.least(F.col("copies"), first + LOT) - 1
    unfolded = lots.repartition("mark", "lot").select(
        *once.columns[:-1], F.explode(F.sequence(first, upto)).alias("copy")
    )
    numbered = once.unionByName(unfolded)
    return settled(
        numbered.select(
            "doc_id", "source", "size", "mark",
            uniform(F.col("mark"), F.col("copy").cast("bigint"), seed).alias("u"),
        ),
        "numbered",
    ), often.select("mark", "copies")


def source_plan(
    rows: DataFrame, cap: float = MAX_REPEATS, cycle: Sequence[float] = CYCLE
) -> DataFrame:
    """One row per source: source, source_size, rows, target, whole copies and the rest.

    Sources by code point, null last, weigh ``cycle`` over and over. One row per source reaches
    the driver, as many as the mix has weights.
    """
    spark = rows.sparkSession
    totals = rows.groupBy("source").agg(F.sum("size"), F.sum(F.signum("size")).cast("bigint"))
    found = sorted(totals.collect(), key=lambda r: (r[0] is None, (r[0] or "").encode("utf-8")))
    targets = shares([r[1] for r in found], [cycle[i % len(cycle)] for i in range(len(found))], cap)
    plan = []
    for (source, size, docs), target in zip(found, targets, strict=True):
        whole = int(target // size) if size else 0
        rest = target - whole * size
        plan.append((source, int(size), int(docs), target, whole, rest))
    return spark.createDataFrame(
        plan, "source string, source_size long, docs long, target double, whole long, rest double"
    )


def rank_value(u: Column, size: Column, plan: dict[str, Column]) -> Column:
    """Random odds over inclusion odds, brought into (0, 1) without changing the order.

    The part of a source that whole copies leave open is f = rest / source_size. A document's
    inclusion odds are f / (1 - f), higher for short documents and lower for long ones by the
    square root of mean size over size, so that a sample does not hang on a few huge texts.
    """
    f = F.greatest(plan["rest"] / plan["source_size"], F.lit(1e-12))
    odds = f / F.greatest(1 - f, F.lit(1e-12)) * F.sqrt(
        plan["source_size"] / plan["docs"] / F.greatest(size, F.lit(1))
    )
    pareto = u / (1 - u) / odds
    return pareto / (1 + pareto)


def ends(rows: DataFrame, plan: DataFrame, steps: int = STEPS) -> DataFrame:
    """``plan`` with ``last``: the largest rank value of a source that its sample takes.

    A source's documents are taken by rank as long as their words stay within the rest. Words
    are summed per step of the rank first, so no task meets a whole source; the step in which
    the sum passes the rest holds about one in ``steps`` of a source's rows.
    """
    columns = {c: F.col(c) for c in plan.columns}
    ranked = rows.where(F.col("size") > 0).join(
        plan.where(F.col("rest") > 0).withColumnRenamed("source", "plan_source"),
        F.col("source").eqNullSafe(F.col("plan_source")),
    )
    ranked = ranked.select(
        "source", "size", "rest", rank_value(F.col("u"), F.col("size"), columns).alias("rank")
    ).withColumn("step", F.floor(F.col("rank") * steps).cast("int"))
    sums = ranked.groupBy("source", "step").agg(F.sum("size").alias("words"), F.max("rest"))
    before = Window.partitionBy("source").orderBy("step").rowsBetween(
        Window.unboundedPreceding, -1
    )
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    passed = sums.where(
        (F.col("before") < F.col("max(rest)"))
        & (F.col("before") + F.col("words") >= F.col("max(rest)"))
    ).select(F.col("source").alias("at_source"), F.col("step").alias("at_step"), "before")
    inside = ranked.join(
        passed,
        F.col("source").eqNullSafe(F.col("at_source")) & (F.col("step") == F.col("at_step")),
    )
    # Equal ranks (repeated rows) are taken together or not at all.
    inside = inside.groupBy("source", "before", "rest", "rank").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("taken", F.col("before") + F.sum("words").over(upto))
    fits = F.col("taken") <= F.col("rest")
    last = inside.groupBy("source").agg(
        F.max(F.when(fits, F.col("rank"))).alias("last"),
        F.max(F.when(fits, F.col("taken"))).alias("sampled"),
        F.max("before").alias("before"),
        F.min("rank").alias("first"),
    )
    # With nothing taken inside the step, the sample ends just below it.
    last = last.select(
        F.col("source").alias("end_source"),
        F.coalesce("last", F.col("first") * F.lit(1 - 1e-15)).alias("last"),
        F.coalesce("sampled", "before").alias("sampled"),
    )
    found = plan.join(last, F.col("source").eqNullSafe(F.col("end_source")), "left").drop(
        "end_source"
    )
    return _completed(rows, settled(found, "sample-ends"))


def _completed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` with ``extra``: random numbers of the documents that complete a sample.

    The first document that no longer fits may be long. Of all documents left, the one whose
    size is nearest to the words still missing is added if that brings the source nearer to its
    target; two rounds add what fits, the last one may go over.
    """
    columns = {c: F.col(c) for c in plan.columns}
    plan = plan.withColumn("extra", F.array().cast("array<double>"))
    for top_up in range(COMPLETIONS):
        missing = F.col("rest") - F.col("sampled")
        off = F.abs(F.col("size") - missing)
        left = rows.where(F.col("size") > 0).join(
            plan.where(missing > 0).withColumnRenamed("source", "plan_source"),
            F.col("source").eqNullSafe(F.col("plan_source")),
        )
        left = left.where(
            (rank_value(F.col("u"), F.col("size"), columns) > F.col("last"))
            & ~F.array_contains("extra", F.col("u"))
            & (off < missing)
        )
        if top_up < COMPLETIONS - 1:
            left = left.where(F.col("size") <= missing)
        # The random number breaks ties; it moves no choice between sizes that differ by more.
        key = off + F.col("u") * 1e-6
        nearest = left.groupBy(F.col("source").alias("near_source")).agg(
            F.min_by("u", key).alias("near"), F.min_by("size", key).alias("near_size")
        )
        plan = plan.join(nearest, F.col("source").eqNullSafe(F.col("near_source")), "left")
        more = F.when(F.col("near").isNull(), F.col("extra")).otherwise(
            F.array_append("extra", F.col("near"))
        )
        plan = plan.withColumns(
            {"extra": more, "sampled": F.col("sampled") + F.coalesce("near_size", F.lit(0))}
        ).drop("near_source", "near", "near_size")
        plan = settled(plan, "completed")
    return plan


def planned(rows: DataFrame) -> DataFrame:
    """``measured`` rows to one row per source with everything that decides its copies."""
    plan = source_plan(rows)
    return ends(rows, plan).select(
        F.col("source").alias("plan_source"),
        "source_size", "docs", "target", "whole", "rest", "last", "extra",
    )


def copies(u: Column, size: Column, plan: dict[str, Column]) -> Column:
    """How often a document is taken: the certain whole copies, and one if it is sampled."""
    ranked = F.coalesce(rank_value(u, size, plan) <= plan["last"], F.lit(False))
    sampled = (size > 0) & (ranked | F.coalesce(F.array_contains(plan["extra"], u), F.lit(False)))
    return plan["whole"] + sampled.cast("bigint")


def _taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with the plan of their source and ``times``, how often each is taken."""
    parts = {c: F.col(c) for c in plan.columns}
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("plan_source")))
    return joined.withColumn("times", copies(F.col("u"), F.col("size"), parts))


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken words of every row of ``docs``.

    A null text has size 0 and is never taken; a null source is a source of its own, the last
    one. A source without words has target 0. Each of several equal rows is sampled on its own.
    No rows give no rows.
    """
    rows, _ = measured(docs)
    return _taken(rows, planned(rows)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken")
    )


def mix(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it.

    Rows without words are not taken, whatever their source; a null source is one of its own.
    Equal rows are sampled each on its own and come back as often as all of them are taken.
    Columns may have any name. No rows give no rows.
    """
    rows, often = measured(docs)
    plan = settled(planned(rows), "plan")
    mark, times = fresh(docs, "row_mark"), fresh(docs, "row_times")
    names = {c: fresh(docs, f"mix_{c}") for c in plan.columns}
    columns = [F.col(quoted(c)) for c in docs.columns]
    marked = docs.select("*", row_mark(docs).alias(mark))
    # Rows met once are decided where they lie.
    keyed = often.select(F.col("mark").alias(names["rest"]))
    once = marked.join(keyed, F.col(mark) == F.col(names["rest"]), "left_anti")
    own = plan.select([F.col(c).alias(a) for c, a in names.items()])
    parts = {c: F.col(a) for c, a in names.items()}
    once = once.join(own, docs["source"].cast("string").eqNullSafe(parts["plan_source"]))
    size, u = word_count(docs["text"]), uniform(F.col(mark), F.lit(0).cast("bigint"))
    taken = F.when(size > 0, copies(u, size, parts)).otherwise(0).cast("int")
    single = once.select(*columns, F.explode(F.array_repeat(F.lit(0), taken)).alias(times))
    # Of equal rows one is unfolded as often as all of them are taken.
    total = _taken(rows.join(often.select("mark"), "mark", "left_semi"), plan)
    total = total.where(F.col("size") > 0).groupBy(F.col("mark").alias(names["last"])).agg(
        F.sum("times").cast("bigint").alias(times)
    )
    total = settled(total.where(F.col(times) > 0), "times")
    equal = marked.join(total, F.col(mark) == F.col(names["last"])).dropDuplicates([mark])
    lots = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(times) - 1) / LOT))
    lot, copy = names["whole"], names["extra"]
    dealt = equal.select("*", F.explode(lots).alias(lot)).repartition(mark, lot)
    left = F.least(F.lit(LOT), F.col(times) - F.col(lot) * LOT).cast("int")
    several = dealt.select(*columns, F.explode(F.array_repeat(F.lit(0), left)).alias(copy))
    return single.select(*columns).unionAll(several.select(*columns))


def op6(spark: SparkSession, folder: str) -> DataFrame:
    return mix_report(table(spark, folder, "documents"))
