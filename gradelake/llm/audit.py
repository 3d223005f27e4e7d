"""What every filter removes in every order, by the potential of the removal game."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.llm.common import let, settled, table, words

LETTERS = "ABCDE"
MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_CAPITAL_PERCENT = 10
MARKS = "[#$%&*|]"
MEASURES = ("n", "good", "toxic")


def own_failures(text: Column) -> list[Column]:
    """Conditions A to D, which look at one text alone (not null)."""
    found = words(text)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]", ""))
    return [
        F.size(found) < MIN_WORDS,
        let(
            found,
            lambda w: 100 * F.size(F.array_distinct(w)) < MIN_DISTINCT_PERCENT * F.size(w),
        ),
        100 * capitals.cast("bigint") > MAX_CAPITAL_PERCENT * F.length(text),
        text.rlike(MARKS),
    ]


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bit i: fails filter i), good and toxic (0 or 1) of every row of ``docs``.

    Every text is read once. What is shuffled after that is a digest of the text and an id.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    bits = [F.when(c, F.lit(1 << i)).otherwise(0) for i, c in enumerate(own_failures(text))]
    rows = settled(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
            F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
            sum(bits[1:], bits[0]).alias("own"),
        ),
        "audit",
    )
    # Only texts met more than once can fail E; the smallest id is found before the shuffle.
    firsts = rows.groupBy(F.col("digest").alias("copied")).agg(
        F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")
    )
    firsts = firsts.where(F.col("copies") > 1).select("copied", "first")
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    masks = rows.join(firsts, F.col("digest") == F.col("copied"), "left").select(
        "doc_id", "part", (F.col("own") + F.when(later, F.lit(16)).otherwise(0)).alias("mask")
    )
    flag = lambda name: F.max(F.when(F.col(name) == 1, 1).otherwise(0))
    marked = labels.groupBy(F.col("doc_id").cast("bigint").alias("labelled")).agg(
        flag("quality").alias("good"), flag("toxic").alias("toxic")
    )
    return masks.join(marked, F.col("doc_id") == F.col("labelled"), "left").select(
        "part",
        "mask",
        F.coalesce("good", F.lit(0)).alias("good"),
        F.coalesce("toxic", F.lit(0)).alias("toxic"),
    )


def coalition_values(masks: DataFrame, filters: int) -> DataFrame:
    """One row per part: total, single_i (rows failing filter i alone) and, for every coalition
    of filters, how many rows it removes: n_S, good_S, toxic_S with S as a bit set."""
    counts = masks.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("good").cast("bigint").alias("good"),
        F.sum("toxic").cast("bigint").alias("toxic"),
    )
    removed = [
        F.sum(
            F.when(F.col("mask").bitwiseAND(F.lit(s)) != 0, F.col(m)).otherwise(F.lit(0))
        ).alias(f"{m}_{s}")
        for s in range(1 << filters)
        for m in MEASURES
    ]
    alone = [
        F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)).alias(f"single_{i}")
        for i in range(filters)
    ]
    return counts.groupBy("part").agg(F.sum("n").alias("total"), *removed, *alone)


def with_potentials(values: DataFrame, filters: int) -> DataFrame:
    """``values`` with p_S, the potential of the removal game on coalition S times filters!.

    The potential of no filter is 0, and that of S is what S removes plus the potentials of S
    without each of its members, divided by its size. Times filters! all of them are whole
    numbers, so the division is exact.
    """
    whole = factorial(filters)
    values = values.withColumn("p_0", F.lit(0).cast("bigint"))
    for size in range(1, filters + 1):
        level = {}
        for s in range(1 << filters):
            if s.bit_count() == size:
                smaller = " + ".join(f"p_{s & ~(1 << i)}" for i in range(filters) if s >> i & 1)
                level[f"p_{s}"] = F.expr(f"({whole} * n_{s} + {smaller}) div {size}")
        values = values.withColumns(level)
    return values


def with_steps(parts: DataFrame, letters: Sequence[str]) -> DataFrame:
    """One row per row of ``parts``, order of the filters and step in it: filter_order, step,
    filter_index and the coalitions ``before`` and ``after`` the step."""
    orders = ",".join("".join(order) for order in permutations(letters))
    rows = parts.select(
        "*", F.explode(F.split(F.lit(orders), ",")).alias("filter_order")
    ).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))

    def coalition(last: Column) -> Column:
        bits = [
            F.when(F.instr("filter_order", c) <= last, F.lit(1 << i)).otherwise(0)
            for i, c in enumerate(letters)
        ]
        return sum(bits[1:], bits[0])

    current = F.substring(F.col("filter_order"), F.col("step"), F.lit(1))
    return rows.select(
        "*",
        (F.position(current, F.lit("".join(letters))) - 1).alias("filter_index"),
        coalition(F.col("step") - 1).alias("before"),
        coalition(F.col("step")).alias("after"),
    )


def interactions(masks: DataFrame, letters: Sequence[str] = LETTERS) -> DataFrame:
    """The audit table of rows with part, mask, good and toxic; bit i of mask is letters[i].

    Per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and
    shapley. The rows that a coalition removes do not depend on the order inside it, so a step
    is the difference of two coalitions; a filter's Shapley value, the mean of what it removes
    over all orders, is the potential of all filters less the potential without that filter.
    ``shapley`` is that value times the number of orders.

    One row per part and mask is shuffled, whatever the number of rows. Parts without rows do
    not come; steps that remove nothing come with zeros. No rows give no rows.
    """
    filters = len(letters)
    values = with_potentials(coalition_values(masks, filters), filters)
    everyone = (1 << filters) - 1

    def per_filter(column: str) -> Column:
        return F.array(*[F.col(column.format(i)) for i in range(filters)])

    shapley = F.array(
        *[F.col(f"p_{everyone}") - F.col(f"p_{everyone & ~(1 << i)}") for i in range(filters)]
    )
    fails = F.array(*[F.col(f"n_{1 << i}") for i in range(filters)])
    lost = [
        F.array(*[F.col(f"{m}_{s}") for s in range(1 << filters)]).alias(f"lost_{m}")
        for m in MEASURES
    ]
    wide = values.select(
        "part", "total", *lost, shapley.alias("shapleys"), fails.alias("fails"),
        per_filter("single_{}").alias("singles"),
    )
    rows = with_steps(wide, letters)

    def step_loss(measure: str) -> Column:
        found = F.col(f"lost_{measure}")
        return F.get(found, F.col("after")) - F.get(found, F.col("before"))

    return rows.select(
        "part",
        "filter_order",
        "step",
        F.get(F.array(*[F.lit(c) for c in letters]), F.col("filter_index")).alias("filter"),
        (F.col("total") - F.get("lost_n", F.col("after"))).alias("kept"),
        step_loss("n").alias("removed"),
        (F.get("fails", F.col("filter_index")) - step_loss("n")).alias("redundant"),
        F.get("singles", F.col("filter_index")).alias("unique_fails"),
        step_loss("good").alias("good_lost"),
        step_loss("toxic").alias("toxic_lost"),
        F.get("shapleys", F.col("filter_index")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interactions of the five filters on ``docs`` (doc_id, text, lang), per language.

    A null text is empty, a null language the part named by the empty string. A text fails E
    when a smaller doc_id has the same text, so rows that repeat an id do not fail for each
    other, and a null doc_id neither fails E nor makes another fail. ``labels`` (doc_id,
    quality, toxic) may repeat an id: one row with 1 is enough; ids without labels and null
    labels count as neither good nor toxic. Other columns are not read.
    """
    return interactions(failure_masks(docs, labels))


def op13(spark: SparkSession, folder: str) -> DataFrame:
    return audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


ORACLE = r"""
with texts as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents
),
smallest as (select t, min(doc_id) as first from texts group by t),
judged as (
  select x.part, x.doc_id,
         concat(
           case when len(w) < 100 then 'A' else '' end,
           case when 100 * len(list_distinct(w)) < 80 * len(w) then 'B' else '' end,
           case when 100 * length(regexp_replace(x.t, '[^A-Z]', '', 'g')) > 10 * length(x.t)
                then 'C' else '' end,
           case when regexp_matches(x.t, '[#$%&*|]') then 'D' else '' end,
           case when x.doc_id > s.first then 'E' else '' end) as fails
  from texts x join smallest s on s.t = x.t
),
marks as (
  select doc_id, max(case when quality = 1 then 1 else 0 end) as good,
         max(case when toxic = 1 then 1 else 0 end) as toxic
  from labels group by doc_id
),
grouped as (
  select part, fails, count(*) as n, sum(coalesce(good, 0)) as good,
         sum(coalesce(toxic, 0)) as toxic
  from judged left join marks using (doc_id) group by part, fails
),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (
  select concat(a.x, b.x, c.x, d.x, e.x) as o
  from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
),
steps as (
  select o, k, substr(o, k, 1) as f, substr(o, 1, k - 1) as earlier
  from orders, (select unnest([1, 2, 3, 4, 5]) as k)
),
met as (
  select part, o, k, f, n, good, toxic, fails,
         contains(fails, f) as failing,
         k > 1 and regexp_matches(fails, concat('[', earlier, '0]')) as gone
  from grouped, steps
),
summed as (
  select part, o, k, f,
         sum(case when not gone and not failing then n else 0 end) as kept,
         sum(case when not gone and failing then n else 0 end) as removed,
         sum(case when gone and failing then n else 0 end) as redundant,
         sum(case when fails = f then n else 0 end) as unique_fails,
         sum(case when not gone and failing then good else 0 end) as good_lost,
         sum(case when not gone and failing then toxic else 0 end) as toxic_lost
  from met group by part, o, k, f
)
select part, o as filter_order, cast(k as int) as step, f as filter, cast(kept as bigint) as kept,
       cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
       cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost,
       cast(toxic_lost as bigint) as toxic_lost,
       cast(sum(removed) over (partition by part, f) as bigint) as shapley
from summed
"""
