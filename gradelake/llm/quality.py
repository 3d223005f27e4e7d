"""Quality rules: counted signals, and a likelihood ratio of hashed n-grams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.llm.common import WORD, let, table, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
REPEAT_WINDOW = 3

# Buckets that word unigrams and bigrams are hashed into.
BUCKETS = 10_000
# Labelled rows of the trusted target that are used at most: those with the smallest hashed id.
TRUSTED_ROWS = 20_000
# A document is kept if its mean log-likelihood ratio per n-gram (natural log) is at least this.
THRESHOLD = -0.1
SMOOTHING = 1.0


def grams(w: Column, buckets: int = BUCKETS) -> Column:
    """Bucket of every word and of every two adjacent words, repeats included."""

    def bucket(*parts: Column) -> Column:
        return F.pmod(F.xxhash64(*parts), F.lit(buckets)).cast("int")

    pairs = F.transform(_places(w, 2), lambda i: bucket(F.get(w, i), F.get(w, i + 1)))
    return F.concat(F.transform(w, lambda x: bucket(x)), pairs)


def _places(tokens: Column, width: int) -> Column:
    """Start of every window of ``width`` words."""
    none = F.array().cast("array<int>")
    last = F.size(tokens) - width
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(none)


def trusted_ids(labels: DataFrame, rows: int = TRUSTED_ROWS) -> DataFrame:
    """Ids of at most ``rows`` documents labelled as good, each once."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull())
    ids = good.select(F.col("doc_id").alias("trusted_id")).distinct()
    return ids.orderBy(F.xxhash64(F.lit("trusted"), "trusted_id"), "trusted_id").limit(rows)


def bucket_weights(
    docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING
) -> np.ndarray:
    """log p_target(bucket) - log p_raw(bucket), both multinomials smoothed by ``smoothing``.

    The raw corpus is all of ``docs``, the target its rows with a trusted id. Those ids are
    bounded (``TRUSTED_ROWS``), so they are broadcast and no text is shuffled; counts are
    summed per task first, and ``buckets`` rows reach the driver.
    """
    marked = docs.select(F.col("doc_id").alias("raw_id"), "text").join(
        F.broadcast(trusted), F.col("raw_id") == F.col("trusted_id"), "left"
    )
    # The outer form: for the inner one Spark adds a filter that computes the array again.
    found = F.explode_outer(let(words(F.col("text")), lambda w: grams(w, buckets)))
    exploded = marked.select(
        F.col("trusted_id").isNotNull().cast("bigint").alias("good"), found.alias("bucket")
    ).where(F.col("bucket").isNotNull())
    counts = exploded.groupBy("bucket").agg(F.count(F.lit(1)), F.sum("good"))
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for bucket, n, good in counts.collect():
        raw[bucket], target[bucket] = n, good
    if not target.sum():
        return np.zeros(buckets)
    raw, target = raw + smoothing, target + smoothing
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def repeated_words(w: Column) -> Column:
    """Words of ``w`` inside 3-word windows found twice or more, the first one included.

    Windows are compared by a 64-bit hash within their document, and equal hashes by their
    words. Only documents with a repeated hash are sorted. Every step is one pass or one sort
    over a document's own words.
    """

    def hits(r: Column) -> Column:
        def same(x: Column, y: Column) -> Column:
            windows = [F.slice(w, z["i"] + 1, REPEAT_WINDOW) for z in (x, y)]
            return F.coalesce((x["h"] == y["h"]) & (windows[0] == windows[1]), F.lit(False))

        found = F.filter(r, lambda x, k: same(x, F.get(r, k + 1)) | same(x, F.get(r, k - 1)))
        return F.array_sort(F.transform(found, lambda x: x["i"]))

    def covered(places: Column) -> Column:
        step = F.transform(
            places,
            lambda x, k: F.least(
                F.lit(REPEAT_WINDOW),
                F.coalesce(F.get(places, k + 1) - x, F.lit(REPEAT_WINDOW)),
            ),
        )
        return F.aggregate(step, F.lit(0).cast("bigint"), lambda s, x: s + x)

    def counted(h: Column) -> Column:
        placed = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        repeats = F.size(F.array_distinct(h)) < F.size(h)
        none = F.lit(0).cast("bigint")
        return F.when(
            repeats, let(let(F.sort_array(placed), hits), covered)
        ).otherwise(none)

    hashes = F.transform(
        _places(w, REPEAT_WINDOW),
        lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
    )
    return let(hashes, counted)


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(WORD)))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))


def mean_ratio(w: Column, weights: np.ndarray) -> Column:
    """Mean weight of the n-grams of ``w``; 0 without any."""
    ratio = F.lit(np.asarray(weights, float))

    def mean(features: Column) -> Column:
        total = F.aggregate(features, F.lit(0.0), lambda s, b: s + F.get(ratio, b))
        return F.when(F.size(features) > 0, total / F.size(features)).otherwise(0.0)

    return let(grams(w, len(weights)), mean)


def signals(text: Column, weights: np.ndarray) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score,
    base_failed and kept of a text.

    A null text is an empty one. Texts without a word have score 0 and fail the base rules.
    """
    text = F.coalesce(text, F.lit(""))
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))

    def measured(w: Column) -> Column:
        chars = F.aggregate(w, F.lit(0).cast("bigint"), lambda s, x: s + F.length(x))
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            chars.alias("word_chars"),
            symbols.cast("bigint").alias("n_symbols"),
            repeated_lines(text).alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
            mean_ratio(w, weights).alias("score"),
        )

    def judged(m: Column) -> Column:
        failed = (m["n_words"] < MIN_WORDS) | (
            100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"]
        )
        names = [
            "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"
        ]
        return F.struct(
            *[m[n].alias(n) for n in names],
            failed.alias("base_failed"),
            (~failed & (m["score"] >= THRESHOLD)).alias("kept"),
        )

    return let(let(words(text), measured), judged)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Signals and verdict of every row of ``docs``; repeated rows are judged alike.

    Without a trusted document every ratio is 0 and the base rules alone decide. No rows give
    no rows. Columns of ``docs`` other than doc_id and text are not read.
    """
    weights = bucket_weights(docs, trusted_ids(labels))
    return docs.select("doc_id", signals(F.col("text"), weights).alias("judged")).select(
        "doc_id", "judged.*"
    )


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, that are kept."""
    weights = bucket_weights(docs, trusted_ids(labels))
    return docs.where(signals(docs["text"], weights)["kept"])


def op1(spark: SparkSession, folder: str) -> DataFrame:
    return judge(table(spark, folder, "documents"), table(spark, folder, "labels"))
