"""License notices: MinHash bands over overlapping windows, then exact containment."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.llm.common import let, table

SHINGLE = 5
CONTAINMENT = 0.8
# Notices with at most so many shingles are looked up by each text shingle alone.
SHORT = 2
# Longer ones: text windows of 4 shingles at every second place against template windows at
# every place. Inside a notice of five shingles and more a text window equals a template window
# (similarity 1); with four or three it shares at least 3 of 5. With 8 bands of one row a window
# of similarity s is found with probability 1 - (1 - s)^8: at least 0.999.
WINDOW = 4
BANDS = 8

# Standard notices of well-known licenses.
NOTICES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
        "International License.",
    ),
    "CC-BY-4.0": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International "
        "License.",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with "
        "or without fee is hereby granted",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case; none for null and blank texts."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+", " ")
    plain = F.btrim(plain)
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def _starts(size: Column, width: int, step: int = 1) -> Column:
    """0, step, 2 * step ... as long as ``width`` items from there are inside."""
    last = size - width
    none = F.array().cast("array<int>")
    return F.when(
        last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step))
    ).otherwise(none)


def _five(w: Column, i: Column) -> list[Column]:
    return [F.get(w, i + k) for k in range(SHINGLE)]


def shingle_hashes(w: Column) -> Column:
    return F.transform(_starts(F.size(w), SHINGLE), lambda i: F.xxhash64(*_five(w, i)))


def shingle_texts(w: Column) -> Column:
    return F.transform(_starts(F.size(w), SHINGLE), lambda i: F.concat_ws(" ", *_five(w, i)))


def masks() -> list[Column]:
    """The bands' hash functions: the order of hashes after flipping a fixed set of bits."""
    return [F.xxhash64(F.lit("license band"), F.lit(k)) for k in range(BANDS)]


def window_keys(hashes: Column, step: int) -> Column:
    """Band keys of all windows of WINDOW hashes that begin at multiples of ``step`` (1 or 2).

    Fewer hashes than a window are one window. With an even number of hashes and step 2 the last
    window ends with the last hash; with an odd number one more begins at the last but three.
    """

    def keys(h: Column) -> Column:
        size = F.size(h)
        whole = F.array(F.greatest(size - WINDOW, F.lit(0)))
        starts = F.array_distinct(F.concat(_starts(size, WINDOW, step), whole))

        def band(mask: Column) -> Column:
            flipped = F.transform(h, lambda x: x.bitwiseXOR(mask))
            return let(
                flipped,
                lambda f: F.transform(
                    starts, lambda i: F.least(F.get(f, i), *[
                        F.coalesce(F.get(f, i + k), F.get(f, i)) for k in range(1, WINDOW)
                    ])
                ),
            )

        found = F.concat(*[band(m) for m in masks()])
        return F.when(size > 0, found).otherwise(F.array().cast("array<bigint>"))

    return let(hashes, keys)


def template_rows(
    spark: SparkSession, notices: Mapping[str, tuple[str, ...]] = NOTICES
) -> list[tuple[str, list[str], list[int]]]:
    """(license, distinct shingles, keys) of each notice, all computed by Spark.

    The list is as long as the notices are, whatever is scanned. Notices of fewer than five
    words have no shingle and are refused.
    """
    pairs = [(name, text) for name, texts in notices.items() for text in texts]
    w = tokens(F.col("text"))
    hashes = let(w, shingle_hashes)
    keys = F.when(F.size(hashes) <= SHORT, hashes).otherwise(window_keys(hashes, 1))
    rows = spark.createDataFrame(pairs, "license string, text string").select(
        "license", F.array_distinct(let(w, shingle_texts)).alias("shingles"), keys.alias("keys")
    )
    found = [(r["license"], list(r["shingles"]), list(set(r["keys"]))) for r in rows.collect()]
    if any(not shingles for _, shingles, _ in found):
        raise ValueError(f"a notice needs at least {SHINGLE} words")
    return found


def _literal(templates: list[tuple[str, list[str], list[int]]]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("license"),
                F.array(*[F.lit(s) for s in shingles]).alias("shingles"),
                F.array(*[F.lit(k).cast("bigint") for k in keys]).alias("keys"),
            )
            for name, shingles, keys in templates
        ]
    )


def retrieved(text: Column, templates: list[tuple[str, list[str], list[int]]]) -> Column:
    """Templates that share a band key with some window of ``text``."""
    every = F.array(*[F.lit(k).cast("bigint") for k in sorted({k for t in templates for k in t[2]})])

    def matching(keys: Column) -> Column:
        near = F.filter(_literal(templates), lambda t: F.arrays_overlap(t["keys"], keys))
        return F.when(F.size(keys) > 0, near)

    def found(h: Column) -> Column:
        keys = F.concat(h, window_keys(h, 2))
        return let(F.array_intersect(keys, every), matching)

    return let(let(tokens(text), shingle_hashes), found)


def best_window(shingles: Column, wanted: Column) -> Column:
    """Largest share of ``wanted`` in a stretch of as many text shingles, and where it begins."""
    size = F.size(wanted)

    def shares(s: Column) -> Column:
        places = F.filter(
            F.transform(s, lambda x, i: F.when(F.array_contains(wanted, x), i)),
            lambda i: i.isNotNull(),
        )
        return F.transform(
            places,
            lambda i: F.struct(
                (F.size(F.array_intersect(F.slice(s, i + 1, size), wanted)) / size).alias("share"),
                (-i).alias("place"),
            ),
        )

    return F.array_max(let(shingles, shares))


def scan(
    docs: DataFrame,
    notices: Mapping[str, tuple[str, ...]] = NOTICES,
    containment: float = CONTAINMENT,
) -> DataFrame:
    """doc_id, license, containment, word: one row per text and license that it carries.

    Texts are compared as lower-case runs of letters and digits in shingles of five. A license
    is carried if, for one of its notices with n different shingles, some n adjacent text
    shingles hold at least ``containment`` of them; the largest share over its notices and the
    first word of the first such stretch are returned.

    Null, empty and short texts carry nothing. Equal rows (doc_id and text) count as one. A null
    doc_id stays null; no rows give no rows. Other columns are not read.
    """
    templates = template_rows(docs.sparkSession, notices)
    # The outer form: for the inner one Spark adds a filter that computes the array again.
    candidates = docs.select(
        F.col("doc_id").cast("bigint"),
        F.xxhash64("text").alias("mark"),
        "text",
        F.explode_outer(retrieved(F.col("text"), templates)).alias("t"),
    ).where(F.col("t").isNotNull())
    best = best_window(let(tokens(F.col("text")), shingle_texts), F.col("t.shingles"))
    verified = candidates.select("doc_id", "mark", F.col("t.license").alias("license"),
                                 best.alias("best"))
    rows = verified.groupBy("doc_id", "mark", "license").agg(F.max("best").alias("best"))
    return rows.where(F.col("best.share") >= containment).select(
        "doc_id",
        "license",
        F.col("best.share").alias("containment"),
        (-F.col("best.place")).alias("word"),
    )


def oracle(notices: Mapping[str, tuple[str, ...]] = NOTICES) -> str:
    """The same by exact comparison of all shingles, as SQL."""
    quoted = ", ".join(
        "('{}', '{}')".format(name, text.replace("'", "''"))
        for name, texts in notices.items()
        for text in texts
    )
    words = "string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ')"
    shingled = (
        "list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))"
    )
    return f"""with notices as (
         select license, row_number() over () as notice, {words} as w
         from (values {quoted}) v(license, text)),
       wanted as (
         select license, notice, list_distinct({shingled}) as s from notices),
       parts as (select license, notice, len(s) as n, unnest(s) as shingle from wanted),
       texts as (select distinct doc_id, text from documents where text is not null),
       listed as (select doc_id, text, {words} as w from texts),
       placed as (
         select doc_id, text, unnest({shingled}) as shingle,
                unnest(range(0, len(w) - 4)) as place
         from listed where len(w) > 4),
       hits as (select doc_id, text, place, license, notice, n, shingle
                from placed join parts using (shingle)),
       shares as (
         select a.doc_id, a.text, a.license, a.notice, a.place,
                count(distinct b.shingle) / a.n as share
         from hits a join hits b on a.doc_id is not distinct from b.doc_id and a.text = b.text
           and a.notice = b.notice and b.place between a.place and a.place + a.n - 1
         group by a.doc_id, a.text, a.license, a.notice, a.place, a.n),
       best as (
         select *, row_number() over (partition by doc_id, text, license
           order by share desc, place) as rank
         from shares)
       select doc_id, license, share as containment, cast(place as int) as word
       from best where rank = 1 and share >= {CONTAINMENT}"""


def op2(spark: SparkSession, folder: str) -> DataFrame:
    return scan(table(spark, folder, "documents"))
