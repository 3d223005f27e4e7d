"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gradelake.llm import (
    components, embeddings, html, language, licenses, lm, mixing, packing, quality, simhash, tokens,
)

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, "
    "kept boolean, fp long, u double, size long, language string, plan_source string, "
    "block long, word string, kept_id long"
)
EXTRA = (None, True, 3, 0.5, 7, "x", "y", 1, "w", 2)


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, *EXTRA) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    good = "the quick brown fox jumps over the lazy dog again and again until evening comes. "
    rows = [
        (1, None, "en", "a"),
        (2, "", "en", "a"),
        (3, " \t\n", None, None),
        (4, good * 4000, "en", "b"),
        (5, "12 34 !!", "en", None),
        (6, good, "en", "b"),
        (6, good, "en", "b"),
        (7, good, None, "a"),
        (None, good, "en", "b"),
        (None, None, None, None),
    ]
    rows += [(10 + i, f"un deux trois quatre {i} cinq six sept", "fr", "c") for i in range(20)]
    rows += [(40 + i, f"they went {i} over the hill and then home", "en", "d") for i in range(9)]
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, [(0, "", "", "")]).where("doc_id > 0")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(4, 1, 0), (4, 1, 0), (None, 1, 0), (6, None, None)], "doc_id long, quality int, toxic int"
    )


def named(rows, key="doc_id"):
    return {r[key]: r for r in rows if r[key] is not None}


def test_quality(odd, nothing, labels):
    rows = quality.judge(odd, labels).collect()
    assert len(rows) == odd.count()
    by_id = named(rows)
    for i in (1, 2, 3):
        assert (by_id[i]["n_words"], by_id[i]["score"]) == (0, 0.0)
        assert by_id[i]["base_failed"] and not by_id[i]["kept"]
    assert by_id[4]["n_repeat_words"] == by_id[4]["n_words"] == 60_000
    assert quality.judge(nothing, labels).count() == 0
    assert quality.judge(odd, labels.where("quality > 1")).count() == len(rows)
    assert quality.drop_low_quality(odd, labels).columns == odd.columns


def test_licenses(spark, odd, nothing):
    assert licenses.scan(odd).count() == 0
    assert licenses.scan(nothing).count() == 0
    notice = "x Released under the MIT License."
    carried = frame(spark, [(1, notice, "", ""), (1, notice, "", ""), (None, notice, "", "")])
    found = [tuple(r) for r in licenses.scan(carried).collect()]
    assert sorted(found, key=str) == [(1, "MIT", 1.0, 1), (None, "MIT", 1.0, 1)]
    with pytest.raises(ValueError):
        licenses.template_rows(spark, {"x": ("too short",)})


def test_html(spark):
    article = "<article><h1>Head &amp; line</h1><p>One  two.<br>Three</p><p>Four, five.</article>"
    clutter = [
        "<nav><a href=x>Home</a></nav>", "<header><p>Site name, motto.</p></header>",
        "<aside><p>Read more, and more.</p></aside>", "<footer><p>&copy; someone.</p></footer>",
        '<div class="cookie-notice"><p>We use cookies, yes.</p></div>',
        '<div id="sidebar"><p>Old posts, new posts.</p></div>', '<div class="ad">Buy.</div>',
        "<form><label>Name</label><input><button>Go</button></form>",
        '<section class="comments"><article><p>Nice text, thanks!</p></article></section>',
        "<script>var a = '<p>no</p>';</script>", "<style>p{}</style>", "<!-- <p>no</p> -->",
    ]
    rows = [(1, None), (2, ""), (3, "<p"), (4, "a < b <b>c</b>"), (5, "<div>" * 3000 + "deep"),
            (6, "<p>Plain text without any frame, but it is prose all the same.</p>" * 3)]
    for k in range(len(clutter) + 1):
        rows.append((10 + k, "<body>" + "".join(clutter[:k]) + article + "".join(clutter[k:])))
    rows.append((10, rows[-1][1]))
    pages = spark.createDataFrame(
        [(i, None, h, "t", 1) for i, h in rows],
        "page_id long, url string, html string, text string, n_chars int",
    )
    found = html.extracted(pages).collect()
    assert len(found) == len(rows)
    by_id = named(found, "page_id")
    assert [by_id[i]["text"] for i in (1, 2, 3)] == ["", "", ""]
    assert by_id[6]["text"].count("\n") == 2
    for k in range(len(clutter) + 1):
        assert by_id[10 + k]["text"] == "Head & line\nOne two. Three\nFour, five."
    assert html.extracted(pages.where("page_id < 0")).count() == 0


def test_language(odd, nothing):
    rows = language.identify(odd).collect()
    assert len(rows) == odd.count()
    by_id = named(rows)
    for i in (1, 2, 3, 5):
        assert (by_id[i]["lang_pred"], by_id[i]["score"]) == ("und", 0.0)
    assert by_id[4]["lang_pred"] == "en" and by_id[12]["lang_pred"] == "fr"
    assert language.identify(nothing).count() == 0
    untaught = language.identify(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in untaught.collect()} == {"und"}
    assert language.keep_known_language(odd).columns == odd.columns
    assert all(not r["held_out"] for r in rows if r["doc_id"] is None)


def test_simhash(odd, nothing):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by_id = named(rows)
    assert {by_id[i]["component_id"] for i in (1, 2, 3)} == {1}
    assert by_id[2]["fingerprint"] == "0" * 16
    assert by_id[7]["component_id"] == by_id[6]["component_id"]
    assert simhash.near_duplicates(nothing).count() == 0
    left = simhash.drop_near_duplicates(odd)
    assert left.columns == odd.columns
    kept = [r["doc_id"] for r in left.collect()]
    assert kept.count(6) <= 1 and kept.count(1) == 1 and 2 not in kept


def test_components(spark):
    draw = np.random.default_rng(1)
    path = [(i, i + 1) for i in draw.permutation(300).tolist()]
    hub = [(1000, 1000 + i) for i in range(400)]
    edges = [*path, *hub, (5, 5), (None, 3), (1000, 1001)]
    found = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    roots = {r["node"]: r["root"] for r in found}
    assert roots == {**{i: 0 for i in range(1, 301)}, **{1000 + i: 1000 for i in range(1, 400)}}
    none = spark.createDataFrame([(1, 1)], "a long, b long")
    assert components.components(none).count() == 0


def test_mixing(odd, nothing):
    rows = mixing.mix_report(odd).collect()
    assert len(rows) == odd.count()
    by_id = named(rows)
    assert by_id[1]["size"] == by_id[1]["taken"] == 0
    assert by_id[3]["source_size"] == 3  # the null source: "12 34 !!"
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    assert len({r["taken"] for r in rows if r["doc_id"] == 6}) == 1
    assert mixing.mix_report(nothing).count() == 0
    assert mixing.mix(odd).columns == odd.columns


def test_targets():
    assert mixing.shares([10, 10, 10], [1, 2, 3]) == pytest.approx([5, 10, 15])
    assert mixing.shares([100, 1, 0], [1, 2, 3]) == pytest.approx([98, 3, 0])
    assert mixing.shares([], []) == [] and mixing.shares([0], [1]) == [0]


def test_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]),
        (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (10, [1e308, 1e300]),
        (None, [0.0, 1.0]), (2, [2.0, 0.0]), (11, [-1.0, 0.0]),
    ]
    frame = spark.createDataFrame(
        [(i, v, "l", 1, 2) for i, v in rows],
        "vec_id long, embedding array<double>, label string, node int, key int",
    )
    found = embeddings.near_duplicates(frame).collect()
    assert len(found) == len(rows)
    by_id = named(found, "vec_id")
    for i in (1, 2, 10):
        assert (by_id[i]["n_links"], by_id[i]["component_id"]) == (3, 1)
    for i in (3, 4, 5, 6, 7, 8, 9, 11):
        assert (by_id[i]["n_links"], by_id[i]["component_id"], by_id[i]["kept"]) == (0, i, True)
    assert embeddings.near_duplicates(frame.where("vec_id < 0")).count() == 0


def test_tokens(odd, nothing):
    rows = tokens.counted(odd).collect()
    assert len(rows) == odd.count()
    by_id = named(rows)
    assert (by_id[1]["n_bytes"], by_id[1]["n_tokens"], by_id[1]["over_limit"]) == (0, 0, False)
    chunked = named(tokens.counted(odd, chunk=100).collect())
    assert {i: r["n_tokens"] for i, r in chunked.items()} == {
        i: r["n_tokens"] for i, r in by_id.items()
    }
    assert tokens.counted(nothing).count() == 0


def test_scores(odd, nothing):
    rows = lm.score(odd, block_bytes=1 << 12).collect()
    assert len(rows) == odd.count()
    by_id = named(rows)
    for i in (1, 2, 3):
        assert by_id[i]["n_tokens"] == 1 and by_id[i]["score"] < 0
    one = named(lm.score(odd).collect())
    for i, r in by_id.items():
        assert one[i]["base_score"] == pytest.approx(r["base_score"])
        assert one[i]["score"] == pytest.approx(r["score"], rel=1e-3)
    assert all(not r["held_out"] for r in rows if r["doc_id"] is None)
    assert lm.score(nothing).count() == 0


def test_packing(odd, nothing):
    rows = packing.pack(odd).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 1) == 1
    assert sum(r["piece"] == 0 for r in rows) == odd.count()
    places = {(r["sequence_id"], r["offset"]) for r in rows}
    assert len(places) == len(rows)
    assert packing.pack(nothing).count() == 0
    sharded = packing.pack(odd, shard_pieces=4).collect()
    key = ["piece", "start", "length", "ids_crc32"]
    assert sorted([r[k] for k in key] for r in sharded) == sorted([r[k] for k in key] for r in rows)


def test_pipeline(spark, odd, nothing, labels, tmp_path):
    for name, docs in (("odd", odd), ("nothing", nothing)):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        found = corpus_pipeline.run(spark, folder)
        assert found.columns[:3] == ["doc_id", "piece", "start"]
        found.collect()
