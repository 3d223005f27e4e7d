"""Sharded Lloyd rounds against plain Python integers, and their edges."""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from gradelake.llm import centroids

FOLDER = "/root/testdata/sf0.001"


def plain(rows, clusters=40, rounds=5, dimensions=64):
    kept = [
        (i, [math.floor(Fraction(x) * 256) for x in v], v)
        for i, v in rows
        if v is not None and len(v) == dimensions
        and all(x is not None and math.isfinite(x) for x in v)
    ]
    order = sorted(
        kept,
        key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[2]),
    )
    centres = [r[1] for r in order[:clusters]]

    def assign():
        found = []
        for _, v, _ in kept:
            gaps = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centres]
            best = min(range(len(centres)), key=lambda k: (gaps[k], k))
            found.append((best, gaps[best]))
        return found

    for _ in range(rounds):
        labels = assign()
        for k in range(len(centres)):
            mine = [v for (_, v, _), (label, _) in zip(kept, labels, strict=True) if label == k]
            if mine:
                centres[k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    labels = assign()
    inertia = [sum(d for label, d in labels if label == k) for k in range(len(centres))]
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    top = (1 << 63) - 1
    return sorted(
        [
            (i, k, min(d, top), min(inertia[k], top), min(sum(inertia), top), marks[k])
            for (i, _, _), (k, d) in zip(kept, labels, strict=True)
        ],
        key=repr,
    )


def found(frame):
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted([tuple(r[n] for n in names) for r in frame.collect()], key=repr)


def test_table(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    result = found(centroids.op11(spark, FOLDER))
    assert result == plain([(r["vec_id"], r["embedding"]) for r in rows])


@pytest.fixture(scope="module")
def odd():
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    rows += [(1, rows[1][1]), (1, [0.5] * 4), (None, [0.25] * 4), (None, None), (70, None)]
    rows += [(71, []), (72, [1.0] * 3), (73, [1.0, None, 0.0, 0.0]), (74, [math.nan] * 4)]
    rows += [(75, [math.inf, 0.0, 0.0, 0.0]), (76, [0.0] * 4), (77, [-1e-9] * 4)]
    rows += [(80 + i, [0.0] * 4) for i in range(30)]
    return rows


SCHEMA = "vec_id long, embedding array<double>, block long, shard int, cell string, label int"


@pytest.mark.parametrize("shards, rows", [(1, 2048), (3, 7), (4, 1)])
def test_odd_vectors(spark, odd, shards, rows):
    frame = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in odd], SCHEMA)
    result = centroids.cluster(frame, 4, 6, block_columns=shards, block_rows=rows)
    assert found(result) == plain(odd, 6, dimensions=4)


def test_huge_components(spark):
    rows = [(i, [1e300 * i, -1e18, float(i), 2.0**60]) for i in range(8)]
    rows += [(20 + i, [70000.0 * i, 0.0, -3.0, 1e5]) for i in range(9)]
    frame = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], SCHEMA)
    result = centroids.cluster(frame, 4, 3, block_columns=2, block_rows=5)
    assert found(result) == plain(rows, 3, dimensions=4)


def test_few_and_none(spark, odd):
    frame = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in odd], SCHEMA)
    few = frame.where("vec_id < 3 and vec_id <> 1")
    assert found(centroids.cluster(few, 4, 40)) == plain(
        [r for r in odd if r[0] in (0, 2)], 40, dimensions=4
    )
    none = centroids.cluster(frame.where("vec_id = 70"), 4)
    assert none.count() == 0
    assert none.columns == centroids.cluster(few, 4).columns


def test_whole_numbers():
    for x in (0.1, -0.1, 1e300, -1e300, 2.0**52 + 1, 1e15 + 0.5, 5e-324, -5e-324):
        assert centroids.to_whole(x) == math.floor(Fraction(x) * 256)
