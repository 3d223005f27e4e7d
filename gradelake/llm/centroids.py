"""Centroid clustering of vectors by Lloyd rounds sharded over dimensions."""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.llm.common import settled, table

DIMENSIONS = 64
CLUSTERS = 40
ROUNDS = 5
SEED = 2
SCALE = 256
# Columns of a shard and vectors of a row block: a cell of the two is what a task works on.
BLOCK_COLUMNS = 16
BLOCK_ROWS = 2048
# Whole numbers up to this size keep squares and sums of a cell exact in 64 bits; larger ones
# are worked on as Python integers.
SMALL = 1 << 24
LARGEST = (1 << 63) - 1


def to_whole(value: float) -> int:
    """floor(SCALE * value), exact for every finite double."""
    if abs(value) >= 1 << 53:  # a whole number already
        return int(value) * SCALE
    return math.floor(value * SCALE)


def compact(matrix: np.ndarray) -> np.ndarray:
    """The same whole numbers in the narrowest type that holds them."""
    if matrix.size == 0:
        return matrix.astype(np.int16)
    low, high = matrix.min(), matrix.max()
    for kind in (np.int16, np.int32, np.int64):
        if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max:
            return matrix.astype(kind)
    return matrix.astype(object)


def exact(matrix: np.ndarray) -> np.ndarray:
    """The same whole numbers in a type whose squares and sums cannot overflow."""
    wide = matrix.size and max(-int(matrix.min()), int(matrix.max())) > SMALL
    return matrix.astype(object if wide else np.int64)


def whole_rows(column: pa.Array) -> np.ndarray:
    values = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    scaled = np.floor(values * SCALE)
    if np.abs(scaled).max(initial=0) < 1 << 53:
        return scaled.astype(np.int64)
    return np.array([[to_whole(v) for v in row] for row in values.tolist()], object)


def usable(vector: Column, dimensions: int) -> Column:
    """Exactly so many components, none null and all finite."""
    # F.abs(v) < inf is false for NaN as well: Spark orders NaN above infinity.
    finite = F.forall(vector, lambda v: v.isNotNull() & (F.abs(v) < F.lit(math.inf)))
    return F.coalesce((F.size(vector) == dimensions) & finite, F.lit(False))


def cells(kept: DataFrame, columns: int, rows: int) -> DataFrame:
    """(block, shard, cell) of every row block and column shard; shard -1 holds the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start in range(0, len(batch), rows):
                part = batch.slice(start, rows)
                matrix = whole_rows(part.column(1))
                ids = part.column(0).to_pylist()
                found = [(-1, pickle.dumps(ids))]
                for shard in range(-(-matrix.shape[1] // columns)):
                    piece = matrix[:, shard * columns : (shard + 1) * columns]
                    found.append((shard, pickle.dumps(compact(piece))))
                shards, packed = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block] * len(shards), pa.int64()),
                        pa.array(shards, pa.int32()),
                        pa.array(packed, pa.binary()),
                    ],
                    names=["block", "shard", "cell"],
                )
                block += 1

    return kept.mapInArrow(run, "block long, shard int, cell binary")


def first_centroids(kept: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors with the smallest hash of their id; as many rows as clusters reach the driver."""
    text = F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string"))
    chosen = kept.select(F.sha2(text, 256).alias("hash"), "vector").orderBy(
        F.col("hash").asc_nulls_last(), "vector"
    )
    rows = [[to_whole(v) for v in r["vector"]] for r in chosen.limit(clusters).collect()]
    return compact(np.array(rows, object))


def partial_distances(cell: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances over the columns of one shard: rows x centroids."""
    points, centres = exact(cell), exact(centroids)
    found = np.empty((len(points), len(centres)), np.result_type(points, centres))
    for k, centre in enumerate(centres):
        gap = points - centre
        found[:, k] = (gap * gap).sum(axis=1)
    return found


def nearest(distances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid, the smaller one of equals, and the distance to it."""
    labels = distances.argmin(axis=1)
    return compact(labels), compact(distances[np.arange(len(labels)), labels])


def member_sums(cell: np.ndarray, labels: np.ndarray, clusters: int) -> tuple:
    """Per centroid the sum of its vectors over the columns of a shard, and their number."""
    points = exact(cell)
    sums = np.zeros((clusters, points.shape[1]), points.dtype)
    np.add.at(sums, labels, points)
    return sums.astype(object), np.bincount(labels, minlength=clusters).astype(object)


def moved(centroids: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A shard's slice of the centroids after a round; empty ones stay."""
    found = centroids.astype(object)
    filled = np.flatnonzero(counts > 0)
    found[filled] = sums[filled] // counts[filled, None]
    return compact(found)


class Sharded:
    """The cells of a table of vectors, dealt once over the tasks that work on them."""

    def __init__(self, stored: DataFrame, partitions: int):
        self.partitions = partitions
        rows = stored.where("shard >= 0").select("block", "shard", "cell").rdd
        # Dealt by (block, shard): a task works on a few columns of a few rows.
        self.cells: RDD = rows.map(
            lambda r: ((r["block"], r["shard"]), bytes(r["cell"]))
        ).partitionBy(partitions)

    def assign(self, slices: list[np.ndarray]) -> RDD:
        """block -> (label, distance) of its vectors, from partial distances of every shard."""
        # A shard's task reads its own slice of the centroids; all of them are one small constant.

        def partial(item):
            (block, shard), cell = item
            return block, compact(partial_distances(pickle.loads(cell), slices[shard]))

        def add(a, b):
            return compact(widened(a) + widened(b))

        return self.cells.map(partial).reduceByKey(add, self.partitions).mapValues(nearest)

    def update(self, slices: list[np.ndarray], assigned: RDD) -> list[np.ndarray]:
        """Every shard moves its own slice; clusters x columns numbers of each come back."""
        shards, clusters = len(slices), len(slices[0])
        labels = assigned.flatMap(
            lambda item: [((item[0], s), item[1][0]) for s in range(shards)]
        )
        # Cells lie where the labels are sent to: they are not moved again.
        met = self.cells.join(labels, self.partitions)

        def sums(item):
            (_, shard), (cell, label) = item
            return shard, member_sums(pickle.loads(cell), label, clusters)

        def add(a, b):
            return a[0] + b[0], a[1] + b[1]

        totals = met.map(sums).reduceByKey(add, min(shards, self.partitions))
        fresh = totals.map(lambda item: (item[0], moved(slices[item[0]], *item[1]))).collectAsMap()
        return [fresh.get(s, slices[s]) for s in range(shards)]


def widened(matrix: np.ndarray) -> np.ndarray:
    """``matrix`` in a type that holds the sum of two such matrices."""
    if matrix.dtype == object or matrix.dtype != np.int64:
        return matrix.astype(object if matrix.dtype == object else np.int64)
    return matrix.astype(object) if matrix.max(initial=0) > LARGEST >> 1 else matrix


def cluster(
    vectors: DataFrame,
    dimensions: int = DIMENSIONS,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    seed: int = SEED,
    block_columns: int = BLOCK_COLUMNS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per usable vector: vec_id, cluster, distance, cluster_inertia, inertia and
    centroid_sha256.

    A vector is usable with exactly ``dimensions`` components, none null and all finite; others
    do not come back. Components become floor(256 * x), and everything after that is exact.
    Centroids start as the vectors whose ids have the smallest hashes. In each round the columns
    are worked on in shards: the tasks of a shard add up squared differences to its slice of the
    centroids, the shards' partial distances are summed by row block, the nearest centroid (of
    equal ones the smaller number) is sent back to the shards, and each shard moves its own slice
    to floor(sum / count). Rows travel in blocks of ``block_rows``, so no group grows with the
    data; the driver holds ``clusters`` x ``dimensions`` numbers.

    Repeated rows count as often as they come; of equal ids the smaller vector is the earlier
    centroid. A null vec_id comes last among first centroids. Fewer vectors than clusters make
    fewer clusters, no vectors no rows. Sums of squares that no long can hold come back as the
    largest long. Other columns are not read.
    """
    spark = vectors.sparkSession
    vector = F.col("embedding").cast("array<double>")
    kept = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), vector.alias("vector"))
    kept = kept.where(usable(F.col("vector"), dimensions))
    stored = settled(cells(kept, block_columns, block_rows), "cells")
    start = first_centroids(kept, clusters, seed)
    schema = (
        "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, "
        "centroid_sha256 string"
    )
    if not len(start):
        return spark.createDataFrame([], schema)
    slices = [start[:, at : at + block_columns] for at in range(0, dimensions, block_columns)]
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sharded = Sharded(stored, max(1, min(wanted, stored.count())))
    for _ in range(rounds):
        slices = sharded.update(slices, sharded.assign(slices))
    assigned = sharded.assign(slices).map(
        lambda item: (item[0], pickle.dumps(item[1][0]), pickle.dumps(item[1][1]))
    )
    labels = settled(
        spark.createDataFrame(assigned, "block long, label binary, distance binary"), "labels"
    )
    inertias = _inertias(labels)
    total = min(sum(inertias.values()), LARGEST)
    centroids = np.concatenate([s.astype(object) for s in slices], axis=1)
    marks = [
        hashlib.sha256(",".join(str(v) for v in row).encode()).hexdigest()
        for row in centroids.tolist()
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                ids, label, distance = [pickle.loads(p) for p in packed]
                label = label.tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array(label, pa.int32()),
                        pa.array([min(d, LARGEST) for d in distance.tolist()], pa.int64()),
                        pa.array([min(inertias[k], LARGEST) for k in label], pa.int64()),
                        pa.array([total] * len(ids), pa.int64()),
                        pa.array([marks[k] for k in label], pa.string()),
                    ],
                    names=[field.split()[0] for field in schema.split(", ")],
                )

    ids = stored.where("shard = -1").select("block", F.col("cell").alias("ids"))
    return ids.join(labels, "block").select("ids", "label", "distance").mapInArrow(run, schema)


def _inertias(labels: DataFrame) -> dict[int, int]:
    """Sum of distances per cluster."""

    def sums(row):
        label, distance = pickle.loads(row["label"]), pickle.loads(row["distance"])
        for k in np.unique(label).tolist():
            yield k, int(distance[label == k].astype(object).sum())

    return labels.rdd.flatMap(sums).reduceByKey(int.__add__).collectAsMap()


def op11(spark: SparkSession, folder: str) -> DataFrame:
    return cluster(table(spark, folder, "embeddings"))
