"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.llm.common import settled


def _state(edges: DataFrame) -> tuple[int, int]:
    """Row count and order-free checksum; two equal edge sets have equal ones."""
    mark = F.sum(F.xxhash64("big", "small").cast("decimal(38,0)"))
    row = edges.agg(F.count(F.lit(1)), mark).first()
    return row[0], int(row[1] or 0)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (``a``, ``b``: bigint) but the roots themselves.

    A root is the smallest node of its component. Large-star and small-star steps alternate:
    every node is tied to the smallest neighbour it has heard of, until nothing changes, which
    takes a number of rounds that grows with the logarithm of the longest path. Minima are
    pre-aggregated before they are shuffled, and a busy node is met only in joins, which AQE
    splits. Each round is written to the shared folder, so a lost executor costs one round.

    Loops (a = b), repeated edges and nulls are ignored; no edges give no rows.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = edges.where(F.col("a") != F.col("b")).select(high.alias("big"), low.alias("small"))
    current = settled(edges.distinct(), "edges")
    state = _state(current)
    while state[0]:
        # Large star: a node's larger neighbours move to the smallest node it knows.
        both = current.select(F.col("big").alias("node"), F.col("small").alias("other")).union(
            current.select("small", "big")
        )
        least = both.groupBy("node").agg(F.min("other").alias("least"))
        least = least.select("node", F.least("least", "node").alias("least"))
        large = both.where(F.col("other") > F.col("node")).join(least, "node")
        large = large.select(F.col("other").alias("big"), F.col("least").alias("small")).distinct()
        # Small star: a node and its smaller neighbours move to the smallest of them.
        least = large.groupBy("big").agg(F.min("small").alias("least"))
        moved = large.join(least, "big").where(F.col("small") != F.col("least"))
        moved = moved.select(F.col("small").alias("big"), F.col("least").alias("small"))
        current = settled(moved.union(least.select("big", "least")).distinct(), "edges")
        before, state = state, _state(current)
        if state == before:
            break
    return current.select(F.col("big").alias("node"), F.col("small").alias("root"))
