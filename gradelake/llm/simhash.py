"""SimHash near-duplicates by the generalised pigeonhole principle."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.llm.common import fresh, map_arrow, quoted, raw_bytes, settled, table
from gradelake.llm.components import components

BITS = 64
SHINGLE = 3
SEED = 42
MAX_DISTANCE = 2
# A bucket with more fingerprints than this is linked by bit flips instead of by pairs: a
# fingerprint has 65 flips, so beyond that many partners they are the cheaper way.
PAIRED_BUCKET = 64
# Shingles whose bits are held unpacked at a time.
BLOCK = 1 << 15


def fingerprint(text: bytes | None) -> int:
    """SimHash of a text as a signed 64-bit number; 0 for null and blank texts."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and exactly the six blanks
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= SHINGLE:
        hashes = [digest(joined, SEED)]
    else:
        after = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *after[: len(words) - SHINGLE]]
        ends = after[SHINGLE - 1 :]
        hashes = [digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends, strict=True)]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BLOCK):
        block = np.frombuffer(b"".join(hashes[at : at + BLOCK]), np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, *carried: str) -> DataFrame:
    """(doc_id, fp) of every row, and the bigint columns ``carried``."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fps = [fingerprint(t) for t in raw_bytes(batch.column(1))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(fps, pa.int64()), *batch.columns[2:]],
            names=["doc_id", "fp", *carried],
        )

    return map_arrow(
        docs.select(F.col("doc_id").cast("bigint"), F.col("text"), *carried),
        run,
        ", ".join(["doc_id long", "fp long", *(f"{name} long" for name in carried)]),
    )


def bit_products(fps: DataFrame) -> np.ndarray:
    """64 x 64 counts of fingerprints with both bits set; its size does not follow the data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for batch in batches:
            raw = np.ascontiguousarray(batch.column(0).to_numpy()).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
        cells = pa.array(range(BITS * BITS), pa.int32())
        yield pa.RecordBatch.from_arrays([cells, pa.array(total.ravel())], names=["cell", "n"])

    sums = fps.select("fp").mapInArrow(run, "cell int, n double").groupBy("cell")
    total = np.zeros(BITS * BITS)
    for cell, n in sums.agg(F.sum("n")).collect():
        total[cell] = n
    return total.reshape(BITS, BITS)


def group_bits(products: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits dealt into ``parts`` equal groups, correlated ones together."""
    rate = np.diag(products) / max(n, 1)
    spread = np.sqrt(np.maximum(rate * (1 - rate), 1e-9))
    tie = np.abs((products / max(n, 1) - np.outer(rate, rate)) / np.outer(spread, spread))
    np.fill_diagonal(tie, 0)
    free, groups = set(range(BITS)), []
    for k in range(parts, 0, -1):
        width = -(-len(free) // k)
        group = [max(sorted(free), key=lambda b: tie[b, list(free)].sum())]
        free.discard(group[0])
        while len(group) < width:
            best = max(sorted(free), key=lambda b: tie[b, group].sum())
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def allocate(costs: Sequence[Sequence[float]], distance: int) -> tuple[float, list[int]]:
    """Thresholds per group of least total cost, by dynamic programming.

    ``costs[i][t + 1]`` is the cost of probing group i with threshold t, from -1 (not probed) to
    ``distance``. Two fingerprints within ``distance`` bits differ by at most t_i bits in some
    group i as long as the thresholds add up to distance - groups + 1.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for t in range(-1, distance + 1):
                offer = (cost + row[t + 1], [*chosen, t])
                if total + t not in step or offer < step[total + t]:
                    step[total + t] = offer
        best = step
    return best[distance - len(costs) + 1]


def masked(groups: Sequence[Sequence[int]]) -> list[int]:
    """Signed 64-bit mask of each group of bits."""
    masks = [sum(1 << b for b in group) for group in groups]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def _flips(bits: Sequence[int], distance: int) -> list[int]:
    sets = (c for k in range(distance + 1) for c in combinations(bits, k))
    return masked(list(sets))


def _keys(fps: DataFrame, masks: Sequence[int], tags: Sequence[int]) -> DataFrame:
    parts = [
        F.struct(F.lit(t).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
        for t, m in zip(tags, masks, strict=True)
    ]
    return fps.select("fp", F.inline(F.array(*parts)))


def plan_search(
    fps: DataFrame, distance: int = MAX_DISTANCE
) -> tuple[list[list[int]], list[int]]:
    """Groups of bits and their thresholds, chosen on counts over all fingerprints.

    Two and three groups are planned and the cheaper plan is taken; both are complete, so the
    choice is one of cost only. The cost of a threshold is the rows probed plus the candidate
    pairs expected: pairs that agree on the whole group are counted, and widened to pairs within
    t bits by the odds that a bit of the group differs.
    """
    n = fps.count()
    products = bit_products(fps)
    rate = np.diag(products) / max(n, 1)
    odds = 2 * rate * (1 - rate) / np.maximum(1 - 2 * rate * (1 - rate), 1e-9)
    plans = [group_bits(products, n, parts) for parts in (2, 3)]
    masks = [m for groups in plans for m in masked(groups)]
    counts = _keys(fps, masks, range(len(masks))).groupBy("part", "key").count()
    exact = F.sum(F.col("count") * (F.col("count") - 1) / 2)
    pairs = dict(counts.groupBy("part").agg(exact).collect())
    found, at = [], 0
    for groups in plans:
        costs = []
        for group in groups:
            agreeing = max(pairs.get(at, 0.0), n * n / 2 * np.prod(1 / (1 + odds[group])))
            symmetric = np.poly(-odds[group])  # elementary symmetric sums of the odds
            rows = np.cumsum([n * comb(len(group), k) for k in range(distance + 1)])
            costs.append([0.0, *(rows + agreeing * np.cumsum(symmetric[: distance + 1]))])
            at += 1
        found.append((*allocate(costs, distance), groups))
    _, thresholds, groups = min(found, key=lambda plan: plan[0])
    return groups, thresholds


def links(fps: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs within ``distance`` (1 or 2) bits.

    ``fps`` holds distinct fingerprints in ``fp``. Each is filed under its bits in every probed
    group, probes the keys within the group's threshold, and candidates are verified.

    A crowded key would make all pairs of its fingerprints. Those fingerprints, and those that
    probe it, are linked by bit flips instead: two of them are within two bits just if they
    share one of their 65 strings at most one bit away. Such a string has at most 65 owners.
    """
    if distance not in (1, 2):
        raise ValueError("distance must be 1 or 2")
    groups, thresholds = plan_search(fps, distance)
    used = [(i, g, t) for i, (g, t) in enumerate(zip(groups, thresholds, strict=True)) if t >= 0]
    tags, masks = [i for i, _, _ in used], masked([g for _, g, _ in used])
    index = _keys(fps, masks, tags)
    probes = None
    for (tag, group, t), mask in zip(used, masks, strict=True):
        own = F.col("fp").bitwiseAND(F.lit(mask))
        flips = F.array(*[F.lit(f) for f in _flips(group, t)])
        keys = F.transform(flips, own.bitwiseXOR)
        rows = fps.select("fp", F.lit(tag).alias("part"), F.explode(keys).alias("key"))
        probes = rows if probes is None else probes.union(rows)
    sizes = index.groupBy("part", "key").count().where(F.col("count") > PAIRED_BUCKET)
    crowded = settled(sizes.select("part", "key"), "crowded")
    sparse = index.join(crowded, ["part", "key"], "left_anti").withColumnRenamed("fp", "b")
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    pairs = probes.withColumnRenamed("fp", "a").alias("p").join(
        sparse.alias("i"),
        (F.col("p.part") == F.col("i.part"))
        & (F.col("p.key") == F.col("i.key"))
        & (F.col("a") < F.col("b"))
        & apart,
    )
    dense = probes.join(crowded, ["part", "key"], "left_semi").select("fp").distinct()
    near = F.array(*[F.lit(f) for f in _flips(range(BITS), 1)])
    owners = dense.select(
        "fp", F.explode(F.transform(near, lambda f: F.col("fp").bitwiseXOR(f))).alias("string")
    )
    if distance == 1:  # both ends are then among the strings' own fingerprints
        owners = owners.join(dense.select(F.col("fp").alias("string")), "string", "left_semi")
    # At most 65 fingerprints are gathered for a string.
    rings = owners.groupBy("string").agg(F.collect_set("fp").alias("ring"))
    rings = rings.where(F.size("ring") > 1)
    if distance == 1:
        spokes = rings.select(F.col("string").alias("a"), F.explode("ring").alias("b"))
    else:
        spokes = rings.select(F.array_min("ring").alias("a"), F.explode("ring").alias("b"))
    return pairs.select("a", "b").union(spokes.where(F.col("a") != F.col("b")).distinct())


def near_duplicates(docs: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (hex), component_id.

    Rows are linked when their fingerprints differ in at most ``distance`` bits; component_id is
    the smallest doc_id that links lead to. Null, empty and blank texts have fingerprint zero
    and are linked like any other. Repeated rows come back as often as they came in. A null
    doc_id is no candidate for component_id, which is null where no member has an id. Columns
    other than doc_id and text are not read.
    """
    rows = settled(fingerprints(docs), "fingerprints")
    firsts = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    firsts = settled(firsts, "distinct")
    roots = components(links(firsts.select("fp"), distance))
    rooted = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    heads = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    owned = rooted.join(heads, "root").select("fp", "component_id")
    return rows.join(owned, "fp").select("doc_id", hexed(F.col("fp")).alias("fingerprint"),
                                         "component_id")


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(docs: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns.

    The row with the smallest doc_id stays, a null doc_id last; of rows that share it the one
    with the smallest fingerprint and then the smallest hash of its columns (maps, which cannot
    be hashed, left out). So an id that is used for two different texts loses neither, and copies
    are dropped whether or not they have an id. An empty table stays empty.
    """
    hashed = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    mark, fp, root = (fresh(docs, name) for name in ("row_mark", "row_fp", "row_root"))
    marked = docs.withColumn(mark, F.xxhash64(*[F.col(quoted(c)) for c in hashed]))
    rows = settled(
        fingerprints(marked.select("doc_id", "text", F.col(mark).alias("mark")), "mark"),
        "marked-fingerprints",
    )
    roots = components(links(rows.select("fp").distinct(), distance))
    rooted = rows.join(roots.withColumnRenamed("node", "root_fp"), F.col("fp") == F.col("root_fp"),
                       "left").select("doc_id", "fp", "mark", F.coalesce("root", "fp").alias(root))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "fp", "mark")
    first = rooted.groupBy(root).agg(F.min(place).alias("first")).select("first.*")
    # How many rows are copies of the chosen one, in every column.
    copies = rows.groupBy("doc_id", "fp", "mark").agg(F.count(F.lit(1)).alias("copies"))
    chosen = settled(
        first.join(
            copies.select(F.col("doc_id").alias("copied"), F.col("fp").alias(fp),
                          F.col("mark").alias("copied_mark"), "copies"),
            F.col("doc_id").eqNullSafe(F.col("copied"))
            & (F.col("fp") == F.col(fp)) & (F.col("mark") == F.col("copied_mark")),
        ).select("doc_id", "mark", "copies"),
        "kept",
    )

    def kept(condition: Column) -> DataFrame:
        # Texts are shuffled once, in the same way at every size, by a join that can spill.
        ids = chosen.where(condition).select(
            F.col("doc_id").alias(fp), F.col("mark").alias(root)
        ).hint("merge")
        same = marked["doc_id"].cast("bigint").eqNullSafe(F.col(fp)) & (marked[mark] == F.col(root))
        return marked.join(ids, same, "left_semi")

    single, repeated = kept(F.col("copies") == 1), kept(F.col("copies") > 1)
    return single.unionByName(repeated.dropDuplicates(["doc_id", mark])).drop(mark)


def op5(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))
