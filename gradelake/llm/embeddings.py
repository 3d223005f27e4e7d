"""Near-duplicate vectors by sorted projection passes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.llm.common import positions, settled, table
from gradelake.llm.components import components

SIMILARITY = 0.95
# Passes come in rounds; there are as many rounds as it takes until, by the links that each
# round adds, no more than one link in a thousand is still to be found.
PASSES = 12
COMPLETE = 0.999
# Hash bits a vector is ordered by in a pass, and neighbours it is compared with on each side.
BITS = 62
WINDOW = 48
SEED = 11
# Rows of a pass that are compared in one task, and vectors of a component multiplied at once.
STRETCH = 4096
TILE = 1024


def unit_rows(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """Which vectors can be linked, and those at length one in double precision."""
    units: list[np.ndarray | None] = []
    for vector in column.to_pylist():
        unit = None
        if vector is not None and None not in vector:
            values = np.asarray(vector, np.float64)
            peak = np.abs(values).max(initial=0.0)
            if np.isfinite(peak) and peak > 0 and np.isfinite(values).all():
                scaled = values / peak
                unit = scaled / np.sqrt(scaled @ scaled)
        units.append(unit)
    return np.array([u is not None for u in units], bool), units


def prepared(vectors: DataFrame) -> DataFrame:
    """vec_id, unit vector (null if it cannot be linked) and its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, units = unit_rows(batch.column(1))
            raw = [None if u is None else u.tobytes() for u in units]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(raw, pa.binary())], names=["vec_id", "unit"]
            )

    rows = vectors.select(
        F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>")
    )
    return rows.mapInArrow(run, "vec_id long, unit binary")


def hashes(units: np.ndarray, turn: int, bits: int, seed: int) -> np.ndarray:
    """Concatenated random hyperplane hashes of a pass, first hash in the highest bit."""
    planes = np.random.default_rng([seed, turn]).standard_normal((units.shape[1], bits))
    places = np.left_shift(np.int64(1), np.arange(bits - 1, -1, -1, dtype=np.int64))
    return ((units @ planes) >= 0) @ places


def projected(distinct: DataFrame, turns: range, bits: int, seed: int) -> DataFrame:
    """One row per vector and pass: turn, size (dimensions), key, node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            sizes = np.array([len(r) // 8 for r in raw])
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                units = np.frombuffer(b"".join(raw[r] for r in rows)).reshape(len(rows), -1)
                for turn in turns:
                    keys = hashes(units, turn, bits, seed)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(rows), turn, np.int32)),
                            pa.array(np.full(len(rows), size, np.int32)),
                            pa.array(keys),
                            batch.column(0).take(pa.array(rows)),
                        ],
                        names=["turn", "size", "key", "node"],
                    )

    return distinct.select("node", "unit").mapInArrow(
        run, "turn int, size int, key long, node long"
    )


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """As few of the pairs as tie the same things together."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent.setdefault(up, up)
            x = up
        return x

    kept: tuple[list[int], list[int]] = ([], [])
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            kept[0].append(x)
            kept[1].append(y)
    return kept


def window_links(
    ordered: DataFrame, window: int, similarity: float, stretch: int = STRETCH
) -> DataFrame:
    """Edges (a, b) verified among neighbours of each pass.

    ``ordered`` has ``position`` within (turn, size). A pass is cut into stretches; each takes
    along the last ``window`` rows of the one before, so no neighbours are missed at a cut.
    """
    at = F.col("position") - 1
    own = F.floor(at / stretch).cast("bigint")
    late = at % stretch >= stretch - window
    stretches = F.when(late, F.array(own, own + 1)).otherwise(F.array(own))

    def run(frame: pa.Table) -> pa.Table:
        frame = frame.sort_by("position")
        nodes = frame.column("node").to_numpy()
        raw = frame.column("unit").to_pylist()
        units = np.frombuffer(b"".join(raw)).reshape(len(raw), -1)
        left, right = [], []
        for step in range(1, min(window, len(nodes) - 1) + 1):
            near = np.flatnonzero(
                np.einsum("ij,ij->i", units[:-step], units[step:]) >= similarity
            )
            left.append(nodes[near])
            right.append(nodes[near + step])
        none = np.zeros(0, np.int64)
        a, b = _forest(np.concatenate([*left, none]), np.concatenate([*right, none]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    rows = ordered.select("turn", "size", "position", "node", "unit", F.explode(stretches).alias("s"))
    return rows.groupBy("turn", "size", "s").applyInArrow(run, "a long, b long")


def member_links(members: DataFrame, similarity: float, tile: int = TILE) -> DataFrame:
    """Linked copies of every node: node, n_links (its own copies not counted).

    ``members`` has root, node, copies, unit of all nodes in components of two and more. A
    component is cut into tiles, and every pair of tiles is multiplied in a task of its own, so
    links are counted exactly, whatever window they were found in, and no pair is ever a row.
    """
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    tiles = F.ceil(F.col("n") / tile).cast("int")
    placed = members.join(sizes, "root").select(
        "root", "node", "copies", "unit", tiles.alias("tiles"),
        F.pmod(F.xxhash64("node"), tiles).cast("int").alias("tile"),
    )
    # Tile t meets tile u in the cell (min, max): each row goes to one cell per tile.
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    cells = placed.select("root", "node", "copies", "unit", "tile", other.alias("other"))
    cells = cells.withColumn("low", F.least("tile", "other")).withColumn(
        "high", F.greatest("tile", "other")
    )

    def run(frame: pa.Table) -> pa.Table:
        tile_of = frame.column("tile").to_numpy()
        nodes, copies = frame.column("node").to_numpy(), frame.column("copies").to_numpy()
        raw = frame.column("unit").to_pylist()
        units = np.frombuffer(b"".join(raw)).reshape(len(raw), -1)
        low = np.flatnonzero(tile_of == tile_of.min())
        high = np.flatnonzero(tile_of == tile_of.max())
        total = np.zeros(len(nodes), np.int64)
        same = frame.column("low")[0] == frame.column("high")[0]
        if same or len(low) < len(nodes):  # of two tiles one may be empty
            for at in range(0, len(low), 1024):
                rows = low[at : at + 1024]
                linked = (units[rows] @ units[high].T) >= similarity
                if same:
                    linked[np.arange(len(rows)), at + np.arange(len(rows))] = False
                    total[rows] += linked @ copies[high]
                else:
                    total[rows] += linked @ copies[high]
                    total[high] += copies[rows] @ linked
        return pa.table({"node": nodes, "n_links": total})

    found = cells.groupBy("root", "low", "high").applyInArrow(run, "node long, n_links long")
    return found.groupBy("node").agg(F.sum("n_links").alias("n_links"))


def complete(merges: list[int], share: float = COMPLETE) -> bool:
    """Whether the ties found after each round say that ``share`` of all is found.

    A tie that a round finds with odds r is new in round k with odds r (1 - r)^(k - 1), so what
    rounds add falls by the factor 1 - r, and what is still missing is about the last round's
    addition times that factor over r. Ties that are hard to find, as between vectors in a dense
    cone, make the additions fall slowly, and the rounds go on.
    """
    if len(merges) < 2:
        return False
    added = merges[-1] - merges[-2]
    before = merges[-2] - (merges[-3] if len(merges) > 2 else 0)
    if added == 0:
        return True
    if added >= before:
        return False
    fall = added / before
    return added * fall / (1 - fall) <= (1 - share) * merges[-1]


def near_duplicates(
    vectors: DataFrame,
    similarity: float = SIMILARITY,
    passes: int = PASSES,
    window: int = WINDOW,
    bits: int = BITS,
    seed: int = SEED,
    share: float = COMPLETE,
) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Equal vectors are one node with a number of copies. In each pass all nodes are ordered by
    concatenated random hashes, neighbours within ``window`` are compared by cosine, and the
    verified pairs of all passes are united. Rounds of ``passes`` with fresh hashes follow each
    other until the links they add say that ``share`` of all ties is found (``complete``); there
    is no largest number of rounds. Links are then counted exactly inside every component, where
    all of them lie.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing:
    they have no links and are their own component. Vectors of different length are never
    compared. Of repeated rows each counts as a vector. A null vec_id is never a component_id
    unless its vector is alone. No rows give no rows. Other columns are not read.
    """
    rows = settled(prepared(vectors), "units")
    usable = rows.where(F.col("unit").isNotNull())
    grouped = usable.groupBy("unit").agg(
        F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies")
    )
    distinct = settled(
        grouped.select("unit", "first", "copies", F.monotonically_increasing_id().alias("node")),
        "vectors",
    )
    linked, merges = None, []
    while not complete(merges, share):
        turns = range(len(merges) * passes, (len(merges) + 1) * passes)
        placed = positions(
            projected(distinct, turns, bits, seed), ["key", "node"], ["turn", "size"], "position"
        )
        ordered = placed.join(distinct.select("node", "unit"), "node")
        edges = window_links(ordered, window, similarity)
        if linked is not None:
            edges = edges.union(linked.select("node", "root"))
        linked = settled(components(edges), "linked")
        merges.append(linked.count())  # every node but one of each component
    roots = linked.select("root").distinct()
    members = linked.union(roots.select("root", "root")).join(distinct, "node")
    members = settled(members.select("root", "node", "copies", "first", "unit"), "members")
    counts = member_links(members, similarity)
    heads = members.groupBy("root").agg(F.min("first").alias("head"))
    known = members.join(heads, "root").join(counts, "node").select("node", "head", "n_links")
    nodes = distinct.join(known, "node", "left").select(
        F.col("unit").alias("node_unit"),
        F.coalesce("head", "first").alias("head"),
        (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    joined = rows.join(nodes, F.col("unit") == F.col("node_unit"), "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("head", "vec_id").alias("component_id"),
    )
    return joined.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op7(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "embeddings"))
