"""Packing token sequences into fixed-size bins by the sum-of-squares rule."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.llm.common import map_arrow, settled, table
from gradelake.llm.vocab import WordIds, default_path

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
# Pieces packed together in one task. More pieces fit more tightly; this many waste little.
SHARD_PIECES = 1 << 16


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """Token pieces of every row: doc_id, piece, start, length, ids_crc32, and a row number.

    A document is its ids followed by ``end_id``; only one longer than ``capacity`` is cut.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [text or "" for text in batch.column(1).to_pylist()]
        rows = []
        for k, ids in enumerate(WordIds.shared(tokenizer).encode(texts)):
            data = memoryview(ids + end)
            total = len(data) // 4
            for piece, start in enumerate(range(0, total, capacity)):
                length = min(capacity, total - start)
                crc = zlib.crc32(data[4 * start : 4 * (start + length)])
                rows.append((k, piece, start, length, crc))
        owner, piece, start, length, crc = (np.array(c, np.int64) for c in zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(owner)),
                pa.array(piece, pa.int32()),
                pa.array(start),
                pa.array(length),
                pa.array(crc),
                pa.array(owner),
            ],
            names=["doc_id", "piece", "start", "length", "ids_crc32", "row"],
        )

    return map_arrow(
        docs.select(F.col("doc_id").cast("bigint"), F.col("text")),
        run,
        "doc_id long, piece int, start long, length long, ids_crc32 long, row long",
    )


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, items taken in the given order.

    Let N(g) be the number of open bins with gap g. An item goes where the sum of N(g)^2 over
    all gaps becomes smallest: into a bin with a gap that holds it, or into a new bin. Filled
    bins count nothing. Of equal choices the tightest gap is taken, a new bin last.
    """
    counts = np.zeros(capacity + 1, np.int64)
    open_bins: dict[int, list[int]] = defaultdict(list)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    used, huge = 0, np.iinfo(np.int64).max
    for k, size in enumerate(lengths.tolist()):
        # Change of the sum, less the 2 of a bin that moves from one gap to another.
        change = 2 * (counts[: capacity + 1 - size] - counts[size:])
        change[0] -= 1  # a filled bin leaves the count
        change[counts[size:] == 0] = huge
        best = int(change.argmin())
        anew = 2 * counts[capacity - size] - 1 if size < capacity else -2
        if change[best] <= anew:
            gap = best + size
            at = open_bins[gap].pop()
            counts[gap] -= 1
        else:
            gap, at, used = capacity, used, used + 1
        bins[k], offsets[k] = at, capacity - gap
        if gap > size:
            counts[gap - size] += 1
            open_bins[gap - size].append(at)
    return bins, offsets


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    shard_pieces: int = SHARD_PIECES,
) -> DataFrame:
    """Packed pieces of every row of ``docs`` (doc_id, text; other columns are not read).

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text
    is its end id alone. Repeated rows are packed as often as they come, a null doc_id stays
    null, no rows give no rows.

    Pieces are dealt by hash into shards of about ``shard_pieces``, whatever document or source
    they come from, and each shard is packed on its own, longest pieces first; only lengths and
    positions travel, never token ids. A sequence id is shard * 2^32 + bin.
    """
    cut = settled(pieces(docs, tokenizer or default_path(TOKENIZER), capacity, end_id), "pieces")
    shards = max(1, -(-cut.count() // shard_pieces))
    shard = F.pmod(F.xxhash64("doc_id", "piece", "row", "ids_crc32"), F.lit(shards))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(
            ["length", "ids_crc32", "doc_id", "piece"], ascending=[False, True, True, True]
        )
        bins, offsets = sum_of_squares(frame["length"].to_numpy(), capacity)
        packed = frame[columns].copy()
        packed["sequence_id"] = (int(frame["shard"].iloc[0]) << 32) + bins
        packed["offset"] = offsets
        packed["doc_id"] = packed["doc_id"].astype("Int64")
        return packed

    return (
        cut.withColumn("shard", shard)
        .select(*columns, "shard")
        .groupBy("shard")
        .applyInPandas(
            run,
            "doc_id long, piece int, start long, length long, ids_crc32 long, "
            "sequence_id long, offset long",
        )
    )


def op10(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"))
