"""Scoring texts: smoothed word counts, and a self-attention model over subword ids."""

from __future__ import annotations

import copy
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradelake.llm import attention
from gradelake.llm.common import id_crc, map_arrow, settled, slices, table
from gradelake.llm.vocab import WordIds, default_path
from gradelake.session import scratch_folder, scratch_run

TOKENIZER = "word_bpe_49k.json"
START, END = 49406, 49407
VOCABULARY = 49408
# The attention model is fitted in rounds, each on its share of the windows of every training
# text. In a round the texts are dealt into shards of about so many windows, which are fitted
# side by side from one model and averaged. A small corpus is gone through again until the
# rounds have made attention.STEPS steps.
ROUNDS = 4
SHARD_WINDOWS = 1 << 17
# Neighbouring windows of a text that go to a shard together; their ids are stored once.
RUN_WINDOWS = 8
# Rows of the model's tables that are averaged together, and shards that are added up at once.
SLICE = 4096
FAN_IN = 32
# Bytes of text whose words are listed once.
BLOCK_BYTES = 8 << 20
# Words kept in one row, words tokenised together, documents scored at once.
LIST_WORDS, WORD_ROWS, GROUP = 8192, 8192, 64
# Constants of XXH64, and xxhash64('shard').
XXH_PRIMES = (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63,
    0x27D4EB2F165667C5,
)
SHARD_HASH = 0xde0a6ccf4da76baa
# Bytes of rows that a task packs together before it passes them on.
PACK_BYTES = 16 << 20


def training_flag(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 7 is not 2; a null id is neither trained on nor held out."""
    return F.coalesce(id_crc(doc_id) % 7 != 2, F.lit(False))


def blocked(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Texts as places in the word lists of their blocks, and those lists; written once.

    A block is a run of neighbouring rows of one input partition with about ``block_bytes`` of
    text. Each text is split into words once, here. A row with ``at`` is a document: its number
    in the block, doc_id, trained, held_out and ``places``, one for each word. The others are
    stretches of the block's list of different words: the place of the first one, the words and
    how often each occurs in training texts.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        training_flag(F.col("doc_id")).alias("trained"),
        F.coalesce(id_crc(F.col("doc_id")) % 7 == 2, F.lit(False)).alias("held_out"),
    )
    schema = (
        "block long, at int, doc_id long, trained boolean, held_out boolean, places binary, "
        "first int, words array<string>, n array<long>"
    )
    arrow = pa.schema(
        [("block", pa.int64()), ("at", pa.int32()), ("doc_id", pa.int64()),
         ("trained", pa.bool_()), ("held_out", pa.bool_()), ("places", pa.binary()),
         ("first", pa.int32()), ("words", pa.list_(pa.string())), ("n", pa.list_(pa.int64()))]
    )

    def listed(block: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = pa.Table.from_batches(parts).combine_chunks()
        words, counts = split(texts.column("text").combine_chunks())
        found = words.dictionary_encode()
        places = found.indices.to_numpy(zero_copy_only=False)
        trained = np.repeat(texts.column("trained").to_numpy(), counts)
        n = np.bincount(places[trained], minlength=len(found.dictionary))
        texts = texts.drop(["text"])
        del words, trained
        begins = np.arange(0, len(n), LIST_WORDS)
        size = len(begins)
        ends = pa.array(np.append(begins, len(n)), pa.int32())
        lists = pa.RecordBatch.from_arrays(
            [pa.array(np.full(size, block), pa.int64()),
             *[pa.nulls(size, t) for t in arrow.types[1:6]],
             pa.array(begins, pa.int32()),
             pa.ListArray.from_arrays(ends, found.dictionary),
             pa.ListArray.from_arrays(ends, pa.array(n, pa.int64()))],
            schema=arrow,
        )
        yield from (lists.slice(k, 1) for k in range(size))
        upto = np.concatenate([[0], np.cumsum(counts)])
        for first in range(0, len(counts), GROUP):
            last = min(len(counts), first + GROUP)
            packed = [_planes(places[upto[k] : upto[k + 1]]) for k in range(first, last)]
            given = texts.slice(first, last - first)
            size = last - first
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, block), pa.int64()),
                 pa.array(np.arange(first, last), pa.int32()),
                 *[given.column(c).combine_chunks() for c in ("doc_id", "trained", "held_out")],
                 pa.array(packed, pa.binary()),
                 *[pa.nulls(size, t) for t in arrow.types[6:]]],
                schema=arrow,
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, filled = TaskContext.get().partitionId() << 32, [], 0
        for part in (part for whole in batches for part in slices(whole)):
            parts.append(part)
            filled += pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
            if filled >= block_bytes:
                yield from listed(block, parts)
                block, parts, filled = block + 1, [], 0
                pa.default_memory_pool().release_unused()
        if parts:
            yield from listed(block, parts)

    return settled(rows.mapInArrow(run, schema), "blocks")


def _planes(places: np.ndarray) -> bytes:
    """Low halves of all numbers, then high halves, which compress to almost nothing."""
    halves = places.astype("<u4").view("<u2").reshape(-1, 2)
    return halves.T.tobytes()


def _joined(planes: bytes) -> np.ndarray:
    low, high = np.frombuffer(planes, "<u2").reshape(2, -1).astype(np.int64)
    return low + (high << 16)


def _pressed(*arrays: np.ndarray) -> bytes:
    """Numbers of several arrays, lowest bytes first, compressed."""
    planes = [a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays]
    return pa.Codec("zstd", compression_level=1).compress(b"".join(planes), asbytes=True)


def _unpressed(data: bytes, *kinds: tuple[str, int]) -> list[np.ndarray]:
    """The arrays of ``_pressed`` from their types and lengths."""
    widths = [np.dtype(kind).itemsize for kind, _ in kinds]
    held = [width * size for width, (_, size) in zip(widths, kinds, strict=True)]
    whole = pa.Codec("zstd").decompress(data, sum(held), asbytes=True)
    found, at = [], 0
    for (kind, size), width, n in zip(kinds, widths, held, strict=True):
        planes = np.frombuffer(whole, np.uint8, n, at).reshape(width, size)
        found.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += n
    return found


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased (A-Z) words of all texts in a row, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = lists.flatten()
    # White space at either end of a text gives an empty word.
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(False))
    return flat.filter(pa.array(real)), np.bincount(owner[real], minlength=len(lists))


def met_words(rows: DataFrame) -> DataFrame:
    """Every word of every block: block, place, word, count in all training text, first.

    Words come counted per block. All blocks that hold a word meet at the word, in one row per
    block however frequent it is, so its total is a window sum. ``first`` marks one row of each
    word.
    """
    listed = rows.where(F.col("words").isNotNull()).select(
        "block", "first", F.posexplode(F.arrays_zip("words", "n")).alias("pos", "item")
    )
    # One window for both columns, so the rows are sorted once.
    whole = Window.partitionBy("word")
    return listed.select(
        "block",
        (F.col("first") + F.col("pos")).alias("place"),
        F.col("item.words").alias("word"),
        F.col("item.n").alias("n"),
    ).select(
        "block",
        "place",
        "word",
        F.sum("n").over(whole).alias("n"),
        (F.min("block").over(whole) == F.col("block")).alias("first"),
    )


def block_words(rows: DataFrame, tokenizer: str) -> DataFrame:
    """``met_words`` with the subword ids of each word in its place: one row per word and block."""
    schema = "block long, place int, n long, ids binary, first boolean"
    return map_arrow(met_words(rows), _tokenised(tokenizer), schema, WORD_ROWS)


def _tokenised(tokenizer: str) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = batch.column(2).dictionary_encode()
        # A word comes in one batch or two: there is little to remember.
        ids = WordIds.shared(tokenizer, 1 << 14).each(found.dictionary)
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns[:2],
                batch.column(3),
                ids.take(found.indices),
                batch.column(4),
            ],
            names=["block", "place", "n", "ids", "first"],
        )

    return run


PACKED = (
    "block long, words int, n_ids long, data binary, distinct long, total long, id array<int>, "
    "times array<double>"
)


def packed_words(rows: DataFrame, tokenizer: str) -> DataFrame:
    """``block_words`` in few rows: words that a task holds of a block lie together, compressed.

    A row without a block sums up a task's words: how many different ones are in training text,
    how often they occur there, and how often each subword id does.
    """
    tokenised = _tokenised(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (part for batch in batches for part in slices(batch, WORD_ROWS))
        yield from _packed(found for part in parts for found in tokenised(part))

    return met_words(rows).mapInArrow(run, PACKED)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``packed_words`` from those of ``block_words``."""
    distinct = total = 0
    times = np.zeros(VOCABULARY)

    def row(*values) -> pa.RecordBatch:
        types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(),
                 pa.list_(pa.int32()), pa.list_(pa.float64())]
        names = ["block", "words", "n_ids", "data", "distinct", "total", "id", "times"]
        return pa.RecordBatch.from_arrays(
            [pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names
        )

    def by_block(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal distinct, total, times
        block, place, n, first = (
            np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in parts])
            for c in ("block", "place", "n", "first")
        )
        ids = pa.concat_arrays([p.column("ids") for p in parts])
        size = pc.binary_length(ids).to_numpy(False).astype(np.int64) // 4
        flat = np.frombuffer(b"".join(ids.to_pylist()), "<u4").astype("<u2")
        once = first & (n > 0)
        distinct, total = distinct + int(once.sum()), total + int(n[once].sum())
        often = np.where(once, n, 0)
        times += np.bincount(flat, np.repeat(often, size), minlength=VOCABULARY)
        # Blocks of a few tasks are few: sorted by their numbers among those here, then place.
        number = pa.array(block).dictionary_encode().indices.to_numpy().astype(np.int64)
        order = np.argsort((number << 32) + place)
        block, place, n, size_of = block[order], place[order], n[order], size[order]
        start = (np.cumsum(size) - size)[order] - (np.cumsum(size_of) - size_of)
        flat = flat[np.repeat(start, size_of) + np.arange(len(flat))]
        upto = np.concatenate([[0], np.cumsum(size_of)])
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            held = flat[upto[a] : upto[b]]
            steps = np.diff(place[a:b], prepend=0).astype("<u4")
            data = _pressed(steps, n[a:b].astype("<i8"), size_of[a:b].astype("<u4"), held)
            yield row(int(block[a]), b - a, len(held), data, None, None, None, None)

    parts, filled = [], 0
    for batch in batches:
        if len(batch):
            parts.append(batch)
            filled += batch.nbytes
        if filled >= PACK_BYTES:
            yield from by_block(parts)
            parts, filled = [], 0
    if parts:
        yield from by_block(parts)
    used = np.flatnonzero(times)
    if distinct:
        yield row(None, None, None, None, distinct, total, used, times[used])


def id_counts(packed: DataFrame) -> np.ndarray:
    """Occurrences of every subword id in all training text, from ``packed_words``."""
    sums = packed.where(F.col("block").isNull()).select(
        F.explode(F.arrays_zip("id", "times")).alias("item")
    )
    counts = np.zeros(VOCABULARY)
    for i, n in sums.groupBy("item.id").agg(F.sum("item.times")).collect():
        counts[i] = n
    return counts


def encoded(rows: DataFrame, vocabulary: DataFrame, total: int, distinct: int) -> DataFrame:
    """One row per document: block, at, doc_id, trained, held_out, its base columns, n_ids, ids.

    ``ids`` has two bytes for every subword id of the text. base_score and n_known are those of
    the words; the end is not among them. ``vocabulary`` is ``block_words`` or ``packed_words``.
    """
    if "data" not in vocabulary.columns:
        vocabulary = vocabulary.mapInArrow(_packed, PACKED)
    schema = (
        "block long, at int, doc_id long, trained boolean, held_out boolean, n_words long, "
        "n_known long, base_score double, n_ids long, ids binary"
    )

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        words = _Words(right, total, distinct)
        n_words, n_known, base, ids = [], [], [], []
        for planes in left.column("places").to_pylist():
            places = _joined(planes)
            n_words.append(len(places))
            n_known.append(int(words.known[places].sum()))
            base.append(float(words.share[places].sum()))
            ids.append(words.ids(places).tobytes())
        return pa.table(
            {
                **{c: left.column(c) for c in left.column_names[:5]},
                "n_words": pa.array(n_words, pa.int64()),
                "n_known": pa.array(n_known, pa.int64()),
                "base_score": pa.array(base, pa.float64()),
                "n_ids": pa.array([len(i) // 2 for i in ids], pa.int64()),
                "ids": pa.array(ids, pa.binary()),
            }
        )

    documents = rows.where(F.col("at").isNotNull())
    left = documents.select("block", "at", "doc_id", "trained", "held_out", "places")
    right = vocabulary.where(F.col("block").isNotNull()).select("block", "words", "n_ids", "data")
    return left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(run, schema)


def runs(texts: DataFrame, turn: int | None = None) -> DataFrame:
    """Windows of all training texts of ``encoded``: doc_id, round, run, n, ids.

    A row is a run of up to RUN_WINDOWS neighbouring windows of one text, ``n`` of them. A round
    takes every ROUNDS-th run of a text, beginning at one hashed from its id; ``turn`` asks for
    one round alone. ``run`` is a number that spreads runs evenly, those of equal rows and of
    one long text as well.

    A window has BLOCK targets that are learned from, the end among them, and the 2 * BLOCK ids
    before the last of them. ``ids`` are those of the run's windows, one after the other, with
    the context of the first one.
    """
    trained = texts.where("trained").select("block", "at", "doc_id", "ids")
    schema = "doc_id long, round int, run long, n long, ids binary"
    return map_arrow(trained, _cut(turn), schema)


def _cut(turn: int | None) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    size, step = attention.BLOCK, attention.BLOCK * RUN_WINDOWS

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = {"doc_id": [], "round": [], "run": [], "n": [], "ids": []}
        lead = np.full(size + 1, START, "<u2").tobytes()
        tail = np.array([END], "<u2").tobytes()
        for block, at, doc_id, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            whole = memoryview(lead + ids + tail)
            targets = len(ids) // 2 + 1
            begin = zlib.crc32(str(doc_id).encode())
            count = -(-targets // step)
            if turn is None:
                places = range(count)
            else:
                places = range((turn - begin) % ROUNDS, count, ROUNDS)
            for k in places:
                first = k * step
                out["doc_id"].append(doc_id)
                out["round"].append((begin + k) % ROUNDS)
                out["run"].append(zlib.crc32(f"{block} {at} {first}".encode()))
                out["n"].append(-(-min(step, targets - first) // size))
                out["ids"].append(bytes(whole[2 * first : 2 * (first + step + size + 1)]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(out["doc_id"], pa.int64()), pa.array(out["round"], pa.int32()),
             pa.array(out["run"], pa.int64()), pa.array(out["n"], pa.int64()),
             pa.array(out["ids"], pa.binary())],
            names=list(out),
        )

    return run


def shard_of(run: np.ndarray, shards: int) -> np.ndarray:
    """``pmod(xxhash64('shard', run), shards)`` of SQL, for runs that are cut in Python."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in XXH_PRIMES)

    def turned(x: np.ndarray, bits: int) -> np.ndarray:
        return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))

    h = turned(run.astype("<i8").view("<u8") * p2, 31) * p1
    h ^= np.array([SHARD_HASH], "<u8") + p5 + np.uint64(8)
    h = turned(h, 27) * p1 + p4
    for bits, prime in ((33, p2), (29, p3)):
        h = (h ^ (h >> np.uint64(bits))) * prime
    return (h ^ (h >> np.uint64(32))).view("<i8") % shards


def dealt(texts: DataFrame, turn: int, shards: int) -> DataFrame:
    """The runs of a round, dealt into shards by ``shard_of``: shard, runs, n_ids, data.

    What a task holds of a shard lies together in one row, compressed; ``in_order`` has it back.
    """
    cut = _cut(turn)

    def by_shard(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pa.Table.from_batches(parts).combine_chunks()
        of = shard_of(found.column("run").to_numpy(), shards)
        order = np.argsort(of, kind="stable")
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(of[order])) + 1, [len(of)]])
        out = {"shard": [], "runs": [], "n_ids": [], "data": []}
        doc_id = found.column("doc_id").to_numpy()
        ids = found.column("ids").to_pylist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            rows = order[a:b]
            flat = np.frombuffer(b"".join([ids[k] for k in rows.tolist()]), "<u2")
            held = np.array([len(ids[k]) // 2 for k in rows.tolist()], "<u4")
            out["shard"].append(int(of[rows[0]]))
            out["runs"].append(len(rows))
            out["n_ids"].append(len(flat))
            out["data"].append(_pressed(doc_id[rows].astype("<i8"), held, flat))
        yield pa.RecordBatch.from_arrays(
            [pa.array(out["shard"], pa.int64()), pa.array(out["runs"], pa.int32()),
             pa.array(out["n_ids"], pa.int64()), pa.array(out["data"], pa.binary())],
            names=list(out),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, filled = [], 0
        for found in (c for batch in batches for part in slices(batch) for c in cut(part)):
            if len(found):
                parts.append(found)
                filled += found.nbytes
            if filled >= PACK_BYTES:
                yield from by_shard(parts)
                parts, filled = [], 0
        if parts:
            yield from by_shard(parts)

    trained = texts.where("trained").select("block", "at", "doc_id", "ids")
    return trained.mapInArrow(run, "shard long, runs int, n_ids long, data binary")


def in_order(frame: pa.Table) -> list[bytes]:
    """Ids of the runs of a shard, by the ids of their texts and then their own."""
    doc_id, found = [], []
    columns = (frame.column(c).to_pylist() for c in ("runs", "n_ids", "data"))
    for n, n_ids, data in zip(*columns, strict=True):
        docs, held, flat = _unpressed(data, ("<i8", n), ("<u4", n), ("<u2", n_ids))
        ends = np.cumsum(2 * held, dtype=np.int64).tolist()
        whole = flat.tobytes()
        doc_id.append(docs)
        found += [whole[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    whole = pa.table({"doc_id": np.concatenate(doc_id), "ids": pa.array(found, pa.binary())})
    whole = whole.sort_by([("doc_id", "ascending"), ("ids", "ascending")])
    return whole.column("ids").to_pylist()


def windows(rows: DataFrame, vocabulary: DataFrame, total: int, distinct: int) -> DataFrame:
    """All windows of all training texts (see ``runs``), from blocks and their words."""
    return runs(encoded(rows, vocabulary, total, distinct))


def unpacked(*found: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, ids before, targets and target weights of the windows of runs."""
    size = attention.BLOCK
    flat = np.frombuffer(b"".join(found), "<u2")
    held = np.array([len(f) // 2 for f in found])
    targets = held - size - 1
    n = -(-targets // size)
    room = n * size + size + 1
    begin = np.cumsum(room) - room
    ids = np.full(room.sum(), END, np.uint16)
    ids[np.repeat(begin - (np.cumsum(held) - held), held) + np.arange(len(flat))] = flat
    of_run = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    ids = ids[(np.repeat(begin, n) + size * of_run)[:, None] + np.arange(2 * size + 1)]
    left = np.repeat(targets, n) - size * of_run
    weight = (np.arange(size) < left[:, None]).astype(np.float32)
    return ids[:, size : 2 * size], ids[:, :size], ids[:, size + 1 :], weight


def fitted(texts: DataFrame, counts: np.ndarray) -> attention.Model:
    """The attention model after all rounds over the training texts of ``texts`` (``encoded``).

    A shard is the runs of a round whose numbers hash alike, in an order of their texts. The
    average of a row of a table is taken over the shards that have the id. Changes are added up
    in steps of at most FAN_IN shards, so no task holds more of them however many there are.
    """
    model = attention.untrained(counts, START)
    n_windows = texts.where("trained").agg(
        F.sum(F.ceil((F.col("n_ids") + 1) / attention.BLOCK)).cast("bigint")
    ).first()[0]
    if not n_windows:
        return model
    shards = -(-n_windows // (ROUNDS * SHARD_WINDOWS))
    context = texts.sparkSession.sparkContext
    tables = 4

    def round_of(turn: int) -> list:
        sent = context.broadcast(model)

        def run(frame: pa.Table) -> pa.Table:
            shard = frame.column("shard")[0].as_py()
            data = unpacked(*in_order(frame))
            before = sent.value.parameters()
            mine = copy.deepcopy(sent.value)
            steps = max(-(-attention.STEPS // ROUNDS), -(-len(data[0]) // attention.BATCH))
            attention.fit(mine, data, steps, [7, turn, shard], turn / ROUNDS, 1 / ROUNDS)
            used = np.unique(np.concatenate([data[0].ravel(), data[1].ravel()]))
            parts = np.split(used, np.flatnonzero(np.diff(used // SLICE)) + 1)
            moved = [a - b for a, b in zip(mine.parameters(), before, strict=True)]
            names = [int(p[0] // SLICE) for p in parts] + [-1]
            ids = [p.astype("<i4").tobytes() for p in parts] + [b""]
            values = [np.concatenate([m[p] for m in moved[:tables]], axis=1) for p in parts]
            values = [v.tobytes() for v in values]
            values.append(np.concatenate([m.ravel() for m in moved[tables:]]).tobytes())
            return pa.table({"part": names, "shard": [shard] * len(names),
                             "ids": pa.array(ids, pa.binary()),
                             "moved": pa.array(values, pa.binary())})

        schema = "part long, shard long, ids binary, moved binary"
        tuned = dealt(texts, turn, shards).groupBy("shard").applyInArrow(run, schema)
        collected = added_up(tuned, shards, tables).collect()
        sent.destroy()  # on the driver as well, or every round leaves a model there
        return collected

    for turn in range(ROUNDS):
        params = model.parameters()
        for part, _, times, moved in round_of(turn):
            values = np.frombuffer(moved, np.float64)
            times = np.frombuffer(times, np.int64)
            if part < 0:
                values = values / times
                at = 0
                for p in params[tables:]:
                    p += values[at : at + p.size].reshape(p.shape)
                    at += p.size
                continue
            values = values.reshape(SLICE, -1) / np.maximum(times, 1)[:, None]
            values = values.reshape(SLICE, tables, -1)
            rows = slice(part * SLICE, min((part + 1) * SLICE, VOCABULARY))
            for k, p in enumerate(params[:tables]):
                p[rows] += values[: len(p[rows]), k]
    attention.bound(model)
    return model


def added_up(tuned: DataFrame, shards: int, tables: int) -> DataFrame:
    """One row per part: part, shard, times, moved; sums over all shards of ``tuned``.

    ``times`` says how many shards have each row of the part. Shards are added up FAN_IN at a
    time, then those sums, until one is left.
    """
    width = tables * attention.WIDTH

    def add(frame: pa.Table) -> pa.Table:
        frame = frame.sort_by("shard")
        part = frame.column("part")[0].as_py()
        total, times = 0.0, 0
        for row in frame.to_pylist():
            if row.get("times") is not None:  # a sum of shards
                values = np.frombuffer(row["moved"], np.float64)
                often = np.frombuffer(row["times"], np.int64)
            elif part < 0:
                values = np.frombuffer(row["moved"], np.float32).astype(np.float64)
                often = np.ones(1, np.int64)
            else:
                at = np.frombuffer(row["ids"], "<i4") - part * SLICE
                values, often = np.zeros((SLICE, width)), np.zeros(SLICE, np.int64)
                values[at] = np.frombuffer(row["moved"], np.float32).reshape(-1, width)
                often[at] = 1
                values = values.ravel()
            total, times = total + values, times + often
        return pa.table(
            {"part": pa.array([part], pa.int64()),
             "shard": pa.array([frame.column("shard")[0].as_py() // FAN_IN], pa.int64()),
             "times": pa.array([times.tobytes()], pa.binary()),
             "moved": pa.array([total.tobytes()], pa.binary())}
        )

    sums, left = tuned, shards
    while True:
        group = F.floor(F.col("shard") / FAN_IN)
        sums = sums.groupBy("part", group).applyInArrow(
            lambda frame: add(frame), "part long, shard long, times binary, moved binary"
        )
        left = -(-left // FAN_IN)
        if left == 1:
            return sums


class _Words:
    """The words of a block by place: smoothed share, whether known, and subword ids."""

    def __init__(self, frame: pa.Table, total: int, distinct: int):
        held = [
            _unpressed(data, ("<u4", n), ("<i8", n), ("<u4", n), ("<u2", n_ids))
            for n, n_ids, data in zip(
                *(frame.column(c).to_pylist() for c in ("words", "n_ids", "data")), strict=True
            )
        ]
        places = [np.cumsum(h[0], dtype=np.int64) for h in held]
        place = np.concatenate([*places, np.zeros(0, np.int64)])
        counts = np.zeros(len(place), np.int64)
        self.size, self.start = counts.copy(), counts.copy()
        size = np.concatenate([*(h[2] for h in held), np.zeros(0, "<u4")]).astype(np.int64)
        counts[place] = np.concatenate([*(h[1] for h in held), np.zeros(0, np.int64)])
        self.size[place], self.start[place] = size, np.cumsum(size) - size
        self.flat = np.concatenate([*(h[3] for h in held), np.zeros(0, "<u2")])
        self.known = counts > 0
        self.share = np.log10((counts + 1) / (total + distinct + 1))

    def ids(self, places: np.ndarray) -> np.ndarray:
        """Subword ids of a sequence of words."""
        size = self.size[places]
        shift = self.start[places] - (np.cumsum(size) - size)
        return self.flat[np.repeat(shift, size) + np.arange(size.sum())]


def score(
    docs: DataFrame, tokenizer: str | None = None, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are not read).

    held_out, n_tokens, n_known, train_tokens, base_score: words and one end per text, with
    counts over all training text. score: log10 probability of the subword ids of all words and
    of the end under the attention model alone; word counts have no part in it.

    A null text is an empty one: it has the end token alone. A null doc_id is neither trained
    on nor held out. Repeated rows come back as often as they came. Without training text all
    words are unknown and the model is uniform over its classes. No rows give no rows.
    """
    path = tokenizer or default_path(TOKENIZER)
    session = docs.sparkSession
    target = f"{scratch_folder(session)}/llm-ids-{uuid.uuid4().hex}"
    # Blocks and words are of no use any more when the ids of all texts are written.
    with scratch_run(session):
        rows = blocked(docs, block_bytes)
        vocabulary = settled(packed_words(rows, path), "words")
        n_words, n_distinct = vocabulary.agg(F.sum("total"), F.sum("distinct")).first()
        texts = rows.where("trained").count()
        total = (n_words or 0) + texts
        distinct = (n_distinct or 0) + (texts > 0)
        counts = id_counts(vocabulary)
        counts[END] += texts
        ids = encoded(rows, vocabulary, total, distinct)
        ids.write.parquet(target)
    found = session.read.schema(ids.schema).parquet(target)
    model = fitted(found, counts)
    end_share = float(np.log10((texts + 1) / (total + distinct + 1)))
    sent = session.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        column = dict(zip(batch.schema.names, batch.columns, strict=True))
        n = len(batch)
        length = pc.binary_length(column["ids"]).to_numpy(False).astype(np.int64) // 2
        ids = np.frombuffer(b"".join(column["ids"].to_pylist()), "<u2")
        inputs, targets, ids_at, ends_at = attention.placed(ids, length, START, END)
        each = sent.value.score(inputs, targets).ravel()
        sums = np.bincount(np.repeat(np.arange(n), length), each[ids_at], n) + each[ends_at]
        base = column["base_score"].to_numpy(False) + end_share
        yield pa.RecordBatch.from_arrays(
            [
                column["doc_id"],
                column["held_out"],
                pc.add(column["n_words"], 1),
                pc.add(column["n_known"], int(texts > 0)),
                pa.array(np.full(n, total, np.int64)),
                pa.array(base),
                pa.array(sums),
            ],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score",
                   "score"],
        )

    return map_arrow(
        found.select("doc_id", "held_out", "n_words", "n_known", "base_score", "ids"),
        run,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double",
        GROUP,
    )


def op9(spark: SparkSession, folder: str) -> DataFrame:
    return score(table(spark, folder, "documents"))
