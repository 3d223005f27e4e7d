"""Language identification by cross-parsing: the fewest longest matches win."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import ClassVar

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradelake.llm.common import BATCH_ROWS, fresh, id_crc, map_arrow, table

UNKNOWN = "und"
# Labelled rows drawn per language, and bytes of normalised text the automaton is made of: all
# rows give about the same share of it, in short cuts from everywhere in them.
SAMPLE_ROWS = 128
SAMPLE_BYTES = 48_000
CUT = 125
# A text is parsed in pieces of this many bytes, each on its own; all pieces count.
PIECE = 512
# Pieces parsed side by side.
LANES = 1 << 14

_LETTER = regex.compile(r"\p{L}")
_OTHER = re.compile(rb"[\x00-\x60\x7b-\x7f]+")


def normalise(text: str) -> bytes:
    """Lower-cased UTF-8; every run of ASCII characters that are no letters is one space."""
    return _OTHER.sub(b" ", text.lower().encode("utf-8", "replace"))


class Automaton:
    """Suffix automaton of a sample, as a dense table for parsing many texts at once.

    ``step[state, symbol]`` is twice the next state, plus one where a new phrase begins with the
    symbol: at the root, and where the longest match ends before it. Symbols that the sample
    lacks share the last column: they are phrases of their own and lead back to the root.
    """

    def __init__(self, sample: bytes):
        follow: list[dict[int, int]] = [{}]
        length, link, last = [0], [-1], 0
        for symbol in sample:
            new = len(follow)
            follow.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and symbol not in follow[p]:
                follow[p][symbol] = new
                p = link[p]
            if p >= 0:
                q = follow[p][symbol]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    clone = len(follow)
                    follow.append(dict(follow[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and follow[p].get(symbol) == q:
                        follow[p][symbol] = clone
                        p = link[p]
                    link[q] = link[new] = clone
            last = new
        symbols = sorted(set(sample))
        self.column = np.full(256, len(symbols), np.uint8)
        self.column[symbols] = np.arange(len(symbols))
        afresh = np.array([2 * follow[0][s] + 1 for s in symbols] + [1], np.int32)
        self.step = np.tile(afresh, (len(follow), 1))
        for state, edges in enumerate(follow):
            for symbol, target in edges.items():
                self.step[state, self.column[symbol]] = 2 * target + (state == 0)
        self.width = len(symbols) + 1

    def phrases(self, block: np.ndarray, alive: np.ndarray) -> np.ndarray:
        """Phrases per row of ``block`` (rows of bytes, longest first).

        ``alive[i]`` is the number of rows with more than i bytes.
        """
        table, width = self.step.ravel(), self.width
        columns = self.column[block.T]
        state = np.zeros(len(block), np.int32)
        count = np.zeros(len(block), np.int32)
        for symbols, rows in zip(columns, alive.tolist(), strict=True):
            found = table[state[:rows] * width + symbols[:rows]]
            count[:rows] += found & 1
            state[:rows] = found >> 1
        return count


class Models:
    """One automaton per language, built once per worker process from its sample."""

    _built: ClassVar[dict[int, Models]] = {}

    def __init__(self, samples: dict[str, bytes]):
        self.names = sorted(samples)
        self.automata = [Automaton(samples[name]) for name in self.names]

    @classmethod
    def shared(cls, samples: dict[str, bytes]) -> Models:
        key = hash(tuple(sorted(samples.items())))
        if key not in cls._built:
            cls._built = {key: cls(samples)}
        return cls._built[key]

    def identify(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text."""
        data = [
            normalise(t) if t and self.names and _LETTER.search(t) else b"" for t in texts
        ]
        sizes = np.array([len(d) for d in data], np.int64)
        counts = np.zeros((len(self.names), len(data)))
        pieces = -(-sizes // PIECE)
        owner = np.repeat(np.arange(len(data)), pieces)
        first = np.cumsum(pieces) - pieces
        start = (np.cumsum(sizes) - sizes)[owner] + PIECE * (np.arange(len(owner)) - first[owner])
        extent = np.minimum(PIECE, (np.cumsum(sizes))[owner] - start)
        flat = np.frombuffer(b"".join(data) + bytes(PIECE), np.uint8)
        order = np.argsort(-extent, kind="stable")
        for at in range(0, len(order), LANES):
            lane = order[at : at + LANES]
            longest = int(extent[lane[0]])
            block = flat[start[lane][:, None] + np.arange(longest)]
            alive = np.searchsorted(-extent[lane], -np.arange(longest), side="left")
            for k, automaton in enumerate(self.automata):
                np.add.at(counts[k], owner[lane], automaton.phrases(block, alive))
        names, scores = [], []
        for k, size in enumerate(sizes):
            if not size:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            ranked = sorted(zip(counts[:, k].tolist(), self.names, strict=True))
            second = ranked[1][0] if len(ranked) > 1 else float(size)
            names.append(ranked[0][1])
            scores.append(max(0.0, 1.0 - ranked[0][0] / second))
        return names, scores


def training_rows(docs: DataFrame) -> DataFrame:
    """Labelled rows a model may learn from: crc32(doc_id as text) mod 3 is not 1."""
    return docs.where((id_crc(F.col("doc_id")) % 3 != 1) & F.col("lang").isNotNull())


def cuts(text: Column, doc_id: Column, wanted: Column) -> Column:
    """Up to ``wanted`` pieces of CUT characters of a text, drawn by hash from all of it."""
    last = F.floor((F.length(text) - 1) / CUT).cast("int")
    drawn = F.array_sort(
        F.transform(
            F.sequence(F.lit(0), last),
            lambda c: F.struct(F.xxhash64(F.lit("cut"), doc_id, c).alias("h"), c.alias("c")),
        )
    )
    return F.transform(
        F.slice(drawn, 1, wanted), lambda p: F.substring(text, p["c"] * CUT + 1, F.lit(CUT))
    )


def learn(
    docs: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES
) -> dict[str, bytes]:
    """A sample of normalised text per language.

    Of each language the ``sample_rows`` training rows with a letter and the smallest hashed ids
    are drawn (an id with two texts is two rows, equal rows are one). Each gives an equal number
    of cuts from places drawn by hash, as many as fill ``sample_bytes``; of a short text that is
    all of it. So neither one long text nor the beginnings of texts make up a sample. Spark keeps
    only so many rows per language and task before it shuffles, so a language with most of the
    rows is no burden; at most ``sample_bytes`` and a cut per row and label reach the driver.
    """
    rank = F.xxhash64(F.lit("language"), "doc_id")
    mark = F.xxhash64("text").alias("mark")
    lettered = training_rows(docs).where(F.col("text").rlike(r"\p{L}"))
    keyed = lettered.select("lang", "doc_id", mark, rank.alias("rank"))
    window = Window.partitionBy("lang").orderBy("rank", "doc_id", "mark")
    # Equal rows have equal ranks, so a dense rank counts them once.
    ranked = keyed.withColumn("n", F.dense_rank().over(window)).where(F.col("n") <= sample_rows)
    chosen = {(r.lang, r.doc_id, r.mark): r.n for r in ranked.distinct().collect()}
    if not chosen:
        return {}
    rows = Counter(lang for lang, _, _ in chosen)
    shares = F.create_map(
        *[F.lit(v) for lang, n in rows.items() for v in (lang, -(-sample_bytes // (CUT * n)))]
    )
    ids = list({doc_id for _, doc_id, _ in chosen})
    pieces = lettered.where(F.col("doc_id").isin(ids)).select(
        "lang", "doc_id", mark,
        cuts(F.col("text"), F.col("doc_id"), F.element_at(shares, F.col("lang"))).alias("cuts"),
    )
    parts: dict[str, dict[int, bytes]] = defaultdict(dict)
    for lang, doc_id, found, texts in pieces.toLocalIterator():
        if (n := chosen.get((lang, doc_id, found))) is not None:
            parts[lang][n] = b" ".join(normalise(t) for t in texts)
    return {lang: b" ".join(t for _, t in sorted(texts.items())) for lang, texts in parts.items()}


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``.

    Learned from text and lang of the training rows of ``docs`` itself; a prediction sees only
    the text. Texts that are null or have no letter are ``und`` with score 0, and so is every
    text when there is nothing to learn from. The score is 1 - fewest / second fewest phrases
    (with one language: 1 - phrases / bytes). Of equal phrase counts the first language by name
    wins. A null doc_id is not held out and not learned from. Other columns are not read.

    A text is parsed whole, in pieces of PIECE bytes side by side; where a piece begins a phrase
    begins, in every language alike.
    """
    samples = learn(docs)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names, scores = Models.shared(samples).identify(batch.column(2).to_pylist())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(names), pa.array(scores)],
            names=["doc_id", "held_out", "lang_pred", "score"],
        )

    rows = docs.select(
        F.col("doc_id").cast("bigint"),
        F.coalesce(id_crc(F.col("doc_id")) % 3 == 1, F.lit(False)).alias("held_out"),
        F.col("text"),
    )
    return map_arrow(
        rows, run, "doc_id long, held_out boolean, lang_pred string, score double"
    )


def language_column(docs: DataFrame, text: Column) -> Column:
    """Predicted language of ``text``, by models learned from ``docs``."""
    samples = learn(docs)

    @F.pandas_udf("string")
    def predict(texts: pd.Series) -> pd.Series:
        found: list[str] = []
        for at in range(0, len(texts), BATCH_ROWS):
            part = texts.iloc[at : at + BATCH_ROWS].tolist()
            found += Models.shared(samples).identify(part)[0]
        return pd.Series(found, dtype=object)

    return predict(text)


def keep_known_language(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, whose language is identified.

    That is every row whose text has a letter, as ``identify`` names the nearest language however
    far it is; null, blank and letterless texts go, and all rows when nothing could be learned
    from. Repeated rows and null ids are kept like others. Columns may have any name.
    """
    name = fresh(docs, "language")
    known = docs.withColumn(name, language_column(docs, docs["text"]))
    return known.where(F.col(name) != UNKNOWN).drop(name)


def op4(spark: SparkSession, folder: str) -> DataFrame:
    return identify(table(spark, folder, "documents"))
