"""Token counts of whole texts, huge ones by overlap resynchronisation."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.llm.common import map_arrow, table
from gradelake.llm.vocab import MEMO_WORDS, default_path, load_tokenizer

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
# Characters of a chunk of a huge text, and by how much chunks overlap at first.
CHUNK = 1 << 15
OVERLAP = 256

# White space other than a lone blank or line feed between two other characters.
_UNEVEN = re.compile(r"[^\S \n]|\s\s|^\s|\s$|[\x1c-\x1f]")
# Letters that every Unicode version knows as letters.
_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]+")


class Counter:
    """Counts of a byte-level BPE tokenizer.

    Its tokens never reach over the boundaries that its pattern draws between words, marks and
    white space, and the pattern looks at no character before a boundary and at one after it.
    """

    _workers: ClassVar[dict[str, Counter]] = {}

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        # Byte-level vocabularies write a blank as U+0120 and a line feed as U+010A.
        self.opens = {
            " ": np.array([n.startswith("Ġ") for n in names]),
            "\n": np.array([n == "Ċ" for n in names]),
        }
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.guard = max([2, *(len(t.content) for t in added)])
        self.memo: dict[str, int] = {}

    @classmethod
    def shared(cls, path: str) -> Counter:
        """The counter of this worker process; it outlives tasks."""
        if path not in cls._workers:
            cls._workers[path] = cls(path)
        return cls._workers[path]

    def count(self, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
        """Tokens of each text, special strings inside it counted as the library does."""
        totals = [0] * len(texts)
        even, uneven = [], []
        for k, text in enumerate(texts):
            if len(text) > chunk:
                totals[k] = self.resynchronised(text, chunk, overlap)
            elif text:
                (uneven if _UNEVEN.search(text) else even).append(k)
        whole = self._encode([texts[k] for k in uneven])
        for k, encoding in zip(uneven, whole, strict=True):
            totals[k] = len(encoding)
        for k, total in zip(even, self._by_word([texts[k] for k in even]), strict=True):
            totals[k] = total
        return totals

    def _encode(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def _by_word(self, texts: list[str]) -> list[int]:
        """Counts of texts whose words are parted by single blanks and line feeds.

        Before a single blank, and on both sides of a single line feed, there always is a
        boundary, so the text is the sum of its words, each with the blank or line feed before
        it, and each different word is encoded once.
        """
        if len(self.memo) > MEMO_WORDS:
            self.memo = {}
        memo = self.memo
        split = [("\n" + t).replace("\n", " \n")[1:].split(" ") for t in texts]
        counts = [list(map(memo.get, words)) for words in split]
        partial = [k for k, found in enumerate(counts) if None in found]
        unknown = {
            w for k in partial for w, n in zip(split[k], counts[k], strict=True) if n is None
        }
        # A full stop or comma after a letter is a token of its own.
        stems = {
            w: w[:-1] if w[-1] in ".," and _LATIN.fullmatch(w[-2:-1]) else w for w in unknown
        }
        self._learn(list(set(stems.values()).difference(memo)))
        for word, stem in stems.items():
            memo[word] = memo[stem] + (len(stem) < len(word))
        for k in partial:
            found = counts[k]
            for at, word in enumerate(split[k]):
                if found[at] is None:
                    found[at] = memo[word]
        return [sum(found) - 1 for found in counts]  # the line feed put before the text

    def _learn(self, words: list[str]) -> None:
        rest = []
        groups: dict[str, list[str]] = {" ": [], "\n": []}
        for word in words:
            first = "\n" if word[0] == "\n" else " "
            letters = word[1:] if first == "\n" else word
            (groups[first] if _LATIN.fullmatch(letters) else rest).append(word)
        for first, members in groups.items():
            joined = "".join(w if first == "\n" else " " + w for w in members)
            ids = np.array(self._encode([joined])[0].ids, np.int64)
            starts = np.flatnonzero(self.opens[first][ids]) if members else ids
            if len(starts) == len(members):
                ends = np.append(starts[1:], len(ids))
                self.memo.update(zip(members, (ends - starts).tolist(), strict=True))
            else:
                rest += members
        spaced = [w if w[0] == "\n" else " " + w for w in rest]
        for word, encoding in zip(rest, self._encode(spaced), strict=True):
            self.memo[word] = len(encoding)

    def _boundaries(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """Positions of word boundaries, tokens before each, and all tokens."""
        encoding = self.tokenizer.encode(text, add_special_tokens=False)
        if not len(encoding):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        word = np.array([-1 if w is None else w for w in encoding.word_ids])
        start = np.array([a for a, _ in encoding.offsets])
        first = np.append(True, (word[1:] != word[:-1]) | (word[1:] < 0))
        before = np.flatnonzero(first)
        return start[before], before, len(word)

    def resynchronised(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """Tokens of a long text, encoded in chunks that overlap.

        A chunk that begins anywhere is out of step at first. Where a boundary of it is also one
        of the chunk before, both go on alike, so there they are spliced. A boundary counts for
        the earlier chunk only if it is far enough from its cut end for that to have no effect.
        If an overlap has no such boundary it is widened, in the end to the rest of the text.
        """
        total, begin, since = 0, 0, 0  # since: tokens of the chunk that are already counted
        while True:
            width = overlap
            while True:
                stop = begin + chunk + width
                places, before, size = self._boundaries(text[begin:stop])
                if stop >= len(text):
                    return total + size - since
                after, skipped, _ = self._boundaries(text[begin + chunk : begin + 2 * chunk + width])
                inside = (places > chunk) & (places <= chunk + width - self.guard)
                common = np.intersect1d(places[inside] - chunk, after[after > 0])
                if len(common):
                    break
                width *= 4
            at = common[0]
            total += int(before[places == at + chunk][0]) - since
            since = int(skipped[after == at][0])
            begin += chunk


def counted(
    docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT, chunk: int = CHUNK
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs``.

    A null text is an empty one, with no tokens. Repeated rows come back as often as they came;
    a null doc_id stays null; no rows give no rows. Other columns are not read.
    """
    path = tokenizer or default_path(TOKENIZER)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        totals = Counter.shared(path).count([t or "" for t in batch.column(2).to_pylist()], chunk)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(totals, pa.int64())],
            names=["doc_id", "n_bytes", "n_tokens"],
        )

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    rows = docs.select(F.col("doc_id").cast("bigint"), size.alias("n_bytes"), "text")
    found = map_arrow(rows, run, "doc_id long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)


def op8(spark: SparkSession, folder: str) -> DataFrame:
    return counted(table(spark, folder, "documents"))
