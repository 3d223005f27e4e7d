"""Public tokenizer files and a memo of the ids of words."""

from __future__ import annotations

import os
import re
from array import array
from typing import ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Words remembered per Python worker; the memo is emptied when it is full and fills anew.
MEMO_WORDS = 800_000
# Mark of a token that ends a run of letters.
WORD_END = "</w>"

# Control characters that Python alone counts as white space.
_CONTROL = re.compile(r"[\x1c-\x1f]")
# A mark before a full stop or comma; the underscore is one, though \w has it.
_MARKS = re.compile(r"(?:[^\w\s]|_)[.,]")
_SPACE = re.compile(r"[ \n\t\r]+")


def default_path(name: str) -> str:
    """Path of a vocabulary file in the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordIds:
    """Ids of texts under a tokenizer that drops white space and never joins words over it.

    Such a tokenizer gives a text the ids of its words, one after the other, so each different
    word is encoded once. The tokenizers this is used with also lower-case, never join letters
    to punctuation, and mark the last token of a run of letters, so a word is looked up in lower
    case and without a full stop or comma after a letter, and words of letters only are encoded
    together and cut at the marks. Ids are kept as little-endian unsigned 32-bit bytes.
    """

    _workers: ClassVar[dict[tuple[str, int], WordIds]] = {}

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        self.tokenizer = load_tokenizer(path)
        self.memo_words = memo_words
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends = np.array(
            [(self.tokenizer.id_to_token(i) or "").endswith(WORD_END) for i in range(size)]
        )
        self.memo: dict[str, bytes] = {}
        self._forget()

    @classmethod
    def shared(cls, path: str, memo_words: int = MEMO_WORDS) -> WordIds:
        """The memo of this worker process; it outlives tasks."""
        key = (path, memo_words)
        if key not in cls._workers:
            cls._workers[key] = cls(path, memo_words)
        return cls._workers[key]

    def _forget(self) -> None:
        self.memo = {"": b""}
        self._learn([".", ","])

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters, and where those of each word end if all is well."""
        joined = self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)
        ids = np.array(joined[0].ids, "<u4")
        return ids, np.flatnonzero(self.ends[ids]) + 1 if len(ids) else ids

    def _learn(self, words: list[str]) -> None:
        letters = [w for w in words if w.isalpha()]
        ids, cuts = self._letters(letters)
        if len(cuts) == len(letters):
            data, start = ids.tobytes(), 0
            for word, end in zip(letters, (4 * cuts).tolist(), strict=True):
                self.memo[word] = data[start:end]
                start = end
            words = [w for w in words if not w.isalpha()]
        others = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        for word, encoding in zip(words, others, strict=True):
            self.memo[word] = array("I", encoding.ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Id bytes of each text."""
        if len(self.memo) > self.memo_words:
            self._forget()
        memo = self.memo
        texts = [self._plain(text) for text in texts]
        split = [_SPACE.split(t) if _CONTROL.search(t) else t.split() for t in texts]
        ids = [list(map(memo.get, words)) for words in split]
        partial = [k for k, found in enumerate(ids) if None in found]
        unknown = {
            word for k in partial for word, i in zip(split[k], ids[k], strict=True) if i is None
        }
        bare = {word: self._bare(word) for word in unknown}
        self._learn(list(set(bare.values()).difference(memo)))
        for word, stem in bare.items():
            memo[word] = memo[stem] + memo[word[-1]] if len(stem) < len(word) else memo[stem]
        for k in partial:
            found = ids[k]
            for at, word in enumerate(split[k]):
                if found[at] is None:
                    found[at] = memo[word]
        return [b"".join(found) for found in ids]

    def each(self, words: pa.Array) -> pa.Array:
        """Id bytes of each of many different words, as ``encode`` gives them.

        Words of letters, and those with a full stop or comma at the end, are not remembered.
        """
        stems = pc.utf8_rtrim(words, ".,")
        marks = (pc.binary_length(words).to_numpy(False) - pc.binary_length(stems).to_numpy(False))
        plain = pc.utf8_is_alpha(stems).to_numpy(False) & (marks <= 1)
        found = stems.filter(pa.array(plain)).dictionary_encode()
        ids, cuts = self._letters(found.dictionary.to_pylist())
        if len(cuts) != len(found.dictionary):
            return pa.array(self.encode(words.to_pylist()), pa.binary())
        others = self.encode(words.filter(pa.array(~plain)).to_pylist())
        # Where the ids of each word lie: first those of the stems, then those of the others.
        flat = np.concatenate([ids, np.frombuffer(b"".join(others), "<u4")])
        stem_size = np.diff(cuts, prepend=0)
        other_size = np.fromiter(map(len, others), np.int64, len(others)) // 4
        size, start = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        of = found.indices.to_numpy()
        size[plain], start[plain] = stem_size[of], (cuts - stem_size)[of]
        size[~plain] = other_size
        start[~plain] = len(ids) + np.cumsum(other_size) - other_size
        marked = plain & (marks == 1)
        ends = np.cumsum(size + marked)
        begin = ends - size - marked
        out = np.empty(ends[-1] if len(ends) else 0, "<u4")
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(begin, size) + step] = flat[np.repeat(start, size) + step]
        stop = pc.ends_with(words.filter(pa.array(marked)), ".").to_numpy(False)
        stop_id, comma_id = (int(np.frombuffer(self.memo[m], "<u4")[0]) for m in ".,")
        out[ends[marked] - 1] = np.where(stop, stop_id, comma_id)
        offsets = 4 * np.concatenate([[0], ends]).astype("<i4")
        buffers = [None, pa.py_buffer(offsets), pa.py_buffer(out)]
        return pa.BinaryArray.from_buffers(pa.binary(), len(words), buffers)

    @staticmethod
    def _plain(text: str) -> str:
        """``text`` with fewer different words and the same ids."""
        if "<|" in text:  # special tokens are told apart by case
            return text
        try:
            text.encode("latin-1")  # letters whose lower case does not depend on the library
        except UnicodeEncodeError:
            return text
        text = text.lower()
        if _MARKS.search(text):  # runs of marks are tokens of their own
            return text
        for mark in (". ", ".\n"):
            text = text.replace(mark, " . ")
        for mark in (", ", ",\n"):
            text = text.replace(mark, " , ")
        return text

    @staticmethod
    def _bare(word: str) -> str:
        if "<|" in word:  # special tokens are told apart by case
            return word
        try:
            word.encode("latin-1")  # letters whose lower case does not depend on the library
        except UnicodeEncodeError:
            return word
        word = word.lower()
        return word[:-1] if word[-1] in ".," and word[-2:-1].isalpha() else word
