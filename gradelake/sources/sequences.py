"""Ids that are never given out twice."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from gradelake.sources.files import Files


class ConcurrentInsert(RuntimeError):
    """Two inserts into one table at the same time."""


class IdSequence:
    """The highest id that was ever given to a row of a table.

    Inserts advance it, deletes leave it, and only ``reset`` takes it back, so the id of a
    deleted row never returns. The mark is kept in ``folder`` as the name of an empty file, which
    appears in one step. It is advanced before rows are written: a failed insert leaves a gap,
    never a second use. One insert at a time is expected; two that meet are told so.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self._files = Files(spark, folder)

    def _marks(self) -> list[tuple[int, int, str]]:
        """(version, last id, name), newest last."""
        found = []
        for name in self._files.names():
            parts = name.split("-")
            if len(parts) == 4 and parts[0] == "mark":
                found.append((int(parts[1]), int(parts[2]), name))
        return sorted(found)

    def last(self) -> int:
        marks = self._marks()
        return marks[-1][1] if marks else 0

    def _put(self, last: int) -> None:
        marks = self._marks()
        version = marks[-1][0] + 1 if marks else 1
        name = f"mark-{version:012d}-{last:020d}-{uuid.uuid4().hex}"
        self._files.make(name)
        if any(v >= version and other != name for v, _, other in self._marks()):
            self._files.drop(name)
            raise ConcurrentInsert("another insert reserved ids at the same time")
        for _, _, old in marks:
            self._files.drop(old)

    def reserve(self, count: int, at_least: int = 0) -> int:
        """The id before a block of ``count`` new ones, which is above ``at_least`` too.

        ``at_least`` is the highest id stored, for a table that is older than its sequence.
        """
        if count < 0:
            raise ValueError("count is negative")
        start = max(self.last(), at_least)
        if start + count > self.last():
            self._put(start + count)
        return start

    def reset(self) -> None:
        """Ids begin at 1 again; for a table that was cleared."""
        if self.last():
            self._put(0)
