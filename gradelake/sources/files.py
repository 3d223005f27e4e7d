"""Small steps on the shared file system, taken by the driver through Hadoop's file API."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """Files under one folder of whatever file system its path names."""

    def __init__(self, spark: SparkSession, folder: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.folder = folder.rstrip("/")
        self._system = self._path(self.folder).getFileSystem(
            spark._jsc.hadoopConfiguration()
        )

    def _at(self, name: str):
        return self._path(f"{self.folder}/{name}" if name else self.folder)

    def exists(self, name: str = "") -> bool:
        return self._system.exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        """Names in a folder, sorted; none if there is no such folder."""
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self._system.listStatus(self._at(name)))

    def stamps(self, name: str = "") -> dict[str, tuple[int, int]]:
        """Size and time of change of the files in a folder."""
        if not self.exists(name):
            return {}
        return {
            s.getPath().getName(): (s.getLen(), s.getModificationTime())
            for s in self._system.listStatus(self._at(name))
        }

    def make(self, name: str) -> None:
        """An empty file; an error if it is there already."""
        self._system.mkdirs(self._path(self.folder))
        self._system.create(self._at(name), False).close()

    def drop(self, name: str = "") -> None:
        self._system.delete(self._at(name), True)
