"""Small files of an index on any Hadoop file system: manifests swapped by rename, a lock that one writer holds."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

STALE_LOCK = 6 * 3600  # seconds after which a lock is taken over


class Store:
    """A folder by URI (a bare path is one of the default file system)."""

    def __init__(self, spark: SparkSession, base: str):
        self.base, self._jvm, self._conf = base.rstrip("/") or "/", spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)
        return path.getFileSystem(self._conf), path

    def exists(self, name: str = "") -> bool:
        fs, path = self._at(name)
        return fs.exists(path)

    def read(self, name: str) -> str:
        fs, path = self._at(name)
        stream = fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """The whole text or, for readers, still what was there: written beside and renamed."""
        fs, path = self._at(name)
        beside = self._at(name + ".new")[1]
        stream = fs.create(beside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self._conf) if path.toUri().getScheme() else self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._conf)
        options = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        context.rename(beside, path, options)

    def remove(self, name: str) -> None:
        fs, path = self._at(name)
        fs.delete(path, True)

    def size(self, name: str) -> int:
        fs, path = self._at(name)
        return fs.getContentSummary(path).getLength() if fs.exists(path) else 0

    @contextmanager
    def locked(self, error: Exception) -> Iterator[None]:
        """One writer at a time: a file that only one can create. A lock left by a lost writer is taken over in the end."""
        fs, path = self._at("writer.lock")
        fs.mkdirs(self._at("")[1])
        if fs.exists(path) and time.time() - fs.getFileStatus(path).getModificationTime() / 1000 > STALE_LOCK:
            fs.delete(path, False)
        try:
            fs.create(path, False).close()
        except Exception as e:  # noqa: BLE001  the file system says in its own way that the file is there
            raise error from e
        try:
            yield
        finally:
            fs.delete(path, False)
