"""Small files and folders on whatever file system a path names, through Hadoop's file system interface."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Store:
    """Folders and small text files below a base path: local, HDFS or object store."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.jvm, self.base = spark._jvm, base.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def names(self, folder: str) -> list[str]:
        """Names in a folder, sorted; none if it isn't there."""
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a file whole under its name, or not at all; False if there is one already."""
        target, draft = self._path(name), self._path(f"{name}.{uuid.uuid4().hex}.tmp")
        if self.fs.exists(target):
            return False
        stream = self.fs.create(draft, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not self.fs.exists(target) and self.fs.rename(draft, target):
            return True
        self.fs.delete(draft, False)
        return False

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def size(self, name: str) -> int:
        """Bytes below a folder."""
        path = self._path(name)
        return self.fs.getContentSummary(path).getLength() if self.fs.exists(path) else 0
