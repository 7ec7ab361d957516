"""Files and folders below a root, through the file system that Spark itself uses for it."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.path = self._path(self.root)
        self.fs = self.path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))

    def _names(self, *parts: str) -> list[str]:
        path = self._path(self.root, *parts)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def _text(self, *parts: str) -> str:
        stream = self.fs.open(self._path(self.root, *parts))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _rename(self, old: str, new: str) -> None:
        """A file system may report a failure by its result alone. Nothing is ever renamed over another."""
        target = self._path(self.root, new)
        if self.fs.exists(target) or not self.fs.rename(self._path(self.root, old), target):
            raise OSError(f"{old} could not become {new} in {self.root}")

    def _delete(self, *parts: str) -> None:
        self.fs.delete(self._path(self.root, *parts), True)

    def _put(self, text: str, *parts: str) -> None:
        """A whole file or none: written beside its place and renamed."""
        aside = f"{parts[0]}/_{uuid.uuid4().hex}"
        stream = self.fs.create(self._path(self.root, aside), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self._rename(aside, "/".join(parts))
