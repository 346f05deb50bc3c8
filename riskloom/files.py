"""Folders of whatever file system a path names."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._at().getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def has(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def make(self, name: str = "") -> None:
        self._fs.mkdirs(self._at(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(name))) if self.has(name) else []

    def move(self, name: str, to: str) -> bool:
        return self._fs.rename(self._at(name), self._at(to))

    def drop(self, name: str) -> None:
        self._fs.delete(self._at(name), True)
