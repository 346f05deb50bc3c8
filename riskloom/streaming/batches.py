"""A table made of numbered micro-batches, each of which appears whole or not at all.

What a micro-batch writes goes to a folder of its own attempt first. One rename makes it
the batch's folder; its name is the entry of the manifest. A repeated micro-batch finds the
folder of its number and writes nothing, and what a lost attempt left is never read. The
folder's file system must rename a folder in one step (HDFS and POSIX do; for an object
store put the table on a file system that does).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, types as T

from ..files import Folder


class BatchTable:
    """Batches of rows of one schema under a path, readable as a table and as a stream."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._files = Folder(spark, path)
        for folder in ("rows", "attempts"):
            self._files.make(folder)

    def has(self, number: int) -> bool:
        return self._files.has(f"rows/batch={number}")

    def numbers(self) -> list[int]:
        """The batches there are; the manifest."""
        return sorted(int(name.split("=")[1]) for name in self._files.names("rows"))

    def add(self, number: int, rows: Callable[[], DataFrame], by: str | None = None) -> bool:
        """Store the rows of a batch unless it is stored; says whether they were.

        `by`: rows of equal values lie in one file. One writer at a time, as a streaming query is.
        """
        if self.has(number):
            return False
        attempt = f"attempts/{number}-{uuid.uuid4().hex}"
        out = rows().select(*self.schema.names)
        (out.repartition(by) if by else out).write.parquet(f"{self.path}/{attempt}")
        if not self._files.move(attempt, f"rows/batch={number}"):
            raise OSError(f"batch {number} of {self.path} could not be stored")
        return True

    def add_streamed(self, number: int, batch: DataFrame, made: Callable[[DataFrame], DataFrame] = lambda df: df) -> bool:
        """Store what is made of a micro-batch. It is computed once, and also if it is stored already: state goes on with it."""
        batch.persist()
        try:
            if self.add(number, lambda: made(batch)):
                return True
            batch.write.format("noop").mode("overwrite").save()
            return False
        finally:
            batch.unpersist()

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows").select(*self.schema.names)

    def stream(self) -> DataFrame:
        """The batches as a stream. A micro-batch takes all batches stored since the last one, whole.

        Files are not counted per trigger on purpose: half a batch would move the watermark past the rest.
        """
        return self.spark.readStream.schema(self.schema).parquet(f"{self.path}/rows").select(*self.schema.names)
