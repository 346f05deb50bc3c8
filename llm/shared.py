"""Row keys, tables cut into the shared folder, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A table is broadcast only if its counted rows are at most this many (of bounded width).
SMALL_ROWS = 10_000


_LOCAL: list[tempfile.TemporaryDirectory] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`.

    Only a local session may leave it unset; then a temporary folder of this machine, removed at exit,
    stands in.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.TemporaryDirectory(prefix="llm-"))
        base = _LOCAL[0].name
    return base.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """The rows of df written to the shared folder and read back: lost executors lose nothing of it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, rid1, rid2, text): two content hashes stand for a row, so that null and repeated ids are no problem.

    Rows that repeat in both columns share their key and have the same result. Null text is empty.
    """
    return docs.select(F.col(doc_id).alias("id"), *_keys(doc_id, text), _body(text).alias("text"))


def with_keys(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(row, rid1, rid2): whole rows, whatever their columns are called, beside their keys."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_keys(doc_id, text))


def _body(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def _keys(doc_id: str, text: str) -> list[Column]:
    return [F.xxhash64(F.col(doc_id), F.lit(1)).alias("rid1"), F.xxhash64(_body(text), F.col(doc_id).isNull()).alias("rid2")]


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most that many rows, else as it is (a shuffle join follows)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def held_out(doc_id: Column) -> Column:
    """Rows of the test fold: crc32 of the id as text, modulo 5, is 0 (a null id is never held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))
