"""First-seen-wins and last-seen-wins by key, safe for very hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def first_per_key(df: DataFrame, key: Column, order: Column) -> DataFrame:
    """One row per key: the one with the smallest `order`. `order` must be unique per key.

    An aggregate and not a window: each task reduces its copies of a key to one row
    before the shuffle, so a key holding a third of the table sends one row per task.
    """
    return _pick(df, key, order, F.min_by)


def last_per_key(df: DataFrame, key: Column, order: Column) -> DataFrame:
    """One row per key: the one with the largest `order`."""
    return _pick(df, key, order, F.max_by)


def _pick(df: DataFrame, key: Column, order: Column, choose) -> DataFrame:
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(key.alias("_key")).agg(choose(row, order).alias("_row")).select("_row.*")


def content_key(text_hash: Column, row_id: Column) -> Column:
    """Dedup key: the hash, or the row itself where the hash is empty or null."""
    return F.when(
        F.coalesce(text_hash, F.lit("")) == "", F.concat(F.lit("row:"), row_id.cast("string"))
    ).otherwise(text_hash)


#: Up to so many rows to check, their hashes are sent to the known ones; a hash is 64 characters.
FEW = 200_000


def unseen(df: DataFrame, known: DataFrame, column: str = "raw_text_hash", few: int = FEW) -> DataFrame:
    """Rows whose hash is not in `known`; an empty or null hash is never excluded.

    A batch is small beside what is stored. Its hashes, if its rows are counted as few, go to where the known
    ones lie, and only those that meet come back: the stored side is read but not shuffled. Counting needs no
    column of `df`. A larger batch meets the known hashes in a shuffle join.
    """
    seen = known.filter(F.col(column) != "").select(F.col(column).alias("_seen"))
    if df.select(F.lit(1)).limit(few + 1).count() <= few:
        mine = df.filter(F.col(column) != "").select(F.col(column).alias("_mine")).distinct()
        seen = seen.join(F.broadcast(mine), F.col("_seen") == F.col("_mine"), "left_semi").distinct()
    return df.join(seen, (df[column] == F.col("_seen")) & (df[column] != ""), "left_anti")
