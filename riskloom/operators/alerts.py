"""Alerts when the risk level of a call rises to medium or high."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scoring import level_rank


KEEP_MS = 6 * 3600 * 1000


def rises(
    windows: DataFrame, call: str, start: str, end: str, level: str, span: str = "1 day", keep_ms: int = KEEP_MS
) -> DataFrame:
    """Windows whose level is medium or high and above the previous window of that call.

    The first window of a call counts as following a low one, and so does a window that starts
    more than `keep_ms` after the end of the one before. A call is cut into spans
    of time, so a call holding a third of all windows is many small groups: the previous
    level is looked up inside the span, and the first window of a span takes it from the
    last window of the span before, one row per span. `windows` is read twice, so hand in
    a stored table rather than a plan that scores them.
    """
    now = F.struct(level_rank(F.col(level)).alias("rank"), F.unix_millis(end).alias("end_ms"))
    ranked = windows.withColumns({"_now": now, "_span": F.window(F.col(start), span)["start"]})
    inside = Window.partitionBy(call, "_span").orderBy(start)
    lagged = ranked.withColumn("_before", F.lag("_now").over(inside))
    ends = ranked.groupBy(call, "_span").agg(F.max_by("_now", start).alias("_last"))
    carried = ends.select(call, "_span", F.lag("_last").over(Window.partitionBy(call).orderBy("_span")).alias("_carry"))
    joined = lagged.join(carried, [call, "_span"]).withColumn("_before", F.coalesce("_before", "_carry"))
    live = F.unix_millis(start) - F.col("_before.end_ms") <= keep_ms
    before = F.when(live, F.col("_before.rank")).otherwise(0)
    return joined.filter(risen(before, F.col("_now.rank"))).select(*windows.columns)


def risen(before: Column, now: Column) -> Column:
    return (now >= 1) & (now > before)
