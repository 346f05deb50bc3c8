"""Bounded samples of labelled documents to fit classifiers on."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.shared import held_out

#: Rows of each class that a classifier is fitted on, and the longest text among them (in characters).
PER_CLASS, LONGEST = 1500, 10_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, doc_id: str = "doc_id", text: str = "text", per_class: int = PER_CLASS, longest: int = LONGEST) -> DataFrame | None:
    """(text, y) of training rows: for each label (a few whole numbers), those with the smallest hashes of their ids.

    Rows of the test fold (`held_out`) and rows without id, label or text are left out. An id with
    several labels has the largest. At most a hundred labels and per_class rows of each are taken.
    None if there is no label.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).where(~held_out(F.col(doc_id)))
    known = known.groupBy(F.col(doc_id).alias("key")).agg(F.max(label).cast("int").alias("y"))
    body = docs.where(F.length(text).between(1, longest)).select(F.col(doc_id).alias("key"), F.col(text).alias("text"))
    out = None
    for y in sorted(r["y"] for r in known.select("y").distinct().limit(100).collect()):
        some = known.where(F.col("y") == y).orderBy(F.xxhash64("key"), "key").limit(per_class)
        rows = body.join(F.broadcast(some), "key").orderBy(F.xxhash64("key", "text")).limit(per_class).select("text", "y")
        out = rows if out is None else out.unionByName(rows)
    return out


def graded_sample(docs: DataFrame, labels: DataFrame, label: str, doc_id: str = "doc_id", text: str = "text", rows: int = 2 * PER_CLASS, longest: int = LONGEST) -> DataFrame:
    """(text, y) of training rows over all grades, as doubles: at most `rows`, as many of each grade as there are, up to that.

    Within a grade the smallest hashes of ids come first. Left out are rows as in labelled_sample; an id with several
    grades has the largest.
    """
    known = labels.where(F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double")) & F.col(doc_id).isNotNull()).where(~held_out(F.col(doc_id)))
    known = known.groupBy(F.col(doc_id).alias("key")).agg(F.max(F.col(label).cast("double")).alias("y"))
    known = known.withColumn("share", F.pmod(F.xxhash64("key", F.lit(7)), F.lit(64)))
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64("key"), "key"))
    known = known.withColumn("turn", first("y", "share")).where(F.col("turn") <= rows)  # a grade that most rows have is ranked in shares
    known = known.withColumn("turn", first("y")).where(F.col("turn") <= rows)
    some = known.orderBy("turn", F.xxhash64("key"), "key").limit(rows).select("key", "y", "turn")
    body = docs.where(F.length(text).between(1, longest)).select(F.col(doc_id).alias("key"), F.col(text).alias("text"))
    return body.join(F.broadcast(some), "key").orderBy("turn", F.xxhash64("key", "text")).limit(rows).select("text", "y")


def fitted(sample: DataFrame | None, fit, kind: pa.DataType = pa.int32()) -> dict:
    """The fields of the model that fit(texts, labels) makes of a bounded sample, in one task of an executor."""
    def run(batches):
        rows = pa.Table.from_batches(list(batches), pa.schema([("text", pa.string()), ("y", kind)])).sort_by([("y", "ascending"), ("text", "ascending")])
        model = fit(rows["text"].combine_chunks(), np.asarray(rows["y"]).astype(np.int64 if kind == pa.int32() else np.float64))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(vars(model))], pa.binary())], ["model"])

    row = sample.coalesce(1).mapInArrow(run, "model binary").first() if sample is not None else None
    return pickle.loads(row["model"]) if row else vars(fit(pa.array([], pa.string()), np.zeros(0, np.int64)))
