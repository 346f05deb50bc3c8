"""Expected grades of texts by ordinal cumulative-link regression on hashed text.

Grades are ordered numbers. One weight vector is shared by all thresholds:
P(grade > k) = sigmoid(w.x - t_k) with t_1 < t_2 < ..., so a text has an expected grade and, for
selection, the probability of reaching a wanted grade. x holds, for four kinds of hashed tokens
(the word, its last two bytes, its length with its first byte, whether it repeats one of the three words
before it), the share of each bucket, and the text's length class. Thresholds are kept in order by adding exponentials.

At most `LEVELS` grades get a threshold each; of more, neighbours are merged at quantiles of the training
rows, and a merged grade counts as the mean of its rows.

Handled cases: null and empty texts have no tokens and are graded by the thresholds and the length
class alone; one grade only, or none, in the sample gives every text that grade (or null); repeated
rows grade alike; null ids are graded and are never in the test fold. Only the text is an input.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.samples import PER_CLASS, fitted, graded_sample
from llm.shared import arrow_schema, held_out
from llm.textkernel import NON_SPACE, U, Slice, mix, slices, words

BITS, KINDS, LENGTHS, LEVELS = 16, 4, 24, 32


@dataclass
class Model:
    weight: np.ndarray  # KINDS x 2^BITS, then a weight for each length class
    cuts: np.ndarray
    grades: np.ndarray
    floors: np.ndarray  # the smallest label of each grade


def _tokens(s: Slice) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Buckets of each kind by word, word offsets of texts, length classes of texts."""
    w = words(s, NON_SPACE, False)
    top = lambda x: (mix(x) >> U(64 - BITS)).astype(np.int64)
    tail = s.data[w.end - 1].astype(U) * U(257) + s.data[np.maximum(w.end - 2, w.start)].astype(U) if len(w.end) else np.zeros(0, U)
    form = (np.minimum(w.end - w.start, 40).astype(U) * U(256) + s.data[w.start].astype(U)) if len(w.end) else np.zeros(0, U)
    again = np.zeros(len(w.hash), U)
    place = np.arange(len(w.hash)) - np.repeat(w.offsets[:-1], np.diff(w.offsets))
    for k in (3, 2, 1):  # the nearest one counts
        again[k:][(w.hash[k:] == w.hash[:-k]) & (place[k:] >= k)] = k
    length = np.minimum(LENGTHS - 1, np.log2(np.diff(w.offsets) + 1)).astype(np.int64)
    shared = [(w.hash >> U(64 - BITS)).astype(np.int64), (1 << BITS) + top(tail + U(1 << 20)), (2 << BITS) + top(form + U(1 << 30))]
    return [*shared, (3 << BITS) + top(again + U(1 << 40))], w.offsets, length


def _linear(weight: np.ndarray, kinds, offsets, length) -> np.ndarray:
    n = np.maximum(np.diff(offsets), 1)
    out = weight[(KINDS << BITS) + length].copy()
    for b in kinds:
        total = np.r_[0, np.cumsum(weight[b])]
        out += (total[offsets[1:]] - total[offsets[:-1]]) / n
    return out


def fit(texts: pa.Array, y: np.ndarray, steps: int = 150, ridge: float = 1e-4) -> Model:
    weight = np.zeros((KINDS << BITS) + LENGTHS)
    floors = np.unique(y)
    if len(floors) > LEVELS:
        floors = np.unique(np.quantile(y, np.arange(LEVELS) / LEVELS, method="lower"))
    k = np.searchsorted(floors, y, "right") - 1
    grades = np.bincount(k, y, len(floors)) / np.bincount(k, minlength=len(floors)) if len(floors) else floors
    if len(grades) < 2:
        return Model(weight, np.zeros(0), grades, floors)
    parts = [_tokens(s) for s in slices(texts)]
    kinds = [np.concatenate([p[0][i] for p in parts]) for i in range(KINDS)]
    offsets = np.r_[0, np.cumsum(np.concatenate([np.diff(p[1]) for p in parts]))]
    length = np.concatenate([p[2] for p in parts])
    doc = np.repeat(np.arange(len(y)), np.diff(offsets))
    share = np.bincount(k, minlength=len(grades)) / len(k)
    above = 1 - np.cumsum(share)[:-1]
    cuts = -np.log(above / (1 - above))
    raw = np.r_[cuts[0], np.log(np.maximum(np.diff(cuts), 1e-3))]
    square, square_cut = np.full(len(weight), 1e-8), np.full(len(raw), 1e-8)
    n = np.maximum(np.diff(offsets), 1)
    for _ in range(steps):
        cuts = raw[0] + np.r_[0, np.cumsum(np.exp(raw[1:]))]
        f = _linear(weight, kinds, offsets, length)
        p = np.c_[np.ones(len(f)), 1 / (1 + np.exp(-np.clip(f[:, None] - cuts, -30, 30))), np.zeros(len(f))]
        d = p * (1 - p)
        rows = np.arange(len(k))
        like = np.maximum(p[rows, k] - p[rows, k + 1], 1e-9)
        g = (d[rows, k] - d[rows, k + 1]) / like / len(k)
        grad = -ridge * weight
        for b in kinds:
            grad += np.bincount(b, (g / n)[doc], len(weight))
        grad += np.bincount((KINDS << BITS) + length, g, len(weight))
        by_cut = np.zeros(len(cuts) + 2)
        np.add.at(by_cut, k, -d[rows, k] / like / len(k))
        np.add.at(by_cut, k + 1, d[rows, k + 1] / like / len(k))
        by_cut = by_cut[1:-1]
        grad_raw = np.r_[by_cut.sum(), np.exp(raw[1:]) * np.cumsum(by_cut[::-1])[::-1][1:]]
        square += grad**2
        square_cut += grad_raw**2
        weight += 1.0 * grad / np.sqrt(square)
        raw += 0.1 * grad_raw / np.sqrt(square_cut)
    return Model(weight, raw[0] + np.r_[0, np.cumsum(np.exp(raw[1:]))], grades, floors)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", per_class: int = PER_CLASS) -> Model:
    return Model(**fitted(graded_sample(docs, labels, label, doc_id, text, 2 * per_class), fit, pa.float64()))


def _grade(m: Model, schema: pa.Schema, wanted: float | None):
    def run(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("id"))
            for s in slices(batch.column(batch.schema.get_field_index("text"))):
                n = len(s.rows)
                if len(m.grades) < 2:
                    grade = float(m.grades[0]) if len(m.grades) else None
                    expected, tail = pa.array([grade] * n, pa.float64()), pa.array([None if grade is None else float(wanted is None or grade >= wanted)] * n, pa.float64())
                else:
                    f = _linear(m.weight, *_tokens(s))
                    p = 1 / (1 + np.exp(-np.clip(f[:, None] - m.cuts, -30, 30)))
                    expected = pa.array(m.grades[0] + p @ np.diff(m.grades).astype(float))
                    reach = len(m.grades) - 1 if wanted is None else int(np.searchsorted(m.floors, wanted))
                    tail = pa.array(np.c_[np.ones(n), p, np.zeros(n)][:, min(reach, len(m.grades))])
                yield pa.RecordBatch.from_arrays([ids.slice(s.rows[0], n), expected, tail], schema=schema)

    return run


def grades(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", wanted: float | None = None) -> DataFrame:
    """(id, expected, tail): expected grade, and the probability of at least the wanted (else the highest) grade."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    result = f"id {rows.schema['id'].dataType.simpleString()}, expected double, tail double"
    return rows.mapInArrow(_grade(model, arrow_schema(result), wanted), result)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of `documents`: expected grade, probability of the highest grade, and whether it is selected."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = grades(docs, model).withColumnRenamed("id", "doc_id")
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("tail").alias("score"), "expected",
        (F.col("tail") >= 0.5).cast("int").alias("predicted"), F.coalesce(F.col("tail") >= 0.5, F.lit(True)).alias("selected"),
    )
