"""Toxic spans and document scores by a linear-chain conditional random field.

Labels say whether a document is toxic, not where. Tokens get their labels from the sample: a word
or word beginning marks toxicity where it stands in toxic documents of several families (near copies
are one) and almost nowhere else. On these labelled tokens a two-state chain is trained: each token's
weight comes from its hashed word, its first five and seven bytes, and the previous and the next
word; transitions are learned too. Forward-backward gives
each token its marginal; a document's marginals (largest, sum, mean) go through a logistic layer
fitted on the sample to its score. Tokens with a marginal of at least 0.5 form the offending spans.

The chain runs over whole texts: blocks of `BLOCK` tokens are multiplied out for all texts at once
and then joined, so a long text is no long loop, and the result is that of one pass over the text.

Handled cases: null and empty texts score by the logistic layer's constant alone, which is below
0.5 unless most sampled texts were toxic; without usable labels all scores are 0; repeated rows
score alike; null ids are scored and are never in the test fold. Only the text is an input.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from llm.samples import PER_CLASS, fitted, labelled_sample
from llm.shared import held_out
from llm.textkernel import ALNUM, U, Words, mix, runs, slices, words

BITS, BLOCK = 16, 128
#: A word is toxic if it stands in toxic documents of so many families, at least this share of them, and so much more often there:
#: in RATIO times the share of families, or in LESS times the share of families and RATIO times the share of places.
FAMILIES, SHARE, RATIO, LESS = 5, 0.02, 12.0, 3.0
BEGINNINGS = (5, 7)


@dataclass
class Model:
    own: np.ndarray  # a row of weights for the word and for each length of beginning
    before: np.ndarray
    after: np.ndarray
    bias: float
    moves: np.ndarray  # log potentials from state to state
    layer: np.ndarray  # constant, largest marginal, log of the sum, mean
    usable: bool = True


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> U(64 - BITS)).astype(np.int64)


def _neighbours(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the previous and the next word of the same text; -1 (the last weight) where there is none."""
    before, after = np.full(len(b), -1), np.full(len(b), -1)
    before[1:], after[:-1] = b[:-1], b[1:]
    inner = offsets[:-1][np.diff(offsets) > 0]
    before[inner] = -1
    last = offsets[1:][np.diff(offsets) > 0] - 1
    after[last] = -1
    return before, after


def features(w: Words) -> np.ndarray:
    """Hashes of each word and of its beginnings, a row for each kind."""
    out = [w.hash]
    for n in BEGINNINGS:
        value = np.full(len(w.hash), n, U)
        for i in range(n):
            at = w.start + i
            value = value * U(256) + np.where(at < w.end, w.data[np.minimum(at, max(0, len(w.data) - 1))], 0).astype(U) if len(at) else value
        out.append(mix(value))
    return np.stack(out)


def emissions(m: Model, h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    b = _bucket(h)
    before, after = _neighbours(b[0], offsets)
    return sum(m.own[k][b[k]] for k in range(len(b))) + m.before[before] + m.after[after] + m.bias


def marginals(e: np.ndarray, offsets: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Probability of the toxic state at each token. The chain starts in the clean state."""
    p, _ = _forward_backward(e, offsets, moves, False)
    return p


def _forward_backward(e, offsets, moves, pairs):
    n = np.diff(offsets)
    per = -(-n // BLOCK)
    total = int(per.sum())
    if total == 0:
        return np.zeros(0), np.zeros((2, 2))
    first = np.cumsum(per) - per
    doc = np.repeat(np.arange(len(n)), per)
    start = offsets[doc] + (np.arange(total) - first[doc]) * BLOCK
    size = np.minimum(BLOCK, offsets[doc + 1] - start)
    at = start[:, None] + np.arange(BLOCK)
    there = np.arange(BLOCK) < size[:, None]
    w = np.where(there, np.exp(np.clip(e[np.minimum(at, len(e) - 1)], -30, 30)), 1.0).T.copy()  # BLOCK x blocks
    there = there.T
    t = np.exp(moves)
    eye = np.eye(2)

    def products():
        """Each block's product of steps, rows by starting state."""
        prod = np.broadcast_to(eye, (total, 2, 2)).copy()
        for k in range(BLOCK):
            nxt = prod @ t
            nxt[:, :, 1] *= w[k][:, None]
            nxt /= nxt.max(axis=(1, 2), keepdims=True)
            prod = np.where(there[k][:, None, None], nxt, prod)
        return prod

    several = per > 1
    alpha0 = np.zeros((total, 2))
    alpha0[first[per > 0]] = [1.0, 0.0]
    beta1 = np.ones((total, 2))
    if several.any():  # join the blocks of longer texts
        prod = products()
        longest = int(per.max())
        for k in range(1, longest):
            b = first[per > k] + k
            v = np.einsum("bi,bij->bj", alpha0[b - 1], prod[b - 1])
            alpha0[b] = v / v.max(axis=1, keepdims=True)
        for k in range(longest - 1, 0, -1):
            b = first[per > k] + k
            v = np.einsum("bij,bj->bi", prod[b], beta1[b])
            beta1[b - 1] = v / v.max(axis=1, keepdims=True)
    alpha = np.empty((BLOCK, total, 2))
    a = alpha0
    for k in range(BLOCK):
        nxt = a @ t
        nxt[:, 1] *= w[k]
        nxt /= nxt.sum(axis=1, keepdims=True)
        a = np.where(there[k][:, None], nxt, a)
        alpha[k] = a
    out = np.empty((BLOCK, total))
    expected = np.zeros((2, 2))
    b = beta1
    for k in range(BLOCK - 1, -1, -1):
        g = alpha[k] * b
        out[k] = g[:, 1] / g.sum(axis=1)
        back = b.copy()
        back[:, 1] *= w[k]
        if pairs:
            prev = alpha[k - 1] if k else alpha0
            x = prev[:, :, None] * t * back[:, None, :]
            x /= x.sum(axis=(1, 2), keepdims=True)
            expected += x[there[k]].sum(axis=0)
        back = back @ t.T
        back /= back.max(axis=1, keepdims=True)
        b = np.where(there[k][:, None], back, b)
    p = np.empty(len(e))
    keep = there.T
    p[at[keep]] = out.T[keep]
    return p, expected


def _summary(p: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = np.diff(offsets)
    total = np.r_[0, np.cumsum(p)]
    total = np.maximum(total[offsets[1:]] - total[offsets[:-1]], 0)
    top = np.zeros(len(n))
    some = n > 0
    if some.any():
        top[some] = np.maximum.reduceat(np.r_[p, 0], offsets[:-1][some])
    return np.stack([np.ones(len(n)), top, np.log1p(total), total / np.maximum(n, 1)], 1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
    return w


def _families(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A name for each text that near copies share: the smallest hash of four of its words in a row."""
    family = np.zeros(len(offsets) - 1, U)
    for i, (lo, hi) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        mixed = h[lo:hi].copy()
        for k in range(1, 4):
            mixed[: max(0, len(mixed) - k)] ^= np.roll(h[lo:hi], -k)[: max(0, len(mixed) - k)] * U(2 * k + 1)
        family[i] = mixed.min() if len(mixed) else 0
    return family


def _toxic_words(h: np.ndarray, offsets: np.ndarray, y: np.ndarray, family: np.ndarray) -> np.ndarray:
    """Hashes of the words that mark toxic documents, counted once for each family of near copies."""
    doc = np.repeat(np.arange(len(y)), np.diff(offsets))
    word, at = np.unique(h, return_inverse=True)
    kin = np.unique(family, return_inverse=True)[1].reshape(-1)
    seen = np.unique(np.stack([at.reshape(-1), kin[doc], y[doc]], 1), axis=0)
    bad = np.bincount(seen[:, 0], seen[:, 2], len(word))
    good = np.bincount(seen[:, 0], 1 - seen[:, 2], len(word))
    families = [max(1, len(np.unique(family[y == v]))) for v in (0, 1)]
    ratio = (bad + 0.1) / (families[1] + 1) / ((good + 0.1) / (families[0] + 1))
    # places of a word in a text of its family's mean, as shares of the text
    weight = (1 / np.maximum(np.diff(offsets), 1) / np.bincount(kin * 2 + y)[kin * 2 + y])[doc]
    dense = [np.bincount(at.reshape(-1), weight * (y[doc] == v), len(word)) / families[v] for v in (0, 1)]
    often = dense[1] >= RATIO * dense[0]
    return word[(bad >= max(FAMILIES, SHARE * families[1])) & ((ratio >= RATIO) | (often & (ratio >= LESS)))]


def fit(texts: pa.Array, y: np.ndarray, epochs: int = 25) -> Model:
    size = (1 << BITS) + 1
    zero = lambda: np.zeros(size)
    if len(np.unique(y)) < 2:
        return Model(np.zeros((1 + len(BEGINNINGS), size)), zero(), zero(), 0.0, np.zeros((2, 2)), np.zeros(4), False)
    y = (y > 0).astype(np.int64)
    h, sizes = [], []
    for s in slices(texts):
        w = words(s, ALNUM, True)
        h.append(features(w))
        sizes.append(np.diff(w.offsets))
    h, offsets = np.concatenate(h, axis=1), np.r_[0, np.cumsum(np.concatenate(sizes))]
    doc = np.repeat(np.arange(len(y)), np.diff(offsets))
    family = _families(h[0], offsets)
    tag = sum(np.isin(x, _toxic_words(x, offsets, y, family)) for x in h) * (y[doc] == 1) > 0
    tag = tag.astype(float)
    b = _bucket(h)
    before, after = _neighbours(b[0], offsets)
    m = Model(np.zeros((len(h), size)), zero(), zero(), -3.0, np.array([[0.0, -1.0], [0.0, 0.0]]), np.zeros(4))
    tags = tag.astype(np.int64)
    prev = np.r_[0, tags[:-1]]
    prev[offsets[:-1][np.diff(offsets) > 0]] = 0
    seen = np.bincount(prev * 2 + tags, minlength=4).reshape(2, 2).astype(float)
    square = [np.full(size, 1e-8) for _ in range(len(h) + 2)]
    for _ in range(epochs):  # full-batch gradient steps of the chain's log likelihood, scaled by coordinate
        p, pairs = _forward_backward(emissions(m, h, offsets), offsets, m.moves, True)
        g = tag - p
        for k, (weight, where) in enumerate([*zip(m.own, b, strict=True), (m.before, before % size), (m.after, after % size)]):
            grad = np.bincount(where, g, size) - (0.05 if k < len(h) else 2.0) * weight
            square[k] += grad**2
            weight += 0.5 * grad / np.sqrt(square[k])
        m.bias += 2.0 * g.mean() / max(tag.mean(), 1e-3) * 0.1
        m.moves += 0.1 * np.clip((seen - pairs) / np.maximum(seen + pairs, 1.0), -1, 1)
    m.layer = _logistic(_summary(marginals(emissions(m, h, offsets), offsets, m.moves), offsets), y)
    return m


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", per_class: int = PER_CLASS) -> Model:
    return Model(**fitted(labelled_sample(docs, labels, label, doc_id, text, per_class), fit))


def _score(m: Model, schema: pa.Schema):
    spans_type = schema.field("spans").type

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            others = [i for i, c in enumerate(batch.schema.names) if c != "text"]
            for s in slices(column):
                w = words(s, ALNUM, True)
                n = len(s.rows)
                p = marginals(emissions(m, features(w), w.offsets), w.offsets, m.moves) if m.usable else np.zeros(len(w.hash))
                score = 1 / (1 + np.exp(-np.clip(_summary(p, w.offsets) @ m.layer, -30, 30))) if m.usable else np.zeros(n)
                doc, lo, hi = runs(p >= 0.5, w.offsets)
                # byte places to character places: count the bytes that begin a character
                char = np.r_[0, np.cumsum((s.data & 0xC0) != 0x80)]
                a, z = w.start[w.offsets[doc] + lo], w.end[w.offsets[doc] + hi - 1]
                base = char[s.offsets[doc]]
                edge = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
                peak = np.maximum.reduceat(np.r_[p, 0], np.stack([w.offsets[doc] + lo, w.offsets[doc] + hi], 1).ravel())[::2] if len(doc) else np.zeros(0)
                spans = pa.ListArray.from_arrays(pa.array(edge), pa.StructArray.from_arrays([pa.array((char[a] - base).astype(np.int32)), pa.array((char[z] - base).astype(np.int32)), pa.array(peak)], ["start", "end", "marginal"]))
                rest = [batch.column(i).slice(s.rows[0], n) for i in others]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(score), spans.cast(spans_type)], schema=schema)

    return run


def toxicity(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score, spans): each document's score and the offending character ranges with their largest marginal."""
    return _scored(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), model)


def clean(docs: DataFrame, model: Model, text: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below the limit."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    return _scored(rows, model).where(F.col("score") < limit).select("row.*")


def _scored(rows: DataFrame, model: Model) -> DataFrame:
    schema = StructType([*(f for f in rows.schema if f.name != "text"), *StructType.fromDDL("score double, spans array<struct<start:int,end:int,marginal:double>>")])
    return rows.mapInArrow(_score(model, to_arrow_schema(schema)), schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of `documents`: its score, learned from training rows of `labels`, and its offending spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = toxicity(docs, model).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
