"""Phrase matching against a lexicon held as a table.

The texts of an Arrow batch are matched together, as one array of UTF-8 bytes: equal bytes are
equal characters, since no character's bytes begin inside another's. Places whose first bytes
begin no keyword drop out by a bitmap; at the others the window of each keyword length is hashed
(two values of a running sum) and looked up, and what is found is compared byte by byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Keywords of one pass over the texts. A pass is a map with its keywords at hand.
PASS_KEYWORDS = 50_000
#: Bytes of texts matched at a time; a longer text is matched alone.
SLICE = 2 << 20
HEAD, MAP_BITS = 4, 20


def phrase_matches(texts: DataFrame, keywords: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Which keywords occur in which text: (*keys, keyword columns), each pair once per text row.

    For lexicons too large to sit in an expression. `keywords` has a column `kw`; null and
    empty ones match nothing. Its distinct keywords are taken in passes of a bounded number, by
    hash of the keyword; in a pass all keywords are matched where the texts lie, so no text leaves
    its task. A pass costs the length of the texts and, at places where some keyword may begin, the
    number of different keyword lengths. The rows
    of a keyword, however many, join its hits afterwards.
    """
    usable = keywords.filter(F.col("kw") != "")
    distinct = usable.select(F.col("kw").alias("_kw")).distinct()
    passes = max(1, -(-distinct.count() // PASS_KEYWORDS))
    found = None
    for turn in range(passes):
        rows = distinct.filter(F.pmod(F.xxhash64("_kw"), F.lit(passes)) == turn).toArrow()
        part = _one_pass(texts, rows, keys, text)
        found = part if found is None else found.unionByName(part)
    return found.join(usable.withColumn("_kw", F.col("kw")), "_kw").drop("_kw")


def _one_pass(texts: DataFrame, rows: pa.Table, keys: list[str], text: str) -> DataFrame:
    matcher = Matcher(rows["_kw"].to_pylist())

    @F.arrow_udf("array<int>")
    def hits(column: pa.Array) -> pa.Array:
        return matcher(column)

    numbered = rows.append_column("_place", pa.array(range(len(rows)), pa.int32()))
    # about PASS_KEYWORDS rows at most: keywords are distinct
    lexicon = F.broadcast(texts.sparkSession.createDataFrame(numbered))
    return texts.select(*keys, F.explode(hits(F.col(text))).alias("_place")).join(lexicon, "_place").drop("_place")


class Matcher:
    """Which of many distinct keywords occur in each text."""

    def __init__(self, words: list[str]):
        raw = [w.encode() for w in words]
        self.value, self.base, self.inverse = _constants()
        self.heads = np.zeros(1 << MAP_BITS, bool)
        self.by_length: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []  # length, hashes, bytes, places
        for size in sorted({len(r) for r in raw} - {0}):
            place = np.array([i for i, r in enumerate(raw) if len(r) == size])
            body = np.frombuffer(b"".join(raw[i] for i in place), np.uint8).reshape(-1, size)
            if size >= HEAD:
                self.heads[_head(body[:, :HEAD].T)] = True
            code = (self.value[body] * _powers(self.base, size)[None, :]).sum(axis=1, dtype=np.uint64)
            order = np.argsort(code, kind="stable")
            self.by_length.append((size, code[order], body[order], place[order]))

    def __call__(self, texts: pa.Array) -> pa.Array:
        """Sorted places of the keywords in each text; none in a null."""
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        edge = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        rows, found, first = [], [], 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(edge, edge[first] + SLICE, "right")) - 1)
            row, place = self._slice(data[edge[first] : edge[last]], edge[first : last + 1] - edge[first])
            rows.append(row + first), found.append(place)
            first = last
        row, place = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (rows, found))
        pair = np.unique(row * np.int64(1 << 32) + place)
        offsets = np.searchsorted(pair >> 32, np.arange(len(texts) + 1))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(pair & ((1 << 32) - 1), pa.int32()))

    def _slice(self, data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, keyword) of all matches in a few texts."""
        n = len(data)
        power, inverse = _powers(self.base, n), _powers(self.inverse, n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.value[data] * power, out=total[1:])
        every = np.arange(n)
        starts = np.flatnonzero(self.heads[_head([data[i : n - HEAD + 1 + i] for i in range(HEAD)])]) if n >= HEAD else every[:0]
        rows, found = [], []
        for size, codes, body, place in self.by_length:
            at = starts if size >= HEAD else every
            at = at[at + size <= n]
            text = np.searchsorted(edge, at, "right") - 1
            inside = at + size <= edge[text + 1]
            at, text = at[inside], text[inside]
            code = (total[at + size] - total[at]) * inverse[at]
            lo, hi = np.searchsorted(codes, code), np.searchsorted(codes, code, "right")
            while (lo < hi).any():  # more than once only if hashes of keywords collide
                some = lo < hi
                at, text, lo, hi = at[some], text[some], lo[some], hi[some]
                same = (data[at[:, None] + np.arange(size)] == body[lo]).all(axis=1)
                rows.append(text[same]), found.append(place[lo[same]])
                lo = lo + 1
        return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in (rows, found))


def _constants() -> tuple[np.ndarray, int, int]:
    rng = np.random.default_rng(7)
    base = int(rng.integers(2**60, 2**61)) * 2 + 1
    return rng.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1), base, pow(base, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base % 2**64, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


def _head(parts) -> np.ndarray:
    code = sum(p.astype(np.uint32) << np.uint32(8 * i) for i, p in enumerate(parts))
    return (code * np.uint32(2654435761)) >> np.uint32(32 - MAP_BITS)
