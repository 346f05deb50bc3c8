"""Words and window hashes of Arrow text batches, computed with numpy on raw UTF-8 bytes.

A batch is cut into slices of a few MB, so memory depends on the longest single text and
not on how many rows an Arrow batch holds. Words are runs of bytes of one class: all the
word definitions used here separate words by ASCII characters, so every byte of a
multi-byte character belongs to a word and bytes can stand for characters.

A word's hash is a polynomial over random 64-bit values of its bytes, modulo 2^64, then
mixed. A window's hash is a second polynomial over word hashes (or bytes). Prefix sums
make each window one subtraction. Equal 64-bit hashes are taken as equal sequences; every
operator that acts on them compares at least 64 bits at the last step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE_BYTES = 4 << 20
CHUNK = 1 << 20

#: Bytes that separate words: blank and the controls 9 to 13.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Letters, digits and all non-ASCII characters (after lower-casing A-Z).
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values with well spread bits (the splitmix64 finaliser)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Poly:
    """Window hashes from prefix sums with an odd base, for sequences of any length."""

    def __init__(self, seed: int):
        self.seed = seed
        rng = np.random.default_rng(seed)
        self.byte = rng.integers(1, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
        self.base = int(rng.integers(2**61, 2**62)) * 2 + 1
        self.inverse = pow(self.base, -1, 2**64)
        self._pow = self._inv = np.ones(1, U)

    def __reduce__(self):
        return Poly, (self.seed,)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._pow) < n:
            n = 1 << max(10, (n - 1).bit_length())
            self._pow = np.multiply.accumulate(np.r_[U(1), np.full(n - 1, self.base % 2**64, U)])
            self._inv = np.multiply.accumulate(np.r_[U(1), np.full(n - 1, self.inverse, U)])
        return self._pow, self._inv

    def prefix(self, values: np.ndarray) -> np.ndarray:
        p, _ = self.powers(len(values) + 1)
        out = np.zeros(len(values) + 1, U)
        np.cumsum(values * p[: len(values)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of values[start:end]; spans of equal content have equal hashes."""
        _, inv = self.powers(len(prefix))
        return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(U) * U(0x9E3779B97F4A7C15))

    def windows(self, values: np.ndarray, length: int) -> np.ndarray:
        if len(values) < length:
            return np.zeros(0, U)
        start = np.arange(len(values) - length + 1)
        return self.spans(self.prefix(values), start, start + length)


WORD = Poly(11)
WINDOW = Poly(23)


@dataclass
class Slice:
    """A few texts: their rows in the batch, their bytes one after the other, and where each begins."""

    rows: np.ndarray
    data: np.ndarray
    offsets: np.ndarray

    def text(self, i: int) -> np.ndarray:
        return self.data[self.offsets[i] : self.offsets[i + 1]]


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The texts of an Arrow string (or binary) column; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        return
    n = len(column)
    if n == 0:
        return
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, raw = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(last, first + 1))
        yield Slice(np.arange(first, last), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


@dataclass
class Words:
    """The words of a slice: byte range and hash of each, and the range of words of each text."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    offsets: np.ndarray
    data: np.ndarray

    def window_hashes(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every window that lies within one text."""
        h = WINDOW.windows(self.hash, length)
        doc = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))
        at = np.arange(len(h))
        at = at[doc[: len(h)] == doc[length - 1 :]] if len(h) else at
        return at, h[at]


def words(s: Slice, kind: np.ndarray, lower: bool) -> Words:
    data = LOWER[s.data] if lower else s.data
    is_word = kind[data]
    n = len(data)
    if n == 0:
        zero = np.zeros(0, np.int64)
        return Words(zero, zero, np.zeros(0, U), np.zeros(len(s.offsets), np.int64), data)
    inner = s.offsets[(s.offsets > 0) & (s.offsets < n)]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = is_word[:-1]
    before[inner] = False
    start = np.flatnonzero(is_word & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = is_word[1:]
    after[inner - 1] = False
    end = np.flatnonzero(is_word & ~after) + 1
    h = np.empty(len(start), U)
    i = 0
    while i < len(start):  # pieces of about CHUNK bytes, cut between words
        j = max(i + 1, int(np.searchsorted(end, start[i] + CHUNK, "right")))
        lo = start[i]
        h[i:j] = WORD.spans(WORD.prefix(WORD.byte[data[lo : end[j - 1]]]), start[i:j] - lo, end[i:j] - lo)
        i = j
    return Words(start, end, h, np.searchsorted(start, s.offsets), data)


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal true runs within each text: (text, start, end), counted from the text's start."""
    if not len(mask):
        zero = np.zeros(0, np.int64)
        return zero, zero, zero
    cuts = offsets[(offsets > 0) & (offsets < len(mask))]
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    first[cuts] = mask[cuts]
    last[:-1] &= ~mask[1:]
    last[cuts - 1] = mask[cuts - 1]
    lo, hi = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(offsets, lo, "right") - 1
    return doc, lo - offsets[doc], hi - offsets[doc]


def span_lists(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: int) -> pa.Array:
    """The runs of n texts as a list column of (start, end)."""
    edge = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(edge), pairs)
