"""Hashed text vectors with exact integer counts, and dense-vector helpers."""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T

from .. import patterns
from .text import bind


def space_name(dim: int) -> str:
    """Label stored next to a vector; vectors of different spaces never meet."""
    return f"md5-count-{dim}"


def embedding_text(fraud_type: Column, scenario: Column, summary: Column, script: Column, signals: Column) -> Column:
    """Text a case is found by: its telling fields, empty ones left out, one per line."""
    parts = F.concat(F.array(fraud_type, scenario, summary), script, signals)
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n")


def tokens(text: Column) -> Column:
    """CJK characters and ASCII words of the lower-cased text, then adjacent pairs joined."""
    return bind(F.regexp_extract_all(F.lower(text), F.lit(patterns.TOKEN), 1), with_pairs)


def with_pairs(unit: Column) -> Column:
    pairs = F.size(unit) - 1
    count = F.greatest(pairs, F.lit(0))
    return F.concat(
        unit, F.zip_with(F.slice(unit, F.lit(1), count), F.slice(unit, F.lit(2), count), lambda a, b: F.concat(a, b))
    )


def _le_word(digest: Column, first: int, size: int) -> Column:
    """`size` digest bytes from byte `first` on, read as a little-endian number."""
    at = [F.substring(digest, 2 * b + 1, 2) for b in reversed(range(first, first + size))]
    return F.conv(F.concat(*at) if len(at) > 1 else at[0], 16, 10).cast("bigint")


def bucket_code(token: Column, dim: int) -> Column:
    """2*bucket + (1 if the sign is plus): bucket and sign of a token's digest.

    The digest's first 8 bytes are an unsigned little-endian number h; the bucket
    is h mod dim and the sign is plus when the top bit of h is set.
    """

    return bind(F.md5(token), lambda digest: _code_of(digest, dim))


def _code_of(digest: Column, dim: int) -> Column:
    plus = (F.substring(digest, 15, 1) >= "8").cast("int")
    if 256 % dim == 0:
        bucket = _le_word(digest, 0, 1) % dim
    elif 2**32 % dim == 0:
        bucket = _le_word(digest, 0, 4) % dim
    else:
        high, low = _le_word(digest, 4, 4), _le_word(digest, 0, 4)
        bucket = ((high % dim) * (2**32 % dim) + low) % dim
    return (bucket * 2 + plus).cast("int")


def bucket_codes(token_list: Column, dim: int) -> Column:
    """`bucket_code` of every token; digests first, so that each is computed once."""
    digests = F.transform(token_list, lambda t: F.md5(t))
    return F.transform(digests, lambda d: _code_of(d, dim))


#: Bytes of text whose tokens are laid out at once.
SLICE_BYTES = 4 << 20


def _slices(texts: pa.Array) -> list[pa.Array]:
    """Consecutive rows of about `SLICE_BYTES` of text each; a longer row is one of its own."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.flatnonzero(np.diff(ends // SLICE_BYTES, prepend=0) > 0)
    edges = np.unique(np.concatenate([[0], cuts, cuts + 1, [len(texts)]]))
    return [texts.slice(a, b - a) for a, b in zip(edges.tolist(), edges[1:].tolist())]


def _units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(row, number) of every character and word of the token pattern in reading order, and what each number stands for."""
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    cjk = (points >= ord("一")) & (points <= ord("龥"))
    low = points | 0x20
    word = ((points >= 48) & (points <= 57)) | ((low >= 97) & (low <= 122))
    goes_on = word[1:] & word[:-1] & (row[1:] == row[:-1])
    first, last = word.copy(), word.copy()
    first[1:] &= ~goes_on
    last[:-1] &= ~goes_on
    at, starts = np.flatnonzero(cjk | first), np.flatnonzero(first)
    # words are ASCII: their letters side by side are an Arrow string array
    ends = np.concatenate([[0], np.cumsum(np.flatnonzero(last) + 1 - starts)]).astype(np.int32)
    letters = points[word].astype(np.uint8)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(letters)]).dictionary_encode()
    ids = points[at].astype(np.int64)
    ids[first[at]] = FIRST_WORD + words.indices.to_numpy().astype(np.int64)
    names, coded = words.dictionary.to_pylist(), pa.array(ids).dictionary_encode()
    found = [names[i - FIRST_WORD] if i >= FIRST_WORD else chr(i).encode() for i in coded.dictionary.to_pylist()]
    return row[at], coded.indices.to_numpy().astype(np.int64), found


#: The number of a character is its code point; those of words begin here.
FIRST_WORD = 0x110000


def _digest_codes(tokens: Iterable[bytes], dim: int) -> np.ndarray:
    """`bucket_code` of every token."""
    number = np.frombuffer(b"".join([md5(token).digest() for token in tokens]), "<u8")[::2]
    return (number % np.uint64(dim)).astype(np.int64) * 2 + (number >> np.uint64(63)).astype(np.int64)


def signed_counts(texts: pa.Array, dim: int) -> np.ndarray:
    """Signed token counts of lower-cased texts, one row each. Each distinct token of the texts is digested once."""
    row, unit, names = _units(texts)
    pair = row[1:] == row[:-1]
    pairs = pa.array((unit[:-1] * len(names) + unit[1:])[pair]).dictionary_encode()
    left, right = np.divmod(pairs.dictionary.to_numpy(), max(len(names), 1))
    pair_codes = _digest_codes([names[a] + names[b] for a, b in zip(left.tolist(), right.tolist())], dim)
    codes = np.concatenate([_digest_codes(names, dim)[unit], pair_codes[pairs.indices.to_numpy()]])
    rows = np.concatenate([row, row[1:][pair]]).astype(np.int64)
    counts = np.bincount(rows * dim + (codes >> 1), weights=(codes & 1) * 2.0 - 1.0, minlength=len(texts) * dim)
    return counts.astype(np.int32).reshape(len(texts), dim)


def counts_of(texts: pa.Array, dim: int) -> np.ndarray:
    """`signed_counts` of texts of any size; a text that many rows hold is counted once."""
    once = texts.dictionary_encode()
    counts = [signed_counts(some, dim) for some in _slices(once.dictionary)]
    if len(once.dictionary) == 0:
        return np.empty((0, dim), np.int32)
    values = counts[0] if len(counts) == 1 else np.concatenate(counts)
    return values if len(values) == len(texts) else values[once.indices.to_numpy(zero_copy_only=False)]


@lru_cache(maxsize=None)
def _summer(dim: int):
    """Arrow function: lower-cased texts -> lists of `dim` signed counts."""

    @F.arrow_udf(T.ArrayType(T.IntegerType(), False))
    def counted(texts: pa.Array) -> pa.Array:
        values = counts_of(texts, dim).ravel()
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(texts) * dim + 1, dim, dtype=np.int32)), pa.array(values))

    return counted


def hash_vector(text: Column, dim: int) -> Column:
    """Signed token counts per bucket as ARRAY<INT>; an empty text gives zeros.

    The counts of `bucket_codes(tokens(text))`, taken for a whole Arrow batch in numpy: the JVM's
    array functions cost several times as much for each token. Case is folded in the JVM, so that both agree.
    No row leaves its partition, however long the text.
    """
    return _summer(dim)(F.lower(F.coalesce(text, F.lit(""))))


def norm2(vec: Column) -> Column:
    """Squared length of an integer vector, exact."""
    return F.aggregate(vec, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint") * x)


def l2_normalize(vec: Column) -> Column:
    """Unit-length copy of a dense vector as ARRAY<DOUBLE>; a zero vector stays zero."""
    wide = F.transform(vec, lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(wide, lambda x: x / F.when(length == 0, F.lit(1.0)).otherwise(length))
