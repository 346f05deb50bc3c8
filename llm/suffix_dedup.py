"""Removes byte strings of `target` bytes that start anywhere else too, by fingerprints of windows.

No suffix is sorted: windows of `target` bytes are equal if their 64-bit hashes are. A suffix array, or a
hash of each window, would send every byte position through a shuffle; here windows are taken in blocks:

* Anchors: in each window of `target` bytes the place of its smallest `ANCHOR`-byte hash. Equal
  windows hold their anchor at equal offsets, with about two anchors per `target - ANCHOR` bytes.
  Consecutive windows with the same anchor form a block.
* Blocks: a block's whole content is hashed. Where the hash occurs twice, all its windows do; that
  settles the inside of long copies without looking at single windows.
* Single windows: only blocks that share their anchor string with a different block remain (ends of
  passages, places around edits), and one of each set of equal blocks beside them. The hashes of
  their windows go to buckets by bits of the hash, and a bucket is sorted alone, so its size bounds
  memory.

Handled cases: null and empty texts have no bytes; texts shorter than `target` keep all; repeated
rows are separate documents; null and repeated ids stay a row per row; other columns are not looked
at. Texts longer than a few MB are worked on in overlapping pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.repeats import buckets_of, find_blocks, find_repeats, loose, minimum_of, rids
from llm.shared import arrow_schema, cut, keyed
from llm.textkernel import U, Poly, Slice, mix, runs, slices, span_lists

TARGET, ANCHOR = 400, 64
PIECE = 1 << 19
BYTES, BLOCK, SUFFIX = Poly(41), Poly(43), Poly(47)
RESULT = "id {id}, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:int,end:int>>"


def _column(batch, name):
    return batch.column(batch.schema.get_field_index(name))


def _pieces(s: Slice, target: int, limit: int):
    """(slice, place of its bytes in the first text): a long single text in pieces that share target - 1 bytes."""
    if len(s.rows) > 1 or len(s.data) <= 2 * limit + target:
        yield s, 0
        return
    for lo in range(0, len(s.data) - target + 1, limit):
        part = s.data[lo : lo + limit + target - 1]
        yield Slice(s.rows, part, np.array([0, len(part)])), lo


def _blocks(s: Slice, target: int, anchor: int):
    """Blocks of a slice: first window, last window, sample point, text; and the sample string hashes."""
    n = len(s.data) - target + 1
    if n <= 0:
        zero = np.zeros(0, np.int64)
        return zero, zero, zero, zero, np.zeros(0, U)
    doc = np.repeat(np.arange(len(s.offsets) - 1, dtype=np.int32), np.diff(s.offsets))
    valid = doc[:n] == doc[target - 1 :]
    short = BYTES.windows(BYTES.byte[s.data], anchor)
    at = minimum_of(short, target - anchor + 1)
    at[~valid] = -1
    edge = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[edge[1:], n] - 1
    real = at[edge] >= 0
    lo, hi = edge[real], last[real]
    return lo, hi, at[lo], doc[lo], short


def _emit_blocks(target: int, anchor: int):
    def emit(batch: pa.RecordBatch):
        for whole in slices(_column(batch, "text"), PIECE):
            for s, base in _pieces(whole, target, PIECE):
                lo, hi, at, doc, short = _blocks(s, target, anchor)
                if len(lo):
                    body = BLOCK.spans(BLOCK.prefix(BLOCK.byte[s.data]), lo, hi + target)
                    key = mix(body ^ ((at - lo).astype(U) * U(0x9E3779B97F4A7C15)))
                    yield rids(batch, s.rows), doc, lo - s.offsets[doc] + base, key, short[at]

    return emit


def _starts(s: Slice, base: int, lists: list, size: int) -> np.ndarray:
    """Marks at listed places of the slice's texts."""
    out = np.zeros(size, bool)
    for lo, hi, raw in zip(s.offsets[:-1], s.offsets[1:], lists, strict=True):
        if raw is not None:
            at = loose(raw, np.uint32).astype(np.int64) - base
            out[lo + at[(at >= 0) & (at < hi - lo)]] = True
    return out


def _emit_suffixes(target: int, anchor: int):
    def emit(batch: pa.RecordBatch):
        asked = _column(batch, "open").to_pylist()
        for whole in slices(_column(batch, "text"), PIECE):
            for s, base in _pieces(whole, target, PIECE):
                lo, hi, _, doc, _ = _blocks(s, target, anchor)
                if len(lo):
                    mine = _starts(s, base, [asked[i] for i in s.rows], len(s.data))[lo]
                    lo, hi, doc = lo[mine], hi[mine], doc[mine]
                if len(lo):
                    n = hi - lo + 1
                    at = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                    doc = np.repeat(doc, n)
                    key = SUFFIX.spans(SUFFIX.prefix(SUFFIX.byte[s.data]), at, at + target)
                    yield rids(batch, s.rows), doc, at - s.offsets[doc] + base, key, None

    return emit


def _remove(target: int, anchor: int, schema: pa.Schema):
    def run(batches):
        for batch in batches:
            blocks, single, ids = _column(batch, "hit").to_pylist(), _column(batch, "suffix").to_pylist(), _column(batch, "id")
            for whole in slices(_column(batch, "text"), PIECE):
                change = np.zeros(len(whole.data) + 1, np.int32)
                if any(blocks[i] is not None or single[i] is not None for i in whole.rows):
                    for s, base in _pieces(whole, target, PIECE):
                        lo, hi, *_ = _blocks(s, target, anchor)
                        settled = _starts(s, base, [blocks[i] for i in s.rows], len(s.data))[lo]
                        np.add.at(change, lo[settled] + base, 1)
                        np.add.at(change, hi[settled] + base + target, -1)
                    at = np.flatnonzero(_starts(whole, 0, [single[i] for i in whole.rows], len(whole.data)))
                    np.add.at(change, at, 1)
                    np.add.at(change, at + target, -1)
                gone = np.cumsum(change[:-1]) > 0
                doc, lo, hi = runs(gone, whole.offsets)
                stay = whole.data[~gone]
                edge = np.r_[0, np.cumsum(~gone)][whole.offsets]
                n = len(whole.rows)
                kept = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(stay)])
                size = np.diff(whole.offsets)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(whole.rows[0], n), pa.array(size), pa.array(size - np.diff(edge)), pa.array(np.bincount(doc, minlength=n).astype(np.int64)), kept, span_lists(doc, lo, hi, n).cast(schema.field("spans").type)],
                    schema=schema,
                )

    return run


def suffix_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", target: int = TARGET, anchor: int = ANCHOR) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept, spans): bytes of texts outside of repeated strings of `target` bytes.

    kept holds the remaining bytes; a cut may fall inside a character. spans are removed byte ranges.
    """
    rows = keyed(docs, doc_id, text)
    found = find_blocks(rows, _emit_blocks(target, anchor)).drop("hits")
    rows = cut(rows.join(found, ["rid1", "rid2"], "left"), "blocks")
    touched = rows.where("hit is not null or open is not null")
    asked = touched.where("open is not null")
    found = find_repeats(asked, _emit_suffixes(target, anchor), buckets_of(asked, weight=4)).drop("hits").withColumnRenamed("hit", "suffix")
    done = rows.where("hit is null and open is null").withColumn("suffix", F.lit(None).cast("binary"))
    rows = touched.join(found, ["rid1", "rid2"], "left").unionByName(done)
    result = RESULT.format(id=rows.schema["id"].dataType.simpleString())
    return rows.select("id", "text", "hit", "suffix").mapInArrow(_remove(target, anchor, arrow_schema(result)), result)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of `documents`: its bytes, the bytes removed in how many runs, and the hash of what is kept."""
    out = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
