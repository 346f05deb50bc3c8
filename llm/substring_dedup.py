"""Removes passages of many words that stand elsewhere too, by level-wise doubling.

Level by level, windows of `start`, 2 x start, ... words are compared, the last level being
exactly `target` words. A target window can only repeat if every shorter window in it does, so
of each target window only its smallest-hash sub-window is looked up, and target windows whose
sub-window stands nowhere else drop out: only windows repeated at one length are extended to
twice that length. The loop ends at `target`, or when no candidates survive. At the last level
all surviving windows are compared themselves.

Handled cases: null and empty texts have no words and an empty kept text; texts of fewer than
`target` words keep all their words; repeated rows count as separate documents, so all their
words go if they are long enough; null and repeated ids are kept as they are, a row per row;
other columns are not looked at. No hash is dropped however often it occurs (see `repeats`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.repeats import find_repeats, loose, minimum_of, rids
from llm.shared import arrow_schema, cut, keyed
from llm.textkernel import NON_SPACE, WINDOW, Poly, Words, slices, words

TARGET, START = 35, 18
FINAL = Poly(31)
RESULT = "id {id}, n_words long, n_removed long, kept string, spans array<struct<start:int,end:int>>"


def _levels(start: int, target: int) -> list[int]:
    out = [min(start, target)]
    while out[-1] < target:
        out.append(min(2 * out[-1], target))
    return out


def _column(batch, name):
    return batch.column(batch.schema.get_field_index(name))


def _marked(w: Words, hits: list, length: int) -> np.ndarray:
    out = np.zeros(length, bool)
    for lo, raw in zip(w.offsets, hits, strict=False):
        if raw is not None:
            out[lo + loose(raw, np.uint32).astype(np.int64)] = True
    return out


def _emitter(level: int, target: int, before: int | None):
    """Entries of one level; `before` is the length of the level whose answers the rows carry."""

    def emit(batch: pa.RecordBatch):
        hits = _column(batch, "hit").to_pylist() if before else None
        for s in slices(_column(batch, "text")):
            w = words(s, NON_SPACE, False)
            n = len(w.hash) - target + 1
            if n <= 0:
                continue
            doc = np.repeat(np.arange(len(w.offsets) - 1), np.diff(w.offsets))
            alive = doc[:n] == doc[target - 1 :]
            if before:
                marked = _marked(w, [hits[i] for i in s.rows], len(w.hash))
                alive &= marked[minimum_of(WINDOW.windows(w.hash, before), target - before + 1)]
            if level < target:
                short = WINDOW.windows(w.hash, level)
                at = np.unique(minimum_of(short, target - level + 1)[alive])
                key = short[at]
            else:
                at = np.flatnonzero(alive)
                key = FINAL.windows(w.hash, target)[at]
            if len(at):
                yield rids(batch, s.rows), doc[at], at - w.offsets[doc[at]], key, None

    return emit


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return edge[::2], edge[1::2]


def _remove(target: int, schema: pa.Schema):
    def run(batches):
        for batch in batches:
            hits = _column(batch, "hit").to_pylist()
            ids = _column(batch, "id")
            for s in slices(_column(batch, "text")):
                w = words(s, NON_SPACE, False)
                own = [hits[i] for i in s.rows]
                change = np.zeros(len(w.hash) + 1, np.int64)
                first = np.flatnonzero(_marked(w, own, len(w.hash)))
                np.add.at(change, first, 1)
                np.add.at(change, first + target, -1)
                gone = np.cumsum(change[:-1]) > 0
                # kept bytes: each kept word and a blank after it, except after the last of a text
                width = w.end - w.start
                stay = np.flatnonzero(~gone)
                size = np.r_[0, np.cumsum(width[stay] + 1)]
                body = np.full(size[-1], 0x20, np.uint8)
                take = np.repeat(w.start[stay] - size[:-1], width[stay] + 1) + np.arange(size[-1])
                last = np.zeros(size[-1], bool)
                last[size[1:] - 1] = True
                body[~last] = s.data[take[~last]]
                edge = size[np.searchsorted(stay, w.offsets)]
                raw = body.tobytes()
                kept = [raw[lo : max(lo, hi - 1)].decode("utf-8", "replace") for lo, hi in zip(edge[:-1], edge[1:], strict=True)]
                spans = []
                for d, raw_hit in enumerate(own):
                    lo, hi = _runs(gone[w.offsets[d] : w.offsets[d + 1]]) if raw_hit is not None else ((), ())
                    spans.append([{"start": int(a), "end": int(b)} for a, b in zip(lo, hi, strict=True)])
                n = np.diff(w.offsets)
                dropped = np.r_[0, np.cumsum(gone)]
                dropped = dropped[w.offsets[1:]] - dropped[w.offsets[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(s.rows[0], len(s.rows)).cast(schema.field("id").type), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, schema.field("spans").type)],
                    schema=schema,
                )

    return run


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", target: int = TARGET, start: int = START) -> DataFrame:
    """(id, n_words, n_removed, kept, spans): texts without the words of repeated windows of `target` words.

    spans are the removed word ranges (end exclusive).
    """
    rows = keyed(docs, doc_id, text).withColumn("hit", F.lit(None).cast("binary"))
    done, before = [], None
    for level in _levels(start, target):
        found = find_repeats(rows, _emitter(level, target, before))
        rows = rows.drop("hit").join(found.drop("hits"), ["rid1", "rid2"], "left")
        if level < target:  # texts without a candidate are through and travel no more
            rows = cut(rows, "windows")
            done.append(rows.where("hit is null"))
            rows = rows.where("hit is not null")
        before = level
    for other in done:
        rows = rows.unionByName(other)
    result = RESULT.format(id=rows.schema["id"].dataType.simpleString())
    return rows.select("id", "text", "hit").mapInArrow(_remove(target, arrow_schema(result)), result)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of `documents`: its words, the words removed, and the hash of what is kept."""
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))


ORACLE = """
with w as (
  select doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) as words from documents),
starts as (select doc_id, unnest(range(1, len(words) - 33)) as i, words from w where len(words) >= 35),
win as (select doc_id, i, array_to_string(words[i : i + 34], ' ') as k from starts),
twice as (select k from win group by k having count(*) > 1),
hit as (select distinct doc_id, i + j as p from win semi join twice using (k), (select unnest(range(0, 35)) as j)),
gone as (select doc_id, count(*) as n, list(p) as ps from hit group by doc_id)
select w.doc_id, len(words)::bigint as n_words, coalesce(n, 0)::bigint as n_removed,
  sha256(array_to_string(case when n is null then words else
    list_filter(words, lambda x, p: not list_contains(ps, p)) end, ' ')) as kept_sha256
from w left join gone on w.doc_id is not distinct from gone.doc_id
"""
