"""Benchmark decontamination with a positional inverted index over the training texts.

`build_index` stores, for each document, the positions of each term (posting lists, partitioned by
document), for the terms that a fixed-size bitmap of the benchmark's vocabulary lets through: all
terms of the benchmark and a few others. `search_index` takes the benchmark's windows in slices of
at most `SLICE_WORDS` words. For a slice it counts its terms over the whole index; each window
starts from the posting list of its rarest term, shifted by the term's offset, and is intersected
with the shifted lists of the next rarest terms until all agree (an exact phrase) or none is left.
Starts that keep at least `near` of `window` terms in place, but not all, are proximity matches; items
shorter than `window` must keep the same share (with 8 of 10: all but one of 5 to 9 words, all of fewer).
With k terms allowed to differ, one of the k + 1 rarest is in place, so the lists of these give all starts.

All lists of a document lie in one row, so intersecting needs no shuffle; only matches travel.

Handled cases: null and empty texts have no words and no hits; benchmark items without words match
nothing, items shorter than `window` are one window of all their words; a null item id counts as an
item named by the empty string; repeated rows and items are each counted; null document ids stay.
Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.shared import cut, keyed, small, with_keys
from llm.textkernel import ALNUM, U, mix, runs, slices, words

WINDOW, NEAR = 10, 8
SLICE_WORDS = 100_000
#: Starts of proximity matches that are looked at together.
STARTS = 1_000_000
BITS = 24
INDEX = "id {id}, rid1 long, rid2 long, n_words long, terms binary, counts binary, places binary"
MATCHES = "rid1 long, rid2 long, spans array<struct<start:int,end:int>>, items array<string>, near array<string>"


def _column(batch, name):
    return batch.column(batch.schema.get_field_index(name))


def _flat(column, kind) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column as one array, and how many each row has."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), kind), np.array([len(x) for x in raw]) // np.dtype(kind).itemsize


def _vocabulary(bench: DataFrame, text: str) -> np.ndarray:
    """A bitmap of 2^BITS bits of the hashes of all terms; its size does not depend on the input."""

    def run(batches):
        seen = np.zeros(1 << BITS, bool)
        for batch in batches:
            for s in slices(_column(batch, "text")):
                seen[words(s, ALNUM, True).hash >> U(64 - BITS)] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen))], ["bit"])

    # one block of bits per row: at most 2^BITS / 64 numbers come to the driver
    bits = bench.select(F.col(text).alias("text")).mapInArrow(run, "bit long")
    rows = bits.groupBy(F.shiftright("bit", 6).alias("block")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask")).toArrow()
    out = np.zeros(1 << (BITS - 6), U)
    out[np.asarray(rows["block"])] = np.asarray(rows["mask"]).view(U)
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool)


def _index(vocabulary: bytes, id_type: pa.DataType):
    def run(batches):
        wanted = np.unpackbits(np.frombuffer(vocabulary, np.uint8), bitorder="little").view(bool)
        for batch in batches:
            for s in slices(_column(batch, "text")):
                w = words(s, ALNUM, True)
                at = np.flatnonzero(wanted[w.hash >> U(64 - BITS)])
                doc = np.searchsorted(w.offsets, at, "right") - 1
                term = w.hash[at]
                order = np.lexsort((term, doc))  # stable: positions of a term stay in order
                at, doc, term = at[order], doc[order], term[order]
                new = np.r_[True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])] if len(at) else np.zeros(0, bool)
                first = np.flatnonzero(new)
                place = at - w.offsets[doc]
                step = np.diff(place, prepend=0)
                step[first] = place[first]
                n = np.diff(np.r_[first, len(at)]).astype(np.uint32)
                n_docs = len(s.rows)
                by_term = np.searchsorted(doc[first], np.arange(n_docs + 1))
                by_place = np.searchsorted(doc, np.arange(n_docs + 1))
                binary = lambda a, edge: pa.Array.from_buffers(pa.binary(), n_docs, [None, pa.py_buffer((edge * a.dtype.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(a))])
                yield pa.RecordBatch.from_arrays(
                    [_column(batch, c).slice(s.rows[0], n_docs) for c in ("id", "rid1", "rid2")]
                    + [pa.array(np.diff(w.offsets)), binary(term[first], by_term), binary(n, by_term), binary(step.astype(np.uint32), by_place)],
                    ["id", "rid1", "rid2", "n_words", "terms", "counts", "places"],
                )

    return run


def build_index(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text", bench_text: str = "text") -> DataFrame:
    """The stored posting lists of docs, for the terms of bench: a row per document (schema INDEX)."""
    rows = keyed(docs, doc_id, text)
    vocabulary = np.packbits(_vocabulary(bench, bench_text), bitorder="little").tobytes()
    return cut(rows.mapInArrow(_index(vocabulary, None), INDEX.format(id=rows.schema["id"].dataType.simpleString())), "index")


def _phrases(window: int, piece: int):
    """Benchmark words in pieces of bounded length that share window - 1 words."""

    def run(batches):
        for batch in batches:
            for s in slices(_column(batch, "text")):
                w = words(s, ALNUM, True)
                for i, lo, hi in zip(s.rows, w.offsets[:-1], w.offsets[1:], strict=True):
                    starts = range(lo, max(hi - window + 1, lo + 1), piece) if hi > lo else ()
                    cuts = [w.hash[a : min(a + piece + window - 1, hi)].tobytes() for a in starts]
                    if cuts:
                        yield pa.RecordBatch.from_arrays([pa.array([_column(batch, "item")[int(i)].as_py()] * len(cuts), pa.string()), pa.array(cuts, pa.binary()), pa.array([len(x) // 8 for x in cuts], pa.int64())], ["item", "body", "n"])

    return run


def _term_counts(terms: np.ndarray):
    def run(batches):
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            term, _ = _flat(_column(batch, "terms"), U)
            count, _ = _flat(_column(batch, "counts"), np.uint32)
            at = np.minimum(np.searchsorted(terms, term), len(terms) - 1)
            ours = terms[at] == term
            total += np.bincount(at[ours], count[ours], len(terms)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], ["at", "n"])

    return run


class _Plan:
    """Windows of a slice: terms by number, offsets from the rarest term on, and the items they belong to."""

    def __init__(self, items: list[str], bodies: list[np.ndarray], window: int, terms: np.ndarray, counts: np.ndarray):
        self.terms = terms
        self.names = items
        rows, owner, size = [], [], []
        for i, body in enumerate(bodies):
            n = min(window, len(body))
            at = np.arange(len(body) - n + 1)[:, None] + np.arange(window)
            part = np.where(np.arange(window) < n, np.searchsorted(terms, body[np.minimum(at, len(body) - 1)]), -1)
            rows.append(part)
            owner.append(np.full(len(part), i))
            size.append(np.full(len(part), n))
        self.body, self.owner, self.size = np.concatenate(rows).astype(np.int32), np.concatenate(owner).astype(np.int32), np.concatenate(size).astype(np.int32)
        rare = np.where(self.body < 0, np.iinfo(np.int64).max, counts[self.body])
        self.order = np.argsort(rare, axis=1, kind="stable").astype(np.int16)

    def anchored(self, rank: int):
        """Windows by their rank-th rarest term: list bounds by term, windows, offsets."""
        return self._lists(np.flatnonzero(self.size > rank), rank)

    def spared(self, near: int) -> np.ndarray:
        """How many terms of each window a proximity match may lack."""
        return self.size * (self.body.shape[1] - near) // self.body.shape[1]

    def near_anchors(self, near: int) -> list:
        """Lists as of `anchored` that hold, for each window, one rank more than it may lack terms."""
        spared = self.spared(near)
        return [self._lists(np.flatnonzero((self.size > rank) & (spared >= rank) & (spared > 0)), rank) for rank in range(spared.max(initial=0) + 1)]

    def _lists(self, some: np.ndarray, rank: int):
        offset = self.order[some, rank]
        term = self.body[some, offset]
        by = np.argsort(term, kind="stable")
        return np.searchsorted(term[by], np.arange(len(self.terms) + 1)), some[by], offset[by]


def _search(plan: _Plan, near: int):
    first, width = plan.anchored(0), plan.body.shape[1]
    anchors, spared = (plan.near_anchors(near), plan.spared(near)) if near else ([], None)

    def starts(term, place, doc, begin, n_words, lists):
        """Every (window, document, start) that the shifted posting lists of the anchors give."""
        edge, window, offset = lists
        n = edge[term + 1] - edge[term]
        posting = np.repeat(np.arange(len(term)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + edge[term][posting]
        win = window[at]
        start = place[posting] - offset[at]
        fits = (start >= 0) & (start + plan.size[win] <= n_words[doc[posting]])
        return win[fits], doc[posting][fits], start[fits]

    def pieces(n):
        """Slices of postings that give about STARTS starts each, n starts a posting."""
        edge = np.flatnonzero(np.diff(np.cumsum(n) // STARTS, prepend=0))
        return [slice(a, b) for a, b in zip(np.r_[0, edge], np.r_[edge, len(n)], strict=True) if b > a]

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                term, per_doc = _flat(_column(batch, "terms"), U)
                count, _ = _flat(_column(batch, "counts"), np.uint32)
                place, per_place = _flat(_column(batch, "places"), np.uint32)
                n_words = np.asarray(_column(batch, "n_words"))
                count = count.astype(np.int64)
                run_sum = np.cumsum(place.astype(np.int64))
                head = np.cumsum(count) - count
                place = run_sum - np.repeat(np.where(head > 0, run_sum[head - 1], 0) if len(run_sum) else head, count)
                number = np.minimum(np.searchsorted(plan.terms, term), len(plan.terms) - 1)
                number = np.where(plan.terms[number] == term, number, -1)
                doc = np.repeat(np.repeat(np.arange(len(n_words)), per_doc), count)
                number = np.repeat(number, count)
                ours = number >= 0
                number, place, doc = number[ours], place[ours], doc[ours]
                begin = np.cumsum(n_words) - n_words
                # the lists side by side: which term stands at each place
                at_place = np.full(n_words.sum() + width, -2, np.int32)
                at_place[begin[doc] + place] = number
                win, d, start = starts(number, place, doc, begin, n_words, first)
                for rank in range(1, width):  # from the rarest on
                    offset = plan.order[win, rank]
                    agree = (plan.size[win] <= rank) | (at_place[begin[d] + start + offset] == plan.body[win, offset])
                    win, d, start = win[agree], d[agree], start[agree]
                exact = win, d, start
                close = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
                for lists in anchors:
                    for part in pieces(np.diff(lists[0])[number]):
                        win, d, start = starts(number[part], place[part], doc[part], begin, n_words, lists)
                        lacks = np.zeros(len(win), np.int8)
                        for rank in range(width):  # from the rarest on
                            offset = plan.order[win, rank]
                            lacks += (plan.size[win] > rank) & (at_place[begin[d] + start + offset] != plan.body[win, offset])
                            still = lacks <= spared[win]
                            win, d, start, lacks = win[still], d[still], start[still], lacks[still]
                        close.append((win[lacks > 0], d[lacks > 0]))
                out = _rows(plan, n_words, exact, tuple(np.concatenate(x) for x in zip(*close, strict=True)))
                if out:
                    rid = [np.asarray(_column(batch, c)) for c in ("rid1", "rid2")]
                    docs = [o[0] for o in out]
                    yield pa.RecordBatch.from_arrays([pa.array(r[docs]) for r in rid] + [pa.array([o[k] for o in out], t) for k, t in ((1, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), (2, pa.list_(pa.string())), (3, pa.list_(pa.string())))], ["rid1", "rid2", "spans", "items", "near"])

    return run


def _rows(plan: _Plan, n_words: np.ndarray, exact, close) -> list:
    win, doc, start = exact
    offsets = np.r_[0, np.cumsum(n_words)]
    change = np.zeros(offsets[-1] + 1, np.int64)
    np.add.at(change, offsets[doc] + start, 1)
    np.add.at(change, offsets[doc] + start + plan.size[win], -1)
    of, lo, hi = runs(np.cumsum(change[:-1]) > 0, offsets)
    found = np.unique(np.stack([doc, plan.owner[win]], 1), axis=0)
    beside = np.unique(np.stack([close[1], plan.owner[close[0]]], 1), axis=0)
    out = []
    for d in np.unique(np.concatenate([found[:, 0], beside[:, 0]])):
        a, b = np.searchsorted(of, [d, d + 1])
        names = [sorted({plan.names[i] for i in x[np.searchsorted(x[:, 0], d) : np.searchsorted(x[:, 0], d + 1), 1]}) for x in (found, beside)]
        out.append((int(d), [{"start": int(x), "end": int(y)} for x, y in zip(lo[a:b], hi[a:b], strict=True)], *names))
    return out


def search_index(index: DataFrame, bench: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, near: int = NEAR) -> DataFrame:
    """(rid1, rid2, spans, items, near) of documents with matches: word ranges and items of exact phrases, items of proximity matches."""
    source = bench.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    # distinct: items count once, and rows repeated as a whole would all fall into one slice
    phrases = cut(source.mapInArrow(_phrases(window, SLICE_WORDS // 10), "item string, body binary, n long").distinct(), "phrases")
    total = phrases.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = None
    slices_n = -(-total // SLICE_WORDS)
    for k in range(slices_n):
        part = phrases.where(F.pmod(F.xxhash64("item", "body"), F.lit(slices_n)) == k).toArrow()
        bodies = [np.frombuffer(x, U) for x in part["body"].to_pylist()]
        if not bodies:
            continue
        terms = np.unique(np.concatenate(bodies))
        counted = index.select("terms", "counts").mapInArrow(_term_counts(terms), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(len(terms), np.int64)
        counts[np.asarray(counted["at"])] = np.asarray(counted["n"])
        plan = _Plan(part["item"].to_pylist(), bodies, window, terms, counts)
        hits = index.drop("id").mapInArrow(_search(plan, near), MATCHES)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return index.sparkSession.createDataFrame([], MATCHES)
    flat = lambda c: F.array_distinct(F.flatten(F.collect_set(c))).alias(c)
    return found.groupBy("rid1", "rid2").agg(flat("spans"), flat("items"), flat("near"))


def covered(spans) -> F.Column:
    """How many words the spans cover together."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(acc, x):
        return F.struct(F.greatest(acc["end"], x["end"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(acc["end"], x["start"]))).alias("n"))

    return F.aggregate(F.array_sort(spans), start, add, lambda acc: acc["n"])


def decontaminate(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, rid1, rid2, n_words, n_hit, spans, items, near): what each document shares with the benchmark."""
    index = build_index(docs, bench, doc_id, text)
    found = search_index(index, bench)
    out = index.select("id", "rid1", "rid2", "n_words").join(found, ["rid1", "rid2"], "left")
    empty = F.array().cast("array<string>")
    return out.withColumn("n_hit", F.coalesce(covered("spans"), F.lit(0).cast("long"))).withColumns({"items": F.coalesce("items", empty), "near": F.coalesce("near", empty)})


def uncontaminated(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that hold no benchmark window."""
    hit = decontaminate(docs, bench, doc_id, text).where("n_hit > 0").select("rid1", "rid2").distinct()
    return with_keys(docs, doc_id, text).join(small(hit), ["rid1", "rid2"], "left_anti").select("row.*")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of `documents`: words inside benchmark windows and the items these come from."""
    out = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join(F.array_sort("items"), ","), "utf-8"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = """
with d as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) as w from documents),
b as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
bw as (select item_id, n, array_to_string(w[i : i + n - 1], ' ') as k
  from (select item_id, w, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as k
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
m as (select doc_id, dw.n, i, item_id from dw join bw on dw.k = bw.k and dw.n = bw.n),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from m) group by doc_id),
items as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from m group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join items using (doc_id)
"""
