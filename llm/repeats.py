"""Which keys occur more than once, for keys far too many to shuffle a row each.

Each task packs the keys of many documents into one row per bucket of the key space: hashes,
positions and a table of documents, as binary columns. A bucket is sorted alone, so memory is
bounded by the number of buckets. The answers are packed the same way by document.

Keys that repeat inside one task are settled there: the task sends one copy of the key, marked
as known to repeat, and answers its documents itself. A key that a third of all documents hold
thus reaches its bucket once per task and not once per document.

Buckets, and the slots that answers are packed into, are as many as the bytes of the texts ask for, whatever
the number of partitions; a packed row holds at least one key or answer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


U = np.uint64
FLUSH = 1_000_000
#: Bytes of texts (or of sets) whose keys make a bucket.
BUCKET_BYTES = 16 << 20
PACKED = "kind int, slot int, ids binary, n binary, pos binary, key binary, extra binary, known binary"
ANSWER = "slot int, flag int, ids binary, n binary, pos binary"
HIT, OPEN = 0, 1


def squeeze(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def loose(raw: bytes | None, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind) if raw else np.zeros(0, kind)


def pack_docs(ids: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Entries sorted by document and position: document table, entries of each, position steps."""
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
    n = np.diff(np.r_[first, len(doc)])
    step = np.diff(pos.astype(np.int64), prepend=0)
    step[first] = pos[first]
    return ids[doc[first]].tobytes(), squeeze(n.astype(np.uint32)), squeeze(step.astype(np.uint32))


def open_docs(ids: bytes, n: bytes, pos: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document table, document of each entry, position of each entry)."""
    table = np.frombuffer(ids, np.int64).reshape(-1, 2)
    n = loose(n, np.uint32).astype(np.int64)
    doc = np.repeat(np.arange(len(n)), n)
    run = np.cumsum(loose(pos, np.uint32).astype(np.int64))
    first = np.cumsum(n) - n
    base = np.where(first > 0, run[first - 1], 0) if len(run) else first
    return table, doc, run - np.repeat(base, n)


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> U(32)) % U(buckets)).astype(np.int64)


def _slot(ids: np.ndarray, slots: int) -> np.ndarray:
    return ((ids[:, 1].astype(np.uint64) >> U(7)) % U(slots)).astype(np.int64)


def _by(slot: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(slot, kind="stable")
    edge = np.flatnonzero(np.r_[True, slot[order][1:] != slot[order][:-1]]) if len(slot) else []
    for i, lo in enumerate(edge):
        yield int(slot[order[lo]]), order[lo : edge[i + 1] if i + 1 < len(edge) else len(order)]


def often(key: np.ndarray, least: int) -> np.ndarray:
    """Whether each key occurs at least so many times in the array."""
    if least <= 2:
        return repeated(key)
    _, same, count = np.unique(key, return_inverse=True, return_counts=True)
    return (count >= least)[same.reshape(-1)]


def repeated(key: np.ndarray) -> np.ndarray:
    """Whether each key occurs more than once in the array."""
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), bool)
    out[order] = np.r_[same, False] | np.r_[False, same]
    return out


def _answers(ids, doc, pos, flag, slots):
    """Answer rows of entries given in (document, position) order."""
    if len(doc):
        slot = _slot(ids, slots)[doc]
        for s, at in _by(slot):
            yield (s, flag, *pack_docs(ids, doc[at], pos[at]))


def _batch(rows: list, schema: str):
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int32() if x.split()[1] == "int" else pa.int64() if x.split()[1] == "long" else pa.binary() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names) if rows else None


class _Buffer:
    """Entries of the documents seen so far in a task."""

    def __init__(self, buckets: int, slots: int, blocks: bool, least: int):
        self.buckets, self.slots, self.blocks, self.least = buckets, slots, blocks, least
        self.clear()

    def clear(self):
        self.ids, self.doc, self.pos, self.key, self.extra, self.size, self.docs = [], [], [], [], [], 0, 0

    def add(self, ids, doc, pos, key, extra):
        self.ids.append(ids)
        self.doc.append(doc + self.docs)
        self.pos.append(pos)
        self.key.append(key)
        self.extra.append(extra if extra is not None else np.zeros(0, U))
        self.size += len(doc)
        self.docs += len(ids)

    def flush(self):
        if not self.docs:
            return
        ids, doc, pos, key = np.concatenate(self.ids), np.concatenate(self.doc), np.concatenate(self.pos), np.concatenate(self.key)
        extra = np.concatenate(self.extra) if self.blocks else None
        self.clear()
        rep = often(key, self.least)
        send = ~rep
        if self.blocks:  # one document of each repeated key may still be asked for its windows
            where = np.flatnonzero(rep)
            _, first = np.unique(key[where], return_index=True)
            send[where[first]] = True
        known = np.unique(key[rep])
        rows = []
        bucket = _bucket(key, self.buckets)
        of_known = dict(_by(_bucket(known, self.buckets)))
        at_send = np.flatnonzero(send)
        for b, at in _by(bucket[at_send]):
            at = at_send[at]
            mine = of_known.pop(b, None)
            rows.append((0, b, *pack_docs(ids, doc[at], pos[at]), key[at].tobytes(), extra[at].tobytes() if self.blocks else b"", known[mine].tobytes() if mine is not None else b""))
        for b, mine in of_known.items():
            rows.append((0, b, b"", squeeze(np.zeros(0, np.uint32)), squeeze(np.zeros(0, np.uint32)), b"", b"", known[mine].tobytes()))
        at = np.flatnonzero(rep)
        for s, _, i, n, p in _answers(ids, doc[at], pos[at], HIT, self.slots):
            rows.append((1, s, i, n, p, b"", b"", b""))
        out = _batch(rows, PACKED)
        if out is not None:
            yield out


def buckets_of(rows: DataFrame, column: str = "text", weight: int = 1) -> int:
    """How many buckets the keys of these rows need; weight: how dense the keys are, 1 for a few to each word."""
    size = rows.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return int(size) * weight // BUCKET_BYTES + 1


def packed(rows: DataFrame, emit: Callable, buckets: int, blocks: bool, least: int = 2) -> DataFrame:
    """emit(batch) yields (ids, doc, pos, key, extra): arrays of one slice of texts, by document and position.

    There are as many slots as buckets.
    """
    slots = buckets

    def run(batches):
        buffer = _Buffer(buckets, slots, blocks, least)
        for batch in batches:
            for entry in emit(batch):
                buffer.add(*entry)
                if buffer.size >= FLUSH or buffer.docs >= FLUSH:
                    yield from buffer.flush()
        yield from buffer.flush()

    return rows.mapInArrow(run, PACKED)


def _opened(table: pa.Table):
    ids, doc, pos, key, extra, known, docs = [], [], [], [], [], [], 0
    for i, n, p, k, e, w in zip(*(table[c].to_pylist() for c in ("ids", "n", "pos", "key", "extra", "known")), strict=True):
        a, d, q = open_docs(i, n, p)
        ids.append(a), doc.append(d + docs), pos.append(q), key.append(np.frombuffer(k, U)), extra.append(np.frombuffer(e, U)), known.append(np.frombuffer(w, U))
        docs += len(a)
    return [np.concatenate(x) for x in (ids, doc, pos, key, extra, known)]


def _through(table: pa.Table) -> pa.Table:
    """Answers that a task gave itself."""
    return pa.table({"slot": table["slot"], "flag": pa.array([HIT] * len(table), pa.int32()), "ids": table["ids"], "n": table["n"], "pos": table["pos"]})


def _table(rows: list, schema: str) -> pa.Table:
    out = _batch(rows, schema)
    if out is None:
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [pa.int32() if x.split()[1] == "int" else pa.int64() if x.split()[1] == "long" else pa.binary() for x in schema.split(", ")]
        return pa.table({n: pa.array([], k) for n, k in zip(names, kinds, strict=True)})
    return pa.Table.from_batches([out])


def find_repeats(rows: DataFrame, emit: Callable, buckets: int | None = None) -> DataFrame:
    """(rid1, rid2, hit): the positions, as packed uint32, whose key occurs anywhere else too."""
    n = slots = buckets or buckets_of(rows)

    def settle(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        if key[0].as_py() == 1:
            return _through(table)
        ids, doc, pos, key, _, known = _opened(table)
        every = repeated(np.concatenate([key, known, known]))[: len(key)]
        return _table(list(_answers(ids, doc[every], pos[every], HIT, slots)), ANSWER)

    return gathered(packed(rows, emit, n, False).groupBy("kind", "slot").applyInArrow(settle, ANSWER)).select("rid1", "rid2", "hit", "hits")


def find_blocks(rows: DataFrame, emit: Callable, buckets: int | None = None) -> DataFrame:
    """(rid1, rid2, hit, open) for entries whose key is a block and whose extra is the block's anchor.

    hit: the block occurs anywhere else too. open: the block's anchor also stands in a different
    block, so single windows must be compared; of equal blocks, one is enough and only that is asked.
    """
    n = slots = buckets or buckets_of(rows)

    def settle(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        if key[0].as_py() == 1:
            done = _through(table)
            empty = pa.array([b""] * len(done), pa.binary())
            zero = pa.array([1] * len(done), pa.int32())
            return pa.table({"kind": zero, "slot": done["slot"], "ids": done["ids"], "n": done["n"], "pos": done["pos"], "key": empty, "extra": empty, "known": empty})
        ids, doc, pos, block, anchor, known = _opened(table)
        every = repeated(np.concatenate([block, known, known]))[: len(block)]
        rows = [(1, s, i, c, p, b"", b"", b"") for s, _, i, c, p in _answers(ids, doc[every], pos[every], HIT, slots)]
        _, first = np.unique(block, return_index=True)  # one entry of each block goes on, to its anchor's bucket
        at = np.sort(first)
        two = repeated(anchor[at])
        sure = at[two]  # different blocks with this anchor are already here
        rows += [(2, s, i, c, p, b"", b"", b"") for s, _, i, c, p in _answers(ids, doc[sure], pos[sure], OPEN, slots)]
        ask, twice = at[~two], np.unique(anchor[sure])
        of_twice = dict(_by(_bucket(twice, n)))
        for b, x in _by(_bucket(anchor[ask], n)):
            x = ask[x]
            mine = of_twice.pop(b, None)
            rows.append((0, b, *pack_docs(ids, doc[x], pos[x]), anchor[x].tobytes(), b"", twice[mine].tobytes() if mine is not None else b""))
        for b, mine in of_twice.items():
            rows.append((0, b, b"", squeeze(np.zeros(0, np.uint32)), squeeze(np.zeros(0, np.uint32)), b"", b"", twice[mine].tobytes()))
        return _table(rows, PACKED)

    def settle_anchors(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        kind = key[0].as_py()
        if kind > 0:
            out = _through(table)
            return out if kind == 1 else out.set_column(1, "flag", pa.array([OPEN] * len(out), pa.int32()))
        ids, doc, pos, anchor, _, known = _opened(table)
        every = repeated(np.concatenate([anchor, known, known]))[: len(anchor)]
        return _table(list(_answers(ids, doc[every], pos[every], OPEN, slots)), ANSWER)

    first = packed(rows, emit, n, True).groupBy("kind", "slot").applyInArrow(settle, PACKED)
    return gathered(first.groupBy("kind", "slot").applyInArrow(settle_anchors, ANSWER))


def _merged(table: pa.Table):
    """(document table, document, position, flag) of all answers of a slot."""
    ids, doc, pos, flag, docs = [], [], [], [], 0
    for f, i, n, p in zip(np.asarray(table["flag"]), table["ids"].to_pylist(), table["n"].to_pylist(), table["pos"].to_pylist(), strict=True):
        a, d, q = open_docs(i, n, p)
        ids.append(a), doc.append(d + docs), pos.append(q), flag.append(np.full(len(d), f))
        docs += len(a)
    ids, doc, pos, flag = (np.concatenate(x) for x in (ids, doc, pos, flag))
    one, same = np.unique(ids, axis=0, return_inverse=True)
    return one, same.reshape(-1)[doc], pos, flag


def gathered(answers: DataFrame) -> DataFrame:
    """(rid1, rid2, hit, open): the answers to each document, as sorted packed uint32."""

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table_ids, doc, pos, flag = _merged(table)
        order = np.lexsort((pos, flag, doc))
        doc, pos, flag = doc[order], pos[order].astype(np.uint32), flag[order]
        edge = np.searchsorted(doc, np.arange(len(table_ids) + 1))
        hits = np.searchsorted(doc * 2 + flag, np.arange(len(table_ids)) * 2 + 1)
        hit = [squeeze(pos[edge[i] : hits[i]]) for i in range(len(table_ids))]
        still = [squeeze(pos[hits[i] : edge[i + 1]]) for i in range(len(table_ids))]
        return pa.table({"rid1": pa.array(table_ids[:, 0]), "rid2": pa.array(table_ids[:, 1]), "hit": pa.array(hit, pa.binary()), "open": pa.array(still, pa.binary()), "hits": pa.array(hits - edge[:-1])})

    return answers.groupBy("slot").applyInArrow(merge, "rid1 long, rid2 long, hit binary, open binary, hits long")


def find_classes(rows: DataFrame, emit: Callable, cap: int = 6, buckets: int | None = None) -> DataFrame:
    """(rid1, rid2, pos, cls) of keys that occur more than once: cls is the binary logarithm of how often, at most cap.

    A key seen 2^cap times inside one task has class cap, so its other holders need not be sent.
    """
    n = slots = buckets or buckets_of(rows, "items")
    kinds = "slot int, flag int, ids binary, n binary, pos binary"

    def classes(key: np.ndarray, known: np.ndarray) -> np.ndarray:
        _, same, count = np.unique(key, return_inverse=True, return_counts=True)
        cls = np.minimum(cap, np.floor(np.log2(count)).astype(np.int64))[same.reshape(-1)]
        cls[np.isin(key, known)] = cap
        return cls

    def settle(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        if key[0].as_py() == 1:
            return _through(table).set_column(1, "flag", pa.array([cap] * len(table), pa.int32()))
        ids, doc, pos, key, _, known = _opened(table)
        cls = classes(key, known)
        rows = []
        for c in range(1, cap + 1):
            at = np.flatnonzero(cls == c)
            rows += _answers(ids, doc[at], pos[at], c, slots)
        return _table(rows, kinds)

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, doc, pos, cls = _merged(table)
        order = np.lexsort((pos, doc))
        doc, pos, cls = doc[order], pos[order].astype(np.uint32), cls[order].astype(np.uint8)
        edge = np.searchsorted(doc, np.arange(len(ids) + 1))
        cut_up = [[a[edge[i] : edge[i + 1]].tobytes() for i in range(len(ids))] for a in (pos, cls)]
        return pa.table({"rid1": pa.array(ids[:, 0]), "rid2": pa.array(ids[:, 1]), "pos": pa.array(cut_up[0], pa.binary()), "cls": pa.array(cut_up[1], pa.binary())})

    entries = packed(rows, emit, n, False, 1 << cap)
    return entries.groupBy("kind", "slot").applyInArrow(settle, kinds).groupBy("slot").applyInArrow(merge, "rid1 long, rid2 long, pos binary, cls binary")


def minimum_of(values: np.ndarray, width: int) -> np.ndarray:
    """For each start of `width` values, the place of the smallest (the leftmost of equals)."""
    bits = U(max(1, int(len(values)).bit_length()))
    ranked = ((values >> bits) << bits) | np.arange(len(values)).astype(U)
    span = 1
    while span * 2 <= width:
        ranked = np.minimum(ranked[:-span], ranked[span:])
        span *= 2
    if span < width:
        ranked = np.minimum(ranked[: len(ranked) - (width - span)], ranked[width - span :])
    return (ranked & ((U(1) << bits) - U(1))).astype(np.int64)


def rids(batch: pa.RecordBatch, rows: np.ndarray) -> np.ndarray:
    return np.stack([np.asarray(batch.column(batch.schema.get_field_index(c)))[rows] for c in ("rid1", "rid2")], 1)
