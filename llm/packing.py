"""Packs documents into sequences of a fixed number of tokens, by linear grouping.

Lengths are whole numbers up to the capacity, so their histogram has a bounded size whatever the data, and
the whole plan is made from it:

1. Large lengths (above a third of the capacity, or a smaller part), longest first, are dealt to `GROUPS` groups of equal
   cardinality; every length is rounded up to the largest of its group.
2. How often to use which configuration of these few sizes is a linear program, solved by column generation
   (the next configuration is a knapsack at the dual prices). Whole parts are taken; what is left over is
   packed first-fit.
3. Actual documents, in order of length, replace the rounded ones: the n-th longest of a group takes the
   n-th place of its size. What each sequence has left is then a step function with few steps.
4. Small lengths, longest first, go into the sequences with the least room that takes them; sequences of
   the same room are filled together as a range, so the plan stays small. New sequences are opened last.

A piece's place is a function of its length and of its rank among the pieces of that length. Ranks are
numbers inside buckets of a few thousand pieces plus the counts of the buckets before, so a length that a
third of all pieces have is no large group. Texts are shuffled nowhere.

Tokens: the normaliser, the splitter and the special tokens never join characters across white space, nor a
letter or digit with a stop after it, and lower-case A-Z. So texts are lower-cased, cut there, and every
distinct chunk is tokenised once.

Handled cases: null and empty texts are one token, the end of document; texts longer than the capacity
are cut and nothing else is; repeated rows are documents of their own; null and repeated ids stay a row
per row; ties in length go by a hash of id and text; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

import os
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.shared import arrow_schema, cut, keyed
from llm.textkernel import slices

CAPACITY, END_ID, TOKENIZER = 4096, 1, "word_bpe_49k.json"
#: Large lengths are rounded to so many sizes; lengths up to capacity / part are small. The part that needs the fewest
#: sequences is taken; parts are tried until the plan is within NEAR of what all tokens need at least.
GROUPS, SMALL_PARTS, NEAR = 128, (3, 4, 8), 1.0005
#: Pieces of one length are numbered in buckets of about so many.
BUCKET = 4096
#: Distinct chunks a task keeps the ids of, and how many are tokenised at a time; bytes of texts taken together.
CHUNKS, AT_ONCE, SLICE = 1_000_000, 8192, 1 << 23
#: Configurations that column generation tries at most; fewer only make the plan less tight.
TURNS = 3000


class ChunkTokenizer:
    """Token ids of texts, each distinct chunk between ASCII white space tokenised once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self):
        self.seen = pa.array([], pa.string())
        self.ids, self.count = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each text's begin)."""
        if len(self.seen) > CHUNKS:
            self.clear()
        texts = pc.replace_substring_regex(texts.fill_null(""), r"([A-Za-z0-9])([.,;:!?])", r"\1 \2")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # no special token whose case matters
            texts = pc.ascii_lower(texts)
        chunks = pc.ascii_split_whitespace(texts)
        edge = np.asarray(chunks.offsets).astype(np.int64) - chunks.offsets[0].as_py()
        coded = chunks.flatten().dictionary_encode()
        known = pc.index_in(coded.dictionary, value_set=self.seen)
        new = coded.dictionary.filter(pc.is_null(known))
        ids, size = [self.ids], [self.count]
        for lo in range(0, len(new), AT_ONCE):
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(new.slice(lo, AT_ONCE).to_pylist(), add_special_tokens=False)]
            size.append(np.fromiter(map(len, lists), np.int64, len(lists)))
            ids.append(np.fromiter(chain.from_iterable(lists), np.uint32, int(size[-1].sum())))
        place = np.asarray(known.fill_null(-1)).astype(np.int64)
        place[place < 0] = len(self.seen) + np.arange(len(new))
        self.seen = pa.concat_arrays([self.seen, new])
        self.ids, self.count = np.concatenate(ids), np.concatenate(size)
        first = np.cumsum(self.count) - self.count
        at = place[np.asarray(coded.indices)]
        n = self.count[at]
        end = np.r_[0, np.cumsum(n)]
        return self.ids[np.repeat(first[at] - end[:-1], n) + np.arange(end[-1])], end[edge]


def _tokenise(path: str, capacity: int, end_id: int, schema: pa.Schema):
    def run(batches):
        tokens = ChunkTokenizer(path)
        for batch in batches:
            for s in slices(batch["text"], SLICE):
                texts = batch["text"].slice(s.rows[0], len(s.rows))
                ids, edge = tokens(texts)
                row, piece, start, size, crc, part = [], [], [], [], [], []
                for i, (lo, hi) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
                    own = np.r_[ids[lo:hi], np.uint32(end_id)].astype("<u4")
                    for k, at in enumerate(range(0, len(own), capacity)):
                        mine = own[at : at + capacity]
                        row.append(s.rows[i]), piece.append(k), start.append(at), size.append(len(mine)), crc.append(zlib.crc32(mine.tobytes())), part.append(mine)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(np.concatenate(part).astype(np.int32)))
                take = batch.select(["id", "rid1", "rid2"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [take["id"].cast(schema.field("id").type), take["rid1"], take["rid2"], pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64()), lists.cast(schema.field("ids").type)],
                    schema=schema,
                )

    return run


def tokenised(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """(id, rid1, rid2, piece, start, length, ids_crc32, ids): the pieces of every text, its end token included."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    rows = keyed(docs, doc_id, text)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, rid1 long, rid2 long, piece int, start long, length long, ids_crc32 long, ids array<int>"
    return rows.mapInArrow(_tokenise(tokenizer, capacity, end_id, arrow_schema(schema)), schema)


# The plan ----------------------------------------------------------------------------------------


def configurations(size: np.ndarray, demand: np.ndarray, capacity: int, turns: int = TURNS) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, times): a basic solution of the covering linear program over configurations of few sizes."""
    k = len(size)
    basis = np.diag((capacity // size).astype(float))
    inverse = np.diag(1 / np.diag(basis))
    best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for _ in range(turns):
        price = inverse.sum(axis=0)
        least = int(size.min())
        best[:], pick[:] = 0, -1
        order = np.argsort(size)
        s, p = size[order], price[order]
        fits = np.searchsorted(s, np.arange(capacity + 1), "right")
        for room in range(least, capacity + 1):  # an unbounded knapsack at the prices
            value = p[: fits[room]] + best[room - s[: fits[room]]]
            at = int(value.argmax())
            if value[at] > best[room - 1]:
                best[room], pick[room] = value[at], at
            else:
                best[room], pick[room] = best[room - 1], -2
        if best[capacity] <= 1 + 1e-6:
            break
        column, room = np.zeros(k), capacity
        while room >= least and pick[room] != -1:
            if pick[room] == -2:
                room -= 1
            else:
                column[order[pick[room]]] += 1
                room -= int(s[pick[room]])
        into, times = inverse @ column, inverse @ demand
        ratio = np.full(k, np.inf)
        up = into > 1e-9
        ratio[up] = np.maximum(times[up], 0) / into[up]
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
        row = inverse[out] / into[out]
        inverse -= np.outer(into, row)
        inverse[out] = row
    return basis.T.astype(np.int64), np.maximum(inverse @ demand, 0)


@dataclass
class Plan:
    """Where the piece of each length and rank goes; arrays whose size depends on the capacity only."""

    capacity: int
    base: np.ndarray  # by length: its first place in the order of all pieces (longest first)
    count: np.ndarray  # by place in that order, at each change of length: pieces before, tokens before, length
    before: np.ndarray
    tokens: np.ndarray
    length: np.ndarray
    seg_start: np.ndarray  # segments of the order that one configuration takes: first place, end of its group
    seg_end: np.ndarray
    seg_first: np.ndarray  # first sequence of the configuration
    seg_each: np.ndarray  # pieces of the segment in one sequence
    seg_earlier: np.ndarray  # segments of the same configuration that lie before it in a sequence (-1: none)
    run_start: np.ndarray  # ranges of small pieces: first place, first sequence, pieces in each, offset of the first
    run_first: np.ndarray
    run_each: np.ndarray
    run_used: np.ndarray
    large: int
    sequences: int

    def total(self, place: np.ndarray) -> np.ndarray:
        """Tokens of all pieces before a place of the order."""
        at = np.searchsorted(self.before, place, "right") - 1
        return self.tokens[at] + (place - self.before[at]) * self.length[at]

    def held(self, seg: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """Tokens of a segment's pieces in the turn-th sequence of its configuration."""
        lo = self.seg_start[seg] + turn * self.seg_each[seg]
        return self.total(np.minimum(lo + self.seg_each[seg], self.seg_end[seg])) - self.total(np.minimum(lo, self.seg_end[seg]))

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the pieces of these lengths and ranks (from 0)."""
        at = self.base[length] + rank
        sequence, offset = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        big = np.flatnonzero(at < self.large)
        seg = np.searchsorted(self.seg_start, at[big], "right") - 1
        turn = (at[big] - self.seg_start[seg]) // self.seg_each[seg]
        sequence[big] = self.seg_first[seg] + turn
        use = self.total(at[big]) - self.total(self.seg_start[seg] + turn * self.seg_each[seg])
        for other in self.seg_earlier[seg].T:
            has = other >= 0
            use[has] += self.held(other[has], turn[has])
        offset[big] = use
        rest = np.flatnonzero(at >= self.large)
        run = np.searchsorted(self.run_start, at[rest], "right") - 1
        within = at[rest] - self.run_start[run]
        sequence[rest] = self.run_first[run] + within // self.run_each[run]
        offset[rest] = self.run_used[run] + within % self.run_each[run] * length[rest]
        return sequence, offset


def _grouped(start: int, end: int, lengths: np.ndarray, before: np.ndarray, groups: int) -> list[tuple[int, int, int]]:
    """(first place, end, size): groups of equal cardinality; groups of one size are one."""
    out: list[tuple[int, int, int]] = []
    step = max(1, -(-(end - start) // groups))
    for lo in range(start, end, step):
        size = int(lengths[np.searchsorted(before, lo, "right") - 1])
        if out and out[-1][2] == size:
            out[-1] = out[-1][0], min(lo + step, end), size
        else:
            out.append((lo, min(lo + step, end), size))
    return out


def _first_fit(size: list[int], left: list[int], capacity: int) -> list[dict[int, int]]:
    """Bins {group: pieces} of what the whole parts of the program leave, longest first."""
    bins: list[dict[int, int]] = []
    room: list[int] = []
    for g, n in enumerate(left):
        for _ in range(n):
            fit = [b for b, r in enumerate(room) if r >= size[g]]
            if not fit:
                bins.append({}), room.append(capacity)
                fit = [len(bins) - 1]
            b = min(fit, key=room.__getitem__)
            bins[b][g] = bins[b].get(g, 0) + 1
            room[b] -= size[g]
    return bins


def best_plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small_parts: tuple[int, ...] = SMALL_PARTS) -> Plan:
    """The plan with the fewest sequences for so many pieces of each length (1 to capacity)."""
    best, least = None, sum(n * c for n, c in histogram.items()) / capacity
    for part in small_parts:
        plan = make_plan(histogram, capacity, groups, part)
        if best is None or plan.sequences < best.sequences:
            best = plan
        if best.sequences <= max(NEAR * least, least + 1):
            break
    return best


def make_plan(histogram: dict[int, int], capacity: int, groups: int, small_part: int) -> Plan:
    """The plan when lengths up to capacity / small_part are small."""
    count = np.zeros(capacity + 1, np.int64)
    for n, c in histogram.items():
        count[n] = c
    lengths = np.arange(capacity, 0, -1)
    lengths = lengths[count[lengths] > 0]
    n = count[lengths]
    before = np.cumsum(n) - n
    tokens = np.cumsum(n * lengths) - n * lengths
    base = np.zeros(capacity + 1, np.int64)
    base[lengths] = before
    full, large = int(count[capacity]), int(count[capacity // small_part + 1 :].sum())
    total = int(count.sum())
    group = _grouped(full, large, lengths, before, groups)
    segments: list[tuple[int, int, int, int, list[int], int]] = []  # start, end, first sequence, each, earlier, turns
    if full:
        segments.append((0, full, 0, 1, [], full))
    used = full
    if group:
        size = np.array([g[2] for g in group])
        demand = [g[1] - g[0] for g in group]
        patterns, times = configurations(size, np.array(demand, float), capacity)
        todo = [(row, int(t + 1e-6)) for row, t in zip(patterns, times, strict=True) if t + 1e-6 >= 1]
        given = np.zeros(len(group), np.int64)
        for row, t in todo:
            given += row * t
        left = [max(0, d - int(a)) for d, a in zip(demand, given, strict=True)]
        todo += [(np.array([b.get(g, 0) for g in range(len(group))]), 1) for b in _first_fit([int(s) for s in size], left, capacity)]
        taken = [g[0] for g in group]
        for row, t in todo:
            earlier: list[int] = []
            for g in np.flatnonzero(row):
                lo, end = taken[g], group[g][1]
                if lo < end:  # places beyond the group's pieces stay empty
                    segments.append((lo, end, used, int(row[g]), list(earlier), t))
                    earlier.append(len(segments) - 1)
                    taken[g] = lo + int(row[g]) * t
            used += t if earlier else 0
    depth = max((len(s[4]) for s in segments), default=0) or 1
    plan = Plan(
        capacity, base, n, before, tokens, lengths,
        *[np.array([s[i] for s in segments], np.int64) for i in range(4)],
        np.array([s[4] + [-1] * (depth - len(s[4])) for s in segments], np.int64).reshape(-1, depth),
        *[np.zeros(0, np.int64)] * 4, large, used,
    )
    order = np.argsort(plan.seg_start, kind="stable")  # segments are looked up by their first place
    where = np.empty(len(order) + 1, np.int64)
    where[order], where[-1] = np.arange(len(order)), -1
    plan.seg_start, plan.seg_end, plan.seg_first, plan.seg_each = (x[order] for x in (plan.seg_start, plan.seg_end, plan.seg_first, plan.seg_each))
    plan.seg_earlier = where[plan.seg_earlier[order]]
    return _fill(plan, _rooms(plan, segments, where, full), total)


def _rooms(plan: Plan, segments: list, where: np.ndarray, full: int) -> dict[int, list[tuple[int, int]]]:
    """Room left -> ranges (first sequence, how many): one for each step of the step functions."""
    rooms: dict[int, list[tuple[int, int]]] = {}
    by_first: dict[int, list[int]] = {}
    for i, s in enumerate(segments):
        by_first.setdefault(s[2], []).append(i)
    for first, mine in by_first.items():
        if full and first == 0:
            continue
        turns = max(segments[i][5] for i in mine)
        cuts = [np.array([0])]
        for i in mine:
            start, end, _, each, _, _ = segments[i]
            stop = min(end, start + each * turns)
            change = plan.before[np.searchsorted(plan.before, start, "right") : np.searchsorted(plan.before, stop)]
            at = (np.r_[change, stop] - start) // each
            cuts += [at, at + 1]
        cut_at = np.unique(np.concatenate(cuts))
        cut_at = cut_at[cut_at < turns]
        use = sum(plan.held(np.full(len(cut_at), where[i]), cut_at) for i in mine)
        for lo, hi, u in zip(cut_at, np.r_[cut_at[1:], turns], use, strict=True):
            rooms.setdefault(plan.capacity - int(u), []).append((first + int(lo), int(hi - lo)))
    return rooms


def _fill(plan: Plan, rooms: dict[int, list[tuple[int, int]]], total: int) -> Plan:
    """Best fit of the small pieces, ranges of sequences at a time."""
    runs, at = [], plan.large
    there = np.zeros(plan.capacity + 1, bool)
    there[[r for r in rooms if r > 0]] = True
    for size, n in zip(plan.length.tolist(), plan.count.tolist(), strict=True):
        if plan.base[size] < plan.large:
            continue
        while n:
            fit = size + int(there[size:].argmax())
            if not there[fit]:  # none fits: open as many as the rest of this size needs
                fit, need = plan.capacity, -(-n // (plan.capacity // size))
                rooms.setdefault(fit, []).append((plan.sequences, need))
                plan.sequences += need
                there[fit] = True
            first, many = rooms[fit].pop()
            each = min(fit // size, n)
            take = min(many, n // each)
            if take < many:
                rooms[fit].append((first + take, many - take))
            there[fit] = bool(rooms[fit])
            runs.append((at, first, each, plan.capacity - fit))
            at, n, rest = at + take * each, n - take * each, fit - each * size
            if rest:
                rooms.setdefault(rest, []).append((first, take))
                there[rest] = True
    assert at == total
    plan.run_start, plan.run_first, plan.run_each, plan.run_used = (np.array([r[i] for r in runs], np.int64) for i in range(4))
    return plan


# Distributed part ---------------------------------------------------------------------------------


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None, groups: int = GROUPS) -> DataFrame:
    """(id, piece, start, length, ids_crc32, ids, sequence_id, offset): a row per piece of every document.

    ids are the piece's token ids. Columns that are not asked for are not shuffled.
    """
    spark = docs.sparkSession
    pieces = cut(tokenised(docs, doc_id, text, capacity, end_id, tokenizer), "tokens")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = best_plan(histogram, capacity, groups)
    buckets = spark.createDataFrame([(n, c // BUCKET + 1) for n, c in sorted(histogram.items())], "length long, buckets long")
    dealt = pieces.join(F.broadcast(buckets), "length").withColumn("bucket", F.pmod(F.xxhash64("rid1", "rid2", "piece"), "buckets"))
    inside = Window.partitionBy("length", "bucket").orderBy("rid1", "rid2", "piece", "ids_crc32")
    ahead = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("length", "bucket").agg(F.count("*").alias("here")).select("length", "bucket", F.coalesce(F.sum("here").over(ahead), F.lit(0)).alias("ahead"))
    ranked = dealt.withColumn("inside", F.row_number().over(inside)).join(offsets, ["length", "bucket"])

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def placed(length: pa.Array, rank: pa.Array) -> pa.Array:
        sequence, offset = plan.place(np.asarray(length), np.asarray(rank))
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], ["sequence_id", "offset"])

    ranked = ranked.withColumn("to", placed(F.col("length"), F.col("inside") + F.col("ahead") - 1))
    return ranked.select("id", "piece", "start", "length", "ids_crc32", "ids", "to.sequence_id", "to.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, starts): the tokens of every sequence and where its pieces begin; at most `capacity` tokens a row."""
    pieces = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(pieces.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.offset").alias("starts"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document of `documents`, and its place in the packed sequences."""
    out = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
