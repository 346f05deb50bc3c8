"""Mines phrases whose words belong together, from exact counts of all frequent n-grams of each language.

1. Candidates: the space of n-gram fingerprints is cut into hash partitions. A task counts what it reads and
   sends one packed row per partition; a partition's rows are folded, one after the other, into a
   Misra-Gries summary. Its capacity exceeds the partition's mass divided by the threshold, so what the
   summary loses of any count is below the threshold and every frequent n-gram survives. Masses arrive
   ahead of the counts (rows are sorted so), hence one shuffle. Counts are cut off at the threshold in each
   task, so one very common n-gram does not add to a partition's mass more than that per task.
2. Survivors become a bitmap of at most `MAP_BITS` bits by hash prefix, each partition its own stretch.
3. Exact counts: n-grams that the bitmap knows, and whose shorter parts it knows, are counted as strings.
   The bitmap has no false negatives; false positives are counted too and dropped by their exact count.
4. Candidates are cut in two at every place, and the parts' counts joined. A candidate is dropped if a
   longer one explains most of its occurrences.

Fingerprints have 6 bits more than the logarithm of a bound on the mass (64 at most), partitions hold about
`COUNTERS` counters: both follow from the bytes of the texts, not from the configuration.

Handled cases: null and empty texts have no words; a null language is `und`; texts without any candidate and
empty tables give no rows; phrases never cross a stop, a line or a document; repeated rows are documents of
their own; ties go to the smaller phrase in byte order; ids and other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.repeats import loose, squeeze
from llm.shared import cut
from llm.textkernel import CHUNK, WINDOW, Poly, U, Words, mix, slices, words

LONGEST, LEAST, TOP, SHARE = 4, 30, 2000, 80
COUNTERS, BUCKET_BITS, MAP_BITS = 1 << 20, 20, 27
FLUSH = 1 << 21
OTHER = Poly(59)
OTHER_WINDOW = Poly(61)

#: Bytes of words: all but blanks, tabs and what ends a piece.
STOP = np.zeros(256, bool)
STOP[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
INSIDE = ~STOP
INSIDE[[0x20, 0x09]] = False

PACKED = "bucket long, kind int, mass long, keys binary, counts binary"
COUNTED = "lang string, size int, phrase string, f long"


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending whole numbers as steps, byte plane after byte plane."""
    step = np.diff(keys, prepend=U(0))
    width = max(1, (int(step.max()).bit_length() + 7) // 8) if len(step) else 1
    planes = np.ascontiguousarray(step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + squeeze(planes)


def open_sorted(raw: bytes) -> np.ndarray:
    planes = loose(raw[1:], np.uint8).reshape(raw[0], -1)
    step = np.zeros((planes.shape[1], 8), np.uint8)
    step[:, : raw[0]] = planes.T
    return np.cumsum(step.view("<u8").reshape(-1).astype(U))


class Grams:
    """The n-grams of a slice of texts: for each length, where one may start, and its hash."""

    def __init__(self, w: Words, lang: np.ndarray, longest: int):
        self.words = w
        doc = np.repeat(np.arange(len(w.offsets) - 1), np.diff(w.offsets))
        self.lang = lang[doc] if len(doc) else np.zeros(0, U)
        stops = np.r_[0, np.cumsum(STOP[w.data], dtype=np.int32)]
        joined = (stops[w.start[1:]] == stops[w.end[:-1]]) & (doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, bool)
        self.starts, valid = [], np.ones(len(doc), bool)
        for n in range(1, longest + 1):
            if n > 1:
                valid = valid[:-1] & joined[n - 2 :]
            self.starts.append(valid)
            if len(valid) < 2:
                break

    def hashes(self, n: int) -> np.ndarray:
        """By first word (also where no n-gram may start)."""
        h = WINDOW.windows(self.words.hash, n)
        return mix(h ^ self.lang[: len(h)])


def _slices(batch: pa.RecordBatch, longest: int):
    lang = batch["lang"].dictionary_encode()
    names = lang.dictionary
    code = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in names.to_pylist()], U)
    of_row = np.asarray(lang.indices)
    for s in slices(batch["text"]):
        yield of_row[s.rows], names, Grams(words(s, INSIDE, True), code[of_row[s.rows]], longest)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[edge], np.add.reduceat(counts, edge) if len(edge) else counts


def _count(longest: int, least: int, bits: int, bucket_bits: int):
    """Packed counts of a task's n-grams, a row per partition of the hash space each time the buffer is full."""

    def flush(buffer):
        keys, counts = np.unique(np.concatenate(buffer), return_counts=True)
        counts = np.minimum(counts, least).astype(np.uint8 if least < 256 else np.uint32)
        bucket = (keys >> U(bits - bucket_bits)).astype(np.int64)
        edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        rows = []
        for lo, hi in zip(edge, np.r_[edge[1:], len(keys)], strict=True):
            mass = int(counts[lo:hi].sum(dtype=np.int64))
            rows.append((int(bucket[lo]), 0, mass, None, None))
            rows.append((int(bucket[lo]), 1, 0, pack_sorted(keys[lo:hi]), squeeze(counts[lo:hi])))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "kind", "mass", "keys", "counts"])

    def run(batches):
        buffer, size = [], 0
        for batch in batches:
            for _, _, grams in _slices(batch, longest):
                for n, start in enumerate(grams.starts, 1):
                    buffer.append(grams.hashes(n)[start] >> U(64 - bits))
                    size += len(buffer[-1])
                if size >= FLUSH:
                    yield flush(buffer)
                    buffer, size = [], 0
        if size:
            yield flush(buffer)

    return run


class Summary:
    """A Misra-Gries summary that whole blocks of counts are merged into."""

    def __init__(self, mass: int, least: int):
        self.capacity, self.least, self.lost = mass // least + 1, least, 0
        self.keys, self.counts = np.zeros(0, U), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray):
        self.waiting.append((keys, counts.astype(np.int64)))
        self.size += len(keys)
        if self.size >= max(len(self.keys), COUNTERS):
            self.merge()

    def merge(self):
        self.keys, self.counts = _summed(np.concatenate([self.keys, *[k for k, _ in self.waiting]]), np.concatenate([self.counts, *[c for _, c in self.waiting]]))
        self.waiting, self.size = [], 0
        if len(self.keys) > self.capacity:  # each of capacity + 1 counters gives up as much, so lost <= mass / (capacity + 1)
            at = len(self.keys) - self.capacity - 1
            less = int(np.partition(self.counts, at)[at])
            stay = self.counts > less
            self.keys, self.counts = self.keys[stay], self.counts[stay] - less
            self.lost += less

    def survivors(self) -> np.ndarray:
        """All keys whose count may reach the threshold."""
        self.merge()
        return self.keys[self.counts + self.lost >= self.least]


def _merge(least: int, bits: int, bucket_bits: int, map_bits: int):
    """A stretch of the bitmap for every partition, from rows sorted by partition, masses first."""

    def stretch(bucket, keys):
        bit = np.zeros(1 << (map_bits - bucket_bits), np.uint8)
        at = (keys >> U(bits - map_bits)).astype(np.int64) if bits >= map_bits else (keys << U(map_bits - bits)).astype(np.int64)
        bit[at - (bucket << (map_bits - bucket_bits))] = 1
        return pa.RecordBatch.from_arrays([pa.array([bucket]), pa.array([len(keys)]), pa.array([squeeze(np.packbits(bit, bitorder="little"))], pa.binary())], ["bucket", "survivors", "bits"])

    def run(batches):
        now, mass, summary = None, 0, None
        for batch in batches:
            for bucket, kind, m, keys, counts in zip(*(batch[c].to_pylist() for c in ("bucket", "kind", "mass", "keys", "counts")), strict=True):
                if bucket != now:
                    if summary:
                        yield stretch(now, summary.survivors())
                    now, mass, summary = bucket, 0, None
                if kind == 0:
                    mass += m
                    continue
                summary = summary or Summary(mass, least)
                summary.add(open_sorted(keys), loose(counts, np.uint8 if least < 256 else np.uint32))
        if summary:
            yield stretch(now, summary.survivors())

    return run


def candidates(texts: DataFrame, least: int, longest: int, counters: int = COUNTERS) -> tuple[np.ndarray, int]:
    """(bitmap of the hash prefixes of all n-grams that may occur `least` times, its bits): texts has lang and text."""
    size = texts.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("rows")).first()
    bound = longest * ((size["bytes"] or 0) + size["rows"]) // 2 + 1  # a word has a byte and a byte after it
    bits = min(64, max(24, bound.bit_length() + 6))
    bucket_bits = min(BUCKET_BITS, max(0, (bound // least // counters).bit_length()))
    map_bits = max(bucket_bits + 3, min(MAP_BITS, max(16, (bound // least).bit_length() + 3)))
    packed = texts.mapInArrow(_count(longest, least, bits, bucket_bits), PACKED)
    packed = packed.repartition(1 << bucket_bits, "bucket").sortWithinPartitions("bucket", "kind")
    parts = packed.mapInArrow(_merge(least, bits, bucket_bits, map_bits), "bucket long, survivors long, bits binary")
    bitmap = np.zeros(1 << (map_bits - 3), np.uint8)
    step = len(bitmap) >> bucket_bits
    for r in parts.select("bucket", "bits").toLocalIterator():  # a bitmap of bounded size, stretch by stretch
        bitmap[r["bucket"] * step : (r["bucket"] + 1) * step] = loose(bytes(r["bits"]), np.uint8)
    return bitmap, map_bits


def _strings(w: Words, at: np.ndarray) -> pa.Array:
    """The words at these places."""
    size = w.end[at] - w.start[at]
    edge = np.r_[0, np.cumsum(size)]
    body = w.data[np.repeat(w.start[at] - edge[:-1], size) + np.arange(edge[-1])]
    return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(body)])


def _other_hash(w: Words, at: np.ndarray) -> np.ndarray:
    """A second hash of the words at these places (0 elsewhere), about CHUNK bytes at a time."""
    out, i = np.zeros(len(w.hash), U), 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(w.end[at], w.start[at[i]] + CHUNK, "right")))
        lo = w.start[at[i]]
        out[at[i:j]] = OTHER.spans(OTHER.prefix(OTHER.byte[w.data[lo : w.end[at[j - 1]]]]), w.start[at[i:j]] - lo, w.end[at[i:j]] - lo)
        i = j
    return out


def _grouped(key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one place of each group, its size): places are equal if both hashes are."""
    order = np.argsort(key, kind="stable")
    new = np.r_[True, key[order][1:] != key[order][:-1]]
    differs = np.r_[False, check[order][1:] != check[order][:-1]]
    if (differs & ~new).any():
        order = np.lexsort((check, key))
        new = np.r_[True, (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1])]
    edge = np.flatnonzero(new)
    return order[edge], np.diff(np.r_[edge, len(key)])


def _exact(longest: int, packed_map: bytes, map_bits: int):
    """(lang, size, phrase, f) of n-grams that the bitmap knows, a row per slice of texts; size 0: words of a language."""

    def run(batches):
        bitmap = loose(packed_map, np.uint8)
        for batch in batches:
            for of_row, names, grams in _slices(batch, longest):
                w = grams.words
                langs, total = np.unique(of_row, return_counts=True)
                total = np.array([int(np.diff(w.offsets)[of_row == x].sum()) for x in langs])
                yield pa.RecordBatch.from_arrays([names.take(pa.array(langs)), pa.array(np.zeros(len(langs), np.int32)), pa.array([""] * len(langs), pa.string()), pa.array(total, pa.int64())], ["lang", "size", "phrase", "f"])
                if not len(w.hash):
                    continue
                doc = np.repeat(np.arange(len(w.offsets) - 1), np.diff(w.offsets))
                before, prefix = None, None
                for n, start in enumerate(grams.starts, 1):
                    key = grams.hashes(n)
                    place = (key >> U(64 - map_bits)).astype(np.int64)
                    known = start & ((bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(bool)
                    if before is not None:
                        known &= before[:-1] & before[1:]
                    at = np.flatnonzero(known)
                    before = known
                    if not len(at):
                        break
                    if prefix is None:  # a second hash of the words, for those that may count
                        prefix = OTHER_WINDOW.prefix(_other_hash(w, at))
                    one, count = _grouped(key[at], OTHER_WINDOW.spans(prefix, at, at + n))
                    one = at[one]
                    phrase = pc.binary_join_element_wise(*[_strings(w, one + j) for j in range(n)], " ") if n > 1 else _strings(w, one)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(of_row[doc[one]])), pa.array(np.full(len(one), n, np.int32)), phrase, pa.array(count, pa.int64())], ["lang", "size", "phrase", "f"])

    return run


def frequent(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST, counters: int = COUNTERS) -> DataFrame:
    """(lang, size, phrase, f): exact counts of all n-grams that occur at least so often; size 0 has all words of a language."""
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    bitmap, map_bits = candidates(texts, least, longest, counters)
    counts = texts.mapInArrow(_exact(longest, squeeze(bitmap), map_bits), COUNTED)
    return counts.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).where((F.col("size") == 0) | (F.col("f") >= least))


def cut_score(a: Column, both: Column) -> Column:
    """floor(2000000 * a / both), exact: no product passes 64 bits for counts below 4 * 10^15."""
    whole = F.call_function("div", a * 2000, both)
    return whole * 1000 + F.call_function("div", (a * 2000 - whole * both) * 1000, both)


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST, top: int = TOP, share: int = SHARE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, size): the best phrases of two and more words of each language."""
    counts = cut(frequent(docs, lang, text, least, longest), "grams")
    total = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    parts = counts.where("size > 0").select("lang", "phrase", "f")
    phrases = counts.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    # a phrase goes if a longer one around it has most of its occurrences
    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))
    longer = phrases.where("size > 2").select("lang", F.explode(inside).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    stay = phrases.join(longer, ["lang", "phrase"], "left").where(F.col("around").isNull() | (F.col("around") * 100 < F.col("a") * share)).drop("around")
    # the worst cut
    at = stay.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    at = at.select("lang", "phrase", "size", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("right"))
    side = lambda c, f: parts.select("lang", F.col("phrase").alias(c), F.col("f").alias(f))
    at = at.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    at = at.withColumn("score", cut_score(F.col("a"), F.col("l") + F.col("r")))
    worst = at.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    rows = worst.select("lang", "phrase", "size", "a", "c.l", "c.r", "c.score")
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    # each of 64 shares of a language has at most `top` rows for the last ranking
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    rows = rows.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return rows.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "size")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2,000 phrases of each language of `documents`."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("size")


ORACLE = """
with pieces as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as p from documents),
lists as (select lang, regexp_extract_all(p, '[^\\x20\\x09]+') as w from pieces),
places as (select lang, w, unnest(range(1, len(w) + 1)) as i from lists),
f as (select lang, size, array_to_string(w[i : i + size - 1], ' ') as phrase, count(*) as f
  from places, (values (1), (2), (3), (4)) s(size) where i + size - 1 <= len(w) group by all having count(*) >= 30),
total as (select lang, sum(len(w))::bigint as n from lists group by lang),
cand as (select lang, phrase, size, f as a, string_split(phrase, ' ') as w from f where size > 1),
around as (select c.lang, array_to_string(w[i : i + k - 1], ' ') as phrase, max(a) as most
  from cand c, (values (2), (3)) s(k), (values (1), (2), (3)) t(i) where k < size and i + k - 1 <= size group by all),
stay as (select c.* from cand c left join around o on c.lang = o.lang and c.phrase = o.phrase where most is null or 100 * most < 80 * a),
cuts as (select c.lang, c.phrase, a, k, l.f as l, r.f as r, ((2000000::hugeint * a) // (l.f + r.f))::bigint as score
  from stay c join (values (1), (2), (3)) s(k) on k < c.size
  join f l on l.lang = c.lang and l.phrase = array_to_string(w[1 : k], ' ')
  join f r on r.lang = c.lang and r.phrase = array_to_string(w[k + 1 : c.size], ' ')),
worst as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from worst)
select lang, rank, phrase, a, l, r, n, score from ranked join total using (lang) where rank <= 2000
"""
