"""Product codes of vectors with exact whole-number codebooks, by dictionaries of values.

A vector's components become whole numbers floor(scale * x) and are cut into equal parts; a part is replaced
by the index of the nearest of 64 codebook entries.

* Blocks: a few thousand vectors are stored together. Each dimension of a block has a dictionary of its
  distinct numbers; the block holds codes into it. This is done once, all later passes read blocks.
* Assigning: for each dimension, the squared differences of every dictionary number to all entries are
  tabulated. The distance of a part to all entries is then a sum of one table row per dimension, gathered by
  the codes; nothing is computed per vector and dimension but these additions.
* Updating: a task adds up what its blocks assign to each entry and sends one row per part and entry; the
  totals (parts x entries rows) make the next codebook on the driver.

All arithmetic is on whole numbers; where squares could pass 64 bits, a block uses Python's unbounded ones.

Handled cases: rows whose vector is null or holds null, NaN or infinite components are dropped. Vectors
count as encodable if they have the width of the encodable vector with the smallest id, which is a positive
multiple of the parts, and components within 2^40 once scaled; other kept rows are returned with null codes
and errors, and count nothing. Null ids come after all others in the order of ids, repeated ids in the order
of their vectors; repeated rows are vectors of their own. With fewer vectors than entries, the codebook has
as many entries as there are vectors. Ties in distance go to the lower index. Sums of errors stop at the
largest long; a label without an encoded vector has none. Null labels are a label of their own. An empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.shared import arrow_schema, cut, small

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Numbers of a block (vectors times width), and the largest component.
BLOCK, LIMIT = 1 << 19, 1 << 40
MOST = (1 << 63) - 1
FLUSH = 1 << 21


def finite(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(False))


def _whole(vectors: pa.ListArray, width: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the encodable rows, which rows those are)."""
    n = len(vectors)
    size = np.asarray(vectors.value_lengths())
    values = np.floor(np.asarray(vectors.flatten()).astype(np.float64) * scale)
    first = np.cumsum(size) - size
    at = np.flatnonzero((size == width) & (width > 0))
    x = values[first[at][:, None] + np.arange(width)] if len(at) else np.zeros((0, max(width, 1)))
    fits = (np.abs(x) <= LIMIT).all(axis=1) if n else np.zeros(0, bool)
    return x[fits].astype(np.int64), at[fits]


def _blocks(width: int, scale: float, schema: pa.Schema):
    """One row per block: ids and labels of all its rows, which are encoded, and for these dictionaries and codes."""

    def run(batches):
        step = max(1, BLOCK // max(width, 1))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                x, at = _whole(part["vector"], width, scale)
                sizes, numbers, codes = [], [], []
                for d in range(width if len(x) else 0):
                    distinct, code = np.unique(x[:, d], return_inverse=True)
                    sizes.append(len(distinct)), numbers.append(distinct), codes.append(code.reshape(-1))
                kind = np.uint16 if max(sizes, default=0) <= 1 << 16 else np.uint32
                raw = [np.array(sizes, np.uint32), np.concatenate([np.zeros(0, np.int64), *numbers]), np.array(codes, kind), at.astype(np.uint32)]
                lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part[c].cast(schema.field(c).type.value_type)) for c in ("id", "label")]
                yield pa.RecordBatch.from_arrays([*lists, *[pa.array([r.tobytes()], pa.binary()) for r in raw], pa.array([kind().itemsize], pa.int32())], schema=schema)

    return run


class Block:
    """An opened block row."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        raw = lambda c, kind: np.frombuffer(batch[c][i].as_py(), kind)
        self.sizes, self.numbers, self.at = raw("sizes", np.uint32).astype(np.int64), raw("numbers", np.int64), raw("encoded", np.uint32).astype(np.int64)
        self.codes = raw("codes", np.uint16 if batch["wide"][i].as_py() == 2 else np.uint32).reshape(len(self.sizes), len(self.at))
        self.first = np.cumsum(self.sizes) - self.sizes

    def values(self, d: int) -> np.ndarray:
        """The dictionary of a dimension."""
        return self.numbers[self.first[d] : self.first[d] + self.sizes[d]]

    def nearest(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) by part and vector; books[part, entry, place]."""
        parts, _, step = books.shape
        entry, distance = [], []
        most = max((int(np.abs(x).max()) for x in (self.numbers, books) if x.size), default=0)
        kind = np.int64 if 4 * most * most * step <= MOST else object
        for p in range(parts):
            total = 0
            for j in range(step):
                table = (self.values(p * step + j).astype(kind)[:, None] - books[p, :, j].astype(kind)[None, :]) ** 2
                total = total + table[self.codes[p * step + j]]
            best = total.argmin(axis=1)
            entry.append(best), distance.append(total[np.arange(len(best)), best])
        return np.array(entry), np.array(distance)


def _sums(books: np.ndarray):
    """Count and component sums of what each entry is assigned, added up over a task's blocks."""
    parts, entries, step = books.shape

    def rows(count, total):
        p, e = np.nonzero(count)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * step, pa.int32()), pa.array(total[p, e].reshape(-1)))
        return pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(count[p, e]), lists], ["part", "entry", "n", "total"])

    def run(batches):
        count, total, seen = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, step), np.int64), 0
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch, i)
                if not len(block.at):
                    continue
                entry, _ = block.nearest(books)
                for p in range(parts):
                    count[p] += np.bincount(entry[p], minlength=entries)
                    for j in range(step):
                        np.add.at(total[p, :, j], entry[p], block.values(p * step + j)[block.codes[p * step + j]])
                seen += len(block.at)
                if seen >= FLUSH:  # sums of so many stay below 2^63
                    yield rows(count, total)
                    count[:], total[:], seen = 0, 0, 0
        if seen:
            yield rows(count, total)

    return run


def _encode(books: np.ndarray, schema: pa.Schema):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels = batch["id"][i].values, batch["label"][i].values
                block = Block(batch, i)
                code, error = np.full(len(ids), None, object), np.full(len(ids), None, object)
                if len(block.at):
                    entry, distance = block.nearest(books)
                    text = np.ascontiguousarray(entry.T).astype(np.uint8).tobytes().hex()
                    width = 2 * books.shape[0]
                    code[block.at] = [text[k * width : (k + 1) * width] for k in range(len(block.at))]
                    error[block.at] = [min(int(x), MOST) for x in distance.sum(axis=0)]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(code, pa.string()), pa.array(error, pa.int64())], schema=schema)

    return run


def _first_books(kept: DataFrame, parts: int, entries: int, scale: float) -> tuple[int, np.ndarray]:
    """(width, codebooks) of the encodable vectors with the smallest ids; a bounded number of rows comes to the driver."""
    usable = kept.where((F.size("vector") > 0) & (F.size("vector") % parts == 0))
    beyond = lambda x: (x.cast("double") * scale >= LIMIT + 1) | (x.cast("double") * scale < -LIMIT)
    usable = usable.where(~F.exists("vector", beyond))
    order = [F.col("id").asc_nulls_last(), F.col("vector").asc()]
    one = usable.orderBy(*order).select(F.size("vector").alias("width")).first()
    if one is None:
        return 0, np.zeros((parts, 0, 0), np.int64)
    first = usable.where(F.size("vector") == one["width"]).orderBy(*order).limit(entries).select("vector").toArrow()
    x, _ = _whole(first["vector"].combine_chunks(), one["width"], scale)
    return one["width"], np.ascontiguousarray(x.reshape(len(x), parts, -1).transpose(1, 0, 2))


def _updated(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The floors of the means of what each entry is assigned; entries without any stay."""
    step = books.shape[2]
    rows = blocks.mapInArrow(_sums(books), "part long, entry long, n long, total array<long>")
    sums = [F.sum(F.col("total")[j].cast("decimal(20,0)")).alias(f"s{j}") for j in range(step)]
    out = books.copy()
    for r in rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect():  # parts x entries rows
        out[r["part"], r["entry"]] = [int(r[f"s{j}"]) // r["n"] for j in range(step)]
    return out


def encode(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> tuple[DataFrame, np.ndarray]:
    """((id, label, code, error) of every kept row, codebooks[part, entry, place]).

    code is two hex digits per part, so at most 256 entries.
    """
    kept = vectors.select(F.col(vec_id).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector")).where(finite(F.col("vector")))
    width, books = _first_books(kept, parts, entries, scale)
    kind = {c: kept.schema[c].dataType.simpleString() for c in ("id", "label")}
    schema = f"id array<{kind['id']}>, label array<{kind['label']}>, sizes binary, numbers binary, codes binary, encoded binary, wide int"
    blocks = cut(kept.mapInArrow(_blocks(width, scale, arrow_schema(schema)), schema), "blocks")
    for _ in range(rounds if books.size else 0):
        books = _updated(blocks, books)
    schema = f"id {kind['id']}, label {kind['label']}, code string, error long"
    return blocks.mapInArrow(_encode(books, arrow_schema(schema)), schema), books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in books.reshape(-1)).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded with the sum of the errors of equal labels; a label's rows meet in no task."""
    key = [F.coalesce(F.col("label").cast("string"), F.lit("")).alias("k"), F.col("label").isNull().alias("none")]
    total = coded.select(*key, "error").groupBy("k", "none").agg(F.sum(F.col("error").cast("decimal(20,0)")).alias("t"))
    total = total.select("k", "none", F.when(F.col("t") > MOST, F.lit(MOST)).otherwise(F.col("t").cast("long")).alias("label_error"))
    return coded.select("*", *key).join(small(total), ["k", "none"]).drop("k", "none")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector of `embeddings`: its code, its error, its label's error, and the digest of the codebooks."""
    coded, books = encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    out = with_label_error(cut(coded, "coded"))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _oracle(rounds: int) -> str:
    """A round is two common table expressions; the first codebook is r0."""
    out = """
with kept as (select vec_id, label, embedding from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
cells as (select vec_id, label, unnest(range(0, 16)) as p,
    list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from kept),
parts as (select vec_id, label, p, v[p * 4 + 1] as a, v[p * 4 + 2] as b, v[p * 4 + 3] as c, v[p * 4 + 4] as d from cells),
first as (select vec_id, row_number() over (order by vec_id) - 1 as e from kept qualify e < 64),
r0 as (select p, e, a, b, c, d from parts join first using (vec_id))"""
    near = """,
d{i} as (select vec_id, label, s.p, e, s.a, s.b, s.c, s.d,
    (s.a - r.a) * (s.a - r.a) + (s.b - r.b) * (s.b - r.b) + (s.c - r.c) * (s.c - r.c) + (s.d - r.d) * (s.d - r.d) as dist
  from parts s join r{i} r on s.p = r.p),
n{i} as (select vec_id, label, p, min(dist) as dist, arg_min(e, dist * 64 + e) as e,
    any_value(a) as a, any_value(b) as b, any_value(c) as c, any_value(d) as d from d{i} group by vec_id, label, p)"""
    new = """,
m{i} as (select p, e, count(*) as n, sum(a)::bigint as a, sum(b)::bigint as b, sum(c)::bigint as c, sum(d)::bigint as d from n{i} group by p, e),
r{j} as (select r.p, r.e, """ + ", ".join(f"coalesce((m.{x} - ((m.{x} % m.n) + m.n) % m.n) // m.n, r.{x}) as {x}" for x in "abcd") + """
  from r{i} r left join m{i} m on r.p = m.p and r.e = m.e)"""
    for i in range(rounds):
        out += near.format(i=i) + new.format(i=i, j=i + 1)
    return out + near.format(i=rounds) + f""",
book as (select sha256(string_agg(concat_ws(',', a, b, c, d), ',' order by p, e)) as codebooks_sha256 from r{rounds}),
coded as (select vec_id, label, string_agg(printf('%02x', e), '' order by p) as code, sum(dist)::bigint as error from n{rounds} group by vec_id, label)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from coded, book
"""


ORACLE = _oracle(ROUNDS)
