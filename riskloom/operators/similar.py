"""Exact top-k similar cases for every query vector.

Two routes with the same result, chosen by the measured size of the case side:

* resident: cases whose vectors and attached fields are proven to fit a byte bound
  go to every executor once; queries are scored where they are, nothing is shuffled.
* partitioned: each distinct query vector is scored once, however many queries share it.
  Distinct vectors and cases are counted and laid on a grid. Its tiles grow from `block_rows`
  to `TILE_ROWS` of either side while enough of them are left for all cores, so the number of
  tiles grows with both tables and a tile's memory does not. Vectors are shuffled as bytes, an
  integer in as few as it needs; a tile sends one row per query with its k best cases. Vectors are
  told apart by two 64-bit hashes; only these leave a tile.

Products are made in 32 bits where these are exact, else bounded by their rounding: a pass over them
gives every query a value that its k-th best case reaches at least, and only cases that may reach it
are scored in 64 bits (`CaseSide`). Inside a tile, cases are also an inverted index in blocks: cases of the
same strongest bucket lie together, and a block keeps the largest share each bucket has in any of its
cases, by sign. These bound the cosine of every case of the block from above, so a block that
cannot reach a query's k-th best score so far is not multiplied out. Where the bounds
spare less than half of the products, the tile is multiplied at once.

Scores are float64 products. With integer vectors every product is exact, so the
result depends neither on block boundaries nor on the route. Ties go to the smaller
case id. Queries are told apart by their rows: repeated or null ids do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import work_folder

CHUNK_BYTES = 32 << 20
#: Cases of a posting block, and what rounding may add to a bound.
POSTING, SLACK = 32, 1e-9
#: Vectors of either side in the largest tile of the grid, and tiles wanted for each core.
TILE_ROWS, TILES_PER_CORE = 1 << 16, 8
#: Queries and cases multiplied at once, and the groups of cases whose maxima bound the k-th best from below.
QUERY_STEP, CASE_STEP, GROUPS = 512, 2048, 64
#: Scores over the bound for each query and case asked for, beyond which a closer bound is worth a pass over the scores.
LOOSE = 4
#: Whole numbers up to this are exact in 32-bit floats.
EXACT32 = 1 << 24


@dataclass(frozen=True)
class TopKOptions:
    resident_bytes: int = 64 << 20
    block_rows: int = 4096  # vectors of either side in the smallest tile of the grid
    decimals: int | None = None  # set for float vectors: rank by the rounded score


def similar_topk(
    queries: DataFrame,
    cases: DataFrame,
    k: int,
    query_id: str,
    info: list[str],
    options: TopKOptions = TopKOptions(),
    keep_vec: bool = True,
) -> DataFrame:
    """`queries` plus `similar`: array of struct(case_id, *info, cosine), best first; without `vec` on demand.

    Both sides carry `vec`, of one width and one `space` where both name theirs; cosine
    is 0 where either vector is zero, and is not clamped. Runs a small size check on
    `cases` at once, so hand in a stored table. `query_id` may repeat or be null.
    """
    size = measure(cases, info)
    snapshot = resident_snapshot(cases, info, options, size)
    if snapshot is not None:
        score = resident_scorer(queries.sparkSession, snapshot, cases, k, info, options)
        found = queries.withColumn("similar", score(F.col("vec")))
        return found if keep_vec else found.drop("vec")
    asked = _stored(queries, keep_vec)
    ranked = _partitioned(asked, cases, size, k, info, options)
    return asked.drop("_bytes").join(ranked, list(_hashes()), "left").drop(*_hashes())


# --- shared numpy helpers -------------------------------------------------


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) != len(lists) * dim:
        raise ValueError(f"vectors must all have {dim} elements")
    return flat.reshape(len(lists), dim)


def _squares(m: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", m, m)


def _cosines(q: np.ndarray, q2: np.ndarray, c: np.ndarray, c2: np.ndarray, decimals: int | None) -> np.ndarray:
    length = np.sqrt(np.outer(q2, c2))
    dots = q @ c.T
    scores = np.divide(dots, length, out=np.zeros_like(dots), where=length > 0)
    return scores if decimals is None else np.round(scores, decimals) + 0.0


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Column numbers of the k largest per row; equal scores keep column order."""
    k = min(k, scores.shape[1])
    if k > 16:
        return np.argsort(-scores, axis=1, kind="stable")[:, :k]
    left = scores.copy()
    rows = np.arange(len(left))
    picks = np.empty((len(left), k), dtype=np.int64)
    for i in range(k):
        picks[:, i] = left.argmax(axis=1)
        left[rows, picks[:, i]] = -np.inf
    return picks


def _chunks(rows: int, width: int):
    step = max(1, CHUNK_BYTES // (8 * max(width, 1)))
    for start in range(0, rows, step):
        yield slice(start, min(start + step, rows))


def _values(lists: pa.Array, dim: int) -> np.ndarray:
    """The vectors as they are: integers stay integers."""
    flat = lists.flatten()
    if len(flat) != len(lists) * dim:
        raise ValueError(f"vectors must all have {dim} elements")
    return flat.to_numpy(zero_copy_only=False).reshape(len(lists), dim)


def _distinct(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each different vector, for each row which of these it equals)."""
    if not m.size:
        return np.arange(min(len(m), 1)), np.zeros(len(m), np.int64)
    m = np.ascontiguousarray(m)
    bits = m.view(f"u{m.itemsize}")
    # rows are sorted by a sum over their numbers; where that tells two of them not apart, by all their bytes
    odd = np.random.default_rng(0).integers(0, 1 << 63, m.shape[1], np.uint64) * np.uint64(2) + np.uint64(1)
    name = np.concatenate([bits[rows].astype(np.uint64) @ odd for rows in _chunks(len(m), m.shape[1])])
    _, first, which = np.unique(name, return_index=True, return_inverse=True)
    if len(first) < len(m) and any((bits[first[which[rows]]] != bits[rows]).any() for rows in _chunks(len(m), m.shape[1])):
        _, first, which = np.unique(m.view(np.dtype((np.void, m.itemsize * m.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return first, which


def _kept(c: np.ndarray, k: int) -> np.ndarray:
    """Rows without those that follow k equal ones: of equal vectors, only the first k can be among k best."""
    _, which = _distinct(c)
    order = np.argsort(which, kind="stable")
    rank = np.arange(len(c)) - np.searchsorted(which[order], which[order])
    return np.sort(order[rank < k])


def _places(marks: np.ndarray) -> np.ndarray:
    """Places of the few set marks among many, found by eights."""
    whole = len(marks) - len(marks) % 8
    eights = np.flatnonzero(marks[:whole].view(np.uint64) != 0)
    near = (eights[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([near[marks[near]], whole + np.flatnonzero(marks[whole:])])


class CaseSide:
    """Cases, ordered by id, made ready for the k best of many queries."""

    def __init__(self, c: np.ndarray, k: int, decimals: int | None):
        self.rows, self.width, self.decimals, self.k = _kept(c, k), min(k, len(c)), decimals, k
        self.c = c[self.rows]
        self.c2 = _squares(self.c.astype(np.float64))
        length = np.sqrt(self.c2)
        self.whole = self.c.dtype.kind in "iu"
        with np.errstate(invalid="ignore", over="ignore"):
            inverse = np.divide(1, length, out=np.zeros_like(length), where=length > 0)
            self.inverse = inverse.astype(np.float32)
            # what is multiplied: whole numbers as they are, others at unit length
            self.factor = self.c.astype(np.float32) if self.whole else (self.c * inverse[:, None]).astype(np.float32)

    @classmethod
    def of(cls, fields: dict) -> CaseSide:
        side = cls.__new__(cls)
        side.__dict__.update(fields)
        return side

    def best(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row numbers of the k best cases, their cosines) of every query, best first, equal cosines in the order of cases."""
        first, which = _distinct(q)
        q = q[first]
        q2 = _squares(q.astype(np.float64))
        picked, cosine = np.empty((len(q), self.width), np.int64), np.empty((len(q), self.width))
        if self.width:
            run = self._step if self._safe(q2) else self._plain
            for start in range(0, len(q), QUERY_STEP):
                part = slice(start, start + QUERY_STEP)
                picked[part], cosine[part] = run(q[part], q2[part])
        return self.rows[picked[which]], cosine[which]

    def _safe(self, q2: np.ndarray) -> bool:
        """Whether all lengths, and the products of any two, are finite and far from the smallest numbers."""
        both = [x[x != 0] for x in (q2, self.c2)]
        if not all(np.isfinite(x).all() for x in both):
            return False
        return not all(map(len, both)) or (1e-250 < both[0].min() * both[1].min() and both[0].max() * both[1].max() < 1e250)

    def _plain(self, q: np.ndarray, q2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = _cosines(q.astype(np.float64), q2, self.c.astype(np.float64), self.c2, self.decimals)
        pick = _best(s, self.k)
        return pick, np.take_along_axis(s, pick, axis=1)

    def _exact(self, dots: np.ndarray, q2: np.ndarray, c2: np.ndarray) -> np.ndarray:
        length = np.sqrt(q2 * c2)
        out = np.divide(dots, length, out=np.zeros_like(dots), where=length > 0)
        return out if self.decimals is None else np.round(out, self.decimals) + 0.0

    def _step(self, q: np.ndarray, q2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k, n, length = self.width, len(q), np.sqrt(q2)
        zero = q2 == 0
        whole = self.whole and q.dtype.kind in "iu"
        small = whole and np.sqrt(q2.max()) * np.sqrt(self.c2.max()) < EXACT32
        if small:
            left = q.astype(np.float32)
        elif whole:
            left = q.astype(np.float64)
        else:
            left = np.divide(q, length[:, None], out=np.zeros(q.shape), where=~zero[:, None]).astype(np.float32)
        # how far a score may be from the true one, beside a share of 2**-20 of it
        unit = length if whole else np.ones(n)
        slack = unit * (0.0 if self.decimals is None else 1.01 * 10.0**-self.decimals)
        if not whole:
            slack = slack + (q.shape[1] + 16) * 2.0**-22
        scores, at = np.full((n, k), -np.inf), np.full((n, k), -1)

        def bound(reached: np.ndarray) -> np.ndarray:
            """What a case must reach here to be among the k best, if k of them reach so much."""
            least = np.where(np.isfinite(reached), reached - np.abs(reached) * 2.0**-20 - slack, reached)
            least[zero] = np.inf
            return least[:, None]

        for start in range(0, len(self.c), CASE_STEP):
            part = slice(start, start + CASE_STEP)
            if whole:
                dots = left @ (self.factor[part] if small else self.c[part].astype(np.float64)).T
                s = dots * self.inverse[part]
            else:
                factor = self.factor[part]
                if self.whole:
                    factor = factor * self.inverse[part, None]
                s = left @ factor.T
            # the k-th best so far is mostly bound enough; at first, and where cases get better and better, it is not
            held = scores[:, -1] * np.where(zero, 1.0, unit)
            over = s >= bound(held).astype(s.dtype)
            if np.count_nonzero(over) > LOOSE * k * n:
                over = s >= bound(np.maximum(self._kth(s, k), held)).astype(s.dtype)
            flat = _places(over.ravel())
            if not len(flat):
                continue
            row, col = np.divmod(flat, s.shape[1])
            case = col + start
            exact = dots[row, col].astype(np.float64) if whole else np.einsum("ij,ij->i", q[row].astype(np.float64), self.c[case].astype(np.float64))
            found = self._exact(exact, q2[row], self.c2[case])
            touched = row[np.r_[True, row[1:] != row[:-1]]]
            held_row, held = np.repeat(touched, k), at[touched].ravel()
            row, case = np.concatenate([held_row, row]), np.concatenate([held, case])
            found = np.concatenate([scores[touched].ravel(), found])
            order = np.lexsort((case, -found, row))
            row, case, found = row[order], case[order], found[order]
            top = np.arange(len(row)) - np.searchsorted(row, row) < k
            scores[touched], at[touched] = found[top].reshape(-1, k), case[top].reshape(-1, k)
        scores[zero], at[zero] = 0.0, np.arange(k)
        return at, scores

    @staticmethod
    def _kth(s: np.ndarray, k: int) -> np.ndarray:
        """A value that at least k scores of each row reach: the k-th largest of the maxima of groups of cases."""
        groups = GROUPS if k <= GROUPS // 4 else k * 4
        deep = s.shape[1] // groups
        if not deep:
            return np.full(len(s), -np.inf) if s.shape[1] < k else -np.partition(-s, k - 1, axis=1)[:, k - 1].astype(np.float64)
        maxima = s[:, : deep * groups].reshape(len(s), deep, groups).max(axis=1)
        return np.partition(maxima, groups - k, axis=1)[:, groups - k].astype(np.float64)


# --- resident route -------------------------------------------------------


def measure(cases: DataFrame, info: list[str]):
    """Row count, vector width and byte size of the case side, in one small aggregate.

    Fails if the vectors come from different spaces: their products would mean nothing.
    """
    weight = sum(
        (F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) for c in ["case_id", *info]), F.lit(0)
    )
    space = F.col("space") if "space" in cases.columns else F.lit("")
    size = cases.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("dim"),
        F.coalesce(F.sum(weight), F.lit(0)).alias("info_bytes"),
        F.min(space).alias("space"),
        F.max(space).alias("other_space"),
    ).first()
    if size["space"] != size["other_space"]:
        raise ValueError(f"case vectors come from different spaces: {size['space']}, {size['other_space']}")
    return size


def resident_snapshot(
    cases: DataFrame, info: list[str], options: TopKOptions = TopKOptions(), size=None
) -> pa.Table | None:
    """The case side ordered by id if it fits the byte bound, else None."""
    size = size or measure(cases, info)
    if size["n"] * size["dim"] * 8 + size["info_bytes"] > options.resident_bytes:
        return None
    return cases.select("case_id", *info, "vec").toArrow().sort_by("case_id").combine_chunks()


def _similar_type(cases: DataFrame, info: list[str]) -> T.ArrayType:
    fields = [cases.schema[c] for c in ["case_id", *info]]
    return T.ArrayType(T.StructType([*fields, T.StructField("cosine", T.DoubleType())]))


def resident_scorer(spark, snapshot: pa.Table, cases: DataFrame, k: int, info: list[str], options: TopKOptions = TopKOptions()):
    """Column function vec -> ranked array. It keeps no state, so it also serves streams."""
    names = ["case_id", *info]
    vectors = snapshot["vec"].combine_chunks() if snapshot.num_rows else pa.array([], pa.list_(pa.int32()))
    dim = len(vectors[0]) if len(vectors) else 0
    matrix = _values(vectors, dim) if dim else np.zeros((0, 0))
    facts = pa.StructArray.from_arrays([snapshot[n].combine_chunks() for n in names], names)
    # plain arrays: a broadcast value is unpickled where this package may not be installed
    held = spark.sparkContext.broadcast((vars(CaseSide(matrix, k, options.decimals)), facts))

    @F.arrow_udf(_similar_type(cases, info))
    def score(vecs: pa.Array) -> pa.Array:
        fields, rows = held.value
        side = CaseSide.of(fields)
        n, width = len(vecs), side.width
        picked, cosine = side.best(_values(vecs, side.c.shape[1])) if width else (np.empty((n, 0), np.int64), np.empty((n, 0)))
        return _lists(rows, picked, cosine)

    return score


def _lists(rows: pa.StructArray, picked: np.ndarray, cosine: np.ndarray) -> pa.ListArray:
    """For every query the picked rows, each with its cosine."""
    n, width = picked.shape
    offsets = pa.array(np.arange(n + 1) * width, pa.int32())
    taken = rows.take(pa.array(picked.ravel()))
    names = [field.name for field in rows.type]
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([*taken.flatten(), pa.array(cosine.ravel())], [*names, "cosine"]))


# --- partitioned route ----------------------------------------------------


def _hashes() -> dict[str, Column]:
    return {"_h1": F.xxhash64("_bytes"), "_h2": F.xxhash64(F.lit(1), "_bytes")}


def grid_of(queries: int, cases: int, options: TopKOptions) -> tuple[int, int]:
    """Rows and columns of the grid of smallest tiles for so many distinct vectors and cases."""
    return max(1, -(-queries // options.block_rows)), max(1, -(-cases // options.block_rows))


def tile_rows(queries: int, cases: int, options: TopKOptions, cores: int) -> int:
    """Vectors of either side in a tile: what a vector is copied for falls with it, tiles for all cores must be left."""
    wanted = int((max(queries, 1) * max(cases, 1) / (TILES_PER_CORE * cores)) ** 0.5)
    return max(options.block_rows, min(wanted, TILE_ROWS))


@F.arrow_udf(T.BinaryType())
def _packed(vecs: pa.Array) -> pa.Array:
    """A vector as bytes: one for the kind of its numbers, then these; whole numbers as narrow as the vector allows."""
    return _bytes_of(vecs)


def _bytes_of(vecs: pa.Array) -> pa.Array:
    if vecs.null_count:
        none = pc.is_null(vecs).to_numpy(zero_copy_only=False)
        return _bytes_of(vecs.filter(pa.array(~none))).take(pa.array(np.cumsum(~none) - 1, mask=none))
    flat, ends = vecs.flatten().to_numpy(zero_copy_only=False), np.cumsum(pc.list_value_length(vecs).to_numpy())
    if len(vecs) and ends[0] and (np.diff(ends) == ends[0]).all():
        return _rows_of(flat.reshape(len(vecs), -1))
    rows = np.split(flat, ends[:-1]) if len(vecs) else []
    if flat.dtype.kind not in "iu":
        return pa.array([flat.dtype.char.encode() + row.tobytes() for row in rows], pa.binary())
    size = np.abs(flat.astype(np.int64))
    tops = np.maximum.reduceat(size, np.concatenate([[0], ends[:-1]])) if len(rows) and (np.diff(ends, prepend=0) > 0).all() else np.full(len(rows), 1 << 62)
    kinds = [np.dtype(kind) for kind in WHOLE]
    narrow = np.searchsorted([np.iinfo(kind).max for kind in kinds], tops)
    return pa.array([kinds[w].char.encode() + row.astype(kinds[w]).tobytes() for w, row in zip(narrow.tolist(), rows)], pa.binary())


def _rows_of(m: np.ndarray) -> pa.Array:
    """`_bytes_of` for vectors of one width: all of a kind are laid out together."""
    kinds = [np.dtype(kind) for kind in WHOLE] if m.dtype.kind in "iu" else [m.dtype]
    narrow = np.searchsorted([np.iinfo(kind).max for kind in kinds], np.abs(m.astype(np.int64)).max(axis=1)) if len(kinds) > 1 else np.zeros(len(m), int)
    parts, order = [], []
    for w, kind in enumerate(kinds):
        mine = np.flatnonzero(narrow == w)
        if len(mine):
            out = np.empty((len(mine), 1 + m.shape[1] * kind.itemsize), np.uint8)
            out[:, 0] = ord(kind.char)
            out[:, 1:] = np.ascontiguousarray(m[mine].astype(kind)).view(np.uint8)
            ends = pa.py_buffer(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32))
            parts.append(pa.Array.from_buffers(pa.binary(), len(mine), [None, ends, pa.py_buffer(out)]))
            order.append(mine)
    if len(parts) == 1:
        return parts[0]
    place = np.empty(len(m), np.int64)
    place[np.concatenate(order)] = np.arange(len(m))
    return pa.concat_arrays(parts).take(pa.array(place))


WHOLE = ("int8", "int16", "int32", "int64")


def _unpacked(packed: pa.Array, dim: int | None = None) -> np.ndarray:
    """The matrix of packed vectors, of the widest kind among them."""
    if packed.null_count:
        raise ValueError(f"vectors must all have {dim} elements")
    rows = packed.to_pylist()
    by_kind: dict[bytes, list[int]] = {}
    for i, row in enumerate(rows):
        by_kind.setdefault(row[:1], []).append(i)
    parts = {}
    for char, where in by_kind.items():
        kind = np.dtype(char.decode())
        dim = dim if dim is not None else (len(rows[where[0]]) - 1) // kind.itemsize
        if any(len(rows[i]) != 1 + dim * kind.itemsize for i in where):
            raise ValueError(f"vectors must all have {dim} elements")
        parts[char] = np.frombuffer(b"".join([rows[i][1:] for i in where]), kind).reshape(len(where), dim)
    out = np.empty((len(rows), dim or 0), np.result_type(*[part.dtype for part in parts.values()]))
    for char, where in by_kind.items():
        out[where] = parts[char]
    return out


def _stored(queries: DataFrame, keep_vec: bool) -> DataFrame:
    """The queries with their packed vectors and hashes of these, written: they are read twice, and what makes a vector is costly."""
    path, packed = work_folder(queries.sparkSession, "queries"), _packed("vec").alias("_bytes")
    void = {f.name: F.lit(None) for f in queries.schema if isinstance(f.dataType, T.NullType)}  # no file holds these
    columns = queries.columns if keep_vec else [c for c in queries.columns if c != "vec"]
    # a plan that names a vector beside what is packed of it makes it twice
    kept = queries.select(*[F.col(f"`{c}`") for c in columns if c not in void], *([] if keep_vec else [packed]))
    kept.write.parquet(path)
    read = queries.sparkSession.read.schema(kept.schema).parquet(path).withColumns(void)
    return read.select(*[F.col(f"`{c}`") for c in columns], packed if keep_vec else "_bytes").withColumns(_hashes())


def _partitioned(queries: DataFrame, cases: DataFrame, size, k: int, info: list[str], options: TopKOptions) -> DataFrame:
    """(_h1, _h2, similar) of every distinct vector of stored queries; these are counted first."""
    spark, names = queries.sparkSession, ["case_id", *info]
    vectors = queries.select("_h1", "_h2", F.col("_bytes").alias("bytes")).where(F.col("bytes").isNotNull())
    distinct = vectors.distinct()
    n, cores = vectors.select("_h1", "_h2").distinct().count(), spark.sparkContext.defaultParallelism
    rows, columns = grid_of(n, size["n"], replace(options, block_rows=tile_rows(n, size["n"], options, cores)))
    along = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    dealt = min(4 * rows * columns, 4 * max(cores, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    query_side = distinct.withColumn("row", F.pmod("_h1", F.lit(rows)).cast("int")).withColumn("col", along(columns))
    case_side = cases.select(*names, _packed("vec").alias("bytes")).withColumn("col", F.pmod(F.xxhash64("case_id"), F.lit(columns)).cast("int")).withColumn("row", along(rows))
    # By a number of its own: few bytes are much work here, so tasks must not be put together by their bytes.
    sides = [side.repartition(dealt, "row", "col").groupBy("row", "col") for side in (query_side, case_side)]
    shape = T.StructType([distinct.schema["_h1"], distinct.schema["_h2"], T.StructField("similar", _similar_type(cases, info))])
    found = sides[0].cogroup(sides[1]).applyInArrow(_tile_scorer(k, names, size["dim"], options.decimals, shape), shape)
    if columns == 1:
        return found
    fields = [*names, "cosine"]
    ranked = lambda s: F.struct((-s["cosine"]).alias("_last"), *[s[n].alias(n) for n in fields])
    merged = F.array_sort(F.transform(F.flatten(F.collect_list("similar")), ranked))
    best = found.groupBy("_h1", "_h2").agg(F.slice(merged, 1, k).alias("s"))
    return best.select("_h1", "_h2", F.transform("s", lambda s: F.struct(*[s[n].alias(n) for n in fields])).alias("similar"))


def _tile_scorer(k: int, names: list[str], dim: int, decimals: int | None, shape: T.StructType):
    """Score the queries of a tile against its cases; a row with k cases leaves for each query."""
    out = to_arrow_schema(shape)

    def run(key: tuple[pa.Scalar, ...], queries: pa.Table, cases: pa.Table) -> pa.Table:
        if not len(queries) or not len(cases):
            return out.empty_table()
        ranked = cases.sort_by("case_id").combine_chunks()
        facts = pa.StructArray.from_arrays([ranked[n].combine_chunks() for n in names], names)
        c, q = _unpacked(ranked["bytes"].combine_chunks(), dim), _unpacked(queries["bytes"].combine_chunks(), dim)
        side, index, tables = CaseSide(c, k, decimals), None, []
        # the index is tried on a corner of the tile, and used as long as it spares products
        tried, some = q[:TILE_STEP].astype(np.float64), c[:CASE_STEP].astype(np.float64)
        spared = side.width == k and tile_topk(tried, some, k, decimals)[3] < len(tried) * len(some)
        for start in range(0, len(q), TILE_STEP):
            part = slice(start, start + TILE_STEP)
            if spared:
                wide = c.astype(np.float64) if index is None else wide
                index = index or Postings(wide, _squares(wide))
                _, picked, cosine, done = tile_topk(q[part].astype(np.float64), wide, k, decimals, index, side)
                picked, cosine = picked.reshape(-1, k), cosine.reshape(-1, k)
                spared = done < len(picked) * len(c)
            else:
                picked, cosine = side.best(q[part])
            ids = queries.select(["_h1", "_h2"]).slice(start, TILE_STEP).combine_chunks()
            tables.append(pa.Table.from_arrays([*ids.columns, _lists(facts, picked, cosine)], names=out.names).cast(out))
        return pa.concat_tables(tables)

    return run


#: Queries of a tile that are scored, and leave, at once.
TILE_STEP = 2048


def tile_topk(
    q: np.ndarray, c: np.ndarray, k: int, decimals: int | None = None, index: Postings | None = None, side: CaseSide | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, case, cosine) rows of the k best cases of each query, and how many products that took."""
    q2, c2 = _squares(q), _squares(c)
    index = index or Postings(c, c2)
    bound = index.bounds(q, q2)
    seen = np.zeros(bound.shape, bool)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    done = 0

    def score(block: int, who: np.ndarray, least: np.ndarray | None) -> np.ndarray:
        nonlocal done
        mine = index.cases[block]
        s = _cosines(q[who], q2[who], c[mine], c2[mine], decimals)
        done += s.size
        keep = np.ones(s.shape, bool) if least is None else s >= least[:, None]
        at, place = np.nonzero(keep)
        found.append((who[at], mine[place], s[at, place]))
        return s

    # the most promising blocks of each query give it a k-th best score to beat
    seeds = min(bound.shape[1], -(-k // POSTING) + 1)
    first = np.argpartition(-bound, seeds - 1, axis=1)[:, :seeds]
    scores: list[tuple[np.ndarray, np.ndarray]] = []
    for block in np.unique(first):
        who = np.flatnonzero((first == block).any(axis=1))
        seen[who, block] = True
        scores.append((who, score(block, who, None)))
    best = np.full((len(q), k), -np.inf)
    for who, s in scores:
        both = np.concatenate([best[who], s], axis=1)
        best[who] = -np.partition(-both, k - 1, axis=1)[:, :k]
    least = best.min(axis=1)
    need = (bound + SLACK >= least[:, None]) & ~seen
    if need.mean() > 0.5:
        pick, cosine = (side or CaseSide(c, k, decimals)).best(q)
        return np.repeat(np.arange(len(q)), pick.shape[1]), pick.ravel(), cosine.ravel(), len(q) * len(c)
    for block in np.flatnonzero(need.any(axis=0)):
        who = np.flatnonzero(need[:, block])
        score(block, who, least[who])
    query, case, cosine = (np.concatenate([f[i] for f in found]) for i in range(3))
    order = np.lexsort((case, -cosine, query))
    query, case, cosine = query[order], case[order], cosine[order]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    top = rank < k
    return query[top], case[top], cosine[top], done


class Postings:
    """Cases in blocks of like vectors, and for each block and bucket the largest share on either side of zero."""

    def __init__(self, c: np.ndarray, c2: np.ndarray):
        length = np.sqrt(c2)[:, None]
        share = np.divide(c, length, out=np.zeros_like(c), where=length > 0)
        strongest = np.abs(share).argmax(axis=1) if c.shape[1] else np.zeros(len(c), int)
        order = np.lexsort((share[np.arange(len(c)), strongest] if c.shape[1] else strongest, strongest))
        self.cases = [order[i : i + POSTING] for i in range(0, len(order), POSTING)]
        self.up = np.array([np.maximum(share[m], 0).max(axis=0) for m in self.cases])
        self.down = np.array([np.maximum(-share[m], 0).max(axis=0) for m in self.cases])

    def bounds(self, q: np.ndarray, q2: np.ndarray) -> np.ndarray:
        """No case of the block has a larger cosine with the query."""
        length = np.sqrt(q2)[:, None]
        share = np.divide(q, length, out=np.zeros_like(q), where=length > 0)
        return np.maximum(share, 0) @ self.up.T + np.maximum(-share, 0) @ self.down.T


def top_one(similar: Column) -> Column:
    """struct(similarity, fraud_type, title) of the best case; similarity 0 when there is none."""
    first = F.get(similar, F.lit(0))
    return F.struct(
        F.coalesce(F.greatest(first["cosine"], F.lit(0.0)), F.lit(0.0)).alias("similarity"),
        first["fraud_type"].alias("fraud_type"),
        first["title"].alias("title"),
    )
