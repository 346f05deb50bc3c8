"""Groups of documents whose sets of word shingles have a Jaccard similarity of at least 0.8.

Exact, without comparing all pairs:

1. Documents with equal sets form one class; one of each class goes on.
2. A linked document has at most a fifth of its shingles for itself. Of each document the 30 % with
   the smallest hashes are looked up among those of all others; it drops out if more than a fifth of
   its set, and one more, are found nowhere (`alone` says why one more). What is left are near copies
   and little else.
3. Left documents order their shingles by how often they occur among them (rare first, by powers of
   two up to 64, then by hash). Linked sets share a shingle among the first fifth, plus one, of that
   order, so documents meet under those shingles only.
4. Documents that meet are compared in tiles. Each carries a hashed bitmap of its set: bits that one
   has and the other lacks bound the overlap from above; pairs that pass intersect their sorted
   sets. First each document meets a few leaders of its shingle groups (two rounds), which joins
   most of each group; then only what lies in different components is compared in full, in tiles
   banded by set size, of at most `TILE` documents a side. No pair that could still join two
   components is left out.

Handled cases: null, empty and wordless texts have no shingles and stand alone; texts of fewer than
five words are one shingle; repeated rows are linked; null ids are linked too, but do not name a
component (component_id is the smallest id in it that is not null); ties go to the smaller hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.components import components
from llm.repeats import find_classes, find_repeats, rids
from llm.shared import cut, keyed, small, with_keys
from llm.textkernel import NON_SPACE, WINDOW, U, mix, slices, words

SHINGLE, PERCENT = 5, 80
LEADERS, ROUNDS, TILE, FIRST = 4, 2, 1024, 16
#: Left documents are looked up by a broadcast of their two-number keys up to this many, else by a shuffle.
BROADCAST_KEYS = 200_000


def _column(batch, name):
    return batch.column(batch.schema.get_field_index(name))


def shingle_sets(batch: pa.RecordBatch, size: int, with_rows: bool = False):
    """(slice, its texts' sorted distinct shingle hashes)."""
    for s in slices(_column(batch, "text")):
        w = words(s, NON_SPACE, True)
        prefix = WINDOW.prefix(w.hash)
        sets = []
        for lo, hi in zip(w.offsets[:-1], w.offsets[1:], strict=True):
            n = hi - lo
            at = np.arange(lo, max(hi - size + 1, lo + min(n, 1)))
            sets.append(np.unique(WINDOW.spans(prefix, at, np.minimum(at + size, hi))))
        yield s, sets


def _sizes(size: int):
    def run(batches):
        for batch in batches:
            for s, sets in shingle_sets(batch, size):
                # a set's name: a sum over its mixed elements, whatever their order
                node = mix(np.array([mix(x ^ U(0xD6E8FEB86659FD93)).sum(dtype=U) for x in sets], U)).view(np.int64)
                take = s.rows[0], len(s.rows)
                yield pa.RecordBatch.from_arrays(
                    [_column(batch, c).slice(*take) for c in ("id", "rid1", "rid2")] + [pa.array([len(x) for x in sets], pa.int64()), pa.array(node)],
                    ["id", "rid1", "rid2", "n", "node"],
                )

    return run


def _emit_sample(size: int, percent: int):
    """The smallest hashes of each set: enough to see that too many of them are unique."""

    def emit(batch: pa.RecordBatch):
        for s, sets in shingle_sets(batch, size):
            sets = [x[: sample(len(x), percent)] for x in sets]
            n = np.array([len(x) for x in sets])
            if n.sum():
                yield rids(batch, s.rows), np.repeat(np.arange(len(n)), n), np.concatenate([np.arange(k) for k in n]), np.concatenate(sets), None

    return emit


def sample(n: int, percent: int) -> int:
    return min(n, (n * (100 - percent) * 3 // 2) // 100 + 2)


def alone(n: int, percent: int) -> int:
    """At most so many sampled shingles of a linked set of n are in no other set's sample.

    Let a partner of m have a shingles that the set lacks, and lack b of the set's; f = (100 - percent) %,
    s = sample. A shared shingle in the set's sample is among the first s(n) - b' + a of the partner, if b' of
    the sample are not shared, so at most max(b, s(n) + a - s(m)) are missed. b <= fn. For a sample that is
    not the whole set s(n) <= 1.5fn + 2 and s(m) > 1.5fm + 1, so the other term is below 1 + a - 1.5f(m - n);
    a linear program over a + b <= f(n + a), with its ends at b = 0 and a = 0, holds that below 1 + fn for
    f up to 2/3; where s(m) = m the term is at most n + a - m = b.
    """
    return n * (100 - percent) // 100 + 1


def _emit_sets(batch: pa.RecordBatch):
    sets = [np.frombuffer(x, U) for x in _column(batch, "items").to_pylist()]
    n = np.array([len(x) for x in sets])
    if len(n):
        yield rids(batch, np.arange(len(n))), np.repeat(np.arange(len(n)), n), np.concatenate([np.arange(k) for k in n]), np.concatenate(sets), None


def _bitmap(items: np.ndarray) -> bytes:
    """About four bits for each element; a power of two, so that wider maps fold onto narrower ones."""
    bits = 1 << max(9, int(4 * len(items) - 1).bit_length())
    out = np.zeros(bits, np.uint8)
    out[(mix(items) % U(bits)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def _fold(m: np.ndarray, size: int) -> np.ndarray:
    while m.shape[-1] > size:
        half = m.shape[-1] // 2
        m = m[..., :half] | m[..., half:]
    return m


def may_link(n: int, bits: np.ndarray, m: np.ndarray, others: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes m and bitmaps `others` may link with one of size n: the overlap's upper bound decides."""
    only_one = np.bitwise_count(bits & ~others).sum(1, dtype=np.int64)
    only_other = np.bitwise_count(others & ~bits).sum(1, dtype=np.int64)
    overlap = np.minimum(n - only_one, m - only_other)
    return 100 * overlap >= percent * (n + m - overlap)


def _sets(size: int):
    def run(batches):
        for batch in batches:
            for s, sets in shingle_sets(batch, size):
                take = s.rows[0], len(s.rows)
                yield pa.RecordBatch.from_arrays(
                    [_column(batch, c).slice(*take) for c in ("node", "rid1", "rid2")]
                    + [pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([_bitmap(x) for x in sets], pa.binary())],
                    ["node", "rid1", "rid2", "n", "items", "bits"],
                )

    return run


def _postings(percent: int):
    def run(batches):
        for batch in batches:
            item, node = [], []
            for k, raw, at, cls in zip(*(_column(batch, c).to_pylist() for c in ("node", "items", "pos", "cls")), strict=True):
                x, at = np.frombuffer(raw, U), np.frombuffer(at, np.uint32)
                left = (len(x) * (100 - percent)) // 100 + 1 - (len(x) - len(at))
                if left > 0:  # else the unique shingles alone fill the prefix
                    order = np.lexsort((x[at], np.frombuffer(cls, np.uint8)))[:left]
                    item.append(x[at[order]])
                    node.append(np.full(len(item[-1]), k, np.int64))
            if item:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(item).view(np.int64)), pa.array(np.concatenate(node))], ["item", "node"])

    return run


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            pairs = (part for lo in range(0, batch.num_rows, 256) for part in zip(*(_column(batch, c).slice(lo, 256).to_pylist() for c in ("items_a", "items_b", "bits_a", "bits_b")), strict=True))
            for x, y, p, q in pairs:
                n, m, size = len(x) // 8, len(y) // 8, min(len(p), len(q))
                p, q = (_fold(np.frombuffer(z, np.uint8), size) for z in (p, q))
                ok = bool(may_link(n, p, np.array([m]), q[None], percent)[0])
                if ok:
                    both = len(np.intersect1d(np.frombuffer(x, U), np.frombuffer(y, U), assume_unique=True))
                    ok = 100 * both >= percent * (n + m - both)
                keep.append(ok)
            yield pa.RecordBatch.from_arrays([_column(batch, "a"), _column(batch, "b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _tile(percent: int):
    """Pairs of a tile that lie in different components and pass the bitmap bound.

    Documents that meet under many shingles would be named under each; a pair is left to a smaller
    shingle that both list among their first ones.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        node, root, n, side = (np.asarray(table[c]) for c in ("node", "root", "n", "side"))
        raw = [np.frombuffer(x, np.uint8) for x in table["bits"].to_pylist()]
        size = min(len(x) for x in raw)
        maps = np.stack([_fold(x, size) for x in raw]).view(U)
        ones, others = np.flatnonzero(side < 2), np.flatnonzero(side % 2 == 0)
        item = key[0].as_py()
        lists = table["first"].to_pylist()
        earlier = np.array(sorted({v for x in lists for v in x if v < item}), np.int64)
        member = np.zeros((len(node), len(earlier)), bool)
        for i, x in enumerate(lists):
            member[i, np.searchsorted(earlier, [v for v in x if v < item])] = True
        a, b = [], []
        for i in ones:
            at = others[(root[others] != root[i]) & (100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i]))]
            at = at[~(member[at] & member[i]).any(axis=1)]
            at = at[may_link(n[i], maps[i], n[at], maps[at], percent)]
            a.append(np.minimum(node[i], node[at]))
            b.append(np.maximum(node[i], node[at]))
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0) if a else np.zeros((0, 2), np.int64)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return run


def _checked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    side = lambda c: sets.select(F.col("node").alias(c), F.col("items").alias(f"items_{c}"), F.col("bits").alias(f"bits_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_verify(percent), "a long, b long")


def _with_root(nodes: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return nodes.withColumn("root", F.col("node"))
    return nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _still_open(postings: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Postings of shingles under which different components meet; of shingles with the same documents, one."""
    now = _with_root(postings.select("item", "node"), roots)
    name = F.xxhash64("node")
    mixed = now.groupBy("item").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("m"), F.bit_xor(name).alias("p"), F.sum(name % 1000003).alias("q")).where("x <> y")
    mixed = mixed.groupBy("m", "p", "q").agg(F.min("item").alias("item")).select("item", "m")
    return now.join(mixed, "item")


def linked_sets(postings: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """(node, root) of sets that link, directly or by way of others."""
    links, roots = None, None
    for turn in range(ROUNDS):
        now = _still_open(postings, roots).withColumn("part", F.pmod(F.xxhash64("item", F.lit(turn)), F.lit(LEADERS)))
        lead = now.groupBy("item", "part").agg(F.min_by(F.struct("node", "root"), F.xxhash64("node", "part", F.lit(turn))).alias("lead"))
        pairs = now.join(lead, ["item", "part"]).where("root <> lead.root").select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).distinct()
        found = cut(_checked(pairs, sets, percent), "linked")
        links = found if links is None else links.unionByName(found)
        roots = components(links)
    found = cut(_checked(_tile_pairs(cut(_still_open(postings, roots), "open"), sets, percent), sets, percent), "linked")
    return components(links.unionByName(found))


def _tile_pairs(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of sets with different roots that meet under a shingle and pass the bitmap bound."""
    first = rest.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("item")), 1, FIRST).alias("first"))
    rest = rest.join(sets.select("node", "n", "bits").join(first, "node"), "node")
    band = F.floor(F.log("n") / F.log(F.lit(100.0 / percent))).cast("int")
    blocks = F.ceil(F.col("m") / TILE).cast("int")
    block = F.pmod(F.xxhash64("node"), blocks).cast("int")
    rest = rest.withColumns({"band": band, "blocks": blocks}).withColumn("block", block)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    # a tile is (band, block) against (the same or the next band, block); side 0: both, 1: first, 2: second
    body = ["item", "node", "root", "n", "bits", "first"]
    rest = rest.select(*body, "band", "block", other)
    tiles = rest.select(*body, "band", F.lit(0).alias("step"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).alias("side"))
    tiles = tiles.unionByName(rest.select(*body, "band", F.lit(1).alias("step"), F.col("block").alias("i"), F.col("other").alias("j"), F.lit(1).alias("side")))
    tiles = tiles.unionByName(rest.select(*body, (F.col("band") - 1).alias("band"), F.lit(1).alias("step"), F.col("other").alias("i"), F.col("block").alias("j"), F.lit(2).alias("side")))
    return tiles.groupBy("item", "band", "step", "i", "j").applyInArrow(_tile(percent), "a long, b long").distinct()


def jaccard_links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """The join itself: (links, members).

    members(id, rid1, rid2, n_shingles, node) has a row per document; documents of equal sets share their node, and
    those without words have none. links(a, b) has each pair of different nodes whose sets are linked, a < b, once;
    all of them, also inside groups of near copies, so there are as many rows as there are links between different
    sets. A document's links are its node's other members and the members of the nodes linked to it (`link_counts`).
    """
    named, sets, postings = _prepared(docs, doc_id, text, shingle, percent)
    links = _checked(_tile_pairs(cut(_still_open(postings, None), "open"), sets, percent), sets, percent)
    return links, named.select("id", "rid1", "rid2", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("node")).alias("node"))


def link_counts(links: DataFrame, members: DataFrame) -> DataFrame:
    """members with n_links: how many other documents each is linked with directly."""
    size = cut(members.where("node is not null").groupBy("node").agg(F.count("*").alias("size")), "classes")
    both = links.union(links.select("b", "a"))
    near = both.join(size.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("size").alias("near"))
    total = size.join(near, "node", "left").select("node", (F.col("size") - 1 + F.coalesce("near", F.lit(0))).alias("total"))
    return members.join(total, "node", "left").withColumn("n_links", F.coalesce("total", F.lit(0))).drop("total")


def _prepared(docs: DataFrame, doc_id: str, text: str, shingle: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Steps 1 to 3: (all documents and the names of their sets, sets that may link, where they meet)."""
    rows = keyed(docs, doc_id, text)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, rid1 long, rid2 long, n long, node long"
    named = cut(rows.mapInArrow(_sizes(shingle), schema), "sets")
    # 1. one document of each class
    one = named.where("n > 0").groupBy("node").agg(F.min(F.struct("rid1", "rid2", "n")).alias("x")).select("node", "x.*")
    # 2. those without too many shingles of their own
    found = find_repeats(rows, _emit_sample(shingle, percent)).select("rid1", "rid2", "hits")
    taken = F.least("n", F.floor(F.col("n") * (100 - percent) * 3 / 2 / 100).cast("long") + 2)
    most = F.floor(F.col("n") * (100 - percent) / 100) + 1  # as in alone()
    left = cut(one.join(found, ["rid1", "rid2"]).where(taken - F.col("hits") <= most).select("rid1", "rid2", "node"), "left")
    sets = rows.join(small(left, BROADCAST_KEYS), ["rid1", "rid2"]).dropDuplicates(["node"]).select("node", "rid1", "rid2", "text")
    sets = cut(sets.mapInArrow(_sets(shingle), "node long, rid1 long, rid2 long, n long, items binary, bits binary"), "items")
    # 3. where they meet
    ranked = sets.join(find_classes(sets, _emit_sets), ["rid1", "rid2"])
    return named, sets, cut(ranked.select("node", "items", "pos", "cls").mapInArrow(_postings(percent), "item long, node long"), "postings")


def jaccard_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(id, rid1, rid2, n_shingles, node, root, component_id): a row per document; equal sets share node, linked ones root."""
    named, sets, postings = _prepared(docs, doc_id, text, shingle, percent)
    # 4. who links
    roots = linked_sets(postings, sets, percent)
    out = named.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = out.where("n > 0").groupBy("root").agg(F.min("id").alias("component_id"))
    out = out.join(names, "root", "left")
    return out.select("id", "rid1", "rid2", F.col("n").alias("n_shingles"), "node", "root", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, without those linked to a row that stays.

    Of each group the smallest id stays (an id before none); texts without words all stay.
    """
    groups = jaccard_groups(docs, doc_id, text)
    order = F.struct(F.col("id").isNull().alias("x"), "id", "rid1", "rid2")
    alone = groups.where("n_shingles = 0").select("rid1", "rid2", F.lit(True).alias("alone")).distinct()
    stay = groups.where("n_shingles > 0").groupBy("root").agg(F.min(order).alias("m")).select("m.rid1", "m.rid2", F.lit(False).alias("alone"))
    kept = with_keys(docs, doc_id, text).join(stay.unionByName(alone), ["rid1", "rid2"])
    first = F.row_number().over(Window.partitionBy("rid1", "rid2").orderBy("rid1"))  # rows repeated as a whole share their key
    return kept.withColumn("n", first).where("alone or n = 1").select("row.*")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of `documents`: the size of its shingle set and the smallest id it is linked with."""
    out = jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
