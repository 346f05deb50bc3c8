"""Near copies among embeddings: a forest of random-projection trees with spill.

Only vectors of equal label and dimension are compared. Equal vectors are one node with a count. A
bounded sample fits each tree's splits (a random direction per level, the sample's median per
branch); all vectors are then led through every tree, and those near a split go to both sides. Leaves
that are still large are split again, round by round, at their own mean. Within a leaf all vectors
are compared in double precision. A leaf that no split takes apart (a dense cluster) is compared in
tiles, so that no task holds more than two blocks of `LEAF` vectors.

A pair may meet in several leaves; it counts in the smallest leaf name that both have. A leaf yields
a count for each vector and a spanning set of links, never its pairs.

The margin is one standard deviation of the distance that a random direction shows of two vectors at
the threshold. A pair is lost only if all trees part it; see the README for measured recall.

Handled cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows
without a label, link with nothing and are their own component; repeated rows are linked copies; rows
with a null id are compared and counted, but do not name a component.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.components import components
from llm.shared import cut

THRESHOLD, TREES, LEAF, SAMPLE, SEED = 0.98, 5, 512, 20_000, 5
MAX_LEVELS, MAX_ROUNDS = 10, 30
#: The sample is as many vectors as fit this, at most SAMPLE.
SAMPLE_BYTES = 32 << 20


def _matrix(column) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.float64) for x in column])


def _directions(dim: int, tree: int) -> np.ndarray:
    r = np.random.default_rng([SEED, dim, tree]).standard_normal((MAX_LEVELS + MAX_ROUNDS, dim))
    return r / np.linalg.norm(r, axis=1, keepdims=True)


def margin(dim: int, threshold: float) -> float:
    return float(np.sqrt(2 - 2 * threshold) / np.sqrt(dim))


def fit_trees(sample: dict[int, np.ndarray], levels: int) -> dict[int, list[list[np.ndarray]]]:
    """For each dimension, tree and level, the split value of each branch; infinite where too few vectors came."""
    out = {}
    for dim, x in sample.items():
        out[dim] = []
        for t in range(TREES):
            path, tree = np.zeros(len(x), np.int64), []
            for d, r in enumerate(_directions(dim, t)[:levels]):
                p = x @ r
                cutoff = np.full(1 << d, np.inf)
                order = np.argsort(path, kind="stable")
                edge = np.searchsorted(path[order], np.arange((1 << d) + 1))
                for b in range(1 << d):
                    if edge[b + 1] - edge[b] >= 8:
                        cutoff[b] = np.median(p[order[edge[b] : edge[b + 1]]])
                tree.append(cutoff)
                path = path * 2 + (p >= cutoff[path])
            out[dim].append(tree)
    return out


def _lead(trees, threshold: float):
    def run(frames):
        for f in frames:
            for dim, part in f.groupby("dim"):
                x = _matrix(part["unit"])
                for t in range(TREES):
                    row, path = np.arange(len(x)), np.zeros(len(x), np.int64)
                    r = _directions(dim, t)
                    for d, cutoff in enumerate(trees[dim][t] if dim in trees else []):
                        p = x[row] @ r[d]
                        c, m = cutoff[path], margin(dim, threshold)
                        left, right = p < c + m, p >= c - m
                        row, path = np.r_[row[left], row[right]], np.r_[path[left] * 2, path[right] * 2 + 1]
                    yield pd.DataFrame({"node": part["node"].to_numpy()[row], "label": part["label"].to_numpy()[row], "dim": dim, "tree": t, "path": path})

    return run


def _project(turn: int):
    def run(frames):
        for f in frames:
            p = np.zeros(len(f))
            for (dim, tree), at in f.groupby(["dim", "tree"]).indices.items():
                p[at] = _matrix(f["unit"].iloc[at]) @ _directions(dim, tree)[MAX_LEVELS + turn]
            yield f[["node", "dim", "tree", "leaf"]].assign(p=p)

    return run


def leaves(nodes: DataFrame, threshold: float) -> DataFrame:
    """(node, leaf): every leaf each node is in."""
    n, widest = nodes.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1))).first()
    some = nodes.orderBy(F.xxhash64("node"), "node").limit(max(1, min(SAMPLE, SAMPLE_BYTES // (8 * widest)))).select("dim", "label", "unit").toPandas()
    sample = {int(dim): _matrix(part["unit"]) for dim, part in some.groupby("dim")}
    groups = max(1, some[["dim", "label"]].drop_duplicates().shape[0])
    levels = int(np.clip(np.ceil(np.log2(max(1.0, n / groups / LEAF))), 0, MAX_LEVELS))
    led = nodes.select("node", "label", "dim", "unit").mapInPandas(_lead(fit_trees(sample, levels), threshold), "node long, label string, dim int, tree int, path long")
    led = cut(led.select("node", "dim", "tree", F.xxhash64("label", "dim", "tree", "path").alias("leaf")), "leaves")
    done = []
    for turn in range(MAX_ROUNDS):
        sizes = led.groupBy("leaf").count()
        large = cut(sizes.where(F.col("count") > LEAF).select("leaf"), "large")
        if large.isEmpty():
            break
        done.append(led.join(large, "leaf", "left_anti").select("node", "leaf"))
        rows = led.join(large, "leaf").join(nodes.select("node", "unit"), "node").select("node", "dim", "tree", "leaf", "unit")
        p = cut(rows.mapInPandas(_project(turn), "node long, dim int, tree int, leaf long, p double"), "split")
        middle = p.groupBy("leaf").agg(F.avg("p").alias("c"), F.coalesce(F.stddev_samp("p"), F.lit(0.0)).alias("s"))
        p = p.join(middle, "leaf").withColumn("m", F.sqrt(F.lit(2 - 2 * threshold)) / F.sqrt("dim"))
        done.append(p.where("s < 2 * m").select("node", "leaf"))  # a split would send nearly all to both sides
        sides = F.array_compact(F.array(F.when(F.col("p") < F.col("c") + F.col("m"), 0), F.when(F.col("p") >= F.col("c") - F.col("m"), 1)))
        led = cut(p.where("s >= 2 * m").select("node", "dim", "tree", "leaf", F.explode(sides).alias("side")).select("node", "dim", "tree", F.xxhash64("leaf", "side").alias("leaf")), "leaves")
    out = led.select("node", "leaf")
    for other in done:
        out = out.unionByName(other)
    return out


def _compare(threshold: float):
    """Counts and spanning links of a tile: rows of side 0 against each other, or side 1 against side 2."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        leaf = key[0].as_py()
        node, copies, side = (np.asarray(table[c]) for c in ("node", "copies", "side"))
        x = _matrix(table["unit"].to_pylist())
        link = (x @ x.T) >= threshold
        np.fill_diagonal(link, False)
        if (side > 0).any():
            link &= side[:, None] != side[None, :]
        own = table["leaves"].to_pylist()
        earlier = np.array(sorted({v for row in own for v in row if v < leaf}), np.int64)
        counted = link
        if len(earlier):
            member = np.zeros((len(node), len(earlier)), np.float32)
            for i, row in enumerate(own):
                member[i, np.searchsorted(earlier, [v for v in row if v < leaf])] = 1
            counted = link & ((member @ member.T) == 0)
        add = counted @ copies
        root = np.arange(len(node))
        while True:  # smallest place reachable within the tile
            low = np.minimum(root, np.where(link, root[None, :], len(node)).min(axis=1))
            low = low[low]
            if (low == root).all():
                break
            root = low
        keep = (add > 0) | (root != np.arange(len(node)))
        return pa.table({"node": pa.array(node[keep]), "links": pa.array(add[keep].astype(np.int64)), "near": pa.array(node[root[keep]])})

    return run


def vector_links(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_links, component_id): for each row, how many others it is linked with and the smallest id it reaches."""
    body = F.col(embedding).cast("array<double>")
    usable = F.col(label).isNotNull() & (F.size(body) > 0) & ~F.exists(body, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(label).cast("string").alias("label"), body.alias("vec"), F.coalesce(usable, F.lit(False)).alias("usable"))
    rows = rows.withColumn("usable", F.col("usable") & F.coalesce(F.exists("vec", lambda v: v != 0), F.lit(False)))
    rows = rows.withColumn("node", F.when(F.col("usable"), F.xxhash64("label", "vec")))
    named = cut(rows.select("id", "node"), "vectors")
    unique = rows.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vec").alias("vec"))

    def unit(frames):
        for f in frames:
            x = [np.asarray(v, np.float64) for v in f["vec"]]
            x = [v / np.abs(v).max() for v in x]
            yield f[["node", "copies", "label"]].assign(dim=[len(v) for v in x], unit=[(v / np.linalg.norm(v)).tobytes() for v in x])

    nodes = cut(unique.mapInPandas(unit, "node long, copies long, label string, dim int, unit binary"), "nodes")
    placed = cut(leaves(nodes, threshold).distinct(), "placed")
    sizes = placed.groupBy("leaf").count().select("leaf", F.ceil(F.col("count") / (2 * LEAF)).cast("int").alias("blocks"))
    own = placed.groupBy("node").agg(F.collect_set("leaf").alias("leaves"))  # at most the leaves of TREES trees
    sides = nodes.select("node", "copies", "unit").join(own, "node").withColumn("leaf", F.explode("leaves")).join(sizes, "leaf")
    sides = sides.withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("b") == F.col("o"), 0).when(F.col("b") < F.col("o"), 1).otherwise(2)
    tiles = sides.select("leaf", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), side.alias("side"), "node", "copies", "unit", "leaves")
    found = cut(tiles.groupBy("leaf", "i", "j").applyInArrow(_compare(threshold), "node long, links long, near long"), "found")
    roots = components(found.select(F.col("node").alias("a"), F.col("near").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    table = nodes.select("node", "copies").join(counts, "node", "left").join(roots, "node", "left")
    out = named.join(table, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = out.where("root is not null").groupBy("root").agg(F.min("id").alias("component_id"))
    out = out.join(names, "root", "left")
    n = F.when(F.col("node").isNull(), F.lit(0)).otherwise(F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    return out.select("id", n.cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))


def op9_vector_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vector of `embeddings`: its links, its component and whether it is kept."""
    out = vector_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
