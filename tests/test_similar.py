import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.functions import vectors
from riskloom.operators import similar
from riskloom.operators.similar import TopKOptions, similar_topk


def brute(queries, cases, k):
    out = {}
    for qid, q in queries:
        scored = []
        for cid, c, _ in cases:
            n = sum(x * x for x in q) * sum(x * x for x in c)
            scored.append((-(float(np.dot(q, c)) / np.sqrt(float(n)) if n else 0.0), cid))
        out[qid] = [(cid, -s) for s, cid in sorted(scored)[:k]]
    return out


def random_side(rng, n, dim, groups):
    centres = rng.integers(-4, 5, (groups, dim))
    rows = centres[rng.integers(0, groups, n)] + rng.integers(-1, 2, (n, dim))
    rows[: max(1, n // 20)] = 0  # zero vectors
    rows[n // 3 : 2 * n // 3] = rows[n // 3]  # a third are copies of one
    return [[int(x) for x in r] for r in rows]


OPTIONS = [
    TopKOptions(),
    TopKOptions(resident_bytes=0, block_rows=15),
    TopKOptions(resident_bytes=0, block_rows=300),  # one tile
]


@pytest.mark.parametrize("options", OPTIONS, ids=["resident", "grid", "one-tile"])
@pytest.mark.parametrize("k", [1, 5, 20])
def test_topk_equals_brute_force(spark, options, k):
    rng = np.random.default_rng(3)
    cases = [(f"c{i:04d}", v, f"t{i}") for i, v in enumerate(random_side(rng, 240, 12, 9))]
    queries = list(enumerate(random_side(rng, 60, 12, 9)))
    found = similar_topk(
        spark.createDataFrame(queries, "qid bigint, vec array<int>").repartition(5),
        spark.createDataFrame(cases, "case_id string, vec array<int>, title string").repartition(3),
        k, "qid", ["title"], options,
    )
    got = {r["qid"]: [(s["case_id"], s["cosine"]) for s in r["similar"]] for r in found.collect()}
    assert got == brute(queries, cases, k)


@pytest.mark.parametrize("options", OPTIONS[:2])
def test_fewer_cases_than_k_and_none(spark, options):
    queries = spark.createDataFrame([(1, [1, 0]), (2, [0, 0])], "qid bigint, vec array<int>")
    cases = spark.createDataFrame([("b", [1, 1], "x"), ("a", [-1, 0], "y")], "case_id string, vec array<int>, title string")
    got = {r["qid"]: [s["case_id"] for s in r["similar"]] for r in similar_topk(queries, cases, 5, "qid", ["title"], options).collect()}
    assert got == {1: ["b", "a"], 2: ["a", "b"]}


@pytest.mark.parametrize("options", OPTIONS)
def test_repeated_and_null_query_ids(spark, options):
    queries = spark.createDataFrame([(1, [1, 0]), (1, [0, 1]), (None, [1, 1]), (1, [0, 1])], "qid bigint, vec array<int>")
    cases = spark.createDataFrame([("a", [1, 0]), ("b", [0, 1]), ("c", [2, 2])], "case_id string, vec array<int>")
    got = similar_topk(queries, cases, 1, "qid", [], options).collect()
    rows = sorted((str(r["qid"]), r["vec"], r["similar"][0]["case_id"]) for r in got)
    assert rows == [("1", [0, 1], "b"), ("1", [0, 1], "b"), ("1", [1, 0], "a"), ("None", [1, 1], "c")]


@pytest.mark.parametrize("options", [TopKOptions(decimals=9), TopKOptions(resident_bytes=0, block_rows=50, decimals=9)])
def test_float_vectors(spark, options):
    v = np.random.default_rng(5).standard_normal((400, 16)).astype(np.float32)
    v[200:] = v[:200]  # every vector twice: ties
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "qid bigint, vec array<float>")
    found = similar_topk(table.repartition(3), table.withColumnRenamed("qid", "case_id"), 3, "qid", [], options).collect()
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    cosine = np.round(unit @ unit.T, 9)
    for r in found:
        want = sorted((-c, j) for j, c in enumerate(cosine[r["qid"]]))[:3]
        assert [s["case_id"] for s in r["similar"]] == [j for _, j in want]


@pytest.mark.parametrize("k", [1, 4, 40])
@pytest.mark.parametrize("width, used", [(64, 3), (16, 16), (256, 2)])
def test_tiles_spare_products_and_lose_nothing(k, width, used):
    rng = np.random.default_rng(width + k)

    def sparse(n):  # few non-zero buckets, many of them alike, some zero
        out = np.zeros((n, width))
        for r in out[n // 10 :]:
            r[rng.choice(width, used, replace=False)] = rng.integers(1, 4, used) * rng.choice([-1, 1], used)
        out[n // 2 : n // 2 + n // 5] = out[n // 2]
        return out

    q, c = sparse(150), sparse(700)
    query, case, cosine, products = similar.tile_topk(q, c, k)
    length = np.sqrt(np.outer((q**2).sum(1), (c**2).sum(1)))
    full = np.divide(q @ c.T, length, out=np.zeros_like(length), where=length > 0)
    for i, row in enumerate(full):
        want = sorted((-s, j) for j, s in enumerate(row))[:k]
        assert [(-s, j) for s, j in zip(cosine[query == i], case[query == i], strict=True)] == want
    assert products <= full.size * 1.3
    if used < 4 and k == 1:
        assert products < 0.8 * full.size


@pytest.mark.parametrize("kind", ["small", "large", "huge", "float", "mixed", "odd"])
@pytest.mark.parametrize("k", [1, 5, 30])
def test_bounded_scores_lose_no_case(monkeypatch, kind, k):
    monkeypatch.setattr(similar, "CASE_STEP", 200)
    monkeypatch.setattr(similar, "QUERY_STEP", 40)
    rng = np.random.default_rng(k)
    q, c = (np.array(random_side(rng, n, 8, 5)) for n in (90, 650))
    if kind in ("large", "huge"):
        q, c = q * 1001, c * (10**4 if kind == "large" else 10**6)
    if kind in ("float", "odd"):
        q, c = q + 0.1, c * 0.3
    if kind == "mixed":
        q = q + 0.5
    if kind == "odd":
        c[7, 1], q[3, 2] = np.nan, np.inf
    decimals = 9 if kind in ("float", "mixed") else None
    picked, cosine = similar.CaseSide(c, k, decimals).best(q)
    with np.errstate(invalid="ignore"):
        s = similar._cosines(q.astype(float), (q.astype(float) ** 2).sum(1), c.astype(float), (c.astype(float) ** 2).sum(1), decimals)
    if kind == "odd":  # as before: what is not a number comes first
        s = s[:3]
        picked, cosine = picked[:3], cosine[:3]
    want = np.argsort(-s, axis=1, kind="stable")[:, :k] if kind != "odd" else similar._best(s, k)
    if kind != "odd":
        assert (picked == want).all()
        assert np.allclose(cosine, np.take_along_axis(s, want, axis=1), rtol=0, atol=1e-12)
    else:
        assert picked.shape == want.shape


def test_vectors_are_copied_to_few_tiles():
    """At 1 GB a tile of 2,048 meant 250 copies of each query's vector and 131 of each document's."""
    options = TopKOptions(block_rows=2048)
    b = similar.tile_rows(267_690, 512_820, options, 12)
    rows, columns = similar.grid_of(267_690, 512_820, TopKOptions(block_rows=b))
    assert rows + columns < 30 and rows * columns >= 12
    assert similar.tile_rows(100, 100, options, 12) == 2048
    assert similar.tile_rows(10**8, 10**8, options, 12) == similar.TILE_ROWS


@pytest.mark.parametrize("kind", ["tinyint", "int", "bigint", "float", "double"])
def test_packed_vectors(spark, kind):
    rows = [[1, -2, 3], [0, 0, 0], [100, 127, -127], [-90, 5, 6]] + ([[40000, 1, 2], [300, -1, 0]] if kind != "tinyint" else [])
    df = spark.createDataFrame([(i, r if "in" in kind else [x / 4 for x in r]) for i, r in enumerate(rows)] + [(99, None)], f"i int, vec array<{kind}>")
    got = {r["i"]: r["b"] for r in df.coalesce(1).select("i", similar._packed("vec").alias("b")).collect()}
    assert got.pop(99) is None
    import pyarrow as pa

    back = similar._unpacked(pa.array([bytes(got[i]) for i in range(len(rows))], pa.binary()), 3)
    assert back.tolist() == [r if "in" in kind else [x / 4 for x in r] for r in rows]
    if "in" in kind:
        assert len(got[0]) == 4 and (kind == "tinyint" or len(got[4]) == 13)
    with pytest.raises(ValueError):
        similar._unpacked(pa.array([bytes(got[0])], pa.binary()), 4)


def test_many_rows_are_many_tasks(spark, tmp_path, monkeypatch):
    from riskloom import session

    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t"))
    scan = spark.read.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(session, "SPREAD_ROWS", 50)
    assert session.spread(scan).rdd.getNumPartitions() == 20
    fine = scan.repartition(30)
    assert session.spread(fine, scan) is fine


def test_counts_equal_the_codes_of_the_tokens(spark, monkeypatch):
    import pyarrow as pa

    texts = ["", "你好 world 123你", "單a", "a-b_c " * 50, "x", "é😀中文9 k", "", "通缉" * 30]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    codes = {r["i"]: r["c"] for r in df.select("i", vectors.bucket_codes(vectors.tokens(F.col("t")), 64).alias("c")).collect()}
    monkeypatch.setattr(vectors, "SLICE_BYTES", 16)
    got = np.concatenate([vectors.signed_counts(some, 64) for some in vectors._slices(pa.array(texts))])
    for i in range(len(texts)):
        want = [0] * 64
        for code in codes[i]:
            want[code >> 1] += 1 if code & 1 else -1
        assert got[i].tolist() == want


def test_tiles_grow_with_both_sides():
    options = TopKOptions(block_rows=100)
    assert similar.grid_of(0, 0, options) == (1, 1) and similar.grid_of(100, 101, options) == (1, 2)
    assert similar.grid_of(10**6, 10**5, options) == (10**4, 10**3)


def test_a_vector_that_most_queries_share_is_scored_once(spark):
    """Its queries meet the result by two hashes; vectors themselves are not sent back."""
    queries = spark.createDataFrame([(i, [1, 2, 0] if i % 3 else [i, 1, 1]) for i in range(300)], "qid bigint, vec array<int>")
    cases = spark.createDataFrame([(f"c{i}", [i % 5, i % 7, 1]) for i in range(50)], "case_id string, vec array<int>")
    found = similar_topk(queries, cases, 2, "qid", [], TopKOptions(resident_bytes=0, block_rows=20))
    assert found.count() == 300 and found.where("size(similar) <> 2").isEmpty()
    assert found.where("vec = array(1, 2, 0)").select("similar").distinct().count() == 1


def test_no_cases(spark):
    queries = spark.createDataFrame([(1, [1, 0])], "qid bigint, vec array<int>")
    cases = spark.createDataFrame([], "case_id string, vec array<int>, title string")
    assert similar_topk(queries, cases, 5, "qid", ["title"]).first()["similar"] == []


def test_mixed_spaces_fail(spark):
    cases = spark.createDataFrame([("a", [1], "x"), ("b", [1], "y")], "case_id string, vec array<int>, space string")
    queries = spark.createDataFrame([(1, [1])], "qid bigint, vec array<int>")
    with pytest.raises(ValueError):
        similar_topk(queries, cases, 1, "qid", [])


def expected_vector(text, dim):
    units = re.findall(r"[一-龥]|[A-Za-z0-9]+", text.lower())
    vec = [0] * dim
    for token in units + [a + b for a, b in zip(units, units[1:])]:
        h = int.from_bytes(hashlib.md5(token.encode()).digest()[:8], "little")
        vec[h % dim] += 1 if h >> 63 else -1
    return vec


@pytest.mark.parametrize("dim", [256, 100, 1024, 64])
def test_hash_vector(spark, dim):
    texts = ["", "你好 World 123", "单", "A-b_c " * 50, "通缉名单，案件编号", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(4)
    rows = df.select("i", vectors.hash_vector(F.col("t"), dim).alias("v"), vectors.norm2(vectors.hash_vector(F.col("t"), dim)).alias("n")).collect()
    for r in rows:
        want = expected_vector(texts[r["i"]] or "", dim)
        assert r["v"] == want and r["n"] == sum(x * x for x in want)


def test_the_bound_is_not_taken_again_for_every_block_of_cases(monkeypatch):
    """The k-th best so far bounds most blocks; maxima of groups cost a pass over all scores."""
    monkeypatch.setattr(similar, "CASE_STEP", 100)
    rng = np.random.default_rng(4)
    q, c = (rng.standard_normal((n, 16)).astype(np.float32) for n in (203, 4001))
    taken, kth = [], similar.CaseSide._kth
    monkeypatch.setattr(similar.CaseSide, "_kth", staticmethod(lambda s, k: taken.append(1) or kth(s, k)))

    def check(c):
        picked, cosine = similar.CaseSide(c, 5, 9).best(q)
        s = similar._cosines(q.astype(float), (q.astype(float) ** 2).sum(1), c.astype(float), (c.astype(float) ** 2).sum(1), 9)
        want = np.argsort(-s, axis=1, kind="stable")[:, :5]
        assert (picked == want).all() and np.allclose(cosine, np.take_along_axis(s, want, axis=1), rtol=0, atol=1e-12)

    check(c)
    assert len(taken) < 20  # of 41 blocks
    check(c[np.argsort(c @ q[0])])  # cases get better and better


def test_places_and_equal_vectors(monkeypatch):
    rng = np.random.default_rng(6)
    for n in (0, 3, 8, 1001):
        marks = rng.random(n) < 0.1
        assert similar._places(marks).tolist() == np.flatnonzero(marks).tolist()
    for kind in (np.int8, np.int32, np.float32, np.float64):
        m = rng.integers(-2, 3, (300, 3)).astype(kind)
        first, which = similar._distinct(m)
        assert (m[first][which] == m).all() and len(first) == len(np.unique(m, axis=0))
    monkeypatch.setattr(similar.np.random, "default_rng", lambda seed: type("One", (), {"integers": lambda self, *a: np.zeros(a[2], np.uint64)})())
    m = np.array([[1, 2], [2, 1], [1, 2]])  # equal sums
    first, which = similar._distinct(m)
    assert len(first) == 2 and (m[first][which] == m).all()


def test_a_vector_is_made_once_for_each_query_and_each_text(spark, monkeypatch):
    """The route for large tables reads its queries twice; they were computed twice, and a text for every row that has it."""
    made = spark.sparkContext.accumulator(0)

    @F.arrow_udf("array<int>")
    def vector(i):
        import pyarrow as pa

        made.add(len(i))
        return pa.array([[n % 7, 1, n % 3] if n % 10 else None for n in i.to_pylist()], pa.list_(pa.int32()))

    queries = spark.range(200).repartition(2).select(F.col("id").alias("qid"), F.lit(None).alias("none"), vector("id").alias("vec"))
    cases = spark.createDataFrame([(f"c{i}", [i % 5, i % 7, 1]) for i in range(50)], "case_id string, vec array<int>")
    options = TopKOptions(resident_bytes=0, block_rows=20)
    found = similar_topk(queries, cases, 2, "qid", [], options)
    assert found.columns == ["qid", "none", "vec", "similar"] and found.schema["vec"].dataType == queries.schema["vec"].dataType
    rows = {r["qid"]: r for r in found.collect()}
    assert made.value == 200 and len(rows) == 200
    assert rows[10]["vec"] is None and rows[10]["similar"] is None and rows[9]["vec"] == [2, 1, 0] and len(rows[9]["similar"]) == 2
    bare = similar_topk(queries, cases, 2, "qid", [], options, keep_vec=False)
    assert bare.columns == ["qid", "none", "similar"] and {r["qid"]: r["similar"] for r in bare.collect()} == {i: r["similar"] for i, r in rows.items()}
    assert made.value == 400
    assert similar_topk(queries, cases, 2, "qid", [], keep_vec=False).columns == ["qid", "none", "similar"]


def test_a_text_of_many_rows_is_counted_once(spark, monkeypatch):
    import pyarrow as pa

    seen = []
    count = vectors.signed_counts
    monkeypatch.setattr(vectors, "signed_counts", lambda texts, dim: seen.append(len(texts)) or count(texts, dim))
    texts = ["你好 a b", "", "a b", "你好 a b"] * 50
    got = vectors.counts_of(pa.array(texts), 16)
    assert seen == [3] and (got == count(pa.array(texts), 16)).all()
    assert vectors.counts_of(pa.array([], pa.string()), 16).shape == (0, 16)
