"""Links among vectors against brute force, with leaves small enough to be split and tiled."""

import brute
import numpy as np
import pytest

from llm import vector_forest


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(1)
    rows = []
    for c in range(60):
        x = rng.standard_normal(24)
        rows += [(len(rows) + k, (x + rng.standard_normal(24) * 0.08).tolist(), c % 3) for k in range(6)]
    x = rng.standard_normal(24)
    rows += [(1000 + i, x.tolist(), 1) for i in range(30)]  # one vector many times
    rows += [(2000 + i, (x + rng.standard_normal(24) * 0.02).tolist(), 2) for i in range(80)]  # a dense cluster
    rows += [(3000, None, 1), (3001, [0.0] * 24, 1), (3002, [float("nan")] * 24, 1), (3003, [None] * 24, 1), (3004, x.tolist(), None), (3005, [], 1), (3006, [1.0, 2.0], 1), (3007, [2.0, 4.0], 1), (3008, [float("inf"), 1.0], 1)]
    return rows + [(0, rows[0][1], rows[0][2])]


def expected(rows):
    n = len(rows)
    usable = [v is not None and len(v) > 0 and None not in v and bool(np.isfinite(v).all()) and any(v) and y is not None for _, v, y in rows]
    pairs = []
    for i in range(n):
        for j in range(i):
            if usable[i] and usable[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.98:
                    pairs.append((j, i))
    deg = np.bincount(np.array(pairs).ravel(), minlength=n)
    return [(r[0], int(d), c) for r, d, c in zip(rows, deg, brute.smallest_ids([r[0] for r in rows], brute.classes(n, pairs)), strict=True)]


@pytest.mark.parametrize(("leaf", "levels"), [(512, 10), (16, 2)])
def test_links(spark, vectors, same, monkeypatch, leaf, levels):
    monkeypatch.setattr(vector_forest, "LEAF", leaf)
    monkeypatch.setattr(vector_forest, "MAX_LEVELS", levels)
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int")
    got = vector_forest.vector_links(table).collect()
    want = expected(vectors)
    found, there = sum(r["n_links"] for r in got), sum(n for _, n, _ in want)
    assert there * 0.9 <= found <= there  # none below the threshold is ever linked
    if leaf == 512:
        same(got, want)


def test_no_vectors(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vector_forest.vector_links(table).count() == 0
