import os
import random

import brute
import numpy as np
import pytest

from llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, id string, k int, code string, error int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA).repartition(3)


def codes(df, **kw):
    coded, books = vector_codes.encode(df, **kw)
    out = vector_codes.with_label_error(coded)
    return [(r["id"], r["code"], r["error"], r["label_error"], vector_codes.books_digest(books)) for r in out.collect()]


def test_against_brute_force(spark, same, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK", 640)  # blocks of ten vectors
    rng = random.Random(5)
    vector = lambda s=1.0: [float(np.float32(rng.gauss(0, s))) for _ in range(64)]
    rows = [(i, vector(), rng.choice([0, 1, None])) for i in range(200)]
    rows += [(300 + i, rows[0][1], 1) for i in range(30)] + [rows[1], rows[1]]  # equal vectors, repeated rows
    rows += [(400, None, 1), (401, [None] * 64, 1), (402, vector()[:63] + [float("nan")], 0), (403, vector()[:63] + [float("-inf")], None)]
    rows += [(-7, [0.0] * 64, 3), (500, [1e6] * 64, 4), (501, [-1e6] * 64, 4)]
    same(codes(table(spark, rows)), brute.codes(rows))


def test_few_and_wide(spark, same):
    few = [(i, [i / 7.0] * 32, 1) for i in range(5)]
    same(codes(table(spark, few)), brute.codes(few))
    big = [(i, [(-1.0) ** i * 1e9 * (1 + i / 64)] * 16, i % 2) for i in range(90)]  # squares beyond 64 bits
    got = {r[0]: r for r in codes(table(spark, big))}
    for r in brute.codes([(i, [float(np.float32(x)) for x in v], y) for i, v, y in big]):
        assert got[r[0]][1] == r[1] and got[r[0]][2] == min(r[2], vector_codes.MOST) and got[r[0]][4] == r[4]


def test_other_widths_stay(spark):
    rows = [(2, [1.0] * 32, 1), (1, [], None), (3, [1.0] * 31, 1), (4, [2.0] * 64, None), (5, [1e30] * 32, 1), (None, [4.0] * 32, 1)]
    got = {r[0]: r[1:4] for r in codes(table(spark, rows))}
    assert set(got) == {1, 2, 3, 4, 5, None}
    assert all(got[i][:2] == (None, None) for i in (1, 3, 4, 5)) and got[2][1] == 0 and got[None][1] == 0
    assert got[1][2] is None and got[5][2] == 0


def test_no_rows(spark):
    assert codes(table(spark, [(1, [1.0] * 16, 1)]).limit(0)) == []
    assert codes(table(spark, [(1, None, 1)])) == []


def test_oracle(spark, data, same):
    duckdb = pytest.importorskip("duckdb")
    folder = os.path.join(os.path.dirname(data), "sf0.01")
    db = duckdb.connect()
    db.execute(f"create view embeddings as from '{folder}/embeddings.parquet'")
    got = vector_codes.op12_vector_codes(spark, folder)
    same(got.collect(), db.sql(vector_codes.ORACLE).select(", ".join(got.columns)).fetchall())
