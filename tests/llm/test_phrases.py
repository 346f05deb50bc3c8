import os
import random
from collections import Counter

import brute
import numpy as np
import pytest

from llm import collocations
from llm.textkernel import U

SCHEMA = "doc_id long, text string, lang string, phrase string, f int, size int, k int, n int, score int, part int, `rank` int"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    word = lambda: rng.choice(["ab", "AB", "c", "Straße", "nœud", "x1", "the", "of", "q"])
    gap = lambda: rng.choice([" "] * 12 + ["  ", "\t", ", ", ". ", "\n", "!"])
    out = [("".join(word() + gap() for _ in range(rng.randrange(0, 120))), rng.choice(["en", "de", None, "und", ""])) for _ in range(150)]
    out += [("new york city hall", "en")] * 40 + [("a third of all rows", "xx")] * 90 + [("go go go go go go " * 30, "en")]
    out += [(None, "en"), ("", None), (" .,;", "en"), ("x" * 100_000 + " y " + "z, " * 40, "en"), (None, None)]
    return out


def table(spark, texts):
    return spark.createDataFrame([(i, t, g, "p", *range(7)) for i, (t, g) in enumerate(texts)], SCHEMA).repartition(4)


def rows(df):
    return df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()


def test_against_brute_force(spark, texts, same):
    want = brute.phrases([(g, t) for t, g in texts])
    same(rows(collocations.collocations(table(spark, texts))), want)
    assert len(want) > 50


def test_top(spark, texts, same):
    same(rows(collocations.collocations(table(spark, texts), top=3)), brute.phrases([(g, t) for t, g in texts], top=3))


def test_many_partitions_and_flushes(spark, texts, same, monkeypatch):
    for name, value in (("FLUSH", 500), ("COUNTERS", 16)):
        monkeypatch.setattr(collocations, name, value)
    f = Counter()
    for t, g in texts:
        for piece in brute.re.split(r"[.,;:!?\x0A-\x0D]", brute.lower(t)):
            w = brute.re.findall(r"[^\x20\x09]+", piece)
            f.update(("und" if g is None else g, k, " ".join(w[i : i + k])) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    got = collocations.frequent(table(spark, texts), counters=512).where("size > 0").collect()
    same(got, [(*k, n) for k, n in f.items() if n >= 30])


def test_summaries_lose_less_than_the_threshold():
    rng = np.random.default_rng(3)
    for least in (3, 10):
        blocks = [_counts(rng) for _ in range(40)]
        total = Counter()
        for keys, counts in blocks:
            total.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
        summary = collocations.Summary(sum(total.values()), least)
        for keys, counts in blocks:
            summary.add(keys, counts)
            summary.merge()
        assert summary.lost < least and len(summary.keys) <= summary.capacity
        assert {k for k, n in total.items() if n >= least} <= set(summary.survivors().tolist())


def _counts(rng):
    keys, counts = np.unique(rng.zipf(1.3, 400) % 5000, return_counts=True)
    return keys.astype(U), counts


def test_packing_of_keys():
    for a in ([], [0], [5], [3, 4, 2**40, 2**64 - 1], list(range(1000))):
        a = np.array(a, U)
        assert (collocations.open_sorted(collocations.pack_sorted(a)) == a).all()


def test_scores(spark):
    for a, both in ((30, 61), (10**13, 3 * 10**13 + 1), (4 * 10**15, 9 * 10**15 - 1), (1, 2)):
        got = spark.sql(f"select {a}L as a, {both}L as b").select(collocations.cut_score(*map(collocations.F.col, "ab"))).first()[0]
        assert got == 2000000 * a // both


def test_no_rows(spark, texts):
    assert rows(collocations.collocations(table(spark, texts).limit(0))) == []
    assert rows(collocations.collocations(table(spark, [(None, None), ("a few words", "en")]))) == []


def test_oracle(spark, data, same):
    duckdb = pytest.importorskip("duckdb")
    folder = os.path.join(os.path.dirname(data), "sf0.01")
    db = duckdb.connect()
    db.execute(f"create view documents as from '{folder}/documents.parquet'")
    got = collocations.op13_collocations(spark, folder)
    same(got.collect(), db.sql(collocations.ORACLE).select(", ".join(got.columns)).fetchall())
