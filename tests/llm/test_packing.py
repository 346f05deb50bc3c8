import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))


ODD = [
    "It's THE end.Don't you'll; 12,5 (a.b) [x].) <|endoftext|> x<|startoftext|>y <|STARTOFTEXT|> tab\tnew\nline\x0bvt\x0c\r wide \u0085 é É. a̸, !̸ K.K",
    "", " \n\t ", None, "a" * 3000, "Ça.ÇA ÉCOLE. école \U0001f600\U0001f600 . , ;", "İi Σς ΟΔΟΣ. ΟΔΟΣ",
]


def test_tokens_are_those_of_whole_texts(tokenizer):
    tokens = packing.ChunkTokenizer(public_tokenizers.path(packing.TOKENIZER))
    for texts in (ODD, [t for t in ODD if "<|" not in (t or "")]):
        ids, edge = tokens(pa.array(texts, pa.string()))
        for i, text in enumerate(texts):
            assert ids[edge[i] : edge[i + 1]].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def placed(lengths, capacity, **kw):
    n = Counter(lengths)
    plan = packing.best_plan(n, capacity, **kw)
    length = np.repeat(np.array(list(n), np.int64), list(n.values()))
    rank = np.concatenate([np.arange(c) for c in n.values()]) if n else np.zeros(0, np.int64)
    return length, *plan.place(length, rank), plan


@pytest.mark.parametrize("seed", range(12))
def test_plans_hold(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 64, 100, 1000])
    lengths = [min(capacity, max(1, rng.choice([rng.randrange(1, capacity + 1), int(rng.expovariate(5 / capacity)), capacity // 3, capacity]))) for _ in range(rng.choice([0, 1, 5, 300, 3000]))]
    length, sequence, offset, plan = placed(lengths, capacity, groups=rng.choice([2, 8, 32]))
    end = defaultdict(int)
    for s, o, n in sorted(zip(sequence.tolist(), offset.tolist(), length.tolist(), strict=True)):
        assert o == end[s]
        end[s] = o + n
    assert all(e <= capacity for e in end.values()) and len(end) == plan.sequences
    assert len(end) <= brute.best_fit(lengths, capacity) * (1.06 if len(lengths) > 100 else 1.4) + 1


def test_tight_on_documents(spark, data):
    lengths = [r["length"] for r in packing.tokenised(spark.read.parquet(f"{data}/documents.parquet")).select("length").collect()]
    _, sequence, _, _ = placed(lengths, packing.CAPACITY)
    assert len(set(sequence.tolist())) <= brute.best_fit(lengths, packing.CAPACITY) + 1


def test_pack(spark, docs, pairs, tokenizer):
    capacity = 256
    rows = packing.pack(docs, capacity=capacity).collect()
    want = Counter()
    for i, text in pairs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[(i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part))] += 1
    assert Counter((r["id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in rows) == want
    end = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == end[r["sequence_id"]]
        end[r["sequence_id"]] += r["length"]
    assert max(end.values()) <= capacity and len(end) <= 1.03 * brute.best_fit([r["length"] for r in rows], capacity) + 1
    whole = packing.sequences(packing.pack(docs, capacity=capacity)).collect()
    assert sorted(len(r["ids"]) for r in whole) == sorted(end.values()) and all(r["starts"][0] == 0 for r in whole)


def test_hot_length_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", 7)  # so that one length has many buckets
    same = spark.createDataFrame([(i % 50, "one and the same text") for i in range(300)] + [(None, None)] * 40, "doc_id long, text string")
    rows = packing.pack(same, capacity=16).collect()
    assert len(rows) == 340 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 340
    assert len({r["sequence_id"] for r in rows}) == brute.best_fit([r["length"] for r in rows], 16)
    assert packing.pack(same.limit(0)).collect() == []
