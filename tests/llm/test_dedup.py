"""Repeated passages, near copies and benchmark windows against brute force."""

import brute
import pytest
from pyspark.sql import functions as F

from llm import decontam, jaccard_join, repeats, shared, substring_dedup, suffix_dedup


def sha(c):
    return F.sha2(F.encode(c, "utf-8"), 256)


@pytest.mark.parametrize("start", [9, 18, 35])
def test_word_windows(docs, pairs, same, start):
    out = substring_dedup.substring_dedup(docs, start=start)
    same(out.select("id", "n_words", "n_removed", sha("kept")).collect(), brute.repeated_words(pairs))


def test_word_spans_cover_what_is_removed(docs):
    out = substring_dedup.substring_dedup(docs).select("n_removed", F.aggregate("spans", F.lit(0), lambda a, s: a + s["end"] - s["start"]).alias("n"))
    assert out.where("n <> n_removed").isEmpty()


def test_byte_strings(docs, pairs, same):
    out = suffix_dedup.suffix_dedup(docs)
    same(out.select("id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect(), brute.repeated_bytes(pairs))


def test_planted_passages_of_over_50_words(spark, same):
    """The contract's 400 bytes decide, not the words: shorter passages stay, longer ones go whole, texts without one are left alone."""
    rows, planted = [], {}
    for size in (371, 399, 400, 401, 650):
        p = f"{size}p" + " ".join(f"{size}k{k:02d}" for k in range(200))[: size - 4]
        assert len(p) == size and len(p.split()) > 50
        for k in range(2):
            planted[len(rows)] = size
            rows.append((len(rows), " ".join(f"d{len(rows)}w{i}" for i in range(60)) + f" {k}{p}{k} " + " ".join(f"e{len(rows)}w{i}" for i in range(60))))
    rows += [(len(rows) + k, " ".join(f"c{k}w{i}" for i in range(150))) for k in range(10)]
    out = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).cache()
    same(out.select("id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect(), brute.repeated_bytes(rows))
    assert {r["id"]: r["n_removed"] for r in out.collect()} == {i: n if (n := planted.get(i, 0)) >= 400 else 0 for i, _ in rows}


def test_long_texts_in_pieces(spark, same, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    rows = [(1, "".join(chr(97 + (i * i) % 23) + chr(97 + i % 19) for i in range(4000))), (2, "x" * 3000), (3, "".join(chr(97 + (i * i) % 23) + chr(97 + i % 19) for i in range(700, 1500)))]
    out = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    same(out.select("id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect(), brute.repeated_bytes(rows))


def test_tasks_that_flush_often(docs, pairs, same, monkeypatch):
    monkeypatch.setattr(repeats, "FLUSH", 50)
    out = substring_dedup.substring_dedup(docs)
    same(out.select("id", "n_words", "n_removed", sha("kept")).collect(), brute.repeated_words(pairs))


@pytest.mark.parametrize(("rounds", "tile"), [(2, 256), (1, 3)])
def test_jaccard_groups(docs, pairs, same, monkeypatch, rounds, tile):
    monkeypatch.setattr(jaccard_join, "ROUNDS", rounds)
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    out = jaccard_join.jaccard_groups(docs).select("id", "n_shingles", "component_id")
    want = [(i, n, c if n else i) for i, n, c in brute.jaccard(pairs)]
    same(out.collect(), want)


def overlaps(sizes, percent=80):
    """(n, m, shared) of all pairs of set sizes that link."""
    return [(n, m, o) for n in sizes for m in range(n, n * 100 // percent + 1) for o in range(1, n + 1) if 100 * o >= percent * (n + m - o)]


@pytest.mark.parametrize("percent", [50, 70, 80, 90])
def test_bound_of_shingles_found_nowhere(percent):
    for n, m, o in overlaps(range(1, 121), percent):
        for x, y in ((n, m), (m, n)):
            missed = max(x - o, jaccard_join.sample(x, percent) + y - o - jaccard_join.sample(y, percent))
            assert missed <= jaccard_join.alone(x, percent)


def test_small_sets_of_all_sizes_and_overlaps(spark):
    rows = []
    for n, m, o in overlaps(range(1, 31)):
        for turn in range(4):
            w = [f"w{len(rows)}x{k}" for k in range(n + m - o + 4)]  # no other pair has these words
            rows += [(len(rows), " ".join(w[: n + 4])), (len(rows) + 1, " ".join(w[n - o :]))]
    out = jaccard_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    lost = out.where("n_shingles > 0 and component_id <> id - id % 2").count()
    assert (out.count(), lost) == (len(rows), 0)


def test_benchmark_windows(spark, docs, pairs, same, monkeypatch):
    text = {i: t for i, t in pairs if t}
    items = [(1, text[105]), (2, "one two"), (3, None), (4, "?!"), (5, text[105]), (6, text[405][3000:3600]), (70, text[405][3100:3300]), (8, "ha ha ha")]
    monkeypatch.setattr(decontam, "SLICE_WORDS", 40)  # several slices, and items cut over them
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontam.decontaminate(docs, bench)
    got = out.select("id", "n_words", "n_hit", F.size("items"), sha(F.array_join(F.array_sort("items"), ",")), F.col("n_hit") > 0).collect()
    same(got, brute.benchmark(pairs, items))


def test_proximity(spark):
    words = [f"w{i}" for i in range(10)]
    near = [*words[:4], "other", *words[5:]]
    docs = spark.createDataFrame([(1, " ".join(near)), (2, " ".join(words)), (3, " ".join(words[:6]))], "doc_id long, text string")
    bench = spark.createDataFrame([("a", " ".join(words))], "item_id string, text string")
    got = {r["id"]: (r["items"], r["near"]) for r in decontam.decontaminate(docs, bench).collect()}
    assert got == {1: ([], ["a"]), 2: (["a"], []), 3: ([], [])}


def test_proximity_of_all_replaced_places(spark, monkeypatch):
    monkeypatch.setattr(decontam, "STARTS", 7)  # starts in several pieces
    items = [("ten", [f"w{i}" for i in range(10)]), ("twelve", [f"v{i}" for i in range(12)]), ("seven", [f"u{i}" for i in range(7)]), ("four", [f"t{i}" for i in range(4)])]
    rows = []
    for _, w in items:
        for i in range(len(w)):
            for j in range(i, len(w)):
                for k in {j, len(w) - 1}:
                    rows.append((len(rows), " ".join(["a", *["other" if p in (i, j, k) else x for p, x in enumerate(w)], "b"])))
    rows += [(len(rows) + k, " ".join(w)) for k, (_, w) in enumerate(items)]

    def found(text):
        d, out = text.split(), set()
        for name, w in items:
            n = min(10, len(w))
            for k in range(len(w) - n + 1):
                kept = [sum(x == y for x, y in zip(w[k : k + n], d[s : s + n], strict=True)) for s in range(len(d) - n + 1)]
                out |= {name for x in kept if x < n and 10 * x >= 8 * n}
        return sorted(out)

    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id string, text string")
    got = {r["id"]: sorted(r["near"]) for r in decontam.decontaminate(docs, bench).collect()}
    want = {i: found(t) for i, t in rows}
    assert {x for v in want.values() for x in v} == {"ten", "twelve", "seven"}
    assert got == want


def test_repeated_items_reach_the_driver_once(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(30))
    bench = spark.createDataFrame([(None, text)] * 50 + [("b", text)], "item_id string, text string")
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    sizes, plan = [], decontam._Plan.__init__
    monkeypatch.setattr(decontam._Plan, "__init__", lambda self, items, *rest: (sizes.append(len(items)), plan(self, items, *rest))[1])
    assert decontam.decontaminate(docs, bench).select("n_hit", F.array_sort("items")).collect() == [(30, ["", "b"])]
    assert sum(sizes) == 2


def test_empty_tables(docs):
    none = docs.where("false")
    assert substring_dedup.substring_dedup(none).count() == 0
    assert suffix_dedup.suffix_dedup(none).count() == 0
    assert jaccard_join.jaccard_groups(none).count() == 0
    bench = docs.select(F.col("doc_id").alias("item_id"), "text").where("false")
    assert decontam.decontaminate(none, bench).count() == 0
    assert decontam.decontaminate(docs, bench).where("n_hit > 0").count() == 0


def test_answer_rows_do_not_follow_the_partitions(spark, data, monkeypatch):
    """Packed answers are as many at 8 and at 128 shuffle partitions."""
    docs = shared.keyed(spark.read.parquet(f"{data}/documents.parquet"), "doc_id", "text")
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 1 << 17)
    made, gathered = [], repeats.gathered

    def counting(answers):
        made.append(answers.count())
        return gathered(answers)

    monkeypatch.setattr(repeats, "gathered", counting)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (8, 32, 128):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            hits = repeats.find_repeats(docs, jaccard_join._emit_sample(5, 80)).agg({"hits": "sum"}).first()[0]
            assert hits > 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert max(made) <= 2 * min(made) and min(made) > 0


def test_all_links_and_their_counts(spark, docs, pairs, same, data):
    for table, rows in ((docs, pairs), _documents(spark, data)):
        links, members = jaccard_join.jaccard_links(table)
        links = shared.cut(links, "links")
        _, want = brute.jaccard_pairs(rows)
        n = [0] * len(rows)
        for i, j in want:
            n[i], n[j] = n[i] + 1, n[j] + 1
        got = jaccard_join.link_counts(links, members)
        same(got.select("id", "n_links").collect(), [(i, k) for (i, _), k in zip(rows, n, strict=True)])
        assert links.where("a >= b").isEmpty() and links.count() == links.distinct().count()


def _documents(spark, data):
    table = spark.read.parquet(f"{data}/documents.parquet")
    return table, [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
