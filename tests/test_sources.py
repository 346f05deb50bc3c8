import json
import random

import pyarrow as pa
import pytest

from riskloom.files import Folder
from riskloom.operators.dedup import first_per_key, last_per_key, unseen
from riskloom.operators.phrases import phrase_matches
from riskloom.session import work_folder
from riskloom.sources.articles import allow_listed, clean_pages, dedup_docs, long_enough, named_texts, read_articles, read_rank, read_seeds, split_rejected, with_source_name
from riskloom.sources.store import CaseStore, stats_by_type
from pyspark.sql import functions as F


def test_article_files(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"text": "正文乙"}, indent=1))
    (tmp_path / "a.json").write_text(json.dumps({"title": "甲", "url": "u", "source_name": "s", "publish_date": "2024-01-01", "text": "正文甲"}))
    (tmp_path / "c.json").write_text(json.dumps({"title": "无正文"}))
    usable, rejected = split_rejected(read_articles(spark, str(tmp_path)))
    rows = usable.orderBy("seq").collect()
    assert [r["url"] for r in rows] == ["u", "local://b.json"]
    assert rows[1]["title"] == "" and rows[1]["source_name"] and rows[1]["publish_date"] is None
    assert [r["title"] for r in rejected.collect()] == ["无正文"]


def test_seeds(spark, tmp_path):
    (tmp_path / "seeds.json").write_text(json.dumps([
        {"url": "https://a.cn/1", "source_name": "甲"}, {"url": "https://b.cn/1"}, {"url": "https://a.cn/1", "source_name": "乙"},
    ]))
    seeds = read_seeds(spark, str(tmp_path / "seeds.json"))
    pages = spark.createDataFrame([("https://a.cn/1",), ("https://b.cn/1",), ("https://a.cn:81/2",)], "url string")
    named = {r["url"]: r["source_name"] for r in with_source_name(pages, seeds).collect()}
    assert named == {"https://a.cn/1": "乙", "https://b.cn/1": "", "https://a.cn:81/2": "a.cn:81"}
    assert allow_listed(pages, seeds).count() == 2
    assert allow_listed(pages.union(spark.createDataFrame([("https://b.cn/9",)], "url string")), seeds, by_host=True).count() == 3


def test_min_length(spark):
    df = spark.createDataFrame([("字" * 79,), ("字" * 80,)], "text string")
    assert long_enough(df).count() == 1


def test_dedup(spark):
    rows = [("h", i, f"t{i}") for i in range(100, 0, -1)] + [("g", 5, "x")]
    df = spark.createDataFrame(rows, "h string, seq int, t string").repartition(6)
    assert sorted(map(tuple, first_per_key(df, F.col("h"), F.col("seq")).collect())) == [("g", 5, "x"), ("h", 1, "t1")]
    assert sorted(map(tuple, last_per_key(df, F.col("h"), F.col("seq")).collect())) == [("g", 5, "x"), ("h", 100, "t100")]


def test_unseen_keeps_empty_hashes(spark):
    df = spark.createDataFrame([("a",), ("",), (None,), ("b",)], "raw_text_hash string")
    known = spark.createDataFrame([("a",), ("",), (None,)], "raw_text_hash string")
    assert sorted(str(r[0]) for r in unseen(df, known).collect()) == ["", "None", "b"]


def test_phrase_join_equals_contains(spark):
    texts = [(1, "稳赚通道稳赚"), (2, "无"), (3, ""), (4, "快递员送包裹，快递丢失"), (5, "赚")]
    words = [("稳赚",), ("稳赚通道",), ("快递",), ("赚",), ("包裹，快递丢失",)]
    df = spark.createDataFrame(texts, "id int, text string")
    got = phrase_matches(df, spark.createDataFrame(words, "kw string"), ["id"]).collect()
    want = {(i, w) for i, t in texts for (w,) in words if w in t}
    assert {(r["id"], r["kw"]) for r in got} == want and len(got) == len(want)


def test_first_copy_is_the_same_for_any_partitioning(spark):
    path = work_folder(spark, "copies")
    rows = [(f"u{i}", "t", "same text") for i in range(100)]
    spark.createDataFrame(rows, "url string, title string, text string").coalesce(1).write.json(path)
    kept = set()
    for n in (1, 3, 7, 13):
        usable, _ = split_rejected(read_articles(spark, path, one_per_file=False))
        docs = usable.repartition(n).withColumn("text_hash", F.sha2("text", 256))
        kept |= {r["url"] for r in dedup_docs(docs).collect()}
        assert usable.select("seq").distinct().count() == 100
    assert kept == {"u0"}


def test_preferred_extractor(spark):
    page = '<html><head><meta content="2021-03-04"><title>own</title></head><body><p>' + "word " * 40 + "</p></body></html>"
    rows = [(1, page, "their text", "theirs", "2020-01-01"), (2, page, "their text", None, ""), (3, page, " ", "theirs", "2020-01-01")]
    out = clean_pages(spark.createDataFrame(rows, "id int, html string, t string, h string, d string"), "html", "t", "h", "d")
    got = {r["id"]: (r["title"], r["publish_date"], r["text"][:10]) for r in out.collect()}
    assert got == {1: ("theirs", "2020-01-01", "their text"), 2: ("", "2021-03-04", "their text"), 3: ("own", None, "word word ")}


@pytest.fixture
def store(spark):
    """(store, a function that makes cases of (id, type, summary))."""
    store = CaseStore(spark, work_folder(spark, "replace"))
    shape = store.read().drop("vec", "norm2", "space", "batch_id", "created_at").schema
    empty = {f.name: None for f in shape} | {"scenario": "", "fraud_script": [], "key_risk_signals": []}

    def make(*rows):
        full = [{**empty, "case_id": i, "raw_text_hash": f"h{i}", "fraud_type": t, "summary": s} for i, t, s in rows]
        return spark.createDataFrame([tuple(r[n] for n in shape.names) for r in full], shape)

    store.append(make(("a", "其他", "old"), ("b", "其他", "old"), ("c", "杀猪盘", "old")), F.col("case_id"))
    return store, make


def state(store):
    return {r["case_id"]: (r["fraud_type"], r["summary"]) for r in store.read().collect()}


def same_totals(store):
    got = {r["fraud_type"]: (r["n"], r["total"]) for r in store.stats().collect()}
    assert got == {r["fraud_type"]: (r["n"], r["total"]) for r in stats_by_type(store.read()).collect()}
    assert store.count() == store.read().count()


def test_store_replaces_by_id(spark, store):
    store, make = store
    store.replace(make(("a", "杀猪盘", "new"), ("d", "其他", "new")))
    assert state(store) == {"a": ("杀猪盘", "new"), "b": ("其他", "old"), "c": ("杀猪盘", "old"), "d": ("其他", "new")}
    same_totals(store)
    store.replace(make(("a", "中奖诈骗", "newer"), ("c", "其他", "newer")))
    store.append(make(("a", "其他", "known hash"), ("e", "其他", "added")), F.col("case_id"))
    assert state(store) == {"a": ("中奖诈骗", "newer"), "b": ("其他", "old"), "c": ("其他", "newer"), "d": ("其他", "new"), "e": ("其他", "added")}
    same_totals(store)
    assert store.get("a").first()["summary"] == "newer" and store.get("zz").count() == 0
    assert [r["found"] for r in store.lookup(spark.createDataFrame([("c",), ("x",)], "case_id string")).orderBy("case_id").collect()] == [True, False]


def test_a_lookup_after_a_replace_scans_no_whole_table(store):
    store, make = store
    store.replace(make(("a", "杀猪盘", "new")))
    plan = store.get("a")._jdf.queryExecution().simpleString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert len(scans) >= 3 and all("EqualTo(case_id,a)" in line for line in scans)
    assert all("/totals/" in name for name in store.stats().inputFiles())


def test_compaction(store):
    store, make = store
    store.replace(make(("a", "杀猪盘", "new")))
    before, old = state(store), store.read()
    store.compact()
    assert state(store) == before == {r["case_id"]: (r["fraud_type"], r["summary"]) for r in old.collect()}
    assert all("/cases/gen=1/" in name for name in store.read().inputFiles())
    store.vacuum()
    store.replace(make(("b", "杀猪盘", "newer")))
    store.append(make(("f", "其他", "added")), F.col("case_id"))
    assert state(store) == {**before, "b": ("杀猪盘", "newer"), "f": ("其他", "added")}
    same_totals(store)


def test_a_compaction_that_was_cut_short(store, monkeypatch):
    store, make = store
    store.replace(make(("a", "杀猪盘", "new")))
    before, make_folder = state(store), Folder.make

    def lost(self, name=""):
        if name.startswith("done/"):
            raise RuntimeError("lost")
        make_folder(self, name)

    monkeypatch.setattr(Folder, "make", lost)
    with pytest.raises(RuntimeError):
        store.compact()
    monkeypatch.undo()
    assert state(store) == before  # the unmarked generation is not read
    store.append(make(("g", "其他", "added")), F.col("case_id"))
    store.compact()
    assert state(store) == {**before, "g": ("其他", "added")}
    same_totals(store)


def test_totals_of_a_batch_that_was_cut_short(store, monkeypatch):
    store, make = store

    def lost(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(CaseStore, "_write_totals", lost)
    with pytest.raises(RuntimeError):
        store.append(make(("h", "中奖诈骗", "stored, not counted")), F.col("case_id"))
    monkeypatch.undo()
    same_totals(store)
    assert store.count() == 4


def test_no_local_folder_on_a_cluster(monkeypatch):
    class Nothing:
        def isDefined(self):
            return False

    class Session:
        class conf:
            get = staticmethod(lambda *_: "")

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                sc = staticmethod(lambda: type("C", (), {"getCheckpointDir": staticmethod(Nothing)}))

    with pytest.raises(ValueError):
        work_folder(Session, "x")


def test_many_rows_of_one_keyword_stay_in_the_lexicon(spark, monkeypatch):
    from riskloom.operators import phrases

    sizes, one_pass = [], phrases._one_pass
    monkeypatch.setattr(phrases, "_one_pass", lambda texts, rows, *rest: (sizes.append(len(rows)), one_pass(texts, rows, *rest))[1])
    texts = spark.createDataFrame([(1, "red car"), (2, "car"), (3, None)], "id long, text string")
    lexicon = spark.createDataFrame([("car", i) for i in range(40)] + [("red", 99), ("", 7), (None, 8)], "kw string, weight int")
    got = phrase_matches(texts, lexicon, ["id"])
    assert got.columns == ["id", "kw", "weight"]
    assert sorted(map(tuple, got.collect())) == sorted([(i, "car", w) for i in (1, 2) for w in range(40)] + [(1, "red", 99)])
    assert sum(sizes) == 2


@pytest.mark.parametrize("few", [0, 200_000])
def test_known_hashes_by_either_route(spark, few):
    stored = [(f"h{i % 40}",) for i in range(500)] + [("",), (None,)]
    new = [(i, f"h{i}") for i in range(60)] + [(100, ""), (101, None), (102, "h3"), (103, "h50")]
    path = work_folder(spark, "known")
    spark.createDataFrame(stored, "raw_text_hash string").repartition(4).write.parquet(path)
    known = spark.read.parquet(path)
    out = unseen(spark.createDataFrame(new, "id int, raw_text_hash string"), known, few=few)
    assert sorted(r["id"] for r in out.collect()) == [*range(40, 60), 100, 101, 103]
    if few:  # above the scan of the stored side, the semi join comes before any exchange
        lines = out._jdf.queryExecution().simpleString().splitlines()
        scan = next(i for i, line in enumerate(lines) if "FileScan" in line)
        depth = lambda i: len(lines[i]) - len(lines[i].lstrip(" :+-"))
        above, at = [], scan
        for i in range(scan - 1, -1, -1):
            if depth(i) < depth(at):
                above.append(lines[i])
                at = i
        names = [next(n for n in ("Exchange", "LeftSemi", "other") if n in line or n == "other") for line in above]
        assert "LeftSemi" in names and "Exchange" not in names[: names.index("LeftSemi")]


def test_matcher_against_brute_force(monkeypatch):
    from riskloom.operators import phrases

    monkeypatch.setattr(phrases, "SLICE", 300)
    rng = random.Random(1)
    letters = "abc安全账户éß\U0001f600"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    words = list({word(rng.randrange(1, 9)) for _ in range(300)} | {"https://www.example.org/" + word(5) for _ in range(50)} | {"x" * 700})
    texts = [word(rng.randrange(0, 120)) for _ in range(80)] + ["", None, "x" * 2000, "https://www.example.org/" * 9 + words[-1], "安", "".join(words)]
    column = pa.array(["not looked at", *texts], pa.string()).slice(1)
    got = phrases.Matcher(words)(column).to_pylist()
    assert got == [[i for i, w in enumerate(words) if w in (t or "")] for t in texts]
    assert phrases.Matcher([])(pa.array(["a", None])).to_pylist() == [[], []] and phrases.Matcher(["a"])(pa.array([], pa.string())).to_pylist() == []


def test_named_texts_by_either_route(spark):
    """Few seeds go to the pages, many meet the texts; both give what two joins on raw pages give, and move no html."""
    body = lambda i: f"<html><title>t{i}</title><body><article>{'<p>' + f'text {i} ' * 20 + '</p>'}</article></body></html>"
    pages = spark.createDataFrame(
        [(i, f"https://h{i % 3}.cn/{i % 20}", body(i)) for i in range(60)] + [(90, None, body(90)), (91, "https://h0.cn/0", None), (92, "https://h0.cn/0", "<p>short</p>")],
        "page_id long, url string, html string",
    ).repartition(4)
    seeds = spark.createDataFrame(
        [(i, f"https://h{i % 3}.cn/{i % 20}", name) for i in range(30) for name in ([f"n{i}"] if i % 4 else [""])] + [(99, "https://h1.cn/1", "last"), (100, "https://other.cn", "x")],
        "pos long, url string, source_name string",
    )
    want = sorted(map(str, long_enough(clean_pages(with_source_name(allow_listed(pages, seeds), seeds))).select("page_id", "url", "source_name", "title", "text").collect()))
    assert 10 < len(want) < 60
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for few in (1000, 5):
            got = named_texts(pages, seeds, few=few)
            assert sorted(map(str, got.select("page_id", "url", "source_name", "title", "text").collect())) == want
            plan = named_texts(pages.repartition(4), seeds, few=few)._jdf.queryExecution().executedPlan().toString()
            assert ("BroadcastHashJoin" in plan) == (few == 1000) and ("SortMergeJoin" in plan) == (few == 5)
        every = named_texts(pages, seeds, only_listed=False)
        plain = long_enough(clean_pages(with_source_name(pages, seeds)))
        assert sorted(map(str, every.select("page_id", "source_name", "text").collect())) == sorted(map(str, plain.select("page_id", "source_name", "text").collect()))
        assert "html" not in every.columns and named_texts(pages, seeds.where("false")).isEmpty()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_read_rank(spark):
    """Ranks over many ranges and files; nulls first, equal rows beside each other, clashing names, an empty table."""
    keys = [None if i % 50 == 0 else (i * 7919) % 400 for i in range(1000)]
    df = spark.createDataFrame([(k, i, "x") for i, k in enumerate(keys)], "seq long, slot long, row string").repartition(6)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "40")
    try:
        got = read_rank(df).orderBy("rank").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert [r["rank"] for r in got] == list(range(1, 1001))
    assert [r["seq"] for r in got] == sorted(keys, key=lambda k: (k is not None, k or 0))
    assert sorted(r["slot"] for r in got) == list(range(1000)) and got[0].__fields__ == ["seq", "slot", "row", "rank"]
    assert read_rank(df.where("false")).count() == 0
