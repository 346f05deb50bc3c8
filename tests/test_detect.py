import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from riskloom.operators.cases import redact_docs
from riskloom.operators.similar import TopKOptions
from riskloom.plans.detect import REQUEST_INFO, as_json, detect, judge_requests, valid_transcripts, with_similar
from riskloom.plans.ingest import ingest, ingest_summary, new_case_lines
from riskloom.session import work_folder
from riskloom.sources.store import CaseStore

# Five types, one article each, and calls that use the same words.
ARTICLES = [
    (1, "传真", "律所收到传真：通缉令附案件编号，资金清查表要求核验款进安全账户，“回执盖章后寄回”，金额4万元。"),
    (2, "接龙", "接龙表写明点赞赚钱、连单、佣金三栏，末行“垫付名次表”，金额1.5万元。"),
    (3, "短信", "短信列出自动续费、扣费、取消订单、百万保障四个链接，金额6万元。"),
    (4, "名额帖", "帖子列出虚拟币、USDT、炒股群、充值入金四项，金额20万元。"),
    (5, "来信", "来信第一句“猜猜我是谁”，第二句微信没零钱，第三句急用钱，金额9万元。"),
]
CALLS = [
    (1, "通缉名单含案件编号，资金清查表须保密，汇款到安全账户。"),
    (2, "自动续费扣费提醒：取消订单请点百万保障，客服共享屏幕演示。"),
    (3, "图书馆周六盘点，闭馆一天。"),
    (4, "炒股群名额，虚拟币和USDT都能充值入金。"),
    (5, "  \n　"),
]


@pytest.fixture(scope="module")
def store(spark):
    store = CaseStore(spark, work_folder(spark, "test-cases"))
    docs = docs_of(spark)
    added = ingest(store, docs, date(2025, 6, 30), "id")
    assert ingest_summary(docs, added, store.read()).first().asDict() == {"fetched": 5, "ingested": 5, "total": 5}
    assert new_case_lines(added).count() == 5
    return store


def docs_of(spark, rows=ARTICLES):
    df = spark.createDataFrame([(i, f"local://{i}", t, x, "2025-01-02") for i, t, x in rows],
                               "id int, url string, title string, text string, publish_date string")
    return redact_docs(df).withColumn("source_name", F.lit("某站"))


@pytest.fixture(scope="module")
def calls(spark):
    return spark.createDataFrame(CALLS, "id bigint, text string")


def test_ingest_again_adds_nothing(spark, store):
    added = ingest(store, docs_of(spark), date(2025, 6, 30), "id")
    assert added.count() == 0 and store.count() == 5


def test_hot_copies_and_personal_data_collapse(spark):
    store = CaseStore(spark, work_folder(spark, "test-cases"))
    text = "工单{}：自动续费、扣费与退款三项合并处理。"
    rows = [(i, f"标题{i}", text.format(13800000000 + i)) for i in range(300)]
    added = ingest(store, docs_of(spark, rows).repartition(7), date(2025, 6, 30), "id").collect()
    assert [r["title"] for r in added] == ["标题0"]


def test_lookup_and_stats(spark, store):
    stats = {r["fraud_type"]: (r["n"], r["total"]) for r in store.stats().collect()}
    assert stats == {t: (1, 5) for t in ["冒充公检法", "刷单返利", "冒充客服", "投资理财", "冒充熟人"]}
    some = store.read().first()["case_id"]
    assert store.get(some).count() == 1 and store.get("none").count() == 0
    ids = spark.createDataFrame([(some,), ("none",)], "case_id string")
    assert {r["case_id"]: r["found"] for r in store.lookup(ids).collect()} == {some: True, "none": False}


def test_partition_pruning(store):
    plan = store.read().filter("fraud_type = '冒充客服'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(fraud_type" in plan


@pytest.fixture(scope="module")
def results(calls, store):
    return {r["id"]: r for r in detect(calls, store.read(), "id").collect()}


def test_levels(results):
    assert set(results) == {1, 2, 3, 4}
    assert results[1]["risk_level"] == "high" and results[1]["fraud_type"] == "冒充公检法"
    assert "安全账户" in results[1]["matched_signals"] and "96110" in results[1]["suggested_action"]
    assert results[1]["similar_cases"][0]["fraud_type"] == "冒充公检法"
    assert results[2]["risk_level"] in ("medium", "high") and results[2]["fraud_type"] == "冒充客服"
    assert results[3]["risk_level"] == "low" and results[3]["risk_score"] < 0.4
    assert results[4]["fraud_type"] == "投资理财" and results[4]["similar_cases"][0]["fraud_type"] == "投资理财"


def test_routes_agree(calls, store, results):
    other = detect(calls, store.read(), "id", topk=TopKOptions(resident_bytes=0, block_rows=2))
    assert {r["id"]: r for r in other.collect()} == results


def test_no_shuffle_without_judge(calls, store):
    plan = detect(calls, store.read(), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_judge_changes_score_type_and_reason(spark, calls, store):
    judged = spark.createDataFrame(
        [(1, '{"score": 0, "fraud_type": "新骗局", "reason": "理由"}'), (3, "坏"), (4, '{"score": 1, "fraud_type": ""}')], "id bigint, answer string"
    )
    rows = {r["id"]: r for r in detect(calls, store.read(), "id", judged).collect()}
    assert rows[1]["fraud_type"] == "新骗局" and rows[1]["reason"] == "理由"
    assert rows[3]["risk_level"] == "low" and rows[4]["fraud_type"] == "投资理财"


def test_requests_and_json(spark, calls, store):
    request = judge_requests(with_similar(calls.filter("id = 1"), store.read(), "id", info=REQUEST_INFO)).first()["request"]
    assert CALLS[0][1] in request and request.count("- [") == 3
    empty = spark.createDataFrame([], store.read().schema)
    assert "（无）" in judge_requests(with_similar(calls.filter("id = 1"), empty, "id", info=REQUEST_INFO)).first()["request"]
    doc = json.loads(as_json(detect(calls.filter("id = 1"), store.read(), "id")).first()["json"])
    assert doc["risk_level"] == "high" and doc["fraud_type"] == "冒充公检法"


def test_blank(calls):
    valid, blank = valid_transcripts(calls)
    assert valid.count() == 4 and [r["id"] for r in blank.collect()] == [5]


def test_answers_are_parsed_once(spark):
    """However many fields are taken of an answer, its text is parsed once; odd answers read as they did."""
    from riskloom.functions import answers

    odd = [
        ('{"score": 0.9, "fraud_type": 5, "reason": null}', (0.9, "5", "")), ("{}", None), ("[{}]", None), (None, None), ('{"score": []}', None),
        ('{"score": " 0.5 "}', (0.5, None, "")), ('{"score": "12d"}', None), ('{"score": false, "reason": "x"}', (0.0, None, "x")), ('{"a": 1}', (0.0, None, "")),
        ('{"score": -3}', (0.0, None, "")), ('{"score": 1', None), ('{"score": ""}', None), ('{"score": null}', None),
    ]
    given = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(odd)], "i int, answer string")
    read = given.select("i", answers.judge_fields(F.col("answer")).alias("j"))
    got = {r["i"]: r["j"] and tuple(r["j"]) for r in read.collect()}
    assert got == {i: expected for i, (_, expected) in enumerate(odd)}
    for column in (answers.judge_fields(F.col("answer")), answers.parse_object(F.col("answer"))):
        plan = given.select(F.struct(column.alias("c")).alias("s"))._jdf.queryExecution().optimizedPlan().toString().lower()
        assert plan.count("parse") == 1, plan
