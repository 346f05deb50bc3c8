import json
from datetime import date

import pytest

from riskloom.functions import answers
from riskloom.operators.cases import accepted_cases, answer_cases, chosen_cases, redact_docs, rule_cases, validate_cases

AS_OF = date(2025, 6, 30)
DOCS = [
    # own sentences: one per kind of article, one that is no fraud
    (1, "local://1", "记事本", "年轻书店店主周某的记事本写着13800001234、通缉、案件编号、“转入安全账户”，另记银行转账3.2万元。", "2025-03-01"),
    (2, "local://2", "", "兼职刷单要先垫付，佣金返利，已付800元。", "2031-01-01"),
    (3, "local://3", "天气", "今天晴，市里办了长跑比赛。", None),
    (4, "local://4", "单词", "客服来电。", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(DOCS, "id int, url string, title string, text string, publish_date string")
    from pyspark.sql import functions as F

    return redact_docs(df).withColumn("source_name", F.lit("某站"))


def test_rule_cases(docs):
    rows = {r["id"]: r for r in rule_cases(docs).collect()}
    assert set(rows) == {1, 2}
    first = rows[1]
    assert first["fraud_type"] == "冒充公检法" and first["loss_amount"] == 32000.0 and first["confidence"] == 0.6  # three hits
    assert first["victim_profile"]["age_group"] == "青年" and first["money_flow"]["payment_method"] == "银行转账"
    assert first["fraud_script"] == ["转入安全账户"] and first["recommended_warning"]
    assert "13800001234" not in json.dumps(first.asDict(True), ensure_ascii=False)
    assert rows[2]["title"] == "刷单返利案例"


def test_validation(docs):
    rows = {r["id"]: r for r in validate_cases(rule_cases(docs), AS_OF).collect()}
    assert rows[1]["publish_date"] == date(2025, 3, 1) and rows[1]["problems"] == []
    assert rows[2]["publish_date"] is None and rows[2]["problems"] == ["date_unusable"]


ANSWERS = {
    1: '{"is_fraud_case": true, "fraud_type": "火星骗局", "summary": "回拨13800001234", "fraud_script": ["无中生有的一句话", 7], "loss_amount": "1e10", "confidence": "x"}',
    2: '{"is_fraud_case": false}',
    3: '{"is_fraud_case": "yes", "fraud_type": "杀猪盘", "summary": "", "scenario": ""}',
    4: '[{"is_fraud_case": true}]',
}


def test_answers(spark, docs):
    table = spark.createDataFrame(list(ANSWERS.items()), "id int, answer string")
    both = docs.join(table, "id", "left")
    by_model = {r["id"]: r for r in answer_cases(both).collect()}
    assert set(by_model) == {1, 3}
    assert by_model[1]["fraud_type"] == "其他" and by_model[1]["fraud_script"] == ["无中生有的一句话"]
    assert by_model[1]["confidence"] == 0.5 and by_model[1]["title"] == "记事本"
    chosen = validate_cases(chosen_cases(both), AS_OF)
    rows = {r["id"]: r for r in chosen.collect()}
    assert {i: r["extraction_method"] for i, r in rows.items()} == {1: "llm", 2: "rule", 3: "llm"}
    assert rows[1]["summary"] == "回拨[手机号]" and rows[1]["loss_amount"] is None and rows[1]["confidence"] == 0.4
    assert rows[1]["problems"] == ["amount_out_of_range:loss_amount", "pii_left:summary", "script_not_in_text"]
    assert not rows[3]["accepted"] and rows[3]["problems"] == ["summary_missing"]
    assert {r["case_id"] for r in accepted_cases(chosen).collect()} == {rows[1]["case_id"], rows[2]["case_id"]}


@pytest.mark.parametrize(
    "answer,expected",
    [
        ('{"score": 2, "fraud_type": "x", "reason": "r"}', (1.0, "x", "r")),
        ('{"score": "-1"}', (0.0, None, "")),
        ('{"reason": "r"}', (0.0, None, "r")),
        ('{"score": null}', None),
        ('{"score": "many"}', None),
        ('{"score": 0.1', None),
        ("[]", None),
        (None, None),
    ],
)
def test_judge(spark, answer, expected):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(answer,)], "a string").select(answers.judge_fields(F.col("a")).alias("j")).first()["j"]
    assert (tuple(got) if got else None) == expected
