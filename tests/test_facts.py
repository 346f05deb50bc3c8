import pytest
from pyspark.sql import functions as F

from riskloom.functions import checks, facts, scoring, text as tx
from riskloom.functions.facts import classify, type_hits
from riskloom.lexicon import Lexicon


@pytest.mark.parametrize(
    "text,expected",
    [
        ("共1,200,000元", [200000.0]),
        ("先付5.8万元，又付 300 余元，再付2万余元和7万", [58000.0, 300.0, 20000.0, 70000.0]),
        ("约100余万元、3亿", []),
        ("付１２万元", [120000.0]),
    ],
)
def test_amounts(one, text, expected):
    assert one(facts.amounts, text) == expected
    assert one(facts.max_amount, text) == (max(expected) if expected else None)


def test_quotes(one):
    text = '他说“先把钱转过来”，又说“好”，并称"验证码发给我们"。' + "“一二三四”" * 9
    got = one(facts.quotes, text)
    assert got[:2] == ["先把钱转过来", "验证码发给我们"] and len(got) == 8


@pytest.mark.parametrize(
    "text,group", [("一名中老年人", "老年"), ("大学生小李", "青年"), ("学生小李", "青少年"), ("退休工人", "老年"), ("市民", None)]
)
def test_age(one, text, group):
    assert one(facts.age_group, text) == group


def test_payment_takes_list_order(one):
    assert one(facts.payment_method, "先用网银，再银行转账") == "银行转账"
    assert one(facts.payment_method, "面谈") is None


def test_classify_article_and_tie(one):
    got = one(lambda t: classify(type_hits(t)), "通缉令附刑事案件编号与资金清查表")
    assert got["fraud_type"] == "冒充公检法" and got["n"] == 4 and got["score"] == 1.0
    # one hit each: the earlier type wins
    assert one(lambda t: classify(type_hits(t))["fraud_type"], "理赔") == "冒充客服"
    none = one(lambda t: classify(type_hits(t)), "天气晴")
    assert none["fraud_type"] == "其他" and none["hits"] == [] and none["score"] == 0.0


def test_rule_score(one):
    def score(t):
        return scoring.rule_score(type_hits(t), scoring.generic_hits(t))

    got = one(score, "先垫付再转账")
    # one type keyword and two generic phrases; a phrase in both lists counts twice
    assert got["score"] == pytest.approx(0.15 + 2 * 0.25)
    assert got["fraud_type"] == "刷单返利" and got["signals"] == ["垫付", "转账"]
    only_generic = one(score, "请保密")
    assert only_generic["fraud_type"] is None and only_generic["score"] == 0.25
    assert one(score, "usdt")["score"] == 0.0


@pytest.mark.parametrize(
    "snippet,text,expected",
    [
        ("安全可靠", "平台安全可靠", True),
        ("##安全可靠##", "安全可靠的平台", False),
        ("###安全可靠的平台", "号称安全可靠的平台", True),
        ("  ", "任何", False),
        ("短", "长", False),
    ],
)
def test_grounded(one, snippet, text, expected):
    assert one(checks.grounded, snippet, text) is expected


@pytest.mark.parametrize(
    "given,expected",
    [
        ("2025-02-28T10:00", "2025-02-28"), ("2025-02-30", None), ("2025-8-2", None), ("2025", None),
        ("1999-12-31", None), ("2025-07-01", None), ("20250101", None), ("", None),
    ],
)
def test_date(one, given, expected):
    got = one(lambda t: checks.parse_date(t, F.lit("2025-06-30").cast("date")), given)
    assert (str(got) if got else None) == expected


def test_host_and_key(one):
    assert one(tx.url_host, "https://a.example.com:8080/x?y#z") == "a.example.com:8080"
    assert one(tx.strip, "\n　 a b\t ") == "a b"
    assert len(one(lambda t: tx.case_key(tx.content_hash(t), t), "x")) == 32


def test_own_lexicon(one, spark):
    rows = spark.createDataFrame(
        [("甲类", ["暗号"], ["信号"], "当心"), ("乙类", ["口令", "暗号二"], None, None)],
        "fraud_type string, keywords array<string>, risk_signals array<string>, warning string",
    ).collect()
    own = Lexicon.from_rows(rows, ["马上"])
    assert own.labels == ["甲类", "乙类", "其他"] and own.warnings == {"甲类": "当心", "乙类": ""}
    got = one(lambda t: scoring.rule_score(type_hits(t, own), scoring.generic_hits(t, own)), "暗号二，口令，马上")
    assert got["fraud_type"] == "乙类" and got["signals"] == ["暗号", "口令", "暗号二", "马上"]
    assert own.keyword_table(spark).count() == 3


def test_rule_of_a_batch_equals_the_expressions(spark):
    """All phrases found together give what a search for each of them gives, and no search for each is left in the plan."""
    from riskloom.plans.detect import with_rule_score

    words = ["垫付", "转账", "理赔", "客服", "USDT", "usdt", "安全账", "户", "稳赚", "稳赚通道", "请保密", "，", "😀", ""]
    rows = [(i, None if i % 50 == 7 else "".join(words[(i * i + i // 7 * j + 3 * j) % len(words)] for j in range(i % 9))) for i in range(600)]
    calls = spark.createDataFrame(rows, "id int, text string").repartition(3)
    strange = Lexicon(keywords={"a": ["稳赚", "稳赚", ""], "b": ["稳赚通道", "户", "a"], "c": ["户", "理赔"]}, generic=["", "户", "转账"])
    for lexicon in (Lexicon(), strange, Lexicon(generic=[])):
        rule = scoring.rule_score(type_hits(F.col("text"), lexicon), scoring.generic_hits(F.col("text"), lexicon))
        want, got = calls.withColumn("rule", rule), with_rule_score(calls, lexicon)
        assert got.select("rule.*").dtypes == want.select("rule.*").dtypes
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "垫付" not in plan and "稳赚" not in plan
