"""Inputs derived from the supplied tables, which hold no calls or fraud articles.

A view is a table name and one SQL expression per column, plain enough for any SQL
engine to run; it reads the whole table, so it grows with it.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

from ..session import spread

AS_OF = date(2025, 6, 30)

CALLS = ("events", {
    "utt_id": "event_id",
    "call_id": "user_id",
    "ts": "ts",
    "text": """case event_type
  when 'error' then concat('检察院传真：通缉名单含您名下案件编号', cast(event_id % 1000 as string), case when user_id % 2 = 0 then '，回执须保密，核验款汇款至安全账户' else '，周五前书面说明' end)
  when 'purchase' then concat('点赞赚钱第', cast(user_id % 9 as string), '组连单，佣金日结，本单垫付', cast(cast(floor(value) as int) as string), '元')
  when 'signup' then case when user_id % 3 = 0 then '炒股群限时名额，USDT充值入金享高收益' else '快递丢失登记：包裹赔付走运费险' end
  when 'click' then concat('票据请传139', lpad(cast(event_id as string), 8, '0'), '，收件刘某某')
  else '周六图书馆盘点，闭馆一天' end""",
})

ARTICLES = ("customer", {
    "art_id": "c_custkey",
    "url": "concat('local://c/', cast(c_custkey as string))",
    "title": "case c_custkey % 6 when 0 then '连单佣金纠纷' when 1 then '资金清查传真' when 2 then '自动续费短信' when 3 then '虚拟币名额' when 4 then '社区书画展' else '老同学来信' end",
    "text": """concat('大学生沈某的来信存档139', lpad(cast(c_custkey as string), 8, '0'), '，卡号', cast(6200000000000000 + c_custkey % 700 as string), '，',
  case c_custkey % 6 when 0 then '群里介绍点赞赚钱和连单，佣金按日结，写明“垫付越多名次越靠前”，' when 1 then '传真列出案件编号与资金清查表，盖章写着“核验款今日入安全账户”，' when 2 then '短信称自动续费已开，退款须走百万保障页面，' when 3 then '名额帖写着虚拟币与USDT，发帖者承诺高收益，' when 4 then '展厅陈列两百幅作品，评委现场打分，' else '来信开头是“猜猜我是谁”，结尾说微信没零钱，急用钱，' end,
  '账单列有支付宝转账', cast(cast(floor(abs(c_acctbal) / 1000) as int) * 1000 as string), '元，合计', cast(c_custkey % 40 as string), '.5万元。')""",
    "publish_date": "concat('20', lpad(cast(c_custkey % 30 as string), 2, '0'), '-0', cast(c_custkey % 9 + 1 as string), '-15')",
})

LLM_ANSWERS = ("customer", {
    "art_id": "c_custkey",
    "answer": """case c_custkey % 7
 when 0 then concat('{"is_fraud_case": true, "title": "案例', cast(c_custkey as string), '", "fraud_type": "冒充客服", "scenario": "页面提示续费，客户留言13900001111", "victim_profile": {"age_group": "老年", "occupation": null, "gender": "女"}, "fraud_script": ["账单列有支付宝转账", 5, null, "不在原文里的句子"], "key_risk_signals": ["要求付款", "留言13911112222"], "money_flow": {"payment_method": "银行转账", "amount": ', cast(c_custkey * 10 as string), '}, "loss_amount": ', cast(c_custkey as string), '.5, "summary": "退费骗局第', cast(c_custkey % 50 as string), '号", "recommended_warning": "退费不用先付款", "confidence": 0.9}')
 when 1 then '{"is_fraud_case": false, "title": "新闻"}'
 when 2 then concat('{"is_fraud_case": true, "title": "", "fraud_type": "跨境电商骗局", "scenario": "", "fraud_script": [], "summary": "第', cast(c_custkey as string), '起电商骗局，订单号62170038100265', cast(10000 + c_custkey % 90000 as string), '", "confidence": "0.75"}')
 when 3 then '{"is_fraud_case": 1, "fraud_type": "投资理财", "summary": "荐股群骗局", "scenario": "群内荐股", "money_flow": {"payment_method": "网银", "amount": "5f"}, "loss_amount": "12d", "confidence": 0.8}'
 when 4 then concat('{"is_fraud_case": true, "title": "坏', cast(c_custkey as string))
 when 5 then '{"is_fraud_case": true, "fraud_type": "杀猪盘", "summary": "网恋后投资", "scenario": null, "fraud_script": ["亲爱的一起来投资吧", "平台绝对安全可靠"], "key_risk_signals": "不是列表", "loss_amount": 2000000000, "confidence": 0.95}'
 else '{"is_fraud_case": true, "fraud_type": "冒充熟人", "scenario": "", "summary": "", "loss_amount": -5}' end""",
})

JUDGE_ANSWERS = ("events", {
    "utt_id": "event_id",
    "answer": """case event_id % 8
 when 0 then '{"score": 0.9, "fraud_type": "冒充客服", "reason": "话术与退费骗局一致"}'
 when 1 then '{"score": "1.7", "fraud_type": null, "reason": ""}'
 when 2 then '{"fraud_type": "", "reason": "信息不足"}'
 when 3 then '{"score": null, "reason": "无"}'
 when 4 then '{"score": 0.2'
 when 5 then '{}'
 when 6 then '{"score": true, "reason": "真"}'
 else concat('{"score": ', cast(event_id % 100 as string), 'e-2, "fraud_type": "新型骗局"}') end""",
})

# Every kind of personal data, at text borders, next to letters, and in lengths just
# inside and outside each rule.
PERSONAL = ("customer", {
    "id": "c_custkey",
    "text": """concat(
 case c_custkey % 4 when 0 then '' when 1 then '身份证' when 2 then 'ID ' else '号' end,
 lpad(cast(c_custkey as string), 17, '4'), case c_custkey % 3 when 0 then 'X' when 1 then '7' else 'a' end,
 '，旧证', lpad(cast(c_custkey as string), 15, '3'), '。固话0731-', lpad(cast(c_custkey as string), cast(7 + c_custkey % 3 as int), '2'),
 '，卡', lpad(cast(c_custkey as string), cast(12 + c_custkey % 9 as int), '6'), '，邮箱u', cast(c_custkey as string), '.x@mail', cast(c_custkey % 9 as string), '.example.com。电话',
 case c_custkey % 5 when 0 then '+86 139-' when 1 then '86138' when 2 then '+86-137 ' when 3 then '0139' else '199' end, lpad(cast(c_custkey as string), 4, '5'), case c_custkey % 2 when 0 then '-' else '' end, lpad(cast(c_custkey as string), 4, '8'),
 '，联系人', case c_custkey % 4 when 0 then '王某某说' when 1 then '李XX，' when 2 then '张×先生' else '赵某' end)""",
})


def derive(spark: SparkSession, folder: str, view: tuple[str, dict[str, str]]) -> DataFrame:
    table, columns = view
    rows = spark.read.parquet(f"{folder}/{table}.parquet")
    return spread(rows.selectExpr(*[f"{expression} as {name}" for name, expression in columns.items()]), rows)


def calls(spark: SparkSession, folder: str) -> DataFrame:
    return derive(spark, folder, CALLS).selectExpr("utt_id", "call_id", "cast(ts as timestamp) as ts", "text")


def articles(spark: SparkSession, folder: str) -> DataFrame:
    return derive(spark, folder, ARTICLES)


def articles_with_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Articles with the model's answer next to each; both come from one row of one table."""
    both = {**ARTICLES[1], "answer": LLM_ANSWERS[1]["answer"]}
    return derive(spark, folder, ("customer", both))


def utterances(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns, three seconds apart, conversations a minute apart."""
    return spark.read.parquet(f"{folder}/conversations.parquet").selectExpr(
        "conv_id as call_id",
        "turn as utt_id",
        "cast(timestamp_ntz '2024-01-01 00:00:00'"
        " + make_dt_interval(0, 0, 0, conv_id * 60 + turn * 3) as timestamp) as ts",
        "text",
    )
