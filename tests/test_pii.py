import random

import pytest
from pyspark.sql import functions as F

from riskloom.functions import pii

CASES = [
    ("来电13800001234请回", "来电[手机号]请回"),
    ("来电+86 138-0000-1234。", "来电[手机号]。"),
    ("证件11010119900307123X已验", "证件[身份证号]已验"),
    ("旧证110101900307123。", "旧证[身份证号]。"),
    ("卡6217000012345678901", "卡[银行卡号]"),
    ("固话0731-1234567，转8", "固话[固定电话]，转8"),
    ("写信a.b+c@mail.example.org吧", "写信[邮箱]吧"),
    ("5.1a@b.com1@c.org", "[邮箱][邮箱]"),
    ("市民王某到场", "市民[当事人]到场"),
    ("对方自称某市民警", "对方自[当事人]市民警"),
    ("联系人王某", "联系人王某"),
    ("张XX", "[当事人]X"),
    ("损失5.8万元即58000元", "损失5.8万元即58000元"),
    ("12345678901234567890", "12345678901234567890"),
]


@pytest.mark.parametrize("text,expected", CASES)
def test_redact(one, text, expected):
    assert one(pii.redact, text) == expected


@pytest.mark.parametrize(
    "text,kinds",
    [
        ("打 13800001234", ["手机号"]),
        ("没有敏感信息", []),
        ("110101199003071234", ["身份证号", "银行卡号"]),
        ("0731-1234567 王某到", []),
        ("a@b.cn 6217000012345678901", ["银行卡号", "邮箱"]),
    ],
)
def test_scan(one, text, kinds):
    assert one(pii.scan, text) == kinds


def test_redacted_text_scans_clean(spark):
    rng = random.Random(7)
    parts = ["1", "3", "9", "0", "86", "+", "-", " ", "X", "x", "a", "@", ".com", "王", "某", "，", "13812345678", "4301031988051243", "\n"]
    rows = [("".join(rng.choice(parts) for _ in range(rng.randint(1, 40))),) for _ in range(20000)]
    left = spark.createDataFrame(rows, "t string").select(pii.scan(pii.redact(F.col("t"))).alias("k")).filter(F.size("k") > 0)
    assert left.count() == 0


def test_long_run_is_linear(one):
    text = "a" * 200_000 + " 1@c.org"
    assert one(pii.redact, text).endswith(" [邮箱]")
