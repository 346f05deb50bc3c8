"""Model answers that arrive as JSON text, and the request texts that ask for them.

Calling a model is outside this engine: requests leave as a table, answers come
back as a table. Answers are read as VARIANT, so a wrong type in one field costs
that field and not the whole answer.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..lexicon import DEFAULT, OTHER, Lexicon
from ..schemas import MONEY, VICTIM
from .text import bind, present, words

MAX_ARTICLE_CHARS = 6000
JUDGE_CASES, JUDGE_SIGNALS = 3, 5
NO_CASES = "（无）"
NUMBER = r"(?i)^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?\s*$"

# Wording of this project.
EXTRACT_REQUEST = (
    "阅读下面的文章，判断它是否讲述一起诈骗案件，只用一个 JSON 对象回答。"
    "字段：is_fraud_case（布尔）、title、fraud_type、scenario、"
    "victim_profile（age_group、occupation、gender）、fraud_script（数组）、key_risk_signals（数组）、"
    "money_flow（payment_method、amount）、loss_amount（单位元）、summary、recommended_warning、confidence（0 到 1）。"
    "文中没有的内容填 null；不要写出姓名、电话、证件号或卡号。fraud_type 只能取：{labels}。\n\n"
    "标题：%s\n正文：\n%s"
)
JUDGE_REQUEST = (
    "根据通话文本与相近案例，估计这通电话是诈骗的可能性，只用一个 JSON 对象回答，"
    "字段：score（0 到 1）、fraud_type（或 null）、reason（一句话，不要添加文本里没有的内容）。\n\n"
    "通话：\n%s\n\n相近案例：\n%s"
)


def extract_request(title: Column, text: Column, lexicon: Lexicon = DEFAULT) -> Column:
    return F.format_string(
        EXTRACT_REQUEST.format(labels="、".join(lexicon.labels)), title, F.substring(text, 1, MAX_ARTICLE_CHARS)
    )


def judge_request(transcript: Column, similar: Column) -> Column:
    """`similar` elements carry fraud_type, summary and key_risk_signals, best first."""
    lines = F.transform(
        F.slice(similar, 1, JUDGE_CASES),
        lambda c: F.concat(
            F.lit("- ["), c["fraud_type"], F.lit("] "), c["summary"], F.lit(" 风险信号: "),
            F.array_join(F.slice(c["key_risk_signals"], 1, JUDGE_SIGNALS), ", "),
        ),
    )
    return F.format_string(JUDGE_REQUEST, transcript, F.coalesce(present(F.array_join(lines, "\n")), F.lit(NO_CASES)))


def parse_object(answer: Column) -> Column:
    """VARIANT of a JSON object; null for broken JSON or anything but an object."""
    return bind(F.try_parse_json(answer), lambda parsed: F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed))


def to_float(value: Column) -> Column:
    """Number from text, null if it is none.

    The cast alone would also take Java's type letters, as in `12d`.
    """
    return F.when(value.rlike(NUMBER), value.try_cast("double"))


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _number(v: Column, path: str) -> Column:
    return to_float(_text(v, path))


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.variant_get(v, path, "variant"))


def _truthy(v: Column, path: str) -> Column:
    """Whether a field counts as set: true, a non-zero number, a non-empty text or structure."""
    kind, text = _kind(v, path), _text(v, path)
    return F.coalesce(
        F.when(kind == "BOOLEAN", text == "true")
        .when(kind == "VOID", F.lit(False))
        .when(kind == "STRING", text != "")
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), ~text.isin("[]", "{}"))
        .otherwise(to_float(text) != 0),
        F.lit(False),
    )


def _strings(v: Column, path: str) -> Column:
    """The text items of a list, others dropped; an empty list if there is no list."""
    items = F.try_variant_get(v, path, "array<variant>")
    kept = F.transform(
        F.filter(items, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: x.cast("string")
    )
    return F.coalesce(kept, F.array().cast("array<string>"))


def is_usable(v: Column) -> Column:
    """Whether a parsed answer claims to describe a fraud case."""
    return v.isNotNull() & _truthy(v, "$.is_fraud_case")


def answer_fields(v: Column, doc_title: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """Case fields of a parsed answer as one struct, defaults filled in."""
    named = present(_text(v, "$.fraud_type"))
    empty = F.lit("")
    return F.struct(
        F.coalesce(present(_text(v, "$.title")), doc_title).alias("title"),
        F.when(named.isin(lexicon.labels), named).otherwise(F.lit(OTHER)).alias("fraud_type"),
        F.coalesce(_text(v, "$.scenario"), empty).alias("scenario"),
        F.struct(
            _text(v, "$.victim_profile.age_group").alias("age_group"),
            _text(v, "$.victim_profile.occupation").alias("occupation"),
            _text(v, "$.victim_profile.gender").alias("gender"),
        ).cast(VICTIM).alias("victim_profile"),
        _strings(v, "$.fraud_script").alias("fraud_script"),
        _strings(v, "$.key_risk_signals").alias("key_risk_signals"),
        F.struct(
            _text(v, "$.money_flow.payment_method").alias("payment_method"),
            _number(v, "$.money_flow.amount").alias("amount"),
        ).cast(MONEY).alias("money_flow"),
        _number(v, "$.loss_amount").alias("loss_amount"),
        F.coalesce(_text(v, "$.summary"), empty).alias("summary"),
        F.coalesce(_text(v, "$.recommended_warning"), empty).alias("recommended_warning"),
        F.coalesce(F.when(_truthy(v, "$.confidence"), _number(v, "$.confidence")), F.lit(0.5)).alias("confidence"),
        F.lit("llm").alias("extraction_method"),
    )


def judge_fields(answer: Column) -> Column:
    """struct(score, fraud_type, reason) of a judge answer; null when it cannot be used.

    A missing score counts as 0 and a boolean as 1 or 0; a score that is no number voids
    the answer, and so does an object without any field.
    """
    # bound step by step: a branch would parse the text again for every field it names
    return bind(bind(F.try_parse_json(answer), _with_fields), _judged)


def _with_fields(parsed: Column) -> Column:
    kind = F.schema_of_variant(parsed)
    return F.when(kind.startswith("OBJECT") & (kind != "OBJECT<>"), parsed)


def _judged(v: Column) -> Column:
    flag = _kind(v, "$.score") == "BOOLEAN"
    absent = v.isNotNull() & F.variant_get(v, "$.score", "variant").isNull()
    number = F.when(flag, F.when(_text(v, "$.score") == "true", 1.0).otherwise(0.0)).otherwise(bind(_text(v, "$.score"), to_float))
    fields = lambda score: F.when(
        score.isNotNull(),
        F.struct(
            F.greatest(F.lit(0.0), F.least(score, F.lit(1.0))).alias("score"),
            _text(v, "$.fraud_type").alias("fraud_type"),
            F.coalesce(_text(v, "$.reason"), F.lit("")).alias("reason"),
        ),
    )
    return bind(F.when(absent, F.lit(0.0)).otherwise(number), fields)
