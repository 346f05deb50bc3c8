"""Call transcripts to risk results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import answers, scoring, vectors
from ..lexicon import DEFAULT, Lexicon
from ..operators.rules import rule_of
from ..operators.similar import TopKOptions, similar_topk, top_one
from ..schemas import RiskOptions

# What a result shows of a similar case, and what a request to a model quotes of it.
RESULT_INFO = ["title", "fraud_type", "recommended_warning"]
REQUEST_INFO = [*RESULT_INFO, "summary", "key_risk_signals"]


def valid_transcripts(calls: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(calls with something said, blank calls)."""
    said = F.coalesce(F.col(text).rlike(r"(?U)\S"), F.lit(False))
    return calls.filter(said), calls.filter(~said)


def with_rule_score(calls: DataFrame, lexicon: Lexicon = DEFAULT, text: str = "text") -> DataFrame:
    """Adds `rule`: struct(score, fraud_type, signals). The lexicon goes along with the plan, so no shuffle."""
    return calls.withColumn("rule", rule_of(F.col(text), lexicon))


def with_vector(calls: DataFrame, options: RiskOptions = RiskOptions(), text: str = "text") -> DataFrame:
    return calls.withColumn("vec", vectors.hash_vector(F.col(text), options.dim))


def with_similar(
    calls: DataFrame,
    cases: DataFrame,
    call_id: str,
    options: RiskOptions = RiskOptions(),
    topk: TopKOptions = TopKOptions(),
    text: str = "text",
    info: list[str] = RESULT_INFO,
) -> DataFrame:
    """Adds `similar`: the k most similar stored cases with their `info` columns, best first."""
    return similar_topk(with_vector(calls, options, text), cases, options.top_k, call_id, info, topk, keep_vec=False)


def judge_requests(scored: DataFrame, text: str = "text") -> DataFrame:
    """Adds `request`, the text to put to a model about each call. `similar` holds REQUEST_INFO."""
    return scored.withColumn("request", answers.judge_request(F.col(text), F.col("similar")))


def assess(scored: DataFrame, options: RiskOptions = RiskOptions()) -> DataFrame:
    """Adds the result columns. Needs `rule`, `similar`, and `judge` (null where none)."""
    staged = scored.withColumn("_top", top_one(F.col("similar")))
    staged = staged.withColumn(
        "raw_score", scoring.fuse(F.col("rule.score"), F.col("_top.similarity"), F.col("judge.score"))
    ).withColumns(
        {
            "risk_level": scoring.level(F.col("raw_score"), options),
            "fraud_type": scoring.pick_type(
                F.col("judge.fraud_type"), F.col("rule.fraud_type"), F.col("_top.fraud_type"), F.col("_top.similarity")
            ),
        }
    )
    return staged.withColumns(
        {
            "risk_score": F.round("raw_score", 3),
            "matched_signals": F.col("rule.signals"),
            "similar_cases": F.transform(
                "similar",
                lambda c: F.struct(
                    c["case_id"].alias("case_id"),
                    c["title"].alias("title"),
                    c["fraud_type"].alias("fraud_type"),
                    F.round(F.greatest(c["cosine"], F.lit(0.0)), 3).alias("similarity"),
                ),
            ),
            "reason": scoring.reason(
                F.col("judge.reason"), F.col("risk_level"), F.col("fraud_type"), F.col("rule.signals"),
                F.col("_top.title"), F.col("_top.similarity"),
            ),
            "suggested_action": scoring.advice(F.col("risk_level"), F.col("fraud_type"), F.col("similar")),
        }
    ).drop("_top")


RESULT = ["risk_level", "risk_score", "fraud_type", "matched_signals", "similar_cases", "reason", "suggested_action"]
NO_JUDGE = "struct<score:double,fraud_type:string,reason:string>"


def detect(
    calls: DataFrame,
    cases: DataFrame,
    call_id: str,
    judged: DataFrame | None = None,
    lexicon: Lexicon = DEFAULT,
    options: RiskOptions = RiskOptions(),
    topk: TopKOptions = TopKOptions(),
    text: str = "text",
) -> DataFrame:
    """Calls with their risk result. `judged` holds (call_id, answer) JSON of a model, if any.

    Blank transcripts are left out; take them from `valid_transcripts`. Without `judged`
    and with a case table that fits an executor, the plan has no shuffle at all.
    """
    said, _ = valid_transcripts(calls, text)
    if judged is None:
        said = said.withColumn("judge", F.lit(None).cast(NO_JUDGE))
    else:
        # Joined while a row is still a transcript: it is widest after scoring.
        read = judged.select(call_id, answers.judge_fields(F.col("answer")).alias("judge"))
        said = said.join(read, call_id, "left")
    scored = with_similar(with_rule_score(said, lexicon, text), cases, call_id, options, topk, text)
    kept = [c for c in calls.columns if c not in RESULT]
    return assess(scored, options).select(*kept, *RESULT)


def as_json(results: DataFrame) -> DataFrame:
    """One JSON text per result, non-ASCII characters kept."""
    return results.select(F.to_json(F.struct(*results.columns), {"ignoreNullFields": "false"}).alias("json"))


def write_json(results: DataFrame, path: str) -> None:
    """Results as JSON lines, nulls and non-ASCII characters kept."""
    results.write.option("ignoreNullFields", "false").json(path)


def read_json(results: DataFrame, path: str) -> DataFrame:
    """What `write_json` wrote for `results`, by its declared schema."""
    return results.sparkSession.read.schema(results.schema).json(path)
