"""Declared schemas and the tunable constants of scoring and cleaning."""

from __future__ import annotations

from dataclasses import dataclass

VICTIM = "struct<age_group:string,occupation:string,gender:string>"
MONEY = "struct<payment_method:string,amount:double>"

ARTICLE_FILE = "title string, source_name string, url string, publish_date string, text string"
SEED_FILE = "array<struct<url:string,source_name:string>>"

CASE_COLUMNS = [
    "case_id", "title", "source_url", "source_name", "publish_date", "fraud_type", "scenario",
    "victim_profile", "fraud_script", "key_risk_signals", "money_flow", "loss_amount", "summary",
    "recommended_warning", "confidence", "raw_text_hash", "extraction_method",
]

# fraud_type comes last: it is the partition column of the stored table.
CASE_TABLE = (
    "case_id string, title string, source_url string, source_name string, publish_date date,"
    f" scenario string, victim_profile {VICTIM}, fraud_script array<string>,"
    f" key_risk_signals array<string>, money_flow {MONEY}, loss_amount double, summary string,"
    " recommended_warning string, confidence double, raw_text_hash string, extraction_method string,"
    " vec array<int>, norm2 bigint, space string, batch_id bigint, created_at timestamp,"
    " fraud_type string"
)


@dataclass(frozen=True)
class RiskOptions:
    """Scoring parameters; the defaults are the engine's documented behaviour."""

    high: float = 0.7
    medium: float = 0.4
    top_k: int = 5
    dim: int = 256
