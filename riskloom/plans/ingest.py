"""Documents to stored cases: the whole ingest as one lazy plan per step."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from ..lexicon import DEFAULT, Lexicon
from ..operators.cases import accepted_cases, chosen_cases, redact_docs, rule_cases, validate_cases
from ..operators.dedup import unseen
from ..sources.articles import dedup_docs, named_texts
from ..sources.store import CaseStore


def pages_to_docs(pages: DataFrame, seeds: DataFrame, order: str, only_listed: bool = True) -> DataFrame:
    """A batch of pages (url, html) as clean, redacted, deduplicated documents."""
    return dedup_docs(redact_docs(named_texts(pages, seeds, only_listed)), order)


def extract_cases(
    docs: DataFrame, as_of: date, answer: str | None = None, lexicon: Lexicon = DEFAULT, keep: list[str] = []
) -> DataFrame:
    """Validated cases of redacted documents. `answer` names a column of model answers.

    `keep` lists document columns to carry along, such as the read order.
    """
    found = chosen_cases(docs, answer, lexicon) if answer else rule_cases(docs, lexicon)
    return accepted_cases(validate_cases(found, as_of, lexicon), *keep)


def ingest(
    store: CaseStore,
    docs: DataFrame,
    as_of: date,
    order: str,
    answer: str | None = None,
    lexicon: Lexicon = DEFAULT,
) -> DataFrame:
    """Store the new cases of redacted documents; returns the cases added.

    Documents already stored leave before extraction, which is the costly part.
    """
    fresh = docs
    if store.exists():
        fresh = unseen(docs, store.read().select(F.col("raw_text_hash").alias("text_hash")), "text_hash")
    return store.append(extract_cases(fresh, as_of, answer, lexicon, [order]), F.col(order), all_new=True)


def ingest_summary(docs: DataFrame, added: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: documents read, cases added, cases stored. The added cases are their own table."""

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")

    rows = count(docs, "fetched").unionByName(count(added, "ingested")).unionByName(count(stored, "total"))
    return rows.agg(
        *[F.sum(F.when(F.col("what") == w, F.col("n"))).alias(w) for w in ("fetched", "ingested", "total")]
    )


def new_case_lines(added: DataFrame) -> DataFrame:
    """One line per new case, as a console would print it."""
    return added.select(
        "case_id",
        F.format_string("+ [%s] %s (confidence=%.2f)", "fraud_type", "title", "confidence").alias("line"),
    )

