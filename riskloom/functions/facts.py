"""Facts read from article text: fraud type, amounts, quotes, victim, payment."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import patterns
from ..lexicon import AGE_MARKERS, DEFAULT, OTHER, PAYMENT_TERMS, Lexicon
from .text import bind, contained, contained_in, first_marker

# Full-width digits count as digits in the patterns; number casts want ASCII.
_WIDE_DIGITS = "０１２３４５６７８９"


def type_hits(text: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """Per type, in rank order: struct(type_rank, fraud_type, kws) with the keywords found.

    A literal lexicon keeps the match inside the scan stage: no join, no shuffle.
    """
    def of(whole: Column) -> Column:
        return F.array(
            *[
                F.struct(
                    F.lit(rank).alias("type_rank"),
                    F.lit(name).alias("fraud_type"),
                    contained_in(whole, kws).alias("kws"),
                )
                for rank, (name, kws) in enumerate(lexicon.keywords.items())
            ]
        )

    return bind(text, of)


def best_type(hits: Column) -> Column:
    """struct(n, neg_rank, fraud_type, kws) of the type with most hits; the earlier type wins ties."""
    return F.array_max(
        F.transform(
            hits,
            lambda h: F.struct(
                F.size(h["kws"]).alias("n"),
                (-h["type_rank"]).alias("neg_rank"),
                h["fraud_type"].alias("fraud_type"),
                h["kws"].alias("kws"),
            ),
        )
    )


def classify(hits: Column) -> Column:
    """struct(fraud_type, hits, n, score) for an article; no hit at all gives the catch-all type."""
    return bind(best_type(hits), _classified)


def _classified(best: Column) -> Column:
    return F.struct(
        F.when(best["n"] > 0, best["fraud_type"]).otherwise(F.lit(OTHER)).alias("fraud_type"),
        F.when(best["n"] > 0, best["kws"]).otherwise(F.array().cast("array<string>")).alias("hits"),
        best["n"].alias("n"),
        F.least(best["n"] / F.lit(4.0), F.lit(1.0)).alias("score"),
    )


def amounts(text: Column) -> Column:
    """All sums of money named in the text, in yuan. One separator group per number."""
    numbers = F.regexp_extract_all(text, F.lit(patterns.AMOUNT), 1)
    units = F.regexp_extract_all(text, F.lit(patterns.AMOUNT), 2)
    return F.zip_with(
        numbers,
        units,
        lambda n, u: F.translate(n, _WIDE_DIGITS + ",", "0123456789").try_cast("double")
        * F.when(F.contains(u, F.lit("万")), F.lit(10000.0)).otherwise(F.lit(1.0)),
    )


def max_amount(text: Column) -> Column:
    return F.array_max(amounts(text))


def quotes(text: Column, limit: int = 8) -> Column:
    """Quoted passages of 4 to 60 characters, the first `limit` of them."""
    return F.slice(F.regexp_extract_all(text, F.lit(patterns.QUOTE), 1), 1, limit)


def age_group(text: Column) -> Column:
    return first_marker(text, dict(AGE_MARKERS))


def payment_method(text: Column) -> Column:
    return F.get(contained(text, PAYMENT_TERMS), F.lit(0))


def lead(text: Column, chars: int = 120) -> Column:
    """Opening of the text on one line."""
    return F.translate(F.substring(text, 1, chars), "\n", " ")


def key_signals(info_signals: Column, hits: Column, limit: int = 10) -> Column:
    """Signals of the type followed by the hits, first occurrence kept, first `limit`."""
    return F.slice(F.array_distinct(F.concat(info_signals, hits)), 1, limit)
