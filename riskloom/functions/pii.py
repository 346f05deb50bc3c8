"""Redaction of personal data, and the scan that checks for leftovers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import patterns

KINDS = [kind for kind, _, _ in patterns.REDACTIONS]


def redact(text: Column, kinds: list[str] | None = None) -> Column:
    """Replace personal data by placeholders, kind after kind in a fixed order.

    Each step sees the result of the one before: an 18-digit run is taken as an
    identity number before the bank-card rule can claim it.
    """
    for kind, pattern, placeholder in patterns.REDACTIONS:
        if kinds is None or kind in kinds:
            text = F.regexp_replace(text, pattern, placeholder)
    return text


def scan(text: Column) -> Column:
    """Kinds of personal data present (identity number, phone, bank card, e-mail)."""
    return F.array_compact(
        F.array(*[F.when(text.rlike(pattern), F.lit(label)) for label, pattern in patterns.SCANS])
    )
