"""Validation of extracted cases: what is repaired, what is noted, what is refused."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..lexicon import DEFAULT, OTHER, Lexicon
from .pii import redact, scan
from .text import bind, strip

# --- fixed values ---------------------------------------------------------
MAX_AMOUNT = 1e9
FIRST_YEAR = 2000
MIN_GROUNDED = 0.3
UNGROUNDED_CONFIDENCE = 0.4


def has_required(summary: Column, scenario: Column) -> Column:
    return (F.coalesce(summary, F.lit("")) != "") | (F.coalesce(scenario, F.lit("")) != "")


def known_type(fraud_type: Column, lexicon: Lexicon = DEFAULT) -> Column:
    return fraud_type.isin(lexicon.labels)


def repair_type(fraud_type: Column, lexicon: Lexicon = DEFAULT) -> Column:
    return F.when(known_type(fraud_type, lexicon), fraud_type).otherwise(F.lit(OTHER))


def amount_ok(value: Column) -> Column:
    """True for null and for 0 < value < 1e9. NaN is out of range too."""
    return value.isNull() | ((value > 0) & (value < MAX_AMOUNT))


def repair_amount(value: Column) -> Column:
    return F.when((value > 0) & (value < MAX_AMOUNT), value)


def parse_date(text: Column, as_of: Column) -> Column:
    """DATE from the first ten characters (YYYY-MM-DD), from 2000 on and not after `as_of`."""
    head = F.substring(text, 1, 10)
    day = F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}\z"), F.try_to_timestamp(head, F.lit("yyyy-MM-dd")).cast("date"))
    return F.when((F.year(day) >= FIRST_YEAR) & (day <= as_of), day)


def date_ok(text: Column, as_of: Column) -> Column:
    """True when there is no date or it is usable."""
    return text.isNull() | (text == "") | parse_date(text, as_of).isNotNull()


def repair_text(text: Column) -> Column:
    """Redact only if a scan finds something left over."""
    return F.when(F.size(scan(text)) > 0, redact(text)).otherwise(text)


def grounded(snippet: Column, text: Column) -> Column:
    """Whether the snippet, or any 6-character piece of it at step 3, occurs in the text."""
    def occurs(s: Column) -> Column:
        last = F.greatest(F.length(s) - 5, F.lit(1)) - 1
        pieces = F.exists(
            F.sequence(F.lit(0), last, F.lit(3)), lambda i: F.contains(text, F.substring(s, i + 1, F.lit(6)))
        )
        return (s != "") & (F.contains(text, s) | pieces)

    return bind(strip(snippet), occurs)


def grounded_share(script: Column, text: Column) -> Column:
    """Share of script lines found in the text; null for an empty script."""
    hits = F.size(F.filter(script, lambda s: grounded(s, text)))
    return F.when(F.size(script) > 0, hits / F.size(script))


def weakly_grounded(method: Column, share: Column) -> Column:
    return (method == "llm") & F.coalesce(share < MIN_GROUNDED, F.lit(False))
