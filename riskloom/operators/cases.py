"""Documents to cases: rule extraction, model answers, choice and validation."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import answers, checks, facts
from ..functions.pii import redact, scan
from ..functions.text import bind, case_key, content_hash, lookup, present, words
from ..lexicon import DEFAULT, Lexicon
from ..schemas import CASE_COLUMNS, MONEY, VICTIM

MIN_HITS = 2

_FIELDS = [
    "title", "fraud_type", "scenario", "victim_profile", "fraud_script", "key_risk_signals", "money_flow",
    "loss_amount", "summary", "recommended_warning", "confidence", "extraction_method",
]


def redact_docs(docs: DataFrame) -> DataFrame:
    """Redact title and text, then hash the redacted text."""
    return once(
        docs, {"title": redact(F.coalesce("title", F.lit(""))), "text": redact(F.col("text"))}
    ).withColumn("text_hash", content_hash(F.col("text")))


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """`withColumns` for costly columns that later steps filter on or name repeatedly.

    A generator computes them once per row. Written as a plain projection they would be
    computed again inside every filter the optimizer pushes below it.
    """
    row = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_row")
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, row).select(*kept, *[F.col(f"_row.{n}").alias(n) for n in columns])


def rule_fields(title: Column, text: Column, found: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """Case fields by rules as one struct. `found` is `facts.classify` of title + newline + text."""
    return bind(F.concat(title, F.lit("\n"), text), lambda whole: _rule_fields(title, text, whole, found, lexicon))


def _rule_fields(title: Column, text: Column, whole: Column, found: Column, lexicon: Lexicon) -> Column:
    signals = {t: lexicon.risk_signals.get(t, []) for t in lexicon.types}
    warnings = {t: lexicon.warnings.get(t, "") for t in lexicon.types}
    kind = found["fraud_type"]
    summary = facts.lead(text)
    return bind(facts.max_amount(whole), lambda amount: F.struct(
        F.coalesce(present(title), F.concat(kind, F.lit("案例"))).alias("title"),
        kind.alias("fraud_type"),
        summary.alias("scenario"),
        F.struct(
            facts.age_group(whole).alias("age_group"),
            F.lit(None).cast("string").alias("occupation"),
            F.lit(None).cast("string").alias("gender"),
        ).cast(VICTIM).alias("victim_profile"),
        facts.quotes(text).alias("fraud_script"),
        facts.key_signals(F.coalesce(lookup(signals, kind), words([])), found["hits"]).alias("key_risk_signals"),
        F.struct(facts.payment_method(whole).alias("payment_method"), amount.alias("amount")).cast(MONEY).alias(
            "money_flow"
        ),
        amount.alias("loss_amount"),
        summary.alias("summary"),
        F.coalesce(lookup(warnings, kind), F.lit("")).alias("recommended_warning"),
        F.round(F.lit(0.3) + F.lit(0.4) * found["score"], 2).alias("confidence"),
        F.lit("rule").alias("extraction_method"),
    ))


def _classified(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    whole = F.concat(F.col("title"), F.lit("\n"), F.col("text"))
    return docs.withColumn("_found", facts.classify(facts.type_hits(whole, lexicon)))


def rule_cases(docs: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Documents with at least two keyword hits of one type, as cases."""
    hit = _classified(docs, lexicon)
    rule = F.when(hit["_found.n"] >= MIN_HITS, rule_fields(F.col("title"), F.col("text"), F.col("_found"), lexicon))
    return _as_cases(hit.withColumn("_case", rule), docs.columns)


def answer_cases(docs: DataFrame, answer: str = "answer", lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Documents whose model answer claims a fraud case, as cases."""
    read = docs.withColumn("_answer", answers.parse_object(F.col(answer)))
    case = F.when(
        answers.is_usable(F.col("_answer")), answers.answer_fields(F.col("_answer"), F.col("title"), lexicon)
    )
    return _as_cases(read.withColumn("_case", case), docs.columns)


def chosen_cases(docs: DataFrame, answer: str = "answer", lexicon: Lexicon = DEFAULT) -> DataFrame:
    """The model's case if usable, else the rules' case, else nothing.

    An answer "not a fraud case" does not veto the rules.
    """
    read = _classified(docs, lexicon).withColumn("_answer", answers.parse_object(F.col(answer)))
    by_rule = F.when(F.col("_found.n") >= MIN_HITS, rule_fields(F.col("title"), F.col("text"), F.col("_found"), lexicon))
    by_model = F.when(
        answers.is_usable(F.col("_answer")), answers.answer_fields(F.col("_answer"), F.col("title"), lexicon)
    )
    return _as_cases(read.withColumn("_case", F.coalesce(by_model, by_rule)), docs.columns)


def _as_cases(df: DataFrame, doc_columns: list[str]) -> DataFrame:
    """Unpack `_case`; rows without one go. Document text stays as `text` for validation.

    The generator evaluates the struct once per row. A filter on it would be pushed
    below the projection and evaluate the whole extraction a second time.
    """
    keep = [c for c in doc_columns if c not in _FIELDS and c != "answer"]
    one = df.select(
        *keep,
        F.explode(F.filter(F.array("_case"), lambda c: c.isNotNull())).alias("_case"),
    )
    return one.select(
        *[c for c in keep if c not in ("url", "text_hash")],
        F.col("url").alias("source_url"),
        F.col("text_hash").alias("raw_text_hash"),
        case_key(F.col("text_hash"), F.col("url")).alias("case_id"),
        *[F.col(f"_case.{f}").alias(f) for f in _FIELDS],
    )


def validate_cases(cases: DataFrame, as_of: date, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Repair what can be repaired; adds `accepted` and the ordered list `problems`.

    `cases` carries the document text as `text`. A case without summary and scenario
    is not accepted and reports only that.
    """
    day = F.lit(as_of)
    required = checks.has_required(F.col("summary"), F.col("scenario"))
    share = checks.grounded_share(F.col("fraud_script"), F.col("text"))
    noted = cases.withColumns(
        {
            "fraud_script": F.transform("fraud_script", lambda s: redact(s)),
            "key_risk_signals": F.transform("key_risk_signals", lambda s: redact(s)),
        }
    ).withColumn("_weak", checks.weakly_grounded(F.col("extraction_method"), share))

    def note(bad: Column, text: str) -> Column:
        return F.when(bad, F.lit(text))

    problems = F.array_compact(
        F.array(
            note(~checks.known_type(F.col("fraud_type"), lexicon), "type_outside_enum"),
            note(~checks.amount_ok(F.col("loss_amount")), "amount_out_of_range:loss_amount"),
            note(~checks.amount_ok(F.col("money_flow.amount")), "amount_out_of_range:money_flow.amount"),
            note(~checks.date_ok(F.col("publish_date"), day), "date_unusable"),
            *[note(F.size(scan(F.col(c))) > 0, f"pii_left:{c}") for c in ("title", "scenario", "summary")],
            note(F.col("_weak"), "script_not_in_text"),
        )
    )
    return noted.withColumns(
        {
            "accepted": required,
            "problems": F.when(required, problems).otherwise(F.array(F.lit("summary_missing"))),
        }
    ).withColumns(
        {
            "fraud_type": checks.repair_type(F.col("fraud_type"), lexicon),
            "loss_amount": checks.repair_amount(F.col("loss_amount")),
            "money_flow": F.col("money_flow").withField("amount", checks.repair_amount(F.col("money_flow.amount"))),
            "publish_date": checks.parse_date(F.col("publish_date"), day),
            "title": checks.repair_text(F.col("title")),
            "scenario": checks.repair_text(F.col("scenario")),
            "summary": checks.repair_text(F.col("summary")),
            "confidence": F.when(
                F.col("_weak"), F.least("confidence", F.lit(checks.UNGROUNDED_CONFIDENCE))
            ).otherwise(F.col("confidence")),
        }
    ).drop("_weak")


def accepted_cases(validated: DataFrame, *extra: str) -> DataFrame:
    return validated.filter("accepted").select(*CASE_COLUMNS, *extra)
