"""Every operator as a query over the supplied tables: name -> (spark, folder) -> DataFrame.

Arrays leave as joined text and doubles rounded, so that another engine's result can be
compared value by value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import answers, checks, facts, html, pii, scoring, text as tx, vectors
from ..lexicon import DEFAULT
from ..operators import alerts, cases as ops, dedup
from ..operators.phrases import phrase_matches
from ..operators.similar import TopKOptions, similar_topk, top_one
from ..schemas import RiskOptions
from ..session import spread, work_folder
from ..sources import articles as src, store as st
from ..streaming import calls as live
from . import derived, detect as det, ingest as ing

OPTIONS = RiskOptions()
WINDOW, SLIDE = "2 hours", "1 hour"


def joined(array: Column | str) -> Column:
    return F.array_join(array, "|")


def r4(value: Column | str) -> Column:
    return F.round(value, 4)


def stamp(ts: str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias(ts)


# --- inputs ---------------------------------------------------------------


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def busy(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A table whose rows are costly to process: the scan keeps all cores at work."""
    return spread(table(spark, folder, name).select(*columns))


def docs(spark: SparkSession, folder: str, with_answers: bool = False) -> DataFrame:
    """Redacted articles with hash, source name and read order."""
    read = derived.articles_with_answers if with_answers else derived.articles
    return ops.redact_docs(read(spark, folder)).withColumn("source_name", tx.url_host(F.col("url")))


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """All supplied and derived texts: (src, id, text)."""
    sources = [
        busy(spark, folder, "documents", "doc_id", "text").selectExpr("'doc' as src", "doc_id as id", "text"),
        derived.articles(spark, folder).selectExpr("'art' as src", "art_id as id", "text"),
        derived.derive(spark, folder, derived.CALLS).selectExpr("'call' as src", "utt_id as id", "text"),
        derived.derive(spark, folder, derived.PERSONAL).selectExpr("'pii' as src", "id", "text"),
    ]
    out = sources[0]
    for other in sources[1:]:
        out = out.unionByName(other)
    return out


def phrase_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Calls and articles: (src, id, text)."""
    calls = derived.calls(spark, folder).selectExpr("'call' as src", "utt_id as id", "text")
    arts = derived.articles(spark, folder).selectExpr("'art' as src", "art_id as id", "concat(title, '\\n', text) as text")
    return calls.unionByName(arts)


def seeds(spark: SparkSession, folder: str) -> DataFrame:
    """An allow-list: every page served by https."""
    return seed_list(spark, folder).filter(F.col("url").startswith("https"))


def seed_list(spark: SparkSession, folder: str) -> DataFrame:
    """A seed for every page, those of one domain without a name."""
    return table(spark, folder, "pages").select(
        F.col("page_id").alias("pos"),
        "url",
        F.when(F.contains(tx.url_host(F.col("url")), F.lit("example.com")), F.lit(""))
        .otherwise(F.concat(F.lit("源-"), tx.url_host(F.col("url")))).alias("source_name"),
    )


def found_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Chosen cases before validation; document text and read order stay next to them."""
    return ops.chosen_cases(docs(spark, folder, True))


def validated(spark: SparkSession, folder: str) -> DataFrame:
    return ops.validate_cases(found_cases(spark, folder), derived.AS_OF)


def fresh_store(spark: SparkSession, folder: str) -> st.CaseStore:
    """A new case table, filled by one ingest of all articles."""
    store = st.CaseStore(spark, work_folder(spark, "cases"), OPTIONS)
    ing.ingest(store, docs(spark, folder, True), derived.AS_OF, "art_id", "answer")
    return store


_STORES: dict[tuple[str, str], st.CaseStore] = {}


def stored(spark: SparkSession, folder: str) -> st.CaseStore:
    """The case table that reading queries of one application share, written at first use."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _STORES:
        _STORES[key] = fresh_store(spark, folder)
    return _STORES[key]


def case_out(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(
        "case_id", "title", "source_url", "source_name", F.col("publish_date").cast("string").alias("publish_date"),
        "fraud_type", "scenario", F.col("victim_profile.age_group").alias("age_group"),
        F.col("victim_profile.gender").alias("gender"), joined("fraud_script").alias("fraud_script"),
        joined("key_risk_signals").alias("key_risk_signals"),
        F.col("money_flow.payment_method").alias("payment_method"), F.col("money_flow.amount").alias("amount"),
        "loss_amount", "summary", "recommended_warning", "confidence", "raw_text_hash", "extraction_method", *extra,
    )


# --- sources and sinks ----------------------------------------------------


def src_articles(spark, folder):
    """Written as JSON lines, some fields missing, and read back through the file source."""
    path = work_folder(spark, "articles")
    gap = F.col("art_id") % 5
    derived.articles(spark, folder).select(
        F.when(gap != 1, F.col("url")).alias("url"),
        F.when(gap != 2, F.lit("某站")).alias("source_name"),
        F.when(gap != 3, F.col("title")).alias("title"),
        "publish_date",
        F.when(gap != 4, F.col("text")).alias("text"),
    ).write.json(path)
    usable, _ = src.split_rejected(src.read_articles(spark, path, one_per_file=False))
    out = ops.redact_docs(usable)
    return out.select(
        F.when(out["url"].startswith("local://part-"), F.lit("by file name")).otherwise(out["url"]).alias("url"),
        "source_name", "title", "publish_date", "text_hash",
    )


def src_articles_order(spark, folder):
    """The read order of the articles as a number: by file name, here the hash of the article's number."""
    listed = derived.articles(spark, folder).select(
        "art_id", F.struct(F.concat(F.sha2(F.col("art_id").cast("string"), 256), F.lit(".json")).alias("file"), "url").alias("seq")
    )
    return src.read_rank(listed).select("art_id", F.col("seq.file").alias("file"), "rank")


def src_seed_sources(spark, folder):
    path = work_folder(spark, "seeds")
    named = F.when(F.col("source_name") != "", F.col("source_name")).alias("source_name")
    seed_list(spark, folder).select(F.to_json(F.array(F.struct("url", named)))).write.text(path)
    return src.read_seeds(spark, path, one_per_file=False).select("url", "source_name")


def doc_source_name(spark, folder):
    return src.with_source_name(table(spark, folder, "pages"), seeds(spark, folder)).select("page_id", "url", "source_name")


def doc_allowlist(spark, folder):
    return src.allow_listed(table(spark, folder, "pages"), seeds(spark, folder)).select("page_id", "url")


def pages_to_docs(spark, folder):
    out = ing.pages_to_docs(busy(spark, folder, "pages", "page_id", "url", "html"), seeds(spark, folder), "page_id")
    return out.select("page_id", "url", "source_name", "title", "publish_date", "text", "text_hash")


def case_upsert(spark, folder):
    """Two overlapping batches; the second adds only what the first did not hold."""
    store = st.CaseStore(spark, work_folder(spark, "cases"), OPTIONS)
    all_docs = docs(spark, folder, True)
    earlier = all_docs.filter(~F.contains("text", F.lit("点赞赚钱")))
    ing.ingest(store, earlier, derived.AS_OF, "art_id", "answer")
    ing.ingest(store, all_docs, derived.AS_OF, "art_id", "answer")
    return store.read().select("case_id", "fraud_type", "raw_text_hash", "batch_id")


def case_lookup(spark, folder):
    """Look up the id of every article's text; most were stored under another article's id."""
    ids = docs(spark, folder).select(tx.case_key(F.col("text_hash"), F.col("url")).alias("case_id")).distinct()
    return stored(spark, folder).lookup(ids).select("case_id", "found", "fraud_type", "title")


def case_scan(spark, folder):
    return case_out(stored(spark, folder).read())


def case_count(spark, folder):
    return stored(spark, folder).read().agg(F.count(F.lit(1)).alias("n"))


def stats_by_type(spark, folder):
    return stored(spark, folder).stats()


def case_provenance(spark, folder):
    return stored(spark, folder).read().select(
        "case_id", "source_url", "source_name", "raw_text_hash", "extraction_method",
        F.col("created_at").isNotNull().alias("stamped"),
    )


def ingest_summary(spark, folder):
    all_docs = docs(spark, folder, True)
    store = st.CaseStore(spark, work_folder(spark, "cases"), OPTIONS)
    added = ing.ingest(store, all_docs, derived.AS_OF, "art_id", "answer")
    # Counted before redaction: the number of articles needs none of it.
    return ing.ingest_summary(derived.articles(spark, folder), added, store.read())


def ingest_new_cases(spark, folder):
    return ing.new_case_lines(stored(spark, folder).read())


def case_new_only(spark, folder):
    cases = validated(spark, folder)
    known = cases.filter(F.col("extraction_method") == "llm").select("raw_text_hash")
    return dedup.unseen(cases, known).select("case_id", "art_id")


def case_replace(spark, folder):
    """The store's rule cases replaced, under their ids, by versions with a new summary."""
    store = st.CaseStore(spark, work_folder(spark, "cases"), OPTIONS)
    cases = ops.accepted_cases(validated(spark, folder))
    store.append(cases.withColumn("raw_text_hash", F.lit("")), F.col("case_id"))
    store.replace(cases.filter(F.col("extraction_method") == "rule").withColumn("summary", F.concat(F.lit("更新："), "summary")))
    return store.read().select("case_id", "batch_id", "summary")


def stats_after_replace(spark, folder):
    """Totals per type, kept with each batch, after a replacement that moves cases to another type."""
    store = st.CaseStore(spark, work_folder(spark, "cases"), OPTIONS)
    cases = ops.accepted_cases(validated(spark, folder))
    store.append(cases.withColumn("raw_text_hash", F.lit("")), F.col("case_id"))
    store.replace(cases.filter(F.col("extraction_method") == "rule").withColumn("fraud_type", F.lit("其他")))
    return store.stats()


# --- pages ----------------------------------------------------------------


def page_title(spark, folder):
    return table(spark, folder, "pages").select("page_id", html.page_title(F.col("html")).alias("title"))


def page_date(spark, folder):
    """Dates of the pages as supplied, and with a dated line put before the main part."""
    pages = table(spark, folder, "pages")
    line = F.format_string("<p>发布于 20%02d年%d月%d日</p><article>", F.col("page_id") % 40, F.col("page_id") % 13, F.col("page_id") % 32)
    dated = F.replace(F.col("html"), F.lit("<article>"), line)
    return pages.select("page_id", html.page_date(F.col("html")).alias("plain"), html.page_date(dated).alias("dated"))


def page_denoise(spark, folder):
    return table(spark, folder, "pages").select("page_id", html.denoise(F.col("html")).alias("html"))


def page_main_container(spark, folder):
    parts = table(spark, folder, "pages").select("page_id", html.blocks(html.denoise(F.col("html"))).alias("parts"))
    best = parts.withColumn("best", html.main_container(F.col("parts")))
    return best.select(
        "page_id",
        F.get("parts", F.col("best.start"))["name"].alias("tag"),
        F.col("best.len").alias("chars"),
        F.when(F.col("best.len") > 100, F.lit("container")).otherwise(F.lit("page")).alias("used"),
    )


def page_text(spark, folder):
    return src.clean_pages(busy(spark, folder, "pages", "page_id", "html")).select("page_id", "text")


def page_text_coalesce(spark, folder):
    pages = table(spark, folder, "pages")
    other = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("  \t"), "url", F.lit("\n"))).when(
        F.col("page_id") % 3 == 1, F.lit(" \n　")
    )
    # A date that stands in an attribute only, for pages whose other extractor has text but no date.
    page = F.concat(F.format_string("<meta content='20%02d-%d-%d'>", F.col("page_id") % 40, F.col("page_id") % 12 + 1, F.col("page_id") % 28 + 1), "html")
    named, dated = F.when(F.col("page_id") % 2 == 0, F.col("url")), F.when(F.col("page_id") % 4 == 0, F.lit("2020-02-02"))
    pages = pages.withColumns({"html": page, "other": other, "named": named, "dated": dated})
    return src.clean_pages(pages, "html", "other", "named", "dated").select("page_id", "title", "publish_date", "text")


def doc_min_length(spark, folder):
    return src.long_enough(table(spark, folder, "documents")).select("doc_id")


# --- personal data --------------------------------------------------------


def _redacted(kinds):
    def run(spark, folder):
        return texts(spark, folder).select("src", "id", pii.redact(F.col("text"), kinds).alias("text"))

    return run


def pii_scan(spark, folder):
    return texts(spark, folder).select("src", "id", joined(pii.scan(F.col("text"))).alias("kinds"))


# --- phrases, types, joins ------------------------------------------------


def phrase_hits(spark, folder):
    hits = phrase_texts(spark, folder).select("src", "id", F.explode(facts.type_hits(F.col("text"))).alias("h"))
    return hits.filter(F.size("h.kws") > 0).select("src", "id", "h.fraud_type", joined("h.kws").alias("kws"))


def phrase_hits_join(spark, folder):
    """The same hits with the lexicon as a table, for lexicons too large for a literal."""
    found = phrase_matches(phrase_texts(spark, folder), DEFAULT.keyword_table(spark), ["src", "id"])
    return found.select("src", "id", "fraud_type", "kw_rank", "kw")


def generic_hits(spark, folder):
    return phrase_texts(spark, folder).select("src", "id", joined(scoring.generic_hits(F.col("text"))).alias("hits"))


def type_info_join(spark, folder):
    typed = phrase_texts(spark, folder).select(
        "src", "id", facts.classify(facts.type_hits(F.col("text")))["fraud_type"].alias("fraud_type")
    )
    info = DEFAULT.info_table(spark)
    return typed.join(info, "fraud_type").select("src", "id", "fraud_type", joined("risk_signals").alias("signals"), "warning")


def classify_type(spark, folder):
    found = facts.classify(facts.type_hits(F.col("text")))
    return phrase_texts(spark, folder).select("src", "id", found.alias("f")).select(
        "src", "id", "f.fraud_type", joined("f.hits").alias("hits"), "f.score"
    )


def _ruled(spark, folder):
    return det.with_rule_score(phrase_texts(spark, folder))


def rule_score(spark, folder):
    return _ruled(spark, folder).select("src", "id", r4("rule.score").alias("score"), "rule.fraud_type")


def matched_signals(spark, folder):
    return _ruled(spark, folder).select("src", "id", joined("rule.signals").alias("signals"))


def key_risk_signals(spark, folder):
    return ops.rule_cases(docs(spark, folder)).select("art_id", joined("key_risk_signals").alias("signals"))


# --- facts ----------------------------------------------------------------


def _art(**columns):
    def run(spark, folder):
        whole = F.concat(F.col("title"), F.lit("\n"), F.col("text"))
        return docs(spark, folder).select("art_id", *[make(whole).alias(n) for n, make in columns.items()])

    return run


def extract_quotes(spark, folder):
    return texts(spark, folder).select("src", "id", joined(facts.quotes(F.col("text"))).alias("quotes"))


def extract_summary(spark, folder):
    return table(spark, folder, "documents").select("doc_id", facts.lead(F.col("text")).alias("summary"))


def content_hash(spark, folder):
    return table(spark, folder, "documents").select("doc_id", tx.content_hash(F.col("text")).alias("text_hash"))


def doc_dedup(spark, folder):
    hashed = table(spark, folder, "documents").select("doc_id", "text", tx.content_hash(F.col("text")).alias("text_hash"))
    return src.dedup_docs(hashed, "doc_id").select("doc_id", "text_hash")


def rule_cases(spark, folder):
    return case_out(ops.rule_cases(docs(spark, folder)), "art_id")


def llm_cases(spark, folder):
    return case_out(ops.answer_cases(docs(spark, folder, True)), "art_id")


def llm_answer_parse(spark, folder):
    rows = derived.derive(spark, folder, derived.LLM_ANSWERS).withColumn("v", answers.parse_object(F.col("answer")))
    return rows.select("art_id", F.col("v").isNotNull().alias("parsed"), answers.is_usable(F.col("v")).alias("usable"))


def llm_requests(spark, folder):
    return docs(spark, folder).select("art_id", answers.extract_request(F.col("title"), F.col("text")).alias("request"))


def to_float(spark, folder):
    rows = derived.derive(spark, folder, derived.LLM_ANSWERS).withColumn("v", answers.parse_object(F.col("answer")))
    return rows.select(
        "art_id",
        answers._number(F.col("v"), "$.loss_amount").alias("loss"),
        answers._number(F.col("v"), "$.money_flow.amount").alias("amount"),
    )


def case_choose(spark, folder):
    return found_cases(spark, folder).select("art_id", "extraction_method", "fraud_type", "title", "summary")


# --- validation -----------------------------------------------------------


def validate_required(spark, folder):
    return validated(spark, folder).select("art_id", "accepted")


def validate_enum(spark, folder):
    raw = derived.derive(spark, folder, derived.LLM_ANSWERS).select(
        "art_id", answers._text(answers.parse_object(F.col("answer")), "$.fraud_type").alias("given")
    )
    return raw.select("art_id", checks.repair_type(F.col("given")).alias("fraud_type"))


def validate_amount(spark, folder):
    return validated(spark, folder).select("art_id", "loss_amount", F.col("money_flow.amount").alias("amount"))


def validate_date(spark, folder):
    day = F.lit(derived.AS_OF)
    return docs(spark, folder).select(
        "art_id", "publish_date", checks.parse_date(F.col("publish_date"), day).cast("string").alias("usable"),
        checks.parse_date(F.replace(F.col("publish_date"), F.lit("-15"), F.lit("-31")), day).cast("string").alias("usable_31"),
    )


def validate_pii(spark, folder):
    return validated(spark, folder).select(
        "art_id", "title", "scenario", "summary", joined("fraud_script").alias("script"), joined("key_risk_signals").alias("signals")
    )


def validate_grounding(spark, folder):
    share = checks.grounded_share(F.col("fraud_script"), F.col("text"))
    return found_cases(spark, folder).select("art_id", r4(share).alias("share"))


def grounding(spark, folder):
    """Every document's middle, cut and altered, against that document."""
    middle = F.substring(F.col("text"), 40, 30)
    changed = F.concat(F.lit("##"), F.substring(F.col("text"), 40, 5), F.lit("##"))
    return table(spark, folder, "documents").select(
        "doc_id",
        checks.grounded(middle, F.col("text")).alias("whole"),
        checks.grounded(F.concat(F.lit("###"), middle), F.col("text")).alias("piece"),
        checks.grounded(changed, F.col("text")).alias("changed"),
        checks.grounded(F.lit("  "), F.col("text")).alias("blank"),
    )


def validate_cases(spark, folder):
    return validated(spark, folder).select("art_id", "accepted", "confidence", joined("problems").alias("problems"))


# --- vectors --------------------------------------------------------------


def tokenize_bigrams(spark, folder):
    """Order-sensitive digest and count of the tokens of every text."""
    return texts(spark, folder).select("src", "id", vectors.tokens(F.col("text")).alias("t")).select(
        "src", "id", F.size("t").alias("n"), F.md5(joined("t")).alias("tokens")
    )


def hash_bucket(spark, folder):
    """Buckets of every event id for a width of 256, one of 100 and one of 1024."""
    token = F.col("event_id").cast("string")
    codes = {d: vectors.bucket_code(token, d) for d in (256, 100, 1024)}
    return table(spark, folder, "events").select(
        "event_id",
        *[F.shiftright(c, 1).alias(f"b{d}") for d, c in codes.items()],
        (codes[256] % 2).alias("plus"),
    )


def hash_embed(spark, folder):
    vec = busy(spark, folder, "documents", "doc_id", "text").select("doc_id", vectors.hash_vector(F.col("text"), OPTIONS.dim).alias("vec"))
    return vec.select("doc_id", F.md5(joined(F.col("vec").cast("array<string>"))).alias("vec"), vectors.norm2(F.col("vec")).alias("norm2"))


def embedding_text(spark, folder):
    return found_cases(spark, folder).select(
        "art_id",
        vectors.embedding_text(
            *[F.col(c) for c in ("fraud_type", "scenario", "summary", "fraud_script", "key_risk_signals")]
        ).alias("text"),
    )


def l2_normalize(spark, folder):
    unit = table(spark, folder, "embeddings").select("vec_id", vectors.l2_normalize(F.col("embedding")).alias("u"))
    return unit.select("vec_id", r4(F.element_at("u", 1)).alias("first"), r4(F.element_at("u", -1)).alias("last"),
                       r4(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x)).alias("length"))


def dense_topk(spark, folder):
    """Five nearest of every supplied vector, itself included."""
    vecs = busy(spark, folder, "embeddings", "vec_id", F.col("embedding").alias("vec"), "label")
    found = similar_topk(
        vecs.select("vec_id", "vec"), vecs.select(F.col("vec_id").alias("case_id"), "vec", "label"), 5, "vec_id", ["label"],
        TopKOptions(decimals=9), keep_vec=False,
    )
    return found.select("vec_id", _by_rank("similar")).select(
        "vec_id", (F.col("pos") + 1).alias("rank"), F.col("s.case_id").alias("near_id"), F.round("s.cosine", 6).alias("cosine")
    )


def similar_documents(spark, folder):
    """The nearest document of every conversation turn, by the route for large tables on both sides."""
    docs = busy(spark, folder, "documents", "doc_id", "text").select(F.col("doc_id").alias("case_id"), vectors.hash_vector(F.col("text"), OPTIONS.dim).alias("vec"))
    path = work_folder(spark, "document-vectors")
    docs.write.parquet(path)
    turns = busy(spark, folder, "conversations", "conv_id", "turn", "text").withColumn("vec", vectors.hash_vector(F.col("text"), OPTIONS.dim))
    found = similar_topk(turns, spark.read.schema(docs.schema).parquet(path), 1, "conv_id", [], TopKOptions(resident_bytes=0, block_rows=2048), keep_vec=False)
    return found.select("conv_id", "turn", F.posexplode("similar").alias("pos", "s")).select("conv_id", "turn", F.col("s.case_id").alias("doc_id"), F.round("s.cosine", 6).alias("cosine"))


def _similar(spark, folder, topk=TopKOptions(), info=det.RESULT_INFO):
    calls = derived.calls(spark, folder)
    return det.with_similar(calls, stored(spark, folder).read(), "utt_id", OPTIONS, topk, info=info)


def _by_rank(similar: Column | str) -> Column:
    """One row per similar case. Exploding a bare column would make the optimizer add a
    size filter on it and push that below the scorer, which would then run twice."""
    return F.posexplode(F.slice(similar, 1, OPTIONS.top_k)).alias("pos", "s")


def _ranked(found):
    return found.select("utt_id", _by_rank("similar")).select(
        "utt_id", (F.col("pos") + 1).alias("rank"), "s.case_id", F.round(F.greatest("s.cosine", F.lit(0.0)), 6).alias("similarity")
    )


def similar_topk_resident(spark, folder):
    return _ranked(_similar(spark, folder))


def similar_topk_partitioned(spark, folder):
    """The route for case tables beyond any executor, on the same data."""
    return _ranked(_similar(spark, folder, TopKOptions(resident_bytes=0, block_rows=512)))


def similar_top1(spark, folder):
    top = top_one(F.col("similar"))
    return _similar(spark, folder).select("utt_id", top.alias("t")).select("utt_id", F.round("t.similarity", 6).alias("similarity"), "t.fraud_type")


# --- detection ------------------------------------------------------------


def _assessed(spark, folder, judged=True):
    calls = derived.calls(spark, folder)
    judge = derived.derive(spark, folder, derived.JUDGE_ANSWERS) if judged else None
    return det.detect(calls, stored(spark, folder).read(), "utt_id", judge)


def judge_scores(spark, folder):
    rows = derived.derive(spark, folder, derived.JUDGE_ANSWERS)
    return rows.select("utt_id", answers.judge_fields(F.col("answer")).alias("j")).select(
        "utt_id", "j.score", "j.fraud_type", "j.reason"
    )


def judge_requests(spark, folder):
    return det.judge_requests(_similar(spark, folder, info=det.REQUEST_INFO)).select("utt_id", "request")


def risk_fusion(spark, folder):
    """Fused score of every call, from its phrases, its nearest case and its judge."""
    return _assessed(spark, folder).select("utt_id", F.col("risk_score").alias("score"))


def risk_level(spark, folder):
    return _assessed(spark, folder).select("utt_id", "risk_level")


def risk_type(spark, folder):
    return _assessed(spark, folder).select("utt_id", "fraud_type")


def detect_reason(spark, folder):
    return _assessed(spark, folder, judged=False).select("utt_id", "reason")


def detect_action(spark, folder):
    return _assessed(spark, folder, judged=False).select("utt_id", "suggested_action")


def detect_calls(spark, folder):
    return _result_out(_assessed(spark, folder))


def _result_out(results):
    return results.select(
        "utt_id", "risk_level", "risk_score", "fraud_type", joined("matched_signals").alias("matched_signals"),
        joined(F.transform("similar_cases", lambda c: c["case_id"])).alias("similar_cases"), "reason", "suggested_action",
    )


def detect_json(spark, folder):
    """Results written as JSON files and read back by their schema."""
    path = work_folder(spark, "results")
    results = _assessed(spark, folder).drop("ts", "text", "call_id")
    det.write_json(results, path)
    return _result_out(det.read_json(results, path))


def transcript_valid(spark, folder):
    """All turns, and as many blank ones beside them."""
    said = table(spark, folder, "conversations").select("conv_id", "turn", "text")
    turns = said.unionByName(said.select("conv_id", (-1 - F.col("turn")).alias("turn"), F.lit(" \t\n").alias("text")))
    valid, blank = det.valid_transcripts(turns)
    return valid.select("conv_id", "turn", F.lit(True).alias("valid")).unionByName(
        blank.select("conv_id", "turn", F.lit(False).alias("valid"))
    )


def ingest_cases(spark, folder):
    read = fresh_store(spark, folder).read()
    return case_out(read, "norm2", F.md5(joined(F.col("vec").cast("array<string>"))).alias("vec"))


# --- streams --------------------------------------------------------------


def _stream_of(spark: SparkSession, df: DataFrame, purpose: str) -> DataFrame:
    """Utterances as a file stream, closed by one row per run far in the future.

    The last row moves the watermark past every real window; its own window stays open
    and never leaves the stream. It is a file of its own, read after the data.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.ROCKSDB)
    path = work_folder(spark, purpose)
    df.select("call_id", "utt_id", "ts", "text").write.parquet(path)
    flush = spark.sql(
        "select -1L as call_id, -1L as utt_id, cast(timestamp_ntz '2100-01-01 00:00:00' as timestamp) as ts, '' as text"
    )
    flush.write.mode("append").parquet(path)
    return spark.readStream.schema("call_id bigint, utt_id bigint, ts timestamp, text string").parquet(path)


def stream_windows(spark, folder):
    """Run as a stream over the conversations with 10 s windows every 5 s."""
    stream = _stream_of(spark, derived.utterances(spark, folder), "utterances")
    out, mark = work_folder(spark, "windows"), work_folder(spark, "windows-checkpoint")
    live.run_to_table(live.transcript_windows(stream, late="10 seconds"), out, mark)
    done = spark.read.schema("call_id bigint, window_start timestamp, window_end timestamp, text string").parquet(out)
    return done.select("call_id", stamp("window_start"), stamp("window_end"), F.md5("text").alias("text"))


def stream_windows_panes(spark, folder):
    """Run as a stream with 60 s windows every 5 s: twelve windows a piece, which lies in the state once."""
    stream = _stream_of(spark, derived.utterances(spark, folder), "utterances")
    out, mark = work_folder(spark, "windows"), work_folder(spark, "windows-checkpoint")
    live.run_to_table(live.transcript_windows(stream, "60 seconds", "5 seconds", late="60 seconds"), out, mark)
    done = spark.read.schema("call_id bigint, window_start timestamp, window_end timestamp, text string").parquet(out)
    return done.select("call_id", stamp("window_start"), stamp("window_end"), F.md5("text").alias("text"))


def table_windows(spark, folder):
    """The same windows over the table of utterances, put together from panes."""
    done = live.transcript_windows(derived.utterances(spark, folder))
    return done.select("call_id", stamp("window_start"), stamp("window_end"), F.md5("text").alias("text"))


def _call_windows(spark, folder):
    return live.transcript_windows(derived.calls(spark, folder), WINDOW, SLIDE)


def stream_detect(spark, folder):
    """Windows of the calls scored inside the stream against a snapshot of the case table."""
    cases = stored(spark, folder).read()
    stream = _stream_of(spark, derived.calls(spark, folder), "calls")
    scored = live.score_windows(live.transcript_windows(stream, WINDOW, SLIDE, late=WINDOW), cases)
    out, mark = work_folder(spark, "scored"), work_folder(spark, "scored-checkpoint")
    keep = scored.select("call_id", "window_start", "risk_level", "risk_score", "fraud_type")
    live.run_to_table(keep, out, mark)
    done = spark.read.schema(keep.schema).parquet(out)
    return done.select("call_id", stamp("window_start"), "risk_level", "risk_score", "fraud_type")


#: Takes the route for case tables beyond any executor.
BEYOND = TopKOptions(resident_bytes=0, block_rows=256)


def stream_detect_partitioned(spark, folder):
    """The same windows, scored one micro-batch at a time against a case table beyond the bound."""
    stream = _stream_of(spark, derived.calls(spark, folder), "calls")
    windows = live.transcript_windows(stream, WINDOW, SLIDE, late=WINDOW)
    done = live.score_stream(windows, stored(spark, folder).read(), work_folder(spark, "scored"), work_folder(spark, "scored-checkpoint"), topk=BEYOND)
    return done.select("call_id", stamp("window_start"), "risk_level", "risk_score", "fraud_type")


def risk_escalation_partitioned(spark, folder):
    return risk_escalation(spark, folder, BEYOND)


def risk_escalation(spark, folder, topk=TopKOptions()):
    """Alerts over the scored windows, kept as a table because they are read twice."""
    path = work_folder(spark, "scored-windows")
    scored = live.score_windows(_call_windows(spark, folder), stored(spark, folder).read(), topk=topk).select(*live.ALERT_COLUMNS)
    scored.write.parquet(path)
    return alerts.rises(spark.read.schema(live.ALERT).parquet(path), "call_id", "window_start", "window_end", "risk_level").select(
        "call_id", stamp("window_start"), "risk_level", "fraud_type"
    )


def stream_alerts(spark, folder):
    """Windows, scores and alerts chained in one streaming query."""
    cases = stored(spark, folder).read()
    stream = _stream_of(spark, derived.calls(spark, folder), "calls")
    scored = live.score_windows(live.transcript_windows(stream, WINDOW, SLIDE, late=WINDOW), cases)
    out, mark = work_folder(spark, "alerts"), work_folder(spark, "alerts-checkpoint")
    live.run_to_table(live.rise_alerts(scored), out, mark)
    done = spark.read.schema(live.ALERT).parquet(out)
    return done.select("call_id", stamp("window_start"), "risk_level", "fraud_type")


def stream_alerts_partitioned(spark, folder, parts=3):
    """Alerts of the calls by the two-stage stream, against a case table beyond the bound.

    The calls arrive in `parts` pieces of time; after each, the stream is started anew and goes on.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.ROCKSDB)
    cases, calls = stored(spark, folder).read(), derived.calls(spark, folder).select("call_id", "utt_id", "ts", "text")
    first, last = calls.agg(F.min("ts"), F.max("ts")).first()
    source, out = work_folder(spark, "calls"), work_folder(spark, "alerts")
    flush = spark.sql("select -1L as call_id, -1L as utt_id, cast(timestamp_ntz '2100-01-01 00:00:00' as timestamp) as ts, '' as text")
    for i in range(parts + 1):
        edge = lambda k: F.lit(first) + F.expr(f"interval {k} seconds")
        step = int((last - first).total_seconds()) // parts + 1 if first else 1
        piece = calls.where((F.col("ts") >= edge(i * step)) & (F.col("ts") < edge((i + 1) * step))) if i < parts else flush
        piece.write.mode("append").parquet(source)
        stream = spark.readStream.schema("call_id bigint, utt_id bigint, ts timestamp, text string").parquet(source)
        done = live.alert_stream(live.transcript_windows(stream, WINDOW, SLIDE, late=WINDOW), cases, out, BEYOND)
    return done.select("call_id", stamp("window_start"), "risk_level", "fraud_type")


QUERIES = {
    "src_articles": src_articles,
    "src_articles_order": src_articles_order,
    "src_seed_sources": src_seed_sources,
    "pages_to_docs": pages_to_docs,
    "case_upsert": case_upsert,
    "doc_source_name": doc_source_name,
    "case_lookup": case_lookup,
    "case_scan": case_scan,
    "detect_json": detect_json,
    "page_title": page_title,
    "page_date": page_date,
    "page_denoise": page_denoise,
    "page_main_container": page_main_container,
    "page_text": page_text,
    "doc_min_length": doc_min_length,
    "page_text_coalesce": page_text_coalesce,
    "pii_redact": _redacted(None),
    **{f"pii_redact_{kind}": _redacted([kind]) for kind in pii.KINDS},
    "pii_scan": pii_scan,
    "doc_allowlist": doc_allowlist,
    "phrase_hits": phrase_hits,
    "phrase_hits_join": phrase_hits_join,
    "generic_hits": generic_hits,
    "type_info_join": type_info_join,
    "case_choose": case_choose,
    "case_new_only": case_new_only,
    "similar_topk": similar_topk_resident,
    "similar_topk_partitioned": similar_topk_partitioned,
    "detect_action": detect_action,
    "classify_type": classify_type,
    "rule_score": rule_score,
    "matched_signals": matched_signals,
    "extract_amount": _art(amount=facts.max_amount, amounts=lambda t: joined(facts.amounts(t).cast("array<bigint>"))),
    "validate_grounding": validate_grounding,
    "case_count": case_count,
    "stats_by_type": stats_by_type,
    "ingest_summary": ingest_summary,
    "ingest_new_cases": ingest_new_cases,
    "hash_embed": hash_embed,
    "doc_dedup": doc_dedup,
    "case_replace": case_replace,
    "stats_after_replace": stats_after_replace,
    "similar_top1": similar_top1,
    "key_risk_signals": key_risk_signals,
    "l2_normalize": l2_normalize,
    "dense_topk": dense_topk,
    "content_hash": content_hash,
    "extract_quotes": extract_quotes,
    "extract_age": _art(age_group=facts.age_group),
    "extract_payment": _art(payment_method=facts.payment_method),
    "extract_summary": extract_summary,
    "rule_cases": rule_cases,
    "llm_cases": llm_cases,
    "to_float": to_float,
    "llm_answer_parse": llm_answer_parse,
    "llm_requests": llm_requests,
    "judge_requests": judge_requests,
    "judge_scores": judge_scores,
    "validate_required": validate_required,
    "validate_enum": validate_enum,
    "validate_amount": validate_amount,
    "validate_date": validate_date,
    "validate_pii": validate_pii,
    "grounding": grounding,
    "validate_cases": validate_cases,
    "embedding_text": embedding_text,
    "tokenize_bigrams": tokenize_bigrams,
    "hash_bucket": hash_bucket,
    "risk_fusion": risk_fusion,
    "risk_level": risk_level,
    "risk_type": risk_type,
    "detect_reason": detect_reason,
    "transcript_valid": transcript_valid,
    "detect_calls": detect_calls,
    "ingest_cases": ingest_cases,
    "case_provenance": case_provenance,
    "stream_windows": stream_windows,
    "table_windows": table_windows,
    "stream_windows_panes": stream_windows_panes,
    "stream_detect": stream_detect,
    "risk_escalation": risk_escalation,
    "stream_alerts": stream_alerts,
    "stream_detect_partitioned": stream_detect_partitioned,
    "risk_escalation_partitioned": risk_escalation_partitioned,
    "stream_alerts_partitioned": stream_alerts_partitioned,
    "similar_documents": similar_documents,
}
