"""The queries again as plain SQL for DuckDB, written apart from the Spark code.

Regular expressions are RE2 here: no look-around, so borders are captured and the
replacement runs twice, because neighbours share a border.
"""

from __future__ import annotations

from riskloom import lexicon as lx
from riskloom.functions import answers, scoring
from riskloom.plans import derived
from riskloom.sources.articles import DEFAULT_SOURCE

NL = "chr(10)"


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]::varchar[]"


def view(v) -> str:
    table, columns = v
    body = ", ".join(f"{e.replace('as string', 'as varchar')} as {n}" for n, e in columns.items())
    return f"select {body} from {table}"


def values(rows, columns: str) -> str:
    body = ", ".join("(" + ", ".join(q(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    return f"select * from (values {body}) v({columns})"


# --- scalar texts ---------------------------------------------------------

D = "[0-9]"
CORE = {
    "id": rf"{D}{{17}}[0-9Xx]|{D}{{15}}",
    "phone": rf"(?:\+?86[-\s]?)?1[3-9]{D}[-\s]?{D}{{4}}[-\s]?{D}{{4}}",
    "landline": rf"0{D}{{2,3}}-{D}{{7,8}}",
    "bank": rf"{D}{{13,19}}",
}
MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
NAME = r"[一-龥](?:某某|某|[Xx×]{1,2})([\s\S])"
PLACE = {"id": "[身份证号]", "phone": "[手机号]", "landline": "[固定电话]", "bank": "[银行卡号]"}


def redact(x: str, kinds=("id", "phone", "landline", "bank", "email", "name")) -> str:
    for kind in kinds:
        if kind == "email":
            x = f"regexp_replace({x}, '{MAIL}', '[邮箱]', 'g')"
            continue
        if kind == "name":
            pattern, new = NAME, r"[当事人]\1"
        else:
            pattern, new = rf"(^|[^0-9])(?:{CORE[kind]})($|[^0-9])", rf"\1{PLACE[kind]}\2"
        for _ in range(2):
            x = f"regexp_replace({x}, '{pattern}', '{new}', 'g')"
    return x


def scan_list(x: str) -> str:
    def has(kind):
        return f"regexp_matches({x}, '(^|[^0-9])(?:{CORE[kind]})($|[^0-9])')"

    return (
        f"list_filter([case when {has('id')} then '身份证号' end, case when {has('phone')} then '手机号' end,"
        f" case when {has('bank')} then '银行卡号' end, case when regexp_matches({x}, '{MAIL}') then '邮箱' end],"
        " lambda k: k is not null)"
    )


def strip(x: str) -> str:
    space = r"[\s\x{a0}\x{3000}\x{2000}-\x{200a}\x{2028}\x{2029}\x{85}]+"
    return f"regexp_replace(regexp_replace({x}, '^{space}', ''), '{space}$', '')"


def first_of(x: str, pairs) -> str:
    return "case " + " ".join(f"when contains({x}, {q(m)}) then {q(v)}" for m, v in pairs) + " end"


def distinct_in_order(x: str) -> str:
    return f"list_filter({x}, lambda w, i: list_position({x}, w) = i)"


def joined(x: str) -> str:
    return f"array_to_string({x}, '|')"


AMOUNT = r"(\d+(?:[.,]\d+)?)\s*(万余?元|万|余?元)"
QUOTE = '[“"]([^”"]{4,60})[”"]'


def amounts(x: str) -> str:
    n, u = f"regexp_extract_all({x}, '{AMOUNT}', 1)", f"regexp_extract_all({x}, '{AMOUNT}', 2)"
    return (
        f"list_transform(range(1, len({n}) + 1), lambda i: replace(({n})[i], ',', '')::double"
        f" * case when contains(({u})[i], '万') then 10000 else 1 end)"
    )


def grounded(s: str, text: str) -> str:
    t = strip(s)
    return (
        f"({t} <> '' and (contains({text}, {t}) or len(list_filter(range(0, greatest(length({t}) - 5, 1), 3),"
        f" lambda i: contains({text}, substr({t}, (i + 1)::bigint, 6)))) > 0))"
    )


def r3(x: str) -> str:
    """Round half up on the shortest decimal form of the double."""
    return f"round(cast(cast({x} as varchar) as decimal(38, 20)), 3)::double"


# --- shared tables --------------------------------------------------------

LEX = values(
    [(t, r, i, k) for r, (t, ks) in enumerate(lx.KEYWORDS.items()) for i, k in enumerate(ks)],
    "fraud_type, type_rank, kw_rank, kw",
)
GENERIC = values(list(enumerate(lx.GENERIC_PHRASES)), "rank, phrase")
INFO = "select * from (values " + ", ".join(
    f"({q(t)}, {lst(lx.RISK_SIGNALS[t])}, {q(lx.WARNINGS[t])})" for t in lx.KEYWORDS
) + ") v(fraud_type, risk_signals, warning)"
LABELS = ", ".join(q(t) for t in [*lx.KEYWORDS, lx.OTHER])

HOST = "regexp_extract(url, '^[^:]+://([^/?#]*)', 1)"

TABLES: dict[str, str] = {
    "calls_syn": view(derived.CALLS),
    "articles_syn": view(("customer", {**derived.ARTICLES[1], "answer": derived.LLM_ANSWERS[1]["answer"]})),
    "judge_syn": view(derived.JUDGE_ANSWERS),
    "pii_syn": view(derived.PERSONAL),
    "texts": "select 'doc' as src, doc_id as id, text from documents union all select 'art', art_id, text from articles_syn"
    " union all select 'call', utt_id, text from calls_syn union all select 'pii', id, text from pii_syn",
    "phrase_texts": "select 'call' as src, utt_id as id, text from calls_syn union all"
    f" select 'art', art_id, title || {NL} || text from articles_syn",
    "lex": LEX,
    "generic": GENERIC,
    "info": INFO,
}


def hits(prefix: str, source: str) -> dict[str, str]:
    """Phrase tables of a (src, id, text) source."""
    p = prefix
    return {
        f"{p}_hit": f"select t.src, t.id, l.* from {source} t join lex l on contains(t.text, l.kw)",
        f"{p}_type": f"select src, id, fraud_type, type_rank, count(*) as n, list(kw order by kw_rank) as kws from {p}_hit group by all",
        f"{p}_best": f"select * from {p}_type qualify row_number() over (partition by src, id order by n desc, type_rank) = 1",
        f"{p}_gen": f"select t.src, t.id, count(*) as g, list(phrase order by rank) as phrases from {source} t join generic on contains(t.text, phrase) group by all",
        f"{p}_word": f"select src, id, kw as word, type_rank * 100 + kw_rank as ord from {p}_hit union all"
        f" select t.src, t.id, phrase, 100000 + rank from {source} t join generic on contains(t.text, phrase)",
        f"{p}_sig": "select src, id, list(word order by ord) as signals from"
        f" (select src, id, word, min(ord) as ord from {p}_word group by all) group by all",
        f"{p}_rule": "select t.src, t.id, t.text, least(coalesce(b.n, 0) * 0.15::double + coalesce(g.g, 0) * 0.25::double, 1.0::double) as score,"
        f" b.fraud_type, coalesce(s.signals, []) as signals from {source} t left join {p}_best b using (src, id)"
        f" left join {p}_gen g using (src, id) left join {p}_sig s using (src, id)",
    }


TABLES |= hits("ph", "phrase_texts")

# --- documents and cases --------------------------------------------------

TABLES["docs0"] = (
    f"select art_id, url, {redact('title')} as title, {redact('text')} as text, publish_date, answer, {HOST} as source_name"
    " from articles_syn"
)
TABLES["docs"] = f"select *, sha256(text) as text_hash, title || {NL} || text as whole from docs0"
TABLES["doc_src"] = "select 'd' as src, art_id as id, whole as text from docs"
TABLES |= hits("dh", "doc_src")
SIGNALS = "list_concat(i.risk_signals, b.kws)"
TABLES["rule_c"] = f"""
select d.art_id, coalesce(nullif(d.title, ''), b.fraud_type || '案例') as title, b.fraud_type,
 replace(substr(d.text, 1, 120), {NL}, ' ') as scenario, {first_of('d.whole', lx.AGE_MARKERS)} as age_group,
 null::varchar as gender, regexp_extract_all(d.text, '{QUOTE}', 1)[1:8] as fraud_script,
 ({distinct_in_order(SIGNALS)})[1:10] as key_risk_signals,
 {first_of('d.whole', [(t, t) for t in lx.PAYMENT_TERMS])} as payment_method,
 list_max({amounts('d.whole')}) as amount, list_max({amounts('d.whole')}) as loss_amount,
 replace(substr(d.text, 1, 120), {NL}, ' ') as summary, i.warning as recommended_warning,
 round(0.3::double + 0.4::double * least(b.n / 4.0::double, 1.0::double), 2) as confidence, 'rule' as extraction_method
from docs d join dh_best b on b.id = d.art_id join info i on i.fraud_type = b.fraud_type where b.n >= 2
"""
TABLES["ans"] = (
    "select art_id, case when json_valid(answer) and json_type(case when json_valid(answer) then answer else '0' end) = 'OBJECT'"
    " then answer::json end as j from docs"
)


def strings(path: str) -> str:
    return (
        f"list_transform(list_filter(json_extract(a.j, '{path}[*]'), lambda x: json_type(x) = 'VARCHAR'),"
        " lambda x: x->>'$')"
    )


TABLES["llm_c"] = f"""
select d.art_id, coalesce(nullif(a.j->>'$.title', ''), d.title) as title,
 case when a.j->>'$.fraud_type' in ({LABELS}) then a.j->>'$.fraud_type' else '{lx.OTHER}' end as fraud_type,
 coalesce(a.j->>'$.scenario', '') as scenario, a.j->>'$.victim_profile.age_group' as age_group,
 a.j->>'$.victim_profile.gender' as gender, {strings('$.fraud_script')} as fraud_script,
 {strings('$.key_risk_signals')} as key_risk_signals, a.j->>'$.money_flow.payment_method' as payment_method,
 try_cast(a.j->>'$.money_flow.amount' as double) as amount, try_cast(a.j->>'$.loss_amount' as double) as loss_amount,
 coalesce(a.j->>'$.summary', '') as summary, coalesce(a.j->>'$.recommended_warning', '') as recommended_warning,
 coalesce(nullif(try_cast(a.j->>'$.confidence' as double), 0), 0.5) as confidence, 'llm' as extraction_method
from docs d join ans a using (art_id) where a.j->>'$.is_fraud_case' in ('true', '1')
"""
TABLES["chosen"] = (
    "select c.*, d.url, d.source_name, d.publish_date, d.text, d.text_hash, substr(sha256(d.text_hash || '|' || d.url), 1, 32) as case_id"
    " from (select * from llm_c union all select * from rule_c where art_id not in (select art_id from llm_c)) c join docs d using (art_id)"
)
TABLES["rule_out"] = (
    "select c.*, d.url, d.source_name, d.publish_date, d.text, d.text_hash, substr(sha256(d.text_hash || '|' || d.url), 1, 32) as case_id"
    " from rule_c c join docs d using (art_id)"
)
TABLES["llm_out"] = TABLES["rule_out"].replace("rule_c", "llm_c")
SHARE = f"len(list_filter(script, lambda s: {grounded('s', 'text')})) / len(script)::double"
TABLES["checked0"] = (
    f"select *, list_transform(fraud_script, lambda s: {redact('s')}) as script,"
    f" list_transform(key_risk_signals, lambda s: {redact('s')}) as signals,"
    f" case when publish_date[1:10] >= '2000' and try_cast(publish_date[1:10] as date) <= date '{derived.AS_OF}'"
    " then try_cast(publish_date[1:10] as date) end as day, (summary <> '' or scenario <> '') as accepted from chosen"
)
TABLES["checked"] = f"""
select *, extraction_method = 'llm' and len(script) > 0 and {SHARE} < 0.3 as weak,
 loss_amount is not null and not (loss_amount > 0 and loss_amount < 1e9) as bad_loss,
 amount is not null and not (amount > 0 and amount < 1e9) as bad_amount,
 len({scan_list('title')}) > 0 as pii_title, len({scan_list('scenario')}) > 0 as pii_scenario, len({scan_list('summary')}) > 0 as pii_summary
from checked0
"""
TABLES["valid"] = f"""
select art_id, case_id, url, source_name, text, text_hash, extraction_method, accepted, fraud_type, age_group, gender, payment_method, recommended_warning,
 case when pii_title then {redact('title')} else title end as title,
 case when pii_scenario then {redact('scenario')} else scenario end as scenario,
 case when pii_summary then {redact('summary')} else summary end as summary,
 script as fraud_script, signals as key_risk_signals, case when not bad_loss then loss_amount end as loss_amount,
 case when not bad_amount then amount end as amount, day as publish_date, case when weak then least(confidence, 0.4) else confidence end as confidence,
 case when not accepted then 'summary_missing' else array_to_string(list_filter([
  case when bad_loss then 'amount_out_of_range:loss_amount' end, case when bad_amount then 'amount_out_of_range:money_flow.amount' end,
  case when publish_date <> '' and day is null then 'date_unusable' end, case when pii_title then 'pii_left:title' end,
  case when pii_scenario then 'pii_left:scenario' end, case when pii_summary then 'pii_left:summary' end,
  case when weak then 'script_not_in_text' end], lambda p: p is not null), '|') end as problems
from checked
"""
TABLES["cases"] = "select * from valid where accepted qualify row_number() over (partition by text_hash order by art_id) = 1"
EMBED = f"array_to_string(list_filter(list_concat([fraud_type, scenario, summary], fraud_script, key_risk_signals), lambda p: p <> ''), {NL})"


def vectors(prefix: str, source: str) -> dict[str, str]:
    """Dense count vectors of an (id, text) source."""
    p = prefix
    return {
        f"{p}_unit": f"select id, regexp_extract_all(lower(text), '[一-龥]|[A-Za-z0-9]+') as u from {source}",
        f"{p}_tok": f"select id, unnest(list_concat(u, list_transform(range(1, len(u)), lambda i: u[i] || u[i + 1]))) as t from {p}_unit",
        f"{p}_cnt": "select id, ('0x' || substr(md5(t), 1, 2))::int as b, sum(case when substr(md5(t), 15, 1) >= '8' then 1 else -1 end)::int as s"
        f" from {p}_tok group by all",
        f"{p}_vec": f"select id, list(coalesce(s, 0) order by b) as vec, sum(coalesce(s, 0) * coalesce(s, 0))::bigint as norm2 from"
        f" (select id, range as b from {source}, range(256)) left join {p}_cnt using (id, b) group by id",
    }


TABLES["case_src"] = f"select case_id as id, {EMBED} as text from cases"
TABLES |= vectors("cv", "case_src")
TABLES["call_src"] = "select distinct text as id, text from calls_syn"
TABLES |= vectors("qv", "call_src")
TABLES["ranked"] = """
select text, case_id, cosine, row_number() over (partition by text order by cosine desc, case_id) as rank from
 (select q.id as text, c.id as case_id, case when q.norm2 * c.norm2 > 0
   then list_dot_product(q.vec::double[], c.vec::double[]) / sqrt((q.norm2 * c.norm2)::double) else 0 end as cosine
  from qv_vec q, cv_vec c) qualify rank <= 5
"""
TABLES["near"] = (
    "select r.*, c.title, c.fraud_type, c.summary, c.key_risk_signals, c.recommended_warning from ranked r join cases c using (case_id)"
)
TABLES["top1"] = "select text, greatest(cosine, 0) as sim, fraud_type as sim_type, title as sim_title from near where rank = 1"
TABLES["judged0"] = (
    "select utt_id, case when json_valid(answer) and answer <> '{}' then answer::json end as j from judge_syn"
)
TABLES["judged"] = """
select utt_id, case when s is not null then greatest(0, least(s, 1)) end as score, case when s is not null then j->>'$.fraud_type' end as fraud_type,
 case when s is not null then coalesce(j->>'$.reason', '') end as reason from
 (select utt_id, j, case when j is null then null when json_type(j, '$.score') is null then 0.0 when json_type(j, '$.score') = 'BOOLEAN' then (j->>'$.score' = 'true')::int::double else try_cast(j->>'$.score' as double) end as s from judged0)
"""


def assessed(judge: str) -> dict[str, str]:
    """Result tables with (judge = 'judged') or without a judge."""
    j = judge if judge == "judged" else "(select null::bigint as utt_id, null::double as score, null::varchar as fraud_type, null::varchar as reason)"
    base = f"0.45::double * r.score + 0.35::double * t.sim"
    return {
        "scored": f"""
select c.utt_id, c.text, r.signals, t.sim, t.sim_title, j.reason as judge_reason,
 case when j.score is not null then {base} + 0.2::double * j.score else ({base}) / 0.8::double end as raw_score,
 coalesce(nullif(j.fraud_type, ''), r.fraud_type, case when t.sim > 0.35 then t.sim_type end) as fraud_type
from calls_syn c join ph_rule r on r.src = 'call' and r.id = c.utt_id join top1 t on t.text = c.text left join {j} j on j.utt_id = c.utt_id
""",
        "levelled": "select *, case when raw_score >= 0.7 then 'high' when raw_score >= 0.4 then 'medium' else 'low' end as risk_level from scored",
        "results": f"""
select l.utt_id, risk_level, {r3('raw_score')} as risk_score, l.fraud_type, {joined('signals')} as matched_signals,
 (select string_agg(case_id, '|' order by rank) from ranked n where n.text = l.text) as similar_cases,
 coalesce(nullif(judge_reason, ''), case when risk_level = 'low' then {q(scoring.TEXT_LOW_REASON)} else
  concat_ws('；', '类型=' || nullif(l.fraud_type, ''),
   case when len(signals) > 0 then '词语=' || array_to_string(signals[1:6], '、') end,
   case when sim > 0.3 then '近例=' || sim_title end) || '。' end) as reason,
 case risk_level when 'high' then {q(scoring.TEXT_HIGH_ADVICE)} || coalesce((select arg_min(recommended_warning, rank) from near n
   where n.text = l.text and n.fraud_type = l.fraud_type and recommended_warning <> ''), '')
  when 'medium' then {q(scoring.TEXT_MEDIUM_ADVICE)} else {q(scoring.TEXT_LOW_ADVICE)} end as suggested_action
from levelled l
""",
    }


# --- pages ----------------------------------------------------------------

ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&amp;", "&")]


def decode(x: str) -> str:
    for name, char in ENTITIES:
        x = f"replace({x}, {q(name)}, {q(char)})"
    return x


def nodes(x: str) -> str:
    return (
        f"list_filter(list_transform(regexp_split_to_array({x}, '<[/!?a-zA-Z][^>]*>'), lambda p: {strip(decode('p'))}),"
        " lambda p: p <> '')"
    )


def drop(x: str, names) -> str:
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', '', 'g')"
    for name in names:
        x = rf"regexp_replace({x}, '(?is)<{name}[\s/>].*?</{name}\s*>', '', 'g')"
    return x


NOISE = ["script", "style", "nav", "header", "footer", "aside", "form", "iframe"]
BLOCK = r"article|main|div|section|p|h[1-6]|ul|ol|dl|table|blockquote|pre|hr|address"


def element(x: str, name: str) -> str:
    return f"array_to_string({nodes(rf'''regexp_extract({x}, '(?is)<{name}(?:|[\s/][^>]*)>(.*?)</{name}\s*>', 1)''')}, '')"


def page_date(x: str) -> str:
    text = f"array_to_string({nodes(drop(x, ['script', 'style']))}, ' ')[1:2000]"
    pattern = r"(20\d{2})[-年/.](\d{1,2})[-月/.](\d{1,2})"
    part = [f"regexp_extract({text}, '{pattern}', {i})" for i in (1, 2, 3)]
    return f"case when {part[0]} <> '' then {part[0]} || '-' || lpad({part[1]}, 2, '0') || '-' || lpad({part[2]}, 2, '0') end"


def paged(source: str) -> dict[str, str]:
    clean = drop("html", NOISE)
    return {
        "pieces": f"select page_id, unnest(parts) as piece, generate_subscripts(parts, 1) as pos from (select page_id,"
        rf" string_split(regexp_replace({clean}, '(?i)<(/?(?:{BLOCK})[\s/>])', chr(1) || '<\1', 'g'), chr(1)) as parts from {source})",
        "blocks": "select page_id, pos, case when pos = 1 then '' else lower(regexp_extract(piece, '^<(/?[a-zA-Z0-9]+)', 1)) end as tag,"
        " case when pos = 1 then piece else regexp_replace(piece, '^<[^>]*>', '') end as body from pieces",
        "depths": "select *, sum(case when tag in ('article', 'main', 'div', 'section') then 1 when tag in ('/article', '/main', '/div', '/section') then -1 else 0 end)"
        f" over (partition by page_id order by pos) as depth, {nodes('body')} as parts from blocks",
        "owned": "select *, max(case when tag in ('article', 'main', 'div', 'section') then pos end) over (partition by page_id, depth order by pos) as home from depths",
        "sums": "select page_id, home, depth, sum(length(array_to_string(parts, ''))) as chars from owned where tag = 'p' and depth > 0 group by all",
        "best": "select page_id, arg_max(home, (chars, -home)) as start, arg_max(depth, (chars, -home)) as depth, max(chars) as chars from sums where chars > 0 group by page_id",
        "span": "select b.*, coalesce(min(d.pos), 1000000000) as stop from best b left join depths d on d.page_id = b.page_id and d.pos > b.start and d.depth < b.depth group by all",
        "kept": "select d.* from depths d left join span s using (page_id) where coalesce(s.chars, 0) <= 100 or (d.pos >= s.start and d.pos < s.stop)",
        "page_texts": f"select page_id, coalesce(nullif(string_agg(case when tag = 'p' and length(array_to_string(parts, ' ')) > 10 then array_to_string(parts, ' ') end, {NL} order by pos), ''),"
        f" string_agg(nullif(array_to_string(parts, {NL}), ''), {NL} order by pos), '') as text from kept group by page_id",
    }


TABLES |= paged("pages")
TABLES["seed_all"] = (
    "select page_id as pos, url, case when contains("
    + HOST + f", 'example.com') then '' else '源-' || {HOST} end as source_name from pages"
)
TABLES["seed_list"] = "select * from seed_all where url like 'https%'"
TABLES["seed_names"] = "select url, arg_max(source_name, pos) as name from seed_list group by url"
TITLE = (
    "coalesce(nullif(" + element(drop("html", ["script", "style"]), "h1") + ", ''), "
    + element(drop("html", ["script", "style"]), "title") + ")"
)
DATED = "replace(html, '<article>', '<p>发布于 20' || lpad((page_id % 40)::varchar, 2, '0') || '年' || (page_id % 13)::varchar || '月' || (page_id % 32)::varchar || '日</p><article>')"
TABLES["page_docs"] = f"""
select page_id, p.url, coalesce(s.name, {HOST.replace('url', 'p.url')}) as source_name, {redact(TITLE)} as title,
 {page_date('html')} as publish_date, {redact('t.text')} as text
from pages p join page_texts t using (page_id) left join seed_names s on s.url = p.url
where p.url in (select url from seed_list) and length(t.text) >= 80
"""

# --- windows --------------------------------------------------------------


def windows(source: str, ts: str, slide: str, size_in_slides: int) -> str:
    return (
        f"select call_id, w as window_start, w + {size_in_slides} * interval '{slide}' as window_end, string_agg(text, '' order by {ts}, utt_id) as text from"
        f" (select *, time_bucket(interval '{slide}', {ts}, timestamp '2000-01-01') - k.range * interval '{slide}' as w from {source}, range({size_in_slides}) k) group by all"
    )


TABLES["turns"] = (
    "select conv_id as call_id, turn as utt_id, timestamp '2024-01-01 00:00:00' + to_seconds(conv_id * 60 + turn * 3) as ts, text from conversations"
)
STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S') as {0}"


def windowed() -> dict[str, str]:
    """Scores of the two-hour windows of the calls. Replaces the call source of the rule and vector tables."""
    out = {"win": windows("calls_syn", "ts", "1 hour", 2), "win_src": "select 'w' as src, text as id, text from (select distinct text from win)"}
    out |= hits("wh", "win_src")
    out["win_id"] = "select id, text from win_src"
    out |= vectors("wv", "win_id")
    out["wtop"] = """
select k.text, greatest(cosine, 0) as sim, fraud_type as sim_type from (select q.id as text, c.id as case_id, case when q.norm2 * c.norm2 > 0
   then list_dot_product(q.vec::double[], c.vec::double[]) / sqrt((q.norm2 * c.norm2)::double) else 0 end as cosine
  from wv_vec q, cv_vec c qualify row_number() over (partition by text order by cosine desc, case_id) = 1) k join cases using (case_id)
"""
    out["wscore"] = """
select w.call_id, w.window_start, (0.45::double * r.score + 0.35::double * t.sim) / 0.8::double as raw_score,
 coalesce(r.fraud_type, case when t.sim > 0.35 then t.sim_type end) as fraud_type
from win w join wh_rule r on r.id = w.text join wtop t on t.text = w.text
"""
    out["wlevel"] = "select *, case when raw_score >= 0.7 then 'high' when raw_score >= 0.4 then 'medium' else 'low' end as risk_level from wscore"
    out["walert"] = (
        "select * from (select *, case risk_level when 'high' then 2 when 'medium' then 1 else 0 end as lv,"
        " case when epoch_ms(window_start) - lag(epoch_ms(window_start) + 7200000) over calls <= 21600000 then lag(lv) over calls else 0 end as before"
        " from wlevel window calls as (partition by call_id order by window_start)) where lv >= 1 and lv > before"
    )
    return out


# --- assembly -------------------------------------------------------------


def sql(final: str, extra: dict[str, str] | None = None) -> str:
    """Prefix the shared tables a query needs, each as a materialised step."""
    import re

    tables = {**TABLES, **(extra or {})}
    need: list[str] = []

    def visit(text: str) -> None:
        for name in tables:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.append(name)
                visit(tables[name])

    visit(final)
    order: list[str] = []

    def place(name: str) -> None:
        for other in need:
            if other != name and other not in order and re.search(rf"\b{other}\b", tables[name]):
                place(other)
        if name not in order:
            order.append(name)

    for name in need:
        place(name)
    steps = ",\n".join(f"{n} as materialized ({tables[n]})" for n in order)
    return (f"with {steps}\n" if steps else "") + final


CASE_OUT = (
    "case_id, title, url as source_url, source_name, publish_date::varchar as publish_date, fraud_type, scenario, age_group, gender,"
    f" {joined('fraud_script')} as fraud_script, {joined('key_risk_signals')} as key_risk_signals, payment_method, amount, loss_amount, summary,"
    " recommended_warning, confidence, text_hash as raw_text_hash, extraction_method"
)
NEAR_DOCS = {
    "doc_src": "select doc_id as id, text from documents", "turn_src": "select distinct text as id, text from conversations",
    **vectors("dv", "doc_src"), **vectors("tv", "turn_src"),
    "near_docs": "select t.id as text, d.id as doc_id, case when t.norm2 * d.norm2 > 0"
    " then list_dot_product(t.vec::double[], d.vec::double[]) / sqrt((t.norm2 * d.norm2)::double) else 0 end as cosine"
    " from tv_vec t, dv_vec d qualify row_number() over (partition by t.id order by cosine desc, d.id) = 1",
}
WITH_JUDGE, NO_JUDGE = assessed("judged"), assessed("none")
WIN = windowed()
VEC = "md5(array_to_string(vec, '|'))"


def _request(template: str, *parts: str) -> str:
    pieces = template.split("%s")
    out = [q(pieces[0])]
    for part, piece in zip(parts, pieces[1:]):
        out += [part, q(piece)]
    return " || ".join(out)


ORACLES: dict[str, str] = {
    "src_articles": sql(
        "select case when art_id % 5 = 1 then 'by file name' else url end as url,"
        f" case when art_id % 5 = 2 then {q(DEFAULT_SOURCE)} else '某站' end as source_name,"
        " case when art_id % 5 = 3 then '' else title end as title, publish_date, text_hash from docs where art_id % 5 <> 4"
    ),
    "src_articles_order": sql(
        "select art_id, sha256(art_id::varchar) || '.json' as file,"
        " row_number() over (order by sha256(art_id::varchar) || '.json', url) as rank from docs"
    ),
    "src_seed_sources": sql("select url, source_name from seed_all"),
    "pages_to_docs": sql(
        "select *, sha256(text) as text_hash from page_docs qualify row_number() over (partition by text order by page_id) = 1"
    ),
    "case_upsert": sql(
        "select case_id, fraud_type, text_hash as raw_text_hash, case when contains(text, '点赞赚钱') then 1 else 0 end as batch_id from cases"
    ),
    "doc_source_name": sql(
        f"select p.page_id, p.url, coalesce(s.name, {HOST.replace('url', 'p.url')}) as source_name from pages p left join seed_names s on s.url = p.url"
    ),
    "case_lookup": sql(
        "select d.case_id, c.case_id is not null as found, c.fraud_type, c.title from"
        " (select distinct substr(sha256(text_hash || '|' || url), 1, 32) as case_id from docs) d left join cases c using (case_id)"
    ),
    "case_scan": sql(f"select {CASE_OUT} from cases"),
    "page_title": sql(f"select page_id, {TITLE} as title from pages"),
    "page_date": sql(f"select page_id, {page_date('html')} as plain, {page_date(DATED)} as dated from pages"),
    "page_denoise": sql(f"select page_id, {drop('html', NOISE)} as html from pages"),
    "page_main_container": sql(
        "select p.page_id, t.tag, b.chars, case when b.chars > 100 then 'container' else 'page' end as used from pages p"
        " left join best b using (page_id) left join blocks t on t.page_id = b.page_id and t.pos = b.start"
    ),
    "page_text": sql("select page_id, text from page_texts"),
    "page_text_coalesce": sql(
        "select page_id, case when page_id % 3 = 0 then url else text end as text,"
        f" case when page_id % 3 <> 0 then {TITLE} when page_id % 2 = 0 then url else '' end as title,"
        f" case when page_id % 3 <> 0 then {page_date('html')} when page_id % 4 = 0 then '2020-02-02'"
        " else printf('20%02d-%02d-%02d', page_id % 40, page_id % 12 + 1, page_id % 28 + 1) end as publish_date"
        " from page_texts join pages using (page_id)"
    ),
    "doc_min_length": "select doc_id from documents where length(text) >= 80",
    "pii_redact": sql(f"select src, id, {redact('text')} as text from texts"),
    **{
        f"pii_redact_{k}": sql(f"select src, id, {redact('text', (k,))} as text from texts")
        for k in ("id", "phone", "landline", "bank", "email", "name")
    },
    "pii_scan": sql(f"select src, id, {joined(scan_list('text'))} as kinds from texts"),
    "doc_allowlist": sql("select page_id, url from pages where url in (select url from seed_list)"),
    "phrase_hits": sql(f"select src, id, fraud_type, {joined('kws')} as kws from ph_type"),
    "phrase_hits_join": sql("select src, id, fraud_type, kw_rank, kw from ph_hit"),
    "generic_hits": sql(f"select t.src, t.id, coalesce({joined('phrases')}, '') as hits from phrase_texts t left join ph_gen using (src, id)"),
    "type_info_join": sql(f"select src, id, fraud_type, {joined('risk_signals')} as signals, warning from ph_best join info using (fraud_type)"),
    "case_choose": sql("select art_id, extraction_method, fraud_type, title, summary from chosen"),
    "case_new_only": sql(
        "select case_id, art_id from valid where text_hash not in (select text_hash from valid where extraction_method = 'llm')"
    ),
    "similar_topk": sql("select utt_id, rank, case_id, round(greatest(cosine, 0), 6) as similarity from calls_syn join ranked using (text)"),
    "similar_topk_partitioned": sql("select utt_id, rank, case_id, round(greatest(cosine, 0), 6) as similarity from calls_syn join ranked using (text)"),
    "detect_action": sql("select utt_id, suggested_action from results", NO_JUDGE),
    "classify_type": sql(
        f"select t.src, t.id, coalesce(fraud_type, '{lx.OTHER}') as fraud_type, coalesce({joined('kws')}, '') as hits,"
        " least(coalesce(n, 0) / 4.0::double, 1.0) as score from phrase_texts t left join ph_best using (src, id)"
    ),
    "rule_score": sql("select src, id, round(score, 4) as score, fraud_type from ph_rule"),
    "matched_signals": sql(f"select src, id, {joined('signals')} as signals from ph_rule"),
    "extract_amount": sql(
        f"select art_id, list_max({amounts('whole')}) as amount,"
        f" {joined('list_transform(' + amounts('whole') + ', lambda a: a::bigint)')} as amounts from docs"
    ),
    "validate_grounding": sql(
        f"select art_id, case when len(fraud_script) > 0 then round({SHARE.replace('script', 'fraud_script')}, 4) end as share from chosen"
    ),
    "case_count": sql("select count(*) as n from cases"),
    "stats_by_type": sql("select fraud_type, count(*) as n, sum(count(*)) over () as total from cases group by fraud_type"),
    "ingest_summary": sql(
        "select (select count(*) from docs) as fetched, (select count(*) from cases) as ingested, (select count(*) from cases) as total"
    ),
    "ingest_new_cases": sql(
        "select case_id, '+ [' || fraud_type || '] ' || title || ' (confidence=' || printf('%.2f', confidence) || ')' as line from cases"
    ),
    "hash_embed": sql(
        f"select id as doc_id, {VEC} as vec, norm2 from ev_vec",
        {"doc_texts": "select doc_id as id, text from documents", **vectors("ev", "doc_texts")},
    ),
    "doc_dedup": "select min(doc_id) as doc_id, sha256(text) as text_hash from documents group by text",
    "case_replace": sql(
        "select case_id, case when extraction_method = 'rule' then 1 else 0 end as batch_id,"
        " case when extraction_method = 'rule' then '更新：' || summary else summary end as summary from valid where accepted"
    ),
    "stats_after_replace": sql(
        "select fraud_type, count(*) as n, sum(count(*)) over ()::bigint as total from"
        " (select case when extraction_method = 'rule' then '其他' else fraud_type end as fraud_type from valid where accepted) group by fraud_type"
    ),
    "similar_top1": sql("select utt_id, round(sim, 6) as similarity, sim_type as fraud_type from calls_syn join top1 using (text)"),
    "key_risk_signals": sql(f"select art_id, {joined('key_risk_signals')} as signals from rule_c"),
    "l2_normalize": "select vec_id, round(v[1] / n, 4) as first, round(v[len(v)] / n, 4) as last, round(list_dot_product(v, v) / (n * n), 4) as length"
    " from (select vec_id, embedding::double[] as v, coalesce(nullif(sqrt(list_dot_product(embedding::double[], embedding::double[])), 0), 1) as n from embeddings)",
    "dense_topk": """
with e as materialized (select vec_id, embedding::double[] as v, list_dot_product(embedding::double[], embedding::double[]) as n2 from embeddings)
select vec_id, rank, near_id, round(c, 6) as cosine from (select a.vec_id, b.vec_id as near_id,
 case when a.n2 * b.n2 > 0 then round(list_dot_product(a.v, b.v) / sqrt(a.n2 * b.n2), 9) else 0 end as c,
 row_number() over (partition by a.vec_id order by c desc, b.vec_id) as rank from e a, e b qualify rank <= 5)
""",
    "content_hash": "select doc_id, sha256(text) as text_hash from documents",
    "extract_quotes": sql(
        f"select src, id, {joined(f'''regexp_extract_all(text, '{QUOTE}', 1)[1:8]''')} as quotes from texts"
    ),
    "extract_age": sql(f"select art_id, {first_of('whole', lx.AGE_MARKERS)} as age_group from docs"),
    "extract_payment": sql(f"select art_id, {first_of('whole', [(t, t) for t in lx.PAYMENT_TERMS])} as payment_method from docs"),
    "extract_summary": f"select doc_id, replace(substr(text, 1, 120), {NL}, ' ') as summary from documents",
    "rule_cases": sql(f"select art_id, {CASE_OUT} from rule_out"),
    "llm_cases": sql(f"select art_id, {CASE_OUT} from llm_out"),
    "to_float": sql(
        "select art_id, try_cast(j->>'$.loss_amount' as double) as loss, try_cast(j->>'$.money_flow.amount' as double) as amount from ans"
    ),
    "llm_answer_parse": sql(
        "select art_id, j is not null as parsed, coalesce(j->>'$.is_fraud_case' in ('true', '1'), false) as usable from ans"
    ),
    "llm_requests": sql(
        "select art_id, "
        + _request(answers.EXTRACT_REQUEST.format(labels="、".join([*lx.KEYWORDS, lx.OTHER])), "title", "substr(text, 1, 6000)")
        + " as request from docs"
    ),
    "judge_requests": sql(
        "select utt_id, " + _request(answers.JUDGE_REQUEST, "c.text", "x.lines") + " as request from calls_syn c join"
        f" (select text, string_agg('- [' || fraud_type || '] ' || summary || ' 风险信号: ' || array_to_string(key_risk_signals[1:5], ', '), {NL} order by rank) as lines"
        " from near where rank <= 3 group by text) x on x.text = c.text"
    ),
    "judge_scores": sql("select utt_id, score, fraud_type, reason from judged"),
    "validate_required": sql("select art_id, accepted from valid"),
    "validate_enum": sql(
        f"select art_id, case when f in ({LABELS}) then f else '{lx.OTHER}' end as fraud_type from (select art_id, j->>'$.fraud_type' as f from ans)"
    ),
    "validate_amount": sql("select art_id, loss_amount, amount from valid"),
    "validate_date": sql(
        f"select art_id, publish_date, case when try_cast(publish_date as date) <= date '{derived.AS_OF}' then publish_date end as usable,"
        f" case when try_cast(replace(publish_date, '-15', '-31') as date) <= date '{derived.AS_OF}' then replace(publish_date, '-15', '-31') end as usable_31 from docs"
    ),
    "validate_pii": sql(
        f"select art_id, title, scenario, summary, {joined('fraud_script')} as script, {joined('key_risk_signals')} as signals from valid"
    ),
    "grounding": "select doc_id, "
    + ", ".join(
        f"{grounded(s, 'text')} as {n}"
        for s, n in (
            ("substr(text, 40, 30)", "whole"), ("('###' || substr(text, 40, 30))", "piece"),
            ("('##' || substr(text, 40, 5) || '##')", "changed"), ("'  '", "blank"),
        )
    )
    + " from documents",
    "validate_cases": sql("select art_id, accepted, confidence, problems from valid"),
    "embedding_text": sql(f"select art_id, {EMBED} as text from chosen"),
    "tokenize_bigrams": sql(
        f"select src, id, len(t) as n, md5({joined('t')}) as tokens from (select src, id,"
        " list_concat(u, list_transform(range(1, len(u)), lambda i: u[i] || u[i + 1])) as t from units)",
        {"units": "select src, id, regexp_extract_all(lower(text), '[一-龥]|[A-Za-z0-9]+') as u from texts"},
    ),
    "hash_bucket": """
with h as (select event_id, md5(event_id::varchar) as d from events),
w as (select event_id, d, ('0x' || d[15:16] || d[13:14] || d[11:12] || d[9:10] || d[7:8] || d[5:6] || d[3:4] || d[1:2])::ubigint as v from h)
select event_id, (v % 256)::int as b256, (v % 100)::int as b100, (v % 1024)::int as b1024, (v >> 63)::int as plus from w
""",
    "risk_fusion": sql("select utt_id, risk_score as score from results", WITH_JUDGE),
    "risk_level": sql("select utt_id, risk_level from results", WITH_JUDGE),
    "risk_type": sql("select utt_id, fraud_type from results", WITH_JUDGE),
    "detect_reason": sql("select utt_id, reason from results", NO_JUDGE),
    "transcript_valid": "select conv_id, turn, coalesce(regexp_matches(text, '\\S'), false) as valid from conversations"
    " union all select conv_id, -1 - turn, false from conversations",
    "detect_calls": sql("select * from results", WITH_JUDGE),
    "detect_json": sql("select * from results", WITH_JUDGE),
    "ingest_cases": sql(f"select {CASE_OUT}, v.norm2, {VEC.replace('vec', 'v.vec')} as vec from cases join cv_vec v on v.id = case_id"),
    "case_provenance": sql(
        "select case_id, url as source_url, source_name, text_hash as raw_text_hash, extraction_method, true as stamped from cases"
    ),
    "stream_windows": sql(
        f"select call_id, {STAMP.format('window_start')}, {STAMP.format('window_end')}, md5(text) as text from win10", {"win10": windows("turns", "ts", "5 seconds", 2)}
    ),
    "table_windows": sql(
        f"select call_id, {STAMP.format('window_start')}, {STAMP.format('window_end')}, md5(text) as text from win10", {"win10": windows("turns", "ts", "5 seconds", 2)}
    ),
    "stream_windows_panes": sql(
        f"select call_id, {STAMP.format('window_start')}, {STAMP.format('window_end')}, md5(text) as text from win60", {"win60": windows("turns", "ts", "5 seconds", 12)}
    ),
    "stream_detect": sql(
        f"select call_id, {STAMP.format('window_start')}, risk_level, {r3('raw_score')} as risk_score, fraud_type from wlevel", WIN
    ),
    "risk_escalation": sql(f"select call_id, {STAMP.format('window_start')}, risk_level, fraud_type from walert", WIN),
    "stream_alerts": sql(f"select call_id, {STAMP.format('window_start')}, risk_level, fraud_type from walert", WIN),
    "stream_detect_partitioned": sql(
        f"select call_id, {STAMP.format('window_start')}, risk_level, {r3('raw_score')} as risk_score, fraud_type from wlevel", WIN
    ),
    "risk_escalation_partitioned": sql(f"select call_id, {STAMP.format('window_start')}, risk_level, fraud_type from walert", WIN),
    "stream_alerts_partitioned": sql(f"select call_id, {STAMP.format('window_start')}, risk_level, fraud_type from walert", WIN),
    "similar_documents": sql("select conv_id, turn, doc_id, round(cosine, 6) as cosine from conversations join near_docs using (text)", NEAR_DOCS),
}
