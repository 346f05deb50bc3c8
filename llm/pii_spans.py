"""Personal data spans from weak labelers, in DataFrame functions only.

Candidates of each kind are found by linear-time patterns; their places come from the pieces between
them. Five labelers vote yes (1), no (0) or not at all (?) on each candidate: the strict form, a
gazetteer (domain endings, country codes, issuer digits, address ranges), the words before it, its
neighbour characters and its length. Votes are counted by kind and vote pattern, a table whose size
is fixed by the number of kinds and labelers. Expectation-maximisation over these counts estimates
each labeler's reliability and each pattern's probability of being personal data; a logistic span
classifier is fitted to those and decides. Spans of the base kinds that meet the base rules always
stay; the classifier adds spans of its own kinds where they overlap none of those.

Handled cases: null and empty texts have no spans; null and repeated ids stay a row per row; texts
of any length take time linear in their length; other columns are not looked at. An empty table fits
a classifier that adds nothing. U+E000 and U+E001 in a text count as "!".
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.shared import cut

BASE = ["email", "ip", "card", "phone"]
ADDED = ["email_spelled", "phone_local", "id_number", "secret"]
LABELERS = ["form", "gazetteer", "context", "edges", "size"]
JOIN, DOT = "\ue000", "\ue001"  # stand for a separator inside a digit run, and for a dot between domain characters

# Each pattern matches from the first character of a run, so that a failing run is tried once. \G lets a
# match begin right after the one before. There are no repeated groups, which would recurse.
LOCAL = rf"[A-Za-z0-9._%+{DOT}-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++{DOT}[A-Za-z0-9{DOT}-]++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": rf"[0-9][0-9{JOIN}]{{12,}}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "email_spelled": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[](?:at|AT)[)\]] ?[A-Za-z0-9-]{1,63}\.[A-Za-z]{2,24}",
    "phone_local": r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "id_number": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?i)\b(?:token|secret|password|api[_-]?key) ?[=:] ?\"?[A-Za-z0-9_/+-]{16,}+",
}
ENDINGS = "com|org|net|edu|gov|io|info|eu|uk|de|fr|es|it|nl|ch|at"
CODES = "1|7|20|27|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
CUES = {
    "email": "mail|contact|write|send|reach", "email_spelled": "mail|contact|write|send|reach", "ip": "ip|host|server|address|login", "card": "card|visa|pay|credit|debit",
    "phone": "phone|call|tel|mobile|fax|contact", "phone_local": "phone|call|tel|mobile|fax|contact", "id_number": "ssn|social|id|number", "secret": "key|auth|token|login|secret",
}
SIZES = {"email": (8, 64), "ip": (7, 15), "card": (13, 23), "phone": (10, 20), "email_spelled": (10, 80), "phone_local": (12, 14), "id_number": (11, 11), "secret": (24, 120)}
BLOCK = 512


def bind(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.transform(F.array(value), use)[0]


def _sums(lengths: Column) -> Column:
    """Running sums, in blocks so that growing the arrays stays cheap."""
    n = F.size(lengths)
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))), lambda b: F.slice(lengths, b * BLOCK + 1, BLOCK))

    def run(x):
        zero = F.array(F.lit(0).cast("long"))
        return F.aggregate(x, zero, lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))

    inner = F.transform(blocks, run)
    base = lambda rows: run(F.transform(rows, lambda r: F.element_at(r, -1)))
    return bind(inner, lambda rows: bind(base(rows), lambda tops: F.flatten(F.transform(rows, lambda r, i: F.transform(F.slice(r, 2, BLOCK), lambda v: v + tops[i])))))


def _luhn(digits: Column) -> Column:
    """Whether the digits pass the check: every second from the right counts as its doubled digit sum."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(F.filter(places, lambda d: d.isNotNull()), F.lit(0), lambda a, d: a + d) % 10 == 0


def _strict(kind: str, m: Column) -> Column | None:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return ~F.exists(F.split(m, r"\."), lambda p: ~p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(digits).between(13, 19) & F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return None


def _vote(yes: Column | None) -> Column:
    return F.lit("?") if yes is None else F.when(yes, "1").otherwise("0")


def _gazetteer(kind: str, m: Column) -> Column | None:
    if kind in ("email", "email_spelled"):
        return F.lower(m).rlike(rf"[.{DOT}](?:{ENDINGS})$")
    if kind == "phone":
        return m.rlike(rf"^\+(?:{CODES})")
    if kind == "card":
        return m.rlike("^[3-6]")
    if kind == "ip":
        return m.rlike(r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.")
    if kind == "id_number":
        return ~m.rlike("^(?:000|666|9)")
    return None


def _found(kind: str, text: Column) -> Column:
    """array<struct<kind, start, end, strict, votes>> of one kind's candidates."""
    pattern = F.lit(PATTERNS[kind])
    both = F.struct(F.split(text, PATTERNS[kind], -1).alias("p"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"))

    def spans(x):
        lengths = F.transform(x["m"], lambda m, i: (F.length(x["p"][i]) + F.when(i > 0, F.length(F.get(x["m"], i - 1))).otherwise(0)).cast("long"))
        low, high = SIZES[kind]

        def one(m, i, ends):
            strict = _strict(kind, m)
            before = F.lower(F.right(x["p"][i], F.lit(24)))
            edges = ~F.right(x["p"][i], F.lit(1)).rlike(r"[\p{L}\p{N}]") & ~F.left(x["p"][i + 1], F.lit(1)).rlike(r"[\p{L}\p{N}]")
            votes = F.concat(
                _vote(strict), _vote(_gazetteer(kind, m)), F.when(before.rlike(rf"\b(?:{CUES[kind]})"), "1").otherwise("?"),
                _vote(edges), _vote(F.length(m).between(low, high)),
            )
            return F.struct(
                F.lit(kind).alias("kind"), ends[i].alias("start"), (ends[i] + F.length(m)).alias("end"),
                (strict if strict is not None else F.lit(False)).alias("strict"), votes.alias("votes"),
            )

        return bind(_sums(lengths), lambda ends: F.transform(x["m"], lambda m, i: one(m, i, ends)))

    return bind(both, spans)


def candidates(text: Column) -> Column:
    """All candidates of a text, base kinds first, each kind by start."""
    plain = F.translate(F.coalesce(text, F.lit("")), JOIN + DOT, "!!")

    def of(t):
        out = []
        for kind in BASE + ADDED:
            body = t
            if kind == "email":
                body = F.regexp_replace(t, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", DOT)
            if kind == "card":
                body = F.regexp_replace(t, r"(?<=[0-9])[ -](?=[0-9])", JOIN)
            needs = {"email": t.contains("@"), "ip": t.contains("."), "phone": t.contains("+"), "email_spelled": t.contains("(at") | t.contains("[at") | t.contains("(AT") | t.contains("[AT"), "secret": t.contains("=") | t.contains(":")}.get(kind, t.rlike("[0-9]{3}"))
            if kind == "card":
                needs = t.rlike("[0-9]")
            nothing = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,strict:boolean,votes:string>>")
            out.append(F.when(needs, _found(kind, body)).otherwise(nothing))
        return F.concat(*out)

    return bind(plain, of)


def fit(counts: list[tuple[str, str, int]], rounds: int = 50) -> dict[str, float]:
    """Weights of the span classifier, from (kind, votes, how many) of all candidates.

    The E step gives each pattern its probability of being personal data from the labelers'
    current reliabilities; the M step re-estimates these and each kind's share. Then the
    classifier (kind and votes, logistic) is fitted to the probabilities by gradient steps.
    """
    kinds = BASE + ADDED
    rate = {v: [0.9, 0.3] for v in range(len(LABELERS))}  # how often it says yes to true and to false candidates
    share = dict.fromkeys(kinds, 0.5)
    belief: dict[tuple[str, str], float] = {}
    for _ in range(rounds):
        for kind, votes, _n in counts:
            odds = math.log(share[kind] / (1 - share[kind]))
            for v, x in enumerate(votes):
                if x != "?":
                    p, q = rate[v]
                    odds += math.log(p / q) if x == "1" else math.log((1 - p) / (1 - q))
            belief[kind, votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        for v in range(len(LABELERS)):
            for side in (0, 1):
                yes = said = 0.0
                for kind, votes, n in counts:
                    if votes[v] != "?":
                        w = n * (belief[kind, votes] if side == 0 else 1 - belief[kind, votes])
                        said += w
                        yes += w * (votes[v] == "1")
                rate[v][side] = (yes + (2.7 if side == 0 else 0.9)) / (said + 3)  # a weak prior holds labelers that never vote
            rate[v][0] = max(rate[v][0], rate[v][1] + 0.01) if rate[v][0] < rate[v][1] else rate[v][0]  # labelers are better than chance
            rate[v] = [min(0.999, max(0.001, x)) for x in rate[v]]
        for kind in kinds:
            total = sum(n for k, _, n in counts if k == kind)
            share[kind] = (sum(n * belief[k, v] for k, v, n in counts if k == kind) + 1) / (total + 2)
    names = ["bias", *kinds, *LABELERS]
    weight = dict.fromkeys(names, 0.0)
    rows = [({"bias": 1.0, kind: 1.0} | {LABELERS[v]: 1.0 if x == "1" else -1.0 for v, x in enumerate(votes) if x != "?"}, belief[kind, votes], math.sqrt(n)) for kind, votes, n in counts]
    total = sum(n for *_, n in rows) or 1.0
    for _ in range(400):
        step = {k: -1e-3 * w for k, w in weight.items()}
        for x, p, n in rows:
            e = n / total * (p - 1 / (1 + math.exp(-sum(weight[k] * v for k, v in x.items()))))
            for k, v in x.items():
                step[k] += e * v
        weight = {k: w + 2.0 * step[k] for k, w in weight.items()}
    return weight


def _probability(c: Column, weight: dict[str, float]) -> Column:
    score = F.lit(weight["bias"])
    for kind in BASE + ADDED:
        score = score + F.when(c["kind"] == kind, F.lit(weight[kind])).otherwise(0.0)
    for v, name in enumerate(LABELERS):
        x = F.substring(c["votes"], v + 1, 1)
        score = score + F.when(x == "1", F.lit(weight[name])).when(x == "0", F.lit(-weight[name])).otherwise(0.0)
    return 1 / (1 + F.exp(-score))


def chosen(found: Column, weight: dict[str, float]) -> Column:
    """array<struct<kind, start, end, probability>>: base spans that meet the rules, then the classifier's."""
    out = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), _probability(c, weight).alias("probability"))

    def split(all_):
        def more(kept):
            free = lambda c: ~F.exists(kept, lambda k: (k["start"] < c["end"]) & (c["start"] < k["end"]))
            return F.concat(kept, F.filter(all_, lambda c: c["kind"].isin(ADDED) & (_probability(c, weight) >= 0.5) & free(c)))

        return F.transform(bind(F.filter(all_, lambda c: c["strict"] & c["kind"].isin(BASE)), more), out)

    return bind(found, split)


def train(found: DataFrame) -> dict[str, float]:
    """Weights from a table with a `found` column; at most kinds x 3^labelers counts come to the driver."""
    counts = found.select(F.explode("found").alias("c")).groupBy("c.kind", "c.votes").count().collect()
    return fit(sorted((r["kind"], r["votes"], r["count"]) for r in counts))


def pii_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, spans): the personal data of each text, in code points, with each span's probability."""
    found = cut(docs.select(F.col(doc_id).alias("id"), candidates(F.col(text)).alias("found")), "candidates")
    return found.select("id", chosen(F.col("found"), train(found)).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """text with each span replaced by its kind in brackets; overlapping spans count as one."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def add(acc, s):
        fresh = s["start"] >= acc["at"]
        piece = F.concat(F.substr(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["parts"], F.array(piece))).otherwise(acc["parts"]).alias("parts"))

    whole = F.aggregate(ordered, zero, add, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substr(text, (acc["at"] + 1).cast("int"))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def redact(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The rows of docs with every span of the text replaced by its kind; n_chars, if there, follows the text."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    found = cut(docs.select(row, candidates(F.col(text)).alias("found")), "candidates")
    out = found.select("row", chosen(F.col("found"), train(found)).alias("spans")).withColumn("body", redacted(F.col(f"row.{text}"), F.col("spans")))
    swap = {text: F.col("body"), n_chars: F.when(F.size("spans") > 0, F.length("body").cast(dict(docs.dtypes).get(n_chars, "long"))).otherwise(F.col(f"row.{n_chars}")) if n_chars in docs.columns else None}
    return out.select(*[swap[c].alias(c) if swap.get(c) is not None else F.col(f"row.`{c}`") for c in docs.columns])


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of `documents`: base spans by kind, their digest, and all spans."""
    out = pii_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.array_join(F.transform(F.filter("spans", lambda s: s["kind"].isin(BASE)), line), ",")
    return out.select(
        F.col("id").alias("doc_id"), *[count(k) for k in BASE],
        F.sha2(F.encode(base, "utf-8"), 256).alias("base_sha256"), F.array_join(F.transform("spans", line), ",").alias("spans"),
    )
