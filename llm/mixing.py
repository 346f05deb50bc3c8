"""Mixes sources to target weights by Poisson replication.

Each source has a mean repetition rate: its target share of the output, in characters, over what it
has. A document's number of copies is the inverse of a Poisson distribution with that mean at a
uniform number hashed from seed and id, so runs repeat and tasks need no state. Copies are spread
over all partitions by a hashed order key and sorted by it there: a global shuffle.

Rates above `STEP` are drawn as sums of independent smaller draws, so no rate is too large.

Handled cases: null sources are a source of their own; a null id is replaced by a hash of the text;
rows repeated with the same id get the same number of copies; null and empty texts count no
characters, and a source without any is kept once per document; sources missing from given weights
have weight 0, and if no source with characters has a weight, none of their documents is copied. Input columns
that are named like an added one get the suffix _in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.shared import cut, parts, small

SEED, POWER, EPOCHS, STEP = 17, 0.5, 1.0, 300.0
ADDED = ["copy_no", "n_copies", "order_key"]


def _number(key: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(F.encode(key, "utf-8")), 1, digits), 16, 10).cast("long")


def rates(docs: DataFrame, source: str = "source", text: str = "text", weights: dict[str, float] | None = None, power: float = POWER, epochs: float = EPOCHS) -> DataFrame:
    """(source_key, rate): each source's mean number of copies.

    Targets are `weights` by source (any scale), or else the source's characters to the given power,
    which lifts small sources. The output has `epochs` times the input's characters in the mean.
    """
    size = docs.groupBy(_key(F.col(source)).alias("source_key")).agg(F.sum(F.coalesce(F.length(F.col(text)), F.lit(0))).alias("chars"))
    if weights is None:
        weight = F.pow(F.col("chars").cast("double"), F.lit(power))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source_key") == f"s{name}", F.lit(float(w))).otherwise(weight)
    size = size.withColumn("weight", F.when(F.col("chars") > 0, weight).otherwise(0.0))
    size = cut(size, "sizes")  # a row for each source
    total = size.agg(F.sum("chars").alias("chars"), F.sum("weight").alias("weight")).first()
    if not total["weight"]:  # no source with characters has a weight
        rate = F.lit(0.0)
    else:
        rate = F.col("weight") / F.lit(total["weight"]) * epochs * F.lit(total["chars"]) / F.col("chars")
    return size.select("source_key", F.when(F.col("chars") > 0, rate).alias("rate"))


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def _cdf(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... until nothing is left in double precision."""
    top = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    zero = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("out"))

    def add(acc, k):
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), (acc["sum"] + p).alias("sum"), F.concat(acc["out"], F.array(acc["sum"] + p)).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), top), zero, add, lambda acc: acc["out"])


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: int = SEED, weights: dict[str, float] | None = None, power: float = POWER, epochs: float = EPOCHS) -> DataFrame:
    """The rows of docs, each repeated by its drawn count, in a random order (by partition, then order_key)."""
    rate = rates(docs, source, text, weights, power, epochs).select("source_key", "rate", F.greatest(F.lit(1), F.ceil(F.col("rate") / STEP)).cast("int").alias("draws"))
    table = rate.select("source_key", "draws", F.when(F.col("rate").isNotNull(), _cdf(F.col("rate") / F.col("draws"))).alias("cdf"))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    key = F.coalesce(F.concat(F.lit("i"), F.col(doc_id).cast("string")), F.concat(F.lit("t"), F.md5(F.encode(body, "utf-8"))))
    whole = F.struct(*[F.col(f"`{c}`").alias(f"{c}_in" if c in ADDED else c) for c in docs.columns])  # whatever columns are called
    rows = docs.select(_key(F.col(source)).alias("source_key"), key.alias("key"), whole.alias("row"))
    rows = rows.join(small(table), "source_key")
    one = lambda j: F.size(F.filter("cdf", lambda c: c <= _number(F.concat_ws("|", F.lit(str(seed)), "key", j.cast("string")), 13) / F.lit(float(1 << 52))))
    drawn = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("draws")), one), F.lit(0), lambda a, n: a + n)
    rows = rows.withColumn("n_copies", F.when(F.col("cdf").isNull(), F.lit(1)).otherwise(drawn)).where("n_copies > 0")
    rows = rows.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    rows = rows.withColumn("order_key", _number(F.concat_ws("|", F.lit(str(seed)), "key", F.lit("copy"), F.col("copy_no").cast("string")), 15))
    rows = rows.select("row.*", "n_copies", "copy_no", "order_key")
    return rows.repartition(parts(docs.sparkSession), "order_key").sortWithinPartitions("order_key")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of every document of `documents` in the mixed output, sources weighted by the root of their size."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
with size as (select coalesce('s' || source, 'n') as k, sum(coalesce(length(text), 0))::double as chars from documents group by 1),
w as (select k, chars, case when chars > 0 then pow(chars, 0.5) else 0 end as weight from size),
rate as (select k, case when chars > 0 then weight / (select sum(weight) from w) * (select sum(chars) from w) / chars end as r from w),
cdf as (select k, r, list_transform(range(0, (ceil(r + 12 * sqrt(r) + 30))::bigint + 1),
    lambda n: list_sum(list_transform(range(0, n + 1), lambda i: exp(-r + i * ln(r) - lgamma(i + 1))))) as c from rate),
d as (select *, coalesce('s' || source, 'n') as k, coalesce('i' || doc_id::varchar, 't' || md5(coalesce(text, ''))) as id from documents),
n as (select d.*, case when r is null then 1
    else len(list_filter(c, lambda x: x <= ('0x' || substr(md5('17|' || id || '|1'), 1, 13))::bigint / 4503599627370496.0)) end as n_copies
  from d join cdf using (k)),
e as (select *, unnest(range(1, n_copies + 1)) as copy_no from n)
select doc_id, text, lang, source, n_chars, n_copies::int as n_copies, copy_no::int as copy_no,
  ('0x' || substr(md5('17|' || id || '|copy|' || copy_no::varchar), 1, 15))::bigint as order_key from e
"""
