"""Article and seed-list files, page tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..functions import html
from ..functions.text import bind, present, strip, url_host
from ..operators.cases import once
from ..operators.dedup import FEW, first_per_key
from ..schemas import ARTICLE_FILE, SEED_FILE
from ..session import work_folder

MIN_TEXT = 80
DEFAULT_SOURCE = "本地文件"


def read_articles(
    spark: SparkSession, path: str, one_per_file: bool = True, default_source: str = DEFAULT_SOURCE
) -> DataFrame:
    """Article files as rows; `_rejected` marks those without text.

    `one_per_file` reads a JSON object per file; otherwise JSON lines, which large
    inputs should use. `seq` is the read order, and the rule for "first seen" later on: the
    file name, and among the lines of one file url and content, since a line has no stable
    number when a file is read in pieces. It depends on the data alone, so any partitioning
    and any retry orders alike. A missing url becomes local://<file name>.
    """
    raw = (
        spark.read.schema(ARTICLE_FILE)
        .option("multiLine", one_per_file)
        .option("pathGlobFilter", "*.json")
        .json(path)
    )
    file = F.col("_metadata.file_name")
    return raw.select(
        F.coalesce("url", F.concat(F.lit("local://"), file)).alias("url"),
        F.coalesce("source_name", F.lit(default_source)).alias("source_name"),
        F.coalesce("title", F.lit("")).alias("title"),
        "publish_date",
        "text",
        F.struct(file.alias("file"), "url", F.sha2(F.to_json(F.struct("title", "source_name", "publish_date", "text")), 256).alias("line")).alias("seq"),
        F.col("text").isNull().alias("_rejected"),
    )


def split_rejected(articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable rows, rejected rows)."""
    return articles.filter("not _rejected").drop("_rejected"), articles.filter("_rejected").drop("_rejected")


def read_rank(docs: DataFrame, order: str = "seq") -> DataFrame:
    """Adds `rank`, from 1: the place of each row in the order of column `order` (nulls first) over all rows.

    The rows are sorted by ranges into a table in the shared folder, whose files follow each other in that order.
    A row's rank is its place in its file, which the reader knows, and the number of rows in the files before,
    of which there is one count per file. No task sees more than a range, and a retried one repeats nothing, since the
    table is fixed. Rows equal in `order` take any order among themselves.
    """
    spark = docs.sparkSession
    path = work_folder(spark, "ranked")
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    docs.select(kept, F.col(order).alias("key")).sort("key").select("row").write.parquet(path)
    name, shape = F.col("_metadata.file_name"), T.StructType([T.StructField("row", docs.schema)])
    slot = F.struct(
        F.regexp_extract(name, r"^part-(\d+)", 1).cast("long").alias("part"), F.regexp_extract(name, r"-c(\d+)\.", 1).alias("piece")
    ).alias("slot")
    rows = spark.read.schema(shape).parquet(path).select("row", slot, F.col("_metadata.row_index").alias("place"))
    before = F.sum("n").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    files = rows.groupBy("slot").agg(F.count("*").alias("n")).select("slot", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(files, "slot").select("row.*", (F.col("before") + F.col("place") + 1).alias("rank"))


def read_seeds(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Allow-list: a JSON array of {url, source_name}; a missing name is empty.

    `one_per_file` reads one array per file, otherwise one per line. `pos` is the place
    in the array: the later entry of a url counts.
    """
    lists = spark.read.option("wholetext", one_per_file).text(path)
    return lists.select(F.posexplode(F.from_json("value", SEED_FILE))).select(
        "pos", F.col("col.url").alias("url"), F.coalesce("col.source_name", F.lit("")).alias("source_name")
    )


def allow_listed(pages: DataFrame, seeds: DataFrame, by_host: bool = False) -> DataFrame:
    """Pages whose url (or host) is on the allow-list."""
    key = url_host(F.col("url")) if by_host else F.col("url")
    listed = seeds.select(key.alias("_key")).distinct()
    keyed = pages.withColumn("_key", key)
    return keyed.join(listed, "_key", "left_semi").drop("_key")


def with_source_name(pages: DataFrame, seeds: DataFrame) -> DataFrame:
    """Adds `source_name`: the seed's name for that url, else the host of the url.

    The last seed entry of a url counts. A seed's empty name stays empty.
    """
    return _named(pages, seed_names(seeds), "left")


def seed_names(seeds: DataFrame) -> DataFrame:
    """(url, _name): one row per seed, with the name of its last entry."""
    return seeds.groupBy("url").agg(F.max_by("source_name", "pos").alias("_name"))


def _named(pages: DataFrame, names: DataFrame, how: str) -> DataFrame:
    return pages.join(names, "url", how).withColumn("source_name", F.coalesce("_name", url_host(F.col("url")))).drop("_name")


def named_texts(pages: DataFrame, seeds: DataFrame, only_listed: bool = True, few: int = FEW) -> DataFrame:
    """Pages (url, html) as cleaned texts with `source_name`; raw html is never shuffled.

    One join serves the allow-list and the name. If the seeds are counted as few, they go to the pages, and
    only listed pages are cleaned; otherwise pages are cleaned where they lie and their texts meet the seeds.
    """
    names = seed_names(seeds)
    if only_listed and names.select(F.lit(1)).limit(few + 1).count() <= few:
        return long_enough(clean_pages(_named(pages, F.broadcast(names), "inner"))).drop("html")
    return _named(long_enough(clean_pages(pages)).drop("html"), names, "inner" if only_listed else "left")


def clean_pages(
    pages: DataFrame, html_column: str = "html", main_text: str | None = None, main_title: str | None = None, main_date: str | None = None
) -> DataFrame:
    """Adds title, publish_date and text of each page. One projection, no shuffle.

    `main_text`, `main_title` and `main_date` name optional columns filled by another
    extractor. Where it has text, text, title and date are its own, a missing title being
    empty and a missing date the first one anywhere in the raw html, attributes included;
    elsewhere all three are native.
    """
    page = F.col(html_column)
    text = bind(
        html.blocks(html.denoise(page)),
        lambda parts: bind(html.container_blocks(parts, html.main_container(parts)), html.block_text),
    )
    title, day = html.page_title(page), html.page_date(page)
    if main_text:
        other = present(strip(F.col(main_text)))
        given = F.coalesce(F.col(main_title), F.lit("")) if main_title else F.lit("")
        dated = present(F.col(main_date)) if main_date else F.lit(None).cast("string")
        title = F.when(other.isNotNull(), given).otherwise(title)
        day = F.when(other.isNotNull(), F.coalesce(dated, html.find_date(page))).otherwise(day)
        text = F.coalesce(other, text)
    return once(pages, {"title": title, "publish_date": day, "text": text})


def long_enough(docs: DataFrame) -> DataFrame:
    """Drops list and error pages: texts under 80 characters, counted before redaction."""
    return docs.filter(F.length("text") >= MIN_TEXT)


def dedup_docs(docs: DataFrame, order: str = "seq") -> DataFrame:
    """First document of each redacted text."""
    return first_per_key(docs, F.col("text_hash"), F.col(order))
