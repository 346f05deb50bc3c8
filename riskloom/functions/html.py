"""Main text, title and date of a web page, as column expressions.

Nothing here leaves the row: a page is cut at its block tags once and one linear
fold over the pieces finds the main container, so the page job has no shuffle.

Known limits against a full HTML tree: "direct child" means the innermost open
container of the four kinds, so a paragraph in a blockquote inside it counts;
close tags are matched by nesting depth, not by name; an unclosed noise element
is kept.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, functions as F

from .. import patterns
from .text import bind, present, strip


_NAMED = "\u0001".join(f"{name}\u0002{chr(code)}" for name, code in name2codepoint.items())


def _code_point(n: Column) -> Column:
    valid = n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    return F.decode(F.unhex(F.lpad(F.hex(F.when(valid, n).otherwise(F.lit(0xFFFD))), 8, "0")), "UTF-32")


def _entity_char(name: Column) -> Column:
    named = F.str_to_map(F.lit(_NAMED), F.lit("\u0001"), F.lit("\u0002"))  # folded to a literal map
    return (
        F.when(name.rlike("^#[xX]"), _code_point(F.conv(F.substring(name, 3, 8), 16, 10).try_cast("bigint")))
        .when(name.startswith("#"), _code_point(F.substring(name, 2, 8).try_cast("bigint")))
        .otherwise(F.coalesce(F.try_element_at(named, name), F.concat(F.lit("&"), name, F.lit(";"))))
    )


def decode_entities(text: Column) -> Column:
    """Resolve character references, each exactly once."""
    names = F.regexp_extract_all(text, F.lit(patterns.ENTITY), 1)
    between = F.split(text, patterns.ENTITY, -1)
    resolved = F.array_join(
        F.zip_with(between, names, lambda t, n: F.concat(t, F.when(n.isNotNull(), _entity_char(n)).otherwise(F.lit("")))),
        "",
    )
    return F.when(F.contains(text, F.lit("&")), resolved).otherwise(text)


def text_nodes(html: Column) -> Column:
    """Stripped, non-empty text pieces between tags, in order."""
    pieces = F.transform(F.split(html, patterns.TAG, -1), lambda p: strip(decode_entities(p)))
    return F.filter(pieces, lambda p: p != "")


def drop_hidden(html: Column) -> Column:
    """Without comments, scripts and styles: what a reader could see."""
    return F.regexp_replace(F.regexp_replace(html, patterns.COMMENT, ""), patterns.RAW_ELEMENTS, "")


def denoise(html: Column) -> Column:
    """Without comments and page furniture (navigation, header, footer, forms, ...)."""
    return F.regexp_replace(F.regexp_replace(html, patterns.COMMENT, ""), patterns.NOISE_ELEMENTS, "")


def page_title(html: Column) -> Column:
    """First h1 if it has text, else the title element, else empty."""
    def title(visible: Column) -> Column:
        def of(pattern: str) -> Column:
            return F.array_join(text_nodes(F.regexp_extract(visible, pattern, 1)), "")

        return F.coalesce(bind(of(patterns.H1), present), of(patterns.TITLE))

    return bind(drop_hidden(html), title)


def find_date(text: Column) -> Column:
    """First date as YYYY-MM-DD, digits only checked; null when there is none."""

    def dated(text: Column) -> Column:
        def part(i: int) -> Column:
            return F.regexp_extract(text, patterns.PAGE_DATE, i)

        return F.when(
            part(1) != "", F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))
        )

    return bind(text, dated)


def page_date(html: Column) -> Column:
    """Date within the first 2000 visible characters."""
    return find_date(F.substring(F.array_join(text_nodes(drop_hidden(html)), " "), 1, 2000))


def blocks(clean_html: Column) -> Column:
    """Cut before every block tag: array of struct(name, body), document order.

    `name` is the lower-case tag ('/p' for a close tag, '' for the part before the
    first block tag); `body` is the html up to the next block tag.
    """
    marked = F.regexp_replace(F.translate(clean_html, "\u0001", ""), patterns.BLOCK_CUT, "\u0001<")
    pieces = F.split(marked, "\u0001", -1)
    return F.transform(
        pieces,
        lambda p, i: F.struct(
            F.when(i == 0, F.lit("")).otherwise(F.lower(F.regexp_extract(p, patterns.BLOCK_NAME, 1))).alias("name"),
            F.when(i == 0, p).otherwise(F.regexp_replace(p, patterns.FIRST_TAG, "")).alias("body"),
        ),
    )


_SPAN = "struct<len:int,start:int,stop:int>"


def main_container(parts: Column) -> Column:
    """struct(len, start, stop): the container holding most paragraph text directly.

    `parts` is the output of `blocks`; start/stop are 0-based, stop exclusive. One
    pass with a stack of open containers; the earlier container wins ties. Null
    when no container holds paragraph text.
    """
    opens = [F.lit(t) for t in patterns.CONTAINER_TAGS]
    closes = [F.lit("/" + t) for t in patterns.CONTAINER_TAGS]
    steps = F.transform(
        parts,
        lambda b, i: F.struct(
            i.alias("pos"),
            F.when(b["name"].isin(*opens), F.lit("open"))
            .when(b["name"].isin(*closes), F.lit("close"))
            .when(b["name"] == "p", F.lit("p"))
            .otherwise(F.lit("")).alias("kind"),
            F.when(b["name"] == "p", F.length(F.array_join(text_nodes(b["body"]), ""))).otherwise(F.lit(0)).alias("len"),
        ),
    )
    steps = F.filter(steps, lambda s: s["kind"] != "")
    zero = F.struct(
        F.array().cast(f"array<{_SPAN}>").alias("stack"), F.lit(None).cast(_SPAN).alias("best")
    )

    def better(a: Column, b: Column) -> Column:
        wins = (b["len"] > 0) & (
            a.isNull() | (b["len"] > a["len"]) | ((b["len"] == a["len"]) & (b["start"] < a["start"]))
        )
        return F.when(wins, b).otherwise(a)

    def span(length: Column, start: Column, stop: Column) -> Column:
        return F.struct(length.alias("len"), start.alias("start"), stop.alias("stop"))

    def push(acc: Column, s: Column) -> Column:
        return F.struct(
            F.concat(acc["stack"], F.array(span(F.lit(0), s["pos"], F.lit(0)))).alias("stack"), acc["best"].alias("best")
        )

    def pop(acc: Column, s: Column) -> Column:
        top = F.element_at(acc["stack"], -1)
        return F.struct(
            F.slice(acc["stack"], F.lit(1), F.size(acc["stack"]) - 1).alias("stack"),
            better(acc["best"], span(top["len"], top["start"], s["pos"])).alias("best"),
        )

    def grow(acc: Column, s: Column) -> Column:
        top = F.element_at(acc["stack"], -1)
        return F.struct(
            F.concat(
                F.slice(acc["stack"], F.lit(1), F.size(acc["stack"]) - 1),
                F.array(span(top["len"] + s["len"], top["start"], F.lit(0))),
            ).alias("stack"),
            acc["best"].alias("best"),
        )

    def step(acc: Column, s: Column) -> Column:
        inside = F.size(acc["stack"]) > 0
        return (
            F.when(s["kind"] == "open", push(acc, s))
            .when(inside & (s["kind"] == "close"), pop(acc, s))
            .when(inside & (s["kind"] == "p"), grow(acc, s))
            .otherwise(acc)
        )

    def finish(acc: Column) -> Column:
        return F.aggregate(
            acc["stack"],
            acc["best"],
            lambda best, left: better(best, span(left["len"], left["start"], F.size(parts))),
        )

    return F.aggregate(steps, zero, step, finish)


def container_blocks(parts: Column, container: Column) -> Column:
    """Blocks of the chosen container; the whole page unless it holds over 100 characters."""
    return bind(container, lambda chosen: _blocks_of(parts, chosen))


def _blocks_of(parts: Column, container: Column) -> Column:
    return F.when(
        container["len"] > 100,
        F.slice(parts, container["start"] + 1, container["stop"] - container["start"]),
    ).otherwise(parts)


def block_text(parts: Column) -> Column:
    """Paragraphs of more than 10 characters, one per line; all text if none survives."""
    paragraphs = F.transform(
        F.filter(parts, lambda b: b["name"] == "p"), lambda b: F.array_join(text_nodes(b["body"]), " ")
    )
    text = bind(paragraphs, lambda all_of: F.array_join(F.filter(all_of, lambda p: F.length(p) > 10), "\n"))
    everything = F.array_join(F.flatten(F.transform(parts, lambda b: text_nodes(b["body"]))), "\n")
    return bind(text, lambda t: F.when(t != "", t).otherwise(everything))
