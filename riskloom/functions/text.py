"""Small text expressions shared by the other modules."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, functions as F

from .. import patterns


def quoted(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def words(values: Iterable[str]) -> Column:
    """Literal ARRAY<STRING>, built in one call however long it is."""
    return F.expr(f"cast(array({', '.join(map(quoted, values))}) as array<string>)")


def lookup(table: dict[str, str | list[str]], key: Column) -> Column:
    """Value of `key` in a literal map; null if it has none."""
    parts = []
    for name, value in table.items():
        held = quoted(value) if isinstance(value, str) else f"array({', '.join(map(quoted, value))})"
        parts += [quoted(name), held]
    return F.try_element_at(F.expr(f"map({', '.join(parts)})"), key)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once, however often the body names it.

    Common-subexpression elimination does not reach into array functions, so an array
    expression written twice runs twice.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Drop leading and trailing white space of any kind."""
    return F.regexp_replace(text, patterns.EDGE_SPACE, "")


def present(text: Column) -> Column:
    """Null for an empty string, the text otherwise."""
    return F.when(text != "", text)


def contained(text: Column, phrases: Iterable[str]) -> Column:
    """The phrases that occur in `text`, each once, in the given order."""
    return bind(text, lambda t: contained_in(t, phrases))


def contained_in(text: Column, phrases: Iterable[str]) -> Column:
    """`contained` for a text that is a plain column or bound already."""
    return F.filter(words(phrases), lambda w: F.contains(text, w))


def first_marker(text: Column, values: dict[str, str]) -> Column:
    """Value of the first marker (in order) found in `text`; null if none is."""
    return lookup(values, F.get(contained(text, values), F.lit(0)))


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, patterns.URL_HOST, 1)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def case_key(text_hash: Column, url: Column) -> Column:
    """Identifier that depends on the content alone, so a retried task repeats it."""
    return F.substring(F.sha2(F.concat_ws("|", text_hash, url), 256), 1, 32)
