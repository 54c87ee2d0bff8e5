"""Suppression of false hits as Spark columns: shapes, example markers, comments, URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scan
from ..functions.regex import to_java


def _matches(value: Column, pattern: str) -> Column:
    return F.rlike(value, F.lit(to_java(pattern)))


def plain_shape(value: Column) -> Column:
    """Whether a value is a UUID, a hash, a date, a URL or a short word."""
    out = F.lit(False)
    for p in scan.PLAIN_SHAPES:
        out = out | F.rlike(value, F.lit("^(?:" + to_java(p) + ")"))
    return out


def line_at(text: Column, start: Column) -> Column:
    """The line around a byte offset."""
    data = text.cast("binary")
    head = F.substring(data, F.lit(1), start).cast("string")
    tail = F.substring(data, start + 1, F.octet_length(text)).cast("string")
    return F.concat(F.substring_index(head, "\n", -1), F.substring_index(tail, "\n", 1))


def line_above(text: Column, start: Column) -> Column:
    """The line above that; null on the first line."""
    head = F.substring(text.cast("binary"), F.lit(1), start).cast("string")
    lines = F.split(head, "\n", -1)
    return F.when(F.size(lines) > 1, F.get(lines, F.size(lines) - 2))


def comment(line: Column) -> Column:
    """Whether a line is a comment without anything like an assignment."""
    prefixes = "|".join("".join("\\" + c for c in p) for p in scan.COMMENT_PREFIXES)
    body = F.regexp_replace(line, F.lit(f"^[ \\t]*(?:{prefixes})"), F.lit(""))
    return F.rlike(line, F.lit(f"^[ \\t]*(?:{prefixes})")) & ~_matches(body, scan.ASSIGNMENT)


def example(text: Column, start: Column) -> Column:
    """Whether the line of an offset, or a comment right above it, marks an example."""
    line, above = line_at(text, start), line_above(text, start)
    own = _matches(line, scan.EXAMPLE_MARKER) | _matches(line, scan.EXAMPLE_PLACEHOLDER)
    return own | F.coalesce((above != "") & comment(above) & _matches(above, scan.EXAMPLE_MARKER), F.lit(False))


def inside_url(text: Column, start: Column, end: Column) -> Column:
    """Whether a span lies inside a URL on its line."""
    head = F.substring(text.cast("binary"), F.lit(1), start).cast("string")
    begin = F.octet_length(F.substring_index(head, "\n", -1))
    line = line_at(text, start)
    from ..functions.rules import Rule
    from ..functions.spans import match_spans

    urls = match_spans(line, Rule("url", scan.URL))
    return F.exists(urls, lambda u: (u["start"] <= begin) & (begin + end - start <= u["end"]))
