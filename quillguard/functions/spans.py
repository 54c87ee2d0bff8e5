"""Matches of one rule as Spark column expressions, with byte offsets and without Python.

Spark has no function for the positions of matches. The texts between matches (split) and the matches
(regexp_extract_all) together give them: a match starts after all texts and matches before it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import split_group, to_java
from .rules import Rule


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """Bytes start to end of a string, as a string; a character cut in two becomes U+FFFD."""
    part = F.substring(text.cast("binary"), start + 1, end - start)
    return F.make_valid_utf8(part.cast("string"))


def match_spans(text: Column, rule: Rule) -> Column:
    """array<struct<start int, end int>> of a rule's values, in order; null text gives an empty array."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    java = to_java(rule.pattern)
    found = F.regexp_extract_all(text, F.lit(java), F.lit(0))
    gaps = F.split(text, java, -1)
    size = F.size(found)
    # (start of match) for all matches: running sums, kept as one array of ends
    steps = F.transform(found, lambda m, i: F.struct(F.octet_length(F.get(gaps, i)).alias("gap"), F.octet_length(m).alias("match")))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["match"]
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("out"))

    spans = F.aggregate(steps, begin, step, lambda acc: acc["out"])
    if rule.group:
        split = to_java(split_group(rule.pattern))
        heads = F.regexp_extract_all(text, F.lit(split), F.lit(1))
        values = F.regexp_extract_all(text, F.lit(split), F.lit(2))

        def value(s: Column, i: Column) -> Column:
            start = s["start"] + F.octet_length(F.get(heads, i))
            return F.struct(start.alias("start"), (start + F.octet_length(F.get(values, i))).alias("end"))

        spans = F.transform(spans, value)
    empty = F.array().cast("array<struct<start:int,end:int>>")
    return F.when(F.rlike(text, F.lit(java)) & (size >= 0), spans).otherwise(empty)


def line_of(text: Column, start: Column) -> Column:
    """1 and the line breaks before a byte offset."""
    head = F.substring(text.cast("binary"), F.lit(1), start).cast("string")
    return F.octet_length(head) - F.octet_length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def column_of(text: Column, start: Column) -> Column:
    """The 1-based byte after the last line break before a byte offset."""
    head = F.substring(text.cast("binary"), F.lit(1), start).cast("string")
    return F.octet_length(F.substring_index(head, "\n", -1)) + 1


def redact(value: Column) -> Column:
    """Stars for up to six bytes; else the first and last three bytes and stars between them."""
    n = F.octet_length(value)
    ends = F.concat(byte_slice(value, F.lit(0), F.lit(3)), F.repeat(F.lit("*"), n - 6), byte_slice(value, n - 3, n))
    return F.when(n <= 6, F.repeat(F.lit("*"), n)).otherwise(ends)


def shannon_entropy(value: Column) -> Column:
    """Bits: over distinct characters, their count by the value's bytes; 0 for an empty value."""
    n = F.octet_length(value)
    chars = F.array_distinct(F.filter(F.split(value, ""), lambda c: c != ""))

    def term(acc: Column, c: Column) -> Column:
        p = (F.char_length(value) - F.char_length(F.replace(value, c, F.lit("")))) / n
        return acc - p * F.log2(p)

    return F.when(n == 0, F.lit(0.0)).otherwise(F.aggregate(chars, F.lit(0.0), term))
