"""Interval operators on span tables (key, start, end), in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scan import WINDOW_BYTES, WINDOW_OVERLAP


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (b_start < a_end)


def overlap_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Rows of left and right with the same key and overlapping start, end; right's as r_start, r_end and so on.

    An equi-join on the key; a key's rows are the spans of one text."""
    other = right.select(*[F.col(c) if c == key else F.col(c).alias(f"r_{c}") for c in right.columns])
    l, r = left.alias("l"), other.alias("r")
    on = (F.col(f"l.{key}") == F.col(f"r.{key}")) & overlaps(F.col("l.start"), F.col("l.end"), F.col("r.r_start"), F.col("r.r_end"))
    out = l.join(r, on, how)
    return out if how in ("left_semi", "left_anti") else out.drop(F.col(f"r.{key}"))


def islands(spans: DataFrame, key: str) -> DataFrame:
    """(key, start, end): spans of a key merged where they overlap or touch."""
    w = Window.partitionBy(key).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.select(key, "start", "end", F.when(F.col("start") <= before, 0).otherwise(1).alias("new"))
    grouped = marked.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return grouped.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def windows_around(spans: DataFrame, key: str, size: str = "n_bytes", window: int = WINDOW_BYTES) -> DataFrame:
    """(key, start, end): windows around the middles of spans (key, start, end, size), clamped and merged."""
    middle = F.floor((F.col("start") + F.col("end")) / 2).cast("int")
    around = spans.select(key, F.greatest(middle - window // 2, F.lit(0)).alias("start"), F.least(middle + window // 2, F.col(size)).alias("end"))
    return islands(around.where(F.col("end") > F.col("start")), key)


def sliding(df: DataFrame, key: str, size: str = "n_bytes", window: int = WINDOW_BYTES, overlap: int = WINDOW_OVERLAP) -> DataFrame:
    """(key, start, end): windows that cover each text of size bytes; the last is the first to reach its end."""
    starts = F.explode(F.sequence(F.lit(0), F.col(size) - 1, F.lit(window - overlap)))
    out = df.where(F.col(size) > 0).select(key, size, starts.alias("start"))
    out = out.where((F.col("start") == 0) | (F.col("start") + overlap < F.col(size)))
    return out.select(key, F.col("start").cast("int").alias("start"), F.least(F.col("start") + window, F.col(size)).cast("int").alias("end"))


def confusion(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(type, tp, fp, fn, precision, recall) of found spans against expected ones (key, start, end, type).

    A found span is true if it overlaps an expected one of its type; several may on one. Where nothing
    was found or expected, precision or recall is 1. Types other than secret and pii are left out."""
    types = ("secret", "pii")
    expected, found = expected.where(F.col("type").isin(*types)), found.where(F.col("type").isin(*types))
    pair = lambda a, b: overlap_join(a, b, key, "left_semi")
    counts = None
    for t in types:
        e, f = expected.where(F.col("type") == t), found.where(F.col("type") == t)
        hit, missed = pair(f, e), overlap_join(e, f, key, "left_anti")
        part = hit.select(F.lit(t).alias("type"), F.lit(1).alias("tp"), F.lit(0).alias("fp"), F.lit(0).alias("fn"))
        part = part.union(overlap_join(f, e, key, "left_anti").select(F.lit(t), F.lit(0), F.lit(1), F.lit(0)))
        part = part.union(missed.select(F.lit(t), F.lit(0), F.lit(0), F.lit(1)))
        counts = part if counts is None else counts.union(part)
    out = counts.groupBy("type").agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")])
    share = lambda a, b: F.when(F.col(a) + F.col(b) == 0, 1.0).otherwise(F.col(a) / (F.col(a) + F.col(b)))
    return out.withColumns({"precision": share("tp", "fp"), "recall": share("tp", "fn")})
