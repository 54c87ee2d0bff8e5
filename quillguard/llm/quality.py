"""Quality rules: statistics of a text, and lines that many documents of a host share.

Lines are normalised (A-Z lower-cased, runs of white space as one space) and hashed. For each host
the distinct documents, by id, of every line of whatever length are counted. A line in more than both
min_docs documents and max_share of the host's documents is removed. A document that loses more than
max_lost of its words by that is depleted and rejected, besides those that fail the base rules.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .text import U, Words, lines, lower, mix, pieces, raw, runs_hash, small, spans_hash, windows_hash
from .tokens import forget


@dataclass(frozen=True)
class QualityRules:
    min_docs: int = 20
    max_share: float = 0.01
    max_lost: float = 0.7


SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def _repeated(w: Words, rows: int) -> np.ndarray:
    """Words of each row that are in a 3-word window found twice or more in the row."""
    hashes = w.hashes()
    if len(hashes) < 3:
        return np.zeros(rows, np.int64)
    row = np.repeat(np.arange(rows), np.diff(w.bounds))
    inside = row[2:] == row[:-2]
    keys = mix(windows_hash(hashes, 3) + mix(row[:-2].astype(U)))[inside]
    _, back, counts = np.unique(keys, return_inverse=True, return_counts=True)
    twice = inside.copy()
    twice[inside] = counts[back] > 1
    hit = np.zeros(len(hashes), bool)
    for j in range(3):
        hit[j : len(hashes) - 2 + j] |= twice
    return np.diff(np.concatenate([[0], np.cumsum(hit)])[w.bounds])


def normal_lines(data: np.ndarray, offsets: np.ndarray):
    """Start, end, row, normalised hash and words of each line that has a word."""
    w = Words(lower(data), offsets)
    starts, ends, row = lines(data, offsets)
    a, b = np.searchsorted(w.starts, starts), np.searchsorted(w.starts, ends)
    some = b > a
    starts, ends, row, a, b = starts[some], ends[some], row[some], a[some], b[some]
    return starts, ends, row, runs_hash(w.hashes(), a, b), b - a


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (id, text, host): statistics, two hashes of the text, and its distinct lines with the words of all their places."""
    forget()
    for batch in pieces(batches):
        rows = batch.num_rows
        data, offsets = raw(batch.column(1))
        w = Words(data, offsets)
        spaces = np.zeros(len(data), bool)
        inner = np.zeros(len(data) + 1, np.int64)
        np.add.at(inner, w.starts, 1)
        np.add.at(inner, w.ends, -1)
        spaces = np.cumsum(inner[:-1]) == 0

        def total(flags: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets]).astype(np.int64)

        chars = total(~spaces & ((data & 0xC0) != 0x80))
        symbols = total(SYMBOLS[data])
        starts, ends, row, line, words = normal_lines(data, offsets)
        exact = mix(spans_hash(data, starts, ends) + mix(row.astype(U)))
        firsts = np.unique(exact, return_index=True)[1]
        dup = np.bincount(row, minlength=rows) - np.bincount(row[firsts], minlength=rows)
        h1 = spans_hash(data, offsets[:-1], offsets[1:])
        h2 = mix(runs_hash(w.hashes(), w.bounds[:-1], w.bounds[1:]) ^ h1)
        order = np.lexsort((line, row))
        row, line, words = row[order], line[order], words[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (line[1:] != line[:-1])
        at = np.flatnonzero(new)
        sums = np.add.reduceat(words, at) if len(at) else words
        ends = np.searchsorted(row[at], np.arange(rows + 1)).astype(np.int32)
        each = pa.StructArray.from_arrays([pa.array(line[at].astype(np.int64)), pa.array(sums.astype(np.int64))], ["line", "total"])
        columns = [batch.column(0), batch.column(2), np.diff(w.bounds), chars, symbols, dup, _repeated(w, rows), h1.astype(np.int64), h2.astype(np.int64)]
        names = ["id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "h1", "h2", "lines"]
        yield pa.RecordBatch.from_arrays([*(x if isinstance(x, pa.Array) else pa.array(x.astype(np.int64)) for x in columns), pa.ListArray.from_arrays(pa.array(ends), each)], names)


def _measured(docs: DataFrame, rules: QualityRules, id_col: str, text_col: str, host_col: str) -> tuple[DataFrame, DataFrame, Scratch]:
    """Statistics of each row, and (host, h1, h2, line, total) of the lines to be removed from each distinct text."""
    s = Scratch(docs.sparkSession, "quality")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"))
    kind = texts.schema["id"].dataType.simpleString()
    schema = f"id {kind}, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, h1 long, h2 long, lines array<struct<line:long,total:long>>"
    stats = s.save(texts.mapInArrow(_stats, schema), "stats")
    hosts = s.save(stats.select("host", "id").distinct().groupBy("host").agg(F.count("*").alias("docs")), "hosts")
    each = stats.select("host", "id", "h1", "h2", F.explode("lines").alias("l")).select("host", "id", "h1", "h2", "l.*")
    often = each.select("host", "line", "id").distinct().groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > rules.min_docs)
    often = s.save(often.join(hosts, "host").where(F.col("n") > rules.max_share * F.col("docs")).select("host", "line"), "often")
    return stats, each.join(often, ["host", "line"]).select("host", "h1", "h2", "line", "total").distinct(), s


def quality(docs: DataFrame, rules: QualityRules = QualityRules(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """id_col, the base statistics, base_failed, lost_words and kept for each row of docs.

    A null text has no words, and so fails; a null host counts as the host of the empty name; a null
    id is returned as it is. Rows of one id, and rows without one, count as one document of their host.
    Equal rows are all returned, with the same values. Columns other than
    the three named are not read. An empty table gives none.
    """
    stats, removed, s = _measured(docs, rules, id_col, text_col, host_col)
    lost = s.save(removed.groupBy("host", "h1", "h2").agg(F.sum("total").alias("lost")), "lost")
    out = stats.drop("lines").join(lost, ["host", "h1", "h2"], "left").withColumn("lost_words", F.coalesce("lost", F.lit(0).cast("long")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = ~failed & (F.col("lost_words") <= rules.max_lost * F.col("n_words"))
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"), "lost_words")


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (..., text, gone): the same rows, text without the lines whose hashes are in gone."""
    for batch in small(batches):
        k = batch.num_columns - 2
        texts = batch.column(k).to_pylist()
        gone = batch.column(k + 1).to_pylist()
        for i, (text, drop) in enumerate(zip(texts, gone, strict=True)):
            if drop and text:
                data = np.frombuffer(text.encode(), np.uint8)
                starts, ends, _, line, _ = normal_lines(data, np.array([0, len(data)]))
                cut = np.isin(line.astype(np.int64), drop)
                bad = {(int(a), int(b)) for a, b in zip(starts[cut], ends[cut], strict=True)}
                out, at = [], 0
                for part in text.encode().split(b"\n"):
                    if (at, at + len(part)) not in bad:
                        out.append(part)
                    at += len(part) + 1
                texts[i] = b"\n".join(out).decode()
        yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(texts, pa.string())], batch.schema.names[:-1])


def clean(docs: DataFrame, rules: QualityRules = QualityRules(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of docs that quality() keeps, all columns, text_col without the lines above the limits."""
    _, removed, s = _measured(docs, rules, id_col, text_col, host_col)
    gone = s.save(removed.groupBy("host", "h1", "h2").agg(F.collect_set("line").alias("gone"), F.sum("total").alias("lost")), "gone")
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    host = F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    marks = "n_words long, n_repeat_words long, h1 long, h2 long"
    rest = [c for c in docs.columns if c != text_col]
    wide = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)], host.alias("host"), F.col(text_col).cast("string").alias("text"))
    fields = ", ".join([*(f"c{i} {kinds[c]}" for i, c in enumerate(rest)), "host string", "text string", marks])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, len(rest) + 1):
            got = next(_stats(iter([pa.RecordBatch.from_arrays([batch.column(0), batch.column(len(rest) + 1), batch.column(len(rest))], ["id", "text", "host"])])))
            names = ["n_words", "n_repeat_words", "h1", "h2"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(got.column(n) for n in names)], [*batch.schema.names, *names])

    wide = wide.mapInArrow(measure, fields)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    wide = wide.where(~failed).join(gone.hint("merge"), ["host", "h1", "h2"], "left").where(F.coalesce("lost", F.lit(0)) <= rules.max_lost * F.col("n_words"))
    names = [f"c{i}" for i in range(len(rest))]
    out = wide.select(*names, "text", "gone").mapInArrow(_without, ", ".join([*(f"c{i} {kinds[c]}" for i, c in enumerate(rest)), "text string"]))
    back = {c: F.col(f"c{i}") for i, c in enumerate(rest)} | {text_col: F.col("text")}
    return out.select(*[back[c].alias(c) for c in docs.columns])
