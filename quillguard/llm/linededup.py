"""Passages that earlier documents have too, found by rare line hashes and removed by patience diff.

Lines are compared in a normal form (A-Z lower-cased, runs of white space as one space). For each line
the documents that have it are counted. Only passages all of whose lines are in two documents or more
can be common, and of those, only such of min_words words count: from each line on, and up to each line,
the fewest lines that have so many words make a run. A run is looked for by its rarest line: documents
meet under that line's hash, those that have the whole run there are paired with the first of them by
id. So a rare line brings few together, and a passage of lines that very many documents have gives a
pair for each and not for any two of them. Every line of a block of min_words words that an earlier
document has is in a run that the first holder of the run has, so no block goes unseen.

A pair is aligned by patience diff: lines that occur once in both, the longest ascending run of them,
and so on between those. Aligned blocks of min_words words or more are removed from the later document,
as are blocks that cross the alignment of others. The first document of a passage keeps it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality import normal_lines
from .scratch import Scratch
from .text import U, pieces, raw, runs_hash, small, spans_hash
from .tokens import forget

#: Words of the shortest block that is removed; pairs of an earlier document that one copy of its lines serves.
MIN_WORDS, SERVED = 50, 1000


def _matches(a: list, b: list, a0: int, a1: int, b0: int, b1: int, out: list) -> None:
    """Aligned places (i, j) of a[a0:a1] and b[b0:b1], in ascending order within a call's ranges."""
    todo = [(a0, a1, b0, b1)]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        counts = Counter(a[a0:a1])
        place = {x: i for i, x in enumerate(a[a0:a1], a0) if counts[x] == 1}
        counts = Counter(b[b0:b1])
        unique = [(place[x], j) for j, x in enumerate(b[b0:b1], b0) if counts[x] == 1 and x in place]
        if unique:
            # the longest run of b's places with ascending places in a
            tops, ends, back = [], [], []
            for k, (i, _) in enumerate(unique):
                at = bisect_left(tops, i)
                tops[at : at + 1] = [i]
                ends[at : at + 1] = [k]
                back.append(ends[at - 1] if at else -1)
            k, run = ends[-1], []
            while k >= 0:
                run.append(unique[k])
                k = back[k]
            i0, j0 = a0, b0
            for i, j in run[::-1]:
                out.append((i, j))
                todo.append((i0, i, j0, j))
                i0, j0 = i + 1, j + 1
            todo.append((i0, a1, j0, b1))
        else:  # only lines that recur: each of b's, in order, with the next equal one of a
            places: dict = {}
            for i in range(a0, a1):
                places.setdefault(a[i], []).append(i)
            i = a0 - 1
            for j in range(b0, b1):
                if i + 1 < a1 and a[i + 1] == b[j]:
                    i += 1
                else:
                    found = places.get(b[j], [])
                    x = bisect_left(found, i + 1)
                    if x == len(found) or j + 1 < b1 and found[x] + 1 < a1 and a[found[x] + 1] != b[j + 1]:
                        continue
                    i = found[x]
                out.append((i, j))


def runs(words: np.ndarray, min_words: int) -> np.ndarray:
    """Distinct (start, end) of the fewest lines with min_words words from each line on, and up to each line."""
    sums = np.concatenate([[0], np.cumsum(words)])
    n = len(words)
    end = np.searchsorted(sums, sums[:-1] + min_words)
    start = np.searchsorted(sums, sums[1:] - min_words, "right") - 1
    on, up = np.flatnonzero(end <= n), np.flatnonzero(start >= 0)
    both = np.concatenate([on * (n + 1) + end[on], start[up] * (n + 1) + up + 1])
    return np.stack(np.divmod(np.unique(both), n + 1), axis=1)


def _inside(spans: np.ndarray, good: np.ndarray) -> np.ndarray:
    """The spans all of whose lines are good."""
    sums = np.concatenate([[0], np.cumsum(good)])
    return spans[sums[spans[:, 1]] - sums[spans[:, 0]] == spans[:, 1] - spans[:, 0]]


def _crossing(earlier: list, later: list, words: list, min_words: int) -> set[int]:
    """Places of later in blocks of min_words words or more that earlier has anywhere, in whatever order."""
    size, has = dict(zip(later, words, strict=True)), set(earlier)
    mine = _inside(runs(np.array(words, np.int64), min_words), np.array([x in has for x in later], bool)).tolist()
    if not mine:
        return set()
    theirs = runs(np.array([size.get(x, 1) for x in earlier], np.int64), min_words)
    theirs = {tuple(earlier[a:b]) for a, b in _inside(theirs, np.array([x in size for x in earlier], bool)).tolist()}
    return {j for a, b in mine if tuple(later[a:b]) in theirs for j in range(a, b)}


def common(earlier: list, later: list, words: list, min_words: int = MIN_WORDS) -> list[int]:
    """Places of later in blocks, of consecutive lines in both, of min_words words or more: aligned ones first,
    then those that cross the alignment."""
    if not earlier or not later:
        return []
    found: list[tuple[int, int]] = []
    _matches(earlier, later, 0, len(earlier), 0, len(later), found)
    block, gone = [], set()
    for i, j in [*sorted(found), (-9, -9)]:
        if block and (i, j) != (block[-1][0] + 1, block[-1][1] + 1):
            if sum(words[y] for _, y in block) >= min_words:
                gone.update(y for _, y in block)
            block = []
        block.append((i, j))
    return sorted(gone | _crossing(earlier, later, words, min_words))


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (id, text): a hash of the text, its lines' hashes and words."""
    forget()
    for batch in pieces(batches):
        data, offsets = raw(batch.column(1))
        _, _, row, line, words = normal_lines(data, offsets)
        ends = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (line.astype(np.int64), words.astype(np.int32))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans_hash(data, offsets[:-1], offsets[1:]).astype(np.int64)), *lists], ["id", "hash", "lines", "words"])


def _keys(min_words: int):
    """Of (id, lines, words, shared lines, how many documents have each): the rarest line and a hash of each run of shared lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            ids, rare, hashes = [], [], []
            for i, lines, words, marks, often in zip(*(batch.column(k) for k in range(5)), strict=True):
                lines, words, marks, often = (x.values.to_numpy() for x in (lines, words, marks, often))
                order = np.argsort(marks)
                marks, often = marks[order], often[order]
                at = np.minimum(np.searchsorted(marks, lines), len(marks) - 1)
                docs = np.where(marks[at] == lines, often[at], 0)
                spans = _inside(runs(words, min_words), docs > 0)
                if len(spans):
                    keys = runs_hash(lines.view(U), spans[:, 0], spans[:, 1]).view(np.int64)
                    least = [min(zip(docs[a:b].tolist(), lines[a:b].tolist(), strict=True))[1] for a, b in spans.tolist()]
                    ids += [i.as_py()] * len(spans)
                    rare += least
                    hashes.append(keys)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rare, pa.int64()), pa.array(np.concatenate(hashes) if hashes else [], pa.int64())], ["id", "rare", "run"])

    return run


def _aligned(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            earlier, later, words = (batch.column(k).to_pylist() for k in (2, 3, 4))
            gone = [common(*x, min_words) for x in zip(earlier, later, words, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gone, pa.list_(pa.int32()))], ["id", "hash", "gone"])

    return run


def _rewritten(text_at: int):
    """Of (..., hash, gone): the rows with the lines in gone taken out of the text, and what was removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            k = batch.num_columns - 1
            texts, n_lines, lost = batch.column(text_at).to_pylist(), [], []
            gone = batch.column(k).to_pylist()
            for i, (text, drop) in enumerate(zip(texts, gone, strict=True)):
                data = np.frombuffer((text or "").encode(), np.uint8)
                starts, ends, _, _, words = normal_lines(data, np.array([0, len(data)]))
                n_lines.append(len(starts))
                lost.append(int(words[drop].sum()) if drop else 0)
                if drop:
                    bad = {(int(a), int(b)) for a, b in zip(starts[drop], ends[drop], strict=True)}
                    out, at = [], 0
                    for part in text.encode().split(b"\n"):
                        if (at, at + len(part)) not in bad:
                            out.append(part)
                        at += len(part) + 1
                    texts[i] = b"\n".join(out).decode()
            columns = list(batch.columns[:k])
            columns[text_at] = pa.array(texts, pa.string())
            columns += [pa.array(n_lines, pa.int64()), pa.array([len(x or ()) for x in gone], pa.int64()), pa.array(lost, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:k], "n_lines", "removed_lines", "removed_words"])

    return run


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs as q_0, q_1, ..., the text without its removed lines, and n_lines (lines with
    a word, before), removed_lines and removed_words.

    Documents of equal id are not compared with each other; equal rows get equal results. Rows with a
    null id are neither earlier nor later than others, and stay as they are, as do null and empty
    texts. An empty table gives none."""
    s = Scratch(docs.sparkSession, "lines")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    profiles = texts.where("id is not null and text is not null").mapInArrow(_profile, "id long, hash long, lines array<long>, words array<int>")
    profiles = s.save(profiles, "profiles")
    # lines of two documents or more, and how many have each; of rows of one id, each counts
    each = profiles.select("id", "hash", F.explode(F.array_distinct("lines")).alias("line"))
    shared = each.groupBy("line").agg(F.count("*").alias("docs"), F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("line", "docs")
    shared = s.save(shared, "shared")
    marks = each.join(shared, "line").groupBy("id", "hash").agg(F.collect_set(F.struct("line", "docs")).alias("marks"))
    marks = s.save(marks, "marks")
    slim = s.save(profiles.join(marks, ["id", "hash"]).dropDuplicates(["id", "hash"]), "slim")
    runs = slim.select("id", "lines", "words", F.col("marks.line").alias("marks"), F.col("marks.docs").alias("often"))
    keys = s.save(runs.mapInArrow(_keys(min_words), "id long, rare long, run long"), "keys")
    firsts = keys.groupBy("rare", "run").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("rare", "run", "first")
    pairs = s.save(keys.join(s.save(firsts, "firsts"), ["rare", "run"]).where("first < id").select("first", "id").distinct(), "pairs")
    # an earlier document of very many pairs is copied, so that its pairs are dealt to many tasks
    serves = s.save(pairs.groupBy("first").agg(F.ceil(F.count("*") / SERVED).cast("int").alias("copies")), "serves")
    salted = s.save(pairs.join(serves, "first").withColumn("salt", F.pmod(F.xxhash64("id"), "copies").cast("int")), "salted")
    half = s.save(salted.join(slim.select("id", "hash", "lines", "words"), "id"), "half")
    served = serves.join(slim.select(F.col("id").alias("first"), F.col("lines").alias("earlier")), "first")
    served = served.select("first", "earlier", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
    both = half.join(served, ["first", "salt"]).select("id", "hash", "earlier", "lines", "words")
    gone = both.mapInArrow(_aligned(min_words), "id long, hash long, gone array<int>").where(F.size("gone") > 0)
    gone = s.save(gone.groupBy("id", "hash").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone")), "gone")
    s.drop("keys", "shared", "marks", "slim", "firsts", "pairs", "salted", "half")

    kinds = [f.dataType for f in docs.schema]
    at = docs.columns.index(text_col)
    kinds[at] = T.StringType()
    fields = [T.StructField(f"q_{i}", k) for i, k in enumerate(kinds)]
    wide = docs.select(*[F.col(c).cast(k).alias(f"q_{i}") for i, (c, k) in enumerate(zip(docs.columns, kinds, strict=True))])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, at):
            data, offsets = raw(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans_hash(data, offsets[:-1], offsets[1:]).astype(np.int64))], [*batch.schema.names, "hash"])

    wide = wide.mapInArrow(hashed, T.StructType([*fields, T.StructField("hash", T.LongType())]))
    own = F.col(f"q_{docs.columns.index(id_col)}").cast("long")
    # one way at every size: texts are shuffled, whether the other side would fit a broadcast or not
    wide = wide.withColumn("id", own).join(gone.hint("merge"), ["id", "hash"], "left").select(*[f.name for f in fields], "gone")
    extra = [T.StructField(n, T.LongType()) for n in ("n_lines", "removed_lines", "removed_words")]
    return wide.mapInArrow(_rewritten(at), T.StructType([*fields, *extra]))


def lines_removed(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, text_col, n_lines, removed_lines and removed_words of dedup_lines(); other columns are not read."""
    out = dedup_lines(docs.select(id_col, text_col), min_words, id_col, text_col)
    return out.withColumnsRenamed({"q_0": id_col, "q_1": text_col})


def clean(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, without the removed lines."""
    out = dedup_lines(docs, min_words, id_col, text_col)
    return out.select(*[F.col(f"q_{i}").alias(c) for i, c in enumerate(docs.columns)])
