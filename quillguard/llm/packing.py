"""Documents packed into sequences of fixed length by best fit after dominance reduction.

Only the number of pieces of each length matters for the plan, at most as many numbers as a
sequence has tokens, whatever the number of documents; so the plan is made on the driver:

1. reduction (Martello and Toth): sets of pieces that dominate every other way to fill a sequence
   with their largest piece are fixed for good. These are a piece that nothing fits beside, two
   pieces that fill a sequence exactly, and the largest piece that fits beside one where no two fit.
   Fixed pieces are taken out, and the rules apply again to what is left;
2. best fit, in decreasing order of lengths, for the rest: each piece goes to the fullest sequence
   that has room, all pieces and sequences of equal lengths at once.

The plan says for each length which of its pieces, numbered, go to which sequences. Pieces are
numbered by counting each length within a partition and summing the counts over partitions.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .text import pieces
from .tokens import encoder

SEQUENCE = 2048
END_ID = 0


def reduce_dominated(counts: dict[int, int], size: int = SEQUENCE) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Fixed (set, times), and the counts of the lengths that are left."""
    left = Counter({k: n for k, n in counts.items() if n})
    fixed = []

    def fix(group: tuple[int, ...], times: int) -> None:
        fixed.append((group, times))
        for x in group:
            left[x] -= times
            if not left[x]:
                del left[x]

    while left:
        before = len(fixed)
        for j in sorted(left, reverse=True):
            if j not in left:
                continue
            if j == size:
                fix((j,), left[j])
            elif size - j in left:  # fills the sequence: dominates every set with j
                times = left[j] // 2 if 2 * j == size else min(left[j], left[size - j])
                if times:
                    fix((j, size - j), times)
        # lengths beside the largest, while at most one fits
        while left:
            j = max(left)
            small = min(left)
            alone = left[j] == 1 and len(left) == 1
            if alone or j + small > size:
                fix((j,), left[j])
                continue
            second = small if left[small] - (small == j) > 1 else min((x for x in left if x != small), default=None)
            if second is not None and j + small + second <= size:
                break
            best = max((x for x in left if x <= size - j and (x != j or left[j] > 1)), default=None)
            if best is None:
                fix((j,), 1)
                continue
            # as often as both last and the largest that fits stays the same
            fix((j, best), left[j] // 2 if best == j else min(left[j], left[best]))
        if len(fixed) == before:
            break
    return fixed, dict(left)


def best_fit(counts: dict[int, int], size: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """(set, times) of best fit in decreasing order, equal lengths and equal sequences together."""
    bins: dict[int, list[list]] = defaultdict(list)  # by room: [set, times]
    for x in sorted(counts, reverse=True):
        n = counts[x]
        while n:
            room = min((r for r in bins if r >= x), default=None)
            if room is None:
                each = size // x  # best fit puts the next piece of this length in the sequence just begun
                full, rest = divmod(n, each)
                if full:
                    bins[size - each * x].append([(x,) * each, full])
                if rest:
                    bins[size - rest * x].append([(x,) * rest, 1])
                break
            group, times = bins[room].pop()
            if not bins[room]:
                del bins[room]
            each = room // x
            take = min(times, n // each)
            if take:
                bins[room - each * x].append([group + (x,) * each, take])
                n -= take * each
                if take < times:
                    bins[room].append([group, times - take])
            else:
                bins[room - n * x].append([group + (x,) * n, 1])
                if times > 1:
                    bins[room].append([group, times - 1])
                n = 0
    return [(group, times) for x in bins.values() for group, times in x]


def plan(counts: dict[int, int], size: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    fixed, left = reduce_dominated(counts, size)
    return fixed + best_fit(left, size)


def slots(groups: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first, last, each, sequence, offset), sorted: pieces first to last of a length lie
    each in a sequence, one after the other from offset on, in the sequences from sequence on."""
    rows, used, sequence = [], Counter(), 0
    for group, times in groups:
        offset = 0
        for x, each in sorted(Counter(group).items(), reverse=True):
            rows.append((x, used[x], used[x] + times * each, each, sequence, offset))
            used[x] += times * each
            offset += x * each
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def _cut(path: str, size: int):
    """Pieces of (id, text): number, place and ids, and the running number of its length in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        task = TaskContext.get().partitionId()
        seen: Counter = Counter()
        for batch in pieces(batches):
            rows, names = defaultdict(list), ("row", "piece", "start", "length", "nth", "ids")
            for i, data in enumerate(e.encode_many([x or "" for x in batch.column(1).to_pylist()])):
                ids = np.append(np.frombuffer(data, e.dtype), END_ID).astype(e.dtype)
                for k, x in enumerate(range(0, len(ids), size)):
                    part = ids[x : x + size]
                    for name, v in zip(names, (i, k, x, len(part), seen[len(part)], part.tobytes()), strict=True):
                        rows[name].append(v)
                    seen[len(part)] += 1
            n = len(rows["row"])
            columns = [batch.column(0).take(pa.array(rows["row"], pa.int64())), pa.array(rows["piece"], pa.int32()), *(pa.array(rows[x], pa.int64()) for x in names[2:5]), pa.array(rows["ids"], pa.binary()), pa.array([task] * n, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "nth", "ids", "task"])

    return run


def _placed(table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (table[:, 0] << 44) + table[:, 1]
        for batch in batches:
            length, rank = (np.asarray(batch.column(k)) for k in (3, 5))
            at = table[np.searchsorted(keys, (length << 44) + rank, "right") - 1]
            nth = rank - at[:, 1]
            crc = [zlib.crc32(np.frombuffer(x, f"<u{len(x) // n}").astype("<u4")) for x, n in zip(batch.column(4).to_pylist(), length.tolist(), strict=True)]
            columns = [*batch.columns[:4], pa.array(crc, pa.int64()), pa.array(at[:, 4] + nth // at[:, 3]), pa.array(at[:, 5] + nth % at[:, 3] * length), batch.column(4)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "crc", "sequence", "offset", "ids"])

    return run


def pack(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset, ids) for each piece of each row of docs.

    ids are the piece's token ids, little-endian, of 2 bytes each or of 4 where the vocabulary needs them;
    ids_crc32 is made from these ids, as 4 bytes each. A sequence is its pieces' ids in order of offset.
    A document's ids end with END_ID; longer ones than size are cut into pieces of size. A null text
    counts as empty, a null id is returned as it is; equal rows are each packed. The plan sent to the
    executors has some rows for each length, a few times size at most. An empty table gives none."""
    s = Scratch(docs.sparkSession, "packing")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    cut = s.save(texts.mapInArrow(_cut(tokenizer, size), f"id {kind}, piece int, start long, length long, nth long, ids binary, task int"), "pieces")
    by_task = s.save(cut.groupBy("length", "task").agg(F.count("*").alias("n")), "by_task")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # size rows at most
    table = slots(plan(counts, size))
    bases = by_task.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("base"))
    bases = s.save(bases, "bases")
    ranked = cut.join(bases, ["length", "task"]).select("id", "piece", "start", "length", "ids", (F.col("base") + F.col("nth")).alias("rank"))
    out = ranked.mapInArrow(_placed(table), f"id {kind}, piece int, start long, length long, crc long, sequence long, offset long, ids binary")
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"), F.col("sequence").alias("sequence_id"), "offset", "ids")
