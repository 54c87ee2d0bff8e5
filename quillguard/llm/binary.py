"""Token ids in flat binary files with 64-bit document offsets.

A table is written as a folder of files, one for each range of ids, in ascending order of the
numbers in their names. A file is, in little-endian integers:

    ids of all its documents, each with its end id last (uint16, or uint32 for larger vocabularies)
    zero bytes up to a multiple of 8
    document ids (int64 each), the place of each document's first id and of the end (int64, one more)
    one byte for each document, 1 where its id is null; zero bytes up to a multiple of 8
    the number of documents (int64); MAGIC; the end id once more

so that all its arrays can be memory-mapped as they are, which open_tokens() does. Spark's text writer
writes the files, a document a line with the end id's bytes as line end: any store that Spark writes
to will do, a task that is lost leaves nothing, and a document is all that is in memory at once. The
place of a document among all ids is its place in its file plus the ids of all files before it, by
prefix sums over the files. Files in a folder that executors mount are read through the map; of
other stores, Spark reads them whole, which the bound on a file's bytes allows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, prepare
from .text import pieces
from .tokens import encoder

#: Fixed values of the format.
MAGIC = b"QGTOKEN1"
END_ID = 1
#: Bytes of text for each file: the least, the most, and the files at which they grow from one to the other.
FILE_BYTES, LARGEST, FILES = 16 << 20, 256 << 20, 20_000
#: Files of a group in the prefix sums, and documents of a batch read back.
GROUP, ROWS = 1024, 1 << 16


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        ids, sizes, pad = [], [], lambda n: bytes(-n % 8)
        for batch in pieces(batches):
            values = e.encode_many([x or "" for x in batch.column(1).to_pylist()])
            ids += batch.column(0).to_pylist()
            sizes += [len(x) // e.dtype.itemsize + 1 for x in values]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.binary())], ["value"])
        if ids:
            null = np.array([x is None for x in ids], np.uint8)
            docs = np.array([x or 0 for x in ids], "<i8")
            starts = np.concatenate([[0], np.cumsum(sizes)]).astype("<i8")
            rest = [pad(int(starts[-1]) * e.dtype.itemsize), docs.tobytes(), starts.tobytes(), null.tobytes(), pad(len(ids)), np.array(len(ids), "<i8").tobytes(), MAGIC]
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(rest)], pa.binary())], ["value"])

    return run


def write_tokens(docs: DataFrame, out: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every whole text, in ascending order of the ids of documents, null ids first.

    A null text counts as empty. Rows with equal ids are all written, in the order of their texts' hashes."""
    prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    texts = texts.withColumns({"h": F.xxhash64("text"), "tie": F.monotonically_increasing_id()})
    order = ["id", "h", "tie"]
    each = min(max(size // FILES, FILE_BYTES), max(LARGEST, FILE_BYTES))
    texts = texts.repartitionByRange(max(1, -(-size // each)), *order).sortWithinPartitions(*order).select("id", "text")
    wide = len(np.zeros(1, encoder(tokenizer).dtype).tobytes())
    end = "".join(map(chr, np.array(END_ID, f"<u{wide}").tobytes()))
    rows = texts.mapInArrow(_encoded(tokenizer), "value binary").select(F.col("value").cast("string").alias("value"))
    rows.write.option("lineSep", end).option("compression", "none").text(out)


def file_parts(content, dtype: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, document ids, offsets and null flags in a file's bytes, without a copy."""
    end = len(content) - np.dtype(dtype).itemsize
    if bytes(content[end - len(MAGIC) : end]) != MAGIC:
        raise ValueError("not a token file")
    end -= len(MAGIC) + 8
    n = int(np.frombuffer(content, "<i8", 1, end)[0])
    end -= n + -n % 8
    null = np.frombuffer(content, np.uint8, n, end)
    starts = np.frombuffer(content, "<i8", n + 1, end - 8 * (n + 1))
    docs = np.frombuffer(content, "<i8", n, end - 8 * (2 * n + 1))
    return np.frombuffer(content, dtype, int(starts[-1])), docs, starts, null


def open_tokens(path: str, dtype: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """file_parts() of a file of a mounted folder, memory-mapped: what is not looked at is not read."""
    return file_parts(np.memmap(path, np.uint8, "r"), dtype)


def _documents(part: int, parts: tuple) -> Iterator[pa.RecordBatch]:
    ids, docs, starts, null = parts
    for k in range(0, len(docs), ROWS):
        at = starts[k : k + ROWS + 1]
        crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        n = len(crc)
        columns = [pa.array([part] * n, pa.int64()), pa.array(docs[k : k + n].astype(np.int64), mask=null[k : k + n] == 1), pa.array(at[:-1].astype(np.int64)), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["part", "id", "place", "n", "crc"])


def _read(dtype: str):
    """Of (part, path, size, content) the documents; without a content, from the mapped file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, path, size, content in zip(*batch.columns, strict=True):
                if size.as_py():
                    content = content.as_buffer()
                    yield from _documents(part.as_py(), open_tokens(path.as_py(), dtype) if content is None else file_parts(memoryview(content), dtype))

    return run


def read_tokens(spark, path: str, tokenizer: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32) of each document of the files in path."""
    prepare(spark)
    s = Scratch(spark, "tokens")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    local = s.scheme(path) == "file"
    content = F.lit(None).cast("binary") if local else F.col("content")
    where = F.regexp_replace("path", "^file:(//)?", "")
    part = F.regexp_extract("path", r"/part-(\d+)[^/]*$", 1).cast("long")
    found = files.select(part.alias("part"), where.alias("path"), F.col("length").alias("size"), content.alias("content"))
    found = s.save(found.mapInArrow(_read(encoder(tokenizer).dtype.str), "part long, id long, place long, n long, crc long"), "found")
    # prefix sums over groups of files, then over the files of each group
    sizes = s.save(found.groupBy("part").agg(F.sum("n").alias("n")).withColumn("group", F.expr(f"part div {GROUP}")), "sizes")
    groups = sizes.groupBy("group").agg(F.sum("n").alias("n"))
    groups = groups.select("group", (F.sum("n").over(Window.orderBy("group")) - F.col("n")).alias("before"))
    inner = F.sum("n").over(Window.partitionBy("group").orderBy("part")) - F.col("n")
    bases = s.save(sizes.select("part", "group", inner.alias("base")).join(groups, "group").select("part", (F.col("before") + F.col("base")).alias("base")), "bases")
    return found.join(bases, "part").select(F.col("id").alias(id_col), (F.col("base") + F.col("place")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def token_files(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the token files of docs in the shared folder and read them back."""
    s = Scratch(docs.sparkSession, "token-files")
    write_tokens(docs, s.path("files"), tokenizer, id_col, text_col)
    return read_tokens(docs.sparkSession, s.path("files"), tokenizer, id_col)
