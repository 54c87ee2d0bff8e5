"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

A sentence's score is a logistic function of the hashed words and word beginnings in it; a document's is
the noisy-or of its sentences, 1 - prod(1 - p). The weights are fitted to document labels only, by
gradients through the noisy-or, on the driver, from a sample of labelled rows that is bounded in rows
and bytes; they take 2 ** bits floats whatever the input. Scoring is one pass without a shuffle, which
also tells the sentences that make a document toxic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import prepare
from .text import U, Words, lower, mix, pieces, raw, spans_hash

#: Bytes between words: all ASCII but letters and digits, after lower-casing.
SEPARATORS = np.zeros(256, bool)
SEPARATORS[:0x80] = True
SEPARATORS[0x30:0x3A] = SEPARATORS[0x61:0x7B] = False
#: Bytes that end a sentence.
STOPS = np.zeros(256, bool)
STOPS[list(b".!?\n")] = True
#: Bytes of the word beginnings that are features, of longer words.
PREFIXES = (4, 5, 6, 7)


@dataclass(frozen=True)
class Training:
    """max_docs, max_bytes: the most labelled rows that are used, and the most bytes of text in all, the first
    in the order of a hash of the id; of those of at most doc_bytes, for the sample alone. z: the least score, in standard deviations, by which a feature is more frequent in documents of
    label 1 for it to get a weight; the rest have none."""

    max_docs: int = 12_000
    max_bytes: int = 64 << 20
    doc_bytes: int = 1 << 20
    bits: int = 18
    z: float = 5.0
    steps: int = 300
    rate: float = 0.1
    l2: float = 1e-5


def features(data: np.ndarray, offsets: np.ndarray, bits: int):
    """Feature numbers, the sentence of each (numbered through all rows), and the row of each sentence.

    Every row has at least one sentence, without features if it has no words."""
    w = Words(lower(data), offsets, SEPARATORS)
    rows = len(offsets) - 1
    row = np.repeat(np.arange(rows), np.diff(w.bounds))
    stops = np.concatenate([[0], np.cumsum(STOPS[data])])
    part = stops[w.starts] + row  # differs between rows and between sentences
    new = np.ones(len(part), bool)
    new[1:] = part[1:] != part[:-1]
    at = np.flatnonzero(new)
    empty = np.setdiff1d(np.arange(rows), row)
    of = np.concatenate([row[at], empty])
    sentence = np.cumsum(new) - 1
    low, length = w.data, w.ends - w.starts
    found, inside = [w.hashes()], [sentence]
    for k in PREFIXES:
        longer = length > k
        found.append(mix(spans_hash(low, w.starts[longer], w.starts[longer] + k) + U(k)))
        inside.append(sentence[longer])
    return (mix(np.concatenate(found)) >> U(64 - bits)).astype(np.int64), np.concatenate(inside), of


def _sums(found, inside, of, weights, bias):
    return np.bincount(inside, weights[found], len(of)) + bias


def _score(z: np.ndarray, of: np.ndarray, rows: int) -> np.ndarray:
    """The noisy-or of each row's sentences."""
    return -np.expm1(-np.bincount(of, np.logaddexp(0, z), rows))


def fit(texts: list[str], labels: np.ndarray, t: Training) -> tuple[np.ndarray, float]:
    """Weights and bias; without rows of both labels the bias alone tells them."""
    weights = np.zeros(1 << t.bits, np.float32)
    if not len(labels) or labels.min() == labels.max():
        return weights, 5.0 if len(labels) and labels[0] else -5.0
    # the document frequency of each feature, then the clearly more frequent ones of label 1; a piece at a time
    df, rows = np.zeros((2, 1 << t.bits)), np.bincount(labels, minlength=2)
    whole = pa.RecordBatch.from_arrays([pa.array(labels), pa.array(texts, pa.string())], ["y", "text"])
    for piece in pieces(iter([whole])):
        y = piece.column(0).to_numpy()
        found, inside, of = features(*raw(piece.column(1)), t.bits)
        seen = np.unique((of[inside] << t.bits) + found)
        for k in (0, 1):
            df[k] += np.bincount((seen & ((1 << t.bits) - 1))[y[seen >> t.bits] == k], minlength=1 << t.bits)
    share = df.sum(axis=0) / len(labels)
    z = (df[1] / rows[1] - df[0] / rows[0]) / np.sqrt(share * (1 - share) * (1 / rows[0] + 1 / rows[1]) + 1e-12)
    good = np.flatnonzero(z >= t.z)
    place = np.full(1 << t.bits, -1)
    place[good] = np.arange(len(good))
    parts, n_rows, n_sentences = [], 0, 0
    for piece in pieces(iter([whole])):
        found, inside, of = features(*raw(piece.column(1)), t.bits)
        keep = place[found] >= 0
        parts.append((place[found[keep]], inside[keep] + n_sentences, of + n_rows))
        n_rows, n_sentences = n_rows + piece.num_rows, n_sentences + len(of)
    found, inside, of = (np.concatenate(x) for x in zip(*parts, strict=True))
    w, m, v = np.append(np.zeros(len(good)), -5.0), np.zeros(len(good) + 1), np.zeros(len(good) + 1)
    for step in range(1, t.steps + 1):
        s = np.bincount(inside, w[found], len(of)) + w[-1]
        q = np.maximum(np.bincount(of, np.logaddexp(0, s), n_rows), 1e-12)
        by_q = np.where(labels == 1, -np.exp(-q) / -np.expm1(-q), 1.0) / n_rows
        by_s = by_q[of] / (1 + np.exp(-np.clip(s, -50, 50)))
        g = np.append(np.bincount(found, by_s[inside], len(good)) + t.l2 * w[:-1], by_s.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= t.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    weights[good] = w[:-1]
    return weights, float(w[-1])


def learn(docs: DataFrame, labels: DataFrame, t: Training = Training(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"):
    """Weights and bias from the rows of labels (id_col, label_col); null ids and labels are left out.

    Of an id with several labels the largest holds; of one with several texts all are used."""
    named = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    chosen = named.orderBy(F.xxhash64("id"), "id").limit(t.max_docs)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = texts.where(F.octet_length("text") <= t.doc_bytes).join(F.broadcast(chosen), "id")  # max_docs rows at most
    order = [F.xxhash64("id"), F.col("id"), F.xxhash64("text")]
    sizes = [r[0] for r in rows.orderBy(*order).select(F.octet_length("text")).limit(t.max_docs).collect()]  # max_docs numbers
    fitting = int(np.searchsorted(np.cumsum(sizes), t.max_bytes, "right"))
    got = rows.select("id", "text", "y").orderBy(*order).limit(fitting).toArrow()
    return fit(got.column("text").to_pylist(), got.column("y").to_numpy(), t)


def _scored(weights: np.ndarray, bias: float, bits: int, sentences: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            data, offsets = raw(batch.column(1))
            found, inside, of = features(data, offsets, bits)
            z = _sums(found, inside, of, weights, bias)
            columns, names = [batch.column(0), pa.array(_score(z, of, batch.num_rows))], ["id", "score"]
            if sentences:
                stops = np.flatnonzero(STOPS[data]) + 1
                w = Words(lower(data), offsets, SEPARATORS)
                first = np.full(len(of), -1)
                row = np.repeat(np.arange(batch.num_rows), np.diff(w.bounds))
                n = inside.max(initial=-1) + 1
                where = np.searchsorted(inside[: len(row)], np.arange(n))  # words come first, in their order
                first[:n] = w.starts[where] if n else 0
                out = [[] for _ in range(batch.num_rows)]
                for k in np.flatnonzero((z > 0) & (first >= 0)):
                    begin, end = offsets[of[k]], offsets[of[k] + 1]
                    x = np.searchsorted(stops, first[k], "right")
                    a = max(begin, stops[x - 1] if x else 0)
                    b = min(end, stops[x] if x < len(stops) else end)
                    out[of[k]].append({"start": int(a - begin), "end": int(b - begin), "score": float(1 / (1 + np.exp(-z[k])))})
                columns.append(pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))))
                names.append("sentences")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def toxicity(docs: DataFrame, model, t: Training = Training(), id_col: str = "doc_id", text_col: str = "text", sentences: bool = True) -> DataFrame:
    """(id_col, score, sentences) for each row of docs; sentences are those of a score over a half, as byte spans.

    A null text counts as empty and gets the score of one sentence without words, whatever a null id
    or further columns. Equal rows get equal scores. An empty table gives none."""
    prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {texts.schema['id'].dataType.simpleString()}, score double" + ", sentences array<struct<start:long,end:long,score:double>>" * sentences
    return texts.mapInArrow(_scored(*model, t.bits, sentences), schema).withColumnRenamed("id", id_col)
