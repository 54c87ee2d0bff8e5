"""Language-model scores by a weighted backoff automaton, with counts of all training texts.

The model is a smoothed trigram model over words and an end token. As an automaton, every bigram and
every word seen in training is a state (what was read last), with an arc for each word that followed
it, and the root holds an arc for every word. Where a state has no arc for a word, its failure arc
leads to the state without its first word, from a word to the root:

    arc of state uv for w:  (c(uvw) + m3 * p(w after v)) / (c(uv) + m3)     failure arc: m3 / (c(uv) + m3)
    arc of state v for w:   (c(vw) + m2 * p(w)) / (c(v) + m2)               failure arc: m2 / (c(v) + m2)
    the root's arcs:        p(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1))

which sums to one over all known words and one unknown word at every state. The weights m2 and m3 are
fitted to the training texts: on average over all training tokens, the failure arcs get what Good and
Turing estimate for n-grams never seen, the share of n-grams that were seen once. A text is read from
left to right, starting and ending at the end token; all texts of a block are read together.

No machine holds the model. Texts are dealt into blocks of bounded bytes. Each block sends its
distinct words, bigrams and trigrams, with its own counts, to the shard of their hash; a shard adds them up
and answers every block that asked, by place in its list, leaving out counts that the block has alone. A block then has
all arcs that its texts can take, and builds its part of the automaton from them. Words are told apart by
64 bits; longer n-grams by as many as keep the chance of a collision below 2 ** -20 at the size of the input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .text import U, Words, lower, mix, pieces, raw

#: Bytes of text in a block, and of all text for each shard of the counts.
BLOCK_BYTES, SHARD_BYTES = 2 << 20, 6 << 20
#: The end token's hash, and the block of the shards' totals.
END, TOTALS = U(0x5DEECE66D1CE4E5B), -1
#: Places of a shard's statistics of one order: keys, tokens, keys seen once, then the number and the tokens of contexts by the bits of their count.
KEYS, TOKENS, ONCE, NUMBER, MASS, PLACES = 0, 1, 2, 3, 67, 131


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences and counts, byte by byte, so that the many zero bytes lie together."""
    steps = np.diff(keys, prepend=U(0))
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes() + counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, counts = (np.ascontiguousarray(x.T).view("<u8").reshape(-1) for x in np.frombuffer(data, np.uint8).reshape(2, 8, -1))
    return np.cumsum(steps, dtype=U), counts.astype(np.int64)


def _pack_some(keep: np.ndarray, counts: np.ndarray) -> bytes:
    """Counts of the kept places of a list, whose keys the receiver has."""
    return np.packbits(keep).tobytes() + counts[keep].astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack_some(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Kept places among n, and their counts."""
    size = -(-n // 8)
    keep = np.unpackbits(np.frombuffer(data, np.uint8, size), count=n).astype(bool)
    counts = np.ascontiguousarray(np.frombuffer(data, np.uint8, offset=size).reshape(8, -1).T).view("<u8").reshape(-1)
    return keep, counts.astype(np.int64)


def width(order: int, size: int) -> int:
    """Bits of the keys of an order for so many bytes of text in all."""
    return 64 if order == 1 else min(64, size.bit_length() + 19)


def _shards(keys: np.ndarray, bits: int, width: int) -> tuple[np.ndarray, list[int]]:
    """The shards that sorted keys of width bits belong to, and where each begins and the last ends."""
    shards = (keys >> U(width - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    some = np.unique(shards)
    return some, np.append(np.searchsorted(shards, some), len(shards)).tolist()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block number for each row of (id, text, train), by bytes within the task."""
    block, size = TaskContext.get().partitionId() << 32, 0
    for batch in pieces(batches):
        if size > BLOCK_BYTES:
            block, size = block + 1, 0
        size += batch.column(1).nbytes
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([block] * batch.num_rows, pa.int64())], ["id", "text", "train", "block"])


class Tokens:
    """The tokens of some texts: each text's word hashes and the end, one after the other."""

    def __init__(self, texts: pa.Array):
        hashes, counts = [], []
        step = pa.RecordBatch.from_arrays([texts, texts], ["a", "b"])
        for batch in pieces(iter([step])):
            data, offsets = raw(batch.column(1))
            w = Words(lower(data), offsets)
            hashes.append(np.insert(w.hashes(), w.bounds[1:], END))
            counts.append(np.diff(w.bounds) + 1)
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, U)
        self.counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        before = np.empty_like(self.hashes)  # every text begins after an end
        before[1:] = self.hashes[:-1]
        before[self.starts] = END
        self.pairs = mix(mix(before + U(1)) + self.hashes)
        self.later = np.ones(len(self.hashes), bool)  # places that have a trigram
        self.later[self.starts] = False
        self.triples = mix(mix(np.append(self.pairs[:1], self.pairs[:-1]) + U(2)) + self.hashes)

    def own(self, train: np.ndarray, order: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys of an order, their places (-1 for none), and how often each is in training texts.

        The lowest bit of a bigram's key tells whether it ends a text, and so is no context."""
        keys = (self.hashes, self.pairs, self.triples)[order - 1] >> U(64 - width(order, size))
        train = np.repeat(train, self.counts)
        if order == 2:
            keys = keys & ~U(1) | (self.hashes == END)
        if order == 3:
            keys, train = keys[self.later], train[self.later]
        found, back = np.unique(keys, return_inverse=True)
        counts = np.bincount(back[train], minlength=len(found))
        if order == 3:
            places = np.full(len(self.hashes), -1)
            places[self.later] = back
            back = places
        return found, back, counts


def _asked(bits: int, size: int):
    """Of (block, texts) the distinct words, bigrams and trigrams with counts, packed for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("order", pa.int32()), ("data", pa.binary())])

        def out(block: int, tables: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(tables).combine_chunks()
            tokens = Tokens(t.column("text").combine_chunks())
            train = t.column("train").to_numpy(zero_copy_only=False).astype(bool)
            for order in (1, 2, 3):
                found, _, n = tokens.own(train, order, size)
                some, at = _shards(found, bits, width(order, size))
                for k in range(0, len(some), 64):
                    data = [_pack(found[a:b], n[a:b]) for a, b in zip(at[k : k + 64], at[k + 1 : k + 65], strict=False)]
                    yield pa.RecordBatch.from_arrays([pa.array(some[k : k + 64], pa.int32()), pa.array([block] * len(data), pa.int64()), pa.array([order] * len(data), pa.int32()), pa.array(data, pa.binary())], schema=schema)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            blocks = batch.column(3).to_numpy()
            at = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1), len(blocks)]
            for a, b in zip(at, at[1:], strict=False):
                if held and held[0].column(3)[0].as_py() != blocks[a]:
                    yield from out(held[0].column(3)[0].as_py(), held)
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield from out(held[0].column(3)[0].as_py(), held)

    return run


def _answered(table: pa.Table) -> pa.Table:
    """For one shard and order: to each block the counts of its keys, where others have some too."""
    order = table.column("order")[0].as_py()
    lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for block, data in zip(table.column("block").to_pylist(), table.column("data"), strict=True):
        keys, own = _unpack(data.as_py())
        if block in lists:  # a block that two tasks have read; places are those in its whole list
            keys, back = np.unique(np.concatenate([lists[block][0], keys]), return_inverse=True)
            own = np.bincount(back, np.concatenate([lists[block][1], own]), len(keys)).astype(np.int64)
        lists[block] = keys, own
    blocks, got = list(lists), list(lists.values())
    del lists
    keys = np.concatenate([k for k, _ in got])
    own = np.concatenate([n for _, n in got])
    row = np.repeat(np.arange(len(got)), [len(k) for k, _ in got])
    del got
    by = np.argsort(keys, kind="stable")  # within a key, by row
    new = np.ones(len(by), bool)
    new[1:] = keys[by[1:]] != keys[by[:-1]]
    at = np.flatnonzero(new)
    sums = np.add.reduceat(own[by], at)
    totals = np.empty_like(own)
    totals[by] = np.repeat(sums, np.diff(np.append(at, len(by))))
    shard, keep = table.column("shard")[0].as_py(), totals != own
    ends = np.searchsorted(row, np.arange(len(blocks) + 1))
    rows = []
    for k, block in enumerate(blocks):
        here = slice(ends[k], ends[k + 1])
        if keep[here].any():
            rows.append({"block": int(block), "shard": shard, "order": order, "data": _pack_some(keep[here], totals[here]), "stats": None})
    rows.append({"block": TOTALS, "shard": shard, "order": order, "data": None, "stats": statistics(sums, sums[keys[by[at]] & U(1) == 0] if order == 2 else sums).tolist()})
    return pa.Table.from_pylist(rows, ANSWER)


ANSWER = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("order", pa.int32()), ("data", pa.binary()), ("stats", pa.list_(pa.int64()))])


def statistics(counts: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """Of the counts of all n-grams of an order, and of those that something follows. Statistics of shards add up."""
    out = np.zeros(PLACES, np.int64)
    out[[KEYS, TOKENS, ONCE]] = (counts > 0).sum(), counts.sum(), (counts == 1).sum()
    contexts = contexts[contexts > 0]
    bits = np.frexp(contexts.astype(float))[1]
    out[NUMBER:MASS] = np.bincount(bits, minlength=64)[:64]
    np.add.at(out, MASS + bits, contexts)
    return out


def fitted(contexts: np.ndarray, ngrams: np.ndarray) -> float:
    """The weight at which the failure arcs of the contexts, by their statistics, get as much as the share of tokens whose n-grams were seen once."""
    number, mass = contexts[NUMBER:MASS].astype(float), contexts[MASS:PLACES].astype(float)
    some = number > 0
    if not some.any() or not ngrams[TOKENS]:
        return 1.0
    mean, mass, share = mass[some] / number[some], mass[some], ngrams[ONCE] / ngrams[TOKENS]
    low, high = 1e-2, 1e6
    for _ in range(100):
        middle = math.sqrt(low * high)
        low, high = (middle, high) if (mass * middle / (mean + middle)).sum() < share * mass.sum() else (low, middle)
    return high


class Automaton:
    """States, arcs and failure arcs that a block's texts can take.

    words: c(w) of each word 0 .. n - 1. pairs: (v, w), and c(vw), of each bigram. triples: (bigram uv, bigram
    vw), and c(uvw), of each trigram. States are ("pair", k), ("word", k) and ("root", 0); only what was seen in
    training is one."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray, triples: np.ndarray, triple_counts: np.ndarray, n: int, v: int, m2: float, m3: float):
        self.words, self.pairs, self.pair_counts, self.triples, self.triple_counts = words, pairs, pair_counts, triples, triple_counts
        p1 = (words + 0.5) / (n + 0.5 * (v + 1))
        p2 = (pair_counts + m2 * p1[pairs[:, 1]]) / (words[pairs[:, 0]] + m2)
        p3 = (triple_counts + m3 * p2[triples[:, 1]]) / (pair_counts[triples[:, 0]] + m3)
        self.root, self.word_arcs, self.pair_arcs = np.log10(p1), np.log10(p2), np.log10(p3)
        self.word_failure, self.pair_failure = np.log10(m2 / (words + m2)), np.log10(m3 / (pair_counts + m3))

    def read(self, word: np.ndarray, pair: np.ndarray, triple: np.ndarray, starts: np.ndarray, begin: int) -> np.ndarray:
        """The log10 probability of each text, all read from left to right together.

        word, pair and triple are the n-grams that end at each place, no trigram (-1) at a text's start. The
        state before a place is that of the longest n-gram read there: the walk is known from what was seen."""
        if not len(starts):
            return np.zeros(0)
        state2 = np.append(begin, word[:-1])
        state2[starts] = begin
        state3 = np.append(0, pair[:-1])
        at_pair = self.pair_counts[state3] > 0
        at_pair[starts] = False
        by_pair = triple >= 0
        by_pair[by_pair] = self.triple_counts[triple[by_pair]] > 0
        by_word = self.pair_counts[pair] > 0
        lower = np.where(by_word, self.word_arcs[pair], np.where(self.words[state2] > 0, self.word_failure[state2], 0.0) + self.root[word])
        steps = np.where(at_pair, self.pair_failure[state3], 0.0) + lower
        steps[by_pair] = self.pair_arcs[triple[by_pair]]
        return np.add.reduceat(steps, starts)


def _scored(n: int, v: int, m2: float, m3: float, bits: int, size: int):
    names = ["id", "train", "n_tokens", "n_known", "base_score", "score"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        text = left.column("text").combine_chunks() if left.num_rows else pa.array([], pa.string())
        tokens = Tokens(text)
        train = left.column("train").to_numpy(zero_copy_only=False).astype(bool)
        answers = dict(zip(zip(right.column("order").to_pylist(), right.column("shard").to_pylist(), strict=True), right.column("data"), strict=True))
        places, counts, ends = [], [], []
        for order in (1, 2, 3):
            distinct, back, count = tokens.own(train, order, size)
            some, at = _shards(distinct, bits, width(order, size))
            for shard, a, b in zip(some.tolist(), at[:-1], at[1:], strict=True):
                if (data := answers.get((order, shard))) is not None:
                    keep, found = _unpack_some(data.as_py(), b - a)
                    count[a:b][keep] = found
            places.append(back)
            counts.append(count)
            if order == 1:
                ends = int(np.searchsorted(distinct, END))
        word, pair, triple = places
        before = np.append(ends, word[:-1])
        before[tokens.starts] = ends
        pairs, triples = np.zeros((len(counts[1]), 2), np.int64), np.zeros((len(counts[2]), 2), np.int64)
        pairs[pair] = np.stack([before, word], axis=1)
        later = np.flatnonzero(tokens.later)
        triples[triple[later]] = np.stack([pair[later - 1], pair[later]], axis=1)
        model = Automaton(counts[0], pairs, counts[1], triples, counts[2], n, v, m2, m3)
        scores = model.read(word, pair, triple, tokens.starts, ends)
        total = lambda x: np.add.reduceat(x, tokens.starts) if len(tokens.starts) else x[:0]
        columns = [left.column("id"), left.column("train"), pa.array(tokens.counts), pa.array(total((counts[0] > 0).astype(np.int64)[word])), pa.array(total(model.root[word])), pa.array(scores)]
        return pa.Table.from_arrays(columns, names)

    return run


def lm_scores(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, train, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    train is a condition on the columns of docs for rows that the counts are taken from; null counts
    as false. score is the automaton's log10 probability, base_score that of its root alone. A null
    text counts as empty and has the end token only; a null id is returned as it is. Repeated rows
    each count and are each returned. Without training rows every word is unknown. An empty table
    gives none."""
    spark = docs.sparkSession
    s = Scratch(spark, "lm")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    kind = texts.schema["id"].dataType.simpleString()
    texts = s.save(texts.mapInArrow(_blocks, f"id {kind}, text string, train boolean, block long"), "texts")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, (size // SHARD_BYTES).bit_length())
    asked = texts.mapInArrow(_asked(bits, size), "shard int, block long, order int, data binary")
    answers = asked.groupBy("shard", "order").applyInArrow(_answered, "block long, shard int, order int, data binary, stats array<long>")
    answers = s.save(answers, "answers")
    # PLACES numbers for each order
    sums = answers.where(F.col("block") == TOTALS).select("order", F.posexplode("stats").alias("at", "x")).groupBy("order", "at").agg(F.sum("x").alias("x"))
    stats = np.zeros((4, PLACES), np.int64)
    for r in sums.collect():
        stats[r["order"], r["at"]] = r["x"]
    n, v = int(stats[1, TOKENS]), int(stats[1, KEYS])
    m2, m3 = fitted(stats[1], stats[2]), fitted(stats[2], stats[3])
    blocks = answers.where(F.col("block") != TOTALS).select("block", "shard", "order", "data")
    out = texts.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(_scored(n, v, m2, m3, bits, size), f"id {kind}, train boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "train", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
