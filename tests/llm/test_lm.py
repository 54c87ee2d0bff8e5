from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quillguard.llm import lm
from quillguard.llm.queries import _part

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*WORD.findall((text or "").translate(LOWER)), None]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def weight(contexts, ngrams):
    """Where the failure arcs' share of the contexts' tokens is that of n-grams seen once; contexts of like counts stand for their mean."""
    groups = {}
    for c in contexts:
        groups.setdefault(c.bit_length(), []).append(c)
    share, low, high = sum(c == 1 for c in ngrams) / sum(ngrams), 1e-2, 1e6
    for _ in range(200):
        m = math.sqrt(low * high)
        failed = sum(sum(g) * m / (sum(g) / len(g) + m) for g in groups.values())
        low, high = (m, high) if failed < share * sum(contexts) else (low, m)
    return high


def brute(rows):
    uni, pairs, triples = Counter(), Counter(), Counter()
    for i, text in rows:
        if not held(i):
            t = tokens(text)
            uni.update(t)
            pairs.update(zip([None, *t], t, strict=False))
            triples.update(zip([None, *t], t, t[1:], strict=False))
    n, v = sum(uni.values()), len(uni)
    m2 = weight(list(uni.values()), list(pairs.values())) if pairs else 1
    m3 = weight([c for (_, b), c in pairs.items() if b is not None], list(triples.values())) if triples else 1
    out = []
    for i, text in rows:
        t = tokens(text)
        p = [(uni[w] + 0.5) / (n + 0.5 * (v + 1)) for w in t]
        q = [(pairs[a, b] + m2 * x) / (uni[a] + m2) for a, b, x in zip([None, *t], t, p, strict=False)]
        r = q[:1] + [(triples[a, b, c] + m3 * x) / (pairs[a, b] + m3) for a, b, c, x in zip([None, *t], t, t[1:], q[1:], strict=False)]
        out.append((i, not held(i), len(t), sum(uni[w] > 0 for w in t), n, sum(map(math.log10, p)), sum(map(math.log10, r))))
    return out


def check(df, rows, train=None):
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    got = sorted(map(tuple, lm.lm_scores(df, _part(5) != 1 if train is None else train).collect()), key=key)
    want = sorted(brute(rows), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


@pytest.mark.parametrize("block,shard", [(lm.BLOCK_BYTES, lm.SHARD_BYTES), (500, 3000)])
def test_brute_force(docs, sample, monkeypatch, block, shard):
    monkeypatch.setattr(lm, "BLOCK_BYTES", block)
    monkeypatch.setattr(lm, "SHARD_BYTES", shard)
    check(docs, [(i, t) for i, t, _ in sample])


def test_blocks_that_several_tasks_read(spark, docs, sample, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 10**9)
    monkeypatch.setattr(lm, "SHARD_BYTES", 5000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("parquet.block.size", "1024")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        check(docs.coalesce(1), [(i, t) for i, t, _ in sample])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        for k in ("parquet.block.size", "spark.sql.files.openCostInBytes"):
            spark.conf.unset(k)


def test_a_block_in_two_lists():
    import pyarrow as pa

    a, b, c = (np.array(x, np.uint64) for x in ([2, 5], [5, 8], [8]))
    one = lambda x: np.ones(len(x), np.int64)
    rows = [{"shard": 0, "block": k, "order": 2, "data": lm._pack(x, one(x))} for k, x in ((7, a), (7, b), (8, c))]
    *out, totals = lm._answered(pa.Table.from_pylist(rows)).to_pylist()
    assert [(r["block"], *(x.tolist() for x in lm._unpack_some(r["data"], n))) for r, n in zip(out, (3, 1), strict=True)] == [(7, [False, False, True], [2]), (8, [True], [2])]
    stats = totals["stats"]  # 2 once, 5 twice and the end of a text, 8 twice
    assert (stats[lm.KEYS], stats[lm.TOKENS], stats[lm.ONCE]) == (3, 5, 1) and sum(stats[lm.MASS :]) == 3 and stats[lm.NUMBER + 2] == stats[lm.NUMBER + 1] == 1


def test_odd(odd, none):
    check(odd, [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert lm.lm_scores(none, _part(5) != 1).collect() == []


def test_without_training(docs):
    from pyspark.sql import functions as F

    out = lm.lm_scores(docs, F.lit(None).cast("boolean")).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["score"] == r["base_score"] == 0 for r in out)


def test_states_sum_to_one():
    """Over all known words and one unknown, by arcs and failure arcs followed one at a time."""
    text = [0, 1, 1, 0, 2, 1, 1, 2, 3, 0, 1, 2, 3]  # 3 is the end
    ends, n, v = 3, 13, 4
    words = np.bincount(text)
    before, texts = Counter(), Counter()
    a, last = 3, None
    for w in text:
        before[a, w] += 1
        if last is not None and last[1] != ends:
            texts[*last, w] += 1
        last, a = (a, w), w
    pairs = sorted(before)
    place = {p: k for k, p in enumerate(pairs)}
    triples = sorted(texts)
    model = lm.Automaton(words, np.array(pairs), np.array([before[p] for p in pairs]), np.array([(place[t[:2]], place.get(t[1:], 0)) for t in triples]), np.array([texts[t] for t in triples]), n, v, 1.5, 0.7)
    unknown = math.log10(0.5 / (n + 0.5 * (v + 1)))

    def step(state, w):
        """The log10 weight of reading w: the state's arc, or its failure arc and then the next state's."""
        if len(state) == 2:
            if (*state, w) in texts:
                return model.pair_arcs[triples.index((*state, w))]
            return model.pair_failure[place[state]] + step(state[1:], w)
        if len(state) == 1:
            return model.word_arcs[place[*state, w]] if (*state, w) in place else model.word_failure[state[0]] + step((), w)
        return model.root[w] if w is not None else unknown

    for state in [(), *((w,) for w in range(4)), *(p for p in pairs if p[1] != ends)]:
        assert math.isclose(sum(10 ** step(state, w) for w in (0, 1, 2, 3, None)), 1)
    # reading all together is reading one at a time
    starts, got = np.array([0, 9]), []
    pair = np.array([place[x] for x in zip([3, *text[:-1]], text, strict=True)])
    triple = np.array([triples.index(x) if k not in (0, 9) else -1 for k, x in enumerate(zip([3, 3, *text[:-2]], [3, *text[:-1]], text, strict=True))])
    for part in (text[:9], text[9:]):
        got.append(sum(step(tuple([3, *part[:k]][-2:]) if k else (3,), w) for k, w in enumerate(part)))
    assert np.allclose(model.read(np.array(text), pair, triple, starts, ends), got)


def test_width_of_keys():
    assert lm.width(1, 10) == 64 and lm.width(2, 1 << 29) == 49 and lm.width(3, 10**15) == 64


def test_packing():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2))
    counts = np.arange(len(keys))
    k, c = lm._unpack(lm._pack(keys, counts))
    assert (k == keys).all() and (c == counts).all()
    keep = counts % 3 == 1
    some, c = lm._unpack_some(lm._pack_some(keep, counts), len(counts))
    assert (some == keep).all() and (c == counts[keep]).all()


def test_held_out_text_is_more_likely_than_by_words_alone(spark):
    rows = [(k, " ".join(f"w{(k * 7 + j) % 50}" for j in range(200))) for k in range(60)]
    out = lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), _part(5) != 1).where("not train").collect()
    assert out and all(r["score"] > r["base_score"] for r in out)
