from __future__ import annotations

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from quillguard.llm.text import raw
from quillguard.llm.toxicity import STOPS, Training, features, fit, learn, toxicity

from .conftest import prose


def tables(spark):
    rng, rows = random.Random(2), []
    for k in range(600):
        text, toxic = prose(k, rng.randrange(20, 120)), int(k % 5 == 0)
        if toxic:
            at = rng.randrange(len(text))
            text = f"{text[:at]} {rng.choice(['zorg', 'blip you', 'Krank!'])} {text[at:]}"
        rows.append((k, text, toxic))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return df.select("doc_id", "text"), df.select("doc_id", "toxic"), {i: (t, y) for i, t, y in rows}


def test_held_out_accuracy_and_sentences(spark):
    docs, labels, rows = tables(spark)
    train = labels.where("crc32(cast(doc_id as string)) % 3 != 1")
    out = toxicity(docs, learn(docs, train)).collect()
    assert len(out) == len(rows)
    held = [r for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    hit = [(r["score"] >= 0.7) == bool(rows[r["doc_id"]][1]) for r in held]
    assert np.mean(hit) > 0.95 and all(0 <= r["score"] <= 1 for r in out)
    found = 0
    for r in held:
        text, toxic = rows[r["doc_id"]]
        if toxic and r["score"] >= 0.7:
            told = [text.encode()[s["start"] : s["end"]].decode().lower() for s in r["sentences"]]
            found += any(w in t for t in told for w in ("zorg", "blip", "krank"))
    assert found > 0.9 * sum(bool(rows[r["doc_id"]][1]) for r in held)


def naive(text, weights, bias, bits):
    """Score and sentences of a text, a sentence and a word at a time."""
    data, clean, told, at = (text or "").encode(), 1.0, [], 0
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), data)
    sentences = [(m.start(), m.end()) for m in re.finditer(rb"[^.!?\n]*(?:[.!?\n]|$)", low)]
    parts = [(a, b, re.findall(rb"[0-9a-z\x80-\xff]+", low[a:b])) for a, b in sentences]
    for a, b, words in [x for x in parts if x[2]] or [(0, 0, [])]:
        z = bias
        for w in words:
            found, _, _ = features(np.frombuffer(w, np.uint8), np.array([0, len(w)]), bits)
            z += weights[found].astype(float).sum()
        p = 1 / (1 + math.exp(-z))
        clean *= 1 - p
        if z > 0 and words:
            told.append((a, b, p))
    return 1 - clean, told


def test_brute_force(spark, odd):
    """Scores and spans against a noisy-or over sentences worked out one by one; also by random weights."""
    docs, labels, rows = tables(spark)
    t = Training(bits=12)
    texts = {i: text for i, (text, _) in rows.items() if i < 200} | {1000 + k: r["text"] for k, r in enumerate(odd.collect()) if len(r["text"] or "") < 1000}
    texts |= {2000: "One. two!\n\nThree? É x", 2001: "...", 2002: "no stop", 2003: "\n a.b\x00c "}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    rng = np.random.default_rng(4)
    for weights, bias in (learn(docs, labels, t), (rng.normal(0, 0.5, 1 << 12).astype(np.float32), -1.0)):
        got, seen = {r["doc_id"]: r for r in toxicity(df, (weights, bias), t).collect()}, 0
        for i, text in texts.items():
            score, told = naive(text, weights, bias, t.bits)
            assert abs(got[i]["score"] - score) < 1e-6
            assert [(s["start"], s["end"]) for s in got[i]["sentences"]] == [(a, b) for a, b, _ in told]
            assert all(abs(s["score"] - p) < 1e-6 for s, (_, _, p) in zip(got[i]["sentences"], told, strict=True))
            seen += len(told)
        assert seen > 20


def test_the_sample_is_bounded_in_bytes(spark):
    docs, labels, _ = tables(spark)
    full, part = learn(docs, labels, Training()), learn(docs, labels, Training(max_bytes=20_000))
    assert np.count_nonzero(part[0]) < np.count_nonzero(full[0])
    assert learn(docs, labels, Training(max_bytes=10))[1] == learn(docs.limit(0), labels)[1]
    assert learn(docs, labels, Training(doc_bytes=1))[1] == -5.0


def test_sentences_do_not_cross_rows():
    data, offsets = raw(pa.array(["a b. c", "", None, "d\ne f", "!"]))
    found, inside, of = features(data, offsets, 10)
    assert sorted(of.tolist()) == [0, 0, 1, 2, 3, 3, 4]
    assert np.bincount(inside, minlength=7).tolist() == [2, 1, 1, 2, 0, 0, 0]
    assert STOPS.sum() == 4


def test_one_label_or_none():
    for labels, high in (([], False), ([0, 0], False), ([1, 1], True)):
        _, bias = fit(["a"] * len(labels), np.array(labels), Training())
        assert (bias > 0) == high


def test_odd(spark, odd, none):
    labels = spark.createDataFrame([(None, 1), (1, 1), (2, None), (5, 0), (5, 1), (6, 0)], "doc_id long, toxic int")
    model = learn(odd, labels)
    out = toxicity(odd, model).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    same = [r["score"] for r in out if r["doc_id"] == 5]
    assert same[0] == same[1]
    assert toxicity(none, learn(none, labels)).collect() == []
