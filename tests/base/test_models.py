from __future__ import annotations

import json
import math
import struct

import numpy as np
import public_tokenizers
import pytest

from quillguard.operators import models as M
from quillguard.operators.encoder import Encoder

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def test_scorer_batches_in_order():
    sizes = []

    def run(ids, mask):
        sizes.append(ids.shape)
        n = mask.sum(axis=1)
        return np.stack([np.zeros(len(n)), n / 10], axis=1)

    scorer = M.SequenceScorer("", TOKENIZER, max_len=20, batch=2, run=run)
    triples = [("", "a " * k, "") for k in (30, 1, 5)]
    out = scorer(triples)
    assert out[1] < out[2] < out[0] and len(sizes) == 2 and max(s[1] for s in sizes) == 20
    assert all(0 < p < 1 for p in out) and scorer([]) == []


def test_detector_offsets_are_bytes_of_the_whole_text():
    def run(ids, mask):
        hit = ids == 57  # the token "Z" of the vocabulary
        return np.stack([~hit, hit], axis=2) * 9.0

    text = ("é" * 1000 + " Z " + "é" * 600).encode()
    at = text.index(b"Z")
    got = M.TokenDetector("", TOKENIZER, ("O", "B-pii"), 4096, run)(text)
    assert [(s.start, s.end, s.type) for s in got if text[s.start : s.end].strip() == b"Z"] == [(at, at + 1, "pii")] or got == []
    from tokenizers import Tokenizer

    z = Tokenizer.from_file(TOKENIZER).encode(" Z").ids[-1]

    def run_z(ids, mask):
        hit = ids == z
        return np.stack([~hit, hit], axis=2) * 9.0

    got = M.TokenDetector("", TOKENIZER, ("O", "B-pii"), 4096, run_z)(text)
    assert len(got) == 1 and text[got[0].start : got[0].end].strip() == b"Z"


def bundle(tensors, version=1, meta=None):
    meta = json.dumps(meta or {"model": "m"}).encode()
    out = b"HBIN" + struct.pack("<III", version, len(tensors), len(meta)) + meta
    for name, kind, x in tensors:
        out += struct.pack("<I", len(name)) + name.encode() + bytes([kind, x.ndim]) + struct.pack(f"<{x.ndim}I", *x.shape) + struct.pack("<Q", x.nbytes) + x.tobytes()
    return out


def test_bundle():
    a, b = np.arange(6, dtype="<f4").reshape(2, 3), np.array([1, -2], "<i1")
    meta, got = M.read_bundle(bundle([("a", 1, a), ("b", 2, b)]))
    assert meta == {"model": "m"} and (got["a"] == a).all() and (got["b"] == b).all()
    for bad in (b"nope", bundle([], 2), bundle([("a", 9, a)]), bundle([("a", 1, a)])[:-1]):
        with pytest.raises(ValueError):
            M.read_bundle(bad)
    assert M.dequantized(b, np.array([0.5, 2.0])).tolist() == [0.5, -4.0]


def model(task="", quantised=False, layers=2, hidden=8, heads=2, wide=12, vocab=40, classes=2):
    """(meta, tensors) of a small model with random weights."""
    rng, t = np.random.default_rng(5), {}
    put = lambda name, *shape: t.__setitem__(name, rng.normal(0, 0.4, shape).astype("<f4"))
    body = "m.roberta."
    for name, rows in (("word", vocab), ("position", 30), ("token_type", 1)):
        put(f"{body}embeddings.{name}_embeddings.weight", rows, hidden)
    norms = [f"{body}embeddings.LayerNorm"]
    for k in range(layers):
        p = f"{body}encoder.layer.{k}."
        for name, a, b in (("attention.self.query", hidden, hidden), ("attention.self.key", hidden, hidden), ("attention.self.value", hidden, hidden), ("attention.output.dense", hidden, hidden), ("intermediate.dense", hidden, wide), ("output.dense", wide, hidden)):
            put(f"{p}{name}.weight", a, b)
            put(f"{p}{name}.bias", b)
        norms += [f"{p}attention.output.LayerNorm", f"{p}output.LayerNorm"]
    for n in norms:
        put(f"{n}.weight", hidden)
        put(f"{n}.bias", hidden)
    if task:
        put("m.classifier.weight", hidden, classes)
        put("m.classifier.bias", classes)
    else:
        for n, out in (("dense", hidden), ("out_proj", classes)):
            put(f"m.classifier.{n}.weight", out, hidden)
            put(f"m.classifier.{n}.bias", out)
    meta = {"model": "small", "hidden": hidden, "layers": layers, "heads": heads, "padding_idx": 1, "output_classes": classes, "task": task}
    if quantised:
        for n in [n for n in t if n.endswith(".weight") and t[n].ndim == 2 and ("dense" in n or "self" in n or "out_proj" in n or "word_emb" in n or n == "m.classifier.weight")]:
            x = t[n].T if "classifier." in n and not task else t[n]
            axis = 1 if "word_emb" in n else 0
            scale = np.abs(x).max(axis=axis) / 127
            t[n], t[f"{n}.scale"] = np.rint(x / (scale[:, None] if axis else scale)).astype("<i1"), scale.astype("<f4")
    return meta, t


def slow(meta, t, ids):
    """The same model for one text without padding, a number at a time."""
    value = lambda n: t[n].astype(float) * (t[f"{n}.scale"].astype(float)[:, None] if "word_emb" in n else t[f"{n}.scale"].astype(float)) if f"{n}.scale" in t else t[n].astype(float)
    turned = lambda n: value(n) if f"{n}.scale" in t else value(n).T

    def linear(x, w, b):
        return [sum(x[i] * w[i, j] for i in range(len(x))) + b[j] for j in range(w.shape[1])]

    def norm(x, p):
        mean = sum(x) / len(x)
        var = sum((v - mean) ** 2 for v in x) / len(x)
        return [(v - mean) / math.sqrt(var + 1e-5) * g + b for v, g, b in zip(x, value(f"{p}.weight"), value(f"{p}.bias"), strict=True)]

    e = "m.roberta.embeddings."
    x = [norm(value(f"{e}word_embeddings.weight")[i] + value(f"{e}position_embeddings.weight")[2 + k] + value(f"{e}token_type_embeddings.weight")[0], f"{e}LayerNorm") for k, i in enumerate(ids)]
    size = meta["hidden"] // meta["heads"]
    for layer in range(meta["layers"]):
        p = f"m.roberta.encoder.layer.{layer}."
        lin = lambda n, v: linear(v, value(f"{p}{n}.weight"), value(f"{p}{n}.bias"))  # noqa: B023, E731
        q, k, v = ([lin(f"attention.self.{n}", y) for y in x] for n in ("query", "key", "value"))
        new = []
        for i in range(len(x)):
            mixed = []
            for h in range(0, meta["hidden"], size):
                w = [math.exp(sum(q[i][h + d] * k[j][h + d] for d in range(size)) / math.sqrt(size)) for j in range(len(x))]
                mixed += [sum(w[j] * v[j][h + d] for j in range(len(x))) / sum(w) for d in range(size)]
            y = norm([a + b for a, b in zip(lin("attention.output.dense", mixed), x[i], strict=True)], f"{p}attention.output.LayerNorm")
            wide = [g * 0.5 * (1 + math.erf(g / math.sqrt(2))) for g in lin("intermediate.dense", y)]
            new.append(norm([a + b for a, b in zip(lin("output.dense", wide), y, strict=True)], f"{p}output.LayerNorm"))
        x = new
    if meta["task"]:
        return [linear(y, value("m.classifier.weight"), value("m.classifier.bias")) for y in x]
    h = [math.tanh(g) for g in linear(x[0], turned("m.classifier.dense.weight"), value("m.classifier.dense.bias"))]
    return linear(h, turned("m.classifier.out_proj.weight"), value("m.classifier.out_proj.bias"))


@pytest.mark.parametrize("task", ["", "token_classification"])
@pytest.mark.parametrize("quantised", [False, True])
def test_forward_pass(task, quantised):
    meta, t = model(task, quantised)
    run, texts = Encoder(meta, t), [[3, 7, 7, 11, 30], [5], [9, 2, 4]]
    ids, mask = np.ones((4, 9), np.int64), np.zeros((4, 9), np.int64)
    for k, x in enumerate(texts):
        ids[k, : len(x)], mask[k, : len(x)] = x, 1
    out = run(ids, mask)
    for k, x in enumerate(texts):
        want, got = np.array(slow(meta, t, x)), out[k, : len(x)] if task else out[k]
        assert np.allclose(got, want, atol=2e-4)
        alone = run(ids[k : k + 1], mask[k : k + 1])[0]
        assert np.allclose(alone, got, atol=1e-5)
    assert out.shape == ((4, 5, 2) if task else (4, 2)) and (task or not out[3].any())
    assert not run(ids[3:], mask[3:]).any()


def test_scorer_and_detector_of_a_container(tmp_path):
    kinds = {"<f4": 1, "<i1": 2, "|i1": 2, "int8": 2, "float32": 1}
    for task in ("", "token_classification"):
        meta, t = model(task, vocab=50_257)
        data = bundle([(n, kinds[str(x.dtype)], x) for n, x in t.items()], meta=meta)
        path = tmp_path / f"m{task}.hbin"
        path.write_bytes(data)
        assert M.model_version(str(path)) == "small"
        if task:
            found = M.TokenDetector(str(path), TOKENIZER, ("O", "B-pii"), 28)(b"a few words")
            assert all(0 <= s.start < s.end <= 11 and s.type == "pii" for s in found)
        else:
            out = M.SequenceScorer(str(path), TOKENIZER, max_len=28)([("a", "b", "c"), ("", "long value", "")])
            assert len(out) == 2 and all(0 < p < 1 for p in out) and out[0] != out[1]
    del t["m.classifier.bias"]
    with pytest.raises(ValueError, match="classifier.bias"):
        Encoder(meta, t)
