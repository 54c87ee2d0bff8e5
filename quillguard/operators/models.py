"""Scorers and detectors over model files, for scored(), batch_score() and detect().

Models are loaded once in a Python worker, from paths that every executor can open. run is the model
itself, (ids, mask) to logits; without one, the model file is run: a container in numpy (encoder.py), others by onnxruntime.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from ..functions.scan import ModelSpan, best_of_type, decode_bio, sliding_windows
from .encoder import load

# What stands around a candidate, the pad id, and the model container's format.
OPEN, CLOSE, PAD = "[CAND]", "[/CAND]", 1
MAGIC, VERSION, KINDS = b"HBIN", 1, {1: "<f4", 2: "<i1", 3: "<i4"}

Run = Callable[[np.ndarray, np.ndarray], np.ndarray]


@lru_cache(4)
def _onnx(path: str) -> Run:
    import onnxruntime

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = 1
    session = onnxruntime.InferenceSession(path, options)
    names = [x.name for x in session.get_inputs()]
    return lambda ids, mask: session.run(None, dict(zip(names, (ids, mask), strict=False)))[0]


def _runner(path: str) -> Run:
    """The model of a file: a container runs in numpy, all else in onnxruntime."""
    with open(path, "rb") as f:
        head = f.read(len(MAGIC))
    return load(path) if head == MAGIC else _onnx(path)


def model_version(path: str) -> str:
    """The name that a model container gives itself; the file's name for others."""
    run = _runner(path) if path.endswith(".hbin") else None
    return getattr(run, "version", "") or os.path.basename(path)


@lru_cache(4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _padded(encodings: list, most: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and masks of a batch, cut to most and padded to its longest."""
    size = max([1, *(min(len(e.ids), most) for e in encodings)])
    ids, mask = np.full((len(encodings), size), PAD, np.int64), np.zeros((len(encodings), size), np.int64)
    for i, e in enumerate(encodings):
        n = min(len(e.ids), most)
        ids[i, :n], mask[i, :n] = e.ids[:n], e.attention_mask[:n]
    return ids, mask


@dataclass(frozen=True)
class SequenceScorer:
    """The probability of class 1 of two for a value in its context. A Scorer."""

    model: str
    tokenizer: str
    max_len: int = 256
    batch: int = 32
    run: Run | None = None

    def __call__(self, triples: list[tuple[str, str, str]]) -> list[float]:
        tokenizer, run = _tokenizer(self.tokenizer), self.run or _runner(self.model)
        texts = [f"{a or ''}{OPEN}{v}{CLOSE}{b or ''}" for a, v, b in triples]
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))  # texts of like lengths together
        out = [0.0] * len(texts)
        for k in range(0, len(order), self.batch):
            part = order[k : k + self.batch]
            logits = np.asarray(run(*_padded(tokenizer.encode_batch([texts[i] for i in part]), self.max_len)), float)
            for i, row in zip(part, logits, strict=True):
                out[i] = float(1 / (1 + np.exp(np.clip(row[0] - row[1], -700, 700))))
        return out


@dataclass(frozen=True)
class TokenDetector:
    """Spans of a token classifier, read in sliding windows of the text's bytes. A Detector."""

    model: str
    tokenizer: str
    labels: tuple[str, ...]
    max_len: int = 384
    run: Run | None = None

    def __call__(self, text: bytes) -> list[ModelSpan]:
        tokenizer, run = _tokenizer(self.tokenizer), self.run or _runner(self.model)
        found = []
        for a, b in sliding_windows(len(text)):
            window = text[a:b].decode("utf-8", "replace")
            e = tokenizer.encode(window)
            ids, mask = _padded([e], self.max_len)
            logits = np.asarray(run(ids, mask), float)[0]
            places = np.cumsum([0, *(len(c.encode()) for c in window)])  # of characters, in bytes
            offsets = [(int(places[x]), int(places[y])) for x, y in e.offsets[: len(logits)]]
            spans = decode_bio(list(self.labels), logits[: len(offsets)].tolist(), offsets, mask[0].tolist()[: len(offsets)])
            found += [s._replace(start=s.start + a, end=s.end + a) for s in spans]
        return best_of_type(found)


def read_bundle(data: bytes) -> tuple[dict, dict[str, np.ndarray]]:
    """Metadata and tensors of a model container."""
    if data[:4] != MAGIC:
        raise ValueError("not a model container")
    version, count, size = struct.unpack_from("<III", data, 4)
    if version != VERSION:
        raise ValueError(f"version {version} is not known")
    at = 16 + size
    meta, tensors = json.loads(data[16:at]), {}
    for _ in range(count):
        (n,) = struct.unpack_from("<I", data, at)
        name = data[at + 4 : at + 4 + n].decode()
        at += 4 + n
        kind, rank = data[at], data[at + 1]
        shape = struct.unpack_from(f"<{rank}I", data, at + 2)
        (n,) = struct.unpack_from("<Q", data, at + 2 + 4 * rank)
        at += 10 + 4 * rank
        if kind not in KINDS or len(data) < at + n:
            raise ValueError(f"{name}: unknown kind, or cut off")
        tensors[name] = np.frombuffer(data[at : at + n], KINDS[kind]).reshape(shape)
        at += n
    return meta, tensors


def dequantized(values: np.ndarray, scales: np.ndarray) -> np.ndarray:
    """Symmetric 8-bit weights by channel (the last axis) as floats."""
    return values.astype(np.float32) * scales.astype(np.float32)
