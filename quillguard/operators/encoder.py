"""The forward pass of a RoBERTa-like classifier in numpy, for models that come as a container file.

It runs inside a Python worker, a batch at a time: (ids, mask) to logits, of a text (sequence
classification) or of each token (token classification).
"""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path

import numpy as np

# Names of tensors in a container, the norm's epsilon, and what is added to the scores of padding.
BODY, HEAD = "m.roberta.", "m.classifier"
EPSILON, MASKED = 1e-5, np.float32(-1e9)


def erf(x: np.ndarray) -> np.ndarray:
    """The error function to 2e-7 (Abramowitz and Stegun 7.1.26)."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.sign(x) * (1 - poly * np.exp(-x * x))


def gelu(x: np.ndarray) -> np.ndarray:
    return (x * 0.5 * (1 + erf(x.astype(np.float64) / np.sqrt(2)))).astype(np.float32)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Encoder:
    """A model of read_bundle(): meta and tensors. Weights of 8 bits are made floats once."""

    def __init__(self, meta: dict, tensors: dict[str, np.ndarray]):
        self.meta, self.tensors = meta, tensors
        self.version = meta.get("model", "")
        self.by_token = meta.get("task") == "token_classification"
        self.layers = [self._layer(f"{BODY}encoder.layer.{k}.") for k in range(meta["layers"])]
        e = f"{BODY}embeddings."
        self.words, self.types = (self._floats(f"{e}{n}_embeddings.weight", rows=True) for n in ("word", "token_type"))
        self.places = self._floats(f"{e}position_embeddings.weight", rows=True)
        self.norm = self._pair(f"{e}LayerNorm")
        if self.by_token:
            self.head = [(self._floats(f"{HEAD}.weight"), self._floats(f"{HEAD}.bias"))]
        else:  # floats are stored with outputs first, bytes with inputs first
            self.head = [(self._floats(f"{HEAD}.{n}.weight", outputs_first=True), self._floats(f"{HEAD}.{n}.bias")) for n in ("dense", "out_proj")]

    def _floats(self, name: str, rows: bool = False, outputs_first: bool = False) -> np.ndarray:
        if name not in self.tensors:
            raise ValueError(f"the model has no {name}")
        x = self.tensors[name]
        if x.dtype != np.int8:
            return np.ascontiguousarray((x.T if outputs_first else x).astype(np.float32))
        if f"{name}.scale" not in self.tensors:
            raise ValueError(f"the model has no {name}.scale")
        scale = self.tensors[f"{name}.scale"].astype(np.float32)
        return x.astype(np.float32) * (scale[:, None] if rows else scale)

    def _pair(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        return self._floats(f"{name}.weight"), self._floats(f"{name}.bias")

    def _layer(self, p: str) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        names = {"q": "attention.self.query", "k": "attention.self.key", "v": "attention.self.value", "mix": "attention.output.dense", "mix_norm": "attention.output.LayerNorm"}
        names |= {"wide": "intermediate.dense", "narrow": "output.dense", "norm": "output.LayerNorm"}
        return {k: self._pair(p + n) for k, n in names.items()}

    @staticmethod
    def _normal(x: np.ndarray, by: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        centred = x - x.mean(axis=-1, keepdims=True)
        return centred / np.sqrt((centred * centred).mean(axis=-1, keepdims=True) + EPSILON) * by[0] + by[1]

    def __call__(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Logits of rows of token ids, mask 1 for tokens and 0 for padding; zero for rows of padding alone."""
        size = int(mask.any(axis=0).nonzero()[0].max(initial=-1)) + 1  # padding at the end of all rows changes nothing
        rows, labels = len(ids), self.head[-1][1].shape[0]
        if not size:
            return np.zeros((rows, 0, labels) if self.by_token else (rows, labels), np.float32)
        ids, mask = ids[:, :size], mask[:, :size] != 0
        pad, heads = self.meta.get("padding_idx", 1), self.meta["heads"]
        x = self.words[ids] + self.places[np.where(mask, pad + np.cumsum(mask, axis=1), pad)] + self.types[0]
        x = self._normal(x, self.norm)
        hidden = np.where(mask, np.float32(0), MASKED)[:, None, None, :]
        split = lambda y: y.reshape(rows, size, heads, -1).transpose(0, 2, 1, 3)
        for layer in self.layers:
            q, k, v = (split(x @ layer[n][0] + layer[n][1]) for n in "qkv")
            share = softmax(q @ k.transpose(0, 1, 3, 2) / np.float32(np.sqrt(q.shape[-1])) + hidden)
            mixed = (share @ v).transpose(0, 2, 1, 3).reshape(rows, size, -1)
            x = self._normal(mixed @ layer["mix"][0] + layer["mix"][1] + x, layer["mix_norm"])
            wide = gelu(x @ layer["wide"][0] + layer["wide"][1])
            x = self._normal(wide @ layer["narrow"][0] + layer["narrow"][1] + x, layer["norm"])
        if self.by_token:
            return x @ self.head[0][0] + self.head[0][1]
        (w1, b1), (w2, b2) = self.head
        out = np.tanh(x[:, 0] @ w1 + b1) @ w2 + b2
        out[~mask.any(axis=1)] = 0
        return out


@lru_cache(4)
def load(path: str) -> Encoder:
    """The model of a container file, once for each Python worker."""
    from .models import read_bundle

    return Encoder(*read_bundle(Path(path).read_bytes()))
