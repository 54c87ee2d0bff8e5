"""Token ids of whole texts, with the ids of words that recur kept."""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np

#: White space to str.split that a tokenizer's \s does not know; texts with it are encoded whole.
_ODD = "\x1c\x1d\x1e\x1f"
#: What stands right before a stop or comma, but for ASCII letters and digits and white space.
_BEFORE = re.compile(r"[.,](?<=([^A-Za-z0-9\s]).)")
# The normalizer and the pre-tokenizer of tokenizers whose words between white space are independent.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PIECES = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
#: Words kept at most, about 200 bytes each, before all are dropped; and the length of the longest.
KEPT, LONGEST = 500_000, 40


class Encoder:
    """Ids of a tokenizers file, equal to those of its own encode() on whole texts.

    Where the file's normalizer and pre-tokenizer are NORMALIZER and PIECES, words between white space
    are encoded apart and kept. Any other tokenizer gets its texts whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        size = max(vocabulary.values(), default=0) + 1
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.code = "H" if size <= 1 << 16 else "I"  # as array.array has them on machines of this byte order
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = re.compile("|".join(re.escape(x.content) for x in added) or "(?!)")
        known = json.loads(self.tokenizer.to_str())
        pre = known["pre_tokenizer"] or {}
        plain = all(x.content.startswith("<|") and not (x.normalized or x.lstrip or x.rstrip or x.single_word) for x in added)
        self.exact = not (plain and known["normalizer"] == NORMALIZER and (pre.get("pretokenizers") or [pre])[0] == PIECES)
        #: Whether a stop after this character is a piece of its own.
        self.apart: dict[str, bool] = {}
        self.kept: dict[str, bytes] = {}
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = None
        if suffix:  # whether a token ends a word
            self.ends = np.zeros(size, bool)
            self.ends[[i for w, i in vocabulary.items() if w.endswith(suffix)]] = True

    def _ids(self, words: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _each(self, words: list[str]) -> list[bytes]:
        """The ids of each word. Words of letters alone are encoded as one text, where each ends with a
        token that ends a word."""
        plain = [w for w in words if w.isalpha()] if self.ends is not None else []
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, self.dtype)
        at = np.flatnonzero(self.ends[ids]) + 1 if len(plain) else []
        if len(at) != len(plain):
            return self._ids(words)
        data, width = ids.tobytes(), self.dtype.itemsize
        stops = (np.asarray(at) * width).tolist()
        known = dict(zip(plain, (data[a:b] for a, b in zip([0, *stops], stops, strict=False)), strict=True))
        rest = [w for w in words if w not in known]
        known.update(zip(rest, self._ids(rest), strict=True))
        return [known[w] for w in words]

    def _stands_apart(self, c: str) -> bool:
        """Whether the normal form of c ends with a letter or digit, so that a stop or comma after it begins a piece."""
        if c not in self.apart:
            normal = self.tokenizer.normalizer.normalize_str(c)
            self.apart[c] = all(self.tokenizer.pre_tokenizer.pre_tokenize_str(normal + x)[-1][0] == x for x in ".,")
        return self.apart[c]

    def _split(self, text: str) -> list[str] | None:
        """Parts of a text that are encoded apart, fewer different ones than its words; None if it has to be taken whole."""
        if self.exact or any(c in text for c in _ODD) or "<|" in text and self.special.search(text):
            return None
        # characters of Latin-1 lower-case one by one and need no composition
        if len(text.encode("latin-1", "ignore")) == len(text):
            text = text.lower()
        if all(map(self._stands_apart, set(_BEFORE.findall(text)))):
            text = text.replace(",", " ,").replace(".", " .")
        return text.split()

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, in dtype's bytes, without special tokens added."""
        kept = self.kept
        if len(kept) > KEPT:
            kept.clear()
        out: list[list[bytes]] = []
        gaps: list[tuple[list[bytes], list[str], list[int]]] = []
        new: set[str] = set()
        for text in texts:
            words = self._split(text)
            found = self._ids([text]) if words is None else list(map(kept.get, words))
            out.append(found)
            if words and None in found:
                places = [i for i, x in enumerate(found) if x is None]
                new.update([words[i] for i in places])
                gaps.append((found, words, places))
        if new:
            missing = list(new)
            kept.update(zip(missing, self._each(missing), strict=True))
        for found, words, places in gaps:
            for i in places:
                found[i] = kept[words[i]]
        for w in new:
            if len(w) > LONGEST:
                del kept[w]
        return [b"".join(x) for x in out]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    return Encoder(path)


def forget() -> None:
    """Drop the words that this Python worker keeps; for operators that it runs next."""
    encoder.cache_clear()
