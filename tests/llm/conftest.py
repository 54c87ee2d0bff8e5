from __future__ import annotations

import random

import pytest

ODD = [
    (None, "a b c d e f", "h"),
    (1, None, None),
    (2, "", "h"),
    (3, " \n\t\x0b ", "h"),
    (4, "One", "h"),
    (5, "one two three", "h"),
    (5, "one two three", "h"),
    (6, "word " * 60_000, "h"),
    (7, "É́ <|endoftext|> \x1c\x00 ünï\r\ncode 'tis don't 12345 …", None),
    (8, "x" * 50_000, ""),
]


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    out = []
    for k in range(words):
        out.append(f"w{int(rng.paretovariate(0.6)) % vocabulary}" + rng.choice(["", "", "", ",", "."]))
        out.append("\n" if k % 17 == 16 else " ")
    return "".join(out).strip()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns named as operators' own."""
    rows = [(i, t, s, "x", 1, 2.0, "y") for i, t, s in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, id string, n int, key double, label string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def sample():
    """(id, text, source): prose, copies, near copies, shared lines, junk."""
    rng = random.Random(5)
    out = []
    for k in range(60):
        out.append([3 * k + 1, prose(k, rng.choice([3, 20, 60, 120, 300]), 3000), f"s{k % 3}"])
    for k in range(60):
        base = out[rng.randrange(20)][1].split(" ")
        for _ in range(rng.randrange(0, max(1, len(base) // 20) + 1)):
            base[rng.randrange(len(base))] = f"e{rng.randrange(10**6)}"
        out.append([1000 - k, " ".join(base), f"s{k % 3}"])
    for k in range(20):
        out.append([2000 + k, "spam ham " * (k + 1), "s0"])
    for k, row in enumerate(out):
        if k % 2:
            row[1] = "This line is shared.\n" + row[1]
    return [tuple(x) for x in out]


@pytest.fixture(scope="session")
def docs(spark, sample):
    return spark.createDataFrame(sample, "doc_id long, text string, source string").repartition(5)


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
