from __future__ import annotations

import random

from quillguard.llm import linededup
from quillguard.llm.linededup import MIN_WORDS, clean, common, lines_removed

from .conftest import prose


def long_line(k, words=60):
    return prose(k, words, 10**6).replace("\n", " ")


def test_common_blocks():
    for earlier, later, gone in (
        ("abcdef", "xabcy", [1, 2, 3]), ("abcdef", "defabc", [0, 1, 2, 3, 4, 5]), ("abcdef", "axbxcx", []),  # single lines are too short
        ("aaaa", "xaa", [1, 2]), ("abab", "zabz", [1, 2]), ("", "ab", []), ("ab", "", []),
    ):
        assert common(list(earlier), list(later), [30] * len(later)) == gone
    assert common(list("ab"), list("ab"), [49, 0], 50) == []


def test_common_finds_planted_blocks():
    rng = random.Random(4)
    for _ in range(300):
        block = [rng.randrange(10**6) for _ in range(rng.randrange(2, 6))]
        a, b = ([rng.randrange(30) for _ in range(rng.randrange(12))] for _ in range(2))
        i, j = rng.randrange(len(a) + 1), rng.randrange(len(b) + 1)
        later = b[:j] + block + b[j:]
        got = common(a[:i] + block + a[i:], later, [25] * len(later))
        assert set(range(j, j + len(block))) <= set(got)


def test_common_is_every_block_that_both_have():
    assert common(list("Pxy"), list("xyP"), [8, 8, 60]) == [2]
    assert common(list("PQxyz"), list("xyzPQw"), [8, 8, 8, 30, 30, 9]) == [3, 4]
    assert common(list("xyPPQ"), list("PQxzy"), [30, 30, 8, 8, 8]) == [0, 1]
    rng = random.Random(6)
    for _ in range(2000):
        words = [rng.choice([5, 10, 30, 60]) for _ in range(9)]
        a, b = ([rng.randrange(9) for _ in range(rng.randrange(14))] for _ in range(2))
        assert common(a, b, [words[x] for x in b]) == sorted(shared_places([a], b, words.__getitem__))


def shared_places(earlier, later, size):
    """Places of later in blocks of enough words that one of earlier has."""
    blocks = {tuple(a[i:k]) for a in earlier for i in range(len(a)) for k in range(i + 1, len(a) + 1) if sum(map(size, a[i:k])) >= MIN_WORDS}
    return {j for i in range(len(later)) for k in range(i + 1, len(later) + 1) if tuple(later[i:k]) in blocks for j in range(i, k)}


def test_every_line_of_a_common_block_is_found(spark, monkeypatch):
    """Documents of few lines in many orders: what goes is what is in a block that any earlier document has."""
    monkeypatch.setattr(linededup, "SERVED", 7)
    rng = random.Random(8)
    lines = [long_line(300 + k, rng.choice([5, 10, 20, 30, 45, 55])) for k in range(40)]
    texts = {i: [lines[min(int(rng.expovariate(0.12)), 39)] for _ in range(rng.randrange(9))] for i in range(120)}
    for i in range(0, 120, 3):  # parts of earlier documents
        other = texts[rng.randrange(i + 1)]
        a = rng.randrange(len(other) + 1)
        texts[i] = texts[i][:2] + other[a : a + 4] + texts[i][2:]
    out = {r["doc_id"]: r["text"] for r in lines_removed(table(spark, [(i, "\n".join(t), "s", 1) for i, t in texts.items()]).repartition(3)).collect()}
    for i, t in texts.items():
        gone = shared_places([texts[k] for k in range(i)], t, lambda x: len(x.split()))
        assert out[i] == "\n".join(x for j, x in enumerate(t) if j not in gone)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lines int")


def test_first_document_keeps_a_passage(spark):
    passage, multi = long_line(1), "\n".join(long_line(k, 20) for k in (2, 3, 4))
    own = [long_line(100 + k) for k in range(40)]
    rows = [(5, f"{own[0]}\n{passage}\n{multi}", "s", 1), (9, f"{multi.upper()}\n\n{own[1]}\n {passage}  ", "s", 1), (7, f"{own[2]}\n{passage}", "s", 1)]
    rows += [(20 + k, f"{own[k]}x\n{passage}\nThis short line is everywhere.", "s", 1) for k in range(3, 30)]
    out = {r["doc_id"]: r for r in lines_removed(table(spark, rows)).collect()}
    assert out[5]["text"] == rows[0][1] and out[5]["removed_lines"] == 0
    assert out[9]["text"] == f"\n{own[1]}" and out[9]["removed_lines"] == 4 and out[9]["n_lines"] == 5
    assert out[7]["text"] == own[2] and out[7]["removed_words"] == 60
    for k in range(3, 30):  # with the short line, which 23 has first, the passage is one block
        assert out[20 + k]["text"] == f"{own[k]}x" + "\nThis short line is everywhere." * (k == 3)
    kept = clean(table(spark, rows))
    assert kept.columns == ["doc_id", "text", "source", "lines"]
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == {i: r["text"] for i, r in out.items()}


def test_brute_force(docs, sample):
    """The lines that are in a block of enough words of an earlier document go, and no others."""
    import re

    norm = lambda x: " ".join(re.findall(r"[^\x20\x09-\x0D]+", x.lower()))
    out = {r["doc_id"]: r["text"] for r in lines_removed(docs).collect()}
    lines = {i: [n for x in t.split("\n") if (n := norm(x))] for i, t, _ in sample}
    changed = 0
    for i, t, _ in sample:
        gone = shared_places([lines[e] for e in lines if e < i], lines[i], lambda x: len(x.split()))
        changed += bool(gone)
        assert [n for x in out[i].split("\n") if (n := norm(x))] == [x for j, x in enumerate(lines[i]) if j not in gone]
        if not gone:
            assert out[i] == t
    assert changed > 10


def test_odd(odd, none):
    rows = odd.collect()
    out = lines_removed(odd).collect()
    key = lambda r: (r["doc_id"] or 0, r["text"] or "")
    assert [(r["doc_id"], r["text"]) for r in sorted(out, key=key)] == [(r["doc_id"], r["text"]) for r in sorted(rows, key=key)]
    assert all(r["removed_lines"] == 0 for r in out)
    assert lines_removed(none).collect() == [] and clean(none).columns == none.columns
