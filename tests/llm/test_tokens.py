from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from quillguard.llm import binary, packing
from quillguard.llm.binary import open_tokens, read_tokens, token_files, write_tokens
from quillguard.llm.tokens import Encoder


@pytest.fixture(scope="module")
def plain(tokenizer):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def all_texts(sample, odd):
    return [t for _, t, _ in sample] + [r["text"] for r in odd.collect()]


def test_encoder_is_the_tokenizer(tokenizer, plain, sample, odd):
    e = Encoder(tokenizer)
    more = ["Hello, World. it's WE'LL o'clock a.b,c. ,. ..", "İstanbul ΣΑΣ. ǅ  x y\u0085z", "á ́b", "<|startoftext|>x", "1,234.50, x2."]
    for _ in range(2):
        for text in all_texts(sample, odd) + more:
            assert np.frombuffer(e.encode(text or ""), e.dtype).tolist() == plain(text)


def test_every_character_beside_a_stop_or_comma(tokenizer):
    from tokenizers import Tokenizer

    e = Encoder(tokenizer)
    texts = [f"a{chr(c)}, {chr(c)}.{chr(c)}" for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    want = Tokenizer.from_file(tokenizer).encode_batch(texts, add_special_tokens=False)
    assert [t for t, a, b in zip(texts, e.encode_many(texts), want, strict=True) if np.frombuffer(a, e.dtype).tolist() != b.ids] == []


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_any_tokenizer(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng, signs = random.Random(3), "ab c.,'\"!-éñßİΣςक़क़́ \n\t\x85\u3000०漢かな゙각😀<|>_𝔸ǅﬡ.,"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(20_000)] + ["a <|endoftext|>. b", "<|startoftext|>,x", ""]
    e, want = Encoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name)).encode_batch(texts, add_special_tokens=False)
    assert e.exact == (name != "word_bpe_49k.json")
    assert [t for t, a, b in zip(texts, e.encode_many(texts), want, strict=True) if np.frombuffer(a, e.dtype).tolist() != b.ids] == []


def test_token_files(docs, odd, sample, tokenizer, plain):
    for df, rows in ((docs, [(i, t) for i, t, _ in sample]), (odd, [(r["doc_id"], r["text"]) for r in odd.collect()])):
        expected, start = [], 0
        for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
            ids = [*plain(text), 1]
            expected.append((i, start, len(ids), crc(ids)))
            start += len(ids)
        out = [tuple(r) for r in token_files(df, tokenizer).orderBy("start").collect()]
        assert out == expected


def test_files_are_mapped(docs, tokenizer, plain, sample, tmp_path, monkeypatch):
    monkeypatch.setattr(binary, "FILE_BYTES", 3_000)
    write_tokens(docs, f"file://{tmp_path}/t", tokenizer)
    parts = sorted(p for p in (tmp_path / "t").iterdir() if p.name.startswith("part"))
    assert len(parts) > 3
    ids, order = [], []
    for p in parts:
        arrays = open_tokens(str(p), "<u2")
        x, names, starts, null = arrays
        assert all(isinstance(a.base, np.memmap) or not a.flags.owndata for a in arrays)
        assert starts[-1] == len(x) and not null.any()
        assert names.ctypes.data % 8 == starts.ctypes.data % 8 == 0
        ids += x.tolist()
        order += names.tolist()
    assert order == sorted(i for i, _, _ in sample)
    assert ids == [x for _, t, _ in sorted(sample) for x in [*plain(t), 1]]


@pytest.mark.parametrize("mounted", [True, False])
def test_files_are_in_the_order_of_their_numbers(spark, docs, tokenizer, tmp_path, monkeypatch, mounted):
    """Names past part-99999, some groups of files, and files that can't be mapped."""
    monkeypatch.setattr(binary, "FILE_BYTES", 3_000)
    monkeypatch.setattr(binary, "GROUP", 2)
    if not mounted:
        monkeypatch.setattr(binary.Scratch, "scheme", lambda self, path: "store")
    write_tokens(docs, f"file://{tmp_path}/t", tokenizer)
    key = lambda r: r["start"]
    want = sorted(read_tokens(spark, f"file://{tmp_path}/t", tokenizer).collect(), key=key)
    for k, p in enumerate(sorted(p for p in (tmp_path / "t").iterdir() if p.name.startswith("part"))):
        p.rename(p.with_name(f"part-{99_998 + k:05d}" + p.name[10:]))
    assert sorted(read_tokens(spark, f"file://{tmp_path}/t", tokenizer).collect(), key=key) == want


def test_token_files_empty(none, tokenizer):
    assert token_files(none, tokenizer).collect() == []


def check_packing(rows, out, plain, size=packing.SEQUENCE):
    expected = []
    for i, text in rows:
        ids = [*plain(text), 0]
        expected += [(i, k, x, len(ids[x : x + size]), crc(ids[x : x + size])) for k, x in enumerate(range(0, len(ids), size))]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted((tuple(r)[:5] for r in out), key=key) == sorted(expected, key=key)
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(bins), -(-sum(r["length"] for r in out) // size)


def test_pack(docs, odd, none, sample, tokenizer, plain):
    n, least = check_packing([(i, t) for i, t, _ in sample], packing.pack(docs, tokenizer).collect(), plain)
    assert n <= least + 1
    check_packing([(r["doc_id"], r["text"]) for r in odd.collect()], packing.pack(odd, tokenizer).collect(), plain)
    assert packing.pack(none, tokenizer).collect() == []


def test_pack_returns_the_ids(spark, tokenizer, plain):
    texts = {k: "some packed words " * n for k, n in ((1, 5), (2, 1500), (3, 0))}
    out = packing.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), tokenizer).collect()
    back = {k: [] for k in texts}
    for r in sorted(out, key=lambda r: (r["doc_id"], r["piece"])):
        ids = np.frombuffer(r["ids"], f"<u{len(r['ids']) // r['length']}")
        assert len(ids) == r["length"] and crc(ids) == r["ids_crc32"]
        back[r["doc_id"]] += ids.tolist()
    assert back == {k: [*plain(t), 0] for k, t in texts.items()}


def least_bins(items, size):
    """The fewest bins, by trying all."""
    best = [len(items)]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for i, r in enumerate(rooms):
            if r >= items[k] and r not in rooms[:i]:
                go(k + 1, [*rooms[:i], r - items[k], *rooms[i + 1 :]])
        go(k + 1, [*rooms, size - items[k]])

    go(0, [])
    return best[0]


def test_reduction_keeps_the_optimum_and_plan_is_complete():
    rng = np.random.default_rng(0)
    for _ in range(300):
        size = int(rng.integers(8, 30))
        items = sorted(rng.integers(1, size + 1, rng.integers(1, 10)).tolist(), reverse=True)
        counts = {x: items.count(x) for x in items}
        fixed, left = packing.reduce_dominated(counts, size)
        rest = sorted((x for x, n in left.items() for _ in range(n)), reverse=True)
        assert sum(n for _, n in fixed) + least_bins(rest, size) == least_bins(items, size)
        groups = packing.plan(counts, size)
        back = {}
        for group, times in groups:
            assert sum(group) <= size
            for x in group:
                back[x] = back.get(x, 0) + times
        assert back == counts


def test_best_fit_is_best_fit_decreasing():
    rng = np.random.default_rng(1)
    for _ in range(200):
        items = sorted(rng.integers(1, 21, rng.integers(1, 60)).tolist(), reverse=True)
        rooms = []
        for x in items:
            fit = [i for i, r in enumerate(rooms) if r >= x]
            if fit:
                rooms[min(fit, key=lambda i: rooms[i])] -= x
            else:
                rooms.append(20 - x)
        assert sum(n for _, n in packing.best_fit({x: items.count(x) for x in items}, 20)) == len(rooms)
