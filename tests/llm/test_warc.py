from __future__ import annotations

import gzip
import hashlib
import random

import pytest

from quillguard.llm import warc
from quillguard.llm.scratch import Scratch
from quillguard.llm.warc import END, LoserTree, archive, capture_time, order_key, parsed, record, url_key, write_archives


def expected(rows):
    firsts = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 100:
            firsts[html] = min(i, firsts.get(html, i))
    out = []
    for i, _, html in rows:
        data, first = (html or "").encode(), firsts.get(html)
        first = None if first == i else first
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if first is None else "revisit", first))
    return out


def key(r):
    return tuple((x is not None, x or 0) for x in r)


TRICKY = [
    (None, None, None), (3, "http://A.b.com/x?b=1&a=2#f", ""), (4, "https://www.a.b.com:443/X", "\r\n\r\n"), (5, "not a url\n", "x\r\n\r\n\r\ny\r\n"),
    (6, "http://a.b/é ü", "é" * 60), (7, "http://[bad", "é" * 60), (2, "http://c.d", "é" * 60), (8, "http://c.d/", "s" * 99), (9, "http://c.d/", "s" * 99),
    (10, "http://c.d/", "\r\n" * 60), (11, "http://c.d/", "\r\n" * 60), (12, "", "WARC/1.1\r\n\r\n" * 20), (12, "", "WARC/1.1\r\n\r\n" * 20), (13, "u:p@", "t\r" * 70), (14, None, "a" * 300_000),
    (15, "http://c.d/", "z\r\n\r\n" * 30), (None, "http://c.d/", "é" * 60),
]


def pages(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, id int, digest string").repartition(parts)


def test_round_trip(spark):
    out = archive(pages(spark, TRICKY))
    assert sorted((tuple(r)[:5] for r in out.collect()), key=key) == sorted(expected(TRICKY), key=key)


def test_test_data_in_order(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [(r["page_id"], r["url"], r["html"]) for r in df.collect()]
    rows += [(10**6 + i, u, h) for i, u, h in rows[:40]]
    got = archive(pages(spark, rows, 7)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(expected(rows), key=key)
    order = [(r["url_key"], r["captured"], r["page_id"]) for r in sorted(got, key=lambda r: r["position"])]
    assert order == sorted(order) and sorted(r["position"] for r in got) == list(range(len(rows)))


def test_pieces_of_runs_in_any_order(spark, monkeypatch):
    """Many runs in parts of few entries, whose pieces are dealt at random before they are merged."""
    monkeypatch.setattr(warc, "PART_ROWS", 50)
    rng = random.Random(9)
    rows = [(k, f"http://{rng.choice('abc')}.x/{rng.randrange(40)}", "t") for k in range(400)]
    read = Scratch.save

    def shuffled(self, df, name):
        return read(self, df, name).orderBy("digest", "nth") if name == "runs" else read(self, df, name)

    monkeypatch.setattr(Scratch, "save", shuffled)
    got = archive(pages(spark, rows, 7)).collect()
    order = [(r["url_key"], r["captured"], r["page_id"]) for r in sorted(got, key=lambda r: r["position"])]
    assert order == sorted((url_key(u), f"{capture_time(i):%Y-%m-%dT%H:%M:%SZ}", i) for i, u, _ in rows)


def test_empty(spark):
    assert archive(pages(spark, TRICKY).limit(0)).collect() == []


def test_files_are_warc(spark, tmp_path):
    write_archives(pages(spark, TRICKY), f"file://{tmp_path}/w", Scratch(spark, "t"), "page_id", "url", "html")
    data = b"".join(gzip.open(p).read() for p in sorted((tmp_path / "w").glob("part-*.gz")))
    n, at = 0, 0
    while at < len(data):
        head, _, _ = data[at:].partition(END.encode())
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ")
        size = int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])[b"Content-Length"])
        at += len(head) + 4 + size
        assert data[at : at + 4] == END.encode()
        at, n = at + 4, n + 1
    assert n == len(TRICKY)


def test_damage_is_seen():
    good = record(1, "http://a", b"abc", hashlib.sha256(b"abc").hexdigest(), None, False)
    assert len(list(parsed(iter(good.split(END.encode()))))) == 1
    with pytest.raises(ValueError):
        list(parsed(iter([b"junk"])))
    with pytest.raises(ValueError):
        list(parsed(iter(good.split(END.encode())[:2])))


def test_url_key():
    assert url_key("HTTP://www.Example.com:80/A?b=2&a=1#x") == "com,example)/a?a=1&b=2"
    assert url_key("https://u:p@x.org:8080") == "org,x:8080)/" and url_key(None) == ""


def test_loser_tree():
    rng = random.Random(0)
    for k in range(12):
        rows = [[(rng.choice("ab"), str(rng.randrange(5)), rng.choice([None, 1, 2, 3])) for _ in range(rng.randrange(6))] for _ in range(k)]
        runs = [sorted(r, key=order_key) for r in rows]
        assert [order_key(r) for r in LoserTree(runs, order_key)] == sorted(order_key(r) for run in rows for r in run)
