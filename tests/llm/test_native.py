from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillguard.llm import decontaminate as D
from quillguard.llm import sharding
from quillguard.llm.queries import op4_shards, op8_decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(rows, items, size=13):
    wins = defaultdict(set)
    for i, text in items:
        w = words(text)
        if i is not None and w:
            for k in range(max(1, len(w) - size + 1)):
                wins[tuple(w[k : k + size])].add(i)
    sizes = {len(w) for w in wins}
    out = []
    for i, text in rows:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in wins:
                    hit.update(range(k, k + n))
                    found |= wins[x]
        ids = ",".join(sorted(map(str, found)))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def key(r):
    return (r[0] is not None, r[0] or 0, *r[1:])


def planted(seed=1):
    rng = random.Random(seed)
    items = [(k, " ".join(f"q{rng.randrange(500)}" for _ in range(rng.choice([1, 5, 13, 14, 40])))) for k in range(30)]
    items += [(100, items[3][1]), (101, "Éa ÉA éa"), (102, "..."), (103, None), (None, "the the"), (104, ""), (105, "the " * 20), (105, "an other")]
    docs = []
    for k in range(120):
        base = [f"q{rng.randrange(500)}" if rng.random() < 0.3 else rng.choice(["The", "of,", "z", "éa"]) for _ in range(rng.choice([0, 3, 30, 200]))]
        if k % 3 == 0:
            part = (items[rng.randrange(30)][1]).split(" ")
            if k % 2:
                part = part[rng.randrange(len(part)) :]
            at = rng.randrange(len(base) + 1)
            base[at:at] = [x.upper() if rng.random() < 0.2 else x for x in part]
        docs.append((k, rng.choice([" ", "\n", "-"]).join(base)))
    docs += [(200, "the " * 40), (201, "Éa éA ÉA"), (202, "éa-ÉA éa"), (0, docs[0][1])]
    return docs, items


@pytest.mark.parametrize("broadcast", [D.SMALL, 0])
def test_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(D, "SMALL", broadcast)
    docs, items = planted()
    df, of = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, D.contamination(df, of).collect()), key=key)
    assert got == sorted(brute(docs, items), key=key)
    clean = {r["doc_id"] for r in D.clean(df, of).collect()}
    assert clean == {r[0] for r in got if not r[5]} and any(r[5] for r in got)


def test_odd_documents_and_items(spark, odd, none):
    items = spark.createDataFrame([(1, "one two three"), (2, "word " * 30), (None, "x"), (3, None)], "item_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = sorted(brute(rows, [(1, "one two three"), (2, "word " * 30)]), key=key)
    assert sorted(map(tuple, D.contamination(odd, items).collect()), key=key) == want
    assert D.clean(odd, items).columns == odd.columns
    assert D.contamination(none, items).collect() == []
    assert all(r["n_hit"] == 0 for r in D.contamination(odd, items.limit(0)).collect())


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a x b c y d"), (3, "b a c d"), (4, "a b q q q q c d"), (5, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b c d")], "item_id long, text string")

    def found(slop):
        hits = D.matches(docs, items, slop=slop).select("text_key").distinct()
        return {r["doc_id"] for r in docs.withColumn("text_key", D.digest(F.col("text"))).join(hits, "text_key").collect()}

    assert found(0) == {1} and found(1) == {1, 2, 3} and found(5) == {1, 2, 3, 4}


@pytest.mark.parametrize("query", [op4_shards, op8_decontamination])
def test_no_python_on_the_main_path(spark, query):
    plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def check_shards(rows, out, limit):
    assert Counter((i, len((t or "").encode())) for i, t in rows) == Counter((r["doc_id"], r["n_bytes"]) for r in out)
    groups, by_prefix = defaultdict(list), Counter()
    for r in out:
        h = int(hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()[:15], 16)
        assert r["prefix"] == h >> (60 - r["depth"])
        groups[r["depth"], r["prefix"], r["page"]].append(r)
        for d in range(61):
            by_prefix[d, h >> (60 - d)] += r["n_bytes"]
    for (depth, prefix, page), members in groups.items():
        total = sum(r["n_bytes"] for r in members)
        assert all(r["shard_bytes"] == total for r in members)
        assert total <= limit or len(members) == 1
        if page == 0 and depth < 60:
            assert total == by_prefix[depth, prefix]
        if depth:  # no bucket that fits was split
            assert by_prefix[depth - 1, prefix >> 1] > limit
    assert all(not (a != b and a[0] < b[0] and b[1] >> (b[0] - a[0]) == a[1]) for a in groups for b in groups)


@pytest.mark.parametrize("limit", [300, 2000, 10**7])
def test_shards(docs, odd, none, sample, limit):
    check_shards([(i, t) for i, t, _ in sample], sharding.shards(docs, limit).collect(), limit)
    check_shards([(r["doc_id"], r["text"]) for r in odd.collect()], sharding.shards(odd, limit).collect(), limit)
    assert sharding.shards(none, limit).collect() == []


def check_directory(out):
    """Every slot of the global depth belongs to one bucket, or to none where no document hashes to it."""
    rows = sharding.buckets(out).collect()
    depth = max((r["depth"] for r in rows), default=0)
    spans = sorted({(r["first_slot"], r["first_slot"] + r["slots"]) for r in rows})
    assert all(r["global_depth"] == depth and r["slots"] == 1 << (depth - r["depth"]) for r in rows)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False)) and (not spans or spans[-1][1] <= 1 << depth)
    for r in out.collect():
        h = int(hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()[:15], 16)
        assert sum(a <= h >> (60 - depth) < b for a, b in spans) == 1


def test_directory_and_written_shards(spark, docs, odd, tmp_path):
    for k, df in enumerate((docs, odd)):
        out = sharding.shards(df, 3000)
        check_directory(out)
        path = tmp_path / f"s{k}"
        sharding.write_shards(df, f"file://{path}", 3000)
        sizes = {"-".join(map(str, r[:3])): r["shard_bytes"] for r in out.select("depth", "prefix", "page", "shard_bytes").distinct().collect()}
        assert {p.name for p in path.glob("shard=*")} == {f"shard={x}" for x in sizes}
        read = spark.read.option("basePath", f"file://{path}").parquet(f"file://{path}").groupBy("shard").agg(F.sum(F.coalesce(F.octet_length("row.text"), F.lit(0))), F.count("*")).collect()
        assert {r[0]: r[1] for r in read} == sizes and all(r[1] <= 3000 or r[2] == 1 for r in read)
        back = sharding.read_shards(spark, f"file://{path}")
        assert back.columns == df.columns and Counter(map(tuple, back.collect())) == Counter(map(tuple, df.collect()))


def test_equal_ids_overflow_into_pages(spark):
    rows = [(1, "x" * (k % 3 * 40)) for k in range(200)] + [(2, "y")]
    out = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string"), 500).collect()
    check_shards(rows, out, 500)
    assert len({r["page"] for r in out}) > 15
