"""The pipeline's stages against brute force, each on its own input."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

from .test_minhash import brute as near_brute
from .test_minhash import shingle_set
from .test_native import brute as hits_brute
from .test_quality import brute as quality_brute
from .test_tokens import check_packing

SF = "/root/testdata/sf0.001"
FUNCTIONS = dict(P.STAGES)


@pytest.fixture(scope="module")
def documents(spark, docs):
    """The smallest table, and cases that it lacks."""
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(3).collect()]
    more = [(10**6 + k, f"{'own words here ' * 5}{t}\n{'x y z w v ' * 3}", "en", "s", 1) for k, t in enumerate(items)]
    more += [(10**6 + 10, None, None, None, None), (10**6 + 11, "", "en", "s", 0)]
    df = spark.read.parquet(f"{SF}/documents.parquet")
    return df.union(spark.createDataFrame(more, df.schema))


def test_stages_are_the_five(documents):
    assert [n for n, _ in P.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]


def table(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_quality(spark, documents):
    from quillguard.llm.quality import QualityRules

    rows = [(r["doc_id"], r["text"], r["source"]) for r in documents.collect()]
    out = FUNCTIONS["quality_rules"](spark, documents, SF)
    assert out.columns == documents.columns and table(out) == quality_brute(rows, QualityRules())[1]
    assert out.where(F.col("n_chars") != F.char_length("text")).isEmpty()


def test_line_dedup(spark, documents):
    from quillguard.llm.linededup import clean

    out, want = FUNCTIONS["line_dedup"](spark, documents, SF), table(clean(documents))
    assert out.columns == documents.columns
    assert table(out) == {i: t for i, t in want.items() if t and re.search(r"[^\x20\x09-\x0D]", t)}


def test_near_dedup(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    sets = {i: shingle_set(t, 5) for i, t in rows}
    assert sets
    import tests.llm.test_minhash as m

    old, m.shingle_set = m.shingle_set, lambda t, k=5: shingle_set(t, 5)
    try:
        want = {i for i, (_, c) in near_brute(rows).items() if i == c}
    finally:
        m.shingle_set = old
    out = FUNCTIONS["near_dedup"](spark, documents, SF)
    assert out.columns == documents.columns and set(table(out)) == want


def test_decontamination(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {r[0] for r in hits_brute(rows, items) if r[5]}
    out = FUNCTIONS["decontamination"](spark, documents, SF)
    assert out.columns == documents.columns and set(table(out)) == {i for i, _ in rows} - bad
    assert {10**6, 10**6 + 1, 10**6 + 2} <= bad


def test_run(spark, tokenizer, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = P.run(spark, SF).collect()
    n, least = check_packing(rows, out, lambda x: t.encode(x or "", add_special_tokens=False).ids)
    assert n <= least * 1.02 + 1


def test_empty_input(spark, documents):
    none = documents.limit(0)
    for name, stage in P.STAGES:
        assert stage(spark, none, SF).collect() == [], name
