from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from quillguard import cli
from quillguard.functions import scan
from quillguard.functions.rules import Rule, RuleSet
from quillguard.operators import candidates as C
from quillguard.operators import intervals as I
from quillguard.plans.queries import LITERALS, QUERIES, SQL, literals
from quillguard.sources.files import FileFilter, chunks, glob_pattern, looks_binary, parse_exts, read_files
from quillguard.streaming import text_stream

M = scan.Matcher(RuleSet.default())


def test_extract_is_the_scan(spark):
    got = [tuple(r) for r in C.extract(literals(spark)).orderBy("doc_id", "start").select("doc_id", "start", "end", "rule", "value").collect()]
    want = [(i, c.start, c.end, c.rule, t.encode()[c.start : c.end].decode()) for i, t in LITERALS for c in scan.candidates(t.encode(), M)]
    assert got == want
    none = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert C.extract(none).collect() == [] and C.masked(none).first()["masked"] is None
    assert not {"value", "left_ctx", "right_ctx"} & set(C.safe(C.extract(none)).columns)


def test_no_shuffle_and_filter_below_python(spark):
    plan = C.extract(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.index("MapInArrow") < plan.index("Filter") < plan.index("FileScan")
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


@pytest.mark.parametrize("table,text,most", [("documents", "text", 0.25), ("pages", "html", 0.3), ("conversations", "text", 0.1)])
def test_share_of_texts_that_reach_python(spark, table, text, most):
    """Few of the test tables' texts have what some rule needs; all that have a candidate do."""
    df = spark.read.parquet(f"/root/testdata/sf0.01/{table}.parquet").withColumn("id", F.monotonically_increasing_id()).cache()
    assert df.where(C.gate(F.col(text), RuleSet.default())).count() <= most * df.count()
    every = C.extract(df, C.Options(rules=RuleSet((*RuleSet.default().rules, Rule("none", "$[a]")))), "id", text)
    assert sorted(r[0] for r in every.select("id").collect()) == sorted(r[0] for r in C.extract(df, None, "id", text).select("id").collect())


def test_redacted(spark):
    df = literals(spark).select("doc_id", "text", F.lit(1).alias("n_masked"), F.lit("x").alias("masked")).union(spark.createDataFrame([(99, None, 1, "x")], "doc_id long, text string, n_masked int, masked string"))
    out = {r["doc_id"]: r for r in C.redacted(df).collect()}
    assert out[99]["masked"] is None and out[99]["findings"] is None and out[16]["findings"] == [] and out[16]["masked"] == ""
    for i, t in LITERALS:
        found = scan.candidates(t.encode(), M)
        assert [(f["start"], f["end"], f["rule"]) for f in out[i]["findings"]] == [(c.start, c.end, c.rule) for c in found]
        assert out[i]["masked"] == scan.mask(t.encode(), [(c.start, c.end, c.rule) for c in found], M)
    counts = {r["doc_id"]: r["n_masked"] for r in C.masked(df).collect()}
    assert counts == {i: len(r["findings"] or []) for i, r in out.items()}


def test_scored_reads_its_input_once(spark):
    plan = C.scored(C.extract(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")), lambda t: [1.0] * len(t))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_scorer_sees_secrets_only(spark):
    seen = spark.sparkContext.accumulator(0)

    def score(triples):
        seen.add(len(triples))
        return [0.4 if "AKIA" in v else 0.9 for _, v, _ in triples]

    cands = C.extract(literals(spark)).cache()
    out = C.scored(cands, score).collect()
    assert seen.value == cands.where("rule_type = 'secret'").count()
    assert not any(r["rule"] == "aws_access_key_id" for r in out) and all(r["confidence"] == 1 for r in out if r["rule_type"] == "pii")
    assert C.scored(cands, None).count() == cands.count()
    triples = spark.createDataFrame([("", "AKIA", ""), ("", "x", "")], "left_ctx string, value string, right_ctx string")
    assert sorted(r["confidence"] for r in C.batch_score(triples, score).collect()) == [0.4, 0.9] and C.batch_score(triples, None).first()["confidence"] == 1


def test_detector_reads_windows_only(spark):
    calls = spark.sparkContext.accumulator(0)

    def detector(text):
        calls.add(1)
        assert len(text) <= scan.WINDOW_BYTES + 100
        at = text.find(b"Zed Quux")
        return [scan.ModelSpan(at, at + 8, "pii", 0.9)] if at >= 0 else []

    rows = [(1, "nothing here " * 500), (2, "word " * 2000 + "Zed Quux " + "word " * 2000)]
    out = C.detect(spark.createDataFrame(rows, "doc_id long, text string"), detector).collect()
    assert [(r["doc_id"], r["start"], r["value"]) for r in out] == [(2, 10000, "Zed Quux")] and calls.value == 1

    def broken(text):
        raise RuntimeError("model")

    with pytest.raises(Exception, match="model"):
        C.detect(literals(spark), broken).collect()


def test_intervals(spark):
    spans = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (1, 11, 12), (2, 3, 4)], "k int, start int, end int")
    assert sorted(map(tuple, I.islands(spans, "k").collect())) == [(1, 0, 9), (1, 11, 12), (2, 3, 4)]
    sized = spark.createDataFrame([(1, 1000, 1010, 10000), (1, 1050, 1060, 10000), (2, 5, 15, 50)], "k int, start int, end int, n_bytes int")
    assert sorted(map(tuple, I.windows_around(sized, "k", window=200).collect())) == [(1, 905, 1155), (2, 0, 50)]
    sizes = [0, 1, 1300, 1500, 1501, 2800, 9999]
    got = I.sliding(spark.createDataFrame(list(enumerate(sizes)), "k int, n_bytes int"), "k").collect()
    assert sorted(map(tuple, got)) == [(k, *w) for k, n in enumerate(sizes) for w in scan.sliding_windows(n)]
    typed = lambda rows: spark.createDataFrame(rows, "k int, start int, end int, type string")
    out = I.confusion(typed([(1, 0, 5, "pii"), (1, 9, 12, "pii")]), typed([(1, 4, 6, "pii"), (1, 20, 21, "pii"), (1, 0, 9, "noise")]), "k").collect()
    assert [tuple(r) for r in out] == [("pii", 1, 1, 1, 0.5, 0.5)]


def tree(tmp_path):
    files = {
        "a.py": b"x = 1\n", "b.PNG": b"x", "empty.txt": b"", "src/c.env": f"{LITERALS[0][1]}".encode(), "src/node_modules/d.js": b"x", "src/.git/e": b"x", "nul.txt": b"a\0b",
        "bad.txt": b"\xff\xfe", "control.txt": b"\x01\x02\x03abc", "latin.txt": "é".encode() * 300, "cut.txt": b"a" * 511 + "é".encode(), "src/deep/f.py": b"y = 2\n",
    }
    for name, data in files.items():
        p = tmp_path / "r" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    return str(tmp_path / "r")


def names(df, root):
    return sorted(r["path"].removeprefix(root + "/") for r in df.collect())


def test_files(spark, tmp_path):
    root = tree(tmp_path)
    base = ["a.py", "latin.txt", "src/c.env", "src/deep/f.py"]
    assert names(read_files(spark, [root]), root) == base
    assert names(read_files(spark, [root], FileFilter().include("*.py")), root) == ["a.py", "src/deep/f.py"]
    assert names(read_files(spark, [root], FileFilter().include("**/src/**").exclude("deep")), root) == ["src/c.env"]
    assert names(read_files(spark, [root], FileFilter().exclude(f"{root}/src")), root) == ["a.py", "latin.txt"]
    assert names(read_files(spark, [root], FileFilter(max_bytes=10)), root) == ["a.py", "src/deep/f.py"]


@pytest.mark.parametrize("glob,path,hit", [("**/dump/**", "/a/dump/x/y", True), ("**/dump/**", "/a/dumps/x", False), ("/a/*.py", "/a/b.py", True), ("/a/*.py", "/a/b/c.py", False), ("/a/**/c", "/a/c", True), ("/a/**/c", "/a/x/y/c", True), ("/?/b", "/a/b", True), ("/{a,b}/c", "/b/c", True)])
def test_globs(glob, path, hit):
    import re

    assert bool(re.fullmatch(glob_pattern(glob), path)) is hit


def test_sniff(spark):
    rows = [(b"", False), (b"a", False), (b"a\0", True), (b"\xff", True), (b"\x01\x02ab", True), (b"\x01abc", False), (b"\t\n\r\f", False), (b"a" * 512 + b"\0", False), (b"a" * 511 + "é".encode(), True)]
    df = spark.createDataFrame([(bytearray(b), w) for b, w in rows], "c binary, want boolean")
    assert df.where(looks_binary(F.col("c")) != F.col("want")).collect() == []
    assert parse_exts("py, .ENV,,yml") == (".py", ".env", ".yml") and parse_exts("") == ()


def test_chunks(spark):
    key = LITERALS[0][1].split()[-1]
    text = "é" * 300 + key + "b" * 200 + key + "é" * 400
    df = spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")
    got = [(r["doc_id"], r["start"], r["end"]) for r in C.extract_chunked(df, chunk=256, carry=64).where("rule = 'aws_access_key_id'").orderBy("start").collect()]
    assert got == []  # both touch letters
    text = "é" * 300 + " " + key + " " + "b c " * 50 + key + " " + "é" * 400
    df = spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")
    got = [(r["start"], r["end"]) for r in C.extract_chunked(df, chunk=256, carry=64).where("rule = 'aws_access_key_id'").orderBy("start").collect()]
    data = text.encode()
    a, b = data.index(key.encode()), data.rindex(key.encode())
    assert got == [(a, a + 20), (b, b + 20)]
    assert chunks(df, "doc_id", "text", 256, 64, 2).count() == 2


def test_stream_is_the_batch(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ck"))
    literals(spark).repartition(3).write.parquet(src)
    text_stream.write_stream(text_stream.masked_stream(text_stream.read_stream(spark, src, "doc_id long, text string")), out, ckpt).awaitTermination()
    got = {r["doc_id"]: r["text"] for r in spark.read.parquet(out).collect()}
    assert got == {r["doc_id"]: r["masked"] for r in C.masked(literals(spark)).collect()}
    found = text_stream.findings_stream(text_stream.read_stream(spark, src, "doc_id long, text string"))
    assert found.isStreaming and "value" not in found.columns


def test_cli(spark, tmp_path, capsys, monkeypatch):
    root = tree(tmp_path)
    run = lambda *a: (cli.main(list(a)), capsys.readouterr().out)
    code, out = run("scan", root)
    rows = [json.loads(x) for x in out.splitlines()]
    assert code == 0 and [r["rule"] for r in rows] == ["aws_access_key_id"] and "span" not in rows[0] and rows[0]["line"] == 1
    assert run("scan", root, "--fail-end")[0] == 2 and run("scan", root, "--fail-fast")[0] == 2 and run("scan", root, "--file-exclude", "*.env", "-f") == (0, "")
    assert run("detect", root)[0] == 1 and run("scan", root, "--rule-exclude", "aws_access_key_id", "--extract-entropy", "5")[1] == ""
    assert json.loads(run("scan", root, "--output-reveal-secrets")[1])["span"].startswith("AKIA")
    assert run("version")[1].strip() and len(run("rules")[1].splitlines()) == 92 and len(json.loads(run("rules", "--json")[1])["rules"]) == 92

    class In:
        class buffer:
            @staticmethod
            def read():
                return b"mail a@b.example\n"

    monkeypatch.setattr("sys.stdin", In)
    assert json.loads(run("scan", "-")[1])[0]["rule"] == "email_address"
    assert run("scan", "-", "-m")[1] == "mail [REDACTED_EMAIL_ADDRESS_1]\n"
    assert run("scan", "-", "--detect", "secrets")[1] == "[]\n"
    assert run("scan", "-", "--rule-add", "x")[0] == 1
    preset = tmp_path / "p.json"
    preset.write_text('{"output-mask": true, "output-placeholder": "#"}')
    assert run("--preset", str(preset), "scan", "-", "-p", "+")[1] == "mail #\n"
    monkeypatch.setenv("QUILLGUARD_OUTPUT_MASK", "true")
    assert run("scan", "-")[1].startswith("mail [RED")


def test_cli_writes_folders_and_prints_masked_files(spark, tmp_path, capsys):
    root, key = tree(tmp_path), LITERALS[0][1].split()[-1]
    run = lambda *a: (cli.main(list(a)), capsys.readouterr())
    code, out = run("scan", root, "-o", str(tmp_path / "found"), "-f")
    rows = [json.loads(x) for p in (tmp_path / "found").glob("part-*") for x in p.read_text().splitlines()]
    assert code == 2 and out.out == "" and [r["rule"] for r in rows] == ["aws_access_key_id"] and not {"span", "value", "left_ctx"} & set(rows[0])
    code, out = run("scan", root, "-m")
    assert code == 0 and key not in out.out and "[REDACTED_AWS_ACCESS_KEY_ID_1]" in out.out and "x = 1\n" in out.out and out.out.count("==> ") == 4
    code, out = run("scan", root, "-m", "-o", str(tmp_path / "masked"), "-p", "#", "-f")
    rows = {json.loads(x)["file"]: json.loads(x) for p in (tmp_path / "masked").glob("part-*") for x in p.read_text().splitlines()}
    assert code == 2 and len(rows) == 4 and rows[f"{root}/src/c.env"]["masked"] == LITERALS[0][1].replace(key, "#")


def test_cli_models_and_rules(spark, tmp_path, capsys, monkeypatch):
    root = tree(tmp_path)
    assert cli.main(["detect", root, "--model", "m.onnx"]) == 1 and "--tokenizer" in capsys.readouterr().err
    assert cli.main(["scan", root, "--model", "m.onnx", "--tokenizer", "t.json"]) == 1 and "m.onnx" in capsys.readouterr().err
    (tmp_path / "m.onnx").write_text("")
    args = cli.settings(["detect", root, "--model", str(tmp_path / "m.onnx"), "--tokenizer", str(tmp_path / "m.onnx")])
    assert cli.models(args)[1].labels[1] == "B-secret" and cli.models(args)[0] is None
    args = cli.settings(["scan", root, "--model", str(tmp_path / "m.onnx"), "--tokenizer", str(tmp_path / "m.onnx")])
    assert cli.models(args)[0].model.endswith("m.onnx") and cli.models(args)[1] is None
    names = lambda *a: cli.rule_set(cli.settings(["scan", root, *a])).names()
    assert names("--rule-include", "jwt", "--rule-add", "mine=x+") == ["jwt", "mine"]
    assert names("--rule-include", "jwt,ssn_us", "--rule-exclude", "jwt,mine", "--rule-add", "mine=x+") == ["ssn_us"]
    assert len(names("--rule-exclude", "jwt")) == 91
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("rule-exclude: jwt\noutput-mask: true\n")
    args = cli.settings(["--config", str(tmp_path / "c.yaml"), "scan", root])
    assert args.rule_exclude == "jwt" and args.output_mask


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
    assert os.path.exists(e.__file__)
