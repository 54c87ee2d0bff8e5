"""Translated patterns against RE2 itself, as DuckDB has it, for every rule."""

from __future__ import annotations

import random
import re
import re._parser as sre
import warnings

import duckdb
import pytest
from pyspark.sql import functions as F

from quillguard.functions import rules as R
from quillguard.functions.regex import split_group, to_bytes, to_java, tokens
from quillguard.functions.spans import match_spans

RULES = R.RuleSet.default()


def sample(rng: random.Random, pattern: str) -> str:
    """A text that the pattern, in Python's reading, matches."""

    def item(op, arg) -> str:
        op = str(op)
        if op == "LITERAL":
            return chr(arg)
        if op == "NOT_LITERAL" or op == "ANY":
            return rng.choice("aZ5-")
        if op == "AT":
            return ""
        if op == "IN":
            if str(arg[0][0]) == "NEGATE":
                return rng.choice([c for c in "aZ5_kSé" if not re.match(f"[{c}]", " ")] or "a")
            choices = []
            for kind, v in arg:
                kind = str(kind)
                choices += [chr(v)] if kind == "LITERAL" else [chr(rng.randint(*v))] if kind == "RANGE" else ["5"] if "DIGIT" in str(v) else [" "] if "SPACE" in str(v) else ["w"]
            return rng.choice(choices)
        if op == "BRANCH":
            return seq(rng.choice(arg[1]))
        if op == "SUBPATTERN":
            return seq(arg[3])
        if op in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, body = arg
            return "".join(seq(body) for _ in range(rng.randint(int(low), min(int(high), int(low) + 3))))
        raise AssertionError(op)

    def seq(parts) -> str:
        return "".join(item(op, arg) for op, arg in parts)

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return seq(sre.parse(pattern))


def texts() -> list[str]:
    rng, out = random.Random(11), []
    around = ["", "é", "\r", "\x0b", " ", "x", "_", "\n", "é́", "0", "-", "K", "ſ"]
    for r in RULES:
        for _ in range(6):
            t = sample(rng, r.pattern)
            for k in range(4):
                a, b = rng.choice(around), rng.choice(around)
                u = t if k < 2 else t.replace("k", "K").replace("s", "ſ") if k == 2 else t[: len(t) // 2] + rng.choice(around) + t[len(t) // 2 :]
                out.append(f"{a}{u}{b}{u if k == 1 else ''}")
    return out + ["mindlessness of", "AKIA" * 10, "", "\n\n", "a@b.co,c@d.ef"]


TEXTS = texts()


@pytest.fixture(scope="module")
def re2():
    con = duckdb.connect()
    con.execute("create table t as select unnest(range(0, ?))::int as id, unnest(?) as text", [len(TEXTS), TEXTS])
    out = {}
    for r in RULES:
        q = split_group(r.pattern) if r.group else f"()({r.pattern})" if not r.pattern.startswith("(?") else re.sub(r"^(\(\?[ims]+\))?(.*)$", r"\1()(\2)", r.pattern, flags=re.S)
        got = con.execute("select id, string_split_regex(text, $p), regexp_extract_all(text, $p), regexp_extract_all(text, $q, 1), regexp_extract_all(text, $q, 2) from t where regexp_matches(text, $p)", {"p": r.pattern, "q": q}).fetchall()
        for i, *each in got:
            at, spans = 0, []
            for g, m, h, v in zip(*each, strict=False):
                at += len(g.encode())
                start = at + (len(h.encode()) if r.group else 0)
                spans.append((start, start + len((v if r.group else m).encode())))
                at += len(m.encode())
            out[r.name, i] = spans
    return out


def test_samples_reach_the_rules(re2):
    assert len({name for name, _ in re2}) >= 90


def test_bytes_match_as_re2(re2):
    for r in RULES:
        for i, t in enumerate(TEXTS):
            assert [m.span(r.group) for m in r.compiled.finditer(t.encode())] == re2.get((r.name, i), []), (r.name, t)


def test_literals_never_hide_a_match(re2):
    from quillguard.functions.scan import Matcher

    matcher = Matcher(RULES)
    for i, t in enumerate(TEXTS):
        got = matcher.spans(t.encode())
        assert [(s.rule, s.start, s.end) for s in got] == [(r.name, *x) for r in RULES for x in re2.get((r.name, i), [])], t


def test_gate_never_hides_a_match(spark, re2):
    """For all rules together, and for each alone, where other rules' needs don't let a text through."""
    from quillguard.operators.candidates import gate

    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").cache()
    closed = {r["id"] for r in df.where(~gate(F.col("text"), RULES)).collect()}
    assert not [k for k in re2 if k[1] in closed]
    alone = {r.name: ~gate(F.col("text"), R.RuleSet((r,))) for r in RULES}
    for k in range(0, len(RULES), 23):
        for row in df.select("id", *[alone[n].alias(n) for n in RULES.names()[k : k + 23]]).collect():
            assert not [n for n in RULES.names()[k : k + 23] if row[n] and (n, row["id"]) in re2]


def test_needs_hold_for_every_sample():
    from quillguard.functions.scan import FOLDED, RUN, need

    rng, runs = random.Random(12), 0
    for r in RULES:
        n = re.compile(need(r).encode())
        runs += need(r) == RUN
        for _ in range(300):
            t = sample(rng, r.pattern).encode()
            assert not r.compiled.search(t) or any(x in t for x in FOLDED) or n.search(t), (r.name, t)
    assert runs > 50


def test_least_run():
    inside = set("abc")
    for pattern, n in (("abc", 3), ("a{4}x", 4), ("ab?c", 2), ("(?:ab|abc)c+", 3), ("a|bbb", 1), ("a(?:x|bb)c", 1), ("[ab]{2,}[^x]c", 2), (r"\ba*\b", 0), ("(?i)ab", 2), ("aa(?:bb)?cc", 4), ("aa(?:xx)?cc", 2)):
        assert R.least_run(pattern, inside) == n, pattern


def test_spark_columns_match_as_re2(spark, re2):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").repartition(4).cache()
    for k in range(0, len(RULES), 23):
        part = RULES.rules[k : k + 23]
        for row in df.select("id", *[match_spans(F.col("text"), r).alias(r.name) for r in part]).collect():
            for r in part:
                assert [tuple(s) for s in row[r.name]] == re2.get((r.name, row["id"]), []), (r.name, TEXTS[row["id"]])


@pytest.mark.parametrize(
    "pattern,text,hit",
    [(r"\bAKIA", "éAKIA", True), ("a.b", "a\rb", True), ("a.b", "a\nb", False), ("(?s)a.b", "a\nb", True), (r"\s", "\x0b", False), (r"\S", "\x0b", True),
     ("a$", "a\n", False), ("(?i)k", "K", True), ("(?i)[a-z]", "ſ", True), ("[k]", "K", False), (r"[^\s]{2}", "é", False), ("(?i)[^k]", "K", False)],
)
def test_differences_between_engines(spark, pattern, text, hit):
    assert bool(to_bytes(pattern).search(text.encode())) is hit
    assert spark.createDataFrame([(text,)], "t string").select(F.rlike("t", F.lit(to_java(pattern)))).first()[0] is hit
    assert duckdb.execute("select regexp_matches(?, ?)", [text, pattern]).fetchall()[0][0] is hit


def test_tokens():
    assert tokens(r"(?i)a[^\]x]\b(?:b)(?P<n>c)") == ["(?i)", "a", r"[^\]x]", r"\b", "(?:", "b", ")", "(?P<n>", "c", ")"]
    assert split_group(r"(?i)ab(c)d") == r"(?i)(ab)(c)d"


def test_catalog():
    assert len(RULES) == 92 and sum(r.type == R.PII for r in RULES) == 24 and sum(r.group > 0 for r in RULES) == 18
    assert len(set(RULES.names())) == 92


def test_rule_sets():
    new = [R.Rule("jwt", "x+"), R.Rule("mine", "(a)", R.PII)]
    s = RULES.extended(new, ["email_address"])
    assert len(s) == 92 and s.names().index("jwt") == RULES.names().index("jwt") and s.names()[-1] == "mine"
    assert s.rules[-1].group == 1 and "email_address" not in s.names()
    assert {r.type for r in RULES.of_types(["pii", "nonsense"])} == {R.PII} and RULES.of_types(None) is RULES
    assert len(R.RuleSet(()).or_default()) == 92 and RULES.selected(["jwt"], []).names() == ["jwt"]
    assert R.parse_rules(RULES.to_json())[0] == list(RULES)
    assert R.parse_rules('{"disabled": ["jwt"]}') == ([], ["jwt"]) and R.parse_rules('[{"name": "a", "pattern": "b"}]')[0][0].type == R.SECRET
    assert R.parse_added("n=a=b").pattern == "a=b"
    for bad in ("{}", '{"x": 1}', '[{"name": "a", "pattern": "("}]', '[{"name": "", "pattern": "a"}]', "nope"):
        with pytest.raises(ValueError):
            R.parse_rules(bad)
    with pytest.raises(ValueError):
        R.parse_added("x")
