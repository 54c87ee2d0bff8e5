from __future__ import annotations

import re
from collections import Counter, defaultdict

from quillguard.llm.quality import QualityRules, clean, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RULES = QualityRules(min_docs=5, max_share=0.1, max_lost=0.3)


def normal(line):
    return " ".join(WORD.findall(line.translate(LOWER)))


def brute(rows, rules):
    docs_of, ids = defaultdict(set), defaultdict(set)
    for i, text, host in rows:
        ids[host or ""].add(i)
        for line in (text or "").split("\n"):
            n = normal(line)
            if n:
                docs_of[host or "", n].add(i)
    often = {k for k, v in docs_of.items() if len(v) > rules.min_docs and len(v) > rules.max_share * len(ids[k[0]])}
    out, cleaned = [], {}
    for i, text, host in rows:
        text = text or ""
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        twice = {w for w, n in Counter(windows).items() if n > 1}
        hit = {k + j for k, w in enumerate(windows) if w in twice for j in range(3)}
        lost = sum(len(WORD.findall(x)) for x in lines if (host or "", normal(x)) in often)
        failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
        kept = not failed and lost <= rules.max_lost * len(words)
        out.append((i, len(words), sum(map(len, words)), sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(hit), failed, kept, lost))
        if kept:
            cleaned[i] = "\n".join(x for x in text.split("\n") if (host or "", normal(x)) not in often)
    return out, cleaned


def key(r):
    return (r[0] is not None, r[0] or 0, *r[1:])


def test_brute_force(docs, sample):
    for rules in (RULES, QualityRules()):
        expected, cleaned = brute(sample, rules)
        assert sorted(map(tuple, quality(docs, rules).collect()), key=key) == sorted(expected, key=key)
        out = clean(docs, rules)
        assert out.columns == docs.columns
        assert {r["doc_id"]: r["text"] for r in out.collect()} == cleaned
    assert any(r[8] for r in brute(sample, RULES)[0])


def test_odd(odd, none):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in odd.collect()]
    expected, cleaned = brute(rows, QualityRules())
    assert sorted(map(tuple, quality(odd).collect()), key=key) == sorted(expected, key=key)
    out = clean(odd)
    assert out.columns == odd.columns and {r["doc_id"]: r["text"] for r in out.collect()} == cleaned
    assert quality(none).collect() == [] and clean(none).collect() == []


def test_windows_end_with_their_row(spark):
    rows = [(1, "a b c d a b", "h"), (2, "c x y z", "h"), (3, "a b c a b c", "h")]
    out = quality(spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)).collect()
    assert {r["doc_id"]: r["n_repeat_words"] for r in out} == {1: 0, 2: 0, 3: 6}


def test_copies_count_as_documents_and_long_lines_too(spark):
    """A page in ten copies is depleted by its own lines; a line of 60 words in many documents goes."""
    page, notice = " ".join(f"p{k}" for k in range(70)), " ".join(f"n{k}" for k in range(60))
    rows = [(k, page, "h") for k in range(10)]
    rows += [(100 + k, " ".join(f"own{k}w{j}" for j in range(150)) + "\n" + notice, "h") for k in range(10)]
    rows += [(200, page, "other"), (200, page, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out, cleaned = brute(rows, RULES)
    assert sorted(tuple(r) for r in quality(df, RULES).collect()) == sorted(out)
    assert not any(r[7] for r in out if r[0] < 10) and cleaned[100] == rows[10][1].split("\n")[0]
    assert {r["doc_id"]: r["text"] for r in clean(df, RULES).collect()} == cleaned
