from __future__ import annotations

import math
import random

import pytest

from quillguard.functions import scan as S
from quillguard.functions.rules import Rule, RuleSet
from quillguard.plans.queries import LITERALS

M = S.Matcher(RuleSet.default())


def rules(text, **k):
    return [c.rule for c in S.candidates(text.encode(), M, **k)]


@pytest.mark.parametrize(
    "spans,size,window,want",
    [([], 1000, 100, []), ([(5, 15)], 50, 100, [(0, 50)]), ([(1000, 1020)], 10000, 200, [(910, 1110)]), ([(100, 110), (5000, 5010)], 10000, 200, [(5, 205), (4905, 5105)]),
     ([(1000, 1010), (1050, 1060)], 10000, 200, [(905, 1155)]), ([(100, 110), (300, 310)], 10000, 200, [(5, 405)]), ([(0, 10)], 10000, 200, [(0, 105)]), ([(9990, 10000)], 10000, 200, [(9895, 10000)])],
)
def test_windows(spans, size, window, want):
    assert S.windows(spans, size, window) == want


def test_sliding_windows():
    assert S.sliding_windows(0) == [] and S.sliding_windows(1500) == [(0, 1500)]
    assert S.sliding_windows(1501) == [(0, 1500), (1300, 1501)] and S.sliding_windows(2800)[-1] == (1300, 2800)


def test_best_of_type():
    m = S.ModelSpan
    assert S.best_of_type([]) == []
    assert S.best_of_type([m(0, 5, "pii", 0.5), m(3, 8, "pii", 0.9)]) == [m(3, 8, "pii", 0.9)]
    assert S.best_of_type([m(0, 5, "pii", 0.5), m(3, 8, "pii", 0.5)]) == [m(0, 5, "pii", 0.5)]
    assert len(S.best_of_type([m(0, 5, "pii", 0.5), m(3, 8, "secret", 0.9)])) == 2
    assert S.best_of_type([m(0, 5, "a", 0.5), m(3, 8, "a", 0.9), m(7, 9, "a", 0.95)]) == [m(7, 9, "a", 0.95)]


def test_greedy_without_overlaps_is_as_by_all_pairs():
    rng = random.Random(0)
    for _ in range(300):
        spans = [S.Span(a, a + rng.randrange(1, 6), str(k), "x") for k in range(12) for a in [rng.randrange(20)]]
        kept = []
        for s in spans:
            if not any(s.start < k.end and k.start < s.end for k in kept):
                kept.append(s)
        assert S.without_overlaps(spans) == sorted(kept)


@pytest.mark.parametrize("value,want", [("abc", "***"), ("abcdef", "******"), ("abcdefg", "abc*efg"), ("0123456789", "012****789")])
def test_redact(value, want):
    assert S.redact(value.encode()) == want


def test_entropy():
    assert S.entropy(b"") == 0 and S.entropy(b"aaaa") == 0 and math.isclose(S.entropy(b"abcd"), 2)
    assert math.isclose(S.entropy("éa".encode()), -2 / 3 * math.log2(1 / 3))  # characters by bytes


def test_priority_and_shadowing():
    assert rules("card 4532 0151 1283 0366") == ["aadhaar_in"]
    assert rules("password = a@b.com.example") == ["generic_assignment_secret"]
    assert rules("-----BEGIN PGP PRIVATE KEY BLOCK-----\nx\n-----END PGP PRIVATE KEY BLOCK-----") == ["private_key_pem"]
    assert "drivers_license_us" in rules("mindlessness")
    assert rules(dict(LITERALS)[2])[0].startswith("encoded_aws")
    assert rules(dict(LITERALS)[12]) == [] and "high_entropy" in rules(dict(LITERALS)[3])
    assert rules("x " + "ab1" * 10, bits=4.0) == [] and rules("x " + "ab1" * 10, bits=1.0) == ["high_entropy"]


def test_offsets_are_bytes_and_lines_count():
    text = dict(LITERALS)[17].encode()
    first = S.candidates(text, M)[0]
    assert text[first.start : first.end].startswith(b"AKIA")
    assert S.Lines(text).at(first.start) == (3, len("b é ".encode()) + 1)
    assert S.Lines(b"\n").at(1) == (2, 1) and S.Lines(b"").at(0) == (1, 1) and S.Lines(b"a\nb").bounds(2) == (2, 3)


@pytest.mark.parametrize(
    "text,at,want",
    [("key X # example key", 4, True), ("# example token, unused\nkey X", 28, True), ("# example token\n\nkey X", 21, False), ("# example token: x = 1\nkey X", 27, False),
     ("example token\nkey X", 18, False), ("k = <SET_ME>", 4, True), ("k = ${ABC}", 4, True), ("k = xxxxx", 4, True), ("k = __A__", 4, True), ("k = real1234", 4, False), ("; dummy-key\nX", 12, True), ("contest fixtures\nX", 17, False)],
)
def test_examples(text, at, want):
    assert S.is_example(text.encode(), S.Lines(text.encode()), at) is want


@pytest.mark.parametrize("value,want", [("123e4567-e89b-12d3-a456-426614174000", True), ("a" * 32, True), ("2024-01-02", True), ("2024-01-02T03:04:05Z", True), ("http://x", True), ("evelText", True), ("a1b", False), ("2024-01-02\n", False), ("ab", False)])
def test_plain_shapes(value, want):
    assert S.is_plain_shape(value.encode()) is want


def test_fusion():
    m = S.ModelSpan
    text = ("a " + dict(LITERALS)[1] + " and Jane Roe").encode()
    found = S.candidates(text, M)
    name = text.index(b"Jane")
    model = [m(found[0].start, found[0].end, "noise", 0.9), m(name, name + 8, "pii", 0.7)]
    assert [(f.rule, f.confidence) for f in S.fuse(text, found, model)] == [("pii", 0.7)]
    assert [f.rule for f in S.fuse(text, found, [model[0]._replace(score=0.4), model[1]._replace(score=0.4)])] == ["secret"]
    pem = b"-----BEGIN PRIVATE KEY-----\nabc\n-----END PRIVATE KEY-----"
    assert [f.rule for f in S.fuse(pem, S.candidates(pem, M), [m(0, 10, "noise", 1.0)])] == ["secret"]
    assert S.fuse(b"x", [], [m(-5, 99, "pii", 0.9)])[0][:2] == (0, 1)


def test_masks():
    text = "é a@b.example c@d.example".encode()
    found = [(c.start, c.end, c.rule) for c in S.candidates(text, M)]
    assert S.mask(text, found, M) == "é [REDACTED_EMAIL_ADDRESS_1] [REDACTED_EMAIL_ADDRESS_2]"
    assert S.mask(text, found, M, "#") == "é # #" and S.mask(text, found, M, "<%s>") == "é <email_address> <email_address>"
    assert S.mask(text, [], M) == text.decode()
    # a narrow span is widened to the match; a covered one leaves a gap in the numbers
    assert S.mask(text, [(3, 5, "pii"), (4, 6, "pii"), found[1]], M) == "é [REDACTED_PII_1] [REDACTED_EMAIL_ADDRESS_3]"
    assert S.mask(text, [(3, 5, "pii")], M, "<%s>") == "é <pii>b.example c@d.example"
    assert S.snap(text, 9, 9, M) == (9, 9)


def test_bio():
    labels = ["O", "B-pii", "I-pii", "B-secret", "I-secret"]
    rows = lambda *ids: [[9.0 if k == i else 0.0 for k in range(5)] for i in ids]
    spans = lambda ids, offsets, mask=None: [s[:3] for s in S.decode_bio(labels, rows(*ids), offsets, mask or [1] * len(ids))]
    assert spans([1, 2, 0, 2], [(0, 2), (2, 4), (4, 5), (6, 8)]) == [(0, 4, "pii"), (6, 8, "pii")]
    assert spans([1, 1], [(0, 2), (2, 4)]) == [(0, 2, "pii"), (2, 4, "pii")]
    assert spans([1, 4], [(0, 2), (2, 4)]) == [(0, 2, "pii"), (2, 4, "secret")]
    assert spans([1, 2, 2], [(0, 2), (0, 0), (2, 4)]) == [(0, 2, "pii"), (2, 4, "pii")]
    assert spans([1, 2], [(0, 2), (2, 4)], [1, 0]) == [(0, 2, "pii")] and spans([], []) == []
    assert 0.99 < S.decode_bio(labels, rows(1), [(0, 2)], [1])[0].score < 1


def test_user_rules():
    m = S.Matcher(RuleSet((Rule("n", r"id=(\d+)"),)))
    assert m.spans(b"id=12 id=x") == [S.Span(3, 5, "n", "secret")]
