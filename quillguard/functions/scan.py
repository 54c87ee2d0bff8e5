"""Scanning one text: candidates, suppression, fusion with a model's spans, masking.

Texts are UTF-8 bytes here, so all offsets are byte offsets, [start, end). The operators run these
functions on Arrow batches; they hold no state and see one text at a time.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache
from typing import NamedTuple

from .regex import to_bytes
from .rules import Rule, RuleSet, anchors, least_run

# Patterns, names and sizes of the scan.
ENTROPY_TOKEN = rb"[A-Za-z0-9+/_\-]{20,}={0,2}"
EMBEDDED_BLOB = rb"(?s)(?:data:image/[a-zA-Z.+\-]+;base64,[A-Za-z0-9+/=]+|-----BEGIN CERTIFICATE-----.*?-----END CERTIFICATE-----)"
BASE64_TOKEN = rb"[A-Za-z0-9+/]{24,}={0,2}"
HIGH_ENTROPY, ENCODED, NOISE = "high_entropy", "encoded_", "noise"
HIGH_TRUST = ("private_key_pem", "x509_certificate", "pgp_private_key", "putty_private_key")
CONTEXT_BYTES, ENTROPY_BITS, SNAP_BYTES = 256, 4.0, 256
WINDOW_BYTES, WINDOW_OVERLAP = 1500, 200
EXAMPLE_MARKER = (
    r"(?i)\b(?:example\s+(?:key|secret|token|password|value|only)|for\s+example|e\.g\.|i\.e\.|"
    r"fake[_ -](?:key|secret|token|password|value|cred|api)|dummy[_ -](?:key|secret|token|password|value|api)|placeholder|"
    r"test[_ -](?:fixture|only|stub|mock|data)|fixture|do\s+not\s+use|illustrative|not\s+a\s+real(?:\s+\w+)?|"
    r"for\s+(?:demo|illustration|demonstration)|todo:?\s*replace|your[_ -](?:secret|token|key|password|api[_ -]?key))\b"
)
EXAMPLE_PLACEHOLDER = (
    r"(?i)(?:<(?:set_me|your[_\-][a-z0-9_\-]+|[a-z0-9_\-]*token|[a-z0-9_\-]*secret|[a-z0-9_\-]*key|[a-z0-9_\-]*password|placeholder)>|"
    r"__[a-z0-9_]+__|\$\{[a-z0-9_]+\}|x{5,}|\.{4,})"
)
COMMENT_PREFIXES = ("//", "#", "--", "/*", "*", ";", "<!--")
ASSIGNMENT = r"[A-Za-z_][A-Za-z0-9_]*\s*(?::=|=|:)\s*\S"
SOFT_NAME = r"\b[A-Z][a-z]{1,}\s+[A-Z][a-z]{1,}\b"
SOFT_ADDRESS = r"(?i)\b\d{1,6}\s+[A-Za-z][A-Za-z\.\s]{0,40}\b(?:St|Street|Ave|Avenue|Rd|Road|Blvd|Lane|Ln|Drive|Dr)\b"
URL = r"https?://\S+"
PLAIN_SHAPES = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"[0-9a-fA-F]{32,128}$",
    r"\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}.*)?$",
    r"https?://",
    r"[A-Za-z]{3,16}$",
)

_ENTROPY, _BLOB, _BASE64 = re.compile(ENTROPY_TOKEN), re.compile(EMBEDDED_BLOB), re.compile(BASE64_TOKEN)
_MARKER, _PLACEHOLDER, _ASSIGNMENT = to_bytes(EXAMPLE_MARKER), to_bytes(EXAMPLE_PLACEHOLDER), to_bytes(ASSIGNMENT)
_NAME, _ADDRESS, _URL = to_bytes(SOFT_NAME), to_bytes(SOFT_ADDRESS), to_bytes(URL)
_SHAPES = tuple(to_bytes(p) for p in PLAIN_SHAPES)
_COMMENTS = tuple(p.encode() for p in COMMENT_PREFIXES)
#: Characters of tokens, and how many in a row make a text worth looking for rules whose matches all have so many.
TOKEN_SIGNS, TOKEN_RUN = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"), 16
RUN = r"(?<![A-Za-z0-9+/=_\-])[A-Za-z0-9+/=_\-]{16}"
# What every match of a default rule with no such run has in it, in the syntax that Python on bytes and Java share. Digits
# may have up to two separators between them.
NINE_DIGITS = r"[0-9](?:[()\-. \t\n\f\r]{0,2}[0-9]){8}"
NEEDS = {
    "gcp_service_account": r"\"service_account\"",
    "azure_sas_token": r"[A-Za-z0-9%_\-]{16}",
    "slack_bot_token": r"xox[abprs]-",
    "jwt": r"eyJ",
    "private_key_pem": r"-----BEGIN ",
    "pgp_private_key": r"-----BEGIN ",
    "db_uri_creds": r"@",
    "http_basic_auth_url": r"@",
    "generic_assignment_secret": r"(?i:passw(?:or)?d|secret|token|key|auth)[ \t\n\f\r]*[:=]",
    "email_address": r"@",
    "ipv4_address": r"[0-9]\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]",
    "ipv6_address": r"(?:[0-9A-Fa-f]{1,4}:){7}",
    "mac_address": r"(?:[0-9A-Fa-f]{2}[:\-]){5}",
    "phone_e164": r"\+[0-9]{8}",
    "nin_uk": r"[A-Za-z]{2}[0-9]{6}",
    "pan_in": r"[A-Z]{5}[0-9]{4}",
    "iban": r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11}",
    "passport_in": r"[A-Za-z][0-9]{7}",
    "drivers_license_us": r"(?i:licen[cs]e|dln?)[^A-Za-z0-9]{0,10}[A-Za-z0-9]{6}",
} | dict.fromkeys(
    ("phone_us", "ssn_us", "sin_ca", "aadhaar_in", "cpf_br", "credit_card_visa", "credit_card_mastercard", "credit_card_amex", "credit_card_discover", "credit_card_jcb", "ein_us", "itin_us", "passport_us", "passport_uk"),
    NINE_DIGITS,
)
#: Letters that match k and s without being ASCII; texts with them are not passed over by literals.
FOLDED = ("K".encode(), "ſ".encode())


class Span(NamedTuple):
    start: int
    end: int
    rule: str
    type: str


class ModelSpan(NamedTuple):
    start: int
    end: int
    type: str
    score: float


@lru_cache(1)
def _default_patterns() -> dict[str, str]:
    return {r.name: r.pattern for r in RuleSet.default()}


@lru_cache(1024)
def need(rule: Rule) -> str | None:
    """A pattern that every text with a match of the rule has a match of, unless it has letters of FOLDED; None if none is known."""
    if rule.name in NEEDS and _default_patterns().get(rule.name) == rule.pattern:
        return NEEDS[rule.name]
    if least_run(rule.pattern, TOKEN_SIGNS) >= TOKEN_RUN:
        return RUN
    literals = ["".join("\\" + c if not c.isalnum() else c for c in x) for x in anchors(rule.pattern)]
    return f"(?i:{'|'.join(literals)})" if literals else None


class Matcher:
    """A rule set ready for scanning: rules whose literals or needs a text lacks are passed over."""

    def __init__(self, rules: RuleSet):
        found = [(r, need(r)) for r in rules.or_default()]
        self.needs = {n: re.compile(n.encode()) for _, n in found if n}
        self.rules = [(r, tuple(a.encode() for a in anchors(r.pattern)), n) for r, n in found]

    def spans(self, text: bytes) -> list[Span]:
        """Values of all rules, in order of priority and place; overlaps included."""
        low, met = text.lower(), {None: True}
        folded = any(x in text for x in FOLDED)
        out = []
        for r, literals, needs in self.rules:
            if not folded:
                if needs not in met:
                    met[needs] = self.needs[needs].search(text) is not None
                if not met[needs] or literals and not any(x in low for x in literals):
                    continue
            for m in r.compiled.finditer(text):
                if m.start(r.group) >= 0:
                    out.append(Span(m.start(r.group), m.end(r.group), r.name, r.type))
        return out


def entropy(value: bytes) -> float:
    """Bits: over distinct characters, their count by the value's bytes."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value.decode("utf-8", "replace")).values()) if n else 0.0


def high_entropy_spans(text: bytes, bits: float = ENTROPY_BITS) -> list[Span]:
    """Long tokens of at least so much entropy, outside images and certificates."""
    masked = _BLOB.sub(lambda m: b" " * len(m[0]), text) if b"data:image/" in text or b"-----BEGIN" in text else text
    return [Span(*m.span(), HIGH_ENTROPY, "secret") for m in _ENTROPY.finditer(masked) if entropy(m[0]) >= bits]


def encoded_spans(text: bytes, matcher: Matcher) -> list[Span]:
    """Base64 tokens in whose decoded text rules match, once for each match."""
    out = []
    for m in _BASE64.finditer(text):
        if len(m[0]) % 4 == 0:
            try:
                decoded = base64.b64decode(m[0], validate=True)
            except binascii.Error:
                continue
            out += [Span(*m.span(), ENCODED + s.rule, s.type) for s in matcher.spans(decoded)]
    return out


def without_overlaps(spans: Iterable[Span]) -> list[Span]:
    """Greedy in the given order: a span stays if it overlaps none that stays. In order of place.

    An empty span overlaps the spans that it lies inside of."""
    starts: list[int] = []
    kept: list[Span] = []
    for s in spans:
        at = bisect_left(starts, s.end) if s.end > s.start else bisect_right(starts, s.start)
        # of the kept, which lie apart, only the last that starts before the end can overlap
        if at and kept[at - 1].end > s.start and kept[at - 1].start < s.end:
            continue
        at = bisect_right(starts, s.start)
        starts.insert(at, s.start)
        kept.insert(at, s)
    return kept


def candidates(text: bytes, matcher: Matcher, bits: float = ENTROPY_BITS) -> list[Span]:
    """Spans of the rules, of encoded values and of high entropy, in this order of priority, without overlaps."""
    return without_overlaps([*matcher.spans(text), *encoded_spans(text, matcher), *high_entropy_spans(text, bits)])


class Lines:
    """Line and column of byte offsets, 1-based."""

    def __init__(self, text: bytes):
        self.text, self.breaks = text, [m.start() for m in re.finditer(b"\n", text)]

    def at(self, pos: int) -> tuple[int, int]:
        k = bisect_left(self.breaks, pos)
        return k + 1, pos - (self.breaks[k - 1] if k else -1)

    def bounds(self, pos: int) -> tuple[int, int]:
        k = bisect_left(self.breaks, min(max(pos, 0), len(self.text)))
        return (self.breaks[k - 1] + 1 if k else 0), (self.breaks[k] if k < len(self.breaks) else len(self.text))


def redact(value: bytes) -> str:
    """Stars for up to six bytes; else the first and last three bytes and stars between them."""
    n = len(value)
    return "*" * n if n <= 6 else value[:3].decode("utf-8", "replace") + "*" * (n - 6) + value[-3:].decode("utf-8", "replace")


def is_plain_shape(value: bytes) -> bool:
    """A UUID, a hash, a date, a URL or a short word."""
    return any(p.match(value) for p in _SHAPES)


def is_comment(line: bytes) -> bool:
    """A comment without anything like an assignment in it."""
    line = line.lstrip(b" \t")
    prefix = next((p for p in _COMMENTS if line.startswith(p)), None)
    return prefix is not None and not _ASSIGNMENT.search(line[len(prefix) :])


def is_example(text: bytes, lines: Lines, start: int) -> bool:
    """Whether the line of an offset, or a comment right above it, marks what is there as an example."""
    begin, end = lines.bounds(start)
    line = text[begin:end]
    if _MARKER.search(line) or _PLACEHOLDER.search(line):
        return True
    if not begin:
        return False
    above = text[lines.bounds(begin - 1)[0] : begin - 1]
    return bool(above) and is_comment(above) and bool(_MARKER.search(above))


def in_url(text: bytes, lines: Lines, start: int, end: int) -> bool:
    """Whether a span lies inside a URL on its line."""
    a, b = lines.bounds(start)
    return any(a + m.start() <= start and end <= a + m.end() for m in _URL.finditer(text[a:b]))


def soft_spans(text: bytes) -> list[tuple[int, int]]:
    """What looks like names and addresses; it only steers windows."""
    return [m.span() for p in (_NAME, _ADDRESS) for m in p.finditer(text)]


def windows(spans: Iterable[tuple[int, int]], size: int, window: int = WINDOW_BYTES) -> list[tuple[int, int]]:
    """Windows around the middles of spans, merged where they overlap or touch."""
    out: list[tuple[int, int]] = []
    half = window // 2
    around = ((max(0, (a + b) // 2 - half), min(size, (a + b) // 2 + half)) for a, b in spans)
    for a, b in sorted(w for w in around if w[1] > w[0]):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def sliding_windows(size: int, window: int = WINDOW_BYTES, overlap: int = WINDOW_OVERLAP) -> list[tuple[int, int]]:
    """Windows that cover a text; the last is the first to reach its end."""
    return [(s, min(s + window, size)) for s in range(0, size, window - overlap) if not s or s + overlap < size]


def best_of_type(spans: Iterable[ModelSpan]) -> list[ModelSpan]:
    """Of overlapping spans of one type the higher score, from left to right; at a tie the earlier."""
    left = sorted(spans, key=lambda s: (s.start, s.end))
    gone = [False] * len(left)
    for i, a in enumerate(left):
        if gone[i]:
            continue
        for j in range(i + 1, len(left)):
            b = left[j]
            if b.start >= a.end:
                break
            if gone[j] or b.type != a.type:
                continue
            if b.score > a.score:
                gone[i] = True
                break
            gone[j] = True
    return [s for s, x in zip(left, gone, strict=True) if not x]


class Finding(NamedTuple):
    start: int
    end: int
    rule: str
    confidence: float


def fuse(text: bytes, found: list[Span], model: list[ModelSpan], least: float = 0.5) -> list[Finding]:
    """Candidates that nothing speaks against, as their type, and model spans that overlap no candidate."""
    lines, out, covered = Lines(text), [], set()
    for c in found:
        over = [i for i, m in enumerate(model) if m.start < c.end and c.start < m.end]
        covered.update(over)
        noise = any(model[i].type == NOISE and model[i].score >= least for i in over)
        if noise and c.rule not in HIGH_TRUST or is_example(text, lines, c.start):
            continue
        if c.rule == HIGH_ENTROPY and (in_url(text, lines, c.start, c.end) or is_plain_shape(text[c.start : c.end])):
            continue
        out.append(Finding(c.start, c.end, c.type or "secret", 1.0))
    for i, m in enumerate(model):
        if i not in covered and m.type != NOISE and m.score >= least:
            start, end = max(0, m.start), min(m.end, len(text))
            end = max(start, end)
            if not is_plain_shape(text[start:end]) and not in_url(text, lines, start, end):
                out.append(Finding(start, end, m.type, m.score))
    return sorted(out, key=lambda f: (f.start, f.end, f.rule))


def snap(text: bytes, start: int, end: int, matcher: Matcher) -> tuple[int, int]:
    """A span widened to all rule matches, within some bytes around, that overlap it."""
    start, end = max(0, start), min(end, len(text))
    if end <= start:
        return start, end
    base = max(0, start - SNAP_BYTES)
    low, high = start, end
    for s in matcher.spans(text[base : end + SNAP_BYTES]):
        a, b = s.start + base, s.end + base
        if a < b and a < end and b > start:
            low, high = min(low, a), max(high, b)
    return low, high


def mask(text: bytes, findings: Iterable[tuple[int, int, str]], matcher: Matcher, placeholder: str = "") -> str:
    """The text with findings (start, end, rule) replaced.

    By [REDACTED_RULE_N], N the place in order of start, or by a fixed placeholder, both on snapped
    spans; or by a placeholder with %s for the rule, on spans as they are."""
    by_rule = "%s" in placeholder
    spans = [(*((a, b) if by_rule else snap(text, a, b, matcher)), rule) for a, b, rule in findings]
    out, at = [], 0
    for n, (a, b, rule) in enumerate(sorted(spans, key=lambda s: s[0]), 1):
        if a >= at:
            out.append(text[at:a])
            out.append((placeholder.replace("%s", rule) if by_rule else placeholder or f"[REDACTED_{rule.upper()}_{n}]").encode())
            at = b
    return b"".join([*out, text[at:]]).decode("utf-8", "replace")


def decode_bio(labels: list[str], logits: list[list[float]], offsets: list[tuple[int, int]], attention: list[int]) -> list[ModelSpan]:
    """Spans of token labels O, B-X and I-X, from each token's logits over labels.

    A special token (without an extent), padding or O ends a span; I-X after no X begins one. A
    span's score is the mean of its tokens' largest probabilities."""
    out, now = [], None

    def close() -> None:
        nonlocal now
        if now:
            out.append(ModelSpan(now[0], now[1], now[2], sum(now[3]) / len(now[3])))
        now = None

    for row, (a, b), on in zip(logits, offsets, attention, strict=True):
        top = max(row)
        prefix, _, kind = labels[row.index(top)].partition("-")
        if not on or not (a or b) or prefix not in ("B", "I") or not kind:
            close()
            continue
        p = 1 / sum(math.exp(x - top) for x in row)
        if now and prefix == "I" and kind == now[2]:
            now[1] = b
            now[3].append(p)
        else:
            close()
            now = [a, b, kind, [p]]
    close()
    return out
