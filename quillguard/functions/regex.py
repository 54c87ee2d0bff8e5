"""RE2 patterns in the syntax of other engines, with RE2's meaning.

RE2 knows ASCII only in \\b, \\d, \\w and \\s, its \\s lacks \\x0b, its dot lacks \\n only, and ignoring case it
takes U+212A for k and U+017F for s. to_java() gives a pattern for Spark's functions on strings,
to_bytes() one for Python's re on UTF-8 bytes, where matches have byte offsets.
"""

from __future__ import annotations

import re

#: RE2's white space, and its other letters for k and s when case is ignored.
SPACE = r"\t\n\f\r "
FOLDS = {"k": "K", "s": "ſ"}


def tokens(pattern: str) -> list[str]:
    """Escapes, classes, group openings and single characters of a pattern."""
    out, i = [], 0
    while i < len(pattern):
        j = i + 1
        if pattern[i] == "\\":
            j = i + 2
        elif pattern[i] == "[":
            j = i + (3 if pattern[i + 1 : i + 3] in ("^]",) else 2)
            while pattern[j] != "]":
                j += 2 if pattern[j] == "\\" else 1
            j += 1
        elif pattern.startswith("(?", i) and (m := re.match(r"\(\?(?:[imsU-]*[:)]|P?<\w+>)", pattern[i:])):
            j = i + m.end()
        out.append(pattern[i:j])
        i = j
    return out


def _ignores_case(pattern: str) -> bool:
    m = re.match(r"\(\?([ims]+)\)", pattern)
    return bool(m and "i" in m[1])


def _has(inner: str, letter: str) -> bool:
    """Whether a class takes a letter in either case."""
    return bool(re.match(f"[{inner}]", letter) or re.match(f"[{inner}]", letter.upper()))


def _class(body: str) -> tuple[bool, str]:
    """Whether a class is negated, and its inside with \\s spelt out."""
    inner = body[1:-1]
    negated = inner.startswith("^")
    return negated, (inner[1:] if negated else inner).replace(r"\s", SPACE)


def to_java(pattern: str) -> str:
    """For Spark's regular-expression functions."""
    word = "0-9A-Za-z_"
    edge = f"(?:(?<=[{word}])(?![{word}])|(?<![{word}])(?=[{word}]))"
    fold, dot_all, out = _ignores_case(pattern), False, []
    for t in tokens(pattern):
        if m := re.fullmatch(r"\(\?([ims]+)\)", t):
            dot_all |= "s" in m[1]
            out.append(t)
        elif t == r"\b":
            out.append(edge)
        elif t == r"\s":
            out.append(f"[{SPACE}]")
        elif t == r"\S":
            out.append(f"[^{SPACE}]")
        elif t == "." and not dot_all:
            out.append(r"[^\n]")
        elif t == "$":
            out.append(r"\z")
        elif t[0] == "[":
            negated, inner = _class(t)
            more = "".join(FOLDS[c] for c in FOLDS if fold and _has(inner, c))
            out.append(f"[{'^' * negated}{inner.replace('[', chr(92) + '[')}{more}]")
        elif fold and t.lower() in FOLDS:
            out.append(f"[{t.lower()}{t.upper()}{FOLDS[t.lower()]}]")
        else:
            out.append(t)
    return "".join(out)


#: One UTF-8 character beyond ASCII.
_WIDE = r"[\xc2-\xf4][\x80-\xbf]{1,3}"


def to_bytes(pattern: str) -> re.Pattern[bytes]:
    """For Python's re on UTF-8 bytes."""
    fold, dot_all, out = _ignores_case(pattern), False, []
    wide = {c: "".join(f"\\x{b:02x}" for b in x.encode()) for c, x in FOLDS.items()}
    for t in tokens(pattern):
        if m := re.fullmatch(r"\(\?([ims]+)\)", t):
            dot_all |= "s" in m[1]
            out.append(t)
        elif t == r"\s":
            out.append(f"[{SPACE}]")
        elif t == r"\S":
            out.append(f"(?:[^{SPACE}\\x80-\\xff]|{_WIDE})")
        elif t == ".":
            out.append(f"(?:[\\x00-\\x7f]|{_WIDE})" if dot_all else f"(?:[\\x00-\\x09\\x0b-\\x7f]|{_WIDE})")
        elif t == "$":
            out.append(r"\Z")
        elif t[0] == "[":
            negated, inner = _class(t)
            folds = [wide[c] for c in FOLDS if fold and _has(inner, c)]
            if negated:
                out.append(f"(?:{''.join(f'(?!{x})' for x in folds)}(?:[^{inner}\\x80-\\xff]|{_WIDE}))")
            else:
                out.append(f"(?:[{inner}]|{'|'.join(folds)})" if folds else f"[{inner}]")
        elif fold and t.lower() in FOLDS:
            out.append(f"(?:{t}|{wide[t.lower()]})")
        else:
            out.append(t)
    return re.compile("".join(out).encode("latin-1"))


def split_group(pattern: str) -> str:
    """A pattern of one capturing group with what stands before the group as a group of its own, so
    that group 1 is the prefix and group 2 the value."""
    parts = tokens(pattern)
    head = 1 if re.fullmatch(r"\(\?[ims]+\)", parts[0]) else 0
    at = parts.index("(")
    return "".join([*parts[:head], "(", *parts[head:at], ")", *parts[at:]])
