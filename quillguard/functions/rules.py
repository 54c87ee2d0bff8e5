"""Rule sets: parsing, overriding, disabling, filtering."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property

from .catalog import DEFAULT_RULES
from .regex import to_bytes, to_java, tokens

SECRET, PII = "secret", "pii"


@dataclass(frozen=True)
class Rule:
    """A named RE2 pattern. group is the capturing group that is the value, 0 for the whole match."""

    name: str
    pattern: str
    type: str = SECRET
    group: int = 0

    def __post_init__(self) -> None:
        if not self.name or not self.pattern:
            raise ValueError("a rule needs a name and a pattern")
        try:
            groups = to_bytes(self.pattern).groups
        except (re.error, IndexError) as e:
            raise ValueError(f"rule {self.name}: {e}") from e
        if not self.group and groups:
            object.__setattr__(self, "group", 1)
        if not self.type:
            object.__setattr__(self, "type", SECRET)

    @cached_property
    def compiled(self) -> re.Pattern[bytes]:
        return to_bytes(self.pattern)

    @cached_property
    def java(self) -> str:
        return to_java(self.pattern)


@dataclass(frozen=True)
class RuleSet:
    """Rules in order of priority. Every operation gives a new set."""

    rules: tuple[Rule, ...]

    @classmethod
    def default(cls) -> RuleSet:
        return cls(tuple(Rule(n, p, t, g) for n, t, g, p in DEFAULT_RULES))

    def __iter__(self):
        return iter(self.rules)

    def __len__(self) -> int:
        return len(self.rules)

    def names(self) -> list[str]:
        return [r.name for r in self.rules]

    def extended(self, extra: Iterable[Rule] = (), disabled: Iterable[str] = ()) -> RuleSet:
        """Without the disabled; rules of a known name take its place, others come last."""
        gone, new = set(disabled), {r.name: r for r in extra}
        kept = [new.pop(r.name, r) for r in self.rules if r.name not in gone]
        return RuleSet((*kept, *(r for r in new.values() if r.name not in gone)))

    def of_types(self, types: Iterable[str] | None) -> RuleSet:
        """Rules of the types; unknown types are passed over, None is all."""
        if types is None:
            return self
        wanted = {t.strip().lower() for t in types} & {SECRET, PII}
        return RuleSet(tuple(r for r in self.rules if r.type in wanted))

    def selected(self, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> RuleSet:
        include, exclude = set(include), set(exclude)
        return RuleSet(tuple(r for r in self.rules if (not include or r.name in include) and r.name not in exclude))

    def or_default(self) -> RuleSet:
        """An empty set stands for all default rules."""
        return self if self.rules else RuleSet.default()

    def to_json(self) -> str:
        return json.dumps({"rules": [{"name": r.name, "type": r.type, "pattern": r.pattern} | ({"value_group": r.group} if r.group else {}) for r in self.rules]}, indent=2)

    def to_df(self, spark):
        rows = [(i, r.name, r.type, r.pattern, r.group) for i, r in enumerate(self.rules)]
        return spark.createDataFrame(rows, "rule_order int, name string, type string, pattern string, value_group int")


def parse_rules(text: str) -> tuple[list[Rule], list[str]]:
    """(rules, disabled names) of a config: an object with rules or disabled, or an array of rules."""
    data = json.loads(text)
    if isinstance(data, dict) and (data.get("rules") or data.get("disabled")):
        rows, disabled = data.get("rules") or [], data.get("disabled") or []
    elif isinstance(data, list):
        rows, disabled = data, []
    else:
        raise ValueError("rules: neither an object with rules or disabled, nor an array")
    return [Rule(r.get("name", ""), r.get("pattern", ""), r.get("type") or SECRET, r.get("value_group") or 0) for r in rows], list(disabled)


def parse_added(text: str) -> Rule:
    """A rule from NAME=PATTERN."""
    name, sep, pattern = text.partition("=")
    if not sep:
        raise ValueError(f"{text!r} is not NAME=PATTERN")
    return Rule(name.strip(), pattern)


def anchors(pattern: str) -> tuple[str, ...]:
    """Lower-case literals of which every match has one, the longest there are; empty if none is certain.

    Only what stands outside groups and quantifiers is looked at, and a leading choice of literals."""
    parts = tokens(pattern)
    if parts and re.fullmatch(r"\(\?[ims]+\)", parts[0]):
        parts = parts[1:]
    runs, run, depth, k = [], "", 0, 0
    optional = lambda k: k < len(parts) and parts[k] in ("?", "*", "{")
    if "|" in parts and depth == 0:
        level = 0
        for p in parts:
            level += (p[0] == "(" and p != r"\(") - (p == ")")
            if p == "|" and not level:
                return ()
    choices: list[tuple[str, ...]] = []
    while k < len(parts):
        p = parts[k]
        if p[0] == "(":
            close, level = k, 0
            while True:
                level += (parts[close][0] == "(") - (parts[close] == ")")
                if not level:
                    break
                close += 1
            runs.append(run)
            run = ""
            inside = "".join(parts[k + 1 : close])
            if not optional(close + 1) and re.fullmatch(r"[\w|+-]+", inside):
                choices.append(tuple(x.lower() for x in inside.split("|")))
            k = close + 1
            continue
        char = p if len(p) == 1 and p not in "^$.?*+{}|[]()" else p[1] if len(p) == 2 and p[0] == "\\" and not p[1].isalnum() else ""
        if p == "{":
            while parts[k] != "}":
                k += 1
            runs.append(run)
            run = ""
        elif char and not optional(k + 1):
            run += char
        else:
            runs.append(run)
            run = ""
        k += 1
    runs.append(run)
    best = max(runs, key=len).lower()
    choices = [c for c in choices if min(map(len, c)) > len(best)]
    if choices:
        return max(choices, key=lambda c: min(map(len, c)))
    return (best,) if best else ()


def least_run(pattern: str, inside: set[str]) -> int:
    """The fewest characters of a set that stand in a row in every match, as far as the pattern tells by itself."""
    parts = tokens(pattern)

    def pure(t: str) -> bool:
        """Whether a single piece takes ASCII characters of the set only."""
        if len(t) > 2 and (t[0] != "[" or t[1] == "^") or t in (".", r"\s", r"\S", r"\W", r"\D"):
            return False
        one = re.compile(t if len(t) > 1 else re.escape(t), re.ASCII)
        return all(chr(c) in inside for c in range(128) if one.fullmatch(chr(c)))

    def choice(k: int) -> tuple[int, int | None, int]:
        """Of the alternatives from k to their closing bracket: the longest sure run, the least length if all is in the set, and the next k."""
        best, whole = [], []
        longest = run = length = 0
        only = True
        while True:
            t = parts[k] if k < len(parts) else ")"
            k += 1
            if t in (")", "|"):
                best.append(max(longest, run))
                whole.append(length if only else None)
                longest = run = length = 0
                only = True
                if t == ")":
                    return min(best), None if None in whole else min(whole), k
                continue
            if t in (r"\b", "^", "$") or re.fullmatch(r"\(\?[imsU]+\)", t):
                continue
            if t[0] == "(":
                deep, size, k = choice(k)
            else:
                deep, size = 0, 1 if pure(t) else None
            least = 1
            if k < len(parts) and parts[k] in ("?", "*", "+", "{"):
                if parts[k] == "{":
                    end = parts.index("}", k)
                    least = int("".join(parts[k + 1 : end]).split(",")[0])
                    k = end
                else:
                    least = int(parts[k] == "+")
                k += 1 + (k + 1 < len(parts) and parts[k + 1] == "?")
            if size is None:
                only, longest, run = False, max(longest, run, deep if least else 0), 0
            else:
                run, length = run + size * least, length + size * least

    return choice(0)[0]
