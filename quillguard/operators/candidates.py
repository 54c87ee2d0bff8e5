"""Candidates, findings and masked texts of whole tables.

A text goes to Python only if it can have a hit: gate() is a condition on strings and literals that
Spark evaluates in the scan. There, one Arrow batch at a time, all rules run over a text's bytes; the
literals that a rule needs are looked for first, so most rules never run on most texts. Nothing here
shuffles: every row is worked on where it is read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import or_
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cluster import ship
from ..functions import scan
from ..functions.rules import PII, RuleSet
from ..functions.scan import Lines, Matcher, ModelSpan
from ..sources.files import chunks

CANDIDATE = "start int, end int, rule string, rule_type string, value string, redacted string, line int, column int, entropy double, left_ctx string, right_ctx string"


class Scorer(Protocol):
    """How likely each (left context, value, right context) is a real secret, 0 to 1. Must pickle."""

    def __call__(self, triples: list[tuple[str, str, str]]) -> list[float]: ...


class Detector(Protocol):
    """Spans that a model finds in a text's bytes, types secret, pii or noise. Must pickle."""

    def __call__(self, text: bytes) -> list[ModelSpan]: ...


@dataclass(frozen=True)
class Options:
    """How to scan. min_confidence holds for scores of secrets and for model spans."""

    rules: RuleSet = field(default_factory=RuleSet.default)
    min_confidence: float = 0.5
    entropy_bits: float = scan.ENTROPY_BITS
    context_bytes: int = scan.CONTEXT_BYTES
    prefilter: bool = True

    @classmethod
    def preset(cls, name: str) -> Options:
        """default: hybrid detection with a lower entropy bound; scan: as the command line."""
        return {"default": cls(entropy_bits=3.0), "scan": cls()}[name]


#: What soft spans need.
_SOFT = r"[A-Z][a-z]+[\t\n\f\r ]+[A-Z][a-z]|[0-9][\t\n\f\r ]+[A-Za-z]"
#: Needs that begin so are looked for only in texts with this sign, or with a match of this quicker pattern.
_SIGNS = {
    "[A-Za-z0-9%": ("=",),
    "(?i:licen": "[dD][lL]|[lL][iI][cC]",
    "(?i:passw": "[dhntyDHNTY][ \\t\\n\\f\\r]*[:=]",
    "(?:[0-9A-Fa-f]": "[:\\-][0-9A-Fa-f]{1,4}[:\\-]",
    "[0-9]": "[0-9]{2}|[0-9]\\.[0-9]",
    "[A-Z": "[0-9]{2}",
    r"\+": ("+",),
}


def gate(text: Column, rules: RuleSet, soft: bool = False) -> Column:
    """Whether a text may have a candidate, or also a soft span: it has what every match of some rule has.

    Needs are the rules' own (scan.need()); a rule of which nothing is known leaves all texts in.
    Encoded and high-entropy values need a run of token characters, as most rules do."""
    needs = {scan.need(r) for r in rules.or_default()}
    if None in needs:
        return F.lit(True)
    has = lambda *signs: reduce(or_, (F.contains(text, F.lit(s)) for s in signs))
    plain = {n for n in needs if re.fullmatch("[A-Za-z@\" -]+|\"\\w+\"", n)}
    groups: dict[str | tuple, list[str]] = {}
    for n in sorted(needs - plain - {scan.RUN}):
        groups.setdefault(next((v for k, v in _SIGNS.items() if n.startswith(k)), ""), []).append(n)
    out = has(*sorted(plain), *(x.decode() for x in scan.FOLDED)) | F.rlike(text, F.lit(scan.RUN))
    for sign, parts in groups.items():
        found = F.rlike(text, F.lit("|".join(parts)))
        out = out | ((has(*sign) if isinstance(sign, tuple) else F.rlike(text, F.lit(sign))) & found if sign else found)
    return out | F.rlike(text, F.lit(_SOFT)) if soft else out


def _rows(texts: pa.Array) -> Iterator[bytes]:
    for x in texts.cast(pa.binary()):
        yield x.as_py() or b""


def _text(value: bytes) -> str:
    return value.decode("utf-8", "replace")


def candidate_rows(text: bytes, matcher: Matcher, o: Options) -> list[tuple]:
    """The fields of CANDIDATE for each candidate."""
    found = scan.candidates(text, matcher, o.entropy_bits)
    lines = Lines(text) if found else None
    ctx = o.context_bytes if o.context_bytes > 0 else scan.CONTEXT_BYTES
    out = []
    for c in found:
        value = text[c.start : c.end]
        out.append((c.start, c.end, c.rule, c.type, _text(value), scan.redact(value), *lines.at(c.start), scan.entropy(value), _text(text[max(0, c.start - ctx) : c.start]), _text(text[c.end : c.end + ctx])))
    return out


_ARROW = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.string(), pa.string()]
_NAMES = [x.split(" ")[0] for x in CANDIDATE.split(", ")]


def per_text(df: DataFrame, id_col: str, text_col: str, names: list[str], kinds: list[pa.DataType], schema: str, rows: Callable[[], Callable[[bytes], list[tuple]]], keep: Callable[[Column], Column]) -> DataFrame:
    """(id_col, names...): a row for each tuple that rows()(text) gives, rows() being called once a task.
    Texts that keep turns down are passed over."""
    ship(df.sparkSession)
    key = f"key {df.schema[id_col].dataType.simpleString()}"
    slim = df.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    slim = slim.where(keep(F.col("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = rows()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                found, of = [], []
                for i, text in enumerate(_rows(part.column(1))):
                    new = each(text)
                    found += new
                    of += [i] * len(new)
                columns = [pa.array([r[j] for r in found], t) for j, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of, pa.int64())), *columns], ["key", *names])

    out = slim.mapInArrow(run, f"{key}, {schema}")
    return out.withColumnRenamed("key", id_col)


def extract(df: DataFrame, options: Options | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, CANDIDATE...): candidates without overlaps, in byte offsets. Null texts have none."""
    o = options or Options()

    def rows():
        matcher = Matcher(o.rules)
        return lambda text: candidate_rows(text, matcher, o)

    return per_text(df, id_col, text_col, _NAMES, _ARROW, CANDIDATE, rows, lambda t: gate(t, o.rules))


def raw_matches(df: DataFrame, options: Options | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, start, end, rule, rule_type): all matches of the rules, overlapping ones too."""
    o = options or Options()

    def rows():
        matcher = Matcher(o.rules)
        return lambda text: [tuple(s) for s in matcher.spans(text)]

    return per_text(df, id_col, text_col, _NAMES[:4], _ARROW[:4], "start int, end int, rule string, rule_type string", rows, lambda t: gate(t, o.rules))


def extract_chunked(df: DataFrame, options: Options | None = None, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """extract() over chunks of long texts, in offsets of the whole text; of equal spans the first chunk's.

    line and column count from the chunk's start."""
    parts = chunks(df, id_col, text_col, **sizes)
    parts = parts.select(F.struct(id_col, "chunk_no", "chunk_start").alias("part"), "content")
    found = extract(parts, options, "part", "content")
    found = found.withColumns({"start": F.col("part.chunk_start") + F.col("start"), "end": F.col("part.chunk_start") + F.col("end")})
    rest = [n for n in _NAMES if n not in ("start", "end")]
    first = F.min_by(F.struct(*rest), "part.chunk_no").alias("first")
    return found.groupBy(F.col(f"part.{id_col}").alias(id_col), "start", "end").agg(first).select(id_col, "start", "end", *[F.col(f"first.{n}").alias(n) for n in rest])


def scored(cands: DataFrame, scorer: Scorer | None, min_confidence: float = 0.5) -> DataFrame:
    """Candidates with a confidence of at least min_confidence.

    Personal data and, without a scorer, everything has confidence 1. Only secrets go to the
    scorer, an Arrow batch at a time."""
    if scorer is None:
        return cands.withColumn("confidence", F.lit(1.0))
    fields = T.StructType([*cands.schema.fields, T.StructField("confidence", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            secret = [i for i, x in enumerate(batch.column("rule_type").to_pylist()) if x != PII]
            out = [1.0] * batch.num_rows
            if secret:
                part = batch.take(pa.array(secret))
                triples = list(zip(*(part.column(n).to_pylist() for n in ("left_ctx", "value", "right_ctx")), strict=True))
                for i, p in zip(secret, scorer(triples), strict=True):
                    out[i] = float(p)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, "confidence"])

    ship(cands.sparkSession)
    return cands.mapInArrow(run, fields).where(F.col("confidence") >= min_confidence)


def batch_score(triples: DataFrame, scorer: Scorer | None) -> DataFrame:
    """Rows of (left_ctx, value, right_ctx, ...) with their score; 1 without a scorer."""
    if scorer is None:
        return triples.withColumn("confidence", F.lit(1.0))
    return scored(triples.withColumn("rule_type", F.lit("secret")), scorer, float("-inf")).drop("rule_type")


def detected(text: bytes, matcher: Matcher, detector: Detector, o: Options) -> list[scan.Finding]:
    """Hybrid detection in one text: the model reads only windows around candidates and soft spans."""
    if not o.prefilter:
        spans = [s for s in detector(text) if s.score >= o.min_confidence]
        return [scan.Finding(max(0, s.start), max(0, min(s.end, len(text))), s.type, s.score) for s in spans]
    found = scan.candidates(text, matcher, o.entropy_bits)
    around = [(c.start, c.end) for c in found] + scan.soft_spans(text)
    model = []
    for a, b in scan.windows(around, len(text)):
        model += [m._replace(start=m.start + a, end=m.end + a) for m in detector(text[a:b])]
    return scan.fuse(text, found, scan.best_of_type(model), o.min_confidence)


FINDING = "start int, end int, rule string, confidence double, value string, redacted string, line int, column int"


def detect(df: DataFrame, detector: Detector | None = None, options: Options | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, FINDING...): findings of rules and a model, rule being the class. Without a detector the
    model finds nothing, and suppression alone acts on the candidates."""
    o = options or Options()

    def rows():
        matcher, model = Matcher(o.rules), detector or (lambda text: [])

        def one(text: bytes) -> list[tuple]:
            found = detected(text, matcher, model, o)
            lines = Lines(text) if found else None
            return [(*f, _text(text[f.start : f.end]), scan.redact(text[f.start : f.end]), *lines.at(f.start)) for f in found]

        return one

    names = [x.split(" ")[0] for x in FINDING.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string(), pa.string(), pa.int32(), pa.int32()]
    return per_text(df, id_col, text_col, names, kinds, FINDING, rows, lambda t: gate(t, o.rules, soft=True) if o.prefilter else F.lit(True))


def masked(df: DataFrame, placeholder: str = "", options: Options | None = None, text_col: str = "text", out_col: str = "masked") -> DataFrame:
    """df with out_col, the text with its candidates replaced, and n_masked, how many there were.

    Python gets the texts that can have a hit and nothing else of a row; a null text stays null."""
    out = redacted(df, placeholder, options, text_col, out_col, "findings__")
    return out.withColumn("n_masked", F.coalesce(F.size("findings__"), F.lit(0))).drop("findings__")


def redacted(df: DataFrame, placeholder: str = "", options: Options | None = None, text_col: str = "text", out_col: str = "masked", findings_col: str = "findings") -> DataFrame:
    """df with out_col, the text with its candidates replaced, and findings_col, an array of the candidates
    (CANDIDATE) that were: empty where there are none, null for a null text."""
    o = options or Options()
    ship(df.sparkSession)
    kinds = pa.struct([("text", pa.string()), ("found", pa.list_(pa.struct(list(zip(_NAMES, _ARROW, strict=True)))))])
    fields = ", ".join(f"`{x.split(' ')[0]}`: {x.split(' ')[1]}" for x in CANDIDATE.split(", "))
    made: dict[str, Matcher] = {}

    def run(texts: pa.Array) -> pa.Array:
        matcher = made.get("m") or made.setdefault("m", Matcher(o.rules))
        out = []
        for value in texts.cast(pa.binary()):
            text = value.as_py()
            found = candidate_rows(text, matcher, o) if text else []
            whole = scan.mask(text, [(c[0], c[1], c[2]) for c in found], matcher, placeholder) if found else None
            out.append({"text": whole, "found": [dict(zip(_NAMES, c, strict=True)) for c in found]})
        return pa.array(out, kinds)

    text = F.col(text_col).cast("string")
    udf = F.arrow_udf(run, f"text string, found array<struct<{fields}>>")
    done = df.withColumn(findings_col, udf(F.when(gate(text, o.rules), text)))
    none = F.array().cast(f"array<struct<{fields}>>")
    done = done.withColumn(out_col, F.coalesce(F.col(findings_col)["text"], text))
    return done.withColumn(findings_col, F.when(text.isNotNull(), F.coalesce(F.col(findings_col)["found"], none)))


def safe(found: DataFrame) -> DataFrame:
    """Without raw values and their surroundings: what may be shown by default."""
    return found.drop("value", "left_ctx", "right_ctx")
