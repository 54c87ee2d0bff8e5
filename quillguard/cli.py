"""Command line: scan and detect files, list rules."""

from __future__ import annotations

import argparse
import json
import os
import sys
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .functions.rules import PII, SECRET, RuleSet, parse_added, parse_rules
from .operators.candidates import Options, detect, extract, masked, safe, scored
from .operators.models import SequenceScorer, TokenDetector
from .sources.files import FileFilter, read_files


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillguard")
    top.add_argument("--config", default=".quillguard.json", help="defaults of options, as JSON or, where PyYAML is there, YAML; flags and QUILLGUARD_* variables come first")
    top.add_argument("--preset", help="such a file whose values come before all others")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("scan", "detect"):
        p = sub.add_parser(name)
        p.add_argument("paths", nargs="*", default=["-"])
        p.add_argument("--file-include", action="append", default=[])
        p.add_argument("--file-exclude", action="append", default=[])
        p.add_argument("--file-max-mb", type=int, default=10)
        p.add_argument("--rule-add", action="append", default=[], metavar="NAME=PATTERN")
        p.add_argument("--rule-file")
        p.add_argument("--rule-include", default="")
        p.add_argument("--rule-exclude", default="")
        p.add_argument("--detect", choices=("secrets", "pii", "both"), default="both")
        p.add_argument("--model", help="model file, on all executors; scan: of a scorer, detect: of a token classifier")
        p.add_argument("--tokenizer", help="tokenizers file of the model")
        p.add_argument("--model-labels", default="O,B-secret,I-secret,B-pii,I-pii,B-noise,I-noise", help="the classes of a token classifier")
        p.add_argument("--model-off", action="store_true")
        p.add_argument("--model-threshold", type=float, default=0.5)
        p.add_argument("--no-prefilter", action="store_true")
        p.add_argument("--extract-entropy", type=float, default=4.0)
        p.add_argument("--extract-ctx", type=int, default=256)
        p.add_argument("-m", "--output-mask", action="store_true")
        p.add_argument("-j", "--output-json", action="store_true")
        p.add_argument("-o", "--output-file")
        p.add_argument("-p", "--output-placeholder", default="")
        p.add_argument("--output-reveal-secrets", action="store_true")
        p.add_argument("-f", "--fail-end", action="store_true")
        p.add_argument("--fail-fast", action="store_true")
        p.add_argument("-w", "--perf-workers", type=int, default=max(1, (os.cpu_count() or 1) - 2))
    p = sub.add_parser("rules")
    p.add_argument("--json", action="store_true")
    sub.add_parser("version")
    return top


def _values(path: Path) -> dict:
    """Option values of a JSON or YAML file."""
    if path.suffix in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError as e:
            raise ValueError(f"{path}: PyYAML is not installed") from e
        return yaml.safe_load(path.read_text()) or {}
    return json.loads(path.read_text())


def settings(argv: list[str]) -> argparse.Namespace:
    """Options: the preset file, then flags, variables, the config file and defaults."""
    top = parser()
    args = top.parse_args(argv)
    given = {a.split("=")[0].lstrip("-").replace("-", "_") for a in argv if a.startswith("--")}
    shorts = {"-m": "output_mask", "-j": "output_json", "-o": "output_file", "-p": "output_placeholder", "-f": "fail_end", "-w": "perf_workers"}
    given |= {shorts[a] for a in argv if a in shorts}

    def fit(name: str, value):
        now = getattr(args, name)
        if isinstance(now, bool):
            return str(value).lower() in ("1", "true", "yes")
        return type(now)(value) if now is not None and not isinstance(now, list) else value

    names = [args.config, *([".quillguard.yaml"] if args.config == ".quillguard.json" else [])]
    config = next((_values(p) for p in (x / n for n in names for x in (Path("."), Path.home())) if p.is_file()), {})
    values = {k.replace("-", "_"): v for k, v in config.items()} | {k[11:].lower(): v for k, v in os.environ.items() if k.startswith("QUILLGUARD_")}
    for k, v in values.items():
        if k not in given and hasattr(args, k):
            setattr(args, k, fit(k, v))
    if args.preset:
        for k, v in _values(Path(args.preset)).items():
            if hasattr(args, name := k.replace("-", "_")):
                setattr(args, name, fit(name, v))
    return args


def rule_set(args: argparse.Namespace) -> RuleSet:
    extra, disabled = parse_rules(Path(args.rule_file).read_text()) if args.rule_file else ([], [])
    names = lambda text: [x.strip() for x in text.split(",") if x.strip()]
    # an include list chooses among the default rules; added ones stay
    default = RuleSet.default()
    left_out = set(default.names()) - set(names(args.rule_include) or default.names())
    rules = default.extended([*extra, *map(parse_added, args.rule_add)], [*disabled, *left_out, *names(args.rule_exclude)])
    return rules.of_types({"secrets": [SECRET], "pii": [PII], "both": None}[args.detect])


def session(workers: int) -> SparkSession:
    builder = SparkSession.builder.appName("quillguard").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if "SPARK_MASTER" not in os.environ and SparkSession.getActiveSession() is None:
        builder = builder.master(f"local[{workers}]")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def texts(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, bool]:
    """(file, text), and whether it is standard input."""
    if args.paths in ([], ["-"]):
        return spark.createDataFrame([("<stdin>", sys.stdin.buffer.read().decode("utf-8", "replace"))], "file string, text string"), True
    files = replace(FileFilter(), max_bytes=args.file_max_mb << 20)
    for raw in (x for v in args.file_exclude for x in v.split(",")):
        files = files.exclude(raw)
    for raw in (x for v in args.file_include for x in v.split(",")):
        files = files.include(raw)
    return read_files(spark, args.paths, files).select(F.col("path").alias("file"), "text"), False


def models(args: argparse.Namespace) -> tuple[SequenceScorer | None, TokenDetector | None]:
    """The scorer or the detector that --model names, with --tokenizer."""
    if not args.model or args.model_off:
        return None, None
    if not args.tokenizer:
        raise ValueError("--model needs --tokenizer")
    for path in (args.model, args.tokenizer):
        if not Path(path).is_file():
            raise OSError(f"{path}: no such file; --model-off scans without a model")
    if args.command == "detect":
        return None, TokenDetector(args.model, args.tokenizer, tuple(args.model_labels.split(",")))
    return SequenceScorer(args.model, args.tokenizer), None


def record(row, reveal: bool) -> dict:
    """The wire form of a finding; zero and empty fields are left out."""
    out = {"file": row["file"] if row["file"] != "<stdin>" else "", "line": row["line"], "column": row["column"], "rule": row["rule"], "redacted": row["redacted"], "start": row["start"], "end": row["end"]}
    out |= {k: row[k] for k in ("entropy", "confidence") if k in row and row[k]}
    if reveal:
        out["span"] = row["value"]
    return {k: v for k, v in out.items() if k != "file" or v}


def main(argv: list[str] | None = None, scorer=None, detector=None) -> int:
    """0, 1 after an error (for detect also with findings), 2 with findings if asked to fail.

    Findings and masked texts of files are printed as they come, or written by the executors where
    --output-file names a folder: the driver never holds them all."""
    args = settings(sys.argv[1:] if argv is None else argv)
    if args.command == "version":
        print(__version__)
        return 0
    if args.command == "rules":
        rules = RuleSet.default()
        print(rules.to_json() if args.json else "\n".join(f"{r.type:<8}{r.name}" for r in rules))
        return 0
    try:
        by_flag = models(args)
        scorer, detector = scorer or by_flag[0], detector or by_flag[1]
        options = Options(rules=rule_set(args), min_confidence=args.model_threshold, entropy_bits=args.extract_entropy, context_bytes=args.extract_ctx, prefilter=not args.no_prefilter)
        spark = session(args.perf_workers)
        df, stdin = texts(spark, args)
        if args.output_mask:
            out = masked(df, args.output_placeholder, options).select("file", "masked", "n_masked")
            count = _masked_files(out, args) if not stdin else _masked_input(out, args)
        else:
            if args.command == "detect":
                out = detect(df, detector, options, "file")
            else:
                out = scored(extract(df, options, "file"), None if args.model_off else scorer, options.min_confidence)
            out = out if args.output_reveal_secrets else safe(out)
            out = out.limit(1) if args.fail_fast else out
            count = _findings(out, args, stdin)
    except (ValueError, OSError) as e:
        print(f"quillguard: {e}", file=sys.stderr)
        return 1
    if args.command == "detect":
        return 1 if count else 0
    return 2 if count and (args.fail_end or args.fail_fast) else 0


def _print(text: str, args: argparse.Namespace) -> None:
    if args.output_file:
        Path(args.output_file).write_text(text)
    else:
        sys.stdout.write(text)


def _masked_input(out: DataFrame, args: argparse.Namespace) -> int:
    row = out.first()
    _print(row["masked"], args)
    return row["n_masked"]


def _masked_files(out: DataFrame, args: argparse.Namespace) -> int:
    """Masked texts of files: JSON lines in the output folder, or one after the other, each under its path."""
    if args.output_file:
        out.write.mode("overwrite").json(args.output_file)
        return out.sparkSession.read.schema(out.schema).json(args.output_file).agg(F.coalesce(F.sum("n_masked"), F.lit(0))).first()[0]
    count = 0
    for row in out.toLocalIterator():
        sys.stdout.write(f"==> {row['file']} <==\n{row['masked']}" + "\n" * (not row["masked"].endswith("\n")))
        count += row["n_masked"]
    return count


def _findings(out: DataFrame, args: argparse.Namespace, stdin: bool) -> int:
    if args.output_file and not stdin:
        wire = {f.name: ("span" if f.name == "value" else f.name) for f in out.schema}
        out = out.select(*[F.col(k).alias(v) for k, v in wire.items() if v not in ("rule_type", "left_ctx", "right_ctx")])
        out.write.mode("overwrite").json(args.output_file)
        return out.sparkSession.read.schema(out.schema).json(args.output_file).count()
    count, lines = 0, []
    for row in (out.orderBy("start", "end") if stdin else out).toLocalIterator():
        line = record(row.asDict(), args.output_reveal_secrets)
        count += 1
        if stdin:
            lines.append(line)  # of one text
        else:
            sys.stdout.write(json.dumps(line, ensure_ascii=False) + "\n")
    if stdin:
        _print(json.dumps(lines, indent=2, ensure_ascii=False) + "\n" if args.command == "scan" else "".join(json.dumps(x, ensure_ascii=False) + "\n" for x in lines), args)
    return count


if __name__ == "__main__":
    sys.exit(main())
