"""Files as a table of texts: which are read, which look binary, and chunks of long ones."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Directories and extensions that are passed over by default, and sizes.
SKIP_DIRS = (
    ".git", ".hg", ".svn", "node_modules", "bower_components", "vendor", ".venv", "venv", "env", "__pycache__", ".tox",
    ".next", ".nuxt", "dist", "build", "target", ".gradle", ".idea", ".vscode", ".cache", ".pytest_cache", ".ruff_cache",
    ".mypy_cache", ".terraform", ".angular", ".svelte-kit", ".parcel-cache",
)
SKIP_EXTS = (
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".ico", ".bmp", ".mp3", ".mp4", ".wav", ".mov", ".avi", ".ogg",
    ".zip", ".tar", ".gz", ".bz2", ".xz", ".7z", ".rar", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
    ".so", ".dylib", ".dll", ".a", ".o", ".class", ".jar", ".pyc", ".pyo", ".exe", ".bin", ".wasm",
    ".onnx", ".safetensors", ".pt", ".pth", ".ckpt", ".h5", ".ttf", ".woff", ".woff2", ".eot", ".lock", ".sum",
)
MAX_BYTES, SNIFF_BYTES = 10 << 20, 512
CHUNK_BYTES, CARRY_BYTES, MAX_CHUNKS = 1 << 20, 4 << 10, 200


@dataclass(frozen=True)
class FileFilter:
    """Which files are read. only_exts, if given, takes the place of skip_exts."""

    max_bytes: int = MAX_BYTES
    skip_dirs: tuple[str, ...] = SKIP_DIRS
    skip_exts: tuple[str, ...] = SKIP_EXTS
    only_exts: tuple[str, ...] = ()
    skip_paths: tuple[str, ...] = ()
    skip_globs: tuple[str, ...] = ()
    include_globs: tuple[str, ...] = ()

    def exclude(self, raw: str) -> FileFilter:
        """Without what a path, *.ext, glob or bare name stands for."""
        raw = raw.strip()
        if not raw:
            return self
        if raw.startswith(("/", "~/")):
            return replace(self, skip_paths=(*self.skip_paths, normal_path(raw)))
        if ext := _extension(raw):
            return replace(self, skip_exts=(*self.skip_exts, ext))
        if "*" in raw or "?" in raw:
            return replace(self, skip_globs=(*self.skip_globs, raw))
        return replace(self, skip_dirs=(*self.skip_dirs, raw))

    def include(self, raw: str) -> FileFilter:
        """Only what a path, *.ext, glob or bare name stands for, besides others included."""
        raw = raw.strip()
        if not raw:
            return self
        if raw.startswith(("/", "~/")):
            return replace(self, include_globs=(*self.include_globs, f"{normal_path(raw)}/**"))
        if ext := _extension(raw):
            return replace(self, only_exts=(*self.only_exts, ext))
        return replace(self, include_globs=(*self.include_globs, raw if "*" in raw or "?" in raw else f"**/{raw}/**"))

    def condition(self, path: Column, size: Column, roots: tuple[str, ...] = ()) -> Column:
        """On a file's path, without scheme, and bytes. Directory names count from the root on."""
        keep = size.between(1, self.max_bytes)
        below = path
        for root in roots:
            parent = root.rstrip("/").rpartition("/")[0]
            below = F.when(F.startswith(path, F.lit(parent + "/")), F.substring(path, len(parent) + 2, 1 << 30)).otherwise(below)
        if self.skip_dirs:
            dirs = F.split(F.regexp_replace(below, F.lit("/[^/]*$"), F.lit("")), "/")
            keep &= ~(F.contains(below, F.lit("/")) & F.arrays_overlap(dirs, F.array(*map(F.lit, self.skip_dirs))))
        ext = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
        keep &= ext.isin(*self.only_exts) if self.only_exts else ~ext.isin(*self.skip_exts) if self.skip_exts else F.lit(True)
        for p in self.skip_paths:
            keep &= ~((path == p) | F.startswith(path, F.lit(f"{p}/")))
        for g in self.skip_globs:
            # a glob that names a directory takes all below it
            keep &= ~(F.rlike(path, F.lit(f"^{glob_pattern(g)}(?:/.*)?$")))
        if self.include_globs:
            some = F.lit(False)
            for g in self.include_globs:
                some |= F.rlike(path, F.lit(f"^{glob_pattern(g)}$"))
            keep &= some
        return keep


def _extension(raw: str) -> str:
    return "." + raw[2:].lower() if raw.startswith("*.") and not re.search(r"[*?/]", raw[2:]) else ""


def normal_path(raw: str) -> str:
    return os.path.abspath(os.path.expanduser(raw.strip()))


def parse_exts(csv: str) -> tuple[str, ...]:
    """py,.ENV as .py and .env."""
    names = [e.strip().lower() for e in csv.split(",")]
    return tuple(e if e.startswith(".") else "." + e for e in names if e)


def glob_pattern(glob: str) -> str:
    """A glob with * and ? inside a name and ** over names, {a,b} and [ab], as a regular expression."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out.append("(?:[^/]*/)*")
            i += 3
            continue
        if glob.startswith("/**", i) and i + 3 == len(glob):
            out.append("(?:/.*)?")
            i += 3
            continue
        if glob.startswith("**", i):
            out.append(".*" if i + 2 == len(glob) and i == 0 else "[^/]*")
            i += 2
            continue
        if c == "[" and "]" in glob[i:]:
            j = glob.index("]", i + 2)
            out.append("[" + glob[i + 1 : j].replace("!", "^", 1 if glob[i + 1] == "!" else 0) + "]")
            i = j + 1
            continue
        out.append({"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")", ",": "|" if "{" in glob[:i] and "}" in glob[i:] else ","}.get(c, re.escape(c)))
        i += 1
    return "".join(out)


def looks_binary(content: Column) -> Column:
    """On the first bytes: a NUL, no valid UTF-8, or more than 30 % control characters. Empty is text."""
    head = F.substring(content, 1, SNIFF_BYTES)
    text = head.cast("string")
    control = F.regexp_count(text, F.lit(r"[\x00-\x08\x0B\x0E-\x1F\x7F]"))
    valid = F.is_valid_utf8(text)
    return F.when(F.octet_length(head) == 0, F.lit(False)).otherwise(F.when(~valid, F.lit(True)).otherwise(F.contains(text, F.lit("\0")) | (control / F.octet_length(head) > 0.3)))


def read_files(spark: SparkSession, roots: list[str], files: FileFilter | None = None) -> DataFrame:
    """(path, length, text) of the text files below roots. Size, path and extension are tested before content is read."""
    files = files or FileFilter()
    roots = [normal_path(r) if "://" not in r else r for r in roots]
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(roots)
    path = F.regexp_replace("path", F.lit("^[a-z]+:/*(?=/)"), F.lit(""))
    df = df.where(F.col("length").between(1, files.max_bytes)).where(files.condition(path, F.col("length"), tuple(roots)))
    df = df.where(~looks_binary(F.col("content")))
    return df.select(path.alias("path"), "length", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def chunks(df: DataFrame, key: str, content: str, chunk: int = CHUNK_BYTES, carry: int = CARRY_BYTES, most: int = MAX_CHUNKS) -> DataFrame:
    """(key, chunk_no, chunk_start, content): content's bytes in chunks, each with the last of the one before.

    At most `most` chunks are read; what lies beyond is left out."""
    data = F.col(content).cast("binary")
    n = F.ceil(F.octet_length(data) / chunk).cast("int")
    numbered = df.where(F.octet_length(data) > 0).select(key, data.alias("data"), F.explode(F.sequence(F.lit(0), F.least(n, F.lit(most)) - 1)).alias("chunk_no"))
    begin = F.greatest(F.col("chunk_no") * chunk - carry, F.lit(0))
    part = F.substring(F.col("data"), begin + 1, (F.col("chunk_no") + 1) * chunk - begin)
    return numbered.select(key, "chunk_no", begin.alias("chunk_start"), part.alias("content"))
