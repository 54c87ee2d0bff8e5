"""WARC archives of pages, and a globally ordered capture index by external merge.

Archives are WARC/1.1 files, gzip-compressed, written by Spark's text writer: a record is a line and
the two line breaks that end every record are the line end, so any store that Spark writes to will
do and a record is all that is in memory at once. They are read by the text reader with the same line
end; pieces of a record that has such breaks inside are put together by its Content-Length.

The index has an entry for each record, by URL key (SURT), time and page. Each task that reads an
archive sorts and numbers its entries in a run; the runs are dealt by range of keys, and a task merges its
parts of all runs with a loser tree, each in the order of its numbers, however its pieces arrive. The
output, part after part, is the whole capture history in order; an entry's place in it is its place in
its part plus the entries of all parts before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

END = "\r\n\r\n"
#: Payloads of fewer bytes are never revisits. The time of the capture of page 0.
LEAST_BYTES, EPOCH = 100, datetime(2024, 1, 1, tzinfo=UTC)
#: Entries of a merged part of the index.
PART_ROWS = 200_000
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """A SURT: the host's parts from the last on, then port, path and query, in lower case, without scheme,
    user, www and fragment."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return (url or "").lower()
    if not host:
        return (url or "").lower()
    host = host.removeprefix("www.")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + (parts.path or "/").lower()
    return key + (f"?{'&'.join(sorted(parts.query.lower().split('&')))}" if parts.query else "")


def capture_time(page_id: int | None) -> datetime:
    return EPOCH + timedelta(seconds=(page_id or 0) % (1 << 32))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A record without the two line breaks at its end. A revisit holds the response's headers and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='!#$&()*+,/:;=?@[]~%' + chr(39))}")
    head += [f"WARC-Date: {capture_time(page_id):%Y-%m-%dT%H:%M:%SZ}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END.encode() + block


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            rows = batch.slice(k, 64).to_pylist()
            out = [record(r["id"], r["url"], (r["html"] or "").encode(), r["digest"], r["first"], r["first"] is not None and r["first"] != r["id"]) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


def write_archives(pages: DataFrame, out: str, s: Scratch, id_col: str, url_col: str, html_col: str) -> None:
    """Write a record for each row; of equal payloads the smallest id is the response.

    The first ids of payloads that recur are found by aggregation, and joined to the pages by digest."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    large = rows.where((F.octet_length("html") >= LEAST_BYTES) & F.col("id").isNotNull()).groupBy("digest")
    firsts = s.save(large.agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("digest", "first"), "firsts")
    rows = rows.join(firsts, "digest", "left")
    lines = rows.select("id", "url", "html", "digest", "first").mapInArrow(_records, "value binary")
    lines.select(F.col("value").cast("string").alias("value")).write.option("lineSep", END).option("compression", "gzip").text(out)


def parsed(stream: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record; stream is an archive's bytes, cut at every END."""
    sep, held = END.encode(), bytearray()

    def filled(n: int) -> None:
        while len(held) < n:
            piece = next(stream, None)
            if piece is None:
                raise ValueError("an archive ends inside a record")
            held.extend(piece + sep)

    while True:
        while held.startswith(b"\r\n"):  # after the last record of a file whose block ends with line breaks
            del held[:2]
        if not held:
            piece = next(stream, None)
            if piece is None:
                return
            held.extend(piece + sep)
            continue
        end = held.find(sep)
        lines = held[:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        begin, need = end + len(sep), int(head["content-length"])
        filled(begin + need + len(sep))
        block = bytes(held[begin : begin + need])
        if held[begin + need : begin + need + len(sep)] != sep:
            raise ValueError("a record does not end where it says")
        del held[: begin + need + len(sep)]
        yield head, block


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A run of index entries, sorted, from the pieces of whole archives."""

    def stream():
        for batch in batches:
            yield from (x.as_py() or b"" for x in batch.column(0))

    run, rows = TaskContext.get().partitionId(), []
    for head, block in parsed(stream()):
        http, _, payload = block.partition(END.encode())
        size = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
        digest = head["warc-payload-digest"].removeprefix("sha256:")
        kind = head["warc-type"]
        if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError(f"payload of {head['warc-record-id']} is damaged")
        page = head["warc-record-id"][len("<urn:page:") : -1]
        first = head.get("warc-refers-to", "")[len("<urn:page:") : -1]
        rows.append((url_key(head.get("warc-target-uri")), head["warc-date"], int(page) if page else None, size, digest, kind, int(first) if first else None))
    rows.sort(key=order_key)
    names = ["url_key", "captured", "id", "size", "digest", "kind", "first"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for k in range(0, len(rows), 10_000):
        part = rows[k : k + 10_000]
        columns = [pa.array([r[i] for r in part], t) for i, t in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([run] * len(part), pa.int32()), pa.array(range(k, k + len(part)), pa.int64())], [*names, "run", "nth"])


def order_key(row: tuple) -> tuple:
    """URL key, time, page; no page first."""
    return row[0], row[1], row[2] is not None, row[2] or 0


class LoserTree:
    """Merges k sorted lists: every inner node keeps the loser of a match, the root the winner of all."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.at = [0] * self.k
        self.head = [key(r[0]) if r else None for r in runs]
        self.losers = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self._play(leaf)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return y is None or x is not None and (x, a) < (y, b)

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node:
            if self.losers[node] < 0:  # the first to come waits for its match
                self.losers[node] = winner
                return
            if self._beats(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while self.k and self.head[winner := self.losers[0]] is not None:
            run = self.runs[winner]
            yield run[self.at[winner]]
            self.at[winner] += 1
            self.head[winner] = self.key(run[self.at[winner]]) if self.at[winner] < len(run) else None
            self._play(winner)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One part of the index in order, numbered, from the parts of sorted runs, whose pieces may come in any order."""
    runs: dict[int, list] = {}
    schema = None
    for batch in batches:
        schema = schema or pa.schema(list(batch.schema)[:-2])
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns, strict=True):
            runs.setdefault(row[-2], []).append(row)
    for run in runs.values():
        run.sort(key=lambda row: row[-1])
    out: list[tuple] = []
    part, n = TaskContext.get().partitionId(), 0

    def done():
        columns = [pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([part] * len(out), pa.int32()), pa.array(range(n - len(out), n), pa.int64())], [*schema.names, "part", "place"])

    for row in LoserTree([runs[k] for k in sorted(runs)], order_key):
        out.append(row)
        n += 1
        if len(out) == 10_000:
            yield done()
            out = []
    if out:
        yield done()


SCHEMA = "url_key string, captured string, id long, size long, digest string, kind string, first long"


def read_archives(spark, path: str, s: Scratch) -> DataFrame:
    """The capture index of the archives in path, in order of URL key, time and page (SCHEMA), and each entry's position in it."""
    text = spark.read.option("lineSep", END).text(path).select(F.col("value").cast("binary"))
    runs = s.save(text.mapInArrow(_entries, f"{SCHEMA}, run int, nth long"), "runs")
    parts = max(1, -(-runs.count() // PART_ROWS))
    merged = s.save(runs.repartitionByRange(parts, "url_key", "captured", "id").mapInArrow(_merged, f"{SCHEMA}, part int, place long"), "merged")
    # a row for each part of PART_ROWS entries
    sizes = merged.groupBy("part").agg(F.count("*").alias("n"))
    bases = s.save(sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base")), "bases")
    return merged.join(bases, "part").withColumn("position", F.col("base") + F.col("place")).drop("part", "place", "base")


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, payload_bytes, payload_digest, record_type, refers_to, url_key, captured, position) of each row of
    pages, read back from archives that are written in the shared folder; position is the place in the index's order.

    Payloads are whole texts in UTF-8, null as empty. Rows with a null id, or of the response's own id,
    are responses. Repeated rows each have a record. A null url has the empty key. The time of a
    capture is EPOCH and as many seconds as its id. An empty table gives none."""
    s = Scratch(pages.sparkSession, "warc")
    write_archives(pages, s.path("archives"), s, id_col, url_col, html_col)
    index = read_archives(pages.sparkSession, s.path("archives"), s)
    return index.select(F.col("id").alias(id_col), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("first").alias("refers_to"), "url_key", "captured", "position")
