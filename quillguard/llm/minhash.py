"""Near-duplicate documents by one-permutation MinHash with optimal densification.

Every document gets one signature from a single hash of each shingle: the hash's high bits choose a
bin, and the bin keeps its smallest hash. Empty bins borrow from a bin that a fixed random order
gives (optimal densification), alike for all documents. Groups of neighbouring bins make banded
buckets. A bucket proposes a star: its centre with each other member, so the candidates grow with
the members and not with their square. Candidates are confirmed on full shingle sets. Buckets whose
members are then still in several components get further stars: each member is compared by its
signature, a byte for each bin, with some centres of its bucket, and its closest partner is confirmed
in the same way. These stages are linear in the members. Only of a bucket that is still in several
components after that, the members of different components are all compared by their signatures, in
blocks of bounded size; so a link that the stars have missed is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .scratch import Scratch
from .text import U, Words, lower, mix, pieces, raw, whole_hash, windows_hash
from .tokens import forget


#: The most bands.
BANDS = 64


@dataclass(frozen=True)
class NearDup:
    """shingle words make a shingle; texts are linked with 100 * intersection >= percent * union.
    bands of rows bins each: at a similarity of 0.8 a pair shares no bucket with a probability of
    (1 - 0.8 ** rows) ** bands, 1e-5 as set here. Pairs that a star hasn't joined are confirmed if
    their signatures agree in a share of close or more of the bins, three standard deviations below
    0.8; blocks of a bucket hold about block members, and its second star has about centres of them."""

    shingle: int = 4
    percent: int = 80
    bands: int = 48
    rows: int = 7
    close: float = 0.73
    block: int = 1024
    centres: int = 32

    @property
    def bins(self) -> int:
        return self.bands * self.rows


@lru_cache(2)
def _donors(bins: int) -> np.ndarray:
    """For each bin, the place of each other bin in its own random order."""
    rng = np.random.Generator(np.random.PCG64(7))
    return np.argsort(rng.random((bins, bins)), axis=1).astype(np.uint16)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """The distinct shingles of a text's word hashes, sorted; of fewer than k words, the whole as one."""
    return np.unique(windows_hash(words, k) if len(words) >= k else whole_hash(words))


def signature(found: np.ndarray, p: NearDup) -> np.ndarray:
    """The densified signature of a non-empty sorted set of hashes."""
    at = ((found >> U(32)) * U(p.bins)) >> U(32)
    first = np.ones(len(at), bool)
    first[1:] = at[1:] != at[:-1]
    full = at[first].astype(np.int64)
    out = np.empty(p.bins, U)
    out[full] = found[first]
    if len(full) < p.bins:
        empty = np.ones(p.bins, bool)
        empty[full] = False
        empty = np.flatnonzero(empty)
        out[empty] = out[full[_donors(p.bins)[empty[:, None], full[None, :]].argmin(axis=1)]]
    return out


def buckets(sig: np.ndarray, p: NearDup) -> np.ndarray:
    """A 64-bit key of each band; the low bits are the band's number."""
    rows = sig.reshape(p.bands, p.rows)
    band = np.arange(p.bands, dtype=U)
    out = band + U(1)
    for j in range(p.rows):
        out = mix(out + rows[:, j])
    return out & ~U(BANDS - 1) | band


def _signatures(p: NearDup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in pieces(batches):
            data, offsets = raw(batch.column(1))
            w = Words(lower(data), offsets)
            hashes = w.hashes()
            n, h1, h2 = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            keys, sigs, ends = [], [None] * batch.num_rows, np.zeros(batch.num_rows + 1, np.int32)
            for i in range(batch.num_rows):
                found = shingles(hashes[w.bounds[i] : w.bounds[i + 1]], p.shingle)
                if len(found):
                    n[i] = len(found)
                    h1[i] = found.sum(dtype=U).astype(np.int64)
                    h2[i] = mix(found ^ U(0xA5A5A5A5A5A5A5A5)).sum(dtype=U).astype(np.int64)
                    sig = signature(found, p)
                    sigs[i] = mix(sig).astype(np.uint8).tobytes()
                    keys.append(buckets(sig, p).astype(np.int64))
                ends[i + 1] = len(keys) * p.bands
            keys = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(h1), pa.array(h2), pa.array(sigs, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), keys)], ["id", "t", "n", "h1", "h2", "sig", "bands"])

    return run


def _similar(p: NearDup):
    """Of (a, b, ta, tb), the pairs (a, b) whose texts' full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(pieces(batches, 2), 3):
            sets = []
            for k in (2, 3):
                data, offsets = raw(batch.column(k))
                w = Words(lower(data), offsets)
                hashes = w.hashes()
                sets.append([hashes[w.bounds[i] : w.bounds[i + 1]] for i in range(batch.num_rows)])
            good = []
            for i, (x, y) in enumerate(zip(*sets, strict=True)):
                x, y = shingles(x, p.shingle), shingles(y, p.shingle)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if len(x) and 100 * both >= p.percent * (len(x) + len(y) - both):
                    good.append(i)
            yield batch.select([0, 1]).take(pa.array(good, pa.int64()))

    return run


def _close(p: NearDup, best: bool):
    """Of (block, band, node, label, part, sig, keys) sorted by block, pairs (a, b) of different labels with close signatures.

    With best, a block has some members of a bucket and its centres, of part 1, and each row's closest centre is told.
    Else it has the members of one part of a bucket, or of two parts, whose own pairs are tested elsewhere. A pair is told in the first band whose bucket the two share, by the buckets' own keys: bytes of a
    signature may agree where the keys differ. keys has a 64-bit key for each band."""

    def pairs(band, node, label, part, sig, keys) -> list[tuple[int, int]]:
        out, two, centres = [], part.min() != part.max(), np.flatnonzero(part == 1)
        for i in range(len(node)):
            if best:
                rest = centres[label[centres] != label[i]]
            else:
                rest = np.flatnonzero((label[i + 1 :] != label[i]) & ((part[i + 1 :] != part[i]) if two else True)) + i + 1
            if len(rest):
                same = np.count_nonzero(sig[rest] == sig[i], axis=1)
                good = rest[same >= p.close * p.bins]
                if len(good) and band:
                    earlier = (keys[good, :band] == keys[i, :band]).any(axis=1)
                    good = good[~earlier]
                if best and len(good) > 1:
                    good = good[[np.count_nonzero(sig[good] == sig[i], axis=1).argmax()]]
                out += [(min(node[i], x), max(node[i], x)) for x in node[good]]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, found = [], []

        def closed(tables):
            t = pa.concat_tables(tables).combine_chunks()
            block, band, node, label, part = (t.column(k).to_numpy() for k in range(5))
            sig = np.frombuffer(b"".join(t.column(5).to_pylist()), np.uint8).reshape(-1, p.bins)
            keys = t.column(6).combine_chunks().flatten().to_numpy().reshape(-1, p.bands)
            at = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1), len(block)]
            for x, y in zip(at, at[1:], strict=False):
                if y - x > 1:
                    found.extend(pairs(int(band[x]), node[x:y], label[x:y], part[x:y], sig[x:y], keys[x:y]))

        def out():
            done = pa.RecordBatch.from_pylist([{"a": int(x), "b": int(y)} for x, y in found], pa.schema([("a", pa.int64()), ("b", pa.int64())]))
            found.clear()
            return done

        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column(0).to_numpy()
            last = int(np.searchsorted(block, block[-1])) if block[0] != block[-1] else 0
            if last:
                closed([*kept, pa.Table.from_batches([batch.slice(0, last)])])
                kept = []
            kept.append(pa.Table.from_batches([batch.slice(last)]))
            yield out()
        if kept:
            closed(kept)
        yield out()

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: NearDup = NearDup()) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for each row of docs; other columns are not read.

    component_id is the smallest id that links reach, kept tells whether that is the row's own.
    A null text counts as empty; texts without words have no shingles and no links. Rows with a
    null id take part in no link and are kept, with a null component_id. Equal rows are all
    returned, with the same values. Where one id carries several texts, each of them has its own links
    and its own component; the id alone links nothing. An empty table gives none.
    """
    p = params
    spark = docs.sparkSession
    s = Scratch(spark, "minhash")
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("t"))
    sig = s.save(texts.mapInArrow(_signatures(p), "id long, t long, n long, h1 long, h2 long, sig binary, bands array<long>"), "signatures")
    # a node is a set; the row of its smallest id stands for all that have it
    first = F.min(F.struct("id", "t")).alias("first")
    groups = sig.where("n > 0 and id is not null").groupBy("h1", "h2").agg(first).select("h1", "h2", "first.*")
    groups = s.save(groups.withColumn("node", F.monotonically_increasing_id()), "groups")
    # one way at every size: rows are shuffled once by the keys of the join, and equal ones are dropped there
    same = ["id", "t", "h1", "h2"]
    own = sig.where("n > 0").join(groups.hint("merge"), same).dropDuplicates(same)
    own = s.save(own.select("node", "id", "t", "sig", "bands"), "own")
    sig = s.save(sig.select("id", "n", "h1", "h2"), "sets")
    s.drop("signatures")
    rows = s.save(own.select("node", F.explode("bands").alias("key")), "rows")
    full = s.save(rows.groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("last")).where("centre < last"), "full")
    stars = s.save(rows.join(full.select("key", "centre"), "key"), "stars")
    s.drop("rows", "full")
    wanted = s.save(own.select("node", "id", "t").join(stars.select("node").distinct(), "node"), "wanted")
    cand = texts.join(wanted.hint("merge"), ["id", "t"]).dropDuplicates(["id", "t"])
    cand = s.save(cand.select("node", "text"), "texts")

    def confirmed(pairs: DataFrame, k: str) -> DataFrame:
        """The pairs (a, b) whose full sets are similar."""
        first = s.save(pairs.join(cand.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b"), f"half-{k}")
        both = first.join(cand.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")
        out = s.save(both.mapInArrow(_similar(p), "a long, b long"), f"links-{k}")
        s.drop(f"half-{k}")
        return out

    pairs = s.save(stars.where("node > centre").groupBy("node").agg(F.min("centre").alias("a")).select("a", F.col("node").alias("b")), "pairs")
    links = confirmed(pairs, "star")
    labels = components(links, s, "star")
    sigs = own.select("node", "sig", "bands")
    # first each member's closest centre, which joins most of what the star has left apart, then all close pairs of the rest
    for k, best in (("best", True), ("rest", False)):
        marked = s.save(stars.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")), f"marked-{k}")
        open_keys = marked.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).where("low < high")
        open_keys = s.save(open_keys.select("key", "n", F.ceil(F.col("n") / p.block).cast("int").alias("m")), f"open-{k}")
        part = F.pmod(F.xxhash64("node"), "m").cast("int")
        blocks, every = marked.join(open_keys, "key").withColumn("part", part), F.sequence(F.lit(0), F.col("m") - 1)
        if best:  # members go to the block of their part, centres to all blocks of the bucket
            centre = F.pmod(F.xxhash64("node", "key"), F.greatest(F.floor(F.col("n") / p.centres), F.lit(1))) == 0
            blocks = blocks.withColumn("other", F.explode(F.when(centre, every).otherwise(F.array("part")))).withColumn("part", centre.cast("int"))
            block = F.xxhash64("key", "other").alias("block")
        else:
            blocks = blocks.withColumn("other", F.explode(every))
            block = F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("block")
        blocks = s.save(blocks.select("node", "label", "part", F.col("key").bitwiseAND(BANDS - 1).cast("int").alias("band"), block), f"blocks-{k}")
        blocks = blocks.join(sigs.join(blocks.select("node").distinct(), "node", "left_semi"), "node")
        blocks = blocks.repartition("block").sortWithinPartitions("block").select("block", "band", "node", "label", "part", "sig", "bands")
        close = blocks.mapInArrow(_close(p, best), "a long, b long").distinct()
        close = s.save(close.join(pairs, ["a", "b"], "left_anti"), f"close-{k}")
        s.drop(f"marked-{k}", f"open-{k}", f"blocks-{k}")
        links, pairs = links.union(confirmed(close, k)), pairs.union(close)
        labels = components(links, s, k)
    linked = s.save(groups.join(labels, "node").select("h1", "h2", "id", "label"), "linked")
    least = s.save(linked.groupBy("label").agg(F.min("id").alias("least")), "least")
    by_set = s.save(linked.join(least, "label").select("h1", "h2", "least"), "least_by_set")
    by_set = s.save(groups.join(by_set, ["h1", "h2"], "left").select("h1", "h2", F.coalesce("least", "id").alias("label")), "by_set")
    out = sig.join(by_set, ["h1", "h2"], "left")
    linked = F.when(F.col("id").isNull() | (F.col("n") == 0), F.col("id")).otherwise(F.coalesce("label", "id"))
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), linked.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
