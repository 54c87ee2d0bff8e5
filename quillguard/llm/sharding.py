"""Shards by extendible hashing, in DataFrame operations only.

A document's hash is the first 60 bits of the MD5 of its id. The directory is indexed by a prefix of
the hash; it starts as one bucket, and only a bucket above the byte limit splits on one more bit. As
a bucket's bytes depend only on its prefix, the end of that process is found from the bytes of each
prefix at a fine depth: a document's bucket is the shortest of its prefixes that fits the limit.
Prefixes still too large at that depth are cut finer in the same way, level by level. A hash value
that alone is too large, as equal ids have, gets overflow pages instead of more bits.

The directory has a slot for each value of the global depth's bits; a bucket of depth d is what the
2 ** (global depth - d) slots from its prefix on point to, so a bucket's row stands for all of them.
All steps are aggregations and sort-merge joins: nothing that grows with the input is broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Bits of the hash, those that one level looks at, and the bytes of a shard.
BITS, STEP, LIMIT = 60, 12, 1 << 20


def hash_of(key: Column) -> Column:
    """60 bits, as a long; a null key as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def prefix(h: Column, depth: int) -> Column:
    return F.shiftright(h, BITS - depth)


def directory(cells: DataFrame, low: int, high: int, limit: int, s: Scratch, name: str) -> DataFrame:
    """(cell, depth, bytes): for each prefix at depth high of cells (cell, bytes), the depth of its
    bucket, from low on, and the bucket's bytes; no row where even the cell is above the limit."""
    depths = F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")
    each = cells.select("cell", "bytes", depths).withColumn("up", F.expr(f"shiftright(cell, {high} - depth)"))
    fits = s.save(each.groupBy("depth", "up").agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") <= limit), name)
    found = each.drop("bytes").join(fits.hint("merge"), ["depth", "up"]).groupBy("cell").agg(F.min(F.struct("depth", "bytes")).alias("b"))
    return found.select("cell", "b.depth", "b.bytes")


def shards(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, depth, prefix, page, shard_bytes, global_depth, slots) for each row of docs; other columns are not read.

    A shard is a (depth, prefix, page). Its bytes are at most limit, but where one document alone has
    more; that one has a page of its own. page is 0 but for overflow pages, which hold rows of one
    hash in the order of their bytes. slots of the directory of global_depth bits point to the bucket.
    A null text has no bytes; a null id hashes as the empty text. Repeated rows are each placed. An
    empty table gives none."""
    return _placed(docs.select(id_col, text_col), limit, id_col, text_col, Scratch(docs.sparkSession, "shards"), False).withColumnRenamed("id", id_col)


def buckets(placed: DataFrame) -> DataFrame:
    """The directory of shards(): a row for each bucket and page, with its first slot, slots, documents and bytes."""
    by = placed.groupBy("depth", "prefix", "page", "global_depth", "slots").agg(F.count("*").alias("documents"), F.sum("n_bytes").alias("shard_bytes"))
    return by.withColumn("first_slot", F.col("prefix") * F.col("slots"))


def write_shards(docs: DataFrame, out: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> None:
    """All columns of docs, a folder shard=depth-prefix-page for each shard, as Parquet; read_shards() reads them back."""
    placed = _placed(docs, limit, id_col, text_col, Scratch(docs.sparkSession, "shards"), True)
    name = F.concat_ws("-", "depth", "prefix", "page")
    placed.select("row", name.alias("shard")).repartition("shard").write.partitionBy("shard").parquet(out)


def read_shards(spark, path: str) -> DataFrame:
    """The rows that write_shards() has written, without their places."""
    return spark.read.parquet(path).select("row.*")


def _placed(docs: DataFrame, limit: int, id_col: str, text_col: str, s: Scratch, whole: bool) -> DataFrame:
    """The columns of shards(), the id as id, and with whole each row of docs as the struct row."""
    size = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long")
    more = ["row"] if whole else []
    row = [F.struct("*").alias("row")] if whole else []
    rows = s.save(docs.select(F.col(id_col).alias("id"), hash_of(F.col(id_col)).alias("h"), size.alias("n_bytes"), *row), "rows")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    low, deepest = 0, 0
    high = min(BITS, STEP // 3 + max(0, math.ceil(math.log2(max(1, total) / limit))))
    open_rows, done, k = rows, [], 0
    while True:
        cells = s.save(open_rows.groupBy(prefix(F.col("h"), high).alias("cell")).agg(F.sum("n_bytes").alias("bytes")), f"cells-{k}")
        found = s.save(directory(cells, low, high, limit, s, f"fits-{k}"), f"directory-{k}")
        deepest = max(deepest, found.agg(F.max("depth")).first()[0] or 0)
        placed = open_rows.withColumn("cell", prefix(F.col("h"), high)).join(found.hint("merge"), "cell", "left")
        fits = placed.where("depth is not null")
        done.append(fits.select("id", "h", "n_bytes", "depth", F.lit(0).cast("long").alias("page"), F.col("bytes").alias("shard_bytes"), *more))
        rest = s.save(placed.where("depth is null").select("id", "h", "n_bytes", *more), f"rest-{k}")
        if high >= BITS or rest.isEmpty():
            break
        open_rows, low, high, k = rest, high + 1, min(BITS, high + STEP), k + 1
    if not rest.isEmpty():
        done.append(_pages(rest, limit, s, more))
        deepest = BITS
    out = done[0]
    for df in done[1:]:
        out = out.union(df)
    slots = F.expr(f"shiftleft(1L, {deepest} - depth)").alias("slots")
    return out.select("id", "n_bytes", F.col("depth").cast("int").alias("depth"), F.expr(f"shiftright(h, {BITS} - depth)").alias("prefix"), "page", "shard_bytes", F.lit(deepest).alias("global_depth"), slots, *more)


def _pages(rest: DataFrame, limit: int, s: Scratch, more: list[str]) -> DataFrame:
    """Overflow pages of hashes that are too large alone.

    Rows of one hash and size are alike, so pages are planned from (hash, size, count): each size
    fills pages of its own, limit // size rows each. The rows of a hash and size are numbered
    within groups of a random thousandth and by the counts of the groups before."""
    each = F.greatest(F.floor(F.lit(limit) / F.greatest("n_bytes", F.lit(1))), F.lit(1))
    salted = s.save(rest.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1000))), "salted")
    counts = s.save(salted.groupBy("h", "n_bytes", "salt").agg(F.count("*").alias("n")), "salt_counts")
    before = Window.partitionBy("h", "n_bytes").orderBy("salt")
    bases = counts.select("h", "n_bytes", "salt", (F.sum("n").over(before) - F.col("n")).alias("base"))
    sizes = counts.groupBy("h", "n_bytes").agg(F.sum("n").alias("n")).withColumn("pages", F.ceil(F.col("n") / each))
    first = sizes.select("h", "n_bytes", F.col("n").alias("of_size"), (F.sum("pages").over(Window.partitionBy("h").orderBy("n_bytes")) - F.col("pages")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("h", "n_bytes", "salt").orderBy(F.lit(1))) - 1
    ranked = salted.withColumn("rank", rank).join(s.save(bases, "salt_bases"), ["h", "n_bytes", "salt"]).join(s.save(first, "first_pages"), ["h", "n_bytes"])
    at = F.col("base") + F.col("rank")
    page = F.floor(at / each)
    held = F.least(each, F.col("of_size") - page * each) * F.col("n_bytes")
    return ranked.select("id", "h", "n_bytes", F.lit(BITS).alias("depth"), (F.col("first") + page).cast("long").alias("page"), held.cast("long").alias("shard_bytes"), *more)
