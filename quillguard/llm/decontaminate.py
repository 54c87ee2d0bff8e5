"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

Every item of a benchmark gives windows of words. The index holds the postings (text, position,
term) of the rarest terms of each window in the training texts; a window's lists, each shifted by
its term's place in the window, are intersected, and what is left is compared in full. The index is
keyed by a text's digest, so copies of a text are indexed and searched once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: What stands between words, in Java's syntax; letters A-Z are lower-cased afterwards.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a window, and how many of its terms are in the index.
WINDOW, ANCHORS = 13, 2
#: Tables of terms of at most so many rows and bytes are broadcast, larger ones shuffled.
SMALL, SMALL_BYTES = 200_000, 8 << 20


def words(text: Column) -> Column:
    """The words of a text in their case; none for null."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), SEPARATORS, -1), "")


def folded(word: Column) -> Column:
    """A-Z lower-cased, other letters as they are."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def _fits(df: DataFrame, text: Column) -> bool:
    """Whether a table of terms, text being all there is in a row, is small enough to broadcast, by its rows and bytes."""
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    return rows <= SMALL and size <= SMALL_BYTES


def _small(df: DataFrame, text: Column) -> DataFrame:
    return F.broadcast(df) if _fits(df, text) else df.hint("merge")


def windows(items: DataFrame, s: Scratch, size: int, item_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(wid, terms) of the distinct windows, and (wid, item) of the items that have them.

    An item of fewer words than size is one window, one without words has none."""
    n = F.size("w")
    lists = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), F.transform(words(F.col(text_col)), folded).alias("w")).where(n > 0)
    at = F.explode(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))))
    each = lists.select("item", "w", at.alias("at")).select("item", F.slice("w", F.col("at") + 1, size).alias("terms")).distinct()
    each = s.save(each, "each")
    found = s.save(each.select("terms").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")
    return found, s.save(each.join(found, "terms").select("wid", "item").distinct(), "window_items")


class Index:
    """Postings of the rarest terms of windows in docs. Null texts have no words."""

    def __init__(self, docs: DataFrame, found: DataFrame, s: Scratch, anchors: int, text_col: str):
        self.s, self.found = s, found
        self.docs = docs.select(F.col(text_col).cast("string").alias("text"))
        placed = found.select("wid", F.posexplode("terms").alias("place", "term"))
        terms = placed.select("term").distinct()
        tokens = self.docs.select(F.explode(words(F.col("text"))).alias("word")).select(folded(F.col("word")).alias("term"))
        terms = s.save(terms, "terms")
        count = F.count("*").alias("n")
        if _fits(terms, F.col("term")):
            counts = tokens.join(F.broadcast(terms), "term").groupBy("term").agg(count)
        else:  # words are counted where they are read, so that a frequent one is a row a task and not one a place
            counts = tokens.groupBy("term").agg(count).join(terms.hint("merge"), "term").select("term", "n")
        counts = s.save(counts, "counts")
        ranked = placed.join(counts, "term", "left").select("wid", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place", "term").alias("t"))
        rare = ranked.groupBy("wid").agg(F.array_sort(F.collect_list("t")).alias("t"))
        rare = rare.where(F.col("t")[0]["n"] > 0).select("wid", F.explode(F.slice("t", 1, anchors)).alias("t"))  # a window whose term is nowhere is nowhere
        self.rare = s.save(rare.select("wid", "t.place", "t.term"), "rare")
        keys = _small(s.save(self.rare.select("term").distinct(), "anchor_terms"), F.col("term"))
        texts = self.docs.select(digest(F.col("text")).alias("text_key"), words(F.col("text")).alias("w"))
        postings = texts.select("text_key", F.posexplode("w").alias("pos", "word")).select("text_key", "pos", folded(F.col("word")).alias("term"))
        self.postings = s.save(postings.join(keys, "term").distinct(), "postings")

    def candidates(self, slop: int = 0) -> DataFrame:
        """(text_key, wid, start): where all of a window's indexed terms are in place, give or take slop words."""
        need = self.rare.groupBy("wid").agg(F.count("*").alias("need"))
        shifted = self.postings.join(self.rare, "term").select("text_key", "wid", "place", (F.col("pos") - F.col("place")).alias("start"))
        if slop:
            around = F.sequence(F.col("start") - slop, F.col("start") + slop)
            shifted = shifted.select("text_key", "wid", "place", F.explode(around).alias("start")).distinct()
        else:
            shifted = shifted.where("start >= 0")
        met = shifted.groupBy("text_key", "wid", "start").agg(F.count("*").alias("n"))
        return met.join(need, "wid").where("n = need").select("text_key", "wid", "start")

    def confirmed(self, slop: int = 0) -> DataFrame:
        """(text_key, wid, start, length) of the candidates that hold in full."""
        cand = self.s.save(self.candidates(slop), f"candidates-{slop}")
        keys = self.s.save(cand.select("text_key").distinct(), f"candidate_keys-{slop}")
        texts = self.docs.select(digest(F.col("text")).alias("text_key"), "text").join(keys, "text_key", "left_semi")
        tokens = texts.dropDuplicates(["text_key"]).select("text_key", F.posexplode(words(F.col("text"))).alias("pos", "word"))
        tokens = tokens.select("text_key", "pos", folded(F.col("word")).alias("term"))
        need = cand.join(_small(self.found, F.concat_ws(" ", "terms")), "wid").select("text_key", "wid", "start", F.size("terms").alias("length"), F.posexplode("terms").alias("place", "term"))
        spot = F.col("start") + F.col("place")
        if slop:
            need = need.withColumn("pos", F.explode(F.sequence(spot - slop, spot + slop)))
        else:
            need = need.withColumn("pos", spot)
        met = need.join(tokens, ["text_key", "pos", "term"]).select("text_key", "wid", "start", "length", "place")
        met = met.distinct() if slop else met
        return met.groupBy("text_key", "wid", "start", "length").agg(F.count("*").alias("n")).where("n = length").drop("n")


def matches(docs: DataFrame, items: DataFrame, size: int = WINDOW, slop: int = 0, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(text_key, item, start, length): exact phrase matches of items' windows in texts; text_key is digest() of the text.

    With slop, proximity matches: every term at most slop words from its place, where start is
    among those within slop of a fitting one."""
    s = Scratch(docs.sparkSession, "matches")
    found, of = windows(items, s, size, item_col, text_col)
    return Index(docs, found, s, ANCHORS, text_col).confirmed(slop).join(of, "wid").select("text_key", "item", "start", "length")


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """All columns of docs with their names as q_0, q_1, ..., and n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit inside any occurrence of an item's window. n_items counts distinct ids of items with
    an occurring window, items_sha256 is of those ids as sorted strings, joined with commas. A document
    is contaminated if a twentieth of its words or more are hit. Null texts, and texts without words,
    have no words and are clean; items without an id are left out. Repeated rows are all returned,
    with equal values. Empty items leave every document clean; an empty table gives none."""
    s = Scratch(docs.sparkSession, "decontaminate")
    found, of = windows(items, s, size, item_col, text_col)
    hits = s.save(Index(docs, found, s, ANCHORS, text_col).confirmed(), "hits")
    spots = hits.select("text_key", "start", "length").distinct()
    spots = spots.select("text_key", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("pos")).distinct()
    named = hits.select("text_key", "wid").distinct().join(of, "wid").select("text_key", F.col("item").cast("string").alias("item")).distinct()
    per_text = spots.groupBy("text_key").agg(F.count("*").alias("n_hit"))
    ids = F.concat_ws(",", F.array_sort(F.collect_list("item")))
    per_item = named.groupBy("text_key").agg(F.count("*").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"))
    per_text = s.save(per_text.join(per_item, "text_key"), "per_text")
    wide = docs.select(*[F.col(c).alias(f"q_{i}") for i, c in enumerate(docs.columns)], digest(F.col(text_col)).alias("text_key"), F.size(words(F.col(text_col))).cast("long").alias("n_words"))
    out = wide.join(per_text.hint("merge"), "text_key", "left").drop("text_key")
    zero = F.lit(0).cast("long")
    out = out.withColumns({"n_hit": F.coalesce("n_hit", zero), "n_items": F.coalesce("n_items", zero), "items_sha256": F.coalesce("items_sha256", F.sha2(F.lit(""), 256))})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """id_col, n_words, n_hit, n_items, items_sha256 and contaminated of decontaminate(); other columns are not read."""
    slim = docs.select(F.col(id_col), F.col(text_col))
    out = decontaminate(slim, items, size, id_col, text_col, item_col).drop("q_1")
    return out.select(F.col("q_0").alias(id_col), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def clean(docs: DataFrame, items: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of docs that are not contaminated, all columns."""
    out = decontaminate(docs, items, size, id_col, text_col, item_col).where(~F.col("contaminated"))
    return out.select(*[F.col(f"q_{i}").alias(c) for i, c in enumerate(docs.columns)])
