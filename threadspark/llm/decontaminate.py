"""Benchmark decontamination as a prefix-filtered set join, in Column expressions only.

Every item gives windows of its words. A window's shingles are ordered by how rare they are in the corpus; for exact
containment the necessary prefix is one shingle, the rarest. A document's shingles meet that table, and the
shingle's place in the window gives the only start at which the window can lie; a start before the text or
an end after it is discarded (positional and length bound), and the words themselves decide.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from threadspark.llm.common import ascii_lower, rows_without, stored

WINDOW_WORDS = 13
SHINGLE_WORDS = 3
#: Windows that are broadcast at once. More come in blocks of this many, each against all documents.
BLOCK_WINDOWS = 200_000
#: Fixed value: what separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")


def _shingle(words: Column, at: Column, size: Column | int) -> Column:
    """Digest of the ``size`` words from ``at`` (from 0); the words after the end count as null."""
    parts = [F.when(F.lit(k) < size, F.get(words, at + k)) for k in range(SHINGLE_WORDS)]
    return F.xxhash64(F.lit(size) if isinstance(size, int) else size, *parts)


def windows_of(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct windows: win (number), words, and the ids of the items that have them."""
    words = words_of(F.col(text_col).cast("string"))
    listed = items.select(F.col(id_col).cast("long").alias("item_id"), words.alias("w")).filter(F.size("w") > 0)
    last = F.greatest(F.size("w") - window, F.lit(0))
    cut = listed.select("item_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    cut = cut.select("item_id", F.slice("w", F.col("at") + 1, F.lit(window)).alias("words"))
    return cut.distinct()


def _document_shingles(docs: DataFrame, size: int) -> DataFrame:
    """A row per shingle of ``size`` words: doc_id, mark, words, at, token. ``words`` stays a reference in generated code."""
    rows = docs.select("doc_id", "mark", "words").filter(F.size("words") >= size)
    spots = F.sequence(F.lit(0), F.size("words") - size)
    return rows.select("doc_id", "mark", "words", F.explode(spots).alias("at")).withColumn(
        "token", _shingle(F.col("words"), F.col("at"), size)
    )


def find_hits(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW_WORDS, block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, item_ids (sorted as strings), mark.

    A null or empty text has no words and no hits; an item without words is nowhere. Items without an id are found like
    others but not listed among item_ids. Rows of ``docs`` that repeat an id are told apart by ``mark``, a digest of the
    text, and rows that repeat both have the same result each; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), words_of(text).alias("words"))
    owned = windows_of(items, item_id_col, item_text_col, window)
    numbered = stored(
        owned.groupBy("words").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
        .withColumn("win", F.xxhash64("words")), "windows",
    )
    n = numbered.count()
    blocks = max(1, -(-n // block_windows))
    parts = [numbered.filter(F.pmod("win", F.lit(blocks)) == block) if blocks > 1 else numbered for block in range(blocks)]
    hits = reduce(DataFrame.unionByName, [_hits_of(rows, part.select("words")) for part in parts])
    # what a document has: its hit words, and its windows
    hits = stored(hits, "hits")
    key = ["doc_id", "mark"]
    spans = hits.select(*key, "at", "len").distinct()
    ordered = W.partitionBy(*key).orderBy("at", "len").rowsBetween(W.unboundedPreceding, -1)
    reach = F.coalesce(F.max(F.col("at") + F.col("len")).over(ordered), F.lit(0))
    end = F.col("at") + F.col("len")
    n_hit = (
        spans.select(*key, F.greatest(F.lit(0), end - F.greatest("at", reach)).alias("new"))
        .groupBy(*key).agg(F.sum("new").alias("n_hit"))
    )
    found = (
        hits.select(*key, "words").distinct().join(numbered.select("words", "item_ids"), "words")
        .select(*key, F.explode("item_ids").alias("item")).distinct()
        .groupBy(*key).agg(F.sort_array(F.collect_list("item")).alias("item_ids"))
    )
    dirty = n_hit.join(found, (n_hit.doc_id.eqNullSafe(found.doc_id)) & (n_hit.mark == found.mark), "left").select(
        n_hit.doc_id.alias("hit_id"), n_hit.mark.alias("hit_mark"), "n_hit", "item_ids"
    )
    # counting words needs no list of them
    counted = rows.select("doc_id", "mark", F.size("words").cast("long").alias("n_words"))
    return counted.join(dirty, counted.doc_id.eqNullSafe(F.col("hit_id")) & (counted.mark == F.col("hit_mark")), "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), "mark",
    )


def _hits_of(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """Occurrences (doc_id, mark, at, len, words) of a bounded block of windows."""
    size = F.least(F.size("words"), F.lit(SHINGLE_WORDS))
    spots = windows.select("words", size.alias("size"), F.explode(F.sequence(F.lit(0), F.size("words") - size)).alias("at"))
    listed = stored(spots.select("words", "size", "at", _shingle(F.col("words"), F.col("at"), F.col("size")).alias("token")), "spots")
    sizes = [r["size"] for r in listed.select("size").distinct().collect()]  # at most SHINGLE_WORDS numbers
    known = F.broadcast(listed.select("token").distinct())
    if not sizes:
        nothing = rows.filter(F.lit(False))
        return nothing.select("doc_id", "mark", F.lit(0).alias("at"), F.lit(0).alias("len"), "words")
    counts = reduce(DataFrame.union, [
        _document_shingles(rows, k).select("token").join(known, "token", "left_semi").groupBy("token").count() for k in sizes
    ])
    counts = counts.withColumnRenamed("count", "n")
    ranked = listed.join(F.broadcast(counts), "token", "left")
    # a window with a shingle that no document has is in no document
    prefix = ranked.groupBy("words").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "token", "size")).alias("first")
    ).filter("first.n > 0")
    prefix = stored(prefix.select(F.col("words").alias("window"), F.col("first.token").alias("token"), F.col("first.at").alias("offset"), "first.size"), "prefix")
    found = []
    for k in sizes:
        part = F.broadcast(prefix.filter(F.col("size") == k).select("token", "window", "offset"))
        start, length = F.col("at") - F.col("offset"), F.size("window")
        bounds = (start >= 0) & (start + length <= F.size("words"))
        same = F.slice("words", F.when(start >= 0, start + 1).otherwise(F.lit(1)), length) == F.col("window")
        met = _document_shingles(rows, k).join(part, "token").filter(bounds & same)
        found.append(met.select("doc_id", "mark", start.alias("at"), length.alias("len"), F.col("window").alias("words")))
    return reduce(DataFrame.unionByName, found)


def contamination(docs: DataFrame, items: DataFrame, share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, mark: contaminated when a ``share``-th of the words is hit."""
    out = find_hits(docs, items)
    return out.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "mark",
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns.

    Rows without words stay, each row is judged by its own text, and null ids are ids like others. Extra columns may have any names; an
    empty table stays empty, and without items all rows stay.
    """
    bad = contamination(docs, items).filter("contaminated").select("doc_id", "mark").distinct()
    keys = {"doc_id": F.col("doc_id"), "mark": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))}
    return rows_without(docs, keys, stored(bad, "bad"))
