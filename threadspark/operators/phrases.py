"""Many phrases at once: which texts hold which of a table of phrases.

A short phrase of ASCII words is looked up whole: it stands in a text exactly if it is one of the text's runs of as many words. Any other phrase is
filed under its rarest word; the distinct words of a text look those phrases up, and only those found run their pattern on it. So
the work grows with the texts and their hits, and hardly with the number of phrases.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadspark.functions.text import word_edges
from threadspark.session import cut_lineage

#: Phrases, or words of phrases, that are broadcast to the texts; more of them meet the words of the texts by a shuffle.
BROADCAST_ROWS = 100_000
#: Words of the phrases that are looked up whole; longer ones run their pattern.
MOST_WORDS = 3
#: Filed phrases up to which a text keeps only their words before they are dealt to rows beside the text.
FEW_PHRASES = 1000

# One word, and a phrase of ASCII words with single spaces between them.
WORD = r"[\p{L}\p{N}]"
PLAIN = r"^[A-Za-z0-9]+( [A-Za-z0-9]+){0,%d}$" % (MOST_WORDS - 1)


def _put(text: Column, *pairs: str) -> Column:
    """The second letter of each pair in place of the first. A search per letter is quicker than ``translate`` on long texts."""
    for one, other in pairs:
        text = F.replace(text, F.lit(one), F.lit(other))
    return text


def folded(text: Column) -> Column:
    """One spelling for all that match in any case. Some more may share it; the pattern tells them apart.

    Each letter is spelled by itself, whatever stands beside it: a final sigma like any other, and the iota below, no letter itself but with a
    capital that is one, as a blank. So a whole text is folded at once. The optimizer takes a case change of a case change for one, which
    letters such as the sharp s are not; hence the steps between.
    """
    small = _put(F.lower(_put(text, "\u0130i", "\u0345 ")), "\u03c2\u03c3")
    return _put(F.lower(_put(F.upper(small), "\u0130I")), "\u03c2\u03c3")


def _spelled(text: Column) -> Column:
    """A text in small letters; just those letters that a pattern takes for one of A-Z, in any case, become a letter of a-z."""
    return _put(F.lower(_put(text, "\u0130i")), "\u0131i", "\u017fs")


def runs_of(text: Column, words: int) -> Column:
    """The distinct runs of as many words of a text with single spaces between them, none cut off within a word; a null text has none.

    For runs of several words, an empty text may stand among them.
    """
    run = rf"{WORD}++" + rf" {WORD}++" * (words - 1)
    # a run is looked at, and its first word passed, so that runs may overlap; a word that begins none is passed, too
    pattern = rf"({run})" if words == 1 else rf"(?=({run})){WORD}++|{WORD}++"
    return F.array_distinct(F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.array().cast("array<string>")))


def words_of(text: Column) -> Column:
    """The distinct folded words of a text: runs of letters and digits; a null text has none."""
    return runs_of(folded(text), 1)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def phrase_index(phrases: DataFrame, texts: DataFrame, column: str) -> DataFrame:
    """``phrases`` (phrase_id, phrase) with ``word``, the one of its words that the fewest texts have; empty for a phrase without words.

    Null and empty phrases are left out. The result is written: it is the size of ``phrases``.
    """
    given = phrases.select("phrase_id", "phrase").filter("phrase <> ''").withColumn("_words", words_of(F.col("phrase")))
    each = cut_lineage(given.select("phrase_id", F.explode("_words").alias("word")))
    count = each.count()
    wanted = each.select("word").distinct()
    some = texts if count else texts.limit(0)
    met = some.select(F.explode(words_of(F.col(column))).alias("word")).join(_small(wanted, count), "word", "left_semi")
    counts = met.groupBy("word").agg(F.count(F.lit(1)).alias("_texts"))
    counted = each.join(counts, "word", "left")
    best = counted.groupBy("phrase_id").agg(F.min(F.struct(F.coalesce("_texts", F.lit(0)), "word")).alias("_best"))
    filed = given.drop("_words").join(best, "phrase_id", "left")
    return cut_lineage(filed.select("phrase_id", "phrase", F.coalesce("_best.word", F.lit("")).alias("word")))


def phrase_hits(texts: DataFrame, keys: Sequence[str], column: str, phrases: DataFrame) -> DataFrame:
    """``keys`` of a text and ``phrase_id`` of each phrase that the text holds as whole words, in any case: the rows of ``has_word`` per phrase.

    ``keys`` identify a text, and ``phrase_id`` a phrase. Null texts, and null or empty phrases, hold and give nothing.
    """
    some = texts.select(*keys, F.col(column).alias("_text")).filter("_text is not null")
    given = cut_lineage(phrases.select("phrase_id", "phrase").filter("phrase <> ''"))
    plain = F.col("phrase").rlike(PLAIN)
    whole = given.filter(plain).select("phrase_id", _spelled(F.col("phrase")).alias("run"), F.size(F.split("phrase", " ")).alias("words"))
    # as many rows as a phrase may have words
    counts = {r["words"]: r["count"] for r in whole.groupBy("words").count().collect()}
    found = _filed_hits(some, keys, given.filter(~plain))
    if counts:
        runs = F.flatten(F.array(*[runs_of(F.col("_spelled"), n) for n in sorted(counts)]))
        spelled = some.select(*keys, _spelled(F.col("_text")).alias("_spelled"))
        met = spelled.select(*keys, F.explode(runs).alias("run")).join(_small(whole.drop("words"), sum(counts.values())), "run")
        found = found.unionByName(met.select(*keys, "phrase_id"))
    return found


def _filed_hits(some: DataFrame, keys: Sequence[str], phrases: DataFrame) -> DataFrame:
    """``phrase_hits`` of texts in ``_text`` by the index of words."""
    index = phrase_index(phrases, some, "_text")
    rows = index.count()
    # a phrase without words is tried on every text
    words = F.concat(words_of(F.col("_text")), F.array(F.lit("")))
    holds = F.regexp_like("_text", word_edges(F.col("phrase")))
    if rows <= BROADCAST_ROWS:
        # a text that holds a phrase holds its letters, which is found sooner
        some = some.withColumn("_folded", folded(F.col("_text")))
        words = F.concat(runs_of(F.col("_folded"), 1), F.array(F.lit("")))
        holds = F.contains("_folded", "_small") & holds
        index = index.withColumn("_small", folded(F.col("phrase")))
        if rows <= FEW_PHRASES:
            # one row
            some = some.crossJoin(F.broadcast(index.agg(F.collect_set("word").alias("_wanted"))))
            words = F.array_intersect(words, "_wanted")
        met = some.withColumn("word", F.explode(words)).join(F.broadcast(index), "word")
        return met.filter(holds).select(*keys, "phrase_id")
    # keys and words are shuffled, not texts beside each of their words
    met = some.select(*keys, F.explode(words).alias("word")).join(index, "word").select(*keys, "phrase_id", "phrase")
    return some.join(met, list(keys)).filter(holds).select(*keys, "phrase_id")
