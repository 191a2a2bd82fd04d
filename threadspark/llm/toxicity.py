"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The features are Column expressions: densities of a built-in and of a learned lexicon, second-person proximity, capitals,
punctuation and obfuscation rates. The learned lexicon comes from all labelled training rows: words, and beginnings of words,
that toxic texts have far more often than clean ones. Trees and calibration are fitted on a bounded sample of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadspark.llm.common import stored

#: Labelled rows that the trees and the calibration are fitted on, at most; the lexicon uses them all.
FIT_ROWS = 20_000
#: Entries of the learned lexicon at most; what scoring needs of it is sent to all tasks.
LEXICON_SIZE = 600
#: Toxic training texts that must have an entry, and the least ratio of its toxic to its clean rate.
LEXICON_TEXTS, LEXICON_RATIO = 3, 6.0
PREFIXES = (4, 5)

INSULTS = (
    "idiot", "idiots", "moron", "morons", "stupid", "dumb", "scum", "trash", "loser", "losers", "pathetic", "worthless", "disgusting",
    "clown", "clowns", "ugly", "fool", "filth", "garbage", "bastard", "imbecile", "dummkopf", "abschaum", "trottel", "connard",
    "ordure", "imbécile", "idiota", "estúpido", "basura", "escoria",
)
YOU = ("you", "your", "youre", "u", "ur", "du", "dich", "dein", "dir", "tu", "te", "toi", "ton", "vous", "tú", "usted", "vosotros")
#: Characters that stand for letters.
LEET_FROM, LEET_TO = "013457@$!", "oieastasi"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}@$!*]+"), "")


def _entries(words: Column) -> Column:
    """Words with letters for look-alikes, and their beginnings, marked by their length."""
    plain = F.transform(words, lambda w: F.translate(w, LEET_FROM + "*", LEET_TO))
    some = [plain]
    for n in PREFIXES:
        long = F.filter(plain, lambda w, n=n: F.char_length(w) > n)
        some.append(F.transform(long, lambda w, n=n: F.concat(F.substring(w, 1, n), F.lit("*"))))
    return F.array_distinct(F.concat(*some))


def learn_lexicon(labelled: DataFrame, text_col: str, label_col: str) -> list[str]:
    """Entries over-represented in toxic texts, at most ``LEXICON_SIZE``, from rows (text, label 0 or 1)."""
    n = labelled.agg(F.sum(label_col).alias("bad"), F.count(F.lit(1)).alias("n")).first()
    bad, good = n["bad"] or 0, n["n"] - (n["bad"] or 0)
    if not bad or not good:
        return []
    seen = labelled.select(F.col(label_col).alias("y"), F.explode(_entries(words_of(F.col(text_col)))).alias("entry"))
    rates = seen.groupBy("entry").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good")).filter(F.col("bad") >= LEXICON_TEXTS)
    ratio = (F.col("bad") / bad) / ((F.col("good") + 0.5) / good)
    chosen = rates.filter(ratio >= LEXICON_RATIO).orderBy(F.desc("bad"), F.desc(ratio), "entry").limit(LEXICON_SIZE)
    return sorted(r["entry"] for r in chosen.select("entry").collect())


def features(text: Column, lexicon: list[str]) -> dict[str, Column]:
    """Name -> number for each feature; ``text`` isn't null. Rates are per character or per word of the text."""
    words = words_of(text)
    plain = F.transform(words, lambda w: F.translate(w, LEET_FROM + "*", LEET_TO))
    hot = set(lexicon) | set(INSULTS)
    whole = sorted(x for x in hot if not x.endswith("*"))
    stems = {n: sorted(x[:-1] for x in hot if x.endswith("*") and len(x) == n + 1) for n in PREFIXES}

    def toxic(w: Column) -> Column:
        yes = w.isin(whole)
        for n, some in stems.items():
            if some:
                yes = yes | ((F.char_length(w) > n) & F.substring(w, 1, n).isin(some))
        return yes

    return {"words": words, "plain": plain, "flags": F.transform("plain", toxic)}


FEATURES = (
    "hits", "hit_rate", "distinct_hits", "insults", "insult_rate", "you_rate", "near_you", "capitals", "shouted", "exclaims",
    "punctuation", "stretched", "obfuscated", "length",
)


def with_features(docs: DataFrame, text_col: str, lexicon: list[str], keep: list[str]) -> DataFrame:
    """``keep`` and the columns of ``FEATURES`` for each row; null texts count as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(*keep, text.alias("_t"))
    made = features(F.col("_t"), lexicon)
    base = base.withColumn("words", made["words"]).withColumn("plain", made["plain"]).withColumn("flags", made["flags"])
    n, chars = F.greatest(F.size("plain"), F.lit(1)), F.greatest(F.char_length("_t"), F.lit(1))
    hits = F.size(F.filter("flags", lambda x: x))
    insults = F.size(F.filter("plain", lambda w: w.isin(*INSULTS)))
    you = F.size(F.filter("plain", lambda w: w.isin(*YOU)))
    at = F.filter(F.transform("flags", lambda f, i: F.when(f, i)), lambda i: i.isNotNull())
    near = F.size(F.filter(at, lambda i: F.arrays_overlap(F.slice("plain", F.greatest(i - 3, F.lit(0)) + 1, F.lit(7)), F.array(*map(F.lit, YOU)))))
    count = lambda pattern: F.regexp_count("_t", F.lit(pattern))
    columns = {
        "hits": F.log1p(hits), "hit_rate": hits / n,
        "distinct_hits": F.size(F.array_distinct(F.transform(at, lambda i: F.get("plain", i)))),
        "insults": F.log1p(insults), "insult_rate": insults / n, "you_rate": you / n, "near_you": near,
        "capitals": count(r"\p{Lu}") / chars, "shouted": count(r"\b\p{Lu}{3,}\b") / n, "exclaims": count("!") / n,
        "punctuation": count(r"\p{P}") / chars, "stretched": count(r"(\p{L})\1\1") / n,
        "obfuscated": count(r"\p{L}[0-9@$*!]+\p{L}") / n, "length": F.log1p(F.size("plain")),
    }
    return base.select(*keep, *(columns[c].cast("double").alias(c) for c in FEATURES))


@dataclass
class Toxicity:
    """A fitted scorer; without usable labels the score is the rate of lexicon words."""

    lexicon: list[str]
    trees: GBTClassificationModel | None = None
    curve: IsotonicRegressionModel | None = None

    def score(self, docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        """``keep`` and score (0 to 1) for each row. A null or empty text is scored like any text without toxic words."""
        rows = with_features(docs, text_col, self.lexicon, list(keep))
        if self.trees is None:
            return rows.select(*keep, F.least(F.lit(1.0), F.col("hit_rate") * 5).alias("score"))
        raw = self.trees.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows.select(*keep, *FEATURES)))
        raw = raw.select(*keep, vector_to_array("probability")[1].alias("raw"))
        if self.curve is None:
            return raw.withColumnRenamed("raw", "score")
        # isotonic steps tie many rows; a small share of the raw score keeps their order
        return self.curve.transform(raw).select(*keep, (0.98 * F.least(F.greatest("curve", F.lit(0.0)), F.lit(1.0)) + 0.02 * F.col("raw")).alias("score"))


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, seed: int = 7, trees: int = 16, depth: int = 3
) -> Toxicity:
    """Learn from the rows of ``labels`` (doc_id, toxic) whose crc32(doc_id) mod 3 isn't 1.

    Remainder 0 fits the trees, remainder 2 the calibration, both fit the lexicon. Rows with a null id or a label other than
    0 and 1 teach nothing. Repeated labels of a document count once when equal and not at all when they differ.
    """
    rest = F.crc32(F.col("doc_id").cast("string")) % 3
    clear = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    clear = clear.filter("doc_id is not null and toxic in (0, 1)").filter(rest != 1)
    clear = clear.groupBy("doc_id").agg(F.min("toxic").alias("label"), F.max("toxic").alias("_most")).filter("label = _most").drop("_most")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # the texts are shuffled once, for the lexicon; a merge join at every size, as the labels grow with the texts
    lexicon = learn_lexicon(texts.join(clear.hint("merge"), "doc_id"), "text", "label")
    # the rows with the smallest digests of their ids are a sample of fixed size, the same on every run; it is picked by ids alone
    by_digest = [F.xxhash64("doc_id", F.lit(seed)), "doc_id"]
    found = clear.join(texts.select("doc_id").hint("merge"), "doc_id", "left_semi")
    picked = stored(found.orderBy(*by_digest).limit(fit_rows).coalesce(1), "picked")
    known = texts.join(F.broadcast(picked), "doc_id").withColumn("side", rest)
    rows = with_features(known, "text", lexicon, ["doc_id", "side", "label"])
    sample = stored(rows.orderBy(*by_digest).limit(fit_rows).coalesce(2), "labelled")
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample)
    fit, tune = vectors.filter("side = 0"), vectors.filter("side = 2")
    if fit.select("label").distinct().count() < 2 or tune.select("label").distinct().count() < 2:
        return Toxicity(lexicon)
    model = GBTClassifier(
        featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, maxBins=64, seed=seed, minInstancesPerNode=3
    ).fit(fit.coalesce(1))
    raw = model.transform(tune).select(F.col("label").cast("double").alias("label"), vector_to_array("probability")[1].alias("raw"))
    curve = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="curve").fit(raw.coalesce(1))
    return Toxicity(lexicon, model, curve)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs``; a null id is not held out."""
    scored = fit_toxicity(docs, labels).score(docs)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, with all their columns.

    Null texts score as empty ones; repeated rows and null ids are judged each. Extra columns may have any names; an empty table stays empty.
    """
    model = fit_toxicity(docs, labels)
    whole = docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text"))
    return model.score(whole, "_text", ("_row",)).filter(F.col("score") < limit).select("_row.*")
