"""The pipeline's stages on odd tables, and the whole pipeline against a plain version."""

import random
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.test_operators import edited, prose, vocabulary
from threadspark.llm import common, decontaminate, exact, ngrams, sentences, toxicity, urls
from threadspark.llm import queries as registered

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: names that the operators use for columns of their own
CLASHES = [
    "_id", "_sha", "_low", "_gone", "_bad_id", "_bad_mark", "_row", "_text", "row", "key", "mark", "part", "kept", "n", "sha", "gone_doc_id", "gone_part",
    "score", "words", "label", "rep", "gid", "component_id", "n_shingles", "ids", "contaminated", "plain", "flags", "features", "raw", "curve",
]


def corpus(rng, words):
    base = prose(rng, words, 120)
    texts = [None, "", " ", "Word", "word", base, base.upper(), base + " end", edited(rng, words, base, 1), edited(rng, words, base, 2)]
    texts += [prose(rng, words, rng.randint(1, 90)) for _ in range(60)] + [prose(rng, words, 8_000)]
    texts += [texts[20], texts[20], "vile you scum " * 12, "you vile scum " * 9]
    return texts


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(12)
    words = vocabulary(rng)
    texts = corpus(rng, words)
    passage = prose(rng, words, 20)
    texts += [prose(rng, words, 40) + " " + passage + " x", prose(rng, words, 900) + " " + passage]
    rows = list(enumerate(texts))
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, t, "xx", "s", len(t or "")) for i, t in rows], COLUMNS).repartition(3).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(1, passage), (2, prose(rng, words, 30))], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    labels = [(i, 0, int("scum" in (t or ""))) for i, t in rows]
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(str(folder / "labels.parquet"))
    return str(folder), rows, [(1, passage)]


def test_whole_pipeline(spark, made, monkeypatch):
    """Scores are taken as given; all that follows is compared row by row."""
    folder, rows, items = made
    scores = {i: (0.9 if "scum" in (t or "") else 0.1) for i, t in rows}

    def given(docs, labels, limit=0.7):
        known = spark.createDataFrame(list(scores.items()), "doc_id long, given double")
        return docs.join(known, "doc_id").filter(F.col("given") < limit).select(docs.columns)

    monkeypatch.setattr(toxicity, "drop_toxic", given)
    got = sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()))
    left = [(i, t) for i, t in rows if scores[i] < 0.7]
    kept = {i: v[0] for i, v in brute.exact(left).items()}
    left = [(i, t) for i, t in left if kept[i] == i]
    tops = brute.ngram_components(left, 5, 80)
    left = [(i, t) for i, t in left if tops[i][1] == i]
    bad = {r[0] for r in brute.contamination(left, items) if r[5]}
    left = [(i, t) for i, t in left if i not in bad]
    assert bad and len(left) < len(rows) - 10
    sp = sentences.processor(registered.PIECES)
    want = []
    for i, t in left:
        ids = sp.encode(t or "")
        want.append((i, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(sp.decode(ids))))
    assert got == sorted(want)


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_with_clashing_names_nulls_and_repeated_rows(spark, made, name):
    folder, rows, _ = made
    docs = registered.table(spark, folder, "documents").filter("doc_id < 30")
    docs = docs.union(docs.filter("doc_id in (0, 5, 20)")).union(docs.filter("doc_id = 21").withColumn("doc_id", F.lit(None).cast("long")))
    wide = docs.select("*", *[F.lit(1).alias(c) for c in CLASHES])
    stage = dict(corpus_pipeline.STAGES)[name]
    plain, clashing = stage(spark, docs, folder), stage(spark, wide, folder)
    if name != corpus_pipeline.STAGES[-1][0]:
        assert plain.columns == docs.columns and clashing.columns == wide.columns
    key = plain.columns[:2]
    assert sorted(map(tuple, clashing.select(key).collect()), key=repr) == sorted(map(tuple, plain.select(key).collect()), key=repr)
    assert plain.filter("doc_id is null").count() <= 1
    empty = stage(spark, docs.filter("doc_id < 0"), folder)
    assert empty.collect() == []


def test_exact_dedup_keeps_one_of_repeated_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "A b"), (1, "a b"), (3, "a B"), (3, "a B"), (None, "a b"), (None, None), (4, None), (4, None)], "doc_id long, text string")
    for few in (1_000_000, 0):
        monkeypatch.setattr(common, "BROADCAST_KEYS", few)  # broadcast, and by a merge join
        got = sorted(((r.doc_id, r.text) for r in exact.drop_copies(docs, keep="largest").collect()), key=repr)
        assert got == [(3, "a B"), (4, None)]
        assert ngrams.drop_near_copies(docs.filter("text is not null")).filter("doc_id is not null").select("doc_id").distinct().collect() == [(1,)]


def test_urls_with_line_feeds(spark):
    some = ["http://a\nb.net/x", "http://a.net\n/x", "http://b\nexample.net/en/x", "http://b.example.net/en/\nx", "http://x.org/\nfr/", "http://casino\n.de/", "http://a.net"]
    pages = spark.createDataFrame(list(enumerate(some)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(pages, urls.RULES + urls.OWN_RULES).collect()}
    own = "*casino*"
    assert [got[k] for k in range(len(some))] == [
        ("net/", "block"), (None, "allow"), ("net/", "block"), ("example.net/en/", "allow"), (None, "allow"), (own, "block"), (None, "allow"),
    ]


def test_signatures_are_shuffled_once(spark, made):
    """Both sides of the join of groups read one exchange by signature."""
    folder, _, _ = made
    plans = []
    stored = ngrams.stored

    def seen(df, name, *by):
        if name == "groups":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, name, *by)

    ngrams.stored = seen
    try:
        ngrams.ngram_components(registered.table(spark, folder, "documents")).count()
    finally:
        ngrams.stored = stored
    assert len(plans) == 1
    lines = [re.sub(r"#\d+L?|plan_id=\d+|^[\s:+-]*", "", x) for x in plans[0].splitlines()]
    shuffled = [k for k, x in enumerate(lines) if "REPARTITION_BY_COL" in x]
    assert len(shuffled) == 2 and lines[shuffled[0] : shuffled[0] + 6] == lines[shuffled[1] : shuffled[1] + 6]
