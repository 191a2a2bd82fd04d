"""The phrase index against one pattern per phrase."""

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from threadspark.functions.text import has_word
from threadspark.operators import phrases as ph

PIECES = ["ring", "Ring", "RINGS", "hot", "c++", "(x)", "ßa", "ẞA", "SSa", "İz", "iz", "ız", "Élan", "élan", "x1", "a.b", "–", "ſun", "sun", "K", "K", "ΟΔΟΣ", "οδος"]


def some_phrases(rng):
    fixed = ["ring", "hot ring", "c++", "++", "(x)", "ßa", "ssa", "iz", "İZ", "ÉLAN", "a.b", "sun", "k", "οδοσ", "nowhere ring", "", None, "ring ", "$1", "\\", "a b"]
    return fixed + [" ".join(rng.choices(PIECES, k=rng.randint(1, 3))) for _ in range(60)]


@pytest.mark.parametrize("few", [100_000, 0])
def test_index_equals_patterns(spark, monkeypatch, few):
    monkeypatch.setattr(ph, "BROADCAST_ROWS", few)
    rng = random.Random(few)
    texts = ["", None, "ring", "xring", "ring,hot ring!", "C++", "a$1 b \\ c"] + ["".join(rng.choice(PIECES) + rng.choice([" ", ", ", "", "\n"]) for _ in range(rng.randint(1, 9))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    phrases = list(enumerate(some_phrases(rng)))
    got = ph.phrase_hits(df, ["id"], "body", spark.createDataFrame(phrases, "phrase_id int, phrase string"))
    flags = df.select("id", *[has_word(F.col("body"), [p]).alias(f"p{k}") for k, p in phrases if p]).collect()
    want = sorted(((r["id"], k) for r in flags for k, p in phrases if p and r[f"p{k}"]), key=repr)
    assert rows(got) == want and len(want) > 200


def test_a_phrase_is_filed_under_its_rarest_word(spark):
    df = spark.createDataFrame([(1, "the ring"), (2, "the Ring the"), (3, "the hot")], "id int, body string")
    phrases = spark.createDataFrame([(1, "the ring"), (2, "THE HOT"), (3, "the absent"), (4, "?!")], "phrase_id int, phrase string")
    assert rows(ph.phrase_index(phrases, df, "body").select("phrase_id", "word")) == [(1, "ring"), (2, "hot"), (3, "absent"), (4, "")]


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "ring")], "id int, body string")
    phrases = spark.createDataFrame([(1, "ring")], "phrase_id int, phrase string")
    assert ph.phrase_hits(df.limit(0), ["id"], "body", phrases).count() == 0
    assert ph.phrase_hits(df, ["id"], "body", phrases.limit(0)).count() == 0


def test_plan_does_not_grow_with_the_phrases(spark):
    df = spark.createDataFrame([(1, "ring")], "id int, body string")

    def size(count):
        many = spark.range(count).select(F.col("id").alias("phrase_id"), F.concat(F.lit("w"), "id").alias("phrase"))
        return len(ph.phrase_hits(df, ["id"], "body", many)._jdf.queryExecution().optimizedPlan().toString())

    assert abs(size(5) - size(5000)) < 200


def test_phrases_of_ascii_words_run_no_pattern(spark, monkeypatch):
    monkeypatch.setattr(ph, "word_edges", lambda phrase: F.lit("nothing holds this"))
    df = spark.createDataFrame([(1, "a Hot, ring"), (2, "HOT \u0130ce R\u0131ng"), (3, "shot ring"), (4, "hot  ring"), (5, "hot ring hot \u212aey")], "id int, body string")
    given = [(1, "hot"), (2, "Hot ring"), (3, "ice ring"), (4, "HOT key"), (5, "hot ice ring"), (6, "hot ring hot key")]
    got = ph.phrase_hits(df, ["id"], "body", spark.createDataFrame(given[:5], "phrase_id int, phrase string"))
    assert rows(got) == [(1, 1), (2, 1), (2, 3), (2, 5), (4, 1), (5, 1), (5, 2), (5, 4)]
    monkeypatch.undo()
    longer = ph.phrase_hits(df, ["id"], "body", spark.createDataFrame(given[5:], "phrase_id int, phrase string"))
    assert rows(longer) == [(5, 6)]
