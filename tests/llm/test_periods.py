"""Runs of words against a plain search of all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import DOCS, table_of
from threadspark.llm import periods
from threadspark.llm import queries as registered


def plain_runs(words, least=12):
    """Every period in turn: maximal stretches of words that equal those one period later."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                if not any(a <= i and a + m >= j + q and q % r == 0 for a, m, r in out):
                    out.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def odd_texts(seed, count):
    rng = random.Random(seed)
    out = []
    for _ in range(count):
        kinds, n = rng.choice([1, 2, 2, 3, 5, 60]), rng.choice([0, 1, 11, 12, 13, 30, 60, 150, 400])
        words = [b"w%d" % rng.randrange(kinds) for _ in range(n)]
        if n and rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + rng.randrange((n - a) // 2 + 1)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        out.append(words)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_of_odd_texts(seed):
    texts = odd_texts(seed, 150)
    assert periods.runs_of(texts) == [plain_runs(t) for t in texts]
    assert [r for t in texts[:20] for r in periods.runs_of([t])] == [plain_runs(t) for t in texts[:20]]


def test_long_and_self_similar_texts(monkeypatch):
    a, b = [b"a"], [b"b"]
    while len(a) < 600:
        a, b = a + b, a  # the Fibonacci word, full of runs
    thue = [b"%d" % (bin(i).count("1") % 2) for i in range(600)]
    for text in (a, thue):
        assert periods.runs_of([text])[0] == plain_runs(text)
    assert periods.runs_of([[b"x"] * 50_000]) == [[(0, 50_000, 1)]]
    block = [b"w%d" % i for i in range(9_000)]
    assert periods.runs_of([[b"y", *block, *block, *block[:17], b"z"]]) == [[(1, 18_017, 9_000)]]
    monkeypatch.setattr(periods, "AT_ONCE", 1)  # a block at a time
    assert periods.runs_of([a])[0] == plain_runs(a)


def test_sums_that_are_zero_modulo_the_prime_only(monkeypatch):
    """With codes that are all alike every block seems to occur everywhere; words still decide."""
    monkeypatch.setattr(periods, "_mix", lambda x: x * np.uint64(0))
    texts = odd_texts(3, 40)
    assert periods.runs_of(texts) == [plain_runs(t) for t in texts]


@pytest.mark.parametrize("n", [4, 16, 64, 512])
def test_transform(n):
    t = periods.Transform(n)
    x = np.random.default_rng(1).integers(0, t.prime, (n, 3)).astype(np.uint64)
    root = int(t.powers[1])
    want = [[sum(int(x[i, c]) * pow(root, i * f, t.prime) for i in range(n)) % t.prime for c in range(3)] for f in range(n)]
    assert t.full(x.copy()).tolist() == want
    x[n // 4 :] = 0
    assert t.quarter(x[: n // 4]).tolist() == t.full(x).tolist()
    assert pow(root, n, t.prime) == 1 and pow(root, n // 2, t.prime) != 1


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for a, m, q in runs for i in range(a + q, a + m)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None, None, None)
    lines = "".join(f"{a},{m},{q}\n" for a, m, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    milli = 1000 * best[1] // best[2] if runs else None
    return doc_id, len(runs), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def test_periodic_runs_query(spark, tmp_path):
    rng = random.Random(9)
    texts = [b" ".join(t).decode() for t in odd_texts(4, 120)]
    texts += [None, "", " \t\r\n", "    a", "é " * 30, "a b\u000bc\u000c" * 20, "\x1c " * 13 + "\x85", texts[5], " ".join(["x"] * 3000)]
    texts += [" ".join(rng.choice("abc") for _ in range(700))]
    rows = list(enumerate(texts))
    table_of(spark, rows).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = registered.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect())) == [plain_row(i, t) for i, t in rows]


def test_null_and_repeated_ids_and_empty_tables(spark):
    docs = table_of(spark, [(None, "a " * 20), (3, "a " * 20), (3, "a " * 20), (3, None)])
    got = sorted(map(tuple, periods.run_digests(periods.periodic_runs(docs)).select("doc_id", "n_runs", "start", "length", "period").collect()), key=repr)
    assert got == [(3, 0, None, None, None), (3, 1, 0, 20, 1), (3, 1, 0, 20, 1), (None, 1, 0, 20, 1)]
    clash = docs.select("doc_id", "text", F.lit(1).alias("runs"), F.lit(2).alias("collapsed"), F.lit(3).alias("n_words"), F.lit(4).alias("best"))
    assert periods.periodic_runs(clash).count() == 4
    assert periods.run_digests(periods.periodic_runs(spark.createDataFrame([], DOCS))).collect() == []
