"""SimHash links against a comparison of all pairs."""

import random

import numpy as np
import pytest
import xxhash

from tests.llm import brute
from tests.llm.test_operators import DOCS, edited, prose, table_of, vocabulary
from threadspark.llm import queries as registered
from threadspark.llm import simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [words[i : i + 4] for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    tops = brute.components(range(len(rows)), near)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[tops[k]] = min(least.get(tops[k], i), i)
    return sorted((i, f"{prints[k]:016x}", least[tops[k]]) for k, (i, _) in enumerate(rows))


def random_prints(seed, count, clusters):
    """Fingerprints at random, and dense clusters of them within a few bits of each other."""
    rng = random.Random(seed)
    out = {rng.getrandbits(64) for _ in range(count)} | {0, (1 << 64) - 1, 1 << 63}
    for size in clusters:
        centre = rng.getrandbits(64)
        for _ in range(size):
            x = centre
            for k in rng.sample(range(64), rng.randint(0, 9)):
                x ^= 1 << k
            out.add(x)
    return np.array(sorted(out), np.uint64)


def plain_roots(values, radius=4):
    links = []
    for i in range(len(values)):
        near = np.flatnonzero(np.bitwise_count(values[:i] ^ values[i]) <= radius)
        links += [(i, int(j)) for j in near]
    return brute.components(range(len(values)), links)


@pytest.mark.parametrize("radius", [0, 1, 3, 4])
@pytest.mark.parametrize("leaf", [8, 256])
def test_search_in_a_shard(radius, leaf, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    values = random_prints(radius, 900, [300, 60])
    masks = simhash.bands(radius)
    assert sum(masks) == (1 << 64) - 1
    links = []
    for mask in masks:
        forest = simhash._Forest(len(values))
        simhash.search(values, np.arange(len(values)), np.arange(0), mask, radius // len(masks), radius, True, forest)
        assert len(forest.links) < len(values)
        links += forest.links
    assert all(int(values[a] ^ values[b]).bit_count() <= radius for a, b in links)
    assert brute.components(range(len(values)), links) == plain_roots(values, radius)


def test_a_band_that_is_the_same_everywhere():
    rng = random.Random(4)
    values = np.array(sorted({rng.getrandbits(43) << 21 for _ in range(700)} | {(3 << 40) ^ (1 << rng.randrange(22, 64)) for _ in range(40)}), np.uint64)
    forest = simhash._Forest(len(values))
    simhash.search(values, np.arange(len(values)), np.arange(0), simhash.bands(4)[0], 1, 4, True, forest)
    assert brute.components(range(len(values)), forest.links) == plain_roots(values)


def test_shards_hold_every_near_pair():
    values = random_prints(7, 1500, [200])
    for mask in simhash.bands(4):
        tree = simhash.UpperTree(values[::3], mask, 5, 1)
        index, shard, own = tree.shards(values)
        assert sorted(index[own].tolist()) == list(range(len(values)))
        home = dict(zip(index[own].tolist(), shard[own].tolist(), strict=True))
        seen = set(zip(index.tolist(), shard.tolist(), strict=True))
        for i in range(len(values)):
            for j in np.flatnonzero(np.bitwise_count((values[:i] ^ values[i]) & np.uint64(mask)) <= 1).tolist():
                assert (i, home[j]) in seen or (j, home[i]) in seen


@pytest.mark.parametrize("rows", [1 << 20, 150])
def test_near_links_over_shards_and_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 200)
    monkeypatch.setattr(simhash, "TASK_ROWS", rows)  # the smaller one deals every shard in blocks
    monkeypatch.setattr(simhash, "LEAF", 32)
    values = random_prints(11, 1200, [250, 80])
    signed = values.view(np.int64).tolist()
    points = spark.createDataFrame([(x,) for x in signed], "fingerprint long").repartition(3)
    links = simhash.near_links(points).collect()
    number = {x: k for k, x in enumerate(signed)}
    assert brute.components(range(len(values)), [(number[a], number[b]) for a, b in links]) == plain_roots(values)


def test_simhash_query(spark, tmp_path):
    rng = random.Random(2)
    words = vocabulary(rng)
    base = prose(rng, words, 400)
    texts = [None, "", " \t", "One", "one", "a b c", "A  B\nc", "a b c d", "é É", "\x1ca b"]
    texts += [edited(rng, words, base, k) for k in range(25) for _ in range(3)] + [base, base.upper()]
    texts += [prose(rng, words, rng.randint(1, 80)) for _ in range(60)] + [prose(rng, words, 30_000)]
    rows = list(enumerate(texts))
    table_of(spark, rows).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = registered.op13_simhash(spark, str(tmp_path))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect())) == plain_components(rows)


def test_null_and_repeated_ids_and_empty_tables(spark):
    got = simhash.simhash_components(table_of(spark, [(None, "a b"), (None, None), (5, "a b"), (3, "A b"), (3, "c"), (3, "c"), (9, None)])).collect()
    found = sorted(((r.doc_id, r.component_id) for r in got), key=repr)
    assert found == [(3, 3), (3, 3), (3, 3), (5, 3), (9, 9), (None, None), (None, None)]
    assert simhash.simhash_components(spark.createDataFrame([], DOCS)).collect() == []
