"""The prefix trie against one that is built turn by turn."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from threadspark.llm import prefixes
from threadspark.llm import queries as registered

CONVERSATIONS = "conv_id long, turn long, role string, text string, depth int, x long, rep string"


def plain_trie(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [t[2:] for t in sorted(turns)] for c, turns in by.items()}
    whole = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(said.get(c - c % 20, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, turns in sorted(whole.items()):
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = []
    for node, convs in members.items():
        below, leaves, saved = [node], 0, 0
        while below:
            at = below.pop()
            below += children[at]
            leaves += not children[at]
            if at:
                saved += (len(members[at]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", at[-1][1]))
        ends = ",".join(str(c) for c in convs if whole[c] == node)
        parent = min(members[node[:-1]]) if node else None
        out.append((convs[0], len(node), parent, len(convs), len(children[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def some_rows(seed, convs, longest):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(0, 3 * convs), convs):
        n = rng.choice([1, 1, 2, 3, 4, 6, longest])
        turns = [(c, t, rng.choice(["user", "user", None, ""]), rng.choice(["a b", "a b", "", None, "c\td e", "é x"])) for t in range(n)]
        if rng.random() < 0.3:
            turns[rng.randrange(n)] = (c, None, "system", "s s s")
        rows += turns
    rows += [(c, t, "user", f"w {t % 3}") for c in (400, 401, 402, 417) for t in range(30)]  # equal and longer than most
    rows += [(401, 30, "user", "last")]
    return rows


def as_table(spark, rows):
    return spark.createDataFrame([(*r, 7, 8, "r") for r in rows], CONVERSATIONS).repartition(3)


@pytest.mark.parametrize("chunk", [4096, 4])
def test_prefix_trie(spark, chunk, monkeypatch):
    monkeypatch.setattr(prefixes, "CHUNK", chunk)  # small chunks: every conversation is carried on
    rows = some_rows(chunk, 120, 12) + [(None, 1, "user", "lost")]
    got = prefixes.prefix_trie(as_table(spark, rows))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_trie(rows)


def test_conversations_left_without_turns(spark):
    """Ids whose own turns all give way to those of an absent or shorter conversation end at the root or early."""
    takes_three = [c for c in range(200) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20][:4]
    rows = [(c, 0, "user", "own") for c in takes_three]
    assert any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in plain_trie(rows))
    assert sorted(map(tuple, prefixes.prefix_trie(as_table(spark, rows)).collect()), key=repr) == plain_trie(rows)


def test_repeated_rows_long_texts_and_empty_tables(spark):
    rows = [(0, 1, "user", "a a"), (0, 1, "user", "a a"), (40, 1, "user", "a a"), (40, 2, "user", "a a"), (60, 1, "u", "w " * 50_000)]
    assert sorted(map(tuple, prefixes.prefix_trie(as_table(spark, rows)).collect()), key=repr) == plain_trie(rows)
    assert prefixes.prefix_trie(as_table(spark, rows).filter("false")).collect() == []
    assert prefixes.prefix_trie(as_table(spark, rows).withColumn("conv_id", F.lit(None).cast("long"))).collect() == []


def test_query_reads_the_table(spark, tmp_path):
    rows = some_rows(5, 40, 5)
    as_table(spark, rows).select("conv_id", "turn", "role", "text").write.parquet(str(tmp_path / "conversations.parquet"))
    assert sorted(map(tuple, registered.op12_prefix_trie(spark, str(tmp_path)).collect()), key=repr) == plain_trie(rows)
