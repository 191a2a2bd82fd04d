"""SimHash near-dedup: fingerprints that differ in a few bits, found exactly through vantage-point trees.

Two fingerprints that differ in ``radius`` bits at most differ in one bit at most in one of ``radius // 2 + 1`` bands of bits. On whole
fingerprints the trees would hardly prune: distances of unrelated ones crowd around half the bits, and a ball of four
covers most of them. On a band a ball of one bit is small. So there is one tree per band: a node splits by the band's Hamming distance to a
vantage point, and by the triangle inequality a fingerprint can only have partners across the split if its distance is within the ball of the border.

The upper levels of each tree are built from a bounded sample and cut the table into shards. A fingerprint is owned by one shard, and queries each other
shard that its ball overlaps. Inside a shard the tree goes on to its leaves. Choices made from the sample move work, never results.

What leaves a task is a forest of its links. Links are between distinct fingerprints, so copies of a text never meet.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadspark.llm.common import ascii_lowered, batches, rows_of, stored
from threadspark.llm.graphs import components

WORDS = 4
RADIUS = 4
BITS = 64
#: Fixed value: the seed of the shingles' hash.
SEED = 42
#: Fingerprints owned by a shard, about; the trees' upper levels have at most ``LEVELS`` splits in a row.
SHARD, LEVELS = 8192, 12
#: Fingerprints that the upper levels are built from.
SAMPLE = 65_536
#: Rows of a shard that one task searches; larger shards are dealt in blocks, each pair of blocks to a task.
TASK_ROWS = 1 << 20
#: Fingerprints of a leaf.
LEAF = 256


def fingerprint(text: str | None, n: int = WORDS) -> int:
    """The 64 bits set in over half of the hashes of a text's ``n``-word shingles, repeats included; 0 without words."""
    words = ascii_lowered(text).split()
    if not words:
        return 0
    joined = b" ".join(words)
    stops = np.cumsum([len(w) + 1 for w in words])
    starts = np.r_[0, stops[:-1]]
    size = min(n, len(words))
    first, last = starts[: len(words) - size + 1].tolist(), (stops[size - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(first), 1 << 14):
        part = zip(first[at : at + (1 << 14)], last[at : at + (1 << 14)], strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in part], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(first), bitorder="little").tobytes(), "little")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, n: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (as a signed number) of each row of ``docs``."""
    out = "doc_id long, fingerprint long"

    def run(incoming: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(((i, _signed(fingerprint(t, n))) for i, t in rows_of(incoming)), out)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, out)


def bands(radius: int) -> list[int]:
    """Masks of the bands of bits."""
    count = radius // 2 + 1
    cuts = [BITS * k // count for k in range(count + 1)]
    return [((1 << high) - 1) ^ ((1 << low) - 1) for low, high in zip(cuts, cuts[1:], strict=False)]


def _split(own: np.ndarray, mask: np.uint64, reach: int) -> tuple[np.uint64, int] | None:
    """A vantage point and a distance, so that about half of ``own`` are within it; None if the points tried hardly part them."""
    best = None
    for k in range(4):
        point = own[len(own) * k // 4] & mask
        sizes = np.bincount(np.bitwise_count((own ^ point) & mask))
        within = np.cumsum(sizes)
        if len(within) < 2:
            continue
        # inner fingerprints near the border are searched on both sides
        border = within - np.r_[np.zeros(min(reach, len(within)), np.int64), within[: max(0, len(within) - reach)]]
        cost = (np.abs(within - len(own) / 2) + border)[:-1]
        ball = int(cost.argmin())
        if best is None or cost[ball] < best[0]:
            best = cost[ball], point, ball
    return None if best is None or best[0] > 0.45 * len(own) else best[1:]


class UpperTree:
    """The upper levels of a band's tree: vantage points and distances of a full binary tree, children of node k are 2k and 2k + 1."""

    def __init__(self, sample: np.ndarray, mask: int, levels: int, reach: int) -> None:
        self.mask, self.levels, self.reach = np.uint64(mask), levels, reach
        self.points = np.zeros(1 << levels, np.uint64)
        self.balls = np.full(1 << levels, -1, np.int16)  # nothing is within -1: all go to the second child
        parts = {1: sample}
        for node in range(1, 1 << levels):
            mine = parts.pop(node)
            found = _split(mine, self.mask, reach) if len(mine) > 1 else None
            if found:
                self.points[node], self.balls[node] = found
            inside = np.bitwise_count((mine ^ self.points[node]) & self.mask) <= self.balls[node]
            parts[2 * node], parts[2 * node + 1] = mine[inside], mine[~inside]

    def shards(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the value, shard, whether the shard owns it) for the owner of each value and all shards that its ball must query."""
        index, node, own = np.arange(len(values)), np.ones(len(values), np.int64), np.ones(len(values), bool)
        for _ in range(self.levels):
            away = np.bitwise_count((values[index] ^ self.points[node]) & self.mask).astype(np.int16)
            ball = self.balls[node]
            inside = away <= ball
            # of two owners apart the inner one queries the outer one's shard; queries go wherever their ball reaches
            to_inner = inside | (~own & (away - self.reach <= ball) & (ball >= 0))
            to_outer = ~inside | (away + self.reach > ball)
            index, node, own = (
                np.concatenate([index[to_inner], index[to_outer]]), np.concatenate([2 * node[to_inner], 2 * node[to_outer] + 1]),
                np.concatenate([(own & inside)[to_inner], (own & ~inside)[to_outer]]),
            )
        return index, node, own


class _Forest:
    """Links between numbered fingerprints, each kept only if it joins two trees."""

    def __init__(self, n: int) -> None:
        self.top = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def roots(self, of: np.ndarray) -> np.ndarray:
        now = self.top[of]
        while True:
            up = self.top[now]
            if np.array_equal(up, now):
                self.top[of] = now
                return now
            now = up

    def join(self, one: int, others: np.ndarray) -> None:
        roots, first = np.unique(self.roots(others), return_index=True)
        mine = int(self.roots(np.array([one]))[0])
        new = roots != mine
        self.links += [(one, int(x)) for x in others[first[new]]]
        self.top[roots[new]] = mine


def _leaf(values: np.ndarray, own: np.ndarray, rest: np.ndarray, radius: int, among: bool, forest: _Forest) -> None:
    for k, one in enumerate(own.tolist()):
        others = np.concatenate([own[k + 1 :], rest]) if among else rest
        near = others[np.bitwise_count(values[others] ^ values[one]) <= radius]
        if len(near):
            forest.join(one, near)


def _dense_leaf(values: np.ndarray, own: np.ndarray, rest: np.ndarray, radius: int, forest: _Forest) -> None:
    """Links of many fingerprints that the band can't part, without comparing what is joined already.

    Centres are taken until each owned fingerprint is within the radius of one. A partner of a member is within twice
    the radius of the centre.
    """
    everything = np.concatenate([own, rest])
    free = np.ones(len(own), bool)
    while free.any():
        centre = int(own[free.argmax()])
        away = np.bitwise_count(values[everything] ^ values[centre])
        forest.join(centre, everything[away <= radius])
        mine = free & (away[: len(own)] <= radius)
        free &= ~mine
        around = everything[(away > radius) & (away <= 2 * radius)]
        members = own[mine]
        for one in members.tolist():
            around = around[forest.roots(around) != forest.roots(np.array([centre]))[0]]
            if not len(around):
                break
            near = around[np.bitwise_count(values[around] ^ values[one]) <= radius]
            if len(near):
                forest.join(one, near)


def search(
    values: np.ndarray, own: np.ndarray, rest: np.ndarray, mask: int, reach: int, radius: int, among: bool, forest: _Forest
) -> None:
    """The lower levels of a band's tree: links of owned fingerprints (``own``, by number) with querying ones (``rest``) and ``among`` each other."""
    bits = np.uint64(mask)
    stack = [(own, rest)]
    while stack:
        own, rest = stack.pop()
        if len(own) <= LEAF:
            _leaf(values, own, rest, radius, among, forest)
            continue
        found = _split(values[own], bits, reach)
        if found is None:
            _dense_leaf(values, own, rest, radius, forest)
            continue
        point, ball = found
        a = np.bitwise_count((values[own] ^ point) & bits).astype(np.int16)
        b = np.bitwise_count((values[rest] ^ point) & bits).astype(np.int16)
        border = own[(a <= ball) & (a > ball - reach)] if among else own[:0]
        stack.append((own[a <= ball], rest[b <= ball + reach]))
        stack.append((own[a > ball], np.concatenate([rest[b > ball - reach], border])))


def _levels(count: int) -> int:
    return min(LEVELS, max(0, (count // SHARD).bit_length()))


def near_links(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``points`` that differ in ``radius`` bits at most.

    ``points`` has one column of distinct numbers, fingerprint, and should be a written table, as it is read several times.
    """
    masks = bands(radius)
    reach = radius // len(masks)
    count = points.count()
    levels = _levels(count)
    sample = points
    if count > SAMPLE // 2:
        sample = points.filter(F.pmod(F.xxhash64("fingerprint"), F.lit(count)) < SAMPLE // 2)
    picked = np.sort(np.array([r[0] for r in sample.limit(SAMPLE).collect()] if levels else [], np.int64).view(np.uint64))
    trees = [UpperTree(picked, m, levels, reach) for m in masks]
    out = "band int, shard long, own boolean, fingerprint long"

    def dealt(incoming: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for band, tree in enumerate(trees):
                index, shard, own = tree.shards(values)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(index), band, np.int32)), pa.array(shard), pa.array(own), pa.array(values[index].view(np.int64)),
                ], names=["band", "shard", "own", "fingerprint"])

    shards = stored(points.select("fingerprint").mapInArrow(dealt, out), "shards")
    return stored(_in_cells(shards).mapInArrow(_searched(masks, reach, radius), "a long, b long"), "links")


def _in_cells(shards: DataFrame) -> DataFrame:
    """Shards as cells (band, shard, i, j) of bounded size: the owned fingerprints of block i and the querying ones of block j.

    A shard of usual size is one block. Of a larger one, owners of different blocks meet once, and querying ones meet all blocks.
    """
    key = ["band", "shard"]
    large = shards.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / TASK_ROWS).cast("int").alias("blocks")).filter("blocks > 1")
    # at most one row per TASK_ROWS rows of the shards
    met = shards.join(F.broadcast(large), key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    met = met.withColumn("mine", F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    as_own = met.filter("own").select(*key, F.col("mine").alias("i"), F.col("other").alias("j"), "own", "fingerprint")
    as_query = met.filter("not own or mine > other").select(*key, F.col("other").alias("i"), F.col("mine").alias("j"), F.lit(False).alias("own"), "fingerprint")
    return as_own.union(as_query).repartition(*key, "i", "j").sortWithinPartitions(*key, "i", "j")


def _cells(incoming: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """(cell, fingerprints, whether they are owned) of sorted rows (band, shard, i, j, own, fingerprint)."""
    key, held = None, []
    for batch in incoming:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
        keys = np.array([c.astype(np.int64) for c in columns[:4]])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for low, high in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if low == high:
                continue
            now = tuple(keys[:, low].tolist())
            if now != key and held:
                yield key, np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
                held = []
            key = now
            held.append((columns[5][low:high].astype(np.int64).view(np.uint64), columns[4][low:high].astype(bool)))
    if held:
        yield key, np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])


def _searched(masks: list[int], reach: int, radius: int):
    def run(incoming: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links() -> Iterator[tuple]:
            for (band, _, i, j), values, owned in _cells(incoming):
                forest = _Forest(len(values))
                search(values, np.flatnonzero(owned), np.flatnonzero(~owned), masks[band], reach, radius, i == j, forest)
                signed = values.view(np.int64)
                yield from ((int(signed[a]), int(signed[b])) for a, b in forest.links)

        yield from batches(links(), "a long, b long")

    return run


def simhash_components(docs: DataFrame, n: int = WORDS, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 lowercase hex digits), component_id.

    A fingerprint's bit is 1 if it is set in over half of the XXH64 values of the text's ``n``-word shingles (words between ASCII white
    space, A-Z lower-cased, repeats included). Fewer words are one shingle; an empty or null text has the fingerprint zero,
    linked like any other. Fingerprints link at ``radius`` differing bits or fewer, and component_id is the smallest id that links lead to. Rows
    that repeat an id are judged each by its own text. A row without an id links nothing and has no component. Other columns are ignored; an empty
    table gives an empty result.
    """
    rows = stored(fingerprints(docs, n, id_col, text_col), "fingerprints")
    known = rows.filter("doc_id is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    known = stored(known, "distinct")
    roots = components(near_links(known.select("fingerprint"), radius))
    labelled = known.join(roots, known.fingerprint == roots.node, "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    labelled = stored(labelled, "labelled")
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    named = labelled.join(smallest, "root").select("fingerprint", "component_id")
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint")
    full = rows.join(named, "fingerprint", "left")
    return full.select("doc_id", digits, F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
