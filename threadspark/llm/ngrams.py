"""N-gram Jaccard join with PartEnum signatures.

Two sets with a Jaccard similarity of p percent differ in at most k elements, and k follows from their sizes. Sets are
put into bands of similar size; for each band the domain of shingles is split into first-level partitions, so many that two
similar sets must differ by at most k2 elements in one of them, and every partition into second-level cells, of which k2 may
differ: each subset of the others gives a signature. Similar sets share one signature at least, so no link is lost.

Links are looked for without listing the pairs of a group. Sets under a signature are compared with the group's hub first. What
that leaves in several components is compared block by block through the differences to the hub, and only a forest of the links
found leaves a task.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadspark.llm.common import ascii_lowered, batches, rows_of, rows_without, stored
from threadspark.llm.graphs import components

#: Largest over smallest size of a band.
BAND = 1.4
#: Ids that are broadcast (16 bytes each) to pick texts; for more of them the texts are shuffled.
BROADCAST_IDS = 4_000_000
#: Members of a block in the comparison within a hub's group. A member travels once per block of its group.
BLOCK = 2048
#: Buckets of the first comparison of two sketches; sketches have 64 or more, a power of two.
COARSE = 32

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted 64-bit digests of a text's distinct ``n``-word shingles; fewer words are one shingle, none none."""
    words = ascii_lowered(text).split()
    if not words:
        return np.zeros(0, np.uint64)
    digests = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    size = min(n, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        out = _mix(out + digests[k : len(digests) - size + 1 + k])
    return np.unique(out)


class Bands:
    """Size bands and the partition plan of each, for sets that are similar at ``percent``."""

    def __init__(self, percent: int) -> None:
        if not 80 <= percent <= 100:
            raise ValueError("percent must be between 80 and 100: bands reach one band up only")
        self.percent, self.starts = percent, [1]
        while self.starts[-1] < 1 << 40:
            self.starts.append(int(self.starts[-1] * BAND) + 1)

    def differing(self, size: int) -> int:
        """The most elements in which two similar sets of at most ``size`` elements differ."""
        return 2 * size * (100 - self.percent) // (100 + self.percent)

    def plan(self, band: int) -> tuple[int, int, int, int]:
        """(first-level partitions, cells in each, cells that may differ, partitions a set may leave out).

        A set leaves out its ``spare`` thinnest partitions, in which unrelated sets are alike by being empty or by one shingle
        of a line that many texts hold. Without cells, a partition that two sets share counts as many elements in both, so that both
        rank the shared ones alike: with ``spare`` partitions more than needed, each keeps the thickest of these. In a partition with cells that
        may differ the counts may, too: with 2 * spare more, a partition stays that both keep.
        """
        k = self.differing(self.starts[band + 1] - 1)
        if k <= 3:
            return 1, k + 3, k, 0
        if k <= 15:
            return -(-(k + 1) // 4), 6, 3, 0
        if self.percent >= 85:
            need = -(-(k + 1) // 2)
            spare = 1 + need // 24
            return need + 2 * spare, 3, 1, spare
        spare = 2 + k // 3
        return k + 1 + spare, 1, 0, spare

    def signatures(self, features: np.ndarray) -> np.ndarray:
        """The 64-bit signatures of a set."""
        size = len(features)
        if not size:
            return np.zeros(0, np.uint64)
        own = bisect_right(self.starts, size) - 1
        some = [self._in_band(features, own)]
        if 100 * size >= self.percent * self.starts[own + 1]:
            some.append(self._in_band(features, own + 1))
        return np.concatenate(some)

    def _in_band(self, features: np.ndarray, band: int) -> np.ndarray:
        if self.differing(self.starts[band + 1] - 1) == 0:
            return np.zeros(0, np.uint64)  # similar sets of this band are equal
        parts, cells, loose, spare = self.plan(band)
        cell = (_mix(features + np.uint64(band)) % np.uint64(parts * cells)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        firsts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        sums, counts = np.zeros(parts * cells, np.uint64), np.zeros(parts * cells, np.int64)
        sums[cell[firsts]] = np.add.reduceat(_mix(features[order]), firsts)
        counts[cell[firsts]] = np.diff(np.r_[firsts, len(cell)])
        sums, counts = _mix(sums.reshape(parts, cells)), counts.reshape(parts, cells)
        thinnest = np.sort(counts, axis=1)[:, : cells - loose].sum(axis=1)
        keep = np.sort(np.argsort(thinnest, kind="stable")[spare:])
        out = []
        with np.errstate(over="ignore"):
            for k, chosen in enumerate(combinations(range(cells), cells - loose)):
                x = np.full(len(keep), band * 1_000_003 + k, np.uint64) + _mix(keep.astype(np.uint64))
                for c in chosen:
                    x = _mix(x + sums[keep, c])
                out.append(x)
        return np.concatenate(out)


def sketch(features: np.ndarray) -> bytes:
    """Counts of a set's elements in buckets, half as many to as many as elements; the counts stop at 15, and a byte holds those of two buckets."""
    buckets = 1 << max(6, len(features).bit_length() - 1)
    counts = np.bincount((features & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
    low, high = np.minimum(counts, 15).astype(np.uint8).reshape(2, -1)
    return (low | high << 4).tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of counts over the fewest buckets that any of them has."""
    buckets = 2 * min(map(len, sketches))
    packed = [np.frombuffer(s, np.uint8) for s in sketches]
    rows = [np.concatenate((p & 15, p >> 4)).reshape(-1, buckets).sum(axis=0, dtype=np.int32) for p in packed]
    return np.minimum(np.array(rows), 255)


def _signed(x: np.ndarray) -> list[int]:
    return x.view(np.int64).tolist()


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest and the sketch of the set, of every row."""
    out = "doc_id long, n_shingles long, high long, low long, sketch binary"

    def run(incoming: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for doc_id, text in rows_of(incoming):
                features = shingles(text, n)
                yield doc_id, *_digest(features), sketch(features)

        yield from batches(rows(), out)

    return docs.mapInArrow(run, out)


def _digest(features: np.ndarray) -> tuple[int, int, int]:
    high, low = divmod(xxhash.xxh3_128_intdigest(features.tobytes()), 1 << 64)
    return len(features), high - (1 << 63), low - (1 << 63)


def _signatures(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id and signatures of the rows that have any."""
    out = "doc_id long, signatures array<long>"

    def run(incoming: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)

        def rows() -> Iterator[tuple]:
            for doc_id, text in rows_of(incoming):
                found = bands.signatures(shingles(text, n))
                if len(found):
                    yield doc_id, _signed(found)

        yield from batches(rows(), out, 256)

    return docs.filter("doc_id is not null").mapInArrow(run, out)


def _features(docs: DataFrame, n: int) -> DataFrame:
    out = "node long, features array<long>"

    def run(incoming: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(((i, _signed(shingles(t, n))) for i, t in rows_of(incoming)), out, 256)

    return docs.mapInArrow(run, out)


def _picked(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``docs`` with or without the written ``ids`` (doc_id), which are broadcast up to a counted bound."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge"), "doc_id", how)


def _groups(docs: DataFrame, sets: DataFrame, n: int, percent: int) -> DataFrame:
    """(gid, rep, size): sets under one signature, each different group of sets once.

    Of equal sets only the smallest id makes signatures.
    """
    owners = sets.groupBy("high", "low").agg(F.min("doc_id").alias("doc_id"))
    repeated = stored(sets.select("doc_id").distinct().join(owners, "doc_id", "left_anti"), "repeated")
    signatures = _signatures(_picked(docs, repeated, "left_anti"), n, percent)
    rows = signatures.select(F.col("doc_id").alias("rep"), F.explode("signatures").alias("gid"))
    # the join below would filter its side; said here, both sides read one exchange
    rows = rows.filter("gid is not null and rep is not null").repartition("gid")
    found = rows.groupBy("gid").agg(
        F.count(F.lit(1)).alias("size"), F.min("rep").alias("low"), F.max("rep").alias("high"),
        F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"),
    ).filter("low < high")
    once = found.groupBy("size", "low", "high", "x", "y").agg(F.min("gid").alias("gid")).select("gid", "size")
    return stored(rows.join(once, "gid"), "groups")


def _in_blocks(members: DataFrame) -> DataFrame:
    """Members of a hub dealt to all pairs of the hub's blocks: key columns hub, i, j, and the side within the pair."""
    counts = members.groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    counts = counts.filter("n > 1 and low < high").select("hub", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    mine = members.join(counts, "hub").withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    each = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = ["hub", "i", "j"]
    return each.withColumns({
        "i": F.least("mine", "other"), "j": F.greatest("mine", "other"), "side": (F.col("mine") > F.col("other")).cast("int"),
    }).drop("mine", "other", "blocks").repartition(*key).sortWithinPartitions(*key)


def _pairs_of(incoming: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[tuple], list[tuple]]]:
    """Left and right members of each pair of blocks, the same list for a block with itself."""
    for _, rows in groupby(rows_of(incoming), key=lambda r: r[:3]):
        group = [r[3:] for r in rows]
        left, right = [m for m in group if m[0] == 0], [m for m in group if m[0] == 1]
        yield left, right or left


def _near_pairs(left: list[tuple], right: list[tuple], percent: int, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each left member the right members of another label that its sketch doesn't rule out, and the bound of each.

    Bucket counts of two sets differ by no more than the sets do. Members are (side, rep, label, size, ...), ``rows`` the counts of both sides.
    """
    # few buckets rule most pairs out at a small share of the work; the right side lies in order of size, so that sizes pick a range
    few = rows.reshape(len(rows), -1, COARSE).sum(axis=1)
    kind = np.int16 if few.sum(axis=1).max() < 1 << 14 else np.int32
    sizes = np.array([m[3] for m in right])
    order = np.argsort(sizes, kind="stable")
    labels, sizes = np.array([m[2] for m in right])[order], sizes[order]
    few_a, few_b = few[: len(left)].T.astype(kind), np.ascontiguousarray(few[len(left) :][order].T.astype(kind))
    rows = rows.astype(np.int16)
    a, b = rows[: len(left)], rows[len(left) :]
    for k, m in enumerate(left):
        most = (m[3] + sizes) * (100 - percent) // (100 + percent)
        alike = np.flatnonzero(np.abs(sizes - m[3]) <= most)
        if not len(alike):
            continue
        # sizes alike to one are neighbours in order
        low, high = int(alike[0]), int(alike[-1]) + 1
        near = labels[low:high] != m[2]
        if right is left:
            near &= order[low:high] > k
        spots = np.flatnonzero(near)
        if not len(spots):
            continue
        if 4 * len(spots) > high - low:
            apart = few_b[:, low:high] - few_a[:, k : k + 1]
            apart = np.add.reduce(np.abs(apart, out=apart), axis=0, dtype=kind)[spots]
            spots += low
        else:
            spots += low
            apart = few_b[:, spots] - few_a[:, k : k + 1]
            apart = np.add.reduce(np.abs(apart, out=apart), axis=0, dtype=kind)
        spots = spots[apart <= most[spots]]
        spots = spots[np.abs(b[order[spots]] - a[k]).sum(axis=1, dtype=np.int32) <= most[spots]]
        if len(spots):
            yield k, order[spots], most[spots]


def _partners(members: DataFrame, percent: int, which: str) -> DataFrame:
    """(a, b, label) of members (hub, rep, label, size, sketch) that may be linked to one of another label under their hub.

    ``which``: "member" gives each such member once as (hub, rep, its label), "first" each with the smallest of its possible partners,
    "all" each pair.
    """
    out = "a long, b long, label long"

    def pairs(left: list[tuple], right: list[tuple]) -> Iterator[tuple]:
        for k, spots, _ in _near_pairs(left, right, percent, folded([m[4] for m in left] + [m[4] for m in right])):
            yield from ((left[k], right[j]) for j in spots)

    def run(incoming: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for left, right in _pairs_of(incoming):
                first: dict[int, tuple] = {}
                for x, y in pairs(left, right):
                    if which == "all":
                        yield min(x[1], y[1]), max(x[1], y[1]), x[2]
                        continue
                    for one, other in ((x, y), (y, x)):
                        to = one[5] if which == "member" else other[1]
                        if one[1] not in first or to < first[one[1]][0]:
                            first[one[1]] = to, one[1], one[2]
                yield from first.values()

        yield from batches(rows(), out)

    dealt = _in_blocks(members).select("hub", "i", "j", "side", "rep", "label", "size", "sketch", F.col("hub").alias("again"))
    return dealt.mapInArrow(run, out)


def _block_links(members: DataFrame, percent: int) -> DataFrame:
    """A forest of the links between members (hub, rep, label, size, delta) of different labels."""
    out = "a long, b long"

    def links(left: list[tuple], right: list[tuple]) -> Iterator[tuple]:
        top: dict[int, int] = {}

        def root(x: int) -> int:
            while top.setdefault(x, x) != x:
                top[x] = x = top[top[x]]
            return x

        both = left + right
        deltas = {m[1]: frozenset(m[4]) for m in both}
        counts = np.array([np.bincount(np.asarray(m[4], np.int64) & 63, minlength=64) for m in both])
        for k, spots, most in _near_pairs(left, right, percent, np.minimum(counts, 255)):
            m = left[k]
            for j, bound in zip(spots.tolist(), most.tolist(), strict=True):
                other = right[j]
                a, b = root(m[2]), root(other[2])
                if a != b and len(deltas[m[1]] ^ deltas[other[1]]) <= bound:
                    top[a] = b
                    yield m[1], other[1]

    def run(incoming: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches((x for left, right in _pairs_of(incoming) for x in links(left, right)), out)

    return _in_blocks(members).select("hub", "i", "j", "side", "rep", "label", "size", "delta").mapInArrow(run, out)


def _apart(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (rep, hub) with the sizes of both and a lower bound of the number of elements in which they differ."""
    out = "rep long, hub long, size long, hub_size long, least long"

    def run(incoming: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for rep, hub, na, nb, a, b in rows_of(incoming):
                x, y = folded([a, b])
                yield rep, hub, na, nb, int(np.abs(x - y).sum())

        yield from batches(rows(), out)

    a = sets.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("na"), F.col("sketch").alias("a"))
    b = sets.select(F.col("doc_id").alias("hub"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("b"))
    return edges.join(a, "rep").join(b, "hub").select("rep", "hub", "na", "nb", "a", "b").mapInArrow(run, out)


def _compared(edges: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """Edges (rep, hub, ...) with the shingles of both, read again from the texts that they need."""
    ids = stored(edges.select(F.explode(F.array("rep", "hub")).alias("doc_id")).distinct(), "wanted")
    features = stored(_features(_picked(docs, ids, "left_semi"), n), "features")
    a = features.select(F.col("node").alias("rep"), F.col("features").alias("fa"))
    b = features.select(F.col("node").alias("hub"), F.col("features").alias("fb"))
    return edges.join(a, "rep").join(b, "hub")


def find_links(docs: DataFrame, sets: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) whose components are those of all links between different sets; ``docs`` has doc_id and text.

    1. Every member of a group meets the group's hub.
    2. Members that may still be linked to one of another component, by their sketches, stay; the others are done.
    3. Members not far from their hub are compared through their differences to it.
    4. Far ones, which are alike apart from the hub, meet the smallest of their possible partners, and then the partners that this leaves
       in other components. Of two linked members both count as near or both as far: the bounds overlap by what a link allows.
    """
    p = percent
    groups = _groups(docs, sets, n, percent)
    weights = groups.groupBy("rep").agg(F.sum("size").alias("weight"))
    hubs = groups.select("gid", "rep").join(weights, "rep").groupBy("gid").agg(F.max(F.struct("weight", (-F.col("rep")).alias("minus"))).alias("best"))
    stars = groups.select("gid", "rep").join(hubs.select("gid", (-F.col("best.minus")).alias("hub")), "gid").filter("rep <> hub")
    stars = stored(_apart(stars.select("rep", "hub").distinct(), sets), "stars")
    mine = sets.select(F.col("doc_id").alias("rep"), "sketch")

    def verified(edges: DataFrame) -> DataFrame:
        near = F.col("least") * (100 + p) <= (F.col("size") + F.col("hub_size")) * (100 - p)
        judged = _compared(edges.filter(near).select("rep", "hub"), docs, n).withColumn("common", F.size(F.array_intersect("fa", "fb")))
        good = 100 * F.col("common") >= p * (F.size("fa") + F.size("fb") - F.col("common"))
        return judged.filter(good).select(F.col("rep").alias("a"), F.col("hub").alias("b"))

    def labelled(members: DataFrame, links: DataFrame) -> DataFrame:
        labels = components(links)
        found = members.join(labels, members.rep == labels.node, "left").withColumn("label", F.coalesce("root", "rep"))
        return found.select("hub", "rep", "label", "size").join(mine, "rep")

    links = stored(verified(stars), "links")
    rest = _partners(labelled(stars, links), p, "member").select(F.col("a").alias("hub"), F.col("b").alias("rep"), "label")
    rest = stored(rest.distinct().join(stars.select("hub", "rep", "size", "least"), ["hub", "rep"]), "rest")
    close = F.col("least") * (p * p) <= 300 * (100 - p) * F.col("size")
    deltas = stored(_compared(rest.filter(close), docs, n).select(
        "hub", "rep", "label", "size", F.concat(F.array_except("fa", "fb"), F.array_except("fb", "fa")).alias("delta")
    ), "deltas")
    links = stored(links.union(_block_links(deltas, p)), "links")
    far = rest.filter(~close).select("hub", "rep", "size").union(
        deltas.filter(F.size("delta") * p > 2 * (100 - p) * F.col("size")).select("hub", "rep", "size")
    )
    far = stored(far.distinct(), "far")
    for which in ("first", "all"):
        pairs = _partners(labelled(far, links), p, which).select(F.col("b").alias("rep"), F.col("a").alias("hub")).distinct()
        links = stored(links.union(verified(stored(_apart(pairs, sets), "pairs"))), "links")
    return links


def ngram_components(
    docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Sets of distinct ``n``-word shingles (words between ASCII white space, A-Z lower-cased) are linked when their Jaccard similarity
    is ``percent`` or more; component_id is the smallest id that links lead to. A text with fewer words is one shingle; an empty or null text
    has an empty set and is linked with nothing. Shingles are compared by 64-bit digests. Rows that repeat an id count as
    one document with all their texts; rows without an id are linked with nothing and have no component. Other columns are ignored.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sets = stored(_sets(picked, n), "sets")
    known = sets.filter("n_shingles > 0 and doc_id is not null")
    roots = stored(components(find_links(picked, known, n, percent)), "roots")
    full = known.select("doc_id", "n_shingles", "high", "low")
    # the set of a row is that of the smallest id which has it
    owners = full.groupBy("high", "low").agg(F.min("doc_id").alias("rep"))
    owners = owners.join(roots, owners.rep == roots.node, "left").select("high", "low", F.coalesce("root", "rep").alias("component_id"))
    linked = full.join(owners, ["high", "low"]).select("doc_id", "n_shingles", "component_id")
    alone = sets.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone)


def drop_near_copies(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the smallest id, and all rows without an id.

    Empty and null texts are linked with nothing and stay; rows that repeat the smallest id all stay. Extra columns may
    have any names; an empty table stays empty.
    """
    gone = ngram_components(docs, n, percent).filter("component_id < doc_id").select("doc_id").distinct()
    return rows_without(docs, {"doc_id": F.col("doc_id").cast("long")}, stored(gone, "gone"))
