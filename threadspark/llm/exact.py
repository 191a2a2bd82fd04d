"""Exact dedup through compressed radix tries.

Every map task inserts the whole normalised texts of its rows into a Patricia trie, so that copies inside
a task meet before anything is shuffled. The trie's terminals ("owners") then go to partitions by text length
and content hash, where a second trie over the full byte strings joins the owners of equal texts. A text that
holds a third of all rows therefore reaches the second step once per map task, not once per row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadspark.llm.common import ascii_lower, ascii_lowered, batches, rows_of, rows_without, stored

#: Bytes of edge labels that a task's trie may hold before it hands on its largest subtree.
TRIE_BYTES = 64 << 20

_LOCAL = (
    "kind int, doc_id long, row long, owner long, sha string, "
    "best_id long, best_row long, n long, len int, hash long, content binary"
)
_MERGED = "owner long, keep_id long, keep_row long, group_size long"


class _Node:
    __slots__ = ("edges", "entry")

    def __init__(self) -> None:
        self.edges: dict[int, list] = {}  # first byte -> [label, node]
        self.entry: list | None = None


def _shared(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of ``a`` and ``b[at:]``, by bisection."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class PatriciaTrie:
    """Byte strings in a compressed radix trie; each terminal has an entry of the caller's."""

    def __init__(self) -> None:
        self.root = _Node()
        self.weights: dict[int, int] = {}  # bytes below each first byte; -1 stands for the empty string

    @property
    def weight(self) -> int:
        return sum(self.weights.values())

    def terminal(self, key: bytes) -> _Node:
        """The node of ``key``, made where it is missing."""
        node, at = self.root, 0
        first = key[0] if key else -1
        self.weights.setdefault(first, 0)
        while at < len(key):
            edge = node.edges.get(key[at])
            if edge is None:
                leaf = _Node()
                node.edges[key[at]] = [key[at:], leaf]
                self.weights[first] += len(key) - at + 200
                return leaf
            label, child = edge
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            n = _shared(label, key, at)
            middle = _Node()
            middle.edges[label[n]] = [label[n:], child]
            edge[:] = [label[:n], middle]
            self.weights[first] += 200
            node, at = middle, at + n
        return node

    def cut(self, first: int) -> Iterator[tuple[bytes, list]]:
        """Take the subtree below a first byte out and give its keys and entries."""
        self.weights.pop(first)
        if first == -1:
            entry, self.root.entry = self.root.entry, None
            if entry is not None:
                yield b"", entry
            return
        edge = self.root.edges.pop(first, None)
        stack = [] if edge is None else [(edge[0], edge[1])]
        while stack:
            key, node = stack.pop()
            if node.entry is not None:
                yield key, node.entry
            stack.extend((key + label, child) for label, child in node.edges.values())

    def largest(self) -> int:
        return max(self.weights, key=self.weights.__getitem__)


def _better(a: tuple, b: tuple, smallest: bool) -> bool:
    """Whether (id, row) ``a`` goes before ``b``: by id, a null id last, then the row met first."""
    if a[0] is None or b[0] is None:
        return a[1] < b[1] if a[0] is b[0] else b[0] is None
    if a[0] != b[0]:
        return (a[0] < b[0]) == smallest
    return a[1] < b[1]


def _local(incoming: Iterable[pa.RecordBatch], smallest: bool, most: int) -> Iterator[pa.RecordBatch]:
    base = TaskContext.get().partitionId() << 36
    trie = PatriciaTrie()

    def owners(first: int) -> Iterator[tuple]:
        for key, (owner, best_id, best_row, n) in trie.cut(first):
            content = xxhash.xxh3_64_intdigest(key) - (1 << 63)
            yield 1, None, None, owner, None, best_id, best_row, n, len(key), content, key

    def rows() -> Iterator[tuple]:
        row = owner = base
        for doc_id, text in rows_of(incoming):
            key = ascii_lowered(text)
            node = trie.terminal(key)
            if node.entry is None:
                node.entry = [owner, doc_id, row, 0]
                owner += 1
            entry = node.entry
            if _better((doc_id, row), (entry[1], entry[2]), smallest):
                entry[1:3] = doc_id, row
            entry[3] += 1
            yield 0, doc_id, row, entry[0], hashlib.sha256(key).hexdigest(), None, None, None, None, None, None
            row += 1
            while trie.weight > most:
                yield from owners(trie.largest())
        for first in list(trie.weights):
            yield from owners(first)

    yield from batches(rows(), _LOCAL)


def _merge(incoming: Iterable[pa.RecordBatch], smallest: bool) -> Iterator[pa.RecordBatch]:
    """Owners sorted by length and hash; a trie lives as long as one such run."""

    def flush(trie: PatriciaTrie) -> Iterator[tuple]:
        for first in list(trie.weights):
            for _, (owners, keep_id, keep_row, size) in trie.cut(first):
                for owner in owners:
                    yield owner, keep_id, keep_row, size

    def rows() -> Iterator[tuple]:
        trie, at = PatriciaTrie(), None
        for owner, best_id, best_row, n, size, content, key in rows_of(incoming):
            if (size, content) != at:
                yield from flush(trie)
                trie, at = PatriciaTrie(), (size, content)
            node = trie.terminal(key)
            if node.entry is None:
                node.entry = [[], best_id, best_row, 0]
            entry = node.entry
            entry[0].append(owner)
            if _better((best_id, best_row), (entry[1], entry[2]), smallest):
                entry[1:3] = best_id, best_row
            entry[3] += n
        yield from flush(trie)

    yield from batches(rows(), _MERGED)


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", trie_bytes: int = TRIE_BYTES
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after lower-casing A-Z; null counts as the empty text, which is a
    text like any other. ``keep`` names the id that stays, "smallest" or "largest"; a null id stays only if all ids of
    the group are null. Of rows that repeat both id and text exactly one has ``kept``. Other columns are ignored, and
    an empty table gives an empty result. A task that holds more than ``trie_bytes`` hands on its largest subtree.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep}")
    smallest = keep == "smallest"
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    seen = stored(picked.mapInArrow(lambda x: _local(x, smallest, trie_bytes), _LOCAL), "exact", "kind")
    owners = (
        seen.filter("kind = 1")
        .select("owner", "best_id", "best_row", "n", "len", "hash", "content")
        .repartition("len", "hash")
        .sortWithinPartitions("len", "hash")
        .mapInArrow(lambda x: _merge(x, smallest), _MERGED)
    )
    return (
        seen.filter("kind = 0").select("doc_id", "row", "owner", "sha")
        .join(owners, "owner")
        .select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"))
    )


def drop_copies(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts the one with the smallest or the largest id.

    Rows are found again by id and text digest; of rows that repeat both one stays, whatever their other columns hold. Null texts count as
    empty, null ids stay only if all ids of the group are null; extra columns may have any names; an empty table stays empty.
    """
    def part(sha: Column) -> Column:
        return F.conv(F.substring(sha, 1, 15), 16, 10).cast("long")

    found = exact_dedup(docs, keep=keep).groupBy("doc_id", part(F.col("text_sha256")).alias("part"))
    found = stored(found.agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")), "verdicts")
    keys = {"doc_id": F.col("doc_id").cast("long"), "part": part(F.sha2(ascii_lower(F.col("text").cast("string")), 256))}
    once = rows_without(docs, keys, found.filter("not kept or n > 1"))
    repeated = found.filter("kept and n > 1")
    if repeated.isEmpty():
        return once
    some = rows_without(docs, keys, repeated, "left_semi")
    packed = some.select(F.struct("*").alias("row"), *[c.alias(k) for k, c in keys.items()]).dropDuplicates(["doc_id", "part"])
    return once.unionByName(packed.select("row.*"))
