"""Token counts of documents in flat token files without an index.

A flat file is a stream of little-endian ids in which one id ends each document. Blocks of a file are scanned apart:
a vectorised search gives the separators of a block, and a prefix scan over the blocks' summaries (how many tokens and separators lie
before, where the last separator was) stitches the documents that lie across blocks. The scan goes by groups of blocks first, so
a file of any length is no single task's work.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from threadspark.llm.common import batches, rows_of, stored

#: Tokens of a block; documents don't end with blocks.
BLOCK_TOKENS = 1 << 16
#: Blocks whose summaries one window of the prefix scan orders.
SCAN_BLOCKS = 4096
#: Separators that one row of a block's summary lists.
LISTED = 4096

_DTYPES = {2: "<u2", 4: "<u4"}
_encoders: dict[tuple[str, str], object] = {}


def encoder(ranks_path: str, pattern: str):
    """A byte-level BPE from a rank file, loaded once per worker."""
    if (ranks_path, pattern) not in _encoders:
        import tiktoken

        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _encoders[ranks_path, pattern] = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[ranks_path, pattern]


def flat_blocks(
    docs: DataFrame, ranks_path: str, pattern: str, separator: int, id_col: str = "doc_id", text_col: str = "text",
    width: int = 2, block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """Documents as flat streams, one file per task: (file, block, payload, doc_ids).

    A document's ids are followed by ``separator``; null counts as empty. ``doc_ids`` names the documents that end in the block, in order: what
    a file's list of sources would say. It has no positions.
    """
    out = "file long, block long, payload binary, doc_ids array<long>"

    def run(incoming: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, file = encoder(ranks_path, pattern), TaskContext.get().partitionId()

        def rows() -> Iterator[tuple]:
            held: list[np.ndarray] = []
            size, block, ids = 0, 0, []
            for doc_id, text in rows_of(incoming):
                stream = np.append(np.array(bpe.encode_ordinary(text or ""), _DTYPES[width]), np.array([separator], _DTYPES[width]))
                while size + len(stream) > block_tokens:
                    cut = block_tokens - size
                    yield file, block, np.concatenate([*held, stream[:cut]]).tobytes(), ids
                    stream, held, size, block, ids = stream[cut:], [], 0, block + 1, []
                held.append(stream)
                size += len(stream)
                ids.append(doc_id)
            if size:
                yield file, block, np.concatenate(held).tobytes(), ids

        yield from batches(rows(), out, 64)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, out)


def read_flat_files(spark: SparkSession, path: str, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Flat token files below ``path``, any Spark-readable store, as blocks (file, block, payload, doc_ids).

    A task reads a whole file, so shards stay below 2 GB, Spark's bound for one; ``doc_ids`` is null. A file's last block may be shorter.
    """
    size = width * block_tokens
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")
    spots = F.explode(F.sequence(F.lit(0), F.ceil(F.col("length") / size).cast("long") - 1)).alias("block")
    cut = files.filter("length > 0").select(F.xxhash64("path").alias("file"), "content", spots)
    payload = F.substring(F.col("content"), (F.col("block") * size + 1).cast("int"), F.lit(size))
    return cut.select("file", "block", payload.alias("payload"), F.lit(None).cast("array<long>").alias("doc_ids"))


def _summaries(blocks: DataFrame, separator: int, width: int) -> DataFrame:
    """(file, block, part, n, ends, doc_ids): tokens of a block and the places just after its separators.

    A block with many separators has several parts; its tokens count in the first.
    """
    out = "file long, block long, part int, n long, ends array<long>, doc_ids array<long>"

    def run(incoming: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for file, block, payload, ids in rows_of(incoming):
                stream = np.frombuffer(payload, _DTYPES[width])
                ends = np.flatnonzero(stream == separator) + 1
                for part, at in enumerate(range(0, max(1, len(ends)), LISTED)):
                    yield (file, block, part, len(stream) if part == 0 else 0, ends[at : at + LISTED].tolist(),
                           None if ids is None else ids[at : at + LISTED])

        yield from batches(rows(), out, 256)

    return blocks.select("file", "block", "payload", "doc_ids").mapInArrow(run, out)


def count_tokens(blocks: DataFrame, separator: int, width: int = 2) -> DataFrame:
    """One row per document of the flat files: file, doc_no, start, n_tokens, doc_id, closed.

    ``start`` is the document's first token in its file and ``n_tokens`` leaves the separator out. Tokens after a file's last separator are a
    document that isn't ``closed``. Two separators in a row enclose a document without tokens. An empty table gives no rows.
    ``doc_id`` is null where the files name no sources. Blocks are (file, block, payload) with ``block`` from 0; other columns are ignored.
    """
    parts = stored(_summaries(blocks, separator, width), "summaries")
    keyed = parts.select(
        "file", F.floor(F.col("block") / SCAN_BLOCKS).alias("group"), "block", "part", "n",
        F.size("ends").cast("long").alias("k"), F.get("ends", F.size("ends") - 1).alias("last"),
    )
    inner = W.partitionBy("file", "group").orderBy("block", "part").rowsBetween(W.unboundedPreceding, -1)
    outer = W.partitionBy("file").orderBy("group").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    # within a group: tokens and separators before the part, and the group's last separator so far
    near = keyed.withColumn("before", F.coalesce(F.sum("n").over(inner), zero)).withColumn(
        "block_at", F.col("before") - F.when(F.col("part") > 0, F.first("n").over(W.partitionBy("file", "group", "block").orderBy("part"))).otherwise(zero)
    ).withColumn("docs", F.coalesce(F.sum("k").over(inner), zero)).withColumn("end", F.col("block_at") + F.col("last"))
    near = near.withColumn("open_at", F.max("end").over(inner))
    groups = near.groupBy("file", "group").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.max("end").alias("end"))
    # over the groups: one row for each SCAN_BLOCKS blocks
    far = groups.withColumn("g_at", F.coalesce(F.sum("n").over(outer), zero)).withColumn("g_docs", F.coalesce(F.sum("k").over(outer), zero))
    far = far.withColumn("g_open", F.max(F.col("g_at") + F.col("end")).over(outer)).select("file", "group", "g_at", "g_docs", "g_open")
    places = near.join(far, ["file", "group"]).select(
        "file", "block", "part", (F.col("g_at") + F.col("block_at")).alias("at"), (F.col("g_docs") + F.col("docs")).alias("doc_no"),
        F.coalesce(F.col("g_at") + F.col("open_at"), "g_open", zero).alias("open"),
    )
    placed = parts.join(places, ["file", "block", "part"])
    found = placed.select("file", "doc_no", "at", "open", "ends", "doc_ids", F.posexplode("ends").alias("j", "end"))
    start = F.when(F.col("j") == 0, F.col("open")).otherwise(F.col("at") + F.get("ends", F.col("j") - 1))
    closed = found.select(
        "file", (F.col("doc_no") + F.col("j")).alias("doc_no"), start.alias("start"), (F.col("at") + F.col("end") - 1 - start).alias("n_tokens"),
        F.get("doc_ids", F.col("j")).alias("doc_id"), F.lit(True).alias("closed"),
    )
    ends = near.join(far, ["file", "group"]).groupBy("file").agg(
        F.max(F.col("g_at") + F.col("before") + F.col("n")).alias("total"), F.max(F.col("g_docs") + F.col("docs") + F.col("k")).alias("doc_no"),
        F.coalesce(F.max(F.col("g_at") + F.col("end")), zero).alias("start"),
    )
    tail = ends.filter("total > start").select(
        "file", "doc_no", "start", (F.col("total") - F.col("start")).alias("n_tokens"), F.lit(None).cast("long").alias("doc_id"), F.lit(False).alias("closed")
    )
    return closed.unionByName(tail)
