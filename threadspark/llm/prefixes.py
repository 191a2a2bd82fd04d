"""The prefix trie of conversations by collapsing whole sequences.

Turns become two 64-bit digests, and a prefix is known by the exclusive or of its turns' digests mixed with their depths, which
combines in any grouping: prefixes are running aggregates within chunks of a conversation, corrected by those of the chunks before.
Identical conversations collapse into one weighted sequence with its ends. Sequences that are proper prefixes of others leave by an
anti-join; the rest are the trie's leaves. Only the prefixes of distinct sequences are aggregated into nodes.

A node's smallest member also is the smallest member of each node below it on that member's path, so (conv_id, depth) names a node, and
the savings of a subtree are sums along paths: each path counts the nodes that its own sequence names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadspark.llm.common import batches, rows_of, stored
from threadspark.operators.ranking import rank_within

#: Conversations of one block share the first turns of the block's first.
BLOCK = 20
#: Most turns that are taken from there.
SHARED = 3
#: Turns of one conversation in a task's window.
CHUNK = 4096

NODE = ["depth", "x", "y"]
_WORD = r"[^\x20\x09-\x0D]+"


def running(df: DataFrame, key: str, position: str, values: Mapping[str, tuple[Callable, Callable[[Column, Column], Column]]]) -> DataFrame:
    """``df`` with running aggregates, by ``position`` within ``key``, in place of the columns of ``values`` (name -> aggregate, sum of two).

    Windows hold ``CHUNK`` positions at most, so a key with very many rows is spread over tasks; totals of chunks are carried on.
    """
    cut = df.withColumn("chunk", F.floor(F.col(position) / CHUNK))
    inside = W.partitionBy(key, "chunk").orderBy(position).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy(key).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    totals = cut.groupBy(key, "chunk").agg(*[f(name).alias(name) for name, (f, _) in values.items()])
    carried = totals.select(key, "chunk", *[f(name).over(before).alias(f"{name}_before") for name, (f, _) in values.items()]).filter("chunk > 0")
    local = cut.withColumns({name: f(name).over(inside) for name, (f, _) in values.items()})
    whole = local.join(carried, [key, "chunk"], "left")
    new = {name: F.coalesce(add(F.col(name), F.col(f"{name}_before")), F.col(name)) for name, (_, add) in values.items()}
    return whole.withColumns(new).select(df.columns)


_XOR = (F.bit_xor, lambda a, b: a.bitwiseXOR(b))
_SUM = (F.sum, lambda a, b: a + b)


def turns_of(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, i (1-based place), digests a and b, words of each turn that has a conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"),
        F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(text, F.lit(2), role).alias("b"),
        F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words"),
    )
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("a"), F.asc("b")]
    return rank_within(stored(rows, "turns"), ["conv_id"], order, "i").select("conv_id", "i", "a", "b", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations' turns (conv_id, depth, a, b, words), and all conversations (conv_id).

    Conversation c opens with the first h turns of the first conversation of its block of 20, h being its id's CRC-32 modulo 4, and goes on with
    its own turns after its first h.
    """
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(BLOCK))
    sizes = stored(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "sizes")
    takes = sizes.withColumn("base", base).filter("conv_id <> base").withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % (SHARED + 1))
    heads = turns.filter(F.col("conv_id") == base).filter(F.col("i") <= SHARED).withColumnRenamed("conv_id", "base")
    borrowed = takes.join(heads, "base").filter("i <= h").select("conv_id", F.col("i").cast("long").alias("depth"), "a", "b", "words")
    given = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    shifts = takes.join(given, "base", "left").select("conv_id", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("m"))
    own = turns.join(shifts, "conv_id", "left").withColumns({"h": F.coalesce("h", F.lit(0)), "m": F.coalesce("m", F.lit(0))}).filter("i > h")
    own = own.select("conv_id", (F.col("i") - F.col("h") + F.col("m")).cast("long").alias("depth"), "a", "b", "words")
    return borrowed.union(own), sizes.select("conv_id")


def _collapse(wholes: DataFrame) -> DataFrame:
    """Distinct sequences (depth, x, y) with rep, the smallest conversation, weight, and the digest of all their conversations.

    The digest is sequential, so the ids of one sequence pass through one task, in order and a batch at a time.
    """
    out = "depth long, x long, y long, rep long, weight long, ends string"

    def run(incoming: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            at, rep, weight, digest = None, None, 0, None
            for depth, x, y, conv in rows_of(incoming):
                if (depth, x, y) != at:
                    if at is not None:
                        yield *at, rep, weight, digest.hexdigest()
                    at, rep, weight, digest = (depth, x, y), conv, 0, hashlib.sha256()
                digest.update(b",%d" % conv if weight else b"%d" % conv)
                weight += 1
            if at is not None:
                yield *at, rep, weight, digest.hexdigest()

        yield from batches(rows(), out)

    return wholes.repartition(*NODE).sortWithinPartitions(*NODE, "conv_id").mapInArrow(run, out)


def prefix_trie(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Nodes are the distinct sequences of the first turns (role, text) of the rebuilt conversations, with the root for none; conv_id is a node's
    smallest member. Rows go by turn, a null one first, ties by role and a digest of the turn, so repeated rows stay. Null role or text counts as empty.
    Rows without a conversation id belong to no conversation and are left out; other columns are ignored, whatever their names. Without
    conversations there is no node, and no root. A conversation of any length is spread over tasks in chunks.
    """
    turns, ids = rebuilt(turns_of(conversations, conv_col, turn_col, role_col, text_col))
    mixed = turns.select(
        "conv_id", "depth", "words", F.xxhash64("depth", "a", "b").alias("px"), F.xxhash64("b", "depth", "a", F.lit(3)).alias("py"),
    )
    mixed = running(mixed.withColumns({"x": F.col("px"), "y": F.col("py")}), "conv_id", "depth", {"x": _XOR, "y": _XOR})
    # without its own turn a prefix is its parent
    parents = {"px": F.col("x").bitwiseXOR(F.col("px")), "py": F.col("y").bitwiseXOR(F.col("py"))}
    prefixes = stored(mixed.withColumns(parents).select("conv_id", "depth", "x", "y", "px", "py", "words"), "prefixes")

    last = prefixes.groupBy("conv_id").agg(F.max(F.struct(*NODE)).alias("last")).select("conv_id", "last.*")
    wholes = ids.join(last, "conv_id", "left").select(*[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in NODE], "conv_id")
    sequences = stored(_collapse(wholes), "sequences")

    reps = sequences.select("rep", "weight", F.col("depth").alias("length"))
    below = prefixes.join(reps, prefixes.conv_id == reps.rep).select("rep", "weight", "length", *NODE, "px", "py", "words")
    zero = F.lit(0).cast("long")
    none = F.lit(None).cast("long")
    roots = reps.select("rep", "weight", "length", *[zero.alias(c) for c in NODE], none.alias("px"), none.alias("py"), zero.alias("words"))
    paths = stored(below.union(roots), "paths")

    proper = paths.filter("depth < length").select(*NODE).distinct()
    leaves = sequences.join(proper, NODE, "left_anti").select("rep", F.lit(1).alias("leaf"))
    nodes = paths.join(leaves, "rep", "left").groupBy(*NODE).agg(
        F.min("rep").alias("conv_id"), F.sum("weight").alias("n_convs"), F.coalesce(F.sum("leaf"), zero).alias("n_leaves"),
        F.first("words").alias("words"), F.first("px").alias("px"), F.first("py").alias("py"),
    )
    nodes = stored(nodes.withColumn("saving", (F.col("n_convs") - 1) * F.col("words")), "nodes")

    named = nodes.select(F.col("conv_id").alias("rep"), "depth", "saving")
    mine = paths.select("rep", *NODE).join(named, ["rep", "depth"], "left").withColumn("saving", F.coalesce("saving", zero))
    # the deepest first, so that running sums are those of the rest of the path
    turned = mine.join(reps.select("rep", "length"), "rep").withColumn("up", F.col("length") - F.col("depth")).drop("length")
    savings = running(turned, "rep", "up", {"saving": _SUM}).groupBy(*NODE).agg(F.sum("saving").alias("saved_tokens"))

    up = [(F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")]
    children = nodes.filter("depth > 0").select(*up).groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_children"))
    ends = sequences.select(*NODE, "ends")
    full = nodes.join(savings, NODE).join(children, NODE, "left").join(ends, NODE, "left")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id"))
    full = full.join(above, ["depth", "px", "py"], "left")
    return full.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
