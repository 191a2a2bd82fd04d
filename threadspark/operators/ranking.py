"""Ranking that holds when one group owns a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadspark.session import cut_lineage

GROUP_LIMIT = 1000
SALTS = 1024
HOT_ROWS = 1_000_000
BROADCAST_KEYS = 100_000


def top_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str, unique: Sequence[str]
) -> DataFrame:
    """The first ``k`` rows of every group with their rank.

    Up to ``GROUP_LIMIT`` Spark keeps only k rows per group in each map task before
    the shuffle. Beyond that a hot group is first cut down in ``SALTS`` slices.
    """
    if k >= GROUP_LIMIT:
        df = df.withColumn("_salt", F.pmod(F.xxhash64(*unique), F.lit(SALTS)))
        sliced = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = df.withColumn(rank, F.row_number().over(sliced)).filter(F.col(rank) <= k).drop("_salt", rank)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(whole)).filter(F.col(rank) <= k)


def global_position(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """1-based position of each row in one total order, without a one-task window.

    Rows are range partitioned and sorted, then numbered inside each partition;
    the row count of the earlier partitions is added. The sorted rows are written
    once, because both passes must see the same partitions.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    fixed = cut_lineage(ranged.withColumn("_row", F.monotonically_increasing_id()))
    fixed = fixed.withColumn("_part", F.shiftright("_row", 33))
    sizes = fixed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_low"))
    # one row per partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", "_low", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = fixed.join(F.broadcast(starts), "_part")
    position = F.col("_row") - F.col("_low") + F.col("_start") + 1
    return placed.withColumn(name, position).drop("_row", "_part", "_low", "_start")


def _rank_hot(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rank: str, groups: int) -> DataFrame:
    placed = global_position(df, [F.col(k) for k in keys] + list(order), "_pos")
    starts = placed.groupBy(*keys).agg(F.min("_pos").alias("_start"))
    starts = F.broadcast(starts) if groups <= BROADCAST_KEYS else starts
    joined = placed.join(starts, list(keys))
    return joined.withColumn(rank, (F.col("_pos") - F.col("_start") + 1).cast("int")).drop("_pos", "_start")


def rank_within(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], rank: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Rank of every row in its group; ``keys`` must not be null.

    Groups of more than ``hot_rows`` rows are found by a count that combines on the
    map side. They are ranked by position in a range-partitioned order; all other
    groups by an ordinary window.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    hot = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows).drop("_n")
    hot = cut_lineage(hot)
    found = hot.count()
    if found == 0:
        return df.withColumn(rank, F.row_number().over(window))
    hot = F.broadcast(hot) if found <= BROADCAST_KEYS else hot
    usual = df.join(hot, list(keys), "left_anti").withColumn(rank, F.row_number().over(window))
    large = _rank_hot(df.join(hot, list(keys), "left_semi"), keys, order, rank, found)
    return usual.unionByName(large)


def pack_parts(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, part_rows: int, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Values of a group as ordered arrays of at most ``part_rows``, numbered in ``part`` from 0.

    A group of any size stays whole: it only takes more parts.
    """
    ranked = rank_within(df.withColumn("_value", value), keys, order, "_rank", hot_rows)
    ranked = ranked.withColumn("part", F.floor((F.col("_rank") - 1) / part_rows).cast("int"))
    packed = ranked.groupBy(*keys, "part").agg(
        F.array_sort(F.collect_list(F.struct("_rank", "_value")), lambda a, b: a["_rank"] - b["_rank"]).alias("_items")
    )
    return packed.select(*keys, "part", F.transform("_items", lambda x: x["_value"]).alias("items"))
