"""Captured Atom feeds and direct targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadspark.functions.text import direct_id
from threadspark.functions.times import parse_iso

ATOM = "entry array<struct<id:string,link:array<struct<_href:string>>,updated:string>>"


def read_feeds(feeds: DataFrame, offset: int = 0, cap: int | None = None) -> DataFrame:
    """``feed_id, pos, post_id, url, post_date`` from ``feed_id, xml``.

    ``pos`` counts from 0 after the offset. Without a cap every entry is read; a cap counts positions, so entries
    dropped for a missing id, link or date still use theirs up.
    """
    entries = F.from_xml("xml", ATOM)["entry"]
    rows = feeds.select("feed_id", F.posexplode(entries).alias("pos", "e"))
    rows = rows.filter(F.col("pos") >= offset)
    if cap is not None:
        rows = rows.filter(F.col("pos") < offset + cap)
    parsed = rows.select(
        "feed_id",
        (F.col("pos") - offset).alias("pos"),
        F.element_at(F.split("e.id", "_"), -1).alias("post_id"),
        F.try_element_at("e.link", F.lit(1))["_href"].alias("url"),
        parse_iso(F.col("e.updated")).alias("post_date"),
    )
    return parsed.dropna(subset=["post_id", "url", "post_date"])


def direct_targets(targets: DataFrame, posts: DataFrame) -> DataFrame:
    """Posts named by id or by URL in ``targets(target)``."""
    ids = targets.select(direct_id(F.col("target")).alias("post_id")).distinct()
    return posts.join(ids, "post_id", "left_semi")


def union_feeds(*feeds: DataFrame) -> DataFrame:
    """Pages or communities appended into one feed; ``feed_no`` keeps their order."""
    whole = None
    for number, feed in enumerate(feeds):
        part = feed.withColumn("feed_no", F.lit(number))
        whole = part if whole is None else whole.unionByName(part)
    return whole
