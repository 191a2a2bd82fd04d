"""Ingestion history: an append-only table of what each query saw, and its JSON view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadspark.functions.times import iso_text
from threadspark.operators.ranking import HOT_ROWS, pack_parts

PART_ENTRIES = 1000
ENTRY = "struct<type:string,timestamp:string,query:map<string,string>>"
HIDDEN_SETTING = "ignore_urls"


def query_map(settings: Column) -> Column:
    """Settings as kept in the history: everything but the ignored links."""
    return F.map_filter(settings, lambda key, _: key != HIDDEN_SETTING)


def entry(kind: Column, ts: Column, query: Column) -> Column:
    return F.struct(kind.alias("type"), iso_text(ts).alias("timestamp"), query_map(query).alias("query"))


def decode(text: Column) -> Column:
    """History array of a JSON text; bad or missing JSON gives an empty one."""
    empty = F.array().cast(f"array<{ENTRY}>")
    parsed = F.from_json(text, f"array<{ENTRY}>", {"mode": "PERMISSIVE"})
    return F.coalesce(F.filter(parsed, lambda e: e["type"].isNotNull()), empty)


def encode(entries: Column) -> Column:
    return F.to_json(entries)


def append(text: Column, new_entry: Column) -> Column:
    """JSON text of a history with one more entry."""
    return encode(F.array_append(decode(text), new_entry))


def history_parts(
    log: DataFrame, part_entries: int = PART_ENTRIES, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``post_id, part, items``: the entries of each post in time order.

    ``log`` has ``post_id, ts, seq, type, query``. A post seen any number of times
    stays whole: it takes more parts of at most ``part_entries``.
    """
    value = F.struct("ts", "type", "query")
    return pack_parts(log, ["post_id"], [F.col("ts"), F.col("seq")], value, part_entries, hot_rows)


def kind_moments(sights: DataFrame, due: Column) -> DataFrame:
    """``post_id, _first, _late``: each post's first sight and its first one past its due time.

    ``due`` follows from the post date, which is the same in every sight of a post.
    Both moments are minima in one aggregation that combines on the map side, so no
    task sorts one post's whole history.
    """
    moment = F.struct("ts", "seq")
    return sights.groupBy("post_id").agg(
        F.min(F.struct(F.col("ts"), F.col("seq"), due.alias("due"))).alias("_first"),
        F.min(F.when(F.col("ts") > due, moment)).alias("_late"),
    )


def sight_kind(first: Column, again: Column) -> Column:
    moment = F.struct("ts", "seq")
    return (
        F.when(moment == first, "initial")
        .when(F.coalesce(moment == again, F.lit(False)), "rescrape")
        .otherwise("hit")
    )


def classify_sights(sights: DataFrame, hours: float) -> DataFrame:
    """``kind`` of every sight of a post: initial, hit or rescrape.

    The first sight is the scrape. If the post was then younger than ``hours``, the
    first sight after ``post_date + hours`` is the one revisit; all others are hits.
    """
    due = F.col("post_date") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(hours) * 3600))
    moments = kind_moments(sights, due).select(
        "post_id",
        F.struct("_first.ts", "_first.seq").alias("_first"),
        F.when(F.col("_first.ts") < F.col("_first.due"), F.col("_late")).alias("_again"),
    )
    marked = sights.join(moments, "post_id")
    return marked.withColumn("kind", sight_kind(F.col("_first"), F.col("_again"))).select(*sights.columns, "kind")
