"""Links in posts: extraction, resolution against known posts, inline replacement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadspark.functions.text import URL, contains_any, permalink_id, urls, wiki_link
from threadspark.session import cut_lineage

#: Targets that are broadcast to the links, or to the state; more of them are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Slices that the links to one target are dealt in.
SLICES = 64


def post_urls(override: Column, body: Column) -> Column:
    """Distinct links of a post, sorted: its own target and those in its body."""
    own = F.when(F.coalesce(override, F.lit("")) != "", F.array(override)).otherwise(F.array().cast("array<string>"))
    found = F.coalesce(urls(body), F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(own, found)))


def without_ignored(links: Column, fragments: Sequence[str]) -> Column:
    """Links that hold none of the fragments."""
    return F.filter(links, lambda url: ~contains_any(url, fragments)) if fragments else links


def note_names(state: DataFrame) -> DataFrame:
    """Link text of every known post."""
    return state.select(
        F.col("post_id").alias("dst_id"), wiki_link(F.col("subreddit"), F.col("post_id")).alias("wiki")
    )


def post_edges(posts: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """``post_id, url, dst_id``: one row per distinct link that is not ignored."""
    links = without_ignored(post_urls(F.col("url_overridden_by_dest"), F.col("selftext")), ignore)
    edges = posts.select("post_id", F.explode(links).alias("url"))
    return edges.withColumn("dst_id", permalink_id(F.col("url")))


def known_targets(edges: DataFrame, state: DataFrame) -> tuple[DataFrame, int]:
    """``dst_id, wiki`` of the linked posts that the state knows, written, and their number.

    Each distinct id meets the state once, however many posts link to it.
    """
    ids = cut_lineage(edges.filter(F.col("dst_id").isNotNull()).select("dst_id").distinct())
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    found = cut_lineage(note_names(state).join(ids, "dst_id", "left_semi"))
    return found, found.count()


def _named(pointing: DataFrame, found: DataFrame, rows: int, unique: Sequence[str], how: str) -> DataFrame:
    """Links beside the names of their targets. Beyond a broadcast, links are dealt in slices, so that one target may have very many."""
    if rows <= BROADCAST_ROWS:
        return pointing.join(F.broadcast(found), "dst_id", how)
    sliced = pointing.withColumn("_slice", F.pmod(F.xxhash64(*unique), F.lit(SLICES)))
    each = found.withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SLICES - 1).cast("long"))))
    return sliced.join(each, ["dst_id", "_slice"], how).drop("_slice")


def resolve_links(edges: DataFrame, state: DataFrame) -> DataFrame:
    """Adds ``link``: the note link of a known target, else the URL.

    Links that are no permalinks take no part in a join.
    """
    found, rows = known_targets(edges, state)
    named = _named(edges.filter(F.col("dst_id").isNotNull()), found, rows, ["post_id", "url"], "left")
    others = edges.filter(F.col("dst_id").isNull())
    own = named.select(*edges.columns, F.coalesce("wiki", "url").alias("link"))
    return own.unionByName(others.withColumn("link", F.col("url")))


def post_links(posts: DataFrame, state: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """``post_id, post_links``: resolved links of a post as one text, in URL order.

    A post's links all come from its own text, so the group is bounded by one row.
    """
    resolved = resolve_links(post_edges(posts, ignore), state)
    ordered = F.array_sort(F.collect_list(F.struct("url", "link")))
    grouped = resolved.groupBy("post_id").agg(ordered.alias("_links"))
    distinct = F.array_distinct(F.transform("_links", lambda x: x["link"]))
    return grouped.select("post_id", F.array_join(distinct, ", ").alias("post_links"))


def inline_links(texts: DataFrame, keys: Sequence[str], column: str, state: DataFrame) -> DataFrame:
    """Replace permalinks of known posts inside a text column by their note links.

    ``keys`` identify a row. Only links to posts take part in the state join; the
    text is put together again from the pieces between its links.
    """
    found = texts.select(*keys, F.posexplode(urls(F.col(column))).alias("_pos", "_url"))
    targets = found.withColumn("dst_id", permalink_id(F.col("_url"))).filter(F.col("dst_id").isNotNull())
    known, rows = known_targets(targets, state)
    named = _named(targets, known, rows, [*keys, "_pos"], "inner")
    per_row = named.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_pos", "wiki"))).alias("_wiki"))
    joined = texts.join(per_row, list(keys), "left")
    pieces = F.split(F.col(column), URL, -1)
    links = F.transform(
        urls(F.col(column)), lambda url, i: F.coalesce(F.try_element_at(F.col("_wiki"), i), url)
    )
    whole = F.array_join(
        F.zip_with(pieces, links, lambda piece, link: F.concat(piece, F.coalesce(link, F.lit("")))), ""
    )
    replaced = F.when(F.col("_wiki").isNotNull(), whole).otherwise(F.col(column))
    return joined.withColumn(column, replaced).drop("_wiki")
