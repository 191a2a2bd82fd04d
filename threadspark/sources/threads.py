"""Captured thread documents: the clean post and its comments."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadspark.functions.text import strip_prefix
from threadspark.functions.times import from_epoch, ntz
from threadspark.session import cut_lineage

LEVELS_PER_PASS = 6

# Field of the raw post, its type and its default.
TEXT_FIELDS = {
    "post_id": ("id", None),
    "title": ("title", None),
    "author": ("author", None),
    "permalink": ("permalink", None),
    "selftext": ("selftext", ""),
    "domain": ("domain", ""),
    "author_flair": ("author_flair_text", ""),
    "post_flair": ("link_flair_text", ""),
    "url_overridden_by_dest": ("url_overridden_by_dest", None),
}
NUMBER_FIELDS = {
    "score": ("int", 0),
    "upvote_ratio": ("double", 0.0),
    "num_comments": ("int", 0),
    "subreddit_subscribers": ("long", 0),
}
FLAG_FIELDS = ["is_video", "is_gallery", "stickied", "spoiler", "over_18"]


def parse_threads(threads: DataFrame) -> DataFrame:
    """``post_id, doc`` from ``post_id, raw``; payloads that are no list are dropped.

    Documents pass through a one-row explode, so that a filter on them is not pushed below it and does not parse them again.
    """
    parsed = threads.select("post_id", F.explode(F.array(F.try_parse_json("raw"))).alias("doc"))
    return parsed.filter(F.try_variant_get("doc", "$[0]", "variant").isNotNull())


def _field(node: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(node, f"$.{name}", kind)


def clean_posts(parsed: DataFrame, as_of: datetime) -> DataFrame:
    """The clean post of each document, with defaults for missing fields."""
    post = F.try_variant_get("doc", "$[0].data.children[0].data", "variant")
    rows = parsed.select(post.alias("p"))
    p = F.col("p")
    out: list[Column] = []
    for name, (raw, default) in TEXT_FIELDS.items():
        value = _field(p, raw, "string")
        out.append((value if default is None else F.coalesce(value, F.lit(default))).alias(name))
    named = F.coalesce(_field(p, "subreddit_name_prefixed", "string"), F.lit(""))
    out.append(strip_prefix(named).alias("subreddit"))
    for name, (kind, default) in NUMBER_FIELDS.items():
        out.append(F.coalesce(_field(p, name, kind), F.lit(default).cast(kind)).alias(name))
    for name in FLAG_FIELDS:
        out.append(F.coalesce(_field(p, name, "boolean"), F.lit(False)).alias(name))
    created = F.coalesce(_field(p, "created_utc", "double"), F.lit(0.0))
    out.append(from_epoch(created).alias("created_utc"))
    out.append(ntz(as_of).alias("scraped_utc"))
    return rows.select(*out)


def _comment(node: Column, path: Column) -> Column:
    data = "data."
    return F.struct(
        path.alias("path"),
        _field(node, "kind", "string").alias("kind"),
        _field(node, data + "author", "string").alias("author"),
        F.coalesce(_field(node, data + "score", "int"), F.lit(0)).alias("score"),
        F.coalesce(_field(node, data + "body", "string"), F.lit("")).alias("body"),
        F.coalesce(_field(node, data + "stickied", "boolean"), F.lit(False)).alias("stickied"),
        F.try_variant_get(node, "$.data.replies.data.children", "array<variant>").alias("replies"),
    )


def _next_level(rows: DataFrame) -> DataFrame:
    """Each row with unread replies becomes itself plus one row per reply."""
    c = F.col("c")
    closed = c.withField("replies", F.lit(None).cast("array<variant>"))
    children = F.transform(c["replies"], lambda node, i: _comment(node, F.concat(c["path"], F.array(i))))
    opened = F.when(c["replies"].isNotNull(), F.concat(F.array(closed), children)).otherwise(F.array(c))
    return rows.select("post_id", F.explode(opened).alias("c"))


def _to_the_bottom(rows: DataFrame) -> DataFrame:
    """Unfold until no reply is unread; only rows with unread replies enter the next pass."""
    unread = F.col("c.replies").isNotNull()
    done: DataFrame | None = None
    while True:
        for _ in range(LEVELS_PER_PASS):
            rows = _next_level(rows)
        rows = cut_lineage(rows)
        finished = rows.filter(~unread)
        done = finished if done is None else done.unionByName(finished)
        rows = rows.filter(unread)
        if rows.isEmpty():
            return done


def flatten_comments(parsed: DataFrame, levels: int | None = None) -> DataFrame:
    """Comment rows of every document, ``levels`` deep or to the bottom.

    Levels are unfolded inside a row, without a shuffle, a few per pass. Whole trees
    take passes until no reply is unread; each pass continues from a written copy.
    A comment's id is its position path, such as ``0.3.1``.
    """
    top = F.try_variant_get("doc", "$[1].data.children", "array<variant>")
    first = F.transform(top, lambda node, i: _comment(node, F.array(i)))
    rows = parsed.select("post_id", F.explode(first).alias("c"))
    if levels is not None:
        for _ in range(levels - 1):
            rows = _next_level(rows)
    else:
        rows = _to_the_bottom(rows)
    path = F.col("c.path")
    parent = F.when(F.size(path) > 1, F.array_join(F.slice(path, 1, F.size(path) - 1), "."))
    return rows.select(
        "post_id",
        F.array_join(path, ".").alias("comment_id"),
        parent.alias("parent_id"),
        F.element_at(path, -1).cast("long").alias("seq"),
        (F.size(path) - 1).alias("depth"),
        "c.kind", "c.author", "c.score", "c.body", "c.stickied",
    )
