"""Markdown rendering: posts, comment sections, update blocks and the dashboard."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadspark.functions import template
from threadspark.functions.text import label, note_name, python_bool
from threadspark.functions.times import day_text, iso_text, minute_text, ntz
from threadspark.operators.comments import PRESETS, trim_tree
from threadspark.operators.links import inline_links, post_links
from threadspark.operators.ranking import pack_parts
from threadspark.plans.rules import rescrape_after

PART_LINES = 10_000

# The built-in note, comment and update formats.
POST_TEMPLATE = """---
post_URL: https://reddit.com${permalink}
community: ${source}
flair: ${post_flair}
author: ${poster}
subreddit: ${subreddit}
date_posted: ${date_posted}
date_created: ${date_created}
date_scraped: ${date_scraped}
post_id: ${post_id}
score: ${score}
upvote_ratio: ${upvote_ratio}
comments_count: ${num_comments}
is_nsfw: ${is_nsfw}
${rescrape_after}${post_links}tags: 
  - reddit
  - ${source}
---
# ${title}

${selftext}

---
## Top Comments

${comment_section}

${update_section}
"""

COMMENT_TEMPLATE = """${indent}- **${author}** (${score} pts):
${indent}  ${body}
${replies}"""

UPDATE_TEMPLATE = """
---
## Updated Comments (${update_timestamp})

${comments}
"""

# Sorts behind every step of a path.
LAST_STEP = (2147483647, 9223372036854775807)


def comment_lines(tree: DataFrame, layout: str = COMMENT_TEMPLATE) -> DataFrame:
    """``post_id, path, line``: the text of each comment, to be read in ``path`` order.

    The layout is cut at its replies placeholder. What follows it becomes a second
    line that sorts behind the whole subtree.
    """
    head, _, tail = layout.partition("${replies}")
    tabs = F.repeat(F.lit("\t"), F.col("depth"))
    deeper = F.concat(F.lit("\n\t"), tabs)
    values = {
        "author": F.col("author"),
        "score": F.col("score"),
        "body": F.replace(F.col("body"), F.lit("\n"), deeper),
        "indent": tabs,
    }
    opening = F.struct(F.col("path").alias("path"), template.render(head, values).alias("line"))
    if not tail:
        return tree.select("post_id", "comment_id", F.col("path"), opening["line"].alias("line"))
    last = F.struct(F.lit(LAST_STEP[0]).alias("down"), F.lit(LAST_STEP[1]).alias("seq"))
    end_path = F.concat("path", F.array(last))
    closing = F.struct(end_path.alias("path"), template.render(tail, values).alias("line"))
    both = tree.select("post_id", "comment_id", F.explode(F.array(opening, closing)).alias("_l"))
    return both.select("post_id", "comment_id", "_l.path", "_l.line")


def comment_section(lines: DataFrame) -> DataFrame:
    """``post_id, comment_section`` for trees of a bounded preset (at most 70 comments each)."""
    ordered = F.array_sort(F.collect_list(F.struct("path", "line")))
    grouped = lines.groupBy("post_id").agg(ordered.alias("_lines"))
    return grouped.select(
        "post_id", F.array_join(F.transform("_lines", lambda x: x["line"]), "").alias("comment_section")
    )


def comment_parts(lines: DataFrame, part_lines: int = PART_LINES, hot_rows: int | None = None) -> DataFrame:
    """``post_id, part, comment_section`` for trees of any size.

    The parts of a thread, read in order, are its whole section; a thread of up to
    ``part_lines`` lines has exactly one.
    """
    extra = {} if hot_rows is None else {"hot_rows": hot_rows}
    packed = pack_parts(lines, ["post_id"], [F.col("path")], F.col("line"), part_lines, **extra)
    return packed.select("post_id", "part", F.array_join("items", "").alias("comment_section"))


def render_comments(
    comments: DataFrame, detail: str, state: DataFrame | None = None, layout: str = COMMENT_TEMPLATE
) -> DataFrame:
    """``post_id, part, comment_section``; links to known posts are replaced if a state is given."""
    tree = trim_tree(comments, detail)
    if state is not None:
        tree = inline_links(tree, ["post_id", "comment_id"], "body", state)
    lines = comment_lines(tree, layout)
    if PRESETS.get(detail, PRESETS["MD"]) is None:
        return comment_parts(lines)
    return comment_section(lines).withColumn("part", F.lit(0))


def post_values(as_of: datetime, hours: float | None = None) -> dict[str, Column]:
    """The template variables of a post."""
    visit = rescrape_after(F.col("created_utc"), hours, as_of)
    return {
        "post_id": F.col("post_id"),
        "title": F.col("title"),
        "poster": F.col("author"),
        "author": F.col("author"),
        "source": F.col("subreddit"),
        "subreddit": F.col("subreddit"),
        "permalink": F.col("permalink"),
        "selftext": F.col("selftext"),
        "score": F.col("score"),
        "upvote_ratio": F.col("upvote_ratio"),
        "num_comments": F.col("num_comments"),
        "domain": F.col("domain"),
        "post_flair": F.col("post_flair"),
        "label": label(F.col("post_flair")),
        "is_nsfw": python_bool(F.col("over_18")),
        "over_18": python_bool(F.col("over_18")),
        "is_video": python_bool(F.col("is_video")),
        "is_gallery": python_bool(F.col("is_gallery")),
        "stickied": python_bool(F.col("stickied")),
        "spoiler": python_bool(F.col("spoiler")),
        "date_posted": day_text(F.col("created_utc")),
        "date_created": minute_text(F.col("created_utc")),
        "date_scraped": minute_text(ntz(as_of)),
        "rescrape_after": F.concat(F.lit("rescrape_after: "), iso_text(visit), F.lit("\n")),
    }


def render_posts(
    posts: DataFrame,
    as_of: datetime,
    state: DataFrame | None = None,
    comments: DataFrame | None = None,
    detail: str = "MD",
    hours: float | None = None,
    ignore_urls: tuple[str, ...] = (),
    layout: str = POST_TEMPLATE,
) -> DataFrame:
    """``post_id, part, content``: one Markdown note per post.

    Comments of an XL tree beyond one part follow as further parts of the note.
    """
    rows = posts
    values = post_values(as_of, hours)
    if state is not None:
        links = post_links(posts, state, ignore_urls)
        rows = inline_links(rows, ["post_id"], "selftext", state).join(links, "post_id", "left")
        values["post_links"] = F.concat(F.lit("post_links: "), F.col("post_links"), F.lit("\n"))
    if comments is None:
        return rows.select("post_id", F.lit(0).alias("part"), template.render(layout, values).alias("content"))
    sections = render_comments(comments, detail, state)
    first = sections.filter(F.col("part") == 0).drop("part")
    rows = rows.join(first, "post_id", "left")
    values["comment_section"] = F.col("comment_section")
    notes = rows.select("post_id", F.lit(0).alias("part"), template.render(layout, values).alias("content"))
    if PRESETS.get(detail, PRESETS["MD"]) is not None:
        return notes
    rest = sections.filter(F.col("part") > 0).join(posts.select("post_id"), "post_id", "left_semi")
    return notes.unionByName(rest.select("post_id", "part", F.col("comment_section").alias("content")))


def update_block(section: Column, as_of: datetime, layout: str = UPDATE_TEMPLATE) -> Column:
    return template.render(layout, {"update_timestamp": minute_text(ntz(as_of)), "comments": section})


def render_updates(sections: DataFrame, as_of: datetime, layout: str = UPDATE_TEMPLATE) -> DataFrame:
    """``post_id, update_block`` from freshly rendered comment sections."""
    block = update_block(F.col("comment_section"), as_of, layout)
    return sections.withColumn("update_block", block).drop("comment_section")


def dashboard(state: DataFrame, as_of: datetime) -> DataFrame:
    """The eight dashboard columns plus ``post_id`` and ``last_scrape_timestamp`` to sort by."""
    visit = F.col("rescrape_after")
    maturing = ntz(as_of) < visit
    # Status texts of the dashboard.
    status = F.when(visit.isNull(), "✅").when(maturing, "⏳ *Maturing*").otherwise("🔄 *Pending*")
    shown = F.when(visit.isNull(), "-").when(maturing, minute_text(visit)).otherwise("**Ready Now**")
    title = F.coalesce("title", F.lit(""))
    linked = F.concat(
        F.lit("[["), note_name(F.col("subreddit"), F.col("post_id")), F.lit(".md|"), title, F.lit("]]")
    )
    return state.select(
        "post_id",
        "last_scrape_timestamp",
        status.alias("status"),
        F.coalesce("label", F.lit("")).alias("label"),
        F.when(F.col("file_path").isNotNull(), linked).otherwise(title).alias("title"),
        F.coalesce(F.col("score").cast("string"), F.lit("-")).alias("score"),
        F.coalesce("sort_method", F.lit("-")).alias("sort"),
        F.coalesce(minute_text(F.col("post_timestamp")), F.lit("N/A")).alias("post_date"),
        F.coalesce(minute_text(F.col("last_scrape_timestamp")), F.lit("N/A")).alias("last_scrape"),
        shown.alias("rescrape_after"),
    )


# The lines above the dashboard's rows.
DASHBOARD_HEAD = (
    "# 🕵️ Reddit Scrape Dashboard",
    "",
    "| Status | Label | Title | Score | Sort | Post Date | Last Scrape | Re-scrape After |",
    "| :| :| :| :| :| :| :| :|",
)


def dashboard_text(board: DataFrame) -> DataFrame:
    """All lines of the dashboard in order: the head, then one line per post, newest first."""
    head = board.sparkSession.createDataFrame([(n, line) for n, line in enumerate(DASHBOARD_HEAD)], "_no int, line string")
    nothing = F.lit(None)
    head = head.select("_no", nothing.cast("timestamp_ntz").alias("_at"), F.lit("").alias("post_id"), "line")
    body = board.select(F.lit(len(DASHBOARD_HEAD)).alias("_no"), F.col("last_scrape_timestamp").alias("_at"), "post_id", _line())
    return head.unionByName(body).orderBy("_no", F.desc("_at"), "post_id").select("line")


def _line() -> Column:
    cells = ["status", "label", "title", "score", "sort", "post_date", "last_scrape", "rescrape_after"]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line")


def dashboard_lines(board: DataFrame) -> DataFrame:
    """Dashboard rows as pipe-table lines, newest first."""
    return board.orderBy(F.desc("last_scrape_timestamp"), "post_id").select("post_id", _line())
